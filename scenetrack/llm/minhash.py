"""Near duplicates by ProbMinHash signatures of weighted word shingles, banding and exact verification.

A text is the multiset of its runs of SIZE words (a shorter text is one run); a run seen n times weighs 1 + ln n. Each
run is a Poisson process of its weight's rate: its arrivals take registers at random, and a register keeps the run
that arrives first. Runs stop once their time exceeds every register's, so long texts cost little more than one arrival
a run. Two registers agree with the texts' probability Jaccard similarity.

Texts with the same words are one class from the start; only one document of each is compared. Bands of registers
make buckets. Within a bucket, members are not paired with each other:
  1. each is verified against the bucket's least id (a star); verified links give components;
  2. buckets of three and more that still have several components go on, without members of which more than the
     tolerated share of runs occurs in no other component (they can link to none). Each bucket takes the member with the
     fewest such runs as the next centre;
  3. what is left is joined across components: each text stands in the lists of its rarest runs that other components hold,
     as many as two similar texts can't both do without; places in the lists and bitmaps of the texts bound the similarity from
     above, and what they leave is verified, so that no link between different components of a bucket is lost.
Two documents link if the Jaccard similarity of their sets of runs is THRESHOLD at least, computed from whole texts.

Inside, rows are told apart by 64 bits of their id and text, so ids may be null or repeat with different texts.

Defined cases: null and blank texts have no words and are one class of exact copies; repeated rows are copies; rows of one
id with different texts are documents of their own, as are rows without an id; an empty table gives no rows; extra columns
are ignored; very long texts are bounded by one text's memory.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut_lineage, release, row_key, table, with_hot_keys
from .components import components
from .textops import Texts, U, column_texts, map_texts, mix, record_batch

SIZE, THRESHOLD = 5, 0.8
BANDS, ROWS = 20, 5
REGISTERS = BANDS * ROWS
PART_PAIRS = 1_000  # pairs of a hub that meet one copy of its text
PART_MEMBERS = 1_000  # members of a bucket that are joined with as many others at once
MAP_WORDS = 16  # longs of a text's bitmap


def weighted_runs(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, tuple]:
    """Different runs of all texts: owner, hash, weight; and the texts' fingerprints."""
    words = texts.words()
    hashes, offsets = words.shingles(SIZE)
    owner = np.repeat(np.arange(len(texts)), np.diff(offsets))
    order = np.lexsort((hashes, owner))
    owner, hashes = owner[order], hashes[order]
    first = np.flatnonzero(np.concatenate([[True], (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])])) if len(hashes) else np.zeros(0, np.int64)
    n = np.diff(np.concatenate([first, [len(hashes)]]))
    return owner[first], hashes[first], 1 + np.log(n), words.fingerprints()


def signatures(owner: np.ndarray, hashes: np.ndarray, weight: np.ndarray, texts: int, registers: int = REGISTERS) -> np.ndarray:
    """The run that each register of each text keeps."""
    best = np.full((texts, registers), np.inf)
    kept = np.zeros((texts, registers), U)
    flat_best, flat_kept = best.reshape(-1), kept.reshape(-1)
    state, time = mix(hashes ^ U(0x8E9D5AEB3C6F1A27)), np.zeros(len(hashes))
    alive = np.arange(len(hashes))
    while len(alive):
        state[alive] = mix(state[alive] + U(0x9E3779B97F4A7C15))
        draw = state[alive]
        time[alive] -= np.log(((draw >> U(12)).astype(np.float64) + 0.5) * 2.0**-52) / weight[alive]
        at = owner[alive] * registers + (mix(draw ^ U(0x5851F42D4C957F2D)) % U(registers)).astype(np.int64)
        np.minimum.at(flat_best, at, time[alive])
        won = flat_best[at] == time[alive]
        flat_kept[at[won]] = hashes[alive[won]]
        latest = best.max(1)
        alive = alive[time[alive] < latest[owner[alive]]]
    return kept


def sketch(docs: DataFrame) -> DataFrame:
    """doc_id, row_key, one, two (fingerprint of the words), runs (number of different runs), keys (one per band)."""

    def work(rows, texts):
        owner, hashes, weight, (one, two) = weighted_runs(texts)
        kept = signatures(owner, hashes, weight, len(texts))
        keys = np.zeros((len(texts), BANDS), U)
        for r in range(ROWS):
            keys = mix(keys * U(31) + kept[:, r::ROWS] + np.arange(BANDS, dtype=U) * U(0xD1342543DE82EF95))
        return {"doc_id": rows["doc_id"], "row_key": rows["row_key"], "one": one, "two": two, "runs": np.bincount(owner, minlength=len(texts)).astype(np.int32), "keys": keys}

    kind = "doc_id long, row_key long, one long, two long, runs int, keys array<long>"
    return map_texts(docs.select("doc_id", "text", row_key().alias("row_key")), kind, work)


def run_sets(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Sorted different run hashes of each text, and offsets."""
    owner, hashes, _, _ = weighted_runs(texts)
    return hashes, np.searchsorted(owner, np.arange(len(texts) + 1))


Sets = Callable[[Texts], tuple[np.ndarray, np.ndarray]]


def with_both_texts(pairs: DataFrame, texts: DataFrame, hub: str, other: str, total: int) -> DataFrame:
    """pairs (hub, other) with text_a (the hub's) and text_b. A hub of many pairs meets them in parts of PART_PAIRS, each
    with a copy of its text, so that no task gets all of them; total bounds the pairs of all hubs."""
    degree = cut_lineage(pairs.groupBy(hub).agg(F.count("*").alias("degree")).withColumn("parts", F.ceil(F.col("degree") / PART_PAIRS)))
    dealt = with_hot_keys(pairs, degree, [hub], "degree", total).withColumn("part", F.pmod(F.xxhash64(other), F.col("parts"))).select(hub, other, "part")
    hubs = texts.select(F.col("doc_id").alias(hub), F.col("text").alias("text_a")).join(degree, hub)
    hubs = hubs.select(hub, "text_a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    others = texts.select(F.col("doc_id").alias(other), F.col("text").alias("text_b"))
    return dealt.join(others, other).join(hubs, [hub, "part"]).select(hub, other, "text_a", "text_b")


def verified(pairs: DataFrame, texts: DataFrame, threshold: float, total: int, sets: Sets = run_sets) -> DataFrame:
    """pairs (a, b) whose whole texts have the similarity, as sets; a is the hub of several."""
    both = with_both_texts(pairs, texts, "a", "b", total)

    def check(rows, texts_a):
        hashes_a, at_a = sets(texts_a)
        hashes_b, at_b = sets(column_texts(rows["text_b"]))
        keep = np.zeros(len(texts_a), bool)
        for i in range(len(texts_a)):
            x, y = hashes_a[at_a[i] : at_a[i + 1]], hashes_b[at_b[i] : at_b[i + 1]]
            common = np.intersect1d(x, y, assume_unique=True).size
            keep[i] = common >= threshold * (len(x) + len(y) - common)
        if not keep.any():
            return None
        some = pa.array(keep)
        return {"a": rows["a"].filter(some), "b": rows["b"].filter(some)}

    return map_texts(both, "a long, b long", check, text="text_a")


def run_rows(texts: DataFrame, sets: Sets = run_sets) -> DataFrame:
    """(doc_id, component, run) for every different run of texts (doc_id, component, text)."""

    def work(rows, got):
        hashes, at = sets(got)
        each = lambda c: pa.array(np.repeat(np.array(rows[c]), np.diff(at)))
        return {"doc_id": each("doc_id"), "component": each("component"), "run": hashes}

    return map_texts(texts.select("doc_id", "component", "text"), "doc_id long, component long, run long", work)


def foreign_runs(texts: DataFrame, ids: DataFrame, sets: Sets = run_sets) -> DataFrame:
    """(doc_id, component, run, holders) for the runs of texts (doc_id, text) that are held by several components of ids
    (doc_id, component); holders: by how many texts."""
    runs = cut_lineage(run_rows(texts.join(ids.select("doc_id", "component"), "doc_id"), sets))
    several = runs.groupBy("run").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("holders")).where("lo <> hi").select("run", "holders")
    held = cut_lineage(with_hot_keys(runs, several := cut_lineage(several), ["run"], "holders", runs.count()))
    release(runs, several)
    return held


def links_of(buckets: DataFrame, texts: DataFrame, threshold: float, total: int, sets: Sets = run_sets) -> DataFrame:
    """Verified links (a, b) that connect all documents of the buckets (key, doc_id, runs) which similar texts connect.

    total is the number of documents in buckets, runs the size of a document's set. Frequent keys are met by broadcast
    (BANDS * MOST_HOT rows at most). Sets whose sizes alone rule the similarity out are not compared.
    """
    near_sizes = lambda a, b: F.least(a, b) >= threshold * F.greatest(a, b)
    centre = cut_lineage(buckets.groupBy("key").agg(F.min("doc_id").alias("centre"), F.min_by("runs", "doc_id").alias("centre_runs"), F.count("*").alias("members")).where("members > 1"))
    starred = cut_lineage(with_hot_keys(buckets, centre, ["key"], "members", total))
    stars = starred.where((F.col("doc_id") != F.col("centre")) & near_sizes(F.col("runs"), F.col("centre_runs")))
    stars = cut_lineage(stars.select(F.col("centre").alias("a"), F.col("doc_id").alias("b")).distinct())
    wanted = stars.select(F.col("a").alias("doc_id")).union(stars.select("b")).union(starred.where("members > 2").select("doc_id"))
    wanted = cut_lineage(wanted.distinct())  # its size is known to the optimiser
    few = cut_lineage(texts.join(wanted, "doc_id", "left_semi").dropDuplicates(["doc_id"]))
    links = cut_lineage(verified(stars, few, threshold, total, sets))

    def open_rows(links: DataFrame) -> DataFrame:
        """Rows of buckets of three and more with several components, with the component."""
        named = starred.where("members > 2").join(components(links).select(F.col("vertex").alias("doc_id"), "component"), "doc_id", "left")
        named = cut_lineage(named.select("key", "doc_id", "runs", F.coalesce("component", "doc_id").alias("component"), "centre", "members"))
        several = cut_lineage(named.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.max("members").alias("members")).where("lo <> hi"))
        return with_hot_keys(named, several, ["key"], "members", total, "left_semi")

    rest = cut_lineage(open_rows(links))
    if rest.isEmpty():
        return links
    ids = rest.select("doc_id", "runs", "component").distinct()
    held = foreign_runs(few, ids, sets)
    counted = held.groupBy("doc_id").agg(F.count("*").alias("shared"))
    shared = cut_lineage(ids.join(counted, "doc_id").where(F.col("shared") >= threshold * F.col("runs")).select("doc_id", "shared"))
    release(held)
    if shared.isEmpty():
        return links
    live = cut_lineage(rest.drop("members").join(shared, "doc_id"))
    best = F.struct(F.col("shared") / F.col("runs"), -F.col("doc_id"))
    seconds = cut_lineage(live.groupBy("key").agg(F.max_by("doc_id", best).alias("second"), F.max_by("runs", best).alias("second_runs"), F.count("*").alias("members")))
    again = with_hot_keys(live, seconds, ["key"], "members", total).where((F.col("doc_id") != F.col("second")) & (F.col("second") != F.col("centre")) & near_sizes(F.col("runs"), F.col("second_runs")))
    again = cut_lineage(again.select(F.col("second").alias("a"), F.col("doc_id").alias("b")).distinct())
    more = cut_lineage(verified(possible(again, wide := cut_lineage(bitmaps(few.join(shared, "doc_id"), sets)), threshold, total), few, threshold, total, sets))
    if not more.isEmpty():
        links = links.union(more)
        live = open_rows(links).join(shared, "doc_id")
    ids = cut_lineage(live.select("doc_id", "runs", "component").distinct())
    pairs = cut_lineage(across(rare_lists(foreign_runs(few, ids, sets), ids, threshold), wide, threshold))
    return cut_lineage(links.union(verified(cut_lineage(possible(pairs, wide, threshold, total)), few, threshold, total, sets)))


def set_bits(bits: np.ndarray, owner: np.ndarray, words: int, count: int) -> np.ndarray:
    """Rows of words longs with the given bits set."""
    out = np.zeros((count, words), U)
    np.bitwise_or.at(out, (owner, bits // 64), U(1) << (bits % 64).astype(U))
    return out


def bitmaps(texts: DataFrame, sets: Sets = run_sets) -> DataFrame:
    """doc_id, map (MAP_WORDS longs) and wide (bytes: the number of runs, then the bits of a map of about four times as many bits) of
    each text; every run sets one bit."""

    def work(rows, got):
        hashes, at = sets(got)
        bit, n = (mix(hashes ^ U(0xA24BAED4963EE407)) >> U(2)).astype(np.int64), np.diff(at)
        owner = np.repeat(np.arange(len(got)), n)
        wide = []
        for k in range(len(got)):
            words = 1 << max(int(n[k]) // 16, MAP_WORDS - 1).bit_length()
            each = bit[at[k] : at[k + 1]] % (words * 64)
            wide.append(np.append(U(n[k]), set_bits(each, np.zeros(len(each), np.int64), words, 1)[0]).tobytes())
        return {"doc_id": rows["doc_id"], "map": set_bits(bit % (MAP_WORDS * 64), owner, MAP_WORDS, len(got)), "wide": pa.array(wide, pa.binary())}

    return map_texts(texts.select("doc_id", "text"), "doc_id long, map array<long>, wide binary", work)


def most_common(a: bytes, b: bytes) -> tuple[int, int, int]:
    """Sizes of two sets, and how many runs they have in common at most, by their wide maps."""
    x, y = np.frombuffer(a, U), np.frombuffer(b, U)
    n, m, x, y = int(x[0]), int(y[0]), x[1:], y[1:]
    while len(x) > len(y):
        x = x[: len(x) // 2] | x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] | y[len(y) // 2 :]
    lacks = lambda p, q: int(np.bitwise_count(p & ~q).sum())
    return n, m, min(n - lacks(x, y), m - lacks(y, x))


def possible(pairs: DataFrame, maps: DataFrame, threshold: float, total: int) -> DataFrame:
    """pairs (a, b) that wide maps don't rule out: most pairs of long texts go without their texts."""
    both = with_both_texts(pairs, maps.select("doc_id", F.col("wide").alias("text")), "a", "b", total)

    def check(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch["text_a"], batch["text_b"], strict=True):
                n, m, common = most_common(x.as_py(), y.as_py())
                keep.append(common >= threshold * (n + m - common))
            yield pa.RecordBatch.from_arrays([batch[c].filter(pa.array(keep, pa.bool_())) for c in ("a", "b")], ["a", "b"])

    return both.mapInArrow(check, "a long, b long")


def rare_lists(held: DataFrame, ids: DataFrame, threshold: float) -> DataFrame:
    """key (a run), doc_id, component, runs, left, members, top of the lists by which texts of different components meet.

    held has the runs that several components hold (foreign_runs), ids the texts' numbers of runs. Similar texts have
    threshold of either's runs in common at least, all of them foreign, so in one order of all runs, rarest first, the first
    that they share has so many foreign runs from it on (left) in both; a text stands in the lists of such runs only.
    members is the number of texts in the list, top the component of most of them."""
    order = Window.partitionBy("doc_id").orderBy(F.desc("holders"), F.desc("run"))
    placed = held.select("doc_id", F.col("run").alias("key"), F.row_number().over(order).alias("left")).join(ids, "doc_id")
    placed = cut_lineage(placed.where(F.col("left") >= threshold * F.col("runs")))
    sizes = placed.groupBy("key", "component").agg(F.count("*").alias("n"))
    several = sizes.groupBy("key").agg(F.max_by("component", "n").alias("top"), F.sum("n").alias("members"), F.count("*").alias("components")).where("components > 1").drop("components")
    return cut_lineage(with_hot_keys(placed, cut_lineage(several), ["key"], "members", placed.count()))


def across(lists: DataFrame, maps: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) of different components of a list (rare_lists) that may have the similarity: all but those that sizes, places
    in the list or bitmaps (maps) rule out. Of the first run that two texts share, their common runs are as many as are left
    from it on at most. A bit that only one of two texts sets is a run at least that the other lacks, so their common runs are
    as many as the one's runs less such bits at most.

    A list's texts of its top component are not met with each other: one side is all others. Large lists are cut into parts of
    PART_MEMBERS; each two parts meet in a group of their own, so that no task gets all pairs of a list."""
    parts = F.ceil(F.col("members") / PART_MEMBERS)
    columns = ["key", "doc_id", "component", "top", "runs", "left", *[F.col("map")[k].alias(f"map{k}") for k in range(MAP_WORDS)]]
    dealt = lists.join(maps.select("doc_id", "map"), "doc_id").select(*columns, F.pmod(F.xxhash64("doc_id"), parts).alias("part"), parts.alias("parts"))
    dealt = cut_lineage(dealt)
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))
    x = dealt.where("component <> top").withColumn("low", F.col("part")).withColumn("high", every).alias("x")
    y = dealt.withColumn("high", F.col("part")).withColumn("low", every).alias("y")
    may = (F.col("x.key") == F.col("y.key")) & (F.col("x.low") == F.col("y.low")) & (F.col("x.high") == F.col("y.high"))
    may = may & (F.col("x.component") != F.col("y.component")) & ((F.col("y.component") == F.col("y.top")) | (F.col("x.doc_id") < F.col("y.doc_id")))
    enough = lambda common: common >= threshold * (F.col("x.runs") + F.col("y.runs") - common)
    may = may & (F.least("x.runs", "y.runs") >= threshold * F.greatest("x.runs", "y.runs")) & enough(F.least("x.left", "y.left"))
    lacks = lambda p, q: sum((F.bit_count(F.col(f"{p}.map{k}").bitwiseAND(F.bitwise_not(f"{q}.map{k}"))) for k in range(MAP_WORDS)), F.lit(0))
    similar = enough(F.least(F.col("x.runs") - lacks("x", "y"), F.col("y.runs") - lacks("y", "x")))
    return x.join(y, may & similar).select(F.least("x.doc_id", "y.doc_id").alias("a"), F.greatest("x.doc_id", "y.doc_id").alias("b")).distinct()


def classes_of(docs: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame, int]:
    """Rows (doc_id, row_key, one, two) of docs; per word sequence (one, two) its copies and its class, which is told by
    its first row: head (no_id, doc_id, row_key); and the number of rows."""
    sketches = cut_lineage(sketch(docs))
    total = sketches.count()
    place = F.struct(F.isnull("doc_id").alias("no_id"), "doc_id", "row_key")
    first = cut_lineage(sketches.groupBy("one", "two").agg(F.min(place).alias("head"), F.count("*").alias("copies"), F.first("runs").alias("runs"), F.first("keys").alias("keys")))
    heads = first.where("runs > 0").select(F.col("head.row_key").alias("doc_id"), "runs", "keys")
    buckets = heads.select("doc_id", "runs", F.explode(F.array_distinct("keys")).alias("key"))
    texts = docs.select(row_key().alias("doc_id"), "text")
    links = links_of(buckets, texts, threshold, total)
    named = first.select("one", "two", "copies", "head", F.col("head.row_key").alias("vertex")).join(components(links), "vertex", "left")
    named = cut_lineage(named.withColumn("component", F.coalesce("component", "vertex")))
    tops = named.groupBy("component").agg(F.min("head").alias("head"), F.count("*").alias("texts"))
    classes = cut_lineage(with_hot_keys(named.drop("head"), cut_lineage(tops), ["component"], "texts", total))
    return sketches.select("doc_id", "row_key", "one", "two"), classes.select("one", "two", "copies", "head"), total


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, class_id, copies (rows with the same words), kept; one row per row of docs.

    A class is a connected component of links. class_id is the least id of its rows; where another class has that id
    too (rows of one id with different texts), or no row has an id, it is a negative number drawn from the class's first
    row. kept marks the first row of each class, by id (null ids last), and rows equal to it.
    """
    rows, classes, total = classes_of(docs, threshold)
    head = classes.select("head").distinct().select("head.*")
    shared = Window.partitionBy(F.coalesce("doc_id", "row_key")).orderBy("row_key")  # classes with one least id
    number = F.when(F.isnotnull("doc_id") & (F.row_number().over(shared) == 1), F.col("doc_id")).otherwise(-F.abs(F.col("row_key").bitwiseAND(F.lit((1 << 62) - 1))) - 1)
    named = head.select(F.col("row_key").alias("top"), number.alias("class_id"))
    found = classes.select("one", "two", "copies", F.col("head.row_key").alias("top")).join(named, "top")
    out = with_hot_keys(rows, cut_lineage(found), ["one", "two"], "copies", total)
    return out.select("doc_id", "class_id", "copies", (F.col("row_key") == F.col("top")).alias("kept"))


def without_near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The first row of each class of near-duplicate texts, by id (null ids last); of rows equal to it one stays."""
    _, classes, _ = classes_of(docs, threshold)
    name = "row_key" + "_" * max(map(len, docs.columns))  # no column is as long
    heads = cut_lineage(classes.select(F.col("head.row_key").alias(name)).distinct())
    return docs.withColumn(name, row_key()).join(heads, name, "left_semi").dropDuplicates([name]).select(docs.columns)


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
