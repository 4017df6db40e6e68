"""Exact repeats of long passages by sparse suffix arrays.

Words are hashed. In every window of SPAN starts the run of SEED words with the least hash marks a suffix, so texts that
share a passage mark the same suffixes in it. A suffix is kept as a hash of its first HEAD words with its position; heads
that occur once in the corpus are dropped. The others are sorted by head and following words, and by head and
preceding words, over range partitions; each is compared with its neighbours in both orders and the match is extended
to the left and to the right, word by word. Where three and more suffixes have one head, a passage may join two that are
neighbours in neither order; the places of such passages that neighbours leave open are keyed by their words on both
sides. A passage of PASSAGE words marks a suffix within its first SPAN words, so HEAD
words of it follow; stretches of matches that reach PASSAGE words are repeats, and overlapping ones are merged.

Copies of a whole text are found by fingerprint first and only one of them is searched; the others get its repeats.

Defined cases: null and blank texts have no words and no repeats; a passage that repeats within one text counts;
repeated rows are copies; rows of one id with different texts are texts of their own, reported under that id, as are rows
without an id under null; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut_lineage, row_key, table, with_hot_keys
from .textops import U, Words, map_texts, mix, record_batch

PASSAGE, SPAN, SEED = 50, 26, 8
HEAD = PASSAGE - SPAN + 1
BEFORE, AFTER = SPAN - 1, SPAN


def marked(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(text, first word) of every suffix that is least in some window of SPAN starts and has HEAD words."""
    n = len(words.hash)
    if n < HEAD:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(words.count)), words.count)
    last = words.first[1:][owner]
    at = np.arange(n)
    seed = words.run_hash(at, np.minimum(at + SEED, last)) | U(1)
    seed[at + HEAD > last] = np.iinfo(np.uint64).max
    # least of each window by doubling; windows stay within a text because its last starts are never least elsewhere
    least, width = seed.copy(), 1
    while width < SPAN:
        step = min(width, SPAN - width)
        nxt = np.full(n, np.iinfo(np.uint64).max)
        nxt[:-step] = np.where(owner[step:] == owner[:-step], least[step:], np.iinfo(np.uint64).max)
        least, width = np.minimum(least, nxt), width + step
    # a start is marked if it is the least of any window that holds it
    need = np.zeros(n, bool)
    for shift in range(SPAN):
        low = at - shift
        same = np.zeros(n, bool)
        same[shift:] = (least[: n - shift] == seed[shift:]) & (owner[: n - shift] == owner[shift:])
        need |= same
    need &= at + HEAD <= last
    pick = np.flatnonzero(need)
    return owner[pick], pick


def heads(docs: DataFrame) -> DataFrame:
    """(head, doc_id, pos) of all marked suffixes."""

    def work(rows, texts):
        words = texts.words()
        owner, at = marked(words)
        ids = np.array(rows["doc_id"])
        return {"head": words.run_hash(at, at + HEAD), "doc_id": ids[owner], "pos": (at - words.first[owner]).astype(np.int32)}

    return map_texts(docs, "head long, doc_id long, pos int", work)


def contexts(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, at: sorted positions) to (head, doc_id, pos, left, right): hashes of the words around."""

    def work(rows, texts):
        words = texts.words()
        lists = rows["at"]
        n = np.diff(np.array(lists.offsets))
        owner = np.repeat(np.arange(len(texts)), n)
        pos = np.array(lists.flatten()).astype(np.int64)
        at = pos + words.first[owner]
        low, high = words.first[owner], words.first[owner + 1]
        small = np.concatenate([(words.hash >> U(32)).astype(np.uint32).view(np.int32), np.zeros(1, np.int32)])

        def around(offsets):
            where = at[:, None] + offsets
            inside = (where >= low[:, None]) & (where < high[:, None])
            # outside a text stand codes that no other text has
            other = (mix(at.astype(U) + (np.array(rows["doc_id"])[owner].view(U) << U(20)))[:, None] + np.arange(len(offsets), dtype=U)).astype(np.uint32).view(np.int32)
            return np.where(inside, small[np.clip(where, 0, len(small) - 1)], other)

        return {"head": words.run_hash(at, at + HEAD), "doc_id": np.array(rows["doc_id"])[owner], "pos": pos.astype(np.int32), "left": around(-1 - np.arange(BEFORE)), "right": around(HEAD + np.arange(AFTER))}

    return map_texts(docs, "head long, doc_id long, pos int, left array<int>, right array<int>", work)


def common(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Length of the common beginning of each pair of rows."""
    same = x == y
    return np.where(same.all(1), same.shape[1], same.argmin(1))


SPANS = "doc_id long, start int, end int"


# A suffix can lie at NEED + 1 places of a passage: a words before it and NEED - a after its head. Bit a of a mask stands
# for such a place.
NEED = PASSAGE - HEAD
ALL = (1 << NEED + 1) - 1
OPEN = "doc_id long, pos int, head long, met int, may int"


def below(n: np.ndarray) -> np.ndarray:
    return (1 << np.maximum(n, 0)) - 1


def places(head: np.ndarray, back: np.ndarray, forth: np.ndarray, order: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of sorted suffixes: the places at which a neighbour meets each, those at which any suffix may (as far as the order
    tells), and which of them are to be looked at again. back and forth are those of the pairs of equal heads."""
    n, a = len(head), np.flatnonzero(head[1:] == head[:-1])
    met, may, degree = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    both = below(back + 1) & ~below(NEED - forth) & ALL
    reach = ALL & ~below(NEED - forth) if order == "right" else below(back + 1) & ALL
    for side in (a, a + 1):
        met[side] |= both
        may[side] |= reach
        degree[side] += 1
    edge = np.zeros(n, bool)
    edge[[0, -1]] = True  # their other neighbour is not here
    degree[edge & (degree > 0)] = 2
    many = degree == 2  # in a run of three and more; two are neighbours in any order
    many[a] |= degree[a + 1] == 2
    many[a + 1] |= degree[a] == 2
    return met, may, np.flatnonzero(many & (edge | (may & ~met != 0)))


def neighbours(suffixes: DataFrame, order: str) -> tuple[DataFrame, DataFrame]:
    """Compare suffixes with their neighbours in the order of head and context: matches of PASSAGE words as spans, and
    the suffixes (OPEN) that a suffix further away may meet where their neighbours don't.

    The sort spreads a frequent head over several partitions. The first row of each partition is met by the last of the
    one before in a second, small pass over partitions' ends.
    """
    # of those with equal words on one side, the ones with most equal words on the other side stand together
    by = ["head", order, "left" if order == "right" else "right", "doc_id", "pos"]
    ranged = suffixes.repartitionByRange(*by).sortWithinPartitions(*by)
    part = ranged.withColumn("part", F.spark_partition_id())

    def compared(batch: dict) -> list[tuple]:
        head, doc, pos, left, right = (batch[k] for k in ("head", "doc_id", "pos", "left", "right"))
        a = np.flatnonzero(head[1:] == head[:-1])
        back, forth = common(left[a], left[a + 1]), common(right[a], right[a + 1])
        met, may, some = places(head, back, forth, order)
        good = back + HEAD + forth >= PASSAGE
        a, back, forth = a[good], back[good], forth[good]
        rows, back, forth = np.concatenate([a, a + 1]), np.concatenate([back, back]), np.concatenate([forth, forth])
        spans = (doc[rows], (pos[rows] - back).astype(np.int32), (pos[rows] + HEAD + forth).astype(np.int32))
        return [spans, (doc[some], pos[some], head[some], met[some].astype(np.int32), may[some].astype(np.int32))]

    def columns(batch: pa.RecordBatch) -> dict:
        out = {k: np.array(batch[k]) for k in ("head", "doc_id", "pos")}
        return out | {k: np.array(batch[k].flatten()).reshape(-1, w) for k, w in (("left", BEFORE), ("right", AFTER))}

    def run(batches):
        """Spans of neighbours within the partition, its open suffixes, and its first and last row as rows of their own."""
        last, first = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            some = columns(batch)
            number = batch["part"][0].as_py()
            if last is not None:
                some = {k: np.concatenate([last[k], v]) for k, v in some.items()}
            else:
                first = {k: v[:1] for k, v in some.items()}
            (doc, start, end), (open_doc, pos, head, met, may) = compared(some)
            yield output(doc, start, end)
            yield output(open_doc, pos, pos, head=head, met=met, may=may)
            last = {k: v[-1:].copy() for k, v in some.items()}
        if first is not None:
            for side, row in enumerate((first, last)):
                yield output(row["doc_id"], row["pos"], row["pos"], edge=pa.array([number * 2 + side], pa.int32()), head=row["head"], left=row["left"], right=row["right"])

    kinds = {"edge": pa.int32(), "head": pa.int64(), "left": pa.list_(pa.int32()), "right": pa.list_(pa.int32()), "met": pa.int32(), "may": pa.int32()}

    def output(doc, start, end, **more):
        return record_batch({"doc_id": doc, "start": start, "end": end, **{k: more.get(k, pa.nulls(len(doc), kind)) for k, kind in kinds.items()}})

    found = cut_lineage(part.mapInArrow(run, SPANS + ", edge int, head long, left array<int>, right array<int>, met int, may int"))
    inner = found.where("head is null").select("doc_id", "start", "end")
    still = found.where("may is not null").select("doc_id", F.col("start").alias("pos"), "head", "met", "may")
    edges = found.where("edge is not null").orderBy("edge").toArrow()  # two rows per partition
    if edges.num_rows < 2:
        return inner, still
    batch = edges.combine_chunks()
    ends = {k: np.array(batch[k].combine_chunks()) for k in ("head", "doc_id")} | {"pos": np.array(batch["start"].combine_chunks())}
    ends |= {k: np.array(batch[k].combine_chunks().flatten()).reshape(-1, w) for k, w in (("left", BEFORE), ("right", AFTER))}
    apart = np.concatenate([[True], (ends["head"][1:] != ends["head"][:-1]) | (ends["doc_id"][1:] != ends["doc_id"][:-1]) | (ends["pos"][1:] != ends["pos"][:-1])])
    met, _ = compared({k: v[apart] for k, v in ends.items()})  # a partition of one row gives it twice
    # the ends that meet: what lies between two ends of one partition was seen there
    again = {k: v[apart] for k, v in ends.items()}
    a = np.flatnonzero(again["head"][1:] == again["head"][:-1])
    back, forth = common(again["left"][a], again["left"][a + 1]), common(again["right"][a], again["right"][a + 1])
    both, reach, _ = places(again["head"], back, forth, order)
    some = np.unique(np.concatenate([a, a + 1]))
    spark = suffixes.sparkSession
    rows = list(zip(*(x.tolist() for x in met), strict=True))
    opened = list(zip(*(x.tolist() for x in (again["doc_id"][some], again["pos"][some], again["head"][some], both[some], reach[some])), strict=True))
    if rows:
        inner = inner.union(spark.createDataFrame(rows, SPANS))
    return inner, still.union(spark.createDataFrame(opened, OPEN)) if opened else still


def further(suffixes: DataFrame, opened: DataFrame, often: DataFrame) -> DataFrame:
    """Spans of the passages in which suffixes of one head meet though they are no neighbours.

    A suffix has open places where some suffix may meet it, as both orders tell, but no neighbour does. Each open place is a
    key of the words there. All suffixes of such heads, of those with equal words around only one, give their keys for
    the places that are open in their head (NEED + 1 at most, no pairs); keys of several suffixes are repeats. All others
    that hold such a key were met by a neighbour.
    """
    joint = opened.groupBy("doc_id", "pos", "head").agg(F.expr("bit_or(met)").alias("met"), *[F.expr(f"bit_or(case when side = '{k}' then may else 0 end)").alias(k) for k in ("right", "left")])
    rest = cut_lineage(joint.select("doc_id", "pos", "head", F.col("right").bitwiseAND(F.col("left")).bitwiseAND(F.bitwise_not("met")).alias("at")).where("at <> 0"))
    at = cut_lineage(rest.groupBy("head").agg(F.expr("bit_or(at)").alias("at")).join(often, "head"))
    total = int(at.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    if not total:
        return suffixes.sparkSession.createDataFrame([], SPANS)

    def keys(rows: DataFrame, *others: str) -> DataFrame:
        bits = F.filter(F.sequence(F.lit(0), F.lit(NEED)), lambda a: F.getbit("at", a) == 1)
        each = rows.select("head", "left", "right", *others, F.explode(bits).alias("a"))
        words = F.xxhash64(F.slice("left", F.lit(1), F.col("a")), F.slice("right", F.lit(1), NEED - F.col("a")))
        return each.select("head", "a", words.alias("words"), *others)

    some = with_hot_keys(suffixes, at, ["head"], "n", total)
    place = F.struct("doc_id", "pos")
    different = some.groupBy("head", F.xxhash64("left").alias("l"), F.xxhash64("right").alias("r")).agg(F.first("left").alias("left"), F.first("right").alias("right"), F.first("at").alias("at"), F.min(place).alias("lo"), F.max(place).alias("hi"))
    shared = keys(different, "lo", "hi").groupBy("head", "a", "words").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("lo <> hi").select("head", "a", "words")
    mine = keys(suffixes.join(rest, ["doc_id", "pos", "head"]), "doc_id", "pos")
    found = mine.join(shared, ["head", "a", "words"], "left_semi")
    return found.select("doc_id", (F.col("pos") - F.col("a")).alias("start"), (F.col("pos") - F.col("a") + PASSAGE).alias("end"))


def merged(spans: DataFrame) -> DataFrame:
    """Union of overlapping spans of each document, by distinct spans of that one document."""
    lists = spans.groupBy("doc_id").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("spans"))

    def run(batches):
        for batch in batches:
            ids, starts, ends = [], [], []
            for doc, some in zip(batch["doc_id"].to_pylist(), batch["spans"].to_pylist(), strict=True):
                begin, end = some[0]["start"], some[0]["end"]
                for s in some[1:]:
                    if s["start"] > end:
                        ids.append(doc), starts.append(begin), ends.append(end)
                        begin, end = s["start"], s["end"]
                    end = max(end, s["end"])
                ids.append(doc), starts.append(begin), ends.append(end)
            yield record_batch({"doc_id": pa.array(ids, pa.int64()), "start": pa.array(starts, pa.int32()), "end": pa.array(ends, pa.int32())})

    return lists.mapInArrow(run, SPANS)


def copy_classes(docs: DataFrame) -> DataFrame:
    """doc_id, row_key, first (least row key with the same words), copies (rows with them), n_words of different rows."""

    def work(rows, texts):
        words = texts.words()
        one, two = words.fingerprints()
        return {"doc_id": rows["doc_id"], "row_key": rows["row_key"], "one": one, "two": two, "n_words": words.count.astype(np.int32)}

    kind = "doc_id long, row_key long, one long, two long, n_words int"
    prints = cut_lineage(map_texts(docs.select("doc_id", "text", row_key().alias("row_key")), kind, work))
    first = cut_lineage(prints.groupBy("one", "two").agg(F.min("row_key").alias("first"), F.count("*").alias("copies")))
    return with_hot_keys(prints, first, ["one", "two"], "copies", prints.count()).select("doc_id", "row_key", "first", "copies", "n_words").distinct()


def by_row(docs: DataFrame) -> DataFrame:
    """docs with the row key for an id: what the search works on."""
    return docs.select(row_key().alias("doc_id"), "text")


def reported(spans: DataFrame, classes: DataFrame) -> DataFrame:
    """(doc_id, start, end) of all rows: spans (by row key) of single rows, and all of each text that has copies."""
    copied = (F.col("copies") > 1) & (F.col("n_words") >= PASSAGE)
    others = classes.where(~copied).join(spans.withColumnRenamed("doc_id", "of"), F.col("first") == F.col("of")).select("doc_id", "start", "end")
    return others.union(classes.where(copied).select("doc_id", F.lit(0).alias("start"), F.col("n_words").alias("end")))


def repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, start, end): merged stretches of words, of PASSAGE at least, that occur elsewhere too."""
    classes = cut_lineage(copy_classes(docs))
    firsts = classes.where("row_key = first and n_words >= %d" % PASSAGE).select(F.col("row_key").alias("doc_id"))
    docs = by_row(docs)
    found = cut_lineage(heads(docs).join(firsts, "doc_id", "left_semi"))
    place = F.struct("doc_id", "pos")
    often = found.groupBy("head").agg(F.min(place).alias("lo"), F.max(place).alias("hi"), F.count("*").alias("n")).where("lo <> hi").select("head", "n")
    often = cut_lineage(often)
    wanted = with_hot_keys(found, often, ["head"], "n", found.count(), "left_semi").groupBy("doc_id").agg(F.array_sort(F.collect_set("pos")).alias("at"))
    with_at = docs.join(wanted, "doc_id").dropDuplicates(["doc_id"])
    suffixes = cut_lineage(contexts(with_at))
    (right, open_right), (left, open_left) = neighbours(suffixes, "right"), neighbours(suffixes, "left")
    opened = open_right.withColumn("side", F.lit("right")).union(open_left.withColumn("side", F.lit("left")))
    return reported(merged(right.union(left).union(further(suffixes, opened, often))), classes)


def op2_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats(table(spark, sf_dir, "documents"))
