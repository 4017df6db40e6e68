"""All texts whose sets of word shingles are similar, exactly: light sets by common subsets, heavy sets by inverted lists.

A text's set has its different runs of SIZE words (A to Z in lower case; a shorter text is one run). Sets of s and t runs
have the Jaccard similarity p percent if at least o(s, t) = ceil(p (s + t) / (100 + p)) runs are common. Equal sets are one
vertex from the start. A set of which more than 100 - p percent of the runs occur in no other set links with none and is left
out: first by the runs in a fixed share of the hash space (SHARE), which bound the number from below and are counted
in all sets, then by all runs of the sets that are left. The sets that stay are divided by their number of runs:

Light sets, up to the boundary: a set gives all its subsets of c runs, for each c that some light partner may need. Sets that
share a subset of c have c runs in common at least, and o grows with the sizes, so of the sets of one subset those that link
with any other there link with the smallest: one star for each subset, no comparison, however many share it.

Heavy sets, and lighter ones that a heavy set can reach: each set stands in the inverted lists of its first n - ceil(p n / 100)
+ 1 runs in one order of all runs; two similar sets share one of these. The order puts runs that are frequent in the corpus last
(by counters over all these texts, of which there are COUNTERS), so that lists are short; any order is right. Lists are scanned by
the centres, stars and joins across components of `links_of`, which compares whole texts and loses no link.

The boundary is the one of the least cost, from the number of sets of each size: rows of subsets against rows of lists
and what they are scanned for (LIST_COST subsets' worth a row).

Subsets, runs and sets are told by hashes of 64 bits (sets by two); what lists find is compared by runs.

Defined cases: null and blank texts have no runs and link with nothing; repeated rows are one vertex; rows of one id with
different texts are different vertices; component_id is the least id that a component's rows have, null if none has one; an
empty table gives no rows; extra columns are ignored; very long texts are bounded by one text's memory.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut_lineage, release, row_key, table, tidy, with_hot_keys
from .components import components
from .minhash import links_of
from .textops import BATCH_BYTES, CHUNK_BYTES, WIDE, Texts, U, map_texts, mix, record_batch, slices

SIZE, PERCENT = 5, 80
SHARE = 0.4
COUNTERS = 1 << 17
MOST_LIGHT, LIST_COST = 20, 6.0
MOST_SENT = 4_000_000  # numbers of texts that are sent to all executors at most

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def run_sets(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Sorted different run hashes of each text in lower case, and offsets."""
    hashes, offsets = Texts(LOWER[texts.data], texts.offsets).words().shingles(SIZE)
    owner = np.repeat(np.arange(len(texts)), np.diff(offsets))
    order = np.lexsort((hashes, owner))
    owner, hashes = owner[order], hashes[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    owner, hashes = owner[new], hashes[new]
    return hashes, np.searchsorted(owner, np.arange(len(texts) + 1))


def counter_of(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> U(20)).astype(np.int64) % COUNTERS


def overlap(s: int, t: int, percent: int = PERCENT) -> int:
    """Common runs that sets of s and t runs need."""
    return -(-percent * (s + t) // (100 + percent))


def least_partner(n: int, percent: int = PERCENT) -> int:
    return -(-percent * n // 100)


def subset_sizes(n: int, boundary: int, percent: int = PERCENT) -> list[int]:
    """Sizes of the subsets that a light set of n runs gives: what it needs with some light partner, itself included."""
    return sorted({overlap(n, t, percent) for t in range(least_partner(n, percent), boundary + 1) if least_partner(t, percent) <= n})


def list_rows(n: int, percent: int = PERCENT) -> int:
    return n - least_partner(n, percent) + 1


def chosen_boundary(sizes: dict[int, int], percent: int = PERCENT, most: int = MOST_LIGHT) -> int:
    """Size up to which sets are light, by cost; sizes: number of sets of each size (those above most have the same cost
    for all boundaries)."""

    def cost(boundary: int) -> float:
        reach = least_partner(boundary + 1, percent)
        light = sum(k * comb(n, c) for n, k in sizes.items() if n <= boundary for c in subset_sizes(n, boundary, percent))
        return light + LIST_COST * sum(k * list_rows(n, percent) for n, k in sizes.items() if reach <= n <= most)

    return min(range(most + 1), key=lambda b: (cost(b), b))


def fingerprints(hashes: np.ndarray, at: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit hash of each set, whatever the order of its runs."""
    sums = np.concatenate([[U(0)], np.cumsum(mix(hashes ^ U(seed)), dtype=U)])
    return sums[at[1:]] - sums[at[:-1]]


ONE, TWO = 0x51AFD7ED558CCD25, 0x2545F4914F6CDD1D


def profiles(docs: DataFrame) -> DataFrame:
    """Per row doc_id, row_key, n and two fingerprints of its set."""

    def work(rows: pa.RecordBatch, texts: Texts) -> dict:
        hashes, at = run_sets(texts)
        return {"doc_id": rows["doc_id"], "row_key": rows["row_key"], "n": np.diff(at).astype(np.int32), "one": fingerprints(hashes, at, ONE), "two": fingerprints(hashes, at, TWO)}

    return map_texts(docs.select("doc_id", row_key().alias("row_key"), "text"), "doc_id long, row_key long, n int, one long, two long", work)


def lonely_runs(docs: DataFrame, share: float) -> DataFrame:
    """one (fingerprint of a set), alone: how many of its runs in the given share of the hash space no other set of docs has."""

    def work(rows: pa.RecordBatch, texts: Texts) -> dict:
        hashes, at = run_sets(texts)
        owner = np.repeat(fingerprints(hashes, at, ONE), np.diff(at))
        chosen = mix(hashes) < U(min(int(share * 2.0**64), 2**64 - 1))
        return {"run": hashes[chosen], "one": owner[chosen]}

    runs = map_texts(docs.select("text"), "run long, one long", work)
    single = runs.groupBy("run").agg(F.min("one").alias("one"), F.max("one").alias("last")).where(F.col("one") == F.col("last"))
    return single.groupBy("one").agg(F.count("*").alias("alone"))


def linkable(sets: DataFrame, docs: DataFrame, share: float, percent: int) -> DataFrame:
    """sets (one, n, ...) that may link with another set of docs."""
    found = sets.join(lonely_runs(docs, share), "one", "left")
    return cut_lineage(found.where((F.col("n") - F.coalesce("alone", F.lit(0))) * 100 >= percent * F.col("n")).drop("alone"))


def counters(docs: DataFrame) -> DataFrame:
    """(slot, times): the runs of all sets of a task that fall on each counter."""
    conf = docs.sparkSession.conf
    if conf.get(BATCH_BYTES) == WIDE:
        conf.set(BATCH_BYTES, str(CHUNK_BYTES * 8))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        times = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            for _, texts in slices(batch, "text"):
                times += np.bincount(counter_of(run_sets(texts)[0]), minlength=COUNTERS)
        hit = np.flatnonzero(times)
        yield record_batch({"slot": hit.astype(np.int32), "times": times[hit]})

    return docs.select("text").mapInArrow(run, "slot int, times long")


def frequency_levels(slots: DataFrame) -> np.ndarray:
    """Of each counter, how many times (in powers of two) it holds more than the mean; slots: (slot, times). COUNTERS rows
    at most come to the driver, whatever the corpus."""
    found = slots.groupBy("slot").agg(F.sum("times").alias("times")).toArrow()
    times = np.zeros(COUNTERS)
    times[np.asarray(found["slot"].combine_chunks())] = np.asarray(found["times"].combine_chunks())
    return np.clip(np.floor(np.log2(np.maximum(times, 1) / max(times.mean(), 1))), 0, 15).astype(np.uint8)


def subset_keys(hashes: np.ndarray, size: int) -> np.ndarray:
    """Keys of all subsets of some sets of equal size, one set a row."""
    chosen = np.array(list(itertools.combinations(range(hashes.shape[1]), size)))
    return mix(mix(hashes)[:, chosen].sum(2, dtype=U) + U(size))


def keys(docs: DataFrame, boundary: int, levels: np.ndarray, percent: int = PERCENT) -> DataFrame:
    """vertex, n, subsets (array of (c, key) of light sets), lists (array of the runs whose lists the set is in)."""
    reach = least_partner(boundary + 1, percent)

    def work(rows: pa.RecordBatch, texts: Texts) -> dict:
        hashes, at = run_sets(texts)
        n = np.diff(at)
        owner = np.repeat(np.arange(len(n)), n)
        level = levels[counter_of(hashes)].astype(U)
        order = np.lexsort(((level << U(60)) | (hashes >> U(4)), owner))
        first = np.where(n >= reach, n - -(-percent * n // 100) + 1, 0)
        listed = hashes[order][np.arange(len(hashes)) - np.repeat(at[:-1], n) < np.repeat(first, n)]
        docs_, sizes, found = [], [], []
        for size in np.unique(n[(n > 0) & (n <= boundary)]).tolist():
            which = np.flatnonzero(n == size)
            sets = hashes[at[which][:, None] + np.arange(size)]
            for c in subset_sizes(size, boundary, percent):
                got = subset_keys(sets, c)
                docs_.append(np.repeat(which, got.shape[1]))
                sizes.append(np.full(got.size, c, np.int32))
                found.append(got.reshape(-1))
        docs_, sizes, found = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (docs_, sizes, found))
        order = np.argsort(docs_, kind="stable")
        ends = lambda counts: pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
        subsets = pa.StructArray.from_arrays([pa.array(sizes[order], pa.int32()), pa.array(found[order].view(np.int64))], ["c", "key"])
        return {
            "vertex": rows["vertex"],
            "n": n.astype(np.int32),
            "subsets": pa.ListArray.from_arrays(ends(np.bincount(docs_, minlength=len(n))), subsets),
            "lists": pa.ListArray.from_arrays(ends(first), pa.array(listed.view(np.int64))),
        }

    return map_texts(docs.select("vertex", "text"), "vertex long, n int, subsets array<struct<c:int,key:bigint>>, lists array<long>", work)


def light_links(subsets: DataFrame, total: int, percent: int = PERCENT) -> DataFrame:
    """Links (a, b) of sets (vertex, n, c, key) that share a subset: to the smallest set of each."""
    least = subsets.groupBy("key", "c").agg(F.min(F.struct("n", "vertex")).alias("least"), F.count("*").alias("members")).where("members > 1")
    met = with_hot_keys(subsets, cut_lineage(least), ["key", "c"], "members", total).where(F.col("vertex") != F.col("least.vertex"))
    similar = F.col("c") * (100 + percent) >= percent * (F.col("n") + F.col("least.n"))
    return met.where(similar).select(F.col("least.vertex").alias("a"), F.col("vertex").alias("b")).distinct()


def similar_sets(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id: the least id of the texts that links of the similarity connect with this one."""
    rows = cut_lineage(profiles(docs))
    total = rows.count()
    same = ["n", "one", "two"]
    sets = cut_lineage(rows.where("n > 0").groupBy(same).agg(F.min("row_key").alias("vertex"), F.min("doc_id").alias("least_id"), F.count("*").alias("copies")))
    first = linkable(sets.select("one", "n", "vertex", "copies"), docs, SHARE, percent)
    tidy(docs.sparkSession)
    texts = docs.select(row_key().alias("vertex"), "text")
    if first.count() <= MOST_SENT:  # else all texts would be shuffled to find these
        texts = texts.join(F.broadcast(first.select("vertex")), "vertex", "left_semi")
    else:
        texts = with_hot_keys(texts, first.select("vertex", "copies"), ["vertex"], "copies", total, "left_semi")
    texts = cut_lineage(texts.dropDuplicates(["vertex"]))
    tidy(docs.sparkSession)
    chosen = linkable(first, texts, 1.0, percent)
    live = cut_lineage(texts.join(chosen.select("vertex"), "vertex", "left_semi"))
    release(texts)
    sizes = {r.n: r.k for r in chosen.where(F.col("n") <= MOST_LIGHT).groupBy("n").agg(F.count("*").alias("k")).collect()}
    own = cut_lineage(keys(live, chosen_boundary(sizes, percent), frequency_levels(counters(live)), percent))
    light = cut_lineage(light_links(own.select("vertex", "n", F.inline("subsets")), total, percent))
    lists = own.select(F.col("vertex").alias("doc_id"), F.col("n").alias("runs"), F.explode("lists").alias("key"))
    heavy = links_of(lists, live.withColumnRenamed("vertex", "doc_id"), percent / 100, total, run_sets)
    found = cut_lineage(components(light.union(heavy)))
    named = sets.join(found, "vertex", "left").withColumn("component", F.coalesce("component", "vertex"))
    named = cut_lineage(named.select(*same, "copies", "least_id", "component"))
    tops = cut_lineage(named.groupBy("component").agg(F.min("least_id").alias("component_id"), F.count("*").alias("texts")))
    classes = cut_lineage(with_hot_keys(named.drop("least_id"), tops, ["component"], "texts", total).select(*same, "copies", "component_id"))
    out = with_hot_keys(rows.where("n > 0"), classes, same, "copies", total)
    columns = ["doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id"]
    return out.select(columns).union(rows.where("n = 0").withColumn("component_id", F.col("doc_id")).select(columns))


def op13_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_sets(table(spark, sf_dir, "documents").withColumn("doc_id", F.col("doc_id").cast("long")))
