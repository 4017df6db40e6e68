"""Mixing sources to target weights with a time-varying curriculum (DataFrame functions only).

Each source has a linear weight schedule over training time t in [0, 1]:
    rate(t) = target * (1 + slope * (2t - 1)),   demand(t) = target * (t + slope * (t*t - t)).
A source's documents stand in a fixed pseudo-random order and are read over and over until its target is met. A
document whose words begin at cumulative token c of that stream is trained at the t with demand(t) = c.

The words that a source's documents take add up to its target, rounded; a whole-document mix (mixed_documents) is within half
a document of it.

Defined cases: a null or blank text has size 0 and takes nothing; a null source is a source of its own, last in
order; repeated rows are rows of their own; an empty table gives an empty plan; extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, cut_lineage, table

WEIGHTS = (5, 2, 1)
MOST_REPEATS = 3


def keys() -> list[Column]:
    """k1, k2: 128 bits of a row's id, source and text; equal rows share theirs."""
    parts = [F.isnull("doc_id"), "doc_id", F.isnull("source"), "source", F.coalesce("text", F.lit(""))]
    return [F.xxhash64(*parts).alias("k1"), F.xxhash64(F.lit(9), *parts).alias("k2")]


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, k1, k2, size (words of the whole text)."""
    words = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select("doc_id", "source", *keys(), words.alias("size"))


def source_targets(sized: DataFrame, weights=WEIGHTS, most=MOST_REPEATS) -> DataFrame:
    """One row per source: source_size, weight, target, slope.

    Weights repeat over the sources by code point, null last. All words are shared by weight; no target exceeds
    most times its source, and what is cut off goes to the others by weight. With sources sorted by the level at
    which they meet that limit, the level of the rest after each cut is a running sum, so no loop is needed. The
    table has a row per source, not per document.
    """
    by_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    ranked = by_source.withColumn("ord", F.row_number().over(order)).withColumn("weight", weight)
    limit = (most * F.col("source_size")).cast("double")
    by_level = Window.orderBy(limit / F.col("weight"), "ord")
    everything = Window.partitionBy()
    total = F.sum("source_size").over(everything).cast("double")
    cut_before = F.coalesce(F.sum(limit).over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    weight_left = F.sum("weight").over(by_level.rowsBetween(0, Window.unboundedFollowing))
    level = (total - cut_before) / weight_left
    # the first level that its own source can bear holds for all later ones
    levels = ranked.withColumn("level", level).withColumn("place", F.row_number().over(by_level))
    bears = F.when(F.col("level") <= limit / F.col("weight"), F.col("place"))
    shared = levels.withColumn("level", F.min_by("level", bears).over(everything))
    target = F.least(F.col("weight") * F.coalesce("level", F.lit(float("inf"))), limit)
    lean = F.when(F.col("ord") % 2 == 0, 0.4).otherwise(-0.4)
    out = shared.withColumn("target", target).withColumn("lean", lean)
    mean = F.sum(F.col("lean") * F.col("target")).over(everything) / F.sum("target").over(everything)
    # slopes lean from the mean, so that the sources' rates add up to the same at any time
    return out.select("source", "source_size", "weight", "target", F.coalesce(F.col("lean") - mean, F.lit(0.0)).alias("slope"))


def time_of(words: Column) -> Column:
    """The t with demand(t) = words."""
    share, slope = F.least(words / F.col("target"), F.lit(1.0)), F.col("slope")
    root = (slope - 1 + F.sqrt((1 - slope) * (1 - slope) + 4 * slope * share)) / (2 * slope)
    return F.when(F.abs(slope) < 1e-9, share).otherwise(F.least(F.greatest(root, F.lit(0.0)), F.lit(1.0))) + F.lit(0.0)


def plan(docs: DataFrame, weights=WEIGHTS, most=MOST_REPEATS) -> DataFrame:
    """Per row of docs: doc_id, source, k1, k2, size, source_size, target, taken, takes (array of taken, position).

    Documents are ordered within a source by a hash of the row. Running sums come from sums of hash buckets, so no
    task holds a whole source. The last document of a source is taken up to the word where its demand ends.
    """
    sized = cut_lineage(sizes(docs))
    buckets = max(1, math.isqrt(sized.count()))  # as many as rows in each
    sized = sized.withColumn("bucket", F.pmod("k2", F.lit(buckets)))
    sums = sized.groupBy("source", "bucket").agg(F.sum("size").alias("in_bucket"))
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("base", F.coalesce(F.sum("in_bucket").over(earlier), F.lit(0))).drop("in_bucket")
    # a source without words or target has no position, but its documents stay in the plan
    named = sums.alias("b").join(source_targets(sized, weights, most).alias("s"), F.col("b.source").eqNullSafe(F.col("s.source")))
    named = named.select(F.col("b.source").alias("of"), "bucket", "base", "source_size", "target", "slope").withColumnRenamed("bucket", "of_bucket")
    joined = sized.join(named, F.col("source").eqNullSafe(F.col("of")) & (F.col("bucket") == F.col("of_bucket")))
    within = Window.partitionBy("source", "bucket").orderBy("k2", "k1").rowsBetween(Window.unboundedPreceding, -1)
    begin = F.col("base") + F.coalesce(F.sum("size").over(within), F.lit(0))
    want = F.round("target").cast("long")

    def take(epoch: int) -> Column:
        start = epoch * F.col("source_size") + F.col("begin")
        words = F.greatest(F.least(want - start, F.col("size")), F.lit(0)).cast("long")
        return F.struct(words.alias("taken"), F.when(words > 0, time_of(start.cast("double"))).alias("position"))

    takes = F.filter(F.array(*[take(e) for e in range(most)]), lambda x: x["taken"] > 0)
    out = joined.withColumn("begin", begin).withColumn("takes", takes)
    taken = F.aggregate("takes", F.lit(0).cast("long"), lambda a, x: a + x["taken"])
    return out.select("doc_id", "source", "k1", "k2", "size", "source_size", "target", taken.alias("taken"), "takes")


def curriculum(docs: DataFrame, **options) -> DataFrame:
    """Per row of docs its size, target, words taken and training positions (one per take), range-sorted by the first."""
    places = F.transform("takes", lambda x: x["position"])
    rows = plan(docs, **options).select("doc_id", "source", "size", "source_size", "target", "taken", F.size("takes").cast("long").alias("repeats"), F.try_element_at(places, F.lit(1)).alias("position"), places.alias("positions"))
    return rows.orderBy(F.col("position").asc_nulls_last(), "doc_id")


def training_order(docs: DataFrame, **options) -> DataFrame:
    """One row per take of a document: doc_id, source, size, take (from 1), taken, position; range-sorted by position."""
    rows = plan(docs, **options).select("doc_id", "source", "size", F.posexplode("takes").alias("take", "t"))
    rows = rows.select("doc_id", "source", "size", (F.col("take") + 1).alias("take"), "t.taken", "t.position")
    return rows.orderBy("position", "doc_id", "take")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """One row of docs per take of a document, range-sorted by training position; documents stay whole, so the one at
    which a source's demand ends counts from half of its words on. Equal rows get a take list each."""
    whole = F.filter("takes", lambda x: 2 * x["taken"] >= F.col("size"))
    lists = plan(docs, **options).groupBy("k1", "k2").agg(F.array_sort(F.collect_list(whole)).alias("lists"))
    rows = docs.select(F.struct("*").alias("d"), *keys())
    rows = rows.withColumn("no", F.row_number().over(Window.partitionBy("k1", "k2").orderBy("k1")))
    each = rows.join(lists, ["k1", "k2"]).select("d", F.explode(F.try_element_at("lists", F.col("no"))).alias("take"))
    return each.orderBy("take.position").select("d.*")


def targets(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size and its source's target (3 digits) of each document: the plan before any document is placed."""
    rows = plan(docs)
    return rows.select("doc_id", "size", "source_size", F.round("target", 3).alias("target"))


TARGETS_SQL = """
with sized as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) as size from documents),
sources as (select source, sum(size)::bigint as source_size from sized group by source),
ranked as (select *, 3.0 * source_size as most, [5.0, 2.0, 1.0][((row_number() over (order by source nulls last)) - 1) % 3 + 1]::double as weight from sources),
levels as (select *, row_number() over w as place,
    (sum(source_size) over () - coalesce(sum(most) over (order by most / weight, source nulls last rows between unbounded preceding and 1 preceding), 0))
    / sum(weight) over (order by most / weight, source nulls last rows between current row and unbounded following) as level
    from ranked window w as (order by most / weight, source nulls last)),
shared as (select *, (select level from levels where level <= most / weight order by place limit 1) as common from levels)
select d.doc_id, d.size::bigint as size, s.source_size, round(least(s.weight * coalesce(s.common, 1e300), s.most)::double, 3) as target
from sized d join shared s on d.source is not distinct from s.source
"""


def mixing_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return targets(table(spark, sf_dir, "documents"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curriculum(table(spark, sf_dir, "documents"))
