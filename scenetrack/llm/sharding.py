"""Sharding by balanced label propagation (DataFrame functions only).

Documents are linked when their texts are equal. Each starts in a shard drawn from its id. In every round a linked
document moves to the shard where most of its neighbours are, as far as that shard's quota lets it; whole groups move
together because the draw is by group. Quotas leave some slack, which a last pass takes back: it makes the counts at most
one apart, and full shards give up unlinked documents first, then small groups. Only a group that exceeds a whole shard is
cut, into as few chunks as that needs. Groups and chunks above 1/PACKED of a shard, which are at most shards * PACKED,
are packed first, the largest first, each into the shard with the most room. What the rounds leave apart is joined last.

Defined cases: null text is empty text; null ids are ids; repeated rows are rows; an empty table gives no rows;
extra columns are ignored; fewer rows than shards leave some shards empty.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut_lineage, table, with_hot_keys

SHARDS, ROUNDS, SLACK, PACKED = 16, 4, 0.2, 64


def linked_rows(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("g1"),
        F.xxhash64(F.lit(8), text).alias("g2"),
        F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(8)).alias("ord"),
    )


def units_of(rows: DataFrame, most: int, count: int) -> DataFrame:
    """rows with unit (group, or chunk of a large group) and whether it has links."""
    groups = cut_lineage(rows.groupBy("g1", "g2").agg(F.count("*").alias("members")).where("members > 1"))
    joined = with_hot_keys(rows, groups, ["g1", "g2"], "members", count, "left")
    chunks = F.ceil(F.col("members") / F.lit(most))
    chunk = F.coalesce(F.pmod("ord", chunks), F.lit(0))
    unit = F.xxhash64("g1", "g2", F.coalesce(chunk, F.lit(0)))
    return joined.withColumn("linked", F.col("members").isNotNull()).withColumn("unit", F.when(F.col("linked"), unit).otherwise(F.xxhash64("g1", "ord")))


def packed(rows: DataFrame, shards: int, count: int) -> DataFrame:
    """rows with the shard (home) of the large units, null for others: largest first into the shard with the most room."""
    sizes = rows.where("linked").groupBy("unit").agg(F.count("*").alias("n")).where(F.col("n") * shards * PACKED > count)
    room = [count // shards + (k < count % shards) for k in range(shards)]
    homes = []
    for unit, n in sorted(sizes.collect(), key=lambda r: (-r.n, r.unit)):  # shards * PACKED rows at most
        home = max(range(shards), key=lambda k: (room[k], -k))
        room[home] -= n
        homes.append((unit, home))
    return rows.join(F.broadcast(rows.sparkSession.createDataFrame(homes, "unit long, home int")), "unit", "left")


def movable(rows: DataFrame) -> DataFrame:
    """rows with the unit to move with, as moves: large units stay in their homes, so their rows get keys of their own, as
    do rows without links; no key has more than 1/PACKED of a shard."""
    return rows.withColumn("moves", F.when(F.col("linked") & F.isnull("home"), F.col("unit")).otherwise(F.xxhash64("unit", "ord")))


def propagate(rows: DataFrame, round_no: int, capacity: float) -> DataFrame:
    """One round over linked rows and the sizes of all: new label of each row."""
    tally = rows.where("linked and home is null").groupBy("unit", "label").agg(F.count("*").alias("n"))
    best = tally.groupBy("unit").agg(F.max_by("label", F.struct("n", -F.col("label"))).alias("best"))
    wish = movable(rows).join(best.withColumnRenamed("unit", "moves"), "moves", "left").drop("moves").withColumn("best", F.coalesce("best", "label"))
    moves = wish.groupBy("label", "best").agg(F.count("*").alias("n"))  # shards * shards rows at most
    into = moves.where("label <> best").groupBy(F.col("best").alias("to")).agg(F.sum("n").alias("coming"))
    of = moves.groupBy(F.col("label").alias("at")).agg(F.sum("n").alias("there"), F.sum(F.when(F.col("label") != F.col("best"), F.col("n")).otherwise(0)).alias("going"))
    room = F.lit(capacity) - F.coalesce("there", F.lit(0)) + F.coalesce("going", F.lit(0)) / 2
    quota = into.join(of, F.col("to") == F.col("at"), "left").select("to", F.least(F.greatest(room / F.col("coming"), F.lit(0.0)), F.lit(1.0)).alias("accepted"))
    draw = F.pmod(F.xxhash64("unit", "best", F.lit(round_no)), F.lit(1_000_000)) / 1e6
    moved = wish.join(F.broadcast(quota), F.col("best") == F.col("to"), "left")
    goes = F.isnull("home") & (F.col("label") != F.col("best")) & (draw < F.coalesce("accepted", F.lit(0.0)))
    return moved.withColumn("label", F.when(goes, F.col("best")).otherwise(F.col("label"))).drop("best", "to", "accepted")


def together(rows: DataFrame) -> DataFrame:
    """Every linked unit in the shard that holds most of it."""
    tally = rows.where("linked and home is null").groupBy("unit", "label").agg(F.count("*").alias("n"))
    best = tally.groupBy("unit").agg(F.max_by("label", F.struct("n", -F.col("label"))).alias("best"))
    return movable(rows).join(best.withColumnRenamed("unit", "moves"), "moves", "left").withColumn("label", F.coalesce("best", "label")).drop("best", "moves")


def level(rows: DataFrame, shards: int, count: int) -> DataFrame:
    """Exact counts: shard and slot of each row; counts differ by one at most.

    Rows of a shard stand in order: linked ones first, those of large groups before others, by unit. Ranks come from counts of buckets of that order.
    Rows beyond a shard's quota are numbered through and fill the gaps of the others.
    """
    buckets = max(1, math.isqrt(count))  # as many as rows in each
    part = F.ceil(F.coalesce("members", F.lit(1)) / buckets)
    rows = rows.withColumn("bucket", F.struct((~F.col("linked")).alias("single"), (-F.floor(F.log2(F.coalesce("members", F.lit(1)).cast("double")))).alias("class"), F.pmod("unit", F.lit(buckets)).alias("b"), F.pmod("ord", part).alias("part")))
    counts = rows.groupBy("label", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("label").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    within = Window.partitionBy("label", "bucket").orderBy("unit", "ord", "doc_id")
    ranked = rows.join(bases, ["label", "bucket"]).withColumn("rank", F.col("base") + F.row_number().over(within) - 1)
    spark = rows.sparkSession
    quota = spark.range(shards).select(F.col("id").cast("int").alias("shard"), (F.lit(count // shards) + (F.col("id") < count % shards).cast("int")).alias("quota"))
    held = counts.groupBy("label").agg(F.sum("n").alias("n"))
    order = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # over one row per shard
    state = quota.join(held, F.col("shard") == F.col("label"), "left").select("shard", "quota", F.coalesce("n", F.lit(0)).alias("n"))
    state = state.withColumn("over", F.greatest(F.col("n") - F.col("quota"), F.lit(0))).withColumn("gap", F.greatest(F.col("quota") - F.col("n"), F.lit(0)))
    state = state.withColumn("over_base", F.coalesce(F.sum("over").over(order), F.lit(0))).withColumn("gap_base", F.coalesce(F.sum("gap").over(order), F.lit(0)))
    state = F.broadcast(cut_lineage(state))
    placed = ranked.join(state.select(F.col("shard").alias("from"), F.col("quota").alias("from_quota"), "over_base"), F.col("label") == F.col("from"))
    number = F.when(F.col("rank") >= F.col("from_quota"), F.col("over_base") + F.col("rank") - F.col("from_quota"))
    placed = placed.withColumn("number", number)
    gaps = state.where("gap > 0").select("shard", "gap_base", "gap", "n")
    fits = (F.col("number") >= F.col("gap_base")) & (F.col("number") < F.col("gap_base") + F.col("gap"))
    out = placed.join(F.broadcast(gaps), fits, "left")
    slot = F.coalesce(F.col("n") + F.col("number") - F.col("gap_base"), F.col("rank"))
    return out.withColumn("shard", F.coalesce("shard", "label").cast("int")).withColumn("slot", slot.cast("long"))


def shard_documents(docs: DataFrame, shards=SHARDS, rounds=ROUNDS, slack=SLACK) -> DataFrame:
    rows = cut_lineage(linked_rows(docs))
    count = rows.count()
    capacity = (1 + slack) * count / shards
    rows = packed(cut_lineage(units_of(rows, max(1, count // shards), count).drop("g1", "g2")), shards, count)
    rows = cut_lineage(rows.withColumn("label", F.coalesce("home", F.pmod("ord", F.lit(shards)).cast("int"))))
    for round_no in range(rounds):
        rows = cut_lineage(propagate(rows, round_no, capacity))
    placed = level(cut_lineage(together(rows)), shards, count)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def cut_edges(placed: DataFrame, text: str = "text_crc32") -> DataFrame:
    """edges, cut: all pairs of rows with equal texts, and those of them in different shards (from counts, not from pairs)."""
    pairs = F.col("n") * (F.col("n") - 1) / 2
    by_shard = placed.groupBy(text, "size", "shard").agg(F.count("*").cast("double").alias("n"))
    groups = by_shard.groupBy(text, "size").agg(F.sum("n").alias("n"), F.sum(pairs).alias("whole"))
    return groups.agg(F.coalesce(F.sum(pairs), F.lit(0.0)).alias("edges"), F.coalesce(F.sum(pairs - F.col("whole")), F.lit(0.0)).alias("cut"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))
