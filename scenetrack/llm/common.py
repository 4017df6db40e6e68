"""Session helpers shared by the corpus operators."""

from __future__ import annotations

import gc
import itertools
import uuid
import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scenetrack.session import shared_folder

WHITESPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write df once as a compressed table in the shared folder and read it from there; it goes with the application."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    out = spark.read.schema(df.schema).parquet(path)
    out.table_at = path
    if next(_tables) % TIDY_EVERY == 0:
        tidy(spark)
    return out


_tables, TIDY_EVERY = itertools.count(1), 12


def tidy(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffles and broadcasts of finished tables now, not at the driver's next full collection
    (half an hour apart by default): operators of many rounds leave many."""
    gc.collect()
    spark._jvm.java.lang.System.gc()


def release(*tables: DataFrame) -> None:
    """Delete tables of cut_lineage that nothing lazy refers to any more, so that they don't fill the shared folder."""
    for df in tables:
        at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.table_at)
        at.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def row_key() -> Column:
    """64 bits that tell rows apart by id and text; equal rows share theirs."""
    return F.xxhash64("doc_id", F.coalesce("text", F.lit("")))


MOST_HOT = 1_000


def with_hot_keys(big: DataFrame, small: DataFrame, keys: list[str], members: str, total: int, how: str = "inner") -> DataFrame:
    """big joined with small (one row per key, with the number of big's rows that hold it); how: inner, left or left_semi.

    Keys with more than total / MOST_HOT members, of which there are MOST_HOT at most, meet big by broadcast, so that no
    task gets all rows of a frequent key; the others are shuffled. small is read twice.
    """
    often = F.col(members) * MOST_HOT > total
    hot, rest = small.where(often), small.where(~often)
    few = F.broadcast(hot.select(*keys))
    fits = big.join(F.broadcast(hot), keys, "left_semi" if how == "left_semi" else "inner")
    others = big.join(few, keys, "left_anti").join(rest, keys, how)
    return fits.unionByName(others)


def fold(column: str, modulus: int) -> Column:
    """Fold of a row: crc32 of the id's decimal text, modulo; null ids count as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


def fold_of(doc_id, modulus: int) -> int:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % modulus
