"""Helpers shared by the training-data operators."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.storage import scratch_dir, ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_dir(spark)}/lexmill-{label}-{uuid.uuid4().hex}"


def materialize(spark: SparkSession, df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it again: cuts lineage, survives lost executors."""
    path = new_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._lexmill_path = path
    return out


def discard(spark: SparkSession, df: DataFrame) -> None:
    """Delete a table made by materialize() that no later plan reads."""
    path = spark._jvm.org.apache.hadoop.fs.Path(df._lexmill_path)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def free_shuffles(spark: SparkSession) -> None:
    """Let each finished SQL execution drop its shuffle files, so that steps don't add up on disk."""
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def prepare(spark: SparkSession) -> None:
    """Send this package to the Python workers, wherever the driver imported it from; bound their batches; free shuffles."""
    free_shuffles(spark)
    # rows of very long texts make batches of a bounded number of rows large
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")
    ship(spark)


def utf8_len(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def hashed_sample(df: DataFrame, key: str, rows: int) -> DataFrame:
    """The `rows` rows of df of the least hash of key, or all if they are fewer; which ones does not depend on how df is dealt.

    All but about twice as many rows are filtered out by a bound on the hash first,
    so tasks don't each send that many to the driver.
    """
    total = df.count()
    rank = F.pmod(F.xxhash64(key), F.lit(1 << 40))
    if total > 4 * rows:
        # a share of hashes that holds twice the rows on average; for 256 rows or more it can't fall short by chance
        df = df.where(rank < int((1 << 40) * 2 * max(rows, 256) / total))
    return df.orderBy(rank, key).limit(rows)


def order_bounds(df: DataFrame, key: str, rows_per_bucket: int, most: int = 65536) -> list[int]:
    """Ascending distinct values of an integer key that cut df into buckets of about equal row counts.

    Only these values reach the driver: one for each rows_per_bucket rows, `most` at most.
    """
    n, filled = df.agg(F.count(F.lit(1)), F.count(key)).first()
    k = min(most, max(1, math.ceil(n / rows_per_bucket)))
    if k == 1 or not filled:
        return []
    cuts = [i / k for i in range(1, k)]
    found = df.agg(F.percentile_approx(key, cuts, max(10_000, 20 * k))).first()[0]
    return sorted(set(found or []))


def bucket_of(key: Column, bounds: list[int]) -> Column:
    """Number of bounds below key, by binary search inside the expression; 0 for a null key."""
    if not bounds:
        return F.lit(0)
    at = F.array(*[F.lit(int(b)).cast("long") for b in bounds])
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(len(bounds).bit_length()))])

    def go(lo: Column, step: Column) -> Column:
        to = lo + step
        return F.when(to <= len(bounds), F.when(F.element_at(at, F.least(to, F.lit(len(bounds)))) < key, to).otherwise(lo)).otherwise(lo)

    return F.coalesce(F.aggregate(steps, F.lit(0), go), F.lit(0))
