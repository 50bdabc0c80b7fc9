"""Stored tables in buckets of their key, of which a load writes only those that it touches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwork.sources.shared import exists, written

BUCKETS = 16
#: Tasks that write a bucket.
PARTS = 4

Combine = Callable[[DataFrame, DataFrame], DataFrame]


def bucket(*keys: str) -> F.Column:
    return F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int")


def stored(spark: SparkSession, folder: str, schema: T.StructType) -> DataFrame:
    """A stored table, without rows where nothing has been stored; schema: that of its rows."""
    if not exists(spark, folder):
        return spark.createDataFrame([], schema)
    return spark.read.schema(T.StructType([*schema.fields, T.StructField("bucket", T.IntegerType())])).parquet(folder).drop("bucket")


def replaced(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old without the rows whose keys new has, and new."""
    named = new.select(*[F.col(k).alias(f"_{k}") for k in keys]).distinct()
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    return old.join(named, same, "left_anti").unionByName(new)


def merged(rows: DataFrame, folder: str, keys: list[str], combine: Combine | None = None, step: Callable[[str], None] | None = None) -> DataFrame:
    """Loads rows into the table in folder: by default they replace what is stored under their keys. Returns the table.

    Only buckets of keys among the rows are read and written: each by overwriting its own partition, when all are ready. A load
    that ended at any point may run again, as long as combine gives the same for rows that are there already. rows are
    written down first, so that what is loaded stays the same. step is told what comes next (a test may stop there).
    """
    spark, step = rows.sparkSession, step or (lambda _: None)
    new = written(rows.withColumn("bucket", bucket(*keys)), "load")
    touched = [r.bucket for r in new.select("bucket").distinct().collect()]  # BUCKETS at most
    if touched:
        out = new
        if exists(spark, folder):
            old = spark.read.schema(new.schema).parquet(folder).where(F.col("bucket").isin(touched))
            out = combine(old, new) if combine else replaced(old, new, keys)
        elif combine:
            out = combine(new.limit(0), new)
        ready = written(out.select(*new.columns), "ready")
        step("write")
        spread = ready.repartition(BUCKETS * PARTS, "bucket", F.pmod(F.xxhash64(*keys), F.lit(BUCKETS * PARTS)))
        spread.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(folder)
        step("done")
    return stored(spark, folder, rows.schema)
