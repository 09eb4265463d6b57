"""Keyed caches of resolver answers, and the log of attempts without one.

A cache is a keyed log: a batch of answers is written in proportion to itself, and its filter
tells most new keys without a look at the cached ones. A folder of plain Parquet files with the
same columns is read as a cache too, and becomes a log when something is added.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casewell.sources.keyed_log import KeyedLog
from casewell.sources.sinks import table_exists

TEXT_CACHE = T.StructType(
    [T.StructField("key", T.StringType()), T.StructField("value", T.StringType())]
)
POINT_CACHE = T.StructType(
    [
        T.StructField("key", T.StringType()),
        T.StructField("lat", T.DoubleType()),
        T.StructField("lon", T.DoubleType()),
        T.StructField("status", T.StringType()),
    ]
)
ATTEMPTS = T.StructType(
    [
        T.StructField("key", T.StringType()),
        T.StructField("part", T.StringType()),
        T.StructField("tried_at", T.TimestampType()),
        T.StructField("error", T.StringType()),
    ]
)


def cache_log(path: str, schema: T.StructType, order: T.StructField | None = None) -> KeyedLog:
    """The log of a cache: the first answer of a key stays; with an `order` column the last one."""
    if order is None:
        return KeyedLog(path, schema, ("key",), keep="first")
    return KeyedLog(path, T.StructType([*schema.fields, order]), ("key",), (order.name,))


def attempt_log(path: str) -> KeyedLog:
    """One row per key and part of a run in which its call failed."""
    return KeyedLog(f"{path}/attempts", ATTEMPTS, ("key", "part"))


def _plain(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame | None:
    """One row per key of a folder of plain files; None without any."""
    if not table_exists(spark, f"{path}/*.parquet"):
        return None
    rows = spark.read.schema(schema).parquet(f"{path}/*.parquet")
    return _greatest(rows, schema)


def _greatest(rows: DataFrame, schema: T.StructType) -> DataFrame:
    """One row per key: an answer before none, and the greater one of two."""
    values = [n for n in schema.fieldNames() if n != "key"]
    return rows.groupBy("key").agg(F.max(F.struct(*values)).alias("_row")).select("key", "_row.*")


def read_cache(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The cache as a frame with one row per key; an absent one is empty."""
    log = KeyedLog.open(spark, path)
    if log is not None:
        return log.read(spark).select(*schema.fieldNames())
    plain = _plain(spark, path, schema)
    return spark.createDataFrame([], schema) if plain is None else plain


def append_cache(
    entries: DataFrame, path: str, schema: T.StructType, order: str | None = None, unique: bool = False
) -> None:
    """Add entries to the cache, where a key has one entry.

    Without `order` the entry that a key has stays; of new entries that share a key an answer
    counts before none and the greater one of two. With it, an entry takes the place of one with a
    smaller value in that column, whether in the same batch or an earlier one. `unique`: the
    entries are known to have one row per key.
    """
    spark = entries.sparkSession
    log = cache_log(path, schema, None if order is None else entries.schema[order])
    if not log.exists(spark):
        plain = _plain(spark, path, schema)
        if plain is not None:
            old = plain if order is None else plain.withColumn(order, F.lit(None))
            log.append(old, unique=True)
    rows = entries.select(*log.schema.fieldNames())
    log.append(rows if order or unique else _greatest(rows, schema), unique or not order)


def cache_misses(spark: SparkSession, keys: DataFrame, path: str, schema: T.StructType) -> DataFrame:
    """Distinct `key` rows that the cache at `path` lacks; most are told by its filter."""
    log = KeyedLog.open(spark, path)
    if log is not None:
        return log.missing(keys)
    plain = _plain(spark, path, schema)
    return keys if plain is None else keys.join(plain.select("key"), "key", "left_anti")


def attempts(spark: SparkSession, path: str) -> DataFrame:
    """(key, attempts, tried_at, error) of failed calls: their number, the last one's time and error."""
    rows = attempt_log(path).read(spark)
    return rows.groupBy("key").agg(
        F.count(F.lit(1)).alias("attempts"),
        F.max("tried_at").alias("tried_at"),
        F.max_by("error", F.struct("tried_at", "part")).alias("error"),
    )


def failures(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """`attempts` of the keys that still have no answer."""
    failed = attempts(spark, path)
    return failed.join(read_cache(spark, path, schema).select("key"), "key", "left_anti")
