"""Joins. None of them forces a broadcast of data: Catalyst and AQE broadcast a side only
when its estimated or measured size is under `spark.sql.autoBroadcastJoinThreshold`, and
otherwise sort-merge. Where one key holds a large share of the rows of one side, AQE splits its
partition (`spark.sql.adaptive.skewJoin.enabled`), so every size takes the same path."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casewell.functions import text as tx

def attach(facts: DataFrame, dim: DataFrame, on: str | Sequence[str]) -> DataFrame:
    """Left equi join: facts keep their rows when the dimension has no match."""
    return lookup(facts, dim, on)


def attach_unique(facts: DataFrame, other: DataFrame, on: str | Sequence[str]) -> DataFrame:
    """Left equi join where the key is unique on both sides, so that no key can be hot."""
    return facts.join(other, on, "left")


def require(facts: DataFrame, dim: DataFrame, on: str | Sequence[str]) -> DataFrame:
    """Inner equi join: facts without a match are dropped."""
    return facts.join(dim, on, "inner")


def located(
    facts: DataFrame,
    locations: DataFrame,
    attrs: DataFrame,
    location_key: str,
    fact_key: str,
    place: Sequence[str],
    kind: str,
) -> DataFrame:
    """Number `n` of facts that have both a location and attributes, per place and kind.

    Facts are counted per pair of keys and then per location and kind. So a frequent key
    meets its attributes or its location as one row per partner, not per fact.
    """
    pairs = facts.groupBy(location_key, fact_key).agg(F.count(F.lit(1)).alias("n"))
    kinds = pairs.join(attrs, fact_key).groupBy(location_key, kind).agg(F.sum("n").alias("n"))
    return kinds.join(locations, location_key).groupBy(*place, kind).agg(F.sum("n").alias("n"))


def keep_all(left: DataFrame, right: DataFrame, on: str | Sequence[str]) -> DataFrame:
    """All rows of `left`; the right side is NULL where it has none."""
    return left.join(right, on, "left")


def merge_indicator(volume: DataFrame, indicator: DataFrame, on: str) -> DataFrame:
    """Groups present on both sides, all values as doubles."""
    merged = volume.join(indicator, on)
    return merged.select(*[F.col(c).cast("double").alias(c) for c in merged.columns])


def lookup(left: DataFrame, right: DataFrame, key: str | Sequence[str], how: str = "left") -> DataFrame:
    """Equi join (`left` or `inner`) on a key that may be very frequent on the left."""
    return left.join(right, [key] if isinstance(key, str) else list(key), how)


def cache_misses(df: DataFrame, cache: DataFrame, key: str = "key") -> DataFrame:
    """Rows whose content key is not cached. Call it on distinct keys."""
    return df.join(cache.select(key), key, "left_anti")


def cache_apply(
    df: DataFrame, cache: DataFrame, key: str, fallback: Column, name: str
) -> DataFrame:
    """Cached `value` of each row's key as `name`, or `fallback` where there is none."""
    hits = cache.select(key, F.col("value").alias("_value"))
    joined = lookup(df, hits, key)
    return joined.withColumn(name, F.coalesce("_value", fallback)).drop("_value")


def apply_mapping(df: DataFrame, mapping: DataFrame, col: str, key: str = "key") -> DataFrame:
    """Set `col` to the mapped value where the text matches; other rows keep theirs.

    `mapping` has (`old`, `new`). Adds `changed`, true where the value differs.
    """
    keyed = df.withColumn(key, tx.content_key(F.col(col)))
    known = mapping.select(tx.content_key(F.col("old")).alias(key), F.col("new").alias("_new"))
    joined = lookup(keyed, known, key)
    replaced = F.coalesce("_new", col)
    return (
        joined.withColumn("changed", F.coalesce(replaced != F.col(col), F.lit(False)))
        .withColumn(col, replaced)
        .drop("_new", key)
    )


def pending(df: DataFrame, col: str) -> DataFrame:
    """Rows that a former run left without a value."""
    return df.filter(F.col(col).isNull())


def skip_reason(df: DataFrame, street: str, number: str) -> DataFrame:
    """Add the `reason` why a row is not fit for a lookup, NULL for the others."""
    no_street = F.coalesce(F.col(street) == "", F.lit(True))
    no_number = F.coalesce(F.col(number) <= 0, F.lit(True))
    return df.withColumn("reason", F.when(no_street, "no_street").when(no_number, "no_number"))


def resolvable(df: DataFrame, street: str, number: str) -> tuple[DataFrame, DataFrame]:
    """Rows fit for a lookup, and the skipped ones with the reason."""
    marked = skip_reason(df, street, number)
    return marked.filter("reason IS NULL").drop("reason"), marked.filter("reason IS NOT NULL")


def present(df: DataFrame, *cols: str) -> DataFrame:
    """Rows with a value in every one of the columns."""
    return df.dropna("any", subset=list(cols))


def keep_values(df: DataFrame, col: str, values: Sequence[object]) -> DataFrame:
    return df.filter(F.col(col).isin(*values))


def where_all(df: DataFrame, conditions: Mapping[str, bool]) -> DataFrame:
    """Rows where each flag has the wanted value; a NULL flag counts as false."""
    for name, wanted in conditions.items():
        flag = F.coalesce(F.col(name), F.lit(False))
        df = df.filter(flag if wanted else ~flag)
    return df
