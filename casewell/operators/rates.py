"""Counts, rates, pivots, modes and ordered reports.

Every group aggregate combines on the map side first, so the size of a group does not
matter; results have one row per group.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casewell.functions.values import null_to_false
from casewell.session import stage


def _as_number(flag: str | Column) -> Column:
    col = F.col(flag) if isinstance(flag, str) else flag
    return null_to_false(col).cast("int").cast("double")


def row_count(df: DataFrame, name: str = "n") -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias(name))


def is_empty(df: DataFrame) -> bool:
    return df.isEmpty()


def counts(df: DataFrame, *by: str, name: str = "n") -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias(name))


def in_order(df: DataFrame, col: str, values: Sequence[object]) -> DataFrame:
    """Exactly the listed values in their order; a value without a row gives NULLs."""
    dtype = df.schema[col].dataType.simpleString()
    listed = df.sparkSession.createDataFrame(
        list(enumerate(values)), f"_place int, {col} {dtype}"
    )
    ordered = listed.join(df, col, "left").orderBy("_place")
    return ordered.select(*df.columns)


def value_counts(df: DataFrame, col: str, categories: Sequence[object]) -> DataFrame:
    """Counts of the named categories in their order, 0 for the ones not found."""
    found = counts(df.filter(F.col(col).isin(*categories)), col)
    return in_order(found, col, categories).withColumn("n", F.coalesce("n", F.lit(0)))


def rate(df: DataFrame, flag: str, name: str = "rate") -> DataFrame:
    """Percentage of true among the rows that have a value."""
    return df.agg((F.avg(F.col(flag).cast("int")) * 100).alias(name))


def rates(df: DataFrame, by: Sequence[str], flags: Sequence[str]) -> DataFrame:
    """Percentage of each flag per group in one pass; a NULL flag counts as false."""
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        *[(F.avg(_as_number(f)) * 100).alias(f"{f}_rate") for f in flags],
    )


def rate_pivot(
    df: DataFrame,
    row: str,
    col: str,
    flag: str,
    row_order: Sequence[object],
    col_values: Sequence[object],
) -> DataFrame:
    """Rate of a flag by two keys, one column per listed value, rows in fixed order."""
    wide = df.groupBy(row).pivot(col, list(col_values)).agg(F.avg(_as_number(flag)) * 100)
    return in_order(wide, row, row_order)


def scenarios(
    df: DataFrame, conditions: Mapping[str, Column], by: str, flag: str
) -> DataFrame:
    """Rate of a flag per class inside overlapping labelled subsets, from one scan.

    Rows are not repeated per subset: each subset is a pair of conditional counts.
    """
    inside = {label: null_to_false(c) for label, c in conditions.items()}
    on = null_to_false(F.col(flag))
    cells = [
        F.struct(
            F.lit(label).alias("scenario"),
            F.count_if(c).alias("n"),
            F.count_if(c & on).alias("hits"),
        )
        for label, c in inside.items()
    ]
    per_class = df.groupBy(by).agg(F.array(*cells).alias("cells"))
    flat = per_class.select(by, F.inline("cells"))
    share = F.when(F.col("n") > 0, F.col("hits").cast("double") * 100 / F.col("n"))
    return flat.select("scenario", by, "n", share.alias("rate"))


def rate_or_zero(found: DataFrame, by: str, labels: Sequence[str], classes: Sequence[object]) -> DataFrame:
    """The full grid of scenarios and classes, with rate 0 for an empty cell."""
    dtype = found.schema[by].dataType.simpleString()
    grid = found.sparkSession.createDataFrame(
        [(s, c) for s in labels for c in classes], f"scenario string, {by} {dtype}"
    )
    return grid.join(found, ["scenario", by], "left").select(
        "scenario",
        by,
        F.coalesce("n", F.lit(0)).alias("n"),
        F.coalesce("rate", F.lit(0.0)).alias("rate"),
    )


def group_mode(
    df: DataFrame, by: Sequence[str], col: str, name: str = "mode", weight: str | None = None
) -> DataFrame:
    """Most frequent non-NULL value per group, the lowest one on ties.

    Values are counted first, so a group with very many values needs no single buffer.
    `n` counts all rows of the group, NULLs included; a row stands for `weight` rows, if named.
    """
    if weight:
        per_value = df.groupBy(*by, col).agg(F.sum(weight).alias("_n"))
    else:
        per_value = counts(df, *by, col, name="_n")
    best = F.min_by(
        F.col(col),
        F.when(F.col(col).isNotNull(), F.struct((-F.col("_n")).alias("a"), F.col(col).alias("b"))),
    )
    return per_value.groupBy(*by).agg(F.sum("_n").alias("n"), best.alias(name))


def points(df: DataFrame, lat: str, lon: str, kind: str, weight: str | None = None) -> DataFrame:
    """Rows and most frequent kind per coordinate pair; places sharing one point merge."""
    return group_mode(df.dropna("any", subset=[lat, lon]), [lat, lon], kind, kind, weight)


def totals(df: DataFrame, by: str, n: str) -> DataFrame:
    return df.groupBy(by).agg(F.sum(n).alias("total"))


def span(df: DataFrame, col: str) -> DataFrame:
    return df.agg(F.min(col).alias("first"), F.max(col).alias("last"))


def summary(df: DataFrame, ts: str, flag: str) -> DataFrame:
    """Row count, time span and rate of a flag, in one pass."""
    return df.agg(
        F.count(F.lit(1)).alias("n"),
        F.min(ts).alias("first"),
        F.max(ts).alias("last"),
        (F.avg(F.col(flag).cast("int")) * 100).alias("rate"),
    )


def top_values(df: DataFrame, col: str, n: int) -> DataFrame:
    """The `n` most frequent values; equal counts come in value order."""
    found = counts(df.dropna(subset=[col]), col)
    return found.orderBy(F.desc("n"), col).limit(n)


def longest(df: DataFrame, col: str, key: str, n: int) -> DataFrame:
    """The `n` longest texts; equal lengths come in key order."""
    sized = df.dropna(subset=[col]).withColumn("length", F.length(col))
    return sized.orderBy(F.desc("length"), key).limit(n)


def sorted_by(df: DataFrame, key: str) -> DataFrame:
    return df.orderBy(key)


def linear_fit(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))


def entity_profile(df: DataFrame, entity: str, flags: Sequence[str]) -> DataFrame:
    """Number of rows and rate of each flag per entity."""
    return rates(df, [entity], flags)


def conditional_rates(df: DataFrame, by: str, flag: str, given: str) -> DataFrame:
    """Per group: share of all rows, rate of a flag, and its rate where `given` is true."""
    grouped = df.groupBy(by).agg(
        F.count(F.lit(1)).alias("n"),
        (F.avg(_as_number(flag)) * 100).alias("rate"),
        (F.avg(F.when(null_to_false(F.col(given)), _as_number(flag))) * 100).alias("rate_given"),
    )
    # Staged, since the total is read from it: one number, and no group meets another in a task.
    grouped = stage(grouped, "groups")
    total = grouped.agg(F.sum("n")).scalar()
    return grouped.withColumn("share", F.col("n").cast("double") * 100 / total)


def rate_ranking(df: DataFrame, by: str, flag: str) -> DataFrame:
    """Groups by falling rate; equal rates come by size, then by group."""
    return rates(df, [by], [flag]).orderBy(F.desc(f"{flag}_rate"), F.desc("n"), by)


def public_flags(flags: Sequence[str], sensitive: Sequence[str]) -> list[str]:
    """Flags that may appear in a public report."""
    return [f for f in flags if f not in set(sensitive)]
