"""Constraint audits and run reports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casewell.functions.text import content_key


class Unique(NamedTuple):
    table: str
    columns: Sequence[str]


class Required(NamedTuple):
    table: str
    columns: Sequence[str]


class Reference(NamedTuple):
    table: str
    column: str
    parent: str
    parent_column: str


def _report(rule: str, table: str, columns: str, violations: Column) -> list[Column]:
    return [
        F.lit(rule).alias("rule"),
        F.lit(table).alias("table_name"),
        F.lit(columns).alias("columns"),
        F.coalesce(violations, F.lit(0)).cast("bigint").alias("violations"),
    ]


def _check(tables: Mapping[str, DataFrame], rule: Unique | Required | Reference) -> DataFrame:
    df = tables[rule.table]
    if isinstance(rule, Unique):
        groups = df.dropna(subset=list(rule.columns)).groupBy(*rule.columns)
        sizes = groups.agg(F.count(F.lit(1)).alias("n"))
        extra = F.sum(F.col("n") - 1)
        return sizes.agg(extra.alias("v")).select(
            *_report("unique", rule.table, ",".join(rule.columns), F.col("v"))
        )
    if isinstance(rule, Required):
        counts = [
            F.struct(*_report("required", rule.table, c, F.count_if(F.col(c).isNull())))
            for c in rule.columns
        ]
        return df.agg(F.array(*counts).alias("r")).select(F.inline("r"))
    # Counted per value first, so a value that many rows share reaches the join once.
    used = df.dropna(subset=[rule.column]).groupBy(F.col(rule.column).alias("key")).agg(
        F.count(F.lit(1)).alias("n")
    )
    known = tables[rule.parent].select(F.col(rule.parent_column).alias("key"))
    orphans = used.join(known, "key", "left_anti").agg(F.sum("n").alias("v"))
    columns = f"{rule.column}->{rule.parent}.{rule.parent_column}"
    return orphans.select(*_report("reference", rule.table, columns, F.col("v")))


def integrity_report(
    tables: Mapping[str, DataFrame], rules: Sequence[Unique | Required | Reference]
) -> DataFrame:
    """Number of rows that break each key, not-null and reference rule."""
    return reduce(DataFrame.unionByName, [_check(tables, rule) for rule in rules])


def run_report(df: DataFrame, before: str, after: str, failed: Column) -> DataFrame:
    """Distinct texts, rows changed and unchanged and failures of a text run, in one pass.

    Texts are told apart by their content key, so the shuffle carries no text.
    """
    changed = F.coalesce(F.col(after) != F.col(before), F.lit(False))
    return df.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_distinct(content_key(F.col(before))).alias("distinct_texts"),
        F.count_if(changed).alias("changed"),
        F.count_if(~changed).alias("unchanged"),
        F.count_if(failed).alias("failed"),
    )
