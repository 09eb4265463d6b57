"""Association statistics. Each one reduces the data to counts per category first; only
those counts, whose number does not depend on the rows, go on to fits and p-values."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casewell.functions.special import chi_square_p, fisher_p, student_p
from casewell.functions.text import matches_any_case
from casewell.functions.values import null_to_false
from casewell.operators.fits import Z95
from casewell.operators.keys import positioned
from casewell.session import stage


def odds_ratios(df: DataFrame, outcome: str, factors: Sequence[str]) -> DataFrame:
    """2x2 table of each factor against the outcome, with odds ratio, 95 % interval of the
    log odds and exact two-sided p. One scan for all factors.

    Ratio and interval are NULL when a cell they divide by is empty.
    """
    y = null_to_false(F.col(outcome))
    cells = []
    for name in factors:
        x = null_to_false(F.col(name))
        cells.append(
            F.struct(
                F.lit(name).alias("factor"),
                F.count_if(x & y).alias("a"),
                F.count_if(x & ~y).alias("b"),
                F.count_if(~x & y).alias("c"),
                F.count_if(~x & ~y).alias("d"),
            )
        )
    table = df.agg(F.array(*cells).alias("cells")).select(F.inline("cells"))
    a, b, c, d = (F.col(k).cast("double") for k in "abcd")
    ratio = F.when((b > 0) & (c > 0), a * d / (b * c))
    filled = (a > 0) & (b > 0) & (c > 0) & (d > 0)
    error = F.when(filled, F.sqrt(1 / a + 1 / b + 1 / c + 1 / d))
    return table.select(
        "factor",
        "a",
        "b",
        "c",
        "d",
        F.when(a + b > 0, a * 100 / (a + b)).alias("rate"),
        ratio.alias("odds_ratio"),
        F.exp(F.log(ratio) - Z95 * error).alias("ci_low"),
        F.exp(F.log(ratio) + Z95 * error).alias("ci_high"),
        fisher_p("a", "b", "c", "d").alias("p_value"),
    )


def chi_square(df: DataFrame, a: str, b: str) -> DataFrame:
    """Pearson chi-square test of two categorical columns.

    Each non-empty cell adds (n - e)^2 / e; an empty one adds its expected count e, and what all
    of those expect together is n less the sum of e over the others. No large numbers cancel.
    """
    cells = df.dropna(subset=[a, b]).groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))
    # Staged: margins and total come from the cells, whose number the levels bound.
    cells = stage(cells, "cells")
    rows = cells.groupBy(a).agg(F.sum("n").cast("double").alias("_row"))
    cols = cells.groupBy(b).agg(F.sum("n").cast("double").alias("_col"))
    total = cells.agg(F.sum("n").alias("n")).first()["n"]
    expected = F.col("_row") * F.col("_col") / F.lit(float(total or 1))
    off = F.col("n") - expected
    sums = cells.join(rows, a).join(cols, b).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"),
        (F.sum(off * off / expected) + F.sum(off)).alias("statistic"),
        F.count_distinct(a).alias("rows"),
        F.count_distinct(b).alias("cols"),
    )
    test = sums.select(
        "n", "statistic", ((F.col("rows") - 1) * (F.col("cols") - 1)).alias("freedom")
    )
    return test.withColumn("p_value", chi_square_p("statistic", "freedom"))


def pearson(
    df: DataFrame, x: str, y: str, exclude: Mapping[str, Column] | None = None
) -> DataFrame:
    """Pearson r, fit line and two-sided p of paired values, for all rows and again
    without the rows of each named condition."""
    subsets = {"all": F.lit(True)}
    for label, condition in (exclude or {}).items():
        subsets[label] = ~null_to_false(condition)
    cells = [
        F.struct(
            F.lit(label).alias("subset"),
            F.count_if(keep & F.col(x).isNotNull() & F.col(y).isNotNull()).alias("n"),
            F.corr(F.when(keep, F.col(x)), F.when(keep, F.col(y))).alias("r"),
            F.regr_slope(F.when(keep, F.col(y)), F.when(keep, F.col(x))).alias("slope"),
            F.regr_intercept(F.when(keep, F.col(y)), F.when(keep, F.col(x))).alias("intercept"),
        )
        for label, keep in subsets.items()
    ]
    result = df.agg(F.array(*cells).alias("cells")).select(F.inline("cells"))
    freedom = (F.col("n") - 2).cast("double")
    t = F.when(
        (freedom > 0) & (F.abs("r") < 1), F.col("r") * F.sqrt(freedom / (1 - F.col("r") * F.col("r")))
    )
    return result.withColumn("p_value", student_p(t, freedom))


def contradictions(df: DataFrame, flag: str, other: str) -> DataFrame:
    """Rows where a flag and a related value disagree, and their share of the flag's rows."""
    on, has = F.col(flag), F.col(other).isNotNull()
    return df.agg(
        F.count_if(~on & has).alias("false_with_value"),
        F.count_if(on & ~has).alias("true_without_value"),
        F.count_if(on.isNull() & has).alias("unknown_with_value"),
        F.count(F.lit(1)).alias("n"),
    )


def agreement(df: DataFrame, a: str, b: str, undecided: str) -> DataFrame:
    """How often two classifiers agree where both decide, and the share left undecided by
    the first alone and by the first with the second as fallback."""
    first = F.coalesce(F.col(a), F.lit(undecided))
    second = F.coalesce(F.col(b), F.lit(undecided))
    both = (first != undecided) & (second != undecided)
    n = F.count(F.lit(1)).cast("double")
    agreed = F.count_if(both & (first == second)).cast("double")
    return df.agg(
        F.count_if(both).alias("both_decided"),
        (agreed * 100 / F.nullif(F.count_if(both), F.lit(0))).alias("agreement"),
        (F.count_if(first == undecided) * 100 / n).alias("undecided_before"),
        (F.count_if((first == undecided) & (second == undecided)) * 100 / n).alias(
            "undecided_after"
        ),
    )


def keyword_counts(df: DataFrame, col: str, words: Mapping[str, str]) -> DataFrame:
    """Texts that contain each keyword pattern and their share, from one scan."""
    found = [
        F.struct(
            F.lit(word).alias("keyword"),
            F.count_if(matches_any_case(F.col(col), pattern)).alias("n"),
            F.count(col).alias("texts"),
        )
        for word, pattern in words.items()
    ]
    flat = df.agg(F.array(*found).alias("found")).select(F.inline("found"))
    return flat.select(
        "keyword", "n", (F.col("n").cast("double") * 100 / F.col("texts")).alias("share")
    )


def fdr(df: DataFrame, p: str, ids: Sequence[str], name: str = "p_adjusted") -> DataFrame:
    """Benjamini-Hochberg adjusted p-values.

    The adjusted value is the least `p * m / rank` among this and all larger p-values.
    It is taken inside each ordered partition and then carried over from the later ones,
    so any number of tests can be ranked.
    """
    tests = df.filter(F.col(p).isNotNull())
    ordered = positioned(tests, [p, *ids], "fdr")
    m = F.col("_total").cast("double")
    scaled = ordered.withColumn("_s", F.col(p) * m / (F.col("_before") + F.col("_pos") + 1))
    least = scaled.groupBy("_part").agg(F.min("_s").alias("_least"))
    later = Window.orderBy(F.desc("_part")).rowsBetween(Window.unboundedPreceding, -1)
    carried = least.select("_part", F.min("_least").over(later).alias("_later"))
    upward = (
        Window.partitionBy("_part").orderBy(F.desc("_pos"))
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        scaled.join(F.broadcast(carried), "_part")
        .withColumn(name, F.least(F.min("_s").over(upward), "_later", F.lit(1.0)))
        .select(*df.columns, name)
    )
