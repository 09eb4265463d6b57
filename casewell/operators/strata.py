"""2x2 tables in strata: Mantel-Haenszel odds ratio and the exact conditional test.

Given the margins of every stratum, the number of hits in it is hypergeometric, and the test looks
at the sum over strata, whose distribution is their convolution.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casewell.functions.special import summed_p
from casewell.functions.values import null_to_false
from casewell.operators.fits import Z95


@F.pandas_udf(T.DoubleType())
def _exact_p(tables: pd.Series) -> pd.Series:
    """Runs on report rows, one per factor."""
    return pd.Series(
        [summed_p([tuple(int(t[k]) for k in "abcd") for t in own]) for own in tables], dtype="float64"
    )


def stratified_odds(df: DataFrame, outcome: str, factors: Sequence[str], by: str) -> DataFrame:
    """Mantel-Haenszel odds ratio of each factor over the strata of `by`, with the 95 % interval of
    Robins, Breslow and Greenland and the exact conditional p. One scan for all factors.

    (factor, strata, n, odds_ratio, ci_low, ci_high, p_value). A null stratum is one of its own;
    null flags are false. Ratio and interval are NULL where a sum they divide by is 0.
    """
    y = null_to_false(F.col(outcome))
    cells = []
    for name in factors:
        x = null_to_false(F.col(name))
        counts = {"a": x & y, "b": x & ~y, "c": ~x & y, "d": ~x & ~y}
        cells.append(F.struct(F.lit(name).alias("factor"), *[F.count_if(v).alias(k) for k, v in counts.items()]))
    tables = df.groupBy(by).agg(F.array(*cells).alias("cells")).select(F.inline("cells"))
    a, b, c, d = (F.col(k).cast("double") for k in "abcd")
    n = a + b + c + d
    p, q, r, s = (a + d) / n, (b + c) / n, a * d / n, b * c / n
    sums = tables.groupBy("factor").agg(
        F.count(F.lit(1)).alias("strata"),
        F.sum(F.col("a") + F.col("b") + F.col("c") + F.col("d")).alias("n"),
        F.sum(r).alias("r"), F.sum(s).alias("s"),
        F.sum(p * r).alias("pr"), F.sum(p * s + q * r).alias("mixed"), F.sum(q * s).alias("qs"),
        # One table a stratum.
        F.sort_array(F.collect_list(F.struct("a", "b", "c", "d"))).alias("tables"),
    )
    filled = (F.col("r") > 0) & (F.col("s") > 0)
    ratio = F.when(filled, F.col("r") / F.col("s"))
    error = F.when(
        filled,
        F.sqrt(
            F.col("pr") / (2 * F.col("r") * F.col("r"))
            + F.col("mixed") / (2 * F.col("r") * F.col("s"))
            + F.col("qs") / (2 * F.col("s") * F.col("s"))
        ),
    )
    return sums.select(
        "factor", "strata", "n", ratio.alias("odds_ratio"),
        F.exp(F.log(ratio) - Z95 * error).alias("ci_low"),
        F.exp(F.log(ratio) + Z95 * error).alias("ci_high"),
        _exact_p("tables").alias("p_value"),
    )
