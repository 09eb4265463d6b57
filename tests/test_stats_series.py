from __future__ import annotations

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from casewell.functions.special import (
    chi_square_upper_p,
    fisher_two_sided_p,
    student_two_sided_p,
)
from casewell.operators import rates as Q
from casewell.operators import fits as Fits
from casewell.operators import series as S
from casewell.operators import stats as G


def cells(spark, table):
    """Rows of a 2x2 table (factor, outcome)."""
    a, b, c, d = table
    rows = [(True, True, a), (True, False, b), (False, True, c), (False, False, d)]
    rows = [r for r in rows if r[2]]
    df = spark.createDataFrame(rows, "factor boolean, outcome boolean, n int")
    return df.select("factor", "outcome", F.explode(F.sequence(F.lit(1), F.col("n")))).drop("col")


@pytest.mark.parametrize(
    "table, ratio, low, high, p",
    [((24, 16, 962, 3054), 4.76, 2.52, 9.00, 1.449e-6), ((79, 132, 907, 2938), 1.94, 1.45, 2.59, 1.53e-5)],
)
def test_published_odds_ratios(spark, table, ratio, low, high, p):
    row = G.odds_ratios(cells(spark, table), "outcome", ["factor"]).first()
    assert (row.a, row.b, row.c, row.d) == table
    assert [round(v, 2) for v in (row.odds_ratio, row.ci_low, row.ci_high)] == [ratio, low, high]
    assert row.p_value == pytest.approx(p, rel=2e-3)


def test_odds_ratio_of_empty_cells_is_null(spark):
    row = G.odds_ratios(cells(spark, (3, 0, 1, 5)), "outcome", ["factor"]).first()
    assert row.odds_ratio is None and row.ci_low is None and 0 < row.p_value < 1


def brute_fisher(a, b, c, d):
    def weight(k):
        return math.comb(a + b, k) * math.comb(c + d, a + c - k)

    ks = range(max(0, a - d), min(a + b, a + c) + 1)
    return sum(weight(k) for k in ks if weight(k) <= weight(a)) / math.comb(a + b + c + d, a + c)


def test_fisher_equals_brute_force():
    random.seed(3)
    tables = [tuple(random.randint(0, 12) for _ in range(4)) for _ in range(200)]
    for t in tables:
        assert fisher_two_sided_p(*t) == pytest.approx(brute_fisher(*t), rel=1e-6), t


def test_tail_probabilities():
    assert chi_square_upper_p(3.841458820694124, 1) == pytest.approx(0.05, rel=1e-9)
    assert chi_square_upper_p(20, 4) == pytest.approx(math.exp(-10) * 11, rel=1e-12)
    assert chi_square_upper_p(0, 3) == 1
    assert student_two_sided_p(2.2281388519649385, 10) == pytest.approx(0.05, rel=1e-9)
    assert student_two_sided_p(1.0, 1) == pytest.approx(0.5, rel=1e-12)
    # r = 0.57 over 15 zones, r = 0.47 over 14.
    for r, n, p in ((0.57, 15, 0.0265), (0.47, 14, 0.0898)):
        assert student_two_sided_p(r * math.sqrt((n - 2) / (1 - r * r)), n - 2) == pytest.approx(p, abs=5e-4)


def test_pearson(spark):
    xs = [(i, float(i), 2.0 * i + (-1) ** i) for i in range(12)]
    df = spark.createDataFrame(xs, "zone int, x double, y double")
    both = {r.subset: r for r in G.pearson(df, "x", "y", {"without 0": F.col("zone") == 0}).collect()}
    assert both["all"].n == 12 and both["without 0"].n == 11
    assert 0 < both["all"].p_value < 1e-6 and both["all"].r > 0.98
    fit = Q.linear_fit(df, "x", "y").first()
    assert fit.slope == pytest.approx(both["all"].slope)


def test_chi_square_equals_odds_table(spark):
    row = G.chi_square(cells(spark, (30, 10, 20, 40)), "factor", "outcome").first()
    n, expected = 100, 100 * (30 * 40 - 10 * 20) ** 2 / (40 * 60 * 50 * 50)
    assert (row.n, row.freedom) == (n, 1)
    assert row.statistic == pytest.approx(expected)
    assert row.p_value == pytest.approx(math.erfc(math.sqrt(expected / 2)))


def test_logistic_of_one_factor_is_its_odds_ratio(spark):
    df = cells(spark, (24, 16, 962, 3054))
    fit = {r.term: r for r in Fits.logistic_or(df, "outcome", ["factor"]).collect()}
    assert set(fit) == {"factor_true", "(intercept)"}
    row = fit["factor_true"]
    assert [round(v, 2) for v in (row.odds_ratio, row.ci_low, row.ci_high)] == [4.76, 2.52, 9.00]
    z = math.log(row.odds_ratio) / (math.log(row.ci_high / row.odds_ratio) / G.Z95)
    assert row.p_value == pytest.approx(math.erfc(z / math.sqrt(2)), rel=1e-3)


def test_logistic_separates_a_confounder(spark):
    """The outcome depends on severity only; the factor goes along with severity."""
    random.seed(11)
    rows = []
    for _ in range(6000):
        severe = random.random() < 0.4
        factor = random.random() < (0.7 if severe else 0.1)
        rows.append((factor, severe, random.random() < (0.6 if severe else 0.2)))
    df = spark.createDataFrame(rows, "factor boolean, severe boolean, outcome boolean")
    fit = {r.term: r for r in Fits.logistic_or(df, "outcome", ["factor", "severe"]).collect()}
    assert fit["factor_true"].ci_low < 1 < fit["factor_true"].ci_high
    assert fit["severe_true"].ci_low > 3


def test_fdr_equals_brute_force(spark):
    random.seed(7)
    ps = [round(random.random() ** 3, 4) for _ in range(400)] + [0.01] * 30
    df = spark.createDataFrame(list(enumerate(ps)), "id int, p double").repartition(4)
    found = {r.id: r.p_adjusted for r in G.fdr(df, "p", ["id"]).collect()}
    order = sorted(range(len(ps)), key=lambda i: (ps[i], i))
    best, expected = 1.0, {}
    for rank in range(len(ps), 0, -1):
        i = order[rank - 1]
        best = min(best, ps[i] * len(ps) / rank)
        expected[i] = best
    assert found == pytest.approx(expected)


def test_mann_kendall_equals_pairs(spark):
    random.seed(2)
    for values in ([random.randint(0, 9) + i // 5 for i in range(53)], [4] * 6, [3, 1, 2], [5]):
        df = spark.createDataFrame(list(enumerate(values)), "t int, n long")
        row = S.mann_kendall(df, "t", "n").first()
        pairs = [(a, b) for i, a in enumerate(values) for b in values[i + 1 :]]
        assert row.s == sum((b > a) - (b < a) for a, b in pairs)
        assert row.periods == len(values)
        if len(set(values)) == 1:
            assert row.z is None and row.p_value is None


def brute_logistic(rows, terms):
    """Newton steps on the rows themselves."""
    levels = [sorted({r[i + 1] for r in rows}) for i in range(terms)]
    x = np.array([[*[float(r[i + 1] == v) for i in range(terms) for v in levels[i][1:]], 1.0] for r in rows])
    y, beta = np.array([float(r[0]) for r in rows]), np.zeros(x.shape[1])
    for _ in range(40):
        mean = 1 / (1 + np.exp(-x @ beta))
        information = x.T @ (x * (mean * (1 - mean))[:, None])
        beta = beta + np.linalg.solve(information, x.T @ (y - mean))
    errors = np.sqrt(np.diag(np.linalg.inv(information)))
    return beta, [math.erfc(abs(b / e) / math.sqrt(2)) for b, e in zip(beta, errors)]


def test_logistic_equals_newton_on_rows(spark):
    random.seed(8)
    rows = [(random.random() < 0.3 + 0.2 * (a == "y"), a, b) for a, b in (random.choices("xyz", k=2) for _ in range(700))]
    df = spark.createDataFrame(rows, "outcome boolean, a string, b string").repartition(3)
    found = {r["term"]: r for r in Fits.logistic_or(df, "outcome", ["a", "b"]).collect()}
    beta, p = brute_logistic(rows, 2)
    for name, b, own in zip(["a_y", "a_z", "b_y", "b_z", "(intercept)"], beta, p):
        assert found[name]["odds_ratio"] == pytest.approx(math.exp(b), rel=1e-9) and found[name]["converged"]
        assert found[name]["p_value"] == pytest.approx(own, rel=1e-7)


def test_logistic_tells_separation(spark):
    rows = [(True, "x"), (False, "x"), (True, "x"), (True, "y"), (True, "y"), (None, "x"), (True, None)]
    df = spark.createDataFrame(rows, "outcome boolean, factor string")
    found = Fits.logistic_or(df, "outcome", ["factor"]).collect()
    assert len(found) == 2 and not any(r["converged"] for r in found)
    assert Fits.logistic_or(df.limit(0), "outcome", ["factor"]).collect() == []


def test_poisson_without_events(spark):
    none = spark.createDataFrame([], "period int, n bigint")
    assert Fits.poisson_trend(none).collect() == []


def test_poisson_trend(spark):
    rows = [(i, round(40 * math.exp(0.02 * i))) for i in range(1, 54)]
    df = spark.createDataFrame(rows, "period int, n long")
    row = Fits.poisson_trend(df).first()
    assert row.slope == pytest.approx(0.02, abs=1e-3) and row.p_value < 1e-6


def moments(spark, *texts):
    return spark.createDataFrame([(t,) for t in texts], "t string").select(
        F.col("t").cast("timestamp_ntz").alias("t")
    )


def test_series_fills_gaps(spark):
    df = moments(spark, "2022-01-31 23:59:59", "2022-04-01 00:00:00", "2022-04-30 10:00:00", None)
    series = [tuple(r) for r in S.monthly_series(df, "t").orderBy("month_end").collect()]
    assert series == [
        (dt.date(2022, 1, 31), 1), (dt.date(2022, 2, 28), 0), (dt.date(2022, 3, 31), 0),
        (dt.date(2022, 4, 30), 2),
    ]
    missing = [r[0] for r in S.missing_periods(df, "t", "month").orderBy("period").collect()]
    assert missing == [dt.date(2022, 2, 1), dt.date(2022, 3, 1)]
    assert tuple(S.completeness(df, "t").first()) == (4, 2, False)


def test_full_span_has_53_months(spark):
    df = moments(spark, "2022-01-01 00:00:00", "2026-05-11 17:45:00")
    assert S.monthly_series(df, "t").count() == 53
    assert tuple(S.completeness(df, "t").first()) == (53, 2, True)


def test_complete_last_month(spark):
    assert S.completeness(moments(spark, "2022-02-28 05:00:00"), "t").first().partial_last is False


def test_periods_ignore_the_session_zone(spark):
    before = spark.conf.get("spark.sql.session.timeZone")
    df = moments(spark, "2024-03-31 02:30:00", "2024-03-31 03:30:00")
    spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
    try:
        hours = S.period_series(df, "t", "hour").select(F.col("period").cast("string"), "n")
        assert sorted(map(tuple, hours.collect())) == [
            ("2024-03-31 02:00:00", 1), ("2024-03-31 03:00:00", 1),
        ]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_time_features(spark):
    df = S.time_features(moments(spark, "2024-01-07 05:59:00", "2024-01-08 18:00:00"), "t")
    assert [tuple(r)[1:] for r in df.orderBy("t").collect()] == [
        (5, "night", 1, 1, 2024), (18, "evening", 2, 1, 2024),
    ]


def test_rates_count_null_as_false(spark):
    rows = [("a", True), ("a", None), ("b", False), (None, True)]
    df = spark.createDataFrame(rows, "g string, f boolean")
    assert {r.g: (r.n, r.f_rate) for r in Q.rates(df, ["g"], ["f"]).collect()} == {
        "a": (2, 50.0), "b": (1, 0.0), None: (1, 100.0),
    }
    assert Q.rate(df, "f").first()[0] == pytest.approx(200 / 3)


def test_pivot_order_and_absent(spark):
    rows = [("x", "M", True), ("x", "F", False), ("y", "M", None)]
    df = spark.createDataFrame(rows, "d string, s string, f boolean")
    wide = Q.rate_pivot(df, "d", "s", "f", ["y", "zz", "x"], ["M", "F"])
    assert [tuple(r) for r in wide.collect()] == [("y", 0.0, None), ("zz", None, None), ("x", 100.0, 0.0)]


def test_mode(spark):
    rows = [(1, "b"), (1, "a"), (1, None), (1, None), (1, None), (2, "z"), (2, "z"), (2, "a"), (3, None)]
    df = spark.createDataFrame(rows, "g int, v string")
    assert sorted(map(tuple, Q.group_mode(df, ["g"], "v").collect())) == [
        (1, 5, "a"), (2, 3, "z"), (3, 1, None),
    ]


def test_value_counts_and_top(spark):
    df = spark.createDataFrame([("a",), ("b",), ("b",), ("c",), (None,)], "v string")
    assert [tuple(r) for r in Q.value_counts(df, "v", ["c", "q", "b"]).collect()] == [
        ("c", 1), ("q", 0), ("b", 2),
    ]
    assert [tuple(r) for r in Q.top_values(df, "v", 2).collect()] == [("b", 2), ("a", 1)]


def test_scenarios(spark):
    rows = [("M", True, True, False), ("M", False, False, False), ("F", True, True, True)]
    df = spark.createDataFrame(rows, "s string, moved boolean, red boolean, emb boolean")
    conditions = {"crude": F.lit(True), "no emb": ~F.col("emb"), "red, no emb": F.col("red") & ~F.col("emb")}
    found = Q.rate_or_zero(Q.scenarios(df, conditions, "s", "moved"), "s", list(conditions), ["M", "F"])
    assert {(r.scenario, r.s): r.rate for r in found.collect()} == {
        ("crude", "M"): 50.0, ("crude", "F"): 100.0, ("no emb", "M"): 50.0, ("no emb", "F"): 0.0,
        ("red, no emb", "M"): 100.0, ("red, no emb", "F"): 0.0,
    }


def test_contradictions_and_agreement(spark):
    df = spark.createDataFrame(
        [(False, "h"), (True, None), (None, "h"), (True, "h"), (False, None)], "f boolean, h string"
    )
    assert tuple(G.contradictions(df, "f", "h").first()) == (1, 1, 1, 5)
    pairs = [("M", "M"), ("M", "F"), ("?", "M"), (None, "?"), ("F", "F")]
    df = spark.createDataFrame(pairs, "a string, b string")
    row = G.agreement(df, "a", "b", "?").first()
    assert tuple(row) == (3, pytest.approx(200 / 3), 40.0, 20.0)


def test_public_flags():
    from casewell import rules as R

    shown = Q.public_flags(R.FLAGS, R.SENSITIVE_FLAGS)
    assert "autolesion" not in shown and "embarazo" in shown and len(shown) == 17
