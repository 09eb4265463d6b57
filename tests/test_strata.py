"""Tables in strata against all tables with the same margins."""

from __future__ import annotations

import itertools
import math
import random

import pytest

from casewell.functions.special import fisher_two_sided_p, summed_p
from casewell.operators import strata as S


def chances(a, b, c, d):
    """Probability of each number of hits, from binomial coefficients."""
    row, rest, col = a + b, c + d, a + c
    whole = math.comb(row + rest, col)
    return {k: math.comb(row, k) * math.comb(rest, col - k) / whole for k in range(max(0, col - rest), min(row, col) + 1)}


def brute(tables):
    total = {}
    for own in itertools.product(*[chances(*t).items() for t in tables]):
        k = sum(x for x, _ in own)
        total[k] = total.get(k, 0) + math.prod(p for _, p in own)
    seen = total[sum(t[0] for t in tables)]
    return sum(p for p in total.values() if p <= seen * (1 + 1e-7))


@pytest.mark.parametrize("seed", range(8))
def test_exact_p_equals_all_tables(seed):
    rng = random.Random(seed)
    tables = [tuple(rng.randint(0, 9) for _ in range(4)) for _ in range(rng.randint(1, 3))]
    found = summed_p(tables)
    if all(len(chances(*t)) == 1 for t in tables):
        assert found is None
    else:
        assert found == pytest.approx(brute(tables), rel=1e-9)


def test_one_stratum_is_the_exact_test():
    for table in [(3, 1, 1, 3), (100, 20, 30, 80), (5000, 5100, 4900, 5200)]:
        assert summed_p([table]) == pytest.approx(fisher_two_sided_p(*table), rel=1e-6, abs=1e-12)


@pytest.mark.parametrize("size", [10**6, 10**9, 10**11])
def test_mirrored_tables_agree_at_large_counts(size):
    half, off = size // 4, int(math.sqrt(size) / 5)
    tables = [(half + off, half - off, half - off, half + off), (half + off, half - off, half + off // 2, half - off // 2)]
    for a, b, c, d in tables:
        p = fisher_two_sided_p(a, b, c, d)
        mirrors = [fisher_two_sided_p(*t) for t in [(b, a, d, c), (c, d, a, b), (a, c, b, d)]]
        assert 0.01 < p < 1 and all(m == pytest.approx(p, rel=1e-5) for m in mirrors)


def test_frame_of_factors_and_strata(spark):
    rng = random.Random(4)
    rows = []
    for _ in range(900):
        stratum = rng.choice(["u", "v", None])
        x = rng.random() < (0.7 if stratum == "u" else 0.3)
        rows.append((stratum, x, rng.random() < 0.2 + 0.4 * (stratum == "u"), rng.random() < 0.5))
    df = spark.createDataFrame(rows, "s string, x boolean, y boolean, z boolean").repartition(3)
    found = {r["factor"]: r for r in S.stratified_odds(df, "y", ["x", "z"], "s").collect()}
    for place, name in ((1, "x"), (3, "z")):
        tables = []
        for stratum in ("u", "v", None):
            own = [(r[place], r[2]) for r in rows if r[0] == stratum]
            tables.append(tuple(sum(o == pair for o in own) for pair in [(True, True), (True, False), (False, True), (False, False)]))
        r = sum(a * d / (a + b + c + d) for a, b, c, d in tables)
        s = sum(b * c / (a + b + c + d) for a, b, c, d in tables)
        assert found[name]["odds_ratio"] == pytest.approx(r / s) and found[name]["strata"] == 3 and found[name]["n"] == 900
        assert found[name]["p_value"] == pytest.approx(brute(tables), rel=1e-8)
        assert found[name]["ci_low"] < r / s < found[name]["ci_high"]


def test_no_rows_and_no_variation(spark):
    none = spark.createDataFrame([], "s string, x boolean, y boolean")
    assert S.stratified_odds(none, "y", ["x"], "s").collect() == []
    same = spark.createDataFrame([("u", True, True)] * 3, "s string, x boolean, y boolean")
    row = S.stratified_odds(same, "y", ["x"], "s").first()
    assert row["odds_ratio"] is None and row["p_value"] is None and row["n"] == 3
