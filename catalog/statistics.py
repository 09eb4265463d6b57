"""Queries of association statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewell.operators import fits as Fits
from casewell.operators import series as S
from casewell.operators import stats as G
from casewell.operators.joins import merge_indicator
from casewell.operators.rates import linear_fit as fit_line
from catalog.registry import Tables, query
from catalog.reports import EVENTS_SQL, flagged_events, monthly_sql
from catalog.texts import EN_MARKER, ES_MARKER


def rounded(df: DataFrame, digits: int, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in cols})


FACTORS = {
    "is_open": "l_linestatus = 'O'",
    "discounted": "l_discount > 0.05",
    "large": "l_quantity > 30",
}
Z = "1.959963984540054::DOUBLE"


def normal_p_sql(z: str) -> str:
    """Two-sided p of a normal value, by a series of the error function."""
    x = f"(greatest(abs({z}), 1e-300) / sqrt(2))"
    terms = f"list_transform(range(0, 150), lambda k: exp((2 * k + 1) * ln({x}) - lgamma(k + 1.5)))"
    return f"round(CASE WHEN abs({z}) > 8 THEN 0 ELSE 1 - exp(-{x} * {x}) * list_sum({terms}) END, 6)"


def student_p_sql(r: str, freedom: str) -> str:
    """Two-sided p of a correlation, by a series of the incomplete beta function."""
    x = f"({r} * {r})"
    head = f"exp(0.5 * ln({x}) + {freedom} / 2 * ln(1 - {x}) - ln(0.5) + lgamma(({freedom} + 1) / 2) - lgamma(0.5) - lgamma({freedom} / 2))"
    steps = f"""list_transform(range(0, 4000), lambda k: exp(lgamma(({freedom} + 1) / 2 + k) - lgamma(({freedom} + 1) / 2)
                 + lgamma(1.5) - lgamma(1.5 + k) + k * ln({x})))"""
    return f"round(1 - {head} * list_sum({steps}), 6)"


def lines_with_factors(t: Tables, *more: str) -> DataFrame:
    return t.lineitem.select(
        *more,
        (F.col("l_returnflag") == "R").alias("returned"),
        *[F.expr(condition).alias(name) for name, condition in FACTORS.items()],
    )


# Exact p: hypergeometric probabilities of all tables with the same margins.
FISHER = """
SELECT factor, sum(exp(lp)) FILTER (lp <= own + 1e-7) AS p_value FROM (
  SELECT factor, k, own, lgamma(a+b+1) - lgamma(k+1) - lgamma(a+b-k+1) + lgamma(c+d+1)
         - lgamma(a+c-k+1) - lgamma(c+d-a-c+k+1) - (lgamma(a+b+c+d+1) - lgamma(a+c+1) - lgamma(b+d+1)) AS lp
  FROM (SELECT *, unnest(range(greatest(0, a - d), least(a + b, a + c) + 1)) AS k,
          lgamma(a+b+1) - lgamma(a+1) - lgamma(b+1) + lgamma(c+d+1) - lgamma(c+1) - lgamma(d+1)
          - (lgamma(a+b+c+d+1) - lgamma(a+c+1) - lgamma(b+d+1)) AS own FROM x))
GROUP BY factor"""


@query(f"""
WITH x AS ({" UNION ALL ".join(f'''
  SELECT '{name}' AS factor, count(*) FILTER (({c}) AND l_returnflag = 'R') AS a,
         count(*) FILTER (({c}) AND l_returnflag <> 'R') AS b,
         count(*) FILTER (NOT ({c}) AND l_returnflag = 'R') AS c,
         count(*) FILTER (NOT ({c}) AND l_returnflag <> 'R') AS d FROM lineitem'''
    for name, c in FACTORS.items())}),
 p AS ({FISHER}),
 r AS (SELECT *, CAST(a AS DOUBLE) * d / (CAST(b AS DOUBLE) * c) AS o,
              sqrt(1.0::DOUBLE / a + 1.0::DOUBLE / b + 1.0::DOUBLE / c + 1.0::DOUBLE / d) AS e FROM x)
SELECT factor, a, b, c, d, CAST(a AS DOUBLE) * 100 / (a + b) AS rate, round(o, 9) AS odds_ratio,
       round(exp(ln(o) - {Z} * e), 9) AS ci_low, round(exp(ln(o) + {Z} * e), 9) AS ci_high,
       round(p_value, 6) AS p_value
FROM r JOIN p USING (factor)""")
def odds_ratios(t: Tables) -> DataFrame:
    table = G.odds_ratios(lines_with_factors(t), "returned", list(FACTORS))
    return rounded(rounded(table, 9, "odds_ratio", "ci_low", "ci_high"), 6, "p_value")


# Log probabilities of hits per stratum within 12 deviations of the mean, and of their sums.
STRATA_SQL = f"""
WITH x AS ({" UNION ALL ".join(f'''
  SELECT '{name}' AS factor, l_linestatus AS stratum, count(*) FILTER (({c}) AND l_returnflag = 'R') AS a,
         count(*) FILTER (({c}) AND l_returnflag <> 'R') AS b, count(*) FILTER (NOT ({c}) AND l_returnflag = 'R') AS c,
         count(*) FILTER (NOT ({c}) AND l_returnflag <> 'R') AS d FROM lineitem GROUP BY l_linestatus'''
    for name, c in FACTORS.items() if name != "is_open")}),
 y AS (SELECT *, row_number() OVER (PARTITION BY factor ORDER BY stratum) AS i, a + b + c + d AS n,
              CAST(a + b AS DOUBLE) * (a + c) / (a + b + c + d) AS mean FROM x),
 z AS (SELECT *, 12 * sqrt(mean * (c + d) / n * (b + d) / (n - 1)) + 3 AS width FROM y),
 k AS (SELECT factor, i, a, unnest(range(CAST(greatest(0, a - d, floor(mean - width)) AS BIGINT),
                                         CAST(least(a + b, a + c, ceil(mean + width)) AS BIGINT) + 1)) AS k, a + b AS r, c + d AS s, a + c AS t FROM z),
 h AS (SELECT factor, i, k, exp(lgamma(r + 1) - lgamma(k + 1) - lgamma(r - k + 1) + lgamma(s + 1) - lgamma(t - k + 1) - lgamma(s - t + k + 1)
              - (lgamma(r + s + 1) - lgamma(t + 1) - lgamma(r + s - t + 1))) AS p FROM k),
 q AS (SELECT u.factor, u.k + v.k AS k, sum(u.p * v.p) AS p FROM h u JOIN h v ON u.factor = v.factor AND u.i = 1 AND v.i = 2 GROUP BY ALL),
 o AS (SELECT factor, sum(a) AS seen FROM x GROUP BY factor),
 e AS (SELECT factor, sum(p) FILTER (p <= own * (1 + 1e-7)) AS p_value
       FROM (SELECT q.*, max(p) FILTER (k = seen) OVER (PARTITION BY factor) AS own FROM q JOIN o USING (factor)) GROUP BY factor),
 w AS (SELECT factor, count(*) AS strata, CAST(sum(n) AS BIGINT) AS n, sum(a::DOUBLE * d / n) AS r, sum(b::DOUBLE * c / n) AS s,
              sum((a + d)::DOUBLE / n * (a::DOUBLE * d / n)) AS pr, sum((b + c)::DOUBLE / n * (b::DOUBLE * c / n)) AS qs,
              sum((a + d)::DOUBLE / n * (b::DOUBLE * c / n) + (b + c)::DOUBLE / n * (a::DOUBLE * d / n)) AS mixed FROM y GROUP BY factor),
 v AS (SELECT *, r / s AS ratio, sqrt(pr / (2 * r * r) + mixed / (2 * r * s) + qs / (2 * s * s)) AS error FROM w)
SELECT factor, strata, n, round(ratio, 9) AS odds_ratio, round(exp(ln(ratio) - {Z} * error), 9) AS ci_low,
       round(exp(ln(ratio) + {Z} * error), 9) AS ci_high, round(p_value, 6) AS p_value
FROM v JOIN e USING (factor)"""


@query(STRATA_SQL)
def stratified_odds(t: Tables) -> DataFrame:
    from casewell.operators.strata import stratified_odds as fit

    rows = lines_with_factors(t, "l_linestatus")
    table = fit(rows, "returned", ["discounted", "large"], "l_linestatus")
    return rounded(rounded(table, 9, "odds_ratio", "ci_low", "ci_high"), 6, "p_value")


@query("""
WITH c AS (SELECT event_type AS a, dayofweek(ts) AS b, count(*) AS n FROM events GROUP BY ALL),
     s AS (SELECT n, a, b, CAST(n AS DOUBLE) * n / sum(n) OVER (PARTITION BY a)
                           / sum(n) OVER (PARTITION BY b) AS share FROM c),
     g AS (SELECT CAST(sum(n) AS BIGINT) AS n, sum(n) * (sum(share) - 1) AS x,
                  (count(DISTINCT a) - 1) * (count(DISTINCT b) - 1) AS f FROM s)
SELECT n, round(x, 6) AS statistic, f AS freedom, round(exp(-x / 2) * list_sum(list_transform(
         range(0, CAST(f / 2 AS BIGINT)), lambda k: exp(k * ln(x / 2) - lgamma(k + 1)))), 6) AS p_value
FROM g""")
def chi_square(t: Tables) -> DataFrame:
    rows = t.events.select("event_type", F.dayofweek("ts").alias("day"))
    return rounded(G.chi_square(rows, "event_type", "day"), 6, "statistic", "p_value")


# With one categorical term the fit reproduces the level odds, so SQL can state it.
@query(f"""
WITH l AS (SELECT event_type, count(*) FILTER (high_k) AS y, count(*) FILTER (NOT high_k) AS z
           FROM {EVENTS_SQL} GROUP BY 1),
     r AS (SELECT y AS y0, z AS z0 FROM l WHERE event_type = 'click'),
     d AS (SELECT sum(y * ln(y / (y + z)) + z * ln(z / (y + z))) AS fit, sum(y) AS sy, sum(z) AS sz FROM l),
     q AS (SELECT 1 - fit / (sy * ln(sy / (sy + sz)) + sz * ln(sz / (sy + sz))) AS r2 FROM d),
     o AS (SELECT 'event_type_' || event_type AS term, ln((y / z) / (y0 / z0)) AS b,
                  sqrt(1 / y + 1 / z + 1 / y0 + 1 / z0) AS e FROM l, r WHERE event_type <> 'click'
           UNION ALL SELECT '(intercept)', ln(y0 / z0), sqrt(1 / y0 + 1 / z0) FROM r)
SELECT term, round(exp(b), 6) AS odds_ratio, round(exp(b - {Z} * e), 6) AS ci_low,
       round(exp(b + {Z} * e), 6) AS ci_high, {normal_p_sql("(b / e)")} AS p_value,
       round(r2, 6) AS pseudo_r2, true AS converged
FROM o, q""")
def logistic_or(t: Tables) -> DataFrame:
    fit = Fits.logistic_or(flagged_events(t), "high_k", ["event_type"])
    return rounded(fit, 6, "odds_ratio", "ci_low", "ci_high", "p_value", "pseudo_r2")


def determinant_sql(rows: list[list[str]]) -> str:
    if not rows:
        return "1"
    parts = [
        f"{'-' if j % 2 else '+'} {cell} * ({determinant_sql([r[:j] + r[j + 1 :] for r in rows[1:]])})"
        for j, cell in enumerate(rows[0])
    ]
    return " ".join(parts)


def newton_sql(flags: list[str], rounds: int) -> str:
    """Newton steps of a logistic fit on flags, from the shares `g(flags, y, w)`; `b{i}` holds
    the estimates `p0` (intercept), `p1`, … and their errors `e0`, …"""
    x = ["1", *flags]
    size = range(len(x))
    minor = lambda i, j: [[f"h{min(a, b)}{max(a, b)}" for b in size if b != j] for a in size if a != i]
    inverse = [[f"({'-' if (i + j) % 2 else ''}({determinant_sql(minor(i, j))}) / det)" for j in size] for i in size]
    old = ", ".join(f"p{i}" for i in size)
    eta = " + ".join(f"p{i} * {v}" for i, v in enumerate(x))
    sums = [f"sum(w * mu * (1 - mu) * {x[i]} * {x[j]}) AS h{i}{j}" for i in size for j in size if i <= j]
    sums += [f"sum(w * (y - mu) * {x[i]}) AS s{i}" for i in size] + [f"any_value(p{i}) AS p{i}" for i in size]
    whole = determinant_sql([[f"h{min(a, b)}{max(a, b)}" for b in size] for a in size])
    moved = [f"p{i} + {' + '.join(f'{inverse[i][j]} * s{j}' for j in size)} AS p{i}" for i in size]
    errors = [f"sqrt({inverse[i][i]}) AS e{i}" for i in size]
    steps = [f"b0 AS (SELECT {', '.join(f'0.0::DOUBLE AS p{i}' for i in size)})"]
    for i in range(1, rounds + 1):
        steps.append(f"""
     m{i} AS (SELECT g.*, {old}, 1 / (1 + exp(-({eta}))) AS mu FROM g, b{i - 1}),
     h{i} AS (SELECT {', '.join(sums)} FROM m{i}),
     i{i} AS (SELECT *, {whole} AS det FROM h{i}),
     b{i} AS (SELECT {', '.join([*moved, *errors])} FROM i{i})""")
    return ",".join(steps)


def logistic_sql(factors: list[str]) -> str:
    """A logistic fit of returned lines on factors, with two-sided p."""
    flags = [f"x{i}" for i in range(1, len(factors) + 1)]
    named = ", ".join(f"CAST(({FACTORS[f]}) AS INTEGER) AS {x}" for f, x in zip(factors, flags, strict=True))
    terms = " UNION ALL ".join(
        f"SELECT '{name}' AS term, p{i} AS b, e{i} AS e FROM b9"
        for i, name in enumerate(["(intercept)", *[f"{f}_true" for f in factors]])
    )
    return f"""
WITH f AS (SELECT CAST(CAST(l_returnflag = 'R' AS INTEGER) AS DOUBLE) AS y, {named} FROM lineitem),
     g AS (SELECT {', '.join(flags)}, avg(y) AS y, CAST(count(*) AS DOUBLE) AS w FROM f GROUP BY {', '.join(flags)}),
     {newton_sql(flags, 9)},
     l AS (SELECT sum(w * (y * ln(mu) + (1 - y) * ln(1 - mu))) AS fit, sum(w * y) / sum(w) AS share,
                  sum(w) AS n FROM m9),
     k AS (SELECT 1 - fit / (n * (share * ln(share) + (1 - share) * ln(1 - share))) AS r2 FROM l),
     o AS ({terms})
SELECT term, round(exp(b), 6) AS odds_ratio, round(exp(b - {Z} * e), 6) AS ci_low,
       round(exp(b + {Z} * e), 6) AS ci_high, {normal_p_sql("(b / e)")} AS p_value,
       round(r2, 8) AS pseudo_r2, true AS converged
FROM o, k"""


def returned_fit(t: Tables, factors: list[str]) -> DataFrame:
    fit = Fits.logistic_or(lines_with_factors(t), "returned", factors)
    return rounded(rounded(fit, 6, "odds_ratio", "ci_low", "ci_high", "p_value"), 8, "pseudo_r2")


@query(logistic_sql(["discounted", "large"]))
def logistic_adjusted(t: Tables) -> DataFrame:
    return returned_fit(t, ["discounted", "large"])


@query(logistic_sql(list(FACTORS)))
def logistic_three(t: Tables) -> DataFrame:
    return returned_fit(t, list(FACTORS))


INDICATOR_SQL = """
WITH v AS (SELECT c_nationkey AS nation, count(*) AS n FROM customer GROUP BY 1),
     i AS (SELECT s_nationkey AS nation, avg(s_acctbal) AS indicator FROM supplier GROUP BY 1),
     m AS (SELECT CAST(nation AS DOUBLE) AS nation, CAST(n AS DOUBLE) AS n, indicator
           FROM v JOIN i USING (nation))"""


def indicator_frame(t: Tables) -> DataFrame:
    volume = t.customer.groupBy(F.col("c_nationkey").alias("nation")).agg(F.count(F.lit(1)).alias("n"))
    indicator = t.supplier.groupBy(F.col("s_nationkey").alias("nation")).agg(
        F.avg("s_acctbal").alias("indicator")
    )
    return merge_indicator(volume, indicator, "nation")


@query(f"""{INDICATOR_SQL}
SELECT 'all' AS subset, count(*) AS n, round(corr(n, indicator), 9) AS r,
       round(regr_slope(n, indicator), 9) AS slope, round(regr_intercept(n, indicator), 6) AS intercept,
       {student_p_sql("corr(n, indicator)", "(count(*) - 2)")} AS p_value
FROM m
UNION ALL
SELECT 'without the first', count(*), round(corr(n, indicator), 9),
       round(regr_slope(n, indicator), 9), round(regr_intercept(n, indicator), 6),
       {student_p_sql("corr(n, indicator)", "(count(*) - 2)")}
FROM m WHERE nation <> 0""")
def indicator_corr(t: Tables) -> DataFrame:
    found = G.pearson(
        indicator_frame(t), "indicator", "n", {"without the first": F.col("nation") == 0}
    )
    return rounded(rounded(found, 9, "r", "slope"), 6, "intercept", "p_value")


@query("""
SELECT round(regr_slope(o_totalprice, o_custkey), 6) AS slope,
       round(regr_intercept(o_totalprice, o_custkey), 3) AS intercept FROM orders""")
def linear_fit(t: Tables) -> DataFrame:
    fit = fit_line(t.orders, "o_custkey", "o_totalprice")
    return rounded(rounded(fit, 6, "slope"), 3, "intercept")


CONTRA = """(SELECT CASE o_orderstatus WHEN 'F' THEN true WHEN 'O' THEN false END AS f,
                    CASE WHEN o_totalprice > 300000 THEN 'x' END AS v FROM orders)"""


@query(f"""
SELECT count(*) FILTER (NOT f AND v IS NOT NULL) AS false_with_value,
       count(*) FILTER (f AND v IS NULL) AS true_without_value,
       count(*) FILTER (f IS NULL AND v IS NOT NULL) AS unknown_with_value, count(*) AS n
FROM {CONTRA}""")
def contradictions(t: Tables) -> DataFrame:
    status = F.col("o_orderstatus")
    rows = t.orders.select(
        F.when(status == "F", True).when(status == "O", False).alias("f"),
        F.when(F.col("o_totalprice") > 300000, "x").alias("v"),
    )
    return G.contradictions(rows, "f", "v")


@query(f"""
WITH m AS (SELECT coalesce(nullif(lang, 'fr'), 'unknown') AS a,
                  regexp_matches(text, '(?i){EN_MARKER}') AS x,
                  regexp_matches(text, '(?i){ES_MARKER}') AS y FROM documents),
     c AS (SELECT a, CASE WHEN x AND NOT y THEN 'en' WHEN y AND NOT x THEN 'es' ELSE 'unknown' END AS b
           FROM m)
SELECT count(*) FILTER (a <> 'unknown' AND b <> 'unknown') AS both_decided,
       CAST(count(*) FILTER (a <> 'unknown' AND b <> 'unknown' AND a = b) AS DOUBLE) * 100
         / count(*) FILTER (a <> 'unknown' AND b <> 'unknown') AS agreement,
       CAST(count(*) FILTER (a = 'unknown') AS DOUBLE) * 100 / count(*) AS undecided_before,
       CAST(count(*) FILTER (a = 'unknown' AND b = 'unknown') AS DOUBLE) * 100 / count(*)
         AS undecided_after
FROM c""")
def agreement(t: Tables) -> DataFrame:
    from casewell.functions.text import marker_class

    markers = {"en": EN_MARKER, "es": ES_MARKER}
    found = marker_class(F.col("text"), F.lit(None).cast("string"), markers, "unknown")
    rows = t.texts("lang", "text").select(F.nullif(F.col("lang"), F.lit("fr")).alias("a"), found.alias("b"))
    return G.agreement(rows, "a", "b", "unknown")


WORDS = {"the": EN_MARKER, "tion": "TION", "number": "[0-9]{7,}", "never": "QQQZZZ"}


@query(" UNION ALL ".join(f"""
SELECT '{word}' AS keyword, count(*) FILTER (regexp_matches(text, '(?i){pattern}')) AS n,
       CAST(count(*) FILTER (regexp_matches(text, '(?i){pattern}')) AS DOUBLE) * 100 / count(text)
         AS share FROM documents""" for word, pattern in WORDS.items()))
def keyword_counts(t: Tables) -> DataFrame:
    return G.keyword_counts(t.texts("text"), "text", WORDS)


# Goodness-of-fit tests with 4 degrees of freedom, whose p is exp(-x/2) * (1 + x/2).
USER_TESTS = """
WITH t AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL),
     x AS (SELECT user_id, 5.0::DOUBLE * CAST(sum(n * n) AS DOUBLE) / CAST(sum(n) AS DOUBLE)
                           - CAST(sum(n) AS DOUBLE) AS x FROM t GROUP BY 1),
     p AS (SELECT user_id, round(exp(-x / 2) * (1 + x / 2), 9) AS p FROM x)"""


def user_tests(t: Tables) -> DataFrame:
    kinds = t.events.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    squares = F.sum(F.col("n") * F.col("n")).cast("double")
    total = F.sum("n").cast("double")
    x = kinds.groupBy("user_id").agg((squares * 5 / total - total).alias("x"))
    p = F.exp(-F.col("x") / 2) * (1 + F.col("x") / 2)
    return x.select("user_id", F.round(p, 9).alias("p"))


@query(f"""{USER_TESTS},
     r AS (SELECT *, row_number() OVER (ORDER BY p, user_id) AS k, count(*) OVER () AS m FROM p)
SELECT user_id, p, least(1, min(p * m / k) OVER (ORDER BY k DESC)) AS p_adjusted FROM r""")
def fdr(t: Tables) -> DataFrame:
    return G.fdr(user_tests(t), "p", ["user_id"])


@query(f"""
WITH s AS ({monthly_sql("orders")}), w AS (SELECT m AS t, n FROM s),
     z AS (SELECT CAST(sum(sign(b.n - a.n)) AS BIGINT) AS s FROM w a JOIN w b ON a.t < b.t),
     g AS (SELECT n, count(*) AS g FROM w GROUP BY 1),
     v AS (SELECT CAST(sum(g) AS BIGINT) AS periods,
                  (CAST(sum(g) AS DOUBLE) * (sum(g) - 1) * (2 * sum(g) + 5)
                   - CAST(sum(g * (g - 1) * (2 * g + 5)) AS DOUBLE)) / 18 AS variance FROM g)
SELECT periods, s, variance, round((s - sign(s)) / sqrt(variance), 9) AS z,
       {normal_p_sql("((s - sign(s)) / sqrt(variance))")} AS p_value FROM v, z""")
def trend(t: Tables) -> DataFrame:
    series = S.period_series(t.orders, "o_orderdate", "month")
    return rounded(rounded(S.mann_kendall(series, "period", "n"), 9, "z"), 6, "p_value")


def poisson_sql(rounds: int) -> str:
    """Steps of a Poisson fit on the period number, from `s(x, y)`."""
    steps = ["b0 AS (SELECT ln(avg(y)) AS p, 0.0::DOUBLE AS q FROM s)"]
    for i in range(1, rounds + 1):
        steps.append(f"""
     m{i} AS (SELECT x, y, p + q * x AS eta, exp(p + q * x) AS mu FROM s, b{i - 1}),
     h{i} AS (SELECT sum(mu) AS a, sum(mu * x) AS b, sum(mu * x * x) AS c,
                     sum(mu * (eta + (y - mu) / mu)) AS u, sum(mu * x * (eta + (y - mu) / mu)) AS v FROM m{i}),
     b{i} AS (SELECT (c * u - b * v) / (a * c - b * b) AS p, (a * v - b * u) / (a * c - b * b) AS q,
                     sqrt(a / (a * c - b * b)) AS e FROM h{i})""")
    return ",".join(steps)


@query(f"""
WITH d AS ({monthly_sql("orders")}),
     s AS (SELECT CAST(row_number() OVER (ORDER BY m) AS DOUBLE) AS x, CAST(n AS DOUBLE) AS y FROM d),
     {poisson_sql(12)}
SELECT round(q, 8) AS slope, round(p, 6) AS intercept, round(e, 8) AS std_error,
       {normal_p_sql("(q / e)")} AS p_value, true AS converged FROM b12""")
def poisson_trend(t: Tables) -> DataFrame:
    fit = Fits.poisson_trend(S.period_series(t.orders, "o_orderdate", "month"))
    return rounded(rounded(fit, 8, "slope", "std_error"), 6, "intercept", "p_value")


def order_profiles(t: Tables) -> DataFrame:
    size = F.when(F.col("o_totalprice") > 350000, "large").when(F.col("o_totalprice") > 150000, "middle")
    return t.orders.select("o_orderstatus", "o_orderpriority", size.alias("size"))


def kmodes_sql(rounds: int, k: int) -> str:
    """Rounds of k-modes on the counted combinations `g(a, b, c, n)`."""
    steps = [f"""
     m0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY n DESC, a, b, c) - 1 AS INTEGER) AS cluster,
                                a, b, c FROM g QUALIFY cluster < {k})"""]
    for i in range(1, rounds + 2):
        steps.append(f"""
     d{i} AS MATERIALIZED (SELECT g.*, cluster, CAST(g.a <> m.a AS INTEGER) + CAST(g.b <> m.b AS INTEGER)
                             + CAST(g.c <> m.c AS INTEGER) AS d FROM g JOIN m{i - 1} m ON true),
     w{i} AS MATERIALIZED (SELECT * FROM d{i}
             QUALIFY row_number() OVER (PARTITION BY a, b, c ORDER BY d, cluster) = 1)""")
        if i <= rounds:
            best = ", ".join(
                f"(SELECT {v} FROM w{i} w WHERE w.cluster = m.cluster GROUP BY {v} ORDER BY sum(n) DESC, {v} LIMIT 1)"
                f" AS {v}"
                for v in "abc"
            )
            steps.append(f"""
     m{i} AS MATERIALIZED (SELECT cluster, {best} FROM m{i - 1} m)""")
    return ",".join(steps)


PROFILE_SQL = """
WITH g AS MATERIALIZED (SELECT o_orderstatus AS a, o_orderpriority AS b,
            CASE WHEN o_totalprice > 350000 THEN 'large' WHEN o_totalprice > 150000 THEN 'middle' ELSE '' END AS c,
            count(*) AS n FROM orders GROUP BY ALL)"""


@query(f"""{PROFILE_SQL}, {kmodes_sql(10, 4)},
     o AS (SELECT w.cluster, w.n, w.d, min(d.d) AS other FROM w11 w
           JOIN d11 d ON d.a = w.a AND d.b = w.b AND d.c = w.c AND d.cluster <> w.cluster
           GROUP BY w.a, w.b, w.c, w.cluster, w.n, w.d),
     pairs AS (SELECT x.a, x.b, x.c, x.n, x.cluster, y.cluster AS other, CAST(sum(y.n) AS DOUBLE) AS size,
                      CAST(sum(y.n * (CAST(x.a <> y.a AS INTEGER) + CAST(x.b <> y.b AS INTEGER) + CAST(x.c <> y.c AS INTEGER))) AS DOUBLE) AS d
               FROM w11 x JOIN w11 y ON true GROUP BY ALL),
     near AS (SELECT cluster, n, max(d / (size - 1)) FILTER (other = cluster AND size > 1) AS p, min(d / size) FILTER (other <> cluster) AS q
              FROM pairs GROUP BY a, b, c, n, cluster),
     exact AS (SELECT cluster, sum(n * CASE WHEN greatest(p, q) > 0 AND p IS NOT NULL AND q IS NOT NULL THEN (q - p) / greatest(p, q)
                                            ELSE 0 END) / sum(n) AS exact FROM near GROUP BY cluster)
SELECT m.cluster, any_value(a) AS o_orderstatus, any_value(b) AS o_orderpriority, any_value(c) AS size,
       CAST(sum(n) AS BIGINT) AS n, CAST(sum(d * n) AS BIGINT) AS cost,
       round(sum(CASE WHEN greatest(d, other) = 0 THEN 0 ELSE (other - d)::DOUBLE / greatest(d, other) END * n)
             / sum(n), 9) AS silhouette, round(any_value(exact), 9) AS exact_silhouette, true AS converged
FROM m10 m JOIN o ON o.cluster = m.cluster JOIN exact ON exact.cluster = m.cluster GROUP BY m.cluster""")
def kmodes(t: Tables) -> DataFrame:
    from casewell.operators.clusters import kmodes as fit

    found = fit(order_profiles(t), ["o_orderstatus", "o_orderpriority", "size"], 4)
    return rounded(found, 9, "silhouette", "exact_silhouette")


def axis_sql(step: int, squarings: int = 26) -> str:
    """Leading eigenvector `v` of the symmetric matrix of `s{step}` as `e{step}`, by squaring it
    again and again, with its value; `s{step + 1}` is the matrix without it."""
    return f"""
     p{step}(k, m) AS (SELECT 0, m FROM s{step} UNION ALL
       SELECT k + 1, [[list_dot_product(r, c) / t for c in m] for r in m]
       FROM (SELECT k, m, list_sum([list_dot_product(r, r) for r in m]) AS t FROM p{step} WHERE k < {squarings})),
     l{step} AS (SELECT unnest(m) AS r, generate_subscripts(m, 1) AS i FROM p{step} WHERE k = {squarings}),
     u{step} AS (SELECT [x / sqrt(r[i]) for x in r] AS v FROM l{step} ORDER BY r[i] DESC, i LIMIT 1),
     e{step} AS (SELECT {step} AS axis, v, list_dot_product(v, [list_dot_product(r, v) for r in m]) AS w, m FROM u{step}, s{step}),
     s{step + 1} AS (SELECT [[x - w * v[i] * v[j] for x, j in r] for r, i in m] AS m FROM e{step})"""


@query(f"""{PROFILE_SQL.replace("WITH", "WITH RECURSIVE")},
     h AS (SELECT *, row_number() OVER (ORDER BY a, b, c) AS combo FROM g),
     ones AS (SELECT combo, n, 'o_orderstatus' AS col, a AS level FROM h UNION ALL
              SELECT combo, n, 'o_orderpriority', b FROM h UNION ALL SELECT combo, n, 'size', c FROM h),
     lev AS (SELECT col, level, sum(n) AS n, row_number() OVER (ORDER BY col, level) AS i,
                    sum(n)::DOUBLE / (sum(sum(n)) OVER ()) AS mass FROM ones GROUP BY col, level),
     both_ AS (SELECT x.col AS c1, x.level AS l1, y.col AS c2, y.level AS l2, sum(x.n) AS n
               FROM ones x JOIN ones y USING (combo) GROUP BY ALL),
     cells AS (SELECT x.i, y.i AS j, (coalesce(b.n, 0) / (sum(b.n) OVER ()) - x.mass * y.mass) / sqrt(x.mass * y.mass) AS v
               FROM lev x JOIN lev y ON true
               LEFT JOIN both_ b ON b.c1 = x.col AND b.l1 = x.level AND b.c2 = y.col AND b.l2 = y.level),
     s1 AS (SELECT list(r ORDER BY i) AS m FROM (SELECT i, list(v ORDER BY j) AS r FROM cells GROUP BY i)),
     {axis_sql(1)}, {axis_sql(2)},
     raw AS (SELECT col, level, mass, axis, w, v[i] * sqrt(w / mass) AS x
             FROM lev, (SELECT axis, v, w FROM e1 UNION ALL SELECT axis, v, w FROM e2)),
     side AS (SELECT axis, x AS first FROM raw
              QUALIFY row_number() OVER (PARTITION BY axis ORDER BY round(abs(x), 9) DESC, col, level) = 1)
SELECT col, level, round(mass, 9) AS mass, axis, round(CASE WHEN first < 0 THEN -x ELSE x END, 6) + 0.0 AS coordinate,
       round(w, 9) AS inertia, true AS converged
FROM raw JOIN side USING (axis)""")
def mca(t: Tables) -> DataFrame:
    from casewell.operators.correspondence import mca as fit

    found = fit(order_profiles(t), ["o_orderstatus", "o_orderpriority", "size"], 2)
    return rounded(rounded(found, 9, "mass", "inertia"), 6, "coordinate").withColumn("coordinate", F.col("coordinate") + 0.0)
