"""Queries of counts, rates, pivots and series."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewell.functions import text as tx
from casewell.operators import audit as A
from casewell.operators import rates as Q
from casewell.operators import series as S
from catalog.registry import Tables, query
from catalog.texts import TAGGED_SQL, deidentify_sql, tagged


def one(condition: str) -> str:
    return f"CASE WHEN {condition} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END"


def flagged_events(t: Tables) -> DataFrame:
    """Events with two flags, the first of them NULL for errors."""
    known = F.col("event_type") != "error"
    return t.events.select(
        "event_id",
        "ts",
        "user_id",
        "event_type",
        F.when(known, F.col("value") > 20).alias("big"),
        (F.get_json_object("props", "$.k").cast("int") > 50).alias("high_k"),
    )


EVENTS_SQL = """(SELECT *, CASE WHEN event_type <> 'error' THEN value > 20 END AS big,
                        CAST(json_extract_string(props, '$.k') AS INTEGER) > 50 AS high_k FROM events)"""


@query(f"""
SELECT count(*) AS n, min(ts) AS first, max(ts) AS last,
       avg(CAST(CAST(big AS INTEGER) AS DOUBLE)) * 100 AS rate
FROM {EVENTS_SQL}""")
def summary(t: Tables) -> DataFrame:
    return Q.summary(flagged_events(t), "ts", "big")


@query("""
SELECT c AS event_type, count(event_id) AS n
FROM (VALUES ('view'), ('click'), ('refund'), ('error')) v(c) LEFT JOIN events ON event_type = c
GROUP BY c""")
def value_counts(t: Tables) -> DataFrame:
    return Q.value_counts(t.events, "event_type", ["view", "click", "refund", "error"])


@query(f"""
SELECT event_type, count(*) AS n, avg({one("big")}) * 100 AS big_rate,
       avg({one("high_k")}) * 100 AS high_k_rate
FROM {EVENTS_SQL} WHERE event_type IN ('click', 'error', 'view') GROUP BY 1""")
def bool_rates(t: Tables) -> DataFrame:
    from casewell.operators.joins import keep_values

    kept = keep_values(flagged_events(t), "event_type", ["click", "error", "view"])
    return Q.rates(kept, ["event_type"], ["big", "high_k"])


@query(f"""
WITH f AS (SELECT *, o_totalprice > 250000 AS flag FROM orders)
SELECT s AS o_orderstatus, {", ".join(
    f"avg({one('flag')}) FILTER (o_orderpriority = '{p}') * 100 AS \"{p}\""
    for p in ("1-URGENT", "3-MEDIUM", "9-NEVER"))}
FROM (VALUES ('P'), ('X'), ('F')) v(s) LEFT JOIN f ON o_orderstatus = s GROUP BY s""")
def rate_pivot(t: Tables) -> DataFrame:
    flagged = t.orders.withColumn("flag", F.col("o_totalprice") > 250000)
    columns = ["1-URGENT", "3-MEDIUM", "9-NEVER"]
    return Q.rate_pivot(flagged, "o_orderstatus", "o_orderpriority", "flag", ["P", "X", "F"], columns)


SCENARIOS = {
    "all": "true",
    "no errors": "event_type <> 'error'",
    "big, no errors": "coalesce(big, false) AND event_type <> 'error'",
}


@query(f"""
WITH s AS ({" UNION ALL ".join(
    f"SELECT '{label}' AS scenario, event_type, high_k FROM {EVENTS_SQL} WHERE {condition}"
    for label, condition in SCENARIOS.items())}),
     r AS (SELECT scenario, event_type, count(*) AS n,
                  CAST(count(*) FILTER (high_k) AS DOUBLE) * 100 / count(*) AS rate
           FROM s GROUP BY ALL),
     g AS (SELECT * FROM (VALUES {", ".join(f"('{s}')" for s in SCENARIOS)}) a(scenario),
                         (VALUES ('error'), ('click'), ('refund')) b(event_type))
SELECT scenario, event_type, coalesce(n, 0) AS n, coalesce(rate, 0) AS rate
FROM g LEFT JOIN r USING (scenario, event_type)""")
def scenario_rates(t: Tables) -> DataFrame:
    no_error = F.col("event_type") != "error"
    conditions = {
        "all": F.lit(True),
        "no errors": no_error,
        "big, no errors": F.coalesce("big", F.lit(False)) & no_error,
    }
    found = Q.scenarios(flagged_events(t), conditions, "event_type", "high_k")
    return Q.rate_or_zero(found, "event_type", list(conditions), ["error", "click", "refund"])


@query("""
WITH e AS (SELECT user_id, nullif(event_type, 'error') AS kind FROM events),
     c AS (SELECT user_id, kind, count(*) AS c FROM e GROUP BY ALL),
     r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY kind IS NULL, c DESC, kind) AS r,
                  sum(c) OVER (PARTITION BY user_id) AS n FROM c)
SELECT user_id, CAST(n AS BIGINT) AS n, kind AS mode FROM r WHERE r = 1""")
def group_mode(t: Tables) -> DataFrame:
    kinds = t.events.select("user_id", F.nullif(F.col("event_type"), F.lit("error")).alias("kind"))
    return Q.group_mode(kinds, ["user_id"], "kind")


def monthly_sql(table: str) -> str:
    return f"""
WITH c AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS m, count(*) AS n
           FROM {table} GROUP BY 1),
     s AS (SELECT CAST(unnest(generate_series((SELECT min(m) FROM c), (SELECT max(m) FROM c),
                                         INTERVAL 1 MONTH)) AS DATE) AS m)
SELECT s.m, coalesce(c.n, 0) AS n FROM s LEFT JOIN c ON c.m = s.m"""


@query(f"SELECT last_day(m) AS month_end, n FROM ({monthly_sql('orders')})")
def monthly_series(t: Tables) -> DataFrame:
    return S.monthly_series(t.orders, "o_orderdate")


MINUTES_SQL = """
WITH c AS (SELECT date_trunc('minute', ts) AS h, count(*) AS n FROM events WHERE ts IS NOT NULL GROUP BY 1),
     s AS (SELECT unnest(generate_series((SELECT min(h) FROM c), (SELECT max(h) FROM c),
                                         INTERVAL 1 MINUTE)) AS h)"""


# Minutes, so that a series of all events has gaps.
@query(f"{MINUTES_SQL} SELECT s.h AS period, coalesce(c.n, 0) AS n FROM s LEFT JOIN c ON c.h = s.h")
def sparse_series(t: Tables) -> DataFrame:
    return S.period_series(t.events, "ts", "minute")


@query(f"{MINUTES_SQL} SELECT h AS period FROM s WHERE h NOT IN (SELECT h FROM c)")
def missing_periods(t: Tables) -> DataFrame:
    return S.missing_periods(t.events, "ts", "minute")


@query("""
SELECT datediff('hour', min(ts), max(ts)) + 1 AS expected,
       count(DISTINCT date_trunc('hour', ts)) AS present,
       CAST(max(ts) AS DATE) < CAST(date_trunc('hour', max(ts)) + INTERVAL 1 HOUR AS DATE) - 1 AS partial_last
FROM events""")
def completeness(t: Tables) -> DataFrame:
    return S.completeness(t.events, "ts", "hour")


@query("""
SELECT l_returnflag || l_linestatus AS v, count(*) AS n FROM lineitem GROUP BY 1
ORDER BY n DESC, v LIMIT 4""")
def top_values(t: Tables) -> DataFrame:
    values = t.lineitem.select(F.concat("l_returnflag", "l_linestatus").alias("v"))
    return Q.top_values(values, "v", 4)


@query("""
SELECT doc_id, text, length(text) AS length FROM documents
ORDER BY length(text) DESC, doc_id LIMIT 8""".replace("length(text) AS", "CAST(length(text) AS INTEGER) AS"))
def longest_texts(t: Tables) -> DataFrame:
    return Q.longest(t.documents.select("doc_id", "text"), "text", "doc_id", 8)


@query(f"""
WITH d AS (SELECT {TAGGED_SQL} AS a FROM documents), r AS (SELECT a, {deidentify_sql("a")} AS b FROM d)
SELECT count(*) AS n, count(DISTINCT a) AS distinct_texts, count(*) FILTER (a <> b) AS changed,
       count(*) FILTER (a = b) AS unchanged, count(*) FILTER (b = '') AS failed
FROM r""")
def run_report(t: Tables) -> DataFrame:
    rows = tagged(t.texts("doc_id", "text", "n_chars")).withColumn("after", tx.deidentify(F.col("text")))
    return A.run_report(rows, "text", "after", F.col("after") == "")


@query(f"""
WITH n AS (SELECT count(*) AS total FROM events)
SELECT event_type, count(*) AS n, avg({one("big")}) * 100 AS rate,
       avg({one("big")}) FILTER (high_k) * 100 AS rate_given,
       CAST(count(*) AS DOUBLE) * 100 / any_value(total) AS share
FROM {EVENTS_SQL}, n GROUP BY 1""")
def conditional_rates(t: Tables) -> DataFrame:
    return Q.conditional_rates(flagged_events(t), "event_type", "big", "high_k")


@query(f"""
SELECT year(o_orderdate) AS year, count(*) AS n,
       avg({one("o_orderstatus = 'F' OR o_totalprice > 400000")}) * 100 AS share
FROM orders GROUP BY 1""".replace("year(o_orderdate) AS", "CAST(year(o_orderdate) AS INTEGER) AS"))
def yearly_share(t: Tables) -> DataFrame:
    flags = [F.nullif(F.col("o_orderstatus"), F.lit("P")) == "F", F.col("o_totalprice") > 400000]
    return S.yearly_share(t.orders, "o_orderdate", flags)


@query(f"""
SELECT p_brand, count(*) AS n, avg({one("l_returnflag = 'R'")}) * 100 AS returned_rate
FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1
ORDER BY returned_rate DESC, n DESC, p_brand""")
def rate_ranking(t: Tables) -> DataFrame:
    lines = t.lineitem.select(
        F.col("l_partkey").alias("p_partkey"), (F.col("l_returnflag") == "R").alias("returned")
    )
    return Q.rate_ranking(
        lines.join(t.part.select("p_partkey", "p_brand"), "p_partkey"), "p_brand", "returned"
    )


@query("""
SELECT event_id, CAST(hour(ts) AS INTEGER) AS hour,
       CASE WHEN hour(ts) >= 18 THEN 'evening' WHEN hour(ts) >= 12 THEN 'afternoon'
            WHEN hour(ts) >= 6 THEN 'morning' ELSE 'night' END AS band,
       CAST(dayofweek(ts) + 1 AS INTEGER) AS weekday, CAST(month(ts) AS INTEGER) AS month,
       CAST(year(ts) AS INTEGER) AS year
FROM events""")
def time_features(t: Tables) -> DataFrame:
    return S.time_features(t.events.select("event_id", "ts"), "ts").drop("ts")


@query(f"""
SELECT CAST(hour(ts) AS INTEGER) AS hour, {", ".join(
    f"count(*) FILTER (dayofweek(ts) = {d - 1}) AS {name}" for d, name in S.WEEKDAYS.items())}
FROM events GROUP BY 1""")
def hour_day(t: Tables) -> DataFrame:
    return S.hour_day(t.events, "ts")


@query("""
SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month,
       count(*) FILTER (o_orderpriority = '1-URGENT') AS "1-URGENT",
       count(*) FILTER (o_orderpriority = '5-LOW') AS "5-LOW"
FROM orders GROUP BY 1""")
def monthly_stack(t: Tables) -> DataFrame:
    return S.monthly_stack(t.orders, "o_orderdate", "o_orderpriority", ["1-URGENT", "5-LOW"])


@query("""
WITH p AS (SELECT o_orderpriority AS a, o_orderstatus AS b, n_name AS c, count(*) AS n
           FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey
           GROUP BY ALL)
SELECT 1 AS step, a AS source, b AS target, CAST(sum(n) AS BIGINT) AS n FROM p GROUP BY ALL
UNION ALL SELECT 2, b, c, CAST(sum(n) AS BIGINT) FROM p GROUP BY ALL""")
def flow_edges(t: Tables) -> DataFrame:
    customers = t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    nations = t.nation.select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    rows = t.orders.join(customers, "o_custkey").join(nations, "c_nationkey")
    return S.flow_edges(rows, "o_orderpriority", "o_orderstatus", "n_name")


@query(f"""
SELECT user_id, count(*) AS n, avg({one("big")}) * 100 AS big_rate,
       avg({one("high_k")}) * 100 AS high_k_rate
FROM {EVENTS_SQL} GROUP BY 1""")
def entity_profile(t: Tables) -> DataFrame:
    return Q.entity_profile(flagged_events(t), "user_id", ["big", "high_k"])
