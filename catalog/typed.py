"""Queries of the date, number, JSON and array functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casewell.functions import values as vl
from catalog.registry import Tables, query


@query("""
SELECT o_orderkey, try_strptime(CASE o_orderstatus
         WHEN 'F' THEN strftime(o_orderdate, '%-d/%-m/%Y %-H:%M')
         WHEN 'O' THEN strftime(o_orderdate, '%d/%m/%Y %H:%M')
         ELSE '31/2/' || year(o_orderdate) || ' 10:00' END, '%d/%m/%Y %H:%M') AS moment
FROM orders""")
def parse_dayfirst(t: Tables) -> DataFrame:
    day = F.col("o_orderdate")
    text = (
        F.when(F.col("o_orderstatus") == "F", F.date_format(day, "d/M/yyyy H:mm"))
        .when(F.col("o_orderstatus") == "O", F.date_format(day, "dd/MM/yyyy HH:mm"))
        .otherwise(F.concat(F.lit("31/2/"), F.year(day).cast("string"), F.lit(" 10:00")))
    )
    return t.orders.select("o_orderkey", vl.parse_dayfirst(text).alias("moment"))


@query("""
WITH x AS (SELECT p_partkey, CASE p_type WHEN 'PROMO' THEN 'S/N' WHEN 'SMALL' THEN p_size || '.5'
                  WHEN 'LARGE' THEN NULL ELSE ' ' || p_size || ' ' END AS raw, p_size, p_type FROM part)
SELECT p_partkey, p_type NOT IN ('PROMO', 'SMALL', 'LARGE') AS accepted,
       CASE WHEN p_type NOT IN ('PROMO', 'SMALL', 'LARGE') THEN p_size END AS number
FROM x""")
def int_or_reject(t: Tables) -> DataFrame:
    size = F.col("p_size").cast("string")
    raw = (
        F.when(F.col("p_type") == "PROMO", "S/N")
        .when(F.col("p_type") == "SMALL", F.concat(size, F.lit(".5")))
        .when(F.col("p_type") != "LARGE", F.concat(F.lit(" "), size, F.lit(" ")))
    )
    accepted, rejected = vl.int_or_reject(t.part.select("p_partkey", raw.alias("number")), "number")
    return accepted.withColumn("accepted", F.lit(True)).unionByName(
        rejected.withColumns({"accepted": F.lit(False), "number": F.lit(None).cast("int")})
    )


@query("""
SELECT o_orderkey, (CASE o_orderstatus WHEN 'F' THEN true WHEN 'O' THEN false END)
       OR (CASE WHEN o_totalprice > 300000 THEN 'x' END) IS NOT NULL AS moved
FROM orders""")
def bool_or_null(t: Tables) -> DataFrame:
    status = F.col("o_orderstatus")
    flag = F.when(status == "F", True).when(status == "O", False)
    other = F.when(F.col("o_totalprice") > 300000, "x")
    return t.orders.select("o_orderkey", vl.flag_or_present(flag, other).alias("moved"))


@query("""
SELECT event_id, json_extract_string(props, '$.k') AS k_text,
       CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
       json_extract_string(props, '$.zz') AS absent,
       json_extract_string('{"b": ' || (value > 20) || '}', '$.b') = 'true' AS b
FROM events""")
def json_fields(t: Tables) -> DataFrame:
    props = F.col("props")
    made = F.concat(F.lit('{"b": '), (F.col("value") > 20).cast("string"), F.lit("}"))
    return t.events.select(
        "event_id",
        vl.json_field(props, "$.k").alias("k_text"),
        vl.json_field(props, "$.k", "int").alias("k"),
        vl.json_field(props, "$.zz").alias("absent"),
        vl.json_field(made, "$.b", "boolean").alias("b"),
    )


@query("""
SELECT event_id, CASE WHEN event_type IN ('error', 'signup') THEN -1
                 ELSE CAST(json_extract_string(props, '$.k') AS INTEGER) END AS k
FROM events""")
def json_default(t: Tables) -> DataFrame:
    kind = F.col("event_type")
    text = F.when(kind == "error", F.concat(F.lit("no json "), "props")).when(
        kind != "signup", F.col("props")
    )
    schema = T.StructType([T.StructField("k", T.IntegerType())])
    parsed = t.events.select("event_id", vl.parse_or_default(text, schema, {"k": -1}).alias("p"))
    return parsed.select("event_id", "p.k")


@query("""
WITH j AS (SELECT '{' || CASE WHEN value < 2 THEN '' ELSE '"kind": "' || event_type || '", ' END
                  || '"big": ' || CASE WHEN value > 20 THEN 'true' WHEN value < 5 THEN '"true"'
                                       ELSE 'false' END
                  || CASE WHEN event_type = 'purchase' THEN ', "x": 1' ELSE '' END || '}' AS a
           FROM events)
SELECT 'kind' AS field, count(*) FILTER (json_type(a, '$.kind') IS NULL) AS missing,
       count(*) FILTER (json_extract_string(a, '$.kind') NOT IN ('click', 'view', 'purchase'))
       AS not_allowed FROM j
UNION ALL
SELECT 'big', count(*) FILTER (json_type(a, '$.big') IS NULL),
       count(*) FILTER (json_type(a, '$.big') <> 'BOOLEAN') FROM j
UNION ALL
SELECT '*', 0, count(*) FILTER (json_type(a, '$.x') IS NOT NULL) FROM j""")
def contract_violations(t: Tables) -> DataFrame:
    value, kind = F.col("value"), F.col("event_type")
    named = F.concat(F.lit('"kind": "'), kind, F.lit('", '))
    attributes = F.concat(
        F.lit("{"),
        F.when(value < 2, "").otherwise(named),
        F.lit('"big": '),
        F.when(value > 20, "true").when(value < 5, '"true"').otherwise("false"),
        F.when(kind == "purchase", ', "x": 1').otherwise(""),
        F.lit("}"),
    )
    made = t.events.select(attributes.alias("a"))
    return vl.contract_report(made, "a", {"kind": ["click", "view", "purchase"]}, ["big"])


@query("""
WITH p AS (SELECT vec_id, list_filter(list_transform(range(1, 64, 2), lambda i: {
                'x': CASE WHEN embedding[i] > 0.1 THEN CAST(embedding[i] AS DOUBLE) ELSE 0 END,
                'y': CASE WHEN embedding[i + 1] > 0.1 THEN CAST(embedding[i + 1] AS DOUBLE) END}),
              lambda s: s.x <> 0 AND coalesce(s.y, 0) <> 0)[1] AS hit FROM embeddings)
SELECT vec_id, hit.y AS lat, hit.x AS lon FROM p""")
def first_valid_point(t: Tables) -> DataFrame:
    def coordinate(i, empty):
        here = F.element_at("embedding", i).cast("double")
        return F.when(here > F.lit(0.1), here).otherwise(empty)

    pairs = F.transform(
        F.sequence(F.lit(1), F.lit(63), F.lit(2)),
        lambda i: F.struct(
            coordinate(i, F.lit(0.0)).alias("x"), coordinate(i + 1, F.lit(None)).alias("y")
        ),
    )
    found = t.embeddings.select("vec_id", vl.first_valid_point(pairs).alias("hit"))
    return found.select("vec_id", "hit.lat", "hit.lon")


@query("""
SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS lat, CAST(embedding[2] AS DOUBLE) AS lon
FROM embeddings
WHERE CAST(embedding[1] AS DOUBLE) BETWEEN -0.1 AND 0.12
  AND CAST(embedding[2] AS DOUBLE) BETWEEN -0.15 AND 0.1""")
def bbox_filter(t: Tables) -> DataFrame:
    lat, lon = (F.element_at("embedding", i).cast("double") for i in (1, 2))
    points = t.embeddings.select("vec_id", lat.alias("lat"), lon.alias("lon"))
    box = {"lat": (-0.1, 0.12), "lon": (-0.15, 0.1)}
    return points.filter(vl.in_box(F.col("lat"), F.col("lon"), box))


@query("""
SELECT strftime(min(ts), '%Y-%m') AS first_period, strftime(max(ts), '%Y-%m') AS last_period
FROM events""")
def date_range(t: Tables) -> DataFrame:
    return vl.date_range(t.events, "ts")
