"""Queries of points and zones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewell.operators import geo
from casewell.operators.joins import located
from casewell.operators.rates import points, totals
from catalog.registry import Tables, query

# Zones made of nations: a part with a hole, and a second part that reaches into others.
OUTER = [(0, 0), (1.5, 0), (1.9, 0.8), (1.5, 1.6), (0, 1.6)]
HOLE = [(0.5, 0.5), (1, 0.5), (1, 1), (0.5, 1)]
SECOND = [(1.6, 1.5), (1.9, 1.5), (2.5, 2.5)]
RINGS = {"OUTER": OUTER, "HOLE": HOLE, "SECOND": SECOND}


def zones(t: Tables) -> DataFrame:
    key = F.col("n_nationkey")
    x, y = (key % 5 * 2).cast("double"), (F.floor(key / 5) * 2).cast("double")

    def ring(corners):
        return F.array(*[F.array(x + F.lit(float(a)), y + F.lit(float(b))) for a, b in corners])

    rings = F.array(F.array(ring(OUTER), ring(HOLE)), F.array(ring(SECOND)))
    return t.nation.select(key.alias("zone"), rings.alias("rings"))


def order_points(t: Tables) -> DataFrame:
    return t.spread("orders", "o_orderkey", "o_orderdate", "o_totalprice").select(
        "o_orderkey",
        (F.dayofyear("o_orderdate") / F.lit(40.0)).alias("lat"),
        (F.col("o_totalprice") / 50000).alias("lon"),
    )


EDGES_SQL = " UNION ALL ".join(
    f"SELECT n_nationkey AS zone, {x}::DOUBLE + a.cx AS x1, {y}::DOUBLE + a.cy AS y1,"
    f" {u}::DOUBLE + a.cx AS x2, {v}::DOUBLE + a.cy AS y2 FROM a"
    for ring in RINGS.values()
    for (x, y), (u, v) in zip(ring, ring[1:] + ring[:1], strict=True)
)
ZONES_SQL = f"""
WITH a AS (SELECT *, CAST(n_nationkey % 5 * 2 AS DOUBLE) AS cx,
                  CAST(n_nationkey // 5 * 2 AS DOUBLE) AS cy FROM nation),
     e AS ({EDGES_SQL}),
     p AS (SELECT o_orderkey, dayofyear(o_orderdate) / 40.0::DOUBLE AS lat,
                  o_totalprice / 50000 AS lon FROM orders),
     c AS (SELECT o_orderkey, zone,
             count(*) FILTER ((y1 > lat) <> (y2 > lat)
                              AND lon < (x2 - x1) * (lat - y1) / (y2 - y1) + x1) AS crossings,
             bool_or((x2 - x1) * (lat - y1) = (y2 - y1) * (lon - x1)
                     AND lon BETWEEN least(x1, x2) AND greatest(x1, x2)
                     AND lat BETWEEN least(y1, y2) AND greatest(y1, y2)) AS on_edge
           FROM p JOIN e ON true GROUP BY ALL),
     z AS (SELECT o_orderkey, min(zone) AS zone FROM c WHERE crossings % 2 = 1 AND NOT on_edge GROUP BY 1)"""


@query(f"{ZONES_SQL} SELECT o_orderkey, lat, lon, zone FROM p LEFT JOIN z USING (o_orderkey)")
def zone_join(t: Tables) -> DataFrame:
    return geo.zone_join(order_points(t), zones(t), "o_orderkey", 0.25)


@query(f"""{ZONES_SQL}
SELECT zone, count(*) AS n FROM z GROUP BY zone""")
def zone_counts(t: Tables) -> DataFrame:
    from casewell.operators.rates import counts

    joined = geo.zone_join(order_points(t), zones(t), "o_orderkey", 0.25)
    return counts(joined.filter("zone IS NOT NULL"), "zone")


POINTS_SQL = """
WITH f AS (SELECT CAST(s_nationkey AS DOUBLE) AS lat, floor(s_acctbal / 2000) AS lon, p_type AS kind
           FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN part ON p_partkey = l_partkey
           WHERE s_acctbal >= 0),
     c AS (SELECT lat, lon, kind, count(*) AS c FROM f GROUP BY ALL),
     r AS (SELECT *, row_number() OVER (PARTITION BY lat, lon ORDER BY c DESC, kind) AS r,
                  CAST(sum(c) OVER (PARTITION BY lat, lon) AS BIGINT) AS n FROM c),
     m AS (SELECT lat, lon, n, kind FROM r WHERE r = 1)"""


def supplier_points(t: Tables) -> DataFrame:
    lines = t.lineitem.select("l_suppkey", "l_partkey")
    places = t.supplier.select(
        F.col("s_suppkey").alias("l_suppkey"),
        F.col("s_nationkey").cast("double").alias("lat"),
        F.when(F.col("s_acctbal") >= 0, F.floor(F.col("s_acctbal") / 2000).cast("double")).alias("lon"),
    )
    kinds = t.part.select(F.col("p_partkey").alias("l_partkey"), F.col("p_type").alias("kind"))
    counted = located(lines, places, kinds, "l_suppkey", "l_partkey", ["lat", "lon"], "kind")
    return points(counted, "lat", "lon", "kind", weight="n")


@query(f"{POINTS_SQL} SELECT * FROM m")
def map_points(t: Tables) -> DataFrame:
    return supplier_points(t)


@query(f"{POINTS_SQL} SELECT kind, CAST(sum(n) AS BIGINT) AS total FROM m GROUP BY kind")
def map_points_totals(t: Tables) -> DataFrame:
    return totals(supplier_points(t), "kind", "n")
