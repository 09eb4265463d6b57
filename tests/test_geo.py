from __future__ import annotations

import json
import math
import random

from pyspark.sql import functions as F

from casewell.operators import geo
from casewell.sources.readers import read_geojson, read_indicator_csv

RINGS = "array<array<array<array<double>>>>"
SQUARE = [[0.0, 0.0], [4.0, 0.0], [4.0, 4.0], [0.0, 4.0], [0.0, 0.0]]
HOLE = [[1.0, 1.0], [2.0, 1.0], [2.0, 2.0], [1.0, 2.0], [1.0, 1.0]]
SECOND = [[10.0, 10.0], [12.0, 10.0], [11.0, 12.0]]
OTHER = [[3.0, 3.0], [6.0, 3.0], [6.0, 6.0], [3.0, 6.0]]


def zones(spark):
    return spark.createDataFrame([(7, [[SQUARE, HOLE], [SECOND]]), (3, [[OTHER]])], f"zone int, rings {RINGS}")


CASES = [
    (0.5, 0.5, 7), (1.5, 1.5, None), (1.0, 1.5, None), (2.0, 2.0, None), (0.0, 0.0, None),
    (4.0, 2.0, None), (2.0, 0.0, None), (9.0, 9.0, None), (11.0, 10.5, 7), (3.5, 3.5, 3),
    (5.0, 5.0, 3), (3.0, 3.5, 7), (1e6, -1e6, None), (3.0, 1.0, 7), (2.5, 2.0, 7),
]


def test_strict_containment(spark):
    points = spark.createDataFrame(
        [(i, lat, lon) for i, (lon, lat, _) in enumerate(CASES)] + [(99, None, 1.0)],
        "id int, lat double, lon double",
    )
    for cell in (0.3, 1.0, 100.0):
        found = {r["id"]: r["zone"] for r in geo.zone_join(points, zones(spark), "id", cell).collect()}
        assert found == {**{i: want for i, (_, _, want) in enumerate(CASES)}, 99: None}, cell


def test_crowded_cells(spark):
    points = [(i, 0.5, 0.5) for i in range(300)] + [(1000, 5.0, 5.0), (1001, None, None)]
    df = spark.createDataFrame(points, "id int, lat double, lon double")
    found = {r["id"]: r["zone"] for r in geo.zone_join(df, zones(spark), "id", 1.0).collect()}
    assert found == {**dict.fromkeys(range(300), 7), 1000: 3, 1001: None}


def inside(x, y, rings):
    """Winding by summed angles: another way to decide, for points off the edges."""
    turns = 0.0
    for ring in rings:
        total = 0.0
        for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1], strict=True):
            a = math.atan2(y2 - y, x2 - x) - math.atan2(y1 - y, x1 - x)
            total += math.atan2(math.sin(a), math.cos(a))
        turns += round(total / (2 * math.pi))
    return turns % 2 == 1


def test_random_polygons_equal_brute_force(spark):
    random.seed(5)
    shapes = []
    for zone in range(12):
        cx, cy = random.uniform(-5, 5), random.uniform(-5, 5)
        ring = [
            [cx + r * math.cos(a), cy + r * math.sin(a)]
            for a, r in ((2 * math.pi * i / 17, random.uniform(0.5, 3)) for i in range(17))
        ]
        shapes.append((zone, [[ring]]))
    points = [(i, random.uniform(-9, 9), random.uniform(-9, 9)) for i in range(1500)]
    df = spark.createDataFrame(points, "id int, lat double, lon double")
    zone_df = spark.createDataFrame(shapes, f"zone int, rings {RINGS}")
    found = {r["id"]: r["zone"] for r in geo.zone_join(df, zone_df, "id", 0.4).collect()}
    expected = {
        i: min((z for z, parts in shapes if inside(lon, lat, parts[0])), default=None)
        for i, lat, lon in points
    }
    assert found == expected and sum(v is not None for v in found.values()) > 300


def test_cut_cells_equal_brute_force(spark):
    """Few edges a cell, so that cells are cut many times; some points on borders of cells."""
    random.seed(6)
    wheel = lambda n, cx, cy, low, high: [
        [cx + r * math.cos(a), cy + r * math.sin(a)]
        for a, r in ((2 * math.pi * i / n, random.uniform(low, high)) for i in range(n))
    ]
    shapes = [(1, [[wheel(400, 0, 0, 2, 3), wheel(90, 0.1, 0, 0.5, 1)]]), (2, [[wheel(60, 2.5, 0.5, 0.1, 1.5)]]),
              (3, [[[[-6.0, -6.0], [6.0, -6.0], [6.0, 6.0], [-6.0, 6.0]]]]), (0, [[wheel(50, 0.3, 0.4, 0.01, 0.02)]])]
    points = [(i, random.uniform(-4, 4), random.uniform(-4, 4)) for i in range(1200)]
    points += [(2000 + i, random.uniform(0.38, 0.42), random.uniform(0.28, 0.32)) for i in range(300)]
    points += [(3000 + i, random.randint(-32, 32) / 8, random.randint(-32, 32) / 8) for i in range(500)]
    df = spark.createDataFrame([*points, (9000, None, 1.0), (9001, 50.0, 50.0)], "id int, lat double, lon double")
    zone_df = spark.createDataFrame(shapes[::-1], f"zone int, rings {RINGS}")
    expected = {i: [z for z, parts in shapes if inside(lon, lat, parts[0])] for i, lat, lon in points}
    wanted = {**{i: min(found, default=None) for i, found in expected.items()}, 9000: None, 9001: None}
    for cell, most in ((1.0, 8), (8.0, 20), (0.25, 256)):
        rows = geo.zone_join(df, zone_df, "id", cell, most=most).collect()
        assert len(rows) == len(wanted) and {r["id"]: r["zone"] for r in rows} == wanted, (cell, most)
    assert len(set(wanted.values())) == 5


def test_no_cell_holds_a_large_zone(spark):
    n = 40_000
    ring = [[math.cos(2 * math.pi * i / n), math.sin(2 * math.pi * i / n)] for i in range(n)]
    large = spark.createDataFrame([(1, [[ring]])], f"zone int, rings {RINGS}")
    cells = geo.zone_cells(large, "zone", "rings", 4.0, most=500)
    sizes = [r[0] for r in cells.selectExpr("size(edges)").filter("edges IS NOT NULL").collect()]
    assert max(sizes) <= 500 and sum(sizes) >= n


def test_edges_that_meet_in_a_spot_stay_together(spark):
    fan = [p for i in range(30) for p in ([0.3, 0.3], [1.0, i / 30], [1.0, (i + 0.5) / 30])]
    df = spark.createDataFrame([(1, 0.31, 0.9), (2, 0.9, 0.99)], "id int, lat double, lon double")
    zone_df = spark.createDataFrame([(1, [[fan]])], f"zone int, rings {RINGS}")
    found = {r["id"]: r["zone"] for r in geo.zone_join(df, zone_df, "id", 1.0, most=200).collect()}
    assert found == {i: 1 if inside(x, y, [fan]) else None for i, y, x in ((1, 0.31, 0.9), (2, 0.9, 0.99))}


def test_cells_inside_carry_no_edges(spark):
    cells = geo.zone_cells(zones(spark), "zone", "rings", 0.5)
    assert cells.filter("inside AND edges IS NOT NULL").count() == 0
    assert cells.filter("inside").count() > 5
    assert cells.filter("NOT inside").count() == 0


def test_assign_keeps_zones_and_repeats(spark):
    rows = [(1, 0.5, 0.5, None), (2, 0.5, 0.5, 99), (3, None, None, None), (4, 50.0, 50.0, None)]
    df = spark.createDataFrame(rows, "id int, lat double, lon double, zone int")
    once = geo.assign_zones(df, zones(spark), "id", 1.0)
    assert {r["id"]: r["zone"] for r in once.collect()} == {1: 7, 2: 99, 3: None, 4: None}
    twice = geo.assign_zones(once, zones(spark), "id", 1.0)
    assert sorted(map(str, twice.collect())) == sorted(map(str, once.collect()))


def test_geojson(spark, tmp_path):
    features = [
        {"type": "Feature", "properties": {"comuna": 2.0, "barrios": "B"},
         "geometry": {"type": "Polygon", "coordinates": [SQUARE, HOLE]}},
        {"type": "Feature", "properties": {"comuna": "1.000", "barrios": None},
         "geometry": {"type": "MultiPolygon", "coordinates": [[SQUARE], [SECOND]]}},
        {"type": "Feature", "properties": {"comuna": 2, "barrios": "C"},
         "geometry": {"type": "Polygon", "coordinates": [SECOND]}},
    ]
    path = tmp_path / "zones.geojson"
    path.write_text(json.dumps({"type": "FeatureCollection", "features": features}, indent=1))
    zones_ = {r["zone"]: r for r in read_geojson(spark, str(path)).collect()}
    assert set(zones_) == {1, 2}
    assert zones_[2]["name"] == "B" and zones_[2]["rings"] == [[SQUARE, HOLE]]
    assert zones_[1]["name"] is None and zones_[1]["rings"] == [[SQUARE], [SECOND]]


def test_indicator_csv(spark, tmp_path):
    path = tmp_path / "nbi.csv"
    path.write_bytes("Comuna,Hogares con NBI,Año\n1,15.9,x\n2,1.8,ñ\ntotal,6,y\n".encode("latin-1"))
    df = read_indicator_csv(spark, str(path))
    assert sorted(map(tuple, df.collect())) == [(1, 15.9), (2, 1.8)]
    assert dict(df.dtypes) == {"zone": "int", "indicator": "double"}


def test_point_on_shared_corner_of_cells(spark):
    points = spark.createDataFrame([(1, 1.0, 3.0), (2, 3.0, 1.0)], "id int, lat double, lon double")
    found = geo.zone_join(points, zones(spark).filter(F.col("zone") == 7), "id", 1.0)
    assert {r["zone"] for r in found.collect()} == {7}
