"""Zones and points: polygon containment as equi joins on the cells of a quadtree.

All zones share one tree over squares of a power of two. A cell with more than `most` edges
is cut into four, until few edges stay; a cell that no edge crosses keeps a verdict and no
edges. Cutting is a join and a grouped count per level, so no row or task holds a whole zone.

A cell keeps only the edges that touch it, and one bit of all others. Take a ray to the right
from a point of the cell. An edge that does not touch the cell lies, at the cell's heights,
left of it or right of it. Let `odd` tell whether the ray along the cell's lower side meets an
odd number of those on the right. Higher up their number changes its parity only at a vertex on
the right where an edge that touches the cell meets one that does not. So the parity of all
crossings is `odd`, plus the touching edges that the ray meets, plus the ends of touching edges
right of the cell, above its lower side and not above the point. A cell gets its bit from the
cell it was cut from by the same rule, or, in the first grid, from the edges of its row.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casewell.functions.values import point
from casewell.operators.joins import lookup
from casewell.session import stage

# Edges that a cell may keep before it is cut, over all zones.
MOST_EDGES = 256
# Cuts of a cell of the first grid. Only edges that meet in one spot are still together then.
DEEPEST = 24
EDGE = ["x1", "y1", "x2", "y2"]


def grid_size(cell: float) -> float:
    """The power of two next to `cell`: its multiples and fractions are exact numbers."""
    return 2.0 ** round(math.log2(cell))


def cell_key(level: Column, cx: Column, cy: Column) -> Column:
    return F.concat_ws("_", *[c.cast("string") for c in (level, cx, cy)])


def zone_edges(zones: DataFrame, zone: str, rings: str) -> DataFrame:
    """One row per edge of every ring of every part; equal parity rules for holes."""
    ring = F.col("ring")
    turned = F.concat(F.slice(ring, 2, F.greatest(F.size(ring), F.lit(1))), F.slice(ring, 1, 1))
    pairs = zones.select(zone, F.explode(F.flatten(rings)).alias("ring")).select(
        zone, F.explode(F.arrays_zip(ring.alias("a"), turned.alias("b"))).alias("e")
    )
    # A ring that repeats its first vertex at the end gives one edge of length 0 less.
    return pairs.select(
        zone,
        F.col("e.a")[0].alias("x1"),
        F.col("e.a")[1].alias("y1"),
        F.col("e.b")[0].alias("x2"),
        F.col("e.b")[1].alias("y2"),
    ).filter("x1 != x2 OR y1 != y2")


def _spans(e, y: Column) -> Column:
    return (e["y1"] > y) != (e["y2"] > y)


def _columns(e, row: Column, size: float) -> tuple[Column, Column]:
    """First and last cell of a row of cells that an edge may touch, with a margin for rounding."""
    x1, y1, x2, y2 = (e[c] for c in EDGE)
    left, right = F.least(x1, x2), F.greatest(x1, x2)
    at = lambda y: F.when(y1 == y2, x1).otherwise(x1 + (x2 - x1) * ((y - y1) / F.nullif(y2 - y1, F.lit(0.0))))
    low = at(F.greatest(F.least(y1, y2), row * size))
    high = F.when(y1 == y2, x2).otherwise(at(F.least(F.greatest(y1, y2), (row + 1) * size)))
    margin = size * 2.0**-20 + (F.abs(x1) + F.abs(x2)) * 2.0**-48
    first = F.greatest(left, F.least(low, high) - margin)
    last = F.least(right, F.greatest(low, high) + margin)
    return F.floor(first / size), F.floor(last / size)


def _first_grid(edges: DataFrame, zone: str, size: float) -> tuple[DataFrame, DataFrame]:
    """Edges by the cells that they touch, and all cells: `(zone, cx, cy, n, odd)`."""
    e = {c: F.col(c) for c in EDGE}
    low, high = F.floor(F.least("y1", "y2") / size), F.floor(F.greatest("y1", "y2") / size)
    rows = edges.select(zone, *EDGE, F.explode(F.sequence(low, high)).alias("cy"))
    first, last = _columns(e, F.col("cy"), size)
    ranges = rows.withColumns({"first": first, "last": last})
    placed = ranges.withColumn("cx", F.explode(F.sequence("first", "last")))
    # Right of all cells before its first one in the row, if it crosses the row's lower side.
    opens = (F.col("cx") == F.col("first")) & _spans(e, F.col("cy") * size)
    counted = placed.groupBy(zone, "cx", "cy").agg(
        F.count("*").alias("n"), F.sum(opens.cast("long")).alias("opens")
    )
    # As many rows as cells of the grid in one row that the zone's outline touches.
    beyond = Window.partitionBy(zone, "cy").orderBy(F.desc("cx"))
    right = F.sum("opens").over(beyond.rowsBetween(Window.unboundedPreceding, -1))
    cells = counted.withColumns(
        {"odd": F.coalesce(right, F.lit(0)) % 2 == 1, "next": F.lag("cx").over(beyond)}
    )
    between = cells.filter("odd AND next > cx + 1").select(
        zone,
        F.explode(F.sequence(F.col("cx") + 1, F.col("next") - 1)).alias("cx"),
        "cy",
        F.lit(0).cast("long").alias("n"),
        "odd",
    )
    return placed.select(zone, "cx", "cy", *EDGE), cells.drop("opens", "next").unionByName(between)


def _quarters(df: DataFrame) -> DataFrame:
    """Each row once per quarter of its cell: new cell `kx`, `ky`."""
    halves = F.array(F.lit(0), F.lit(1))
    spread = df.withColumn("i", F.explode(halves)).withColumn("j", F.explode(halves))
    return spread.withColumns({"kx": F.col("cx") * 2 + F.col("i"), "ky": F.col("cy") * 2 + F.col("j")})


def _cut(
    touching: DataFrame, cells: DataFrame, crowded: DataFrame, zone: str, size: float
) -> tuple[DataFrame, DataFrame]:
    """`touching` and `cells` of the quarters of crowded cells of the given size."""
    half = size / 2
    e = {c: F.col(c) for c in EDGE}
    floor = F.col("ky") * half
    quarters = _quarters(touching.join(crowded, ["cx", "cy"]))
    first, last = _columns(e, F.col("ky"), half)
    quarters = quarters.withColumns({"first": first, "last": last})
    in_row = F.col("ky").between(F.floor(F.least("y1", "y2") / half), F.floor(F.greatest("y1", "y2") / half))
    met = in_row & F.col("kx").between(F.col("first"), F.col("last"))
    passed = ~met & _spans(e, floor) & (F.col("first") > F.col("kx"))
    ends = sum(
        (
            (F.floor(F.col(x) / size) > F.col("cx")) & (F.col(y) > F.col("cy") * size) & (F.col(y) <= floor)
        ).cast("long")
        for x, y in (("x1", "y1"), ("x2", "y2"))
    )
    turned = quarters.withColumns({"met": met, "turns": passed.cast("long") + ends})
    counted = turned.groupBy(zone, "kx", "ky").agg(
        F.sum(F.col("met").cast("long")).alias("met"), F.sum("turns").alias("turns")
    )
    whole = _quarters(cells.join(crowded, ["cx", "cy"])).select(zone, "kx", "ky", "odd")
    known = whole.join(counted, [zone, "kx", "ky"], "left").select(
        zone,
        F.col("kx").alias("cx"),
        F.col("ky").alias("cy"),
        F.coalesce("met", F.lit(0)).alias("n"),
        (F.col("odd") != (F.coalesce("turns", F.lit(0)) % 2 == 1)).alias("odd"),
    )
    kept = turned.filter("met").select(zone, F.col("kx").alias("cx"), F.col("ky").alias("cy"), *EDGE)
    return kept, known.filter("n > 0 OR odd")


def _leaves(touching: DataFrame, cells: DataFrame, zone: str, level: int) -> DataFrame:
    edges = touching.groupBy(zone, "cx", "cy").agg(F.collect_list(F.struct(*EDGE)).alias("edges"))
    return cells.join(edges, [zone, "cx", "cy"], "left").select(
        zone,
        F.lit(level).alias("level"),
        "cx",
        "cy",
        F.when(F.col("n") == 0, True).alias("inside"),
        "odd",
        "edges",
    )


def zone_tree(
    zones: DataFrame, zone: str, rings: str, cell: float, most: int = MOST_EDGES
) -> tuple[DataFrame, int]:
    """Leaves `(zone, level, cx, cy, inside, odd, edges)`, and the deepest level.

    A leaf has at most `most` edges over all zones, unless they are still together after
    `DEEPEST` cuts. Below a cell that was cut, leaves without any zone have a row with a NULL
    zone, so that a point there meets exactly one leaf.
    """
    size = grid_size(cell)
    touching, cells = _first_grid(zone_edges(zones, zone, rings), zone, size)
    parts, level, empty = [], 0, None
    while True:
        crowded = cells.groupBy("cx", "cy").agg(F.sum("n").alias("_n")).filter(F.col("_n") > most).drop("_n")
        done = level == DEEPEST or crowded.isEmpty()
        if not done:
            touching, cells, crowded = stage(touching, "edges"), stage(cells, "cells"), stage(crowded, "crowded")
            left = [x.join(crowded, ["cx", "cy"], "left_anti") for x in (touching, cells)]
        else:
            left = [touching, cells]
        parts.append(_leaves(*left, zone, level))
        if empty is not None:
            free = empty if done else empty.join(crowded, ["cx", "cy"], "left_anti")
            parts.append(
                free.select(
                    *[
                        F.lit(level).alias(f.name) if f.name == "level"
                        else F.col(f.name) if f.name in ("cx", "cy")
                        else F.lit(None).cast(f.dataType).alias(f.name)
                        for f in parts[0].schema
                    ]
                )
            )
        if done:
            break
        touching, cells = _cut(touching, cells, crowded, zone, size)
        empty = _quarters(crowded).select(F.col("kx").alias("cx"), F.col("ky").alias("cy"))
        size, level = size / 2, level + 1
    leaves = parts[0]
    for part in parts[1:]:
        leaves = leaves.unionByName(part)
    return leaves, level


def zone_cells(
    zones: DataFrame, zone: str, rings: str, cell: float, most: int = MOST_EDGES
) -> DataFrame:
    """`(zone, cell, inside, odd, edges)` of the leaves that a zone touches.

    `inside` is true for a leaf wholly inside, and NULL where `edges` must decide.
    """
    leaves, _ = zone_tree(zones, zone, rings, cell, most)
    key = cell_key(F.col("level"), F.col("cx"), F.col("cy")).alias("cell")
    return leaves.filter(F.col(zone).isNotNull()).select(zone, key, "inside", "odd", "edges")


def _contains(z: Column, x: Column, y: Column, right: Column, floor: Column) -> Column:
    """Whether a zone's leaf strictly contains a point; `right` and `floor` bound the leaf."""

    def changes(e: Column) -> Column:
        met = _spans(e, y) & (x < (e["x2"] - e["x1"]) * (y - e["y1"]) / (e["y2"] - e["y1"]) + e["x1"])
        end = lambda vx, vy: ((vx >= right) & (vy > floor) & (vy <= y)).cast("int")
        return met.cast("int") + end(e["x1"], e["y1"]) + end(e["x2"], e["y2"])

    def touched(e: Column) -> Column:
        return (
            ((e["x2"] - e["x1"]) * (y - e["y1"]) == (e["y2"] - e["y1"]) * (x - e["x1"]))
            & x.between(F.least(e["x1"], e["x2"]), F.greatest(e["x1"], e["x2"]))
            & y.between(F.least(e["y1"], e["y2"]), F.greatest(e["y1"], e["y2"]))
        )

    start = F.when(z["odd"], 1).otherwise(0)
    crossings = F.aggregate(z["edges"], start, lambda n, e: n + changes(e))
    return F.coalesce(z["inside"], (crossings % 2 == 1) & ~F.exists(z["edges"], touched))


def zone_join(
    points: DataFrame,
    zones: DataFrame,
    key: str,
    cell: float,
    zone: str = "zone",
    rings: str = "rings",
    lat: str = "lat",
    lon: str = "lon",
    most: int = MOST_EDGES,
) -> DataFrame:
    """Zone that strictly contains each point, NULL for none; the lowest id of several.

    A point on an outline, a hole's included, is in no zone. The points meet the cells of the
    first grid, of the size of `cell`, in one join; if any of these was cut, a second join takes
    their points to the leaves. `most` bounds the edges that a point is compared with. The
    points' `key` is not needed any more.
    """
    x, y = F.col(lon), F.col(lat)
    size = grid_size(cell)
    known = point(x, y).isNotNull()
    at = lambda level: cell_key(
        level.cast("int"), *[F.floor(c / (size * F.pow(F.lit(0.5), level))) for c in (x, y)]
    )
    leaves, deepest = zone_tree(zones, zone, rings, cell, most)
    one = F.when(F.col(zone).isNotNull(), F.struct(zone, "inside", "odd", "edges"))
    # Staged: small, of a size the planner then knows, and not computed again.
    per_cell = stage(
        leaves.groupBy("level", "cx", "cy").agg(F.collect_list(one).alias("_zones")), "cells"
    )
    named = per_cell.select(
        cell_key(F.col("level"), F.col("cx"), F.col("cy")).alias("_cell"), "_zones", "level"
    )
    placed = points.withColumn("_cell", F.when(known, at(F.lit(0))))
    if deepest == 0:
        near = lookup(placed, named.withColumnRenamed("level", "_level"), "_cell")
    else:
        # Levels of the leaves in every cell of the first grid that was cut.
        root = [F.expr(f"shiftright({c}, level)").alias(c) for c in ("cx", "cy")]
        roots = per_cell.select("level", *root).groupBy("cx", "cy").agg(F.collect_set("level").alias("_levels"))
        cells = stage(roots.select(cell_key(F.lit(0), F.col("cx"), F.col("cy")).alias("_cell"), "_levels"), "roots")
        levels = F.coalesce("_levels", F.array(F.lit(0)))
        tried = lookup(placed, cells, "_cell").withColumn("_try", F.explode(levels)).drop("_levels", "_cell")
        tried = tried.withColumn("_cell", F.when(known, at(F.col("_try"))))
        found = lookup(tried, named.withColumnRenamed("level", "_level"), "_cell")
        # One leaf holds the point; without a cut cell the first grid was tried alone.
        near = found.filter(F.col("_level").isNotNull() | (F.col("_try") == 0))
    edge = size * F.pow(F.lit(0.5), F.coalesce("_level", F.lit(0)))
    right, floor = (F.floor(x / edge) + 1) * edge, F.floor(y / edge) * edge
    holding = F.filter("_zones", lambda z: _contains(z, x, y, right, floor))
    return near.select(*points.columns, F.array_min(F.transform(holding, lambda z: z[zone])).alias(zone))


def assign_zones(
    locations: DataFrame, zones: DataFrame, key: str, cell: float, zone: str = "zone"
) -> DataFrame:
    """Fill the zone of located rows that have none; a zone once set is kept."""
    open_rows = locations.filter(F.col(zone).isNull() & F.col("lat").isNotNull())
    fresh = zone_join(open_rows.select(key, "lat", "lon"), zones, key, cell).select(
        key, F.col("zone").alias("_zone")
    )
    joined = locations.join(fresh, key, "left")
    return joined.withColumn(zone, F.coalesce(zone, "_zone")).drop("_zone").select(*locations.columns)
