"""Typologies of categorical rows by k-modes, on counted combinations of levels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casewell.operators.silhouette import exact_silhouette
from casewell.session import stage


def combinations(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Distinct combinations of levels with their number of rows; NULL is a level `''`."""
    levels = df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in cols])
    return stage(levels.groupBy(*cols).agg(F.count(F.lit(1)).alias("n")), "combinations")


def _distances(cols: Sequence[str], modes: Sequence[Sequence[str]]) -> Column:
    """Number of columns that differ from each mode, as an array."""
    return F.array(
        *[
            sum((F.col(c) != F.lit(v)).cast("int") for c, v in zip(cols, mode, strict=True))
            for mode in modes
        ]
    )


def assign_modes(df: DataFrame, cols: Sequence[str], modes: Sequence[Sequence[str]]) -> DataFrame:
    """Add the nearest mode as `cluster` (the first of equal ones), the distance to it, and
    the distance to the nearest other mode."""
    measured = df.withColumn("_d", _distances(cols, modes))
    nearest = measured.withColumn("distance", F.array_min("_d"))
    placed = nearest.withColumn(
        "cluster", (F.array_position("_d", F.col("distance")) - 1).cast("int")
    )
    others = F.filter("_d", lambda d, i: i != F.col("cluster"))
    return placed.withColumn("other_distance", F.array_min(others)).drop("_d")


def _next_modes(
    assigned: DataFrame, cols: Sequence[str], modes: list[tuple[str, ...]]
) -> list[tuple[str, ...]]:
    """Most frequent level of each column per cluster, the lowest on ties. Counts are made
    on the cluster; what comes back is one level per mode and column."""
    cells = F.array(*[F.struct(F.lit(i).alias("i"), F.col(c).alias("v")) for i, c in enumerate(cols)])
    counted = (
        assigned.select("cluster", "n", F.inline(cells))
        .groupBy("cluster", "i", "v")
        .agg(F.sum("n").alias("n"))
    )
    best = counted.groupBy("cluster", "i").agg(
        F.min_by("v", F.struct((-F.col("n")).alias("a"), F.col("v").alias("b"))).alias("v")
    )
    found = {(r["cluster"], r["i"]): r["v"] for r in best.collect()}
    return [
        tuple(found.get((k, i), level) for i, level in enumerate(mode))
        for k, mode in enumerate(modes)
    ]


def fit_modes(
    combos: DataFrame, cols: Sequence[str], k: int, rounds: int
) -> tuple[list[tuple[str, ...]], bool]:
    """Modes from the `k` most frequent combinations, updated until they stay or `rounds` times,
    and whether they stayed."""
    first = combos.orderBy(F.desc("n"), *cols).limit(k).select(*cols).collect()
    modes = [tuple(r) for r in first]
    for _ in range(rounds):
        moved = _next_modes(assign_modes(combos, cols, modes), cols, modes)
        if moved == modes:
            return modes, True
        modes = moved
    return modes, _next_modes(assign_modes(combos, cols, modes), cols, modes) == modes


def kmodes(df: DataFrame, cols: Sequence[str], k: int, rounds: int = 100) -> DataFrame:
    """One row per cluster: its mode, its rows, their summed distance, the simplified silhouette
    (own mode against the nearest other one), the exact one (own rows against those of the nearest
    other cluster), and whether the modes came to rest within `rounds` updates."""
    combos = combinations(df, cols)
    modes, converged = fit_modes(combos, cols, k, rounds)
    assigned = assign_modes(combos, cols, modes)
    a, b = F.col("distance"), F.col("other_distance")
    silhouette = F.coalesce((b - a) / F.nullif(F.greatest(a, b), F.lit(0)), F.lit(0.0))
    sizes = assigned.groupBy("cluster").agg(
        F.sum("n").alias("n"),
        F.sum(a * F.col("n")).alias("cost"),
        (F.sum(silhouette * F.col("n")) / F.sum("n")).alias("silhouette"),
    )
    listed = df.sparkSession.createDataFrame(
        [(i, *mode) for i, mode in enumerate(modes)],
        "cluster int, " + ", ".join(f"`{c}` string" for c in cols),
    )
    exact = exact_silhouette(assigned.select("cluster", *cols, "n"), cols, len(modes))
    return listed.join(sizes, "cluster", "left").join(exact, "cluster", "left").select(
        "cluster", *cols, F.coalesce("n", F.lit(0)).alias("n"), "cost", "silhouette",
        "exact_silhouette", F.lit(converged).alias("converged"),
    )
