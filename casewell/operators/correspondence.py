"""Multiple correspondence analysis by block iteration on a sparse indicator table.

The operator whose leading vectors are sought averages a level vector over the levels of every
combination, and the results over the combinations of every level. Both are grouped aggregations
over counted combinations, so levels may be many. A block of vectors is improved by the best
combinations of itself, its residuals and its last change (a locally optimal block method); what
reaches the driver is one matrix of products of these vectors, whatever the number of levels.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewell.operators.clusters import combinations
from casewell.session import stage

# Vectors carried beyond the wanted ones: convergence follows the first value left out.
EXTRA = 6
# Relative size below which a direction counts as lost.
_LOST = 1e-10
_RESULT = "col string, level string, mass double, axis int, coordinate double, inertia double, converged boolean"
_LEVELS = "col string, level string, mass double, block array<double>"


def indicator(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Ones of the indicator matrix, (combo, n, col, level): `n` rows have the combination."""
    combos = combinations(df, cols).withColumn("combo", F.monotonically_increasing_id())
    named = F.array(*[F.struct(F.lit(c).alias("col"), F.col(c).alias("level")) for c in cols])
    return stage(combos.select("combo", "n", F.inline(named)), "indicator")


def _averaged(ones: DataFrame, levels: DataFrame, q: int, start: int, width: int) -> DataFrame:
    """`levels` with the averages of `width` vectors of their block, from `start` on, behind it."""
    # A frequent level's rows are split by AQE: the other side is unique by level.
    own = levels.select("col", "level", F.slice("block", start + 1, width).alias("x"))
    joined = ones.join(own, ["col", "level"])
    means = [(F.sum(F.get("x", F.lit(i))) / q).alias(f"r{i}") for i in range(width)]
    members = F.collect_list(F.struct("col", "level")).alias("members")  # one level a column
    rows = joined.groupBy("combo", "n").agg(*means, members)
    back = rows.select("n", *[f"r{i}" for i in range(width)], F.inline("members"))
    total = F.sum("n")
    y = F.array(*[F.sum(F.col("n") * F.col(f"r{i}")) / total for i in range(width)])
    found = levels.join(back.groupBy("col", "level").agg(y.alias("y")), ["col", "level"])
    return stage(found.withColumn("block", F.concat("block", "y")).drop("y"), "averaged")


def _block(frame: pa.RecordBatch) -> np.ndarray:
    return frame.column(frame.schema.get_field_index("block")).flatten().to_numpy().reshape(frame.num_rows, -1)


def _products(levels: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(mass-weighted products of the centred vectors of the block, their means). Tasks add up
    the matrices of their rows; one matrix of `width` + 1 rows comes back."""
    size = width + 1

    def task(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for frame in frames:
            mass = frame.column(0).to_numpy()
            block = np.hstack([np.ones((len(mass), 1)), _block(frame)])
            total += block.T @ (mass[:, None] * block)
        columns = [pa.array(np.arange(size * size)), pa.array(total.ravel())]
        yield pa.RecordBatch.from_arrays(columns, names=["cell", "v"])

    parts = levels.select("mass", "block").mapInArrow(task, "cell bigint, v double")
    out = np.zeros(size * size)
    for row in parts.groupBy("cell").agg(F.sum("v").alias("v")).collect():
        out[row["cell"]] = row["v"]
    out = out.reshape(size, size)
    return out[1:, 1:] - np.outer(out[0, 1:], out[0, 1:]), out[0, 1:]


def _combined(levels: DataFrame, weights: np.ndarray, means: np.ndarray) -> DataFrame:
    """`levels` with the centred block times a matrix in place of the block."""

    def task(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            if frame.num_rows:
                moved = (_block(frame) - means) @ weights
                offsets = pa.array(np.arange(frame.num_rows + 1, dtype=np.int32) * weights.shape[1])
                rows = pa.ListArray.from_arrays(offsets, pa.array(moved.ravel()))
                yield pa.RecordBatch.from_arrays([*frame.columns[:3], rows], names=["col", "level", "mass", "block"])

    return levels.select("col", "level", "mass", "block").mapInArrow(task, _LEVELS)


def _basis(products: np.ndarray) -> np.ndarray:
    """Weights that make vectors orthonormal; directions that are lost are left out."""
    sizes = np.sqrt(np.clip(np.diag(products), 0, None))
    scale = np.where(sizes > 0, 1 / np.where(sizes > 0, sizes, 1), 0)
    values, vectors = np.linalg.eigh(scale[:, None] * products * scale[None, :])
    held = values > max(values.max(initial=0), 0) * _LOST
    return scale[:, None] * vectors[:, held] / np.sqrt(values[held])


def _best(found: np.ndarray, many: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(weights, values) of the best `width` combinations of the first `many` vectors of a block
    whose last `many` ones are their averages."""
    basis = _basis(found[:many, :many])
    small = basis.T @ found[:many, many:] @ basis
    values, vectors = np.linalg.eigh((small + small.T) / 2)
    order = np.argsort(values)[::-1][:width]
    return basis @ vectors[:, order], values[order]


def mca(df: DataFrame, cols: Sequence[str], axes: int = 2, steps: int = 100, tolerance: float = 1e-9) -> DataFrame:
    """Principal coordinates of every level on the first axes, with each axis' inertia.

    (col, level, mass, axis, coordinate, inertia, converged); NULL is the level `''`. Stops when
    the residual of every wanted axis is below `tolerance` times the first inertia, else after
    `steps` with `converged` false. Where the levels leave fewer directions than the block has,
    the first step is exact. The largest coordinate of an axis is positive (the first level of
    equal ones, to 9 digits). Fewer axes come back where the data have no more; axes of equal
    inertia are any basis of their plane. An empty frame gives no rows.
    """
    q, spark = len(cols), df.sparkSession
    ones = indicator(df, cols)
    counted = ones.groupBy("col", "level").agg(F.sum("n").alias("n"))
    total = ones.groupBy("col").agg(F.sum("n").alias("n")).agg(F.max("n")).first()[0]
    if not total:
        return spark.createDataFrame([], _RESULT)
    width = axes + EXTRA
    noise = F.array(*[F.xxhash64("col", "level", F.lit(i)) / F.lit(2.0**63) for i in range(width)])
    mass = (F.col("n") / F.lit(float(total * q))).alias("mass")
    levels = stage(counted.select("col", "level", mass, noise.alias("block")), "levels")
    found, means = _products(levels, width)
    first = _basis(found)
    width = first.shape[1]
    if not width:
        return spark.createDataFrame([], _RESULT)
    # The block is [x, T x]; later [x, p, r, T x, T p, T r] with residuals r and last changes p.
    levels = _averaged(ones, stage(_combined(levels, first, means), "block"), q, 0, width)
    many, converged = width, False
    for step in range(max(1, steps)):
        found, means = _products(levels, 2 * many)
        weights, values = _best(found, many, width)
        width = len(values)
        nothing = np.zeros_like(weights)
        x, y = np.vstack([weights, nothing]), np.vstack([nothing, weights])
        r = y - x * values
        # Lengths of the residuals of the vectors that these ones improve.
        old = np.sqrt(np.diag(found)[many - width : many].clip(0))[:axes] if step else np.full(axes, np.inf)
        converged = bool((old <= tolerance * max(values[0], 0)).all())
        if converged or step == steps - 1:
            break
        change = weights.copy()
        change[:width] = 0
        sizes = np.sqrt(np.clip(np.diag(change.T @ found[:many, :many] @ change), 0, None))
        change /= np.where(sizes > 0, sizes, 1)
        p, tp = np.vstack([change, nothing]), np.vstack([nothing, change])
        keep = [x, p, r, y, tp] if step else [x, r, y]
        levels = stage(_combined(levels, np.hstack(keep), means), "block")
        many = (len(keep) + 1) // 2 * width
        levels = _averaged(ones, levels, q, many - width, width)
    return _coordinates(levels, weights[:, :axes], values[:axes], means, converged)


def _coordinates(levels: DataFrame, weights: np.ndarray, inertia: np.ndarray, means: np.ndarray, converged: bool) -> DataFrame:
    axes = [i for i, v in enumerate(inertia) if v > _LOST]
    if not axes:
        return levels.sparkSession.createDataFrame([], _RESULT)
    scaled = np.vstack([weights[:, axes] * np.sqrt(inertia[axes]), np.zeros_like(weights[:, axes])])
    # Staged: the orientation and the rows must be of the same numbers.
    placed = stage(_combined(levels, scaled, means).select("col", "level", "mass", F.posexplode("block").alias("place", "raw")), "axes")
    largest = F.struct((-F.round(F.abs("raw"), 9)).alias("size"), F.col("col"), F.col("level"))
    sides = placed.groupBy("place").agg(F.min_by("raw", largest).alias("most"))
    signed = placed.join(F.broadcast(sides), "place")  # one row an axis
    values = F.array(*[F.lit(float(v)) for v in inertia[axes]])
    return signed.select(
        "col", "level", "mass", (F.col("place") + 1).alias("axis"),
        F.when(F.col("most") < 0, -F.col("raw")).otherwise(F.col("raw")).alias("coordinate"),
        F.get(values, F.col("place")).alias("inertia"), F.lit(converged).alias("converged"),
    )
