"""Row numbers, surrogate ids, dimension rows and links to them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casewell.functions import text as tx
from casewell.operators.joins import lookup
from casewell.session import stage

# monotonically_increasing_id puts the partition number above these bits.
_POSITION_BITS = 33


def number_rows(
    df: DataFrame, part: Sequence[str], order: Sequence[str], name: str = "row_number"
) -> DataFrame:
    """1, 2, … inside each `part` by the order columns, which tell its rows apart.

    All rows are put in total order over all tasks, where the rows of a part that lie in the
    same partition, a piece, follow each other. A row's number is its place after the piece's
    first row, and the rows in earlier pieces are added. So no task sorts a part alone.
    """
    placed = _ordered(df, [*part, *order], "rows")
    pieces = placed.groupBy("_part", *part).agg(
        F.min("_pos").alias("_first"), F.count(F.lit(1)).alias("_rows")
    )
    # A part has no more pieces than there are partitions.
    earlier = Window.partitionBy(*part).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("_rows").over(earlier), F.lit(0)) - F.col("_first")
    shifts = pieces.select(
        F.col("_part").alias("_at"), before.alias("_shift"), *[F.col(c).alias(f"_of_{c}") for c in part]
    )
    same = F.col("_part") == F.col("_at")
    for c in part:
        same = same & F.col(c).eqNullSafe(F.col(f"_of_{c}"))
    # Staged, so that its size is known: where the parts are few, the rows stay in place.
    numbered = placed.join(stage(shifts, "shifts"), same)
    number = (F.col("_pos") + F.col("_shift") + 1).cast("bigint").alias(name)
    return numbered.select(*df.columns, number)


def _ordered(df: DataFrame, order: Sequence[str | Column], label: str) -> DataFrame:
    """`df` in total order with `_part` and `_pos` (0-based place in the part).

    Rows are range-partitioned and sorted, never brought into one task. The ordered rows
    are staged, since range bounds are sampled and a re-run task could cut them elsewhere.
    """
    ordered = (
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_seq", F.monotonically_increasing_id())
    )
    return (
        stage(ordered, label)
        .withColumn("_part", F.shiftright("_seq", _POSITION_BITS))
        .withColumn("_pos", F.col("_seq").bitwiseAND((1 << _POSITION_BITS) - 1))
        .drop("_seq")
    )


def positioned(df: DataFrame, order: Sequence[str | Column], label: str) -> DataFrame:
    """`df` in total order with `_part`, `_pos` (0-based place in the part), `_before`
    (rows in earlier parts) and `_total` (all rows).

    The table of part sizes has one row per partition, so it may be broadcast.
    """
    staged = _ordered(df, order, label)
    sizes = staged.groupBy("_part").agg(F.count(F.lit(1)).alias("_rows"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before")
    total = F.sum("_rows").over(Window.partitionBy()).alias("_total")
    return staged.join(F.broadcast(sizes.select("_part", before, total)), "_part")


def dense_ids(
    df: DataFrame, order: Sequence[str | Column], name: str = "id", start: int = 1
) -> DataFrame:
    """Surrogate ids `start`, `start + 1`, … without gaps, in the given order."""
    number = (F.col("_before") + F.col("_pos") + start).cast("bigint").alias(name)
    return positioned(df, order, "ids").select(number, *df.columns)


def next_id(df: DataFrame, name: str = "id") -> int:
    """The id after the largest one in use (one number, from one aggregate)."""
    return (df.agg(F.max(name)).first()[0] or 0) + 1


def distinct_of(df: DataFrame, *cols: str) -> DataFrame:
    return df.select(*cols).distinct()


def _told_apart(df: DataFrame) -> DataFrame:
    """Distinct rows, by counting them. The optimizer would drop a plain distinct below a
    minimum, and the minimum of a text or struct sorts every row it reads."""
    counted = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_n"))
    return counted.filter("_n > 0").drop("_n")


def one_per_key(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per key: the least of its distinct rows."""
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.distinct()
    rows = _told_apart(df)
    least = rows.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_row"))
    return least.select(*keys, "_row.*").select(*df.columns)


def one_name_per_code(df: DataFrame, code: str = "code", name: str = "name") -> DataFrame:
    return df.distinct().groupBy(code).agg(F.min(name).alias(name))


def coded_dim(df: DataFrame, label: str) -> DataFrame:
    """`(code, name)` of a coded label column, one row per code."""
    labels = _told_apart(df.select(label).filter(F.col(label).isNotNull()))
    pairs = labels.select(
        tx.label_code(F.col(label)).alias("code"), tx.label_name(F.col(label)).alias("name")
    )
    return one_name_per_code(pairs)


def missing_rows(target: DataFrame, source: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of `source`, one per key, whose key is not in `target`."""
    new_keys = one_per_key(source, keys)
    return new_keys.join(target.select(*keys), list(keys), "left_anti")


def append(target: DataFrame, rows: DataFrame) -> DataFrame:
    return target.unionByName(rows)


def insert_missing(target: DataFrame, source: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Insert-if-absent: rows of the target stay as they are."""
    return append(target, missing_rows(target, source, keys).select(*target.columns))


def insert_missing_with_ids(
    target: DataFrame, source: DataFrame, keys: Sequence[str], name: str = "id"
) -> DataFrame:
    """Insert-if-absent where new rows get ids after the largest one in use."""
    fresh = missing_rows(target, source, keys)
    numbered = dense_ids(fresh, list(keys), name, next_id(target, name))
    return target.unionByName(numbered, allowMissingColumns=True)


def upsert(target: DataFrame, source: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of `source` replace those of the target with the same key."""
    kept = target.join(source.select(*keys), list(keys), "left_anti")
    return kept.unionByName(source)


def link_by_name(df: DataFrame, dim: DataFrame, col: str, name: str, id_: str) -> DataFrame:
    """Add the id of the dimension row whose name equals `col`, NULL without one."""
    return lookup(df, dim.select(F.col(name).alias(col), id_), col)


def link_by_pair(
    df: DataFrame, dim: DataFrame, a: str, b: str, id_: str, dtype: str = "int"
) -> DataFrame:
    """Add the id of the row with equal `a` and `b`, where `b` is text on the fact side."""
    right = dim.select(F.col(a), F.col(b).alias("_b"), id_)
    left = df.withColumn("_b", F.trim(F.col(b).cast("string")).try_cast(dtype))
    return lookup(left, right, [a, "_b"]).select(*df.columns, id_)


def link_code(df: DataFrame, col: str, name: str, sep: str = tx.R.LABEL_SEPARATOR) -> DataFrame:
    """Add the code of a coded label; no join is needed."""
    return df.withColumn(name, tx.label_code(F.col(col), sep))
