"""Exact silhouette of clustered categorical rows, without pairs.

The Hamming distance of a row to all rows of a cluster, summed, is for each column the cluster's
size less the number of its rows with the same level. So counts of levels per cluster are enough.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def exact_silhouette(assigned: DataFrame, cols: Sequence[str], k: int) -> DataFrame:
    """Mean silhouette of each cluster's rows, (cluster, exact_silhouette).

    `assigned` has counted combinations: `cluster` (0 to k - 1), the columns, and `n` rows of each.
    A row's own distance is the mean to the others of its cluster, the other one the least mean to
    another cluster that has rows. It is 0 for a row alone in its cluster, without another cluster,
    or where both distances are 0.
    """
    clusters = F.array(*[F.lit(j) for j in range(k)])
    sizes = assigned.agg(*[F.coalesce(F.sum(F.when(F.col("cluster") == j, F.col("n"))), F.lit(0)).alias(f"s{j}") for j in range(k)]).first()
    cells = F.array(*[F.struct(F.lit(c).alias("col"), F.col(c).alias("level")) for c in cols])
    rows = assigned.withColumn("combo", F.struct(*cols)).select("combo", "cluster", "n", F.inline(cells))
    held = rows.groupBy("col", "level").agg(
        *[F.coalesce(F.sum(F.when(F.col("cluster") == j, F.col("n"))), F.lit(0)).alias(f"c{j}") for j in range(k)]
    )
    # A level's counts meet every combination that has it; a combination has one level a column.
    apart = rows.join(held, ["col", "level"]).groupBy("combo", "cluster", "n").agg(
        *[F.sum(F.lit(sizes[f"s{j}"]) - F.col(f"c{j}")).alias(f"d{j}") for j in range(k)]
    )
    distance = F.array(*[F.col(f"d{j}").cast("double") for j in range(k)])
    size = F.array(*[F.lit(float(sizes[f"s{j}"])) for j in range(k)])
    own_size, own = F.get(size, F.col("cluster")), F.get(distance, F.col("cluster"))
    others = F.filter(clusters, lambda j: (j != F.col("cluster")) & (F.get(size, j) > 0))
    b = F.array_min(F.transform(others, lambda j: F.get(distance, j) / F.get(size, j)))
    measured = apart.select(
        "cluster", "n", F.when(own_size > 1, own / (own_size - 1)).alias("a"), b.alias("b")
    )
    a, b = F.col("a"), F.col("b")
    value = F.when((F.greatest(a, b) > 0) & a.isNotNull() & b.isNotNull(), (b - a) / F.greatest(a, b))
    return measured.groupBy("cluster").agg(
        (F.sum(F.coalesce(value, F.lit(0.0)) * F.col("n")) / F.sum("n")).alias("exact_silhouette")
    )
