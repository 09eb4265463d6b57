"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewell.session import stage


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component): the least id reachable, for every id in a link.

    In each round a node takes the least label of itself and its neighbours, then the label of
    that label, so labels jump and a chain needs about the logarithm of its length. Every round
    is staged; only the question whether a label changed reaches the driver.
    """
    both = links.select(F.col(a).alias("id"), F.col(b).alias("other")).filter("id <> other")
    edges = stage(both.union(both.select("other", "id")).distinct(), "edges")
    labels = stage(edges.groupBy("id").agg(F.least("id", F.min("other")).alias("component")), "labels")
    while True:
        heard = edges.join(labels.withColumnRenamed("id", "other"), "other").groupBy("id").agg(F.min("component").alias("_heard"))
        least = labels.join(heard, "id").select("id", F.col("component").alias("_old"), F.least("component", "_heard").alias("_new"))
        above = labels.select(F.col("id").alias("_new"), F.col("component").alias("_jump"))
        following = stage(
            least.join(above, "_new", "left").select(
                "id", F.coalesce(F.least("_new", "_jump"), "_new").alias("component"), "_old"
            ),
            "labels",
        )
        labels = following.select("id", "component")
        if following.filter("component <> _old").isEmpty():
            return labels
