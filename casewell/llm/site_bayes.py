"""Quality classifier: document evidence combined with host and path posteriors.

1. Document classifier: a logistic regression on document statistics gives every document a
   probability.
2. Hierarchical empirical Bayes: the sites' levels (host, path) are groups of documents. Going
   down, the rate of a group is a beta posterior around its parent's rate. The strength of the
   prior is fitted per level by moments, so groups with few documents shrink to their parent.
3. The document's log odds are moved by those of its lowest group against the global rate.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewell.llm.common import slim
from casewell.llm.document_stats import ALL, document_stats, ratios
from casewell.llm.quality_rules import labelled_sample
from casewell.session import stage


def fit_logistic(x: np.ndarray, y: np.ndarray, rounds: int = 30, ridge: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(weights with the intercept last, means, scales) by Newton steps on scaled features."""
    mean, scale = x.mean(0), np.where(x.std(0) > 0, x.std(0), 1)
    z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    w = np.zeros(z.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        h = z.T @ (z * (p * (1 - p) + 1e-9)[:, None]) + ridge * np.eye(len(w))
        step = np.linalg.solve(h, z.T @ (y - p) - ridge * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w, mean, scale


def features(table: np.ndarray) -> np.ndarray:
    """Ratios and their square roots, which part small shares of noise from none."""
    x = ratios(table)
    return np.column_stack([x, np.sqrt(np.maximum(x, 0))])


def document_scores(stats: DataFrame, model: tuple[np.ndarray, np.ndarray, np.ndarray] | None, share: float) -> DataFrame:
    def task(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            p = np.full(frame.num_rows, share)
            if model:
                w, mean, scale = model
                z = (features(np.column_stack([frame.column(c).to_numpy() for c in ALL])) - mean) / scale
                p = 1 / (1 + np.exp(-np.clip(z @ w[:-1] + w[-1], -30, 30)))
            at = [i for i, c in enumerate(frame.schema.names) if c not in ALL]
            names = [frame.schema.names[i] for i in at]
            yield pa.RecordBatch.from_arrays([*[frame.column(i) for i in at], pa.array(p)], names=[*names, "p_document"])

    fields = [f for f in stats.schema.fields if f.name not in ALL]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    return stats.mapInArrow(task, f"{schema}, p_document double")


def _posterior(groups: DataFrame, parent: str, out: str) -> DataFrame:
    """Beta posterior mean of each group around its parent's rate; the prior's strength by the
    moments of all groups: s = within / between, where the groups' spread beyond chance is the
    between part. No spread beyond chance gives a strong prior."""
    rate = F.col("good") / F.col("n")
    within = F.col(parent) * (1 - F.col(parent))
    spread = groups.agg(
        F.sum(F.col("n") * (rate - F.col(parent)) ** 2).alias("seen"),
        F.sum(within).alias("chance"),
        F.sum(F.col("n") * within).alias("total"),
        F.sum("n").alias("n"),
        F.count(F.lit(1)).alias("groups"),
    ).first()
    strength = 1.0
    if spread["groups"]:
        between = max((spread["seen"] - spread["chance"]) / max(spread["n"], 1), 0.0)
        mean = spread["total"] / max(spread["n"], 1)
        strength = float(np.clip(mean / between if between > 0 else 1e6, 1.0, 1e6))
    return groups.withColumn(out, (F.col("good") + strength * F.col(parent)) / (F.col("n") + strength))


def site_quality(
    df: DataFrame,
    labels: DataFrame,
    levels: Sequence[str] = ("source", "lang"),
    key: str = "doc_id",
    text: str = "text",
    label: str = "quality",
    bound: int = 20_000,
    least: float = 0.5,
) -> DataFrame:
    """One row per document row: `key`, `p_document`, `p_host`, `p_path`, `score`, `kept`.

    `levels` names the host and the path column; each level's groups are counted by grouped
    aggregation, down to (host, path). A null in them is a group of its own. The classifier is
    fitted on at most `bound` labelled rows; rates of groups cover all documents. Null or empty
    texts have zero statistics. Without labels of two classes every document has the share of
    the labels, or 0.5.
    """
    host, path = levels
    sites = df.select(df[key], df[text], F.struct(df[host].cast("string").alias("h"), df[path].cast("string").alias("p")).alias("_site"))
    # The site travels with the document's statistics inside the key.
    packed = sites.select(F.to_json(F.struct(F.col(key).alias("k"), F.col("_site.h").alias("h"), F.col("_site.p").alias("p"))).alias("_packed"), text)
    shape = f"k {df.schema[key].dataType.simpleString()}, h string, p string"
    opened = document_stats(packed, "_packed", text).withColumn("_it", F.from_json("_packed", shape))
    stats = stage(opened.select(F.col("_it.k").alias(key), F.col("_it.h").alias("_host"), F.col("_it.p").alias("_path"), *ALL), "site-stats")
    table, y = labelled_sample(stats.select(key, *ALL), slim(labels, key, label), key, label, bound)
    share = float(y.mean()) if len(y) else 0.5
    model = fit_logistic(features(table), y) if len(y) and 0 < share < 1 else None
    scored = stage(document_scores(stats, model, share), "site-scores")
    good = F.sum("p_document").alias("good")
    paths = stage(scored.groupBy("_host", "_path").agg(good, F.count(F.lit(1)).alias("n")), "paths")
    total = paths.agg(F.sum("good"), F.sum("n")).first()
    rate = float(np.clip(total[0] / total[1], 1e-6, 1 - 1e-6)) if total[1] else share
    hosts = paths.groupBy("_host").agg(F.sum("good").alias("good"), F.sum("n").alias("n")).withColumn("_global", F.lit(rate))
    hosts = stage(_posterior(hosts, "_global", "p_host").select("_host", "p_host"), "hosts")
    placed = paths.join(hosts, paths["_host"].eqNullSafe(hosts["_host"])).drop(hosts["_host"])
    rates = stage(_posterior(placed, "p_host", "p_path").select("_host", "_path", "p_host", "p_path"), "rates")
    own = rates.withColumnsRenamed({"_host": "_h", "_path": "_p"})
    joined = scored.join(own, F.col("_host").eqNullSafe(F.col("_h")) & F.col("_path").eqNullSafe(F.col("_p")))
    odds = lambda p: F.log(F.greatest(F.least(p, F.lit(1 - 1e-9)), F.lit(1e-9)) / (1 - F.greatest(F.least(p, F.lit(1 - 1e-9)), F.lit(1e-9))))
    score = 1 / (1 + F.exp(-(odds(F.col("p_document")) + odds(F.col("p_path")) - odds(F.lit(rate)))))
    return joined.select(key, "p_document", "p_host", "p_path", score.alias("score"), (score >= least).alias("kept"))
