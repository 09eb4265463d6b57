"""Quality rules: fixed base rules, then gradient-boosted trees over document statistics."""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewell.llm.common import slim
from casewell.llm.document_stats import ALL, FEATURES, document_stats, ratios
from casewell.session import stage

# More symbols, repeats and copied lines never raise the quality.
MONOTONE = {"symbol_rate": -1, "dup_line_rate": -1, "repeat_rate": -1}


@dataclass(frozen=True)
class Trees:
    """All trees as flat node arrays; a leaf points to itself."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probability of the positive class of every row, all trees and rows at once."""
        at = np.repeat(self.roots[None, :], len(x), 0)
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            low = x[rows, self.feature[at]] <= self.threshold[at]
            at = np.where(low, self.left[at], self.right[at])
        return 1 / (1 + np.exp(-(self.base + self.value[at].sum(1))))


def fit_trees(
    x: np.ndarray,
    y: np.ndarray,
    monotone: Mapping[int, int],
    trees: int = 60,
    depth: int = 4,
    rate: float = 0.2,
    bins: int = 64,
    ridge: float = 1.0,
    least: float = 2.0,
) -> Trees:
    """Boosted regression trees on the logistic loss, splits from histograms.

    A split on a feature with a sign is taken only if its two values stand in that order, and
    the middle of the two bounds all leaves below, so the score is monotone in the feature.
    """
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    codes = np.column_stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)])
    share = min(max(float(y.mean()), 1e-3), 1 - 1e-3)
    base = float(np.log(share / (1 - share)))
    margin = np.full(len(y), base)
    feature, threshold, left, right, value, roots = [], [], [], [], [], []

    def node() -> int:
        for array, start in ((feature, 0), (threshold, 0.0), (left, len(left)), (right, len(right)), (value, 0.0)):
            array.append(start)
        return len(value) - 1

    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = p - y, p * (1 - p)
        roots.append(node())
        level = [(roots[-1], np.arange(len(y)), -np.inf, np.inf)]
        for deep in range(depth + 1):
            following = []
            for at, rows, low, high in level:
                g, h = grad[rows].sum(), hess[rows].sum()
                value[at] = rate * float(np.clip(-g / (h + ridge), low, high))
                margin[rows] += 0  # the value is added once the tree is done
                if deep == depth or len(rows) < 2:
                    continue
                best = (1e-6, None)
                for j, cut in enumerate(cuts):
                    if not len(cut):
                        continue
                    gs = np.cumsum(np.bincount(codes[rows, j], grad[rows], len(cut) + 1))[:-1]
                    hs = np.cumsum(np.bincount(codes[rows, j], hess[rows], len(cut) + 1))[:-1]
                    gain = gs**2 / (hs + ridge) + (g - gs) ** 2 / (h - hs + ridge) - g**2 / (h + ridge)
                    small, large = np.clip(-gs / (hs + ridge), low, high), np.clip(-(g - gs) / (h - hs + ridge), low, high)
                    fit = (hs >= least) & (h - hs >= least) & ((large - small) * monotone.get(j, 0) >= 0)
                    gain = np.where(fit, gain, -1)
                    k = int(gain.argmax())
                    if gain[k] > best[0]:
                        best = (float(gain[k]), (j, k, small[k], large[k]))
                if best[1] is None:
                    continue
                j, k, small, large = best[1]
                feature[at], threshold[at] = j, float(cuts[j][k])
                left[at], right[at] = node(), node()
                middle, sign = (small + large) / 2, monotone.get(j, 0)
                goes = codes[rows, j] <= k
                following.append((left[at], rows[goes], low if sign >= 0 else max(low, middle), high if sign <= 0 else min(high, middle)))
                following.append((right[at], rows[~goes], low if sign <= 0 else max(low, middle), high if sign >= 0 else min(high, middle)))
            level = following
        own = Trees(*map(np.asarray, (feature, threshold, left, right, value)), np.asarray(roots[-1:]), depth, 0.0)
        at = np.full(len(y), roots[-1])
        for _ in range(depth):
            at = np.where(x[np.arange(len(y)), own.feature[at]] <= own.threshold[at], own.left[at], own.right[at])
        margin += own.value[at]
    return Trees(*map(np.asarray, (feature, threshold, left, right, value, roots)), depth, base)


def labelled_sample(stats: DataFrame, labels: DataFrame, key: str, label: str, bound: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts and labels of no more than `bound` labelled rows, those with the least hashes of the
    key. Only rows below a hash that leaves about so many are sorted and sent to the driver."""
    known = slim(labels, key, label).filter(F.col(key).isNotNull() & F.col(label).isNotNull())
    known = known.groupBy(key).agg(F.max(label).cast("int").alias("_label"))
    found = stage(stats.join(known, key).select(key, *ALL, "_label", F.xxhash64(key).alias("_place")), "labelled")
    many, share = found.count(), 0.0
    near = found
    while many > bound and share < 1:
        # Repeated keys lie together, so a first guess can leave too few.
        share = max(2 * share, (bound + 6 * bound**0.5) / many)
        near = found if share >= 1 else found.filter(F.col("_place") <= F.lit(int(share * 2**64) - 2**63))
        if share >= 1 or near.count() >= bound:
            break
    rows = near.orderBy("_place", key, *ALL).limit(bound).toPandas()
    return rows[ALL].to_numpy(np.int64).reshape(-1, len(ALL)), rows["_label"].to_numpy(np.float64)


def quality_rules(
    df: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    label: str = "quality",
    bound: int = 20_000,
    least_score: float = 0.5,
) -> DataFrame:
    """One row per document: counts, `base_failed`, `score` of the trees, `kept`.

    The trees are fitted on at most `bound` labelled rows; everything else covers all rows.
    A null or empty text has zero words and fails the base rules. Repeated rows stay repeated.
    With labels of fewer than two classes there is no model: `score` is null and the base
    rules decide alone.
    """
    stats = stage(document_stats(df, key, text), "stats")
    table, y = labelled_sample(stats, labels, key, label, bound)
    trees = None
    if len(set(y.tolist())) > 1:
        trees = fit_trees(ratios(table), y, {FEATURES.index(k): s for k, s in MONOTONE.items()})

    def task(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            if trees is None:
                score = pa.nulls(frame.num_rows, pa.float64())
            else:
                counts = np.column_stack([frame.column(c).to_numpy() for c in ALL])
                score = pa.array(trees.scores(ratios(counts)))
            yield pa.RecordBatch.from_arrays([*frame.columns, score], names=[*frame.schema.names, "score"])

    kind = stats.schema[key].dataType.simpleString()
    scored = stats.mapInArrow(task, f"`{key}` {kind}, " + ", ".join(f"{c} bigint" for c in ALL) + ", score double")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    kept = ~failed & (F.coalesce("score", F.lit(1.0)) >= least_score)
    return scored.select(key, *ALL, failed.alias("base_failed"), "score", kept.alias("kept"))
