"""Target-distribution importance resampling with exact ranks by regular sampling.

A document's features are its runs of one to three words, hashed into buckets by CRC-32. A bucket
gains what the logarithm of its smoothed share in the target exceeds that in all documents; the
sum over a document's features, plus Gumbel noise from its key, is its score, and the highest
scores are a sample without replacement by weight.

Scores are ranked by parallel sorting by regular sampling: every task sorts its rows (a run),
each step-th row of every run is a sample, evenly spaced samples split the order into segments,
each segment is exchanged to one task and merged there, and the number of rows in earlier segments
makes local ranks global ones. Segments behind the last drawn rank are neither exchanged nor sorted.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from casewell.llm.common import TERM, runs, slim, words
from casewell.session import stage

BUCKETS = 10_000
# More splitters would not help: a segment is merged by a sort that spills.
MOST_SEGMENTS = 4096
SAMPLES = 16
_POSITION_BITS = 33
_SHORT = 64


def _byte_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1).astype(np.uint32)
    return table


_CRC = _byte_table()


def _shift_tables() -> np.ndarray:
    """[n, k, b]: what n further bytes make of byte k of a CRC, for n up to `_SHORT`."""
    now = (np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]).astype(np.uint32)
    out = [now]
    for _ in range(_SHORT):
        now = _CRC[now & 255] ^ (now >> 8)
        out.append(now)
    return np.stack(out)


_SHIFT = _shift_tables()


def shifted(crc: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """CRCs moved on by as many bytes as `sizes` says: crc(a + b) = shifted(crc(a), len(b)) ^ crc(b)."""
    out, left = crc, sizes
    while True:
        now = np.minimum(left, _SHORT)
        out = (
            _SHIFT[now, 0, out & 255] ^ _SHIFT[now, 1, (out >> 8) & 255]
            ^ _SHIFT[now, 2, (out >> 16) & 255] ^ _SHIFT[now, 3, out >> 24]
        )
        left = left - now
        if not left.any():
            return out


def word_crcs(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(CRC-32, bytes) of the words that begin at `starts`; a word ends before a blank."""
    if not len(starts):
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    ends = np.append(starts[1:], len(data))
    # A text that ends in a word is followed by the next one's without a blank.
    full = np.concatenate([[0], np.cumsum(data != 32)])
    sizes = full[ends] - full[starts]
    order = np.argsort(-np.minimum(sizes, _SHORT + 1), kind="stable")
    long = int(np.count_nonzero(sizes > _SHORT))
    at, n = starts[order], sizes[order]
    crc = np.full(len(at), 0xFFFFFFFF, np.uint32)
    active = np.searchsorted(-n[long:], -np.arange(1, _SHORT + 1), "right") + long
    for j in range(int(n[long]) if long < len(n) else 0):
        own = slice(long, int(active[j]))
        crc[own] = _CRC[(crc[own] ^ data[at[own] + j]) & 255] ^ (crc[own] >> 8)
    crc ^= np.uint32(0xFFFFFFFF)
    for i in range(long):
        crc[i] = zlib.crc32(data[at[i] : at[i] + n[i]])
    out = np.empty_like(crc)
    out[order] = crc
    return out, sizes


def buckets(data: np.ndarray, bounds: np.ndarray, many: int = BUCKETS) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """(words of each text, [(bucket of each run of 1, 2, 3 words, index of each text's first run)])."""
    data = TERM[data]
    _, first, starts = words(data, bounds)
    crc, sizes = word_crcs(data, starts)
    spaced = shifted(np.full(len(crc), zlib.crc32(b" "), np.uint32), sizes) ^ crc
    counts = np.diff(first)
    out = [((crc % np.uint32(many)).astype(np.int64), first)]
    run, begin = crc, np.arange(len(crc))
    word_left = np.repeat(first[1:], counts) - begin  # words to the end of the text, itself included
    for width in (2, 3):
        keep = word_left[begin] >= width
        begin, run = begin[keep], run[keep]
        last = begin + width - 1
        run = shifted(run, sizes[last] + 1) ^ spaced[last]
        own = np.concatenate([[0], np.cumsum(np.maximum(counts - width + 1, 0))])
        out.append(((run % np.uint32(many)).astype(np.int64), own))
    return counts, out


def bucket_counts(df: DataFrame, text: str = "text", many: int = BUCKETS) -> np.ndarray:
    """Features of all texts per bucket; only these `many` numbers reach the driver."""

    def task(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(many, np.int64)
        for frame in frames:
            for _, _, data, bounds in runs(frame.column(0)):
                for found, _ in buckets(data, bounds, many)[1]:
                    total += np.bincount(found, minlength=many)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    parts = slim(df, text).mapInArrow(task, "bucket bigint, n bigint")
    out = np.zeros(many, np.int64)
    for row in parts.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[row["bucket"]] = row["n"]
    return out


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln((t+1)(S+B) / ((s+1)(T+B)))) of each of the B buckets."""
    many, s_all, t_all = len(source), int(source.sum()), int(target.sum())
    return np.asarray(
        [math.floor(1000 * math.log((t + 1) * (s_all + many) / ((s + 1) * (t_all + many)))) for s, t in zip(source.tolist(), target.tolist(), strict=True)],
        np.int64,
    )


def noise(key: str | None, seed: int) -> int:
    """Gumbel noise of a key in thousandths; a null key counts as an empty one."""
    h = int(hashlib.sha256(f"{seed}:{key or ''}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(df: DataFrame, gains: np.ndarray, key: str = "doc_id", text: str = "text", seed: int = 42) -> DataFrame:
    """key, n_words, n_features, weight and score of every row."""

    def task(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            for start, end, data, bounds in runs(frame.column(2)):
                counts, found = buckets(data, bounds, len(gains))
                weight = np.zeros(len(counts), np.int64)
                for at, first in found:
                    total = np.concatenate([[0], np.cumsum(gains[at])])
                    weight += total[first[1:]] - total[first[:-1]]
                features = sum(np.maximum(counts - k, 0) for k in range(3))
                names = frame.column(1).slice(start, end - start).to_pylist()
                score = weight + np.asarray([noise(n, seed) for n in names], np.int64)
                yield pa.RecordBatch.from_arrays(
                    [frame.column(0).slice(start, end - start), *map(pa.array, (counts, features, weight, score))],
                    names=[key, "n_words", "n_features", "weight", "score"],
                )

    kind = df.schema[key].dataType.simpleString()
    rows = df.select(df[key].alias(key), df[key].cast("string").alias("name"), df[text].alias("text"))
    return rows.mapInArrow(task, f"`{key}` {kind}, n_words bigint, n_features bigint, weight bigint, score bigint")


def _place(score: int, key, run: int, pos: int) -> tuple:
    """A row's place in the order: higher score, smaller key, rows without a key last; run and
    position tell equal rows apart, so no group of them is too large for a segment."""
    return (-score, key is None, key if key is not None else 0, run, pos)


def ranked(rows: DataFrame, draw: int, key: str = "doc_id", segments: int | None = None) -> DataFrame:
    """`rows` (staged runs with `run`, `pos` and `fit`) with the exact `rank` of the first `draw` fit rows.

    At most `SAMPLES` samples a segment and one more a run reach the driver.
    """
    spark = rows.sparkSession
    fit = rows.filter("fit")
    total = fit.count()
    # So many that the drawn rows alone come to as many segments as a shuffle has partitions.
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    segments = segments or min(MOST_SEGMENTS, max(1, -(-tasks * total // max(draw, 1))))
    step = max(1, total // (SAMPLES * segments))
    sample = sorted(_place(*r) for r in fit.filter(F.col("pos") % step == 0).select("score", key, "run", "pos").collect())
    splitters = sorted({sample[i * len(sample) // segments] for i in range(1, segments)}) if sample else []

    def task(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            columns = [frame.column(frame.schema.get_field_index(c)).to_pylist() for c in ("score", key, "run", "pos", "fit")]
            own = [bisect_right(splitters, _place(*r[:4])) if r[4] else None for r in zip(*columns, strict=True)]
            yield pa.RecordBatch.from_arrays([*frame.columns, pa.array(own, pa.int32())], names=[*frame.schema.names, "segment"])

    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    dealt = rows.mapInArrow(task, f"{shape}, segment int")
    sizes = {r["segment"]: r["n"] for r in dealt.filter("fit").groupBy("segment").agg(F.count(F.lit(1)).alias("n")).collect()}
    before, offsets = 0, []
    for i in range(len(splitters) + 1):
        offsets.append(before)
        before += sizes.get(i, 0)
    last = max([i for i, n in enumerate(offsets) if n < draw], default=-1)
    place = [F.desc("score"), F.asc_nulls_last(key), F.asc("run"), F.asc("pos")]
    # One segment a task; a segment's rows in earlier ones are known by now.
    merged = dealt.filter(F.col("segment") <= last).repartitionById(max(1, last + 1), F.col("segment"))
    number = F.row_number().over(Window.partitionBy("segment").orderBy(*place))
    starts = F.array(*[F.lit(n).cast("bigint") for n in offsets[: last + 1]]) if last >= 0 else F.array(F.lit(0).cast("bigint"))
    rank = number + F.get(starts, F.col("segment"))
    first = merged.withColumn("rank", rank).withColumn("rank", F.when(F.col("rank") <= draw, F.col("rank")))
    rest = dealt.filter(F.col("segment").isNull() | (F.col("segment") > last)).withColumn("rank", F.lit(None).cast("bigint"))
    return first.unionByName(rest).drop("segment")


def importance_sample(
    df: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, key: str = "doc_id", text: str = "text", seed: int = 42
) -> DataFrame:
    """key, n_features, weight, score, rank of every row of `df`; `percent` of the rows with at
    least `least_words` words are drawn (rounded down) and have a rank, the others a null one.

    Rows with a null or empty text have no features and weight 0. Repeated rows count and are
    ranked each on its own; of equal scores and keys any comes first, as they are the same. A row
    without a key has the noise of an empty key and comes behind rows of equal score. An empty
    `df` gives no rows; with an empty target every bucket's gain comes from the documents alone.
    """
    gains = bucket_gains(bucket_counts(df, text), bucket_counts(target, text))
    rows = scored(df, gains, key, text, seed).withColumn("fit", F.col("n_words") >= least_words)
    order = rows.sortWithinPartitions(F.desc("fit"), F.desc("score"), F.asc_nulls_last(key)).withColumn("seq", F.monotonically_increasing_id())
    placed = order.select(
        key, "n_features", "weight", "score", "fit",
        F.shiftright("seq", _POSITION_BITS).alias("run"),
        F.col("seq").bitwiseAND((1 << _POSITION_BITS) - 1).alias("pos"),
    )
    # Staged, since run and position must be the same for samples, counts and ranks.
    staged = stage(placed, "runs")
    draw = percent * staged.filter("fit").count() // 100
    return ranked(staged, draw, key).select(key, "n_features", "weight", "score", "rank")
