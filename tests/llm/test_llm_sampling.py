"""Importance resampling against a plain version."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from casewell.llm import importance_sampling as sampling
from casewell.llm.common import TERM, words
from casewell.session import stage

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
UPPER = {c: c + 32 for c in range(65, 91)}


def features(text):
    own = WORD.findall((text or "").translate(UPPER))
    return len(own), [" ".join(own[i : i + k]) for k in (1, 2, 3) for i in range(len(own) - k + 1)]


def plain(docs, target, percent=5, least=20):
    """(key, n_features, weight, score, rank) of each document, as the contract says."""
    many = 10_000
    found = [(k, *features(t)) for k, t in docs]
    source, aim = [0] * many, [0] * many
    for _, _, names in found:
        for f in names:
            source[zlib.crc32(f.encode()) % many] += 1
    for t in target:
        for f in features(t)[1]:
            aim[zlib.crc32(f.encode()) % many] += 1
    s_all, t_all = sum(source), sum(aim)
    gain = [math.floor(1000 * math.log((t + 1) * (s_all + many) / ((s + 1) * (t_all + many)))) for s, t in zip(source, aim)]
    rows = []
    for k, n, names in found:
        h = int(hashlib.sha256(f"42:{'' if k is None else k}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[zlib.crc32(f.encode()) % many] for f in names)
        rows.append([k, n, len(names), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    fit = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    rank = {id(r): i + 1 for i, r in enumerate(fit[: percent * len(fit) // 100])}
    return [(r[0], r[2], r[3], r[4], rank.get(id(r))) for r in rows]


def odd_rows():
    rng = random.Random(3)
    vocabulary = ["Haus", "été", "x1", "日本", "AND", "and", "a" * 70, "b" * 200, "42", "ß"]
    docs = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(0, 60))) + rng.choice(["", "!", "\n", "…"])) for i in range(120)]
    docs += [(120, None), (121, ""), (122, ".,;"), (None, "and " * 30), (None, None), (123, "same text " * 15), (123, "same text " * 15)]
    docs += [(124, "w" * 100_000 + " end"), (125, "\x00and\x7fand`and{and")]
    return docs


def as_rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("percent", [5, 37, 100])
def test_sample_equals_plain_version(spark, percent):
    docs, target = odd_rows(), ["Haus and été 42", None, "日本 x1 AND"]
    df = spark.createDataFrame([(k, t, 7, 1) for k, t in docs], "doc_id long, text string, rank int, run int").repartition(5)
    aim = spark.createDataFrame([(t,) for t in target], "text string")
    found = sampling.importance_sample(df, aim, percent=percent)
    assert found.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert as_rows(found) == sorted(plain(docs, target, percent), key=str)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "one two three " * 10)], "doc_id long, text string")
    assert sampling.importance_sample(none, some).collect() == []
    assert as_rows(sampling.importance_sample(some, none, percent=100)) == plain([(1, "one two three " * 10)], [], 100)


def test_keys_of_another_kind(spark):
    docs = [(f"k{i % 7}", "some words in a row " * (4 + i)) for i in range(20)]
    df = spark.createDataFrame(docs, "doc_id string, text string").repartition(3)
    found = sampling.importance_sample(df, df.limit(0), percent=50)
    assert sorted(r["rank"] for r in found.collect() if r["rank"]) == list(range(1, 11))


def test_segments_split_equal_rows(spark):
    """A third and more of the rows share score and key; ranks stay exact and every segment small."""
    rows = spark.range(9000).select(
        F.when(F.col("id") < 6000, 5).otherwise(F.col("id")).alias("doc_id"), F.lit(1).alias("score"), F.lit(True).alias("fit")
    )
    runs = rows.repartition(6).sortWithinPartitions("doc_id").withColumn("seq", F.monotonically_increasing_id())
    runs = stage(runs.select("doc_id", "score", "fit", F.shiftright("seq", 33).alias("run"), F.expr("seq & 8589934591").alias("pos")), "t")
    found = sampling.ranked(runs, 8000, segments=12)
    out = found.select("doc_id", "rank", F.spark_partition_id().alias("task")).collect()
    numbered = sorted((r["rank"], r["doc_id"]) for r in out if r["rank"] is not None)
    assert [n for n, _ in numbered] == list(range(1, 8001)) and [k for _, k in numbered] == [5] * 6000 + list(range(6000, 8000))
    tasks = np.unique([r["task"] for r in out if r["rank"] is not None], return_counts=True)[1]
    assert tasks.max() < 2 * 9000 / 12


def test_word_crcs_equal_zlib():
    texts = [b"a", b"", b"abc  de " + b"q" * 64 + b" " + b"r" * 65 + b" " + b"s" * 999, b"no", b"end"]
    data = TERM[np.frombuffer(b"".join(texts), np.uint8)]
    bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    _, first, starts = words(data, bounds)
    crc, sizes = sampling.word_crcs(data, starts)
    own = [w for t in texts for w in t.split()]
    assert crc.tolist() == [zlib.crc32(w) for w in own] and sizes.tolist() == [len(w) for w in own] and first[-1] == len(own)
