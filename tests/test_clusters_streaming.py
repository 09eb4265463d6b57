from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest

from casewell.operators import clusters as C
from casewell.operators import correspondence as M
from casewell.sources import sinks
from casewell.sources.keyed_log import KeyedLog
from casewell.streaming.incremental import insert_missing_stream, upsert_stream

COLS = ["a", "b", "c"]


def sample(seed=4, n=400):
    random.seed(seed)
    centres = [("x", "p", "1"), ("y", "q", "2"), ("z", "r", None)]
    rows = []
    for _ in range(n):
        base = random.choice(centres)
        rows.append(tuple(random.choice("xyz") if random.random() < 0.15 else v for v in base))
    return rows


def brute_kmodes(rows, k, rounds):
    rows = [tuple(v or "" for v in r) for r in rows]
    counts = Counter(rows)
    modes = [r for r, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:k]]

    def assign():
        return {r: min(range(k), key=lambda j: (sum(u != v for u, v in zip(r, modes[j])), j)) for r in counts}

    for _ in range(rounds):
        where, moved = assign(), []
        for j in range(k):
            mode = []
            for i in range(len(modes[j])):
                levels = Counter()
                for r, n in counts.items():
                    if where[r] == j:
                        levels[r[i]] += n
                mode.append(min(levels, key=lambda v: (-levels[v], v)) if levels else modes[j][i])
            moved.append(tuple(mode))
        if moved == modes:
            break
        modes = moved
    where = assign()
    return [(modes[j], sum(n for r, n in counts.items() if where[r] == j)) for j in range(k)]


@pytest.mark.parametrize("k", [1, 3, 5])
def test_kmodes_equals_brute_force(spark, k):
    rows = sample()
    df = spark.createDataFrame(rows, "a string, b string, c string")
    out = C.kmodes(df, COLS, k, 6).orderBy("cluster").collect()
    assert [((r.a, r.b, r.c), r.n) for r in out] == brute_kmodes(rows, k, 6)
    if k == 3:
        assert all(r.silhouette > 0.4 for r in out)
    full = [tuple(v or "" for v in r) for r in rows]
    place = {r: j for j, own in enumerate(brute_members(rows, k, 6)) for r in own}
    for r in out:
        own = [exact(x, full, place, k) for x in full if place[x] == r.cluster]
        assert (r.exact_silhouette is None) if not own else r.exact_silhouette == pytest.approx(sum(own) / len(own))


def brute_members(rows, k, rounds):
    """Combinations of each cluster by the fitted modes."""
    modes = [mode for mode, _ in brute_kmodes(rows, k, rounds)]
    found = [[] for _ in modes]
    for r in {tuple(v or "" for v in r) for r in rows}:
        found[min(range(len(modes)), key=lambda j: (sum(u != v for u, v in zip(r, modes[j])), j))].append(r)
    return found


def exact(row, rows, place, k):
    """Silhouette of a row from its distances to all rows."""
    apart = [[] for _ in range(k)]
    for other in rows:
        apart[place[other]].append(sum(u != v for u, v in zip(row, other)))
    own = apart.pop(place[row])
    means = [sum(d) / len(d) for d in apart if d]
    if len(own) < 2 or not means:
        return 0
    a, b = sum(own) / (len(own) - 1), min(means)
    return (b - a) / max(a, b) if max(a, b) else 0


def test_kmodes_tells_when_it_has_not_converged(spark):
    df = spark.createDataFrame(sample(5, 300), "a string, b string, c string")
    assert all(r.converged for r in C.kmodes(df, COLS, 3).collect())
    found = [C.fit_modes(C.combinations(df, COLS), COLS, 5, n) for n in (0, 100)]
    assert found[1][1] and (found[0][0] == found[1][0] or not found[0][1])


def decomposed(rows, cols):
    """(levels, inertias, coordinates) of the indicator matrix by a full decomposition."""
    levels = sorted({(c, r[i] or "") for r in rows for i, c in enumerate(cols)})
    place = {level: i for i, level in enumerate(levels)}
    z = np.zeros((len(rows), len(levels)))
    for n, r in enumerate(rows):
        for i, c in enumerate(cols):
            z[n, place[c, r[i] or ""]] = 1
    p = z / z.sum()
    row, col = p.sum(axis=1), p.sum(axis=0)
    s = (p - np.outer(row, col)) / np.sqrt(np.outer(row, col))
    _, values, vectors = np.linalg.svd(s, full_matrices=False)
    return levels, values**2, vectors * values[:, None] / np.sqrt(col)


def many_levels(n=1500):
    rng = random.Random(3)
    rows = []
    for _ in range(n):
        base = rng.choice([0, 0, 0, 7, 7, 14])
        rows.append(tuple(str((base if rng.random() < 0.6 else 0) + rng.randint(0, 12)) for _ in range(3)))
    return rows


@pytest.mark.parametrize("rows", [sample(9), many_levels(), [("x", "p", "1")] * 3 + [("y", "p", "1")]], ids=["few", "many", "one"])
def test_mca_equals_the_decomposed_indicator_matrix(spark, rows):
    df = spark.createDataFrame(rows, "a string, b string, c string")
    found = M.mca(df, COLS, 2).collect()
    levels, inertia, coordinates = decomposed(rows, COLS)
    axes = [i for i in range(2) if inertia[i] > 1e-9]
    assert len(found) == len(axes) * len(levels)
    for r in found:
        want = coordinates[r.axis - 1, levels.index((r.col, r.level))]
        assert abs(r.coordinate) == pytest.approx(abs(want), abs=1e-7)
        assert r.inertia == pytest.approx(inertia[r.axis - 1], abs=1e-10) and r.converged
    for axis in axes:
        own = [r.coordinate for r in found if r.axis == axis + 1]
        assert max(own) >= -min(own) - 1e-8


def test_mca_tells_when_it_has_not_converged(spark):
    df = spark.createDataFrame(many_levels(300), "a string, b string, c string")
    found = M.mca(df, COLS, 1, steps=2).collect()
    assert found and not any(r.converged for r in found)


def test_mca_without_rows_or_differences(spark):
    none = spark.createDataFrame([], "a string, b string")
    same = spark.createDataFrame([("x", None)] * 4, "a string, b string")
    assert M.mca(none, ["a", "b"]).collect() == [] and M.mca(same, ["a", "b"]).collect() == []


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_tables_grow_from_a_stream(spark, tmp_path):
    schema = spark.createDataFrame([], "k int, v string").schema
    source, dim, table = (str(tmp_path / n) for n in ("in", "dim", "table"))

    def feed(*values):
        spark.createDataFrame(values, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        for start, path in ((insert_missing_stream, dim), (upsert_stream, table)):
            start(stream, path, schema, ["k"], f"{path}-checkpoint").awaitTermination()

    feed((1, "a"), (2, "b"))
    feed((2, "z"), (3, "c"), (3, "b"))
    assert rows(sinks.read_current(spark, dim)) == [(1, "a"), (2, "b"), (3, "b")]
    assert rows(sinks.read_current(spark, table)) == [(1, "a"), (2, "z"), (3, "b")]
    feed((1, "again"))
    assert rows(sinks.read_current(spark, dim)) == [(1, "a"), (2, "b"), (3, "b")]
    assert rows(sinks.read_current(spark, table)) == [(1, "again"), (2, "z"), (3, "b")]


def test_a_late_batch_does_not_undo_a_later_row(spark, tmp_path):
    schema = spark.createDataFrame([], "k int, t int, v string").schema
    source, first, last = (str(tmp_path / n) for n in ("in", "first", "last"))
    sinks.write_version(spark.createDataFrame([(9, 1, "old table")], schema), last)

    def feed(*values):
        spark.createDataFrame(values, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        for start, path in ((insert_missing_stream, first), (upsert_stream, last)):
            start(stream, path, schema, ["k"], f"{path}-checkpoint", order=["t"]).awaitTermination()

    feed((1, 5, "b"), (1, 7, "a"), (2, 1, "x"))
    feed((1, 6, "late"), (2, 2, "y"), (3, 1, "z"))
    assert rows(sinks.read_current(spark, first)) == [(1, 5, "b"), (2, 1, "x"), (3, 1, "z")]
    assert rows(sinks.read_current(spark, last)) == [(1, 7, "a"), (2, 2, "y"), (3, 1, "z"), (9, 1, "old table")]
    # The second batch wrote its own rows only.
    sizes = [spark.read.parquet(f"{first}/{r.name}").count() for r in KeyedLog.open(spark, first).runs(spark)]
    assert sizes == [2, 1]
