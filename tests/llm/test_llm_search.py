"""Ranked lexical search against a plain version."""

from __future__ import annotations

import math
import random
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from casewell.llm import lexical_search as search

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
UPPER = {c: c + 32 for c in range(65, 91)}


def terms(text):
    return TERM.findall((text or "").translate(UPPER))


def plain(docs, items, k):
    own = [(key, terms(text)) for key, text in docs]
    n_docs, n_terms = sum(bool(t) for _, t in own), sum(len(t) for _, t in own)
    wanted = {}
    for item, text in items:
        wanted.setdefault(item, set()).update(terms(text))
    out = []
    for item, names in wanted.items():
        scores = []
        for key, words in own:
            total = 0
            for term in names:
                tf = words.count(term)
                if tf:
                    df = sum(term in set(w) for _, w in own)
                    m = 100 - 50 + (50 * len(words) * n_docs) // n_terms
                    total += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1))) * ((10**9 * tf) // (1000 * tf + 20 * m))
            if total > 0:
                scores.append((key, total))
        scores.sort(key=lambda r: (-r[1], r[0] is None, r[0] or 0))
        out += [(item, i + 1, key, score) for i, (key, score) in enumerate(scores[:k])]
    return sorted(out, key=str)


def odd_tables():
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(40)] + ["Été", "日本", "THE", "the", "x" * 90]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    docs = [(i, " ".join(rng.choices(vocabulary, weights, k=rng.randint(1, 30))) + rng.choice("!.\n")) for i in range(150)]
    docs += [(200 + i, "w1 w2 same text") for i in range(30)] + [(200, "w1 w2 same text"), (None, "w1 w2 same text"), (None, None)]
    docs += [(300, None), (301, ""), (302, "-- ,"), (303, "w3 " * 5000)]
    items = [(1, "w1 w2 W2!"), (2, "THE w5, w6 w7 w39"), (3, None), (4, ""), (5, "unknownword"), (6, "w9"), (6, "日本 été"), (None, "same Text"), (7, " ".join(vocabulary))]
    return docs, items


@pytest.mark.parametrize("k,entries,depth", [(10, 2_000_000, 64), (3, 100, 1), (1000, 100, 4)])
def test_search_equals_plain_version(spark, monkeypatch, k, entries, depth):
    docs, items = odd_tables()
    monkeypatch.setattr(search, "PART_ENTRIES", entries)
    monkeypatch.setattr(search, "_TEXTS", 20)
    monkeypatch.setattr(search.best_positions, "__defaults__", (depth,))
    df = spark.createDataFrame([(key, text, 1, 2) for key, text in docs], "doc_id long, text string, rank int, score int").repartition(4)
    aim = spark.createDataFrame([(key, text, 1) for key, text in items], "item_id long, text string, doc_id int")
    found = search.lexical_search(df, aim, k=k)
    assert [f.dataType.simpleString() for f in found.schema.fields] == ["bigint", "int", "bigint", "bigint"]
    assert sorted((tuple(r) for r in found.collect()), key=str) == plain(docs, items, k)


def test_blocks_of_items_and_text_keys(spark):
    docs, items = odd_tables()
    df = spark.createDataFrame([(None if key is None else f"{key:05}", text) for key, text in docs], "name string, body string")
    aim = spark.createDataFrame([(str(key), text) for key, text in items if key], "q string, t string")
    found = search.lexical_search(df, aim, 10, "name", "body", "q", "t", block_terms=9).collect()
    rows = [(int(r["q"]), r["rank"], None if r["name"] is None else int(r["name"]), r["score"]) for r in found]
    assert sorted(rows, key=str) == plain(docs, [i for i in items if i[0]], 10)


def test_oracle_equals_plain_version():
    docs, items = odd_tables()
    docs = [d for d in docs if d[0] is not None]
    link = duckdb.connect()
    for name, key, rows in (("documents", "doc_id", docs), ("benchmark", "item_id", items)):
        link.register(name, pa.table({key: pa.array([r[0] for r in rows], pa.int64()), "text": pa.array([r[1] for r in rows], pa.string())}))
    assert sorted(link.sql(search.ORACLE).fetchall(), key=str) == plain(docs, items, 50)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert search.lexical_search(none, items).collect() == []
    assert search.lexical_search(docs, items.limit(0)).collect() == []
    assert [tuple(r) for r in search.lexical_search(docs, items).collect()] == plain([(1, "a b")], [(1, "a b")], 50)


def test_reading_stops_early_and_is_exact():
    rng = np.random.default_rng(5)
    rows, n_terms, k = 5000, 12, 10
    held = rng.random((n_terms, rows)) < rng.uniform(0.05, 0.9, (n_terms, 1))
    term, row = np.nonzero(held)
    impact = rng.zipf(1.3, len(row)).clip(1, 10**6)
    part = search.Part(row, term, impact, rows)
    scores = np.bincount(row, impact, rows).astype(np.int64)
    want = sorted(range(rows), key=lambda r: (-scores[r], r))[:k]
    at, found, read = search.best_positions(part, np.arange(n_terms), k, np.zeros(0, np.int64))
    best = sorted(zip(at.tolist(), found.tolist()), key=lambda r: (-r[1], r[0]))[:k]
    assert best == [(r, scores[r]) for r in want] and read < held.sum(axis=1).max()
    # Scores found elsewhere stop it sooner, and rows below them are not returned.
    at, found, sooner = search.best_positions(part, np.arange(n_terms), k, np.full(k, scores[want[0]] + 1))
    assert not len(at) and sooner <= read


def test_reading_goes_on_at_equal_scores():
    """Row 0 has the score of all others, so a stop at the threshold itself would lose it."""
    row = np.concatenate([np.arange(1, 300), [0]])
    part = search.Part(row, np.zeros(300, np.int64), np.full(300, 7), 300)
    part.by_impact = np.argsort(np.where(part.row == 0, 300, part.row))
    part.position[part.by_impact] = np.arange(300)
    at, scores, _ = search.best_positions(part, np.asarray([0]), 1, np.zeros(0, np.int64), 1)
    assert 0 in at.tolist() and set(scores.tolist()) == {7}


def test_long_documents_do_not_overflow():
    weights, times, lengths = np.asarray([5]), np.asarray([3]), np.asarray([10**9])
    found = search.impacts(weights, times, lengths, 10**11, 10**13)
    m = 50 + 50 * 10**9 * 10**11 // 10**13
    assert found.tolist() == [5 * (3 * 10**9 // (3000 + 20 * m))]
