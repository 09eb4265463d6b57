"""Document operators against brute force on small tables, and odd rows."""

from __future__ import annotations

import re
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from oracle import compare, connect
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from casewell.llm import decontaminate as dc
from casewell.llm import language_id as li
from casewell.llm import line_dedup as ld
from casewell.llm import minhash as mh
from casewell.llm import quality_rules as qr
from casewell.llm import site_bayes as sb
from casewell.llm import url_filter as uf
from casewell.llm.components import components
from casewell.llm.document_stats import ALL, COUNTS, FEATURES, document_stats, ratios

FOLDER = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, a string"
ODD = [
    (None, "some words without a key", "en", None, 1, 1, "x"),
    (1, None, "en", "s", None, 1, "x"),
    (2, "", None, "s", 0, 1, None),
    (3, " \n\t\r\n ", "en", "s", 4, 1, "x"),
    (4, "one", "en", "s", 3, 1, "x"),
    (4, "one", "en", "s", 3, 1, "x"),
    (5, "A B c d\te f A B c\x0bD e\nA B c\n\nA B c\n#*$%&|<> é日", "fr", "s", 9, 2, "y"),
    (6, "word " * 4000 + "\n" + "line of text\n" * 300, "en", "t", 5, 1, "z"),
    (7, "x" * 30_000, "de", "t", 5, 1, "z"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def counts_of(text):
    words = WORD.findall(text or "")
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        dup += bool(WORD.search(line)) and line in seen
        seen.add(line)
    grams = Counter(zip(words, words[1:], words[2:], strict=False))
    covered = {i + k for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered)


def test_counts_equal_plain_ones(spark, odd, documents):
    for df in (odd, documents):
        expected = Counter((r["doc_id"], *counts_of(r["text"])) for r in df.collect())
        assert Counter(tuple(r) for r in document_stats(df).select("doc_id", *COUNTS).collect()) == expected


def test_trees_are_monotone_and_learn():
    draw = np.random.default_rng(0)
    x = draw.random((3000, len(FEATURES)))
    y = (x[:, 2] + 0.3 * x[:, 5] + 0.1 * draw.random(3000) < 0.7).astype(float)
    trees = qr.fit_trees(x, y, {2: -1})
    assert ((trees.scores(x) > 0.5) == y).mean() > 0.95
    base = draw.random((50, len(FEATURES)))
    last = None
    for value in np.linspace(0, 1, 40):
        base[:, 2] = value
        now = trees.scores(base)
        assert last is None or (now <= last + 1e-12).all()
        last = now


def test_trees_one_by_one():
    draw = np.random.default_rng(1)
    x = draw.random((400, 3))
    t = qr.fit_trees(x, (x[:, 0] > x[:, 1]).astype(float), {}, trees=5)
    for row, score in zip(x[:50], t.scores(x[:50]), strict=True):
        total = t.base
        for at in t.roots.tolist():
            while t.left[at] != at:
                at = t.left[at] if row[t.feature[at]] <= t.threshold[at] else t.right[at]
            total += t.value[at]
        assert score == pytest.approx(1 / (1 + np.exp(-total)))


def test_quality_rules(spark, odd, nothing):
    labels = spark.createDataFrame([(4, 1), (5, 0), (None, 1), (6, None)], "doc_id long, quality int")
    rows = qr.quality_rules(odd, labels).collect()
    assert len(rows) == len(ODD)
    for r in rows:
        failed = r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]
        assert r["base_failed"] == failed and not (failed and r["kept"])
    assert qr.quality_rules(nothing, labels).count() == 0
    assert all(r["score"] is None for r in qr.quality_rules(odd, labels.limit(0)).collect())
    quality = entry.queries()["op1_quality_rules"](spark, FOLDER)
    known = quality.join(spark.read.parquet(f"{FOLDER}/labels.parquet"), "doc_id").filter("NOT base_failed").collect()
    assert np.mean([r["kept"] == (r["quality"] == 1) for r in known]) > 0.95


def test_language_id(spark, documents, odd, nothing):
    rows = entry.queries()["op2_language_id"](spark, FOLDER).join(documents.select("doc_id", "lang"), "doc_id").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in rows if r["held_out"]]) > 0.9
    found = {r["doc_id"]: r for r in li.language_id(odd.unionByName(documents.selectExpr("doc_id + 100 doc_id", "text", "lang", "source", "n_chars", "1L id", "'q' a"))).collect()}
    assert [found[i]["lang_pred"] for i in (1, 2, 3)] == ["und"] * 3 and found[1]["score"] == 0
    assert found[None]["held_out"] is False and found[None]["lang_pred"] in {"en", "fr", "de", "es"}
    assert li.language_id(nothing).count() == 0
    assert {r["lang_pred"] for r in li.language_id(odd.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


@pytest.mark.parametrize("classes", [2, 3, 4, 5, 6, 12, 40])
def test_code_words_are_apart(classes):
    book = li.code_book(classes)
    assert len({tuple(r) for r in book}) == classes
    least = min(int((a != b).sum()) for a, b in combinations(book, 2))
    assert least >= (1 if classes == 2 else 2 if classes == 3 else 4)


def shingles(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())


def linked(rows, percent):
    sets = {k: shingles(t) for k, t in rows}
    parent = {k: k for k in sets}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a, b in combinations(sorted(sets), 2):
        common = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    return {k: (len(sets[k]), root(k)) for k in sets}


def test_near_duplicates_equal_all_pairs(spark, documents):
    draw = np.random.default_rng(5)
    words = [f"w{i}" for i in range(3000)]
    rows = []
    for group in range(12):
        base = list(draw.choice(words, 120))
        for _ in range(12):
            copy = list(base)
            for at in draw.integers(0, 120, draw.integers(0, 7)):
                copy[at] = str(draw.choice(words))
            rows.append((len(rows) * 3 + group % 2, " ".join(copy).upper() if len(rows) % 5 == 0 else " ".join(copy)))
    rows += [(10_000, "same few words"), (9_000, "Same FEW words"), (9_500, "same few"), (9_600, None), (9_700, "")]
    for data in (rows, [(r["doc_id"], r["text"]) for r in documents.collect()]):
        df = spark.createDataFrame(data, "doc_id long, text string")
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in mh.near_duplicates(df).collect()}
        assert got == linked(data, 85)


def test_blocks_of_a_bucket_equal_one_block(spark, monkeypatch):
    draw = np.random.default_rng(6)
    base = [f"v{i}" for i in range(150)]
    rows = []
    for i in range(70):
        copy = list(base)
        for at in draw.integers(0, 150, draw.integers(0, 9)):
            copy[at] = f"u{draw.integers(0, 99)}"
        rows.append((i, " ".join(copy)))
    monkeypatch.setattr(mh, "BLOCK", 7)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in mh.near_duplicates(df).collect()}
    assert got == linked(rows, 85)


def test_near_duplicates_of_odd_rows(odd, nothing):
    rows = mh.near_duplicates(odd).collect()
    assert len(rows) == len(ODD) and mh.near_duplicates(nothing).count() == 0
    assert all(r["kept"] and r["component_id"] == r["doc_id"] for r in rows)


def test_a_key_in_several_classes_joins_them(spark):
    text = lambda c: " ".join(f"{c}{i}" for i in range(30))
    rows = [(3, text("a")), (5, text("a")), (5, text("b")), (7, text("b")), (8, text("c")), (8, text("d")), (8, text("d")), (9, text("e"))]
    rows += [(None, text("e")), (10, None), (10, None), (10, text("f"))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r["doc_id"], r["component_id"], r["kept"]) for r in mh.near_duplicates(df).collect()}
    assert got == {(3, 3, True), (5, 3, False), (7, 3, False), (8, 8, True), (9, 9, True), (None, None, True), (10, 10, True)}
    left = Counter(map(tuple, corpus_pipeline.near_copies(spark, df, FOLDER).collect()))
    stay = [(3, text("a")), (8, text("c")), (8, text("d")), (9, text("e")), (None, text("e")), (10, None), (10, text("f"))]
    assert left == Counter(stay)


@pytest.mark.parametrize("percent", [50, 70, 80, 85, 90, 100])
def test_bands_follow_the_threshold(percent):
    rows = mh.band_rows(percent)
    assert (1 - (percent / 100) ** rows) ** mh.band_keys(np.zeros((1, mh.MINIMA), np.uint32), rows).shape[1] < 1e-6
    assert rows == {80: 5, 85: 6}.get(percent, rows)


def test_near_duplicates_equal_all_pairs_at_80(spark):
    draw = np.random.default_rng(15)
    rows = []
    for group in range(8):
        base = [f"g{group}w{i}" for i in range(120)]
        for _ in range(10):
            copy = list(base)
            for at in draw.integers(0, 120, draw.integers(0, 5)):
                copy[at] = f"u{draw.integers(0, 999)}"
            rows.append((len(rows), " ".join(copy)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in mh.near_duplicates(df, percent=80).collect()}
    assert got == linked(rows, 80)


def test_estimate_is_corrected_for_chance():
    draw = np.random.default_rng(2)
    a = draw.integers(0, 1 << 63, 900, dtype=np.uint64)
    b = np.concatenate([a[:800], draw.integers(0, 1 << 63, 100, dtype=np.uint64)])
    x, y = (mh.packed_bits(mh.minima(s))[0] for s in (a, b))
    groups = sum(((int(p) ^ int(q)) >> (4 * k)) & 15 != 0 for p, q in zip(x, y, strict=True) for k in range(16))
    assert abs(mh.estimate(groups) - 0.8) < 0.12 and mh.estimate(0) == 1


def test_components_of_chains(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (102, 101), (7, 7)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100}


def dedup(rows, least):
    """Later copies of runs, by dictionary."""
    first, out = {}, {}
    for key, text in sorted((k, t) for k, t in rows if k is not None and t is not None):
        lines = text.split("\n")
        gone = set()
        for i in range(len(lines)):
            total, j = 0, i
            while j < len(lines) and total < least:
                total += len(WORD.findall(lines[j]))
                j += 1
            if total >= least and first.setdefault(tuple(lines[i:j]), (key, i)) != (key, i):
                gone.update(range(i, j))
        out[key] = (len(gone), "\n".join(x for i, x in enumerate(lines) if i not in gone))
    return out


def test_line_dedup_equals_plain_one(spark):
    draw = np.random.default_rng(8)
    lines = ["", "a", "b b", "c c c", "d d d d", "e e e e e", "  ", "f\tf"]
    rows = [(int(k), "\n".join(draw.choice(lines, draw.integers(0, 25)))) for k in range(60)]
    rows += [(100, "\n".join(["a"] * 40)), (101, "\n".join(["a"] * 40)), (102, None), (103, "")]
    df = spark.createDataFrame([(*r, "e") for r in rows], "doc_id long, text string, runs string")
    got = {r["doc_id"]: (r["n_deleted"], r["text"]) for r in ld.line_dedup(df, min_words=6).collect()}
    assert got == {**dedup(rows, 6), 102: (0, None)}


def maximal_dedup(rows, least):
    """Lines of all runs of `least` words, however long, that stand earlier as well."""
    first, out = {}, {}
    for key, text in sorted((k, t) for k, t in rows if k is not None and t is not None):
        lines, gone = text.split("\n"), set()
        for i, j in combinations(range(len(lines) + 1), 2):
            if len(WORD.findall("\n".join(lines[i:j]))) >= least and first.setdefault(tuple(lines[i:j]), (key, i)) != (key, i):
                gone.update(range(i, j))
        out[key] = (len(gone), "\n".join(x for i, x in enumerate(lines) if i not in gone))
    return out


def test_maximal_line_dedup_equals_all_runs(spark):
    draw = np.random.default_rng(18)
    lines = ["", "a", "b b", "c c c", "d d d d", "e e e e e", "  ", "f\tf"]
    rows = [(int(k), "\n".join(draw.choice(lines, draw.integers(0, 25)))) for k in range(40)]
    rows += [(100, "\n".join(["a"] * 40)), (101, "\n".join(["a"] * 40)), (102, "g g g g g g\n" + "\n" * 20 + "h"), (103, "")]
    rows += [(104, "g g g g g g\n" + "\n" * 20 + "i"), (105, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_deleted"], r["text"]) for r in ld.line_dedup(df, min_words=6, maximal=True).collect()}
    assert got == {**maximal_dedup(rows, 6), 105: (0, None)}


@pytest.mark.parametrize("sizes", [(60, 10), (30, 30, 5), (10, 60, 10)])
def test_last_lines_of_a_repeated_run_go(spark, sizes):
    run = "\n".join(" ".join(f"w{i}" for _ in range(n)) for i, n in enumerate(sizes))
    rows = [(k, f"before {k}\n{run}\nafter {k}") for k in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in ld.line_dedup(df, maximal=True).collect()}
    assert got == {0: rows[0][1], 1: "before 1\nafter 1", 2: "before 2\nafter 2"}
    kept = {r["doc_id"]: r["text"] for r in corpus_pipeline.repeated_lines(spark, df, FOLDER).collect()}
    assert kept == got


def test_maximal_query_equals_sql(spark):
    name = "op9_maximal_line_dedup"
    assert compare(entry.queries()[name](spark, FOLDER), connect(FOLDER), entry.oracle_sql()[name]) is None


def test_line_dedup_of_odd_rows(odd, nothing):
    rows = ld.drop_repeated_lines(odd).collect()
    assert len(rows) == len(ODD) and ld.line_dedup(nothing).count() == 0
    assert [r["text"] for r in rows if r["doc_id"] == 4] == ["one", "one"]
    repeated = next(r for r in rows if r["doc_id"] == 6)
    assert repeated["text"].count("line of text") < 300 and repeated["a"] == "z"


def test_decontamination_finds_copies_at_any_place(spark, odd, nothing):
    draw = np.random.default_rng(4)
    words = [f"t{i}" for i in range(500)]
    items = [(i, " ".join(draw.choice(words, n))) for i, n in enumerate([8, 14, 23, 31, 40, 59, 300])]
    rows, expected = [], {}
    for i, text in items:
        for shift in range(6):
            rows.append((len(rows), " ".join(draw.choice(words, shift)) + "\n" + text.upper() + " " + " ".join(draw.choice(words, 9))))
            expected[rows[-1][0]] = [i]
    for _ in range(40):
        rows.append((len(rows), " ".join(draw.choice(words, 80))))
        expected[rows[-1][0]] = []
    changed = items[5][1].split()
    changed[0] = changed[58] = "other"
    rows.append((len(rows), "before it " + " ".join(changed) + " and after"))
    expected[rows[-1][0]] = [5]
    benchmark = spark.createDataFrame([*items, (90, None), (91, ""), (None, "t1 t2")], "item_id long, text string")
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for part in (5000, 3):
        found = dc.contaminated(df, benchmark, part=part).collect()
        assert {r["doc_id"]: [m["item"] for m in r["matches"]] for r in found} == expected
    assert all(r["kept"] for r in dc.decontaminate(odd, benchmark).collect())
    assert dc.decontaminate(nothing, benchmark).count() == 0
    assert all(r["kept"] for r in dc.decontaminate(df, benchmark.limit(0)).collect())


def most_alike(text, item, width=5):
    """Weighted Jaccard similarity of the stretch of `text` most like the item, over all of them."""
    if len(item) < width:
        return float(any(Counter(text[i : i + len(item)]) == Counter(item) for i in range(len(text) - len(item) + 1)))
    cut = lambda x: [tuple(x[i : i + width]) for i in range(len(x) - width + 1)]
    own, grams, best = Counter(cut(item)), cut(text), 0.0
    for i in range(len(grams)):
        stretch, common = Counter(), 0
        for j in range(i, len(grams)):
            stretch[grams[j]] += 1
            common += stretch[grams[j]] <= own[grams[j]]
            best = max(best, common / (own.total() + j - i + 1 - common))
    return best


def copies_of(draw, item, vocabulary):
    """Copies cut at either end, with a changed phrase, head or tail, and with words put in or left out."""
    n = len(item)
    other = lambda k: list(draw.choice(vocabulary, k))
    for lost in range(1, n // 4 + 1):
        yield item[lost:] + other(draw.integers(0, 2) * 9)
        yield other(draw.integers(0, 2) * 9) + item[:-lost]
        at = int(draw.integers(0, n - lost + 1))
        for put in (lost, 0, lost + 1):
            yield other(draw.integers(0, 9)) + item[:at] + other(put) + item[at + lost :] + other(draw.integers(0, 9))
        yield other(5) + item[:-lost] + other(lost + 5)
        yield other(5) + other(lost) + item[lost:] + other(5)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 6, 7, 15, 38, 51, 59, 100])
def test_decontamination_equals_search_of_all_stretches(n):
    draw = np.random.default_rng(n)
    vocabulary = [f"t{i}" for i in range(400)]
    items = [list(draw.choice(vocabulary, n)) for _ in range(2)]
    items.append((items[0][: n // 2] * 2 + items[1])[:n])
    texts = [t for item in items for t in copies_of(draw, item, vocabulary)]
    texts += [list(draw.choice(vocabulary, 40)) + item + list(draw.choice(vocabulary, shift)) for item in items for shift in range(5)]
    expected = {
        (i, k): best for i, text in enumerate(texts) for k, item in enumerate(items) if (best := most_alike(text, item)) >= 0.8
    }
    index = dc.build_index([0, 1, 2], dc._item_words([" ".join(i) for i in items]), 5)
    hashes = dc._item_words([" ".join(t) for t in texts])
    first = np.cumsum([0, *map(len, hashes)])
    got = {(t, i): alike for t, i, _, alike in dc.matches(np.concatenate(hashes), first, index, 0.8, 5)}
    assert got == pytest.approx(expected) and len(got) >= len(items) * 5


def test_long_items_with_a_changed_phrase_are_found():
    draw = np.random.default_rng(200)
    vocabulary = [f"t{i}" for i in range(5000)]
    item = list(draw.choice(vocabulary, 200))
    texts = []
    for at in range(5, 180):
        copy = item[:at] + list(draw.choice(vocabulary, 17)) + item[at + 17 :]
        texts.append(list(draw.choice(vocabulary, int(draw.integers(0, 9)))) + copy)
    assert min(most_alike(t, item) for t in texts[:175:25]) >= 0.8
    hashes = dc._item_words([" ".join(t) for t in texts])
    index = dc.build_index([0], dc._item_words([" ".join(item)]), 5)
    found = dc.matches(np.concatenate(hashes), np.cumsum([0, *map(len, hashes)]), index, 0.8, 5)
    assert [m[0] for m in found] == list(range(len(texts)))


def test_documents_that_are_a_cut_item_go(spark):
    item = [f"q{i}" for i in range(51)]
    texts = [item[:46], item[5:], item[:20] + ["x"] + item[21:], item[:30]]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    benchmark = spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")
    found = {r["doc_id"]: (r["item_ids"], r["similarity"], r["kept"]) for r in dc.decontaminate(df, benchmark).collect()}
    alike = [pytest.approx(most_alike(t, item)) for t in texts]
    assert found == {**{i: ([7], alike[i], False) for i in range(3)}, 3: ([], None, True)}


def test_each_row_has_its_own_verdict_at_any_number_of_parts(spark, monkeypatch):
    items = [(i, " ".join(f"{c}{k}" for k in range(8))) for i, c in enumerate("abc")]
    texts = [(None, items[0][1]), (None, "clean one"), (5, items[1][1] + " x " + items[2][1]), (5, "clean two"), (5, "clean two"), (6, None)]
    df = spark.createDataFrame([(k, "e", t) for k, t in texts], "doc_id long, lang string, text string")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    expected = Counter([(None, (0,)), (None, ()), (5, (1, 2)), (5, ()), (5, ()), (6, ())])
    for part in (5000, 3, 2, 1):
        found = dc.contaminated(df, benchmark, part=part).collect()
        assert Counter((r["doc_id"], tuple(m["item"] for m in r["matches"])) for r in found) == expected
    monkeypatch.setattr(type(spark.read), "parquet", lambda *_: benchmark)
    left = corpus_pipeline.benchmark(spark, df, FOLDER)
    monkeypatch.undo()
    assert left.columns == df.columns
    assert Counter(map(tuple, left.collect())) == Counter([(None, "e", "clean one"), (5, "e", "clean two"), (5, "e", "clean two"), (6, "e", None)])


def test_all_prints_within_the_radius_are_candidates():
    draw = np.random.default_rng(9)
    own = [draw.integers(0, 1 << 63, 20, dtype=np.uint64) for _ in range(30)]
    index = dc.build_index(list(range(30)), own, 5)
    size = next(iter(index.classes))
    prints = index.classes[size][0]
    probes = np.asarray([int(p) ^ sum(1 << int(b) for b in draw.choice(64, n, False)) for p in prints for n in (0, 3, 7, 8)], np.uint64)
    left, right = dc.candidates(probes, index, size)
    near = {(i, j) for i, p in enumerate(probes) for j, q in enumerate(prints) if int(p ^ q).bit_count() <= dc.RADIUS}
    assert set(zip(left.tolist(), right.tolist(), strict=True)) == near


def test_decontamination_equals_plain_search(spark, documents):
    benchmark = spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()
    rows = entry.queries()["op3_decontaminate"](spark, FOLDER).collect()
    found = {r["doc_id"]: set(r["item_ids"]) for r in rows}
    texts = {r["doc_id"]: f" {' '.join(r['text'].lower().split())} " for r in documents.collect()}
    for r in benchmark:
        item = f" {' '.join(r['text'].lower().split())} "
        assert {k for k, t in texts.items() if item in t} <= {k for k, v in found.items() if r["item_id"] in v}


def test_url_verdicts(spark):
    day = lambda d: f"2024-01-{d:02d}"
    changes = [
        ("block", "bad.org", day(3), True), ("block", "bad.org", day(6), False), ("block", "bad.org", day(9), True),
        ("ads", "www.ok.net/ads", day(1), True), ("ads", None, day(1), True), ("late", "ok.net", day(20), True),
        ("block", "bad.org", day(4), True), ("tie", "tie.io", day(2), True), ("tie", "tie.io", day(2), False),
    ]
    urls = [
        ("https://bad.org/x", 2, ""), ("https://bad.org/x", 3, "block"), ("http://sub.Bad.ORG:80/x", 5, "block"),
        ("https://bad.org", 6, ""), ("https://bad.org./", 9, "block"), ("https://notbad.org/", 9, ""),
        ("https://www.ok.net/ads/1?q=/a", 4, "ads"), ("https://www.ok.net/adsense", 4, ""), ("https://u:p@www.ok.net/ads", 21, "ads,late"),
        ("no url", 4, ""), (None, 4, ""), ("https://tie.io/", 5, ""), ("https://bad.org/x", None, ""), ("https://bad.org/x", 3, "block"),
    ]
    log = spark.createDataFrame(changes, "list string, rule string, at string, added boolean").selectExpr("list", "rule", "date(at) at", "added")
    pages = spark.createDataFrame([(i, u, d and day(d)) for i, (u, d, _) in enumerate(urls)], "id long, url string, t string")
    got = uf.url_verdicts(pages.selectExpr("id", "url", "date(t) t", "'c' rule"), log, "id", "url", "t").collect()
    assert {r["id"]: ",".join(r["lists"]) for r in got} == {i: x for i, (_, _, x) in enumerate(urls)}
    assert all(r["kept"] == (not r["lists"]) for r in got)
    assert uf.url_verdicts(pages.limit(0).selectExpr("id", "url", "date(t) t"), log.limit(0), "id", "url", "t").count() == 0


def test_site_quality(spark, odd, nothing, documents):
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    rows = sb.site_quality(documents, labels).collect()
    score = lambda p: np.log(p / (1 - p))
    rate = np.mean([r["p_document"] for r in rows])
    for r in rows[:50]:
        p = np.clip(r["p_document"], 1e-9, 1 - 1e-9)
        assert score(r["score"]) == pytest.approx(score(p) + score(r["p_path"]) - score(rate), abs=1e-5)
    assert sb.site_quality(odd, labels).count() == len(ODD) and sb.site_quality(nothing, labels).count() == 0


def test_small_sites_shrink(spark):
    rows = [("big", 900.0, 1000), ("low", 100.0, 1000), ("mid", 500.0, 1000), ("tiny", 1.0, 1)]
    groups = spark.createDataFrame([(*r, 0.5) for r in rows], "h string, good double, n long, parent double")
    got = {r["h"]: r["p"] for r in sb._posterior(groups, "parent", "p").collect()}
    assert abs(got["big"] - 0.9) < 0.02 and abs(got["low"] - 0.1) < 0.02 and 0.5 < got["tiny"] < 0.8


@pytest.mark.parametrize("name", ["op5_url_filter", "op9_line_dedup"])
def test_query_equals_sql(spark, name):
    assert compare(entry.queries()[name](spark, FOLDER), connect(FOLDER), entry.oracle_sql()[name]) is None


def test_pipeline_stages(spark, documents, odd):
    rows = documents.unionByName(odd.drop("id", "a"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, rows, FOLDER)
        assert after.columns == rows.columns, name
        assert stage(spark, rows.limit(0), FOLDER).count() == 0
        rows = spark.createDataFrame(after.collect(), after.schema)
    last = corpus_pipeline.STAGES[-1][1](spark, rows, FOLDER).collect()
    assert len(last) == rows.count() and 4 in {r["doc_id"] for r in last}


def test_pipeline_query_equals_its_stages(spark, documents):
    rows = documents
    for _, stage in corpus_pipeline.STAGES:
        after = stage(spark, rows, FOLDER)
        rows = spark.createDataFrame(after.collect(), after.schema)
    assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, corpus_pipeline.run(spark, FOLDER).collect()))


def test_pipeline_stages_equal_brute_force(spark, monkeypatch):
    """Repeated lines, near copies and benchmark passages in a row, with exact, cut and edited copies."""
    draw = np.random.default_rng(27)
    fresh = lambda n: " ".join(f"n{i}" for i in draw.integers(0, 10**6, n))
    items = [(k, fresh(n)) for k, n in enumerate([3, 6, 15, 51, 59])]
    passage = "\n".join(fresh(n) for n in (30, 30, 5))
    texts = [f"{fresh(20)}\n{passage}\n{fresh(20)}" for _ in range(4)]
    base = fresh(120).split()
    for changed in (0, 1, 2, 3, 5):
        copy = list(base)
        copy[10 : 10 + changed] = fresh(changed).split()
        texts.append(" ".join(copy))
    for _, item in items:
        words = item.split()
        n, lost = len(words), len(words) // 12
        texts += [item, f"{fresh(7)} {item.upper()} {fresh(9)}", " ".join(words[lost:]), " ".join(words[: n - lost])]
        texts += [f"{fresh(6)} {' '.join([*words[: n // 2], 'other', *words[n // 2 + 1 :]])} {fresh(6)}"]
    texts += [fresh(40) for _ in range(5)]
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    done = corpus_pipeline.near_copies(spark, corpus_pipeline.repeated_lines(spark, df, FOLDER), FOLDER)
    monkeypatch.setattr(type(spark.read), "parquet", lambda *_: benchmark)
    stage = lambda d: corpus_pipeline.benchmark(spark, d, FOLDER)
    left = stage(spark.createDataFrame(done.collect(), done.schema))
    monkeypatch.undo()
    lines = maximal_dedup(rows, 50)
    plain = [(k, t) for k, (n, t) in lines.items() if not n or WORD.search(t)]
    roots = linked(plain, 80)
    single = [(k, t) for k, t in plain if roots[k][1] == k]
    clean = [(k, t) for k, t in single if all(most_alike(t.lower().split(), item.split()) < 0.8 for _, item in items)]
    assert len(rows) > len(single) > len(clean)
    assert sorted(map(tuple, left.collect())) == clean


def test_every_operator_has_a_query():
    names = entry.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11))
    assert len(ALL) == 11 and ratios(np.ones((2, 11), np.int64)).shape == (2, len(FEATURES))


def test_stages_with_any_column_names(spark):
    """Names that stages use themselves, a MAP column, and rows that share an id and a text."""
    names = ["_language", "runs", "_runs", "_key", "_hash", "_matches", "_n", "_row", "n", "key", "carried_1", "kept"]
    text = " ".join(f"the quick brown fox jumps over lazy dogs near river number {i}" for i in range(12))
    rows = [(1, text, "en"), (1, text, "en"), (2, text + " and another line\n" + text, "en"), (None, "a short English line of words", "en"), (3, None, "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for i, name in enumerate(names):
        df = df.withColumn(name, F.lit(i))
    df = df.withColumn("tags", F.create_map(F.lit("a"), F.lit(1))).withColumn("source", F.lit("s"))
    for name, run in corpus_pipeline.STAGES[:-1]:
        found = run(spark, df, FOLDER)
        assert found.columns == df.columns, name
        for row in found.collect():
            assert [row[n] for n in names] == list(range(len(names))) and row["tags"] == {"a": 1}, name
    left = corpus_pipeline.near_copies(spark, df, FOLDER).filter("doc_id = 1").count()
    assert left == 1
    assert corpus_pipeline.STAGES[-1][1](spark, df, FOLDER).count() == len(rows)


def test_labelled_sample_is_the_least_by_hash(spark):
    from casewell.llm.quality_rules import ALL, labelled_sample

    stats = spark.range(3000).select(F.when(F.col("id") < 900, 7).otherwise(F.col("id")).alias("doc_id"), *[F.col("id").alias(c) for c in ALL])
    labels = spark.range(3000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).alias("quality"))
    for bound in (1, 50, 800, 2000, 2950, 3000, 5000):  # also nearly all rows, where no hash bounds them
        table, y = labelled_sample(stats, labels, "doc_id", "quality", bound)
        want = stats.orderBy(F.xxhash64("doc_id"), "doc_id", *ALL).limit(bound).collect()
        assert table[:, 0].tolist() == [r[ALL[0]] for r in want] and y.tolist() == [r["doc_id"] % 2 for r in want]
