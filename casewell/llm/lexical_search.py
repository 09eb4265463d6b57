"""Ranked lexical search by the Best Position Algorithm over impact-ordered lists.

Terms are runs of digits, Latin letters and characters beyond ASCII, with A-Z in lower case. A
document's impact for a term is an integer that grows with its occurrences and shrinks with the
document's length; the score is the sum of impacts over an item's terms, once each.

Documents are searched in parts, each by one task and of bounded size, and the best of all parts
are merged: a part's lists hold (document, impact) by falling impact for every term of the items.
All lists of an item are read in step. A document met in one of them is looked up in the others
at once, which marks its positions there as seen too. A list's best position is the last before
which all are seen; a document not seen in any list scores no more than the sum of the impacts
there. Reading stops when the k-th best score lies strictly above that sum, as a document with an
equal score may have the smaller id. The k best of earlier parts are kept, so later parts stop early.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from casewell.llm.common import TERM, runs, slim, words
from casewell.session import stage

# (item, term) rows that one pass over the documents searches for.
BLOCK_TERMS = 1 << 20
# (document, term) entries of a part: what a task holds at a time.
PART_ENTRIES = 2_000_000
DEPTH = 64
_TEXTS = 1000


def item_terms(items: DataFrame, key: str, text: str) -> DataFrame:
    """Distinct (key, term hash) rows. Items that share a key, or have none, are one item."""
    kind = items.schema[key].dataType.simpleString()

    def task(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            for start, end, data, bounds in runs(frame.column(1)):
                hashes, first, _ = words(TERM[data], bounds)
                at = np.repeat(np.arange(end - start), np.diff(first))
                yield pa.RecordBatch.from_arrays([frame.column(0).slice(start, end - start).take(pa.array(at)), pa.array(hashes.view(np.int64))], names=["item", "term"])

    return slim(items, key, text).mapInArrow(task, f"item {kind}, term bigint").distinct()


def postings(df: DataFrame, vocabulary: np.ndarray, key: str, text: str) -> DataFrame:
    """key, n (all terms of the text), terms (places in the sorted vocabulary) and times (how
    often each occurs) of every row; null and empty texts have none."""
    kind = df.schema[key].dataType.simpleString()

    def task(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            for start, end, data, bounds in runs(frame.column(1)):
                hashes, first, _ = words(TERM[data], bounds)
                place = np.searchsorted(vocabulary, hashes)
                known = np.append(vocabulary, np.uint64(0))[place] == hashes
                known &= place < len(vocabulary)
                rows = np.repeat(np.arange(end - start), np.diff(first))
                own, times = np.unique(rows[known] * len(vocabulary) + place[known], return_counts=True)
                row, term = np.divmod(own, max(len(vocabulary), 1))
                offsets = pa.array(np.searchsorted(row, np.arange(end - start + 1)).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        frame.column(0).slice(start, end - start),
                        pa.array(np.diff(first)),
                        pa.ListArray.from_arrays(offsets, pa.array(term.astype(np.int32))),
                        pa.ListArray.from_arrays(offsets, pa.array(times.astype(np.int32))),
                    ],
                    names=["key", "n", "terms", "times"],
                )

    return slim(df, key, text).mapInArrow(task, f"key {kind}, n bigint, terms array<int>, times array<int>")


def document_frequencies(rows: DataFrame, many: int) -> np.ndarray:
    """Documents of each term of the vocabulary; counted in tasks, one number a term comes back."""

    def task(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(many, np.int64)
        for frame in frames:
            total += np.bincount(frame.column(0).flatten().to_numpy(), minlength=many)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["term", "n"])

    parts = rows.select("terms").mapInArrow(task, "term bigint, n bigint")
    out = np.zeros(many, np.int64)
    for row in parts.groupBy("term").agg(F.sum("n").alias("n")).collect():
        out[row["term"]] = row["n"]
    return out


def term_weights(frequencies: np.ndarray, documents: int) -> np.ndarray:
    return np.asarray([math.floor(1000 * math.log((2 * documents + 2) / (2 * f + 1))) for f in frequencies.tolist()], np.int64)


def impacts(weights: np.ndarray, times: np.ndarray, lengths: np.ndarray, documents: int, all_terms: int) -> np.ndarray:
    """w * ((10^9 tf) div (1000 tf + 20 m)) with m = 50 + (50 n N) div L, all in integers."""
    if len(lengths) and int(lengths.max()) * 50 * documents >= 1 << 63:
        m = np.asarray([50 + 50 * n * documents // all_terms for n in lengths.tolist()], np.int64)
    else:
        m = 50 + 50 * lengths * documents // max(all_terms, 1)
    times = times.astype(np.int64)
    return weights * (1_000_000_000 * times // (1000 * times + 20 * m))


class Part:
    """Lists of a part of the documents: entries sorted by (term, document) for direct access,
    and for each term its entries by falling impact for reading in order."""

    def __init__(self, row: np.ndarray, term: np.ndarray, impact: np.ndarray, rows: int):
        order = np.lexsort((row, term))
        self.rows, self.row, self.impact = rows, row[order], impact[order]
        self.code = term[order] * rows + self.row
        self.terms, first = np.unique(term[order], return_index=True)
        self.first = np.append(first, len(order))
        # Entries of each term by falling impact, and the inverse: an entry's position.
        self.by_impact = np.lexsort((self.row, -self.impact, term[order]))
        self.position = np.empty(len(order), np.int64)
        self.position[self.by_impact] = np.arange(len(order))

    def lists(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(term, begin, end) of the wanted terms that the part holds."""
        at = np.searchsorted(self.terms, wanted)
        held = at[np.append(self.terms, -1)[at] == wanted]
        return self.terms[held], self.first[held], self.first[held + 1]

    def access(self, terms: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Entries of all (term, row) pairs; -1 where a row lacks the term."""
        code = terms[:, None] * self.rows + rows[None, :]
        at = np.searchsorted(self.code, code)
        at[at == len(self.code)] = 0
        return np.where(self.code[at] == code, at, -1)


def best_positions(part: Part, wanted: np.ndarray, k: int, floor: np.ndarray, depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray, int]:
    """(rows, scores) of the part that may be among the `k` best, and how many entries were read
    in order. `floor`: the best scores found before, at most `k`; they count with the part's own."""
    terms, begin, end = part.lists(wanted)
    met = np.zeros(part.rows, bool)
    seen = np.zeros(int((end - begin).sum()), bool)
    base = np.cumsum(end - begin) - (end - begin)
    # Places of a list's entries in `seen`: position - begin + base.
    best = np.zeros(len(terms), np.int64)
    found_rows, found_scores, top = [], [], np.sort(floor)[::-1][:k]
    read = 0
    while len(terms):
        stop = np.minimum(read + depth, end - begin)
        start = np.minimum(read, end - begin)
        steps = stop - start
        at = np.repeat(begin + start - (np.cumsum(steps) - steps), steps) + np.arange(steps.sum())
        new = np.unique(part.row[part.by_impact[at]])
        new = new[~met[new]]
        if len(new):
            met[new] = True
            entry = part.access(terms, new)
            hit = entry >= 0
            scores = np.where(hit, part.impact[entry], 0).sum(axis=0)
            place = part.position[entry] - begin[:, None] + base[:, None]
            seen[place[hit]] = True
            found_rows.append(new)
            found_scores.append(scores)
            top = np.sort(np.concatenate([top, scores]))[::-1][:k]
        read, depth = read + depth, depth * 2
        limit = 0
        for i in range(len(terms)):
            size = int(end[i] - begin[i])
            rest = seen[base[i] + best[i] : base[i] + size]
            gap = int(rest.argmin()) if len(rest) else 0
            best[i] = size if not len(rest) or rest[gap] else best[i] + gap
            # The impact at the best position; none is left where all are seen.
            if best[i] < size:
                limit += int(part.impact[part.by_impact[begin[i] + max(best[i] - 1, 0)]])
        if (best == end - begin).all() or (len(top) >= k and top[-1] > limit):
            break
    if not found_rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), read
    rows, scores = np.concatenate(found_rows), np.concatenate(found_scores)
    keep = scores > 0
    if len(top) >= k:
        keep &= scores >= top[-1]
    return rows[keep], scores[keep], read


def _search_block(df: DataFrame, block: pa.Table, k: int, key: str, text: str) -> DataFrame:
    """(item, key, score): the best rows of each task for every item of the block."""
    items, number = np.unique(block.column("place").to_numpy(), return_inverse=True)
    hashes = block.column("term").to_numpy().view(np.uint64)
    vocabulary, term = np.unique(hashes, return_inverse=True)
    order = np.lexsort((term, number))
    term, bounds = term[order], np.searchsorted(number[order], np.arange(len(items) + 1))
    rows = stage(postings(df, vocabulary, key, text), "postings")
    counts = rows.agg(F.count_if(F.col("n") > 0).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    documents, all_terms = counts["docs"], counts["terms"]
    weights = term_weights(document_frequencies(rows, len(vocabulary)), documents)
    kind = rows.schema["key"].dataType.simpleString()

    def task(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        empty = (np.zeros(0, np.int64), [])
        best: list[tuple[np.ndarray, list]] = [empty] * len(items)

        def search(batches: list[pa.RecordBatch]) -> None:
            keys = pa.concat_arrays([b.column(0) for b in batches])
            lengths = np.concatenate([b.column(1).to_numpy() for b in batches])
            sizes = np.concatenate([b.column(2).value_lengths().to_numpy() for b in batches])
            own_terms = np.concatenate([b.column(2).flatten().to_numpy() for b in batches]).astype(np.int64)
            times = np.concatenate([b.column(3).flatten().to_numpy() for b in batches])
            row = np.repeat(np.arange(len(sizes)), sizes)
            part = Part(row, own_terms, impacts(weights[own_terms], times, lengths[row], documents, all_terms), len(sizes))
            for i in range(len(items)):
                floor, names = best[i]
                at, scores, _ = best_positions(part, term[bounds[i] : bounds[i + 1]], k, floor)
                if len(at):
                    all_names = names + keys.take(pa.array(at)).to_pylist()
                    all_scores = np.concatenate([floor, scores])
                    own = sorted(range(len(all_scores)), key=lambda j: (-all_scores[j], all_names[j] is None, all_names[j] if all_names[j] is not None else 0))[:k]
                    best[i] = (all_scores[own], [all_names[j] for j in own])

        held, entries = [], 0
        for frame in frames:
            for start in range(0, frame.num_rows, _TEXTS):
                piece = frame.slice(start, _TEXTS)
                held.append(piece)
                entries += len(piece.column(2).flatten())
                if entries >= PART_ENTRIES:
                    search(held)
                    held, entries = [], 0
        if held:
            search(held)
        for i, (scores, names) in enumerate(best):
            if names:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([int(items[i])] * len(names), pa.int64()), pa.array(names, frame.schema.field(0).type), pa.array(scores)], names=["place", "key", "score"]
                )

    found = rows.filter(F.size("terms") > 0).select("key", "n", "terms", "times").mapInArrow(task, f"place bigint, key {kind}, score bigint")
    return found.withColumn("part", F.spark_partition_id())


def lexical_search(
    df: DataFrame, items: DataFrame, k: int = 50, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", block_terms: int = BLOCK_TERMS
) -> DataFrame:
    """`item`, rank, `key`, score: the `k` rows of `df` with the highest scores above 0 for each
    item, ties by ascending key, rows without a key last.

    Null, empty and wordless texts match nothing; an item without terms, or whose terms no
    document holds, has no rows. Every row of `df` is a document of its own, so a repeated key
    can be listed again. Items with one key, or with none, are one item with the terms of all.
    Items are searched in blocks of about `block_terms` (item, term) rows; a block's rows and one
    frequency a term reach the driver, never anything of the documents.
    """
    spark = df.sparkSession
    terms = stage(item_terms(items, item, item_text), "terms")
    # Items are numbered; numbers, and not keys, go to the tasks.
    names = stage(terms.select("item").distinct().withColumn("place", F.monotonically_increasing_id()), "items")
    placed = terms.join(names, terms["item"].eqNullSafe(names["item"])).select("place", "term")
    total = terms.count()
    blocks = -(-total // block_terms)
    found = spark.createDataFrame([], f"place bigint, key {df.schema[key].dataType.simpleString()}, score bigint, part int")
    for b in range(blocks):
        mine = placed.filter(F.pmod(F.xxhash64("place"), F.lit(blocks)) == b).toArrow()
        if len(mine):
            found = found.unionByName(_search_block(df, mine, k, key, text))
    order = [F.desc("score"), F.asc_nulls_last("key")]
    # Best rows of groups of tasks first, so that no task holds those of all of them.
    for group in (F.pmod("part", F.lit(64)), F.lit(0)):
        best = F.row_number().over(Window.partitionBy("place", group).orderBy(*order))
        found = found.withColumn("rank", best).filter(F.col("rank") <= k)
    return found.join(names, "place").select(F.col("item").alias(item), "rank", F.col("key").alias(key), "score")


ORACLE = """
WITH docs AS (
  SELECT row_number() OVER () AS place, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS words
  FROM documents
), items AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term
  FROM benchmark
), totals AS (
  SELECT count(*) FILTER (WHERE len(words) > 0) AS docs, sum(len(words))::BIGINT AS terms FROM docs
), postings AS (
  SELECT place, doc_id, n, term, count(*) AS tf
  FROM (SELECT place, doc_id, len(words)::BIGINT AS n, unnest(words) AS term FROM docs)
  WHERE term IN (SELECT term FROM items)
  GROUP BY ALL
), weights AS (
  SELECT term, floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1)))::BIGINT AS w
  FROM postings, totals GROUP BY term
), scored AS (
  SELECT item_id, place, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * docs) // terms))))::BIGINT AS score
  FROM items JOIN postings USING (term) JOIN weights USING (term), totals
  GROUP BY ALL
), placed AS (
  SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INT AS rank, doc_id, score
  FROM scored WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM placed WHERE rank <= 50
"""
