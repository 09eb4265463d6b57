"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, and
short sub-windows that no copy can do without.

A text repeats an item if any stretch of it, of any length and at any place, has a similarity of
0.8 or more with the item: weighted Jaccard of the two bags of five-word shingles, a shingle
weighing as often as it stands there. Items of fewer than five words have no shingle; a stretch
repeats them if it has as many words and the same ones, a word counting as often as it stands there.

Candidates are pairs of a text and an item, from two sources:

- SimHash: window sizes are a few classes of whole strides, about 1.25 times apart. An item takes
  the largest class that leaves room for `STRIDE` starts, and is fingerprinted from each of them;
  a document is fingerprinted at every `STRIDE`th word for every class. A fingerprint has 64
  bits, each the sign of the summed bits of the window's words. The four 16-bit blocks of an item
  fingerprint, and each with one bit turned, index it, which finds all within a distance of 7.
  This radius does not follow from the threshold: copies cut short or edited can lie beyond it.
- Sub-windows: a stretch of similarity 0.8 holds 0.8 of the item's shingles, so it holds one of
  any of them that make up more than 0.2. So many of each item, the ones that fewest items
  have, are looked up at every word of the documents. No copy is lost to this source, wherever it is
  cut or edited. Items below five words are looked up by the summed hashes of their words.

Each candidate is verified over all stretches of the text that begin and end with a shingle of
the item, as longer ones are less alike.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from casewell.llm.common import LOWER, mix, runs, slim, windows, words
from casewell.session import stage

STRIDE = 4
RADIUS = 7


def fingerprint(hashes: np.ndarray) -> np.uint64:
    """SimHash of some words: each bit set in more than half of them."""
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(0)
    return np.packbits(2 * bits > len(hashes)).view(np.uint64)[0]


def window_prints(hashes: np.ndarray, first: np.ndarray, sizes: list[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(size, first word, fingerprint) of the windows at every `STRIDE`th word of each text.

    Texts are padded to whole strides. Bits are summed per stride, these sums to runs of 2, 4,
    8 … strides, and every size (whole strides) is put together from such runs.
    """
    counts = np.diff(first)
    strides = -(-counts // STRIDE)
    begins = np.cumsum(strides) - strides
    padded = np.zeros(int(strides.sum()) * STRIDE, np.uint64)
    padded[np.arange(len(hashes) - first[0]) + np.repeat(begins * STRIDE - first[:-1] + first[0], counts)] = hashes[first[0] :]
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1).reshape(-1, STRIDE, 64)
    wide = np.uint8 if max(sizes) < 256 else np.uint32
    sums = [bits.sum(1, dtype=wide)]
    while 2 ** len(sums) * STRIDE <= max(sizes):
        half = 2 ** (len(sums) - 1)
        sums.append(sums[-1][: len(sums[-1]) - half] + sums[-1][half:])
    stride = np.arange(len(sums[0])) - np.repeat(begins, strides)
    owner = np.repeat(np.arange(len(counts)), strides)
    for size in sizes:
        total, done, units = None, 0, size // STRIDE
        if units > len(sums[0]):
            continue
        last = len(sums[0]) - units + 1
        for level in range(len(sums)):
            if units >> level & 1:
                part = sums[level][done : done + last]
                total, done = part if total is None else total + part, done + 2**level
        at = np.flatnonzero(stride[:last] * STRIDE + size <= counts[owner[:last]])
        prints = np.packbits(total[at] > size // 2, axis=1).view(np.uint64)[:, 0]
        yield size, first[owner[at]] + stride[at] * STRIDE, prints


@dataclass(frozen=True)
class Index:
    """Items of one part of the benchmark."""

    ids: list
    lengths: np.ndarray
    classes: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]]
    # Distinct shingles of each item and how often each stands there.
    shingles: list[tuple[np.ndarray, np.ndarray]]
    # Sorted keys of the sub-windows and their items, by number of words.
    anchors: dict[int, tuple[np.ndarray, np.ndarray]]
    # The key of each item below `width` words.
    sums: dict[int, np.uint64]


def _keys(hashes: np.ndarray, first: np.ndarray, words_each: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(key, index of each text's first one) of the sub-windows at every word: shingles, or below
    `width` words the sum of the word hashes, which is one for equal bags."""
    if words_each == width:
        return windows(hashes, first, width)
    starts = np.maximum(np.diff(first) - words_each + 1, 0)
    ends = np.concatenate([[0], np.cumsum(starts)])
    at = np.repeat(first[:-1] - ends[:-1], starts) + np.arange(ends[-1])
    total = np.zeros(len(at), np.uint64)
    for k in range(words_each):
        total += hashes[at + k]
    return mix(total), ends


def _anchors(item_words: list[np.ndarray], shingles: list[tuple[np.ndarray, np.ndarray]], least: float, width: int) -> dict:
    """Sub-windows of which a stretch of similarity `least` holds one, whichever it is."""
    found: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
    full = [n for n, own in enumerate(item_words) if len(own) >= width]
    seen = np.sort(np.concatenate([shingles[n][0] for n in full])) if full else np.zeros(0, np.uint64)
    for n, own in enumerate(item_words):
        if len(own) >= width:
            keys, often = shingles[n]
            common = np.searchsorted(seen, keys, "right") - np.searchsorted(seen, keys)
            order = np.lexsort((keys, common))
            total = int(often.sum())
            spared = total - int(np.ceil(least * total - 1e-9))
            keys = keys[order[: int(np.searchsorted(np.cumsum(often[order]), spared, "right")) + 1]]
            size = width
        elif len(own):
            keys, size = _keys(own, np.asarray([0, len(own)]), len(own), width)[0], len(own)
        else:
            continue
        found.setdefault(size, []).append((keys, np.full(len(keys), n)))
    out = {}
    for size, parts in found.items():
        keys, items = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
        order = np.argsort(keys, kind="stable")
        out[size] = (keys[order], items[order])
    return out


def build_index(ids: list, item_words: list[np.ndarray], width: int, least: float = 0.8) -> Index:
    """Fingerprints, their items and offsets per class, for each block the sorted keys, and the
    sub-windows."""
    most = max(map(len, item_words))
    sizes = [STRIDE]
    while sizes[-1] < most:
        sizes.append(sizes[-1] + STRIDE * max(1, round(sizes[-1] / STRIDE / 4)))
    rows: dict[int, list[tuple[int, int, int]]] = {}
    for item, own in enumerate(item_words):
        size = max((s for s in sizes if s <= len(own) - STRIDE + 1), default=STRIDE)
        for start in range(min(STRIDE, max(len(own) - size + 1, 0))):
            rows.setdefault(size, []).append((int(fingerprint(own[start : start + size])), item, start))
    classes = {}
    for size, found in rows.items():
        prints = np.asarray([f[0] for f in found], np.uint64)
        tables = []
        for block in range(4):
            part = ((prints >> np.uint64(16 * block)) & np.uint64(0xFFFF)).astype(np.int64)
            turned = np.concatenate([part, *[part ^ (1 << bit) for bit in range(16)]])
            own = np.tile(np.arange(len(part)), 17)
            order = np.argsort(turned, kind="stable")
            begins = np.searchsorted(turned[order], np.arange((1 << 16) + 1))
            tables.append((begins.astype(np.int32), own[order].astype(np.int32)))
        classes[size] = (prints, np.asarray([f[1] for f in found]), np.asarray([f[2] for f in found]), tables)
    shingles = [np.unique(windows(w, np.asarray([0, len(w)]), width)[0], return_counts=True) for w in item_words]
    anchors = _anchors(item_words, shingles, least, width)
    sums = {int(n): key for size, own in anchors.items() if size < width for key, n in zip(*own, strict=True)}
    return Index(ids, np.asarray([len(w) for w in item_words]), classes, shingles, anchors, sums)


def candidates(prints: np.ndarray, index: Index, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(window, row of the class) of all pairs within the radius."""
    own, _, _, tables = index.classes[size]
    left, right = [], []
    for block, (begins, rows) in enumerate(tables):
        key = ((prints >> np.uint64(16 * block)) & np.uint64(0xFFFF)).astype(np.int64)
        many = begins[key + 1] - begins[key]
        at = np.flatnonzero(many)
        reps = many[at]
        where = np.repeat(at, reps)
        shift = np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps)
        row = rows[np.repeat(begins[key[at]], reps) + shift]
        near = np.bitwise_count(prints[where] ^ own[row]) <= RADIUS
        left.append(where[near])
        right.append(row[near])
    pairs = np.unique(np.concatenate(left).astype(np.int64) * (len(own) + 1) + np.concatenate(right))
    return pairs // (len(own) + 1), pairs % (len(own) + 1)


def shared(keys: np.ndarray, begins: np.ndarray, anchors: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """(text, item) of all sub-windows that both have."""
    own, items = anchors
    at = np.searchsorted(own, keys)
    at[at == len(own)] = 0
    hit = np.flatnonzero(own[at] == keys)
    texts = np.searchsorted(begins, hit, "right") - 1
    # Equal keys of a text are looked up once.
    texts, keys = np.unique(np.stack([texts.astype(np.uint64), keys[hit]]), axis=1) if len(hit) else (texts, keys[hit])
    low = np.searchsorted(own, keys)
    many = np.searchsorted(own, keys, "right") - low
    shift = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    return np.stack([np.repeat(texts.astype(np.int64), many), items[np.repeat(low, many) + shift]])


def best_stretch(grams: np.ndarray, keys: np.ndarray, often: np.ndarray, least: float) -> tuple[float, int]:
    """(similarity, first shingle) of the stretch of `grams` most like the item whose distinct
    shingles `keys` (sorted) stand there `often`, the first of equals; (0, 0) below `least`."""
    kind = np.searchsorted(keys, grams)
    kind[kind == len(keys)] = 0
    place = np.flatnonzero(keys[kind] == grams)
    kind = kind[place]
    total = int(often.sum())
    # A stretch longer than this has too much besides the item.
    ends = np.searchsorted(place, place + int(total / least + 1e-9))
    # How many of the same shingle stand before each.
    order = np.argsort(kind, kind="stable")
    rank = np.empty(len(kind), np.int64)
    rank[order] = np.arange(len(kind)) - np.searchsorted(kind[order], kind[order])
    best = (0.0, 0)
    for i in np.flatnonzero(ends - np.arange(len(place)) >= least * total - 1e-9):
        span = slice(i, ends[i])
        # Those before the stretch, as its first one of each kind tells.
        some, at, which = np.unique(kind[span], return_index=True, return_inverse=True)
        before = rank[span][at][which]
        common = np.cumsum(rank[span] - before < often[kind[span]])
        alike = common / (total + place[span] - place[i] + 1 - common)
        top = float(alike.max())
        if top >= least and top > best[0]:
            best = (top, int(place[i]))
            if top == 1:
                break
    return best


def matches(hashes: np.ndarray, first: np.ndarray, index: Index, least: float, width: int) -> list[tuple[int, int, int, float]]:
    """(text, item, word at which the copy starts, similarity) of all verified pairs."""
    if not len(hashes) or not (index.classes or index.anchors):
        return []
    pairs = [np.zeros((2, 0), np.int64)]
    for size, starts, prints in window_prints(hashes, first, sorted(index.classes)) if index.classes else ():
        if len(starts):
            window, row = candidates(prints, index, size)
            pairs.append(np.stack([np.searchsorted(first, starts[window], "right") - 1, index.classes[size][1][row]]))
    grams, begins = windows(hashes, first, width)
    sums = {}
    for size, anchors in index.anchors.items():
        keys, edges = sums[size] = (grams, begins) if size == width else _keys(hashes, first, size, width)
        pairs.append(shared(keys, edges, anchors))
    every = np.concatenate(pairs, axis=1)
    code = np.unique(every[0] * len(index.ids) + every[1])
    found = []
    for text, item in zip((code // len(index.ids)).tolist(), (code % len(index.ids)).tolist(), strict=True):
        size = int(index.lengths[item])
        if size >= width:
            alike, begin = best_stretch(grams[begins[text] : begins[text + 1]], *index.shingles[item], least)
        else:
            keys, edges = sums[size]
            at = np.flatnonzero(keys[edges[text] : edges[text + 1]] == index.sums[item])
            alike, begin = (1.0, int(at[0])) if len(at) else (0.0, 0)
        if alike >= least:
            found.append((text, item, begin, alike))
    return found


def _item_words(texts: list[str]) -> list[np.ndarray]:
    parts = [t.encode() for t in texts]
    bounds = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    hashes, first, _ = words(LOWER[np.frombuffer(b"".join(parts), np.uint8)], bounds)
    return [hashes[first[i] : first[i + 1]] for i in range(len(parts))]


def with_matches(
    df: DataFrame, benchmark: DataFrame, columns: Sequence[str], text: str = "text", item: str = "item_id",
    item_text: str = "text", least: float = 0.8, width: int = 5, part: int = 5_000, name: str = "matches",
) -> DataFrame:
    """The named columns of each row of `df`, with `matches`: (item, start word, similarity) of
    each item that a stretch of its text repeats, by item; an empty list where there is none.

    The benchmark is taken in parts of `part` items, each a pass over the documents, so what
    travels with a task is bounded. With several parts the rows are numbered, and each part's
    matches are joined back by that number. Null or wordless texts and items match nothing.
    """
    items = slim(benchmark, item, item_text).filter(F.col(item).isNotNull() & F.col(item_text).rlike("[^\\x20\\x09-\\x0D]"))
    kind = benchmark.schema[item].dataType.simpleString()
    listed = f"array<struct<item:{kind},start:bigint,similarity:double>>"

    def searched(rows: DataFrame, carried: Sequence[str], index: Index | None) -> DataFrame:
        place, own = rows.columns.index(text), [rows.columns.index(c) for c in carried]
        element = pa.struct([("item", pa.int64() if kind != "string" else pa.string()), ("start", pa.int64()), ("similarity", pa.float64())])

        def task(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for frame in frames:
                for start, end, data, bounds in runs(frame.column(place), 1 << 19):
                    lists: list[list[dict]] = [[] for _ in range(end - start)]
                    if index:
                        hashes, first, _ = words(LOWER[data], bounds)
                        for at, n, begin, alike in matches(hashes, first, index, least, width):
                            lists[at].append({"item": index.ids[n], "start": begin, "similarity": alike})
                    kept = [frame.column(c).slice(start, end - start) for c in own]
                    yield pa.RecordBatch.from_arrays([*kept, pa.array(lists, pa.list_(element))], names=[*carried, name])

        return rows.mapInArrow(task, StructType([*[rows.schema[c] for c in carried], StructField(name, StructType.fromDDL(f"m {listed}")[0].dataType)]))

    every = slim(df, text, *[c for c in columns if c != text])
    numbered = None
    held: list = []
    results = []

    def passed(only: bool = False) -> None:
        nonlocal numbered
        index = build_index([r[0] for r in held], _item_words([r[1] for r in held]), width, least) if held else None
        held.clear()
        if only:
            results.append(searched(every, columns, index))
            return
        if numbered is None:
            numbered = stage(every.withColumn("_row", F.monotonically_increasing_id()), "numbered")
        results.append(searched(slim(numbered, text, "_row"), ["_row"], index).filter(F.size(name) > 0))

    for row in items.orderBy(item, item_text).toLocalIterator():
        if len(held) == part:
            passed()
        held.append(row)
    passed(only=not results)
    found = results[0]
    if numbered is not None:
        for other in results[1:]:
            found = found.unionByName(other)
        found = found.groupBy("_row").agg(F.flatten(F.collect_list(name)).alias(name))
        found = numbered.join(found, "_row", "left").withColumn(name, F.coalesce(name, F.array().cast(listed)))
    return found.select(*columns, F.array_sort(name).alias(name))


def contaminated(
    df: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id",
    item_text: str = "text", least: float = 0.8, width: int = 5, part: int = 5_000,
) -> DataFrame:
    """Rows of `df` as `key` with `matches`; one row per row of `df` at every number of items."""
    return with_matches(df, benchmark, [key], text, item, item_text, least, width, part)


def decontaminate(df: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: `key`, the items it repeats with the best similarity, and whether
    it is `kept` (repeats none)."""
    found = contaminated(df, benchmark, key, text)
    return found.select(
        key,
        F.transform("matches", lambda m: m["item"]).alias("item_ids"),
        F.array_max(F.transform("matches", lambda m: m["similarity"])).alias("similarity"),
        (F.size("matches") == 0).alias("kept"),
    )
