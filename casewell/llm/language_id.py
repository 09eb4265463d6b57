"""Language ID by error-correcting output codes over byte n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casewell.llm.common import runs, slim

BITS = 15
BUCKETS = 1 << BITS
ORDERS = (2, 3, 4)
UNKNOWN = "und"

# Lower-case ASCII letters and all bytes of other letters stay; the rest is one blank.
FOLD = np.full(256, 32, np.uint8)
FOLD[97:123] = np.arange(97, 123)
FOLD[65:91] = np.arange(97, 123)
FOLD[128:] = np.arange(128, 256)
_ODD = np.asarray([2654435761, 2246822519, 3266489917, 668265263, 374761393], np.uint32)


def grams(data: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order: the bucket of the n-gram at every byte, and whether it lies in one text."""
    folded = FOLD[data].astype(np.uint32)
    for n in ORDERS:
        size = len(folded) - n + 1
        if size <= 0:
            continue
        code = folded[:size].copy()
        for k in range(1, n):
            code = (code << np.uint32(8)) | folded[k : size + k]
        inside = np.ones(size, bool)
        for k in range(1, n):
            edge = bounds[1:-1] - k
            inside[edge[(edge >= 0) & (edge < size)]] = False
        # A run of blanks says nothing.
        blank = folded == 32
        inside &= ~(blank[:size] & blank[1 : size + 1])
        yield (code * _ODD[n]) >> np.uint32(32 - BITS), inside


def code_book(classes: int, seed: int = 7) -> np.ndarray:
    """±1 code words, one row per class: all splits for few classes, else the dense random
    book with the largest least distance of 500 draws."""
    if classes < 2:
        return np.ones((classes, 1))
    if classes <= 5:
        splits = [(1, *rest) for rest in product((1, -1), repeat=classes - 1) if -1 in rest]
        return np.asarray(splits, float).T
    random, best, book = np.random.default_rng(seed), -1, None
    width = int(np.ceil(10 * np.log2(classes)))
    for _ in range(500):
        draw = random.choice([-1.0, 1.0], (classes, width))
        draw = draw[:, np.abs(draw.sum(0)) < classes]
        apart = (draw.shape[1] - draw @ draw.T) / 2
        least = apart[~np.eye(classes, dtype=bool)].min() if draw.shape[1] else -1
        if least > best:
            best, book = least, draw
    return book


@dataclass(frozen=True)
class Model:
    languages: list[str]
    book: np.ndarray
    weights: np.ndarray
    trust: np.ndarray

    def losses(self, totals: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Weighted logistic loss of each code word; `totals` are summed n-gram evidence."""
        margin = totals / np.sqrt(np.maximum(sizes, 1))[:, None]
        toward = np.logaddexp(0, -margin) * self.trust
        away = np.logaddexp(0, margin) * self.trust
        return toward @ (self.book.T > 0) + away @ (self.book.T < 0)


def fit(counts: np.ndarray, languages: list[str]) -> Model:
    """One binary classifier per bit: log ratio of the mean n-gram shares of its two sides.

    A bit is trusted by the evidence that it gives per n-gram of its own languages.
    """
    book = code_book(len(languages))
    share = (counts + 0.5) / (counts + 0.5).sum(1, keepdims=True)
    columns = []
    for bit in book.T:
        sides = [share[bit > 0], share[bit < 0]]
        columns.append(np.zeros(BUCKETS) if not all(len(s) for s in sides) else np.log(sides[0].mean(0) / sides[1].mean(0)))
    weights = np.clip(np.column_stack(columns), -4, 4)
    gain = ((share @ weights) * book).mean(0)
    trust = gain / gain.mean() if gain.mean() > 0 else np.ones(len(gain))
    return Model(languages, book, weights.astype(np.float32), trust)


def _has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def gram_counts(df: DataFrame, text: str, lang: str) -> DataFrame:
    """(lang, bucket, n): n-gram counts of all given rows, summed in each task first."""

    def task(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, np.ndarray] = {}
        for frame in frames:
            langs = frame.column(1).to_pylist()
            for start, end, data, bounds in runs(frame.column(0)):
                names = sorted(set(langs[start:end]))
                place = {name: i for i, name in enumerate(names)}
                owner = np.repeat([place[x] for x in langs[start:end]], np.diff(bounds))
                total = np.zeros(len(names) * BUCKETS, np.int64)
                for bucket, inside in grams(data, bounds):
                    where = owner[: len(bucket)][inside] * BUCKETS + bucket[inside]
                    total += np.bincount(where, minlength=len(total))
                for name, i in place.items():
                    own = total[i * BUCKETS : (i + 1) * BUCKETS]
                    known[name] = known[name] + own if name in known else own
        for name, own in known.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(own[at])],
                names=["lang", "bucket", "n"],
            )

    parts = slim(df, text, lang).mapInArrow(task, "lang string, bucket int, n bigint")
    return parts.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def learn(df: DataFrame, text: str = "text", lang: str = "lang") -> Model | None:
    """The model from all rows with a text and a language. Only counts per language and
    bucket reach the driver: 32,768 numbers for each language, whatever the corpus."""
    known = df.filter(F.col(text).isNotNull() & F.col(lang).isNotNull())
    rows = gram_counts(known, text, lang).groupBy("lang").agg(
        F.sort_array(F.collect_list(F.struct("bucket", "n"))).alias("cells")
    )
    found = {r["lang"]: r["cells"] for r in rows.collect()}
    if not found:
        return None
    languages = sorted(found)
    counts = np.zeros((len(languages), BUCKETS))
    for i, name in enumerate(languages):
        cells = np.asarray(found[name], np.int64)
        counts[i, cells[:, 0]] = cells[:, 1]
    return fit(counts, languages)


def predict(df: DataFrame, model: Model | None, text: str, out: str, slack: float = 0.7) -> DataFrame:
    """All columns of `df` with (lang_pred, score, ambiguous) as the struct `out`.

    `score` is the share of the nearest code word in exp(-loss). A result is `ambiguous` if
    the runner-up's loss is larger by less than `slack`. Null or letterless texts, and all
    texts if there was nothing to learn from, are `und` with score 0.
    """
    kind = "struct<lang_pred:string,score:double,ambiguous:boolean>"
    names = pa.struct([("lang_pred", pa.string()), ("score", pa.float64()), ("ambiguous", pa.bool_())])
    at = df.columns.index(text)

    def task(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            column = frame.column(at)
            for start, end, data, bounds in runs(column):
                totals = np.zeros((end - start, model.weights.shape[1] if model else 1))
                sizes = np.zeros(end - start)
                if model:
                    for bucket, inside in grams(data, bounds):
                        edge = np.minimum(bounds, len(bucket))
                        many = np.concatenate([[0], np.cumsum(inside)])
                        sizes += many[edge[1:]] - many[edge[:-1]]
                        for bit in range(totals.shape[1]):
                            worth = model.weights[:, bit][bucket] * inside
                            run = np.concatenate([[0.0], np.cumsum(worth, dtype=np.float64)])
                            totals[:, bit] += run[edge[1:]] - run[edge[:-1]]
                texts = column.slice(start, end - start)
                letter = np.asarray([_has_letter(t) for t in texts.to_pylist()], bool)
                if model:
                    losses = model.losses(totals, sizes)
                    best = losses.argmin(1)
                    order = np.sort(losses, 1)
                    score = 1 / np.exp(order[:, :1] - losses).sum(1)
                    close = (order[:, 1] - order[:, 0] < slack) if losses.shape[1] > 1 else np.zeros(len(best), bool)
                    langs = [model.languages[b] if ok else UNKNOWN for b, ok in zip(best, letter, strict=True)]
                else:
                    score, close, langs = np.zeros(len(letter)), np.ones(len(letter), bool), [UNKNOWN] * len(letter)
                found = pa.StructArray.from_arrays(
                    [pa.array(langs, pa.string()), pa.array(np.where(letter, score, 0.0)), pa.array(close | ~letter)],
                    fields=list(names),
                )
                part = frame.slice(start, end - start)
                yield pa.RecordBatch.from_arrays([*part.columns, found], names=[*part.schema.names, out])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInArrow(task, f"{schema}, `{out}` {kind}")


def held_out(key: str) -> Column:
    """Whether crc32 of the key as text leaves 1 when divided by 3; a null key is not held out."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 3 == 1, F.lit(False))


def identify(df: DataFrame, train: DataFrame, text: str = "text", lang: str = "lang", out: str = "_language") -> DataFrame:
    """Learn from `train`, then add the struct `out` to every row of `df`."""
    return predict(df, learn(train, text, lang), text, out)


def language_id(df: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """One row per document: `key`, `held_out`, `lang_pred`, `score`, `ambiguous`.

    Learns from rows with a key that are not held out; the language column is read for
    nothing else. Repeated rows are predicted each.
    """
    train = slim(df, key, text, lang).filter(F.col(key).isNotNull() & ~held_out(key))
    found = identify(slim(df, key, text), train, text, lang, "_language")
    return found.select(key, held_out(key).alias("held_out"), "_language.*")


def accepted(out: str = "_language", least: float = 0.4) -> Column:
    """Rows that a filter keeps: a language was found, and not by a guess between several."""
    return (F.col(f"{out}.lang_pred") != UNKNOWN) & (~F.col(f"{out}.ambiguous") | (F.col(f"{out}.score") >= least))
