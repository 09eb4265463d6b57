"""Statistics of whole documents, one pass in numpy over Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from casewell.llm.common import BLANK, mix, pieces, runs, slim, windows, words

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
EXTRA = ["n_lines", "n_upper", "n_digits", "n_punct", "n_bytes", "n_distinct"]
ALL = COUNTS + EXTRA


def _members(chars: str) -> np.ndarray:
    table = np.zeros(256, bool)
    table[np.frombuffer(chars.encode(), np.uint8)] = True
    return table


SYMBOL = _members("#*$%&|<>")
UPPER = _members("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
DIGIT = _members("0123456789")
PUNCT = _members("!?.,;:\"'()[]{}/\\@=+~^_`-")


def _per_text(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[bounds[1:]] - total[bounds[:-1]]


def _later(keys: np.ndarray) -> np.ndarray:
    """Where an equal key stands earlier."""
    _, first = np.unique(keys, return_index=True)
    later = np.ones(len(keys), bool)
    later[first] = False
    return later


def _own(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Hashes that are equal only inside one text."""
    texts = np.repeat(np.arange(len(first) - 1, dtype=np.uint64), np.diff(first))
    return mix(hashes ^ mix(texts + np.uint64(1)))


def statistics(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Counts of `ALL` as a table with a row per text."""
    hashes, first, _ = words(data, bounds)
    full = ~BLANK[data]
    out = np.zeros((len(bounds) - 1, len(ALL)), np.int64)
    out[:, 0] = np.diff(first)
    out[:, 1] = _per_text(full & ((data & 0xC0) != 0x80), bounds)
    out[:, 2] = _per_text(SYMBOL[data], bounds)
    # Lines: blanks inside count too, so they are hashed with the blanks told apart.
    breaks = data == 10
    begins = np.zeros(len(data), bool)
    begins[1:] = breaks[:-1]
    begins[bounds[:-1][bounds[:-1] < len(data)]] = True
    starts = np.flatnonzero(begins)
    if len(starts):
        shown = data.copy()
        shown[BLANK[data] & ~breaks] |= 0x80  # 0x89 to 0x8d and 0xa0; the length tells the rest
        sizes = np.diff(np.append(starts, len(data)))
        lines = pieces(shown, starts) ^ mix(_per_text(BLANK[data] & ~breaks, np.append(starts, len(data))).astype(np.uint64))
        owner = np.searchsorted(starts, bounds)
        worded = np.add.reduceat(full, starts, dtype=np.int64) > 0
        later = _later(_own(lines, owner)) & worded & (sizes > 0)
        out[:, 3] = _per_text(later, owner)
    grams, own = windows(hashes, first, 3)
    if len(grams):
        keys = _own(grams, own)
        _, place, counts = np.unique(keys, return_inverse=True, return_counts=True)
        twice = counts[place] > 1
        at = np.repeat(first[:-1] - own[:-1], np.diff(own)) + np.arange(len(grams))
        covered = np.zeros(len(hashes), bool)
        for k in range(3):
            covered[at[twice] + k] = True
        out[:, 4] = _per_text(covered, first)
    out[:, 5] = _per_text(breaks, bounds) + 1
    out[:, 6] = _per_text(UPPER[data], bounds)
    out[:, 7] = _per_text(DIGIT[data], bounds)
    out[:, 8] = _per_text(PUNCT[data], bounds)
    out[:, 9] = np.diff(bounds)
    out[:, 10] = np.diff(first) - _per_text(_later(_own(hashes, first)), first)
    return out


def document_stats(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`key` and the counts of `ALL` (bigint) of every row's whole text; null counts as empty."""
    kind = df.schema[key].dataType.simpleString()
    names = [key, *ALL]

    def task(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            for start, end, data, bounds in runs(frame.column(1)):
                table = statistics(data, bounds)
                keys = frame.column(0).slice(start, end - start)
                columns = [keys, *[pa.array(table[:, i]) for i in range(len(ALL))]]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return slim(df, key, text).mapInArrow(task, f"`{key}` {kind}, " + ", ".join(f"{c} bigint" for c in ALL))


def ratios(table: np.ndarray) -> np.ndarray:
    """Features of classifiers from rows of `ALL`."""
    c = {name: table[:, i].astype(np.float64) for i, name in enumerate(ALL)}
    n, size = np.maximum(c["n_words"], 1), np.maximum(c["n_bytes"], 1)
    return np.column_stack(
        [
            np.log1p(c["n_words"]), c["word_chars"] / n, c["n_symbols"] / n, c["n_dup_lines"] / c["n_lines"],
            c["n_repeat_words"] / n, c["n_upper"] / size, c["n_digits"] / size, c["n_punct"] / n,
            c["n_distinct"] / n, c["n_lines"] / n,
        ]
    )


FEATURES = [
    "log_words", "word_length", "symbol_rate", "dup_line_rate", "repeat_rate", "upper_rate", "digit_rate",
    "punct_rate", "distinct_rate", "line_rate",
]
