"""Unigram token counts by dynamic programming over a trie of the distinct pre-tokens.

A pre-token is a word behind the mark of a word's beginning. The distinct pre-tokens of a batch
are sorted; walked in that order, the prefix that a word shares with the one before is the path
in their trie that both share, and its forward scores stand already. Only the rest of the word
is computed. The score of a prefix is the best sum of piece scores; of equal sums the one with
the longest last piece counts. The terminal count, the pieces of the best path, is kept per word.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from casewell.llm.common import Kept, runs, slim

MARK = "▁"
CACHED = 300_000


def load_pieces(path: str) -> dict[str, float]:
    """Pieces and scores of a sentencepiece model file, without control, unknown and byte pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return {
        model.id_to_piece(i): model.get_score(i)
        for i in range(model.get_piece_size())
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))
    }


def terminal_counts(words: list[str], pieces: Mapping[str, float], longest: int, unknown: float) -> list[int]:
    """Tokens of the best segmentation of each of the sorted, distinct `words`.

    A character that no piece ends at is one piece with the score `unknown` and counts as the
    bytes of its UTF-8 form.
    """
    best, count, before, out = [0.0], [0], "", []
    for word in words:
        shared, most = 0, min(len(word), len(before))
        while shared < most and word[shared] == before[shared]:
            shared += 1
        del best[shared + 1 :], count[shared + 1 :]
        for end in range(shared + 1, len(word) + 1):
            top = many = None
            for start in range(max(0, end - longest), end):
                score = pieces.get(word[start:end])
                if score is not None and (top is None or best[start] + score > top):
                    top, many = best[start] + score, count[start] + 1
            if word[end - 1] not in pieces and (top is None or best[end - 1] + unknown > top):
                top, many = best[end - 1] + unknown, count[end - 1] + len(word[end - 1].encode())
            best.append(top)
            count.append(many)
        out.append(count[-1])
        before = word
    return out


def token_counts(df: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`key`, `n_words`, `n_tokens` (bigint) of every row's whole text.

    Words are `[^\\x20\\x09-\\x0D]+`. Null, empty and blank texts have none. Counts of words are
    kept for the rest of the task, up to a bound. Repeated rows and null keys stay as they are.
    """
    kind = df.schema[key].dataType.simpleString()

    def task(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load_pieces(path)
        longest, unknown = max(map(len, pieces)), min(pieces.values()) - 10
        kept = Kept(CACHED)
        for frame in frames:
            for start, end, data, bounds in runs(frame.column(1), 1 << 22):
                raw = data.tobytes()
                texts = [raw[a:b].split() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
                # Byte order of UTF-8 is the order of code points.
                new = sorted(kept.missing(set().union(*texts)))
                cache = kept.new
                cache.update(zip(new, terminal_counts([MARK + w.decode() for w in new], pieces, longest, unknown), strict=True))
                sums = [sum([cache[w] for w in t]) for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [frame.column(0).slice(start, end - start), pa.array(np.asarray([len(t) for t in texts], np.int64)), pa.array(sums, pa.int64())],
                    names=[key, "n_words", "n_tokens"],
                )

    return slim(df, key, text).mapInArrow(task, f"`{key}` {kind}, n_words bigint, n_tokens bigint")
