"""BPE encoding and decoding by batched merge rounds in numpy, for word-end vocabularies.

Texts fall into chunks at ASCII white space. Chunks new to a task are normalised and cut into
pre-tokens; the symbols of all their pre-tokens lie in one flat array. In each round every
pre-token's lowest-ranked pair, found by binary search over the sorted pair keys, is merged
wherever it stands in it; a pre-token without a pair is done. Results are kept per chunk for
the rest of the task, up to a bound.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewell.llm.common import Kept, runs, slim

NO_PAIR = np.iinfo(np.int64).max
CACHED = 200_000


def byte_chars() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


@dataclass
class Vocabulary:
    tokens: dict[int, str]
    inner: np.ndarray
    final: np.ndarray
    pairs: np.ndarray
    ranks: np.ndarray
    merged: np.ndarray
    special: dict[str, int]
    cut: regex.Pattern | None
    pattern: regex.Pattern
    base: int


def load(path: str) -> Vocabulary:
    with open(path, encoding="utf-8") as file:
        data = json.load(file)
    vocab, suffix = data["model"]["vocab"], data["model"]["end_of_word_suffix"] or ""
    special = {t["content"]: t["id"] for t in data["added_tokens"]}
    base = max([*vocab.values(), *special.values()]) + 1
    rows = []
    for rank, (left, right) in enumerate(data["model"]["merges"]):
        rows.append((vocab[left] * base + vocab[right], rank, vocab[left + right]))
    table = np.asarray(sorted(rows), np.int64)
    chars = byte_chars()
    split = next(p for p in data["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
    return Vocabulary(
        {**{i: t for t, i in vocab.items()}, **{i: t for t, i in special.items()}},
        np.asarray([vocab.get(c, -1) for c in chars]),
        np.asarray([vocab.get(c + suffix, -1) for c in chars]),
        *table.T.copy(),
        special,
        regex.compile("(" + "|".join(map(regex.escape, special)) + ")") if special else None,
        regex.compile(split["pattern"]["Regex"].replace(r"\s", r"\p{White_Space}")),
        base,
    )


def merge_rounds(pretokens: list[bytes], v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all pre-tokens in order, bounds of each)."""
    sizes = np.asarray([len(p) for p in pretokens], np.int64)
    raw = np.frombuffer(b"".join(pretokens), np.uint8)
    symbols = v.inner[raw].astype(np.int64)
    last = np.cumsum(sizes) - 1
    symbols[last] = v.final[raw[last]]
    owner = np.repeat(np.arange(len(sizes)), sizes)
    owner, symbols = owner[symbols >= 0], symbols[symbols >= 0]  # bytes that the vocabulary lacks
    done: list[tuple[np.ndarray, np.ndarray]] = []
    while len(symbols):
        rank = np.full(len(symbols), NO_PAIR)
        key = symbols[:-1] * v.base + symbols[1:]
        at = np.minimum(np.searchsorted(v.pairs, key), len(v.pairs) - 1)
        hit = (v.pairs[at] == key) & (owner[:-1] == owner[1:])
        rank[:-1][hit] = v.ranks[at[hit]]
        starts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        best = np.minimum.reduceat(rank, starts)
        lengths = np.diff(np.append(starts, len(symbols)))
        open_ = np.repeat(best < NO_PAIR, lengths)
        done.append((owner[~open_], symbols[~open_]))
        chosen = (rank == np.repeat(best, lengths)) & (rank < NO_PAIR)
        # Of overlapping pairs (a a a) the first, third, … are merged.
        index = np.arange(len(symbols))
        begin = chosen & ~np.concatenate([[False], chosen[:-1]])
        chosen &= (index - np.maximum.accumulate(np.where(begin, index, 0))) % 2 == 0
        symbols[chosen] = v.merged[at[chosen[:-1]]]
        open_[1:] &= ~chosen[:-1]
        owner, symbols = owner[open_], symbols[open_]
    owners = np.concatenate([d[0] for d in done]) if done else owner
    order = np.argsort(owners, kind="stable")
    ids = np.concatenate([d[1] for d in done])[order] if done else symbols
    return ids, np.searchsorted(owners[order], np.arange(len(sizes) + 1))


def pretokenize(chunk: str, v: Vocabulary) -> list[bytes | int]:
    """Pre-tokens of a chunk as bytes, special tokens as ids."""
    out: list[bytes | int] = []
    for part in v.cut.split(chunk) if v.cut else [chunk]:
        if part in v.special:
            out.append(v.special[part])
            continue
        # Every letter is lower-cased by itself, so no sigma becomes a final one.
        text = part if part.isascii() else unicodedata.normalize("NFC", part).replace("Σ", "σ")
        out += [p.encode() for p in v.pattern.findall(text.lower())]
    return out


def encode_chunks(chunks: list[bytes], v: Vocabulary) -> list[np.ndarray]:
    """Ids of each chunk."""
    cut = [pretokenize(c.decode(), v) for c in chunks]
    known: dict[bytes, int] = {}
    for parts in cut:
        for p in parts:
            if isinstance(p, bytes):
                known.setdefault(p, len(known))
    ids, bounds = merge_rounds(list(known), v)
    one = lambda p: ids[bounds[known[p]] : bounds[known[p] + 1]] if isinstance(p, bytes) else np.asarray([p])
    return [np.concatenate([one(p) for p in parts]) if parts else ids[:0] for parts in cut]


def decode(ids: np.ndarray, v: Vocabulary) -> str:
    """Tokens of the ids, with a blank between: the vocabulary names no decoder."""
    return " ".join([v.tokens[i] for i in ids.tolist()])


def encode_texts(df: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`key`, `ids` (array of int), `decoded`, and the two digests of every whole text.

    Null is encoded as an empty text: no ids, an empty decoded text. The vocabulary file lies
    at `path` on every machine. Rows keep their keys, null and repeated ones too.
    """
    return _encoded(df, path, key, text, True)


def _encoded(df: DataFrame, path: str, key: str, text: str, whole: bool) -> DataFrame:
    kind = df.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if whole else "")

    def task(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = load(path)
        kept = Kept(CACHED)
        for frame in frames:
            for start, end, data, bounds in runs(frame.column(1)):
                raw = data.tobytes()
                texts = [raw[a:b].split() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
                new = kept.missing(set().union(*texts))
                cache = kept.new
                for chunk, ids in zip(new, encode_chunks(new, v), strict=True):
                    cache[chunk] = (len(ids), " ".join(map(str, ids.tolist())), decode(ids, v))
                counts, shas, decoded, listed, joined = [], [], [], [], []
                for chunks in texts:
                    found = [cache[c] for c in chunks]
                    numbers = " ".join([f[1] for f in found if f[0]])
                    words = " ".join([f[2] for f in found if f[0]])
                    counts.append(sum([f[0] for f in found]))
                    shas.append(hashlib.sha256(numbers.encode()).hexdigest())
                    decoded.append(hashlib.sha256(words.encode()).hexdigest())
                    if whole:
                        listed.append(np.asarray(numbers.split(), np.int32))
                        joined.append(words)
                columns = [frame.column(0).slice(start, end - start), pa.array(counts, pa.int64()), pa.array(shas, pa.string()), pa.array(decoded, pa.string())]
                names = [key, "n_tokens", "ids_sha256", "decoded_sha256"]
                if whole:
                    columns += [pa.array(listed, pa.list_(pa.int32())), pa.array(joined, pa.string())]
                    names += ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return slim(df, key, text).mapInArrow(task, schema)


def decode_ids(df: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Add the decoded text of a column of ids; null ids give null."""
    at = df.columns.index(ids)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)

    def task(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = load(path)
        for frame in frames:
            texts = [None if x is None else decode(np.asarray(x, np.int64), v) for x in frame.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*frame.columns, pa.array(texts, pa.string())], names=[*frame.schema.names, out])

    return df.mapInArrow(task, f"{schema}, `{out}` string")


def bpe_digests(df: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`key`, `n_tokens`, `ids_sha256`, `decoded_sha256` of `encode_texts`, without the texts."""
    return _encoded(df, path, key, text, False).select(key, F.col("n_tokens"), "ids_sha256", "decoded_sha256")
