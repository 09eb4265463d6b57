"""Token-id files with a minimal perfect hash index from document keys to offsets.

A folder holds shards of consecutive keys. `shard-N.ids` is the raw payload: ids of its documents
one after another, little-endian, 2 bytes each if the vocabulary allows it, else 4. `shard-N.idx`
holds the keys in order with start and count of each, and the index: bits and ranks of a minimal
perfect hash in levels, and per slot the key's 32-bit fingerprint, start and count. A key is
found by a few probes, whatever the size. Both are written under another name and then moved, so
a task that runs twice leaves one whole file.
"""

from __future__ import annotations

import io
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from casewell.llm.common import BLANK, held, mix, runs, slim
from casewell.llm.word_bpe import byte_chars
from casewell.session import stage, staging_root

# Pieces and ids that a Python worker keeps for its later tasks.
CACHED_PIECES, CACHED_IDS = 2_000_000, 16_000_000
GAMMA = 2
_ODD_SPACE = re.compile(r"[\x1c-\x1f\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_MARK = np.zeros(256, bool)
_MARK[list(b".,;:!?#$%&*")] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
# A space or none and Latin letters: one pre-token whatever the version of the letter tables.
_WORD = re.compile("[ ]?[A-Za-zÀ-ÖØ-öø-ɏ]+")
_SHOWN = dict(enumerate(byte_chars()))
_BYTE = np.random.default_rng(10).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def cuts(data: np.ndarray, bounds: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """Bytes at which the pieces of texts begin: no token of the pattern crosses the place before
    a run of blanks, behind a single line end, or between a last ASCII letter and the marks up to
    the next blank. Texts marked `whole` are one piece. An empty text has none."""
    n = len(data)
    blank = BLANK[data]
    before = np.concatenate([[False], blank[:-1]]) if n else blank
    first = np.zeros(n + 1, bool)
    first[bounds[:-1]] = True
    first[n] = True
    after_text = first[1:]  # the byte is its text's last one
    begin = first[:-1] | (blank & ~before)
    next_blank = np.append(blank[1:], True) | after_text
    # A line end that stands alone before a word.
    line = begin & (data == 10) & ~next_blank
    begin[1:] |= line[:-1]
    # Marks from a letter to the end of a word: the last byte that is no mark, at every word's end.
    place = np.maximum.accumulate(np.where(_MARK[data], 0, np.arange(n))) if n else np.zeros(0, np.int64)
    ends = np.flatnonzero(_MARK[data] & next_blank)
    last = place[ends]
    good = _LETTER[data[last]]
    # The letter must be of the same text.
    text = np.cumsum(first[:-1])
    good &= text[last] == text[ends]
    begin[last[good] + 1] = True
    if whole.any():
        inside = np.zeros(n + 1, np.int64)
        np.add.at(inside, bounds[:-1][whole], 1)
        np.add.at(inside, bounds[1:][whole], -1)
        begin &= ~((np.cumsum(inside)[:-1] > 0) & ~first[:-1])
    return np.flatnonzero(begin)


def piece_hashes(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """64-bit hash of each piece, of all its bytes."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    sizes = np.diff(np.append(starts, len(data)))
    place = np.arange(len(data)) - np.repeat(starts, sizes)
    powers = np.full(int(sizes.max()) + 1, _STEP)
    powers[0] = 1
    powers = np.multiply.accumulate(powers)
    return mix(np.add.reduceat(_BYTE[data] * powers[place], starts))


def splits_safely(tokenizer) -> bool:
    """Whether a tokenizer's file has the form for which texts may be cut: bytes without a
    normalizer or a space in front, the usual pattern, and added tokens without blanks or letters
    and marks at which a cut could fall."""
    parts = json.loads(tokenizer.to_str())
    split = parts.get("pre_tokenizer") or {}
    plain = parts.get("normalizer") is None and parts["model"].get("type") == "BPE" and not parts["model"].get("dropout")
    plain = plain and not parts["model"].get("ignore_merges") and not any(parts["model"].get(k) for k in ("continuing_subword_prefix", "end_of_word_suffix"))
    usual = split.get("type") == "ByteLevel" and not split.get("add_prefix_space", True) and split.get("use_regex", True)
    added = parts.get("added_tokens") or []
    calm = not any(t.get(k) for t in added for k in ("lstrip", "rstrip", "single_word", "normalized"))
    return plain and usual and calm and not any(re.search(r"\s|[A-Za-z][.,;:!?#$%&*]", t["content"]) or _WORD.fullmatch(t["content"]) for t in added)


class Pieces:
    """Ids of pieces by hash, in flat arrays, kept until a bound is met."""

    def __init__(self, tokenizer):
        self.tokenizer, self.model, self.safe = tokenizer, tokenizer.model, splits_safely(tokenizer)
        self.kind = np.dtype("<u2" if tokenizer.get_vocab_size(True) <= 1 << 16 else "<u4")
        self.clear()

    def clear(self) -> None:
        self.hashes, self.slot = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.ids, self.first, self.used = np.zeros(1 << 16, self.kind), np.zeros(1, np.int64), 0

    def encode(self, pieces: list[str]) -> list[list[int]]:
        """Single words go to the library's model at once, all other pieces to its whole chain."""
        out: list = [None] * len(pieces)
        other = []
        for i, piece in enumerate(pieces):
            if self.safe and _WORD.fullmatch(piece):
                out[i] = [t.id for t in self.model.tokenize(piece.encode().decode("latin-1").translate(_SHOWN))]
            else:
                other.append(i)
        found = self.tokenizer.encode_batch_fast([pieces[i] for i in other], add_special_tokens=False)
        for i, e in zip(other, found, strict=True):
            out[i] = e.ids
        return out

    def slots(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Slot of each piece; new ones are encoded, each distinct one once."""
        if len(self.hashes) > CACHED_PIECES or self.used > CACHED_IDS:
            self.clear()
        hashes, one, place = np.unique(piece_hashes(data, starts), return_index=True, return_inverse=True)
        at = np.searchsorted(self.hashes, hashes)
        known = np.append(self.hashes, np.uint64(0))[at] == hashes
        known &= at < len(self.hashes)
        new = np.flatnonzero(~known)
        if len(new):
            ends = np.append(starts[1:], len(data))
            raw, own = data.tobytes(), one[new]
            rows = self.encode([raw[a:b].decode() for a, b in zip(starts[own].tolist(), ends[own].tolist(), strict=True)])
            sizes = np.fromiter(map(len, rows), np.int64, len(rows))
            flat = np.fromiter(chain.from_iterable(rows), self.kind, int(sizes.sum()))
            if self.used + len(flat) > len(self.ids):
                self.ids = np.concatenate([self.ids[: self.used], flat, np.zeros(self.used + len(flat), self.kind)])
            self.ids[self.used : self.used + len(flat)] = flat
            slots = len(self.first) - 1 + np.arange(len(new))
            self.first = np.concatenate([self.first, self.used + np.cumsum(sizes)])
            self.used += len(flat)
            self.hashes, self.slot = np.insert(self.hashes, at[new], hashes[new]), np.insert(self.slot, at[new], slots)
            at = np.searchsorted(self.hashes, hashes)
        return self.slot[at][place] if len(place) else np.zeros(0, np.int64)

    def rows(self, data: np.ndarray, bounds: np.ndarray, whole: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts with `end` behind each, where each text's begin, with the end)."""
        starts = cuts(data, bounds, whole)
        slot = self.slots(data, starts)
        counts = self.first[slot + 1] - self.first[slot]
        total = np.concatenate([[0], np.cumsum(counts)])
        at = np.repeat(self.first[slot] - total[:-1], counts) + np.arange(total[-1])
        text_end = total[np.searchsorted(starts, bounds[1:])]
        ids = np.insert(self.ids[at], text_end, end)
        return ids, np.concatenate([[0], text_end + np.arange(1, len(bounds))])


def _level(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    return (mix(keys ^ mix(np.full(1, level + 1, np.uint64))) % np.uint64(size)).astype(np.int64)


def build_hash(keys: np.ndarray) -> dict[str, np.ndarray]:
    """Minimal perfect hash of distinct 64-bit keys: level by level, keys alone at their bit
    stay there and the others go on."""
    left, sizes, bits = keys.view(np.uint64), [], []
    while len(left):
        size = (GAMMA * len(left) + 63) // 64 * 64
        at = _level(left, len(sizes), size)
        alone = np.bincount(at, minlength=size) == 1
        sizes.append(size)
        bits.append(alone)
        left = left[~alone[at]]
    flags = np.concatenate(bits) if bits else np.zeros(0, bool)
    words = np.packbits(flags, bitorder="little").view(np.uint64)
    ranks = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)[:-1]]) if len(words) else np.zeros(0, np.int64)
    return {"sizes": np.asarray(sizes, np.int64), "words": words, "ranks": ranks}


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (mix(keys.view(np.uint64) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(32)).astype(np.uint32)


def slots(keys: np.ndarray, index: dict[str, np.ndarray]) -> np.ndarray:
    """Slot of each key, -1 where the index says that it has none."""
    out = np.full(len(keys), -1, np.int64)
    todo, base = np.arange(len(keys)), 0
    for level, size in enumerate(index["sizes"].tolist()):
        at = base + _level(keys[todo].view(np.uint64), level, size)
        word, bit = index["words"][at >> 6], (at & 63).astype(np.uint64)
        hit = (word >> bit) & np.uint64(1) == 1
        below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1)))
        out[todo[hit]] = index["ranks"][at[hit] >> 6] + below[hit]
        todo, base = todo[~hit], base + size
    if "prints" in index and len(index["prints"]):
        out[(out >= 0) & (index["prints"][np.maximum(out, 0)] != fingerprints(keys))] = -1
    return out


def find(keys: np.ndarray, index: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(start, count) of each key; -1 for keys that are not in the shard."""
    at = slots(keys, index)
    start, count = (np.append(index[c], -1)[at] for c in ("slot_start", "slot_count"))
    return start, count


def make_index(keys: np.ndarray, null: np.ndarray, counts: np.ndarray) -> dict[str, np.ndarray]:
    """Index of a shard; of rows with one key the first is indexed, rows without a key are not."""
    starts = np.cumsum(counts) - counts
    rows = np.flatnonzero(~null)
    own, first = np.unique(keys[rows], return_index=True)
    index = build_hash(own)
    at, rows = slots(own, index), rows[first]
    prints, start, count = np.zeros(len(own), np.uint32), np.zeros(len(own), np.int64), np.zeros(len(own), np.int64)
    prints[at], start[at], count[at] = fingerprints(own), starts[rows], counts[rows]
    return {**index, "prints": prints, "slot_start": start, "slot_count": count, "keys": keys, "null": null, "starts": starts, "counts": counts}


def _place(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def _save(fs: pafs.FileSystem, path: str, data: bytes) -> None:
    own = f"{path}.{uuid.uuid4().hex}"
    with fs.open_output_stream(own) as out:
        out.write(data)
    fs.move(own, path)


def _tokenizer(path: str):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def encoded(df: DataFrame, path: str, end: int, key: str, text: str) -> DataFrame:
    """`key`, `ids` (binary) and `width` of every whole text, the id `end` appended; null is empty.

    Texts are cut where no token can cross, and the tokenizers library encodes each distinct new
    piece once; ids are gathered by piece. Texts with other white space than ASCII's, and all texts
    where the tokenizer's file is of another form, are encoded whole. Pieces stay in the Python
    worker, up to a bound, for its later tasks too.
    """
    kind = df.schema[key].dataType.simpleString()

    def task(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        kept = held("token_files", path, lambda: Pieces(_tokenizer(path)))
        for frame in frames:
            for start, last, data, bounds in runs(frame.column(1)):
                raw, n = data.tobytes(), last - start
                edges = bounds.tolist()
                whole = np.ones(n, bool)
                if kept.safe:
                    odd = not raw.isascii() or any(c in raw for c in (b"\x1c", b"\x1d", b"\x1e", b"\x1f"))
                    whole = np.asarray([odd and bool(_ODD_SPACE.search(raw[a:b].decode())) for a, b in zip(edges[:-1], edges[1:], strict=True)], bool)
                ids, first = kept.rows(data, bounds, whole, end)
                offsets = pa.array(first * kept.kind.itemsize, pa.int64())
                rows = pa.Array.from_buffers(pa.large_binary(), n, [None, offsets.buffers()[1], pa.py_buffer(ids.tobytes())])
                yield pa.RecordBatch.from_arrays(
                    [frame.column(0).slice(start, n), rows.cast(pa.binary()), pa.array(np.full(n, kept.kind.itemsize, np.int32))],
                    names=[key, "ids", "width"],
                )

    return slim(df, key, text).mapInArrow(task, f"`{key}` {kind}, ids binary, width int")


def _write_shards(folder: str):
    def task(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _place(folder)
        now, out, own, keys, null, sizes, width = None, None, "", [], [], [], 2
        written = []

        def close() -> None:
            nonlocal out
            out.close()
            fs.move(own, f"{root}/shard-{now}.ids")
            counts = np.asarray(sizes, np.int64) // width
            index = make_index(np.asarray(keys, np.int64), np.asarray(null, bool), counts)
            buffer = io.BytesIO()
            np.savez(buffer, width=np.asarray(width), **index)
            _save(fs, f"{root}/shard-{now}.idx", buffer.getvalue())
            written.append((now, len(keys), int(counts.sum())))
            out = None

        for frame in frames:
            for shard, key, ids, width_ in zip(*(frame.column(i) for i in range(4)), strict=True):
                if shard.as_py() != now:
                    if out is not None:
                        close()
                    now, keys, null, sizes = shard.as_py(), [], [], []
                    own = f"{root}/shard-{now}.ids.{uuid.uuid4().hex}"
                    out = fs.open_output_stream(own)
                width = width_.as_py()
                out.write(ids.as_buffer())
                null.append(not key.is_valid)
                keys.append(key.as_py() or 0)
                sizes.append(ids.as_buffer().size)
        if out is not None:
            close()
        columns = list(zip(*written, strict=True)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["shard", "n_docs", "n_tokens"])

    return task


def write_token_files(
    df: DataFrame, folder: str, path: str, end: int, key: str = "doc_id", text: str = "text", shard_bytes: int = 32 << 20
) -> DataFrame:
    """Encode, write the shards of ascending keys to `folder` (a URI that all machines share), and
    return the manifest: shard, low (key from which it holds), n_docs, n_tokens, start.

    The key is an integer; rows without one come first, rows that share one lie together. Shard
    limits are quantiles of the keys, so that about `shard_bytes` of text come to a shard; only
    these limits and one row per shard reach the driver.
    """
    spark = df.sparkSession
    size = df.agg(F.coalesce(F.sum(F.octet_length(df[text])), F.lit(0))).first()[0]
    many = max(1, -(-size // shard_bytes))
    limits: list[int] = []
    if many > 1:
        shares = F.array(*[F.lit(i / many) for i in range(1, many)])
        found = df.select(df[key].cast("bigint").alias("k")).agg(F.percentile_approx("k", shares, F.lit(100 * many))).first()[0]
        limits = sorted(set(found or []))
    # Number of limits at or below the key; a null key belongs to the first shard.
    shard = _bucket(key, limits)
    rows = encoded(df.select(df[key].cast("bigint").alias(key), df[text]), path, end, key, text)
    dealt = rows.withColumn("_shard", shard.cast("int")).repartitionById(len(limits) + 1, F.col("_shard"))
    fs, root = _place(folder)
    fs.create_dir(root, recursive=True)
    ordered = dealt.sortWithinPartitions("_shard", F.col(key).asc_nulls_first(), "ids").select("_shard", key, "ids", "width")
    written = stage(ordered.mapInArrow(_write_shards(folder), "shard bigint, n_docs bigint, n_tokens bigint"), "shards")
    low = spark.createDataFrame([(i + 1, int(v)) for i, v in enumerate(limits)], "shard bigint, low bigint")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return stage(
        written.join(low, "shard", "left").withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0))), "manifest"
    )


def _bucket(key: str, limits: list[int]) -> Column:
    """Number of limits at or below the key, found by halves."""

    def within(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(F.col(key) < F.lit(limits[middle]), within(low, middle)).otherwise(within(middle + 1, high))

    return F.when(F.col(key).isNull(), F.lit(0)).otherwise(within(0, len(limits)))


def _index(fs: pafs.FileSystem, path: str) -> dict[str, np.ndarray]:
    with fs.open_input_file(path) as file:
        return dict(np.load(io.BytesIO(file.read())))


def read_token_files(manifest: DataFrame, folder: str) -> DataFrame:
    """doc key, start, n_tokens, ids_crc32 of every document in the files, found through the index.

    `start` counts the ids of all documents before it. Every shard is read by a task of its own,
    document by document.
    """

    def task(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _place(folder)
        for frame in frames:
            for shard, offset in zip(frame.column(0).to_pylist(), frame.column(1).to_pylist(), strict=True):
                index = _index(fs, f"{root}/shard-{shard}.idx")
                width = int(index["width"])
                keys, null = index["keys"], index["null"]
                start, count = find(keys, index)
                # A later row of a key, or one without a key, is not in the index.
                _, first = np.unique(np.where(null, -1, keys), return_index=True)
                other = np.ones(len(keys), bool)
                other[first] = False
                other |= null
                start[other], count[other] = index["starts"][other], index["counts"][other]
                sums = []
                with fs.open_input_file(f"{root}/shard-{shard}.ids") as file:
                    for at, n in zip(start.tolist(), count.tolist(), strict=True):
                        ids = np.frombuffer(file.read_at(n * width, at * width), f"<u{width}")
                        sums.append(zlib.crc32(ids.astype("<u4").tobytes()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys, mask=null), pa.array(start + offset), pa.array(count), pa.array(sums, pa.int64())],
                    names=["key", "start", "n_tokens", "ids_crc32"],
                )

    # A task a shard, as far as there are cores: AQE merges no partitions that are counted out.
    many = max(1, manifest.count())
    places = manifest.select("shard", "start", (F.row_number().over(Window.orderBy("shard")) - 1).cast("int").alias("place"))
    rows = places.repartitionById(many, F.col("place")).select("shard", "start")
    return rows.mapInArrow(task, "key bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def fetch(manifest: DataFrame, folder: str, wanted: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, ids) of the wanted keys by the index alone; keys that no shard holds give null ids."""
    shards = [(r["shard"], r["low"]) for r in manifest.orderBy("shard").collect()]
    lows = np.asarray([r[1] for r in shards[1:]], np.int64)

    def task(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _place(folder)
        held: tuple[int, dict[str, np.ndarray]] | None = None
        for frame in frames:
            keys = frame.column(0).to_pylist()
            out: list[list[int] | None] = [None] * len(keys)
            places = [-1 if k is None else int(np.searchsorted(lows, k, "right")) for k in keys]
            for at in sorted(range(len(keys)), key=lambda i: places[i]):
                if places[at] < 0:
                    continue
                name = shards[places[at]][0]
                if held is None or held[0] != name:
                    held = (name, _index(fs, f"{root}/shard-{name}.idx"))
                start, count = find(np.asarray([keys[at]], np.int64), held[1])
                if start[0] >= 0:
                    width = int(held[1]["width"])
                    with fs.open_input_file(f"{root}/shard-{name}.ids") as file:
                        raw = file.read_at(int(count[0]) * width, int(start[0]) * width)
                    out[at] = np.frombuffer(raw, f"<u{width}").tolist()
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(out, pa.list_(pa.int64()))], names=["key", "ids"])

    return wanted.select(wanted[key].cast("bigint").alias("key")).mapInArrow(task, "key bigint, ids array<bigint>")


def token_folder(spark: SparkSession) -> str:
    return f"{staging_root(spark)}/tokens-{uuid.uuid4().hex}"


def token_files(df: DataFrame, path: str, end: int = 0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Write the files, read them back: one row per document, null and repeated keys too."""
    folder = token_folder(df.sparkSession)
    manifest = write_token_files(df, folder, path, end, key, text)
    return read_token_files(manifest, folder).withColumnRenamed("key", key)
