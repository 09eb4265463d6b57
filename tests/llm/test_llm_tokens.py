"""Token operators against the tokenizers library, and exact round trips."""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer, models, pre_tokenizers

from casewell.llm import token_files as files
from casewell.llm import word_bpe
from casewell.llm.token_counts import load_pieces, terminal_counts, token_counts

WORD = public_tokenizers.path("word_bpe_49k.json")
BYTE = public_tokenizers.path("byte_bpe_50k.json")
PIECE = public_tokenizers.path("piece_bpe_32k.model")

TEXTS = [
    "Plain words, 12,345 numbers and don't, we'll, I'M!!",
    "mark <|endoftext|> inside<|startoftext|>ΣΑΣ  İstanbul",
    None,
    "",
    " \t\n ",
    "é é \x1c\x85 日本語 😀😀 aaaaaaaa....",
    "x  <|endoftext|>  y\n\n\nb \n c\t\td",
    "no break spaces \r\n end  ",
    "word " * 3000,
    "a" * 2000,
    "Plain words, 12,345 numbers and don't, we'll, I'M!!",
]


def frame(spark):
    rows = [(i, t, "extra") for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string")


def test_word_bpe_equals_library(spark):
    library = Tokenizer.from_file(WORD)
    rows = {r["doc_id"]: r for r in word_bpe.encode_texts(frame(spark), WORD).collect()}
    assert len(rows) == len(TEXTS)
    for i, text in enumerate(TEXTS):
        ids = library.encode(text or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        assert rows[i]["ids"] == ids and rows[i]["decoded"] == decoded and rows[i]["n_tokens"] == len(ids)
        assert rows[i]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert rows[i]["decoded_sha256"] == hashlib.sha256(decoded.encode()).hexdigest()


def test_word_bpe_decodes_ids(spark):
    library = Tokenizer.from_file(WORD)
    df = spark.createDataFrame([([320, 1929],), ([],), (None,)], "ids array<int>")
    found = [r["decoded"] for r in word_bpe.decode_ids(df, WORD).collect()]
    assert found == [library.decode([320, 1929], skip_special_tokens=False), "", None]


def test_word_bpe_of_random_strings():
    library, v = Tokenizer.from_file(WORD), word_bpe.load(WORD)
    draw = np.random.default_rng(3)
    letters = list("aabbeeiilmnorst'.,0179éñß#")
    for _ in range(200):
        text = "".join(draw.choice(letters, draw.integers(1, 30)))
        ids = word_bpe.encode_chunks([text.encode()], v)[0].tolist()
        assert ids == library.encode(text, add_special_tokens=False).ids


def test_no_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert word_bpe.bpe_digests(empty, WORD).count() == 0
    assert token_counts(empty, PIECE).count() == 0
    assert files.token_files(empty, BYTE).count() == 0


def test_token_files_read_back(spark):
    library = Tokenizer.from_file(BYTE)
    folder = files.token_folder(spark)
    manifest = files.write_token_files(frame(spark), folder, BYTE, 0, shard_bytes=5000)
    assert manifest.count() > 1
    rows = {r["key"]: r for r in files.read_token_files(manifest, folder).collect()}
    start = 0
    for i, text in enumerate(TEXTS):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        crc = zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))
        assert tuple(rows[i])[1:] == (start, len(ids), crc)
        start += len(ids)
    wanted = spark.createDataFrame([(0,), (6,), (99,), (None,)], "doc_id long")
    got = {r["key"]: r["ids"] for r in files.fetch(manifest, folder, wanted).collect()}
    assert got[99] is None and got[None] is None
    assert got[6] == [*library.encode(TEXTS[6], add_special_tokens=False).ids, 0]


def test_token_files_with_null_and_repeated_keys(spark):
    rows = [(None, "one"), (5, "two"), (5, "two words"), (None, None), (-3, "three")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = [tuple(r) for r in files.token_files(df, BYTE).collect()]
    assert sorted(k for k, *_ in found if k is not None) == [-3, 5, 5]
    by_start = sorted(found, key=lambda r: r[1])
    assert [r[0] for r in by_start][:2] == [None, None]
    assert all(a[1] + a[2] == b[1] for a, b in zip(by_start, by_start[1:], strict=False))


def test_perfect_hash_is_minimal():
    keys = np.unique(np.random.default_rng(1).integers(-(1 << 62), 1 << 62, 20_000))
    index = files.make_index(keys, np.zeros(len(keys), bool), np.ones(len(keys), np.int64))
    assert sorted(files.slots(keys, index).tolist()) == list(range(len(keys)))
    start, count = files.find(keys, index)
    assert start.tolist() == list(range(len(keys))) and set(count.tolist()) == {1}
    others = keys[:-1] + 1
    others = others[~np.isin(others, keys)]
    assert (files.slots(others, index) >= 0).mean() < 1e-3


def best_count(word, pieces, unknown):
    """Every segmentation by plain recursion over ends."""
    best = [(0.0, 0)]
    for end in range(1, len(word) + 1):
        top = None
        for start in range(end):
            piece = word[start:end]
            if piece in pieces:
                step = (pieces[piece], 1)
            elif end - start == 1:
                step = (unknown, len(piece.encode()))
            else:
                continue
            score = (best[start][0] + step[0], best[start][1] + step[1])
            if top is None or score[0] > top[0]:
                top = score
        best.append(top)
    return best[-1][1]


def test_trie_counts_equal_plain_ones():
    pieces = load_pieces(PIECE)
    longest, unknown = max(map(len, pieces)), min(pieces.values()) - 10
    words = sorted({"▁" + w for t in TEXTS if t for w in t.split() if len(w) < 60})
    assert terminal_counts(words, pieces, longest, unknown) == [best_count(w, pieces, unknown) for w in words]


def test_trie_counts_equal_library():
    pieces = load_pieces(PIECE)
    longest, unknown = max(map(len, pieces)), min(pieces.values()) - 10
    library = Tokenizer(models.Unigram([("<unk>", 0.0), *pieces.items()], 0, False))
    library.pre_tokenizer = pre_tokenizers.Metaspace(prepend_scheme="always", split=True)
    words = sorted({"▁" + w for w in "the cat sat on a mat with international nationalities and thoroughness".split()})
    assert terminal_counts(words, pieces, longest, unknown) == [len(library.encode(w[1:]).ids) for w in words]


def test_token_counts_of_rows(spark):
    rows = {r["doc_id"]: (r["n_words"], r["n_tokens"]) for r in token_counts(frame(spark), PIECE).collect()}
    assert rows[2] == rows[3] == rows[4] == (0, 0) and rows[0] == rows[10]
    assert rows[8][0] == 3000 and rows[8][1] == 3000 * rows[8][1] // 3000


def test_pieces_equal_whole_texts_of_random_strings():
    """Cuts between pieces never change the ids, whatever stands at them."""
    rng = np.random.default_rng(5)
    alphabet = ["a", "b", "the", " ", " ", "  ", "\n", "\n\n", "\t", " \n", "\r\n", ",", ".", "...", "!?", "'s", "'ll", "é", "日", "1", "23", "$", "%%"]
    alphabet += ["&", "*", "_", "-", "<|endoftext|>", "\xa0", "\x1c", "😀", "\x0b", "\x0c", "\x00", "\x7f", " .", "A.", "\u2003"]
    texts = ["".join(rng.choice(alphabet, rng.integers(0, 25))) for _ in range(5000)]
    library, data = Tokenizer.from_file(BYTE), np.frombuffer("".join(texts).encode(), np.uint8)
    bounds = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    whole = np.asarray([bool(files._ODD_SPACE.search(t)) for t in texts])
    kept = files.Pieces(library)
    assert kept.safe
    for _ in range(2):  # new pieces, and kept ones
        ids, first = kept.rows(data, bounds, whole, 0)
        for i, text in enumerate(texts):
            assert ids[first[i] : first[i + 1]].tolist() == [*library.encode(text, add_special_tokens=False).ids, 0], text


def test_kept_pieces_are_bounded(monkeypatch):
    monkeypatch.setattr(files, "CACHED_PIECES", 10)
    kept = files.Pieces(Tokenizer.from_file(BYTE))
    data = np.frombuffer(" ".join(f"w{i}" for i in range(40)).encode(), np.uint8)
    bounds = np.asarray([0, len(data)])
    found = [kept.rows(data, bounds, np.zeros(1, bool), 0)[0].tolist() for _ in range(3)]
    assert found[0] == found[1] == found[2] and len(kept.hashes) == 40


def test_tokenizers_of_another_form_encode_whole_texts(spark, tmp_path):
    """A file whose pattern or added tokens forbid the cuts is told, not encoded wrongly."""
    library = Tokenizer.from_file(BYTE)
    library.add_tokens(["b c"])
    path = str(tmp_path / "own.json")
    library.save(path)
    assert not files.splits_safely(Tokenizer.from_file(path)) and not files.splits_safely(Tokenizer.from_file(WORD))
    df = spark.createDataFrame([(1, "a b c d"), (2, None)], "doc_id long, text string")
    rows = {r["doc_id"]: np.frombuffer(r["ids"], "<u2").tolist() for r in files.encoded(df, path, 0, "doc_id", "text").collect()}
    assert rows == {1: [*library.encode("a b c d", add_special_tokens=False).ids, 0], 2: [0]}


def test_shards_are_read_by_tasks_of_their_own(spark):
    df = spark.range(400).selectExpr("id AS doc_id", "repeat(concat('word ', id), 20) AS text")
    folder = files.token_folder(spark)
    manifest = files.write_token_files(df, folder, BYTE, 0, shard_bytes=8000)
    many = manifest.count()
    from pyspark.sql import functions as F

    tasks = files.read_token_files(manifest, folder).select(F.spark_partition_id().alias("t")).distinct().count()
    assert many > 4 and tasks == many
