from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from forgemart.llm import token_counts, token_store

PIECES = public_tokenizers.path("piece_bpe_32k.model")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
PARTS = [*"ab1é日😀▁", " ", "  ", " x", " the", "\n", "\r\n", "\t", "'s", " don't", ",", "!'t", "<s>", "<|endoftext|>", "|>", "\xa0", "ā"]


def texts(seed, n=300, most=80):
    draw = random.Random(seed)
    common = [p for p in PARTS if p.isascii()]
    found = ["".join(draw.choice(draw.choice((PARTS, common))) for _ in range(draw.randint(0, most))) for _ in range(n)]
    return [*found, "", "x" * 500, "the " * 100 + " " * 300 + "ab", "one two. " * 200]


@pytest.mark.parametrize(("chunk", "overlap"), [(40, 4), (300, 16), (1 << 15, 1 << 9)])
def test_spliced_counts_are_whole_counts(chunk, overlap):
    whole = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    with open(PIECES, "rb") as file:
        model = file.read()
    for text in texts(1):
        assert token_counts.count_tokens(model, text.encode(), chunk, overlap) == len(whole.encode(text)), text


def test_counts_of_rows(spark):
    whole = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    rows = [(i, t, 7) for i, t in enumerate(texts(2, 60))] + [(900, None, 7), (901, "word " * 20_000, 7), (None, "a b", 7), (1, "again", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    found = sorted(tuple(r) for r in token_counts.token_counts(docs, PIECES, limit=50).fillna({"doc_id": -1}).collect())
    expected = [(-1 if i is None else i, len((t or "").encode()), n := len(whole.encode(t or "")), n > 50) for i, t, _ in rows]
    assert found == sorted(expected)
    assert token_counts.token_counts(docs.limit(0), PIECES).count() == 0


def test_encoder_equals_the_library(monkeypatch):
    monkeypatch.setattr(token_store, "MEMO", 50)
    encoder = token_store.Encoder(open(BYTES, encoding="utf-8").read())
    library = Tokenizer.from_file(BYTES)
    for seed in range(4):
        some = texts(seed, 400)
        found = [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(some)]
        assert found == [library.encode(t, add_special_tokens=False).ids for t in some]


def test_long_pieces_are_not_kept():
    encoder = token_store.Encoder(open(BYTES, encoding="utf-8").read())
    library = Tokenizer.from_file(BYTES)
    some = ["abc" * 40 + " word " + "abc" * 40, "7" * 90 + " word", "word"]
    assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(some)] == [library.encode(t).ids for t in some]
    assert max(map(len, encoder.memo)) <= token_store.MEMO_CHARS
    assert " word" in encoder.memo


def test_dictionary_is_trained_on_stretches_of_whole_arrays(spark, monkeypatch):
    """Stretches lie anywhere in the arrays and don't depend on partitions."""
    library, seen = Tokenizer.from_file(BYTES), []

    class Trained:
        def as_bytes(self):
            return b"".join(seen[-1])

    with monkeypatch.context() as patch:
        patch.setattr(token_store.zstandard, "train_dictionary", lambda size, samples: seen.append(samples) or Trained())
        rows = [(i % 70, " ".join(f"w{i} {k}" for k in range(i))) for i in range(100)] + [(None, "no id"), (None, "no id"), (3, None)]
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        model = open(BYTES, encoding="utf-8").read()
        first = token_store.train_dictionary(docs.repartition(3), model, 2, sample=60, sample_ids=20)
        assert first == token_store.train_dictionary(docs.repartition(5), model, 2, sample=60, sample_ids=20)
    arrays = [[*library.encode(t or "").ids, 2] for _, t in rows]
    begins = []
    for stretch in map(token_store.deserialize, seen[0]):
        n = len(stretch)
        at = [i for a in arrays for i in range(len(a) - n + 1) if n == min(len(a), 20) and a[i : i + n] == stretch.tolist()]
        assert at
        begins.append(min(at))
    assert len(begins) == 60
    assert sum(b > 20 for b in begins) > 20
    assert token_store.train_dictionary(docs.limit(0), model, 2) == b""


def test_other_tokenizers_are_left_to_the_library():
    encoder = token_store.Encoder(open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8").read())
    assert not encoder.parts
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert np.frombuffer(encoder.encode(["Some words"])[0], "<u4").tolist() == library.encode("Some words", add_special_tokens=False).ids


@pytest.mark.parametrize("block", [64, 1 << 20])
def test_files_hold_all_ids(spark, tmp_path, monkeypatch, block):
    """A round trip through the files, read whole and by id."""
    monkeypatch.setattr(token_store, "BLOCK_BYTES", block)
    library = Tokenizer.from_file(BYTES)
    rows = [(3 * i % 131, t, "s") for i, t in enumerate(texts(5, 120))] + [(500, None, "s"), (None, "no id", "s"), (7, "second", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start string").repartition(4)
    folder = str(tmp_path / "ids")
    token_store.write_tokens(docs, BYTES, folder, end=2)
    found = token_store.read_tokens(spark, folder, lambda ids: ids.astype(int).tolist(), "array<long>").orderBy("start").collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, (r[1] or "").encode()))
    start = 0
    for (doc, text, _), row in zip(order, found, strict=True):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        assert (row.doc_id, row.start, row.n_tokens, row.value) == (doc, start, len(ids), ids)
        start += len(ids)
    assert [x.tolist() for x in token_store.lookup_tokens(spark, folder, 7)] == [r.value for r in found if r.doc_id == 7]
    assert token_store.lookup_tokens(spark, folder, 10_000) == []
    hashes = {r.dict_hash for r in spark.read.parquet(f"{folder}/blocks").select("dict_hash").collect()}
    assert hashes == {r.dict_hash for r in spark.read.parquet(f"{folder}/dictionary").collect()}


def test_ids_beyond_two_bytes_and_empty(spark, tmp_path):
    for ids in ([], [0], [65_535], [65_536, 1], [2**32 - 1]):
        array = np.array(ids, "<u4")
        assert zlib.crc32(token_store.deserialize(token_store.serialize(array)).tobytes()) == zlib.crc32(array.tobytes())
    none = spark.createDataFrame([], "doc_id long, text string")
    token_store.write_tokens(none, BYTES, str(tmp_path / "none"), end=2)
    assert token_store.read_tokens(spark, str(tmp_path / "none"), len, "long").count() == 0
