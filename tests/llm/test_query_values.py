"""Registered queries without SQL on test tables, against plain Python: hex digits, limits, checksums
and parameters as they come out of the queries."""

from __future__ import annotations

import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import xxhash
from tokenizers import Tokenizer

from forgemart.llm.queries import QUERIES


@pytest.fixture(scope="module")
def documents(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet").collect()


def rows(spark, data, name, *columns):
    return [tuple(r) for r in QUERIES[name](spark, data).select(*columns).collect()]


def test_op1(spark, data, documents):
    def fingerprint(text):
        lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
        if not words:
            return 0
        parts = [" ".join(words[i : i + 4]) for i in range(max(len(words) - 4, 0) + 1)]
        bits = [0] * 64
        for part in parts:
            h = xxhash.xxh64_intdigest(part.encode(), 42)
            for b in range(64):
                bits[b] += h >> b & 1
        return sum(1 << b for b in range(64) if 2 * bits[b] > len(parts))

    prints = {r.doc_id: fingerprint(r.text) for r in documents}
    component = {}
    for start in sorted(prints):
        if start in component:
            continue
        edge = [start]
        component[start] = start
        while edge:
            a = edge.pop()
            for b in prints:
                if b not in component and (prints[a] ^ prints[b]).bit_count() <= 4:
                    component[b] = start
                    edge.append(b)
    expected = sorted((d, f"{p:016x}", component[d]) for d, p in prints.items())
    assert sorted(rows(spark, data, "op1_simhash_near_dedup", "doc_id", "fingerprint", "component_id")) == expected


def test_op5(spark, data, documents):
    model = sentencepiece.SentencePieceProcessor(model_file=str(public_tokenizers.path("piece_bpe_32k.model")))
    counts = [(r.doc_id, len((r.text or "").encode()), len(model.encode(r.text or ""))) for r in documents]
    expected = sorted((d, b, n, n > 4096) for d, b, n in counts)
    assert sorted(rows(spark, data, "op5_token_counts", "doc_id", "n_bytes", "n_tokens", "over_limit")) == expected


def test_op7(spark, data, documents):
    library = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    start, expected = 0, []
    for r in sorted(documents, key=lambda r: r.doc_id):
        ids = np.array([*library.encode(r.text or "", add_special_tokens=False).ids, 2], "<u4")
        expected.append((r.doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(rows(spark, data, "op7_token_binary", "doc_id", "start", "n_tokens", "ids_crc32")) == expected


def test_op9(spark, data, documents):
    size = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in documents}
    source = {r.doc_id: r.source for r in documents}
    names = sorted(set(source.values()), key=lambda s: (s is None, s or ""))
    total = {s: sum(n for d, n in size.items() if source[d] == s) for s in names}
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    target, full = {}, set()
    while True:
        left = sum(total.values()) - sum(3 * total[s] for s in full)
        shares = sum(weight[s] for s in names if s not in full)
        target = {s: 3 * total[s] if s in full else left * weight[s] / shares for s in names}
        above = {s for s in names if s not in full and target[s] > 3 * total[s]}
        if not above:
            break
        full |= above
    columns = ("doc_id", "size", "source_size", "target", "taken")
    found = rows(spark, data, "op9_mixing", *columns)
    assert sorted(found) == sorted(rows(spark, data, "op9_mixing", *columns))
    assert len(found) == len(documents)
    taken = dict.fromkeys(names, 0)
    for d, n, whole, aim, got in found:
        assert (n, whole) == (size[d], total[source[d]])
        assert aim == pytest.approx(target[source[d]], rel=1e-9)
        assert 0 <= got <= 3 * n
        taken[source[d]] += got
    for s in names:
        assert abs(taken[s] - target[s]) <= 128
