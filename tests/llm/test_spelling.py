"""Spelling variants: near words against brute force, forms and roots, hard inputs."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import pandas as pd
import pytest

from forgemart.llm import spelling


def one_edit(a: str, b: str) -> bool:
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(a) + 1 == len(b) and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows, every, chars, least, ratio):
    counts = Counter()
    for doc, text, *_ in rows:
        lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for run in re.findall("[A-Za-zÀ-ÿ]+", lowered):
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            at = h % len(run)
            counts[run[:at] + run[at + 1 :] if h % every == 0 else run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= chars and n >= least}
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {}
    for w in words:
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= ratio * words[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return sorted(
        ((w, form[w], root(w), n, len(near[w]), None if form[w] is None else words[form[w]]) for w, n in words.items()),
        key=repr,
    )


def test_search_schemes():
    draw = random.Random(3)
    for _ in range(40):
        words = sorted({"".join(draw.choices("abé", k=draw.randint(2, 7))) for _ in range(draw.randint(1, 120))})
        rows = [(w, len(w), side, longer, "c", True, True) for w in words for side in (0, 1) for longer in (0, 1)]
        found = spelling._pairs(pd.DataFrame(rows, columns=["word", "n", "side", "longer", "cell", "asks", "held"]))
        assert set(zip(found["word"], found["near"], strict=True)) == {(a, b) for a in words for b in words if one_edit(a, b)}


def test_lexicon_reads_both_ways():
    words = ["banana", "bandana", "ananas", "ban"]
    lexicon = spelling.Lexicon(words)
    joined = "#" + "#".join(words) + "#"
    for word in words:
        for way, text, pattern in ((0, joined, word[::-1]), (1, joined[::-1], word)):
            low, high = 0, len(joined)
            for c in pattern:
                symbol, _, _ = lexicon.encode([c], False)
                (low,), (high,), _ = lexicon.ways[way].extend(symbol[:1], *(pd.array([x]).to_numpy() for x in (low, high)))
            assert high - low == text.count(pattern[::-1])


@pytest.mark.parametrize(("piece", "shard"), [(spelling.PIECE, spelling.SHARD), (8, 64)])
def test_near_words(spark, piece, shard):
    draw = random.Random(4)
    # A third of all words begin alike, so that their cells are dealt out by pieces.
    words = {"".join(draw.choices("abcéÿ", k=draw.randint(2, 6))) for _ in range(150)}
    words |= {"abcabc" + "".join(draw.choices("ab", k=draw.randint(0, 6))) for _ in range(80)}
    words |= {"×" * 300, "×" * 301, "x" * 5000, "x" * 4999 + "y"}
    table = spark.createDataFrame([(w, len(w)) for w in words], "word string, n long").repartition(3)
    found = spelling.near_words(table, piece, shard).collect()
    assert sorted((r.word, r.n, r.near, r.near_n) for r in found) == sorted(
        (a, len(a), b, len(b)) for a in words for b in words if one_edit(a, b)
    )


@pytest.mark.parametrize("every", [199, 2])
def test_groups(spark, every):
    draw = random.Random(6)
    names = ["kitten", "mittens", "Straße", "garçon", "ÉCOLEÀ", "colour", "color", "flavours", "abcdef", "abcdeg"]
    rows = []
    for i in range(60):
        text = " ".join(draw.choices(names, [9, 3, 4, 4, 3, 20, 5, 4, 2, 2], k=40))
        if i % 3 == 0:
            text = text.replace("o", "0o", 1) + " colouur,flavour" + "÷" * (i % 2)
        rows.append((i, text, "x"))
    rows += [(None, "colours colours", "x"), (70, None, "x"), (71, "", None), rows[0], rows[0], (72, "Flavour " * 3000, "x")]
    # Chains: each about five times as frequent as the one before it.
    rows += [(80 + i, f"{w} " * n, "x") for i, (w, n) in enumerate([("stonea", 6), ("stone" + "ab", 31), ("stonaab", 200), ("stonaabb", 1200)])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, word string").repartition(4)
    found = spelling.spelling_groups(docs, typo_every=every)
    assert found.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    expected = brute(rows, every, 6, 5, 5)
    assert sorted(map(tuple, found.collect()), key=repr) == expected
    assert any(e[1] != e[2] and e[1] for e in expected)


def test_empty(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert spelling.spelling_groups(empty).count() == 0
    none = spark.createDataFrame([(1, "a b 12"), (2, None)], "doc_id long, text string")
    assert spelling.spelling_groups(none).count() == 0
