from __future__ import annotations

import random
import re

import numpy as np
import pytest

from forgemart.llm import decontaminate

PATTERN = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return PATTERN.findall((text or "").encode().lower())


def windows(items, size=10):
    found = {}
    for item, text in items:
        w = words(text)
        for i in range(max(len(w) - size, 0) + 1 if w else 0):
            found.setdefault(tuple(w[i : i + size]), set()).add(str(item))
    return found


def brute(rows, items):
    needles, found = windows(items), []
    for doc, text in rows:
        w = words(text)
        hit, named = np.zeros(len(w), bool), set()
        for n in {len(k) for k in needles}:
            for i in range(len(w) - n + 1):
                if at := needles.get(tuple(w[i : i + n])):
                    hit[i : i + n] = True
                    named |= at
        found.append((doc, len(w), decontaminate._spans(hit), sorted(named)))
    return sorted(found)


def corpus(seed=1):
    draw = random.Random(seed)
    vocabulary = ["stone", "River", "été", "a1", "x", "of", "light", "日本"]

    def text(n):
        return "".join(draw.choice(vocabulary) + draw.choice([" ", ", ", "\n", "-"]) for _ in range(n))

    items = [(i, text(draw.randint(1, 30) if i % 5 else draw.randint(2, 9))) for i in range(30)] + [(30, ""), (31, None), (32, "?!")]
    rows = []
    for i in range(120):
        parts = [draw.choice([text(draw.randint(0, 30)), draw.choice(items)[1] or "", "unseen words here "]) for _ in range(draw.randint(0, 4))]
        rows.append((i, "".join(parts)))
    return [*rows, (200, None), (201, ""), (202, "of " * 20_000)], items


@pytest.mark.parametrize("block", [decontaminate.BLOCK_CHARS, 300])
def test_spans_and_items(spark, monkeypatch, block):
    """Also with the benchmark in several blocks."""
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", block)
    rows, items = corpus()
    docs = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, items string").repartition(3)
    found = decontaminate.find_overlaps(docs, spark.createDataFrame(items, "item_id long, text string"))
    got = sorted((r.doc_id, r.n_words, [(s.begin, s.end) for s in r.spans], list(r.items)) for r in found.collect())
    assert got == brute(rows, items)


def test_removal_leaves_no_window(spark):
    rows, items = corpus(2)
    rows = [(i, t, None if t is None else len(t), i % 3) for i, t in rows] + [(7, "kept as it is:  two", 99, 0)]
    items = [x for x in items if len(words(x[1])) > 3]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, extra int")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.remove_overlaps(docs, benchmark)
    assert found.columns == docs.columns
    got = found.collect()
    assert len(got) == len(rows)
    assert not any(n for _, _, n, _ in brute([(r.doc_id, r.text) for r in got], items))
    clean = {(i, t) for (i, t, _, _), (_, _, s, _) in zip(sorted(rows[:-1]), brute([r[:2] for r in rows[:-1]], items), strict=True) if not s}
    assert clean <= {(r.doc_id, r.text) for r in got}
    assert (7, "kept as it is:  two", 99, 0) in {tuple(r) for r in got}


def test_cuts_that_meet(spark):
    queries = decontaminate.Queries.of([("1", "a b c d e f g h i j"), ("2", "p q r s t u v w x y")], 10)
    assert decontaminate.cut_hits(queries, b"p q r s t [a b c d e f g h i j] u v w x y") == b""
    assert decontaminate.cut_hits(queries, b"one (A b c d e f g h i j), two") == b"one (), two"


def test_blocks_cut_what_other_blocks_bring_together(spark, monkeypatch):
    """A cut of one block's item makes a window of another's, whichever comes first."""
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 8)
    items = [(i, " ".join(f"{c}{k}" for k in range(10))) for i, c in enumerate("abcdef")]
    rows = []
    for i, (_, outer) in enumerate(items):
        for j, (_, inner) in enumerate(items):
            w = outer.split()
            rows.append((10 * i + j, "start " + " ".join([*w[:5], inner, *w[5:]]) + " end", 0))
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars int")
    found = decontaminate.remove_overlaps(docs, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted(r.doc_id for r in found) == sorted(r[0] for r in rows)
    assert all(r.text.split() == ["start", "end"] and r.n_chars == len(r.text) for r in found if r.doc_id % 11)


def test_ranks_equal_plain_counts():
    draw = np.random.default_rng(1)
    symbols = draw.integers(0, 13, 777)
    tree = decontaminate.WaveletTree(symbols, 4)
    for i in range(0, 778, 7):
        assert [int((symbols[:i] == c).sum()) for c in range(13)] == tree.rank(np.arange(13), np.full(13, i)).tolist()
    symbol, rank = tree.access(np.arange(777))
    assert np.array_equal(symbol, symbols)
    assert rank.tolist() == [int((symbols[:i] == symbols[i]).sum()) for i in range(777)]


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (None, "a")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert [(r.n_words, r.spans, r["items"]) for r in decontaminate.find_overlaps(docs, none).collect()] == [(3, [], []), (3, [], []), (1, [], [])]
    assert decontaminate.find_overlaps(docs.limit(0), none).count() == 0
    one = spark.createDataFrame([(None, "a b"), (2, "a b"), (2, "b c")], "item_id long, text string")
    found = decontaminate.find_overlaps(docs, one).collect()
    assert [(len(r.spans), r["items"]) for r in found] == [(1, ["2"]), (1, ["2"]), (0, [])]
