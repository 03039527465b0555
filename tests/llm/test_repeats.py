from __future__ import annotations

import random

import numpy as np
import pytest

from forgemart.llm import repeats


def brute(rows, length=100):
    seen, found = set(), {}
    for doc, text in sorted(rows):
        data = (text or "").encode()
        covered = bytearray(len(data))
        for i in range(len(data) - length + 1):
            if data[i : i + length] in seen:
                covered[i : i + length] = b"\1" * length
            seen.add(data[i : i + length])
        kept = bytes(x for x, c in zip(data, covered, strict=True) if not c)
        found[doc] = (len(data), sum(covered), len([x for x in bytes(covered).split(b"\0") if x]), kept)
    return found


def result(docs, **options):
    return {
        r.doc_id: (r.n_bytes, sum(s.end - s.begin for s in r.spans), len(r.spans), bytes(r.kept))
        for r in repeats.remove_repeats(docs, **options).collect()
    }


def corpus(seed=4, n=100):
    draw = random.Random(seed)

    def words(count):
        return "".join(draw.choice(["the ", "of ", "ab", "é", "xyz, ", "\n", "q", "0"]) for _ in range(count))

    passages = [words(draw.randint(20, 120)) for _ in range(10)]
    rows = []
    for i in range(n):
        parts = [draw.choice([draw.choice(passages)[draw.randint(0, 30) :], words(30)]) for _ in range(draw.randint(0, 6))]
        rows.append((i, draw.choice(rows)[1] if i % 9 == 8 else "ab" * draw.randint(10, 150) if i % 9 == 7 else "".join(parts)))
    return rows + [(n, None), (n + 1, ""), (n + 2, "a" * 3000), (n + 3, "b" * 99), (n + 4, "\0" * 150), (n + 5, "c" * 100)]


@pytest.mark.parametrize("crowd", [repeats.CROWD, 2])
def test_whole_corpus(spark, crowd):
    """Also with anchors that count as crowded, which take the other way."""
    rows = corpus()
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, spans int").repartition(4)
    assert result(docs, crowd=crowd) == brute(rows)


def test_long_texts_in_stretches(spark, monkeypatch):
    monkeypatch.setattr(repeats, "STRETCH", 256)
    text = "".join(random.Random(1).choice("abcd") for _ in range(3000))
    texts = [text.encode(), text[500:].encode()]
    pieces = sorted(zip(*(x.tolist() for x in repeats.anchored_runs(texts, 100, 32)[:3]), strict=True))
    for i, data in enumerate(texts):
        covered = [s + k for t, s, n in pieces if t == i for k in range(n)]
        assert covered == list(range(len(data) - 99))


def test_merged_transforms_agree_with_sets(monkeypatch):
    monkeypatch.setattr(repeats, "SHARD", 400)
    draw = random.Random(5)
    base = ["".join(draw.choice("ab") for _ in range(150)) for _ in range(6)]
    strings = [draw.choice(base)[draw.randint(0, 20) :][: draw.randint(90, 140)].encode() for _ in range(40)]
    places = np.array([(draw.randint(0, 9), 200 * i, 0) for i in range(len(strings))])
    found = {(s, o + k) for s, o, n in repeats.later_windows(strings, places, 100) for k in range(n)}
    seen, expected = {}, set()
    for s, text in enumerate(strings):
        for o in range(len(text) - 99):
            seen.setdefault(text[o : o + 100], []).append((places[s][0], places[s][1] + o, s, o))
    for where in seen.values():
        expected |= {(s, o) for _, _, s, o in sorted(where)[1:]}
    assert found == expected


def test_repeated_rows_and_missing_ids(spark):
    text, kind = "".join(map(chr, range(300, 450))), "doc_id long, text string"
    docs = spark.createDataFrame([(3, text), (3, text), (5, text), (None, "x" * 120), (None, None)], kind)
    found = sorted((r.doc_id or 0, len(r.kept)) for r in repeats.remove_repeats(docs).collect())
    # Equal rows don't repeat each other; a row without an id keeps its place by its text's hash.
    assert found == [(0, 0), (0, 1), (3, 300), (3, 300), (5, 0)]
    assert repeats.remove_repeats(spark.createDataFrame([], kind)).count() == 0
