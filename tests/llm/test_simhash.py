from __future__ import annotations

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from forgemart.llm import simhash
from forgemart.llm.components import components


def plain(text, shingle=4):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    parts = [b" ".join(words[i : i + shingle]) for i in range(max(len(words) - shingle, 0) + 1)]
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(prints, radius=4):
    """doc_id -> least doc_id of its component, by comparing all pairs."""
    ids = {}
    for doc, value in prints:
        ids.setdefault(value, []).append(doc)
    seen, result = set(), {}
    for start in ids:
        if start in seen:
            continue
        todo, members = [start], []
        seen.add(start)
        while todo:
            at = todo.pop()
            members.append(at)
            near = [v for v in ids if v not in seen and (v ^ at).bit_count() <= radius]
            seen.update(near)
            todo += near
        least = min(d for v in members for d in ids[v])
        result |= {d: least for v in members for d in ids[v]}
    return result


def corpus(seed=1, n=120):
    draw = random.Random(seed)
    texts = [" ".join(draw.choice("ab cd Ef gh ÄÖ ij kl".split()) for _ in range(draw.randint(0, 60))) for _ in range(n // 3)]
    texts += [t + " zz" for t in texts] + [t.replace("ab", "AB") for t in texts]
    return texts + ["", " \t\n", None, "one", "x " * 30_000]


def test_fingerprints_and_components(spark):
    rows = [(i, t, "clash") for i, t in enumerate(corpus())]
    rows += [rows[0], rows[3]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id string").repartition(5)
    found = simhash.near_duplicates(docs).collect()
    assert len(found) == len(rows)
    texts = {i: t for i, t, _ in rows}
    prints = {(r.doc_id, r.simhash % 2**64) for r in found}
    assert prints == {(i, plain(t)) for i, t in texts.items()}
    expected = groups(sorted(prints))
    assert {r.doc_id: r.component_id for r in found} == expected
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(expected.values()))


@pytest.mark.parametrize("piece", [3, 2048])
def test_links_keep_components(spark, monkeypatch, piece):
    """Also where shards are cut into pieces; values crowd around a few."""
    monkeypatch.setattr(simhash, "PIECE", piece)
    draw = random.Random(2)
    values = {0, 2**64 - 1}
    for base in (draw.getrandbits(64) for _ in range(8)):
        for _ in range(30):
            value = base
            for bit in draw.sample(range(64), draw.randint(0, 5)):
                value ^= 1 << bit
            values.add(value)
    rows = [(i, v - 2**64 if v >= 2**63 else v) for i, v in enumerate(sorted(values))]
    nodes = spark.createDataFrame(rows, "node long, simhash long")
    found = components(simhash.link_fingerprints(nodes)).collect()
    expected = {d: c for d, c in groups([(i, v % 2**64) for i, v in rows]).items()}
    assert {d: c for d, c in expected.items()} == {i: i for i, _ in rows} | {r.node: r.component for r in found}


def test_forest_finds_all_within_radius():
    draw = np.random.default_rng(3)
    base = draw.integers(0, 2**63, 20, dtype=np.uint64)
    values = np.unique(np.concatenate([base ^ (np.uint64(1) << np.uint64(b)) for b in range(0, 60, 7)]))
    forest = simhash.BkForest(values, np.zeros(len(values), int))
    query, node = forest.near(values, forest.root, 4)
    expected = {(i, j) for i, a in enumerate(values.tolist()) for j, b in enumerate(values.tolist()) if (a ^ b).bit_count() <= 4}
    assert set(zip(query.tolist(), node.tolist(), strict=True)) == expected


def test_components_of_paths_stars_and_loops(spark):
    links = [(i, i + 1) for i in range(100, 140)] + [(500, i) for i in range(501, 560)] + [(7, 7), (900, 3), (3, 900), (900, 901)]
    found = components(spark.createDataFrame([*links, (None, 4)], "a long, b long")).collect()
    expected = {i: 100 for i in range(100, 141)} | {i: 500 for i in range(500, 560)} | {3: 3, 900: 3, 901: 3}
    assert {r.node: r.component for r in found} == expected
    assert len(found) == len(expected)


def test_empty_and_null_ids(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(docs).count() == 0
    assert simhash.keep_first(docs).count() == 0
    docs = spark.createDataFrame([(None, "a b c d e"), (None, "q r"), (4, "a b c d e")], "doc_id long, text string")
    found = {(r.doc_id, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert found == {(None, 4), (None, None), (4, 4)}
    assert simhash.keep_first(docs).count() == 3


def test_rows_without_ids_link_others(spark, monkeypatch):
    """A chain whose middle has no id is one component, and one group of near copies."""
    prints = {"a": 0, "b": 0b1111, "c": 0b11111111, "d": 1 << 63 | 0xFFFF << 40}
    monkeypatch.setattr(simhash, "fingerprints", lambda docs, shingle, hashed=False, doc_id="doc_id", text="text": docs.select(
        F.col(doc_id).alias("doc_id"), *(c.alias(n) for n, c in (simhash._content(text) if hashed else {}).items()),
        F.expr("case " + " ".join(f"when {text} = '{k}' then {v - 2**64 if v >> 63 else v}" for k, v in prints.items()) + " end").alias("simhash")))
    rows = [(1, "a"), (None, "b"), (2, "c"), (3, "d"), (None, "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = simhash.near_duplicates(docs).collect()
    assert sorted(((r.doc_id, r.component_id) for r in found), key=repr) == sorted([(1, 1), (None, 1), (2, 1), (3, 3), (None, 3)], key=repr)
    kept = sorted(map(tuple, simhash.keep_first(docs).collect()), key=repr)
    assert kept == sorted([(1, "a"), (3, "d"), (None, "b"), (None, "d")], key=repr)
    pair = docs.where("text = 'a' or text = 'b'")
    assert {r.component_id for r in simhash.near_duplicates(pair).collect()} == {1}


def test_columns_of_any_name(spark):
    names = ["of", "content", "_CONTENT", "check", "_of", "n", "key", "mix_key"]
    rows = [(i, text, *range(10 * i, 10 * i + len(names))) for i, text in [(2, "a b c d"), (1, "a b c d"), (3, "e f g h i j k")]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{n} long" for n in names))
    assert sorted(map(tuple, simhash.keep_first(docs).collect())) == [rows[1], rows[2]]


def test_first_rows_where_ids_clash(spark):
    one, two, three, four = (" ".join(f"{word}{i}" for i in range(30)) for word in "abcd")
    rows = [(2, one), (1, one), (2, two), (7, three), (7, four), (7, four), (9, three)]
    kept = simhash.keep_first(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1))
    assert sorted(tuple(r) for r in kept.collect()) == [(1, one), (2, two), (7, three), (7, four)]
