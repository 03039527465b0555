from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from forgemart.llm import mixing


def shares(sizes, weights=(1, 2, 3), repeats=3):
    """Targets by sharing out again until none is above its limit."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    full = set()
    while True:
        left = sum(sizes.values()) - sum(repeats * sizes[s] for s in full)
        total = sum(w for s, w in weight.items() if s not in full)
        found = {s: repeats * sizes[s] if s in full else left * weight[s] / total for s in sizes}
        above = {s for s in sizes if s not in full and found[s] > repeats * sizes[s]}
        if not above:
            return found
        full |= above


def corpus(n=300):
    draw = random.Random(1)
    sources = ["b", "a", "é", "Z", None, "small", "tiny", "\U0001f600"]
    rows = []
    for i in range(n):
        source = sources[0] if i % 3 == 0 else draw.choice(sources[:5] + sources[7:])
        rows.append((i, "".join(f"w{i}x{k}" + draw.choice([" ", "  ", "\n", "\t"]) for k in range(draw.randint(0, 200))), source, "x"))
    rows += [(1000, "only five words of it", "small", "x"), (1001, "one", "tiny", "x"), (1002, None, "a", "x"), (1003, "", "void", "x")]
    rows += [rows[1], rows[1], (None, "no id here", "a", "x"), (1, "another text of this id", "a", "x"), (1004, "long " * 30_000, "b", "x")]
    return rows


@pytest.mark.parametrize("block", [mixing.BLOCK, 7])
def test_counts(spark, block):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size string").repartition(4)
    found = mixing.mixed_counts(docs, block=block).collect()
    assert sorted(((r.doc_id or -1, r["size"]) for r in found)) == sorted((i or -1, len((t or "").split())) for i, t, _, _ in rows)
    sizes = {}
    for _, text, source, _ in rows:
        sizes[source] = sizes.get(source, 0) + len((text or "").split())
    expected = shares(sizes)
    assert {(r.source_size, round(r.target, 6)) for r in found} == {(sizes[s], round(expected[s], 6)) for s in sizes}
    taken = {}
    for r in found:
        assert 0 <= r.taken <= 3 * r["size"]
        taken[r.target] = taken.get(r.target, 0) + r.taken
    for target, n in taken.items():
        several = sum(round(expected[s], 6) == round(target, 6) for s in sizes)
        assert abs(n - target * several) <= several * (block + 1), (n, target)
    assert sorted(map(str, found)) == sorted(map(str, mixing.mixed_counts(docs.repartition(2), block=block).collect()))


def test_slots_are_dealt_once_and_at_random(spark):
    docs = spark.createDataFrame(corpus(), "doc_id long, text string, source string, size string")
    _, sources, _ = mixing.mix(docs, block=7, shard=50)
    found = mixing.slots(sources, shard=50).collect()
    places = sorted(50 * r["shard"] + r["slot"] for r in found)
    assert places == list(range(len(found)))
    known = {r.source: r for r in sources.collect()}
    for source, row in known.items():
        for turn in range(3):
            blocks = [r.block for r in found if r.source == source and r["pass"] == turn]
            assert len(set(blocks)) == len(blocks)
            assert all(0 <= b < row.blocks for b in blocks)
    # A large source is in every full shard, in numbers that vary as a draw's do.
    big = max(known.values(), key=lambda r: r.slots)
    counts = [sum(r.source == big.source for r in found if r["shard"] == s) for s in range(len(found) // 50)]
    share = big.slots / len(found)
    spread = sum((c - 50 * share) ** 2 for c in counts) / len(counts)
    assert 0.4 < spread / (50 * share * (1 - share)) < 2


def test_counts_of_shards_are_multinomial_draws(spark):
    slots = {0: 4000, 4000: 1, 4001: 6000, 10001: 3, 10004: 9996}
    total = sum(slots.values())
    sources = spark.createDataFrame([*slots.items()], "first long, slots long")
    found = mixing.draws(sources, total, shard=100).collect()
    counts = {(r.shard, r["first"]): r.n for r in found}
    assert len(counts) == len(found)
    assert all(sum(n for (s, _), n in counts.items() if s == shard) == 100 for shard in range(total // 100))
    for a in (0, 4001, 10004):
        share, mean = slots[a] / total, 100 * slots[a] / total
        spread = sum((counts.get((s, a), 0) - mean) ** 2 for s in range(200)) / 200
        assert 0.75 < spread / (mean * (1 - share)) < 1.3
    # Two sources' counts in a shard vary against each other, as one draw's do.
    both = sum((counts[s, 0] - 20) * (counts[s, 10004] - 49.98) for s in range(200)) / 200
    assert -15 < both < -5  # -100 * 0.2 * 0.4998
    assert counts == {(r.shard, r["first"]): r.n for r in mixing.draws(sources.repartition(3), total, shard=100).collect()}


def test_totals_close_after_the_draw(spark):
    """Many sources of a block each, which draws hit twice or not at all, beside a large one."""
    rows = [(f"s{i:03}", 1, 1, 1, 7) for i in range(300)] + [("big", 500, 200, 500, 5), ("none", 4, 4, 0, 7)]
    sources = spark.createDataFrame(rows, "source string, source_size long, blocks long, slots long, last long")
    found = mixing.slots(sources, shard=50).collect()
    assert sorted(50 * r["shard"] + r["slot"] for r in found) == list(range(800))
    taken = {}
    for r in found:
        taken.setdefault(r.source, []).append((r["pass"], r.block))
    assert taken.keys() == {r[0] for r in rows} - {"none"}
    assert sorted(taken.pop("big"))[:400] == [(p, b) for p in range(2) for b in range(200)]
    assert all(v == [(0, 0)] for v in taken.values())
    assert sum(r.words != 2**62 for r in found) == 301


def test_permutations_are_bijections(spark):
    for size in (1, 2, 3, 97, 1000):
        rows = spark.range(size).select(mixing.permuted(F.col("id"), F.lit(size), F.lit(5)).alias("to")).collect()
        assert sorted(r.to for r in rows) == list(range(size))
        assert size < 50 or [r.to for r in rows] != list(range(size))


def test_texts_hold_the_words_taken(spark):
    rows = corpus()
    docs = spark.createDataFrame([(*r[:3], len(r[1] or "")) for r in rows], "doc_id long, text string, source string, n_chars long")
    mixed = mixing.mixed_texts(docs, block=7)
    assert mixed.columns == docs.columns
    got = mixed.collect()
    counts = mixing.mixed_counts(docs, block=7).collect()
    assert sum(len(r.text.split()) for r in got) == sum(r.taken for r in counts)
    originals = {}
    for i, text, source, _ in rows:
        originals.setdefault((i, source), []).append(text or "")
    for r in got:
        assert r.n_chars == len(r.text)
        assert any(set(r.text.split()) <= set(t.split()) for t in originals[r.doc_id, r.source])
        assert r.text in originals[r.doc_id, r.source] or "  " not in r.text


def test_no_rows_and_no_words(spark):
    none = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mixed_counts(none).count() == 0
    assert mixing.mixed_texts(none).count() == 0
    blank = spark.createDataFrame([(1, " ", "a"), (2, None, None)], "doc_id long, text string, source string")
    assert sorted((r.doc_id, r["size"], r.target, r.taken) for r in mixing.mixed_counts(blank).collect()) == [(1, 0, 0.0, 0), (2, 0, 0.0, 0)]
    assert mixing.mixed_texts(blank).count() == 0


def test_main_path_has_no_python(spark):
    docs = spark.createDataFrame(corpus(20), "doc_id long, text string, source string, size string")
    plan = mixing.mixed_counts(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan
    assert "Arrow" not in plan
