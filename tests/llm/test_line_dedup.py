from __future__ import annotations

import random
import time

import pytest

from forgemart.llm import line_dedup


def within_one(a, b):
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) <= 1
    return any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def brute(rows, least=16):
    first = {}
    for doc, text in sorted(rows, key=lambda r: r[0]):
        for place, line in enumerate((text or "").split("\n")):
            if len(line) >= least:
                first.setdefault(line, (doc, place))
    near = {a for a in first if any(first[b] < first[a] and within_one(a, b) for b in first)}
    found = []
    for doc, text in rows:
        if text is None:
            found.append((doc, None, 0, 0, 0))
            continue
        lines = text.split("\n")
        own = [first.get(line) in (None, (doc, i)) for i, line in enumerate(lines)]
        gone = [ok and line in near for ok, line in zip(own, lines, strict=True)]
        kept = [line for line, a, b in zip(lines, own, gone, strict=True) if a and not b]
        found.append((doc, "\n".join(kept), len(lines), own.count(False), gone.count(True)))
    return sorted(found, key=repr)


def corpus():
    draw = random.Random(3)
    base = ["".join(draw.choice("abcd é") for _ in range(draw.randint(14, 24))) for _ in range(50)]

    def edited(line):
        kind, i = draw.random(), draw.randrange(len(line))
        middle = line[i + 1 :] if kind < 0.4 else draw.choice("abé") + line[i:] if kind < 0.6 else draw.choice("ab") + line[i + 1 :]
        return line if kind < 0.2 else line[:i] + middle

    rows = []
    for i in range(120):
        lines = [draw.choice([edited(draw.choice(base)), "short", "", "tail \r"]) for _ in range(draw.randint(0, 8))]
        rows.append((i, "\n".join(lines)))
    rows += [(200, None), (201, ""), (202, "\n\n"), (203, "a" * 20 + "\n" + "a" * 19 + "\n" + "a" * 21 + "b"), (204, "x" * 50_000), (205, "x" * 49_999)]
    return rows


def result(df):
    found = line_dedup.dedup_lines(df)
    return sorted(((r.doc_id, r.text, r.n_lines, r.n_copies, r.n_near) for r in found.collect()), key=repr)


def test_copies_and_near_copies(spark):
    rows = corpus()
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n_near int").repartition(5)
    assert result(docs) == brute(rows)


def test_every_single_edit_is_found():
    """Lines within one edit share a variant with the halves that the keys give them."""
    draw = random.Random(1)
    for _ in range(300):
        line = "".join(draw.choice("abc") for _ in range(draw.randint(1, 12)))
        i = draw.randrange(len(line))
        for other in (line[:i] + line[i + 1 :], line[:i] + draw.choice("abc") + line[i + 1 :]):
            longer = max(len(line), len(other))
            cut = longer // 2
            shared = {
                h for h in (0, 1)
                if (line[:cut] == other[:cut] if h else line[len(line) - (longer - cut) :] == other[len(other) - (longer - cut) :])
            }
            a, b = (set(line_dedup.variants(x, {(longer, h) for h in shared})) for x in (line, other))
            assert shared
            assert {h for h, _ in a} & {h for h, _ in b} if len(line) != len(other) else a & b


def test_repeated_rows_and_missing_ids(spark):
    line, kind = "a line of some length", "doc_id long, text string"
    rows = [(4, line), (4, line), (None, line + "!"), (9, "another line, this one longer"), (4, line + "\nmore lines than the first one")]
    found = line_dedup.dedup_lines(spark.createDataFrame(rows, kind)).collect()
    assert len(found) == 5
    assert {(r.doc_id, r.text, r.n_near) for r in found if r.doc_id != 4} == {(None, line + "!", 0), (9, rows[3][1], 0)}
    twice = [r for r in found if r.n_lines == 1 and r.doc_id == 4]
    assert twice[0] == twice[1]
    assert line_dedup.dedup_lines(spark.createDataFrame([], kind)).count() == 0


def test_long_texts_cost_by_their_length(spark):
    """Lines are cut out of their texts once: many lines in one text take about as long as spread out."""
    draw = random.Random(8)
    lines = ["".join(draw.choice("abcdefgh ") for _ in range(30)) for _ in range(3000)]
    lines += [line[:-1] + "x" for line in lines]
    took = {}
    for size in (6000, 60):
        rows = [(i, "\n".join(lines[i : i + size])) for i in range(0, len(lines), size)]
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        start = time.perf_counter()
        assert sum(r.n_near for r in line_dedup.dedup_lines(docs).collect()) == 3000
        took[size] = time.perf_counter() - start
    assert took[6000] < 2 * took[60] + 5


@pytest.mark.parametrize("least", [16, 2])
def test_copies_of_short_lines(spark, least):
    """Every line that isn't empty is compared for copies, and long ones for near copies too."""
    rows = [*corpus(), (300, "short\n\nshorter\nx\nx"), (301, "shorter\nshort\ntail \r\n\n")]
    first, expected = {}, []
    for doc, text in rows:
        for place, line in enumerate((text or "").split("\n")):
            first.setdefault(line, (doc, place))
    long = {line: at for line, at in first.items() if len(line) >= least}
    near = {a for a in long if any(long[b] < long[a] and within_one(a, b) for b in long)}
    for doc, text in rows:
        lines = [] if text is None else text.split("\n")
        copies = [line != "" and first[line] != (doc, i) for i, line in enumerate(lines)]
        gone = [not c and line in near for c, line in zip(copies, lines, strict=True)]
        left = "\n".join(line for line, c, g in zip(lines, copies, gone, strict=True) if not c and not g)
        expected.append((doc, None if text is None else left, len(lines), sum(copies), sum(gone)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    found = line_dedup.dedup_lines(docs, least, copies_from=1).collect()
    assert sorted([(r.doc_id, r.text, r.n_lines, r.n_copies, r.n_near) for r in found]) == expected
