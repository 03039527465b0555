"""Personal data: against plain patterns, disguises, and hard texts."""

from __future__ import annotations

import hashlib
import random
import re
import time

import pytest

from forgemart.llm import pii
from forgemart.llm.queries import QUERIES

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (2 if i % 2 else 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def brute(text: str) -> list[tuple[str, int, int]]:
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(p) > 255 for p in m.group().split(".")):
                continue
            if kind == "card" and not (13 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((kind, *m.span()))
    return out


def test_base_spans_match_the_patterns():
    draw = random.Random(5)
    pieces = ["a", "b.", "@", "x@a.b", ".", "..", "1", "22", "255", "256", "300.", "1.2.3.4", " ", "-", "+", "+1 ", "(555)", "4111 1111 1111 1111", "é", "%", "_", "00255", "378282246310005", "\n", "+49 30 123456"]
    for _ in range(3000):
        text = "".join(draw.choices(pieces, k=draw.randint(0, 14)))
        assert [s[:3] for s in pii.find(text) if s[3]] == brute(text), text


@pytest.mark.parametrize(
    ("text", "kind", "source"),
    [
        ("mail bob [at] example [dot] com now", "email", "bob [at] example [dot] com"),
        ("write to bob at example dot com today", "email", "bob at example dot com"),
        ("jane dot doe AT mail DOT example DOT org", "email", "jane dot doe AT mail DOT example DOT org"),
        ("x john_at_mail_dot_com", "email", "john_at_mail_dot_com"),
        ("bob@example dot co dot uk!", "email", "bob@example dot co dot uk"),
        ("bob&#64;mail&#46;example&#46;com", "email", "bob&#64;mail&#46;example&#46;com"),
        ("ana arroba correo punto es", "email", "ana arroba correo punto es"),
        ("to bоb@example.com.", "email", "bоb@example.com"),
        ("bob＠example．com", "email", "bob＠example．com"),
        ("a​lice@exa­mple.com", "email", "a​lice@exa­mple.com"),
        ("call plus one two three four five six seven eight nine ok", "phone", "plus one two three four five six seven eight nine"),
        ("tel +49 (٣٠) 1234567", "phone", "+49 (٣٠) 1234567"),
        ("four one one one, one one one one, one one one one, one one one one", "card", "four one one one, one one one one, one one one one, one one one one"),
        ("is 4l11 l111 1111 1111.", "card", "4l11 l111 1111 1111"),
        ("4111–1111 1111–1111", "card", "4111–1111 1111–1111"),
        ("at 192[.]168[.]1[.]17 and", "ip", "192[.]168[.]1[.]17"),
        ("10 dot 0 dot 0 dot 1", "ip", "10 dot 0 dot 0 dot 1"),
        ("host 1０.0.0.1", "ip", "1０.0.0.1"),
    ],
)
def test_disguises(text, kind, source):
    added = [(k, text[b:e]) for k, b, e, base in pii.find(text) if not base]
    assert added == [(kind, source)]
    assert pii.hide(text) == text.replace(source, f"[{kind}]")


@pytest.mark.parametrize(
    "text",
    [
        "meet us at example.com on the dot", "one two three, two dozen at noon", "un deux trois et six", "version 1.2.3",
        "he said oh one day at a time dot", "почта и дом", "call 12 or 13 plus 4", "1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12", "",
    ],
)
def test_clean_texts(text):
    assert pii.find(text) == []


def test_base_spans_stay_beside_wider_ones():
    text = "bоb@example.com"
    assert pii.find(text) == [("email", 0, 15, False), ("email", 2, 15, True)]
    plain = "bob@example.com and 10.0.0.1 and +1 (555) 123-4567"
    assert all(base for *_, base in pii.find(plain)) and len(pii.find(plain)) == 3


def test_long_texts_take_time_by_their_length():
    for unit in ("a", "1", " ", "1.", "a@", "+1", "one ", "at dot ", "[ ", "1 dot ", "@a dot ", "plus "):
        took = []
        for n in (20_000, 80_000):
            start = time.perf_counter()
            pii.find(unit * (n // len(unit)))
            took.append(time.perf_counter() - start)
        assert took[1] < 10 * took[0] + 0.5, unit


def test_rows(spark):
    rows = [(1, "bob@example.com", "s"), (None, "10.0.0.1", None), (2, None, "s"), (3, "", "s"), (1, "bob@example.com", "s"), (4, "b [at] c [dot] de", "s"), (5, "word " * 50_000 + "a@b.c", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string").repartition(3)
    got = sorted(((r.doc_id, [tuple(s) for s in r.spans]) for r in pii.personal_data(docs).collect()), key=repr)
    expected = [(i, pii.find(t or "")) for i, t, _ in rows]
    assert got == sorted(expected, key=repr)
    hidden = pii.redact(docs)
    assert hidden.columns == docs.columns
    kept = {(r.doc_id, r.text) for r in hidden.collect()}
    assert {(1, "[email]"), (None, "[ip]"), (2, None), (3, ""), (4, "[email]")} <= kept
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert pii.personal_data(empty).count() == pii.redact(empty).count() == 0


def test_query(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").collect()
    expected = []
    for r in docs:
        base = brute(r.text or "")
        told = ",".join(f"{k}:{b}:{e}" for k, b, e in base)
        counts = [sum(k == kind for k, *_ in base) for kind in PATTERNS]
        every = ",".join(f"{k}:{b}:{e}" for k, b, e, _ in pii.find(r.text or ""))
        expected.append((r.doc_id, *counts, hashlib.sha256(told.encode()).hexdigest(), every))
    found = QUERIES["op11_pii"](spark, data)
    assert found.columns == ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(expected, key=repr)
    assert sum(sum(e[1:5]) for e in expected) > 0
