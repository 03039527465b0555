"""Personal data in texts, also behind look-alike characters, spelled digits and at/dot disguises."""

from __future__ import annotations

import functools
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forgemart.llm.scratch import map_texts

KINDS = ("email", "ip", "card", "phone")
SPANS = "array<struct<kind:string,begin:long,end:long,base:boolean>>"

Span = tuple[int, int]

# ---- identifiers in plain spelling ------------------------------------------------------

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_HOST = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_DOTTED = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++)++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_PART = re.compile(r"[0-9]+")
_DIGITS = str.maketrans("", "", " +().-")


def emails(text: str) -> Iterator[Span]:
    """Leftmost matches of `[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+`, found from the @ on:
    what stands before it is walked once, however long it is."""
    free = 0
    for host in _HOST.finditer(text):
        at = host.start()
        left = max(text.rfind("@", free, at) + 1, free)
        begin = left + len(text[left:at].rstrip(_LOCAL))
        if begin < at:
            free = host.end()
            yield begin, free


def addresses(text: str) -> Iterator[Span]:
    """Four dotted numbers of at most 255, taken from the left of a dotted run."""
    for run in _DOTTED.finditer(text):
        parts = list(_PART.finditer(text, *run.span()))
        for i in range(0, len(parts) - 3, 4):
            values = [p.group().lstrip("0") for p in parts[i : i + 4]]
            if all(len(v) <= 3 and int(v or 0) <= 255 for v in values):
                yield parts[i].start(), parts[i + 3].end()


def _luhn(digits: str) -> bool:
    doubled = (2 * int(d) for d in digits[-2::-2])
    return (sum(map(int, digits[::-2])) + sum(d - 9 if d > 9 else d for d in doubled)) % 10 == 0


def cards(text: str) -> Iterator[Span]:
    """13 to 19 digits, single spaces or hyphens between them, with a right check digit."""
    for m in _CARD.finditer(text):
        digits = m.group().translate(_DIGITS)
        if 13 <= len(digits) <= 19 and _luhn(digits):
            yield m.span()


def phones(text: str) -> Iterator[Span]:
    """9 to 15 digits behind a plus sign."""
    for m in _PHONE.finditer(text):
        if 9 <= len(m.group().translate(_DIGITS)) <= 15:
            yield m.span()


FINDERS: dict[str, Callable[[str], Iterator[Span]]] = dict(
    zip(KINDS, (emails, addresses, cards, phones), strict=True)
)

# ---- transducers ------------------------------------------------------------------------


@dataclass
class Rewritten:
    """What a transducer makes of a text, and where each rewritten piece comes from."""

    text: str
    at: list[int] = field(default_factory=list)  # pieces in the new text,
    to: list[int] = field(default_factory=list)
    begin: list[int] = field(default_factory=list)  # and in the old one
    end: list[int] = field(default_factory=list)

    def _piece(self, i: int) -> Span:
        k = bisect_right(self.at, i) - 1
        if k < 0:
            return i, i + 1
        if i < self.to[k]:
            return self.begin[k], self.end[k]
        i += self.end[k] - self.to[k]
        return i, i + 1

    def source(self, span: Span) -> Span:
        """The stretch of the old text that a stretch of the new one comes from."""
        return self._piece(span[0])[0], self._piece(span[1] - 1)[1]


Step = Callable[[str], Rewritten]


def rewrite(text: str, pieces: Iterable[tuple[int, int, str]]) -> Rewritten:
    """The text with pieces (begin, end, new), given from left to right, put in place."""
    made = Rewritten(text)
    parts, done, size = [], 0, 0
    for begin, end, new in pieces:
        parts += (text[done:begin], new)
        made.at.append(size + begin - done)
        size += begin - done + len(new)
        done = end
        made.to.append(size)
        made.begin.append(begin)
        made.end.append(end)
    if parts:
        made.text = "".join([*parts, text[done:]])
    return made


def transducer(pattern: re.Pattern, output: Callable[[re.Match], str], hint: Callable[[str], object]) -> Step:
    """A step that rewrites the leftmost matches of a pattern and copies everything else. Texts of
    which `hint` is false have no match."""
    def run(text: str) -> Rewritten:
        if not hint(text):
            return Rewritten(text)
        return rewrite(text, ((*m.span(), output(m)) for m in pattern.finditer(text)))

    return run


def _pattern(text: str) -> re.Pattern:
    return re.compile(text, re.IGNORECASE)


_SPLIT = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


@functools.lru_cache(2)
def _words(text: str) -> list[bytes]:
    """The lower-cased words of a text, in order: cheap to ask before patterns are tried."""
    return text.lower().encode().translate(_SPLIT).split()


# Cyrillic, Greek and other letters that look like Latin ones, marks that look like
# ASCII marks, and the letters that stand for digits between digits.
LOOK_ALIKES = (
    "АA ВB СC ЕE НH ІI ЈJ КK МM ОO РP ЅS ТT ХX УY ЗZ аa сc ԁd еe һh іi јj ӏl оo рp ԛq ѕs ԝw хx уy "
    "ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX αa ιi κk νv οo ρp υu χx ϲc ϳj "
    "ıi ȷj ɑa ɡg ʏy ԍg ⅼl "
    "‐- ‑- ‒- –- —- −- ﹣- ·. •. ‧. ∙. ⋅. 。. ․. ⁄/"
)
DIGIT_LETTERS = {"O": "0", "o": "0", "I": "1", "l": "1", "|": "1"}
INVISIBLE = "­​‌‍‎‏⁠﻿"

# Digits 0 to 9 in English, German, French and Spanish.
DIGIT_WORDS = (
    "zero one two three four five six seven eight nine",
    "null eins zwei drei vier fünf sechs sieben acht neun",
    "zéro un deux trois quatre cinq six sept huit neuf",
    "cero uno dos tres cuatro cinco seis siete ocho nueve",
)
#: Words that say a digit more than once, and a short zero.
TIMES = {"double": 2, "triple": 3}
SHORT_ZERO = "oh"


@functools.lru_cache(1)
def _glyph_table() -> dict[str, str]:
    """ASCII for characters that Unicode's compatibility forms or LOOK_ALIKES equate with it."""
    table = {pair[0]: pair[1] for pair in LOOK_ALIKES.split()} | dict.fromkeys(INVISIBLE, "")
    for code in range(0x80, 0x1FBFA):
        c = chr(code)
        plain = unicodedata.normalize("NFKC", c)
        if plain != c and plain.isascii() and plain.strip() or unicodedata.category(c) == "Zs":
            table.setdefault(c, plain if plain.isascii() else " ")
        elif unicodedata.category(c) == "Nd":
            table.setdefault(c, str(unicodedata.digit(c)))
    return table


@functools.lru_cache(1)
def _glyphs() -> Step:
    """Homoglyphs to ASCII. One for one pieces keep their places, so only others are noted."""
    table = _glyph_table()
    single = str.maketrans({c: new for c, new in table.items() if len(new) == 1})

    def run(text: str) -> Rewritten:
        if text.isascii() or not (glyphs := table.keys() & set(text)):
            return Rewritten(text)
        uneven = "".join(re.escape(c) for c in sorted(glyphs) if len(table[c]) != 1)
        text = text.translate(single)
        if not uneven:
            return Rewritten(text)
        return rewrite(text, ((*m.span(), table[m.group()]) for m in re.finditer(f"[{uneven}]", text)))

    return run


# Words for the signs in an address.
AT_WORDS = ("at", "arroba", "arobase", "ät")
DOT_WORDS = ("dot", "punkt", "point", "punto")
_AT, _DOT = f"(?:{'|'.join(AT_WORDS)})", f"(?:{'|'.join(DOT_WORDS)})"
_OPEN, _CLOSE = r"[\[({<]", r"[\])}>]"
_SPACE = r"[\t-\r\x20]"
_LABEL = r"[A-Za-z0-9-]{1,63}"
_BARE_AT = rf"(?:{_SPACE}{{1,3}}{_AT}{_SPACE}{{1,3}}|[_-]{_AT}[_-])"
_BARE_DOT = rf"(?:{_SPACE}{{1,3}}{_DOT}{_SPACE}{{1,3}}|[_-]{_DOT}[_-])"
_dots = frozenset(w.encode() for w in DOT_WORDS)


def _spells_dot(text: str) -> bool:
    return not _dots.isdisjoint(_words(text))


# A sign in brackets, or as a character reference, is a sign anywhere.
_signs = transducer(
    _pattern(
        rf"{_SPACE}{{0,3}}{_OPEN}{_SPACE}{{0,2}}(?:(?P<at>@|{_AT})|\.|{_DOT}){_SPACE}{{0,2}}{_CLOSE}{_SPACE}{{0,3}}"
        r"|(?P<at2>&\#(?:64|x40);|&commat;|%40)|&\#(?:46|x2e);|&period;|%2e"
    ),
    lambda m: "@" if m["at"] or m["at2"] else ".",
    re.compile(r"[\[({<&%]").search,
)
# A bare word `at` is a sign only where a spelled dot follows in the same host.
_bare_at = transducer(
    _pattern(rf"(?<=[A-Za-z0-9_%+-]){_BARE_AT}(?={_LABEL}(?:\.{_LABEL}){{0,8}}{_BARE_DOT}[A-Za-z])"),
    lambda m: "@",
    _spells_dot,
)
# A bare word `dot` is a sign only in a host behind an @ that ends like one, and in the name before it.
_host = _pattern(
    rf"@{_LABEL}(?:\.{_LABEL}|{_BARE_DOT}(?=[A-Za-z0-9-]{{2}}){_LABEL})*{_BARE_DOT}[A-Za-z]{{2,24}}(?![A-Za-z0-9])"
    r"(?:\.[A-Za-z]{2,24}(?![A-Za-z0-9]))*"
)
_name = _pattern(rf"(?<![A-Za-z0-9])(?:[A-Za-z0-9-]{{1,40}}{_BARE_DOT}){{1,4}}[A-Za-z0-9._%+-]{{1,64}}$")
_dot = _pattern(_BARE_DOT)


def _dots_in_hosts(text: str) -> Iterator[tuple[int, int, str]]:
    free = 0
    for host in _host.finditer(text):
        before = max(free, host.start() - 250)
        name = _name.search(text[before : host.start()])
        for m in _dot.finditer(text, before + name.start() if name else host.start(), host.end()):
            yield *m.span(), "."
        free = host.end()


def _bare_dots(text: str) -> Rewritten:
    return rewrite(text, _dots_in_hosts(text)) if "@" in text and _spells_dot(text) else Rewritten(text)


_VALUES = {word: str(i) for words in DIGIT_WORDS for i, word in enumerate(words.split())} | {SHORT_ZERO: "0"}
_NUMBER = rf"(?:(?:{'|'.join(TIMES)}){_SPACE})?(?:{'|'.join(sorted(_VALUES, key=len, reverse=True))})"
_LETTER = r"[^\W\d_]"
_BETWEEN = rf"(?:{_SPACE}?[,;]{_SPACE}|{_SPACE}-{_SPACE}|{_SPACE}|-)"
_number = _pattern(_NUMBER)
_numerals = frozenset(w.encode() for w in (*_VALUES, *TIMES))


def _spells_digits(text: str) -> bool:
    """Whether a number word has another, or digits on both sides, as neighbours."""
    words = _words(text)
    if _numerals.isdisjoint(words):
        return False
    at = [i for i, w in enumerate(words) if w in _numerals]
    if any(b - a == 1 for a, b in zip(at, at[1:])):
        return True
    return any(words[i - 1][-1:].isdigit() and words[i + 1][:1].isdigit() for i in at if 0 < i < len(words) - 1)


def _say(m: re.Match) -> str:
    """The digits of a run of number words; between them one space or what stood there alone."""
    parts, done = [], m.start()
    for word in _number.finditer(m.string, *m.span()):
        gap = m.string[done : word.start()]
        parts.append(gap if gap in ("", " ", "-") else " ")
        *times, name = word.group().lower().split()
        parts.append(_VALUES[name] * (TIMES[times[0]] if times else 1))
        done = word.end()
    return "".join(parts)


# Two number words in a row at least, or one between digits.
_spelled = transducer(
    _pattern(
        rf"(?<!{_LETTER})(?:{_NUMBER}(?:{_BETWEEN}{_NUMBER})+|(?<=[0-9][\x20-]){_NUMBER}(?=[\x20-][0-9]))(?!{_LETTER})"
    ),
    _say,
    _spells_digits,
)
# Look-alike letters in a group that has a digit.
_digit_letters = transducer(
    re.compile(r"(?<![A-Za-z0-9|])(?=[OoIl|]*[0-9])[0-9OoIl|]{2,}(?![A-Za-z0-9|])"),
    lambda m: m.group().translate(str.maketrans(DIGIT_LETTERS)),
    re.compile(r"[0-9][OoIl|]|[OoIl|][0-9]").search,
)
_number_signs = transducer(
    _pattern(
        rf"(?<=[0-9])(?:{_SPACE}?{_OPEN}{_SPACE}?(?:\.|{_DOT}){_SPACE}?{_CLOSE}{_SPACE}?|{_SPACE}{_DOT}{_SPACE})(?=[0-9])"
        rf"|(?<!{_LETTER})plus{_SPACE}{{0,2}}(?=[0-9(])"
    ),
    lambda m: "+" if m.group()[0] in "pP" else ".",
    lambda text: b"plus" in _words(text) or _spells_dot(text) or re.search(rf"[0-9]\s?{_OPEN}", text),
)

#: Each kind's chain of transducers behind the homoglyphs.
CHAINS: dict[tuple[str, ...], tuple[Step, ...]] = {
    ("email",): (_signs, _bare_at, _bare_dots),
    ("ip", "card", "phone"): (_spelled, _digit_letters, _number_signs),
}


def find(text: str) -> list[tuple[str, int, int, bool]]:
    """(kind, begin, end, base) of all identifiers in a text, by kind as in KINDS and place, in code
    points. `base` ones stand there in plain spelling. A disguised one is added unless it lies in a
    base one of its kind; where it reaches beyond base ones, these stay beside it."""
    found: dict[str, dict[Span, bool]] = {kind: dict.fromkeys(FINDERS[kind](text), True) for kind in KINDS}
    plain = _glyphs()(text)
    for kinds, chain in CHAINS.items():
        steps = [plain]
        for step in chain:
            steps.append(step(steps[-1].text))
        if steps[-1].text == text:
            continue
        for kind in kinds:
            known = sorted(found[kind])
            starts = [s for s, _ in known]
            for span in list(FINDERS[kind](steps[-1].text)):
                for step in reversed(steps):
                    span = step.source(span)
                k = bisect_right(starts, span[0]) - 1
                if k < 0 or known[k][1] < span[1]:
                    found[kind].setdefault(span, False)
    return [(kind, *span, base) for kind in KINDS for span, base in sorted(found[kind].items())]


def personal_data(docs: DataFrame, *, doc_id="doc_id", text="text") -> DataFrame:
    """(doc_id, spans) of every row: kind, begin, end (exclusive, in code points) and base of each
    identifier, by kind as in KINDS, then place.

    base ones match in plain spelling, leftmost and without overlaps in their kind: e-mail
    addresses, IPv4 addresses, card numbers with a right check digit, phone numbers behind a plus
    sign. Others are found in what transducers make of the text (homoglyphs and invisible
    characters; at and dot in brackets, as references or as words; digits as words or look-alike
    letters) and mapped back to the characters they come from. Null and empty texts have no spans;
    repeated rows repeat; ids may be null or of any type; other columns are not read; an empty table
    gives an empty result. A text is read whole, in time that grows with its length.
    """
    def batch(rows: pa.RecordBatch) -> pa.RecordBatch:
        spans = [
            [dict(zip(("kind", "begin", "end", "base"), s, strict=True)) for s in find(t or "")]
            for t in rows.column("text").to_pylist()
        ]
        return pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(spans, _ARROW)], ["doc_id", "spans"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return map_texts(rows, "text", batch, f"doc_id {kind}, spans {SPANS}")


_ARROW = pa.list_(
    pa.struct([("kind", pa.string()), ("begin", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())])
)


def hide(text: str) -> str:
    """The text with each stretch of identifiers replaced by its first one's kind in brackets."""
    merged: list[tuple[int, int, str]] = []
    for begin, end, kind in sorted((b, e, k) for k, b, e, _ in find(text)):
        if merged and begin < merged[-1][1]:
            merged[-1] = (merged[-1][0], max(end, merged[-1][1]), merged[-1][2])
        else:
            merged.append((begin, end, kind))
    parts, done = [], 0
    for begin, end, kind in merged:
        parts += (text[done:begin], f"[{kind}]")
        done = end
    return "".join([*parts, text[done:]])


def redact(docs: DataFrame, *, text="text") -> DataFrame:
    """All rows and columns, the identifiers in the texts replaced by their kinds. Null stays null."""
    def batch(rows: pa.RecordBatch) -> pa.RecordBatch:
        at = rows.schema.get_field_index(text)
        new = [None if t is None else hide(t) for t in rows.column(at).to_pylist()]
        return rows.set_column(at, rows.schema.field(at), pa.array(new, rows.schema.field(at).type))

    return map_texts(docs, text, batch, docs.schema)
