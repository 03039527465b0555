"""Repeated passages across documents, found by merging Burrows-Wheeler transforms."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from forgemart.llm.scratch import BATCH_BYTES, map_arrow, saved, slices, texts_as_bytes

LENGTH = 100  # bytes of a passage
ANCHOR = 32  # bytes whose hash decides where a passage is compared
#: Bytes that are anchored at once, contexts of one anchor that are merged in one task at most, and
#: bytes of a shard transform and of the transforms that are merged at once.
STRETCH, CROWD, SHARD, MERGE = 1 << 20, 4096, 1 << 17, 1 << 20
#: A run's place in one number: start, then 22 bits of the text's hash, then its windows (up to 127).
_WINDOWS, _TAG = 7, 22

_draw = np.random.default_rng(11)
_CODES = _draw.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FACTORS = _draw.integers(0, 1 << 63, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def anchors(data: np.ndarray, length: int, anchor: int) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each `anchor` bytes, and for each window of `length` bytes the place of its least
    such hash, the first of equals. It depends on the window's bytes alone."""
    hashes, width = _CODES[data], 1
    while width < anchor:  # `anchor` is a power of two
        hashes = hashes[:-width] * _FACTORS[width.bit_length()] + hashes[width:]
        width *= 2
    hashes = (hashes ^ (hashes >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    hashes ^= hashes >> np.uint64(32)
    low = np.uint64((1 << 22) - 1)
    least, span, width = (hashes & ~low) | np.arange(len(hashes), dtype=np.uint64), length - anchor + 1, 1
    while 2 * width <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < span:
        least = np.minimum(least[: len(least) - (span - width)], least[span - width :])
    return hashes, (least & low).astype(np.int64)


def anchored_runs(texts: list[bytes], length: int, anchor: int):
    """(text, start, windows, anchor hash, content hash) of all runs of windows with one anchor.

    Texts are joined, long ones in stretches that overlap, so that every window stands in one run.
    """
    found: list[tuple[np.ndarray, ...]] = []
    parts: list[tuple[int, int, bytes]] = []

    def flush() -> None:
        data = b"".join(p for _, _, p in parts)
        if len(data) >= length:
            sizes = np.array([len(p) for _, _, p in parts])
            ends = np.cumsum(sizes)
            hashes, place = anchors(np.frombuffer(data, np.uint8), length, anchor)
            part = np.repeat(np.arange(len(parts)), sizes)[: len(place)]
            inside = np.arange(len(place)) + length <= ends[part]
            change = (place[1:] != place[:-1]) | (part[1:] != part[:-1]) | (inside[1:] != inside[:-1])
            begin = np.concatenate(([0], np.flatnonzero(change) + 1))
            end = np.concatenate((begin[1:], [len(place)]))
            begin, end = begin[inside[begin]], end[inside[begin]]
            digest = xxhash.xxh64_intdigest
            spans = zip(begin.tolist(), (end + (length - 1)).tolist(), strict=True)
            content = np.fromiter((digest(data[a:b]) for a, b in spans), np.uint64, len(begin))
            of = part[begin]
            text = np.array([t for t, _, _ in parts])[of]
            shift = np.array([s for _, s, _ in parts])[of] - (ends - sizes)[of]
            found.append((text, begin + shift, end - begin, hashes[place[begin]].view(np.int64), content.view(np.int64)))
        parts.clear()

    size = 0
    for i, text in enumerate(texts):
        for start in range(0, max(len(text) - length + 1, 0), STRETCH):
            parts.append((i, start, text[start : start + STRETCH + length - 1]))
            size += len(parts[-1][2])
            if size >= STRETCH:
                flush()
                size = 0
    flush()
    if not found:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


class Transform:
    """Burrows-Wheeler transform of a shard of byte strings, each ended by a mark of its own.

    Row r stands for the suffix at `suffixes[r]`, in lexicographic order; `before[r]` is the symbol in
    front of it (0: the string begins).
    """

    def __init__(self, strings: list[bytes]):
        lengths = np.array([len(s) for s in strings])
        ends = np.cumsum(lengths + 1) - 1
        text = np.frombuffer(b"\0".join(strings) + b"\0", np.uint8).astype(np.int16) + 1
        text[ends] = 0
        n = len(text)
        string = np.repeat(np.arange(len(strings)), lengths + 1)
        rest = ends[string] - np.arange(n)
        padded = np.concatenate((text, np.zeros(7, np.int16)))
        key = np.zeros(n, np.int64)
        for gap in range(7):
            key = (key << 9) | np.where(rest > gap, padded[gap : gap + n], 0)
        reach = 7
        while True:
            order = np.argsort(key)
            ordered = key[order]
            rank = np.empty(n, np.int64)
            rank[order] = np.concatenate(([0], np.cumsum(ordered[1:] != ordered[:-1])))
            if rank[order[-1]] == n - 1:
                break
            # Suffixes that tie beyond their end are equally long; their strings' marks decide.
            ahead = rank[np.minimum(np.arange(n) + reach, n - 1)]
            key = rank * n + np.where(rest < reach, string, ahead)
            reach *= 2
        self.suffixes, self.string, self.begin = order, string, ends - lengths
        self.text, self.rank = text, rank
        self.before = text[order - 1]
        self.before[order == 0] = 0

    def back(self, many: int, codes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """Of each row, the `many` symbols before it as one number of codes of `bits` bits, the
        farthest first (0: the string begins earlier), and the row of the suffix that begins there."""
        code = codes[self.text]
        key, whole = np.zeros(len(code), np.int64), np.ones(len(code), bool)
        for gap in range(1, many + 1):
            here = np.concatenate((np.zeros(min(gap, len(code)), np.int64), code[:-gap]))
            key |= here << bits * (gap - 1)
            whole &= here > 0
        return np.where(whole, key, 0)[self.suffixes], self.rank[self.suffixes - many]


def repeated_intervals(shards: list[Transform], length: int) -> tuple[np.ndarray, np.ndarray]:
    """Merges shard transforms: (interval, row) of all rows, numbered through the shards, whose suffix
    has its first `length` symbols in common with another's.

    The interleave of the shards' rows is refined by a few symbols a turn (Holt and McMillan 2014):
    stably sorting the rows by the symbols before them, and stepping each to the left in its own
    shard, turns their order by k symbols into that by a few more. Rows that part there have less in
    common, so the rows still in one interval after `length` symbols agree that far. Intervals of one
    row can't become larger and are left out of further turns; no suffix is sorted again. A turn
    takes as many symbols as fit a long beside a row's place, which keeps the sort stable.
    """
    shift = np.cumsum([0] + [len(s.before) for s in shards])
    used = np.unique(np.concatenate([s.before for s in shards]))
    codes = np.zeros(257, np.int64)
    codes[used[used > 0]] = np.arange(1, (used > 0).sum() + 1)
    bits, place = int(codes.max()).bit_length() or 1, int(shift[-1]).bit_length()
    most = max(min((63 - place) // bits, length), 1)
    steps: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    rows = np.arange(shift[-1])
    interval = np.zeros(len(rows), np.int64)
    for done in range(0, length, most):
        many = min(most, length - done)
        if many not in steps:
            both = [s.back(many, codes, bits) for s in shards]
            left = [b + n for (_, b), n in zip(both, shift, strict=False)]
            steps = {many: (np.concatenate([a for a, _ in both]), np.concatenate(left))}
        before, left = steps[many]
        symbol = before[rows]
        open_ = symbol > 0
        rows, interval, symbol = rows[open_], interval[open_], symbol[open_]
        if not len(rows):
            break
        key = symbol << place | np.arange(len(rows))
        key.sort()
        order, symbol = key & ((1 << place) - 1), key >> place
        rows, interval = left[rows[order]], interval[order]
        new = np.concatenate(([True], (symbol[1:] != symbol[:-1]) | (interval[1:] != interval[:-1])))
        single = new & np.concatenate((new[1:], [True]))
        interval = np.cumsum(new)
        rows, interval = rows[~single], interval[~single]
    return interval, rows


def later_windows(strings: list[bytes], places: np.ndarray, length: int) -> list[tuple[int, int, int]]:
    """(string, offset, windows): runs of the windows that also stand at an earlier place.

    `places` has (document, start, tag) of each string; a window's place is that with its offset
    added to the start.
    """
    groups, size = [[]], 0
    for i, s in enumerate(strings):
        if size >= SHARD:
            groups, size = [*groups, []], 0
        groups[-1].append(i)
        size += len(s)
    shards = [Transform([strings[i] for i in group]) for group in groups]
    interval, row = repeated_intervals(shards, length)
    if not len(row):
        return []
    shift = np.cumsum([0] + [len(s.before) for s in shards])
    string, offset = np.empty(len(row), np.int64), np.empty(len(row), np.int64)
    for shard, group, a, b in zip(shards, groups, shift, shift[1:], strict=False):
        mine = (row >= a) & (row < b)
        suffix = shard.suffixes[row[mine] - a]
        inner = shard.string[suffix]
        string[mine], offset[mine] = np.array(group)[inner], suffix - shard.begin[inner]
    document, start, tag = places[string].T
    order = np.lexsort((tag, start + offset, document, interval))
    at = np.stack((interval, document, start + offset, tag))[:, order]
    # A run may stand here under several keys: what is at the first's own place is no repeat of it.
    first = np.maximum.accumulate(np.where(np.concatenate(([True], at[0, 1:] != at[0, :-1])), np.arange(len(order)), 0))
    later = (at != at[:, first]).any(0)
    string, offset = string[order][later], offset[order][later]
    order = np.lexsort((offset, string))
    string, offset = string[order], offset[order]
    new = np.concatenate(([True], (string[1:] != string[:-1]) | (offset[1:] != offset[:-1] + 1)))[: len(string)]
    new = np.flatnonzero(new)
    many = np.diff(np.concatenate((new, [len(string)])))
    return list(zip(string[new].tolist(), offset[new].tolist(), many.tolist(), strict=True))


def _pack(start: np.ndarray, tag: np.ndarray, windows: np.ndarray) -> np.ndarray:
    return (start << (_WINDOWS + _TAG)) | (tag << _WINDOWS) | windows


def _split(packed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return packed >> (_WINDOWS + _TAG), (packed >> _WINDOWS) & ((1 << _TAG) - 1), packed & ((1 << _WINDOWS) - 1)


def _batch(columns: list, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names)


def _runs(rows: DataFrame, length: int, anchor: int) -> DataFrame:
    """(anchor, content, id, packed): runs of all texts. Of equal runs in one batch only the first is
    left to be compared; the others are known repeats, without content and dealt out by place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            ids, tags = (batch.column(c).to_numpy() for c in ("id", "tag"))
            text, start, windows, hashes, content = anchored_runs(texts_as_bytes(batch, "text"), length, anchor)
            packed, ids = _pack(start, tags[text], windows), ids[text]
            order = np.lexsort((packed, ids, content, hashes))
            packed, ids, content, hashes = (x[order] for x in (packed, ids, content, hashes))
            new = np.concatenate(([True], (hashes[1:] != hashes[:-1]) | (content[1:] != content[:-1])))[: len(ids)]
            first = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
            repeat = (ids != ids[first]) | (packed != packed[first])  # rows that are equal don't repeat each other
            spread = (ids * 0x9E3779B1) ^ (packed >> _WINDOWS)
            columns = [np.where(repeat, spread, hashes), pa.array(content, mask=repeat), ids, packed]
            yield _batch(columns, ["anchor", "content", "id", "packed"])

    return map_arrow(rows, run, "anchor long, content long, id long, packed long")


def _decided(runs: DataFrame) -> DataFrame:
    """(id, packed, anchor): repeated runs, without an anchor; and, where an anchor has several
    contents, the first run of each, with it. All other runs have no repeat."""
    runs = runs.repartition("anchor")
    order = Window.partitionBy("anchor", "content").orderBy("id", "packed")
    place, whole = F.struct("id", "packed"), Window.partitionBy("anchor")
    runs = runs.withColumns({
        "repeat": F.col("content").isNull() | (place != F.first(place).over(order)),
        "number": F.row_number().over(order),
    }).withColumn("mixed", F.min("content").over(whole) != F.max("content").over(whole))
    runs = runs.where("repeat or (mixed and number = 1)")
    return runs.select("id", "packed", F.when(~F.col("repeat"), F.col("anchor")).alias("anchor"))


def _contexts(rows: DataFrame, wanted: DataFrame, length: int, anchor: int) -> DataFrame:
    """(key, id, packed, data) of the wanted runs (id, tag, packed, anchor): the bytes of a run's
    windows, once for each side on which a window could be equal to one of another run.

    A window has length - anchor bytes besides its anchor, so that two equal ones agree in the half
    of these that stands before the anchor, or in as many behind it. Each of the two, together with
    the anchor, is a longer anchor: equal windows meet at one of its two keys, and runs that share
    neither with another run have no repeat.
    """
    half = (length - anchor + 1) // 2
    listed = wanted.groupBy("id", "tag").agg(F.sort_array(F.collect_list(F.struct("packed", "anchor"))).alias("wanted"))
    found = rows.join(listed, ["id", "tag"], "left").where("wanted is not null").select("id", "text", "wanted")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_intdigest
        for batch in slices(batches, "text"):
            lists, texts = batch.column("wanted"), texts_as_bytes(batch, "text")
            each = lists.flatten()
            owner = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy())
            packed, marks = (each.field(c).to_numpy() for c in ("packed", "anchor"))
            start, _, windows = _split(packed)
            stop = start + windows + (length - 1)
            data = [texts[i][a:b] for i, a, b in zip(owner.tolist(), start.tolist(), stop.tolist(), strict=True)]
            # The anchor's place in each: where its bytes have its hash, inside all of the run's windows.
            joined = np.frombuffer(b"".join(data) + bytes(anchor), np.uint8)
            ends = np.cumsum(stop - start)
            begin = ends - (stop - start)
            hashes, _ = anchors(joined, anchor, anchor)
            low = begin + windows - 1  # where the last window begins
            high = begin + (length - anchor)  # the first window's last place for an anchor
            place = np.full(len(data), -1)
            for gap in range(int((high - low).max(initial=-1)) + 1):
                at = low + gap
                hit = (place < 0) & (at <= high)
                hit[hit] = hashes[at[hit]].view(np.int64) == marks[hit]
                place[hit] = at[hit]
            at = place - begin
            keys, rows_of = [], []
            for i, (p, mark) in enumerate(zip(at.tolist(), marks.tolist(), strict=True)):
                for side, a, b in ((0, p - half, p), (1, p + anchor, p + anchor + half)):
                    if a >= 0 and b <= len(data[i]):
                        keys.append((digest(data[i][a:b], mark & 0xFFFFFFFF) << 1 | side) & (1 << 64) - 1)
                        rows_of.append(i)
            take = pa.array(rows_of, pa.int64())
            yield _batch(
                [np.array(keys, np.uint64).view(np.int64), batch.column("id").take(pa.array(owner)).take(take),
                 pa.array(packed).take(take), pa.array(data, pa.binary()).take(take)],
                ["key", "id", "packed", "data"],
            )

    return map_arrow(found, run, "key long, id long, packed long, data binary")


def _merged(contexts: DataFrame, length: int) -> DataFrame:
    """(id, packed) of the runs of repeated windows in contexts (key, id, packed, data): all of one
    key meet in one task, which merges the transforms of whole keys at a time."""

    def merge(rows: list[tuple]) -> pa.RecordBatch:
        packed = np.array([r[2] for r in rows], np.int64)
        start, tag, _ = _split(packed)
        places = np.stack((np.array([r[1] for r in rows], np.int64), start, tag), 1)
        found = np.array(later_windows([r[3] for r in rows], places, length), np.int64).reshape(-1, 3)
        string, offset, windows = found.T
        return _batch([places[string, 0], _pack(start[string] + offset, tag[string], windows)], ["id", "packed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if size >= MERGE and row[0] != rows[-1][0]:
                    yield merge(rows)
                    rows, size = [], 0
                rows.append(row)
                size += len(row[3])
        if rows:
            yield merge(rows)

    rows = contexts.repartition("key").sortWithinPartitions("key").select("key", "id", "packed", "data")
    return map_arrow(rows, run, "id long, packed long")


def _crowds(contexts: DataFrame, length: int) -> DataFrame:
    """The same for keys of more than CROWD contexts, by a 128-bit hash of each window, so that no
    task holds such a key's contexts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "data", BATCH_BYTES // 16):
            found = []
            for i, p, data in zip(*(batch.column(c).to_pylist() for c in ("id", "packed", "data")), strict=True):
                one = p + 1 - (p & ((1 << _WINDOWS) - 1))
                for k in range(len(data) - length + 1):
                    found.append((xxhash.xxh128_digest(data[k : k + length]), i, one + (k << (_WINDOWS + _TAG))))
            columns = list(zip(*found, strict=True)) or [[], [], []]
            kinds = pa.binary(), pa.int64(), pa.int64()
            yield _batch([pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)], ["window", "id", "packed"])

    rows = map_arrow(contexts.select("id", "packed", "data"), run, "window binary, id long, packed long")
    first = rows.groupBy("window").agg(F.min(F.struct("id", "packed")).alias("first"), F.count("*").alias("n"))
    return rows.join(first.where("n > 1"), "window").where(F.struct("id", "packed") != F.col("first")).select("id", "packed")


def remove_repeats(docs: DataFrame, length: int = LENGTH, *, doc_id="doc_id", text="text", crowd: int = CROWD) -> DataFrame:
    """(doc_id, n_bytes, spans, kept) of every row: spans are the maximal byte ranges [begin, end)
    covered by `length`-byte strings that also start earlier (in a row of a smaller id, or further
    left in the same), judged on the input; kept is the bytes outside them.

    Null texts are empty. Rows with one id are ordered by the string's start, then by 22 bits of
    their texts' hash, which tells them apart; rows equal in both get one result. A row without an
    id takes its place by its text's hash. Strings never reach over documents.

    Every window of `length` bytes belongs to one anchor, the least hash of ANCHOR bytes in it, so
    equal windows meet at equal anchors. Neighbouring windows of one anchor are a run. Runs that are
    equal as a whole repeat the first of them; only where an anchor has different runs are their
    bytes compared, by merging the Burrows-Wheeler transforms of shards of them.
    """
    content = F.coalesce(F.xxhash64(F.col(text)), F.lit(0))
    rows = docs.select(
        F.coalesce(F.col(doc_id).cast("long"), content).alias("id"),
        content.bitwiseAND((1 << (_TAG - 1)) - 1) * 2 + F.col(doc_id).isNull().cast("long"),
        F.col(doc_id).alias("doc_id"), F.col(text).alias("text"),
    )
    rows = rows.toDF("id", "tag", "doc_id", "text")
    runs = _runs(rows.select("id", "tag", "text"), length, ANCHOR)
    decided = saved(_decided(runs))
    tag = F.shiftright("packed", _WINDOWS).bitwiseAND((1 << _TAG) - 1)
    several = decided.where("anchor is not null").withColumn("tag", tag)
    texts = rows.select("id", "tag", "doc_id", "text")
    contexts = saved(_contexts(texts, several, length, ANCHOR))
    counts = contexts.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    contexts = contexts.join(counts.select("key", (F.col("n") > crowd).alias("crowd")), "key")
    found = decided.where("anchor is null").select("id", "packed")
    found = found.union(_merged(contexts.where("not crowd"), length)).union(_crowds(contexts.where("crowd"), length))
    found = found.withColumn("tag", tag).groupBy("id", "tag").agg(F.collect_list("packed").alias("runs"))
    joined = texts.join(found, ["id", "tag"], "left").select("doc_id", "text", "runs")
    kind = rows.schema["doc_id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            data, spans, kept = texts_as_bytes(batch, "text"), [], []
            for i, text in enumerate(data):
                runs = batch.column("runs")[i].values
                if runs is None or not len(runs):
                    spans.append([])
                    kept.append(text)
                    continue
                begin, _, windows = _split(runs.to_numpy())
                change = np.zeros(len(text) + 1, np.int64)
                np.add.at(change, begin, 1)
                np.add.at(change, begin + windows + (length - 1), -1)
                covered = np.cumsum(change) > 0
                edge = np.diff(np.concatenate(([0], covered.astype(np.int8), [0])))
                both = zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True)
                spans.append([{"begin": a, "end": b} for a, b in both])
                kept.append(np.frombuffer(text, np.uint8)[~covered[:-1]].tobytes())
            span = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
            columns = [batch.column("doc_id"), pa.array(map(len, data), pa.int64()), pa.array(spans, span), pa.array(kept, pa.binary())]
            yield _batch(columns, ["doc_id", "n_bytes", "spans", "kept"])

    return map_arrow(joined, cut, f"doc_id {kind}, n_bytes long, spans array<struct<begin:long,end:long>>, kept binary")
