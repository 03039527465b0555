"""Benchmark passages in training documents, found through an FM-index of each shard."""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from forgemart.llm.scratch import map_arrow, saved, slices, texts_as_bytes, whole_number

#: Characters of benchmark text that are sent to the tasks at once.
BLOCK_CHARS = 4 << 20
SAMPLED = 8  # every so many suffix positions of a shard are kept

#: Word characters are 0-9, a-z (A-Z lowered) and all beyond ASCII; others part words.
_WORDS = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256)).lower()


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_WORDS).split()


class WaveletTree:
    """Ranks of symbols in a sequence: a bit vector for each bit of the symbols, from the highest
    down, each stably parted by the bits above."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.levels = []
        for bit in range(bits - 1, -1, -1):
            ones = (symbols >> bit & 1).astype(bool)
            packed = np.packbits(ones, bitorder="little")
            packed = np.concatenate((packed, np.zeros(16 - len(packed) % 8, np.uint8)))[: len(ones) // 64 * 8 + 8]
            words = packed.view(np.uint64)
            before = np.concatenate(([0], np.cumsum(np.bitwise_count(words), dtype=np.int64)))
            zeros = len(ones) - int(ones.sum())
            self.levels.append((bit, words, before, zeros))
            symbols = np.concatenate((symbols[~ones], symbols[ones]))
        self.first = np.zeros(1 << bits, np.int64)
        self.first = self._descend(np.arange(1 << bits), np.zeros(1 << bits, np.int64))

    def _ones(self, level: tuple, i: np.ndarray) -> np.ndarray:
        _, words, before, _ = level
        low = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return before[i >> 6] + np.bitwise_count(words[i >> 6] & low)

    def _descend(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        for level in self.levels:
            ones = self._ones(level, i)
            i = np.where(symbol >> level[0] & 1, level[3] + ones, i - ones)
        return i

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before place i."""
        return self._descend(symbol, i) - self.first[symbol]

    def access(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols at places i, and their ranks there."""
        symbol = np.zeros(len(i), np.int64)
        for level in self.levels:
            bit, words, _, zeros = level
            one = (words[i >> 6] >> (i & 63).astype(np.uint64) & np.uint64(1)).astype(np.int64)
            ones = self._ones(level, i)
            i = np.where(one, zeros + ones, i - ones)
            symbol |= one << bit
        return symbol, i - self.first[symbol]


class ShardIndex:
    """FM-index of a sequence of word numbers; 0 parts stretches that no pattern spans."""

    def __init__(self, sequence: np.ndarray, bits: int):
        n = len(sequence)
        parting = sequence == 0
        # Every 0 ranks below all words and differs from every other 0, so suffixes differ early.
        rank = np.where(parting, np.cumsum(parting) - 1, sequence.astype(np.int64) + parting.sum())
        reach = 1
        while True:
            ahead = np.zeros(n, np.int64)
            ahead[: n - reach] = rank[reach:] + 1
            key = rank * (max(n, int(rank.max())) + 2) + ahead
            suffixes = np.argsort(key, kind="stable")
            ordered = key[suffixes]
            new = np.concatenate(([0], np.cumsum(ordered[1:] != ordered[:-1])))
            rank = np.empty(n, np.int64)
            rank[suffixes] = new
            if new[-1] == n - 1:
                break
            reach *= 2
        before = sequence[suffixes - 1]
        before[suffixes == 0] = 0
        self.tree = WaveletTree(before, bits)
        self.counts = np.concatenate(([0], np.cumsum(np.bincount(sequence, minlength=1 << bits))))
        # Positions at regular steps and at starts of stretches: walks never cross a 0.
        kept = (suffixes % SAMPLED == 0) | (before == 0)
        self.kept, self.kept_before, self.positions = kept, np.cumsum(kept) - kept, suffixes[kept]

    def find(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(pattern, position) of every occurrence. Patterns are rows of word numbers, right-aligned."""
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.counts[-1])
        who = np.arange(len(patterns))
        for step in range(1, patterns.shape[1] + 1):
            active = who[(lengths[who] >= step)]
            symbol = patterns[active, -step]
            low[active] = self.counts[symbol] + self.tree.rank(symbol, low[active])
            high[active] = self.counts[symbol] + self.tree.rank(symbol, high[active])
            who = who[low[who] < high[who]]
        many = high[who] - low[who]
        pattern = np.repeat(who, many)
        row = np.repeat(low[who], many) + np.arange(len(pattern)) - np.repeat(np.cumsum(many) - many, many)
        position = np.empty(len(row), np.int64)
        left, walked = np.arange(len(row)), 0
        while len(left):
            at = row[left]
            known = self.kept[at]
            position[left[known]] = self.positions[self.kept_before[at[known]]] + walked
            left, at = left[~known], at[~known]
            symbol, rank = self.tree.access(at)
            row[left] = self.counts[symbol] + rank
            walked += 1
        return pattern, position


@dataclass
class Queries:
    """A block of benchmark items as windows of word numbers."""

    numbers: dict[bytes, int]
    patterns: np.ndarray
    lengths: np.ndarray
    items: list[list[str]]  # of each pattern

    @classmethod
    def of(cls, rows: list[tuple[str | None, str | None]], window: int) -> Queries:
        numbers: dict[bytes, int] = {}
        found: dict[tuple[int, ...], set[str]] = {}
        for item, text in rows:
            ids = [numbers.setdefault(w, len(numbers) + 1) for w in words_of((text or "").encode())]
            for i in range(max(len(ids) - window, 0) + 1 if ids else 0):
                found.setdefault(tuple(ids[i : i + window]), set()).update([] if item is None else [item])
        patterns = np.zeros((len(found), window), np.int64)
        for row, ids in zip(patterns, found, strict=True):
            row[window - len(ids) :] = ids
        lengths = np.array([len(ids) for ids in found], np.int64)
        return cls(numbers, patterns, lengths, [sorted(s) for s in found.values()])

    def search(self, texts: list[bytes]) -> tuple[list[int], list[np.ndarray], list[set[str]]]:
        """Of each text: its number of words, which of them are hit, and the items that hit them."""
        numbers = [
            np.fromiter(map(self.numbers.get, words, repeat(0)), np.int64, len(words))
            for words in map(words_of, texts)
        ]
        counts = [len(x) for x in numbers]
        hits, items = [np.zeros(n, bool) for n in counts], [set() for _ in texts]
        if not len(self.lengths):
            return counts, hits, items
        # Words of no benchmark item part stretches; shorter stretches than any window hold none.
        joined = np.concatenate([part for x in numbers for part in (x, [0])] or [[0]]).astype(np.int64)
        edge = np.diff(np.concatenate(([0], (joined > 0).astype(np.int8), [0])))
        start, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        long = stop - start >= self.lengths.min()
        start, stop = start[long], stop[long]
        if not len(start):
            return counts, hits, items
        width = stop - start + 1  # with the 0 behind it
        place = np.arange(width.sum()) + np.repeat(start - (np.cumsum(width) - width), width)
        index = ShardIndex(joined[place], len(self.numbers).bit_length())
        pattern, position = index.find(self.patterns, self.lengths)
        position = place[position]
        change = np.zeros(len(joined) + 1, np.int64)
        np.add.at(change, position, 1)
        np.add.at(change, position + self.lengths[pattern], -1)
        hit = np.cumsum(change) > 0
        begin = np.concatenate(([0], np.cumsum(np.array(counts) + 1)))
        for i in np.unique(np.searchsorted(begin, position, "right") - 1).tolist():
            hits[i] = hit[begin[i] : begin[i] + counts[i]]
        text = np.searchsorted(begin, position, "right") - 1
        for i, p in np.unique(np.stack((text, pattern), 1), axis=0).tolist():
            items[i].update(self.items[p])
        return counts, hits, items


def _blocks(benchmark: DataFrame, window: int, item_id: str, text: str) -> tuple[int, Iterator[Broadcast]]:
    """The number of blocks of about BLOCK_CHARS that the benchmark falls into, and the blocks, each
    fetched and sent to the tasks when its turn comes."""
    rows = benchmark.select(F.col(item_id).cast("string").alias("item"), F.col(text).alias("text"))
    blocks = whole_number(rows, F.sum(F.length("text"))) // BLOCK_CHARS + 1
    block = F.pmod(F.xxhash64("item", "text"), F.lit(blocks))
    context = benchmark.sparkSession.sparkContext
    return blocks, (
        context.broadcast(Queries.of([tuple(r) for r in rows.where(block == b).collect()], window))
        for b in range(blocks)
    )


def _spans(hit: np.ndarray) -> list[tuple[int, int]]:
    edge = np.diff(np.concatenate(([0], hit.astype(np.int8), [0])))
    return list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True))


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges that touch or overlap become one."""
    found: list[tuple[int, int]] = []
    for begin, end in sorted(spans):
        if found and begin <= found[-1][1]:
            found[-1] = found[-1][0], max(end, found[-1][1])
        else:
            found.append((begin, end))
    return found


def find_overlaps(
    docs: DataFrame, benchmark: DataFrame, window: int = 10, *,
    doc_id="doc_id", text="text", item_id="item_id", item_text="text",
) -> DataFrame:
    """(doc_id, n_words, spans, items) of every row of documents.

    A window is `window` consecutive words of an item, or the whole of a shorter item that has
    words. spans are the merged word ranges [begin, end) that occurrences of windows cover; items
    are the ids, as sorted strings, of the items with occurring windows. Null and empty texts have
    no words; items without an id hit but aren't named; repeated rows repeat. An empty benchmark
    hits nothing. Each block of the benchmark (one up to BLOCK_CHARS) is a pass over the texts; of
    several, a pass writes its spans and frees its block before the next one starts.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    found = "n_words long, spans array<struct<begin:long,end:long>>, items array<string>"
    types = to_arrow_schema(StructType.fromDDL(found))

    def searched(rows: DataFrame, block: Broadcast, all_rows: bool, kept: str) -> DataFrame:
        """Column `kept`, counts, spans and items of all rows, or of those that the block hits."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, "text"):
                counts, hits, items = block.value.search(texts_as_bytes(batch, "text"))
                told = [i for i, hit in enumerate(hits) if all_rows or hit.any()]
                values = (
                    [counts[i] for i in told], [[{"begin": a, "end": b} for a, b in _spans(hits[i])] for i in told],
                    [sorted(items[i]) for i in told],
                )
                columns = [pa.array(v, f.type) for v, f in zip(values, types, strict=True)]
                names = [kept, "n_words", "spans", "items"]
                yield pa.RecordBatch.from_arrays([batch.column(kept).take(pa.array(told, pa.int64())), *columns], names)

        of = rows.schema[kept].dataType.simpleString()
        return map_arrow(rows.select(kept, "text"), run, f"{kept} {of}, {found}")

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    count, blocks = _blocks(benchmark, window, item_id, item_text)
    if count == 1:
        return searched(rows, next(blocks), True, "doc_id")
    rows = saved(rows.withColumn("row", F.monotonically_increasing_id()))
    passes = []
    for i, block in enumerate(blocks):
        passes.append(saved(searched(rows, block, i == 0, "row")))
        block.destroy()
    together = functools.reduce(DataFrame.union, passes).groupBy("row").agg(
        F.max("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = types.get_field_index("spans")
        for batch in batches:
            spans = [_merged([(s["begin"], s["end"]) for s in row]) for row in batch.column("spans").to_pylist()]
            spans = [[{"begin": a, "end": b} for a, b in row] for row in spans]
            yield batch.set_column(batch.schema.get_field_index("spans"), "spans", pa.array(spans, types.field(at).type))

    rows = rows.select("row", "doc_id").join(together, "row").drop("row")
    return map_arrow(rows, merged, f"doc_id {kind}, {found}")


def cut_hits(queries: Queries, text: bytes) -> bytes:
    """The text without the stretches that windows cover, until none is left."""
    while True:
        _, (hit,), _ = queries.search([text])
        if not hit.any():
            return text
        letters = np.frombuffer(text.translate(_WORDS), np.uint8) != 32
        edge = np.diff(np.concatenate(([0], letters.astype(np.int8), [0])))
        start, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        kept, at = [], 0
        for begin, end in _spans(hit):
            kept.append(text[at : start[begin]])
            at = int(stop[end - 1])
        text = b"".join([*kept, text[at:]])


def remove_overlaps(
    docs: DataFrame, benchmark: DataFrame, window: int = 10, *, text="text", n_chars="n_chars",
    item_id="item_id", item_text="text",
) -> DataFrame:
    """All rows and columns of documents, with the text that windows cover cut out.

    Where a cut brings other words together that make a window, it is cut as well. Blocks of the
    benchmark take turns, each on what the one before wrote, in rounds until one cuts nothing more;
    a single block needs one round. n_chars, if there is such a column, is the length of the text
    that is left. Other rows stay as they are.
    """

    def cleared(docs: DataFrame, block: Broadcast) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, text):
                texts = texts_as_bytes(batch, text)
                _, hits, _ = block.value.search(texts)
                cut = {at: cut_hits(block.value, texts[at]).decode() for at, hit in enumerate(hits) if hit.any()}
                if cut:
                    for name, value in ((text, str), (n_chars, len)):
                        if name in batch.schema.names:
                            old = batch.column(name).to_pylist()
                            new = [value(cut[i]) if i in cut else x for i, x in enumerate(old)]
                            at = batch.schema.get_field_index(name)
                            batch = batch.set_column(at, batch.schema.field(at), pa.array(new, batch.schema.field(at).type))
                yield batch

        return map_arrow(docs, run, docs.schema)

    count, blocks = _blocks(benchmark, window, item_id, item_text)
    if count == 1:
        return cleared(docs, next(blocks))
    size = F.sum(F.octet_length(text))
    was, now = None, whole_number(docs, size)
    while was != now:  # a cut makes a text shorter
        for block in _blocks(benchmark, window, item_id, item_text)[1]:
            docs = saved(cleared(docs, block))
            block.destroy()
        was, now = now, whole_number(docs, size)
    return docs
