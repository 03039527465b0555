"""Line deduplication across documents: copies, and lines within one edit of an earlier line."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from forgemart.llm.scratch import map_texts, saved

MIN_CHARS = 16
#: Base of the variants' hash and its inverse, modulo 2^64.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(n: int) -> np.ndarray:
    """The first n powers of the base."""
    factors = np.full(n, _BASE, np.uint64)
    factors[:1] = 1
    return np.multiply.accumulate(factors)


def variants(line: str, halves: set[tuple[int, int]]) -> list[tuple[int, int]]:
    """(hash, place) of the line's variants for the pairs (longer length, half edited).

    Where the line is the longer or of equal length, one for each character of the half, deleted;
    where it is the shorter, the line itself, at place -1.
    """
    n = len(line)
    codes = np.frombuffer(line.encode("utf-32-le"), "<u4").astype(np.uint64)
    codes = (codes + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    before = np.zeros(n + 1, np.uint64)
    np.cumsum(codes * _powers(n), out=before[1:])
    found = []
    for longer, half in halves:
        if longer > n:
            found.append((before[-1:], np.array([-1])))
            continue
        place = np.arange(0, n // 2) if half == 0 else np.arange(n // 2, n)
        found.append((before[place] + (before[-1] - before[place + 1]) * np.uint64(_INVERSE), place))
    hashes, places = (np.concatenate(x) for x in zip(*found, strict=True))
    return list(dict.fromkeys(zip(hashes.view(np.int64).tolist(), places.tolist(), strict=True)))


def _halves(line: Column) -> Column:
    """What two lines within one edit agree in, for the longer length and the half that is edited:
    the other half. A line may be the longer (or equal) or the shorter of the pair."""
    n = F.length(line)

    def one(longer: Column, half: int) -> Column:
        cut = F.floor(longer / 2).cast("int")
        rest = F.substr(line, n - (longer - cut) + 1) if half == 0 else F.substr(line, F.lit(1), cut)
        return F.struct(longer.alias("longer"), F.lit(half).alias("half"), F.xxhash64(longer, F.lit(half), rest).alias("key"))

    return F.array(*(one(longer, half) for longer in (n, n + 1) for half in (0, 1)))


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def dedup_lines(
    docs: DataFrame, min_chars: int = MIN_CHARS, *, copies_from: int | None = None, doc_id="doc_id", text="text"
) -> DataFrame:
    """(doc_id, text, n_lines, n_copies, n_near, kept): documents without lines seen before.

    Lines end at line feeds. Lines of fewer than `min_chars` characters are kept and not compared;
    with `copies_from`, those of that many characters or more are compared for copies alone.
    Of equal lines, the first by (doc_id, content hash of the document, place) stays; it goes too if
    a line within one character edit (inserted, deleted or replaced) has an earlier first place,
    kept or not, so the outcome doesn't depend on an order of work. `text` is the lines left, `kept`
    their places, n_copies and n_near what went as a copy or as a near copy. A null text has no
    lines and stays null; null ids come first; rows that agree in id and text get the same result.

    Equal lines meet as 128-bit hashes, summed before they are shuffled. Two lines within one edit
    agree in one half, so only lines that share a half with another emit deletion variants, of the
    other half. Equal variants are joined by minima: with the variant of the same place
    (replacement), and between a line and variants equal to it. Distances are verified on texts.
    """
    rows = docs.select(F.col(doc_id).alias("id"), F.xxhash64(F.col(text)).alias("content"), F.col(text).alias("text"))
    lines = rows.select("id", "content", F.posexplode(_lines(F.col("text"))).alias("place", "line"))
    least = min_chars if copies_from is None else min(copies_from, min_chars)
    halves = F.when(F.length("line") >= min_chars, _halves(F.col("line")))
    first = F.struct("id", "content", "place")
    distinct = saved(
        lines.where(F.length("line") >= least)
        .select(F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"), first.alias("first"), halves.alias("halves"))
        .groupBy("h1", "h2").agg(F.min("first").alias("first"), F.min("halves").alias("halves"))
    )
    keys = distinct.select("h1", "h2", F.explode("halves").alias("half")).select("h1", "h2", "half.*")
    shared = saved(
        keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
        .join(keys, "key").groupBy("h1", "h2").agg(F.collect_set(F.struct("longer", "half")).alias("halves"))
        .join(distinct.select("h1", "h2", "first"), ["h1", "h2"]).select("first", "halves")
    )
    # The texts of these lines, by their documents; the same exchange of documents serves the end.
    wanted = shared.groupBy("first.id", "first.content").agg(
        F.collect_list(F.struct("first.place", "halves")).alias("wanted")
    )
    near = _near(_texts(rows, wanted))
    stays = distinct.select("first").join(near, "first", "left_anti")
    stays = stays.groupBy("first.id", "first.content").agg(F.collect_list("first.place").alias("stays"))
    lost = near.groupBy("first.id", "first.content").agg(F.count("*").alias("n_near"))
    decisions = stays.join(lost, [stays.id.eqNullSafe(lost.id), stays.content == lost.content], "full").select(
        F.coalesce(stays.id, lost.id).alias("of"), F.coalesce(stays.content, lost.content).alias("with"), "stays", "n_near"
    )
    same = F.col("id").eqNullSafe(F.col("of")) & F.col("content").eqNullSafe(F.col("with"))
    found = rows.join(decisions, same, "left").withColumn("lines", _lines(F.col("text")))
    listed = F.coalesce("stays", F.array().cast("array<int>"))
    # Numbers of lines in order: those that stay, and those not compared.
    short = F.filter(F.transform("lines", lambda line, i: F.when(F.length(line) < least, i)), lambda i: i.isNotNull())
    found = found.withColumn("kept", F.sort_array(F.concat(listed, F.coalesce(short, F.array().cast("array<int>")))))
    left = F.array_join(F.transform("kept", lambda i: F.get("lines", i)), "\n")
    lines_in = F.when(F.col("text").isNull(), 0).otherwise(F.size("lines")).cast("long")
    n_near = F.coalesce("n_near", F.lit(0)).cast("long")
    return found.select(
        F.col("id").alias("doc_id"), F.when(F.col("text").isNotNull(), left).alias("text"), lines_in.alias("n_lines"),
        (lines_in - F.size("kept") - n_near).cast("long").alias("n_copies"), n_near.alias("n_near"), "kept",
    )


def _texts(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """(first, line, halves) of the wanted places of documents; copies of a document count once."""
    same = F.col("id").eqNullSafe(F.col("of")) & F.col("content").eqNullSafe(F.col("with"))
    wanted = wanted.select(F.col("id").alias("of"), F.col("content").alias("with"), "wanted")
    found = rows.join(wanted, same, "left").where("wanted is not null").select("id", "content", "wanted", "text")

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        """The wanted lines of a batch of texts, each of which is cut up once."""
        wanted = batch.column("wanted")
        each = wanted.flatten()
        owner = np.repeat(np.arange(batch.num_rows), wanted.value_lengths().to_numpy())
        places = each.field("place").to_numpy()
        lines, at, cut_up = [], -1, []
        for of, place in zip(owner.tolist(), places.tolist(), strict=True):
            if of != at:
                at, cut_up = of, batch.column("text")[of].as_py().split("\n")
            lines.append(cut_up[place])
        owner = pa.array(owner)
        columns = [batch.column("id").take(owner), batch.column("content").take(owner), each.field("place"), pa.array(lines, pa.string()), each.field("halves")]
        return pa.RecordBatch.from_arrays(columns, ["id", "content", "place", "line", "halves"])

    kind = found.schema["id"].dataType.simpleString()
    halves = "array<struct<longer:int,half:int>>"
    lines = map_texts(found, "text", cut, f"id {kind}, content long, place int, line string, halves {halves}")
    return lines.select(F.struct("id", "content", "place").alias("first"), "line", "halves")


def _near(lines: DataFrame) -> DataFrame:
    """(first) of the lines with a line within one edit that comes first."""

    def batch(rows: pa.RecordBatch) -> pa.RecordBatch:
        found = []
        for line, halves in zip(rows.column("line").to_pylist(), rows.column("halves").to_pylist(), strict=True):
            found.append([{"hash": h, "place": p} for h, p in variants(line, {(x["longer"], x["half"]) for x in halves})])
        kind = pa.list_(pa.struct([("hash", pa.int64()), ("place", pa.int32())]))
        return pa.RecordBatch.from_arrays([rows.column("first"), pa.array(found, kind)], ["first", "variants"])

    # Identical documents may stand here more than once; equal places are one line.
    kind = lines.schema["first"].dataType.simpleString()
    emitted = map_texts(lines, "line", batch, f"first {kind}, variants array<struct<hash:long,place:int>>")
    emitted = emitted.select("first", F.explode("variants").alias("v")).select("first", "v.hash", "v.place")
    short = F.col("place") == -1
    equal, alike = Window.partitionBy("hash"), Window.partitionBy("hash", "place")
    emitted = emitted.withColumns({
        "shorter": F.min(F.when(short, F.col("first"))).over(equal), "longer": F.min(F.when(~short, F.col("first"))).over(equal),
    }).withColumn("equal", F.min("first").over(alike))
    before = F.when(short, F.col("longer")).otherwise(F.least("shorter", "equal"))
    pairs = emitted.select("first", before.alias("other")).where("other < first").distinct()
    left = lines.select(F.col("first").alias("a"), F.col("line").alias("line_a"))
    right = lines.select(F.col("first").alias("b"), F.col("line").alias("line_b"))
    checked = pairs.join(left, F.col("first") == F.col("a")).join(right, F.col("other") == F.col("b"))
    return checked.where(F.levenshtein("line_a", "line_b", 1) >= 0).select("first").distinct()
