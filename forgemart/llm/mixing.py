"""Mixes sources to target weights: fixed-length blocks of words, drawn for each output shard.

DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from forgemart.llm.scratch import free_names, saved

BLOCK = 128  # words
SHARD = 1024  # slots, one block each
SLOTS = 1 << 17  # that one task counts out
BINS = 1024  # of a source's documents, and shards of a bin, so that running totals need no single task
ROUNDS = 12  # of a permutation
SPACE = r"[\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """A text's words; none for null."""
    found = F.split(F.coalesce(text, F.lit("")), SPACE)
    return F.filter(found, lambda w: w != "")


def permuted(index: Column, size: Column, *key: Column) -> Column:
    """Where a pseudorandom permutation of 0 .. size - 1 sends `index`; `key` names the permutation.

    Swap-or-not (Hoang, Morris and Rogaway 2012): a round pairs each index with another and swaps
    the pair or not, by a hash of the greater of the two, so any size gets a bijection.
    """

    def swap(at: Column, turn: Column) -> Column:
        partner = F.pmod(F.pmod(F.xxhash64(turn, F.lit(-1), *key), size) - at, size)
        choose = F.xxhash64(F.greatest(at, partner), turn, *key).bitwiseAND(1) == 1
        return F.when(choose, partner).otherwise(at)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), index.cast("long"), swap)


def running(rows: DataFrame, column: str, value: Column, name: str) -> DataFrame:
    """`rows` with the sum of `value` over the rows before, by the column, null last; the column's
    values are distinct. Sorted by ranges; only one total of each range meets in one task."""
    by = F.col(column).asc_nulls_last()
    parts = saved(rows.repartitionByRange(by).withColumns({"part": F.spark_partition_id(), "value": value}))
    before = parts.groupBy("part").agg(F.sum("value").alias("n"))
    before = before.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    inside = F.sum("value").over(Window.partitionBy("part").orderBy(by).rowsBetween(Window.unboundedPreceding, 0))
    return parts.withColumn("inside", inside).join(before, "part").select(
        *rows.columns, (F.col("before") + F.col("inside") - F.col("value")).alias(name)
    )


def targets(sizes: DataFrame, weights: Sequence[float] = (1.0, 2.0, 3.0), repeats: int = 3) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    Sources in code point order, null last, weigh `weights`, repeating, and share all sizes. A
    target stops at `repeats` times its source's size; the excess is shared out again by weight
    until none is above. Each round is one aggregate over the sources.
    """
    at = F.pmod("rank", F.lit(len(weights))).cast("int") + 1
    known = running(sizes, "source", F.lit(1), "rank")
    known = saved(
        known.select("source", "source_size", F.element_at(F.array(*map(F.lit, map(float, weights))), at).alias("weight"))
    )
    most = repeats * F.col("source_size")
    level, full = None, F.lit(False)
    while True:
        got = known.agg(
            F.sum("source_size").alias("all"),
            F.sum(F.when(full, most).otherwise(0)).alias("taken"),
            F.sum(F.when(full, 0.0).otherwise(F.col("weight"))).alias("weight"),
            F.count_if(full).alias("n"),
        ).first()
        if level is not None and got["n"] == stopped:
            break
        if not got["weight"]:
            break
        stopped, level = got["n"], (got["all"] - got["taken"]) / got["weight"]
        full = most < F.col("weight") * level
    target = F.when(full, most.cast("double")).otherwise(F.col("weight") * F.lit(float(level or 0.0)))
    return known.select("source", "source_size", target.alias("target"))


def block_counts(sources: DataFrame, block: int) -> DataFrame:
    """Adds `blocks` (of a source), `slots` (blocks that the mix takes of it, repeats counted) and
    `last` (words of its last slot, the others taking whole blocks).

    A target holds whole passes over the source, `passes`, and `rest` words of one more.
    """
    size, target = F.col("source_size"), F.round("target").cast("long")
    blocks = F.ceil(size / block)
    passes = F.when(size > 0, F.floor(target / size)).otherwise(0)
    rest = target - passes * size
    more = F.least(F.ceil(rest / block), blocks)
    return sources.withColumns({
        "blocks": blocks, "slots": passes * blocks + more,
        "last": F.when(more > 0, rest - (more - 1) * block).otherwise(block),
    })


def _key(doc_id: str, text: str, source: str) -> dict[str, Column]:
    """Rows that agree in these are copies of one document."""
    return {
        "key": F.xxhash64(F.col(doc_id), F.col(source), F.col(text)),
        "check": F.hash(F.col(text), F.col(source), F.col(doc_id)),
    }


def packed(docs: DataFrame) -> DataFrame:
    """Adds `begin`, the place of a document's first word among its source's words; `n` copies of
    `size` words stand one after another.

    A source's documents are in BINS bins by the hash of their content, in each by that hash. Totals
    of bins are summed first, so a task orders one bin of one source; null is a source.
    """
    extent = F.col("size") * F.col("n")
    rows = docs.withColumn("bin", F.pmod("key", F.lit(BINS)))
    bins = rows.groupBy("source", "bin").agg(F.sum(extent).alias("words"))
    over = Window.partitionBy("source").orderBy("bin")
    bins = bins.select("source", "bin", (F.sum("words").over(over) - F.col("words")).alias("before"))
    order = Window.partitionBy("source", "bin").orderBy("key", "check", "doc_id", "size")
    inside = F.sum(extent).over(order.rowsBetween(Window.unboundedPreceding, 0)) - extent
    rows = rows.withColumn("inside", inside)
    same = F.col("l.source").eqNullSafe(F.col("r.source")) & (F.col("l.bin") == F.col("r.bin"))
    begin = F.col("before") + F.col("inside")
    return rows.alias("l").join(bins.alias("r"), same).select("l.*", begin.alias("begin")).drop("bin", "inside")


def draws(sources: DataFrame, total: int, shard: int = SHARD) -> DataFrame:
    """(shard, first, n) from (first, slots): how many of a shard's slots fall to the source whose
    slots begin at `first`; counts of 0 have no row.

    Shards hold `shard` slots each, the last one what is left of `total`. A shard's counts are a
    multinomial draw at the sources' shares: each slot picks a number below the total by a hash, and
    the source that holds this number. Numbers are looked up in stretches of `width`, in which few
    sources begin on average, so that slots join few candidates.
    """
    count = sources.count()
    width = max(1, min(1024, total // max(count, 1)))
    # Stretches are counted out in two steps, so that no row holds an array that grows with a source.
    some = F.lit(width * 4096)
    last = F.col("first") + F.col("slots") - 1
    held = sources.withColumn("run", F.explode(F.sequence(F.floor(F.col("first") / some), F.floor(last / some))))
    held = held.repartition(total // (SLOTS * width) + 1, "first", "run")
    begin = F.greatest(F.floor(F.col("first") / width), F.col("run") * 4096)
    until = F.least(F.floor(last / width), F.col("run") * 4096 + 4095)
    held = saved(held.select("first", last.alias("end"), F.explode(F.sequence(begin, until)).alias("stretch")))
    slot = F.col("id")
    drawn = sources.sparkSession.range(0, total, 1, total // SLOTS + 1).select(
        F.floor(slot / shard).alias("shard"), F.pmod(F.xxhash64(slot, F.lit("draw")), F.lit(total)).alias("number")
    )
    drawn = drawn.withColumn("stretch", F.floor(F.col("number") / width)).join(held, "stretch")
    return drawn.where(F.col("number").between(F.col("first"), F.col("end"))).groupBy("shard", "first").agg(F.count("*").alias("n"))


def slots(sources: DataFrame, shard: int = SHARD) -> DataFrame:
    """(shard, slot, source, pass, block, words) of the whole mix, a row for each block taken.

    `draws` gives each shard its counts of the sources. The slots drawn for a source are numbered
    through the shards and map through a permutation of their own number to the source's indexes:
    index // blocks is the pass, and a permutation for each pass gives the block. Totals close by
    index: a source drawn more often than it has slots hands over the slots whose index is beyond
    them, spread over all shards, and sources drawn too seldom take them in their order. So every
    index is taken once. In a shard, slots stand by a permutation.
    `sources` is from block_counts; sources without slots give no rows.
    """
    known = saved(running(sources.where("slots > 0"), "source", F.col("slots"), "first"))
    total = int(known.agg(F.sum("slots")).first()[0] or 0)
    counts = saved(draws(known.select("first", "slots"), total, shard).withColumn("bin", F.floor(F.col("shard") / BINS)))
    bins = saved(counts.groupBy("first", "bin").agg(F.sum("n").alias("n")))
    drawn = bins.groupBy("first").agg(F.sum("n").alias("drawn"))
    known = known.select("source", "slots", "blocks", "last", "first").join(drawn, "first", "left")
    known = saved(known.withColumn("drawn", F.coalesce("drawn", F.lit(0).cast("long"))))
    over = Window.partitionBy("first").orderBy("bin")
    spare = running(known.select("first", F.greatest(F.col("drawn") - F.col("slots"), F.lit(0)).alias("n")), "first", F.col("n"), "spare")
    bins = bins.select("first", "bin", (F.sum("n").over(over) - F.col("n")).alias("before"))
    bins = bins.join(known.drop("source", "blocks", "last"), "first").join(spare.drop("n"), "first")
    inside = F.sum("n").over(Window.partitionBy("first", "bin").orderBy("shard").rowsBetween(Window.unboundedPreceding, 0))
    here = F.sum("n").over(Window.partitionBy("shard").orderBy("first").rowsBetween(Window.unboundedPreceding, 0))
    rows = counts.withColumns({"inside": inside - F.col("n"), "here": here - F.col("n")}).join(bins, ["first", "bin"])
    # Few rows become many: the number of tasks follows the slots, not what arrives here.
    rows = rows.repartition(total // SLOTS + 1, "shard", "first")
    rows = rows.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    size = F.least(F.lit(shard).cast("long"), F.lit(total) - F.col("shard") * shard)
    index = permuted(F.col("before") + F.col("inside") + F.col("i"), F.col("drawn"), F.col("first"), F.lit("index"))
    rows = saved(rows.select(
        "shard", permuted(F.col("here") + F.col("i"), size, F.col("shard"), F.lit("slot")).alias("slot"),
        "first", index.alias("index"), "slots", "spare",
    ))
    own = rows.where("index < slots").select("shard", "slot", "first", "index")
    handed = rows.where("index >= slots").select("shard", "slot", (F.col("spare") + F.col("index") - F.col("slots")).alias("turn"))
    wanting = running(known.where("drawn < slots"), "first", F.col("slots") - F.col("drawn"), "turn")
    wanting = wanting.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slots") - F.col("drawn") - 1)))
    wanting = wanting.select("first", (F.col("drawn") + F.col("i")).alias("index"), (F.col("turn") + F.col("i")).alias("turn"))
    rows = own.unionByName(handed.join(wanting, "turn").drop("turn")).join(known.drop("drawn"), "first")
    turn = F.floor(F.col("index") / F.col("blocks"))
    block = permuted(F.pmod("index", "blocks"), F.col("blocks"), turn, F.col("first"))
    return rows.select(
        "shard", "slot", "source", turn.alias("pass"), block.alias("block"),
        F.when(F.col("index") == F.col("slots") - 1, F.col("last")).otherwise(F.lit(2**62)).alias("words"),
    )


def mix(
    docs: DataFrame, weights: Sequence[float] = (1.0, 2.0, 3.0), repeats: int = 3, block: int = BLOCK,
    shard: int = SHARD, *, doc_id="doc_id", text="text", source="source",
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The mix in three tables: documents (key, check, doc_id, source, size, n, begin), sources with
    targets and block counts, and pieces (key, check, doc_id, source, size, copy, shard, slot, pass,
    offset, taken): `taken` words of a copy of a document from word `offset` on stand in that slot of
    that output shard.

    Each source's words are one stream of its documents, cut into blocks of `block` words, which may
    hold several documents or a part of one. Null texts have no words, null is a source of its own,
    each of repeated rows counts, ids may be null, and no rows make an empty mix. Reruns agree. No
    word is taken more than `repeats` times.
    """
    rows = docs.select(
        *(c.alias(name) for name, c in _key(doc_id, text, source).items()),
        F.col(doc_id).alias("doc_id"), F.col(source).alias("source"),
        F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("size"),
    )
    rows = saved(rows.groupBy(rows.columns).agg(F.count("*").alias("n")))
    sizes = rows.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    known = saved(block_counts(targets(sizes, weights, repeats), block))
    rows = saved(packed(rows))
    extent = F.col("size") * F.col("n")
    first, last = F.floor(F.col("begin") / block), F.floor((F.col("begin") + extent - 1) / block)
    parts = rows.where("size > 0").withColumn("block", F.explode(F.sequence(first, last)))
    same = F.col("l.source").eqNullSafe(F.col("r.source")) & (F.col("l.block") == F.col("r.block"))
    # Slots are counted out from far fewer rows, which would make them look small enough to broadcast.
    pieces = parts.alias("l").join(slots(known, shard).hint("merge").alias("r"), same)
    here = F.col("l.block") * block
    pieces = pieces.select(
        "l.key", "check", "doc_id", "l.source", "size", "shard", "slot", "pass",
        (F.greatest(here, "begin") - F.col("begin")).alias("start"),
        (F.least(here + block, here + F.col("words"), F.col("begin") + extent) - F.col("begin")).alias("stop"),
    ).where("stop > start")
    # A block may reach over several copies of a document.
    copies = F.sequence(F.floor(F.col("start") / F.col("size")), F.floor((F.col("stop") - 1) / F.col("size")))
    pieces = pieces.withColumn("copy", F.explode(copies))
    offset = F.greatest(F.col("start") - F.col("copy") * F.col("size"), F.lit(0))
    until = F.least(F.col("stop") - F.col("copy") * F.col("size"), F.col("size"))
    pieces = pieces.withColumns({"offset": offset, "taken": until - offset}).drop("start", "stop")
    return rows, known, pieces


def mixed_counts(docs: DataFrame, *args, **options) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every row of documents; see mix.

    taken counts repeats; a document without words takes 0.
    """
    rows, known, pieces = mix(docs, *args, **options)
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    taken = pieces.groupBy("key", "check", "doc_id", "source", "size", "copy").agg(F.sum("taken").alias("taken"))
    same = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in taken.columns[:-1]]
    rows = rows.alias("l").join(taken.alias("r"), same, "left").select("l.*", "taken")
    sizes = known.select(F.col("source").alias("of"), "source_size", "target")
    rows = rows.join(sizes, F.col("of").eqNullSafe(F.col("source")))
    return rows.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed_texts(
    docs: DataFrame, weights: Sequence[float] = (1.0, 2.0, 3.0), repeats: int = 3, block: int = BLOCK,
    *, doc_id="doc_id", text="text", source="source", n_chars="n_chars",
) -> DataFrame:
    """The mix as rows of documents, all columns: a row for each pass in which words of a document
    are taken. Where all its words are taken the text stays as it is; else it is the words taken, in
    their order, parted by spaces. n_chars, if there is such a column, follows.

    Documents without words, and those of which nothing is taken, give no row. Of rows that agree in
    id, source and text but differ elsewhere, one row's other columns stand for all.
    """
    _, _, pieces = mix(docs, weights, repeats, block, doc_id=doc_id, text=text, source=source)
    runs = pieces.groupBy("key", "check", "copy", "pass").agg(
        F.sort_array(F.collect_list(F.struct("offset", "taken"))).alias("runs"), F.sum("taken").alias("taken")
    )
    key, check, run, taken, parts = free_names(docs, "key", "check", "runs", "taken", "words")
    runs = runs.select(*(F.col(c).alias(name) for c, name in zip(("key", "check", "runs", "taken"), (key, check, run, taken), strict=True)))
    keys = dict(zip((key, check), _key(doc_id, text, source).values(), strict=True))
    one = docs.withColumns(keys).groupBy(key, check).agg(*(F.first(c).alias(c) for c in docs.columns))
    rows = one.join(runs, [key, check])
    rows = rows.withColumn(parts, words(F.col(text)))
    cut = F.transform(run, lambda r: F.array_join(F.slice(parts, r.offset.cast("int") + 1, r.taken.cast("int")), " "))
    whole = F.col(taken) == F.size(parts)
    rows = rows.withColumn(text, F.when(whole, F.col(text)).otherwise(F.array_join(cut, " ")))
    if n_chars in docs.columns:
        rows = rows.withColumn(n_chars, F.length(text).cast(docs.schema[n_chars].dataType))
    return rows.select(docs.columns)
