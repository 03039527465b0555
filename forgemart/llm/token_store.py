"""Token ids in compressed blocks: each document by itself, with one shared dictionary."""

from __future__ import annotations

import functools
import hashlib
import itertools
import re
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType
from tokenizers import Tokenizer

from forgemart.llm.scratch import map_arrow, slices, texts_as_bytes

#: Bytes of compressed documents in a block (a longer document is a block of its own), bytes of the
#: dictionary, and the documents and ids of each that it is trained on.
BLOCK_BYTES, DICT_BYTES, SAMPLE, SAMPLE_IDS, LEVEL = 1 << 20, 1 << 16, 2000, 1 << 12, 3
#: Pieces of words whose ids a Python worker keeps, twice, and the characters of the longest of them.
MEMO, MEMO_CHARS = 600_000, 64

#: The file format: a Parquet table of blocks, and a table `dictionary` beside it.
BLOCKS = (
    "part int, number int, before long, n_tokens long, first_id {id}, last_id {id}, dict_hash string, "
    "doc_ids array<{id}>, tokens array<long>, offsets array<long>, body binary"
)

#: Fixed values of byte-level BPE over characters whose classes no Unicode version changes: letters of
#: Latin-1, digits, ASCII punctuation, and single spaces and line feeds between others.
_LETTERS, _SIGNS = "A-Za-zÀ-ÖØ-öø-ÿ", r"!-/:-@\[-`{-~"
_PIECES = re.compile(rf"'(?:s|t|re|ve|m|ll|d)| ?[{_LETTERS}]+| ?[0-9]+| ?[{_SIGNS}]+|\n").findall


def _byte_letters() -> dict[int, str]:
    """The characters that byte-level BPE writes for bytes: printable ones stand for themselves, the
    others are counted from 256."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in printable]
    return {b: chr(256 + i) for i, b in enumerate(others)}


class Pieces(dict):
    """Ids of pieces, worked out on first use; those of more than MEMO_CHARS characters aren't kept."""

    def __init__(self, encode: Callable[[str], bytes], older: dict[str, bytes]):
        super().__init__()
        self.encode, self.older = encode, older

    def __missing__(self, piece: str) -> bytes:
        ids = self.older.get(piece) or self.encode(piece)
        if len(piece) <= MEMO_CHARS:
            self[piece] = ids
        return ids


class Encoder:
    """Encodes whole texts with a tokenizer, as little-endian unsigned 32-bit ids.

    A byte-level BPE tokenizer with its usual pattern parts texts into pieces before it merges. For
    texts of common characters the pieces are found here, and the library's model encodes each
    piece once: two generations of MEMO pieces are kept, but for long ones. All other texts, those
    with an added token's first character and next, and other kinds of tokenizers go to the library
    whole.
    """

    def __init__(self, model: str):
        self.tokenizer = Tokenizer.from_str(model)
        kind = str(self.tokenizer.pre_tokenizer)
        self.parts = kind.startswith("ByteLevel(add_prefix_space=False") and "use_regex=True" in kind
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.parts &= self.tokenizer.normalizer is None and all(len(t) > 1 for t in added)
        self.apart = ["\n\n", "\n ", *(t[:2] for t in added)]
        self.letters = _byte_letters()
        self.memo = Pieces(self._piece, {})

    def _piece(self, piece: str) -> bytes:
        if piece.isascii():
            letters = piece.replace(" ", self.letters[32]).replace("\n", self.letters[10])
        else:
            letters = "".join([self.letters.get(b) or chr(b) for b in piece.encode()])
        tokens = self.tokenizer.model.tokenize(letters)
        return array("I", [t.id for t in tokens]).tobytes()

    def _joined(self, text: str) -> bytes | None:
        """The ids of a text of common characters, with single spaces and line feeds between others;
        None for all other texts."""
        if not self.parts or text[:1] in (" ", "\n") or text.endswith("\n") or any(t in text for t in self.apart):
            return None
        pieces = _PIECES(text)
        if "".join(pieces) != text:
            return None  # something stands between the pieces
        return b"".join(map(self.memo.__getitem__, pieces))

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text."""
        found = []
        for text in texts:
            found.append(self._joined(text))
            if len(self.memo) > MEMO:
                self.memo.older = {}
                self.memo = Pieces(self._piece, self.memo)
        whole = [t for t, ids in zip(texts, found, strict=True) if ids is None]
        other = iter(self.tokenizer.encode_batch_fast(whole, add_special_tokens=False))
        return [np.array(next(other).ids, "<u4").tobytes() if ids is None else ids for ids in found]


@functools.lru_cache(maxsize=2)
def encoder(model: str) -> Encoder:
    return Encoder(model)


def serialize(ids: np.ndarray) -> bytes:
    """A document's ids as stored: two bytes each if all are small, else four, after a width byte."""
    small = not len(ids) or int(ids.max()) < 1 << 16
    return (b"\x02" if small else b"\x04") + ids.astype("<u2" if small else "<u4").tobytes()


def deserialize(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<u2" if data[0] == 2 else "<u4", offset=1).astype("<u4")


def train_dictionary(
    docs: DataFrame, model: str, end: int, doc_id: str = "doc_id", text: str = "text",
    sample: int = SAMPLE, sample_ids: int = SAMPLE_IDS,
) -> bytes:
    """A zstandard dictionary trained on id arrays: of the `sample` ids with the least hashes one
    text each (the least of an id's), encoded whole, and of its ids a stretch of `sample_ids` at
    most from a place that the hash gives. Tasks encode; the driver gets the stretches.

    Only this sample is bounded: it shapes the size of the files and not what they hold. Too few
    texts give an empty dictionary.
    """
    rows = docs.select(F.xxhash64(doc_id).alias("hash"), F.coalesce(text, F.lit("")).alias("text"))
    # The hashes first, so that no task sends texts that other tasks' texts displace.
    least = rows.select("hash").distinct().orderBy("hash").limit(sample).agg(F.max("hash")).first()[0]
    if least is None:
        return b""
    rows = rows.where(F.col("hash") <= F.lit(least)).groupBy("hash").agg(F.min("text").alias("text"))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            hashes, stretches = batch.column("hash").to_pylist(), []
            texts = [t.decode() for t in texts_as_bytes(batch, "text")]
            for place, raw in zip(hashes, encoder(sent.value).encode(texts), strict=True):
                ids = np.frombuffer(raw + np.uint32(end).tobytes(), "<u4")
                begin = place % max(len(ids) - sample_ids + 1, 1)
                stretches.append(serialize(ids[begin : begin + sample_ids]))
            yield pa.RecordBatch.from_arrays([batch.column("hash"), pa.array(stretches, pa.binary())], ["hash", "ids"])

    found = sorted(map(tuple, map_arrow(rows, run, "hash long, ids binary").collect()))
    sent.destroy()
    try:
        return zstandard.train_dictionary(DICT_BYTES, [bytes(ids) for _, ids in found]).as_bytes()
    except zstandard.ZstdError:
        return b""


def dictionary_hash(dictionary: bytes) -> str:
    return hashlib.sha256(dictionary).hexdigest()


def _compressor(dictionary: bytes):
    data = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=data).compress


def _decompressor(dictionary: bytes):
    data = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    return zstandard.ZstdDecompressor(dict_data=data).decompress


def write_tokens(docs: DataFrame, model_path: str, folder: str, end: int, *, doc_id="doc_id", text="text") -> None:
    """Encodes every row and writes the ids, `end` after each document, below `folder`.

    Documents are in ascending order of id (null first), then of text: range partitions in order,
    and blocks in order in each. `folder`/blocks is a Parquet table of blocks; in a block, document
    i is the zstandard frame body[offsets[i]:offsets[i + 1]], and `before` counts the ids of its
    partition before it. `folder`/dictionary has the dictionary under the hash that blocks name.
    Spark's committer writes both, so a lost task is written again and leaves nothing behind. Null
    texts are empty and have the end id alone; repeated rows are written each; without rows there
    are no blocks.
    """
    with open(model_path, encoding="utf-8") as file:
        model = file.read()
    spark = docs.sparkSession
    dictionary = train_dictionary(docs, model, end, doc_id, text)
    key = dictionary_hash(dictionary)
    entry = spark.createDataFrame([(key, bytearray(dictionary))], "dict_hash string, dictionary binary")
    entry.coalesce(1).write.parquet(f"{folder}/dictionary")
    sent = spark.sparkContext.broadcast((model, dictionary))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(text, F.lit("")).alias("text"))
    rows = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    rows = rows.withColumn("part", F.spark_partition_id())
    schema = BLOCKS.format(id=rows.schema["doc_id"].dataType.simpleString())
    kinds = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, dictionary = sent.value
        compress = _compressor(dictionary)
        number = before = size = 0
        ids, tokens, frames = [], [], []

        def block(part: int) -> pa.RecordBatch:
            offsets = [0, *itertools.accumulate(map(len, frames))]
            row = [part, number, before, sum(tokens), ids[0], ids[-1], key, ids, tokens, offsets, b"".join(frames)]
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, kinds, strict=True)], schema=kinds)

        for batch in slices(batches, "text"):
            part = batch.column("part")[0].as_py()
            texts = [t.decode() for t in texts_as_bytes(batch, "text")]
            for name, raw in zip(batch.column("doc_id").to_pylist(), encoder(model).encode(texts), strict=True):
                frame = compress(serialize(np.frombuffer(raw + np.uint32(end).tobytes(), "<u4")))
                ids.append(name)
                tokens.append(len(raw) // 4 + 1)
                frames.append(frame)
                size += len(frame)
                if size >= BLOCK_BYTES:
                    yield block(part)
                    number, before, size = number + 1, before + sum(tokens), 0
                    ids, tokens, frames = [], [], []
        if ids:
            yield block(part)

    map_arrow(rows, run, schema).write.option("compression", "none").parquet(f"{folder}/blocks")


def _dictionaries(spark: SparkSession, folder: str) -> dict[str, bytes]:
    rows = spark.read.parquet(f"{folder}/dictionary").collect()
    found = {row["dict_hash"]: bytes(row["dictionary"]) for row in rows}
    for key, dictionary in found.items():
        if dictionary_hash(dictionary) != key:
            raise ValueError(f"the dictionary of {folder} doesn't have its hash {key}")
    return found


def read_tokens(spark: SparkSession, folder: str, value: Callable[[np.ndarray], object], kind: str) -> DataFrame:
    """(doc_id, start, n_tokens, value) of every document: `value` of its ids, as Spark type `kind`.

    start counts the ids of all documents before. The driver gets one total for each partition that
    was written, and the dictionary.
    """
    blocks = spark.read.parquet(f"{folder}/blocks")
    totals = dict(blocks.groupBy("part").agg(F.sum("n_tokens")).collect())
    parts = sorted(totals)
    starts = dict(zip(parts, [0, *itertools.accumulate(totals[p] for p in parts)], strict=False))
    sent = spark.sparkContext.broadcast((starts, _dictionaries(spark, folder)))
    rows = blocks.select("part", "before", "dict_hash", "doc_ids", "tokens", "offsets", "body")
    name = blocks.schema["first_id"].dataType.simpleString()
    schema = f"doc_id {name}, start long, n_tokens long, value {kind}"
    kinds = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts, dictionaries = sent.value
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i].as_py() for name in batch.schema.names}
                decompress = _decompressor(dictionaries[row["dict_hash"]])
                body, offsets = memoryview(row["body"]), row["offsets"]
                found = [deserialize(decompress(body[a:b])) for a, b in itertools.pairwise(offsets)]
                begin = starts[row["part"]] + row["before"]
                columns = (
                    row["doc_ids"], [begin + n for n in itertools.accumulate(row["tokens"][:-1], initial=0)],
                    list(map(len, found)), list(map(value, found)),
                )
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kinds, strict=True)], schema=kinds)

    return map_arrow(rows, run, schema)


def lookup_tokens(spark: SparkSession, folder: str, doc_id) -> list[np.ndarray]:
    """The ids of the documents with this id, reading the blocks whose range has it and decompressing
    these documents alone."""
    dictionaries = _dictionaries(spark, folder)
    begins = F.col("first_id").isNull() | (F.col("first_id") <= doc_id)
    blocks = spark.read.parquet(f"{folder}/blocks").where(begins & (F.col("last_id") >= doc_id))
    place = F.posexplode("doc_ids").alias("i", "id")
    rows = blocks.select("dict_hash", "offsets", "body", "part", "number", place).where(F.col("id") == doc_id)
    begin, end = F.element_at("offsets", F.col("i") + 1), F.element_at("offsets", F.col("i") + 2)
    frame = F.expr("substring(body, cast(at as int) + 1, cast(until - at as int))")
    rows = rows.withColumns({"at": begin, "until": end}).select("part", "number", "i", "dict_hash", frame.alias("frame"))
    found = rows.orderBy("part", "number", "i").collect()
    return [deserialize(_decompressor(dictionaries[r["dict_hash"]])(bytes(r["frame"]))) for r in found]
