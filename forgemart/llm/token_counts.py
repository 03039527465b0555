"""Exact token counts; huge texts are encoded in overlapping chunks that are spliced."""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forgemart.llm.scratch import map_texts, texts_as_bytes

SPACE = "▁"


@functools.lru_cache(maxsize=4)
def _processor(model: bytes) -> tuple[sentencepiece.SentencePieceProcessor, bool]:
    """The model, and whether its vocabulary proves that a space after another character is a
    boundary whatever stands around it: no piece then has a space behind another character, and the
    text reaches the pieces unchanged."""
    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    pieces = (sp.id_to_piece(i) for i in range(sp.vocab_size()))
    probe = " ①ﬁ  a \n\tb "
    plain = sp.normalize(probe).removeprefix(SPACE).replace(SPACE, " ") == probe
    return sp, plain and not any(SPACE in p.lstrip(SPACE) for p in pieces)


def _begins(sp, chunk: bytes) -> np.ndarray:
    """Where the tokens of a chunk begin, in bytes of the chunk."""
    pieces = sp.encode(chunk.decode(), return_type="proto").pieces
    return np.fromiter((p.begin for p in pieces), np.int64, len(pieces))


def _stable(data: bytes, p: int) -> bool:
    """Whether `p` stands between a character and a single space before another character."""
    marks = (b" ", SPACE.encode())
    inside = 0 < p < len(data) - 1 and data[p] == marks[0][0]
    return inside and not data.endswith(marks, max(p - 3, 0), p) and not data.startswith(marks, p + 1)


def _character(data: bytes, p: int) -> int:
    """The last place at `p` or before it where a character begins."""
    while 0 < p < len(data) and data[p] & 0xC0 == 0x80:
        p -= 1
    return p


def count_tokens(model: bytes, data: bytes, chunk: int = 1 << 15, overlap: int = 1 << 9) -> int:
    """The number of tokens of a whole text in UTF-8.

    A text beyond `chunk` bytes is encoded in chunks that overlap. Both encodings of an overlap must
    have a common token boundary at a place that the vocabulary proves stable; there the later chunk
    takes over. If there is none, the overlap doubles, at last back to where the chunk took over.
    """
    sp, provable = _processor(model)
    if len(data) <= chunk or not provable:
        return len(sp.encode(data.decode()))
    end = _character(data, chunk)
    begins = _begins(sp, data[:end])
    count, since = 0, 0  # tokens before `since`, where the current chunk took over
    while end < len(data):
        wide = overlap
        while True:
            # One character before `since` at least: what a chunk adds at its start is not counted.
            first = _character(data, max(since - 1, 0))
            start = _character(data, max(end - wide, first))
            stop = _character(data, min(max(start + chunk, end + wide), len(data)))
            later = _begins(sp, data[start:stop]) + start
            common = np.intersect1d(begins, later)
            common = common[(common > max(start, since)) & (common < end - 1)]
            splice = next((int(p) for p in common[::-1] if _stable(data, int(p))), None)
            if splice is not None or start == first:
                break
            wide *= 2
        if splice is None:  # no stable boundary since `since`: the longer chunk replaces this one
            begins, end = later, stop
            continue
        count += int(((begins >= since) & (begins < splice)).sum())
        begins, since, end = later, splice, stop
    return count + int((begins >= since).sum())


def token_counts(
    docs: DataFrame, model_path: str, limit: int = 4096, *, doc_id="doc_id", text="text",
    chunk: int = 1 << 15, overlap: int = 1 << 9,
) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row, as the sentencepiece model counts
    whole texts, without begin and end tokens.

    Null and empty texts have 0 bytes and 0 tokens. Repeated rows repeat; ids may be null. The model
    file is read on the driver and sent to the tasks (its size is the vocabulary's).
    """
    with open(model_path, "rb") as file:
        model = docs.sparkSession.sparkContext.broadcast(file.read())

    def batch(rows: pa.RecordBatch) -> pa.RecordBatch:
        texts = texts_as_bytes(rows, "text")
        short = [i for i, t in enumerate(texts) if len(t) <= chunk]
        counts = np.zeros(len(texts), np.int64)
        sp, _ = _processor(model.value)
        if short:
            encoded = sp.encode([texts[i].decode() for i in short], num_threads=1)
            counts[short] = [len(ids) for ids in encoded]
        for i in set(range(len(texts))).difference(short):
            counts[i] = count_tokens(model.value, texts[i], chunk, overlap)
        lengths = pa.array(map(len, texts), pa.int64())
        return pa.RecordBatch.from_arrays(
            [rows.column(0), lengths, pa.array(counts), pa.array(counts > limit)],
            ["doc_id", "n_bytes", "n_tokens", "over_limit"],
        )

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean"
    return map_texts(rows, "text", batch, schema)
