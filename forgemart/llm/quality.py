"""Quality classifier: random-indexing word vectors, pooled, and a small calibrated network."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forgemart.llm.scratch import map_arrow, map_texts, slices, texts_as_bytes

#: Words and their shapes share WORDS slots by their checksum, and each slot has a vector of DIMS
#: numbers, so that the word vectors of any corpus are a table of 4 MB.
WORDS, DIMS, SPARSE, REACH = 1 << 15, 32, 2, 2
FEATURES = 4 * DIMS
CHUNKS = 16  # pieces in which tasks hand over their sums
HIDDEN, EPOCHS, BATCH, RATE, DECAY, SEED = 32, 60, 256, 3e-3, 1e-4, 7


#: Fixed table: letters by case, bytes of other characters as small letters, digits as 0.
_CLASS = bytes(
    ord("a") if c >= 128 or chr(c).islower() else ord("A") if chr(c).isupper() else ord("0") if chr(c).isdigit() else c
    for c in range(256)
)


def _slots(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Slots of a text's words (runs without ASCII white space, as written), and of their shapes:
    the class of the first character and of the last three."""
    words = text.split()
    shapes = [w[:1] + w[-3:] for w in text.translate(_CLASS).split()]
    half = WORDS // 2

    def slots(items: list[bytes]) -> np.ndarray:
        return np.fromiter(map(zlib.crc32, items), np.uint32, len(items)).astype(np.int64) & (half - 1)

    return slots(words), slots(shapes) + half


def _index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """The sparse index vector of each slot: SPARSE places, each with +1 or -1."""
    draw = np.random.default_rng(SEED)
    return draw.integers(0, DIMS, (WORDS, SPARSE)), draw.choice([-1.0, 1.0], (WORDS, SPARSE))


def context_sums(texts: list[bytes]) -> np.ndarray:
    """Sums, for each slot, of the index vectors of the words up to REACH before and after it."""
    places, signs = _index_vectors()
    total = np.zeros(WORDS * DIMS)
    for slots in (slots for text in texts for slots in _slots(text)):
        for start in range(0, len(slots), 1 << 16):  # with REACH words of the next stretch
            here = slots[start : start + (1 << 16) + REACH]
            for gap in range(1, REACH + 1):
                left, right = here[:-gap], here[gap:]
                if start + (1 << 16) < len(slots):
                    left, right = left[: 1 << 16], right[: 1 << 16]
                for word, other in ((left, right), (right, left)):
                    at = (word * DIMS)[:, None] + places[other]
                    np.add.at(total, at.ravel(), signs[other].ravel())
    return total.astype(np.int64)


def word_vectors(docs: DataFrame, text: str = "text") -> np.ndarray:
    """The WORDS x DIMS table of the corpus, each vector of length 1 (or 0).

    Every word of every text counts. Each task sums its part and hands it over in CHUNKS pieces,
    which other tasks add one at a time, so memory doesn't grow with the corpus; sums are whole
    numbers, so order doesn't matter. The driver gets the table, whose size is fixed.
    """

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(WORDS * DIMS, np.int64)
        for batch in slices(batches, "text"):
            total += context_sums(texts_as_bytes(batch, "text"))
        if total.any():
            pieces = [p.tobytes() for p in np.split(total, CHUNKS)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(CHUNKS), pa.int32()), pa.array(pieces, pa.binary())], ["chunk", "sums"]
            )

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, sums in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                piece = np.frombuffer(sums, np.int64)
                total[chunk] = total[chunk] + piece if chunk in total else piece
        yield pa.RecordBatch.from_arrays(
            [pa.array(total.keys(), pa.int32()), pa.array([t.tobytes() for t in total.values()], pa.binary())],
            ["chunk", "sums"],
        )

    kind = "chunk int, sums binary"
    parts = map_arrow(docs.select(F.col(text).alias("text")), part, kind)
    table = np.zeros((CHUNKS, WORDS * DIMS // CHUNKS))
    for row in map_arrow(parts.repartition(CHUNKS, "chunk"), add, kind).collect():
        table[row["chunk"]] += np.frombuffer(row["sums"], np.int64)
    table = table.reshape(WORDS, DIMS)
    length = np.linalg.norm(table, axis=1, keepdims=True)
    return (table / np.where(length > 0, length, 1)).astype(np.float32)


def pool(text: bytes, vectors: np.ndarray) -> np.ndarray:
    """Mean and standard deviation of the vectors of a text's words, then of its words' shapes;
    zeros for a text without words."""
    pooled = []
    for slots in _slots(text):
        total, squares, n = np.zeros(DIMS), np.zeros(DIMS), max(len(slots), 1)
        for start in range(0, len(slots), 1 << 14):
            part = vectors[slots[start : start + (1 << 14)]]
            total += part.sum(0, dtype=np.float64)
            squares += np.einsum("ij,ij->j", part, part, dtype=np.float64)
        mean = total / n
        pooled += [mean, np.sqrt(np.maximum(squares / n - mean * mean, 0))]
    return np.concatenate(pooled)


@dataclass
class Network:
    """Two layers over standardised features; `temperature` divides the last layer's output."""

    mean: np.ndarray
    spread: np.ndarray
    first: np.ndarray
    bias: np.ndarray
    last: np.ndarray
    offset: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        """Sums run in one order for each row, so that rows of a batch don't change each other's
        last digits, as they do in a matrix product."""
        z = (x - self.mean) / self.spread
        hidden = np.tanh(np.einsum("ij,jk->ik", z, self.first, optimize=False) + self.bias)
        return np.einsum("ij,j->i", hidden, self.last, optimize=False) + self.offset

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -60, 60)))


def fit_network(x: np.ndarray, y: np.ndarray) -> Network:
    """Trains on four fifths of the rows by Adam and sets the temperature on the last fifth.

    Without rows every score is 0.5; with one label alone, near that label.
    """
    width = x.shape[1] if x.ndim == 2 else FEATURES
    draw = np.random.default_rng(SEED)
    spread = x.std(0) if len(x) else np.ones(width)
    net = Network(
        x.mean(0) if len(x) else np.zeros(width), np.where(spread > 1e-9, spread, 1.0),
        draw.normal(0, width**-0.5, (width, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), 0.0,
    )
    if len(y) == 0 or y.min() == y.max():
        net.offset = 0.0 if len(y) == 0 else (4.0 if y[0] else -4.0)
        return net
    order = draw.permutation(len(y))
    held, train = order[: len(y) // 5], order[len(y) // 5 :]
    z = (x - net.mean) / net.spread
    weights = [net.first, net.bias, net.last, np.zeros(1)]
    moment, square, step = [0 * w for w in weights], [0 * w for w in weights], 0
    for _ in range(EPOCHS):
        draw.shuffle(train)
        for start in range(0, len(train), BATCH):
            rows = train[start : start + BATCH]
            hidden = np.tanh(z[rows] @ weights[0] + weights[1])
            error = (1 / (1 + np.exp(-np.clip(hidden @ weights[2] + weights[3], -60, 60))) - y[rows]) / len(rows)
            back = np.outer(error, weights[2]) * (1 - hidden**2)
            step += 1
            for i, slope in enumerate((z[rows].T @ back, back.sum(0), hidden.T @ error, error.sum(keepdims=True))):
                slope = slope + DECAY * weights[i]
                moment[i] = 0.9 * moment[i] + 0.1 * slope
                square[i] = 0.999 * square[i] + 0.001 * slope**2
                weights[i] = weights[i] - RATE * (moment[i] / (1 - 0.9**step)) / (
                    np.sqrt(square[i] / (1 - 0.999**step)) + 1e-8
                )
    net.first, net.bias, net.last, net.offset = weights[0], weights[1], weights[2], float(weights[3][0])
    if len(held):
        logits, truth = net.logits(x[held]), y[held]
        options = np.geomspace(0.25, 8, 61)
        loss = [np.logaddexp(0, np.where(truth > 0, -logits, logits) / t).mean() for t in options]
        net.temperature = float(options[int(np.argmin(loss))])
    return net


def held_out(doc_id: str = "doc_id"):
    """Whether a row's label may not be learnt from; a null id has no label."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(3)) == 1, F.lit(False))


def train_quality(
    docs: DataFrame, labels: DataFrame, sample: int = 10_000, *, doc_id="doc_id", text="text"
) -> tuple[np.ndarray, Network]:
    """Word vectors of all of `docs`, and a network fitted on labelled rows that aren't held out.

    `sample` bounds the labelled ids that the network is fitted on: those with the least hash. Ids
    labelled more than once count as the lower label; null ids and labels are left out.
    """
    known = (
        labels.select(F.col("doc_id").cast("long").alias("id"), "quality")
        .where("id is not null and quality is not null")
        .where(~held_out("id"))
        .groupBy("id").agg(F.min("quality").alias("quality"))
        .orderBy(F.xxhash64("id"), "id").limit(sample)
    )
    vectors = word_vectors(docs, text)
    sent = docs.sparkSession.sparkContext.broadcast(vectors)

    def batch(rows: pa.RecordBatch) -> pa.RecordBatch:
        pooled = [pool(t, sent.value).tobytes() for t in texts_as_bytes(rows, "text")]
        return pa.RecordBatch.from_arrays(
            [rows.column(0), rows.column(1), pa.array(pooled, pa.binary())], ["id", "quality", "pooled"]
        )

    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    rows = rows.join(F.broadcast(known), "id").select("id", F.col("quality").cast("int"), "text")
    found = map_texts(rows, "text", batch, "id long, quality int, pooled binary")
    # One row an id, so that repeated rows of documents don't widen what the driver gets.
    found = found.groupBy("id").agg(F.min("quality").alias("y"), F.min("pooled").alias("x")).orderBy("id").collect()
    x = np.array([np.frombuffer(r["x"]) for r in found]).reshape(len(found), FEATURES)
    return vectors, fit_network(x, np.array([float(r["y"] > 0) for r in found]))


def score_quality(
    docs: DataFrame, vectors: np.ndarray, network: Network, *, doc_id="doc_id", text="text"
) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row; a text without words has a score too."""
    model = docs.sparkSession.sparkContext.broadcast((vectors, network))

    def batch(rows: pa.RecordBatch) -> pa.RecordBatch:
        table, net = model.value
        pooled = np.array([pool(t, table) for t in texts_as_bytes(rows, "text")]).reshape(-1, FEATURES)
        score = net.scores(pooled)
        return pa.RecordBatch.from_arrays(
            [rows.column(0), rows.column(1), pa.array(score), pa.array((score >= 0.5).astype(np.int32))],
            ["doc_id", "held_out", "score", "predicted"],
        )

    rows = docs.select(F.col(doc_id).alias("doc_id"), held_out(doc_id).alias("held_out"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return map_texts(rows, "text", batch, f"doc_id {kind}, held_out boolean, score double, predicted int")


def classify(docs: DataFrame, labels: DataFrame, sample: int = 10_000, *, doc_id="doc_id", text="text") -> DataFrame:
    """Trains on `docs` and `labels` and scores every row of `docs`.

    Null and empty texts are scored from zeros; empty tables give an empty result or scores of 0.5.
    Training runs while the result is built: two passes over the texts, then one more to score.
    """
    vectors, network = train_quality(docs, labels, sample, doc_id=doc_id, text=text)
    return score_quality(docs, vectors, network, doc_id=doc_id, text=text)


def keep_good(docs: DataFrame, labels: DataFrame, sample: int = 10_000, *, doc_id="doc_id", text="text") -> DataFrame:
    """The rows of `docs`, all columns, that are scored 0.5 or more."""
    vectors, network = train_quality(docs, labels, sample, doc_id=doc_id, text=text)
    model = docs.sparkSession.sparkContext.broadcast((vectors, network))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, net = model.value
        for rows in slices(batches, text):
            pooled = np.array([pool(t, table) for t in texts_as_bytes(rows, text)]).reshape(-1, FEATURES)
            yield rows.filter(pa.array(net.scores(pooled) >= 0.5))

    return map_arrow(docs, run, docs.schema)
