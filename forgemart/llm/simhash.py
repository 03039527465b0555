"""SimHash near-duplicates, linked through BK-trees over shards of fingerprints."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forgemart.llm.components import components, merge_links
from forgemart.llm.scratch import free_names, map_pandas, map_texts, saved, texts_as_bytes

#: Fingerprints of one shard tree at most; larger shards are searched piece by piece.
PIECE = 2048
#: Rows that a task links at once.
FOREST = 1 << 16


def simhash(text: bytes, shingle: int = 4, seed: int = 42) -> int:
    """64-bit SimHash: bit b is set if over half of the shingles' XXH64 values have it.

    A-Z are lower-cased, words are runs without ASCII white space, shingles repeat as often as they
    occur. A text of fewer words is one shingle; one without words has fingerprint 0.
    """
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    last = max(len(words) - shingle, 0) + 1
    spans = zip(starts[:last].tolist(), ends[min(shingle, len(words)) - 1 :].tolist(), strict=True)
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[s:e], seed) for s, e in spans), np.uint64, last)
    ones = np.zeros(64, np.int64)
    for i in range(0, last, 1 << 14):
        bits = np.unpackbits(hashes[i : i + (1 << 14)].view(np.uint8), bitorder="little")
        ones += bits.reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > last, bitorder="little").view(np.uint64)[0])


def _content(text: str) -> dict[str, Column]:
    return {"content": F.xxhash64(F.col(text)), "check": F.xxhash64(F.lit(1), F.col(text))}


def fingerprints(docs: DataFrame, shingle: int = 4, *, hashed: bool = False, doc_id="doc_id", text="text") -> DataFrame:
    """(doc_id, simhash) of every row; the 64 bits as a signed long. Null text has none set. If
    `hashed`, also content and check, the text's hash in two parts."""
    hashes = _content(text) if hashed else {}
    names = ["doc_id", *hashes, "simhash"]

    def batch(rows: pa.RecordBatch) -> pa.RecordBatch:
        values = [simhash(t, shingle) for t in texts_as_bytes(rows, "text")]
        values = np.array(values, np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([*(rows.column(c) for c in names[:-1]), pa.array(values)], names)

    rows = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"),
        *(c.alias(name) for name, c in hashes.items()), F.col(text).alias("text"),
    )
    return map_texts(rows, "text", batch, ", ".join(f"{name} long" for name in names))


class BkForest:
    """BK-trees over groups of distinct 64-bit values, all built and searched level by level.

    A node's children are keyed by their distance to it. `values` are sorted by group; each group's
    first value is its root.
    """

    def __init__(self, values: np.ndarray, group: np.ndarray):
        n = len(values)
        self.values = values
        firsts = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
        self.root = firsts[np.cumsum(np.concatenate(([True], group[1:] != group[:-1]))) - 1]
        self.parent = np.full(n, -1)
        self.edge = np.zeros(n, np.int64)
        at = self.root.copy()
        left = np.flatnonzero(at != np.arange(n))
        while len(left):
            distance = np.bitwise_count(values[left] ^ values[at[left]]).astype(np.int64)
            key = at[left] * 65 + distance
            order = np.argsort(key, kind="stable")
            sorted_key = key[order]
            new = np.concatenate(([True], sorted_key[1:] != sorted_key[:-1]))
            child = left[order[new]]  # the first to arrive at an edge becomes its node
            self.parent[child] = at[child]
            self.edge[child] = distance[order[new]]
            down = np.empty(len(left), np.int64)
            down[order] = child[np.cumsum(new) - 1]
            at[left] = down
            left = left[down != left]
        inner = np.flatnonzero(self.parent >= 0)
        self.child = inner[np.lexsort((self.edge[inner], self.parent[inner]))]
        self.child_key = self.parent[self.child] * 65 + self.edge[self.child]

    def near(self, query: np.ndarray, root: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (index into query, node) at `radius` bits or less; each query starts at its root.
        From a node at distance d only the edges d - radius to d + radius are followed."""
        found_query, found_node = [], []
        for start in range(0, len(query), FOREST):
            who = np.arange(start, min(start + FOREST, len(query)))
            node = root[who]
            while len(who):
                distance = np.bitwise_count(query[who] ^ self.values[node]).astype(np.int64)
                hit = distance <= radius
                found_query.append(who[hit])
                found_node.append(node[hit])
                low = np.searchsorted(self.child_key, node * 65 + np.maximum(distance - radius, 0))
                high = np.searchsorted(self.child_key, node * 65 + np.minimum(distance + radius, 64), "right")
                many = high - low
                who = np.repeat(who, many)
                offset = np.arange(len(who)) - np.repeat(np.cumsum(many) - many, many)
                node = self.child[np.repeat(low, many) + offset]
        return np.concatenate(found_query or [[]]).astype(int), np.concatenate(found_node or [[]]).astype(int)


def _link(rows: pd.DataFrame, radius: int) -> pd.DataFrame:
    """The links in whole cells, as paths: a node is named twice a cell at most."""
    rows = rows.sort_values(["cell", "tree"], ascending=[True, False], kind="stable")
    cell = rows["cell"].to_numpy()
    value = rows["simhash"].to_numpy().view(np.uint64)
    tree = rows["tree"].to_numpy()
    node = rows["node"].to_numpy()
    inside = np.flatnonzero(tree)
    forest = BkForest(value[inside], cell[inside])
    # Queries are all rows of the cell; those that a cell's tree holds search it too.
    first = np.searchsorted(cell[inside], cell)
    known = (first < len(inside)) & (cell[inside][np.minimum(first, len(inside) - 1)] == cell)
    query, hit = forest.near(value[known], first[known], radius)
    parent = np.arange(len(rows))
    merge_links(parent, np.flatnonzero(known)[query], inside[hit])
    order = np.lexsort((node, parent))
    same = parent[order][1:] == parent[order][:-1]
    return pd.DataFrame({"a": node[order][:-1][same], "b": node[order][1:][same]})


def link_fingerprints(nodes: DataFrame, radius: int = 4, blocks: int | None = None) -> DataFrame:
    """Links (a, b) that connect the rows of `nodes` (node long, simhash long, each value once)
    exactly as all pairs at `radius` bits or less do.

    The 64 bits are cut into radius + 1 blocks (or more): values so near agree in one of them at
    least, so shards hold the values that agree in a block. A shard has a BK-tree for each PIECE of
    its values, and each of its pieces asks each of those trees in a cell of its own, so no task
    holds a large shard. There are (radius + 1) x 2^13 shards at most for radius 4: their counts,
    and only those, are joined back to find the number of pieces.
    """
    blocks = blocks or radius + 1
    edges = [64 * i // blocks for i in range(blocks + 1)]
    bands = F.array(
        *(
            F.struct(
                F.lit(i).alias("block"),
                F.shiftrightunsigned("simhash", low).bitwiseAND((1 << (high - low)) - 1).alias("bits"),
            )
            for i, (low, high) in enumerate(zip(edges, edges[1:], strict=False))
        )
    )
    rows = nodes.select("node", "simhash", F.explode(bands).alias("band")).select(
        "node", "simhash", F.col("band.block").alias("block"), F.col("band.bits").alias("bits")
    )
    pieces = (
        rows.groupBy("block", "bits")
        .agg(F.count("*").alias("n"))
        .where("n > 1")
        .select("block", "bits", F.ceil(F.col("n") / PIECE).cast("int").alias("pieces"))
    )
    piece = F.pmod(F.xxhash64("simhash", F.lit(1)), "pieces").cast("int")
    rows = rows.join(pieces, ["block", "bits"]).withColumn("piece", piece)
    # Cell (i, j) with i <= j: the tree of piece i, asked by piece j.
    cells = F.transform(
        F.sequence(F.lit(0), F.col("pieces") - 1),
        lambda other: F.struct(
            F.least("piece", other).alias("i"),
            F.greatest("piece", other).alias("j"),
            (F.col("piece") <= other).alias("tree"),
        ),
    )
    rows = rows.select("node", "simhash", "block", "bits", F.explode(cells).alias("at")).select(
        "node", "simhash", F.xxhash64("block", "bits", "at.i", "at.j").alias("cell"), "at.tree"
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: list[pd.DataFrame] = []
        for batch in batches:
            kept.append(batch)
            if sum(map(len, kept)) >= FOREST:
                rows = pd.concat(kept)
                open_cell = rows["cell"] == rows["cell"].iloc[-1]
                yield _link(rows[~open_cell], radius)
                kept = [rows[open_cell]]
        if kept:
            yield _link(pd.concat(kept), radius)

    spread = rows.repartition("cell").sortWithinPartitions("cell")
    return map_pandas(spread, run, "a long, b long")


def near_duplicates(
    docs: DataFrame, shingle: int = 4, radius: int = 4, *, doc_id="doc_id", text="text"
) -> DataFrame:
    """(doc_id, simhash, component_id) of every row of documents.

    Rows whose fingerprints differ in `radius` bits or less are linked; component_id is the least
    doc_id that links lead to. Null, empty and blank texts have fingerprint 0 and link like others.
    Repeated rows repeat. A null doc_id names no component, but rows without one link others: they
    get the component of their fingerprint, null if links lead to no id. An empty table gives an
    empty result.

    Rows of one fingerprint become one node, named by it, before anything is compared.
    """
    prints = saved(fingerprints(docs, shingle, doc_id=doc_id, text=text))
    nodes = saved(
        prints.groupBy("simhash").agg(F.min("doc_id").alias("least")).select(F.col("simhash").alias("node"), "simhash", "least")
    )
    found = components(link_fingerprints(nodes.select("node", "simhash"), radius))
    joined = saved(nodes.join(found, "node", "left").select("simhash", "least", F.coalesce("component", "node").alias("group")))
    named = saved(joined.groupBy("group").agg(F.min("least").alias("component_id")))
    groups = joined.join(named, "group").select("simhash", "component_id")
    return prints.join(groups, "simhash", "left").select("doc_id", "simhash", "component_id")


def keep_first(docs: DataFrame, shingle: int = 4, radius: int = 4, *, doc_id="doc_id", text="text") -> DataFrame:
    """The first row, all columns, of each group of rows whose fingerprints links of `radius` bits or
    less connect: by (doc_id, fingerprint, hash of the text).

    Groups are of fingerprints, so rows of one id but different texts are apart unless these link.
    Of rows that agree in id and text one stays. Rows without an id have no place: all of them stay,
    and they link others.
    """
    prints = fingerprints(docs, shingle, hashed=True, doc_id=doc_id, text=text)
    known = F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "simhash", "content", "check"))
    first = F.min(known).alias("first")
    nodes = saved(prints.groupBy("simhash").agg(first).select(F.col("simhash").alias("node"), "simhash", "first"))
    found = components(link_fingerprints(nodes.select("node", "simhash"), radius))
    groups = nodes.join(found, "node", "left").groupBy(F.coalesce("component", "node")).agg(F.min("first").alias("first"))
    of, content, check = free_names(docs, "of", "content", "check")
    least = groups.where("first is not null").select("first.doc_id", "first.content", "first.check")
    least = saved(least.toDF(of, content, check))
    rows = docs.withColumns(dict(zip((content, check), _content(text).values(), strict=True)))
    same = [F.col(doc_id).cast("long") == F.col(of), *(rows[c] == least[c] for c in (content, check))]
    named = rows.join(least, same, "left_semi").dropDuplicates([doc_id, content, check])
    return named.select(docs.columns).union(docs.where(F.col(doc_id).isNull()))
