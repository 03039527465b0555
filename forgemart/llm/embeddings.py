"""Embedding near-duplicates: exact threshold pairs by dual traversal of cover trees."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forgemart.llm.components import components, merge_links
from forgemart.llm.scratch import saved, ship_code, whole_number

#: Vectors of one tree; cells of more than LARGE pieces of members are split, by about FAN centres at
#: once. Below that, comparing pieces costs less than the copies of rows near borders.
PIECE, LARGE, FAN = 4096, 8, 256
#: Candidates for centres, and single points, whose distances are computed at once, at most.
BLOCK, SLAB = 64, 512
#: Columns that name a cell: the label as text, the vectors' length, the centres chosen level by level.
CELL = ("label", "size", "path")
#: Distance below which points are compared by value, and the slack of bounds against rounding.
NEAR, SLACK = 1e-7, 1e-6


def _apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distances of unit vectors, to about 1e-8; bounds leave a hundred times as much."""
    return np.sqrt(np.maximum(2 - 2 * x @ y.T, 0))


class CoverTree:
    """Nested levels of centres with halving radii over rows of `points`.

    The first centre covers everything; at each further level a node's points are covered by centres
    of its own, the node's centre among them, within half the radius. A node holds a range of
    `order`; `radius` is the largest distance of its points from its centre. Only distances to
    centres are computed, and a node hands its points' distances on to its first child.
    """

    def __init__(self, points: np.ndarray):
        self.points = points
        self.order = np.arange(len(points))
        self.centre, self.begin, self.end, self.radius, self.children = [], [], [], [], []
        self._node(self.order.copy(), _apart(points[:1], points)[0], 0, 2.0)

    def _node(self, rows: np.ndarray, distance: np.ndarray, begin: int, scale: float) -> int:
        """A node for `rows`, the centre first, which fill `order` from `begin`; `distance` is that
        from the centre."""
        me, centre, points = len(self.centre), int(rows[0]), self.points
        far = float(distance.max())
        same = far < NEAR and bool((points[rows] == points[centre]).all())
        self.centre.append(centre)
        self.begin.append(begin)
        self.end.append(begin + len(rows))
        self.radius.append(0.0 if same else max(far, NEAR))
        self.children.append(())
        if same:
            self.order[begin : begin + len(rows)] = rows
            return me  # copies of one point
        scale = min(scale, self.radius[me]) / 2
        kids = self._copies(rows) if self.radius[me] <= NEAR else self._cover(rows, distance, scale)
        children = []
        for some, away in kids:
            children.append(self._node(some, away, begin, scale) if len(some) > 1 else self._point(int(some[0]), begin))
            begin += len(some)
        self.children[me] = np.array(children)
        return me

    def _point(self, row: int, begin: int) -> int:
        """A node for one row."""
        self.order[begin] = row
        self.centre.append(row)
        self.begin.append(begin)
        self.end.append(begin + 1)
        self.radius.append(0.0)
        self.children.append(())
        return len(self.centre) - 1

    def _copies(self, rows: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Points too near to tell by distance: a child for each different one."""
        _, of = np.unique(self.points[rows], axis=0, return_inverse=True)
        kids = [rows[of == k] for k in dict.fromkeys(of.ravel().tolist())]
        return [(some, np.zeros(len(some))) for some in kids]

    def _cover(self, rows: np.ndarray, distance: np.ndarray, scale: float) -> list[tuple[np.ndarray, np.ndarray]]:
        """Each point with the first centre within `scale`; the first that has none is the next one.

        Candidates' distances come in blocks, which grow while all candidates become centres.
        """
        near = distance <= scale
        near[0] = True
        kids = [(rows[near], distance[near])]
        left, block = rows[~near], 1
        while len(left):
            away = _apart(self.points[left[:block]], self.points[left])
            taken, found = np.zeros(len(left), bool), 0
            for i, far in enumerate(away):
                if not taken[i]:
                    near = (far <= scale) & ~taken
                    near[i] = True
                    kids.append((left[near], far[near]))
                    taken |= near
                    found += 1
            block = min(2 * block, BLOCK) if found == len(away) else max(found, 1)
            left = left[~taken]
        return kids

    def freeze(self) -> CoverTree:
        self.centre, self.radius = np.array(self.centre), np.array(self.radius)
        self.begin, self.end = np.array(self.begin), np.array(self.end)
        return self


def _rows(a: CoverTree, b: CoverTree, p: np.ndarray, q: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """The rows of the node pairs (p[k], q[k]): those of one row each together, others pair by pair."""
    one = (a.end[p] - a.begin[p] == 1) & (b.end[q] - b.begin[q] == 1)
    if one.any():
        yield a.order[a.begin[p[one]]], b.order[b.begin[q[one]]], False
    for i, j in zip(p[~one], q[~one], strict=True):
        yield a.order[a.begin[i] : a.end[i]], b.order[b.begin[j] : b.end[j]], True


def near_pairs(a: CoverTree, b: CoverTree, cosine: float) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """Covers the pairs of unit vectors of a and b at `cosine` or more exactly once.

    Gives (rows of a, rows of b, every): if `every`, all pairs of them are near, else those at equal
    places. A pair of nodes is dropped if its centres are further apart than the threshold and both
    radii allow, and taken whole if they are so near that all pairs are within it; otherwise
    children meet children. Single points meet by their cosines.
    """
    reach = np.sqrt(2 - 2 * cosine)
    todo = [(np.array([0]), np.array([0]))]
    while todo:
        left, right = todo.pop()
        thin_left, thin_right = a.radius[left] == 0, b.radius[right] == 0
        # Single points decide by their cosine alone.
        p, q = left[thin_left], right[thin_right]
        for k in range(0, len(p) if len(q) else 0, SLAB):
            i, j = np.nonzero(a.points[a.centre[p[k : k + SLAB]]] @ b.points[b.centre[q]].T >= cosine)
            yield from _rows(a, b, p[k + i], q[j])
        for p, q in ((left[~thin_left], right), (p, right[~thin_right])):
            if not len(p) or not len(q):
                continue
            apart = _apart(a.points[a.centre[p]], b.points[b.centre[q]])
            radii = a.radius[p][:, None] + b.radius[q][None, :]
            inside = apart + radii <= reach - SLACK
            i, j = np.nonzero(inside)
            yield from _rows(a, b, p[i], q[j])
            further = ~inside & (apart - radii <= reach + SLACK)
            # Each node's children meet the children of all its partners in one product.
            for i in np.flatnonzero(further.any(1)):
                below = a.children[p[i]] if len(a.children[p[i]]) else p[i : i + 1]
                nodes = [b.children[k] if len(b.children[k]) else np.array([k]) for k in q[further[i]]]
                todo.append((below, np.concatenate(nodes)))


def _unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.sqrt(np.einsum("ij,ij->i", vectors, vectors))[:, None]


def link_cell(rows: pd.DataFrame, cosine: float) -> pd.DataFrame:
    """Of one cell's piece of members against one piece of points: (node, links, root) of all nodes
    that are linked; links counts weights and is for members, root the least node they lead to."""
    rows = rows.sort_values("node", kind="stable").drop_duplicates(["node", "member"])
    points = rows.drop_duplicates("node")
    node = points["node"].to_numpy()
    unit = _unit(np.stack(points["vector"].to_numpy()).astype(float))
    weight = points["weight"].to_numpy()
    inside = np.flatnonzero(np.isin(node, rows["node"][rows["member"]]))
    asked = np.flatnonzero(np.isin(node, rows["node"][~rows["member"]]))
    if not len(inside) or not len(asked):
        return pd.DataFrame({"node": node[:0], "links": weight[:0], "root": node[:0]})
    links, parent = np.zeros(len(node), np.int64), np.arange(len(node))
    trees = CoverTree(unit[inside]).freeze(), CoverTree(unit[asked]).freeze()
    a, b, held = [], [], 0

    def merge() -> None:
        if held:
            merge_links(parent, np.concatenate(a), np.concatenate(b))
            a.clear()
            b.clear()

    for left, right, every in near_pairs(*trees, cosine):
        left, right = inside[left], asked[right]
        if every:  # all with the first of the other side
            links[left] += weight[right].sum()
            left = np.concatenate([left, np.full(len(right), left[0])])
            right = np.concatenate([np.full(len(left) - len(right), right[0]), right])
        else:
            np.add.at(links, left, weight[right])
        a.append(left)
        b.append(right)
        held += len(left)
        if held > 1 << 16:
            merge()
            held = 0
    merge()
    told = np.flatnonzero((links > 0) | (parent != np.arange(len(node))))
    return pd.DataFrame({"node": node[told], "links": links[told], "root": node[parent[told]]})


def near_vectors(
    vectors: DataFrame, cosine: float = 0.98, *, vec_id="vec_id", embedding="embedding", label="label"
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row.

    Rows of one label link at `cosine` or more, in double precision. Null labels, and vectors that
    are null, empty, zero or hold nulls or values that aren't finite, link with nothing; vectors of
    different lengths don't either. n_links counts the other rows linked directly, component_id is
    the least vec_id that links lead to, kept says that it is the row's own. Repeated ids count as
    rows each; a row without an id links, but names no component.

    Copies of one vector become one node. A label's nodes fall into cells by the nearest of a
    hashed sample of its centres; cells of more than LARGE * PIECE members are split again by
    centres of their own, level by level. A node joins, as a visitor, each cell whose border lies within the
    threshold's distance: no link is lost, since the nearer half space of the other centre is no
    further away than any vector in it. What can't be split (vectors that all lie within the
    threshold's distance) is cut in pieces of PIECE nodes; each piece of a cell's members meets each
    piece of its members and visitors in a task of its own, by cover trees.
    """
    rows = vectors.select(
        F.col(vec_id).cast("long").alias("vec_id"), F.col(label).alias("label"),
        F.transform(embedding, lambda x: x.cast("double")).alias("vector"),
    )
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.coalesce(F.col("label").isNotNull() & (F.size("vector") > 0) & finite & F.exists("vector", lambda x: x != 0), F.lit(False))
    rows = rows.select("vec_id", "label", F.when(usable, F.col("vector")).alias("vector"))
    rows = rows.withColumn("group", F.when(F.col("vector").isNotNull(), F.sha2(F.to_json(F.struct("label", "vector")), 256)))
    rows = saved(rows)
    nodes = saved(
        rows.where("group is not null").groupBy("group").agg(
            F.min("vec_id").alias("vec_id"), F.count("*").alias("weight"), F.first("label").alias("label"),
            F.first("vector").alias("vector"),
        ).withColumn("node", F.unhex("group"))
    )
    found = _links(nodes, cosine)
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    # Nodes are 256-bit hashes; a component is named by its least vec_id.
    named = nodes.select("node", "vec_id").join(roots, "node", "left").withColumn("root", F.coalesce("component", "node"))
    least = named.groupBy("root").agg(F.min("vec_id").alias("component_id"))
    groups = saved(
        nodes.select("node", "group", "weight").join(counts, "node", "left")
        .join(named.select("node", "root"), "node").join(least, "root")
        .select("group", F.greatest(F.coalesce("links", "weight"), "weight").alias("links"), "component_id")
    )
    result = rows.select("vec_id", "group").join(groups, "group", "left")
    component = F.when(F.col("group").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return result.select(
        "vec_id", F.coalesce(F.col("links") - 1, F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"),
    )


def _split(points: pd.DataFrame, centres: pd.DataFrame, reach: float) -> pd.DataFrame:
    """Some of a cell's points, each in the cell of its nearest centre and, as a visitor, in those
    whose half space is within `reach`. A cell without two centres stays whole."""
    if not len(points) or len(centres) < 2:
        return points
    near = _unit(np.stack(centres.sort_values("node")["vector"].to_numpy()).astype(float))
    dot = _unit(np.stack(points["vector"].to_numpy()).astype(float)) @ near.T
    home, every = dot.argmax(1), np.arange(len(points))
    border = np.maximum(_apart(near, near), 1e-9)
    visits = (dot[every, home][:, None] - dot) / border[home] <= reach
    visits[every, home] = True
    row, cell = np.nonzero(visits)
    found = points.iloc[row].reset_index(drop=True)
    return found.assign(path=found["path"] + np.char.mod(".%d", cell), home=found["home"].to_numpy() & (cell == home[row]))


def _cells(nodes: DataFrame, cosine: float) -> tuple[DataFrame, DataFrame]:
    """The nodes in their cells (CELL, node, weight, vector, home), and each cell's numbers of members
    and of all its points. A level splits large cells by about FAN centres each, in tasks of about
    PIECE points of a cell."""
    reach = float(np.sqrt(2 - 2 * cosine)) + SLACK
    key = list(CELL)
    placed = nodes.select(
        F.col("label").cast("string").alias("label"), F.size("vector").alias("size"), F.lit("").alias("path"),
        "node", "weight", "vector", F.lit(True).alias("home"),
    )
    above, done, counts, level = None, [], [], 0
    while True:
        count = placed.groupBy(*key).agg(F.count_if("home").alias("members"), F.count("*").alias("points")).where("members > 0")
        large = F.col("members") > LARGE * PIECE
        if above is not None:
            # Where a split took little away, pieces meet pieces instead.
            count = count.withColumn("outer", F.substring_index("path", ".", level)).join(above, ["label", "size", "outer"])
            large &= (F.col("members") <= 0.9 * F.col("was")) & (F.col("points") <= 0.5 * F.col("had"))
        count = saved(count.select(*key, "members", "points", large.alias("large")))
        counts.append(count.where("not large").drop("large"))
        done.append(placed.join(counts[-1].select(*key), key, "left_semi"))
        big = count.where("large").drop("large")
        if not whole_number(big, F.count("*")):
            break
        rows = placed.join(big, key)
        drawn = F.pmod(F.xxhash64("node", F.lit(level)), "members") < FAN
        parts = F.ceil(F.col("points") / PIECE).cast("int")
        centres = saved(rows.where(F.col("home") & drawn).select(*key, "node", "vector", parts.alias("parts")))
        centres = centres.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        rows = rows.withColumn("part", F.pmod(F.xxhash64("node", F.lit(3)), parts).cast("int")).drop("members", "points")
        schema, names = placed.schema, placed.columns
        ship_code(nodes.sparkSession)
        both = rows.groupBy(*key, "part").cogroup(centres.groupBy(*key, "part"))
        placed = saved(both.applyInPandas(lambda points, centres: _split(points, centres, reach)[names], schema))  # noqa: B023
        above = big.select("label", "size", F.col("path").alias("outer"), F.col("members").alias("was"), F.col("points").alias("had"))
        level += 1
    return functools.reduce(DataFrame.union, done), functools.reduce(DataFrame.union, counts)


def _links(nodes: DataFrame, cosine: float) -> DataFrame:
    """(node, links, root): for each node the weights linked with it, itself included, in parts, and
    links to the roots of its parts."""
    placed, counts = _cells(nodes, cosine)
    pieces = counts.select(
        *CELL, F.ceil(F.col("members") / PIECE).cast("int").alias("inner"), F.ceil(F.col("points") / PIECE).cast("int").alias("all")
    )
    rows = placed.join(pieces, list(CELL))
    # Members of piece i ask piece j of all points: each row stands once in each cell (i, j) it is in.
    own, any_ = F.pmod(F.xxhash64("node", F.lit(1)), "inner").cast("int"), F.pmod(F.xxhash64("node", F.lit(2)), "all").cast("int")
    member = F.when(F.col("home"), F.transform(F.sequence(F.lit(0), F.col("all") - 1), lambda j: F.struct(own.alias("i"), j.alias("j"), F.lit(True).alias("member"))))
    point = F.transform(F.sequence(F.lit(0), F.col("inner") - 1), lambda i: F.struct(i.alias("i"), any_.alias("j"), F.lit(False).alias("member")))
    both = F.concat(F.coalesce(member, F.array().cast("array<struct<i:int,j:int,member:boolean>>")), point)
    rows = rows.withColumn("at", F.explode(both)).select(*CELL, "at.i", "at.j", "at.member", "node", "weight", "vector")
    ship_code(nodes.sparkSession)
    return saved(
        rows.groupBy(*CELL, "i", "j").applyInPandas(lambda pdf: link_cell(pdf, cosine), "node binary, links long, root binary")
    )
