from __future__ import annotations

import numpy as np
import pytest

from forgemart.llm import embeddings


def brute(rows, cosine=0.98):
    ok = [
        label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v, label in rows
    ]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    links = [0] * len(rows)
    for i, (_, a, la) in enumerate(rows):
        for j, (_, b, lb) in enumerate(rows[:i]):
            if ok[i] and ok[j] and la == lb and len(a) == len(b):
                a_, b_ = np.array(a, float), np.array(b, float)
                if a_ @ b_ / (np.linalg.norm(a_) * np.linalg.norm(b_)) >= cosine:
                    links[i] += 1
                    links[j] += 1
                    parent[root(i)] = root(j)
    least = {}
    for i, (vec, _, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), vec), vec)
    return sorted((vec, links[i], least[root(i)], least[root(i)] == vec) for i, (vec, _, _) in enumerate(rows))


def sample():
    draw = np.random.default_rng(1)
    rows = []
    for base in draw.normal(size=(25, 12)):
        for spread in draw.choice([0.01, 0.05, 0.08, 0.3], 8):
            rows.append((base + spread * draw.normal(size=12)).astype(np.float32).tolist())
    rows += [rows[0], rows[0], (2 * np.array(rows[5])).tolist()]
    rows = [(i, v, i % 2) for i, v in enumerate(rows)]
    odd = [None, [], [0.0] * 12, [None] + [1.0] * 11, [float("nan")] + [1.0] * 11, [float("inf")] + [1.0] * 11, rows[0][1][:5]]
    rows += [(1000 + i, v, 0) for i, v in enumerate(odd)]
    return rows + [(2000, rows[0][1], None), (2001, rows[0][1], None)]


@pytest.mark.parametrize(("piece", "cosine"), [(2048, 0.98), (16, 0.98), (16, 0.7), (5, 0.98)])
def test_links_and_components(spark, monkeypatch, piece, cosine):
    """Small pieces give several cells, visitors and pieces of cells."""
    monkeypatch.setattr(embeddings, "PIECE", piece)
    rows = sample()
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, label int, n_links int")
    found = embeddings.near_vectors(df.repartition(3), cosine).collect()
    assert sorted(tuple(r) for r in found) == brute([(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], c) for i, v, c in rows], cosine)


def test_large_cells_are_split_level_by_level(spark, monkeypatch):
    """Cells of more than four members are split by about six centres, and their cells again."""
    for name, value in (("PIECE", 2), ("LARGE", 2), ("FAN", 6)):
        monkeypatch.setattr(embeddings, name, value)
    rows = [r for r in sample() if r[0] < 120]
    nodes = spark.createDataFrame([(i.to_bytes(2), 1, c, v) for i, v, c in rows], "node binary, weight long, label int, vector array<double>")
    placed, counts = embeddings._cells(nodes, 0.98)
    homes = placed.where("home").groupBy("node").count().collect()
    assert sorted(r["count"] for r in homes) == [1] * len(rows)
    assert max(path.count(".") for (path,) in counts.select("path").collect()) >= 2
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert sorted(tuple(r) for r in embeddings.near_vectors(df, 0.98).collect()) == brute(rows)


def test_cover_tree_holds_its_invariants():
    draw = np.random.default_rng(2)
    close = draw.normal(size=(1, 6)) + 1e-9 * draw.normal(size=(20, 6))
    many = (draw.normal(size=(200, 6)), np.repeat(draw.normal(size=(1, 6)), 30, 0), close)
    points = embeddings._unit(np.concatenate(many))
    tree = embeddings.CoverTree(points).freeze()
    assert sorted(tree.order) == list(range(len(points)))
    for node, kids in enumerate(tree.children):
        held = tree.order[tree.begin[node] : tree.end[node]]
        away = np.linalg.norm(points[held] - points[tree.centre[node]], axis=1)
        assert away.max() <= tree.radius[node] + 1e-7
        if len(kids):
            assert tree.centre[kids[0]] == tree.centre[node]  # nested
            assert sum(tree.end[k] - tree.begin[k] for k in kids) == len(held)
            assert all(tree.radius[k] <= max(tree.radius[node] / 2, embeddings.NEAR) + 1e-7 for k in kids)
        elif tree.radius[node] == 0:
            assert (points[held] == points[held[0]]).all()


def test_repeated_ids_and_empty(spark):
    kind = "vec_id long, embedding array<double>, label int"
    assert embeddings.near_vectors(spark.createDataFrame([], kind)).count() == 0
    rows = [(1, [1.0, 0.0], 5), (1, [1.0, 0.0], 5), (None, [1.0, 0.0], 5), (3, [0.0, 1.0], 5)]
    found = sorted(tuple(r) for r in embeddings.near_vectors(spark.createDataFrame(rows, kind)).collect() if r[0])
    assert found == [(1, 2, 1, True), (1, 2, 1, True), (3, 0, 3, True)]
