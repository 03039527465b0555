"""Whitening against numpy's eigenvectors; the solver on hard matrices; hard rows."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from forgemart.llm import whitening
from forgemart.llm.queries import QUERIES


def brute(rows, scale=256, components=4):
    """(vec_id, component, n, deviation, whitened, explained) with the sign left open."""
    sound = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    lengths = [len(v) for _, v in sound]
    width = max(set(lengths), key=lambda d: (lengths.count(d), d))
    x = [(i, [math.floor(scale * float(c)) for c in v]) for i, v in sound if len(v) == width]
    fit = sorted({tuple(v) for _, v in x})
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    centre = np.array(sums) / n
    apart = np.array(fit, float) - centre
    values, vectors = np.linalg.eigh(apart.T @ apart / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    out = []
    for i, v in x:
        deviation = sum((n * a - s) ** 2 for a, s in zip(v, sums, strict=True))
        for k in range(min(components, width)):
            w = (np.array(v) - centre) @ vectors[:, k] / math.sqrt(values[k]) if values[k] > 1e-9 * values[0] else None
            out.append((i, k + 1, n, deviation, w, values[k] / values.sum()))
    return out


def agree(found, expected):
    found = sorted((r.component, repr(r.vec_id), r.deviation, r) for r in found)
    expected = sorted((e[1], repr(e[0]), e[3], e) for e in expected)
    assert [f[:3] for f in found] == [e[:3] for e in expected]
    for k in {f[0] for f in found}:
        got = [f[3] for f in found if f[0] == k]
        want = [e[3] for e in expected if e[0] == k]
        assert {r.n for r in got} == {e[2] for e in want}
        assert {r.explained for r in got} == {got[0].explained}
        assert got[0].explained == pytest.approx(want[0][5], rel=1e-9, abs=1e-12)
        a, b = (np.array([np.nan if v is None else v for v in side]) for side in ([r.whitened for r in got], [e[4] for e in want]))
        assert np.allclose(a, b, atol=1e-7, equal_nan=True) or np.allclose(a, -b, atol=1e-7, equal_nan=True)


def test_solver():
    draw = np.random.default_rng(0)
    for trial in range(120):
        n = int(draw.integers(1, 32))
        matrix = draw.normal(size=(n, n)) * 10.0 ** draw.integers(-3, 4, n)
        if trial % 5 == 0:
            matrix[:, : n // 2] = 0
        if trial % 7 == 0:
            matrix = np.eye(n) * 3
        if trial % 11 == 0 and n > 3:  # equal values
            turn, other = (np.linalg.qr(draw.normal(size=(n, n)))[0] for _ in range(2))
            matrix = turn @ np.diag([5.0, 5.0, 5.0, *np.linspace(1, 2, n - 3)]) @ other
        values, vectors = whitening.directions(matrix, 4)
        expected = np.linalg.svd(matrix, compute_uv=False)
        assert np.allclose(values, expected, rtol=1e-9, atol=1e-12 * expected[0])
        assert np.abs(vectors @ vectors.T - np.eye(len(vectors))).max() < 1e-12
        for vector, value in zip(vectors, values, strict=False):
            assert np.linalg.norm(matrix.T @ (matrix @ vector) - value**2 * vector) <= 1e-12 * expected[0] ** 2


def test_dqds_is_accurate_for_small_values():
    # A graded matrix whose least value a routine with absolute errors would lose.
    diagonal, above = 10.0 ** np.arange(0, -24, -3), np.full(7, 1e-3) * 10.0 ** np.arange(0, -21, -3)
    values = whitening.dqds(diagonal, above)
    assert np.prod(values / np.sort(diagonal)[::-1]) == pytest.approx(1, rel=1e-10)  # both multiply to the determinant


def test_rows(spark):
    draw = np.random.default_rng(1)
    base = draw.normal(size=(150, 6)) * [3, 2, 1.5, 1, 0.5, 0.1]
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(base)]
    rows += [rows[0]] * 100 + [(None, rows[1][1]), (200, None), (201, []), (202, [1.0, None, 1.0, 1.0, 1.0, 1.0])]
    rows += [(203, [float("nan")] + [0.0] * 5), (204, [float("inf")] + [0.0] * 5), (205, [1.0, 2.0]), (206, [0.0] * 6), (207, [-0.0] * 6)]
    table = spark.createDataFrame([(*r, 1, 2.0) for r in rows], "vec_id long, embedding array<float>, x int, e double").repartition(7)
    single = [(i, None if v is None else [None if c is None else float(np.float32(c)) for c in v]) for i, v in rows]
    found = whitening.whiten(table)
    assert found.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    agree(found.collect(), brute(single))
    assert found.agg(F.max("identity_error")).first()[0] < 1e-9
    many = whitening.merged(spark.range(1000).repartition(200), lambda r: r[["id"]].sum().to_frame().T, fan=8)
    assert many == [499500]


def test_flat_and_huge(spark):
    rows = [(i, [float(i % 5), 0.0, 2.0]) for i in range(20)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = whitening.whiten(table).collect()
    agree(found, brute(rows))
    assert {r.component for r in found if r.whitened is None} == {2, 3}
    same = whitening.whiten(spark.createDataFrame(rows[:1] * 3, table.schema)).collect()
    assert len(same) == 9 and {(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in same} == {(1, 0, None, None, None)}
    wide = [(i, [1e12 * i, 1.0]) for i in range(4)]
    assert {r.deviation for r in whitening.whiten(spark.createDataFrame(wide, table.schema)).collect()} == {None}
    assert whitening.whiten(spark.createDataFrame([], table.schema)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, None)], table.schema)).count() == 0


def test_query(spark, data):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{data}/embeddings.parquet").collect()]
    found = QUERIES["op13_embedding_whitening"](spark, data).collect()
    agree(found, brute(rows))
    assert max(r.identity_error for r in found) < 1e-8
