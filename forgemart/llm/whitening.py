"""Whitening directions of embeddings: blockwise QR, bidiagonal form, dqds, twisted factorisations."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forgemart.llm.scratch import map_arrow, map_pandas, saved

#: Rows whose QR factor is taken at once, and factors that one task merges.
BLOCK, FAN = 4096, 64
EPS = np.finfo(float).eps
TINY = np.finfo(float).tiny

# ---- the factor of the centred rows -----------------------------------------------------


def quantised(vectors: DataFrame, scale: float, vec_id: str, embedding: str) -> DataFrame:
    """(vec_id, x) of the rows without null or non-finite entries whose vectors have the commonest
    number of entries (of equals the greatest): x = floor(scale * entry), as longs."""
    entries = F.col(embedding).cast("array<double>")
    sound = F.forall(entries, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = vectors.select(F.col(vec_id).alias("vec_id"), entries.alias("e")).where(sound & (F.size("e") > 0))
    common = rows.groupBy(F.size("e").alias("d")).agg(F.count("*").alias("n")).agg(F.max_by("d", F.struct("n", "d"))).scalar()
    return rows.where(F.size("e") == common).select(
        "vec_id", F.transform("e", lambda c: F.floor(F.lit(scale) * c).cast("long")).alias("x")
    )


def merged(df: DataFrame, merge: Callable[[pd.DataFrame], pd.DataFrame], fan: int = FAN) -> list:
    """The values of the one row that all rows merge into, about `fan` in a task: a tree of steps,
    whatever their number; none if there are no rows."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept = None
        for rows in batches:
            kept = merge(rows if kept is None else pd.concat((kept, rows)))
        if kept is not None:
            yield kept

    df = saved(df)
    n = df.count()
    while n > 1:
        n = -(-n // fan)
        df = saved(map_pandas(df.repartition(n), run, df.schema))
    return [list(r) for r in df.collect()][0] if n else []


def _flat(arrays: list[np.ndarray]) -> pa.Array:
    return pa.array([a.ravel().tolist() for a in arrays], pa.list_(pa.float64()))


def _blocks(batches: Iterator[pa.RecordBatch], width: int, name: str = "x") -> Iterator[np.ndarray]:
    """The vectors of a partition as matrices of at most BLOCK rows."""
    kept, size = [], 0
    for batch in batches:
        column = batch.column(name)
        kept.append(column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width))
        size += len(kept[-1])
        while size >= BLOCK:
            rows = np.concatenate(kept)
            yield rows[:BLOCK]
            kept, size = [rows[BLOCK:]], size - BLOCK
    if size:
        yield np.concatenate(kept)


def centred(rows: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x - S / n, from n x - S where that is a whole number below 2^62."""
    most = max(map(abs, sums)) + n * int(max(rows.max(initial=0), -int(rows.min(initial=0))))
    if most < 1 << 62:
        return (n * rows - np.array(sums, np.int64)) / n
    return rows - np.array([s / n for s in sums])


def deviations(rows: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sums of (n x - S)^2 over a row's entries, exact; none beyond a long."""
    most = max(map(abs, sums)) + n * int(max(rows.max(initial=0), -int(rows.min(initial=0))))
    if rows.shape[1] * most**2 < 1 << 62:
        apart = n * rows - np.array(sums, np.int64)
        return np.einsum("ij,ij->i", apart, apart).tolist()
    exact = ((n * rows.astype(object) - np.array(sums, object)) ** 2).sum(1)
    return [int(v) if v < 1 << 63 else None for v in exact]


def totals(fit: DataFrame, d: int) -> tuple[int, list[int]]:
    """How many vectors there are, and their sum: exact, added up by Spark from partial sums."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, np.zeros(d, np.int64), np.zeros(d, np.int64)
        for rows in _blocks(batches, d):
            n += len(rows)
            high += (rows >> 32).sum(0)
            low += (rows & 0xFFFFFFFF).sum(0)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(d)), pa.array(np.full(d, n)), pa.array(high), pa.array(low)], ["at", "n", "high", "low"]
        )

    parts = map_arrow(fit.select("x"), run, "at long, n long, high long, low long")
    wide = [F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("high", "low")]
    rows = parts.groupBy("at").agg(F.sum("n").alias("n"), *wide).orderBy("at").collect()
    return (rows[0].n, [(int(r.high) << 32) + int(r.low) for r in rows]) if rows else (0, [0] * d)


def factor(fit: DataFrame, n: int, sums: list[int]) -> np.ndarray:
    """R of the QR factorisation of all centred rows: of blocks, and of blocks' stacked factors."""
    d = len(sums)

    def stack(blocks: list[np.ndarray]) -> np.ndarray:
        return np.linalg.qr(np.concatenate(blocks), mode="r")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.zeros((0, d))
        for rows in _blocks(batches, d):
            r = stack([r, centred(rows, n, sums)])
        if len(r):
            yield pa.RecordBatch.from_arrays([_flat([r])], ["r"])

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"r": [stack([np.asarray(r, float).reshape(-1, d) for r in rows["r"]]).ravel().tolist()]})

    # A task holds about as much as a block of rows has.
    found = merged(map_arrow(fit.select("x"), run, "r array<double>"), merge, fan=max(2, min(FAN, BLOCK // d)))
    r = np.asarray(found[0], float).reshape(-1, d)
    return np.concatenate((r, np.zeros((d - len(r), d))))


# ---- singular values and directions of the factor ---------------------------------------


def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Householder reduction of a square matrix to upper bidiagonal form: its diagonal, what stands
    above it, and the reflections from the right (unit vectors of the last columns)."""
    a, n = np.array(r, float), len(r)
    right = []

    def reflect(x: np.ndarray) -> np.ndarray:
        v = x.copy()
        v[0] += np.copysign(np.linalg.norm(x), x[0])
        size = np.linalg.norm(v)
        return v / size if size > 0 else v

    for k in range(n):
        v = reflect(a[k:, k])
        a[k:, k:] -= 2 * np.outer(v, v @ a[k:, k:])
        if k < n - 1:
            w = reflect(a[k, k + 1 :])
            a[k:, k + 1 :] -= 2 * np.outer(a[k:, k + 1 :] @ w, w)
            right.append(w)
    return np.diag(a).copy(), np.diag(a, 1).copy(), right


def dqds(diagonal: np.ndarray, above: np.ndarray) -> np.ndarray:
    """The singular values of a bidiagonal matrix, falling, each to high relative accuracy.

    Differential quotient-difference steps with shifts below the least value that is left: they
    only multiply, divide and add positive numbers. A shift that turns a number negative was too
    great and is halved, at last to none, which never fails.
    """
    q, e = diagonal**2, above**2
    found = []
    stack = [(q, e, 0.0)]
    while stack:
        q, e, moved = stack.pop()
        n = len(q)
        if n == 0:
            continue
        if n == 1:
            found.append(q[0] + moved)
            continue
        small = np.flatnonzero(e <= EPS**2 * (q[:-1] + q[1:] + moved) + TINY)
        if len(small):  # parts without a link between them
            cut = int(small[-1]) + 1
            stack += [(q[:cut], e[: cut - 1], moved), (q[cut:], e[cut:], moved)]
            continue
        # The least eigenvalue of the last two rows: above that of all, and near it once the end has converged.
        a, b, c = q[-2] + (e[-2] if n > 2 else 0.0), q[-2] * e[-1], q[-1] + e[-1]
        gap = (a - c) / 2
        shift = c - b / (gap + np.copysign(np.hypot(gap, np.sqrt(b)), gap)) if b > 0 else min(a, c)
        shift = min(max(shift, 0.0), float(q.min())) * (1 - 1e-3)
        while True:
            step = _qd_step(q, e, shift)
            if step is not None:
                break
            shift = shift / 4 if shift > EPS * float(q.min()) else 0.0
        stack.append((*step, moved + shift))
    return np.sqrt(np.sort(np.array(found))[::-1])


def _qd_step(q: np.ndarray, e: np.ndarray, shift: float) -> tuple[np.ndarray, np.ndarray] | None:
    new_q, new_e = np.empty_like(q), np.empty_like(e)
    d = q[0] - shift
    for k in range(len(e)):
        if d < 0 or (d == 0 and shift > 0):
            return None
        new_q[k] = d + e[k]
        ratio = q[k + 1] / new_q[k] if new_q[k] > 0 else 0.0
        new_e[k] = e[k] * ratio
        d = d * ratio - shift
    if d < 0:
        return None
    new_q[-1] = d
    return new_q, new_e


def twisted_vector(diagonal: np.ndarray, above: np.ndarray, value: float, start: int = 0) -> np.ndarray:
    """The unit right singular vector of a bidiagonal matrix for a singular value.

    B'B - value^2 is factored from the top (stationary qd) and from the bottom (progressive qd);
    the two meet where the residual is least, and the vector follows from there in both directions
    by products alone. `start` takes the next best meeting place instead, for equal values.
    """
    n = len(diagonal)
    q, e, shift = diagonal**2, above**2, value**2
    # L D L' = B'B with l_k = above_k / diagonal_k: D = q, and l_k^2 q_k = e_k.
    least = TINY**0.5 * max(float(q.max()), shift, TINY**0.5)

    def safe(x: float) -> float:
        return x if abs(x) > least else least

    down, up = np.empty(n), np.empty(n)  # diagonals of the two factorisations
    s, s_all = -shift, np.empty(n)
    for k in range(n):
        s_all[k] = s
        down[k] = safe(q[k] + s)
        if k < n - 1:
            s = e[k] * (s / down[k]) - shift
    p, p_all = q[-1] - shift, np.empty(n)
    p_all[-1] = p
    up[-1] = safe(p)
    for k in range(n - 2, -1, -1):
        u = safe(e[k] + p)
        up[k] = u  # of the entry between k and k + 1
        p = q[k] * (p / u) - shift
        p_all[k] = p
    residual = np.abs(s_all + p_all + shift)
    r = int(np.argsort(residual, kind="stable")[min(start, n - 1)])
    z = np.zeros(n)
    z[r] = 1.0
    off = diagonal[:-1] * above  # entries beside the diagonal of B'B
    for k in range(r - 1, -1, -1):
        z[k] = -off[k] / down[k] * z[k + 1]
    for k in range(r, n - 1):
        z[k + 1] = -off[k] / up[k] * z[k]
    with np.errstate(all="ignore"):
        z /= np.abs(z).max()
    size = np.linalg.norm(z)
    if not np.isfinite(size) or size == 0:
        z = np.zeros(n)
        z[r] = size = 1.0
    return z / size


def directions(r: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The greatest singular values of a square matrix, falling, and its right singular vectors as
    rows. Vectors of equal or close values are any orthonormal basis of their space."""
    diagonal, above, right = bidiagonal(r)
    values = dqds(diagonal, above)
    scale = float(values[0]) if len(values) else 0.0
    vectors: list[np.ndarray] = []
    basis: list[np.ndarray] = []
    for i in range(min(count, len(values))):
        z = None
        for start in range(len(diagonal)):
            z = _in_block(diagonal, above, float(values[i]), start, scale)
            for _ in range(2):
                for y in basis:
                    z = z - (y @ z) * y
            size = np.linalg.norm(z)
            # Close values may give the same vector again: then from another place.
            if size > 0.1:
                break
        z = z / np.linalg.norm(z)
        basis.append(z)
        v = z.copy()
        for k in range(len(right) - 1, -1, -1):
            w = right[k]
            v[k + 1 :] -= 2 * w * (w @ v[k + 1 :])
        vectors.append(v * np.copysign(1.0, v[np.argmax(np.abs(v))]))
    return values, np.array(vectors).reshape(len(vectors), len(r))


def _in_block(diagonal: np.ndarray, above: np.ndarray, value: float, start: int, scale: float) -> np.ndarray:
    """The `start`-th choice of a singular vector, where links that vanish part the matrix."""
    n = len(diagonal)
    cuts = [0, *(np.flatnonzero(np.abs(above) <= EPS * scale) + 1).tolist(), n]
    blocks = []
    for a, b in zip(cuts, cuts[1:], strict=False):
        own = dqds(diagonal[a:b], above[a : b - 1])
        blocks.append((float(np.abs(own - value).min()), a, b))
    blocks.sort()
    sizes = 0
    for _, a, b in blocks:
        if start < sizes + b - a:
            z = np.zeros(n)
            z[a:b] = twisted_vector(diagonal[a:b], above[a : b - 1], value, start - sizes)
            return z
        sizes += b - a
    raise IndexError(start)


# ---- the operator -----------------------------------------------------------------------


def _identity_error(fit: DataFrame, n: int, sums: list[int], project: np.ndarray) -> float:
    """The largest absolute entry of the projections' covariance minus the identity. Each block is
    centred by its own mean before it is multiplied; blocks' moments are merged pairwise."""
    k, d = project.shape

    def moments(rows: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
        mean = rows.mean(0)
        return len(rows), mean, (rows - mean).T @ (rows - mean)

    def add(a: tuple, b: tuple) -> tuple[int, np.ndarray, np.ndarray]:
        count, apart = a[0] + b[0], b[1] - a[1]
        return count, a[1] + apart * b[0] / count, a[2] + b[2] + np.outer(apart, apart) * a[0] * b[0] / count

    def told(found: tuple) -> list:
        return [found[0], found[1].tolist(), found[2].ravel().tolist()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = None
        for rows in _blocks(batches, d):
            own = moments(np.einsum("ij,kj->ik", centred(rows, n, sums), project))
            found = own if found is None else add(found, own)
        if found is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in told(found)], ["n", "mean", "m"])

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        found = None
        for count, mean, m in rows.itertuples(index=False):
            own = (int(count), np.asarray(mean, float), np.asarray(m, float).reshape(k, k))
            found = own if found is None else add(found, own)
        return pd.DataFrame([told(found)], columns=["n", "mean", "m"])

    schema = "n long, mean array<double>, m array<double>"
    count, _, m = merged(map_arrow(fit.select("x"), run, schema), merge)
    return float(np.abs(np.reshape(m, (k, k)) / count - np.eye(k)).max())


def whiten(vectors: DataFrame, components: int = 4, scale: float = 256.0, *, vec_id="vec_id", embedding="embedding") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): a row for each sound
    vector and each of the first `components` components (as many as entries at most).

    Entries are quantised to x = floor(scale * entry). The fit list is each distinct x once: n of
    them, with sums S. Components are the unit eigenvectors of its covariance (divisor n) by falling
    eigenvalue e; whitened is (x - S / n) on the component over sqrt(e), explained e over the
    covariance's trace, deviation the sum of (n x - S)^2, exact (null beyond a long), and
    identity_error how far the covariance of whitened over the fit list is from the identity.

    Rows whose vector is null or empty, or holds null or non-finite entries, are left out; so are
    vectors that have not the commonest number of entries (of equals the greatest). Repeated rows
    repeat but count once in the fit list; ids may be null; other columns are not read; an empty
    table gives an empty result. A component without variance has explained 0 and whitened null;
    identity_error is of the other ones, null if there are none, and explained is null if the whole
    fit list is one vector.

    The rows' QR factors are merged in a tree of tasks; only the last one, of the size of the
    dimension squared, reaches the driver, where bidiagonal form, singular values and vectors follow.
    """
    rows = saved(quantised(vectors, scale, vec_id, embedding))
    first = rows.select(F.size("x")).first()
    schema = (
        f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, component int, n long, deviation long, "
        "whitened double, explained double, identity_error double"
    )
    if first is None:
        return vectors.sparkSession.createDataFrame([], schema)
    d = first[0]
    fit = saved(rows.select("x").distinct())
    n, sums = totals(fit, d)
    values, axes = directions(factor(fit, n, sums), components)
    squares = values**2
    trace = float(squares.sum())
    sound = values[: len(axes)] > EPS * max(n, d) ** 0.5 * values[0]
    project = axes * np.where(sound, np.sqrt(n) / np.where(sound, values[: len(axes)], 1.0), 0.0)[:, None]
    error = _identity_error(fit, n, sums, project[sound]) if sound.any() else None
    explained = [None if trace == 0 else float(v) / trace if ok else 0.0 for v, ok in zip(squares, sound, strict=False)]
    k = len(axes)

    def batch(data: pa.RecordBatch) -> pa.RecordBatch:
        x = data.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
        height = len(x)
        whitened = np.einsum("ij,kj->ik", centred(x, n, sums), project).ravel()
        ok = np.tile(sound, height)
        return pa.RecordBatch.from_arrays(
            [
                data.column("vec_id").take(pa.array(np.repeat(np.arange(height), k))),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), height)),
                pa.array(np.full(height * k, n)),
                pa.array([v for v in deviations(x, n, sums) for _ in range(k)], pa.int64()),
                pa.array(whitened, mask=~ok),
                pa.array(explained * height, pa.float64()),
                pa.array([error] * (height * k), pa.float64()),
            ],
            ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
        )

    return map_arrow(rows, lambda batches: map(batch, batches), schema)
