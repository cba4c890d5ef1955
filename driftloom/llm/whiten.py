"""Embedding whitening with eigenvectors refined from single to double precision.

1. Components become whole numbers; their number and sums by dimension are exact, and the
   covariance is the sum of what tasks add up over centred rows.
2. Eigenvectors of the covariance are found in float32 and then corrected by the iterations
   of Ogita and Aishima, which are matrix products only: in double precision until nothing
   moves, then in extended precision. Corrections between eigenvectors of (nearly) equal
   eigenvalues can't be told from the products' rounding; such clusters are solved anew in
   the space they span, shifted by their mean eigenvalue, and corrected again.
3. Rows are projected on the leading components and divided by their deviation; the
   covariance of the result is measured over all rows.

The covariance has a number for each pair of dimensions, which the driver holds (8 MB for
1,024 dimensions); tasks hand on one such matrix each, whose rows are added up on Spark.

Results for special cases: vectors that are null, empty or hold null or non-finite entries
are dropped; vectors of another length form a fit list of their own (a covariance each, so
lengths should be few); repeated rows and a null ``vec_id`` have their rows; components
without variance (equal vectors, a single vector, fewer vectors than dimensions) have a
null ``whitened`` and don't count for ``identity_error``, which is 0 if none counts;
``explained`` is 0 where there is no variance at all; entries of any finite size are kept
up to 2^62, a ``deviation`` that no long can hold is null; among equal eigenvalues any
orthogonal vectors are components; further columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftloom.llm.common import stored

SCALE, SHIFT, COMPONENTS = 1024, 100_000, 8
#: Rounds of correction at most (they converge quadratically), rows worked on at a time,
#: and the largest entry.
ROUNDS, PART, MOST = 12, 4096, 1 << 62


# ---------------------------------------------------------------- eigenvectors


def corrected(a: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """One iteration: better vectors, eigenvalues, which pairs are clustered, and how far
    the vectors moved. All products are of the type of ``x``."""
    r = np.eye(len(a), dtype=x.dtype) - x.T @ x
    s = x.T @ (a @ x)
    s = (s + s.T) / 2  # else rounding, divided by small gaps, would leave them oblique
    e = np.diag(s) / (1 - np.diag(r))
    off = s - np.diag(e)
    unsure = 2 * (np.linalg.norm(off.astype(np.float64)) + float(np.abs(e).max(initial=0)) * np.linalg.norm(r.astype(np.float64)))
    gap = e[None, :] - e[:, None]
    near = np.abs(gap) <= unsure
    move = np.where(near, r / 2, (s + e[None, :] * r) / np.where(near, 1, gap))
    return x + x @ move, e, near & ~np.eye(len(a), dtype=bool), float(np.abs(move).max(initial=0))


def clusters(near: np.ndarray) -> list[np.ndarray]:
    """Groups of indices that ``near`` links, of two or more."""
    left, out = set(np.flatnonzero(near.any(axis=1)).tolist()), []
    while left:
        todo, group = [left.pop()], set()
        while todo:
            k = todo.pop()
            group.add(k)
            new = left.intersection(np.flatnonzero(near[k]).tolist())
            left -= new
            todo += new
        out.append(np.array(sorted(group)))
    return out


def solved(a: np.ndarray, x: np.ndarray, e: np.ndarray, group: np.ndarray) -> np.ndarray:
    """The vectors of a cluster, turned within the space they span. With their mean
    eigenvalue taken off, what tells them apart isn't lost beside it."""
    v = x[:, group]
    mean = e[group].mean()
    small = v.T @ (a @ v - mean * v)
    small = ((small + small.T) / 2).astype(np.float64)
    return v @ np.linalg.eigh(small)[1].astype(x.dtype)


def refined(a: np.ndarray, x: np.ndarray, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """Iterations in one precision until the vectors rest."""
    a, x, before, tiny = a.astype(kind), x.astype(kind), np.inf, float(np.finfo(kind).eps)
    for _ in range(ROUNDS):
        x, e, near, moved = corrected(a, x)
        groups = clusters(near)
        for group in groups:
            x[:, group] = solved(a, x, e, group)
        if moved <= tiny * 8 or (moved <= tiny * 1e4 and moved >= before / 2):
            break
        before = moved
    order = np.argsort(-e, kind="stable")
    return x[:, order], e[order]


def eigenvectors(covariance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (falling) and unit eigenvectors (columns) to double precision. A vector's
    entry of largest size is positive."""
    size = float(np.abs(covariance).max(initial=0))
    if not size:
        return np.zeros(len(covariance)), np.eye(len(covariance))
    a = covariance / size
    _, x = np.linalg.eigh(a.astype(np.float32))
    x, e = refined(a, x[:, ::-1], np.float64)
    x, e = refined(a, x, np.longdouble)
    for _ in range(2):  # what a last sub-solve has left oblique
        x = x + x @ ((np.eye(len(a), dtype=x.dtype) - x.T @ x) / 2)
    e = (x * (a.astype(x.dtype) @ x)).sum(axis=0)
    order = np.argsort(-e, kind="stable")
    x, e = x[:, order], e[order]
    sign = np.sign(x[np.abs(x).argmax(axis=0), np.arange(len(x))])
    return np.maximum(e, 0).astype(np.float64) * size, (x * sign).astype(np.float64)


# ---------------------------------------------------------------- sums over all rows


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Lists of one length as rows."""
    flat = column.flatten().to_numpy(zero_copy_only=False) if isinstance(column, pa.ListArray) else column.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def by_length(batch: pa.RecordBatch, column: str = "v") -> Iterator[tuple[int, pa.RecordBatch]]:
    """Parts of a batch whose vectors have one length, PART rows at a time."""
    length = batch.column(column).value_lengths().to_numpy()
    for n in np.unique(length):
        part = batch.filter(pa.array(length == n))
        for at in range(0, part.num_rows, PART):
            yield int(n), part.slice(at, PART)


def whole(v: np.ndarray) -> np.ndarray:
    """Entries as whole numbers."""
    x = np.floor(SCALE * v.astype(np.float64))
    return np.clip(x, -float(MOST), float(MOST)).astype(np.int64) + SHIFT


def exact_sum(x: np.ndarray) -> list[int]:
    """Sums of columns, as Python's numbers where a long might not hold them."""
    if not len(x) or int(np.abs(x).max()) < MOST // len(x):
        return x.sum(axis=0).tolist()
    return [sum(c) for c in x.T.tolist()]


def sums(vectors: DataFrame, exact: bool) -> dict[int, tuple[int, list]]:
    """By length of the vectors ``v``: how many there are, and the sums of their entries
    (whole numbers if ``exact``). A task hands on a row for each length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: dict[int, int] = {}
        total: dict[int, list] = {}
        for batch in batches:
            for d, part in by_length(batch):
                x = matrix(part.column("v"))
                one = exact_sum(whole(x)) if exact else x.sum(axis=0).tolist()
                total[d] = [a + b for a, b in zip(total[d], one, strict=True)] if d in total else one
                n[d] = n.get(d, 0) + len(x)
        said = pa.array([[str(x) if exact else repr(x) for x in total[d]] for d in total], pa.list_(pa.string()))
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([n[d] for d in total], pa.int64()), said], names=["d", "n", "total"])

    parts = vectors.select("v").mapInArrow(run, "d int, n long, total array<string>")
    sort = "decimal(38,0)" if exact else "double"
    rows = parts.select("d", "n", F.posexplode("total").alias("k", "x")).groupBy("d", "k").agg(F.sum("n").alias("n"), F.sum(F.col("x").cast(sort)).alias("x")).collect()
    out: dict[int, tuple[int, list]] = {}
    for r in sorted(rows, key=lambda r: (r["d"], r["k"])):
        out.setdefault(r["d"], (r["n"], []))[1].append(int(r["x"]) if exact else r["x"])
    return out


def products(vectors: DataFrame, means: dict[int, np.ndarray], exact: bool) -> dict[int, np.ndarray]:
    """By length: the sum over rows of the products of centred entries. A task hands on its
    matrix by rows; rows of one place are added up in order of the tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for d, part in by_length(batch):
                x = matrix(part.column("v"))
                y = (whole(x) if exact else x).astype(np.float64) - means[d]
                total[d] = total.get(d, 0) + y.T @ y
        task = TaskContext.get().partitionId()
        for d, m in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([d] * d, pa.int32()), pa.array(range(d), pa.int32()), pa.array([task] * d, pa.int32()), pa.array(list(m), pa.list_(pa.float64()))], names=["d", "k", "task", "row"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, total = None, None
        for batch in batches:
            for d, k, row in zip(batch.column("d").to_pylist(), batch.column("k").to_pylist(), batch.column("row"), strict=True):
                if place != (d, k):
                    if place:
                        yield one(place, total)
                    place, total = (d, k), np.zeros(d)
                total += row.values.to_numpy()
        if place:
            yield one(place, total)

    def one(place: tuple[int, int], total: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([place[0]], pa.int32()), pa.array([place[1]], pa.int32()), pa.array([total], pa.list_(pa.float64()))], names=["d", "k", "row"])

    parts = vectors.select("v").mapInArrow(run, "d int, k int, task int, row array<double>")
    rows = parts.repartition("d", "k").sortWithinPartitions("d", "k", "task").mapInArrow(added, "d int, k int, row array<double>").collect()
    out: dict[int, np.ndarray] = {}
    for r in rows:
        out.setdefault(r["d"], np.zeros((r["d"], r["d"])))[r["k"]] = r["row"]
    return {d: (m + m.T) / 2 for d, m in out.items()}


# ---------------------------------------------------------------- whitening


@dataclass
class Fit:
    """What is known of the vectors of one length."""

    n: int
    sums: list[int]
    mean: np.ndarray
    axes: np.ndarray  # components as columns, divided by their deviation
    alive: np.ndarray  # whether a component has variance
    explained: np.ndarray


def usable(embedding: Column) -> Column:
    """Not null, not empty, and every entry finite."""
    return F.coalesce((F.size(embedding) > 0) & F.forall(embedding, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))), F.lit(False))


def fit(vectors: DataFrame, components: int = COMPONENTS) -> dict[int, Fit]:
    """The fits by length of the usable vectors ``v``: two passes over them."""
    found = sums(vectors, True)
    # whole part and rest apart, so that a mean of large numbers keeps its digits
    means = {d: np.array([s // n + (s % n) / n for s in total]) for d, (n, total) in found.items()}
    out = {}
    for d, m in products(vectors, means, True).items():
        n, total = found[d]
        e, x = eigenvectors(m / n)
        k, trace = min(components, d), float(np.trace(m / n))
        alive = e[:k] > max(e[0], 0) * d * np.finfo(np.float64).eps * 8
        axes = x[:, :k] / np.sqrt(np.where(alive, e[:k], 1))
        out[d] = Fit(n, total, means[d], axes, alive, e[:k] / trace if trace else np.zeros(k))
    return out


def deviation(x: np.ndarray, n: int, total: list[int]) -> list[int | None]:
    """Sum over dimensions of (n x - S)^2, exact; None where a long can't hold it."""
    bound = n * int(np.abs(x).max(initial=0)) + max(map(abs, total), default=0)
    if bound * bound * len(total) < MOST:
        y = n * x - np.array(total, np.int64)
        return (y * y).sum(axis=1).tolist()
    out = []
    for row in x.tolist():
        one = sum((n * a - s) ** 2 for a, s in zip(row, total, strict=True))
        out.append(one if one < 1 << 63 else None)
    return out


def projected(vectors: DataFrame, fits: dict[int, Fit]) -> DataFrame:
    """``vec_id, d, n, deviation, v``: the whitened leading components of each vector (0
    where there is no variance)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, part in by_length(batch):
                f, x = fits[d], whole(matrix(part.column("v")))
                white = (x.astype(np.float64) - f.mean) @ f.axes * f.alive
                yield pa.RecordBatch.from_arrays(
                    [part.column("vec_id"), pa.array([d] * len(x), pa.int32()), pa.array([f.n] * len(x), pa.int64()), pa.array(deviation(x, f.n, f.sums), pa.int64()), pa.array(list(white), pa.list_(pa.float64()))],
                    names=["vec_id", "d", "n", "deviation", "v"],
                )

    kind = vectors.schema["vec_id"].dataType.simpleString()
    return vectors.select("vec_id", "v").mapInArrow(run, f"vec_id {kind}, d int, n long, deviation long, v array<double>")


def identity_error(rows: DataFrame, fits: dict[int, Fit]) -> dict[int, float]:
    """By length: the largest entry of the whitened rows' covariance minus the identity."""
    out = {}
    for d, f in fits.items():
        part = rows.filter(F.col("d") == d)
        k = len(f.alive)
        n, total = sums(part, False)[k]
        spread = products(part, {k: np.array(total) / n}, False)[k] / n
        out[d] = float(np.abs((spread - np.eye(k))[np.ix_(f.alive, f.alive)]).max(initial=0))
    return out


def whiten(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error``: a row for
    each usable vector and leading component."""
    vectors = embeddings.filter(usable(F.col("embedding"))).select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    fits = fit(vectors, components)
    rows = stored(projected(vectors, fits))
    wrong = identity_error(rows, fits)
    one = F.posexplode(F.col("v")).alias("k", "whitened")
    out = rows.select("vec_id", "d", "n", "deviation", one)
    facts = [(d, k, bool(f.alive[k]), float(f.explained[k]), wrong[d]) for d, f in fits.items() for k in range(len(f.alive))]
    # a row for each length and component
    said = embeddings.sparkSession.createDataFrame(facts, "d int, k int, alive boolean, explained double, identity_error double")
    out = out.join(F.broadcast(said), ["d", "k"])
    return out.select("vec_id", (F.col("k") + 1).cast("int").alias("component"), "n", "deviation", F.when(F.col("alive"), F.col("whitened")).alias("whitened"), "explained", "identity_error")
