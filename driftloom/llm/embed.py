"""Embedding near-duplicates with spherical-cap filters.

Filter directions form a structured random product code: the coordinates are cut into
blocks, each block has a small random code of unit vectors, and every choice of one code
word per block is a direction. A vector belongs to all directions whose inner product
exceeds a cap (and at least to its LEAST best, by a lower cap); list decoding finds
them block by block and drops a partial choice as soon as the best rest can't lift it
over the cap. Vectors that share a direction are compared by exact cosine.

The directions are fitted for each label, to a sample of about ``SAMPLE`` of its vectors;
every vector is indexed. Filters work on vectors less the label's mean (or a part of it,
:func:`fitted`), as vectors with a common mean would all lie in the same few caps; cosines
are those of the vectors themselves. The cap is the one by which the sample's vectors have
as many directions as a pair of the least cosine needs to share some, and the number of
directions grows with the label's vectors until a vector is compared with about
``COMPARED`` others: the work grows in proportion to the vectors, but where more of them
really lie that close.

Equal vectors of a label are one class with a count. A filter with many classes is cut
into chunks that meet pairwise; a unit hands on a sum of links and a root for each class,
never its pairs. A pair that shares several directions counts in the smallest of them.

Results for special cases: vectors that are null, empty, zero or hold null or non-finite
components, rows with a null label and rows with a null vec_id link with nothing (a null
vec_id has a null component); repeated rows are vectors of their own and link with each
other; vectors of different length link with nothing; further columns are ignored; an
empty table gives an empty result; a component is named by its smallest vec_id, so ties
don't matter. Components of any finite size are scaled before they are squared.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftloom.llm.common import bucket_pairs, components, runs_of, saved, stored, union_roots

COSINE, SEED, UNIT_ROWS = 0.93, 11, 2048
#: Directions of a vector and vectors it is compared with, on average; code words of a
#: block, at least and at most (a third block comes beyond).
DIRECTIONS, COMPARED, CODE, CODE_MOST = 20, 1000, 128, 1024
#: Directions that every vector has at least (of DIRECTIONS), and by how much its cap is
#: lowered for it.
LEAST, STEP = 16, 0.02
#: Vectors of a label that its directions are fitted to, on average; those that the cap is
#: measured on; and how often at most the number of directions is doubled for the sample.
SAMPLE, MEASURED, DOUBLED = 1000, 200, 6
#: Parts of the mean that may be taken off, and the squared length that all but
#: SHORT of the vectors must keep: below it a linked pair's rests point too far apart.
SHIFTS, KEPT_LENGTH, SHORT = (1.0, 0.75, 0.5, 0.25, 0.0), 0.13, 0.02
#: Directions that a pair of the least cosine shares on average, and a vector has at most.
#: The cost of a copy of a vector, in comparisons.
COMMON, MOST, COPY = 8, 400, 100


def code_for(n: int, dim: int, directions: int = DIRECTIONS) -> tuple[int, int, float]:
    """Blocks, code words of a block, and cap for n vectors that may link. Of n vectors,
    n * directions / t are in one of t directions, so COMPARED asks for this t; the inner
    product of a vector with a random direction is nearly normal, with variance 1 / dim."""
    wanted = n * directions**2 / COMPARED
    blocks = 2 if wanted <= CODE_MOST**2 else 3
    code = max(CODE if blocks == 2 else 1, math.ceil(wanted ** (1 / blocks)))
    return blocks, code, NormalDist().inv_cdf(1 - directions / code**blocks) / math.sqrt(dim)


def directions_for(cosine: float, of: int) -> int | None:
    """Directions that a vector needs out of ``of``, so that two vectors of this cosine have
    COMMON in common: given that one of them is above the cap, its mean there decides how
    likely the other is. None where it takes more than MOST."""
    normal, d = NormalDist(), DIRECTIONS
    while d <= MOST:
        cap = normal.inv_cdf(1 - d / of)
        mean = normal.pdf(cap) * of / d
        if d * normal.cdf((cosine * mean - cap) / math.sqrt(1 - cosine**2)) >= COMMON:
            return d
        d = math.ceil(d * 1.1)
    return None


def units(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # large components would overflow
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def product_code(dim: int, blocks: int = 2, code: int = CODE, seed: int = SEED) -> list[tuple[slice, np.ndarray]]:
    """Coordinates and code words (rows of length 1/sqrt(blocks)) of each block."""
    rng, edges, out = np.random.default_rng(seed), np.linspace(0, dim, blocks + 1).astype(int), []
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        words = rng.standard_normal((code, b - a))
        out.append((slice(a, b), words / (np.linalg.norm(words, axis=1, keepdims=True) * np.sqrt(blocks))))
    return out


def above_cap(unit: np.ndarray, code: list[tuple[slice, np.ndarray]], cap: float) -> tuple[np.ndarray, np.ndarray]:
    """(vector, direction) for all directions above the cap."""
    scores = [unit[:, at] @ words.T for at, words in code]
    best = [s.max(axis=1) for s in scores]
    row, direction, total = np.arange(len(unit)), np.zeros(len(unit), np.int64), np.zeros(len(unit))
    for k, s in enumerate(scores):
        rest = sum(best[k + 1 :], np.zeros(len(unit)))
        choice = total[:, None] + s[row]
        i, j = np.nonzero(choice + rest[row][:, None] >= cap)
        row, direction, total = row[i], direction[i] * s.shape[1] + j, choice[i, j]
    return row, direction


def list_decode(unit: np.ndarray, code: list[tuple[slice, np.ndarray]], cap: float, least: int = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """(vector, direction) for all directions above the cap, sorted. For a vector with
    fewer than ``least`` of them the cap is lowered step by step until it has as many."""
    left, rows, directions = np.arange(len(unit)), [], []
    while len(left):
        row, direction = above_cap(unit[left], code, cap)
        enough = np.bincount(row, minlength=len(left)) >= least
        rows.append(left[row[enough[row]]])
        directions.append(direction[enough[row]])
        left, cap = left[~enough], cap - STEP
        if cap < -1:
            break
    row, direction = np.concatenate([*rows, []]).astype(np.int64), np.concatenate([*directions, []]).astype(np.int64)
    order = np.lexsort((direction, row))
    return row[order], direction[order]


def rests(x: np.ndarray, shift: np.ndarray) -> np.ndarray:
    """Unit vectors less ``shift``, as unit vectors; one that is the shift stays as it is."""
    left = x - shift
    length = np.linalg.norm(left, axis=1, keepdims=True)
    return np.where(length > 1e-9, left / np.maximum(length, 1e-9), x)


def measured_cap(x: np.ndarray, code: list[tuple[slice, np.ndarray]], cap: float, directions: int) -> float:
    """The cap near ``cap``, in small steps, by which vectors have ``directions`` or a few more."""
    enough = lambda c: len(above_cap(x[:MEASURED], code, c)[0]) >= directions * min(len(x), MEASURED)
    while enough(cap) and cap < 1:
        cap += STEP / 4
    while not enough(cap) and cap > -1:
        cap -= STEP / 4
    return cap


def fitted(x: np.ndarray, n: int) -> tuple[np.ndarray, int, int, float, int]:
    """What is taken off before filtering, blocks, code words, cap and directions of a
    vector, for n unit vectors of which ``x`` is a sample.

    Two unit vectors of cosine c whose rests have squared length q have rests of cosine
    1 - (1 - c) / q: the more of the mean is taken off, the more directions a pair needs,
    but the more evenly they are met. The part of the least cost is taken: the others that a
    vector is compared with, by the share of pairs measured in the sample, and COPY for each
    of its directions. Where vectors lie close, as in clusters, directions are doubled as
    long as that costs less."""
    dim, mean = x.shape[1], x.mean(axis=0)

    def tried(part: float, more: int) -> tuple | None:
        length = float(np.quantile(((x - part * mean) ** 2).sum(axis=1), SHORT))
        if length < KEPT_LENGTH:
            return None
        at, need = 0, DIRECTIONS
        while need > at:
            at = need
            blocks, words, cap = code_for(n << more, dim, at)
            need = directions_for(1 - (1 - COSINE) / length, words**blocks)
            if need is None:
                return None
        code, rest = product_code(dim, min(blocks, dim), words), rests(x, part * mean)
        cap = measured_cap(rest, code, cap, at)
        _, load = np.unique(above_cap(rest, code, cap)[1], return_counts=True)
        share = float((load * (load - 1)).sum()) / max(1, len(x) * (len(x) - 1))
        return share * n + COPY * at, part, blocks, words, cap, at

    best = min(found for part in SHIFTS if (found := tried(part, 0)))
    for more in range(1, DOUBLED + 1):
        if best[0] - COPY * best[-1] <= 2 * COMPARED or (found := tried(best[1], more)) is None or found >= best:
            break
        best = found
    _, part, blocks, words, cap, at = best
    return part * mean, blocks, words, cap, at


def _fits(classes: DataFrame) -> DataFrame:
    """``label, dim, shift, blocks, words, cap, directions``: a row for each label and
    length of vectors, from a sample by the hash of the class; a task holds one sample."""
    classes = classes.withColumn("dim", F.size("embedding"))
    sizes = stored(classes.groupBy("label", "dim").agg(F.count("*").alias("of")))
    chance = F.pmod(F.xxhash64("class"), F.lit(1 << 30)) / float(1 << 30)
    # the smallest class of a label is always in, so that no label is without a fit
    first = classes.groupBy("label", "dim").agg(F.min("class").alias("class")).join(sizes, ["label", "dim"])
    sample = classes.join(sizes, ["label", "dim"]).filter(chance * F.col("of") < SAMPLE).select("class", "label", "dim", "of", "embedding")
    sample = sample.unionByName(classes.join(first, ["class", "label", "dim"]).select("class", "label", "dim", "of", "embedding"))

    def fit(table: pa.Table) -> pa.Table:
        table = table.sort_by("class")
        x = units(np.array(table["embedding"].to_pylist(), np.float64))
        shift, blocks, words, cap, at = fitted(x, table["of"][0].as_py())
        return pa.table({"label": [table["label"][0].as_py()], "dim": pa.array([x.shape[1]], pa.int32()), "shift": [shift.tolist()], "blocks": pa.array([blocks], pa.int32()), "words": pa.array([words], pa.int32()), "cap": [cap], "directions": pa.array([at], pa.int32())})

    made = sample.groupBy("label", "dim").applyInArrow(fit, "label long, dim int, shift array<double>, blocks int, words int, cap double, directions int")
    return stored(made)


def _filters(classes: DataFrame) -> DataFrame:
    """``class, label, n, embedding, filters``: directions of each class, by its label's fit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes: dict[tuple[int, int, int], list] = {}
        for batch in batches:
            rows = batch.column("embedding").to_pylist()
            found: list[list[int]] = [[] for _ in rows]
            kinds: dict[tuple[int, int], list[int]] = {}
            for k, (label, v) in enumerate(zip(batch.column("label").to_pylist(), rows, strict=True)):
                kinds.setdefault((label, len(v)), []).append(k)
            for (_, dim), at in kinds.items():
                fit = {name: batch.column(name)[at[0]].as_py() for name in ("shift", "blocks", "words", "cap", "directions")}
                kind = dim, fit["blocks"], fit["words"]
                if kind not in codes:
                    if len(codes) >= 64:
                        codes.clear()
                    codes[kind] = product_code(dim, min(fit["blocks"], dim), fit["words"])
                x = rests(units(np.array([rows[k] for k in at], np.float64)), np.array(fit["shift"]))
                least = fit["directions"] * LEAST // DIRECTIONS
                parts = [list_decode(x[k : k + 256], codes[kind], fit["cap"], least) for k in range(0, len(x), 256)]
                row = np.concatenate([r + 256 * k for k, (r, _) in enumerate(parts)])
                direction = np.concatenate([d for _, d in parts])
                edges = np.searchsorted(row, np.arange(len(at) + 1))
                for k, a, b in zip(at, edges[:-1], edges[1:], strict=True):
                    found[k] = direction[a:b].tolist()
            kept = [batch.column(c) for c in ("class", "label", "n", "embedding")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(found, pa.list_(pa.int32()))], names=["class", "label", "n", "embedding", "filters"])

    kind = classes.schema["embedding"].dataType.simpleString()
    # hash joined or broadcast by the fits' size on disk; a hot label is split by AQE
    both = classes.withColumn("dim", F.size("embedding")).join(_fits(classes), ["label", "dim"])
    return both.select("class", "label", "n", "embedding", "shift", "blocks", "words", "cap", "directions").mapInArrow(run, f"class string, label long, n long, embedding {kind}, filters array<int>")


def _unit_links(rows: dict, first: int) -> pa.RecordBatch | None:
    """Links of one unit: for each class its linked vectors and a linked class."""
    length = rows["embedding"].value_lengths().to_numpy()
    side, same = rows["side"].to_numpy(), rows["unit_i"][0].as_py() == rows["unit_j"][0].as_py()
    x = rows["embedding"].flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(length), -1) if (length == length[0]).all() else None
    if x is None:  # vectors of several lengths: one length at a time
        parts = []
        table = pa.table({k: v for k, v in rows.items()})
        for n in np.unique(length):
            part = table.filter(pa.array(length == n)).combine_chunks()
            if part.num_rows > 1:
                got = _unit_links({k: part.column(k).combine_chunks() for k in part.column_names}, first)
                parts += [got] if got else []
        return pa.Table.from_batches(parts).combine_chunks().to_batches()[0] if parts else None
    x = units(x)
    lists = rows["filters"]
    width = lists.value_lengths().to_numpy()
    member = np.full((len(x), width.max()), -1, np.int64)
    member[np.arange(width.max()) < width[:, None]] = lists.flatten().to_numpy()
    count, names = rows["n"].to_numpy(), rows["class"].to_pylist()
    left = np.arange(len(x)) if same else np.flatnonzero(side == rows["unit_i"][0].as_py())
    right = left if same else np.flatnonzero(side == rows["unit_j"][0].as_py())
    total, parent, hit = np.zeros(len(x), np.int64), np.arange(len(x)), np.zeros(len(x), bool)
    for at in range(0, len(left), 256):
        rows_at = left[at : at + 256]
        i, j = np.nonzero(x[rows_at] @ x[right].T >= COSINE)
        i, j = rows_at[i], right[j]
        ok = i < j if same else np.ones(len(i), bool)
        i, j = i[ok], j[ok]
        step = max(64, 8_000_000 // member.shape[1] ** 2)
        for a in range(0, len(i), step):  # keep a pair where this is its first common direction
            p, q = i[a : a + step], j[a : a + step]
            lower_p = np.where((member[p] >= 0) & (member[p] < first), member[p], -1)
            lower_q = np.where((member[q] >= 0) & (member[q] < first), member[q], -2)
            mine = ~(lower_p[:, :, None] == lower_q[:, None, :]).any(axis=(1, 2))
            p, q = p[mine], q[mine]
            np.add.at(total, p, count[q])
            np.add.at(total, q, count[p])
            hit[p] = hit[q] = True
            parent = union_roots(len(x), p, q, parent)
    at = np.flatnonzero(hit)
    if not len(at):
        return None
    return pa.RecordBatch.from_arrays([pa.array([names[k] for k in at]), pa.array([names[k] for k in parent[at]]), pa.array(total[at])], names=["a", "b", "links"])


def near_duplicates(vectors: DataFrame) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for each row of ``vectors``."""
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    usable = F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite & F.exists("embedding", lambda v: v != 0), F.lit(False))
    kind = "array<float>" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "array<double>"
    as_text = F.concat_ws(",", F.col("label").cast("string"), F.transform("embedding", lambda v: v.cast("string")))
    rows = vectors.select("vec_id", F.col("label").cast("long").alias("label"), F.col("embedding").cast(kind).alias("embedding"), usable.alias("usable"), as_text.alias("as_text"))
    rows = rows.withColumn("class", F.when(F.col("usable"), F.md5("as_text"))).drop("as_text")
    classes = rows.filter("usable").groupBy("class").agg(F.first("label").alias("label"), F.count("*").alias("n"), F.min("vec_id").alias("low"), F.first("embedding").alias("embedding"))
    # a node's name begins with its smallest vec_id, so that a component's root tells it
    half = F.lit(str(1 << 63)).cast("decimal(20,0)")
    node = F.concat(F.lpad((F.col("low").cast("decimal(20,0)") + half).cast("string"), 20, "0"), "class")
    classes = saved(classes.withColumn("node", node))
    filtered = saved(_filters(classes.select(F.col("node").alias("class"), "label", "n", "embedding")))
    dealt = filtered.select("*", F.explode("filters").alias("direction"))
    dealt = dealt.withColumn("key", F.concat_ws("/", "label", "direction"))
    dealt = bucket_pairs(dealt, "key", F.col("class"), UNIT_ROWS)
    unit = ["label", "direction", "unit_i", "unit_j"]
    dealt = dealt.repartition(*unit).sortWithinPartitions(*unit).select("class", "n", "embedding", "filters", "side", *unit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in runs_of(batches, unit):
            out = _unit_links(part, part["direction"][0].as_py())
            if out is not None:
                yield out

    links = saved(dealt.mapInArrow(run, "a string, b string, links long"))
    counts = links.groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    member = classes.select("class", "node", "n").join(counts, "node", "left").join(components(links), "node", "left")
    root = F.substring(F.coalesce("root", "node"), 1, 20)
    low = (root.cast("decimal(20,0)") - half).cast("long")
    member = member.select("class", low.alias("component_id"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"))
    one = F.coalesce(F.col("class"), F.concat(F.lit("-"), F.xxhash64("vec_id").cast("string")))
    out = rows.select("vec_id", one.alias("class")).join(member, "class", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
