"""SimHash near-duplicates with BK-trees.

Fingerprints of 64 bits are made from 3-word shingles. Two fingerprints link at 3 or
fewer differing bits. Of 3 + k bit blocks at least k are equal in linked fingerprints, so
each distinct fingerprint goes to the shards named by bits of every choice of k of its
blocks. How many bits, and which k, follows from the number of distinct fingerprints: a
shard should have about ``TREE_ROWS`` of them. Within a shard a BK-tree (children keyed
by their Hamming distance to the parent) is built and searched along edges within the
radius only. Trees have the fingerprints of all documents, so they aren't broadcast: a
shuffle brings shard and searchers together, and a shard above ``SHARD_ROWS`` is cut into
chunks that meet pairwise. A unit hands on one row for each fingerprint (its root within
the unit), never its pairs.

Results for special cases: null or blank texts have the fingerprint zero and link like
any other; an empty table gives an empty result; repeated rows each have a row in the result; a null ``doc_id`` takes part and
its component has the smallest doc_id that isn't null (null if there is none); further
columns are ignored by :func:`near_duplicates` and kept by :func:`representatives`.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftloom.llm.common import bucket_pairs, components, over_texts, packed, runs_of, saved, texts_of, union_roots, unpacked

RADIUS, SEED, SHINGLE_WORDS, SHARD_ROWS, TREE_ROWS = 3, 42, 3, 4096, 256


def fingerprint(text: str) -> int:
    """Majority bits of the XXH64 of every shingle, as an unsigned number."""
    words = text.encode("utf-8").lower().split()
    if not words:
        return 0
    if len(words) < SHINGLE_WORDS:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    digest = xxhash.xxh64_intdigest
    hashes = [digest(b"%b %b %b" % w, SEED) for w in zip(words, words[1:], words[2:], strict=False)]
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        part = np.array(hashes[at : at + 65536], "<u8")
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * counts > len(hashes), bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, fp``, the fingerprint as a signed 64-bit number."""

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            fps = np.array([fingerprint(t) for t in texts_of(batch)], "<u8").view("<i8")
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps)], names=["doc_id", "fp"])

        return work

    return over_texts(docs.select("doc_id", "text"), make, "doc_id long, fp long")


class BkTree:
    """BK-tree over distinct 64-bit numbers, its nodes and edges in flat arrays."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys.astype(np.uint64)
        children: list[dict[int, int]] = [{} for _ in keys]
        values = [int(k) for k in self.keys]
        for new in range(1, len(values)):
            at, key = 0, values[new]
            while True:
                d = (key ^ values[at]).bit_count()
                below = children[at].get(d)
                if below is None:
                    children[at][d] = new
                    break
                at = below
        self.first = np.concatenate([[0], np.cumsum([len(c) for c in children])]).astype(np.int64)
        self.child = np.array([x for c in children for x in c.values()], np.int64)
        self.edge = np.array([d for c in children for d in c], np.int64)

    def within(self, queries: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (query index, node) within the radius, level by level. Of a node at
        distance d only the edges from d - radius to d + radius are followed."""
        query, node = np.arange(len(queries)), np.zeros(len(queries), np.int64)
        while len(query):
            d = np.bitwise_count(queries[query] ^ self.keys[node]).astype(np.int64)
            near = d <= radius
            yield query[near], node[near]
            n = self.first[node + 1] - self.first[node]
            query, d = np.repeat(query, n), np.repeat(d, n)
            edges = np.repeat(self.first[node] - np.cumsum(n) + n, n) + np.arange(n.sum())
            follow = np.abs(self.edge[edges] - d) <= radius
            query, node = query[follow], self.child[edges[follow]]


def unit_roots(tree_keys: np.ndarray, queries: np.ndarray, radius: int = RADIUS, block: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Root of each of ``tree_keys + queries`` over the links of queries to tree keys."""
    tree = BkTree(tree_keys)
    nodes = np.concatenate([tree_keys, queries])
    parent = np.arange(len(nodes))
    for at in range(0, len(queries), block):
        found = [(q, n) for q, n in tree.within(queries[at : at + block], radius) if len(q)]
        if found:
            left = np.concatenate([q for q, _ in found]) + (len(tree_keys) + at)
            parent = union_roots(len(nodes), left, np.concatenate([n for _, n in found]), parent)
    return nodes, parent


def shard_blocks(n: int, tree_rows: int = 0) -> tuple[int, int, int]:
    """(blocks, equal ones, bits of each that name a shard) for n distinct fingerprints:
    the fewest blocks whose bits suffice for shards of about ``tree_rows``."""
    bits = max(0, round(math.log2(max(1, n) / (tree_rows or TREE_ROWS))))
    for equal in (1, 2, 3):
        blocks = RADIUS + equal
        if bits <= equal * (64 // blocks) or equal == 3:
            return blocks, equal, min(-(-bits // equal), 64 // blocks)


def shard_keys(n: int) -> list[Column]:
    """The shards of a fingerprint ``fp``, one for each choice of equal blocks."""
    blocks, equal, bits = shard_blocks(n)
    wide = 64 // blocks
    part = [F.shiftrightunsigned(F.col("fp"), k * wide).bitwiseAND(F.lit((1 << bits) - 1)) for k in range(blocks)]
    keys = []
    for k, choice in enumerate(combinations(range(blocks), equal)):
        named = F.lit(k).cast("long")
        for j in choice:
            named = named * (1 << bits) + part[j]
        keys.append(named)
    return keys


def links(distinct_fps: DataFrame) -> DataFrame:
    """Edges ``a, b`` (signed fingerprints) whose components are those of all links."""
    keys = shard_keys(distinct_fps.count())
    rows = distinct_fps.select("fp", F.explode(F.array(*keys)).alias("shard"))
    dealt = bucket_pairs(rows, "shard", F.col("fp"), SHARD_ROWS)
    unit = ["shard", "unit_i", "unit_j"]
    dealt = dealt.repartition(*unit).sortWithinPartitions(*unit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in runs_of(batches, unit):
            fps, side = rows["fp"].to_numpy().view(np.uint64), rows["side"].to_numpy()
            i, j = rows["unit_i"][0].as_py(), rows["unit_j"][0].as_py()
            if len(fps) == 2:
                if int(fps[0] ^ fps[1]).bit_count() > RADIUS:
                    continue
                a, b = fps[:1], fps[1:]
            elif i == j:
                nodes, parent = unit_roots(fps, fps)
                parent = np.minimum(parent[: len(fps)], parent[len(fps) :])
                a, b = fps, nodes[parent]
            else:
                nodes, parent = unit_roots(fps[side == i], fps[side == j]) if (side == i).any() and (side == j).any() else (fps, np.arange(len(fps)))
                a, b = nodes, nodes[parent]
            out = a != b
            if out.any():
                yield pa.RecordBatch.from_arrays([pa.array(a[out].view(np.int64)), pa.array(b[out].view(np.int64))], names=["a", "b"])

    return dealt.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for each row of ``docs``."""
    fps = saved(fingerprints(docs))
    first = saved(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    linked = components(links(first.select("fp")))
    member = first.join(linked.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    low = member.groupBy("root").agg(F.min("first_id").alias("component_id"))
    member = member.select("fp", "root").join(low, "root").select("fp", "component_id")
    return fps.join(member, "fp").select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
    )


def representatives(docs: DataFrame) -> DataFrame:
    """Rows of ``docs`` that stay when one document of each component stays: that with
    the component's smallest doc_id. Of repeated rows with that doc_id one stays (the
    smallest text, null first). Where no doc_id of a component is known, all its rows stay."""
    found = near_duplicates(docs).filter("doc_id <> component_id").select("doc_id").distinct()
    stay = docs.join(found, "doc_id", "left_anti")
    # a doc_id that occurs again has equal or other texts; only its smallest row stays
    again = stay.groupBy("doc_id").count().filter("count > 1 AND doc_id IS NOT NULL").select("doc_id")
    once = stay.join(again, "doc_id", "left_anti")
    several = stay.join(again, "doc_id", "left_semi")
    # by the text, then by all columns as JSON, as maps have no order
    one = several.select("doc_id", packed(docs), F.struct("text", F.to_json(packed(docs))).alias("_order"))
    one = one.groupBy("doc_id").agg(F.min_by("_row", "_order").alias("_row"))
    return once.unionByName(one.select(*unpacked(one, docs.columns)))
