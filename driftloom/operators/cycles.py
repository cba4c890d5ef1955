"""The cycles of a directed graph as strongly connected components.

A node is on a cycle if it can reach itself. What lies between two cycles can't, which
taking away the graph's loose ends does not show. So:

1. Nodes without an edge in or out are trimmed, a layer at a time.
2. Chains (nodes with one edge in and one out) shrink to one edge by pointer doubling, in
   rounds that grow with the logarithm of their length. A node of a chain is on a cycle
   just if the chain's two ends are in one component, so it is found again at the end.
3. When both stop paying, every node takes the smallest node that reaches it as its colour
   (with jumps: the colour of a node's colour reaches it too). What can go back to the
   node that gave the colour, within the colour, is that node's component. Components
   leave the graph, and so do edges between colours, which are on no cycle.

All steps are joins and grouped minima on stored tables; the driver sees counts. Nodes are
numbered in the order of their ids, and colours go along edges stored once as arrays.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from driftloom.operators.graph import adjacency, indexed, passed, stored

#: Trimming and shrinking go on while they take away this share of the edges.
PAYS = 0.1


def _trimmed(edges: DataFrame) -> DataFrame:
    """Edges whose source has an edge in and whose target has one out."""
    ins, outs = stored(edges.select(F.col("dst").alias("src")).distinct()), stored(edges.select(F.col("src").alias("dst")).distinct())
    return edges.join(ins, "src", "left_semi").join(outs, "dst", "left_semi")


def _ends(chain: DataFrame, n: int) -> DataFrame:
    """``id, left, right, low, ring`` of each chain node (``id, before, after``): the nodes
    at both ends of its chain, or, of a ring that has no ends, its smallest node."""
    ids = chain.select("id")
    inside = lambda c: ids.select(F.col("id").alias(c), F.lit(False).alias(f"_{c}"))
    cur = chain.select("id", F.col("before").alias("left"), F.col("after").alias("right"), F.least("id", "after").alias("low"))
    cur = cur.join(inside("left"), "left", "left").join(inside("right"), "right", "left")
    cur = stored(cur.select("id", "left", "right", "low", F.coalesce("_left", F.lit(True)).alias("left_done"), F.coalesce("_right", F.lit(True)).alias("right_done")))
    reach = 1
    while reach <= n and cur.filter("NOT left_done OR NOT right_done").limit(1).count():
        far = lambda side: cur.select(F.col("id").alias(side), F.col(side).alias("_to"), F.col(f"{side}_done").alias("_done"), F.col("low").alias("_low"))  # noqa: B023, E731
        nxt = cur.join(far("right").withColumnsRenamed({"_to": "_r", "_done": "_rd", "_low": "_rl"}), "right", "left")
        nxt = nxt.join(far("left").withColumnsRenamed({"_to": "_l", "_done": "_ld"}).drop("_low"), "left", "left")
        cur = stored(
            nxt.select(
                "id",
                F.when(F.col("left_done"), F.col("left")).otherwise(F.col("_l")).alias("left"),
                F.when(F.col("right_done"), F.col("right")).otherwise(F.col("_r")).alias("right"),
                F.when(F.col("right_done"), F.col("low")).otherwise(F.least("low", "_rl")).alias("low"),
                (F.col("left_done") | F.coalesce("_ld", F.lit(True))).alias("left_done"),
                (F.col("right_done") | F.coalesce("_rd", F.lit(True))).alias("right_done"),
            )
        )
        reach *= 2
    return cur.select("id", "left", "right", "low", (~F.col("left_done") | ~F.col("right_done")).alias("ring"))


def _shrunk(edges: DataFrame, least: float) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame] | None:
    """Edges with each chain as one edge; the chains' nodes (``id, left, right``); nodes
    whose chain leads back to themselves; and nodes of rings with their component. None if
    fewer than ``least`` nodes are in chains."""
    outs = edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("_o"), F.min("dst").alias("after"))
    ins = edges.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("_i"), F.min("src").alias("before"))
    chain = stored(outs.join(ins, "id").filter("_o = 1 AND _i = 1").select("id", "before", "after"))
    n = chain.count()
    if n < least:
        return None
    ends = _ends(chain, n)
    inner = ends.filter("NOT ring")
    kept = edges.join(chain.select(F.col("id").alias("src")), "src", "left_anti").join(chain.select(F.col("id").alias("dst")), "dst", "left_anti")
    both = kept.unionByName(inner.filter("left <> right").select(F.col("left").alias("src"), F.col("right").alias("dst"))).distinct()
    loops = stored(inner.filter("left = right").select(F.col("left").alias("id")).distinct())
    return stored(both), inner.select("id", "left", "right"), loops, ends.filter("ring").select("id", F.col("low").alias("component"))


def _coloured(near: DataFrame, nodes: DataFrame) -> DataFrame:
    """``id, colour``: the smallest node that reaches each node. Only nodes with a new
    colour send it."""
    cur = front = stored(nodes.select("id", F.col("id").alias("colour")))
    while True:
        got = passed(near, front).groupBy("id").agg(F.min("colour").alias("_c"))
        nxt = cur.join(got, "id", "left").select("id", F.col("colour").alias("_old"), F.least("colour", F.coalesce("_c", "colour")).alias("_new"))
        jump = nxt.select(F.col("id").alias("_new"), F.col("_new").alias("_jump"))
        nxt = stored(nxt.join(jump, "_new").select("id", "_old", F.least("_new", "_jump").alias("colour")))
        cur, front = nxt.select("id", "colour"), stored(nxt.filter("colour <> _old").select("id", "colour"))
        if not front.limit(1).count():
            return cur


def _back(edges: DataFrame, back: DataFrame, colours: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes that reach the node of their colour (``id, component``), and the edges of one
    colour among the others. ``back``: the edges turned round, as arrays."""
    colours = stored(colours)
    seen = front = stored(colours.filter("id = colour").select("id", F.col("colour").alias("component")))
    while True:
        nxt = passed(back, front).select("id", "component").distinct().join(colours, "id").filter("component = colour").select("id", "component")
        front = stored(nxt.join(seen.select("id"), "id", "left_anti"))
        if not front.limit(1).count():
            break
        seen = stored(seen.unionByName(front))
    rest = stored(colours.join(seen.select("id"), "id", "left_anti"))
    a, b = rest.select(F.col("id").alias("src"), "colour"), rest.select(F.col("id").alias("dst"), F.col("colour").alias("_c"))
    return seen, stored(edges.join(a, "src").join(b, "dst").filter("colour = _c").select("src", "dst"))


def components(edges: DataFrame) -> DataFrame:
    """``id, component`` of every node on a cycle (a loop of one edge is one), the component
    named by its smallest node. ``edges``: ``src, dst``; those with a null end don't count."""
    given, ids = edges.select("src", "dst").filter("src IS NOT NULL AND dst IS NOT NULL"), None
    if not all(isinstance(f.dataType, IntegralType) for f in given.schema):
        given = stored(given)
        ids, given = indexed(given.select(F.explode(F.array("src", "dst")).alias("id")), given)
    every = stored(given.distinct())
    cur, found, levels = every.filter("src <> dst"), [], []
    size = cur.count()
    while size:
        cur = stored(_trimmed(cur))
        left = cur.count()
        if left and size - left < PAYS * size:
            shrunk = _shrunk(cur, max(1, PAYS * left))
            if shrunk is not None:
                cur, inner, loops, rings = shrunk
                levels.append((inner, loops))
                found.append(rings)
                left = cur.count()
        if left and size - left < PAYS * size:
            near, back = adjacency(cur), adjacency(cur.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
            # every node left has an edge out and one in
            part, cur = _back(cur, back, _coloured(near, near.select(F.col("src").alias("id")).unionByName(back.select(F.col("src").alias("id"))).distinct()))
            # a node alone is a component only if it is on a loop
            many = part.groupBy("component").agg(F.count("*").alias("n")).filter("n > 1").select("component")
            found.append(stored(part.join(many, "component").select("id", "component")))
            left = cur.count()
        size = left
    none = every.select(F.col("src").alias("id"), F.col("src").alias("component")).filter("false")
    of = stored(reduce(DataFrame.unionByName, found, none))
    loop = every.filter("src = dst").select(F.col("src").alias("id"))
    for inner, alone in [*reversed(levels), (None, loop)]:
        of = stored(of.unionByName(alone.join(of, "id", "left_anti").select("id", F.col("id").alias("component"))))
        if inner is not None:
            ends = inner.join(of.select(F.col("id").alias("left"), "component"), "left").join(of.select(F.col("id").alias("right"), F.col("component").alias("_c")), "right")
            of = stored(of.unionByName(ends.filter("component = _c").select("id", "component")))
    low = of.groupBy("component").agg(F.min("id").alias("_low"))
    out = of.join(low, "component").select("id", F.col("_low").alias("component"))
    if ids is None:
        return out
    named = out.join(ids.select(F.col("n").alias("component"), F.col("id").alias("_name")), "component").select(F.col("id").alias("n"), "_name")
    return named.join(ids, "n").select("id", F.col("_name").alias("component"))
