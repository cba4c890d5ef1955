"""Communities by label propagation in the sequential order (G5), and bridges.

Label propagation that changes all nodes at once swings on two-sided graphs. In sequence,
each node sees the labels that nodes before it have just taken. Neighbours may not change
together, others may: so nodes get a colour, one more than the highest colour of their
neighbours that come before them in the order (Jones and Plassmann), and one colour changes
at a time. That gives just what a loop over the nodes in order gives.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftloom.operators.graph import adjacency, indexed, numbered, passed, stored
from driftloom.operators.selection import at_ranks

#: Up to so many colours have arrays of their own.
FEW = 8


def coloured(nodes: DataFrame, links: DataFrame, order: Column | None = None) -> DataFrame:
    """``id, colour`` from 0. ``links``: ``src, dst`` in both directions. The order is by id;
    one by a hash of it needs few colours on any graph, that by id as many as the longest
    path along which ids rise."""
    of = lambda c: F.struct((order if order is not None else F.lit(0)).alias("h"), F.col("id").alias("i")).alias(c)
    ids = nodes.select("id").distinct()
    place = ids.select("id", of("o"))
    pairs = links.filter("src <> dst").select("src", "dst").distinct()
    pairs = pairs.join(place.select(F.col("id").alias("src"), F.col("o").alias("_a")), "src").join(place.select(F.col("id").alias("dst"), F.col("o").alias("_b")), "dst")
    waits = stored(pairs.filter("_a > _b").select(F.col("src").alias("id"), F.col("dst").alias("first")))
    left, done = stored(ids), []
    for k in count():
        free = stored(left.join(waits.select("id"), "id", "left_anti"))
        done.append(free.withColumn("colour", F.lit(k)))
        if not waits.limit(1).count():
            break
        left = stored(left.join(free, "id", "left_anti"))
        waits = stored(waits.join(free.select(F.col("id").alias("first")), "first", "left_anti"))
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return stored(out)


def label_communities(nodes: DataFrame, edges: DataFrame, rounds: int = 20, order: Column | None = None) -> DataFrame:
    """``id, community``: in each round every node in turn takes the label most common
    among its neighbours (each edge counts, in both directions), the smallest on a tie;
    communities are numbered from 0 in order of their labels. Nodes without edges keep their
    own label."""
    own = edges.select("src", "dst")
    if order is None:
        ids, own = indexed(nodes, own)
        cur = ids.select(F.col("n").alias("id"))
    else:  # the order needs the ids themselves
        ids, cur = stored(nodes.select("id", F.col("id").alias("n")).distinct()), nodes.select("id").distinct()
    own = stored(own)
    both = own.unionByName(own.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    colours = coloured(cur, both, order)
    # a neighbour that is no node has no label to give
    to = both.join(colours.select(F.col("id").alias("dst"), "colour"), "dst").select("src", "dst", "colour")
    most = (colours.agg(F.max("colour")).first()[0] or 0) + 1
    near = [adjacency(to.filter(F.col("colour") == k).drop("colour")) for k in range(most)] if most <= FEW else None
    links = near or stored(to)
    cur = stored(colours.select("id", "colour", F.col("id").alias("label")))
    for _ in range(rounds):
        changed = 0
        for k in range(most):
            labels = cur.select("id", "label")
            sent = passed(near[k], labels) if near else links.filter(F.col("colour") == k).join(labels.withColumnRenamed("id", "src"), "src").select(F.col("dst").alias("id"), "label")
            votes = sent.groupBy("id", "label").agg(F.count("*").alias("v"))
            best = votes.groupBy("id").agg(F.min(F.struct((-F.col("v")).alias("v"), "label")).alias("_b"))
            nxt = cur.join(best, "id", "left").select("id", "colour", F.coalesce("_b.label", "label").alias("label"), (F.col("_b.label") != F.col("label")).alias("_new"))
            nxt = stored(nxt)
            changed += nxt.filter("_new").limit(1).count()
            cur = nxt.drop("_new")
        if not changed:
            break
    names = stored(numbered(cur.select("label").distinct(), ["label"], "community"))
    return cur.withColumnRenamed("id", "n").join(ids, "n").join(names, "label").select("id", "community")


def bridges(communities: DataFrame, edges: DataFrame, between: DataFrame, beta: DataFrame, pct: float = 0.9, least: float = 0.6) -> DataFrame:
    """Nodes with neighbours in two communities or more, a betweenness at or above the
    percentile of such nodes (the rank ``round(pct (n - 1))``, selected without a sort) and a beta (``id,
    beta``; none is 0) of at least ``least``."""
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    many = both.join(communities.select(F.col("id").alias("dst"), "community"), "dst").groupBy(F.col("src").alias("id")).agg(F.count_distinct("community").alias("n")).filter("n >= 2")
    cand = stored(many.join(between, "id"))
    k = cand.count()
    if not k:
        return cand.select("id", "betweenness")
    ranks = cand.sparkSession.createDataFrame([(round(pct * (k - 1)),)], "rank long")
    cut = at_ranks(cand, "betweenness", [], ranks).first()["found"]
    return cand.filter(F.col("betweenness") >= cut).join(beta, "id", "left").filter(F.coalesce("beta", F.lit(0.0)) >= least).select("id", "betweenness")
