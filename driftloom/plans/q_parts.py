"""Iterative graph queries over all suppliers and parts (no SQL twin: tests compare the
operators with brute force). Those of q_more and q_tiles on nations stay as SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftloom.operators import evidence as E
from driftloom.operators import experiments as EX
from driftloom.operators import graph as G
from driftloom.plans.q_more import number, r6
from driftloom.plans.roles import graph, t, trade


def sources(s, d):
    return G.sampled(graph(s, d)[0])


def lenses(s, d):
    return sources(s, d).select(F.col("source").alias("lens"), "id")


def steps(df, key):
    return df.select(key, "id", F.col("dist").cast("int").alias("dist"))


def signs(s, d):
    x = t(s, d, "lineitem").groupBy("l_partkey").agg(F.count_if(F.col("l_quantity") > 25).alias("wins"), F.count_if(F.col("l_quantity") < 25).alias("losses"))
    return r6(EX.sign_test(x.select("wins", "losses")), "p_one_sided", "p_two_sided")


QUERIES = {
    "g01_pagerank_parts": (lambda s, d: r6(G.pagerank(*trade(s, d)), "rank"), None),
    "g02_bfs_parts": (lambda s, d: steps(G.bfs(sources(s, d), trade(s, d)[1]), "source"), None),
    "g03_harmonic_parts": (lambda s, d: r6(G.harmonic_in(sources(s, d), trade(s, d)[1], graph(s, d)[0]), "harmonic"), None),
    "g07_g15_scope_window_parts": (lambda s, d: steps(G.window(graph(s, d)[0], graph(s, d)[1].withColumn("kind", F.lit("link")), lenses(s, d), 1, ["module", "file"], ["link"], 6), "lens"), None),
    "g09_components_parts": (lambda s, d: G.connected(*graph(s, d)), None),
    "g10_clustering_parts": (lambda s, d: r6(G.clustering(*graph(s, d)), "clustering"), None),
    "g11_pan_parts": (lambda s, d: G.panned(sources(s, d).select("id"), graph(s, d)[1], graph(s, d)[0].select("id", (number() * 7 % 25).cast("double").alias("value")), 1), None),
    "g13_preset_window_parts": (lambda s, d: steps(E.preset_window("module-focus", graph(s, d)[0], graph(s, d)[1].withColumn("kind", F.lit("call")), lenses(s, d)), "lens"), None),
    "a35_sign_test_parts": (signs, None),
}
