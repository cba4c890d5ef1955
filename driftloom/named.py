"""The library's operators and fields by name."""

from __future__ import annotations

import importlib
import inspect

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftloom.operators import fields as FD
from driftloom.operators import graph as G
from driftloom.registry import fields, operators

MODULES = ("communities", "cycles", "delta", "events", "evidence", "experiments", "fields", "graph", "pixels", "prefix", "reports", "resamples", "selection", "series", "tiles")


def _register_operators() -> None:
    """Every public operator as ``module.function``, its defaults from its signature. The
    bare function name is an alias where no other module has it."""
    found = {}
    for name in MODULES:
        module = importlib.import_module(f"driftloom.operators.{name}")
        for f, run in inspect.getmembers(module, inspect.isfunction):
            if run.__module__ == module.__name__ and not f.startswith("_"):
                found[name, f] = run
    once = [f for _, f in found]
    for (name, f), run in found.items():
        defaults = {k: p.default for k, p in inspect.signature(run).parameters.items() if p.default is not p.empty}
        alias = (f,) if once.count(f) == 1 else ()
        operators.register(f"{name}.{f}", run, defaults, alias)


def _degree_field(column: str):
    def field(nodes: DataFrame, edges: DataFrame) -> DataFrame:
        return G.degrees(nodes, edges).select(F.col("id").alias("node"), F.col(column).cast("double").alias("value"))

    field.__doc__ = f"The nodes' {column}."
    return field


def _rank_field(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """PageRank of the nodes."""
    return G.pagerank(nodes, edges).select(F.col("id").alias("node"), F.col("rank").alias("value"))


def _register_fields() -> None:
    for column in ("degree", "in_degree", "out_degree", "in_strength", "out_strength"):
        fields.register(column, _degree_field(column))
    fields.register("pagerank", _rank_field, aliases=("rank",))


def blended(nodes: DataFrame, edges: DataFrame, weights: dict[str, float], resolve=None) -> DataFrame:
    """The blend of named fields, each brought into [0, 1] first. ``resolve`` may stand
    in for the registry: a function from a name to a field."""
    find = resolve or (lambda name: fields.get(name).run)
    parts = [FD.minmax(find(name)(nodes, edges), "value").select(F.lit(name).alias("name"), "node", F.col("norm").alias("value")) for name in weights]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return FD.blend(every, weights)


_register_operators()
_register_fields()
