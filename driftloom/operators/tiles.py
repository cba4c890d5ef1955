"""Tiles, cells and regions: text tiles, profiles, impact, region statistics and choice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from driftloom.operators import graph, pixels

# Weight of each keyword in a line.
KEYWORDS = {
    "def": 5.0, "class": 7.0, "return": 2.0, "yield": 3.0, "if": 3.0, "elif": 2.0, "else": 1.0, "for": 3.0, "while": 3.0, "try": 4.0,
    "except": 4.0, "with": 2.0, "match": 4.0, "case": 2.0, "import": 2.0, "from": 1.5, "as": 0.5, "lambda": 3.0, "await": 2.5, "async": 2.5,
}


#: All white space, which a line is stripped of; its indent counts blanks only.
WHITE = "".join(c for c in map(chr, range(0x3001)) if c.isspace())


def occurrences(text: Column, part: str | Column) -> Column:
    part = F.lit(part) if isinstance(part, str) else part
    return (F.length(text) - F.length(F.replace(text, part, F.lit("")))) / F.length(part)


def line_score(line: Column, low: Column) -> Column:
    """Weighted keywords of a line, given also trimmed and lower-cased, and its indent."""
    words = sum((w * occurrences(low, k) for k, w in KEYWORDS.items()), F.lit(0.0))
    lead = F.length(line) - F.length(F.ltrim(line))
    return words + 0.2 * (occurrences(low, "(") + occurrences(low, ".") + (lead >= 8).cast("int") + (lead >= 16).cast("int"))


def line_entropy(low: Column) -> Column:
    """A40 within a row: entropy of the characters over that of as many different ones."""
    kinds = F.filter(F.array_distinct(F.split(low, "")), lambda c: c != "")
    shares = F.transform(kinds, lambda c: occurrences(low, c) / F.length(low))
    h = F.aggregate(shares, F.lit(0.0), lambda acc, p: acc - p * F.log2(p))
    return F.when(low == "", 0.0).otherwise(F.least(F.lit(1.0), h / F.log2(F.least(F.lit(256), F.greatest(F.lit(2), F.size(kinds))))))


def text_tiles(docs: DataFrame, by: str, text: str = "text") -> DataFrame:
    """The lines of a text in equal runs on a square grid of tiles: score over the
    largest, mean entropy, and whether a tile is of the best tenth. Empty tiles are 0.
    Lines become numbers before they are dealt to tiles, so no text is copied."""
    x = docs.select(by, F.split(F.coalesce(text, F.lit("")), "\n").alias("_l"))
    x = x.withColumn("_low", F.transform("_l", lambda v: F.lower(F.trim(v, F.lit(WHITE)))))
    side = F.ceil(F.sqrt(F.greatest(F.lit(4), F.ceil(F.size("_l") / 12)))).cast("int")
    x = x.select(by, side.alias("side"), F.size("_l").alias("_lines"), F.zip_with("_l", "_low", line_score).alias("_s"), F.transform("_low", line_entropy).alias("_e"))
    x = x.withColumn("_n", F.col("side") * F.col("side"))
    x = x.withColumn("_step", F.greatest(F.lit(1), F.ceil(F.col("_lines") / F.col("_n"))).cast("int"))
    x = x.select("*", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("tile"))
    part = lambda c: F.slice(c, F.col("tile") * F.col("_step") + 1, F.col("_step"))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda acc, v: acc + v)
    x = x.select(by, "side", "_n", "tile", part("_s").alias("_s"), part("_e").alias("_e"))
    mean = F.when(F.size("_e") > 0, total("_e") / F.size("_e")).otherwise(0.0)
    x = x.select(by, "side", "_n", "tile", F.round(total("_s"), 9).alias("_s"), mean.alias("entropy"))
    w = W.partitionBy(by)
    place = F.row_number().over(w.orderBy(F.desc("_s"), "tile"))
    edge = F.when(F.max("_s").over(w) > 0, F.col("_s") / F.max("_s").over(w)).otherwise(0.0)
    return x.select(by, "side", "tile", edge.alias("edge"), "entropy", (place <= F.greatest(F.lit(1), F.floor(F.col("_n") * 0.1))).alias("roi"))


def row_profile(docs: DataFrame, by: str, depth: str, calls: str, rows: int = 24) -> DataFrame:
    """Largest depth and summed calls of each of ``rows`` runs of lines, over the
    largest. ``depth`` and ``calls`` are arrays with a value a line, one line at least."""
    n = F.size(depth)
    r = F.explode(F.sequence(F.lit(0), F.lit(rows - 1))).alias("row")
    x = docs.select(by, F.col(depth).alias("_d"), F.col(calls).alias("_c"), n.alias("_n"), r)
    low, high = F.floor(F.col("row") * F.col("_n") / rows), F.floor((F.col("row") + 1) * F.col("_n") / rows)
    start, size = F.least(low + 1, F.col("_n")).cast("int"), F.greatest(high - low, F.lit(1)).cast("int")
    total = F.aggregate(F.slice("_c", start, size), F.lit(0.0), lambda a, v: a + v)
    x = x.select(by, "row", F.array_max(F.slice("_d", start, size)).cast("double").alias("depth"), total.alias("calls"))
    w = W.partitionBy(by)
    over = lambda c: F.when(F.max(c).over(w) > 0, F.col(c) / F.max(c).over(w)).otherwise(0.0)
    return x.select(by, "row", over("depth").alias("depth"), over("calls").alias("calls"))


def relation(rows: DataFrame, by: str, a: str, b: str) -> DataFrame:
    """Correlation of two columns, 0 where one of them is constant."""
    flat = (F.min(a) == F.max(a)) | (F.min(b) == F.max(b))
    rho = F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))
    return rows.groupBy(by).agg(F.when(flat, 0.0).otherwise(F.coalesce(rho, F.lit(0.0))).alias("rho"))


def mask_profile(cells: DataFrame, by: str, rows: int, cols: int, thr: float) -> DataFrame:
    """S = rows + cols, H = cells over the threshold, Z = connected groups of them,
    alpha and beta as shares of S + H."""
    mask = cells.filter(F.col("edge") > thr).select(by, "row", "col")
    name = lambda r, c: F.concat_ws(":", F.col(by), F.col(r), F.col(c))
    e = pixels.adjacency(mask, by, "4").select(name("row", "col").alias("src"), name("row2", "col2").alias("dst"))
    nodes = mask.select(name("row", "col").alias("id"), F.col(by))
    z = graph.connected(nodes.select("id"), e).filter("id = component").join(nodes, "id").groupBy(by).agg(F.count("*").alias("Z"))
    h = cells.groupBy(by).agg(F.count_if(F.col("edge") > thr).alias("H"))
    out = h.join(z, by, "left").withColumn("Z", F.coalesce("Z", F.lit(0))).withColumn("S", F.lit(rows + cols).cast("long"))
    return out.withColumn("alpha", F.col("S") / (F.col("S") + F.col("H"))).withColumn("beta", F.col("H") / (F.col("S") + F.col("H")))


def alignment(alpha: Column, beta: Column, z: Column, most: Column, to_alpha: Column, to_beta: Column, weights: tuple = (1.0, 1.0, 0.4)) -> Column:
    """1 less the weighted distance of two profiles, 0 at least."""
    a, b, c = weights
    return 1 - F.least(F.lit(1.0), a * F.abs(alpha - to_alpha) + b * F.abs(beta - to_beta) + c * z / F.greatest(F.lit(1), most))


def impact(rows: DataFrame, by: str) -> DataFrame:
    """Edge, else impact, else |dS| + |dH| + |dZ| / 4, over the largest of the key."""
    z = lambda c: F.abs(F.coalesce(c, F.lit(0.0)))
    v = F.greatest(F.lit(0.0), F.coalesce("edge", "impact", z("dS") + z("dH") + 0.25 * z("dZ")))
    top = F.max("_v").over(W.partitionBy(by))
    return rows.withColumn("_v", v).withColumn("value", F.when(top > 0, F.col("_v") / top).otherwise(0.0)).drop("_v")


def region_stats(cells: DataFrame, by: str, thr: float) -> DataFrame:
    """A51 of the cells over the threshold: links and mean degree, density |E| / |R|, mean
    contrast to neighbours, cohesion (1 less it, scaled by |R| and the mean degree) and
    coverage of all cells."""
    region = cells.filter(F.col("edge") > thr)
    size = cells.groupBy(by).agg(F.count("*").alias("cells"), F.count_if(F.col("edge") > thr).alias("size"))
    a, b = region.select(by, "row", "col", F.col("edge").alias("_a")), region.select(by, F.col("row").alias("row2"), F.col("col").alias("col2"), F.col("edge").alias("_b"))
    near = pixels.adjacency(region.select(by, "row", "col"), by, "4").join(a, [by, "row", "col"]).join(b, [by, "row2", "col2"])
    e = near.groupBy(by).agg((F.count("*") / 2).cast("long").alias("links"), F.avg(F.abs(F.col("_a") - F.col("_b"))).alias("contrast"))
    out = size.join(e, by, "left").fillna(0, ["links", "contrast"])
    r = F.greatest(F.col("size"), F.lit(1))
    return out.withColumns({"degree": 2 * F.col("links") / r, "density": F.col("links") / r, "cohesion": 1 - F.col("contrast") / 2, "coverage": F.col("size") / F.col("cells")})


def cell_values(cells: DataFrame, blocks: DataFrame, by: str, width: int, height: int) -> DataFrame:
    """Each cell (centre ``cx, cy``) takes the value of the block (``bi, bj``) that
    holds its centre, 0 without one; values leave [0, 1] only to be scaled into it."""
    dims = blocks.groupBy(by).agg((F.max("bi") + 1).alias("_bx"), (F.max("bj") + 1).alias("_by"))
    x = cells.join(dims, by)
    at = lambda c, size, n: F.least(F.greatest(F.floor(F.col(c) / F.greatest(F.lit(1), F.floor(F.lit(size) / F.col(n)))), F.lit(0)), F.col(n) - 1).cast("long")
    x = x.withColumns({"bi": at("cx", width, "_bx"), "bj": at("cy", height, "_by")})
    x = x.join(blocks.select(by, F.col("bi").cast("long"), F.col("bj").cast("long"), "value"), [by, "bi", "bj"], "left")
    v, w = F.coalesce(F.nanvl("value", F.lit(0.0)), F.lit(0.0)), W.partitionBy(by)
    x = x.withColumn("_v", v).withColumns({"_lo": F.min("_v").over(w), "_hi": F.max("_v").over(w)})
    inside = (F.col("_lo") >= 0) & (F.col("_hi") <= 1)
    scaled = F.when(F.col("_hi") > F.col("_lo"), (F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("_v"))))
    return x.select(*cells.columns, F.when(inside, F.col("_v")).otherwise(scaled).alias("value"))


def region_for(label: Column, q25: Column, q75: Column, thr: float, roi_labels=(), prefer_edges: bool = False, prefer_stability: bool = False, bias: float = 0.0) -> Column:
    """The region a label maps to by the quartiles of the edge values; policy rules
    come first. Labels without a rule have ``~edges``."""
    cut = F.lit(min(1.0, max(0.0, thr + bias)))
    base = F.when(label.isin("Call", "Expr"), F.lit("edges") if prefer_edges else F.when(q75 >= cut, "edges").otherwise("~edges"))
    base = base.when(label == "Assign", F.lit("~edges") if prefer_stability else F.when(q25 <= cut, "~edges").otherwise("edges"))
    base = base.when(label.isin("FunctionDef", "ClassDef"), "roi").when(label == "Return", F.lit("~edges" if prefer_stability else "all"))
    base = base.when(label.isin("If", "For", "While", "With"), "all").otherwise("~edges")
    return F.when(label.isin(*roi_labels), "roi").otherwise(base) if roi_labels else base
