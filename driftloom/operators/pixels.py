"""Images and grids as tables of pixels or cells (image, x, y, g)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def luma(r, g, b) -> Column:
    """.299 R + .587 G + .114 B on [0, 1]."""
    return F.least(F.greatest(0.299 * r + 0.587 * g + 0.114 * b, F.lit(0.0)), F.lit(1.0))


def entropy(px: DataFrame, by: list[str], bins: int = 256) -> DataFrame:
    """Entropy in bits over equal bins of [0, 1], the last one closed."""
    b = F.least(F.floor(F.col("g") * bins), F.lit(bins - 1))
    c = px.groupBy(*by, b.alias("_b")).agg(F.count("*").alias("c"))
    return c.groupBy(*by).agg((F.log2(F.sum("c")) - F.sum(F.col("c") * F.log2("c")) / F.sum("c")).alias("entropy"))


def gradients(px: DataFrame, by: list[str]) -> DataFrame:
    """Forward differences within ``by``; 0 at the last column and row."""
    dx = F.lead("g").over(W.partitionBy(*by, "y").orderBy("x")) - F.col("g")
    dy = F.lead("g").over(W.partitionBy(*by, "x").orderBy("y")) - F.col("g")
    return px.withColumn("dx", F.coalesce(dx, F.lit(0.0))).withColumn("dy", F.coalesce(dy, F.lit(0.0)))


def edge_density(px: DataFrame, by: list[str]) -> DataFrame:
    """Mean of the absolute differences, 1 at most."""
    return gradients(px, by).groupBy(*by).agg(F.least(F.lit(1.0), F.avg(F.abs("dx") + F.abs("dy"))).alias("edges"))


def contrast(px: DataFrame, by: list[str]) -> DataFrame:
    """I4: standard deviation."""
    return px.groupBy(*by).agg(F.stddev_pop("g").alias("contrast"))


def block_stats(px: DataFrame, block: int) -> DataFrame:
    """Statistics of square blocks; edges within the block only."""
    b = px.withColumn("bx", F.floor(F.col("x") / block)).withColumn("by", F.floor(F.col("y") / block))
    keys = ["image", "bx", "by"]
    s = gradients(b, keys).groupBy(*keys).agg(F.least(F.lit(1.0), F.avg(F.abs("dx") + F.abs("dy"))).alias("edges"), F.avg("g").alias("mean"), F.var_pop("g").alias("variance"))
    return s.join(entropy(b, keys, 64), keys)


def pairs(px: DataFrame, other: DataFrame) -> DataFrame:
    """Pixels of two tables at the same place (image, x, y)."""
    return px.join(other.withColumnRenamed("g", "h"), ["image", "x", "y"])


def psnr(p: DataFrame) -> DataFrame:
    """10 log10(1 / MSE), infinite for equal images."""
    m = p.groupBy("image").agg(F.avg(F.pow(F.col("g") - F.col("h"), 2)).alias("mse"))
    return m.select("image", F.when(F.col("mse") <= 1e-12, float("inf")).otherwise(10 * F.log10(1 / F.greatest("mse", F.lit(1e-300)))).alias("psnr"))


def difference(p: DataFrame) -> DataFrame:
    """I8: mean, 95th percentile and largest absolute difference."""
    d = F.abs(F.col("g") - F.col("h"))
    return p.groupBy("image").agg(F.avg(d).alias("mean"), F.percentile(d, 0.95).alias("p95"), F.max(d).alias("max"))


def reflected(px: DataFrame, r: int, width: int, height: int) -> DataFrame:
    """Pixels with a border of r on each side, mirrored without repeating the edge."""

    def axis(df: DataFrame, c: str, n: int) -> DataFrame:
        places = F.array_compact(F.array(F.col(c), F.when((F.col(c) >= 1) & (F.col(c) <= r), -F.col(c)), F.when((F.col(c) <= n - 2) & (F.col(c) >= n - 1 - r), 2 * (n - 1) - F.col(c))))
        return df.withColumn(c, F.explode(places))

    return axis(axis(px, "x", width), "y", height)


def ssim(p: DataFrame, width: int, height: int, win: int = 7) -> DataFrame:
    """Mean of the structural similarity with a box window, in two passes of averages
    along rows and columns of the mirrored images."""
    r = win // 2
    c1, c2 = 0.01**2, 0.03**2
    x = reflected(p.withColumns({"gg": F.col("g") * F.col("g"), "hh": F.col("h") * F.col("h"), "gh": F.col("g") * F.col("h")}), r, width, height)
    cols = ["g", "h", "gg", "hh", "gh"]
    row, col = W.partitionBy("image", "y").orderBy("x").rowsBetween(-r, r), W.partitionBy("image", "x").orderBy("y").rowsBetween(-r, r)
    x = x.select("image", "x", "y", *[F.avg(c).over(row).alias(c) for c in cols])
    x = x.select("image", "x", "y", *[F.avg(c).over(col).alias(c) for c in cols])
    x = x.filter(F.col("x").between(0, width - 1) & F.col("y").between(0, height - 1))
    vg, vh, cov = F.col("gg") - F.col("g") ** 2, F.col("hh") - F.col("h") ** 2, F.col("gh") - F.col("g") * F.col("h")
    s = ((2 * F.col("g") * F.col("h") + c1) * (2 * cov + c2)) / ((F.col("g") ** 2 + F.col("h") ** 2 + c1) * (vg + vh + c2))
    return x.groupBy("image").agg(F.avg(F.least(F.greatest(s, F.lit(-1.0)), F.lit(1.0))).alias("ssim"))


def sobel(px: DataFrame) -> DataFrame:
    """Sobel magnitude over 8, edge pixels repeated outwards."""
    row = W.partitionBy("image", "y").orderBy("x")
    col = W.partitionBy("image", "x").orderBy("y")
    at = lambda c, k, w: F.coalesce(F.lag(c, -k).over(w) if k < 0 else F.lag(c, k).over(w), F.col(c))
    nxt = lambda c, w: F.coalesce(F.lead(c).over(w), F.col(c))
    x = px.withColumns({"_dx": nxt("g", row) - at("g", 1, row), "_sx": nxt("g", row) + 2 * F.col("g") + at("g", 1, row)})
    gx = nxt("_dx", col) + 2 * F.col("_dx") + at("_dx", 1, col)
    gy = nxt("_sx", col) - at("_sx", 1, col)
    return x.withColumns({"_gx": gx, "_gy": gy}).select("image", "x", "y", (F.hypot("_gx", "_gy") / 8).alias("edge"))


def period(profile: DataFrame, by: str, at: str, value: str, n: int, least: int = 2) -> DataFrame:
    """Lag with the largest circular autocorrelation of a profile of n values."""
    w = W.partitionBy(by)
    p = profile.select(by, at, (F.col(value) - F.avg(value).over(w)).alias("v"))
    lags = p.select(by, F.col("v").alias("a"), F.col(at).alias("i"), F.explode(F.sequence(F.lit(least), F.lit(n // 2))).alias("lag"))
    j = lags.withColumn(at, F.pmod(F.col("i") + F.col("lag"), F.lit(n))).join(p, [by, at])
    acf = j.groupBy(by, "lag").agg(F.round(F.sum(F.col("a") * F.col("v")), 9).alias("acf"))
    return acf.groupBy(by).agg(F.max_by("lag", F.struct("acf", -F.col("lag"))).alias("period"))


OFFSETS = {"4": ((0, 1), (0, -1), (1, 0), (-1, 0)), "8": tuple((a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b)}


def adjacency(cells: DataFrame, by: str, kind: str = "4") -> DataFrame:
    """Neighbouring cells (by, row, col) -> (row2, col2). ``hex``: odd rows are
    shifted to the right."""
    if kind == "hex":
        side = F.when(F.col("row") % 2 == 0, F.array(F.lit(-1), F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1)))
        up = F.transform(side, lambda c: F.struct(F.lit(-1).alias("dr"), c.alias("dc")))
        down = F.transform(side, lambda c: F.struct(F.lit(1).alias("dr"), c.alias("dc")))
        flat = F.array(*[F.struct(F.lit(0).alias("dr"), F.lit(c).alias("dc")) for c in (-1, 1)])
        steps = F.concat(up, down, flat)
    else:
        steps = F.array(*[F.struct(F.lit(r).alias("dr"), F.lit(c).alias("dc")) for r, c in OFFSETS[kind]])
    x = cells.select(by, "row", "col", F.explode(steps).alias("s")).select(by, "row", "col", (F.col("row") + F.col("s.dr")).alias("row2"), (F.col("col") + F.col("s.dc")).alias("col2"))
    return x.join(cells.select(by, F.col("row").alias("row2"), F.col("col").alias("col2")), [by, "row2", "col2"], "left_semi")


def grid_meta(cells: DataFrame, rows: int, cols: int) -> DataFrame:
    """Border flag, ring (steps from the border) and centre of each cell."""
    ring = F.least("row", "col", F.lit(rows - 1) - F.col("row"), F.lit(cols - 1) - F.col("col"))
    return cells.withColumns({"ring": ring, "border": ring == 0, "u": (F.col("col") + 0.5) / cols, "v": (F.col("row") + 0.5) / rows})


def merged_masks(layers: DataFrame, by: list[str], mode: str) -> DataFrame:
    """Masks of several layers as one: max, min, mean or mul."""
    agg = {"max": F.max("v"), "min": F.min("v"), "mean": F.avg("v"), "mul": F.product("v")}[mode]
    return layers.groupBy(*by).agg(F.least(F.lit(1.0), F.greatest(F.lit(0.0), agg)).alias("v"))
