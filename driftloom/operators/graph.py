"""Graphs as node and edge tables: metrics, search, ranking, communities, windows."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce
from itertools import count

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType
from pyspark.sql.window import Window as W

#: Edges of a node in one array; sources in a word of bits; sources of a pass of G4;
#: rounds that G1 looks back.
CHUNK, BITS, WIDTH, BACK = 4096, 63, 32, 3


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names. Where it names none, a temporary one
    serves a single machine; on a cluster that would be the driver's own disk: an error."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named is None and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    return named or tempfile.mkdtemp(prefix="spark-ckpt-")


def checkpointed(df: DataFrame) -> DataFrame:
    """Cuts the lineage of an iteration in the shared folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """A table written to the shared folder and read again: cuts the lineage, and the
    planner knows its size, so that a round's small table is broadcast by Spark's own rule."""
    path = f"{shared_folder(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, order: list, name: str) -> DataFrame:
    """``df`` with the place of each row in an order, from 0: sorted over ranges; the driver
    sees a count a range."""
    at = checkpointed(df.orderBy(*order).withColumn("_m", F.monotonically_increasing_id()))
    part, place = F.shiftright("_m", 33), F.col("_m").bitwiseAND((1 << 33) - 1)
    starts, n = [F.lit(-1).cast("long"), F.lit(0).cast("long")], 0
    for r in at.groupBy(part.alias("p")).agg(F.count("*").alias("n")).orderBy("p").collect():
        starts += [F.lit(r["p"]).cast("long"), F.lit(n).cast("long")]
        n += r["n"]
    return at.withColumn(name, place + F.element_at(F.create_map(*starts), part)).drop("_m")


def indexed(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The nodes as ``id, n``, n their place in the order of ids, and the edges with these
    numbers as ends (edges of other nodes are left out): rounds group by numbers, whose
    minimum needs no sort, and the smallest number is the smallest id."""
    ids = stored(numbered(nodes.select("id").distinct(), ["id"], "n"))
    for end in ("src", "dst"):
        edges = edges.join(ids.select(F.col("id").alias(end), F.col("n").alias("_n")), end).drop(end).withColumnRenamed("_n", end)
    return ids, edges


def adjacency(edges: DataFrame, *values: str) -> DataFrame:
    """Edges for many passes: ``src, out``, arrays of up to CHUNK ``dst`` with values, so that
    a pass sorts and shuffles arrays, about as many as nodes, and no single edges."""
    rows = edges.withColumn("_c", F.floor((F.row_number().over(W.partitionBy("src").orderBy(F.lit(0))) - 1) / CHUNK))
    return stored(rows.groupBy("src", "_c").agg(F.collect_list(F.struct("dst", *values)).alias("out")).select("src", "out"))


def passed(near: DataFrame, nodes: DataFrame) -> DataFrame:
    """What nodes (``id`` and more) send along their edges: ``id`` is the receiver."""
    more = [c for c in nodes.columns if c != "id"]
    sent = near.join(nodes.withColumnRenamed("id", "src"), "src").select(F.explode("out").alias("_o"), *more)
    return sent.select(F.col("_o.dst").alias("id"), "_o", *more)


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """In, out and total degree and strength; isolated nodes have 0."""
    w = F.coalesce("weight", F.lit(1.0))
    ends = edges.select(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i"), w.alias("so"), F.lit(0.0).alias("si"))
    ends = ends.unionByName(edges.select(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i"), F.lit(0.0).alias("so"), w.alias("si")))
    g = ends.groupBy("id").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"), F.sum("si").alias("in_strength"), F.sum("so").alias("out_strength"))
    return nodes.select("id").join(g, "id", "left").fillna(0).withColumn("degree", F.col("in_degree") + F.col("out_degree"))


def density(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """M / (n (n - 1)) without loops, one row."""
    n = nodes.agg(F.count("*").alias("n"))
    m = edges.filter("src <> dst").agg(F.count("*").alias("m"))
    return n.crossJoin(m).select("n", "m", F.when(F.col("n") > 1, F.col("m") / (F.col("n") * (F.col("n") - 1))).otherwise(0.0).alias("density"))


def canonical_digests(nodes: DataFrame, edges: DataFrame, by: str) -> DataFrame:
    """SHA-256 of each group's distinct nodes by id and edges by (src, dst, kind), so
    that the order of rows doesn't count. A group's parts meet in one task."""
    line = lambda *xs: F.concat_ws("|", *xs)
    n = nodes.select(by, line(F.lit("n"), "id", "kind").alias("x"))
    e = edges.select(by, line(F.lit("o"), "src", "dst", "kind").alias("x"))
    return n.unionByName(e).groupBy(by).agg(F.sha2(F.array_join(F.array_sort(F.collect_set("x")), "\n"), 256).alias("digest"))


def grid_edges(cells: DataFrame) -> DataFrame:
    """Each cell (grid, x, y, edge) with its neighbours right and below; the vote
    between two cells is 1 + half the sum of their edge values."""
    a = cells.select("grid", F.col("x").alias("_x"), F.col("y").alias("_y"), F.col("id").alias("src"), F.col("edge").alias("_a"))
    to = F.explode(F.array(F.struct((F.col("_x") + 1).alias("x"), F.col("_y").alias("y")), F.struct(F.col("_x").alias("x"), (F.col("_y") + 1).alias("y"))))
    a = a.select("grid", "src", "_a", to.alias("to")).select("grid", "src", "_a", "to.x", "to.y")
    b = cells.select("grid", "x", "y", F.col("id").alias("dst"), F.col("edge").alias("_b"))
    return a.join(b, ["grid", "x", "y"]).select("src", "dst", (1 + 0.5 * (F.col("_a") + F.col("_b"))).alias("weight"))


def induced(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with both ends among the ids."""
    return edges.join(ids.select(F.col("id").alias("src")), "src", "left_semi").join(ids.select(F.col("id").alias("dst")), "dst", "left_semi")


def pagerank(nodes: DataFrame, edges: DataFrame, alpha: float = 0.85, tol: float = 1e-8, rounds: int = 200) -> DataFrame:
    """G1: weighted PageRank; the mass of nodes without edges is spread over all. A round
    is one pass over the edges; the driver sees a few sums. The next ranks are the mix of the
    last BACK + 1 rounds whose changes cancel best (Anderson), as on graphs of two sides plain
    rounds swing, by .85 a round; it ends where one plain round moves less than ``tol``."""
    w = F.coalesce("weight", F.lit(1.0))
    every = stored(edges.select("src", "dst", w.alias("_w")))
    out = every.groupBy("src").agg(F.sum("_w").alias("_s")).filter("_s > 0")
    ids, links = indexed(nodes, every.join(out, "src").select("src", "dst", (F.col("_w") / F.col("_s")).alias("share")))
    n = ids.count()
    if n == 0:
        return nodes.select("id", F.lit(0.0).alias("rank"))
    near = adjacency(links, "share")
    base = ids.join(out.select(F.col("src").alias("id"), F.lit(1.0).alias("_out")), "id", "left")
    cur = stored(base.select(F.col("n").alias("id"), F.when(F.col("_out").isNull(), 1.0).otherwise(0.0).alias("_end"), F.lit(1.0 / n).alias("_x0")))
    lost = cur.agg(F.sum(F.col("_end") * F.col("_x0"))).first()[0]
    old = 0  # earlier rounds that a row holds: their ranks and moves
    for _ in range(rounds):
        got = passed(near, cur.select("id", F.col("_x0").alias("_v"))).groupBy("id").agg(F.sum(F.col("_o.share") * F.col("_v")).alias("_g"))
        new = F.lit((1 - alpha) / n + alpha * lost / n) + alpha * F.coalesce("_g", F.lit(0.0))
        cur = stored(cur.join(got, "id", "left").withColumn("_f0", new - F.col("_x0")).drop("_g"))
        f = [F.col(f"_f{k}") for k in range(old + 1)]
        diff = [f[0] - f[k] for k in range(1, old + 1)]
        step = [F.col("_x0") - F.col(f"_x{k}") + diff[k - 1] for k in range(1, old + 1)]
        sums = [F.sum(F.abs(f[0])), F.sum(F.col("_end") * (F.col("_x0") + f[0]))]
        sums += [F.sum(F.col("_end") * s) for s in step] + [F.sum(d * f[0]) for d in diff] + [F.sum(a * b) for a in diff for b in diff]
        moved, lost, *rest = cur.agg(*[x.alias(f"_{k}") for k, x in enumerate(sums)]).first()
        if moved < tol:
            break
        ends, right, left = np.array(rest[:old]), np.array(rest[old : 2 * old]), np.array(rest[2 * old :]).reshape(old, old)
        mix = np.linalg.lstsq(left, right, rcond=1e-12)[0] if old else ends
        lost -= float(mix @ ends)
        nxt = F.col("_x0") + f[0]
        for m, s in zip(mix, step, strict=True):
            nxt = nxt - F.lit(float(m)) * s
        old = min(old + 1, BACK)
        cur = cur.select("id", "_end", nxt.alias("_x0"), *[F.col(f"_{v}{k}").alias(f"_{v}{k + 1}") for k in range(old) for v in "xf"])
    return cur.withColumnRenamed("id", "n").join(ids, "n").select("id", (F.col("_x0") + F.col("_f0")).alias("rank"))


def sampled(nodes: DataFrame, k: int = 32) -> DataFrame:
    """W2 over all nodes: every ``n // k``-th id in order, the first k: ``source, id``. A
    global sort numbers the rows; the driver sees a count a partition."""
    at = checkpointed(nodes.select("id").distinct().orderBy("id").select("id", F.monotonically_increasing_id().alias("_m")))
    part, place = F.shiftright("_m", 33), F.col("_m").bitwiseAND((1 << 33) - 1)
    sizes = at.groupBy(part.alias("p")).agg(F.count("*").alias("n")).orderBy("p").collect()
    n, starts = 0, []
    for r in sizes:
        starts += [F.lit(r["p"]), F.lit(n)]
        n += r["n"]
    if not n:
        return at.select(F.col("id").alias("source"), "id")
    step = max(1, n // min(k, n))
    row = place + F.element_at(F.create_map(*starts), part)
    return checkpointed(at.filter((row % step == 0) & (row < step * k)).select(F.col("id").alias("source"), "id"))


def _levels(sources: DataFrame, edges: DataFrame, depth: int | None) -> tuple[DataFrame, DataFrame]:
    """Nodes by the step at which sources first reach them (``id, word, mask, dist``: bit b of
    word w is source ``BITS w + b``), and the sources as ``source, slot``. A round is one
    pass over the edges, however many sources there are."""
    names = stored(numbered(sources.select("source").distinct(), ["source"], "slot"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("slot") % BITS).cast("int"))
    seed = sources.join(names, "source").groupBy("id", F.floor(F.col("slot") / BITS).alias("word")).agg(F.bit_or(bit).alias("mask"))
    seen = front = stored(seed)
    near, levels = adjacency(edges), [front.withColumn("dist", F.lit(0))]
    for k in count(1) if depth is None else range(1, depth + 1):
        got = passed(near, front).groupBy("id", "word").agg(F.bit_or("mask").alias("_m"))
        new = got.join(seen, ["id", "word"], "left").select("id", "word", F.col("_m").bitwiseAND(F.bitwise_not(F.coalesce("mask", F.lit(0).cast("long")))).alias("mask"))
        front = stored(new.filter("mask <> 0"))
        if not front.limit(1).count():
            break
        levels.append(front.withColumn("dist", F.lit(k)))
        seen = stored(seen.unionByName(front).groupBy("id", "word").agg(F.bit_or("mask").alias("mask")))
    return reduce(DataFrame.unionByName, levels), names


def bfs(sources: DataFrame, edges: DataFrame, depth: int | None = None, directed: bool = True) -> DataFrame:
    """Steps from every source (``source, id``) at once: ``source, id, dist``, up to
    ``depth`` if given. A round a step."""
    e = edges.select("src", "dst")
    e = e if directed else e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    levels, names = _levels(sources, e, depth)
    slots = F.filter(F.sequence(F.lit(0), F.lit(BITS - 1)), lambda b: F.call_function("getbit", F.col("mask"), b) == 1)
    rows = levels.select("id", "dist", "word", F.explode(slots).alias("_b")).select("id", "dist", (F.col("word") * BITS + F.col("_b")).alias("slot"))
    return rows.join(names, "slot").select("source", "id", "dist")


def harmonic_in(sources: DataFrame, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Sum of 1/d from the sampled sources, divided by their number."""
    n = sources.count()
    levels = _levels(sources, edges.select("src", "dst"), None)[0].filter("dist > 0")
    d = levels.groupBy("id").agg((F.sum(F.bit_count("mask") / F.col("dist")) / n).alias("harmonic"))
    return nodes.select("id").join(d, "id", "left").fillna(0.0)


def betweenness(sources: DataFrame, edges: DataFrame, nodes: DataFrame, depth: int | None = None) -> DataFrame:
    """Brandes by levels from the sampled sources: shortest-path counts forward,
    dependencies backward; divided by the samples and then by the largest value. A row has a
    column for each of WIDTH sources (the driver sees the sources' names), so that a level is
    one pass over the edges of its nodes."""
    e = stored(edges.select("src", "dst"))
    near, back = adjacency(e), adjacency(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    names = [r[0] for r in sources.select("source").distinct().orderBy("source").collect()]
    parts = [_dependencies(sources, names[k : k + WIDTH], near, back, depth) for k in range(0, len(names), WIDTH)]
    n = sources.count()
    total = reduce(DataFrame.unionByName, parts, nodes.select("id", F.lit(0.0).alias("delta")).filter("false"))
    s = stored(total.groupBy("id").agg((F.sum("delta") / n).alias("b")))
    most = s.agg(F.max("b")).first()[0] or 0.0
    return nodes.select("id").join(s, "id", "left").select("id", (F.coalesce("b", F.lit(0.0)) / F.lit(most or 1.0)).alias("betweenness"))


def _dependencies(sources: DataFrame, names: list, near: DataFrame, back: DataFrame, depth: int | None) -> DataFrame:
    """``id, delta``: dependencies of the sources named, none of a source on itself."""
    cols = range(len(names))
    s = [F.col(f"s{k}") for k in cols]
    plus = lambda xs: reduce(lambda a, b: a + b, xs)
    mask = plus(F.when(s[k] > 0, 1 << k).otherwise(0).cast("long") for k in cols).alias("mask")
    front = stored(sources.groupBy("id").agg(*[F.max(F.when(F.col("source") == x, 1.0).otherwise(0.0)).alias(f"s{k}") for k, x in enumerate(names)]).filter(F.greatest(*s, F.lit(0.0)) > 0))
    seen, levels = front.select("id", mask), [front]
    for _ in count(1) if depth is None else range(depth):
        got = passed(near, front).groupBy("id").agg(*[F.sum(x).alias(f"s{k}") for k, x in enumerate(s)])
        free = [F.when(F.call_function("getbit", F.coalesce("mask", F.lit(0).cast("long")), F.lit(k)) == 0, s[k]).otherwise(0.0).alias(f"s{k}") for k in cols]
        front = stored(got.join(seen, "id", "left").select("id", *free).filter(F.greatest(*s, F.lit(0.0)) > 0))
        if not front.limit(1).count():
            break
        levels.append(front)
        seen = stored(seen.unionByName(front.select("id", mask)).groupBy("id").agg(F.bit_or("mask").alias("mask")))
    delta, totals = levels[-1].select("*", *[F.lit(0.0).alias(f"d{k}") for k in cols]), []
    for k in range(len(levels) - 2, -1, -1):
        sent = delta.select("id", *[F.when(s[j] > 0, (1 + F.col(f"d{j}")) / s[j]).otherwise(0.0).alias(f"m{j}") for j in cols])
        got = passed(back, sent).groupBy("id").agg(*[F.sum(f"m{j}").alias(f"m{j}") for j in cols])
        delta = stored(levels[k].join(got, "id", "left").select("id", *s, *[(s[j] * F.coalesce(f"m{j}", F.lit(0.0))).alias(f"d{j}") for j in cols]))
        totals.append(delta.select("id", plus(F.when(F.lit(k > 0) | (F.col("id") != F.lit(x)), F.col(f"d{j}")).otherwise(0.0) for j, x in enumerate(names)).alias("delta")))
    return reduce(DataFrame.unionByName, totals, levels[0].select("id", F.lit(0.0).alias("delta")).filter("false"))


def label_propagation(nodes: DataFrame, edges: DataFrame, rounds: int = 20, weight: str | None = None) -> DataFrame:
    """Every node takes the label most common (or heaviest) among its neighbours,
    the smallest on a tie, all at once; a node that would swap labels with the round
    before last keeps the smaller. A community is named by one of its nodes' ids."""
    w = F.coalesce(F.col(weight), F.lit(1.0)) if weight else F.lit(1.0)
    e, cur, ids = edges.filter("src <> dst").select("src", "dst", w.alias("_w")), nodes.select("id").distinct(), None
    if not isinstance(nodes.schema["id"].dataType, IntegralType):
        ids, e = indexed(nodes, e)
        cur = ids.select(F.col("n").alias("id"))
    e = stored(e)
    near = adjacency(e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "_w")), "_w")
    # the votes of nodes that one array holds are dealt by node, which spares a second shuffle
    hubs = near.groupBy("src").agg(F.count("*").alias("n")).filter("n > 1").limit(1).count()
    cur = stored(cur.select("id", F.col("id").alias("label"), F.col("id").alias("prev")))
    for _ in range(rounds):
        sent = passed(near, cur.select("id", "label")).select("id", "label", "_o._w")
        votes = (sent if hubs else sent.repartition("id")).groupBy("id", "label").agg(F.sum("_w").alias("v"))
        best = votes.groupBy("id").agg(F.min(F.struct(-F.col("v"), F.col("label"))).alias("b")).select("id", F.col("b.label").alias("_new"))
        nxt = cur.join(best, "id", "left").withColumn("_new", F.coalesce("_new", "label"))
        new = F.when((F.col("_new") == F.col("prev")) & (F.col("_new") != F.col("label")), F.least("_new", "label")).otherwise(F.col("_new"))
        cur = stored(nxt.select("id", new.alias("label"), F.col("label").alias("prev")))
        if not cur.filter("label <> prev").limit(1).count():
            break
    out = cur.select("id", F.col("label").alias("community"))
    if ids is None:
        return out
    named = out.join(ids.select(F.col("n").alias("community"), F.col("id").alias("_name")), "community").select(F.col("id").alias("n"), "_name")
    return named.join(ids, "n").select("id", F.col("_name").alias("community"))


def connected(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Smallest node id of each component, by neighbours' labels and label jumps. Only
    nodes with a new label send it."""
    ids, e = indexed(nodes, edges.select("src", "dst").filter("src <> dst"))
    near = adjacency(e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))))
    cur = front = stored(ids.select(F.col("n").alias("id"), F.col("n").alias("label")))
    while True:
        got = passed(near, front).groupBy("id").agg(F.min("label").alias("_n"))
        nxt = stored(cur.join(got, "id", "left").select("id", "label", F.least("label", "_n").alias("_l")))
        jump = nxt.select(F.col("id").alias("_l"), F.col("_l").alias("_j"))
        nxt = stored(nxt.join(jump, "_l").select("id", F.col("label").alias("_old"), F.least("_l", "_j").alias("label")))
        cur, front = nxt.select("id", "label"), stored(nxt.filter("label <> _old").select("id", "label"))
        if not front.limit(1).count():
            break
    named = cur.join(ids.select(F.col("n").alias("label"), F.col("id").alias("component")), "label")
    return named.withColumnRenamed("id", "n").join(ids, "n").select("id", "component")


def clustering(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Links among a node's neighbours over all possible. Edges go towards the higher
    degree, which bounds the work at hubs. A triangle is two edges from one node and the
    edge between their ends, or a path of two edges and the one from its first node to its
    last: the form with fewer pairs of edges is taken (on graphs of two sides hardly any
    path has two edges)."""
    pairs = stored(edges.filter("src <> dst").select("src", "dst"))
    ids, e = indexed(pairs.select(F.explode(F.array("src", "dst")).alias("id")), pairs)
    u = stored(e.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct())
    deg = stored(u.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("k")))
    d = u.join(deg.select(F.col("id").alias("a"), F.col("k").alias("ka")), "a").join(deg.select(F.col("id").alias("b"), F.col("k").alias("kb")), "b")
    up = (F.col("ka") < F.col("kb")) | ((F.col("ka") == F.col("kb")) & (F.col("a") < F.col("b")))
    o = stored(d.select(F.when(up, F.col("a")).otherwise(F.col("b")).alias("x"), F.when(up, F.col("b")).otherwise(F.col("a")).alias("y")))
    ends = o.select(F.col("x").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(o.select(F.col("y").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    ends = ends.groupBy("id").agg(F.sum("o").alias("o"), F.sum("i").alias("i"))
    fans, paths = ends.agg(F.sum(F.col("o") * (F.col("o") - 1) / 2), F.sum(F.col("o") * F.col("i"))).first()
    if (fans or 0) < (paths or 0):
        two = o.select("x", F.col("y").alias("y1")).join(o.select("x", F.col("y").alias("y2")), "x").filter("y1 < y2")
        tri = two.join(u, (F.col("y1") == F.col("a")) & (F.col("y2") == F.col("b")))
    else:
        through = ends.filter("o > 0 AND i > 0").select("id")
        first = o.join(through.withColumnRenamed("id", "y"), "y", "left_semi").select("x", F.col("y").alias("y1"))
        last = o.join(through.withColumnRenamed("id", "x"), "x", "left_semi").select(F.col("x").alias("y1"), F.col("y").alias("y2"))
        tri = first.join(last, "y1").join(o.withColumnRenamed("y", "y2"), ["x", "y2"])
    t = tri.select(F.explode(F.array("x", "y1", "y2")).alias("id")).groupBy("id").agg(F.count("*").alias("t"))
    known = deg.join(t, "id", "left").withColumnRenamed("id", "n").join(ids, "n").select("id", "k", "t")
    out = nodes.select("id").join(known, "id", "left").fillna(0)
    return out.select("id", F.when(F.col("k") > 1, 2 * F.col("t") / (F.col("k") * (F.col("k") - 1))).otherwise(0.0).alias("clustering"))


def anchor(nodes: DataFrame, degree: DataFrame, kinds: list[str], by: str | None = None) -> DataFrame:
    """O2: the node of highest degree of the first kind there is."""
    rank = F.array_position(F.array(*map(F.lit, kinds)), F.col("kind"))
    return nodes.filter(F.col("kind").isin(*kinds)).join(degree, "id").orderBy(rank, F.desc("degree"), "id").limit(1)


def panned(anchors: DataFrame, edges: DataFrame, field: DataFrame, steps: int) -> DataFrame:
    """Each anchor moves to its neighbour with the largest value, step by step."""
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    at = anchors.select(F.col("id").alias("anchor"), "id")
    for _ in range(steps):
        near = at.join(both, F.col("id") == F.col("src"), "left").join(field.select(F.col("id").alias("dst"), "value"), "dst", "left")
        at = checkpointed(near.groupBy("anchor").agg(F.max_by("dst", F.struct(F.coalesce("value", F.lit(0.0)), F.col("dst"))).alias("_d"), F.first("id").alias("_i")).select("anchor", F.coalesce("_d", "_i").alias("id")))
    return at


def window(nodes: DataFrame, edges: DataFrame, anchors: DataFrame, depth: int, kinds: list[str], edge_kinds: list[str] | None, most: int, field: DataFrame | None = None, at_least: float = 0.0) -> DataFrame:
    """Nodes around anchors (``lens, id``): search along allowed edges and
    kinds, up to ``most`` nodes of a lens by depth and id, those with a field value of the
    given share of the largest. Several lenses at once; membership flags come from a left
    join on (lens, id)."""
    e = edges.filter(F.col("kind").isin(*edge_kinds)) if edge_kinds else edges
    ok = nodes.filter(F.col("kind").isin(*kinds)).select("id")
    e = induced(e, ok.unionByName(anchors.select("id")).distinct())
    seen = bfs(anchors.select(F.col("lens").alias("source"), "id"), e, depth, directed=False)
    w = W.partitionBy("source").orderBy("dist", "id")
    out = seen.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= most).drop("_r")
    if field is not None:
        out = out.join(field.select("id", "value"), "id", "left").withColumn("_m", F.max("value").over(W.partitionBy("source")))
        out = out.filter((F.col("_m") > 0) & (F.col("value") / F.col("_m") >= at_least)).drop("_m", "value")
    return out.select(F.col("source").alias("lens"), "id", "dist")


def from_facts(defs: DataFrame, calls: DataFrame, imports: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of definitions (module, file, func), calls (file, func, name)
    and imports (file, module); the first node of an id counts, edges keep their number."""
    n = defs.select(F.concat(F.lit("module:"), "module").alias("id"), F.lit("module").alias("kind")).unionByName(defs.select(F.concat(F.lit("file:"), "file").alias("id"), F.lit("file").alias("kind"))).unionByName(defs.select(F.concat(F.lit("func:"), "file", F.lit(":"), "func").alias("id"), F.lit("func").alias("kind")))
    e = defs.select(F.concat(F.lit("module:"), "module").alias("src"), F.concat(F.lit("file:"), "file").alias("dst"), F.lit("define").alias("kind")).distinct()
    e = e.unionByName(defs.select(F.concat(F.lit("file:"), "file").alias("src"), F.concat(F.lit("func:"), "file", F.lit(":"), "func").alias("dst"), F.lit("define").alias("kind")))
    e = e.unionByName(calls.select(F.concat(F.lit("func:"), "file", F.lit(":"), "func").alias("src"), F.concat(F.lit("name:"), "name").alias("dst"), F.lit("call").alias("kind")))
    e = e.unionByName(imports.select(F.concat(F.lit("file:"), "file").alias("src"), F.concat(F.lit("module:"), "module").alias("dst"), F.lit("import").alias("kind")))
    return n.groupBy("id").agg(F.min("kind").alias("kind")), e
