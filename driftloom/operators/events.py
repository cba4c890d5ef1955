"""Event logs: paths, completion, coupling, chains, upserts, integrity, ratios."""

from __future__ import annotations

import fnmatch

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType
from pyspark.sql.window import Window as W

from driftloom.operators.prefix import running_sums

#: Letters of an inner literal that J27 looks up, and tasks that a literal's keys go to.
GRAM, SALTS = 3, 16


def path_pairs(events: DataFrame, key: str, first: str, then: str, seconds: int, between: str | None = None) -> DataFrame:
    """A then B of one key within a window, and no X strictly between.

    ``events`` has ``key, kind, at`` (epoch seconds or a comparable number) and ``id``.
    The join is on the key and a bucket of the window's length, so that a key with a long
    history isn't paired with itself as a whole. The last X before B is found in one
    window pass, which spares a second join.
    """
    x = events
    if between is not None:
        x = x.withColumn("_x", F.max(F.when(F.col("kind") == between, F.col("at"))).over(W.partitionBy(key).orderBy("at").rangeBetween(W.unboundedPreceding, -1)))
    bucket = F.floor(F.col("at") / seconds)
    a = x.filter(F.col("kind") == first).select(key, F.col("id").alias("a_id"), F.col("at").alias("a_at"), F.explode(F.array(bucket, bucket + 1)).alias("_b"))
    b = x.filter(F.col("kind") == then).select(key, F.col("id").alias("b_id"), F.col("at").alias("b_at"), bucket.alias("_b"), *(["_x"] if between is not None else []))
    j = a.join(b, [key, "_b"]).filter((F.col("b_at") > F.col("a_at")) & (F.col("b_at") <= F.col("a_at") + seconds))
    if between is not None:
        j = j.filter(F.col("_x").isNull() | (F.col("_x") <= F.col("a_at")))
    return j.select(key, "a_id", "b_id")


def incomplete(events: DataFrame, key: str, start: str, ends: list[str], seconds: int) -> DataFrame:
    """Starts that no end follows in time; by the next end's time, without a join."""
    w = W.partitionBy(key).orderBy(F.col("at")).rangeBetween(1, W.unboundedFollowing)
    nxt = F.min(F.when(F.col("kind").isin(*ends), F.col("at"))).over(w)
    x = events.withColumn("_n", nxt).filter(F.col("kind") == start)
    return x.filter(F.col("_n").isNull() | (F.col("_n") > F.col("at") + seconds)).drop("_n")


def chains(events: DataFrame, key: str, kinds: list[str], seconds: int) -> DataFrame:
    """A then B then C ..., each within the window of the one before."""
    out = None
    for a, b in zip(kinds, kinds[1:], strict=False):
        step = path_pairs(events, key, a, b, seconds)
        k = 0 if out is None else len(out.columns) - 1
        step = step.select(key, F.col("a_id").alias(f"id{max(k - 1, 0)}"), F.col("b_id").alias(f"id{max(k, 1)}"))
        out = step if out is None else out.join(step, [key, f"id{k - 1}"])
    return out.select(key, *[f"id{k}" for k in range(len(kinds))])


#: Files of a commit that meet in one unit of work.
UNIT = 500


def units(files: DataFrame, commit: str, path: str, unit: int = UNIT) -> tuple[DataFrame, DataFrame]:
    """Left and right sides of the pairs of distinct ``files``, as ``commit, i, j`` and a
    path (``a`` or ``b``). A commit of more than ``unit`` files is cut into chunks, each pair
    of which is a unit; so any two files meet in one unit, and none holds a large commit."""
    d = files.select(F.col(commit).alias("commit"), F.col(path).alias("path")).distinct()
    large = d.groupBy("commit").agg(F.count("*").alias("n")).filter(F.col("n") > unit)
    d = d.join(large, "commit", "left").withColumn("n", F.coalesce(F.ceil(F.col("n") / unit), F.lit(1)).cast("int"))
    d = d.withColumn("k", F.pmod(F.xxhash64("path"), F.col("n")).cast("int"))
    left = d.select("commit", F.col("path").alias("a"), F.col("k").alias("i"), F.explode(F.sequence("k", F.col("n") - 1)).alias("j"))
    right = d.select("commit", F.col("path").alias("b"), F.explode(F.sequence(F.lit(0), "k")).alias("i"), F.col("k").alias("j"))
    return left, right


def coupling(changes: DataFrame, commit: str, path: str, unit: int = UNIT) -> DataFrame:
    """Pairs of files changed together, counted; counts are combined before they are
    shuffled, and a large commit is dealt to many tasks."""
    left, right = units(changes, commit, path, unit)
    pairs = left.join(right, ["commit", "i", "j"]).filter((F.col("i") < F.col("j")) | (F.col("a") < F.col("b")))
    return pairs.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.count("*").alias("together"))


def nearest_before(points: DataFrame, marks: DataFrame, by: str, at: str, name: str) -> DataFrame:
    """The last mark at or before each point (as-of), in one sort of both."""
    both = points.withColumn("_m", F.lit(1)).unionByName(marks.select(by, at, F.col(name).alias("_name")).withColumn("_m", F.lit(0)), allowMissingColumns=True)
    w = W.partitionBy(by).orderBy(at, "_m").rowsBetween(W.unboundedPreceding, 0)
    return both.withColumn(name, F.last("_name", ignorenulls=True).over(w)).filter("_m = 1").drop("_m", "_name")


def in_ranges(points: DataFrame, ranges: DataFrame, by: str, at: str, low: str, high: str, width: int = 64) -> DataFrame:
    """Points joined left to the ranges that hold them, by buckets of ``width``. That
    gives all pairs; who only counts them takes :func:`range_hits`."""
    r = ranges.withColumn("_b", F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))))
    p = points.withColumn("_b", F.floor(F.col(at) / width))
    held = p.join(r, [by, "_b"], "left").filter(F.col(low).isNull() | F.col(at).between(F.col(low), F.col(high)))
    return held.drop("_b")


def range_hits(points: DataFrame, ranges: DataFrame, by: str, at: str, low: str, high: str) -> DataFrame:
    """Points with ``hits``, the number of ranges that hold each. No pair is formed: it
    is the ranges that begin at the point or before less those that end before it, as running
    sums over the places of points and ends, cut into blocks (W14). A range with a null end,
    or whose low is above its high, holds nothing; a point with a null has no hits."""
    ends = ranges.filter(F.col(by).isNotNull() & (F.col(low) <= F.col(high)))
    place = lambda x, c, begins, stops: x.select(F.col(by).alias("_k"), F.col(c).alias("_at"), F.lit(begins).cast("long").alias("_begins"), F.lit(stops).cast("long").alias("_stops"))
    places = place(points.filter(F.col(by).isNotNull() & F.col(at).isNotNull()), at, 0, 0).unionByName(place(ends, low, 1, 0)).unionByName(place(ends, high, 0, 1))
    places = places.groupBy("_k", "_at").agg(F.sum("_begins").alias("_begins"), F.sum("_stops").alias("_stops"))
    held = running_sums(places, "_k", "_at", ["_begins", "_stops"]).select("_k", "_at", (F.col("run__begins") - F.col("run__stops") + F.col("_stops")).alias("_hits"))
    met = points.join(held.filter("_hits > 0"), (F.col(by) == F.col("_k")) & (F.col(at) == F.col("_at")), "left")
    return met.withColumn("hits", F.coalesce("_hits", F.lit(0).cast("long"))).drop("_k", "_at", "_hits")


def dedup_insert(target: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """Rows to append: one for each new id that the target hasn't."""
    first = new.groupBy(key).agg(F.min_by(F.struct(*new.columns), order).alias("_r")).select("_r.*")
    return first.join(target.select(key), key, "left_anti")


def upsert(target: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """New values where given, else old ones."""
    cols = [c for c in target.columns if c != key]
    n = new.select(key, *[F.col(c).alias(f"_{c}") for c in cols])
    return target.join(n, key, "full_outer").select(key, *[F.coalesce(f"_{c}", c).alias(c) for c in cols])


def orphans(child: DataFrame, parent: DataFrame, key: str, parent_key: str) -> DataFrame:
    """Child rows whose key the parent hasn't; nulls refer to nothing."""
    return child.filter(F.col(key).isNotNull()).join(parent.select(F.col(parent_key).alias(key)), key, "left_anti")


def stale(snapshots: DataFrame, current: DataFrame, key: str, digest: str) -> DataFrame:
    """Keys whose snapshot is missing or has another digest."""
    j = current.join(snapshots.select(key, F.col(digest).alias("_d")), key, "left")
    return j.filter(~F.col(digest).eqNullSafe(F.col("_d"))).drop("_d")


def causal_chain(rows: DataFrame, key: str, parent: str) -> DataFrame:
    """Root and depth of every row by pointer doubling: each round doubles how far a
    row sees, so a chain of n rows takes log2(n) joins. Rows whose parents form a cycle
    have no root: when a row still isn't at one after as many steps as there are rows, that
    is an error."""
    from driftloom.operators.graph import checkpointed

    cur = rows.select(F.col(key).alias("id"), F.coalesce(parent, key).alias("up"), F.when(F.col(parent).isNull(), 0).otherwise(1).cast("long").alias("depth"))
    # a parent that isn't there ends the chain
    known = rows.select(F.col(key).alias("up"), F.lit(1).alias("_k")).distinct()
    cur = cur.join(known, "up", "left").select("id", F.when(F.col("_k").isNull(), F.col("id")).otherwise(F.col("up")).alias("up"), F.when(F.col("_k").isNull(), 0).otherwise(F.col("depth")).cast("long").alias("depth"))
    seen, n = 1, cur.count()
    while True:
        nxt = cur.select(F.col("id").alias("up"), F.col("up").alias("_u"), F.col("depth").alias("_d"))
        cur = checkpointed(cur.join(nxt, "up").select("id", F.col("_u").alias("up"), (F.col("depth") + F.col("_d")).alias("depth"), (F.col("_d") > 0).alias("_more")))
        if not cur.filter("_more").limit(1).count():
            break
        if seen > n:
            raise ValueError("the parents form a cycle")
        seen *= 2
    return cur.select(F.col("id").alias(key), F.col("up").alias("root"), "depth")


def _regex(glob: str) -> str:
    """A glob for the whole key as a Java regex: case counts, sets in brackets too."""
    return r"\A" + fnmatch.translate(glob)[:-2] + r"\z"


@F.udf(StringType())
def _regex_of(glob):  # of the rule table only, never of the keys
    return None if glob is None else _regex(glob)


def pattern_anchors(patterns: DataFrame) -> DataFrame:
    """Rules with ``side, literal``: what a key must have to match. The longer of the
    letters before the first and after the last wildcard; if these are fewer than three,
    three letters between wildcards; a rule without any letter has side ``all``."""
    p = F.col("pattern")
    head, tail = F.regexp_extract(p, r"^[^*?\[]*", 0), F.regexp_extract(p, r"[^*?\[\]]*\z", 0)
    inner = F.filter(F.split(p, "[*?]", -1), lambda x: F.length(x) >= GRAM)
    gram = F.when(~p.contains("[") & (F.size(inner) > 0), F.left(inner[0], F.lit(GRAM)))
    rows = patterns.select("*", head.alias("_h"), tail.alias("_t"), gram.alias("_g"))
    best = F.greatest(F.length("_h"), F.length("_t"))
    side = F.when((best < GRAM) & F.col("_g").isNotNull(), "gram").when(best == 0, "all").when(F.length("_h") == best, "head").otherwise("tail")
    rows = rows.withColumn("side", side)
    return rows.withColumn("literal", F.when(side == "gram", F.col("_g")).when(side == "head", F.col("_h")).when(side == "tail", F.col("_t")).otherwise("")).drop("_h", "_t", "_g")


def pattern_hits(keys: DataFrame, patterns: DataFrame) -> DataFrame:
    """Every ``key`` with every rule whose glob it matches. Keys are looked up by the
    rules' literals as equal join keys, and only what is found there is matched. Keys are
    dealt over SALTS tasks a literal, so a frequent one is no hot key."""
    rules = pattern_anchors(patterns.filter("pattern is not null")).withColumn("_regex", _regex_of("pattern"))
    sizes = {side: sorted(n) for side, n in rules.groupBy("side").agg(F.collect_set(F.length("literal"))).collect()}  # at most the longest rule's length each
    k, size = F.col("key"), F.length("key")
    anchor = lambda side, x: F.struct(F.lit(side).alias("side"), x.alias("literal"))
    wanted = [F.when(size >= n, anchor("head", F.left(k, F.lit(n)))) for n in sizes.get("head", [])]
    wanted += [F.when(size >= n, anchor("tail", F.right(k, F.lit(n)))) for n in sizes.get("tail", [])]
    wanted += [anchor("all", F.lit(""))] if "all" in sizes else []
    found = F.filter(F.array(*wanted), lambda x: x.isNotNull()) if wanted else F.array().cast("array<struct<side:string,literal:string>>")
    if "gram" in sizes:
        grams = F.when(size >= GRAM, F.array_distinct(F.transform(F.sequence(F.lit(1), size - (GRAM - 1)), lambda i: F.substring(k, i, F.lit(GRAM)))))
        found = F.concat(found, F.transform(F.coalesce(grams, F.array().cast("array<string>")), lambda g: anchor("gram", g)))
    looked = keys.filter(k.isNotNull()).select("*", F.pmod(F.xxhash64(k), F.lit(SALTS)).alias("_salt"), F.explode(found).alias("_a"))
    looked = looked.withColumn("side", F.col("_a.side")).withColumn("literal", F.col("_a.literal")).drop("_a")
    dealt = rules.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>")))
    return looked.join(dealt, ["side", "literal", "_salt"]).filter(F.rlike(k, F.col("_regex"))).drop("side", "literal", "_salt", "_regex")


def pattern_join(keys: DataFrame, patterns: DataFrame, prefer: dict[str, int], deny: list[str], history: list[str]) -> DataFrame:
    """The best key of each slot. ``patterns``: slot, idx, pattern (glob), weight. Of
    a key's patterns in a slot the lowest idx counts, then the largest weight; score is
    1000 - idx + weight + 120 if the pattern is the key + max(0, 80 - 5 rank) + 25 for a
    key of the history; ties go to the preferred, then to the first by name. Keys that
    match a glob of ``deny`` are out; null keys match nothing."""
    allowed = keys
    for glob in deny:
        allowed = allowed.filter(~F.col("key").rlike(_regex(glob)))
    hit = pattern_hits(allowed, patterns)
    first = hit.groupBy("slot", "key").agg(F.min_by(F.struct("idx", "pattern", "weight"), F.struct("idx", -F.col("weight"))).alias("p"))
    rank = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in prefer.items() for x in kv]), F.col("key")), F.lit(999)) if prefer else F.lit(999)
    score = 1000 - F.col("p.idx") + F.col("p.weight") + F.when(F.col("p.pattern") == F.col("key"), 120).otherwise(0) + F.greatest(F.lit(0), 80 - 5 * rank) + F.when(F.col("key").isin(*history), 25).otherwise(0)
    best = first.select("slot", "key", score.alias("score"), rank.alias("rank"))
    return _best(best)


def _best(scored: DataFrame) -> DataFrame:
    first = F.min_by(F.struct("key", "score"), F.struct(-F.col("score"), "rank", "key"))
    return scored.groupBy("slot").agg(first.alias("b")).select("slot", "b.key", "b.score")


def fused_findings(findings: DataFrame, by: list[str], line: str, tolerance: int = 2) -> DataFrame:
    """Findings of one key whose lines follow within the tolerance are one (gaps and
    islands): highest severity, mean confidence, all traces."""
    w = W.partitionBy(*by).orderBy(line)
    new = F.coalesce((F.col(line) - F.lag(line).over(w) > tolerance).cast("int"), F.lit(1))
    x = findings.withColumn("_new", new).withColumn("_i", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    g = x.groupBy(*by, "_i").agg(F.min(line).alias("line"), F.max("severity").alias("severity"), F.avg("confidence").alias("confidence"), F.array_sort(F.collect_set("trace")).alias("trace"), F.count("*").alias("n"))
    return g.drop("_i")


def finding_priority(sev, conf, reach, delta, public, category, secret) -> tuple[Column, Column]:
    """Score and class."""
    score = 1.0 * sev + 0.7 * conf + 0.7 * reach + 0.3 * delta + 0.3 * public + 0.2 * category + 1.2 * secret
    return score, F.when(score >= 1.8, "block").when(score >= 1.2, "review").when(score >= 0.8, "fixable").otherwise("triage")


def arg_max(rows: DataFrame, by: str, value: str, weight: str) -> DataFrame:
    """The value with the largest weight; of equal ones the smallest value."""
    return rows.groupBy(by).agg(F.max_by(value, F.struct(F.col(weight), -F.col(value))).alias(value), F.max(weight).alias(weight))


def conserved(rows: DataFrame, by: str, order: str, z: str, dz: str) -> DataFrame:
    """Whether the steps of a path add up to its end less its start."""
    w = W.partitionBy(by).orderBy(order)
    step = F.when(F.row_number().over(w) > 1, F.col(dz)).otherwise(0)
    g = rows.withColumn("_s", step).groupBy(by).agg(F.sum("_s").alias("total"), (F.max_by(z, order) - F.min_by(z, order)).alias("change"))
    return g.withColumn("conserved", F.abs(F.col("total") - F.col("change")) < 1e-9)
