"""Change tokens: histograms, features, scores, gates, fingerprints, snapshot diffs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from driftloom.functions.exprs import TOPS, clamp01, kind_bucket, lang_bucket, safe_div, top_bucket

# Fixed values.
GATES = (0.25, 0.50, 0.75)
SCORE_WEIGHTS = {"churn": 0.45, "entropy": 0.20, "gini_inv": 0.20, "dens": 0.15}


def token_keys() -> Column:
    """Histogram keys of a token with columns type and file."""
    kind = kind_bucket("type")
    return F.array_compact(F.array(F.concat(F.lit("T:"), "type"), F.concat(F.lit("PATH:"), top_bucket("file")), F.concat(F.lit("LANG:"), lang_bucket("file")), F.when(kind.isNotNull(), F.concat(F.lit("KIND:"), kind))))


def token_filter(tokens: DataFrame, include=(), exclude=(), include_path: str | None = None, exclude_path: str | None = None) -> DataFrame:
    """By type and path."""
    keep = F.lit(True)
    if include:
        keep &= F.col("type").isin(*include)
    if exclude:
        keep &= ~F.col("type").isin(*exclude)
    path = F.coalesce("file", F.lit(""))
    keep &= path.rlike(include_path) if include_path else F.lit(True)
    keep &= ~path.rlike(exclude_path) if exclude_path else F.lit(True)
    return tokens.filter(keep)


def histogram(tokens: DataFrame, by: str = "commit") -> DataFrame:
    """A1: ``by, key, cnt``."""
    return tokens.select(by, F.explode(token_keys()).alias("key")).groupBy(by, "key").agg(F.count("*").alias("cnt"))


def entropy_gini(counts: DataFrame, by: str, cnt: str = "cnt") -> DataFrame:
    """A3, A4: entropy in bits, normalised entropy, impurity and Gini coefficient.

    From three sums a group: of c, c log2 c and c squared; ranks for the coefficient.
    """
    rank = F.row_number().over(W.partitionBy(by).orderBy(cnt))
    x = counts.filter(F.col(cnt) > 0).withColumn("_r", rank)
    s = x.groupBy(by).agg(F.sum(cnt).alias("n"), F.count("*").alias("k"), F.sum(F.col(cnt) * F.log2(cnt)).alias("l"), F.sum(F.col(cnt).cast("double") * F.col(cnt)).alias("q"), F.sum(F.col("_r") * F.col(cnt)).alias("w"))
    h = F.log2("n") - F.col("l") / F.col("n")
    gini = 2 * F.col("w") / (F.col("k") * F.col("n")) - (F.col("k") + 1) / F.col("k")
    return s.select(by, h.alias("entropy"), F.when(F.col("k") > 1, h / F.log2("k")).otherwise(0.0).alias("entropy_norm"), (1 - F.col("q") / (F.col("n") * F.col("n"))).alias("impurity"), gini.alias("gini"))


def features(hist: DataFrame, by: str = "commit") -> DataFrame:
    """A2: the 29 features of each histogram, in one aggregation by ``by``."""
    kind, name = F.substring_index("key", ":", 1), F.expr("substring(key, instr(key, ':') + 1)")
    h = hist.select(by, "cnt", kind.alias("k"), name.alias("t"))
    total = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("cnt"))), F.lit(0)).cast("double")
    is_t, t, cnt = F.col("k") == "T", F.col("t"), F.col("cnt").cast("double")
    s = h.groupBy(by).agg(
        total(is_t).alias("n"),
        F.count(F.when(is_t, 1)).cast("double").alias("distinct_types"),
        total(is_t & (t.startswith("ADD_") | (t == "ΔIMPORT+"))).alias("adds"),
        total(is_t & (t.startswith("DEL_") | (t == "ΔIMPORT-"))).alias("dels"),
        total(is_t & t.startswith("RENAME_")).alias("renames"),
        total(is_t & t.isin("MODIFY_SIG_FN", "MODIFY_BODY_FN", "MODIFY_BODY_CLASS", "MOD_FILE")).alias("modify"),
        total(is_t & t.startswith("ΔIMPORT")).alias("imports"),
        total(is_t & t.isin("ADD_FILE", "DEL_FILE", "MOVE_FILE", "MOD_FILE")).alias("file_ops"),
        F.coalesce(F.sum(F.when(is_t, cnt * F.log2(cnt))), F.lit(0.0)).alias("l"),
        F.coalesce(F.sum(F.when(is_t, cnt * cnt)), F.lit(0.0)).alias("q"),
        F.coalesce(F.max(F.when(is_t, cnt)), F.lit(0.0)).alias("top"),
        total(F.col("k") == "LANG").alias("lang"),
        *[total((F.col("k") == "LANG") & (t == x)).alias(f"lang_{x}") for x in ("py", "other")],
        *[total((F.col("k") == "KIND") & (t == x)).alias(f"kind_{x}") for x in ("fn", "class")],
        total(F.col("k") == "PATH").alias("path"),
        *[total((F.col("k") == "PATH") & (t == x)).alias(f"path_{x}") for x in (*TOPS, "other")],
    )
    churn, files = F.col("adds") + F.col("dels") + F.col("renames") + F.col("modify"), F.greatest(F.col("file_ops"), F.lit(1.0))
    return s.select(
        by,
        F.col("n").alias("tokens_total"),
        "distinct_types",
        *[safe_div(x, "n").alias(y) for x, y in (("adds", "share_add"), ("dels", "share_del"), ("renames", "share_rename"), ("modify", "share_modify"), ("imports", "share_imports"))],
        "file_ops",
        (F.col("n") / files).alias("density"),
        churn.alias("churn"),
        (churn / files).alias("churn_per_file"),
        F.when(F.col("n") > 0, F.log2("n") - F.col("l") / F.col("n")).otherwise(0.0).alias("type_entropy"),
        F.when(F.col("n") > 0, 1 - F.col("q") / (F.col("n") * F.col("n"))).otherwise(0.0).alias("type_gini"),
        safe_div("top", "n").alias("top_type_share"),
        *[safe_div(f"lang_{x}", "lang").alias(f"lang_share_{x}") for x in ("py", "other")],
        *[safe_div(f"kind_{x}", "n").alias(f"kind_share_{x}") for x in ("fn", "class")],
        *[safe_div(f"path_{x}", "path").alias(f"path_share_{x}") for x in (*TOPS, "other")],
    )


def change_score(feats: DataFrame, weights: dict | None = None) -> DataFrame:
    """A5 on the output of :func:`features`; weights replace single defaults."""
    w = SCORE_WEIGHTS | (weights or {})
    churn = clamp01(safe_div("churn", F.greatest(F.lit(8.0), F.col("tokens_total"))))
    dens = clamp01(F.col("file_ops") / 16)
    entropy = clamp01(F.when(F.col("distinct_types") > 1, F.col("type_entropy") / F.log2("distinct_types")).otherwise(0.0))
    score = clamp01(w["churn"] * churn + w["entropy"] * entropy + w["gini_inv"] * clamp01(1 - F.col("type_gini")) + w["dens"] * dens)
    return feats.withColumn("score", score)


def escalated(score: Column, sig: Column, body: Column, renames: Column) -> Column:
    """A5: floors of .70 and .55."""
    low = F.when((body >= 5) | (renames >= 3), 0.55).otherwise(0.0)
    return F.greatest(score, F.when(sig >= 1, 0.70).otherwise(0.0), low)


def gate(score: Column, sig: Column, renames: Column, cuts: tuple = GATES) -> Column:
    """I1 to I4; signature changes are I4, five renames I3 at least."""
    by_score = F.when(score < cuts[0], "I1").when(score < cuts[1], "I2").when(score < cuts[2], "I3").otherwise("I4")
    return F.when(sig >= 1, "I4").when(renames >= 5, F.greatest(by_score, F.lit("I3"))).otherwise(by_score)


def weighted_risk(hist: DataFrame, weights: DataFrame, by: str, churn: str = "churn", psnr: str = "psnr", ssim: str = "ssim") -> DataFrame:
    """Risk from token weights (missing: 1), churn and image quality."""
    x = hist.join(weights, "token", "left").groupBy(by).agg(F.sum(F.coalesce("weight", F.lit(1.0)) * F.col("cnt")).alias("w"), F.sum("cnt").alias("n"), F.max(churn).alias("c"), F.max(psnr).alias("p"), F.max(ssim).alias("s"))
    tokens = F.least(F.lit(1.0), safe_div("w", "n") / 2.5)
    quality = 0.1 * F.when(F.col("p") < 20, 1.0).otherwise(0.0) + 0.1 * F.when(F.col("s").isNull(), 0.0).otherwise(1 - clamp01("s"))
    return x.select(by, clamp01(0.5 * tokens + 0.3 * F.least(F.lit(1.0), F.col("c") / 200) + quality).alias("risk"))


def report_risk(sig, imports, psnr, ssim) -> Column:
    """Risk from signature and import counts and image quality."""
    p = F.coalesce(psnr, F.lit(50.0))
    ramp = F.when(p >= 40, 0.0).when(p <= 20, 1.0).otherwise((40 - p) / 20)
    return clamp01(0.6 * F.least(F.lit(1.0), (sig + imports) / 100) + 0.2 * ramp + 0.2 * clamp01(1 - F.coalesce(ssim, F.lit(1.0))))


def decision(score: Column, alpha: float = 0.85, beta: float = 0.92, z: float = 0.99) -> Column:
    """Ok, review, block or hard-block."""
    return F.when(score > z, "hard-block").when(score > beta, "block").when(score > alpha, "review").otherwise("ok")


def diff_churn(lines: DataFrame, by: str, line: str = "line") -> DataFrame:
    """A10: added and deleted lines, file headers left out; hunks."""
    x = F.col(line)
    return lines.groupBy(by).agg(F.count_if(x.startswith("+") & ~x.startswith("+++ ")).alias("adds"), F.count_if(x.startswith("-") & ~x.startswith("--- ")).alias("dels"), F.count_if(x.startswith("@@")).alias("hunks"))


def fingerprint(pairs: DataFrame, by: str, key: str = "key", value: str = "cnt", chars: int = 16) -> DataFrame:
    """SHA-256 of the sorted ``k=v`` joined by semicolons, in any row order."""
    items = F.array_sort(F.collect_list(F.concat_ws("=", key, F.col(value).cast("string"))))
    return pairs.groupBy(by).agg(F.left(F.sha2(F.array_join(items, ";"), 256), F.lit(chars)).alias("fingerprint"))


def snapshot_diff(prev: DataFrame, curr: DataFrame, keys: list[str], sig: str = "sig", body: str = "body") -> DataFrame:
    """Keys with what changed: ADD, DEL, MODIFY_SIG, MODIFY_BODY (both: two rows)."""
    p = prev.select(*keys, F.col(sig).alias("_ps"), F.col(body).alias("_pb"), F.lit(True).alias("_p"))
    n = curr.select(*keys, F.col(sig).alias("_ns"), F.col(body).alias("_nb"), F.lit(True).alias("_n"))
    both = F.col("_p").isNotNull() & F.col("_n").isNotNull()
    changes = F.array_compact(F.array(F.when(F.col("_p").isNull(), "ADD"), F.when(F.col("_n").isNull(), "DEL"), F.when(both & ~F.col("_ps").eqNullSafe(F.col("_ns")), "MODIFY_SIG"), F.when(both & ~F.col("_pb").eqNullSafe(F.col("_nb")), "MODIFY_BODY")))
    return p.join(n, keys, "full_outer").select(*keys, F.explode(changes).alias("change"))


def renames(prev: DataFrame, curr: DataFrame, by: list[str], key: str, body: str) -> DataFrame:
    """Keys gone and keys new with one body; of several old keys the last counts."""
    gone = prev.join(curr.select(*by, key), [*by, key], "left_anti").groupBy(*by, body).agg(F.max(key).alias("old_key"))
    new = curr.join(prev.select(*by, key), [*by, key], "left_anti")
    return new.join(gone, [*by, body]).select(*by, "old_key", F.col(key).alias("new_key"))


def without_renamed(diff: DataFrame, renamed: DataFrame, by: list[str], key: str) -> DataFrame:
    """Additions and deletions that a rename explains are dropped."""
    rest = diff.join(renamed.select(*by, F.col("new_key").alias(key), F.lit("ADD").alias("change")), [*by, key, "change"], "left_anti")
    return rest.join(renamed.select(*by, F.col("old_key").alias(key), F.lit("DEL").alias("change")), [*by, key, "change"], "left_anti")


def label_diff(base: DataFrame, head: DataFrame, keys: list[str], cnt: str = "cnt") -> DataFrame:
    """Counts added, deleted and kept by label."""
    b, h = base.withColumnRenamed(cnt, "_b"), head.withColumnRenamed(cnt, "_h")
    b0, h0 = F.coalesce("_b", F.lit(0)), F.coalesce("_h", F.lit(0))
    return b.join(h, keys, "full_outer").select(*keys, F.greatest(F.lit(0), h0 - b0).alias("added"), F.greatest(F.lit(0), b0 - h0).alias("deleted"), F.least(b0, h0).alias("same"))


def structure_score(labels: DataFrame, weights: DataFrame, by: list[str]) -> DataFrame:
    """S and H as weighted label counts, Z the depth, alpha and beta their shares."""
    s = labels.join(weights, "label", "left").groupBy(*by).agg(F.sum(F.coalesce("w_s", F.lit(0)) * F.col("cnt")).alias("S"), F.sum(F.coalesce("w_h", F.lit(0)) * F.col("cnt")).alias("H"), F.greatest(F.lit(1), F.max("depth")).alias("Z"))
    n = F.greatest(F.lit(1), F.col("S") + F.col("H"))
    return s.withColumn("alpha", F.col("S") / n).withColumn("beta", F.col("H") / n)


def merged_deltas(base: DataFrame, head: DataFrame, key: str, by: str) -> DataFrame:
    """Structure change by file, merged by group with weighted shares."""
    b, h = base.select(by, key, *[F.col(x).alias(f"b{x}") for x in "SHZ"]), head.select(by, key, *[F.col(x).alias(f"h{x}") for x in "SHZ"])
    j = b.join(h, [by, key])
    wb, wh = F.greatest(F.lit(1), F.col("bS") + F.col("bH")), F.greatest(F.lit(1), F.col("hS") + F.col("hH"))
    return j.groupBy(by).agg(*[F.sum(F.col(f"h{x}") - F.col(f"b{x}")).alias(f"d{x}") for x in "SHZ"], (F.sum("hS") / F.sum(wh) - F.sum("bS") / F.sum(wb)).alias("dalpha"), F.count("*").alias("files"))


def fused_tokens(tokens: DataFrame, lines: int = 5, cap: int = 8) -> DataFrame:
    """Tokens of one uid, kind, file and line bucket as one."""
    at = F.floor(F.col("line") / lines) * lines
    return tokens.groupBy("uid", "kind", "file", at.alias("line_bucket")).agg(F.max("severity").alias("severity"), F.avg("confidence").alias("confidence"), F.slice(F.array_sort(F.collect_set("evidence")), 1, cap).alias("evidence"), F.max("weight").alias("weight"))


def rewritten_tokens(tokens: DataFrame) -> DataFrame:
    """Of ordered tokens of a uid, ADD and DEL cancel in pairs; renames collapse to
    first and last name; repeated signature changes are one."""
    g = tokens.groupBy("uid").agg(
        (F.count_if(F.col("kind") == "ADD") - F.count_if(F.col("kind") == "DEL")).alias("net"),
        F.min_by("old_name", F.when(F.col("kind") == "RENAME", F.col("seq"))).alias("first_name"),
        F.max_by("new_name", F.when(F.col("kind") == "RENAME", F.col("seq"))).alias("last_name"),
        F.bool_or(F.col("kind") == "MODIFY_SIG").alias("sig"),
    )
    return g.withColumn("renamed", F.col("first_name").isNotNull() & (F.col("first_name") != F.col("last_name")))


def diff_summary(files: DataFrame, by: list[str]) -> DataFrame:
    """Files, status counters and line sums."""
    status = [F.count_if(F.col("status") == s).alias(f"n_{s}") for s in "AMDRC"]
    return files.groupBy(*by).agg(F.count_distinct("path").alias("files"), *status, F.sum("adds").alias("adds"), F.sum("dels").alias("dels"), (F.sum("adds") + F.sum("dels")).alias("delta"), (F.sum("adds") - F.sum("dels")).alias("net"))


def _let(x: Column, f: Callable[[Column], Column]) -> Column:
    """``f(x)`` with x worked out once: in a lambda's body Spark works out an expression
    anew for each element and each mention."""
    return F.transform(F.array(x), f)[0]


def source_tokens(old: Column, new: Column) -> Column:
    """Tokens of two text versions by patterns: added imports, functions added or
    removed, functions with other arguments (the last definition of a name counts). Each text
    is read once a pattern, and the functions of both are sorted by name, so that the work
    grows with the text, not with the square of its functions."""
    names = r"(?m)^[ \t]*(?:async[ \t]+)?def[ \t]+(\w+)[ \t]*\(([^)]*)\)"
    part = lambda x, k: F.regexp_extract(x, names, k)
    imports = lambda x: F.array_distinct(F.transform(F.regexp_extract_all(x, F.lit(r"(?m)^[ \t]*((?:import|from)[ \t]+[^\n#]+)"), F.lit(1)), lambda v: F.trim(v)))
    functions = lambda x, side: F.transform(F.regexp_extract_all(x, F.lit(names), F.lit(0)), lambda v, k: F.struct(part(v, 1).alias("name"), F.lit(side).alias("side"), k.alias("k"), part(v, 2).alias("args")))
    token = lambda kind, xs: F.transform(xs, lambda x: F.struct(F.lit(kind).alias("type"), x.alias("target")))
    # an index outside the array is null, which no name equals
    last = lambda xs: F.filter(xs, lambda x, k: ~(F.get(xs, k + 1)["name"].eqNullSafe(x["name"]) & F.get(xs, k + 1)["side"].eqNullSafe(x["side"])))

    def tokens(xs: Column) -> Column:
        """``xs``: of each name its last definition in the old text, then that in the new."""
        twin = lambda k: F.get(xs, k)["name"]
        kinds = {
            "ADD_FN": lambda x, k: (x["side"] == 1) & ~twin(k - 1).eqNullSafe(x["name"]),
            "DEL_FN": lambda x, k: (x["side"] == 0) & ~twin(k + 1).eqNullSafe(x["name"]),
            "MODIFY_SIG": lambda x, k: (x["side"] == 0) & twin(k + 1).eqNullSafe(x["name"]) & (F.get(xs, k + 1)["args"] != x["args"]),
        }
        placed = [F.sort_array(F.transform(F.filter(xs, keep), lambda x: F.struct(x["k"].alias("k"), x["name"].alias("name")))) for keep in kinds.values()]
        return F.concat(*[token(kind, F.transform(p, lambda x: x["name"])) for kind, p in zip(kinds, placed, strict=True)])

    def both(v: Column) -> Column:
        return F.concat(token("ΔIMPORT", F.array_except(imports(v["new"]), imports(v["old"]))), _let(F.sort_array(F.concat(functions(v["old"], 0), functions(v["new"], 1))), lambda xs: _let(last(xs), tokens)))

    return _let(F.struct(old.alias("old"), new.alias("new")), both)


@F.arrow_udtf(returnType="key string")
class RowKeys:
    """The keys of rows of ``kind, bucket`` as a table function of a table, for
    vocabularies of one's own. It works on Arrow batches, not rows; Spark allows such a
    function on a table argument, not on the right of a lateral join. Nulls have no key.
    Those of :func:`token_keys` need no Python and are the faster way."""

    def eval(self, rows: pa.RecordBatch) -> Iterator[pa.Table]:
        kind, bucket = rows.column("kind").drop_null().cast(pa.string()), rows.column("bucket").drop_null().cast(pa.int64())
        first = pc.list_element(pc.split_pattern(kind, "_", max_splits=1), 0)
        rest = pc.subtract(bucket, pc.multiply(pc.divide(bucket, 10), 10))
        rest = pc.if_else(pc.less(rest, 0), pc.add(rest, 10), rest)
        for head, values in (("T:", kind), ("KIND:", first), ("U:", rest.cast(pa.string()))):
            yield pa.table({"key": pc.binary_join_element_wise(head, values, "")})
