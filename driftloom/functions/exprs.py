"""Column expressions: guards, paths, patterns, validation, tags (all JVM-side)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
TOPS = ("app", "core", "analysis", "mosaic", "delta", "docs", "tests", "bench", "io", "spec")
KINDS_BY_LEVEL = {"project": ("module", "file"), "module": ("module", "file"), "file": ("file", "func"), "func": ("func",), "bus": ("topic", "file"), "custom": ("module", "file", "func", "topic")}
STATUS_SCORE = {"A": 0.75, "M": 0.70, "R": 0.60, "C": 0.55, "D": 0.50}

c = lambda x: F.col(x) if isinstance(x, str) else x


def clamp01(x) -> Column:
    """Into [0, 1]; NaN, infinities and null are 0."""
    x = c(x)
    bad = x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.when(bad, 0.0).otherwise(F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0)))


def safe_div(a, b) -> Column:
    """0 where the divisor is 0 or null."""
    return F.coalesce(F.try_divide(c(a).cast("double"), c(b).cast("double")), F.lit(0.0))


def nan_safe(x) -> Column:
    """NaN and -Inf are 0, +Inf is 1."""
    x = c(x)
    return F.when(F.isnan(x) | (x == float("-inf")), 0.0).when(x == float("inf"), 1.0).otherwise(x)


def top_bucket(path) -> Column:
    """First directory if it is a known one, else other."""
    top = F.substring_index(F.ltrim(c(path), F.lit("/")), "/", 1)
    return F.when(top.isin(*TOPS), top).otherwise("other")


def lang_bucket(path) -> Column:
    return F.when(F.endswith(c(path), F.lit(".py")), "py").otherwise("other")


def kind_bucket(kind) -> Column:
    return F.when(F.endswith(c(kind), F.lit("_FN")), "fn").when(F.endswith(c(kind), F.lit("_CLASS")), "class")


def module_id(path) -> Column:
    """P10: dotted module of a path."""
    bare = F.regexp_replace(F.regexp_replace(c(path), r"\.py$", ""), r"/__init__$", "")
    return F.concat(F.lit("module:"), F.replace(bare, F.lit("/"), F.lit(".")))


def extension(path) -> Column:
    """P10: lower-case extension without the dot; empty if there is none."""
    name = F.substring_index(c(path), "/", -1)
    return F.lower(F.regexp_extract(name, r"^.+\.([^.]*)$", 1))


def first_segment(path) -> Column:
    return F.substring_index(c(path), "/", 1)


def any_match(x, patterns: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [c(x).rlike(f"(?i){p}") for p in patterns], F.lit(False))


def path_wanted(path, include: list[str] = (), exclude: list[str] = (), ignore: list[str] = ()) -> Column:
    """Exclude wins; ignored paths need an include; includes restrict."""
    included = any_match(path, include)
    kept = (~any_match(path, ignore) | included) & (included if include else F.lit(True))
    return ~any_match(path, exclude) & kept


def prefix_suffix(path, filters: list[str]) -> Column:
    """Filters that begin with a dot are suffixes, others prefixes; any suffices."""
    tests = [F.endswith(c(path), F.lit(f)) if f.startswith(".") else F.startswith(c(path), F.lit(f)) for f in filters]
    return reduce(lambda a, b: a | b, tests, F.lit(not filters))


def glob_regex(pattern: str) -> str:
    special = {"*": ".*", "?": "."}
    return "^" + "".join(special.get(x, "\\" + x if not x.isalnum() else x) for x in pattern) + "$"


def node_matches(pattern: str, *columns) -> Column:
    """P5: glob or regex search over several columns; an empty pattern matches none."""
    if not pattern:
        return F.lit(False)
    tests = [c(x).rlike(glob_regex(pattern)) | F.coalesce(c(x).rlike(pattern), F.lit(False)) for x in columns]
    return F.coalesce(reduce(lambda a, b: a | b, tests), F.lit(False))


def allowed_kinds(kind, level: str) -> Column:
    """Node kinds that a level looks at."""
    return c(kind).isin(*KINDS_BY_LEVEL[level])


def range_base(x) -> Column:
    """Left side of A..B; of a single ref its parent."""
    return F.when(F.instr(c(x), "..") > 0, F.split(c(x), r"\.\.", 2)[0]).otherwise(F.concat(c(x), F.lit("~1")))


def range_head(x) -> Column:
    return F.when(F.instr(c(x), "..") > 0, F.split(c(x), r"\.\.", 2)[1]).otherwise(c(x))


def edge_score(path, status) -> Column:
    """P20: base by status, .10 for Python, .02 a level of depth up to .15."""
    base = reduce(lambda acc, kv: acc.when(c(status) == kv[0], kv[1]), list(STATUS_SCORE.items())[1:], F.when(c(status) == "A", STATUS_SCORE["A"])).otherwise(0.60)
    depth = F.size(F.split(c(path), "/")) - 1
    return clamp01(base + F.when(F.endswith(c(path), F.lit(".py")), 0.10).otherwise(0.0) + F.least(F.lit(0.15), 0.02 * depth))


def in_rect(x, y, x0: int, y0: int, x1: int, y1: int) -> Column:
    """Half-open rectangle."""
    return (c(x) >= x0) & (c(x) < x1) & (c(y) >= y0) & (c(y) < y1)


def in_circle(x, y, cx: float, cy: float, r: float) -> Column:
    return F.lit(r > 0) & (F.pow(c(x) - cx, 2) + F.pow(c(y) - cy, 2) <= r * r)


def redacted(x, pattern: str) -> Column:
    """Matches replaced by a mark."""
    return F.regexp_replace(c(x), pattern, "[REDACTED]")


def fingerprints(x, pattern: str) -> Column:
    """A digest of each match that :func:`redacted` takes out, in order."""
    return F.transform(F.regexp_extract_all(c(x), F.lit(pattern), F.lit(0)), lambda v: F.sha2(v, 256))


def line_tags(x, mark: str = "tag:") -> Column:
    """Tags ``# <mark>key=value`` of a line, several of them: key, value and column."""
    pattern = rf"#\s*{mark}([\w.]+)\s*=\s*([^#\n]*)"
    pieces = F.split(c(x), pattern, -1)
    found = F.arrays_zip(*[F.regexp_extract_all(c(x), F.lit(pattern), F.lit(k)).alias(n) for k, n in ((0, "all"), (1, "key"), (2, "value"))])
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<key:string,value:string,col:int>>").alias("out"))

    def step(acc: Column, p: Column) -> Column:
        at = acc["at"] + F.length(p["p"])
        one = F.struct(p["m"]["key"].alias("key"), F.trim(p["m"]["value"]).alias("value"), (at + 1).alias("col"))
        return F.struct((at + F.length(p["m"]["all"])).alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

    pairs = F.zip_with(F.slice(pieces, F.lit(1), F.size(found)), found, lambda p, m: F.struct(p.alias("p"), m.alias("m")))
    return F.aggregate(pairs, start, step, lambda acc: acc["out"])


def normalised_text(x) -> Column:
    """Line ends as LF, no blanks at line ends."""
    return F.regexp_replace(F.regexp_replace(c(x), r"\r\n?", "\n"), r"(?m)[ \t]+$", "")


def parsed_ts(x, default=None) -> Column:
    """ISO time, Z is UTC; what can't be parsed is the default (now)."""
    return F.coalesce(F.try_to_timestamp(F.regexp_replace(c(x), "Z$", "+00:00")), default if default is not None else F.current_timestamp())


def tag_value(x) -> Column:
    """Kind of a tag's value and its items: json, pair (A->B), list or raw."""
    x = F.trim(c(x))
    kind = F.when(F.try_parse_json(x).isNotNull() & x.rlike(r'^[\[{"]'), "json").when(x.contains("->"), "pair").when(x.contains(","), "list").otherwise("raw")
    items = F.when(kind == "pair", F.split(x, "->", 2)).when(kind == "list", F.split(x, ",")).otherwise(F.array(x))
    return F.struct(kind.alias("kind"), F.filter(F.transform(items, lambda v: F.trim(v)), lambda v: v != "").alias("items"))


# Required paths of a payload, and their JSON types, by topic.
PAYLOADS = {
    "analytics.delta.ready": (("delta_report", "object"), ("paths", "object"), ("paths.metrics", "string")),
    "analytics.invariants.violation": (("level", "string"), ("score", "number"), ("delta_report", "object")),
    "analytics.scope.ready": (("level", "string"), ("graph", "object")),
    "core.mosaic.ready": (("grid", "object"), ("rows", "number"), ("cols", "number")),
}


def payload_errors(topic, payload, rules: dict = PAYLOADS) -> Column:
    """What is wrong with a payload of a topic; empty if nothing is."""
    v = F.try_parse_json(c(payload))
    is_object = F.coalesce(F.startswith(F.schema_of_variant(v), F.lit("OBJECT")), F.lit(False))
    starts = {"object": "OBJECT", "string": "STRING", "number": "(BIGINT|DOUBLE|DECIMAL|INT|FLOAT)", "boolean": "BOOLEAN"}
    tests = []
    for name, fields in rules.items():
        for path, kind in fields:
            got = F.schema_of_variant(F.try_variant_get(v, f"$.{path}", "variant"))
            missing = got.isNull() | (got == "VOID")
            tests.append(F.when((c(topic) == name) & is_object & missing, F.lit(f"missing {path}")))
            tests.append(F.when((c(topic) == name) & is_object & ~missing & ~got.rlike(f"^{starts[kind]}"), F.lit(f"{path} is not {kind}")))
    head = [F.when(~c(topic).isin(*rules), F.lit("unknown topic")), F.when(~is_object, F.lit("payload is not an object"))]
    return F.array_compact(F.array(*head, *tests))
