"""Personal data by bootstrapped contextual extraction, in DataFrame functions only.

1. Base spans of four kinds are found by their formats; these entities are the seeds.
2. Each identifier (seed, or one of another shape: digit groups, spelt-out addresses,
   groups between colons) has lexical patterns: the word to its left, the two words to its
   left, and the word to its right, in lower case with digits masked. Patterns and
   instances form a graph, stored as distinct pairs.
3. Patterns and instances are scored in turns by grouped sums until nothing rises any
   more. A pattern's confidence for a kind is the share of its instances that are believed
   to be of that kind; an instance of no known format is believed as far as the patterns
   that hold it. What one pattern finds is thus the evidence that induces further ones.
4. Patterns of high confidence give their kind to the instances of unknown format beside
   them, which are added to the spans; of several kinds the one of most confidence counts,
   and at a tie the first as listed.

A context has the 40 characters nearest to the identifier and ends at the last or next
match of the same shape; a longer word counts by what of it is in there.

Results for special cases: null and empty texts have no spans; repeated rows each have
their row; in a null ``doc_id`` nothing changes, as rows aren't looked up by doc_id; long
texts are read whole, in time by their length and n log n in their matches; further columns are ignored by :func:`find` and kept by
:func:`redact`; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftloom.llm.common import packed, saved, stored, unpacked

KINDS = ("email", "ip", "card", "phone")
#: The four formats, possessive where giving back can't help: the engine then repeats
#: groups in a loop, not by recursion, so that long runs don't exhaust its stack. Where
#: a run of letters or digits can only match from its start, the look-behind says so,
#: which spares the regex engine a try at every letter.
FORMATS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){15,}+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: What a text must hold for a format to be possible.
HINTS = {"email": "@", "ip": r"[0-9]\.[0-9]+\.[0-9]", "card": "[0-9](?:[ -]?[0-9]){15}", "phone": r"\+"}
#: Identifiers of unknown format, by shape: digit groups of 7 digits or more, addresses
#: with their signs spelt out, and groups between colons; and what a text must hold.
OTHERS = {
    "digits": (r"(?<![0-9A-Za-z+.@-])[0-9](?:[ .()/-]{0,2}[0-9]){6,}+(?![A-Za-z@])", "[0-9](?:[ .()/-]{0,2}[0-9]){6}"),
    "spelt": (r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?: ?[\[(]at[\])] ?| at )[A-Za-z0-9-]++(?:(?: ?[\[(]dot[\])] ?| dot |\.)[A-Za-z0-9-]++)++", r"[\[(]at[\])]| at [A-Za-z0-9-]+(?: ?[\[(]dot| dot |\.)"),
    "colons": (r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{0,4}+:){2,7}+[0-9A-Fa-f]{0,4}+(?![0-9A-Za-z:])", "[0-9A-Fa-f]:[0-9A-Fa-f]*:"),
}
#: A pattern counts with so many believed instances of a kind, by where it stands, and
#: gives its kind away at this confidence; it is evidence from EVIDENCE on. Scores count
#: as settled once all beliefs together rise by less than SETTLED.
MIN_SEEDS, MIN_CONFIDENCE, EVIDENCE, SETTLED = {"left": 5, "two": 5, "right": 20}, 0.9, 0.5, 0.01
CONTEXT_CHARS, SALTS = 40, 16


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    """Whether the digits pass the Luhn test (from the right, every second one doubled)."""
    digits = F.reverse(_digits(value))
    at = F.sequence(F.lit(1), F.length(digits))
    digit = lambda i: F.substring(digits, i, 1).cast("int")
    points = F.transform(at, lambda i: F.when(i % 2 == 0, digit(i) * 2 - F.when(digit(i) > 4, 9).otherwise(0)).otherwise(digit(i)))
    return F.aggregate(points, F.lit(0), lambda a, x: a + x) % 10 == 0


def _holds(kind: str, value: Column) -> Column:
    if kind == "ip":
        part = F.split(value, r"\.")
        return F.forall(part, lambda p: p.rlike("^0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})$"))
    if kind == "card":
        return (F.length(_digits(value)).between(16, 19)) & _luhn(value)
    if kind == "phone":
        return F.length(_digits(value)).between(8, 15)
    return F.lit(True)


def _valid(kind: str) -> Callable[[Column], Column]:
    return lambda s: _holds(kind, s["value"])


def _is(kind: str) -> Callable[[Column], Column]:
    return lambda s: s["kind"] == kind


NO_SPANS = "array<struct<kind:string,start:int,end:int,value:string,before:string,after:string>>"


def _running(values: Column, join: Callable[[Column, Column], Column]) -> Column:
    """Running sums (or maxima) of an array: in round k each place takes in the one 2^k
    before it, so n values take n log n steps and no list is copied for each of them."""
    rounds = F.sequence(F.lit(0), F.floor(F.log2(F.greatest(F.size(values), F.lit(1)))).cast("int"))

    def step(acc: Column, k: Column) -> Column:
        back = F.call_function("shiftleft", F.lit(1), k)
        return F.transform(acc, lambda x, i: F.when(i < back, x).otherwise(join(x, F.get(acc, i - back))))

    return F.aggregate(rounds, values, step)


def _with_matches(df: DataFrame, name: str, kind: str, pattern: str, hint: Column) -> DataFrame:
    """Adds ``name``: the matches in order as structs of kind, start, end (code points),
    value and the text just before and after. The pieces between the matches give the places, as
    their lengths add up. Found and pieces are columns of their own, else Catalyst would
    repeat the search wherever they are used."""
    found = F.when(hint, F.regexp_extract_all("_text", F.lit(pattern), F.lit(0)))
    df = df.withColumn("_found", found)
    df = df.withColumn("_pieces", F.when(F.size("_found") > 0, F.split("_text", pattern, -1)))
    n = F.size("_found")
    ahead = F.slice("_pieces", F.lit(1), n)
    near = F.zip_with(ahead, F.slice("_pieces", F.lit(2), n), lambda p, q: F.struct(F.right(p, F.lit(CONTEXT_CHARS)).alias("p"), F.left(q, F.lit(CONTEXT_CHARS)).alias("q")))
    pairs = F.zip_with(near, "_found", lambda x, m: F.struct(x["p"].alias("p"), x["q"].alias("q"), m.alias("m")))
    ends = _running(F.zip_with(ahead, "_found", lambda p, m: F.length(p) + F.length(m)), lambda x, y: x + y)

    def span(x: Column, end: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), (end - F.length(x["m"])).alias("start"), end.alias("end"), x["m"].alias("value"), x["p"].alias("before"), x["q"].alias("after"))

    spans = F.when(F.col("_pieces").isNotNull(), F.zip_with(pairs, ends, span))
    return df.withColumn(name, F.coalesce(spans, F.array().cast(NO_SPANS))).drop("_found", "_pieces")


def _outside(others: Column, base: Column) -> Column:
    """The spans of ``others`` that meet none of ``base``. All are put in order of their
    starts; a base span that starts no later is met if the largest end so far lies behind
    the start, one that starts later if the next base start lies before the end."""
    late = F.lit(2**31 - 1)
    known = F.transform(base, lambda s: F.struct(s["start"].alias("start"), F.lit(0).alias("other"), s.alias("span")))
    rows = F.array_sort(F.concat(known, F.transform(others, lambda s: F.struct(s["start"].alias("start"), F.lit(1).alias("other"), s.alias("span")))))

    def free(r: Column) -> Column:
        ends = _running(F.transform(r, lambda x: F.when(x["other"] == 0, x["span"]["end"]).otherwise(0)), F.greatest)
        nexts = F.reverse(_running(F.transform(F.reverse(r), lambda x: F.when(x["other"] == 0, x["start"]).otherwise(late)), F.least))
        beside = F.zip_with(ends, nexts, lambda e, n: F.struct(e.alias("e"), n.alias("n")))
        kept = F.zip_with(r, beside, lambda x, y: F.when((x["other"] == 1) & (y["e"] <= x["start"]) & (y["n"] >= x["span"]["end"]), x["span"]))
        return F.filter(kept, lambda s: s.isNotNull())

    return F.transform(F.array(rows), free)[0]  # sorted once, for all uses


def _masked(words: Column) -> Column:
    return F.regexp_replace(F.lower(words), "[0-9]", "#")


def _patterns(e: Column) -> Column:
    """Lexical patterns of an identifier, as structs of side and words."""
    found = {"left": F.regexp_extract(e["before"], r"(\S+)\s*$", 1), "two": F.regexp_extract(e["before"], r"(\S+\s+\S+)\s*$", 1), "right": F.regexp_extract(e["after"], r"^\s*(\S+)", 1)}
    every = F.array(*[F.struct(F.lit(side).alias("side"), _masked(words).alias("words")) for side, words in found.items()])
    return F.filter(every, lambda p: p["words"].rlike("[a-z]{2}|[^\\x00-\\x7F]"))


def _instance(e: Column) -> Column:
    """What an identifier is known by: digits for numbers, else the value itself."""
    return F.when(e["kind"].isin("email", "ip") | e["value"].rlike("[A-Za-z]"), F.lower(e["value"])).otherwise(_digits(e["value"]))


def _joined(spans: Column) -> Column:
    """``kind:start:end`` comma-joined, by kind as listed and then start."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(_rank(s["kind"]).alias("k"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _rank(kind: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, KINDS)), kind)


def spans_of(docs: DataFrame) -> DataFrame:
    """``docs`` with ``base`` (spans of the four formats), ``other`` (identifiers of
    unknown format outside them) and ``key``, by which texts with such are looked up."""
    out = docs.withColumn("_text", F.coalesce("text", F.lit("")))
    for kind in KINDS:
        out = _with_matches(out, f"_{kind}", kind, FORMATS[kind], F.col("_text").rlike(HINTS[kind]))
        out = out.withColumn(f"_{kind}", F.filter(f"_{kind}", _valid(kind)))
    out = out.withColumn("base", F.concat(*[f"_{k}" for k in KINDS]))
    for shape, (pattern, hint) in OTHERS.items():
        out = _with_matches(out, f"_{shape}", "other", pattern, F.col("_text").rlike(hint))
    out = out.withColumn("_other", F.concat(*[f"_{shape}" for shape in OTHERS]))
    mixed = (F.size("_other") > 0) & (F.size("base") > 0)
    out = out.withColumn("other", F.when(mixed, _outside(F.col("_other"), F.col("base"))).otherwise(F.col("_other")))
    key = F.when(F.size("other") > 0, F.sha2("_text", 256)).otherwise(F.xxhash64("_text").cast("string"))
    return out.withColumn("key", key).drop("_text", "_other", *[f"_{k}" for k in (*KINDS, *OTHERS)])


def _salted(rows: DataFrame, scores: DataFrame) -> DataFrame:
    """Rows with the scores of their pattern; a word that many instances stand beside is
    dealt to several tasks."""
    salted = scores.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64("value"), F.lit(SALTS)).cast("int")).join(salted, ["pattern", "salt"]).drop("salt")


def pattern_scores(graph: DataFrame) -> DataFrame:
    """``pattern, kind, confidence`` of the patterns of high confidence.

    ``graph``: distinct ``pattern`` (side and words), ``value, kind``, the kind ``other``
    for instances of unknown format. A round is a join and a sum on patterns and one of
    each on instances; beliefs never fall, so the rounds end.
    """
    least = F.coalesce(*[F.when(F.col("pattern.side") == side, n) for side, n in MIN_SEEDS.items()])
    pairs = graph.select("pattern", "value").distinct()
    totals = stored(pairs.groupBy("pattern").agg(F.count("*").alias("total")).filter(F.col("total") >= least))
    seeds = graph.filter("kind <> 'other'").select("value", "kind").distinct()
    seeded = stored(pairs.join(seeds, "value").groupBy("pattern", "kind").agg(F.count("*").cast("double").alias("sure")))
    # instances of no known format that a pattern with a chance has; their beliefs change
    open_ = stored(pairs.join(seeds, "value", "left_anti").join(totals.select("pattern"), "pattern", "left_semi"))
    belief, sum_before = None, 0.0
    while True:
        support = seeded
        if belief is not None:
            won = open_.join(belief, "value").groupBy("pattern", "kind").agg(F.sum("belief").alias("won"))
            support = seeded.join(won, ["pattern", "kind"], "full").select("pattern", "kind", (F.coalesce("sure", F.lit(0.0)) + F.coalesce("won", F.lit(0.0))).alias("sure"))
        scores = support.filter(F.col("sure") >= least - 1e-6).join(totals, "pattern").select("pattern", "kind", F.round(F.col("sure") / F.col("total"), 9).alias("confidence"))
        scores = stored(scores)
        # an instance is of a kind unless every pattern that holds it is wrong
        hold = _salted(open_, scores.filter(F.col("confidence") > EVIDENCE))
        belief = stored(hold.groupBy("value", "kind").agg((1 - F.exp(F.sum(F.log(1.000000001 - F.col("confidence"))))).alias("belief")))
        sum_now = belief.agg(F.sum("belief")).first()[0] or 0.0
        if sum_now - sum_before < SETTLED:
            return scores.filter(F.col("confidence") >= MIN_CONFIDENCE)
        sum_before = sum_now


def discovered(found: DataFrame) -> DataFrame:
    """``key, new``: the spans that confident patterns add to a text, from rows with
    base, other and key. Equal texts have one key and one row."""
    entity = F.explode(F.concat("base", "other"))
    graph = found.filter(F.size("base") + F.size("other") > 0).select(entity.alias("e"))
    graph = graph.select(F.explode(_patterns(F.col("e"))).alias("pattern"), _instance(F.col("e")).alias("value"), F.col("e.kind").alias("kind")).distinct()
    good = pattern_scores(stored(graph))
    texts = found.filter(F.size("other") > 0).groupBy("key").agg(F.first("other").alias("other"))
    unseen = texts.select("key", F.explode("other").alias("e")).select("key", F.explode(_patterns(F.col("e"))).alias("pattern"), "e.start", "e.end", F.xxhash64("key", "e.start").alias("value"))
    named = _salted(unseen, good).groupBy("key", "start", "end").agg(F.max_by("kind", F.struct("confidence", -_rank(F.col("kind")))).alias("kind"))
    return named.groupBy("key").agg(F.collect_list(F.struct("kind", "start", "end")).alias("new"))


def _with_spans(rows: DataFrame, new: DataFrame) -> DataFrame:
    """Adds ``spans``, base and discovered ones. ``new`` is a stored table, whose size
    decides whether Spark broadcasts it."""
    base = F.transform("base", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    none = F.array().cast("array<struct<kind:string,start:int,end:int>>")
    return rows.join(new, "key", "left").withColumn("spans", F.concat(base, F.coalesce("new", none))).drop("new")


def find(docs: DataFrame) -> DataFrame:
    """``doc_id``, counts of the base spans by kind, their digest and all spans."""
    found = saved(spans_of(docs.select("doc_id", "text")).drop("text"))
    n = [F.size(F.filter("base", _is(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    out = _with_spans(found, stored(discovered(found)))
    return out.select("doc_id", *n, F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


def _cut(text: Column, cuts: Column) -> Column:
    """The text's pieces between rising places, one more than places. Each round cuts every
    piece at the middle one of its places, so a letter is read once a round and the rounds
    are the logarithm of the number of places."""
    whole = F.struct(text.alias("s"), F.lit(0).alias("at"), F.lit(0).alias("low"), F.size(cuts).alias("high"))
    rounds = F.sequence(F.lit(0), F.floor(F.log2(F.greatest(F.size(cuts), F.lit(1)))).cast("int"))

    def halves(p: Column, mid: Column, cut: Column) -> Column:
        left = F.struct(F.substring(p["s"], F.lit(1), cut - p["at"]).alias("s"), p["at"].alias("at"), p["low"].alias("low"), mid.alias("high"))
        right = F.struct(F.substring(p["s"], cut - p["at"] + 1, F.length(p["s"])).alias("s"), cut.alias("at"), (mid + 1).alias("low"), p["high"].alias("high"))
        return F.when(p["low"] >= p["high"], F.array(p)).otherwise(F.array(left, right))

    def step(acc: Column, k: Column) -> Column:
        def split(p: Column) -> Column:
            mid = F.shiftright(p["low"] + p["high"], 1)
            return halves(p, mid, F.get(acc["cuts"], mid))

        return F.struct(acc["cuts"].alias("cuts"), F.flatten(F.transform(acc["pieces"], split)).alias("pieces"))

    return F.aggregate(rounds, F.struct(cuts.alias("cuts"), F.array(whole).alias("pieces")), step, lambda acc: F.transform(acc["pieces"], lambda p: p["s"]))


def _redacted(rows: DataFrame) -> DataFrame:
    """``rows`` with ``_clean``: the text with every run of overlapping spans as the kind
    of its first one in brackets."""
    some = F.size("spans") > 0
    ordered = F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), s["kind"].alias("kind"))))
    rows = rows.withColumn("_ordered", F.when(some, ordered))
    rows = rows.withColumn("_ends", F.when(some, _running(F.transform("_ordered", lambda s: -s["back"]), F.greatest)))
    n = F.size("_ordered")
    before = F.concat(F.array(F.lit(0)), F.slice("_ends", F.lit(1), n - 1))
    # a run opens where a span starts behind all spans before it
    opened = F.zip_with("_ordered", before, lambda s, end: F.when(s["start"] >= end, F.struct(s["start"].alias("start"), s["kind"].alias("kind"))))
    rows = rows.withColumn("_opened", F.when(some, opened))
    runs = F.filter("_opened", lambda s: s.isNotNull())
    last = F.concat(F.transform(F.slice("_opened", F.lit(2), n), lambda s: s.isNotNull()), F.array(F.lit(True)))
    ends = F.filter(F.zip_with("_ends", last, lambda end, x: F.when(x, end)), lambda end: end.isNotNull())
    cuts = F.flatten(F.zip_with(runs, ends, lambda s, end: F.array(s["start"], end)))
    names = F.flatten(F.transform(runs, lambda s: F.array(F.lit(None).cast("string"), F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))))
    rows = rows.withColumn("_parts", F.when(some, _cut(F.col("text"), cuts)))
    clean = F.array_join(F.zip_with("_parts", names, lambda part, name: F.coalesce(name, part)), "")
    return rows.withColumn("_clean", F.when(some, clean).otherwise(F.col("text")))


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets; of overlapping spans
    the first (the longest from one start) is named. n_chars follows the text."""
    # a filter before the write would be pushed down and repeat every search
    found = saved(spans_of(docs.select("text")).select("base", "other", "key"))
    rows = docs.select(packed(docs), "text")
    out = _redacted(_with_spans(spans_of(rows), stored(discovered(found))))
    some = F.size("spans") > 0
    new = {"text": F.col("_clean")}
    if "n_chars" in docs.columns:
        n = F.length("_clean").cast(docs.schema["n_chars"].dataType)
        new["n_chars"] = F.when(some, n).otherwise(F.col("_row.n_chars"))
    return out.select(*unpacked(out, docs.columns, new))
