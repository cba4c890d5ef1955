"""Benchmark decontamination by winnowing, in DataFrame functions only.

An item's windows are its runs of WINDOW words (all its words, if it has fewer). The hash
of every gram of GRAM words is taken, and of the grams in a window the smallest hash is
kept: the window's fingerprint. A window of WINDOW words has one, whatever stands around
it, so a text that shares a window with an item shares its fingerprint: every common run
of at least WINDOW words is found.

1. Distinct windows of the items and their fingerprints are stored.
2. The fingerprints of all texts are joined with those, in blocks of BLOCK fingerprints
   that are broadcast (8 bytes each, so their size is bounded), a pass over the texts for
   each block. No text is shuffled.
3. Hits are extended to the whole window and compared word for word. Overlapping windows
   merge into spans.
4. Equal texts share their result, which is joined back by digest.

Items of fewer words form classes by their length, with grams of at most their length.

Results for special cases: null and empty texts, and those without a word, have no words
and no hits; items without a word are ignored; a null ``item_id`` counts as ``null``;
items with equal ids count once; texts of any length are compared whole (one row a window
is shuffled, and only where a fingerprint fits); repeated rows, equal and null ``doc_id``
each have their row, as rows are looked up by text; ties of fingerprints don't matter, as
all places of a fingerprint are compared; further columns are ignored by :func:`scan` and
:func:`spans` and kept by :func:`clean`; empty tables give no hits.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from driftloom.llm.common import packed, stored, unpacked

WINDOW, GRAM = 10, 5
#: Fingerprints that are broadcast at a time.
BLOCK = 1_000_000
#: A-Z become a-z, other ASCII but digits and a-z becomes a blank, the rest stays.
UPPER = "".join(map(chr, range(65, 91)))
CUT = "".join(chr(c) for c in range(128) if not chr(c).isalnum())


def words_of(text: Column) -> Column:
    folded = F.translate(F.coalesce(text, F.lit("")), UPPER + CUT, UPPER.lower() + " " * len(CUT))
    return F.array_remove(F.split(folded, " "), "")


def fingerprint(hashes: Column, at: Column, window: int, gram: int) -> Column:
    """Smallest hash of a gram in the window of that many words that starts at ``at``."""
    gram = min(gram, window)
    grams = [F.xxhash64(*[F.get(hashes, at + j + k) for k in range(gram)]) for j in range(window - gram + 1)]
    return F.least(*grams) if len(grams) > 1 else grams[0]


def windows(texts: DataFrame, window: int, gram: int, prints: DataFrame | None = None) -> DataFrame:
    """``texts`` (with ``words``) with a row for each window: its ``start``, fingerprint
    ``m`` and ``window``, its words joined by blanks; only those whose fingerprint is in
    ``prints``, if given. What is broadcast meets the rows where they are made, so that
    only windows that fit are put together."""
    hashed = texts.withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w))).filter(F.size("hashes") >= window)
    at = hashed.withColumn("start", F.explode(F.sequence(F.lit(0), F.size("hashes") - window)))
    at = at.withColumn("m", fingerprint(F.col("hashes"), F.col("start"), window, gram))
    if prints is not None:
        at = at.join(F.broadcast(prints.select("m")), "m", "left_semi")
    return at.withColumn("window", F.array_join(F.slice("words", F.col("start") + 1, F.lit(window)), " ")).drop("words", "hashes")


def item_windows(items: DataFrame, window: int = WINDOW, gram: int = GRAM) -> tuple[DataFrame, list[int]]:
    """Stored ``item, size, m, window``, distinct, and the sizes there are (at most
    ``window`` numbers)."""
    split = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), words_of(F.col("text")).alias("words"))
    split = stored(split.withColumn("size", F.least(F.size("words"), F.lit(window))).filter("size > 0"))
    sizes = sorted(r["size"] for r in split.select("size").distinct().collect())
    parts = [windows(split.filter(F.col("size") == n), n, gram) for n in sizes]
    none = split.select("item", "size", F.lit(0).cast("long").alias("m"), F.lit("").alias("window")).filter("false")
    return stored(reduce(DataFrame.unionByName, [p.drop("start") for p in parts], none).distinct()), sizes


def occurrences(docs: DataFrame, items: DataFrame, window: int = WINDOW, gram: int = GRAM) -> tuple[DataFrame, DataFrame]:
    """Stored ``key, start, size, window`` of every window of an item in a distinct text,
    whose SHA-256 is ``key``; and the items' windows."""
    wanted, sizes = item_windows(items, window, gram)
    texts = docs.filter("text IS NOT NULL").select(F.sha2("text", 256).alias("key"), words_of(F.col("text")).alias("words"))
    prints = stored(wanted.select("size", "m").distinct())
    counts = {r["size"]: r["n"] for r in prints.groupBy("size").agg(F.count("*").alias("n")).collect()}
    parts = []
    for n in sizes:
        blocks = -(-counts[n] // BLOCK)
        for k in range(blocks):
            some = prints.filter((F.col("size") == n) & (F.pmod(F.xxhash64("m"), F.lit(blocks)) == k))
            parts.append(windows(texts, n, gram, some).withColumn("size", F.lit(n)))
    none = texts.select("key", F.lit(0).alias("start"), F.lit(0).alias("size"), F.lit(0).cast("long").alias("m"), F.lit("").alias("window")).filter("false")
    near = reduce(DataFrame.unionByName, parts, none)
    exact = wanted.select("size", "m", "window").distinct()
    return stored(near.join(exact, ["size", "m", "window"]).select("key", "start", "size", "window").distinct()), wanted


def merged(found: DataFrame) -> DataFrame:
    """``key, start, end`` (words, end exclusive): windows that overlap or touch, as one."""
    before = W.partitionBy("key").orderBy("start").rowsBetween(W.unboundedPreceding, -1)
    ends = found.groupBy("key", "start").agg(F.max(F.col("start") + F.col("size")).alias("end"))
    new = F.coalesce((F.col("start") > F.max("end").over(before)).cast("int"), F.lit(1))
    numbered = ends.withColumn("_new", new).withColumn("_span", F.sum("_new").over(W.partitionBy("key").orderBy("start")))
    return numbered.groupBy("key", "_span").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_span")


def hits(found: DataFrame, wanted: DataFrame) -> DataFrame:
    """``key, n_hit, n_items, items_sha256`` of every text with a hit."""
    n_hit = merged(found).groupBy("key").agg(F.sum(F.col("end") - F.col("start")).cast("long").alias("n_hit"))
    held = found.select("key", "size", "window").distinct().join(wanted.select("size", "window", "item"), ["size", "window"])
    ids = held.groupBy("key").agg(F.sort_array(F.collect_set("item")).alias("ids"))
    ids = ids.select("key", F.size("ids").cast("long").alias("n_items"), F.sha2(F.array_join("ids", ","), 256).alias("items_sha256"))
    return n_hit.join(ids, "key")


def scan(docs: DataFrame, items: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated`` of each document."""
    found = stored(hits(*occurrences(docs.select("text"), items.select("item_id", "text"), window, gram)))
    rows = docs.select("doc_id", F.sha2("text", 256).alias("key"), F.size(words_of(F.col("text"))).cast("long").alias("n_words"))
    out = rows.join(found, "key", "left")
    n = {c: F.coalesce(c, F.lit(0).cast("long")) for c in ("n_hit", "n_items")}
    return out.select("doc_id", "n_words", *[x.alias(c) for c, x in n.items()], F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), (n["n_hit"] > 0).alias("contaminated"))


def spans(docs: DataFrame, items: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """``doc_id, start, end``: the words of each document that stand in items' windows."""
    found, _ = occurrences(docs.select("text"), items.select("item_id", "text"), window, gram)
    return docs.select("doc_id", F.sha2("text", 256).alias("key")).join(stored(merged(found)), "key").select("doc_id", "start", "end")


def clean(docs: DataFrame, items: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """The documents in which no window of an item occurs, with all their columns."""
    found, _ = occurrences(docs.select("text"), items.select("item_id", "text"), window, gram)
    rows = docs.select(packed(docs), F.sha2("text", 256).alias("_key"))
    left = rows.join(stored(found.select(F.col("key").alias("_key")).distinct()), "_key", "left_anti")
    return left.select(*unpacked(left, docs.columns))


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

SQL = f"""with items as (select cast(item_id as varchar) as item, {_WORDS} as words from benchmark),
sized as (select *, least(len(words), {WINDOW}) as size from items where len(words) > 0),
wanted as (select distinct item, size, array_to_string(words[k : k + size - 1], ' ') as win from (select *, unnest(range(1, len(words) - size + 2)) as k from sized)),
docs as (select row_number() over () as rid, doc_id, {_WORDS} as words from documents),
places as (select rid, size, k, array_to_string(words[k : k + size - 1], ' ') as win from
 (select rid, words, size, unnest(range(1, len(words) - size + 2)) as k from docs cross join (select distinct size from sized) where len(words) >= size)),
found as (select rid, k, p.size, p.win from places p join (select distinct size, win from wanted) w on p.size = w.size and p.win = w.win),
covered as (select rid, count(distinct word) as n_hit from (select rid, unnest(range(k, k + size)) as word from found) group by 1),
held as (select rid, count(*) as n_items, sha256(string_agg(item, ',' order by item)) as items_sha256 from
 (select distinct rid, item from found f join wanted w on f.size = w.size and f.win = w.win) group by 1)
select doc_id, cast(len(words) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, coalesce(items_sha256, sha256('')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from docs left join covered using (rid) left join held using (rid)"""
