"""Importance resampling towards a target distribution, with segment deduplication.

Features are the runs of 1 to ``most`` words; their hashed counts in a bag of buckets are a
model of the raw texts and one of the target texts. A bucket's gain is the logarithm of the
ratio of both; documents are drawn without replacement by gain plus Gumbel noise that
follows from their doc_id.

Texts are cut into lines at newlines. Equal lines are counted first; the features of each
distinct line are counted once and multiplied by its number. Runs that cross a line's end
are added separately, from the words around the ends.

The draw takes no global sort: scores are whole numbers in a range that the logarithms
bound, so a count of each score tells where the draw ends; only rows drawn are sorted, over
ranges.

Results for special cases: null and empty texts have no features and weight 0; repeated
rows are documents of their own, and equal rows get ranks beside each other; ties go to the
smaller doc_id; a null ``doc_id`` hashes as an empty one and comes last among ties; texts
and lines of any length are read whole; further columns are ignored by :func:`scores` and
kept by :func:`resampled`; an empty target makes all gains follow the raw counts alone; an
empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftloom.llm.common import numbered, over_texts, packed, stored, texts_of, unpacked

BUCKETS, MOST, SEED, SHARE, LEAST_WORDS = 10_000, 1, 2024, 10, 20
#: ASCII letters in lower case; other ASCII but digits and newlines cuts words.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or c == 10 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
#: Features whose bucket a task remembers; beyond, it forgets all and begins anew.
REMEMBERED = 200_000


class Buckets(dict):
    """A feature's bucket, worked out once while it is remembered."""

    def __init__(self, buckets: int):
        super().__init__()
        self.buckets = buckets

    def __missing__(self, feature: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        found = self[feature] = zlib.crc32(feature) % self.buckets
        return found


def lines_of(text: str) -> list[list[bytes]]:
    return [line.split() for line in text.encode("utf-8").translate(FOLD).split(b"\n")]


def inside(words: list[bytes], most: int) -> list[bytes]:
    """All runs of up to ``most`` words."""
    runs = list(words)
    for n in range(2, most + 1):
        runs += [b" ".join(words[k : k + n]) for k in range(len(words) - n + 1)]
    return runs


def crossing(lines: list[list[bytes]], most: int) -> list[bytes]:
    """All runs of up to ``most`` words that cross an end of a line: they begin in one of
    the last words before it, so few words of a line are looked at."""
    lines = [words for words in lines if words] if most > 1 else []
    found = []
    for at in range(len(lines) - 1):
        tail, after, k = lines[at][-(most - 1) :], [], at + 1
        while k < len(lines) and len(after) < most - 1:
            after += lines[k][: most - 1 - len(after)]
            k += 1
        near = tail + after
        for first in range(len(tail)):
            for n in range(max(2, len(tail) - first + 1), min(most, len(near) - first) + 1):
                found.append(b" ".join(near[first : first + n]))
    return found


def feature_counts(texts: DataFrame, most: int = MOST, buckets: int = BUCKETS) -> DataFrame:
    """``bucket, n``: how often features of each bucket occur in all ``texts``."""
    lines = texts.filter("text IS NOT NULL").select(F.explode(F.split("text", "\n")).alias("text")).groupBy("text").agg(F.count("*").alias("times"))

    def of(column: str | None):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bucket, total = Buckets(buckets), np.zeros(buckets, np.int64)
            for batch in batches:
                found = [inside(lines_of(t)[0], most) for t in texts_of(batch)] if column else [crossing(lines_of(t), most) for t in texts_of(batch)]
                at = np.fromiter((bucket[x] for one in found for x in one), np.int64)
                times = np.repeat(batch.column(column).to_numpy(), [len(one) for one in found]) if column else None
                np.add.at(total, at, 1 if times is None else times)
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

        return run

    found = lines.mapInArrow(of("times"), "bucket long, n long")
    if most > 1:
        found = found.unionByName(texts.filter("text IS NOT NULL").select("text").mapInArrow(of(None), "bucket long, n long"))
    return found.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(raw: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """The gain of each bucket; what comes to the driver is a number for each bucket."""
    spark = raw.sparkSession
    n = spark.range(buckets).withColumnRenamed("id", "bucket").join(raw.withColumnRenamed("n", "s"), "bucket", "left").join(target.withColumnRenamed("n", "t"), "bucket", "left").fillna(0)
    n = stored(n)
    whole = n.agg(F.sum("s").alias("s"), F.sum("t").alias("t")).first()
    over = (F.col("t") + 1).cast("double") * F.lit(float(whole["s"] + buckets))
    under = (F.col("s") + 1).cast("double") * F.lit(float(whole["t"] + buckets))
    rows = n.select("bucket", F.floor(F.lit(1000.0) * F.log(over / under)).cast("long").alias("gain")).collect()
    out = np.zeros(buckets, np.int64)
    for r in rows:
        out[r["bucket"]] = r["gain"]
    return out


def weights(docs: DataFrame, gain: np.ndarray, keep: list[str], most: int = MOST) -> DataFrame:
    """``keep``, ``n_words, n_features, weight``: a document's features and the floored mean
    of their gains. Lines that come again in a batch are worked out once."""
    buckets = len(gain)
    gain = gain.tolist()

    def make():
        bucket = Buckets(buckets)

        def points(features: list[bytes]) -> tuple[int, int]:
            return len(features), sum([gain[bucket[x]] for x in features])

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            known: dict[bytes, tuple[int, int, int]] = {}
            out: list[list[int]] = [[], [], []]
            for text in texts_of(batch):
                words = features = total = 0
                raw = text.encode("utf-8").translate(FOLD).split(b"\n")
                for line in raw:
                    if line not in known:
                        split = line.split()
                        known[line] = (len(split), *points(inside(split, most)))
                    w, n, s = known[line]
                    words, features, total = words + w, features + n, total + s
                if most > 1:
                    n, s = points(crossing([x.split() for x in raw], most))
                    features, total = features + n, total + s
                for column, x in zip(out, (words, features, total // features if features else 0), strict=True):
                    column.append(x)
            return pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], *[pa.array(x, pa.int64()) for x in out]], names=[*keep, "n_words", "n_features", "weight"])

        return work

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return over_texts(docs.select(*keep, "text"), make, f"{kinds}, n_words long, n_features long, weight long")


def scores(docs: DataFrame, target: DataFrame, keep: tuple[str, ...] = ("doc_id",), most: int = MOST, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """``keep``, ``n_words, n_features, weight, score`` of each document."""
    gain = gains(feature_counts(docs.select("text"), most, buckets), feature_counts(target.select("text"), most, buckets), buckets)
    found = weights(docs, gain, list(dict.fromkeys(["doc_id", *keep])), most)
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")
    return found.withColumn("score", F.col("weight") + noise)


def ranked(scored: DataFrame, share: int = SHARE, least_words: int = LEAST_WORDS) -> DataFrame:
    """``scored`` (stored) with ``rank`` of the documents drawn: ``share`` percent of those
    with ``least_words`` words."""
    able = F.col("n_words") >= least_words
    # scores are whole numbers between logarithms: a bounded number of rows
    counts = sorted(((r["score"], r["n"]) for r in scored.filter(able).groupBy("score").agg(F.count("*").alias("n")).collect()), reverse=True)
    wanted = sum(n for _, n in counts) * share // 100
    none = scored.withColumn("rank", F.lit(None).cast("long"))
    if not wanted:
        return none
    taken = 0
    for cut, n in counts:
        taken += n
        if taken >= wanted:
            break
    first = able & (F.col("score") >= cut)
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), *[F.col(c) for c in ("n_features", "n_words")]]
    drawn = numbered(scored.filter(first), order, "rank")
    return drawn.withColumn("rank", F.when(F.col("rank") <= wanted, F.col("rank"))).unionByName(none.filter(~first))


def draw(docs: DataFrame, target: DataFrame, most: int = MOST, buckets: int = BUCKETS, seed: int = SEED, share: int = SHARE, least_words: int = LEAST_WORDS) -> DataFrame:
    """``doc_id, n_features, weight, score, rank`` of each document."""
    found = ranked(stored(scores(docs.select("doc_id", "text"), target, most=most, buckets=buckets, seed=seed)), share, least_words)
    return found.select("doc_id", "n_features", "weight", "score", "rank")


def resampled(docs: DataFrame, target: DataFrame, most: int = MOST, buckets: int = BUCKETS, seed: int = SEED, share: int = SHARE, least_words: int = LEAST_WORDS) -> DataFrame:
    """The documents drawn, with all their columns."""
    rows = docs.select("doc_id", "text", packed(docs))
    found = ranked(stored(scores(rows, target, ("_row",), most, buckets, seed)), share, least_words).filter("rank IS NOT NULL")
    return found.select(*unpacked(found, docs.columns))


#: CRC-32 by its definition, bit by bit, once for each distinct word.
SQL = rf"""with recursive bits(i, c, k) as (select i, i, 0 from (select unnest(range(0, 256)) as i) union all
 select i, case when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end, k + 1 from bits where k < 8),
crc as materialized (select list(c order by i) as t from bits where k = 8),
docs as materialized (select row_number() over () as rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words from documents),
raw as (select rid, unnest(words) as word from docs),
wanted as (select unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) as word from benchmark),
letters as (select word, list_transform(range(0, len(hex(encode(word))) // 2), lambda k: cast('0x' || substr(hex(encode(word)), 2 * k + 1, 2) as bigint)) as b from (select word from raw union select word from wanted)),
hashed as materialized (select word, xor(list_reduce(b, lambda a, x: xor(a // 256, t[xor(a % 256, x) + 1]), 4294967295), 4294967295) % {BUCKETS} as bucket from letters, crc),
s as (select bucket, count(*) as s from raw join hashed using (word) group by 1),
t as (select bucket, count(*) as t from wanted join hashed using (word) group by 1),
gain as (select bucket, floor(1000 * ln((coalesce(t, 0) + 1) * cast((select coalesce(sum(s), 0) from s) + {BUCKETS} as double) / ((coalesce(s, 0) + 1) * cast((select coalesce(sum(t), 0) from t) + {BUCKETS} as double)))) as gain
 from (select unnest(range(0, {BUCKETS})) as bucket) left join s using (bucket) left join t using (bucket)),
sums as (select rid, floor(sum(gain) / count(*)) as weight from raw join hashed using (word) join gain using (bucket) group by 1),
scored as (select doc_id, len(words) as n, cast(coalesce(weight, 0) as bigint) as weight, cast(coalesce(weight, 0) + floor(-1000 * ln(-ln((cast('0x' || substr(sha256('{SEED}:' || coalesce(cast(doc_id as varchar), '')), 1, 8) as bigint) + 0.5) / 4294967296))) as bigint) as score
 from docs left join sums using (rid)),
placed as (select *, row_number() over (partition by n >= {LEAST_WORDS} order by score desc, doc_id nulls last, n) as place, count(*) over (partition by n >= {LEAST_WORDS}) as able from scored)
select doc_id, cast(n as bigint) as n_features, weight, score, case when n >= {LEAST_WORDS} and place <= able * {SHARE} // 100 then place end as rank from placed"""
