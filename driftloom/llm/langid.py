"""Language identification by Bayesian fusion of evidence.

P(language | row) is proportional to P(text | language) ** t · P(declared | language) ·
P(language | host, suffix).

* Text: log likelihoods of hashed character trigrams under a multinomial model, fitted
  on a bounded sample of each declared language (the ``SAMPLE_ROWS`` distinct texts of
  smallest hash, the first ``SAMPLE_CHARS`` of each). Every language declared by
  ``MIN_ROWS`` rows of the table is one. The power t tempers them, as neighbouring
  trigrams aren't independent. A language ``und`` with even likelihoods stands for what
  is no language.
* Declared: the language that the row declares (the markup's attribute, or a column). A
  label that too few rows declare is one more choice for its rows, with the likelihood
  of the text and the prior that ``und`` has.
* Suffix: the last part of the host name, where a row has an address; it is what the
  prior of a host is smoothed towards.
* Host: how often each language won by text alone on the host, smoothed towards the
  counts of the suffix, and these towards those of all rows. Grouped sums over all rows.

Results for special cases: a null or empty text, or one without letters, has only the
other evidence and is ``und`` if it has no letters; null declared languages, hosts and
suffixes give no evidence; ties go to the language first by name; repeated rows have
equal results; further columns are kept; an empty table gives an empty result. If no language is declared anywhere, every row
is ``und``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from driftloom.llm.common import KEPT, give_back, packed, saved, stored, texts_of, unpacked

SAMPLE_ROWS, SAMPLE_CHARS, MIN_ROWS, BINS, SMOOTH = 2000, 20_000, 5, 1 << 14, 0.5
#: A text of n trigrams counts as TEMPER * sqrt(n) of them.
TEMPER, DECLARED_TRUST, HOST_PRIOR, SUFFIX_PRIOR, ALL_PRIOR = 4.0, 0.8, 8.0, 32.0, 1.0
UND, UND_SHARE, MIN_POSTERIOR = "und", 0.01, 0.5
SAMPLE_TASKS = 16
RESULTS = ["language", "posterior", "text_language", "accepted"]


def trigrams(text: str) -> np.ndarray:
    """Bins of the trigrams of the lower-cased letters; runs of others are one space."""
    raw = text.lower()
    codes = np.frombuffer(f" {raw} ".encode("utf-32-le", "surrogatepass"), "<u4")
    letter = ((codes >= 97) & (codes <= 122)) | (codes >= 0xC0)
    codes = np.where(letter, codes, 32)
    keep = letter.copy()
    keep[0] = True
    keep[1:] |= letter[:-1]
    codes = codes[keep].astype(np.uint64)
    if len(codes) < 3 or not letter.any():
        return np.zeros(0, np.int64)
    mixed = (codes[:-2] * np.uint64(0x9E3779B97F4A7C15) + codes[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + codes[2:] * np.uint64(0x165667B19E3779F9))
    return (mixed >> np.uint64(50)).astype(np.int64) & (BINS - 1)


class Model:
    """Log likelihoods of the bins: one row a language, ``und`` last."""

    def __init__(self, languages: list[str], table: np.ndarray):
        self.languages, self.table = languages, table

    def scores(self, text: str) -> list[float] | None:
        """None for a text without letters."""
        bins = trigrams(text)
        if not len(bins):
            return None
        total = self.table @ np.bincount(bins, minlength=BINS) if len(bins) > 2000 else self.table[:, bins].sum(axis=1)
        power = min(1.0, TEMPER / math.sqrt(len(bins)))
        return np.round((total - total.max()) * power, 6).tolist()


def fit(rows: DataFrame, text: str = "text", declared: str = "declared") -> Model:
    """Counts of the samples' trigrams by language, summed by Spark."""
    known = rows.filter(F.col(declared).isNotNull() & (F.col(declared) != UND))
    known = known.select(F.col(declared).alias("declared"), F.when(F.length(text) > 0, F.xxhash64(text, declared)).alias("_h"), F.substring(text, 1, SAMPLE_CHARS).alias("text"))
    sizes = known.groupBy("declared").agg(F.count("*").alias("n"), F.approx_count_distinct("_h").alias("d")).filter(F.col("n") >= MIN_ROWS)
    sizes = {r["declared"]: r["d"] for r in sizes.collect()}  # a row a language
    languages = sorted(sizes)
    counts = np.full((len(languages), BINS), SMOOTH)
    if languages:
        # hashes below a bound that lets about twice the sample of a language through; of
        # these the smallest are the sample, each text once
        bound = {x: -(2**63) + int(2**64 * min(1.0, 2 * SAMPLE_ROWS / max(d, 1))) - 1 for x, d in sizes.items()}
        bounds = F.create_map(*[F.lit(v) for x in bound.items() for v in x])
        sample = known.filter(F.col("declared").isin(languages) & (F.col("_h") <= bounds[F.col("declared")])).dropDuplicates(["declared", "_h"])
        sample = sample.withColumn("_r", F.row_number().over(Window.partitionBy("declared").orderBy("_h"))).filter(F.col("_r") <= SAMPLE_ROWS)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own: dict[str, np.ndarray] = {}  # BINS numbers a language
            for batch in batches:
                for lang, value in zip(batch.column("declared").to_pylist(), texts_of(batch), strict=True):
                    own.setdefault(lang, np.zeros(BINS, np.int64))
                    own[lang] += np.bincount(trigrams(value), minlength=BINS)
            for lang, n in own.items():
                bins = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(bins), pa.string()), pa.array(bins, pa.int64()), pa.array(n[bins])], names=["declared", "bin", "n"])

        counted = sample.select("declared", "text").repartition(SAMPLE_TASKS).mapInArrow(run, "declared string, bin long, n long").groupBy("declared", "bin").agg(F.sum("n").alias("n"))
        got = counted.toArrow()  # at most BINS rows a language
        place = {x: k for k, x in enumerate(languages)}
        at = np.array([place[x] for x in got.column("declared").to_pylist()], np.int64)
        counts[at, got.column("bin").to_numpy()] += got.column("n").to_numpy()
    table = np.log(counts / counts.sum(axis=1, keepdims=True))
    return Model([*languages, UND], np.vstack([table, np.full((1, BINS), -math.log(BINS))]))


def _with_text(rows: DataFrame, model: Model) -> DataFrame:
    sent = rows.sparkSession.sparkContext.broadcast((model.languages, model.table))  # fixed size
    schema = T.StructType([*rows.schema.fields, T.StructField("_ll", T.ArrayType(T.DoubleType())), T.StructField("_letters", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        KEPT.clear()
        own = Model(*sent.value)
        for batch in batches:
            scores = [own.scores(t) for t in texts_of(batch)]
            ll, letters = pa.array([x or [0.0] * len(own.languages) for x in scores], pa.list_(pa.float64())), pa.array([x is not None for x in scores], pa.bool_())
            yield pa.RecordBatch.from_arrays([*batch.columns, ll, letters], names=[*batch.schema.names, "_ll", "_letters"])
        batch = ll = letters = None
        give_back()

    return rows.mapInArrow(run, schema)


def host_priors(won: DataFrame, languages: list[str]) -> DataFrame:
    """``_host, _suffix, _prior`` from ``_host, _suffix, _won`` (a language's place, null
    where the text decides nothing): shares by host, smoothed towards those of the
    suffix, smoothed towards those of all rows."""
    n = len(languages)
    hosts = won.groupBy("_host", "_suffix").agg(*[F.count(F.when(F.col("_won") == k, 1)).alias(f"n{k}") for k in range(n)])
    hosts = saved(hosts)
    suffixes = hosts.groupBy("_suffix").agg(*[F.sum(f"n{k}").alias(f"s{k}") for k in range(n)])
    total = hosts.agg(*[F.sum(f"n{k}").alias(f"t{k}") for k in range(n)]).first()
    sums = [float(total[f"t{k}"] or 0) for k in range(n)]
    start = [UND_SHARE if x == UND else (1 - UND_SHARE) / max(1, n - 1) for x in languages]
    whole = [(x + ALL_PRIOR * p) / (sum(sums) + ALL_PRIOR) for x, p in zip(sums, start, strict=True)]
    s_sum, n_sum = sum((F.col(f"s{k}") for k in range(n)), F.lit(0)), sum((F.col(f"n{k}") for k in range(n)), F.lit(0))
    by_suffix = [(F.col(f"s{k}") + SUFFIX_PRIOR * whole[k]) / (s_sum + SUFFIX_PRIOR) for k in range(n)]
    by_host = [(F.col(f"n{k}") + HOST_PRIOR * by_suffix[k]) / (n_sum + HOST_PRIOR) for k in range(n)]
    return hosts.join(suffixes, "_suffix").select("_host", "_suffix", F.array(*by_host).alias("_prior"))


def identify(rows: DataFrame, declared: str, host: str, suffix: str | None = None, text: str = "text") -> DataFrame:
    """``rows`` with ``language, posterior, text_language, accepted``, which take the place
    of columns of these names.

    A row is accepted if some language, not ``und``, has a posterior of MIN_POSTERIOR.
    """
    out = identified(rows, declared, host, suffix, text)
    plain = [c for c in rows.columns if c not in RESULTS]
    return out.select(*unpacked(out, plain), *RESULTS)


def identified(rows: DataFrame, declared: str, host: str, suffix: str | None = None, text: str = "text") -> DataFrame:
    """``_row`` (all columns of a row) and the results of :func:`identify`."""
    none = F.lit(None).cast("string")
    parts = rows.select(
        packed(rows),
        F.col(text).alias("text"),
        F.col(declared).alias("declared"),
        F.coalesce(F.col(host), F.lit("")).alias("_host"),
        F.coalesce(F.col(suffix) if suffix else none, F.lit("")).alias("_suffix"),
    )
    model = fit(parts)
    languages = model.languages
    best = F.array_max("_ll")
    # a text decides if one language stands out; without letters all scores are 0
    clear = F.size(F.filter("_ll", lambda x: x > best - 2.0)) == 1
    won = _with_text(parts.select("text", "_host", "_suffix"), model)
    won = won.select("_host", "_suffix", F.when(clear, (F.array_position("_ll", best) - 1).cast("int")).alias("_won"))
    priors = stored(host_priors(won, languages))
    names = F.array(*map(F.lit, languages))
    known = F.col("declared").isin(*languages)
    rare = F.coalesce(~known & (F.col("declared") != ""), F.lit(False))  # a label that is no class
    with_own = lambda x, own: F.when(rare, F.concat(x, F.array(own))).otherwise(x)
    wrong = (1 - DECLARED_TRUST) / F.greatest(F.lit(1), F.size("_names") - 1)
    said = F.transform("_names", lambda x: F.when(~F.coalesce(known | rare, F.lit(False)), F.lit(0.0)).when(x == F.col("declared"), math.log(DECLARED_TRUST)).otherwise(F.log(wrong)))
    out = _with_text(parts, model).join(priors, ["_host", "_suffix"], "left").withColumn("_names", with_own(names, F.col("declared"))).withColumn("_said", said)
    prior = F.transform(with_own(F.col("_prior"), F.element_at("_prior", -1)), lambda p: F.log(p))
    text_ll = with_own(F.col("_ll"), F.element_at("_ll", -1))
    out = out.withColumn("_log", F.zip_with(F.zip_with(text_ll, "_said", lambda a, b: a + b), prior, lambda a, b: a + b))
    out = out.withColumn("_best", F.array_max("_log"))
    share = F.aggregate("_log", F.lit(0.0), lambda acc, x: acc + F.exp(x - F.col("_best")))
    language = F.when(F.col("_letters"), F.element_at("_names", F.array_position("_log", F.col("_best")).cast("int"))).otherwise(F.lit(UND))
    by_text = F.when(F.col("_letters"), F.element_at(names, F.array_position("_ll", F.array_max("_ll")).cast("int"))).otherwise(F.lit(UND))
    posterior = F.round(1 / share, 6)
    accepted = (F.col("language") != UND) & (F.col("posterior") >= MIN_POSTERIOR)
    out = out.select("_row", language.alias("language"), posterior.alias("posterior"), by_text.alias("text_language"))
    return out.select("*", accepted.alias("accepted"))


def accepted_documents(docs: DataFrame) -> DataFrame:
    """``docs`` without the rejected rows; ``lang`` is the language found."""
    found = identified(docs, "lang", "source").filter("accepted")
    return found.select(*unpacked(found, docs.columns, {"lang": F.col("language")}))


def identify_pages(pages: DataFrame) -> DataFrame:
    """``page_id, host, suffix, declared, language, posterior, accepted`` of web pages:
    the language declared in the markup, and host and suffix of the address."""
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-zA-Z]+://(?:[^/@]*@)?([^/:?#]+)", 1))
    # the text without tags, scripts and entities
    text = F.regexp_replace(F.coalesce("html", F.lit("")), r"(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->|<[^>]*>|&[a-z#0-9]+;", " ")
    declared = F.lower(F.regexp_extract(F.coalesce("html", F.lit("")), r"(?is)<html\b[^>]*\blang\s*=\s*[\"']?([a-z]{2,3})", 1))
    rows = pages.select("page_id", F.nullif(host, F.lit("")).alias("host"), F.nullif(F.regexp_extract(host, r"\.([a-z]{2,})$", 1), F.lit("")).alias("suffix"), F.nullif(declared, F.lit("")).alias("declared"), text.alias("text"))
    return identify(rows, "declared", "host", "suffix").drop("text")
