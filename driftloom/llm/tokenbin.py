"""Token ids as fixed-stride shards in training order.

Documents are encoded and cut into sequences of ``LENGTH`` ids. A sequence's number is
made of its document's doc_id and its place in the document, turned round by the hash of
the text, so that rows of one doc_id and different texts lie apart. A keyed Feistel network
permutes the numbers; where it leaves the range of numbers it is applied again (cycle
walking). Numbers are sparse, so the sequences in the order of their permuted numbers
have the dense slots 0, 1, 2 and so on. The order depends on the documents and the key
only, not on how Spark split the input.

The permuted range is cut into even ranges, one a shard. A shard is one file of records
of ``STRIDE`` bytes in the order of slots: a head of doc_id, place in the document, number
of real ids and flags, then the ids, then an end byte. Shards hold about ``SHARD``
sequences up to ``WRITERS`` shards; of larger inputs they grow to ``SHARD_MOST``. :func:`index` counts the records of
the shards from the files' sizes, which gives each shard's first slot; a reader finds any
slot by its shard and ``offset = (slot - first_slot) * STRIDE`` and reads on from there.

Results for special cases: null and empty texts have no sequence; the last sequence of a
document is filled with ``PAD``, n_tokens says how many ids are real; rows that share a
doc_id (or have none) have sequences of their own, spread by their texts; rows that are
equal in both have equal places, ordered by their ids, so that it doesn't matter which of
them comes first; a null doc_id is passed on; a very long text is encoded whole, in one
task; further columns are ignored; an empty table gives no shards and an empty result. Vocabularies of
more than 65,535 ids raise an error.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from driftloom.llm.bpe import loader
from driftloom.llm.common import give_back, shared_dir, stored, texts_of

LENGTH, SHARD, SHARD_MOST, KEY, PAD, ROUNDS = 512, 4096, 1 << 16, 0x5EED, 0xFFFF, 6
#: Sequences that one document may have at most: more than a text of 2 GB can have.
SEQUENCES = 1 << 24
#: A record's bytes; the last one is the end byte that Spark's text writer adds.
RECORD = np.dtype([("doc_id", ">i8"), ("seq", ">u4"), ("n_tokens", ">u2"), ("flags", ">u2"), ("ids", "<u2", (LENGTH,))])
STRIDE = RECORD.itemsize + 1
#: Where doc_ids span more than this, a hash of them takes their place in the numbers;
#: which of two sequences of one number comes first is settled by doc_id and ids.
WIDEST = 1 << 37
#: Bytes of text that one sequence stands for, to choose the number of shards by; and
#: tasks that write shards at most.
TEXT_BYTES, WRITERS = 1600, 20_000
#: Documents encoded at a time, and words kept: more than elsewhere, for less CPU time.
DOCUMENTS, CACHE_WORDS, TOGETHER_CHARS = 1024, 350_000, 1 << 21


def feistel(number: np.ndarray, n: int, key: int = KEY) -> np.ndarray:
    """A permutation of range(n), applied to an array of its members."""
    half = max(1, -(-(max(n - 1, 1)).bit_length() // 2))
    mask = np.uint64((1 << half) - 1)

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> np.uint64(half), x & mask
        for k in range(ROUNDS):
            mixed = (right + np.uint64((key * 2 + 1) * (k + 1) & (1 << 64) - 1)) * np.uint64(0x9E3779B97F4A7C15)
            mixed = (mixed ^ mixed >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ (mixed >> np.uint64(32)) & mask
        return left << np.uint64(half) | right

    out = once(number.astype(np.uint64))
    while (outside := out >= np.uint64(n)).any():
        out[outside] = once(out[outside])
    return out.astype(np.int64)


def records(ids: list[bytes], docs: list[int | None]) -> tuple[np.ndarray, np.ndarray]:
    """The records of encoded documents, and the document (its place in the list) of each."""
    counts = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
    pieces = -(-counts // LENGTH)
    which = np.repeat(np.arange(len(ids)), pieces)
    out = np.zeros(len(which), RECORD)
    first = np.cumsum(pieces) - pieces
    seq = np.arange(len(which)) - first[which]
    out["seq"], out["n_tokens"] = seq, np.minimum(LENGTH, counts[which] - seq * LENGTH)
    out["doc_id"] = np.array([d or 0 for d in docs], np.int64)[which]
    out["flags"] = np.array([d is None for d in docs], np.uint16)[which]
    flat = np.full(len(which) * LENGTH, PAD, "<u2")
    flat[np.arange(counts.sum()) + np.repeat(first * LENGTH - np.cumsum(counts) + counts, counts)] = np.frombuffer(b"".join(ids), "<u4")
    out["ids"] = flat.reshape(-1, LENGTH)
    return out, which


def sequences(docs: DataFrame, vocabulary: str, key: int = KEY) -> tuple[DataFrame, int]:
    """``place, record`` (the permuted number and the bytes of a sequence), and the
    number that all places are below."""
    known = docs.agg(F.min("doc_id").cast("long").alias("low"), F.max("doc_id").cast("long").alias("high")).first()
    low, high = known["low"] or 0, known["high"] or 0
    span = min(high - low + 2, WIDEST)  # the first is that of null doc_ids
    hashed, n = high - low + 2 > WIDEST, span * SEQUENCES
    load = loader(docs, vocabulary, CACHE_WORDS, TOGETHER_CHARS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = load()
        if len(coder.names) > PAD:
            raise ValueError("the ids of this vocabulary don't fit 16 bits")
        for batch in batches:
            for at in range(0, batch.num_rows, DOCUMENTS):
                part = batch.slice(at, DOCUMENTS)
                ids = part.column("doc_id").to_pylist()
                rows, which = records(coder.encode_texts(texts_of(part)), ids)
                if hashed:
                    number = part.column("hash").to_numpy() % (span - 1) + 1
                else:
                    number = np.array([0 if d is None else d - low + 1 for d in ids], np.int64)
                turned = (rows["seq"] + part.column("turn").to_numpy()[which]) % SEQUENCES
                number = number[which] * SEQUENCES + turned
                size = RECORD.itemsize
                record = pa.Array.from_buffers(pa.binary(size), len(rows), [None, pa.py_buffer(rows.tobytes())]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(feistel(number, n, key)), record], names=["place", "record"])
        batch = part = record = rows = None
        give_back()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("doc_id").alias("hash"), F.pmod(F.xxhash64("text"), F.lit(SEQUENCES)).cast("long").alias("turn"))
    return rows.mapInArrow(run, "place long, record binary"), n


def shards_for(size: int) -> int:
    """Shards of ``size`` bytes of text: a task each, then larger ones, as files must not
    become too many to list."""
    sequences = size / TEXT_BYTES
    return max(1, min(round(sequences / SHARD), max(WRITERS, round(sequences / SHARD_MOST))))


def write(docs: DataFrame, vocabulary: str, path: str, key: int = KEY) -> None:
    """Writes one file of fixed-stride records for each shard that has any."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = shards_for(size)
    rows, n = sequences(docs, vocabulary, key)
    wide = -(-n // shards)
    rows = rows.withColumn("shard", F.expr(f"cast(place div {wide} as int)"))
    writers = min(shards, WRITERS)
    rows = rows.repartitionById(writers, F.floor(F.col("shard") * F.lit(writers).cast("long") / shards).cast("int"))
    rows = rows.sortWithinPartitions("shard", "place", "record").select("shard", F.col("record").cast("string").alias("record"))
    rows.write.partitionBy("shard").option("lineSep", "\n").option("compression", "none").text(path)


def _files(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").load(path)
    # a folder without shards has no partition column
    return files if "shard" in files.columns else files.withColumn("shard", F.lit(0))


def index(spark: SparkSession, path: str) -> DataFrame:
    """``shard, file, n, first_slot`` of the shards, a row each, from the files' sizes.
    Running sums are taken within blocks of 1,024 shards and over the blocks."""
    files = _files(spark, path)
    found = files.select(F.col("shard").cast("int").alias("shard"), F.col("path").alias("file"), (F.col("length") / STRIDE).cast("long").alias("n"))
    found = found.withColumn("block", F.floor(F.col("shard") / 1024))
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    blocks = found.groupBy("block").agg(F.sum("n").alias("n")).withColumn("base", before(W.orderBy("block"))).drop("n")
    found = found.withColumn("within", before(W.partitionBy("block").orderBy("shard")))
    return found.join(blocks, "block").select("shard", "file", "n", (F.col("base") + F.col("within")).alias("first_slot"))


def read(spark: SparkSession, path: str, first_slot: int = 0) -> DataFrame:
    """``slot, shard, offset, doc_id, seq, n_tokens, ids`` of the sequences from a slot on,
    read from the shards' files; their order is that of ``slot``."""
    # stored, so that Spark knows its size and moves no contents where it is small
    shards = stored(index(spark, path).filter(F.col("first_slot") + F.col("n") > first_slot).select(F.col("shard").alias("_shard"), "first_slot"))
    files = _files(spark, path).select(F.col("shard").cast("int").alias("shard"), "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, first, content in zip(batch.column("shard").to_pylist(), batch.column("first_slot").to_pylist(), batch.column("content"), strict=True):
                whole = np.frombuffer(content.as_buffer(), np.dtype([("record", RECORD), ("end", "u1")]))
                at = np.arange(max(0, first_slot - first), len(whole))
                rows = whole["record"][at]
                ids = pa.Array.from_buffers(pa.binary(2 * LENGTH), len(rows), [None, pa.py_buffer(rows["ids"].tobytes())]).cast(pa.binary())
                docs = pa.array(rows["doc_id"].astype(np.int64), mask=rows["flags"] > 0)
                columns = [first + at, np.full(len(at), shard, np.int32), at * STRIDE, docs, rows["seq"].astype(np.int64), rows["n_tokens"].astype(np.int64), ids]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=["slot", "shard", "offset", "doc_id", "seq", "n_tokens", "ids"])

    rows = files.join(shards, F.col("shard") == F.col("_shard")).select("shard", "first_slot", "content")
    return rows.mapInArrow(run, "slot long, shard int, offset long, doc_id long, seq long, n_tokens long, ids binary")


def materialise(docs: DataFrame, vocabulary: str, path: str | None = None, key: int = KEY) -> DataFrame:
    """Writes the shards to ``path`` (a new folder in the shared one by default) and
    returns them as read back by :func:`read`."""
    spark = docs.sparkSession
    path = path or f"{shared_dir(spark)}/shards-{uuid.uuid4().hex}"
    write(docs, vocabulary, path, key)
    return read(spark, path)


def manifest(docs: DataFrame, vocabulary: str) -> DataFrame:
    """The shards' records with a digest of each one's ids."""
    return materialise(docs, vocabulary).withColumn("ids_sha256", F.sha2("ids", 256)).drop("ids")
