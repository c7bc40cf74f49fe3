"""Problem 7: has this key been seen before, exactly, without all earlier keys in memory.

A streaming query partitions records by key and keeps, in RocksDB, a disk-backed state store checkpointed to the shared
folder, the keys that have been seen, each with the sequence number of its first record. There is no watermark, so no key
ever expires. The stateful operator itself emits first or repeat for every record; nothing is joined afterwards.

Keys share state entries: an entry is a bucket of about ``KEYS_PER_BUCKET`` hashed keys, held as two sorted arrays, so that a
group of records is decided by a few array operations. A hot key costs its bucket one record for each block of the map side:
of the records of a key in one block all but the earliest are repeats whatever the state says, and they travel packed,
spread over all partitions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from strandmill.functions.kmer import unpack
from strandmill.llm.kmer_rows import K, VALID_SQL, _coding, coded
from strandmill.runtime import remove, scratch, table

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
KEYS_PER_BUCKET = 2048
BLOCK, PACK = 1 << 20, 1 << 14
FIRST, REPEAT, DISPLACED = 0, 1, 2
FLAGS = "key bigint, seq bigint, kind int"

Batches = Iterator[pa.RecordBatch]


def _bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    h = keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return (h % np.uint64(buckets)).astype(np.int64)


def _folding(buckets: int, prepare: Callable[[Batches], Batches] | None):
    """Blocks of records to one candidate a key and block, by bucket, and packs of certain repeats under numbers below 0."""

    def folded(keys: np.ndarray, seqs: np.ndarray, spread: np.random.Generator) -> Batches:
        order = np.lexsort((seqs, keys))
        keys, seqs = keys[order], seqs[order]
        new = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        least = np.repeat(seqs[new], np.diff(np.r_[new, len(keys)]))
        sure = seqs > least
        k, s = keys[~sure], seqs[~sure]
        names = ["bucket", "key", "seq", "pack"]
        yield pa.RecordBatch.from_arrays([pa.array(_bucket(k, buckets)), pa.array(k), pa.array(s), pa.nulls(len(k), pa.binary())], names=names)
        k, s = keys[sure], seqs[sure]
        packs = [np.r_[k[a : a + PACK], s[a : a + PACK]].tobytes() for a in range(0, len(k), PACK)]
        if packs:
            none = pa.nulls(len(packs), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(-1 - spread.integers(1 << 62, size=len(packs))), none, none, pa.array(packs, pa.binary())], names=names)

    def fold(batches: Batches) -> Batches:
        spread, held, rows = np.random.default_rng(TaskContext.get().partitionId()), [], 0
        for b in prepare(batches) if prepare else batches:
            here = b.column(0).is_valid().to_numpy(zero_copy_only=False) & b.column(1).is_valid().to_numpy(zero_copy_only=False)
            held.append([c.fill_null(0).to_numpy(zero_copy_only=False)[here] for c in b.columns[:2]])
            rows += len(held[-1][0])
            if rows >= BLOCK:
                yield from folded(*map(np.concatenate, zip(*held)), spread)
                held, rows = [], 0
        if rows:
            yield from folded(*map(np.concatenate, zip(*held)), spread)

    return fold


def _flag(bucket: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    """First or repeat for the records of one bucket, against its seen keys and among themselves."""
    if bucket[0] < 0:
        for f in frames:
            for p in f["pack"]:
                got = np.frombuffer(p, np.int64).reshape(2, -1)
                yield pd.DataFrame({"key": got[0], "seq": got[1], "kind": np.int32(REPEAT)})
        return
    keys, seqs = (np.concatenate(x) for x in zip(*((f["key"].to_numpy(np.int64), f["seq"].to_numpy(np.int64)) for f in frames)))
    seen, firsts = (np.frombuffer(x, np.int64) for x in state.get) if state.exists else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    own, at = np.unique(keys, return_inverse=True)
    least = np.full(len(own), np.iinfo(np.int64).max)
    np.minimum.at(least, at, seqs)
    place = np.searchsorted(seen, own)
    known = np.zeros(len(own), bool)
    inside = place < len(seen)
    known[inside] = seen[place[inside]] == own[inside]
    before = np.full(len(own), np.iinfo(np.int64).max)
    before[known] = firsts[place[known]]
    first = np.minimum(least, before)
    moved = known & (least < before)
    kind = np.where(seqs > first[at], REPEAT, FIRST)
    if moved.any() or not known.all():
        firsts = firsts.copy()
        firsts[place[moved]] = least[moved]
        new = ~known
        state.update((np.insert(seen, place[new], own[new]).tobytes(), np.insert(firsts, place[new], first[new]).tobytes()))
    yield pd.DataFrame({"key": np.r_[keys, own[moved]], "seq": np.r_[seqs, before[moved]], "kind": np.r_[kind, np.full(moved.sum(), DISPLACED)].astype(np.int32)})


def seen_before(stream: DataFrame, key: str, seq: str, buckets: int, checkpoint: str | None = None, prepare: Callable[[Batches], Batches] | None = None) -> DataFrame:
    """``(key, seq, kind)`` for each record of a stream, after all that is available has been taken in.

    ``kind`` is ``FIRST`` or ``REPEAT``. A record that comes in a later micro-batch than another of its key but has the smaller
    number takes its place: it is emitted as ``FIRST``, and the other one once more, as ``DISPLACED``. Repeats are therefore all rows that are
    not ``FIRST``, each record once. Records equal in key and number are both first or both repeats. Null keys and null numbers are left out.

    ``prepare`` turns the Arrow batches of the stream into batches of key and number; without it the two columns are BIGINTs.
    ``buckets`` is the number of state entries; it stays the same as long as a ``checkpoint`` lives (a call with another number is
    refused). With a ``checkpoint`` path of its own a later call goes on from the state that earlier ones left and returns its own records.
    """
    spark = stream.sparkSession
    out, state = scratch(spark, "flags"), checkpoint or scratch(spark, "state")
    if checkpoint:
        spark.range(1).select(F.lit(buckets).alias("buckets")).write.mode("ignore").parquet(f"{checkpoint}/buckets")
        if (had := spark.read.parquet(f"{checkpoint}/buckets").first()[0]) != buckets:
            raise ValueError(f"this checkpoint has {had} buckets, not {buckets}")
    rows = stream.select(key, seq).mapInArrow(_folding(buckets, prepare), "bucket bigint, key bigint, seq bigint, pack binary")
    flags = rows.groupBy("bucket").applyInPandasWithState(_flag, FLAGS, "seen binary, firsts binary", "append", "NoTimeout")

    def store(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    spark.createDataFrame([], FLAGS).write.parquet(f"{out}/batch=-1")  # so that a stream without records has a result as well
    settings = {"spark.sql.streaming.stateStore.providerClass": ROCKSDB, "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true", "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true"}  # one memory bound for all partitions of an executor
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        flags.writeStream.outputMode("append").foreachBatch(store).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    if checkpoint is None:
        remove(spark, state)
    return spark.read.schema(FLAGS).parquet(f"{out}/batch=*")


def repeats(flags: DataFrame) -> DataFrame:
    """``(key, seq)`` of every record whose key came before."""
    return flags.filter(F.col("kind") != FIRST).select("key", "seq")


def settled(flags: DataFrame) -> DataFrame:
    """``(key, seq, seen_before)`` of every record, displaced firsts taken back."""
    firsts, gone = flags.filter(F.col("kind") == FIRST), flags.filter(F.col("kind") == DISPLACED)
    left = firsts.join(gone.select("key", "seq"), ["key", "seq"], "left_anti")
    return left.select("key", "seq", F.lit(False).alias("seen_before")).unionByName(repeats(flags).withColumn("seen_before", F.lit(True)))


def error_rate(flags: DataFrame, records: DataFrame, key: str, seq: str) -> DataFrame:
    """``(n_records, n_repeats, n_wrong, wrong_rate)`` of ``(key, seq, seen_before)`` against each key's smallest number, found by a batch aggregation of its own.

    Wrong are a record flagged as first that isn't, a first flagged as repeat, and a record too many or too few. No records have the rate null.
    """
    told = flags.groupBy("key").agg(F.count("*").alias("n"), F.sum((~F.col("seen_before")).cast("int")).alias("firsts"), F.min(F.when(~F.col("seen_before"), F.col("seq"))).alias("first"))
    true = records.filter(F.col(key).isNotNull() & F.col(seq).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.count("*").alias("m"), F.min(seq).alias("least"))
    both = true.join(told, "key", "full")
    n, m, found = F.coalesce("n", F.lit(0)), F.coalesce("m", F.lit(0)), F.coalesce(F.col("first") == F.col("least"), F.lit(False))
    wrong = F.abs(n - m) + F.coalesce("firsts", F.lit(0)) - F.when(found, 1).otherwise(0) + F.when(found | F.col("m").isNull() | F.col("n").isNull(), 0).otherwise(1)
    all_ = both.agg(F.sum(n).alias("n_records"), F.sum(n - F.coalesce("firsts", F.lit(0))).alias("n_repeats"), F.sum(wrong).alias("n_wrong"))
    return all_.withColumn("wrong_rate", F.col("n_wrong") / F.col("n_records"))


def _flags(spark: SparkSession, sf_dir: str, batches: int = 4) -> DataFrame:
    """The k-mer records in the order of their files, in about ``batches`` micro-batches, or one for each file if these are fewer."""
    rows = table(spark, sf_dir, "kmers").select("kmer", "seq_no")
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/kmers.parquet")
    size = at.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(at).getLength()
    stream = spark.readStream.schema(rows.schema).option("maxBytesPerTrigger", size // batches + 1).parquet(f"{sf_dir}/kmers.parque[t]")  # a pattern also takes a single file
    return seen_before(stream, "kmer", "seq_no", rows.count() // KEYS_PER_BUCKET + 1, prepare=_coding(K))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats(_flags(spark, sf_dir)).select(F.col("seq").alias("seq_no"))


def p7_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settled(_flags(spark, sf_dir)).select(F.col("seq").alias("seq_no"), unpack(F.col("key"), K).alias("kmer"), "seen_before")


def p7_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records, repeats and wrong answers of ``p7_flags``, checked against a plain aggregation of the table."""
    return error_rate(settled(_flags(spark, sf_dir)), coded(table(spark, sf_dir, "kmers"), "seq_no"), "code", "seq_no")


SQL = {
    "p7_found": f"WITH {VALID_SQL} SELECT seq_no FROM (SELECT seq_no, row_number() OVER (PARTITION BY c ORDER BY seq_no) AS r FROM ok) WHERE r > 1",
    "p7_flags": f"WITH {VALID_SQL} SELECT seq_no, c AS kmer, row_number() OVER (PARTITION BY c ORDER BY seq_no) > 1 AS seen_before FROM ok",
    "p7_rate": f"WITH {VALID_SQL} SELECT count(*) AS n_records, count(*) - count(DISTINCT c) AS n_repeats, CAST(0 AS BIGINT) AS n_wrong, CAST(0 AS DOUBLE) AS wrong_rate FROM ok",
}
QUERIES = {"p7_found": p7_found, "p7_flags": p7_flags, "p7_rate": p7_rate}
