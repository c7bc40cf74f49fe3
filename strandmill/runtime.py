"""Tables, shared scratch space and distributed prefix sums."""

from __future__ import annotations

import atexit
import shutil
import sys
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F, types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from ``spark.checkpoint.dir``.

    Only a local session may go without the setting: it then gets a folder of its own, removed at exit.
    """
    sc = spark.sparkContext
    if found := sc.getConf().get("spark.checkpoint.dir") or getattr(shared_dir, "own", None):
        return found.rstrip("/")
    if not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    shared_dir.own = tempfile.mkdtemp(prefix="strandmill-")
    atexit.register(shutil.rmtree, shared_dir.own, ignore_errors=True)
    return shared_dir.own


def scratch(spark: SparkSession, what: str) -> str:
    """A new path under the shared folder. What an application leaves there goes when its Python ends."""
    home = f"{shared_dir(spark)}/strandmill/{spark.sparkContext.applicationId}"
    if home not in _homes:
        _homes.add(home)
        atexit.register(_forget, spark, home)
    return f"{home}/{what}-{uuid.uuid4().hex[:12]}"


_homes: set[str] = set()


def _forget(spark: SparkSession, home: str) -> None:
    try:
        remove(spark, home)
    except Exception as e:  # the session may have been stopped, and its files with it
        print(f"{home} was not removed: {type(e).__name__}", file=sys.stderr) if spark._jsc is not None and not spark._jsc.sc().isStopped() else None


def materialise(df: DataFrame, what: str = "table", instead_of: DataFrame | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts the lineage, survives lost executors.

    The table of ``instead_of``, an earlier result of this function that nothing else reads any more, is deleted then.
    """
    return measured(df, what, instead_of)[0]


def measured(df: DataFrame, what: str, instead_of: DataFrame | None = None, **metrics: Column) -> tuple[DataFrame, dict]:
    """As ``materialise``, with aggregates over the rows taken while they are written. After a lost task they may count rows twice."""
    spark, path = df.sparkSession, scratch(df.sparkSession, what)
    seen = Observation()
    (df.observe(seen, *[c.alias(n) for n, c in metrics.items()]) if metrics else df).write.parquet(path)
    if (old := getattr(instead_of, "_scratch", None)) is not None:
        remove(spark, old)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    got = seen.get if metrics else {}
    if metrics.keys() - got.keys():  # a plan that is found to be empty observes nothing
        got = out.agg(*[c.alias(n) for n, c in metrics.items()]).first().asDict()
    return out, got


def remove(spark: SparkSession, path: str) -> None:
    """Delete a scratch path through Hadoop's file system API."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def prefix_sums(df: DataFrame, group: str | None, order: list[str], value: str, out: str) -> DataFrame:
    """Add ``out``: the sum of ``value`` (not negative) over the rows of the same group up to this one in ``order``.

    A window would send a whole group to one task. Here rows are range-partitioned by (group, order), each partition
    sums its own rows. Only a partition's first group can go on from an earlier one, so there is at most one offset a partition.
    The result is a written table. ``order`` must be unique within a group for a reproducible result. Null values count 0.
    """
    keys = ([group] if group else []) + order
    schema = T.StructType([*df.schema.fields, T.StructField("_pid", T.IntegerType()), T.StructField("_local", T.LongType())])

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, last, carry = TaskContext.get().partitionId(), None, 0
        for b in batches:
            if not b.num_rows:
                continue
            v = pc.fill_null(b.column(b.schema.get_field_index(value)).cast(pa.int64()), 0).to_numpy(zero_copy_only=False)
            sums = np.cumsum(v)
            if group:
                g = b.column(b.schema.get_field_index(group))
                code = g.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
                new = np.r_[True, code[1:] != code[:-1]]
                new[0] = last is not None and g[0].as_py() != last[0]
                starts = np.flatnonzero(new)
                base = np.zeros(len(v), np.int64)
                base[starts] = np.diff(np.r_[0, sums[starts] - v[starts]])
                base = np.cumsum(base)
                sums = sums - base
                sums[: starts[0] if len(starts) else len(v)] += carry
                last = (g[-1].as_py(),)
            else:
                sums = sums + carry
            carry = int(sums[-1])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(len(v), pid, np.int32)), pa.array(sums)], names=[*b.schema.names, "_pid", "_local"])

    ranged = df.repartitionByRange(*[F.col(k) for k in keys]).sortWithinPartitions(*keys)
    done = materialise(ranged.mapInArrow(local, schema), "sums")
    at = (F.col(group) if group else F.lit(None).cast("string")).alias("_g")
    totals = done.groupBy("_pid", at).agg(F.max("_local").alias("t"))
    spread = totals.groupBy(F.col("_g").alias("_s")).agg(F.count("*").alias("n")).filter("n > 1").drop("n")
    ends = totals.join(spread, F.col("_g").eqNullSafe(F.col("_s"))).select("_pid", "_g", "t").collect()  # a partition shares its first and its last group at most
    before: dict = {}
    offsets = []
    for pid, g, t in sorted(ends, key=lambda r: r[0]):
        if g in before:
            offsets.append((pid, g, before[g]))
        before[g] = before.get(g, 0) + t
    kind = df.schema[group].dataType if group else T.StringType()
    known = df.sparkSession.createDataFrame(offsets, T.StructType([T.StructField("_p", T.IntegerType()), T.StructField("_g", kind), T.StructField("_off", T.LongType())]))
    same = (F.col("_pid") == F.col("_p")) & ((F.col(group).eqNullSafe(F.col("_g"))) if group else F.lit(True))
    total = F.col("_local") + F.coalesce("_off", F.lit(0))
    return done.join(F.broadcast(known), same, "left").withColumn(out, total).drop("_pid", "_local", "_p", "_g", "_off")  # one offset a partition at most
