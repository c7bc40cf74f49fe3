"""Problem 5: a uniform sample of fixed size from data of unknown size that arrives in pieces.

Adaptive Bernoulli sampling: a record's draw is a hash of the job's seed and its identifier, and a partition keeps the
records whose draw is below its inclusion probability, 1 at first. When its buffer overflows, the probability is halved
and the buffer thinned, as long as that leaves the sample's size. Merging takes the lowest probability of any partition
for all; of the records left, the ones with the smallest draws make up the exact size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from strandmill.runtime import materialise, table

DRAW_BITS = 60
BUFFER = 200_000
CUT_BITS = 12


def _thinning(sizes: dict[int, int]):
    def thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[pa.RecordBatch]] = {}
        count: dict[int, int] = {}
        level: dict[int, int] = {}
        seen: dict[int, np.ndarray] = {}  # by job: how many draws are below 2^-l, for each l

        def out(job: int) -> pa.RecordBatch:
            b = pa.Table.from_batches(held.pop(job)).combine_chunks().to_batches()[0]
            count[job] = 0
            return b.append_column("level", pa.array(np.full(b.num_rows, level[job], np.int32)))

        for batch in batches:
            job_of = batch.column(0).to_numpy(zero_copy_only=False)
            for job in np.unique(job_of).tolist():
                rows = batch.filter(pa.array(job_of == job))
                draws = rows.column(1).to_numpy(zero_copy_only=False)
                if job not in seen:
                    seen[job], level[job] = np.zeros(DRAW_BITS + 1, np.int64), 0
                own = DRAW_BITS - np.where(draws > 0, np.floor(np.log2(np.maximum(draws, 1).astype(np.float64))).astype(np.int64) + 1, 0)
                own -= (draws >> np.minimum(DRAW_BITS - own, 62)) > 0  # where rounding to a double passed a power of two
                seen[job] += np.bincount(np.clip(own, 0, DRAW_BITS), minlength=DRAW_BITS + 1)[::-1].cumsum()[::-1]
                if level[job]:
                    rows = rows.filter(pa.array(draws < 1 << (DRAW_BITS - level[job])))
                held.setdefault(job, []).append(rows)
                count[job] = count.get(job, 0) + rows.num_rows
                size = sizes[job]
                if count[job] > min(4 * size + 256, BUFFER):
                    fits = np.flatnonzero(seen[job] >= size)
                    if len(fits) and fits[-1] > level[job]:
                        level[job] = int(fits[-1])
                        kept = [x.filter(pa.array(x.column(1).to_numpy(zero_copy_only=False) < 1 << (DRAW_BITS - level[job]))) for x in held[job]]
                        held[job], count[job] = kept, sum(x.num_rows for x in kept)
                    if count[job] > BUFFER // 2:  # the sample itself is larger than the buffer
                        yield out(job)
        for job in list(held):
            yield out(job)

    return thin


def fixed_size_samples(records: DataFrame, jobs: DataFrame) -> DataFrame:
    """``(job_id, record_id, draw, level)``: for each job exactly ``sample_size`` of its records, or all if there are fewer.

    ``records`` is ``(record_id, part)`` with repeated deliveries; a record counts once, in its smallest part. Null record
    identifiers are no records. ``jobs`` is ``(job_id, part, seed, sample_size)``, null part: all records. A job without
    a seed or with no positive size is unusable and has no rows. Jobs with equal seeds draw alike. ``level`` is the
    number of halvings that the merged sample had. The number of jobs must be moderate: they go to every task.
    """
    wanted = jobs.filter("seed IS NOT NULL AND sample_size > 0 AND job_id IS NOT NULL").select("job_id", F.col("part").alias("_part"), "seed", "sample_size")
    rows = wanted.take(10_001)
    if len(rows) > 10_000:
        raise ValueError("more than 10,000 sampling jobs at once: run them in blocks")
    sizes = {r.job_id: r.sample_size for r in rows}
    known = records.sparkSession.createDataFrame([tuple(r) for r in rows], wanted.schema)
    distinct = records.filter("record_id IS NOT NULL").groupBy("record_id").agg(F.min("part").alias("part"))
    draw = F.conv(F.substring(F.md5(F.concat_ws(":", F.col("seed").cast("string"), F.col("record_id").cast("string"))), 1, DRAW_BITS // 4), 16, 10).cast("bigint")
    pick = lambda j: j.select(F.col("job_id").cast("bigint"), draw.alias("draw"), "record_id")
    drawn = pick(distinct.join(F.broadcast(known.filter("_part IS NOT NULL")), F.col("part") == F.col("_part")))
    if every := [r for r in rows if r._part is None]:
        each = F.explode(F.array(*[F.struct(F.lit(r.job_id).alias("job_id"), F.lit(r.seed).alias("seed")) for r in every]))
        drawn = drawn.unionByName(pick(distinct.select("record_id", each.alias("j")).select("record_id", "j.*")))
    kept = materialise(drawn.mapInArrow(_thinning(sizes), "job_id bigint, draw bigint, record_id bigint, level int"), "drawn")

    sized = records.sparkSession.createDataFrame(list(sizes.items()), "job_id bigint, size bigint")
    lowest = kept.groupBy("job_id").agg(F.max("level").alias("level"))
    equal = kept.drop("level").join(F.broadcast(lowest.join(sized, "job_id")), "job_id").filter(F.col("draw") < F.expr(f"shiftright(bigint(1) << {DRAW_BITS}, level)"))
    slot = F.expr(f"shiftright(draw, greatest({DRAW_BITS - CUT_BITS} - level, 0))").alias("slot")
    counts = equal.groupBy("job_id", "size", slot).agg(F.count("*").alias("n"))
    up_to = counts.withColumn("upto", F.sum("n").over(Window.partitionBy("job_id").orderBy("slot")))  # at most 2^CUT_BITS rows a job
    fate = F.broadcast(up_to.select("job_id", "slot", (F.col("size") - F.col("upto") + F.col("n")).alias("room"), "n").filter("room > 0"))
    placed = equal.withColumn("slot", slot).join(fate, ["job_id", "slot"])
    whole = placed.filter("n <= room")
    cut = placed.filter("n > room").withColumn("_r", F.row_number().over(Window.partitionBy("job_id").orderBy("draw", "record_id"))).filter("_r <= room")
    return whole.select("job_id", "record_id", "draw", "level").unionByName(cut.select("job_id", "record_id", "draw", "level"))


def _usable(jobs: DataFrame) -> DataFrame:
    return jobs.filter("probability > 0 AND probability <= 1").select("job_id", F.col("file_id").alias("part"), "seed", "sample_size")


def p5_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    reads = table(spark, sf_dir, "reads_fastq").select(F.col("read_id").alias("record_id"), F.col("file_id").alias("part"))
    return fixed_size_samples(reads, _usable(table(spark, sf_dir, "subsampler"))).select("job_id", F.col("record_id").alias("read_id"))


def p5_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each usable job the reads it asked for and got."""
    jobs = _usable(table(spark, sf_dir, "subsampler")).filter("seed IS NOT NULL AND sample_size > 0").select(F.col("job_id").cast("bigint"), "sample_size")
    got = p5_sample(spark, sf_dir).groupBy("job_id").agg(F.count("*").alias("n"))
    return jobs.join(got, "job_id", "left").select("job_id", "sample_size", F.coalesce("n", F.lit(0)).alias("n_reads"))


_SAMPLE_SQL = """WITH reads AS (SELECT read_id, min(file_id) AS file_id FROM reads_fastq WHERE read_id IS NOT NULL GROUP BY read_id),
jobs AS (SELECT * FROM subsampler WHERE probability > 0 AND probability <= 1 AND seed IS NOT NULL AND sample_size > 0),
drawn AS (SELECT job_id, sample_size, read_id, row_number() OVER (PARTITION BY job_id ORDER BY substr(md5(CAST(seed AS BIGINT) || ':' || read_id), 1, 15), read_id) AS r
          FROM jobs JOIN reads ON jobs.file_id IS NULL OR jobs.file_id = reads.file_id)
"""
SQL = {
    "p5_sample": _SAMPLE_SQL + "SELECT CAST(job_id AS BIGINT) AS job_id, read_id FROM drawn WHERE r <= sample_size",
    "p5_sizes": _SAMPLE_SQL + ", n AS (SELECT job_id, count(*) AS n FROM drawn WHERE r <= sample_size GROUP BY job_id) SELECT CAST(job_id AS BIGINT) AS job_id, sample_size, coalesce(n, 0) AS n_reads FROM jobs LEFT JOIN n USING (job_id)",
}
QUERIES = {"p5_sample": p5_sample, "p5_sizes": p5_sizes}
