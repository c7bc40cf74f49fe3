"""Streaming forms of the screening operators: a static k-mer set probed by a stream of reads, and running counts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from strandmill.operators.kmers import SCREEN_K, HITS_SQL, count_kmers, fasta_reads, hits_per_read, kmers_sql, occurrences, route
from strandmill.runtime import remove, scratch
from strandmill.sources.readers import parse_fastq_texts
from strandmill.sources.writers import write_reads


def fastq_stream(spark: SparkSession, folder: str, offset: int = 33, keep_bad: bool = False) -> DataFrame:
    """Reads of the FASTQ files that arrive in a folder, each file whole: ``(name, seq, qual, source_file)``. No state is kept."""
    texts = spark.readStream.option("wholetext", "true").text(folder, wholetext=True)
    return parse_fastq_texts(texts.select("value", F.col("_metadata.file_path").alias("source_file")), offset, keep_bad)


def spool(lines, folder: str, records: int = 100_000) -> int:
    """Cut a stream of four-line FASTQ text, such as stdin, into files of whole records that ``fastq_stream`` takes up; the number of files."""
    import os

    os.makedirs(folder, exist_ok=True)
    held, files = [], 0

    def put() -> None:
        nonlocal files
        own = os.path.join(folder, f".part-{files:08d}.fastq")
        with open(own, "w") as f:
            f.writelines(held)
        os.replace(own, os.path.join(folder, f"part-{files:08d}.fastq"))  # a file appears whole
        files += 1
        held.clear()

    for line in lines:
        held.append(line)
        if len(held) == 4 * records:
            put()
    if held:
        put()
    return files


def screen_stream(reads: DataFrame, reference: DataFrame, k: int, checkpoint: str, each: Callable[[DataFrame, int], None], threshold: int = 1, ident: str = "read_id") -> StreamingQuery:
    """Route a stream of reads: every micro-batch is screened against the static set, and ``each`` gets it with ``hits`` and ``bin``."""

    def batch(df: DataFrame, number: int) -> None:
        keyed = df.withColumnRenamed(ident, "read_id") if ident != "read_id" else df
        hits = route(hits_per_read(keyed, reference, k), threshold)
        each(keyed.join(hits, "read_id"), number)

    return reads.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def write_bins(path: str, fmt: str = "FASTQ") -> Callable[[DataFrame, int], None]:
    """A sink for ``screen_stream``: text in one folder for each bin. A batch that is run again replaces its own folder."""
    return lambda df, number: write_reads(df, f"{path}/batch={number}", fmt, by=["bin"], mode="overwrite")


def running_counts(reads: DataFrame, k: int) -> DataFrame:
    """Streaming ``(kmer, coverage)``, for output mode update or complete; the state is one counter a k-mer."""
    return occurrences(reads, k).groupBy("kmer").agg(F.count("*").alias("coverage"))


def windowed_events(events: DataFrame, late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """An extension: events by type and window of event time, with a watermark for late ones."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def _stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}.parque[t]")


def _run(spark: SparkSession, start: Callable[[str, Callable[[DataFrame, int], None]], StreamingQuery], schema: str) -> DataFrame:
    """Run a query over all that is there and return what its batches wrote."""
    out, state = scratch(spark, "streamed"), scratch(spark, "stream-state")
    start(state, lambda df, n: df.write.mode("overwrite").parquet(f"{out}/batch={n}")).awaitTermination()
    remove(spark, state)
    return spark.read.schema(schema).parquet(out)


def _screened(s: SparkSession, d: str) -> DataFrame:
    reads = _stream(s, d, "reads_fastq").select("read_id", "seq").dropDuplicates(["read_id"])
    reference = count_kmers(fasta_reads(s, d), SCREEN_K)
    got = _run(s, lambda state, each: screen_stream(reads, reference, SCREEN_K, state, lambda df, n: each(df.select("read_id", "hits", "bin"), n), 20), "read_id bigint, hits bigint, bin string")
    return got.select("read_id", "hits", "bin")


def _counted(s: SparkSession, d: str) -> DataFrame:
    reads = _stream(s, d, "reads_fastq").select("read_id", "seq")
    got = _run(s, lambda state, each: running_counts(reads, 21).writeStream.outputMode("update").foreachBatch(each).option("checkpointLocation", state).trigger(availableNow=True).start(), "kmer string, coverage bigint")
    return got.groupBy("kmer").agg(F.max("coverage").alias("coverage"))  # counts only grow


QUERIES = {"stream_screen": _screened, "stream_counts": _counted}
SQL = {
    "stream_screen": f"WITH {HITS_SQL} SELECT read_id, hits, CASE WHEN hits < 20 THEN 'clean' ELSE 'contaminated' END AS bin FROM hits",
    "stream_counts": f"WITH {kmers_sql('reads_fastq', 21, 'rk')} SELECT kmer, count(*) AS coverage FROM rk GROUP BY kmer",
}
