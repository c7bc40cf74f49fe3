"""Queries that write tables to the file formats and read them back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from strandmill.operators.kmers import FASTA_SQL, HITS_SQL, READS_SQL, SET_SQL, _hits, dumped_set, fasta_reads, fastq_reads, route
from strandmill.operators.readstats import SQL as READ_SQL, demultiplex
from strandmill.runtime import scratch
from strandmill.sources import kmer_files as KF, readers as R, set_image as I, writers as W


def _named(df: DataFrame) -> DataFrame:
    return df.withColumn("name", F.concat(F.lit("r"), F.col("read_id").cast("string")))


def fasta_roundtrip(s: SparkSession, d: str) -> DataFrame:
    path = scratch(s, "fasta")
    W.write_reads(_named(fasta_reads(s, d)), path, "FASTA")
    return R.read_fasta(s, path).select("name", "seq")


def _good(s: SparkSession, d: str) -> DataFrame:
    return _named(fastq_reads(s, d)).filter((F.size("qual") == F.length("seq")) & (F.array_max("qual") <= 93) & (F.array_min("qual") >= 0))


def fastq_roundtrip(s: SparkSession, d: str) -> DataFrame:
    path = scratch(s, "fastq")
    W.write_reads(_good(s, d), path, "FASTQ")
    return R.read_fastq(s, path).select("name", "seq", "qual")


def fastq_four_line_roundtrip(s: SparkSession, d: str) -> DataFrame:
    path = scratch(s, "fastq4")
    W.write_reads(_good(s, d), path, "FASTQ")
    return R.read_fastq(s, path, four_line=True).select("name", "seq", "qual")


def kmer_file_roundtrip(s: SparkSession, d: str) -> DataFrame:
    path = local_path(scratch(s, "kmers"))
    KF.write_kmers(dumped_set(s, d, 0), path, 21)
    return KF.read_kmers(s, path, 21).select("kmer", "coverage", "edges")


def set_image_roundtrip(s: SparkSession, d: str) -> DataFrame:
    path = scratch(s, "image")
    I.save_image(dumped_set(s, d), path, 21)
    return I.load_image(s, path, 21)


def coverage_tables(s: SparkSession, d: str) -> DataFrame:
    """Both tables, written and read again: ``kmer`` is null for the rows of the first one."""
    path = scratch(s, "coverage")
    W.write_coverage_tables(dumped_set(s, d, 0), path)
    read = lambda p, schema: s.read.schema(schema).option("sep", "\t").option("header", True).csv(p)
    counts = read(f"{path}.tab", "coverage bigint, n_kmers bigint").select(F.lit(None).cast("string").alias("kmer"), "coverage", "n_kmers")
    return counts.unionByName(read(f"{path}_kmer.tab", "kmer string, coverage bigint").withColumn("n_kmers", F.lit(1).cast("bigint")))


def filter_folders(s: SparkSession, d: str) -> DataFrame:
    """Reads written to one folder for each number of hits, counted in the folders."""
    path, reads = scratch(s, "bins"), fastq_reads(s, d).filter("length(seq) > 0")
    bins = route(_hits(s, d), 0).select("read_id", "bin")
    W.write_reads(reads.join(bins, "read_id"), path, "FASTA", by=["bin"])
    entries = s.read.text(path).filter(F.startswith("value", F.lit(">")))
    return entries.groupBy(F.col("bin").cast("string").alias("bin")).agg(F.count("*").alias("n"))


def demultiplex_folders(s: SparkSession, d: str) -> DataFrame:
    """Reads written to one folder for each index, counted in the folders; those without one are in the default folder, here null."""
    path = scratch(s, "index")
    W.write_reads(demultiplex(fastq_reads(s, d).filter("length(seq) > 0")), path, "FASTA", by=["index"])
    entries = s.read.text(path).filter(F.startswith("value", F.lit(">")))
    return entries.groupBy(F.col("index").cast("string").alias("index")).agg(F.count("*").alias("n"))


def local_path(path: str) -> str:
    """The writer of binary files works on a mounted path."""
    return path.removeprefix("file://").removeprefix("file:")


_FASTQ = f"WITH {READS_SQL} SELECT 'r' || read_id AS name, replace(seq, '.', 'N') AS seq, qual FROM reads WHERE len(qual) = length(seq) AND list_max(qual) <= 93 AND list_min(qual) >= 0 AND regexp_full_match(replace(seq, '.', 'N'), '[ACGTNacgtn]+')"
QUERIES = {"fasta_roundtrip": fasta_roundtrip, "fastq_roundtrip": fastq_roundtrip, "fastq_four_line_roundtrip": fastq_four_line_roundtrip, "kmer_file_roundtrip": kmer_file_roundtrip, "set_image_roundtrip": set_image_roundtrip, "coverage_tables": coverage_tables, "filter_folders": filter_folders, "demultiplex_folders": demultiplex_folders}
SQL = {
    "fasta_roundtrip": f"WITH {FASTA_SQL} SELECT 'r' || read_id AS name, seq FROM fasta WHERE length(seq) > 0",
    "fastq_roundtrip": _FASTQ,
    "fastq_four_line_roundtrip": _FASTQ,
    "kmer_file_roundtrip": f"WITH {SET_SQL} SELECT kmer, coverage, edges FROM kset WHERE colour = 0",
    "set_image_roundtrip": f"WITH {SET_SQL} SELECT * FROM kset",
    "coverage_tables": f"WITH {SET_SQL} SELECT NULL AS kmer, coverage, count(*) AS n_kmers FROM kset WHERE colour = 0 GROUP BY coverage UNION ALL SELECT kmer, coverage, 1 FROM kset WHERE colour = 0",
    "filter_folders": f"WITH {HITS_SQL} SELECT 'KMERS' || hits AS bin, count(*) AS n FROM hits SEMI JOIN (SELECT read_id FROM reads WHERE length(seq) > 0) USING (read_id) GROUP BY hits",
    "demultiplex_folders": READ_SQL["demultiplex_counts"].replace("FROM reads GROUP BY 1", "FROM reads WHERE length(seq) > 0 GROUP BY 1"),
}
