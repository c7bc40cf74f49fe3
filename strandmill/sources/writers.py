"""Text sinks: FASTA, FASTQ, binned and demultiplexed outputs, tables with tabs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def fasta_text(name: Column, seq: Column, width: int = 0) -> Column:
    """A FASTA entry without its last line end; lines of ``width`` bases if it is set; null without a sequence."""
    body = F.rtrim(F.regexp_replace(seq, f"(.{{{width}}})", "$1\n"), F.lit("\n")) if width else seq
    return F.when(F.length(seq) > 0, F.concat(F.lit(">"), F.coalesce(name, F.lit("")), F.lit("\n"), body))


def fastq_text(name: Column, seq: Column, qual: Column, offset: int = 33) -> Column:
    """A FASTQ record without its last line end; missing qualities are 0, as many as there are bases."""
    n = F.length(seq)
    q = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.chr(F.coalesce(F.get(qual, i), F.lit(0)) + offset))
    return F.when(n > 0, F.concat(F.lit("@"), F.coalesce(name, F.lit("")), F.lit("\n"), seq, F.lit("\n+\n"), F.array_join(q, "")))


def _text(reads: DataFrame, fmt: str, offset: int) -> Column:
    return fastq_text(F.col("name"), F.col("seq"), F.col("qual"), offset) if fmt.upper() == "FASTQ" else fasta_text(F.col("name"), F.col("seq"))


def write_reads(reads: DataFrame, path: str, fmt: str, offset: int = 33, mode: str = "errorifexists", by: list[str] | None = None) -> None:
    """Write reads as text, in one folder for each value of the columns ``by`` (mate and bin, index, ...)."""
    rows = reads.select(*(by or []), _text(reads, fmt, offset).alias("value")).filter("value IS NOT NULL")
    writer = rows.write.mode(mode)
    (writer.partitionBy(*by) if by else writer).text(path)


def write_tsv(df: DataFrame, path: str, mode: str = "append") -> None:
    """A table with tabs and a header; appending adds files, which needs no lock between programs."""
    df.write.mode(mode).option("sep", "\t").option("header", True).csv(path)


def contig_text(contigs: DataFrame) -> DataFrame:
    """``value``: contigs ``(path_id, seq, n_kmers, avg_coverage, min_coverage, max_coverage)`` as FASTA, 80 bases a line."""
    head = F.format_string("node_%d length:%d average_coverage:%.2f min_coverage:%d max_coverage:%d", "path_id", F.length("seq"), "avg_coverage", "min_coverage", "max_coverage")
    return contigs.select(fasta_text(head, F.col("seq"), 80).alias("value")).filter("value IS NOT NULL")


def coverage_list(first: Column, coverages: Column, k: int) -> Column:
    """Coverages by base: the first k-mer's for the leading k - 1 bases, then one a k-mer."""
    return F.concat(F.array_repeat(first, k - 1), coverages)


def write_coverage_tables(kmer_set: DataFrame, path: str) -> None:
    """Two tables with tabs: ``<path>.tab``, how many k-mers have each coverage, and ``<path>_kmer.tab``, the coverage of each k-mer."""
    write_tsv(kmer_set.groupBy("coverage").agg(F.count("*").alias("n_kmers")), f"{path}.tab", "errorifexists")
    write_tsv(kmer_set.select("kmer", "coverage"), f"{path}_kmer.tab", "errorifexists")
