"""Scans of sequence files: FASTA, FASTQ, FASTA with qualities, colour space, file lists and assembler logs."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from strandmill.functions.seq import from_colours
from strandmill.runtime import prefix_sums

FORMATS = ("FASTA", "FASTQ", "CTX", "ROCHE", "HASH", "CSFASTA", "KMERS")


def parse_format(name: str | None) -> str:
    """Upper-case name of a format, ``UNSPECIFIED`` if it is none."""
    return name.strip().upper() if name and name.strip().upper() in FORMATS else "UNSPECIFIED"


def _with_ordinals(entries: DataFrame) -> DataFrame:
    """Add ``read_id``, from 0 in the order of file, block and row; without a single-task window."""
    numbered = prefix_sums(entries.withColumn("_one", F.lit(1).cast("bigint")), None, ["_file", "_block", "_row"], "_one", "_n")
    return numbered.withColumn("read_id", F.col("_n") - 1).drop("_one", "_n", "_block", "_row")


def read_fasta(spark: SparkSession, paths: str | list[str], ordinals: bool = False) -> DataFrame:
    """``(name, seq, source_file)``, one row an entry, and ``read_id`` with ``ordinals``.

    The text source splits files at the header marks, so large files are read in parallel. The name ends at the first
    blank, sequence lines are cut at their first blank and joined, lines that start with ``#`` are comments, all symbols
    and cases are kept. An entry without sequence has an empty one.
    """
    raw = spark.read.option("lineSep", "\n>").text(paths).select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_row"))
    entries = raw.filter(~F.startswith("value", F.lit("#")) & (F.trim("value") != ""))
    lines = F.split(F.regexp_replace("value", "^>", ""), "\n")
    body = F.filter(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))), lambda x: ~F.startswith(x, F.lit("#")))
    seq = F.array_join(F.transform(body, lambda x: F.regexp_extract(x, r"^\S*", 0)), "")
    out = entries.select(F.regexp_extract(F.get(lines, F.lit(0)), r"^[^ \t\r]*", 0).alias("name"), seq.alias("seq"), "_file", "_block", "_row")
    return (_with_ordinals(out) if ordinals else out.drop("_block", "_row")).withColumnRenamed("_file", "source_file")


_VALID = set("ACGTNacgtn")


def fastq_records(text: str, offset: int = 33, keep_bad: bool = False) -> Iterator[tuple[str, str, list[int]]]:
    """Records of FASTQ text with sequences and qualities over any number of lines.

    A quality ends once it is as long as the sequence, so ``@`` may start one of its lines. ``.`` becomes N. A record of
    unequal lengths is skipped, and one with symbols other than ACGTN too, unless ``keep_bad``.
    """
    lines, i = text.split("\n"), 0
    while i < len(lines):
        line = lines[i].rstrip("\r")
        i += 1
        if not line.startswith("@"):
            continue
        name, seq, qual = line[1:].split("\t")[0], "", ""
        while i < len(lines) and not lines[i].startswith("+"):
            seq += lines[i].rstrip("\r")
            i += 1
        i += 1
        while i < len(lines) and len(qual) < len(seq):
            qual += lines[i].rstrip("\r")
            i += 1
        while i < len(lines) and lines[i] and not lines[i].startswith("@"):  # more qualities than bases
            qual += lines[i].rstrip("\r")
            i += 1
        seq = seq.replace(".", "N")
        if seq and len(seq) == len(qual) and (keep_bad or set(seq) <= _VALID):
            yield name, seq, [ord(c) - offset for c in qual]


def parse_fastq_texts(texts: DataFrame, offset: int = 33, keep_bad: bool = False) -> DataFrame:
    """``(name, seq, qual, source_file)`` from rows ``(value, source_file)`` that each hold whole records. Also takes a stream."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for text, where in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                rows = list(fastq_records(text or "", offset, keep_bad))
                for at in range(0, len(rows), 10_000):
                    part = rows[at : at + 10_000]
                    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in part]), pa.array([r[1] for r in part]), pa.array([r[2] for r in part], pa.list_(pa.int32())), pa.array([where] * len(part))], names=["name", "seq", "qual", "source_file"])

    return texts.select("value", "source_file").mapInArrow(parse, "name string, seq string, qual array<int>, source_file string")


def read_fastq(spark: SparkSession, paths: str | list[str], offset: int = 33, keep_bad: bool = False, four_line: bool = False) -> DataFrame:
    """``(name, seq, qual, source_file)`` of FASTQ files.

    In general a file is parsed by one task, as only its start says where records begin. With ``four_line``, for files that
    hold each record on four lines, it is split: lines are numbered by distributed prefix sums and joined by four.
    """
    if not four_line:
        return parse_fastq_texts(spark.read.text(paths, wholetext=True).select("value", F.col("_metadata.file_path").alias("source_file")), offset, keep_bad)
    raw = spark.read.text(paths).select(F.rtrim("value", F.lit("\r")).alias("value"), F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_row"), F.lit(1).cast("bigint").alias("_one"))
    n = prefix_sums(raw, "_file", ["_block", "_row"], "_one", "_n").withColumn("_n", F.col("_n") - 1)
    part = lambda i: F.max(F.when(F.col("_n") % 4 == i, F.col("value")))
    whole = n.groupBy("_file", F.floor(F.col("_n") / 4).alias("_r")).agg(part(0).alias("h"), F.replace(part(1), F.lit("."), F.lit("N")).alias("seq"), part(3).alias("q"))
    good = whole.filter((F.length("seq") == F.length("q")) & (F.length("seq") > 0) & (F.lit(keep_bad) | F.regexp_like("seq", F.lit("^[ACGTNacgtn]+$"))))
    return good.select(F.regexp_extract("h", r"^@([^\t]*)", 1).alias("name"), "seq", F.transform(F.split("q", ""), lambda c: F.ascii(c) - offset).alias("qual"), F.col("_file").alias("source_file"))


def read_fasta_and_qual(spark: SparkSession, fasta: str, qual: str) -> DataFrame:
    """``(read_id, name, seq, qual)``: entries of two files joined by their ordinal; qualities are integers between blanks."""
    a = read_fasta(spark, fasta, ordinals=True).select("read_id", "name", "seq")
    raw = spark.read.option("lineSep", "\n>").text(qual).select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_row"))
    numbers = F.filter(F.split(F.regexp_replace("value", r"^[^\n]*", ""), r"\s+"), lambda x: x != "")
    b = _with_ordinals(raw.filter(~F.startswith("value", F.lit("#")) & (F.trim("value") != "")).select(F.transform(numbers, lambda x: x.cast("int")).alias("qual"), "_file", "_block", "_row"))
    return a.join(b.select("read_id", "qual"), "read_id", "left")


def read_csfasta(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Colour-space FASTA, with the bases it decodes to."""
    return read_fasta(spark, paths).withColumn("bases", from_colours(F.col("seq")))


def read_pairs(first: DataFrame, second: DataFrame) -> DataFrame:
    """Mates of two scans with ordinals, by position: ``(read_id, name1, seq1, name2, seq2)``."""
    side = lambda df, i: df.select("read_id", F.col("name").alias(f"name{i}"), F.col("seq").alias(f"seq{i}"))
    return side(first, 1).join(side(second, 2), "read_id")


def read_file_list(spark: SparkSession, path: str) -> list[tuple[str, int, int]]:
    """Lines ``filename [colour] [pair]`` as ``(filename, colour, pair)``, 0 where missing. One line a file, so it is small."""
    rows = []
    for (line,) in spark.read.text(path).collect():
        parts = line.split()
        if parts and not parts[0].startswith("#"):
            rows.append((parts[0], int(parts[1]) if len(parts) > 1 else 0, int(parts[2]) if len(parts) > 2 else 0))
    return rows


def read_listed(spark: SparkSession, path: str, fmt: str, offset: int = 33) -> DataFrame:
    """All files of a list as ``(name, seq, source_file, colour)``."""
    out = None
    for name, colour, _ in read_file_list(spark, path):
        one = read_reads(spark, name, fmt, offset).select("name", "seq", "source_file").withColumn("colour", F.lit(colour))
        out = one if out is None else out.unionByName(one)
    return out if out is not None else spark.createDataFrame([], "name string, seq string, source_file string, colour int")


def read_reads(spark: SparkSession, paths: str | list[str], fmt: str, offset: int = 33) -> DataFrame:
    """Dispatch by format; other formats hold no reads."""
    match parse_format(fmt):
        case "FASTA":
            return read_fasta(spark, paths)
        case "FASTQ":
            return read_fastq(spark, paths, offset)
        case "CSFASTA":
            return read_csfasta(spark, paths)
        case other:
            raise ValueError(f"no reads in format {other}")


def read_pair_libraries(spark: SparkSession, path: str) -> DataFrame:
    """``(first, second, distance, tolerance, min_coverage, max_coverage)`` from lines of that order between blanks."""
    p = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).filter((F.trim("value") != "") & ~F.startswith("value", F.lit("#")))
    kinds = {"first": "string", "second": "string", "distance": "int", "tolerance": "int", "min_coverage": "int", "max_coverage": "int"}
    return rows.select(*[F.get(p, F.lit(i)).cast(t).alias(c) for i, (c, t) in enumerate(kinds.items())])


def read_assembler_log(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``(source_file, line_no, stamp, section, key, value)``: the ``key: value`` and ``key = value`` lines of logs, whole files at a time.

    A line in capitals without a value starts a section. A time in square brackets at the start of a line is its stamp.
    """

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import re

        item, stamp_at = re.compile(r"^\s*([A-Za-z][^:=]*?)\s*[:=]\s*(\S.*?)\s*$"), re.compile(r"^\[([^\]]+)\]\s*")
        for b in batches:
            out: list[tuple] = []
            for text, where in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                section = None
                for no, line in enumerate((text or "").split("\n")):
                    stamp = None
                    if m := stamp_at.match(line):
                        stamp, line = m[1], line[m.end() :]
                    if m := item.match(line):
                        out.append((where, no, stamp, section, m[1], m[2]))
                    elif line.strip() and line.strip() == line.strip().upper() and any(c.isalpha() for c in line):
                        section = line.strip()
            kinds = [pa.string(), pa.int32(), *[pa.string()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names=["source_file", "line_no", "stamp", "section", "key", "value"])

    texts = spark.read.text(paths, wholetext=True).select("value", F.col("_metadata.file_path").alias("f"))
    return texts.mapInArrow(parse, "source_file string, line_no int, stamp string, section string, key string, value string")
