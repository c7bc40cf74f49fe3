"""Binary k-mer files: a Python data source that reads them by record ranges, and a writer.

Layout, little-endian: magic (6 bytes), version 5, k, number of 64-bit words a k-mer, number of colours, mean read length (all
32-bit), total reads (64-bit), magic. Then records: the words, most significant first, coverage (32-bit), edges (8-bit).
"""

from __future__ import annotations

import glob
import os
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# Fixed values of the file format.
MAGICS = {b"KMERS ": "KMERS", b"CORTEX": "CTX"}
VERSION = 5
HEADER = "<6sIIIIIQ6s"
HEADER_SIZE = struct.calcsize(HEADER)
SCHEMA = "kmer string, colour int, coverage bigint, edges int, source_file string"


def words_for(k: int) -> int:
    return k // 32 + 1


def _dtype(words: int) -> np.dtype:
    return np.dtype([("words", "<u8", (words,)), ("coverage", "<u4"), ("edges", "u1")])


def read_header(path: str) -> dict:
    """The header of a file; raises where magic, version, words or colours don't fit or its size is no whole number of records."""
    with open(path, "rb") as f:
        raw = f.read(HEADER_SIZE)
    if len(raw) < HEADER_SIZE:
        raise ValueError(f"{path}: too short for a header")
    magic, version, k, words, colours, mean_read_len, total_reads, end = struct.unpack(HEADER, raw)
    if magic not in MAGICS or end != magic:
        raise ValueError(f"{path}: not a k-mer file")
    if version != VERSION or colours != 1 or words != words_for(k):
        raise ValueError(f"{path}: version {version}, {colours} colours, {words} words for k = {k} can't be read")
    rest = os.path.getsize(path) - HEADER_SIZE
    if rest % _dtype(words).itemsize:
        raise ValueError(f"{path}: broken last record")
    return {"format": MAGICS[magic], "k": k, "words": words, "mean_read_len": mean_read_len, "total_reads": total_reads, "records": rest // _dtype(words).itemsize}


def decode(words: np.ndarray, k: int) -> list[str]:
    """K-mers of rows of words."""
    at = np.arange(k - 1, -1, -1)
    codes = (words[:, words.shape[1] - 1 - at // 32] >> (2 * (at % 32)).astype(np.uint64)) & np.uint64(3)
    letters = np.frombuffer(b"ACGT", np.uint8)[codes.astype(np.int64)]
    text = letters.tobytes().decode()
    return [text[i : i + k] for i in range(0, len(text), k)]


def encode(kmers: list[str], k: int) -> np.ndarray:
    letters = np.frombuffer("".join(kmers).encode(), np.uint8).reshape(len(kmers), k)
    digit = np.zeros(256, np.uint64)
    digit[list(b"ACGT")] = np.arange(4)
    out = np.zeros((len(kmers), words_for(k)), np.uint64)
    for i in range(k):
        p = k - 1 - i
        out[:, out.shape[1] - 1 - p // 32] |= digit[letters[:, i]] << np.uint64(2 * (p % 32))
    return out


class _Range(InputPartition):
    def __init__(self, path: str, start: int, count: int, k: int, words: int):
        self.path, self.start, self.count, self.k, self.words = path, start, count, k, words


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = sorted(glob.glob(options["path"])) if not os.path.isdir(options["path"]) else sorted(glob.glob(os.path.join(options["path"], "*")))
        self.k, self.colour, self.step = int(options.get("k", 0)), int(options.get("colour", 0)), int(options.get("recordsperpartition", 1_000_000))

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        for path in self.paths:
            h = read_header(path)
            if self.k and h["k"] != self.k:
                raise ValueError(f"{path}: k is {h['k']}, not {self.k}")
            out += [_Range(path, a, min(self.step, h["records"] - a), h["k"], h["words"]) for a in range(0, h["records"], self.step)]
        return out or [_Range("", 0, 0, 1, 1)]

    def read(self, part: _Range) -> Iterator[pa.RecordBatch]:
        kind = _dtype(part.words)
        for a in range(part.start, part.start + part.count, 100_000):
            n = min(100_000, part.start + part.count - a)
            rows = np.fromfile(part.path, kind, n, offset=HEADER_SIZE + a * kind.itemsize)
            yield pa.RecordBatch.from_arrays([pa.array(decode(rows["words"], part.k)), pa.array(np.full(n, self.colour, np.int32)), pa.array(rows["coverage"].astype(np.int64)), pa.array(rows["edges"].astype(np.int32)), pa.array([part.path] * n)], names=["kmer", "colour", "coverage", "edges", "source_file"])


class KmerFiles(DataSource):
    """``spark.read.format("kmers")`` with options ``path`` (file, folder or pattern on a shared file system), ``k`` and ``colour``."""

    @classmethod
    def name(cls) -> str:
        return "kmers"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader(self.options)


def read_kmers(spark: SparkSession, path: str, k: int = 0, colour: int = 0) -> DataFrame:
    """Records of KMERS or CTX files as they are; merge them with ``operators.kmers.merge_sets``."""
    spark.dataSource.register(KmerFiles)
    return spark.read.format("kmers").option("k", k).option("colour", colour).load(path)


def total_reads(path: str) -> int:
    """Reads that the headers of the files name."""
    paths = glob.glob(os.path.join(path, "*")) if os.path.isdir(path) else glob.glob(path)
    return sum(read_header(p)["total_reads"] for p in paths)


def write_kmers(kmer_set: DataFrame, folder: str, k: int, total_reads: int = 0, ctx: bool = False) -> None:
    """Write ``(kmer, coverage, edges)``, one complete file a partition, into a new folder that all executors share.

    Coverage above 32 bits becomes the largest that fits. The header's reads stand in the file of partition 0 alone.
    """
    os.makedirs(folder)  # raises if it exists
    magic = b"CORTEX" if ctx else b"KMERS "

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = TaskContext.get()
        pid, path = c.partitionId(), os.path.join(folder, f"part-{c.partitionId():05d}.{'ctx' if ctx else 'kmers'}")
        n, own = 0, f"{folder}/.{pid}-{c.attemptNumber()}-{os.getpid()}"  # a lost attempt leaves no half file
        with open(own, "wb") as f:
            f.write(struct.pack(HEADER, magic, VERSION, k, words_for(k), 1, 0, 0 if pid else total_reads, magic))
            for b in batches:
                rows = np.zeros(b.num_rows, _dtype(words_for(k)))
                if b.num_rows:
                    rows["words"] = encode(b.column(0).to_pylist(), k)
                    rows["coverage"] = np.minimum(b.column(1).to_numpy(zero_copy_only=False), 2**32 - 1)
                    rows["edges"] = b.column(2).to_numpy(zero_copy_only=False)
                rows.tofile(f)
                n += b.num_rows
        os.replace(own, path)
        yield pa.RecordBatch.from_arrays([pa.array([n])], names=["n"])

    rows = kmer_set.select("kmer", F.coalesce("coverage", F.lit(0)).cast("bigint"), F.coalesce("edges", F.lit(0)).cast("int"))
    rows.mapInArrow(write, "n bigint").agg(F.sum("n")).collect()


def write_by_colour(kmer_set: DataFrame, prefix: str, k: int) -> list[str]:
    """One folder for each colour, ``<prefix>_c<colour>``."""
    out = []
    for (c,) in sorted(kmer_set.select("colour").distinct().collect()):
        write_kmers(kmer_set.filter(F.col("colour") == c), f"{prefix}_c{c}", k, ctx=True)
        out.append(f"{prefix}_c{c}")
    return out
