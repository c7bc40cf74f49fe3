"""Images of whole k-mer sets, in Parquet: faster to restore than the binary files, split among tasks, on any file system."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def save_image(kmer_set: DataFrame, path: str, k: int, mode: str = "errorifexists") -> None:
    """Write the set with all its columns, and its k, beside each other under ``path``."""
    kmer_set.write.mode(mode).parquet(f"{path}/entries")
    kmer_set.sparkSession.range(1).select(F.lit(k).alias("k")).write.mode(mode).parquet(f"{path}/head")


def load_image(spark: SparkSession, path: str, k: int | None = None) -> DataFrame:
    """The set as it was saved; with ``k`` a set of other k-mers is refused."""
    had = spark.read.parquet(f"{path}/head").first().k
    if k is not None and had != k:
        raise ValueError(f"the image holds {had}-mers, not {k}-mers")
    return spark.read.parquet(f"{path}/entries")
