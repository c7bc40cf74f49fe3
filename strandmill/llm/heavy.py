"""Problem 4: the most frequent values of a column, in memory that doesn't grow with the number of distinct values.

A hierarchy of count sketches with signed hashes: value codes go through a reversible mix, so that a prefix of the mixed
bits is a group of values and the full width is one value. Every task adds its rows to its own sketches, which have a fixed
size, and the sketches are added up. From the shortest prefixes, counted exactly, the search goes down into the prefixes
whose estimate is large; what is left at full width are candidates, which a second scan of the rows counts exactly.

The width of the sketches follows from the share that is asked for. What is left in the counters once the large prefixes are
taken out gives the error of the estimates; where that is too much to tell the share, the sketches are made twice as wide.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from strandmill.functions.kmer import unpack
from strandmill.llm.kmer_rows import K, VALID_SQL, coded, weight
from strandmill.runtime import table

DEPTH, TOP, STEP = 5, 10, 4
SLACK = 0.6
WIDEST = 1 << 18  # counters in a row: 10 MB a level
SIGMAS = 4


def width_for(share: float) -> int:
    """Counters in a row for items of at least this share: a power of two, about 40 for each item there can be."""
    if not 0 < share <= 1:
        raise ValueError("the share must be above 0 and at most 1")
    width = 1 << max(10, math.ceil(math.log2(40 / share)))
    if width > WIDEST:
        raise ValueError(f"a share below {40 / WIDEST:.6f} needs sketches of more than {WIDEST} counters in a row")
    return width


def _odd(n: int) -> np.ndarray:
    return np.random.default_rng(20160104).integers(1, 1 << 62, n, dtype=np.uint64) | np.uint64(1)


def _levels(bits: int) -> list[int]:
    return [*range(TOP, bits, STEP), bits]


class Mix:
    """A reversible mix of codes of ``bits`` bits."""

    def __init__(self, bits: int):
        self.bits, self.mask, self.shift = bits, np.uint64((1 << bits) - 1), np.uint64(bits // 2)
        self.by = [int(x) for x in _odd(2)]
        self.back = [pow(x, -1, 1 << bits) for x in self.by]

    def __call__(self, code: np.ndarray) -> np.ndarray:
        x = code.astype(np.uint64)
        for m in self.by:
            x = (x * np.uint64(m)) & self.mask
            x ^= x >> self.shift
        return x

    def invert(self, mixed: np.ndarray) -> np.ndarray:
        x = mixed.astype(np.uint64)
        for m in reversed(self.back):
            y = x ^ (x >> self.shift)
            if self.bits % 2:
                y = x ^ (y >> self.shift)
            x = (y * np.uint64(m)) & self.mask
        return x.astype(np.int64)


def _slots(prefix: np.ndarray, level: int, row: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Counter and sign of prefixes in one row of a level's sketch."""
    salt = np.random.default_rng(1000 * level + row).integers(1, 1 << 62, 2, dtype=np.uint64) | np.uint64(1)
    h = prefix.astype(np.uint64) * salt[0] + salt[1]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    return (h % np.uint64(width)).astype(np.int64), 1 - 2 * (h >> np.uint64(63)).astype(np.int64)


def _sketching(bits: int, width: int):
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mix, levels = Mix(bits), _levels(bits)
        top = np.zeros(1 << levels[0], np.int64)
        tables = np.zeros((len(levels) - 1, DEPTH, width), np.int64)
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def add() -> None:
            if not held:
                return
            code, w = (np.concatenate(x) for x in zip(*held))
            held.clear()
            code, back = np.unique(code, return_inverse=True)
            total = np.zeros(len(code), np.int64)
            np.add.at(total, back, w)
            mixed = mix(code)
            np.add.at(top, (mixed >> np.uint64(bits - levels[0])).astype(np.int64), total)
            for i, level in enumerate(levels[1:]):
                prefix = mixed >> np.uint64(bits - level)
                for row in range(DEPTH):
                    slot, sign = _slots(prefix, level, row, width)
                    np.add.at(tables[i, row], slot, sign * total)

        n = 0
        for b in batches:
            held.append((b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)))
            n += b.num_rows
            if n > 250_000:
                add()
                n = 0
        add()
        if top.any():
            out = [(0, 0, top.tobytes())] + [(i + 1, row, tables[i, row].tobytes()) for i in range(len(levels) - 1) for row in range(DEPTH)]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.int32(), pa.int32(), pa.binary()))], names=["level", "row", "counters"])

    return sketch


def _adding(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[tuple[int, int], np.ndarray] = {}
    for b in batches:
        for level, row, raw in zip(*(c.to_pylist() for c in b.columns)):
            x = np.frombuffer(raw, np.int64)
            sums[level, row] = sums[level, row] + x if (level, row) in sums else x
    if sums:
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in sums], pa.int32()), pa.array([k[1] for k in sums], pa.int32()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], names=["level", "row", "counters"])


def sketch_candidates(rows: DataFrame, bits: int, share: float) -> tuple[np.ndarray, np.ndarray, int, float]:
    """Codes whose estimate is at least ``SLACK * share`` of the total, their estimates, the exact total of all amounts, and the error of an estimate.

    ``rows`` is ``(code, amount)`` with amounts not negative. The driver gets the summed sketches, of fixed size. The error is ``SIGMAS``
    standard errors at the level where it is largest; the median over the rows of a sketch is better than that.
    """
    width = width_for(share)
    while True:
        found = _descend(rows, bits, share, width)
        _, _, total, error = found
        if error <= (1 - SLACK) * share * total:
            return found
        if width * 2 > WIDEST:
            raise ValueError(f"sketches of {width} counters in a row can't tell a share of {share}: an estimate may be off by {error:.0f} of {total}")
        warnings.warn(f"sketches of {width} counters in a row are too narrow for these rows, going on with {2 * width}", stacklevel=2)
        width *= 2


def _descend(rows: DataFrame, bits: int, share: float, width: int) -> tuple[np.ndarray, np.ndarray, int, float]:
    schema = "level int, row int, counters binary"
    sums = rows.mapInArrow(_sketching(bits, width), schema).repartition("level", "row").mapInArrow(_adding, schema).collect()
    if not sums:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), 0, 0.0
    got = {(r.level, r.row): np.frombuffer(r.counters, np.int64) for r in sums}
    top, levels = got[0, 0], _levels(bits)
    total, error = int(top.sum()), 0.0
    least = max(1.0, SLACK * share * total)
    prefix = np.flatnonzero(top >= least).astype(np.uint64)
    est = top[prefix.astype(np.int64)]
    for i, level in enumerate(levels[1:]):
        more = level - levels[i]
        prefix = ((prefix[:, None] << np.uint64(more)) | np.arange(1 << more, dtype=np.uint64)).ravel()
        spots = [_slots(prefix, level, row, width) for row in range(DEPTH)]
        est = np.median([got[i + 1, row][slot] * sign for row, (slot, sign) in enumerate(spots)], axis=0) if len(prefix) else np.zeros(0)
        keep = est >= least
        prefix, est = prefix[keep], est[keep]
        rest = [got[i + 1, row] - np.bincount(slot[keep], sign[keep] * est, width) for row, (slot, sign) in enumerate(spots)]
        error = max(error, SIGMAS * math.sqrt(np.median([np.square(x, dtype=np.float64).sum() for x in rest]) / width))
    return Mix(bits).invert(prefix), est.astype(np.int64), total, error


def heavy_hitters(rows: DataFrame, bits: int, share: float) -> DataFrame:
    """``(code, approx_total, error, total)`` of every code with at least ``share`` of the summed amount of all rows.

    ``rows`` is ``(unit, code, amount)``; rows of a unit are deliveries of one record and count once, with the largest amount.
    A null code is no value. Nothing is heavy where the total is 0. ``error`` is what ``approx_total`` may be off by.
    A share that no sketch of the greatest width can tell is refused.
    """
    once = lambda df: df.groupBy("unit").agg(F.max("code").alias("code"), F.max("amount").alias("amount"))
    rows = rows.filter(F.col("code").isNotNull())
    codes, approx, total, error = sketch_candidates(once(rows).select("code", "amount"), bits, share)
    spark = rows.sparkSession
    cands = spark.createDataFrame([(int(c), int(a), error) for c, a in zip(codes, approx)], "code bigint, approx_total bigint, error double")  # at most about 1 / (SLACK * share) rows
    second = once(rows.filter(F.col("code").isin([int(c) for c in codes]))) if len(codes) else once(rows.filter("false"))
    exact = second.groupBy("code").agg(F.sum("amount").alias("total"))
    return exact.join(F.broadcast(cands), "code").filter(F.col("total") >= F.lit(share * total)).filter(F.lit(total > 0)).select("code", "approx_total", "error", "total")


SHARE = 0.005


def _heavy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = coded(table(spark, sf_dir, "kmers"), "record_id", "coverage")
    unit = F.coalesce(F.col("record_id"), -1 - F.monotonically_increasing_id())
    return heavy_hitters(rows.select(unit.alias("unit"), "code", weight(F.col("coverage")).alias("amount")), 2 * K, SHARE).withColumn("kmer", unpack(F.col("code"), K))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _heavy(spark, sf_dir).select("kmer")


def p4_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _heavy(spark, sf_dir).select("kmer", F.col("total").alias("coverage"))


def p4_approximate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _heavy(spark, sf_dir).select("kmer", "approx_total", "error", F.col("total").alias("coverage"))


def p4_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the estimates lie within their stated error."""
    return _heavy(spark, sf_dir).select("kmer", F.col("total").alias("coverage"), (F.abs(F.col("approx_total") - F.col("total")) <= F.col("error") + 1).alias("error_holds"))


_HEAVY_SQL = f"WITH {VALID_SQL}, t AS (SELECT c AS kmer, CAST(sum(cov) AS BIGINT) AS coverage FROM recs GROUP BY c), s AS (SELECT *, sum(coverage) OVER () AS everything FROM t) "
SQL = {
    "p4_found": _HEAVY_SQL + "SELECT kmer FROM s WHERE coverage * 200 >= everything AND everything > 0",
    "p4_accuracy": _HEAVY_SQL + "SELECT kmer, coverage, TRUE AS error_holds FROM s WHERE coverage * 200 >= everything AND everything > 0",
    "p4_totals": _HEAVY_SQL + "SELECT kmer, coverage FROM s WHERE coverage * 200 >= everything AND everything > 0",
}
QUERIES = {"p4_found": p4_found, "p4_totals": p4_totals, "p4_approximate": p4_approximate, "p4_accuracy": p4_accuracy}
