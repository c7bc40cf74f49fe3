"""Problem 2: distinct counts over sets too large to hold, with a known error and mergeable partial results.

Linear counting at several resolutions: an identifier sets one hashed bit of a fixed bitmap, sets merge by bitwise OR, and the
share of empty bits estimates how many distinct identifiers set the others. Level i of a bitmap takes one in 2^(i+1) of the
identifiers and the last level the rest, so that whatever the size of a set some level is filled to a usable part; it and
all higher ones give the estimate. A bitmap of ``LEVEL`` bits a level keeps the standard error within ``relative_error``, 0.4 %, and
grows with the logarithm of the number of identifiers only. Bitmaps are kept in pieces of 32,768 bits, one row for each cell
(day, group, colour), level and piece, so neither a hot identifier nor a large set meets in one task.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from strandmill.llm.kmer_rows import VALID_SQL, coded
from strandmill.runtime import materialise, table

PIECE = 1 << 15
LEVEL = 1 << 17
LOAD = 2.0  # identifiers a bit up to which a level is used
SIGMAS = 6
PLANES = 1 << 26  # bytes of bitmaps that a task holds
CODES = 1 << 15  # identifiers in a part of the exact count


def levels_for(n: int) -> int:
    """Levels that keep the standard error for up to ``n`` identifiers."""
    return 1 + max(0, math.ceil(math.log2(max(n, 1) / (LOAD * LEVEL))))


def relative_error(n: float, levels: int) -> float:
    """Standard error as a share of ``n``: of the emptiness of bits, and of the identifiers that the used levels don't see."""
    if n <= 0:
        return 0.0
    share = [2.0 ** -(i + 1) for i in range(levels - 1)] + [2.0 ** -(levels - 1)]
    base = next((i for i in range(levels) if n * share[i] / LEVEL <= LOAD), levels - 1)
    counting = sum(LEVEL * max(math.expm1(t) - t, 0.0) for t in (min(n * s / LEVEL, 700.0) for s in share[base:]))
    return math.sqrt(4.0**base * counting + n * (2**base - 1)) / n


def cell_bitmaps(rows: DataFrame, cell: list[str], identifier: str, levels: int) -> DataFrame:
    """``(*cell, level, piece, bitmap)``: the mergeable partial counts of every cell. Null identifiers set no bit; null cell values are cells."""
    h = F.xxhash64(identifier)
    low = h.bitwiseAND(F.lit(0xFFFFFFFF))
    zeros = F.bit_count(F.bitwise_not(low).bitwiseAND(low - 1))  # trailing ones of nothing but the low half
    at = F.shiftrightunsigned(h, 40).bitwiseAND(F.lit(LEVEL - 1))
    level = F.least(zeros, F.lit(levels - 1)).cast("int").alias("level")
    placed = rows.filter(F.col(identifier).isNotNull()).select(*cell, level, F.shiftright(at, 15).cast("int").alias("piece"), at.bitwiseAND(F.lit(PIECE - 1)).alias("_bit"))
    return placed.groupBy(*cell, "level", "piece").agg(F.bitmap_construct_agg("_bit").alias("bitmap"))


def _estimate(ones: list[Column]) -> tuple[Column, Column]:
    """Identifiers, and their standard error, from the bits set at each level."""
    bits = float(LEVEL)
    t = [-F.log1p(-F.least(x, F.lit(LEVEL - 1)) / F.lit(bits)) for x in ones]
    most = LEVEL * -math.expm1(-LOAD)
    counts = errors = None
    n = v = F.lit(0.0)
    for base in reversed(range(len(ones))):
        n, v = n + bits * t[base], v + bits * F.greatest(F.expm1(t[base]) - t[base], F.lit(0.0))
        scale = float(2**base)
        e = F.sqrt(scale * scale * v + scale * n * (scale - 1))
        usable = ones[base] <= most
        counts, errors = (scale * n, e) if counts is None else (F.when(usable, scale * n).otherwise(counts), F.when(usable, e).otherwise(errors))
    return counts, errors


def _by_level(rows: DataFrame, keys: list[str], columns: dict[str, str], levels: int) -> DataFrame:
    """Estimates and errors for each key from the bits set at each level; ``columns`` names, for each column of bits, what its estimate is called."""
    at = lambda c, i: F.sum(F.when(F.col("level") == i, F.col(c)).otherwise(0)).alias(f"_{c}_{i}")
    wide = rows.groupBy(*keys).agg(*[at(c, i) for c in columns for i in range(levels)])
    out = []
    for c, name in columns.items():
        n, e = _estimate([F.col(f"_{c}_{i}") for i in range(levels)])
        out += [n.alias(name), e.alias(f"error_{name}")]
    return wide.select(*keys, *out)


def merged_counts(bitmaps: DataFrame, keys: list[str], levels: int) -> DataFrame:
    """``(*keys, estimate, std_error)``: bitmaps united over everything but ``keys``; ``std_error`` in identifiers."""
    pieces = bitmaps.groupBy(*keys, "level", "piece").agg(F.bitmap_count(F.bitmap_or_agg("bitmap")).alias("ones"))
    return _by_level(pieces, keys, {"ones": "estimate"}, levels).withColumnRenamed("error_estimate", "std_error")


# -- many sets of cells ----------------------------------------------------------------------------------------------

Planes = tuple[np.ndarray, np.ndarray]


def _spots(dump: np.ndarray, day: np.ndarray) -> np.ndarray:
    return (dump.astype(np.int64) << 32) + (day.astype(np.int64) + (1 << 31))


def _from_bitmaps(b: pa.RecordBatch) -> Planes:
    """Sorted spots, one for each dump and day, and their bits: of all rows, of colour 0 and of colour 1."""
    dump, day, colour = (b.column(i).fill_null(-1).to_numpy(zero_copy_only=False) for i in (2, 3, 4))
    text = b.column(5).combine_chunks() if isinstance(b.column(5), pa.ChunkedArray) else b.column(5)
    words = np.frombuffer(b"".join(text.to_pylist()), np.uint64).reshape(len(dump), -1)
    spots, at = np.unique(_spots(dump, day), return_inverse=True)
    planes = np.zeros((len(spots), 3, words.shape[1]), np.uint64)
    for plane, rows in ((0, np.arange(len(at))), (1, np.flatnonzero(colour == 0)), (2, np.flatnonzero(colour == 1))):
        np.bitwise_or.at(planes[:, plane], at[rows], words[rows])
    return spots, planes


def _from_codes(b: pa.RecordBatch) -> Planes:
    """The same with a bit of its own for each identifier: an exact count."""
    dump, day, colour = (b.column(i).fill_null(-1).to_numpy(zero_copy_only=False) for i in (2, 3, 4))
    own, bit = np.unique(b.column(5).to_numpy(zero_copy_only=False), return_inverse=True)
    spots, at = np.unique(_spots(dump, day), return_inverse=True)
    planes = np.zeros((len(spots), 3, (len(own) + 63) // 64), np.uint64)
    value = np.uint64(1) << (bit & 63).astype(np.uint64)
    for plane, rows in ((0, np.arange(len(at))), (1, np.flatnonzero(colour == 0)), (2, np.flatnonzero(colour == 1))):
        np.bitwise_or.at(planes, (at[rows], plane, bit[rows] >> 6), value[rows])
    return spots, planes


def _runs_united(planes: np.ndarray, longest: int) -> list[np.ndarray]:
    """Unions of 1, 2, 4 ... spots from each spot on: two of them cover any run of days."""
    out = [planes]
    while 2 << len(out) - 1 <= longest:
        half = 1 << len(out) - 1
        out.append(out[-1][:-half] | out[-1][half:])
    return out


def _uniting(build: Callable[[pa.RecordBatch], Planes]):
    """Partitions sorted by part and kind, first the cells of a part, then the sets: how many bits each set has in the part."""

    def counted(b: pa.RecordBatch, spots: np.ndarray, unions: list[np.ndarray], step: int) -> Iterator[pa.RecordBatch]:
        members = b.column(7).combine_chunks() if isinstance(b.column(7), pa.ChunkedArray) else b.column(7)
        sizes = np.diff(members.offsets.to_numpy())
        dump, low, high = members.flatten().fill_null(-1).to_numpy(zero_copy_only=False), *(np.repeat(b.column(i).to_numpy(zero_copy_only=False), sizes) for i in (8, 9))
        owner = np.repeat(np.arange(len(sizes)), sizes)
        a, z = np.searchsorted(spots, _spots(dump, low), "left"), np.searchsorted(spots, _spots(dump, high), "right")
        hit = (z > a) & (dump >= 0)
        owner, a, z = owner[hit], a[hit], z[hit]
        tall = np.floor(np.log2(z - a)).astype(np.int64)
        ones = np.zeros((len(sizes), 3), np.int64)
        for s in range(0, len(owner), step):
            o, t, i, j = owner[s : s + step], tall[s : s + step], a[s : s + step], z[s : s + step]
            got = np.empty((len(o), *unions[0].shape[1:]), np.uint64)
            for h in np.unique(t):
                at = np.flatnonzero(t == h)
                got[at] = unions[h][i[at]] | unions[h][j[at] - (1 << h)]
            if s and owner[s - 1] == o[0]:
                got[0] |= kept  # the set goes on from the step before
            first = np.flatnonzero(np.r_[True, o[1:] != o[:-1]])
            united = np.bitwise_or.reduceat(got, first, axis=0)
            ones[o[first]] = np.bitwise_count(united).sum(axis=2, dtype=np.int64)
            kept = united[-1]
        some = np.flatnonzero(ones[:, 0])
        yield pa.RecordBatch.from_arrays([b.column(6).take(pa.array(some)), b.column(10).take(pa.array(some)), *(pa.array(ones[some, i]) for i in range(3))], names=["set_id", "level", "ones", "ones_0", "ones_1"])

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, cells, spots, unions = None, [], None, []
        for b in batches:
            p, kind = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            first = np.flatnonzero(np.r_[True, (p[1:] != p[:-1]) | (kind[1:] != kind[:-1])]) if len(p) else []
            for s, e in zip(first, [*first[1:], len(p)]):
                if p[s] != part:
                    part, cells, spots = p[s], [], None
                if kind[s] == 0:
                    cells.append(b.slice(s, e - s))
                    continue
                if cells:
                    spots, planes = build(pa.Table.from_batches(cells).combine_chunks().to_batches()[0])
                    _, days = np.unique(spots >> 32, return_counts=True)
                    unions, cells = _runs_united(planes, int(days.max())), []
                if spots is not None:
                    yield from counted(b.slice(s, e - s), spots, unions, max(64, (1 << 23) // max(1, unions[0][0].nbytes)))

    return unite


def _united(cells: DataFrame, sets: DataFrame, parts: int, build: Callable[[pa.RecordBatch], Planes], level: Column) -> DataFrame:
    """``(set_id, level, ones, ones_0, ones_1)`` for each set and part. ``cells`` is ``(part, dump, day, colour, value)``.

    Every part is a unit of bounded size; a set visits each part once, so the work grows with the number of sets times that of parts.
    """
    empty = {"set_id": "bigint", "members": "array<int>", "from_day": "int", "to_day": "int", "level": "int"}
    left = cells.select("part", F.lit(0).alias("kind"), "dump", "day", "colour", "value", *[F.lit(None).cast(t).alias(c) for c, t in empty.items()])
    none = {"dump": "int", "day": "int", "colour": "int", "value": cells.schema["value"].dataType}
    right = sets.select(F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.lit(1).alias("kind"), *[F.lit(None).cast(t).alias(c) for c, t in none.items()], "set_id", "members", "from_day", "to_day").withColumn("level", level.cast("int"))
    both = left.unionByName(right.select(*left.columns)).repartition("part").sortWithinPartitions("part", "kind")
    return both.mapInArrow(_uniting(build), "set_id bigint, level int, ones bigint, ones_0 bigint, ones_1 bigint")


def set_counts(bitmaps: DataFrame, sets: DataFrame, levels: int) -> DataFrame:
    """``(set_id, distinct, distinct_0, distinct_1)`` estimates, with ``error_`` columns, for each set ``(set_id, members, from_day, to_day)``, days as integers.

    ``bitmaps`` has cells ``(day, dump_id, colour)``; one without a day or dump is in no set. Bitmaps are cut into slices so that
    those of all cells, and their unions over runs of days, fit a task; their size depends on the numbers of dumps and days, not on rows or sets.
    """
    cells = bitmaps.filter("dump_id IS NOT NULL AND day IS NOT NULL")
    spots, days = cells.agg(F.count_distinct("dump_id", "day"), F.count_distinct("day")).first()
    held = 3 * (PIECE // 8) * max(spots, 1) * (1 + max(days, 1).bit_length())
    slices = max(4, min(PIECE // 64, 1 << max(0, math.ceil(math.log2(held / PLANES)))))
    wide, per = PIECE // 8 // slices, LEVEL // PIECE * slices
    cut = F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(slices - 1)), lambda s: F.col("bitmap").substr(s * wide + 1, F.lit(wide)))).alias("s", "value")
    left = cells.select("level", "piece", F.col("dump_id").alias("dump"), "day", "colour", cut).select((F.col("level") * per + F.col("piece") * slices + F.col("s")).cast("int").alias("part"), "dump", "day", "colour", "value")
    ones = _united(left, sets, levels * per, _from_bitmaps, F.floor(F.col("part") / per))
    return _by_level(ones, ["set_id"], {"ones": "distinct", "ones_0": "distinct_0", "ones_1": "distinct_1"}, levels)


def exact_counts(rows: DataFrame, bitmaps: DataFrame, sets: DataFrame, about: float) -> DataFrame:
    """``(set_id, distinct, distinct_0, distinct_1)``, exactly, of rows ``(code, day, dump_id, colour)`` with ``about`` so many distinct codes.

    Only cells, of those in ``bitmaps``, that some set covers are looked at. Codes are dealt out to parts of about ``CODES``; in a part every code has a bit of its own.
    """
    parts = max(1, math.ceil(about / CODES))
    named = sets.select(F.explode("members").alias("dump_id"), "from_day", "to_day").distinct()
    cells = rows.filter("dump_id IS NOT NULL AND day IS NOT NULL").select(F.pmod(F.xxhash64("code"), F.lit(parts)).cast("int").alias("part"), F.col("dump_id").alias("dump"), "day", "colour", F.col("code").alias("value")).distinct()
    spans = bitmaps.select("dump_id", "day").distinct().join(named, "dump_id").filter("day BETWEEN from_day AND to_day").select("dump_id", "day").distinct()
    here = cells.join(spans.select(F.col("dump_id").alias("dump"), "day"), ["dump", "day"], "left_semi")
    ones = _united(here.select("part", "dump", "day", "colour", "value"), sets, parts, _from_codes, F.lit(0))
    return ones.groupBy("set_id").agg(*[F.sum(f"ones{x}").alias(f"distinct{x}") for x in ("", "_0", "_1")])


def _inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    raw = table(spark, sf_dir, "kmers")
    levels = levels_for(raw.count())
    day = F.datediff("run_day", F.lit("1970-01-01")).alias("day")
    rows = coded(raw, "run_day", "dump_id", "colour").select("code", day, "dump_id", "colour")
    cells = materialise(cell_bitmaps(rows, ["day", "dump_id", "colour"], "code", levels), "bitmaps")
    since = lambda c: F.datediff(c, F.lit("1970-01-01"))
    dated = F.col("from_day").isNotNull() & F.col("to_day").isNotNull()  # a set without its days is empty
    sets = table(spark, sf_dir, "hash_table").select(F.col("snapshot_id").alias("set_id"), F.coalesce("dump_ids", F.array().cast("array<int>")).alias("members"), F.when(dated, since("from_day")).otherwise(1).alias("from_day"), F.when(dated, since("to_day")).otherwise(0).alias("to_day"), F.col("unique_kmers").alias("r"), F.get("colour_kmers", F.lit(0)).alias("r_0"), F.get("colour_kmers", F.lit(1)).alias("r_1"))
    return rows, cells, sets, levels


COLUMNS = ["set_id", "members", "from_day", "to_day"]
SUFFIXES = ("", "_0", "_1")


def _slack(x: str) -> Column:
    """What an estimate may be off by: six standard errors, and three for the few collisions among few identifiers."""
    d = F.coalesce(F.col(f"distinct{x}"), F.lit(0.0))
    return SIGMAS * F.coalesce(F.col(f"error_distinct{x}"), F.lit(0.0)) + F.when(d > 0, 3.0).otherwise(0.0)


def deviating(rows: DataFrame, cells: DataFrame, sets: DataFrame, levels: int) -> DataFrame:
    """Every set with its estimates, ``off`` (a report is off by more than a tenth) and how that was decided.

    A report r is off if the true d is below 10r/11 or above 10r/9. Where the estimate with six standard errors lies on one
    side of both limits, the bitmaps decide; the sets in between, if any, are counted exactly (``checked``). A null report is never off.
    """
    est = set_counts(cells, sets.select(*COLUMNS), levels)
    both = sets.join(est, "set_id", "left")
    sure, fine = [], []
    for x in SUFFIXES:
        d, r, slack = F.coalesce(F.col(f"distinct{x}"), F.lit(0.0)), F.col(f"r{x}").cast("double"), _slack(x)
        low, high = 10 * r / 11, 10 * r / 9
        sure.append(F.coalesce((d + slack < low) | (d - slack > high), F.lit(False)))
        fine.append(F.coalesce((d - slack >= low) & (d + slack <= high), F.lit(True)))
    any_sure, all_fine = sure[0] | sure[1] | sure[2], fine[0] & fine[1] & fine[2]
    decided = materialise(both.withColumns({"off": any_sure, "open": ~any_sure & ~all_fine}), "counted")
    unsure = decided.filter("open")
    if unsure.isEmpty():
        return decided.withColumn("checked", F.lit(False)).drop("open")
    true = exact_counts(rows, cells, unsure.select(*COLUMNS), merged_counts(cells, [], levels).first().estimate)
    off = F.lit(False)
    again = unsure.drop(*[f"{c}{x}" for c in ("distinct", "error_distinct") for x in SUFFIXES], "off").join(true, "set_id", "left")
    for x in SUFFIXES:
        d, r = F.coalesce(F.col(f"distinct{x}"), F.lit(0)), F.col(f"r{x}")
        off = off | F.coalesce(F.abs(r - d) * 10 > d, F.lit(False))
    again = again.withColumns({"off": off, "checked": F.lit(True)} | {f"distinct{x}": F.col(f"distinct{x}").cast("double") for x in SUFFIXES} | {f"error_distinct{x}": F.lit(0.0) for x in SUFFIXES})
    return decided.filter("not open").withColumn("checked", F.lit(False)).unionByName(again).drop("open")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deviating(*_inputs(spark, sf_dir)).filter("off").select(F.col("set_id").alias("snapshot_id"))


def p2_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return deviating(*_inputs(spark, sf_dir)).select(F.col("set_id").alias("snapshot_id"), F.col("r").alias("unique_kmers"), zero("distinct").alias("estimate"), zero("error_distinct").alias("std_error"), zero("distinct_0").alias("estimate_0"), zero("distinct_1").alias("estimate_1"), "off", "checked")


def p2_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The true counts of every snapshot, and whether its three estimates, by bitmaps alone, lie within six stated standard errors of them."""
    rows, cells, sets, levels = _inputs(spark, sf_dir)
    est = set_counts(cells, sets.select(*COLUMNS), levels)
    true = exact_counts(rows, cells, sets.select(*COLUMNS), merged_counts(cells, [], levels).first().estimate).select("set_id", *[F.col(f"distinct{x}").alias(f"true{x}") for x in SUFFIXES])
    both = sets.select("set_id").join(est, "set_id", "left").join(true, "set_id", "left")
    zero = {f"true{x}": F.coalesce(f"true{x}", F.lit(0)) for x in SUFFIXES}
    holds = F.lit(True)
    for x in SUFFIXES:
        holds = holds & (F.abs(F.coalesce(f"distinct{x}", F.lit(0.0)) - F.col(f"true{x}")) <= _slack(x))
    return both.withColumns(zero).select(F.col("set_id").alias("snapshot_id"), F.col("true").alias("distinct_kmers"), F.col("true_0").alias("distinct_0"), F.col("true_1").alias("distinct_1"), holds.alias("error_holds"))


LEVELS = {"day": ["run_day"], "dump": ["dump_id"], "colour": ["colour"], "all": []}


def _groups(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows, cells, _, levels = _inputs(spark, sf_dir)
    dated = lambda df: df.withColumn("run_day", F.date_add(F.lit("1970-01-01").cast("date"), F.col("day")))
    kinds = {"run_day": "date", "dump_id": "int", "colour": "int"}
    outs = []
    for count in (lambda keys: merged_counts(dated(cells), keys, levels), lambda keys: dated(rows).groupBy(*keys).agg(F.count_distinct("code").alias("distinct_kmers"))):
        out = None
        for level, keys in LEVELS.items():
            got = count(keys)
            one = got.select(F.lit(level).alias("level"), *[(F.col(c) if c in keys else F.lit(None).cast(t)).alias(c) for c, t in kinds.items()], *[c for c in got.columns if c not in kinds])
            out = one if out is None else out.unionByName(one)
        outs.append(out)
    return outs[0], outs[1]


def p2_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct k-mers per day, per dump, per colour and overall; ``level`` names the grouping."""
    return _groups(spark, sf_dir)[0]


def p2_groups_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The true counts of the groups, and whether each estimate lies within six stated standard errors, and its stated error within 0.5 %."""
    est, true = _groups(spark, sf_dir)
    key = ["level", "run_day", "dump_id", "colour"]
    e, t = est.alias("e"), true.alias("t")
    same = [F.col(f"e.{k}").eqNullSafe(F.col(f"t.{k}")) for k in key]
    off = F.abs(F.col("estimate") - F.col("distinct_kmers"))
    holds = (off <= SIGMAS * F.col("std_error") + 3) & (F.col("std_error") <= 0.005 * F.greatest("estimate", F.lit(1.0)))
    return t.join(e, same, "left").select(*[F.col(f"t.{k}") for k in key], "distinct_kmers", F.coalesce(holds, F.col("distinct_kmers") == 0).alias("error_holds"))


_SETS_SQL = f"""WITH {VALID_SQL},
cells AS (SELECT DISTINCT c, dump_id, run_day, colour FROM ok),
named AS (SELECT snapshot_id, from_day, to_day, unnest(list_distinct(dump_ids)) AS dump_id FROM hash_table),
d AS (SELECT snapshot_id, count(DISTINCT c) AS d, count(DISTINCT CASE WHEN colour = 0 THEN c END) AS d0, count(DISTINCT CASE WHEN colour = 1 THEN c END) AS d1
      FROM named JOIN cells ON cells.dump_id = named.dump_id AND run_day BETWEEN from_day AND to_day GROUP BY snapshot_id)
"""
SQL = {
    "p2_found": _SETS_SQL + "SELECT snapshot_id FROM hash_table LEFT JOIN d USING (snapshot_id)\nWHERE abs(unique_kmers - coalesce(d, 0)) * 10 > coalesce(d, 0) OR abs(colour_kmers[1] - coalesce(d0, 0)) * 10 > coalesce(d0, 0) OR abs(colour_kmers[2] - coalesce(d1, 0)) * 10 > coalesce(d1, 0)",
    "p2_accuracy": _SETS_SQL + "SELECT snapshot_id, coalesce(d, 0) AS distinct_kmers, coalesce(d0, 0) AS distinct_0, coalesce(d1, 0) AS distinct_1, TRUE AS error_holds FROM hash_table LEFT JOIN d USING (snapshot_id)",
    "p2_groups_accuracy": f"""WITH {VALID_SQL}
SELECT 'day' AS level, run_day, CAST(NULL AS INT) AS dump_id, CAST(NULL AS INT) AS colour, count(DISTINCT c) AS distinct_kmers, TRUE AS error_holds FROM ok GROUP BY run_day
UNION ALL SELECT 'dump', NULL, dump_id, NULL, count(DISTINCT c), TRUE FROM ok GROUP BY dump_id
UNION ALL SELECT 'colour', NULL, NULL, colour, count(DISTINCT c), TRUE FROM ok GROUP BY colour
UNION ALL SELECT 'all', NULL, NULL, NULL, count(DISTINCT c), TRUE FROM ok""",
}
QUERIES = {"p2_found": p2_found, "p2_snapshots": p2_snapshots, "p2_groups": p2_groups, "p2_accuracy": p2_accuracy, "p2_groups_accuracy": p2_groups_accuracy}
