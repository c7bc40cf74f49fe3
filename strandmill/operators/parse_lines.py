"""Problem 3: rows that fail to parse, set apart with their reason, while the valid rows come out typed.

Structural indexing, a whole batch of lines at a time: a mask of the quotes and the parity of their running count say of
every byte whether it stands inside a quoted field, so that delimiters and record ends fall out of array operations. Every
further rule is a count of bytes of some class between two delimiters, taken from a running count.
"""

from __future__ import annotations

import datetime
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from strandmill.runtime import table

N_FIELDS = 7
SLICE_BYTES = 1 << 22
MAX_QUALITY = 41
_SEQ = np.zeros(256, bool)
_SEQ[list(b"ACGTNacgtn.")] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[list(b"0123456789")] = True
_SPACE = np.zeros(256, bool)
_SPACE[list(b" \t\n\r\x0b\x0c")] = True
_NUMBER = re.compile(r"[0-9]+(\.[0-9]+)?")
REASONS = np.array([None, "quoting", "column_count", "value"], object)
TYPED = "name string, mate int, seq string, qual array<int>, n_bases bigint, mean_qual double, run_date date"
_TYPES = [pa.string(), pa.int32(), pa.string(), pa.list_(pa.int32()), pa.int64(), pa.float64(), pa.date32()]


def structure(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions of the commas outside quotes, the line of each, and which lines break the quoting rules.

    ``starts`` and ``ends`` delimit lines that don't overlap, in order. A quote opens a field where the parity before it is
    even; it must then follow a delimiter or, doubled, a quote. One that closes must stand before a delimiter or a quote.
    """
    n, lines = len(buf), len(starts)
    quote = buf == 34
    count = np.r_[0, np.cumsum(quote)]
    line_of = np.repeat(np.arange(lines), ends - starts)
    at = np.repeat(starts - np.r_[0, np.cumsum(ends - starts)[:-1]], ends - starts) + np.arange(len(line_of))
    odd = (count[at + 1] - count[starts][line_of]) & 1  # after this byte
    byte = buf[at]
    comma = (byte == 44) & (odd == 0)
    bad = ((count[ends] - count[starts]) & 1).astype(bool)
    q = np.flatnonzero(byte == 34)
    if len(q):
        pos, line = at[q], line_of[q]
        before = np.where(pos > starts[line], buf[np.maximum(pos - 1, 0)], 44)
        after = np.where(pos + 1 < ends[line], buf[np.minimum(pos + 1, n - 1)], 44)
        opens = odd[q] == 1
        wrong = np.where(opens, (before != 44) & (before != 34), (after != 44) & (after != 34))
        bad[line[wrong]] = True
    c = np.flatnonzero(comma)
    return at[c], line_of[c], bad


def record_ends(buf: np.ndarray) -> np.ndarray:
    """Positions of the newlines outside quotes in raw text: where its records end."""
    return np.flatnonzero((buf == 10) & ((np.cumsum(buf == 34) & 1) == 0))


def _between(flags: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """How many flags are set in [lo, hi)."""
    count = np.r_[0, np.cumsum(flags)]
    return count[hi] - count[lo]


def _real_date(buf: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    ok = hi - lo == 10
    at = np.where(ok, lo, 0)[:, None] + np.arange(10)
    b = buf[np.minimum(at, len(buf) - 1)].astype(np.int64)
    digits = np.array([0, 1, 2, 3, 5, 6, 8, 9])
    ok &= _DIGIT[b[:, digits]].all(axis=1) & (b[:, 4] == 45) & (b[:, 7] == 45)
    d = b - 48
    year, month, day = d[:, 0] * 1000 + d[:, 1] * 100 + d[:, 2] * 10 + d[:, 3], d[:, 5] * 10 + d[:, 6], d[:, 8] * 10 + d[:, 9]
    leap = (year % 4 == 0) & ((year % 100 != 0) | (year % 400 == 0))
    longest = np.array([0, 31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31])[np.clip(month, 0, 12)] + (leap & (month == 2))
    return ok & (year >= 1) & (month >= 1) & (month <= 12) & (day >= 1) & (day <= longest)


def check_lines(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, offset: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Reason code of each line (0: valid), and starts, ends and quotedness of the fields of the lines with the right count."""
    comma, line, bad = structure(buf, starts, ends)
    fields = np.bincount(line, minlength=len(starts)) + 1
    reason = np.where(bad, 1, np.where(fields != N_FIELDS, 2, 0))
    rows = np.flatnonzero(reason == 0)
    inner = comma[(reason == 0)[line]].reshape(len(rows), N_FIELDS - 1)
    lo, hi = np.c_[starts[rows], inner + 1], np.c_[inner, ends[rows]]
    quoted = (hi - lo >= 2) & (buf[np.minimum(lo, max(len(buf) - 1, 0))] == 34)
    lo, hi = lo + quoted, hi - quoted
    if not len(rows):
        return reason, lo, hi, quoted
    size = hi - lo
    byte = lambda f, i=0: buf[np.minimum(lo[:, f] + i, len(buf) - 1)]
    ok = _between(~_SPACE[buf], lo[:, 0], hi[:, 0]) > 0
    ok &= (size[:, 1] == 1) & ((byte(1) == 49) | (byte(1) == 50))
    ok &= (size[:, 2] > 0) & (_between(~_SEQ[buf], lo[:, 2], hi[:, 2]) == 0)
    symbols = size[:, 3] - _between(buf == 34, lo[:, 3], hi[:, 3]) // 2  # a doubled quote is one symbol
    ok &= symbols == size[:, 2]
    base = np.repeat(np.r_[0, offset[rows]], np.diff(np.r_[0, lo[:, 3], len(buf)])).astype(np.int32)  # from each quality field on
    value = buf.astype(np.int32) - base
    ok &= _between((value < 0) | (value > MAX_QUALITY), lo[:, 3], hi[:, 3]) == 0
    ok &= (size[:, 4] > 0) & (_between(~_DIGIT[buf], lo[:, 4], hi[:, 4]) == 0)
    width = int(min(size[:, 4].max(), 18))
    number = np.zeros(len(rows), np.int64)
    for i in range(width):
        number = np.where(i < size[:, 4], number * 10 + (byte(4, i).astype(np.int64) - 48), number)
    for r in np.flatnonzero(ok & (size[:, 4] > 18)):
        number[r] = min(int(buf[lo[r, 4] : hi[r, 4]].tobytes()), 1 << 62)
    ok &= number == size[:, 2]
    ok &= _real_date(buf, lo[:, 6], hi[:, 6])
    point = _between(buf == 46, lo[:, 5], hi[:, 5])
    digits = _between(_DIGIT[buf], lo[:, 5], hi[:, 5])
    ok &= (digits + point == size[:, 5]) & (point <= 1)
    for r in np.flatnonzero(ok & (size[:, 5] > 0)):
        text = buf[lo[r, 5] : hi[r, 5]].tobytes().decode()
        ok[r] = bool(_NUMBER.fullmatch(text)) and float(text) <= MAX_QUALITY
    reason[rows[~ok]] = 3
    return reason, lo, hi, quoted


def _slices(lines: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of lines of at most ``SLICE_BYTES``, or one line."""
    sizes = np.diff(np.frombuffer(lines.buffers()[1], np.int32, len(lines) + 1, lines.offset * 4))
    part = np.cumsum(sizes) // SLICE_BYTES
    for p in np.unique(part):
        yield int(np.searchsorted(part, p)), int(np.searchsorted(part, p, "right"))


def _parsing(typed: bool):
    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            lines = whole.column(0).cast(pa.string())
            if not whole.num_rows:
                continue
            for a, z in _slices(lines):
                part = lines.slice(a, z - a).fill_null("")
                part = pa.concat_arrays([part])  # own buffers from offset 0
                at = np.frombuffer(part.buffers()[1], np.int32, len(part) + 1, part.offset * 4).astype(np.int64)
                raw = part.buffers()[2]
                buf = np.frombuffer(raw, np.uint8)[: at[-1]] if raw is not None and at[-1] else np.zeros(0, np.uint8)
                buf = np.r_[buf, np.uint8(10)]  # so that every position before the end of a line exists
                starts, ends = at[:-1], at[1:].copy()
                ends -= (ends > starts) & (buf[np.maximum(ends - 1, 0)] == 13)
                offset = whole.column(1).slice(a, z - a).fill_null(33).to_numpy(zero_copy_only=False).astype(np.int64)
                reason, lo, hi, quoted = check_lines(buf, starts, ends, offset)
                cols = [c.slice(a, z - a) for c in whole.columns[2:]] + [pa.array(REASONS[reason], pa.string())]
                names = [*whole.schema.names[2:], "reason"]
                if typed:
                    text = buf.tobytes()
                    made: list[list] = [[None] * (z - a) for _ in range(N_FIELDS)]
                    rows = np.flatnonzero((reason == 0) | (reason == 3))
                    for i, r in enumerate(rows):
                        if reason[r]:
                            continue
                        f = [text[s:e].replace(b'""', b'"') if q else text[s:e] for s, e, q in zip(lo[i], hi[i], quoted[i])]
                        values = (f[0].decode(), int(f[1]), f[2].decode(), np.frombuffer(f[3], np.uint8).astype(np.int32) - offset[r], int(f[4]), float(f[5]) if f[5] else None, datetime.date.fromisoformat(f[6].decode()))
                        for c, v in zip(made, values):
                            c[r] = v
                    cols += [pa.array(c, t) for c, t in zip(made, _TYPES)]
                    names += [x.split()[0] for x in TYPED.split(", ")]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return parse


def parse_reads(lines: DataFrame, line: Column, offset: Column, *carry: str, typed: bool = True) -> DataFrame:
    """``(*carry, reason)`` and, if ``typed``, the fields of a read, which are null where ``reason`` is set.

    A line that fails gets the first of ``quoting``, ``column_count`` and ``value`` that applies, every line gives one row.
    One trailing carriage return isn't part of a line. A null or empty line has one field and so fails with
    ``column_count``. ``offset`` is that of the quality codes, null is 33.
    """
    rows = lines.select(line.alias("_line"), offset.cast("int").alias("_offset"), *carry)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[2:])
    return rows.mapInArrow(_parsing(typed), f"{schema}, reason string" + (f", {TYPED}" if typed else ""))


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "kmer_reader").select("file_id", "fastq_ascii_offset").dropDuplicates(["file_id"])
    return table(spark, sf_dir, "raw_reads").select("raw_id", "file_id", "line").join(files, "file_id", "left")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_reads(_raw(spark, sf_dir), F.col("line"), F.col("fastq_ascii_offset"), "raw_id", typed=False).filter("reason IS NOT NULL").select("raw_id", "reason")


def p3_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_reads(_raw(spark, sf_dir), F.col("line"), F.col("fastq_ascii_offset"), "raw_id", "file_id").filter("reason IS NULL").drop("reason")


def p3_bad_by_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = parse_reads(_raw(spark, sf_dir), F.col("line"), F.col("fastq_ascii_offset"), "file_id", typed=False)
    count = lambda r: F.count_if(F.col("reason") == r).alias(f"n_{r}")
    return got.groupBy("file_id").agg(F.count("*").alias("n_lines"), F.count("reason").alias("bad_reads"), *[count(r) for r in REASONS[1:]])


_FIELD = r'("([^"]|"")*"|[^",]*)'
_WELL = f"^{_FIELD}(,{_FIELD})*$"
_UNQUOTED = "CASE WHEN f[{i}][1] = '\"' THEN replace(f[{i}][2:-2], '\"\"', '\"') ELSE f[{i}] END"
_CHECK_SQL = (
    r"""WITH l AS (SELECT raw_id, file_id, coalesce(fastq_ascii_offset, 33) AS off, CASE WHEN ends_with(line, chr(13)) THEN line[:-2] ELSE coalesce(line, '') END AS line
           FROM raw_reads LEFT JOIN kmer_reader USING (file_id)),
w AS (SELECT *, regexp_full_match(line, '(?s)"""
    + _FIELD
    + "(,"
    + _FIELD
    + r""")*') AS well FROM l),
s AS (SELECT *, CASE WHEN well THEN list_transform(regexp_extract_all(',' || line, '(?s),("(?:[^"]|"")*"|[^",]*)'), lambda x: x[2:]) END AS f FROM w),
u AS (SELECT *, """
    + ", ".join(_UNQUOTED.replace("{i}", str(i)) + f" AS f{i}" for i in range(1, 8))
    + r""" FROM s),
r AS (SELECT *, CASE WHEN NOT well THEN 'quoting' WHEN len(f) <> 7 THEN 'column_count' WHEN NOT (
  trim(f1, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) <> '' AND f2 IN ('1', '2') AND regexp_full_match(f3, '[ACGTNacgtn.]+') AND length(f4) = length(f3)
  AND len(list_filter(string_split(f4, ''), lambda c: ord(c) < off OR ord(c) > off + 41)) = 0
  AND regexp_full_match(f5, '[0-9]+') AND coalesce(try_cast(f5 AS HUGEINT), -1) = length(f3)
  AND (f6 = '' OR (regexp_full_match(f6, '[0-9]+(\.[0-9]+)?') AND try_cast(f6 AS DOUBLE) <= 41))
  AND regexp_full_match(f7, '[0-9]{4}-[0-9]{2}-[0-9]{2}') AND try_cast(f7 AS DATE) IS NOT NULL) THEN 'value' END AS reason FROM u)
"""
)
SQL = {
    "p3_found": _CHECK_SQL + "SELECT raw_id, reason FROM r WHERE reason IS NOT NULL",
    "p3_bad_by_file": _CHECK_SQL + "SELECT file_id, count(*) AS n_lines, count(reason) AS bad_reads, count(*) FILTER (reason = 'quoting') AS n_quoting, count(*) FILTER (reason = 'column_count') AS n_column_count, count(*) FILTER (reason = 'value') AS n_value FROM r GROUP BY file_id",
    "p3_reads": _CHECK_SQL + "SELECT raw_id, file_id, f1 AS name, CAST(f2 AS INT) AS mate, f3 AS seq, list_transform(string_split(f4, ''), lambda c: CAST(ord(c) - off AS INT)) AS qual, CAST(f5 AS BIGINT) AS n_bases, TRY_CAST(nullif(f6, '') AS DOUBLE) AS mean_qual, CAST(f7 AS DATE) AS run_date FROM r WHERE reason IS NULL",
}
QUERIES = {"p3_found": p3_found, "p3_reads": p3_reads, "p3_bad_by_file": p3_bad_by_file}
