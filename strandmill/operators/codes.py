"""K-mers of reads as packed BIGINTs, for k up to 31: one pass over the bases of a whole batch, with NumPy.

Two bits a base, order-preserving, so the smaller code is the canonical k-mer; ``functions.kmer`` packs and unpacks the same codes.
A row is 8 bytes instead of a string, and each read is looked at once for its k-mers and their neighbours.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

_DIGIT = np.full(256, 4, np.uint8)
for _i, _pair in enumerate((b"Aa", b"Cc", b"Gg", b"Tt")):
    _DIGIT[list(_pair)] = _i
LONGEST = 31
#: Bases of a block: longer batches are cut between reads.
BLOCK = 1 << 22


def rolling_codes(digits: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all runs of ``k`` digits and of their reverse complements, by doubling."""
    d = (digits & 3).astype(np.int64)
    forward, back, have = None, None, 0
    f, r, width = d, 3 - d, 1
    rest = k
    while rest:
        if rest & 1:
            if have == 0:
                forward, back, have = f, r, width
            else:
                n = len(forward) - width
                forward = (forward[: max(n, 0)] << (2 * width)) | f[have : have + max(n, 0)]
                back = (r[have : have + max(n, 0)] << (2 * have)) | back[: max(n, 0)]
                have += width
        rest >>= 1
        if rest:
            n = max(len(f) - width, 0)
            f, r = (f[:n] << (2 * width)) | f[width : width + n], (r[width : width + n] << (2 * width)) | r[:n]
            width *= 2
    return forward, back


def packed(kmers: pa.Array, k: int) -> np.ndarray:
    """Codes of k-mers of one length, ACGT only."""
    text = kmers.cast(pa.large_string())
    offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset :]
    digits = _DIGIT[np.frombuffer(text.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[len(text)]]].reshape(len(text), k)
    code = np.zeros(len(text), np.int64)
    for i in range(k):
        code = code << 2 | digits[:, i]
    return code


def reversed_codes(code: np.ndarray, k: int) -> np.ndarray:
    """Codes of the reverse complements."""
    out = np.zeros_like(code)
    for i in range(k):
        out = out << 2 | 3 - (code >> 2 * i & 3)
    return out


def _blocks(batch: pa.RecordBatch, cut: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``(first row, digits, ends)`` of blocks of reads; a base that can't be part of a k-mer has the digit 4."""
    text = batch.column(1).cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
    raw = np.frombuffer(text.buffers()[2] or b"", np.uint8)
    row = 0
    while row < len(text):
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + BLOCK, "right")) - 1)
        digits = _DIGIT[raw[offsets[row] : offsets[stop]]]
        ends = offsets[row + 1 : stop + 1] - offsets[row]
        if cut > 0:
            _mask_low(digits, ends, batch.column(2).slice(row, stop - row), cut)
        yield row, digits, ends
        row = stop


def _mask_low(digits: np.ndarray, ends: np.ndarray, qualities: pa.ListArray, cut: int) -> None:
    """Bases of a quality up to ``cut``; a base beyond its read's qualities, or of a null one, stays."""
    begins = np.r_[0, ends[:-1]]
    lengths = qualities.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    values = qualities.flatten().fill_null(np.iinfo(np.int32).max).to_numpy(zero_copy_only=False)
    at = np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    inside = at < np.repeat(ends - begins, lengths)
    place = (at + np.repeat(begins, lengths))[inside]
    digits[place[values[inside] <= cut]] = 4


def _windows(digits: np.ndarray, ends: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts of all good windows, the read of each, and the codes of both strands."""
    none = np.zeros(0, np.int64)
    if len(digits) < k:
        return none, none, none, none
    bad = np.r_[0, np.cumsum(digits > 3)]
    owner = np.repeat(np.arange(len(ends)), np.diff(np.r_[0, ends]))[: len(digits) - k + 1]
    good = np.flatnonzero((bad[k:] == bad[:-k]) & (np.arange(len(owner)) + k <= ends[owner]))
    forward, back = rolling_codes(digits, k)
    return good, owner[good], forward[good], back[good]


def _check(k: int) -> None:
    if not 1 <= k <= LONGEST:
        raise ValueError(f"k must be from 1 to {LONGEST} to fit a BIGINT")


def _plain(reads: DataFrame, key: str, cut: int) -> DataFrame:
    if cut <= 0:
        return reads.select(key, "seq")
    return reads.select(key, F.regexp_replace("seq", r"[^\x00-\x7F]", "N").alias("seq"), F.col("qual").cast("array<int>"))  # a byte a base, as qualities go by bases


def read_codes(reads: DataFrame, k: int, key: str = "read_id", cut: int = 0) -> DataFrame:
    """``(key, code, n)``: the canonical k-mers of each read, each once with how often it occurs; null and 0 for a read without any."""
    _check(k)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, digits, ends in _blocks(b, cut):
                _, owner, forward, back = _windows(digits, ends, k)
                code = np.minimum(forward, back)
                order = np.lexsort((code, owner))
                code, owner = code[order], owner[order]
                first = np.flatnonzero(np.r_[True, (code[1:] != code[:-1]) | (owner[1:] != owner[:-1])]) if len(code) else np.zeros(0, np.int64)
                n = np.diff(np.r_[first, len(code)])
                without = np.setdiff1d(np.arange(len(ends)), owner)
                at = np.r_[owner[first], without]
                codes = pa.array(np.r_[code[first], np.zeros(len(without), np.int64)], mask=np.r_[np.zeros(len(first), bool), np.ones(len(without), bool)])
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row + at)), codes, pa.array(np.r_[n, np.zeros(len(without), np.int64)])], names=[key, "code", "n"])

    rows = _plain(reads, key, cut)
    return rows.mapInArrow(coded, f"`{key}` {rows.schema[key].dataType.simpleString()}, code bigint, n bigint")


def count_codes(reads: DataFrame, k: int, cut: int = 0) -> DataFrame:
    """``(code, coverage)``: partial counts for each block and task before the shuffle, so a hot k-mer is one row a task."""
    return neighbours(reads, k, cut, edges=False).groupBy("code").agg(F.sum("n").alias("coverage"))


def neighbours(reads: DataFrame, k: int, cut: int = 0, edges: bool = True) -> DataFrame:
    """``(code, n, edges)``: canonical k-mers of blocks of reads, how often they occur, and the edge byte of the bases beside them."""
    _check(k)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, digits, ends in _blocks(b, cut):
                at, owner, forward, back = _windows(digits, ends, k)
                code = np.minimum(forward, back)
                names, columns = ["code", "n"], []
                if edges:
                    same = forward <= back
                    after, before = np.full(len(at), 4, np.uint8), np.full(len(at), 4, np.uint8)
                    has = at + k < ends[owner]
                    after[has] = digits[at[has] + k]
                    has = at > np.r_[0, ends[:-1]][owner]
                    before[has] = digits[at[has] - 1]
                    bits = np.where(after < 4, np.left_shift(1, (after & 3).astype(np.int32) + np.where(same, 0, 4)), 0) | np.where(before < 4, np.left_shift(1, 3 - (before & 3).astype(np.int32) + np.where(same, 4, 0)), 0)
                order = np.argsort(code, kind="stable")
                code = code[order]
                first = np.flatnonzero(np.r_[True, code[1:] != code[:-1]]) if len(code) else np.zeros(0, np.int64)
                columns = [pa.array(code[first]), pa.array(np.diff(np.r_[first, len(code)]))]
                if edges:
                    names.append("edges")
                    columns.append(pa.array((np.bitwise_or.reduceat(bits[order], first) if len(first) else np.zeros(0)).astype(np.int32)))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    rows = _plain(reads.withColumn("_key", F.lit(0)), "_key", cut)
    return rows.mapInArrow(coded, "code bigint, n bigint" + (", edges int" if edges else ""))
