"""Problem 6: cutting items over a size limit at natural boundaries, with an overlap where a unit has to be cut.

Of every read the boundaries are known beforehand: the ends of its windows, points in the gaps between them and, in a
window over the limit, the starts that forced cuts can lead to. Each boundary is joined to its farthest legal successor,
for all reads of a batch in one table; squaring that table again and again marks, in a logarithmic number of steps, the
boundaries that the greedy cutting from the left reaches. Rows never leave their task until the pieces are made.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from strandmill.runtime import table

_BASE = np.zeros(256, bool)
_BASE[list(b"ACGTacgt")] = True
PIECES = "read_id bigint, piece_no int, start int, end int, cut_window int, piece string"
BATCH_BYTES = 1 << 23


def _boundaries(good: np.ndarray, size: int, limit: int, unit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions to start a piece at, where that piece ends, and the window it has to cut (-1: none)."""
    edge = np.flatnonzero(np.diff(np.r_[False, good, False].astype(np.int8)))
    lo, hi = edge[::2], edge[1::2]
    keep = hi - lo >= unit
    lo, hi = lo[keep], hi[keep]
    number = np.arange(len(lo))
    natural = np.unique(np.r_[0, lo, hi, size])
    gap_lo, gap_hi = np.r_[0, hi], np.r_[lo, size]
    wide = gap_hi - gap_lo > limit
    if wide.any():
        natural = np.unique(np.r_[natural, *(np.arange(a, z, limit) for a, z in zip(gap_lo[wide], gap_hi[wide]))])
    natural = natural.astype(np.int64)
    far = natural[np.searchsorted(natural, natural + limit, "right") - 1]
    start, end, cut = [natural], [far], [np.full(len(natural), -1)]
    step = max(limit - unit, 1)
    for w in number[hi - lo > limit]:
        forced = int(-(-(hi[w] - limit - lo[w]) // step))  # pieces that end inside the window
        s = lo[w] + step * np.arange(forced + 1, dtype=np.int64)
        e = s + limit
        e[-1] = natural[np.searchsorted(natural, s[-1] + limit, "right") - 1]
        c = np.full(forced + 1, w)
        c[-1] = -1
        at = np.searchsorted(natural, lo[w])
        end[0][at], cut[0][at] = e[0], c[0]
        start.append(s[1:]), end.append(e[1:]), cut.append(c[1:])
    return np.concatenate(start), np.concatenate(end), np.concatenate(cut)


def greedy_pieces(seqs: list[bytes], limits: np.ndarray, units: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pieces of all sequences at once: index of the sequence, start, end, window cut at the end (-1: none), in order."""
    owner, start, end, cut, nxt, heads, base = [], [], [], [], [], [], 0
    for i, seq in enumerate(seqs):
        size, limit, unit = len(seq), max(int(limits[i]), 1), max(int(units[i]), 1)
        if size <= limit:
            s, e, c = np.array([0, size]), np.array([size, size]), np.array([-1, -1])
        else:
            s, e, c = _boundaries(_BASE[np.frombuffer(seq, np.uint8)], size, limit, unit)
        order = np.argsort(s, kind="stable")
        s, e, c = s[order], e[order], c[order]
        follow = np.where(c >= 0, e - min(unit, limit - 1), e)
        owner.append(np.full(len(s), i)), start.append(s), end.append(e), cut.append(c), heads.append(base)
        nxt.append(base + np.searchsorted(s, follow))
        base += len(s)
    owner, start, end, cut, jump = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (owner, start, end, cut, nxt))
    reached = np.zeros(len(start), bool)
    reached[heads] = True
    while len(jump):  # jump leads 1, 2, 4, ... successors on
        more = reached.copy()
        more[jump[reached]] = True
        if (more == reached).all() and (jump[jump] == jump).all():
            break
        reached, jump = more, jump[jump]
    reached &= (start < end) | ((start == 0) & (end == 0))
    at = np.flatnonzero(reached)
    if len(at):  # an empty sequence has two boundaries at 0 and one piece
        at = at[np.r_[True, (owner[at][1:] != owner[at][:-1]) | (start[at][1:] != start[at][:-1])]]
    return owner[at], start[at], end[at], cut[at]


def _cutting(text: bool):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            sizes = np.array([len(x or "") for x in whole.column(1).to_pylist()], np.int64)
            part = np.cumsum(sizes) // BATCH_BYTES
            for p in np.unique(part):
                b = whole.slice(int(np.searchsorted(part, p)), int(np.count_nonzero(part == p)))
                raw = b.column(1).to_pylist()
                seqs = [(x or "").encode("ascii", "replace") for x in raw]
                big = np.iinfo(np.int32).max
                limits = np.array([x if x is not None and x > 0 else big for x in b.column(2).to_pylist()], np.int64)
                units = np.array([x if x is not None and x > 0 else 1 for x in b.column(3).to_pylist()], np.int64)
                i, s, e, c = greedy_pieces(seqs, limits, units)
                first = np.r_[0, np.flatnonzero(np.diff(i)) + 1] if len(i) else np.zeros(0, int)
                number = np.arange(len(i)) - np.repeat(first, np.diff(np.r_[first, len(i)]))
                ids = b.column(0).take(pa.array(i))
                pieces = [raw[k] and raw[k][a:z] if text else None for k, a, z in zip(i, s, e)]
                yield pa.RecordBatch.from_arrays([ids, pa.array(number, pa.int32()), pa.array(s, pa.int32()), pa.array(e, pa.int32()), pa.array(c, pa.int32(), mask=c < 0), pa.array(pieces, pa.string())], names=["read_id", "piece_no", "start", "end", "cut_window", "piece"])

    return cut


def split_oversized(reads: DataFrame, text: bool = True) -> DataFrame:
    """``(read_id, piece_no, start, end, cut_window, piece)``: every read in pieces of at most ``max_chunk`` bases.

    Windows are maximal runs of ACGT in either case of at least ``kmer_size`` bases. Pieces end at the farthest boundary
    within the limit; only a window over the limit is cut, ``cut_window`` then has its number and the next piece starts
    ``kmer_size`` bases before the cut (the limit less one, if that is smaller). Reads within the limit come out whole. A
    null limit, or one below 1, is none; a null ``kmer_size`` is 1. A null or empty ``seq`` is one piece, null or empty.
    A read_id counts once: rows repeated whole give each piece once.
    """
    got = reads.select("read_id", "seq", "max_chunk", "kmer_size").mapInArrow(_cutting(text), PIECES)
    return got.dropDuplicates(["read_id", "piece_no", "start", "end"])


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    reads = table(spark, sf_dir, "reads_fasta").filter(F.length("seq") > F.col("max_chunk"))
    cut = reads.select("read_id", "seq", "max_chunk", "kmer_size").mapInArrow(_cutting(False), PIECES).filter("cut_window IS NOT NULL")
    return cut.select("read_id", F.col("cut_window").alias("window_no")).distinct()


def p6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_oversized(table(spark, sf_dir, "reads_fasta"))


SQL = {
    "p6_found": """WITH reads AS (SELECT DISTINCT read_id, seq, max_chunk, kmer_size FROM reads_fasta WHERE length(seq) > max_chunk),
w AS (SELECT read_id, max_chunk, list_filter(regexp_extract_all(upper(seq), '[ACGT]+'), lambda x: length(x) >= kmer_size) AS ws FROM reads),
n AS (SELECT read_id, max_chunk, ws, unnest(range(len(ws))) AS i FROM w)
SELECT read_id, CAST(i AS INT) AS window_no FROM n WHERE length(ws[i + 1]) > max_chunk""",
    "p6_pieces": """WITH RECURSIVE reads AS (SELECT DISTINCT read_id, seq, CASE WHEN max_chunk > 0 THEN max_chunk ELSE 2147483647 END AS lim, CASE WHEN kmer_size > 0 THEN kmer_size ELSE 1 END AS unit FROM reads_fasta),
big AS (SELECT * FROM reads WHERE length(seq) > lim),
chars AS (SELECT read_id, unit, unnest(string_split(seq, '')) AS c, unnest(range(length(seq))) AS i FROM big),
bases AS (SELECT read_id, unit, i, i - row_number() OVER (PARTITION BY read_id ORDER BY i) AS island FROM chars WHERE strpos('ACGTacgt', c) > 0),
win AS (SELECT read_id, lo, hi, row_number() OVER (PARTITION BY read_id ORDER BY lo) - 1 AS no FROM (SELECT read_id, min(i) AS lo, max(i) + 1 AS hi FROM bases GROUP BY read_id, island, unit HAVING count(*) >= unit)),
edges AS (SELECT read_id, lo AS x FROM win UNION SELECT read_id, hi FROM win UNION SELECT read_id, 0 FROM big UNION SELECT read_id, length(seq) FROM big),
gaps AS (SELECT read_id, hi AS a, lead(lo) OVER (PARTITION BY read_id ORDER BY lo) AS z FROM win UNION ALL SELECT read_id, 0, min(lo) FROM win GROUP BY read_id
  UNION ALL SELECT read_id, 0, NULL FROM big WHERE read_id NOT IN (SELECT read_id FROM win)),
wide AS (SELECT read_id, unnest(range(a, coalesce(z, length(seq)), lim)) AS x FROM gaps JOIN big USING (read_id) WHERE coalesce(z, length(seq)) - a > lim),
cuts AS (SELECT read_id, list(x) AS xs FROM (SELECT * FROM edges UNION SELECT * FROM wide) GROUP BY read_id),
base AS MATERIALIZED (SELECT read_id, length(seq) AS size, lim, unit, xs FROM big JOIN cuts USING (read_id)),
steps(read_id, n, s, e, forced, nxt) AS (
  SELECT read_id, 0, CAST(0 AS BIGINT), CAST(coalesce(list_max(list_filter(xs, lambda x: x > 0 AND x <= lim)), lim) AS BIGINT), len(list_filter(xs, lambda x: x > 0 AND x <= lim)) = 0,
    CAST(coalesce(list_max(list_filter(xs, lambda x: x > 0 AND x <= lim)), lim - least(unit, lim - 1)) AS BIGINT) FROM base
  UNION ALL SELECT read_id, n + 1, nxt, coalesce(list_max(list_filter(xs, lambda x: x > nxt AND x <= nxt + lim)), nxt + lim), len(list_filter(xs, lambda x: x > nxt AND x <= nxt + lim)) = 0,
    coalesce(list_max(list_filter(xs, lambda x: x > nxt AND x <= nxt + lim)), nxt + lim - least(unit, lim - 1)) FROM steps JOIN base USING (read_id) WHERE nxt < size)
SELECT s.read_id, CAST(n AS INT) AS piece_no, CAST(s.s AS INT) AS "start", CAST(e AS INT) AS "end", CAST(CASE WHEN forced THEN no END AS INT) AS cut_window, substr(seq, s.s + 1, e - s.s) AS piece
FROM steps s JOIN big USING (read_id) LEFT JOIN win w ON forced AND w.read_id = s.read_id AND s.s >= lo AND s.s < hi
UNION ALL SELECT read_id, 0, 0, coalesce(length(seq), 0), NULL, seq FROM reads WHERE seq IS NULL OR length(seq) <= lim""",
}
QUERIES = {"p6_found": p6_found, "p6_pieces": p6_pieces}
