"""Pairwise local alignment in Arrow batches, and what is built on it: orientation, consensus, variants, masks, scores.

Only the dynamic programme runs in Python, with NumPy along anti-diagonals. Consensus over many alignments is an aggregation
by reference position, so that no reference's reads have to meet in one task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from strandmill.functions import seq as S
from strandmill.operators.kmers import fastq_reads, occurrences
from strandmill.runtime import materialise

# Match, transition, transversion, gap, and the score of a symbol other than ACGT against another one, by rule.
RULES = {"default": (2, -5, -7, -10, 2), "extreme": (1, -5, -7, -20, 2), "half_gap": (2, -5, -7, -5, -10), "simple": (2, -5, -5, -10, -5)}
_CODE = np.full(256, 9, np.int64)
_CODE[list(b"ACGT")] = np.arange(4)
ALIGNED = "score int, start_a int, end_a int, start_b int, end_b int, a_aligned string, b_aligned string, matches int, mismatches int, gaps int, longest int"
_KINDS = [*[pa.int32()] * 5, pa.string(), pa.string(), *[pa.int32()] * 4]


def local_alignment(a: str, b: str, rule: str = "default") -> tuple:
    """The best local alignment in upper case: fields of ``ALIGNED``, ends exclusive.

    Of equal best cells the last one counts. Going back, the diagonal comes first, then the gap in b if its cell is
    strictly better than that of the gap in a. Nothing aligns with an empty string: all zeros.
    """
    match, transition, transversion, gap, other = RULES[rule]
    a, b = a.upper(), b.upper()
    n, m = len(a), len(b)
    if not n or not m:
        return (0, 0, 0, 0, 0, "", "", 0, 0, 0, 0)
    x, y = (np.frombuffer(s.encode("ascii", "replace"), np.uint8) for s in (a, b))
    cx, cy = _CODE[x], _CODE[y]
    score = np.zeros((n + 1, m + 1), np.int32)
    for d in range(2, n + m + 1):
        i = np.arange(max(1, d - m), min(n, d - 1) + 1)
        j = d - i
        p, q = cx[i - 1], cy[j - 1]
        change = p ^ q
        s = np.where(x[i - 1] == y[j - 1], match, np.where((p > 3) | (q > 3), other, np.where(change == 2, transition, transversion)))
        score[i, j] = np.maximum(0, np.maximum(score[i - 1, j - 1] + s, np.maximum(score[i - 1, j], score[i, j - 1]) + gap))
    flat = score[1:, 1:].ravel()
    best = len(flat) - 1 - int(flat[::-1].argmax())
    i, j = best // m + 1, best % m + 1
    top = int(score[i, j])
    if not top:
        return (0, 0, 0, 0, 0, "", "", 0, 0, 0, 0)
    end_a, end_b, out_a, out_b = i, j, [a[i - 1]], [b[j - 1]]
    i, j = i - 1, j - 1
    while i and j and score[i, j]:
        diagonal, up, left = score[i - 1, j - 1], score[i - 1, j], score[i, j - 1]
        if diagonal >= up and diagonal >= left:
            out_a.append(a[i - 1]), out_b.append(b[j - 1])
            i, j = i - 1, j - 1
        elif up > left:
            out_a.append(a[i - 1]), out_b.append("-")
            i -= 1
        else:
            out_a.append("-"), out_b.append(b[j - 1])
            j -= 1
    left_a, left_b = "".join(reversed(out_a)), "".join(reversed(out_b))
    matches = mismatches = gaps = run = longest = 0
    for p, q in zip(left_a, left_b):
        gaps += p == "-" or q == "-"
        matches += p == q
        mismatches += p != q and p != "-" and q != "-"
        run = run + 1 if p == q else 0
        longest = max(longest, run)
    return (top, i, end_a, j, end_b, left_a, left_b, matches, mismatches, gaps, longest)


#: Bytes of one block's scores, and pairs of a block, at most; a single pair may take more.
BLOCK_BYTES, BLOCK_PAIRS = 24 << 20, 512
_PAD = 0x80
_SYMBOL = np.arange(256, dtype=np.uint8) & 0x7F
_SYMBOL[list(b"ACGT")], _SYMBOL[:4] = np.arange(4), list(b"ACGT")  # other ASCII symbols keep their number, so each equals itself only
_TURN = bytes.maketrans(b"ACGT", b"TGCA")
_WAYS: tuple[Callable[[bytes], bytes], ...] = (lambda s: s, lambda s: s.translate(_TURN)[::-1], lambda s: s[::-1], lambda s: s.translate(_TURN))


def _packed(seqs: list[bytes], pad: int) -> tuple[np.ndarray, np.ndarray]:
    """Symbols and bytes of a block, a column a sequence, filled up with a symbol that fits nothing."""
    width = max(map(len, seqs))
    raw = np.frombuffer(b"".join(s.ljust(width, b"\0") for s in seqs), np.uint8).reshape(len(seqs), width)
    codes = np.where(np.arange(width) < np.array([len(s) for s in seqs])[:, None], _SYMBOL[raw], pad).astype(np.uint8)
    return np.ascontiguousarray(codes.T), raw


def _scored(p: np.ndarray, q: np.ndarray, rule: str, keep: bool) -> np.ndarray:
    """Best scores of a block of pairs; with ``keep`` all scores, by anti-diagonal, position in a and pair.

    The scores of cells beyond a shorter pair's ends are below those of cells within, so they are never the best.
    """
    match, transition, transversion, gap, other = RULES[rule]
    (n, w), m = p.shape, len(q)
    kind = np.int16 if match * min(n, m) < 30_000 else np.int32
    score = np.zeros((n + m + 1 if keep else 3, n + 1, w), kind)
    best, back = np.zeros((n + 1, w), kind), np.ascontiguousarray(q[::-1])
    plain = max(int(p.max()), int(q.max())) < 4
    for d in range(2, n + m + 1):
        lo, hi = max(1, d - m), min(n, d - 1)
        x, y = p[lo - 1 : hi], back[m - d + lo : m - d + hi + 1]
        change = x ^ y
        s = (change == 2).view(np.int8) * np.int8(transition - transversion)
        s += np.int8(transversion)
        if not plain:
            both = x | y
            np.copyto(s, np.int8(other), where=both > 3)
        np.copyto(s, np.int8(match), where=change == 0)
        if not plain:
            np.copyto(s, np.int8(-100), where=both >= _PAD)
        now, one, two = (score[(d - i) if keep else (d - i) % 3] for i in (0, 1, 2))
        cell = np.maximum(one[lo - 1 : hi], one[lo : hi + 1])
        cell += kind(gap)
        np.maximum(cell, two[lo - 1 : hi] + s, out=cell)
        np.maximum(cell, 0, out=cell)
        now[lo : hi + 1] = cell
        if keep:
            continue
        now[lo - 1] = 0  # what an earlier diagonal has left beside this one
        if hi < n:
            now[hi + 1] = 0
        np.maximum(best[lo : hi + 1], cell, out=best[lo : hi + 1])
    return score if keep else best.max(0)


def _traced(a: list[bytes], b: list[bytes], rule: str) -> list[list]:
    """The columns of ``ALIGNED`` for a block of pairs, as of ``local_alignment``."""
    (p, raw_a), (q, raw_b) = _packed(a, _PAD), _packed(b, _PAD | 1)
    score, w = _scored(p, q, rule, True), len(a)
    each = np.arange(w)
    top = score.max((0, 1))
    hit = score == top
    i = len(p) - hit.any(0)[::-1].argmax(0)
    d = len(score) - 1 - hit[:, i, each][::-1].argmax(0)
    j, some = d - i, top > 0
    i[~some], j[~some] = 0, 0
    end_a, end_b = i.copy(), j.copy()
    out_a, out_b, on = [], [], each[some]
    first = True
    while len(on):
        u, v = i[on], j[on]
        diagonal, up, left = score[u + v - 2, u - 1, on], score[u + v - 1, u - 1, on], score[u + v - 1, u, on]
        straight = (diagonal >= up) & (diagonal >= left) | first
        first = False
        in_a, in_b = straight | (up > left), straight | (up <= left)
        line_a, line_b = np.zeros(w, np.uint8), np.zeros(w, np.uint8)
        line_a[on], line_b[on] = np.where(in_a, raw_a[on, u - 1], 45), np.where(in_b, raw_b[on, v - 1], 45)
        out_a.append(line_a), out_b.append(line_b)
        u, v = u - in_a, v - in_b
        i[on], j[on] = u, v
        on = on[(u > 0) & (v > 0) & (score[u + v, u, on] > 0)]
    steps = len(out_a)
    x, y = (np.ascontiguousarray(np.array(o[::-1], np.uint8).reshape(steps, w).T) for o in (out_a, out_b))
    there, same = x > 0, (x == y) & (x > 0)
    gaps = there & ((x == 45) | (y == 45))
    count = np.cumsum(same, 1, dtype=np.int64)
    longest = (count - np.maximum.accumulate(np.where(same, 0, count), 1)).max(1, initial=0)
    skip = steps - there.sum(1)
    text = lambda o: [o[r, s:].tobytes().decode("ascii") for r, s in enumerate(skip.tolist())]
    numbers = (same.sum(1), (there & ~same & ~gaps).sum(1), gaps.sum(1), longest)
    return [top.tolist(), i.tolist(), end_a.tolist(), j.tolist(), end_b.tolist(), text(x), text(y), *[c.tolist() for c in numbers]]


def _blocks(a: list[bytes], b: list[bytes], rows: list[int], keep: bool) -> Iterator[list[int]]:
    """The rows in blocks of similar lengths."""
    block, n, m = [], 0, 0
    for r in sorted(rows, key=lambda r: (len(a[r]), len(b[r]))):
        n, m = max(n, len(a[r])), max(m, len(b[r]))
        if block and (len(block) == BLOCK_PAIRS or 2 * (n + m + 1 if keep else 6) * (n + 1) * (len(block) + 1) > BLOCK_BYTES):
            yield block
            block, n, m = [], len(a[r]), len(b[r])
        block.append(r)
    if block:
        yield block


def alignments(a: list[str | None], b: list[str | None], rule: str = "default") -> list[list]:
    """The columns of ``ALIGNED`` for many pairs: as ``local_alignment``, but a block of pairs at once."""
    a, b = ([(s or "").upper() for s in x] for x in (a, b))
    out: list[list] = [[0] * len(a) if t != pa.string() else [""] * len(a) for t in _KINDS]
    plain = [bool(x) and bool(y) and x.isascii() and y.isascii() and "\0" not in x + y for x, y in zip(a, b)]
    x, y = ([s.encode() if ok else b"" for s, ok in zip(o, plain)] for o in (a, b))
    for block in _blocks(x, y, [r for r, ok in enumerate(plain) if ok], True):
        for to, got in zip(out, _traced([x[r] for r in block], [y[r] for r in block], rule)):
            for r, v in zip(block, got):
                to[r] = v
    for r in (r for r, ok in enumerate(plain) if not ok and a[r] and b[r]):
        for to, v in zip(out, local_alignment(a[r], b[r], rule)):
            to[r] = v
    return out


def best_ways(a: list[str | None], b: list[str | None], rule: str = "default") -> tuple[list[int], list[int], list[str]]:
    """For each pair the best of b as it is, reverse complement, reverse and complement, its score, and b turned that way; of equals the first."""
    a, b = ([(s or "").upper() for s in x] for x in (a, b))
    turn = str.maketrans("ACGT", "TGCA")
    texts = (lambda s: s, lambda s: s.translate(turn)[::-1], lambda s: s[::-1], lambda s: s.translate(turn))
    best, score = [0] * len(a), [0] * len(a)
    plain = [bool(x) and bool(y) and x.isascii() and y.isascii() and "\0" not in x + y for x, y in zip(a, b)]
    x, y = ([s.encode() if ok else b"" for s, ok in zip(o, plain)] for o in (a, b))
    for block in _blocks(x, y, [r for r, ok in enumerate(plain) if ok], False):
        p, _ = _packed([x[r] for r in block], _PAD)
        every = np.array([_scored(p, _packed([turned(y[r]) for r in block], _PAD | 1)[0], rule, False) for turned in _WAYS])
        for r, way, top in zip(block, every.argmax(0).tolist(), every.max(0).tolist()):
            best[r], score[r] = way, top
    for r in (r for r, ok in enumerate(plain) if not ok and a[r] and b[r]):
        tops = [local_alignment(a[r], t(b[r]), rule)[0] for t in texts]
        best[r], score[r] = tops.index(max(tops)), max(tops)
    return best, score, [texts[way](s) for way, s in zip(best, b)]


_FIELDS = [f.split()[0] for f in ALIGNED.split(", ")]


def _over_pairs(rows: DataFrame, made: Callable[[list, list], tuple[list, list, list]], schema: str) -> DataFrame:
    """The columns after the first two, and those that are made of the first two."""
    kept = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema.fields[2:])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols, kinds, names = made(batch.column(0).to_pylist(), batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns[2:], *[pa.array(c, t) for c, t in zip(cols, kinds)]], names=[*batch.schema.names[2:], *names])

    return rows.mapInArrow(run, kept + schema)


def align(pairs: DataFrame, a: str, b: str, *carry: str, rule: str = "default") -> DataFrame:
    """``(*carry, fields of the alignment)`` for each row; a null sequence aligns like an empty one."""
    rows = pairs.select(F.col(a).alias("_a"), F.col(b).alias("_b"), *carry)
    return _over_pairs(rows, lambda x, y: (alignments(x, y, rule), _KINDS, _FIELDS), ALIGNED)


def identity() -> Column:
    """Matches by length of the alignment."""
    return F.when(F.length("a_aligned") > 0, F.col("matches") / F.length("a_aligned")).otherwise(0.0)


def align_best_of_four(pairs: DataFrame, a: str, b: str, *keys: str, rule: str = "default", traced: bool = True) -> DataFrame:
    """The best of b as it is, reverse complement, reverse and complement, by score; of equals the first. ``keys`` identify a pair.

    Only scores are made of all four, the alignment of the best one; without ``traced`` just ``way`` and ``score`` are returned.
    """
    rows = pairs.select(F.col(a).alias("_a"), F.col(b).alias("_b"), *keys)

    def made(x: list, y: list) -> tuple[list, list, list]:
        ways, scores, turned = best_ways(x, y, rule)
        if not traced:
            return [ways, scores], [pa.int32()] * 2, ["way", "score"]
        return [ways, *alignments(x, turned, rule)], [pa.int32(), *_KINDS], ["way", *_FIELDS]

    return _over_pairs(rows, made, f"way int, {ALIGNED}" if traced else "way int, score int")


def numt_score(length_a: Column, least_identity: float, window: float) -> Column:
    """Identity, or 0 where it is below the threshold or the alignment's length not within ``window`` of a's."""
    n = F.length("a_aligned")
    return F.when((n >= length_a * (1 - window)) & (n <= length_a * (1 + window)) & (identity() >= least_identity), identity()).otherwise(0.0)


def chimera_score(length_a: Column, least: float, most: float) -> Column:
    """Longest exact run by a's length, or 0 out of bounds."""
    part = F.col("longest") / length_a
    return F.when((F.col("longest") >= length_a * least) & (F.col("longest") <= length_a * most), part).otherwise(0.0)


# -- consensus -------------------------------------------------------------------------------------------------------


_BASES = 1 << 21  # more than there are code points


def _voting(batches: Iterator[pa.RecordBatch], least_quality: int) -> Iterator[pa.RecordBatch]:
    """``(ref_id, pos, v)`` of the columns of alignments; v is the negative quality times ``_BASES`` and the read's base."""
    points = lambda column: np.frombuffer("".join(column.to_pylist()).encode("utf-32-le"), np.uint32)
    for batch in batches:
        x, y = points(batch.column(1)), points(batch.column(2))
        n = pc.utf8_length(batch.column(1)).to_numpy()
        row, first = np.repeat(np.arange(len(n)), n), np.repeat(np.cumsum(n) - n, n)

        def place(symbols: np.ndarray, start: np.ndarray) -> np.ndarray:
            seen = np.r_[0, np.cumsum(symbols != 45)]
            return start[row] + seen[1:] - seen[first] - 1

        pos, at = place(x, batch.column(3).to_numpy()), place(y, batch.column(4).to_numpy())
        size = pc.fill_null(pc.list_value_length(batch.column(5)), 0).to_numpy()
        flat = np.r_[pc.fill_null(batch.column(5).flatten(), 0).to_numpy(), 0]
        has = (at >= 0) & (at < size[row])
        q = np.where(has, flat[np.where(has, (np.cumsum(size) - size)[row] + at, len(flat) - 1)], 0).astype(np.int64)
        use = (x != 45) & (y != 45) & (y != ord("N")) & (q > least_quality)
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row[use])), pa.array(pos[use].astype(np.int32)), pa.array(-q[use] * _BASES + y[use])], names=["ref_id", "pos", "v"])


def consensus(references: DataFrame, alignments: DataFrame, least_quality: int, least_score: int, window: int = 0) -> DataFrame:
    """``(ref_id, pos, ref, base, quality)``: by position the read base of the highest quality, else the reference's in lower case.

    ``references`` is ``(ref_id, seq)``, ``alignments`` the alignment of reference (a) and read (b) with ``ref_id`` and the
    read's ``qual``. Only alignments above ``least_score``, and bases other than N and gaps above ``least_quality``, count;
    of equal qualities the smaller base. With a ``window``, a position gets its reference base in lower case if the lowest
    quality from half a window before it to half a window after it, exclusive, is below ``least_quality``.
    """
    rows = alignments.filter(F.col("score") > least_score).select("ref_id", "a_aligned", "b_aligned", "start_a", "start_b", F.col("qual").cast("array<int>").alias("qual"))
    kind = references.schema["ref_id"].dataType.simpleString()
    # A vote is one number, so that it is folded by hash: the higher quality first, then the smaller base.
    votes = rows.mapInArrow(lambda batches: _voting(batches, least_quality), f"ref_id {rows.schema['ref_id'].dataType.simpleString()}, pos int, v bigint").withColumn("ref_id", F.col("ref_id").cast(kind))
    top = votes.groupBy("ref_id", "pos").agg(F.min("v").alias("v"))
    base = F.decode(F.unhex(F.lpad(F.hex(F.pmod("v", F.lit(_BASES))), 8, "0")), "UTF-32")
    top = top.select("ref_id", "pos", (-F.floor(F.col("v") / _BASES)).cast("int").alias("quality"), base.alias("vote"))
    every = references.select("ref_id", F.posexplode(S.letters(F.col("seq"))).alias("pos", "ref"))
    out = every.join(top, ["ref_id", "pos"], "left").select("ref_id", "pos", "ref", F.coalesce("vote", F.lower("ref")).alias("base"), F.coalesce("quality", F.lit(0)).alias("quality"))
    if window < 2:
        return out
    near = Window.partitionBy("ref_id").orderBy("pos").rowsBetween(-(window // 2), window // 2 - 1)  # as many rows as the reference has bases
    low = F.min(F.when(F.col("pos") > 0, F.col("quality"))).over(near)
    return out.withColumn("low", low).withColumn("base", F.when(F.coalesce("low", F.lit(100)) < least_quality, F.lower("ref")).otherwise(F.col("base"))).drop("low")


def consensus_sequences(voted: DataFrame) -> DataFrame:
    """``(ref_id, seq, correct)`` with the number of upper-case, i.e. voted bases. A row is as long as its reference."""
    seq = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "base"))), lambda x: x["base"]), "")
    return voted.groupBy("ref_id").agg(seq.alias("seq")).withColumn("correct", F.length("seq") - F.length(F.regexp_replace("seq", "[A-Z]", "")))


def variants(references: DataFrame, sequences: DataFrame, least_correct: int) -> DataFrame:
    """``(ref_id, kind, from, position, to)``: changed bases, and by codon whether the amino acid changes; positions from 1."""
    both = references.select("ref_id", F.col("seq").alias("r")).join(sequences.filter(F.col("correct") > least_correct).select("ref_id", F.col("seq").alias("c")), "ref_id")
    each = F.transform(S.letters(F.upper("r")), lambda f, i: F.struct(i.alias("i"), f.alias("f"), F.substring(F.upper("c"), i + 1, F.lit(1)).alias("t")))
    changed = both.select("ref_id", F.explode(F.filter(each, lambda x: x["f"] != x["t"])).alias("x"), S.translate_codons(F.col("r")).alias("rp"), S.translate_codons(F.col("c")).alias("cp"))
    hit = changed.select("ref_id", "x.i", "x.f", "x.t", "rp", "cp")
    codon = F.floor(F.col("i") / 3).cast("int") + 1
    amino = lambda p: F.substring(F.col(p), codon, F.lit(1))
    syn = hit.filter(codon <= F.length("rp")).select("ref_id", F.when(amino("rp") == amino("cp"), "SYN").otherwise("NO_SYN").alias("kind"), amino("rp").alias("from"), codon.alias("position"), amino("cp").alias("to"))
    return hit.select("ref_id", F.lit("BASE").alias("kind"), F.col("f").alias("from"), (F.col("i") + 1).alias("position"), F.col("t").alias("to")).unionByName(syn)


def joined(references: DataFrame, reads: DataFrame, least_quality: int = 10, least_score: int = 40, window: int = 0, percent: float = 50.0) -> DataFrame:
    """``(ref_id, seq, correct, peptide)``: the reads of each reference, mates as a rule, joined over it.

    ``reads`` is ``(ref_id, read_id, seq, qual)``. Each is aligned in the best of its four orientations, its qualities turned with it, and votes in the
    consensus; a sequence stays if more than ``percent`` per cent of its bases were voted. References without a read that aligns have no vote.
    """
    refs = references.select("ref_id", F.upper("seq").alias("ref_seq"))
    pairs = refs.join(reads.select("ref_id", "read_id", "seq", "qual"), "ref_id")
    best = align_best_of_four(pairs, "ref_seq", "seq", "ref_id", "read_id")
    turned = best.join(reads.select("ref_id", "read_id", "qual"), ["ref_id", "read_id"]).withColumn("qual", F.when(F.col("way").isin(1, 2), F.reverse("qual")).otherwise(F.col("qual")))
    found = consensus_sequences(consensus(refs.withColumnRenamed("ref_seq", "seq"), turned, least_quality, least_score, window))
    return found.filter(F.col("correct") * 100 > F.length("seq") * percent).select("ref_id", "seq", "correct", S.translate_codons(F.col("seq")).alias("peptide"))


def without_n(found: DataFrame, *columns: str) -> DataFrame:
    """Variants none of whose sequences has an N, in either case; a null sequence has none."""
    for c in columns:
        found = found.filter(~F.coalesce(F.contains(F.upper(c), F.lit("N")), F.lit(False)))
    return found


def variant_filters(found: DataFrame, left: int = 25, right: int = 3, mapping_quality: int = 30, coverage: float = 2.0) -> DataFrame:
    """Add ``passes``: flanks of at least ``left`` and ``right`` bases, the mapping quality, and for each allele the median of its coverages, all together.

    ``found`` has ``flank_5``, ``flank_3``, ``mapq`` and ``allele_coverages``, one array an allele; anything missing fails.
    """
    middle = lambda a: F.when(F.size(a) % 2 == 1, F.get(F.sort_array(a), F.floor(F.size(a) / 2).cast("int")).cast("double")).otherwise((F.get(F.sort_array(a), (F.size(a) / 2).cast("int") - 1) + F.get(F.sort_array(a), (F.size(a) / 2).cast("int"))) / 2)
    deep = F.forall("allele_coverages", lambda a: F.coalesce(middle(a) >= coverage, F.lit(False))) & (F.size("allele_coverages") > 0)
    every = (F.length("flank_5") >= left) & (F.length("flank_3") >= right) & (F.col("mapq") >= mapping_quality) & deep
    return found.withColumn("passes", F.coalesce(every, F.lit(False)))


# -- masks and repairs -----------------------------------------------------------------------------------------------


def mask_primers(sequences: DataFrame, primers: dict[str, str], least_score: int) -> DataFrame:
    """``(id, seq)`` with N over every primer that aligns above the score at an end, and over all beyond it. Few primers, given as literals."""
    scored, starts, ends = (_FIELDS.index(f) for f in ("score", "start_a", "end_a"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seqs = batch.column(1).to_pylist()
            left, right = [0] * len(seqs), [len(s or "") for s in seqs]
            for primer in primers.values():
                got, m = alignments(seqs, [primer] * len(seqs)), len(primer)
                for r, (score, start, end) in enumerate(zip(got[scored], got[starts], got[ends])):
                    if score > least_score and seqs[r] is not None:
                        right[r] = min(right[r], start) if start >= len(seqs[r]) - m else right[r]
                        left[r] = max(left[r], end) if end <= m + 1 else left[r]
            masked = [s if s is None else "N" * l + s[l:r] + "N" * (len(s) - r) if r > l else "N" * len(s) for s, l, r in zip(seqs, left, right)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(masked, pa.string())], names=["id", "seq"])

    return sequences.select("id", "seq").mapInArrow(run, f"id {sequences.schema['id'].dataType.simpleString()}, seq string")


def mask_match(sequence: str, mask: str, search_window: int = 10, max_mismatches: int = 1) -> tuple[int, int, int]:
    """Matches, mismatches and the last position of a run that is longer than the window, of a sequence under an IUPAC mask with N as wildcard."""
    fits = {**S.IUPAC, **{c: "".join(x for x in "ACGT" if x != out) for c, out in S.IUPAC_NOT.items()}}
    matches = mismatches = longest = run = bad = 0
    for i, (s, m) in enumerate(zip(sequence.upper().ljust(len(mask), "-"), mask.upper())):
        if m == "N":
            run += 1
        elif s == m or s in fits.get(m, ""):
            matches, run, bad = matches + 1, run + 1, 0
        else:
            mismatches, bad = mismatches + 1, bad + 1
            run = 0 if bad > max_mismatches else run
            continue
        longest = i if run > search_window else longest
    return matches, mismatches, longest


def repair(sequence: str, mask: str, most_shift: int = 3, most_mismatches: int = 1, look: int = 12) -> tuple[str, int]:
    """Repair homopolymers and small insertions and deletions against a mask; the repaired sequence and the number of fixes.

    A gap takes the base of the longer run beside it, in lower case, if the mask allows it. From left to right, where more
    than ``most_mismatches`` of the next ``look`` symbols don't fit, the sequence is shifted by up to ``most_shift`` bases: left, dropping
    surplus bases, or right, putting gaps in, by the smallest shift that makes them fit.
    """
    fits = {**{b: b for b in "ACGT"}, **S.IUPAC, **{c: "".join(x for x in "ACGT" if x != out) for c, out in S.IUPAC_NOT.items()}, "N": "ACGTN-"}
    good = lambda s, m: s.upper() in fits.get(m, "") or s == "-"
    seq, mask, fixes = list(sequence), mask.upper(), 0

    def bad(shifted: list[str], at: int) -> int:
        return sum(not good(s, m) for s, m in zip(shifted[at : at + look], mask[at : at + look]))

    at = 0
    while at < min(len(seq), len(mask)):
        if not good(seq[at], mask[at]) and (now := bad(seq, at)) > most_mismatches:
            tries = [t for n in range(1, most_shift + 1) for t in (seq[:at] + seq[at + n :], seq[:at] + ["-"] * n + seq[at:])]
            best = min(tries, key=lambda t: bad(t, at))
            if bad(best, at) <= most_mismatches and bad(best, at) < now:
                seq, fixes = best, fixes + 1
        at += 1
    for i, s in enumerate(seq):
        if s == "-" and i < len(mask):
            runs = []
            for step in (-1, 1):
                j = i + step
                while 0 <= j < len(seq) and seq[j] == "-":
                    j += step
                base, n = (seq[j].upper(), 0) if 0 <= j < len(seq) else ("", 0)
                while 0 <= j < len(seq) and seq[j].upper() == base:
                    j, n = j + step, n + 1
                runs.append((n, base))
            n, base = max(runs)
            if base and base in fits.get(mask[i], "") and n > 1:
                seq[i], fixes = base.lower(), fixes + 1
    return "".join(seq), fixes


def repair_under_mask(sequences: DataFrame, mask: str) -> DataFrame:
    """``(id, seq, matches, mismatches, gaps, fixes, score)``: repaired, and scored matches less mismatches, twice the gaps and the fixes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for s in b.column(1).to_pylist():
                fixed, fixes = repair(s or "", mask)
                matches, mismatches, _ = mask_match(fixed, mask)
                gaps = fixed.count("-")
                rows.append((fixed, matches, mismatches, gaps, fixes, matches - mismatches - 2 * gaps - fixes))
            cols = [pa.array([r[i] for r in rows], pa.string() if i == 0 else pa.int32()) for i in range(6)]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], names=["id", "seq", "matches", "mismatches", "gaps", "fixes", "score"])

    kind = sequences.schema["id"].dataType.simpleString()
    return sequences.select("id", "seq").mapInArrow(run, f"id {kind}, seq string, matches int, mismatches int, gaps int, fixes int, score int")


# -- reads and references --------------------------------------------------------------------------------------------


#: Reads of one task's group, references of a posting list and columns of a block of counts, at most or about.
GROUP, POSTINGS, BLOCK = 256, 10_000, 1_024


def _best_of_group(reads: list[np.ndarray], refs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Reads, and for each the other reference of the most k-mers and their number. Row i of the lists is one k-mer: who of the reads, who of the references hold it."""
    read_ids, at = np.unique(np.concatenate(reads), return_inverse=True)
    ref_ids, to = np.unique(np.concatenate(refs), return_inverse=True)
    rows = np.repeat(np.arange(len(refs)), [len(x) for x in refs])
    held = np.zeros((len(read_ids), len(reads)), np.float32)
    held[at, np.repeat(np.arange(len(reads)), [len(x) for x in reads])] = 1
    best, most = np.zeros(len(read_ids), np.int64), np.zeros(len(read_ids), np.int64)
    for c in range(0, len(ref_ids), BLOCK):
        ids, here = ref_ids[c : c + BLOCK], (to >= c) & (to < c + BLOCK)
        has = np.zeros((len(refs), len(ids)), np.float32)
        has[rows[here], to[here] - c] = 1
        shared = held @ has
        shared[read_ids[:, None] == ids[None, :]] = 0
        first = shared.argmax(1)  # of equal ones the smallest id
        top = shared[np.arange(len(read_ids)), first].astype(np.int64)
        better = top > most
        best[better], most[better] = ids[first[better]], top[better]
    return read_ids[most > 0], best[most > 0], most[most > 0]


def _counting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``(group, reads, refs)`` sorted by group, to one row a read."""

    def made(reads: list[np.ndarray], refs: list[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in _best_of_group(reads, refs)], names=["read_id", "ref_id", "shared"])

    last, reads, refs = None, [], []
    for b in batches:
        lists = [(c.values.to_numpy(), c.offsets.to_numpy()) for c in b.columns[1:]]
        for i, group in enumerate(b.column(0).to_pylist()):
            if group != last and reads:
                yield made(reads, refs)
                reads, refs = [], []
            last = group
            for into, (values, ends) in zip((reads, refs), lists):
                into.append(values[ends[i] : ends[i + 1]])
    if reads:
        yield made(reads, refs)


def best_reference(reads: DataFrame, references: DataFrame, k: int) -> DataFrame:
    """``(read_id, ref_id, shared)``: for each read the other reference that shares the most k-mers with it, of equal ones the smallest ref_id.

    Distinct k-mers count, and all references of a k-mer. Pairs are counted, but never become rows: reads that have their smallest
    hash in common overlap and form groups, and a group gets the posting list of each of its k-mers once. Large groups and
    long lists are split. The counting grows with the pairs that share a k-mer, the shuffles with the lists by groups.
    """
    own = occurrences(references.select(F.col("ref_id").alias("read_id"), "seq"), k, "read_id").select(F.col("read_id").cast("bigint").alias("ref_id"), "kmer").distinct()
    mine = materialise(occurrences(reads, k, "read_id").select(F.col("read_id").cast("bigint").alias("read_id"), "kmer").distinct(), "mine")
    sizes = own.groupBy("kmer").agg(F.count("*").alias("n")).filter(F.col("n") > POSTINGS)
    part = F.coalesce(F.pmod(F.xxhash64("ref_id"), F.ceil(F.col("n") / POSTINGS)), F.lit(0))
    lists = own.join(sizes, "kmer", "left").groupBy("kmer", part.alias("part")).agg(F.collect_list("ref_id").alias("refs")).drop("part")
    near = mine.groupBy("read_id").agg(F.min(F.xxhash64("kmer")).alias("h"))
    many = near.groupBy("h").agg(F.count("*").alias("n")).filter(F.col("n") > GROUP)
    salt = F.coalesce(F.pmod(F.xxhash64("read_id"), F.ceil(F.col("n") / GROUP)), F.lit(0))
    groups = near.join(many, "h", "left").select("read_id", F.struct("h", salt.alias("salt")).alias("g"))
    held = mine.join(groups, "read_id").groupBy("g", "kmer").agg(F.collect_list("read_id").alias("reads"))
    alone = (F.size("reads") == 1) & (F.size("refs") == 1) & (F.get("reads", F.lit(0)) == F.get("refs", F.lit(0)))
    rows = held.join(lists, "kmer").filter(~alone).select(F.concat_ws(":", "g.h", "g.salt").alias("g"), "reads", "refs")
    return rows.repartition("g").sortWithinPartitions("g").mapInArrow(_counting, "read_id bigint, ref_id bigint, shared bigint")


ALIGN_K = 15


def _references(s: SparkSession, d: str) -> DataFrame:
    """Reads are each other's references."""
    return fastq_reads(s, d).select(F.col("read_id").alias("ref_id"), F.upper("seq").alias("seq"))


def _placed(s: SparkSession, d: str) -> DataFrame:
    reads, refs = fastq_reads(s, d), _references(s, d)
    at = best_reference(reads, refs, ALIGN_K)
    pairs = at.join(refs.select("ref_id", F.col("seq").alias("ref_seq")), "ref_id").join(reads.select("read_id", "seq", "qual"), "read_id")
    return materialise(pairs.select("read_id", "ref_id", "ref_seq", "seq", "qual"), "placed")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "local_alignment": lambda s, d: align(_placed(s, d), "ref_seq", "seq", "read_id", "ref_id").withColumn("identity", identity()),
    "best_orientation": lambda s, d: align_best_of_four(_placed(s, d), "ref_seq", "seq", "read_id", "ref_id", traced=False),
    "alignment_scores": lambda s, d: align(_placed(s, d), "ref_seq", "seq", "read_id", "ref_seq").select("read_id", numt_score(F.length("ref_seq"), 0.8, 0.1).alias("numt"), chimera_score(F.length("ref_seq"), 0.3, 0.8).alias("chimera")),
    "quality_consensus": lambda s, d: (lambda placed: consensus_sequences(consensus(_references(s, d).join(placed.select("ref_id"), "ref_id", "left_semi"), align(placed, "ref_seq", "seq", "ref_id", "qual"), 10, 40, 4)))(_placed(s, d)),
    "variants": lambda s, d: (lambda refs, placed: (lambda voted: variants(voted, consensus_sequences(consensus(voted, align(placed, "ref_seq", "seq", "ref_id", "qual"), 10, 40)), 20))(refs.join(placed.select("ref_id"), "ref_id", "left_semi")))(_references(s, d), _placed(s, d)),  # without a read a reference has no voted base
    "primer_masking": lambda s, d: mask_primers(fastq_reads(s, d).select(F.col("read_id").alias("id"), "seq"), {"left": "ACGTACGT", "right": "TTGACCGA"}, 8),
    "mask_repair": lambda s, d: repair_under_mask(fastq_reads(s, d).select(F.col("read_id").alias("id"), "seq"), "NNRYWSACGTNNNN"),
}
SQL: dict[str, str] = {}
