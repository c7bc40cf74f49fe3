"""Column builders for k-mers. Everything stays inside generated code; nothing here is a UDF."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def reverse_complement(seq: Column) -> Column:
    """Reverse complement in upper case; symbols other than ACGT stay as they are."""
    return F.reverse(F.translate(F.upper(seq), "ACGT", "TGCA"))


def canonical(kmer: Column) -> Column:
    """The smaller (A<C<G<T) of a k-mer and its reverse complement. Expects upper case."""
    return F.least(kmer, F.reverse(F.translate(kmer, "ACGT", "TGCA")))


def is_acgt(seq: Column) -> Column:
    """True for a string that holds nothing but upper-case ACGT; an empty string passes."""
    return F.translate(seq, "ACGT", "") == ""


def valid_kmer(raw: Column, k: int) -> Column:
    """Trimmed, upper-cased canonical k-mer, or null where the text isn't exactly ``k`` letters of ACGT."""
    x = F.upper(F.trim(raw))
    return F.when((F.length(x) == k) & is_acgt(x), canonical(x))


def pack(kmer: Column) -> Column:
    """Two bits a base in a BIGINT, order-preserving; for k up to 31. The input must be ACGT only."""
    return F.conv(F.translate(kmer, "ACGT", "0123"), 4, 10).cast("bigint")


def unpack(code: Column, k: int) -> Column:
    """The k-mer of a packed BIGINT."""
    return F.translate(F.lpad(F.conv(code.cast("string"), 10, 4), k, "0"), "0123", "ACGT")


def mask(seq: Column, qual: Column | None = None, cut: int = 0) -> Column:
    """Upper case with every bad base as ``N``: not ACGT or, where ``cut`` > 0, quality <= ``cut`` (the cutoff itself is bad).

    A quality array shorter than the sequence, or a null one, leaves the bases it doesn't cover unmasked.
    """
    clean = F.regexp_replace(F.upper(seq), "[^ACGT]", "N")
    if qual is None or cut <= 0:
        return clean
    kept = F.transform(F.split(clean, ""), lambda c, i: F.when(F.get(qual, i) <= cut, F.lit("N")).otherwise(c))
    return F.when(F.length(clean) > 0, F.when(qual.isNull(), clean).otherwise(F.array_join(kept, ""))).otherwise(clean)


def break_homopolymers(masked: Column, cutoff: int) -> Column:
    """Put ``N`` where a run of one base reaches ``cutoff``: the run's first ``cutoff - 1`` bases stay, the rest becomes one ``N``."""
    if cutoff < 2:
        raise ValueError("cutoff must be at least 2")
    return F.regexp_replace(masked, r"(([ACGT])\2{%d})\2+" % (cutoff - 2), "$1N")


def starts(masked: Column, k: int) -> Column:
    """Array of the 1-based starts of all k-letter substrings; empty where the read is shorter than ``k``."""
    n = F.length(masked) - k + 1
    return F.when(n >= 1, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))


def window_lengths(masked: Column, k: int) -> Column:
    """Number of k-mers of each window (maximal good run of at least ``k`` bases), from left to right."""
    runs = F.filter(F.split(masked, "N+"), lambda r: F.length(r) >= k)
    return F.transform(runs, lambda r: F.length(r) - k + 1)
