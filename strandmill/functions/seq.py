"""Column builders on sequences, qualities, names and edge bytes."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The standard genetic code in the order TCAG, and which bases an IUPAC code stands for.
CODE_ORDER = "TCAG"
AMINO_ACIDS = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
IUPAC = {"R": "GA", "Y": "TC", "K": "GT", "M": "AC", "S": "GC", "W": "AT"}
IUPAC_NOT = {"B": "A", "D": "C", "H": "G", "V": "T"}
CASAVA = r"^([^:\s]+):(\d+):([^:\s]+):(\d+):(\d+):(\d+):(\d+) (\d+):([YN]):(\d+):([ACGTN]*)$"
CASAVA_FIELDS = {"instrument": "string", "run": "int", "flowcell": "string", "lane": "int", "tile": "int", "x": "int", "y": "int", "read": "int", "filtered": "string", "control": "int", "index": "string"}


def letters(seq: Column) -> Column:
    """Array of the characters; empty for an empty or null string."""
    return F.when(F.length(seq) > 0, F.split(seq, "")).otherwise(F.array().cast("array<string>"))


def complement(seq: Column) -> Column:
    return F.translate(seq, "ACGTacgt", "TGCAtgca")


def reverse_complement_read(seq: Column, qual: Column) -> Column:
    """Struct of the reverse complement, case kept, and the reversed qualities."""
    return F.struct(F.reverse(complement(seq)).alias("seq"), F.reverse(qual).alias("qual"))


def mask_range(seq: Column, start: int, end: int) -> Column:
    """N on the positions [start, end), from 0; positions beyond the end are none."""
    n = F.greatest(F.least(F.lit(end), F.length(seq)) - start, F.lit(0))
    return F.concat(F.substring(seq, F.lit(1), F.lit(start)), F.repeat(F.lit("N"), n), F.substring(seq, F.lit(start + 1) + n, F.length(seq)))


def remove_base(seq: Column, pos: int) -> Column:
    return F.overlay(seq, F.lit(""), F.lit(pos + 1), F.lit(1))


def insert_base(seq: Column, pos: int, base: str) -> Column:
    return F.overlay(seq, F.lit(base), F.lit(pos + 1), F.lit(0))


def trim_to(seq: Column, n: int) -> Column:
    return F.substring(seq, 1, n)


def drop_trailing_gaps(seq: Column) -> Column:
    return F.rtrim(seq, F.lit("-"))


def count_gaps(seq: Column) -> Column:
    return F.length(seq) - F.length(F.replace(seq, F.lit("-"), F.lit("")))


def run_length(seq: Column, pos: int) -> Column:
    """Length of the homopolymer that starts at ``pos``."""
    return F.length(F.regexp_extract(F.substring(seq, F.lit(pos + 1), F.length(seq)), r"^((.)\2*)", 1))


def longest_homopolymer(seq: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(F.regexp_extract_all(seq, F.lit(r"((.)\2*)"), 1), lambda r: F.length(r))), F.lit(0))


def next_homopolymer(seq: Column, pos: int) -> Column:
    """First position from ``pos`` on with the same base next to it, or -1."""
    rest = F.substring(seq, F.lit(pos + 1), F.length(seq))
    return F.when(F.regexp_like(rest, F.lit(r"(.)\1")), F.length(F.regexp_extract(rest, r"^(.*?)(.)\2", 1)) + pos).otherwise(-1)


def quality_mask(seq: Column, qual: Column, threshold: int) -> Column:
    """N where the quality is below the threshold; bases without a quality stay."""
    kept = F.transform(letters(seq), lambda c, i: F.when(F.get(qual, i) < threshold, F.lit("N")).otherwise(c))
    return F.when(qual.isNull(), seq).otherwise(F.array_join(kept, ""))


def _code(base: Column) -> Column:
    return F.when(base == "A", 0).when(base == "C", 1).when(base == "G", 2).when(base == "T", 3).otherwise(-1)


def to_colours(seq: Column) -> Column:
    """Colour space with the leading T: 0 same, 1 transversion, 2 transition, 3 complement, ``.`` next to a base other than ACGT."""
    with_t = letters(F.concat(F.lit("T"), F.upper(seq)))
    codes = F.transform(with_t, _code)
    pairs = F.zip_with(F.slice(codes, 1, F.length(seq)), F.slice(codes, 2, F.length(seq)), lambda a, b: F.when((a < 0) | (b < 0), F.lit(".")).otherwise(a.bitwiseXOR(b).cast("string")))
    return F.when(F.length(seq) > 0, F.concat(F.lit("T"), F.array_join(pairs, ""))).otherwise(F.lit("T"))


def from_colours(colours: Column) -> Column:
    """Bases of a colour sequence, without its first base. After an unknown colour every base is N."""
    number = lambda c: F.when(c == "0", 0).when(c == "1", 1).when(c == "2", 2).when(c == "3", 3).otherwise(-1)
    turn = lambda at, c: F.when((at < 0) | (number(c) < 0), F.lit(-1)).otherwise(at.bitwiseXOR(number(c)))
    letter = lambda at: F.when(at < 0, F.lit("N")).otherwise(F.substring(F.lit("ACGT"), at + 1, F.lit(1)))
    step = lambda acc, c: F.struct(turn(acc["at"], c).alias("at"), F.concat(acc["out"], letter(turn(acc["at"], c))).alias("out"))
    start = F.struct(_code(F.substring(F.upper(colours), 1, 1)).alias("at"), F.lit("").alias("out"))
    return F.aggregate(F.slice(letters(colours), 2, F.greatest(F.length(colours), F.lit(1))), start, step)["out"]


def translate_codons(seq: Column, offset: int = 0) -> Column:
    """Peptide from ``offset`` on, ``*`` for a stop, ``X`` for a codon with another symbol than ACGT; U is T."""
    digits = F.translate(F.substring(F.upper(seq), F.lit(offset + 1), F.length(seq)), "TUCAG0123", "00123XXXX")
    amino = lambda c: F.when(F.translate(c, "0123", "") == "", F.substring(F.lit(AMINO_ACIDS), F.conv(c, 4, 10).cast("int") + 1, F.lit(1))).otherwise(F.lit("X"))
    return F.array_join(F.transform(F.regexp_extract_all(digits, F.lit("(?s)(...)"), 1), amino), "")


def differences(a: Column, b: Column) -> Column:
    """Positions at which two strings differ, up to the shorter one's end."""
    n = F.least(F.length(a), F.length(b))
    cut = lambda s: F.slice(letters(s), 1, n)
    return F.aggregate(F.zip_with(cut(a), cut(b), lambda x, y: (x != y).cast("int")), F.lit(0), lambda t, d: t + d)


def base_fits(base: Column, code: Column) -> Column:
    """Whether an IUPAC code stands for a base; U counts as T, a symbol always fits itself."""
    base, code = F.upper(base), F.upper(code)
    b = F.when(base == "U", F.lit("T")).otherwise(base)
    fits = (base == code) | (code == "N")
    for c, of in IUPAC.items():
        fits = fits | ((code == c) & b.isin(*of))
    for c, out in IUPAC_NOT.items():
        fits = fits | ((code == c) & (b != out))
    return fits


def mask_differences(seq: Column, mask: Column) -> Column:
    """Positions whose base doesn't fit the mask's code, up to the shorter one's end."""
    n = F.least(F.length(seq), F.length(mask))
    cut = lambda s: F.slice(letters(s), 1, n)
    return F.aggregate(F.zip_with(cut(seq), cut(mask), lambda x, y: (~base_fits(x, y)).cast("int")), F.lit(0), lambda t, d: t + d)


def compare_with_ambiguity(a: Column, b: Column) -> Column:
    """Order of two sequences as a number: second less first symbol at the first position that tells them apart, else of the lengths.

    A position tells apart two plain bases that differ, or a plain base and a code that the first doesn't fit into.
    """
    n = F.least(F.length(a), F.length(b))
    cut = lambda s: F.slice(letters(s), 1, n)
    plain = lambda x: x.isin("A", "C", "G", "T", "U")
    differ = lambda x, y: F.when(plain(x) & plain(y), F.ascii(y) - F.ascii(x)).when(plain(x) | plain(y), F.when(base_fits(x, y), F.lit(0)).otherwise(F.ascii(y) - F.ascii(x))).otherwise(0)
    return F.coalesce(F.get(F.filter(F.zip_with(cut(a), cut(b), differ), lambda d: d != 0), F.lit(0)), F.length(b) - F.length(a))


def merge_ambiguity(a: Column, b: Column) -> Column:
    """Of two sequences of one length the plain base wherever either has one, else the first one's code; null for unequal lengths."""
    plain = lambda x: x.isin("A", "C", "G", "T", "U")
    both = F.zip_with(letters(a), letters(b), lambda x, y: F.when(~plain(x) & plain(y), y).otherwise(x))
    return F.when(F.length(a) == F.length(b), F.array_join(both, ""))


def casava(name: Column) -> Column:
    """Struct of an Illumina 1.8 header, null where the name isn't one."""
    fields = [F.regexp_extract(name, CASAVA, i + 1).cast(t).alias(f) for i, (f, t) in enumerate(CASAVA_FIELDS.items())]
    return F.when(F.regexp_like(name, F.lit(CASAVA)), F.struct(*fields))


# -- packed k-mers and edge bytes ------------------------------------------------------------------------------------


def append_base(code: Column, base: int, k: int) -> Column:
    """Shift a packed k-mer left by one base and put ``base`` (0 to 3) at its right end."""
    return (F.shiftleft(code, 2).bitwiseOR(F.lit(base).cast("bigint"))).bitwiseAND(F.lit((1 << (2 * k)) - 1))


def prepend_base(code: Column, base: int, k: int) -> Column:
    return F.shiftright(code, 2).bitwiseOR(F.lit(base << (2 * (k - 1))).cast("bigint"))


def base_at(code: Column, pos: int, k: int) -> Column:
    """Base 0 to 3 at a position, from 0 at the left end."""
    return F.shiftright(code, 2 * (k - 1 - pos)).bitwiseAND(F.lit(3).cast("bigint")).cast("int")


def edge_bit(base: Column, reverse: Column) -> Column:
    """Bit of an edge in the edge byte: the low four for the forward, the high four for the reverse orientation."""
    b = F.when(base == "A", 1).when(base == "C", 2).when(base == "G", 4).when(base == "T", 8)
    return F.when(reverse, b * 16).otherwise(b)


def edge_count(edges: Column, reverse: bool) -> Column:
    return F.bit_count(F.shiftright(edges, 4 if reverse else 0).bitwiseAND(F.lit(15))).cast("int")


def is_blunt(edges: Column) -> Column:
    """No edge on at least one side."""
    return (edge_count(edges, False) == 0) | (edge_count(edges, True) == 0)


def common_bits(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseAND(b))
