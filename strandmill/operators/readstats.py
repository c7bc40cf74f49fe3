"""Statistics of reads, routing by name, quality or content, and sampling."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from strandmill.functions import seq as S
from strandmill.functions.kmer import reverse_complement
from strandmill.operators.kmers import FASTA_SQL, READS_SQL, densify, fasta_reads, fastq_reads

DRAW = 15


def base_composition(reads: DataFrame) -> DataFrame:
    """``(read_id, n_a, n_c, n_g, n_t, n_other, percent_a)``, without exploding the reads."""
    upper, size = F.upper("seq"), F.length("seq")
    n = {b: size - F.length(F.translate(upper, b, "")) for b in "ACGT"}
    other = size - n["A"] - n["C"] - n["G"] - n["T"]
    return reads.select("read_id", *[n[b].alias(f"n_{b.lower()}") for b in "ACGT"], other.alias("n_other"), F.when(size > 0, 100 * n["A"] / size).alias("percent_a"))


def content_split(reads: DataFrame, threshold: float) -> DataFrame:
    """``(read_id, part)``: ``less`` where less than ``threshold`` per cent of the bases are A, else ``more``. Both are percentages."""
    return base_composition(reads).select("read_id", F.when(F.coalesce("percent_a", F.lit(0.0)) < threshold, F.lit("less")).otherwise(F.lit("more")).alias("part"))


def positional_stats(reads: DataFrame) -> DataFrame:
    """``(kind, pos, id, n, percent, quality)``: counts of single bases (``nuc``) and of neighbours (``din``), by position and overall.

    Symbols other than ACGT are N. ``percent`` is of the kind at that position, or overall where ``pos`` is null;
    ``quality`` is the mean, over both bases of a pair, and null if no base of the group has one. One pass with grouping sets.
    """
    bases = F.regexp_replace(F.upper("seq"), "[^ACGT]", "N")
    rows = reads.select(F.posexplode(S.letters(bases)).alias("pos", "b"), F.col("qual"), bases.alias("s"))
    nxt = F.substring(F.col("s"), F.col("pos") + 2, F.lit(1))
    q, q2 = F.get("qual", F.col("pos")), F.get("qual", F.col("pos") + 1)
    each = F.array(F.struct(F.lit("nuc").alias("kind"), F.col("b").alias("id"), q.cast("double").alias("q")), F.struct(F.lit("din").alias("kind"), F.concat("b", nxt).alias("id"), ((q + q2) / 2).alias("q")))
    long = rows.select("pos", F.explode(F.filter(each, lambda e: (e["kind"] == "nuc") | (F.length(e["id"]) == 2))).alias("e")).select("pos", "e.kind", "e.id", "e.q")
    sets = long.groupingSets([[F.col("kind"), F.col("pos"), F.col("id")], [F.col("kind"), F.col("id")]], "kind", "pos", "id").agg(F.count("*").alias("n"), F.avg("q").alias("quality"))
    return sets.withColumn("percent", 100 * F.col("n") / F.sum("n").over(Window.partitionBy("kind", "pos"))).select("kind", "pos", "id", "n", "percent", "quality")


def length_histogram(reads: DataFrame, width: int) -> DataFrame:
    """``(length, n)`` by bins of ``width``, named by their lower end, with the empty ones in between."""
    bins = reads.filter("seq IS NOT NULL").groupBy(F.floor(F.length("seq") / width).alias("bin")).agg(F.count("*").alias("n"))
    return densify(bins, "bin", "n", 0).select((F.col("bin") * width).alias("length"), "n")


def n50(reads: DataFrame) -> DataFrame:
    """One row: the largest length such that sequences at least that long hold half of all bases. Sums by length first, so the window is over lengths only."""
    by = reads.filter(F.length("seq") > 0).groupBy(F.length("seq").alias("length")).agg(F.sum(F.length("seq")).alias("bases"))
    run = by.withColumn("longer", F.sum("bases").over(Window.orderBy(F.desc("length")))).withColumn("whole", F.sum("bases").over(Window.partitionBy()))
    return run.filter(F.col("longer") * 2 >= F.col("whole")).agg(F.max("length").alias("n50"))


def demultiplex(reads: DataFrame) -> DataFrame:
    """Add ``index`` from the Illumina header; null where the name has none. Written with ``partitionBy("index")`` it is one output an index."""
    return reads.withColumn("index", S.casava(F.col("name"))["index"])


def bernoulli(reads: DataFrame, probability: float, seed: int) -> DataFrame:
    """Each read with the given probability, by a hash of seed and read_id: the same reads whatever the partitioning."""
    draw = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("read_id").cast("string"))), 1, DRAW), 16, 10).cast("bigint")
    return reads.filter(draw < F.lit(int(probability * 16**DRAW)))


def collapse(reads: DataFrame, primer: int, least: int = 2) -> DataFrame:
    """``(seq, n)`` of the first ``primer`` bases, in upper case, that occur at least ``least`` times."""
    return reads.groupBy(S.trim_to(F.upper("seq"), primer).alias("seq")).agg(F.count("*").alias("n")).filter(F.col("n") >= least)


def collapse_with_mask(reads: DataFrame, mask: str, least: int = 2, mismatches: int = 1) -> DataFrame:
    """As ``collapse``, of the prefixes that fit an IUPAC mask with at most ``mismatches``."""
    return collapse(reads, len(mask), least).filter(S.mask_differences(F.col("seq"), F.lit(mask)) <= mismatches)


MASK, PRIMER = "NNRYWSACGT", 6
_Q = lambda make: lambda s, d: fastq_reads(s, d).select("read_id", *make())
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "base_composition": lambda s, d: base_composition(fasta_reads(s, d)),
    "content_split": lambda s, d: content_split(fastq_reads(s, d), 25.0),
    "positional_stats": lambda s, d: positional_stats(fastq_reads(s, d)),
    "length_histogram": lambda s, d: length_histogram(fasta_reads(s, d), 500),
    "n50": lambda s, d: n50(fasta_reads(s, d)),
    "casava_headers": lambda s, d: fastq_reads(s, d).select("read_id", S.casava(F.col("name")).alias("h")).filter("h IS NOT NULL").select("read_id", "h.*"),
    "demultiplex_counts": lambda s, d: demultiplex(fastq_reads(s, d)).groupBy("index").agg(F.count("*").alias("n")),
    "bernoulli_sample": lambda s, d: bernoulli(fastq_reads(s, d), 0.1, 42).select("read_id"),
    "collapse": lambda s, d: collapse(fastq_reads(s, d), PRIMER),
    "collapse_with_mask": lambda s, d: collapse_with_mask(fastq_reads(s, d), MASK[:PRIMER]),
    "reverse_complement": _Q(lambda: [reverse_complement(F.col("seq")).alias("rc")]),
    "reverse_complement_read": lambda s, d: fastq_reads(s, d).select("read_id", S.reverse_complement_read(F.col("seq"), F.col("qual")).alias("r")).select("read_id", "r.seq", "r.qual"),
    "string_edits": _Q(lambda: [S.mask_range(F.col("seq"), 3, 9).alias("masked"), S.remove_base(F.col("seq"), 2).alias("removed"), S.insert_base(F.col("seq"), 2, "A").alias("inserted"), S.trim_to(F.col("seq"), 10).alias("trimmed")]),
    "gap_helpers": lambda s, d: fasta_reads(s, d).filter("seq IS NOT NULL").select("read_id", S.drop_trailing_gaps(F.col("seq")).alias("seq"), S.count_gaps(F.col("seq")).alias("n_gaps")),
    "longest_homopolymer": _Q(lambda: [S.longest_homopolymer(F.upper("seq")).alias("longest")]),
    "quality_mask": _Q(lambda: [S.quality_mask(F.col("seq"), F.col("qual"), 15).alias("seq")]),
    "colour_space": _Q(lambda: [S.to_colours(F.col("seq")).alias("colours")]),
    "colour_space_back": _Q(lambda: [S.from_colours(S.to_colours(F.col("seq"))).alias("seq")]),
    "codon_translation": _Q(lambda: [S.translate_codons(F.col("seq")).alias("peptide")]),
    "peptide_differences": lambda s, d: fastq_reads(s, d).select("read_id", S.translate_codons(F.col("seq")).alias("a"), S.translate_codons(reverse_complement(F.col("seq"))).alias("b")).select("read_id", S.differences(F.col("a"), F.col("b")).alias("n")),
    "iupac_mismatches": _Q(lambda: [S.mask_differences(F.col("seq"), F.lit(MASK)).alias("n")]),
    "ambiguity_compare": _Q(lambda: [S.compare_with_ambiguity(F.upper("seq"), F.lit("ACGTNNRYAC")).alias("order")]),
    "ambiguity_merge": _Q(lambda: [S.merge_ambiguity(S.trim_to(F.upper("seq"), 10), F.lit("ACGTACGTAC")).alias("merged")]),
}
_UP = "upper(seq)"
_N = {b: f"(length(seq) - length(replace({_UP}, '{b}', '')))" for b in "ACGT"}
_COMP = f"SELECT read_id, {', '.join(f'{_N[b]} AS n_{b.lower()}' for b in 'ACGT')}, length(seq) - {' - '.join(_N.values())} AS n_other, CASE WHEN length(seq) > 0 THEN 100 * {_N['A']} / length(seq) END AS percent_a"
_CODE = "CASE {c} WHEN 'A' THEN 0 WHEN 'C' THEN 1 WHEN 'G' THEN 2 WHEN 'T' THEN 3 ELSE -1 END"
_COLOURS = f"list_transform(range(1, length(seq) + 1), lambda i: CASE WHEN ({_CODE.format(c='w[i]')}) < 0 OR ({_CODE.format(c='w[i + 1]')}) < 0 THEN '.' ELSE CAST(xor({_CODE.format(c='w[i]')}, {_CODE.format(c='w[i + 1]')}) AS VARCHAR) END)"
_TCAG = "(instr('TCAG', {c}) - 1)"


def _amino(s: str) -> str:
    at = lambda j: f"substr({s}, 3 * i + {j}, 1)"
    known = " AND ".join(f"instr('TCAG', {at(j)}) > 0" for j in (1, 2, 3))
    index = f"{_TCAG.format(c=at(1))} * 16 + {_TCAG.format(c=at(2))} * 4 + {_TCAG.format(c=at(3))} + 1"
    return f"array_to_string(list_transform(range(length({s}) // 3), lambda i: CASE WHEN {known} THEN substr('{S.AMINO_ACIDS}', {index}, 1) ELSE 'X' END), '')"


def _fits(b: str, c: str) -> str:
    rules = [f"{b} = {c}", f"{c} = 'N'", *[f"({c} = '{k}' AND {b} IN ({', '.join(repr(x) for x in v)}))" for k, v in S.IUPAC.items()], *[f"({c} = '{k}' AND {b} <> '{v}')" for k, v in S.IUPAC_NOT.items()]]
    return "(" + " OR ".join(rules) + ")"


_RC = "reverse(translate(upper(seq), 'ACGT', 'TGCA'))"
_PLAIN = "{x} IN ('A', 'C', 'G', 'T', 'U')"
_R = f"WITH {READS_SQL} "
_HEAD = f"regexp_extract(name, '{S.CASAVA.replace(chr(36), '')}', ['" + "', '".join(S.CASAVA_FIELDS) + "'])"
_AMB = "ACGTNNRYAC"
SQL = {
    "base_composition": f"WITH {FASTA_SQL} {_COMP} FROM fasta",
    "content_split": f"{_R}, c AS ({_COMP} FROM reads) SELECT read_id, CASE WHEN coalesce(percent_a, 0) < 25 THEN 'less' ELSE 'more' END AS part FROM c",
    "positional_stats": f"""{_R}, s AS (SELECT regexp_replace(upper(seq), '[^ACGT]', 'N', 'g') AS s, qual FROM reads), p AS (SELECT s, qual, unnest(range(1, length(s) + 1)) AS i FROM s),
e AS (SELECT 'nuc' AS kind, i - 1 AS pos, s[i] AS id, CAST(qual[i] AS DOUBLE) AS q FROM p UNION ALL SELECT 'din', i - 1, s[i:i + 1], (qual[i] + qual[i + 1]) / 2 FROM p WHERE i < length(s)),
g AS (SELECT kind, pos, id, count(*) AS n, avg(q) AS quality FROM e GROUP BY GROUPING SETS ((kind, pos, id), (kind, id)))
SELECT kind, CAST(pos AS INT) AS pos, id, n, 100 * n / sum(n) OVER (PARTITION BY kind, pos) AS percent, quality FROM g""",
    "length_histogram": f"WITH {FASTA_SQL}, c AS (SELECT length(seq) // 500 AS k, count(*) AS n FROM fasta WHERE seq IS NOT NULL GROUP BY 1) SELECT i * 500 AS length, coalesce(n, 0) AS n FROM (SELECT unnest(range(0, (SELECT max(k) + 1 FROM c))) AS i) LEFT JOIN c ON i = k",
    "n50": f"WITH {FASTA_SQL}, r AS (SELECT length(seq) AS l, sum(length(seq)) OVER (ORDER BY length(seq) DESC, read_id) AS t, sum(length(seq)) OVER () AS w FROM fasta WHERE length(seq) > 0) SELECT CAST(max(l) AS INT) AS n50 FROM r WHERE t * 2 >= w",
    "casava_headers": f"{_R}, h AS (SELECT read_id, {_HEAD} AS h FROM reads WHERE regexp_full_match(name, '{S.CASAVA}')) SELECT read_id, " + ", ".join(f"CAST(h['{f}'] AS {'INT' if t == 'int' else 'VARCHAR'}) AS \"{f}\"" for f, t in S.CASAVA_FIELDS.items()) + " FROM h",
    "demultiplex_counts": f"{_R} SELECT CASE WHEN regexp_full_match(name, '{S.CASAVA}') THEN {_HEAD}['index'] END AS \"index\", count(*) AS n FROM reads GROUP BY 1",
    "bernoulli_sample": f"{_R} SELECT read_id FROM reads WHERE CAST('0x' || substr(md5('42:' || read_id), 1, {DRAW}) AS BIGINT) < {int(0.1 * 16**DRAW)}",
    "collapse": f"{_R} SELECT left(upper(seq), {PRIMER}) AS seq, count(*) AS n FROM reads GROUP BY 1 HAVING count(*) >= 2",
    "collapse_with_mask": f"{_R}, c AS (SELECT left(upper(seq), {PRIMER}) AS seq, count(*) AS n FROM reads GROUP BY 1 HAVING count(*) >= 2) SELECT * FROM c WHERE len(list_filter(range(1, length(seq) + 1), lambda i: NOT {_fits('seq[i]', repr(MASK[:PRIMER]) + '[i]')})) <= 1",
    "reverse_complement": f"{_R} SELECT read_id, {_RC} AS rc FROM reads",
    "reverse_complement_read": f"{_R} SELECT read_id, reverse(translate(seq, 'ACGTacgt', 'TGCAtgca')) AS seq, list_reverse(qual) AS qual FROM reads",
    "string_edits": f"{_R} SELECT read_id, seq[1:3] || repeat('N', least(9, length(seq)) - 3) || seq[10:] AS masked, seq[1:2] || seq[4:] AS removed, seq[1:2] || 'A' || seq[3:] AS inserted, left(seq, 10) AS trimmed FROM reads",
    "gap_helpers": f"WITH {FASTA_SQL} SELECT read_id, rtrim(seq, '-') AS seq, length(seq) - length(replace(seq, '-', '')) AS n_gaps FROM fasta WHERE seq IS NOT NULL",
    "longest_homopolymer": f"{_R}, c AS (SELECT read_id, upper(seq) AS s FROM reads), p AS (SELECT read_id, s, unnest(range(1, length(s) + 1)) AS i FROM c), g AS (SELECT read_id, i, count_if(i = 1 OR s[i] <> s[i - 1]) OVER (PARTITION BY read_id ORDER BY i) AS r FROM p), n AS (SELECT read_id, r, count(*) AS n FROM g GROUP BY read_id, r) SELECT read_id, max(n) AS longest FROM n GROUP BY read_id",
    "quality_mask": f"{_R} SELECT read_id, CASE WHEN qual IS NULL THEN seq ELSE array_to_string(list_transform(range(1, length(seq) + 1), lambda i: CASE WHEN coalesce(qual[i], 99) < 15 THEN 'N' ELSE seq[i] END), '') END AS seq FROM reads",
    "colour_space": f"{_R} SELECT read_id, 'T' || array_to_string({_COLOURS}, '') AS colours FROM (SELECT *, 'T' || upper(seq) AS w FROM reads)",
    "colour_space_back": f"{_R} SELECT read_id, regexp_extract(upper(seq), '^[ACGT]*') || repeat('N', length(seq) - length(regexp_extract(upper(seq), '^[ACGT]*'))) AS seq FROM reads",
    "codon_translation": f"{_R} SELECT read_id, {_amino('upper(seq)')} AS peptide FROM reads",
    "peptide_differences": f"{_R}, p AS (SELECT read_id, {_amino('upper(seq)')} AS a, {_amino(_RC)} AS b FROM reads) SELECT read_id, len(list_filter(range(1, length(a) + 1), lambda i: a[i] <> b[i])) AS n FROM p",
    "iupac_mismatches": f"{_R} SELECT read_id, len(list_filter(range(1, least(length(seq), {len(MASK)}) + 1), lambda i: NOT {_fits('upper(seq)[i]', repr(MASK) + '[i]')})) AS n FROM reads",
    "ambiguity_compare": f"{_R}, o AS (SELECT read_id, seq, list_filter(list_transform(range(1, 11), lambda i: CASE WHEN ({_PLAIN.format(x='upper(seq)[i]')}) AND ({_PLAIN.format(x=repr(_AMB) + '[i]')}) THEN ascii('{_AMB}'[i]) - ascii(upper(seq)[i]) WHEN (({_PLAIN.format(x='upper(seq)[i]')}) OR ({_PLAIN.format(x=repr(_AMB) + '[i]')})) AND NOT {_fits('upper(seq)[i]', repr(_AMB) + '[i]')} THEN ascii('{_AMB}'[i]) - ascii(upper(seq)[i]) ELSE 0 END), lambda x: x <> 0) AS d FROM reads) SELECT read_id, CAST(coalesce(d[1], 10 - length(seq)) AS INT) AS \"order\" FROM o",
    "ambiguity_merge": f"{_R} SELECT read_id, CASE WHEN length(left(seq, 10)) = 10 THEN array_to_string(list_transform(range(1, 11), lambda i: CASE WHEN {_PLAIN.format(x='upper(seq)[i]')} THEN upper(seq)[i] ELSE 'ACGTACGTAC'[i] END), '') END AS merged FROM reads",
}
