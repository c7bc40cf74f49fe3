"""Counting k-mers, merging k-mer sets, screening reads against a reference set, and the reports on it.

A k-mer set is a DataFrame ``(kmer, colour, coverage, edges)``; reads are ``(read_id, seq)`` with an optional ``qual`` array.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from strandmill.functions import kmer as K
from strandmill.operators.codes import LONGEST, count_codes, read_codes
from strandmill.runtime import materialise, table

HISTOGRAM_TOP = 20_000
#: Taking a substring costs as much as its position; long sequences are therefore cut, with overlap, before they are exploded.
CHUNK = 128


# -- extraction ------------------------------------------------------------------------------------------------------


def masked_reads(reads: DataFrame, *keep: str, cut: int = 0, homopolymer: int = 0) -> DataFrame:
    """``(*keep, m)`` with every base that can't be part of a k-mer as N."""
    m = K.mask(F.col("seq"), F.col("qual") if cut > 0 else None, cut)
    return reads.select(*keep, (K.break_homopolymers(m, homopolymer) if homopolymer else m).alias("m"))


def occurrences(reads: DataFrame, k: int, *keep: str, cut: int = 0, homopolymer: int = 0, outer: bool = False) -> DataFrame:
    """``(*keep, pos, kmer)``: one row for each good k-mer, canonical, ``pos`` from 0.

    With ``outer`` a read without any gives one row with a null k-mer. Null and short reads have none.
    """
    explode, n = F.explode_outer if outer else F.explode, F.length("m") - k
    chunks = F.when(n >= 0, F.sequence(F.lit(0), n, F.lit(CHUNK))).otherwise(F.array().cast("array<int>"))
    rows = masked_reads(reads, *keep, cut=cut, homopolymer=homopolymer).select(*keep, "m", explode(chunks).alias("c"))
    rows = rows.select(*keep, "c", F.substring(F.col("m"), F.col("c") + 1, F.lit(CHUNK + k - 1)).alias("m"))
    # The reverse complement of a k-mer is a substring of the chunk's, which is made once, below the explode.
    rows = rows.withColumn("r", F.reverse(F.translate("m", "ACGT", "TGCA"))).select(*keep, "c", "m", "r", explode(K.starts(F.col("m"), k)).alias("i"))
    x, y = F.substring(F.col("m"), F.col("i"), F.lit(k)), F.substring(F.col("r"), F.length("m") - F.col("i") - (k - 2), F.lit(k))
    rows = rows.select(*keep, (F.col("c") + F.col("i") - 1).alias("pos"), F.when(~F.contains(x, F.lit("N")), F.least(x, y)).alias("kmer"))
    return rows if outer else rows.filter("kmer IS NOT NULL")


def read_windows(reads: DataFrame, k: int, cut: int = 0, homopolymer: int = 0) -> DataFrame:
    """``(read_id, window_no, n_kmers)`` of the good runs of at least ``k`` bases, from left to right, from 0."""
    rows = masked_reads(reads, "read_id", cut=cut, homopolymer=homopolymer)
    return rows.select("read_id", F.posexplode(K.window_lengths(F.col("m"), k)).alias("window_no", "n_kmers"))


def fixed_windows(reads: DataFrame, k: int) -> DataFrame:
    """``(read_id, pos, kmer)`` of every position, the k-mer null where a base is bad."""
    x = F.substring(F.col("m"), F.col("i"), F.lit(k))
    rows = masked_reads(reads, "read_id").select("read_id", "m", F.explode(K.starts(F.col("m"), k)).alias("i"))
    return rows.select("read_id", (F.col("i") - 1).alias("pos"), F.when(~F.contains(x, F.lit("N")), x).alias("kmer"))


def kmers_with_quality(reads: DataFrame, k: int, cut: int = 0) -> DataFrame:
    """``(read_id, pos, kmer, quality)``: each good k-mer with the qualities of its bases."""
    found = occurrences(reads, k, "read_id", "qual", cut=cut)
    return found.select("read_id", "pos", "kmer", F.slice("qual", F.col("pos") + 1, k).alias("quality"))


def present_windows(reads: DataFrame, kmer_set: DataFrame, k: int) -> DataFrame:
    """Runs of consecutive k-mers that are all in the set, as ``(read_id, window_no, start, end)`` in bases.

    A bad base breaks a run as an absent k-mer does. Gaps and islands: within a read, position less rank is constant in a run.
    """
    from pyspark.sql import Window

    here = occurrences(reads, k, "read_id").join(kmer_set.select("kmer").distinct(), "kmer", "left_semi")
    w = Window.partitionBy("read_id").orderBy("pos")
    runs = here.withColumn("g", F.col("pos") - F.row_number().over(w)).groupBy("read_id", "g").agg(F.min("pos").alias("start"), (F.max("pos") + k).alias("end"))
    return runs.select("read_id", (F.row_number().over(Window.partitionBy("read_id").orderBy("start")) - 1).alias("window_no"), "start", "end")


def reads_in_graph(reads: DataFrame, kmer_set: DataFrame, k: int) -> DataFrame:
    """Every window that lies wholly in the set as a read of its own."""
    return present_windows(reads, kmer_set, k).join(reads.select("read_id", "seq"), "read_id").select("read_id", "window_no", F.substring(F.col("seq"), F.col("start") + 1, F.col("end") - F.col("start")).alias("seq"))


# -- k-mer sets ------------------------------------------------------------------------------------------------------


def count_kmers(reads: DataFrame, k: int, cut: int = 0, homopolymer: int = 0) -> DataFrame:
    """``(kmer, coverage)``: partial counts before the shuffle, so a hot k-mer is one row a task. Up to k = 31 k-mers are counted packed."""
    if k <= LONGEST and not homopolymer:
        return count_codes(reads, k, cut).select(K.unpack(F.col("code"), k).alias("kmer"), "coverage")
    return occurrences(reads, k, cut=cut, homopolymer=homopolymer).groupBy("kmer").agg(F.count("*").alias("coverage"))


def merge_sets(*sets: DataFrame) -> DataFrame:
    """Union of k-mer sets ``(kmer, coverage, edges)``: coverages add up, edge bits are united."""
    every = sets[0]
    for s in sets[1:]:
        every = every.unionByName(s)
    return every.groupBy("kmer").agg(F.sum("coverage").alias("coverage"), F.bit_or("edges").alias("edges"))


def update_coverage(reference: DataFrame, sample: DataFrame) -> DataFrame:
    """``(kmer, coverage_0, coverage_1)``: the sample's coverage on the k-mers of the reference only."""
    ref = reference.groupBy("kmer").agg(F.sum("coverage").alias("coverage_0"))
    own = sample.groupBy("kmer").agg(F.sum("coverage").alias("coverage_1"))
    return ref.join(own, "kmer", "left").select("kmer", "coverage_0", F.coalesce("coverage_1", F.lit(0)).cast("bigint").alias("coverage_1"))


def lookup(kmer_set: DataFrame, *wanted: str) -> DataFrame:
    """Rows of the set for the given k-mers, in whatever orientation they are written."""
    return kmer_set.filter(F.col("kmer").isin([min(x, x[::-1].translate(str.maketrans("ACGT", "TGCA"))) for x in map(str.upper, wanted)]))


# -- screening -------------------------------------------------------------------------------------------------------


def hits_per_read(reads: DataFrame, reference: DataFrame, k: int, cut: int = 0) -> DataFrame:
    """``(read_id, n_kmers, hits)``: k-mers of the read, and how many of them, with multiplicity, the reference holds.

    Every read comes out, reads without k-mers with 0. The engine broadcasts the reference only if it is small.
    """
    if k <= LONGEST:
        packed = reference.select("code") if "code" in reference.columns else reference.select(K.pack(F.col("kmer")).alias("code"))
        return _hits_of(read_codes(reads, k, cut=cut), packed)
    ref = reference.select("kmer").distinct().withColumn("_in", F.lit(1))
    found = occurrences(reads, k, "read_id", cut=cut, outer=True).join(ref, "kmer", "left")
    return found.groupBy("read_id").agg(F.count("kmer").alias("n_kmers"), F.count("_in").alias("hits"))


def _hits_of(coded: DataFrame, reference: DataFrame) -> DataFrame:
    """Of ``(read_id, code, n)``, each k-mer of a read once, and the codes of the reference."""
    found = coded.join(reference.select("code").distinct().withColumn("_in", F.lit(1)), "code", "left")
    return found.groupBy("read_id").agg(F.sum("n").alias("n_kmers"), F.coalesce(F.sum(F.when(F.col("_in") == 1, F.col("n"))), F.lit(0)).alias("hits"))


def hit_histogram(hits: DataFrame, top: int = HISTOGRAM_TOP) -> DataFrame:
    """``(no_of_kmers, count)``, dense from 0 to the largest number of hits; more than ``top`` count as ``top``."""
    counts = hits.groupBy(F.least(F.col("hits"), F.lit(top)).alias("no_of_kmers")).agg(F.count("*").alias("count"))
    return densify(counts, "no_of_kmers", "count", 0)


def densify(counts: DataFrame, key: str, value: str, first: int) -> DataFrame:
    """Rows with 0 for the keys that are missing between ``first`` and the largest."""
    every = counts.agg(F.max(key).alias("m")).filter("m IS NOT NULL").select(F.explode(F.sequence(F.lit(first).cast("bigint"), F.col("m").cast("bigint"))).alias(key))
    return every.join(counts.select(F.col(key).cast("bigint").alias(key), value), key, "left").select(key, F.coalesce(value, F.lit(0)).cast("bigint").alias(value))


def route(hits: DataFrame, threshold: int) -> DataFrame:
    """Add ``bin``: with a threshold ``clean`` below it and ``contaminated`` from it on, without (0) the number of hits."""
    label = F.when(F.col("hits") < threshold, F.lit("clean")).otherwise(F.lit("contaminated")) if threshold > 0 else F.concat(F.lit("KMERS"), F.col("hits").cast("string"))
    return hits.withColumn("bin", label)


def route_pairs(first: DataFrame, second: DataFrame, reference: DataFrame, k: int, threshold: int) -> DataFrame:
    """``(read_id, mate, bin)``: pairs share a read_id, and the second mate follows the first, unlooked at."""
    bins = route(hits_per_read(first, reference, k), threshold).select("read_id", "bin")
    one = bins.select("read_id", F.lit(1).alias("mate"), "bin")
    two = second.select("read_id").join(bins, "read_id").select("read_id", F.lit(2).alias("mate"), "bin")
    return one.unionByName(two)


def keep_unmatched(reads: DataFrame, reference: DataFrame, k: int, min_matches: int = 3) -> DataFrame:
    """Reads with fewer than ``min_matches`` k-mers of the reference; counting ends there, so ``matches`` never exceeds it."""
    hits = hits_per_read(reads, reference, k).select("read_id", F.least(F.col("hits"), F.lit(min_matches)).alias("matches"))
    return hits.filter(F.col("matches") < min_matches)


# -- reports ---------------------------------------------------------------------------------------------------------


def colour_statistics(both: DataFrame) -> DataFrame:
    """Of ``(kmer, coverage_0, coverage_1)``: k-mers with coverage and their mean, by colour, and k-mers with both. No k-mers: NaN."""
    nan = F.lit(float("nan"))
    mean = lambda c: F.coalesce(F.avg(F.when(F.col(c) > 0, F.col(c))), nan)
    return both.agg(
        F.count_if(F.col("coverage_0") > 0).alias("reference_kmers"), mean("coverage_0").alias("reference_coverage"), F.count_if(F.col("coverage_1") > 0).alias("sample_kmers"), mean("coverage_1").alias("sample_coverage"),
        F.count_if((F.col("coverage_0") > 0) & (F.col("coverage_1") > 0)).alias("common"),
    )


def beside(a: DataFrame, b: DataFrame) -> DataFrame:
    """The columns of two one-row tables in one row."""
    return a.withColumn("_row", F.lit(1)).join(b.withColumn("_row", F.lit(1)), "_row").drop("_row")


def _percent(part: Column, whole: Column) -> Column:
    """In single precision, as the report's figures are; null where the whole is 0."""
    return F.when(whole > 0, ((F.lit(100).cast("float") * part.cast("float")).cast("float") / whole.cast("float")).cast("float").cast("double"))


def contamination_report(both: DataFrame, reference: str, sample: str, k: int, reference_reads: int | Column, reads: DataFrame, sample_total: Column | None = None) -> DataFrame:
    """One row with the report's columns. ``reads`` has one row: ``sample_reads`` and ``contaminated_reads``.

    ``sample_kmers`` counts k-mers of the reference seen in the sample; the number of all k-mers of the sample is an extra column.
    """
    row = beside(colour_statistics(both), reads)
    ref = reference_reads if isinstance(reference_reads, Column) else F.lit(reference_reads)
    return row.select(
        F.lit(reference).alias("reference"), F.lit(sample).alias("sample"), ref.cast("bigint").alias("reference_reads"), "sample_reads", F.lit(k).alias("kmer_size"), "reference_kmers", "reference_coverage", "sample_kmers", "sample_coverage",
        _percent(F.col("common"), F.col("reference_kmers")).alias("percentage"), "common", F.col("sample_reads").alias("sample_reads_again"), "contaminated_reads", _percent(F.col("contaminated_reads"), F.col("sample_reads")).alias("percentage_contaminated_reads"),
        *([sample_total.alias("sample_kmers_total")] if sample_total is not None else []),
    )


def read_totals(reads: DataFrame, hits: DataFrame) -> DataFrame:
    """One row: reads, bases, reads without a good k-mer, reads with a hit."""
    bases = reads.agg(F.coalesce(F.sum(F.length("seq")), F.lit(0)).alias("n_bases"))
    return beside(hits.agg(F.count("*").alias("n_reads"), F.count_if(F.col("n_kmers") == 0).alias("bad_reads"), F.count_if(F.col("hits") > 0).alias("contaminated_reads")), bases)


def set_summary(kmer_set: DataFrame) -> DataFrame:
    """K-mers with an edge: how many, summed and mean coverage."""
    rows = kmer_set.filter("edges <> 0")
    return rows.agg(F.count("*").alias("n_kmers"), F.coalesce(F.sum("coverage"), F.lit(0)).alias("coverage"), F.coalesce(F.avg("coverage"), F.lit(float("nan"))).alias("mean_coverage"))


def coverage_spectrum(kmer_set: DataFrame, first: int = 1) -> DataFrame:
    """``(coverage, n_kmers)``, dense from ``first`` to the largest coverage."""
    return densify(kmer_set.filter(F.col("coverage") >= first).groupBy("coverage").agg(F.count("*").alias("n_kmers")), "coverage", "n_kmers", first)


# -- the test tables -------------------------------------------------------------------------------------------------

SCREEN_K, CUT = 11, 15


def fastq_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads of the table, each delivery once. Redelivered reads agree in all of these columns."""
    return table(spark, sf_dir, "reads_fastq").select("read_id", "file_id", "name", "seq", "qual").dropDuplicates(["read_id"])


def fasta_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "reads_fasta").select("read_id", "name", "seq").dropDuplicates(["read_id"])


def dumped_set(spark: SparkSession, sf_dir: str, colour: int | None = None) -> DataFrame:
    """The ``kmers`` table as a k-mer set ``(kmer, colour, coverage, edges)``: each record once, canonical, merged."""
    rows = table(spark, sf_dir, "kmers").select("record_id", "colour", "coverage", "edges", K.valid_kmer(F.col("kmer"), 21).alias("kmer")).filter("kmer IS NOT NULL AND colour IS NOT NULL")
    rows = rows.filter(F.col("colour") == colour) if colour is not None else rows
    once = rows.groupBy("record_id").agg(F.max("kmer").alias("kmer"), F.max("colour").alias("colour"), F.max(F.greatest(F.coalesce("coverage", F.lit(0)), F.lit(0))).alias("coverage"), F.max(F.coalesce("edges", F.lit(0))).alias("edges"))
    return once.groupBy("kmer", "colour").agg(F.sum("coverage").alias("coverage"), F.bit_or("edges").alias("edges"))


def by_colour(kmer_set: DataFrame) -> DataFrame:
    """``(kmer, coverage_0, coverage_1)`` by conditional sums, without a join."""
    c = lambda n: F.sum(F.when(F.col("colour") == n, F.col("coverage")).otherwise(0)).alias(f"coverage_{n}")
    return kmer_set.groupBy("kmer").agg(c(0), c(1))


READS_SQL = "reads AS (SELECT DISTINCT read_id, file_id, name, seq, qual FROM reads_fastq)"
FASTA_SQL = "fasta AS (SELECT DISTINCT read_id, name, seq FROM reads_fasta)"
MASK_SQL = "regexp_replace(upper(seq), '[^ACGT]', 'N', 'g')"
CUT_SQL = f"CASE WHEN qual IS NULL OR seq = '' THEN {MASK_SQL} ELSE array_to_string(list_transform(range(1, length(seq) + 1), lambda i: CASE WHEN coalesce(qual[i], 99) <= {CUT} THEN 'N' ELSE {MASK_SQL}[i] END), '') END"
SET_SQL = """once AS (SELECT record_id, max(c) AS kmer, max(colour) AS colour, max(CASE WHEN coverage > 0 THEN coverage ELSE 0 END) AS coverage, max(coalesce(edges, 0)) AS edges
  FROM (SELECT *, least(u, reverse(translate(u, 'ACGT', 'TGCA'))) AS c FROM (SELECT *, upper(trim(kmer)) AS u FROM kmers) WHERE regexp_full_match(u, '[ACGT]{21}') AND colour IS NOT NULL) GROUP BY record_id),
kset AS (SELECT kmer, colour, CAST(sum(coverage) AS BIGINT) AS coverage, bit_or(edges) AS edges FROM once GROUP BY kmer, colour)"""


def kmers_sql(source: str, k: int, out: str, masked: str = MASK_SQL) -> str:
    """Common table expressions for the k-mer occurrences of ``source``."""
    return f"""{out}_m AS (SELECT read_id, {masked} AS m FROM {source}),
{out}_x AS (SELECT read_id, i - 1 AS pos, substr(m, i, {k}) AS x FROM (SELECT read_id, m, unnest(range(1, length(m) - {k} + 2)) AS i FROM {out}_m)),
{out} AS (SELECT read_id, pos, least(x, reverse(translate(x, 'ACGT', 'TGCA'))) AS kmer FROM {out}_x WHERE NOT contains(x, 'N'))"""


def _hits(s: SparkSession, d: str) -> DataFrame:
    return hits_per_read(fastq_reads(s, d), count_codes(fasta_reads(s, d), SCREEN_K), SCREEN_K)


HITS_SQL = f"""{READS_SQL}, {FASTA_SQL}, {kmers_sql('reads', SCREEN_K, 'rk')}, {kmers_sql('fasta', SCREEN_K, 'fk')}, ref AS (SELECT kmer, count(*) AS coverage FROM fk GROUP BY kmer),
h AS (SELECT read_id, count(*) AS n_kmers, count(ref.kmer) AS hits FROM rk LEFT JOIN ref USING (kmer) GROUP BY read_id),
hits AS (SELECT read_id, coalesce(n_kmers, 0) AS n_kmers, coalesce(hits, 0) AS hits FROM reads LEFT JOIN h USING (read_id))"""


def _report(s: SparkSession, d: str) -> DataFrame:
    """Reads and contigs are taken apart once; coverages, hits and totals come from the same rows."""
    coded = materialise(read_codes(fastq_reads(s, d), SCREEN_K), "codes")
    fasta = fasta_reads(s, d)
    reference = materialise(count_codes(fasta, SCREEN_K), "reference")
    hits = _hits_of(coded, reference).agg(F.count("*").alias("sample_reads"), F.count_if(F.col("hits") > 0).alias("contaminated_reads"))
    own = coded.filter("code IS NOT NULL").groupBy("code").agg(F.sum("n").alias("coverage_1"))
    both = reference.withColumnRenamed("coverage", "coverage_0").join(own, "code", "left").select("coverage_0", F.coalesce("coverage_1", F.lit(0)).alias("coverage_1"))
    return contamination_report(both, "reads_fasta", "reads_fastq", SCREEN_K, F.col("reference_reads"), beside(hits, fasta.agg(F.count("*").alias("reference_reads"))))


def _dump_report(s: SparkSession, d: str) -> DataFrame:
    reads = table(s, d, "kmers_meta").agg(F.sum("total_reads").alias("sample_reads"), F.lit(0).cast("bigint").alias("contaminated_reads"))
    both = by_colour(dumped_set(s, d))
    return contamination_report(both.filter("coverage_0 > 0"), "colour 0", "colour 1", 21, 0, reads)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "kmer_count": lambda s, d: count_kmers(fastq_reads(s, d), 21),
    "kmer_count_fasta": lambda s, d: count_kmers(fasta_reads(s, d), 21),
    "kmer_count_quality": lambda s, d: count_kmers(fastq_reads(s, d), 21, cut=CUT),
    "kmer_distinct": lambda s, d: count_kmers(fastq_reads(s, d), 21).agg(F.count("*").alias("unique_kmers"), F.sum("coverage").alias("n_kmers")),
    "kmer_windows": lambda s, d: read_windows(fastq_reads(s, d), 21),
    "kmer_windows_quality": lambda s, d: read_windows(fastq_reads(s, d), 21, cut=CUT),
    "homopolymer_break": lambda s, d: read_windows(fastq_reads(s, d), 21, homopolymer=4),
    "kmer_fixed_windows": lambda s, d: fixed_windows(fastq_reads(s, d), 31).groupBy("read_id").agg(F.count("*").alias("n"), F.count("kmer").alias("n_valid")),
    "kmer_with_quality": lambda s, d: kmers_with_quality(fastq_reads(s, d), 31).groupBy("kmer").agg(F.count("*").alias("n"), F.sum(F.aggregate(F.coalesce("quality", F.array().cast("array<int>")), F.lit(0).cast("bigint"), lambda a, q: a + q)).alias("quality")),
    "kmer_packed": lambda s, d: count_kmers(fastq_reads(s, d), 15).select(K.pack(F.col("kmer")).alias("code"), K.unpack(K.pack(F.col("kmer")), 15).alias("kmer")),
    "present_windows": lambda s, d: present_windows(fastq_reads(s, d), count_kmers(fasta_reads(s, d), SCREEN_K), SCREEN_K),
    "reads_in_graph": lambda s, d: reads_in_graph(fastq_reads(s, d), count_kmers(fasta_reads(s, d), SCREEN_K), SCREEN_K),
    "kmerset": lambda s, d: dumped_set(s, d),
    "kmerset_merge": lambda s, d: merge_sets(dumped_set(s, d, 0).drop("colour"), dumped_set(s, d, 1).drop("colour")),
    "kmerset_update": lambda s, d: update_coverage(dumped_set(s, d, 0), dumped_set(s, d, 1)),
    "kmer_lookup": lambda s, d: lookup(dumped_set(s, d), "A" * 21, "T" * 21, "AATGAGGGTTTAGCCGCAAGT"),
    "colour_statistics": lambda s, d: colour_statistics(by_colour(dumped_set(s, d))),
    "set_summary": lambda s, d: set_summary(dumped_set(s, d, 0)),
    "coverage_spectrum": lambda s, d: coverage_spectrum(count_kmers(fastq_reads(s, d), SCREEN_K)),
    "kmerinfo_spectrum": lambda s, d: coverage_spectrum(dumped_set(s, d, 0).filter("edges <> 0"), 0),
    "screen_hits_per_read": _hits,
    "hits_histogram_dense": lambda s, d: hit_histogram(_hits(s, d)),
    "filter_threshold": lambda s, d: route(_hits(s, d), 20).select("read_id", "bin"),
    "filter_bins": lambda s, d: route(_hits(s, d), 0).groupBy("bin").agg(F.count("*").alias("n")),
    "filter_pairs": lambda s, d: route_pairs(fastq_reads(s, d), fasta_reads(s, d), count_kmers(fasta_reads(s, d), SCREEN_K), SCREEN_K, 20),
    "filter_reads": lambda s, d: keep_unmatched(fastq_reads(s, d), count_kmers(fasta_reads(s, d), SCREEN_K), SCREEN_K),
    "read_totals": lambda s, d: read_totals(fastq_reads(s, d), _hits(s, d)),
    "contamination_report": _report,
    "contamination_report_dumps": _dump_report,
}

_COUNT = "SELECT kmer, count(*) AS coverage FROM rk GROUP BY kmer"
_RUNS = "list_filter(regexp_split_to_array({m}, 'N+'), lambda r: length(r) >= 21)"


def _windows_sql(masked: str) -> str:
    return f"WITH {READS_SQL}, w AS (SELECT read_id, list_filter(regexp_split_to_array({masked}, 'N+'), lambda r: length(r) >= 21) AS runs FROM reads), n AS (SELECT read_id, runs, unnest(range(len(runs))) AS i FROM w) SELECT read_id, CAST(i AS INT) AS window_no, CAST(length(runs[i + 1]) - 20 AS INT) AS n_kmers FROM n"


_BROKEN = MASK_SQL
for _b in "ACGT":
    _BROKEN = f"regexp_replace({_BROKEN}, '({_b}{{3}}){_b}+', '\\1N', 'g')"
_PRESENT = f"""WITH {HITS_SQL}, p AS (SELECT read_id, pos, pos - row_number() OVER (PARTITION BY read_id ORDER BY pos) AS g FROM rk SEMI JOIN ref USING (kmer)),
w AS (SELECT read_id, min(pos) AS a, max(pos) + {SCREEN_K} AS z FROM p GROUP BY read_id, g), n AS (SELECT *, row_number() OVER (PARTITION BY read_id ORDER BY a) - 1 AS i FROM w)
"""
_PERCENT = "CASE WHEN {b} > 0 THEN CAST(CAST(CAST(100 AS FLOAT) * CAST({a} AS FLOAT) AS FLOAT) / CAST({b} AS FLOAT) AS DOUBLE) END"
_REPORT = """SELECT '{ref}' AS reference, '{sample}' AS sample, CAST({ref_reads} AS BIGINT) AS reference_reads, CAST(sr AS BIGINT) AS sample_reads, {k} AS kmer_size, rk0 AS reference_kmers, rc AS reference_coverage, sk AS sample_kmers, sc AS sample_coverage,
""" + _PERCENT.format(a="cm", b="rk0") + " AS percentage, cm AS common, CAST(sr AS BIGINT) AS sample_reads_again, CAST(cr AS BIGINT) AS contaminated_reads, " + _PERCENT.format(a="cr", b="sr") + " AS percentage_contaminated_reads FROM stats, heads"  # fmt: skip
_STATS = "stats AS (SELECT count(*) FILTER (c0 > 0) AS rk0, coalesce(avg(c0) FILTER (c0 > 0), 'nan') AS rc, count(*) FILTER (c1 > 0) AS sk, coalesce(avg(c1) FILTER (c1 > 0), 'nan') AS sc, count(*) FILTER (c0 > 0 AND c1 > 0) AS cm FROM both_)"
_BOTH = "both_ AS (SELECT kmer, CAST(sum(CASE WHEN colour = 0 THEN coverage ELSE 0 END) AS BIGINT) AS c0, CAST(sum(CASE WHEN colour = 1 THEN coverage ELSE 0 END) AS BIGINT) AS c1 FROM kset GROUP BY kmer)"
_DENSE = "SELECT i AS {key}, coalesce(n, 0) AS {value} FROM (SELECT unnest(range({first}, (SELECT max(k) + 1 FROM c))) AS i) LEFT JOIN c ON i = k"
SQL = {
    "kmer_count": f"WITH {READS_SQL}, {kmers_sql('reads', 21, 'rk')} {_COUNT}",
    "kmer_count_fasta": f"WITH {FASTA_SQL}, {kmers_sql('fasta', 21, 'rk')} {_COUNT}",
    "kmer_count_quality": f"WITH {READS_SQL}, {kmers_sql('reads', 21, 'rk', CUT_SQL)} {_COUNT}",
    "kmer_distinct": f"WITH {READS_SQL}, {kmers_sql('reads', 21, 'rk')} SELECT count(DISTINCT kmer) AS unique_kmers, count(*) AS n_kmers FROM rk",
    "kmer_windows": _windows_sql(MASK_SQL),
    "kmer_windows_quality": _windows_sql(CUT_SQL),
    "homopolymer_break": _windows_sql(_BROKEN),
    "kmer_fixed_windows": f"WITH {READS_SQL}, {kmers_sql('reads', 31, 'rk')} SELECT read_id, count(*) AS n, count(*) FILTER (NOT contains(x, 'N')) AS n_valid FROM rk_x GROUP BY read_id",
    "kmer_with_quality": f"WITH {READS_SQL}, {kmers_sql('reads', 31, 'rk')} SELECT kmer, count(*) AS n, CAST(coalesce(sum(list_sum(qual[pos + 1:pos + 31])), 0) AS BIGINT) AS quality FROM rk JOIN reads USING (read_id) GROUP BY kmer",
    "kmer_packed": f"WITH {READS_SQL}, {kmers_sql('reads', 15, 'rk')} SELECT kmer, CAST(list_reduce(list_prepend(0::BIGINT, list_transform(string_split(kmer, ''), lambda c: CAST(instr('ACGT', c) - 1 AS BIGINT))), lambda a, b: a * 4 + b) AS BIGINT) AS code FROM (SELECT DISTINCT kmer FROM rk)",
    "present_windows": _PRESENT + "SELECT read_id, CAST(i AS INT) AS window_no, CAST(a AS INT) AS \"start\", CAST(z AS INT) AS \"end\" FROM n",
    "reads_in_graph": _PRESENT + "SELECT read_id, CAST(i AS INT) AS window_no, substr(seq, CAST(a + 1 AS BIGINT), CAST(z - a AS BIGINT)) AS seq FROM n JOIN reads USING (read_id)",
    "kmerset": f"WITH {SET_SQL} SELECT * FROM kset",
    "kmerset_merge": f"WITH {SET_SQL} SELECT kmer, CAST(sum(coverage) AS BIGINT) AS coverage, bit_or(edges) AS edges FROM kset WHERE colour IN (0, 1) GROUP BY kmer",
    "kmerset_update": f"WITH {SET_SQL} SELECT a.kmer, a.coverage AS coverage_0, coalesce(b.coverage, 0) AS coverage_1 FROM kset a LEFT JOIN (SELECT * FROM kset WHERE colour = 1) b USING (kmer) WHERE a.colour = 0",
    "kmer_lookup": f"WITH {SET_SQL} SELECT * FROM kset WHERE kmer IN ('AAAAAAAAAAAAAAAAAAAAA', 'AATGAGGGTTTAGCCGCAAGT', reverse(translate('AATGAGGGTTTAGCCGCAAGT', 'ACGT', 'TGCA')))",
    "colour_statistics": f"WITH {SET_SQL}, {_BOTH}, {_STATS} SELECT rk0 AS reference_kmers, rc AS reference_coverage, sk AS sample_kmers, sc AS sample_coverage, cm AS common FROM stats",
    "set_summary": f"WITH {SET_SQL} SELECT count(*) AS n_kmers, CAST(coalesce(sum(coverage), 0) AS BIGINT) AS coverage, coalesce(avg(coverage), 'nan') AS mean_coverage FROM kset WHERE colour = 0 AND edges <> 0",
    "coverage_spectrum": f"WITH {READS_SQL}, {kmers_sql('reads', SCREEN_K, 'rk')}, c AS (SELECT coverage AS k, count(*) AS n FROM ({_COUNT}) GROUP BY coverage) " + _DENSE.format(key="coverage", value="n_kmers", first=1),
    "kmerinfo_spectrum": f"WITH {SET_SQL}, c AS (SELECT coverage AS k, count(*) AS n FROM kset WHERE colour = 0 AND edges <> 0 GROUP BY coverage) " + _DENSE.format(key="coverage", value="n_kmers", first=0),
    "screen_hits_per_read": f"WITH {HITS_SQL} SELECT * FROM hits",
    "hits_histogram_dense": f"WITH {HITS_SQL}, c AS (SELECT least(hits, {HISTOGRAM_TOP}) AS k, count(*) AS n FROM hits GROUP BY 1) " + _DENSE.format(key="no_of_kmers", value="count", first=0),
    "filter_threshold": f"WITH {HITS_SQL} SELECT read_id, CASE WHEN hits < 20 THEN 'clean' ELSE 'contaminated' END AS bin FROM hits",
    "filter_bins": f"WITH {HITS_SQL} SELECT 'KMERS' || hits AS bin, count(*) AS n FROM hits GROUP BY hits",
    "filter_pairs": f"WITH {HITS_SQL}, b AS (SELECT read_id, CASE WHEN hits < 20 THEN 'clean' ELSE 'contaminated' END AS bin FROM hits) SELECT read_id, 1 AS mate, bin FROM b UNION ALL SELECT read_id, 2, bin FROM b JOIN fasta USING (read_id)",
    "filter_reads": f"WITH {HITS_SQL} SELECT read_id, least(hits, 3) AS matches FROM hits WHERE hits < 3",
    "read_totals": f"WITH {HITS_SQL} SELECT count(*) AS n_reads, count(*) FILTER (n_kmers = 0) AS bad_reads, count(*) FILTER (hits > 0) AS contaminated_reads, (SELECT CAST(sum(length(seq)) AS BIGINT) FROM reads) AS n_bases FROM hits",
    "contamination_report": f"WITH {HITS_SQL}, both_ AS (SELECT kmer, ref.coverage AS c0, coalesce(s.coverage, 0) AS c1 FROM ref LEFT JOIN ({_COUNT}) s USING (kmer)), {_STATS}, heads AS (SELECT count(*) AS sr, count(*) FILTER (hits > 0) AS cr, (SELECT count(*) FROM fasta) AS fr FROM hits) " + _REPORT.format(ref="reads_fasta", sample="reads_fastq", ref_reads="fr", k=SCREEN_K),
    "contamination_report_dumps": f"WITH {SET_SQL}, all_ AS ({_BOTH[10:-1]}), both_ AS (SELECT * FROM all_ WHERE c0 > 0), {_STATS}, heads AS (SELECT sum(total_reads) AS sr, 0 AS cr FROM kmers_meta) " + _REPORT.format(ref="colour 0", sample="colour 1", ref_reads="0", k=21),
}
