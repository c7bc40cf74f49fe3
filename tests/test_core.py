import io
import os
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from strandmill.functions import kmer as K, seq as S
from strandmill.operators import kmers as M, readstats as RS
from strandmill.plans import programs as P
from strandmill.runtime import prefix_sums
from strandmill.sources import set_image as IMG
from strandmill.sources import kmer_files as KF, readers as R, writers as W
from strandmill.streaming import screen as ST

COMP = str.maketrans("ACGT", "TGCA")
SEQ = "AAAAANNTTTTGGGG"


def reads(spark, *rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "read_id long, seq string, qual array<int>")


@pytest.mark.parametrize(
    ("qual", "cut", "k", "want"),
    [
        ([0] * 15, 0, 3, [3, 6]),
        ([20] * 11 + [10] + [20] * 3, 15, 3, [3, 2, 1]),
        ([5, 10, 20, 20, 20, 20, 0, 0, 0, 20, 20, 30, 20, 20, 20], 15, 3, [1, 4]),
        ([0] * 15, 15, 3, []),
        ([0] * 15, 0, 5, [1, 4]),
        (None, 15, 5, [1, 4]),
    ],
)
def test_windows(spark, qual, cut, k, want):
    rows = M.read_windows(reads(spark, (SEQ, qual)), k, cut).orderBy("window_no").collect()
    assert [r.n_kmers for r in rows] == want and [r.window_no for r in rows] == list(range(len(want)))


@pytest.mark.parametrize(("cutoff", "want"), [(4, [1, 4]), (3, [4]), (2, [4])])
def test_homopolymers_break_windows(spark, cutoff, want):
    rows = M.read_windows(reads(spark, ("AAAAANNTCAGAT", None)), 3, homopolymer=cutoff).orderBy("window_no").collect()
    assert [r.n_kmers for r in rows] == want


def test_counts_of_known_reads(spark):
    seqs = ["AATAATAATAATAATAATAATAATAAT", "GGGCAGTCTCT", "GGGCAGTCTCT", "TTTTTTTTTT"]
    got = {min(r.kmer, r.kmer.translate(COMP)[::-1]): r.coverage for r in M.count_kmers(reads(spark, *[(s, None) for s in seqs]), 3).collect()}
    canon = lambda x: min(x, x.translate(COMP)[::-1])
    assert len(got) == 12 and got[canon("TTT")] == 8 and got[canon("AAT")] == 9 and got[canon("TCT")] == 4
    assert all(got[canon(x)] == 2 for x in ("GGG", "GGC", "GCA", "CAG", "AGT", "GTC"))


@pytest.mark.parametrize("chunk", [128, 7])
def test_random_reads_and_long_ones(spark, monkeypatch, chunk):
    monkeypatch.setattr(M, "CHUNK", chunk)
    rng, k = random.Random(chunk), 5
    seqs = [None, "", "AC", "acgta"] + ["".join(rng.choice("ACGTacgtN.") for _ in range(rng.randrange(0, 600))) for _ in range(60)]
    want, per = Counter(), {}
    for i, s in enumerate(seqs):
        u = (s or "").upper()
        ks = [u[j : j + k] for j in range(len(u) - k + 1) if set(u[j : j + k]) <= set("ACGT")]
        per[i] = [min(x, x.translate(COMP)[::-1]) for x in ks]
        want.update(per[i])
    df = reads(spark, *[(s, None) for s in seqs])
    assert {r.kmer: r.coverage for r in M.count_kmers(df, k).collect()} == want
    ref = {x for n, x in enumerate(sorted(want)) if n % 3 == 0}
    hits = M.hits_per_read(df, spark.createDataFrame([(x,) for x in ref] * 2, "kmer string"), k)
    assert {r.read_id: (r.n_kmers, r.hits) for r in hits.collect()} == {i: (len(p), sum(x in ref for x in p)) for i, p in per.items()}
    histogram = {r.no_of_kmers: r["count"] for r in M.hit_histogram(hits).collect()}
    counts = Counter(sum(x in ref for x in p) for p in per.values())
    assert histogram == {n: counts.get(n, 0) for n in range(max(counts) + 1)}
    capped = {r.no_of_kmers: r["count"] for r in M.hit_histogram(hits, 3).collect()}
    assert max(capped) <= 3 and sum(capped.values()) == len(seqs)


def test_sets_reports_and_empty_tables(spark):
    a = spark.createDataFrame([("AAA", 2, 1), ("AAC", 3, 2)], "kmer string, coverage long, edges int")
    b = spark.createDataFrame([("AAA", 5, 4), ("GGG", 1, 0)], "kmer string, coverage long, edges int")
    assert {tuple(r) for r in M.merge_sets(a, b).collect()} == {("AAA", 7, 5), ("AAC", 3, 2), ("GGG", 1, 0)}
    both = M.update_coverage(a, b)
    assert {tuple(r) for r in both.collect()} == {("AAA", 2, 5), ("AAC", 3, 0)}
    heads = spark.createDataFrame([(4, 1)], "sample_reads long, contaminated_reads long")
    row = M.contamination_report(both, "r", "s", 3, 9, heads).first()
    assert (row.reference_kmers, row.sample_kmers, row.common, row.percentage, row.percentage_contaminated_reads) == (2, 1, 1, 50.0, 25.0)
    none = M.contamination_report(both.filter("false"), "r", "s", 3, 0, heads.selectExpr("0L sample_reads", "0L contaminated_reads")).first()
    assert none.percentage is None and none.reference_coverage != none.reference_coverage
    assert M.coverage_spectrum(a.filter("false")).count() == 0 and [tuple(r) for r in M.coverage_spectrum(a).orderBy("coverage").collect()] == [(1, 0), (2, 1), (3, 1)]
    empty = spark.createDataFrame([], "read_id long, seq string, qual array<int>")
    for df in (M.count_kmers(empty, 3), M.hits_per_read(empty, a, 3), M.hit_histogram(M.hits_per_read(empty, a, 3)), RS.positional_stats(empty), RS.length_histogram(empty, 10)):
        assert df.count() == 0
    assert RS.n50(empty).first().n50 is None
    assert {r.bin for r in M.route(M.hits_per_read(reads(spark, ("AAAA", None), ("CGCG", None)), a, 3), 2).collect()} == {"contaminated", "clean"}


def test_codes_and_edges(spark):
    one = spark.range(1)
    x = F.lit("ACGTT")
    row = one.select(K.pack(x).alias("p"), S.append_base(K.pack(x), 3, 5).alias("a"), S.prepend_base(K.pack(x), 2, 5).alias("b"), S.base_at(K.pack(x), 1, 5).alias("c"), S.edge_bit(F.lit("G"), F.lit(True)).alias("e"), S.edge_count(F.lit(0x31), True).alias("n"), S.is_blunt(F.lit(0x30)).alias("blunt"), S.common_bits(F.lit(7), F.lit(5)).alias("bits")).first()
    back = one.select(K.unpack(F.lit(row.a), 5).alias("a"), K.unpack(F.lit(row.b), 5).alias("b")).first()
    assert tuple(back) == ("CGTTT", "GACGT") and (row.c, row.e, row.n, row.blunt, row.bits) == (1, 64, 2, True, 2)
    head = one.select(S.casava(F.lit("HWI-ST319:185:D0CWKACXX:3:1101:1189:2148 1:N:0:TGATAACA")).alias("h")).first().h
    assert head["index"] == "TGATAACA" and head.tile == 1101 and one.select(S.casava(F.lit("other")).alias("h")).first().h is None
    assert one.select(S.from_colours(F.lit("T0123.1")).alias("x"), S.translate_codons(F.lit("ATGGCNTAA")).alias("p"), S.next_homopolymer(F.lit("ACGGT"), 1).alias("n"), S.run_length(F.lit("ACGGT"), 2).alias("l")).first()[1:] == ("MX*", 2, 2)


FASTA = "#c\n>one x\nACGT AA\nTTNN\n>two\tq\nacgt\r\n\n>three\n"
FASTQ = "@r1 a b\tz\nAC\nGT\n+\n@@\n@I\n@r2\nAC#T\n+\nIIII\n@r3\nAC.T\n+r3\nIIII\n@r4\nACGT\n+\nIIIII\n@r5\nA\n+\n!\n"


def test_files(spark, tmp_path):
    (tmp_path / "a.fa").write_text(FASTA), (tmp_path / "a.fq").write_text(FASTQ), (tmp_path / "a.qual").write_text(">one\n1 2 3 4\n5 6 7 8\n>two\n9 9 9 9\n>three\n")
    assert [(r.read_id, r.name, r.seq) for r in R.read_fasta(spark, str(tmp_path / "a.fa"), ordinals=True).orderBy("read_id").collect()] == [(0, "one", "ACGTTTNN"), (1, "two", "acgt"), (2, "three", "")]
    assert [(r.name, r.seq, r.qual) for r in R.read_fastq(spark, str(tmp_path / "a.fq")).collect()] == [("r1 a b", "ACGT", [31, 31, 31, 40]), ("r3", "ACNT", [40] * 4), ("r5", "A", [0])]
    assert [r.name for r in R.read_fastq(spark, str(tmp_path / "a.fq"), keep_bad=True).collect()] == ["r1 a b", "r2", "r3", "r5"]
    assert R.read_fasta_and_qual(spark, str(tmp_path / "a.fa"), str(tmp_path / "a.qual")).filter("name = 'one'").first().qual == list(range(1, 9))
    (tmp_path / "list").write_text(f"{tmp_path}/a.fa 1\n\n{tmp_path}/a.fa\n")
    assert {(r.name, r.colour) for r in R.read_listed(spark, str(tmp_path / "list"), "fasta").collect()} == {(n, c) for n in ("one", "two", "three") for c in (0, 1)}
    (tmp_path / "log").write_text("[Mon] CORE\n[Mon] K: 21\nINPUT\nReads = 7 of 9\nfree text\n")
    assert [(r.section, r.key, r.value) for r in R.read_assembler_log(spark, str(tmp_path / "log")).orderBy("line_no").collect()] == [("CORE", "K", "21"), ("INPUT", "Reads", "7 of 9")]
    (tmp_path / "libs").write_text("a b 300 50 2 90\n")
    assert R.read_pair_libraries(spark, str(tmp_path / "libs")).first().distance == 300
    (tmp_path / "cs.fa").write_text(">x\nT0123\n")
    assert R.read_csfasta(spark, str(tmp_path / "cs.fa")).first().bases == "TGAT"
    with pytest.raises(ValueError):
        R.read_reads(spark, "x", "ROCHE")
    row = spark.createDataFrame([(7, "ACGT" * 30, 5, 2.5, 1, 9)], "path_id int, seq string, n_kmers int, avg_coverage double, min_coverage int, max_coverage int")
    assert W.contig_text(row).first().value.split("\n")[1:] == ["ACGT" * 20, "ACGT" * 10]


@pytest.mark.parametrize("k", [21, 31, 33, 63])
def test_kmer_files(spark, tmp_path, k):
    rng = random.Random(k)
    rows = [("".join(rng.choice("ACGT") for _ in range(k)), rng.choice([1, 2**40]), rng.randrange(256)) for _ in range(50)]
    path = str(tmp_path / "set")
    KF.write_kmers(spark.createDataFrame(rows, "kmer string, coverage long, edges int"), path, k, total_reads=99)
    assert sorted(tuple(r) for r in KF.read_kmers(spark, path, k).select("kmer", "coverage", "edges").collect()) == sorted((x, min(c, 2**32 - 1), e) for x, c, e in rows)
    assert KF.total_reads(path) == 99
    with pytest.raises(FileExistsError):
        KF.write_kmers(spark.createDataFrame(rows, "kmer string, coverage long, edges int"), path, k)
    first = sorted(os.listdir(path))[-1]
    with open(os.path.join(path, first), "r+b") as f:
        f.write(b"BROKEN")
    with pytest.raises(ValueError):
        KF.read_header(os.path.join(path, first))


def test_programs(spark, tmp_path):
    rng = random.Random(3)
    genome = "".join(rng.choice("ACGT") for _ in range(300))
    other = ["".join(rng.choice("ACGT") for _ in range(60)) for _ in range(10)]
    (tmp_path / "ref.fa").write_text(f">g\n{genome}\n")
    fq = lambda seqs: "".join(f"@r{i}\n{s}\n+\n{'I' * len(s)}\n" for i, s in enumerate(seqs))
    mine = [genome[i : i + 60] for i in range(0, 240, 24)]
    (tmp_path / "1.fq").write_text(fq(mine + other)), (tmp_path / "2.fq").write_text(fq(other + mine))
    at = lambda x: str(tmp_path / x)
    P.main(["build", "-i", at("ref.fa"), "-f", "FASTA", "-o", at("ref"), "-n", "16"])
    P.build(spark, [at("ref"), at("ref")], "KMERS", at("twice"))
    assert KF.read_kmers(spark, at("twice")).agg(F.sum("coverage")).first()[0] == 2 * 280
    row = P.contamination(spark, at("ref"), at("1.fq"), "FASTQ", at("report"), at("hist")).first()
    assert (row.reference_kmers, row.sample_reads, row.contaminated_reads, row.percentage_contaminated_reads) == (280, 20, 10, 50.0) and row.sample_kmers_total == row.common + 400
    assert os.path.isdir(at("report")) and sum(int(r["count"]) for r in spark.read.option("sep", "\t").option("header", True).csv(at("hist")).collect()) == 20
    P.build(spark, at("1.fq"), "FASTQ", at("sample"))
    assert P.contamination(spark, at("ref"), at("sample"), "KMERS").first().contaminated_reads == 0
    P.filter_reads(spark, at("ref"), at("1.fq"), at("out"), at("2.fq"), threshold=1, print_contaminated=True)
    assert {r.seq for r in R.read_fastq(spark, at("out/mate=1/bin=clean")).collect()} == set(other)
    assert {r.seq for r in R.read_fastq(spark, at("out/mate=2/bin=contaminated")).collect()} == set(other)
    found = P.info(spark, at("ref"), 21, [genome[:21]])
    assert found["found"].count() == 1 and set(found) == {"summary", "spectrum", "found"}
    assert P.assemble(spark, at("ref.fa"), "FASTA", at("contigs"), shape="gml").filter(F.length("seq") > 200).count() <= 1
    lines = [line for f in sorted((tmp_path / "contigs.gml").glob("part-*")) for line in f.read_text().splitlines()]
    assert lines[0].startswith("graph [") and lines[-1] == "]" and [x.split()[0] for x in lines[1:-1]] == sorted((x.split()[0] for x in lines[1:-1]), reverse=True)
    (whole,) = P.assemble(spark, at("ref.fa"), "FASTA", at("walked"), walk="Y_WALK").collect()
    assert min(whole.seq, whole.seq.translate(COMP)[::-1]) == min(genome, genome.translate(COMP)[::-1]) and whole.avg_coverage == 1.0
    P.build(spark, at("1.fq"), "FASTQ", at("split"), four_line=True)
    same = [{(r.kmer, r.coverage) for r in KF.read_kmers(spark, at(x)).collect()} for x in ("sample", "split")]
    assert same[0] == same[1] and len(same[0]) > 400
    with pytest.raises(ValueError):
        P.build(spark, at("1.fq"), "FASTQ", at("even"), k=20)
    image = spark.createDataFrame([("ACGTA", 3)], "kmer string, coverage bigint")
    IMG.save_image(image, at("image"), 5)
    assert IMG.load_image(spark, at("image"), 5).collect() == image.collect()
    with pytest.raises(ValueError):
        IMG.load_image(spark, at("image"), 7)


def test_streams(spark, tmp_path):
    text = io.StringIO("".join(f"@r{i}\nACGTACGTA\n+\nIIIIIIIII\n" for i in range(7)))
    assert ST.spool(text, str(tmp_path / "in"), records=3) == 3
    got: list = []
    ref = spark.createDataFrame([("ACGTA",)], "kmer string")
    q = ST.screen_stream(ST.fastq_stream(spark, str(tmp_path / "in")).select("name", "seq", "qual"), ref, 5, str(tmp_path / "state"), lambda df, n: got.extend(df.collect()), ident="name")
    q.awaitTermination()
    assert len(got) == 7 and {r.bin for r in got} == {"contaminated"} and {r.hits for r in got} == {sum(min(x, x.translate(COMP)[::-1]) == "ACGTA" for x in ("ACGTACGTA"[i : i + 5] for i in range(5)))}
    q = ST.screen_stream(ST.fastq_stream(spark, str(tmp_path / "in")).select("name", "seq", "qual"), ref, 5, str(tmp_path / "state2"), lambda df, n: ST.write_bins(str(tmp_path / "bins"))(df.withColumnRenamed("read_id", "name"), n), ident="name")
    q.awaitTermination()
    assert R.read_fastq(spark, str(tmp_path / "bins/batch=0/bin=contaminated")).count() == 7


def test_read_statistics(spark):
    df = reads(spark, ("AACGTN", [10] * 6), ("", None), (None, None), ("aacc", [1, 2]))
    rows = {r.read_id: (r.n_a, r.n_other, r.percent_a) for r in RS.base_composition(df).collect()}
    assert rows == {0: (2, 1, 100 * 2 / 6), 1: (0, 0, None), 2: (None, None, None), 3: (2, 0, 50.0)}
    stats = {(r.kind, r.pos, r.id): (r.n, r.percent, r.quality) for r in RS.positional_stats(df).collect()}
    assert stats["nuc", 0, "A"] == (2, 100.0, 5.5) and stats["nuc", 5, "N"] == (1, 100.0, 10.0) and stats["nuc", None, "A"][0] == 4 and stats["din", None, "AA"][0] == 2
    assert {r.read_id: r.part for r in RS.content_split(df, 40).collect()} == {0: "less", 1: "less", 2: "less", 3: "more"}
    assert RS.n50(df).first().n50 == 6
    many = spark.range(20_000).select(F.col("id").alias("read_id"))
    assert abs(RS.bernoulli(many, 0.1, 1).count() - 2000) < 200 and RS.bernoulli(many, 0.0, 1).count() == 0 and RS.bernoulli(many, 1.0, 1).count() == 20_000


@pytest.mark.parametrize("group", ["g", None])
def test_prefix_sums_over_many_groups(spark, group):
    rng = random.Random(11)
    rows = [(rng.choice([None, 1, 1, 1, *range(500)]), i, rng.choice([None, 0, 3])) for i in range(3000)]
    df = spark.createDataFrame(rows, "g long, i long, v long").repartition(5)
    want, sums = {}, {}
    for g, i, v in rows:
        key = g if group else 0
        want[i] = sums[key] = sums.get(key, 0) + (v or 0)
    assert {r.i: r.s for r in prefix_sums(df, group, ["i"], "v", "s").collect()} == want
