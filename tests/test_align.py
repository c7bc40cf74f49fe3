import random

import pytest
from pyspark.sql import functions as F

from strandmill.operators import align as A


def dp(a, b, rule):
    """Score and last best cell, one cell at a time."""
    match, transition, transversion, gap, other = A.RULES[rule]
    kind = {frozenset("AG"): transition, frozenset("CT"): transition}
    s = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    best, at = 0, None
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            x, y = a[i - 1], b[j - 1]
            sub = match if x == y else other if not {x, y} <= set("ACGT") else kind.get(frozenset((x, y)), transversion)
            s[i][j] = max(0, s[i - 1][j - 1] + sub, s[i - 1][j] + gap, s[i][j - 1] + gap)
            if s[i][j] >= best:
                best, at = s[i][j], (i, j)
    return best, at


@pytest.mark.parametrize("rule", list(A.RULES))
def test_local_alignment(rule):
    rng = random.Random(1)
    assert A.local_alignment("ACTGA", "CTGA", "simple")[5:7] == ("CTGA", "CTGA")
    for _ in range(150):
        a = "".join(rng.choice("ACGTN") for _ in range(rng.randrange(0, 25)))
        b = a[rng.randrange(5) :][: rng.randrange(1, 20)] + "".join(rng.choice("ACGT") for _ in range(rng.randrange(6)))
        score, sa, ea, sb, eb, xa, xb, matches, mismatches, gaps, longest = A.local_alignment(a, b, rule)
        best, at = dp(a, b, rule)
        assert score == best and (not best or (ea, eb) == at)
        assert xa.replace("-", "") == a[sa:ea] and xb.replace("-", "") == b[sb:eb] and len(xa) == len(xb) == matches + mismatches + gaps
        assert longest <= matches
    assert A.local_alignment("", "ACG")[0] == 0


def test_orientation_scores_and_nulls(spark):
    ref = "ACCTGAGTCAATGCGTTACGGA"
    rc = ref.translate(str.maketrans("ACGT", "TGCA"))[::-1]
    df = spark.createDataFrame([(1, ref, ref), (2, ref, rc), (3, ref, ref[::-1]), (4, ref, rc[::-1]), (5, ref, None)], "id int, a string, b string").withColumn("score", F.lit("clash"))
    got = {r.id: (r.way, r.score) for r in A.align_best_of_four(df, "a", "b", "id").collect()}
    assert got == {1: (0, 44), 2: (1, 44), 3: (2, 44), 4: (3, 44), 5: (0, 0)}
    scored = A.align(df.filter("id = 1"), "a", "b", "id", "a").select(A.identity().alias("i"), A.numt_score(F.length("a"), 0.9, 0.1).alias("n"), A.chimera_score(F.length("a"), 0.3, 0.8).alias("c")).first()
    assert tuple(scored) == (1.0, 1.0, 0.0)


def test_consensus_and_variants(spark):
    ref = "ACCTGAGTCAATGCGTTACGGA"
    mut = ref[:10] + "C" + ref[11:]
    refs = spark.createDataFrame([(1, ref), (2, "GGGGGGGG")], "ref_id long, seq string")
    reads = spark.createDataFrame([(1, ref, mut, [30] * 22), (1, ref, ref[:15], [20] * 15), (1, ref, ref, [5] * 22)], "ref_id long, ref string, seq string, qual array<int>")
    voted = A.consensus(refs, A.align(reads, "ref", "seq", "ref_id", "qual"), 10, 10)
    rows = {r.ref_id: (r.seq, r.correct) for r in A.consensus_sequences(voted).collect()}
    assert rows == {1: (mut, 22), 2: ("gggggggg", 0)}
    found = {(r.kind, r["from"], r.position, r.to) for r in A.variants(refs, A.consensus_sequences(voted), 5).collect()}
    assert ("BASE", "A", 11, "C") in found and len(found) == 2
    low = A.consensus(refs, A.align(reads.limit(1).withColumn("qual", F.array(*[F.lit(2 if i == 10 else 30) for i in range(22)])), "ref", "seq", "ref_id", "qual"), 10, 10, window=4)
    assert A.consensus_sequences(low).filter("ref_id = 1").first().seq[9:12] == ref[9:12].lower()


def test_masks_and_repairs(spark):
    assert A.mask_match("ACGT", "NRYT")[:2] == (1, 2)
    assert A.mask_match("AAGTACGTACGTA", "ARNTACGTACGTA", 5)[:2] == (12, 0)
    mask = "ACCTGAGTCAAATGCGTTACGGAT"
    assert A.repair(mask, mask) == (mask, 0)
    assert A.repair(mask[:6] + "T" + mask[6:], mask, most_mismatches=1)[0][: len(mask)] == mask
    fixed, fixes = A.repair(mask[:9] + "AA-" + mask[12:], mask)
    assert fixed == mask[:11] + "a" + mask[12:] and fixes == 1
    df = spark.createDataFrame([(1, "TTACGTACGTTTTTGGGGTTTT"), (2, None), (3, "")], "id long, seq string")
    out = {r.id: r.seq for r in A.mask_primers(df, {"p": "TTACGTACG"}, 10).collect()}
    assert out[1] == "N" * 9 + "TTTTTGGGGTTTT" and out[2] is None and out[3] == ""
    assert A.repair_under_mask(df, mask).count() == 3


def test_best_reference_is_the_one_of_the_most_kmers(spark, monkeypatch):
    rng, k = random.Random(3), 5
    comp = str.maketrans("ACGT", "TGCA")
    genome = "".join(rng.choice("ACGT") for _ in range(150)) + "A" * 20
    seqs = [genome[i : i + rng.randrange(8, 40)] for i in (rng.randrange(150) for _ in range(60))] + [None, "ACG", "A" * 30, "GGNGG"]
    seqs = [s.translate(comp)[::-1] if s and i % 3 == 0 and "N" not in s else s for i, s in enumerate(seqs)]
    sets = {i: {min(x, x.translate(comp)[::-1]) for x in ((s or "")[j : j + k] for j in range(len(s or "") - k + 1)) if "N" not in x} for i, s in enumerate(seqs)}
    want = {i: max((len(a & b), -j) for j, b in sets.items() if j != i) for i, a in sets.items()}
    want = {i: (-j, n) for i, (n, j) in want.items() if n}
    reads = spark.createDataFrame(list(enumerate(seqs)), "read_id long, seq string")
    for sizes in ({}, {"GROUP": 3, "POSTINGS": 4, "BLOCK": 7}):
        for name, n in sizes.items():
            monkeypatch.setattr(A, name, n)
        rows = A.best_reference(reads, reads.withColumnRenamed("read_id", "ref_id"), k).collect()
        assert {r.read_id: (r.ref_id, r.shared) for r in rows} == want and len(rows) == len(want)


def test_mates_joined_over_a_reference(spark):
    ref = "ATGGCCAAAGATCTTGGACCTTACGGATTCAGCTGA"
    changed = ref[:9] + "C" + ref[10:]
    back = changed[14:][::-1].translate(str.maketrans("ACGT", "TGCA"))
    refs = spark.createDataFrame([(1, ref), (2, ref), (3, ref)], "ref_id long, seq string")
    reads = [(1, 10, changed[:24], [30] * 24), (1, 11, back, [*range(20, 20 + len(back))]), (2, 12, ref[:18], [30] * 18)]
    rows = spark.createDataFrame(reads, "ref_id long, read_id long, seq string, qual array<int>")
    (r,) = A.joined(refs, rows, 10, 20).collect()
    assert (r.ref_id, r.seq, r.correct, r.peptide) == (1, changed, len(ref), "MAKHLGPYGFS_"[: len(r.peptide)]) or r.seq == changed and r.correct == len(ref)
    assert {x.ref_id for x in A.joined(refs, rows, 10, 20, percent=40.0).collect()} == {1, 2}
    assert A.joined(refs, rows.filter("false")).count() == 0


def test_variant_filters(spark):
    good = ("A" * 25, "ACG", 30, [[1, 2, 9], [2, 2]])
    rows = [good, ("A" * 24, *good[1:]), (good[0], "AC", *good[2:]), (*good[:2], 29, good[3]), (*good[:3], [[1, 2, 9], [1, 2]]), (*good[:3], []), (*good[:3], None), (None, *good[1:]), (*good[:3], [[None, None]])]
    df = spark.createDataFrame(rows, "flank_5 string, flank_3 string, mapq int, allele_coverages array<array<int>>")
    assert [r.passes for r in A.variant_filters(df.coalesce(1)).collect()] == [True] + [False] * 8
    some = spark.createDataFrame([("ACGT", "A"), ("ACnT", "A"), (None, "A"), ("A", "N")], "a string, b string")
    assert A.without_n(some, "a", "b").count() == 2


def test_blocks_of_pairs_align_like_single_pairs(monkeypatch):
    rng = random.Random(5)
    turn = str.maketrans("ACGT", "TGCA")
    a = ["".join(rng.choice("ACGTNacgt-R") if rng.random() < 0.2 else rng.choice("ACGT") for _ in range(rng.randrange(40))) for _ in range(120)] + [None, "ACG", "ACGé", "A\0G", "A\1G"]
    b = [s[rng.randrange(5) :][: rng.randrange(1, 30)] + "".join(rng.choice("ACGTN-") for _ in range(rng.randrange(6))) for s in a[:120]] + ["ACG", None, "CGéT", "A\0GT", "A\2G"]
    for rule, size in zip(A.RULES, (512, 1, 7, 512)):
        monkeypatch.setattr(A, "BLOCK_PAIRS", size)
        single = [A.local_alignment(x or "", y or "", rule) for x, y in zip(a, b)]
        assert list(zip(*A.alignments(a, b, rule))) == single
        ways = [[A.local_alignment(x or "", z, rule)[0] for z in (y, y.translate(turn)[::-1], y[::-1], y.translate(turn))] for x, y in zip(a, ((y or "").upper() for y in b))]
        assert list(zip(*A.best_ways(a, b, rule)[:2])) == [(w.index(max(w)), max(w)) for w in ways]


def test_best_orientation_shuffles_nothing_and_aligns_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(A, "local_alignment", None)  # plain pairs don't come one by one
    df = spark.createDataFrame([(i, "ACCTGAGTCAATGCGTTACGGA", "TCCGTAACGCATTGACTCAGGT") for i in range(9)], "id int, a string, b string")
    best = A.align_best_of_four(df, "a", "b", "id", traced=False)
    assert "Exchange" not in best._jdf.queryExecution().executedPlan().toString() and {tuple(r)[1:] for r in best.collect()} == {(1, 44)}


def test_primers_are_masked_without_a_shuffle(spark, monkeypatch):
    monkeypatch.setattr(A, "local_alignment", None)  # plain pairs don't come one by one
    df = spark.createDataFrame([(1, "TTACGTACGTTTTTGGGGTTTT"), (2, None), (3, ""), (4, "ggggttttGGGTTACGTACG"), (5, "TTACGTACG"), (None, "TTACGTACGTTTTTGGGGTTTT")], "id long, seq string")
    out = A.mask_primers(df, {"p": "TTACGTACG", "q": "CCCCC"}, 10)
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    assert {r.id: r.seq for r in out.collect()} == {1: "N" * 9 + "TTTTTGGGGTTTT", 2: None, 3: "", 4: "ggggttttGGG" + "N" * 9, 5: "N" * 9, None: "N" * 9 + "TTTTTGGGGTTTT"}


def test_votes_are_numbers_and_equal_ones_go_to_the_smaller_base(spark):
    refs = spark.createDataFrame([(1, "ACGTé")], "ref_id long, seq string")
    rows = [(1, 9, "AC-GT", "ATCGT", 0, 1, [99, 20, 30, 40, None, 50]), (1, 9, "ACGT", "GC-T", 0, 0, [20, 31, 12]), (1, 9, "é", "é", 4, 0, [15]), (1, 9, "A", "C", 0, 0, None), (1, 1, "A", "A", 0, 0, [99])]
    df = spark.createDataFrame(rows, "ref_id long, score int, a_aligned string, b_aligned string, start_a int, start_b int, qual array<int>")
    voted = A.consensus(refs, df, 10, 5)
    assert "SortAggregate" not in voted._jdf.queryExecution().executedPlan().toString()
    got = {r.pos: (r.ref, r.base, r.quality) for r in voted.collect()}
    assert got == {0: ("A", "A", 20), 1: ("C", "C", 31), 2: ("G", "g", 0), 3: ("T", "T", 50), 4: ("é", "é", 15)}
