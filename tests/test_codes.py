import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandmill.functions.kmer import unpack
from strandmill.operators import codes, kmers


def rc(s):
    return s[::-1].translate(str.maketrans("ACGT", "TGCA"))


def reads(rng, n):
    out = [(None, "ACGTACGTAAACCC", [9] * 14), (1, None, None), (2, "", []), (3, "ACG", [1, 2, 3]), (4, "A" * 5000, None), (5, "acgtn.ACGTTGCA-ACGT", [30] * 19), (6, "ACGTACGTACGT", [30, 2]), (7, "ACGTACGTACGT", [2] * 40), (8, "ACGTéACGTA", [40] * 10)]
    for i in range(10, n):
        s = "".join(rng.choice("ACGTACGTACGTN") for _ in range(rng.randrange(60)))
        out.append((i, s, rng.choice([None, [rng.choice([None, 5, 20]) for _ in s]])))
    return out


def brute(rows, k, cut=0):
    found = {}
    for i, (key, seq, qual) in enumerate(rows):
        m = [c.upper() if c.upper() in "ACGT" else "N" for c in seq or ""]
        if cut:
            for j, q in enumerate((qual or [])[: len(m)]):
                m[j] = "N" if q is not None and q <= cut else m[j]
        m = "".join(m)
        found[i] = [(p, m[p : p + k]) for p in range(len(m) - k + 1) if "N" not in m[p : p + k]]
    return found


@pytest.mark.parametrize("k, cut, block", [(1, 0, 1 << 22), (3, 10, 1 << 22), (11, 0, 100), (21, 0, 1 << 22), (31, 0, 1 << 22)])
def test_codes_of_reads(spark, monkeypatch, k, cut, block):
    monkeypatch.setattr(codes, "BLOCK", block)
    rows = reads(random.Random(k), 120)
    df = spark.createDataFrame([(*r, "clash") for r in rows], "read_id long, seq string, qual array<int>, code string").repartition(3)
    want = brute(rows, k, cut)
    per = Counter((rows[i][0], min(x, rc(x))) for i, found in want.items() for _, x in found)
    got = codes.read_codes(df, k, cut=cut).withColumn("kmer", unpack(F.col("code"), k)).collect()
    assert {(r.read_id, r.kmer): r.n for r in got if r.code is not None} == dict(per)
    assert sorted((r.read_id is None, r.read_id or 0) for r in got if r.code is None) == sorted((rows[i][0] is None, rows[i][0] or 0) for i, found in want.items() if not found)
    total = Counter()
    for (_, x), n in per.items():
        total[x] += n
    assert {r.kmer: r.coverage for r in kmers.count_kmers(df, k, cut).collect()} == dict(total)
    edges = Counter()
    for found in want.values():
        at = dict(found)
        for p, x in found:
            c = min(x, rc(x))
            same = x == c
            edges[c] |= (1 << "ACGT".index(at[p + 1][-1]) + (0 if same else 4) if p + 1 in at else 0) | (1 << 3 - "ACGT".index(at[p - 1][0]) + (4 if same else 0) if p - 1 in at else 0)
    assert {unpacked: e for unpacked, e in ((r.kmer, r.e) for r in codes.neighbours(df, k, cut).groupBy(unpack(F.col("code"), k).alias("kmer")).agg(F.bit_or("edges").alias("e")).collect())} == dict(edges)
    assert codes.read_codes(df.filter("false"), k).count() == 0 and codes.count_codes(df.filter("false"), k).count() == 0


def test_long_kmers_take_the_other_way(spark):
    rows = [(1, "ACGTTGCAAC" * 9), (2, "T" * 50)]
    df = spark.createDataFrame(rows, "read_id long, seq string")
    ref = kmers.count_kmers(df.filter("read_id = 1"), 41)
    assert {r.read_id: (r.n_kmers, r.hits) for r in kmers.hits_per_read(df, ref, 41).collect()} == {1: (50, 50), 2: (10, 0)}
    with pytest.raises(ValueError):
        codes.read_codes(df, 32)
    f, b = codes.rolling_codes(np.array([0, 1, 2, 3, 3], np.uint8), 3)
    assert f.tolist() == [0b000110, 0b011011, 0b101111] and b.tolist() == [0b011011, 0b000110, 0b000001]
