import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandmill.functions.kmer import pack, unpack, valid_kmer
from strandmill.llm import distinct, heavy, sampling, seen, splitting
from strandmill.llm.frequencies import marked, term_frequencies
from strandmill.llm.kmer_rows import coded


def test_codes_equal_the_column_expressions(spark):
    rng = random.Random(1)
    raw = ["".join(rng.choice("ACGTacgt") for _ in range(21)) for _ in range(200)] + [None, "", " " * 21, " " + "A" * 21 + " ", "A" * 20, "A" * 22, "N" * 21, "A" * 20 + "\n", "é" + "A" * 20, "x" * 100_000]
    df = spark.createDataFrame([(i, k, 7) for i, k in enumerate(raw)], "id int, kmer string, code int")
    mine = {r.id: r.code for r in coded(df.drop("code"), "id").collect()}
    theirs = df.select("id", valid_kmer(F.col("kmer"), 21).alias("c")).filter("c is not null").select("id", "c", pack(F.col("c")).alias("p"), unpack(pack(F.col("c")), 21).alias("u")).collect()
    assert mine == {r.id: r.p for r in theirs} and all(r.c == r.u for r in theirs) and len(theirs) == 201
    assert coded(df.filter("false"), "id").collect() == []


@pytest.mark.parametrize("kind", ["bigint", "string"])
def test_term_frequencies(spark, kind):
    rng = random.Random(2)
    rows = []
    for unit in range(3000):
        term = 5 if rng.random() < 0.4 else rng.choice([None, *range(200)])
        rows.append((term, rng.choice([None, 1, 2, 3, 9]), rng.choice([unit, unit, None]), rng.choice([None, -4, 0, 1, 7]), "x"))
    rows += [r for r in rows if r[2] is not None and rng.random() < 0.2]
    rows.append((*rows[0][:2], 10_001, 3, "x"))
    rows += [(5, 1, 10_002, a, "x") for a in (2, 9, 4)]  # deliveries that disagree: the largest counts
    df = spark.createDataFrame(rows, "t long, rec int, unit long, amount long, edge string").withColumn("t", F.col("t").cast(kind)).repartition(3)
    want = defaultdict(lambda: [0, 0, set()])
    best = {}
    for i, (t, rec, unit, amount, _) in enumerate(rows):
        if t is not None:
            key = (t, rec, ("u", unit) if unit is not None else ("row", i))
            best[key] = max(best.get(key, 0), amount or 0, 0)
    for (t, rec, _), amount in best.items():
        want[t][0] += amount
        want[t][1] += 1
        want[t][2] |= {rec} - {None}
    got = {int(r.term): [r.total, r.units, r.records] for r in term_frequencies(df, "t", "rec", "unit", "amount").collect()}
    assert got == {t: [a, n, len(s)] for t, (a, n, s) in want.items()}
    assert term_frequencies(df.filter("false"), "t", "rec", "unit", "amount").count() == 0
    assert {(r.rare, r.common) for r in marked(term_frequencies(df, "t", "rec", "unit", "amount"), 4).filter("term = 5").collect()} == {(False, True)}


@pytest.mark.parametrize("level", [1 << 17, 1 << 15])
def test_linear_counting_stays_within_its_error(spark, monkeypatch, level):
    monkeypatch.setattr(distinct, "LEVEL", level)
    rng = random.Random(3)
    rows = [(rng.randrange(3), rng.randrange(4), rng.choice([None, 0, 1]), rng.choice([None, 1, rng.randrange(1_000_000), rng.randrange(1_000_000)])) for _ in range(100_000)]
    df = spark.createDataFrame(rows, "day int, dump_id int, colour int, code long")
    levels = distinct.levels_for(100_000 if level > 1 << 15 else 1 << 20)
    cells = distinct.cell_bitmaps(df, ["day", "dump_id", "colour"], "code", levels)
    for keys in (["day"], ["dump_id", "colour"], []):
        true = {tuple(r[k] for k in keys): r.n for r in df.groupBy(*keys).agg(F.countDistinct("code").alias("n")).collect()}
        got = {tuple(r[k] for k in keys): (r.estimate, r.std_error) for r in distinct.merged_counts(cells, keys, levels).collect()}
        assert true.keys() == got.keys()
        assert all(abs(e - true[k]) <= 6 * s + 1 for k, (e, s) in got.items())
        assert all(abs(s / e - distinct.relative_error(e, levels)) < 0.001 for e, s in got.values())


def test_errors_hold_at_every_size():
    sizes = [10**x for x in range(1, 16)]
    assert [distinct.levels_for(n) for n in (0, 1, 1 << 18, (1 << 18) + 1, 1 << 40)] == [1, 1, 1, 2, 23]
    assert max(distinct.relative_error(n / d, distinct.levels_for(n)) for n in sizes for d in (1, 2, 3, 7, 1000)) <= 0.005
    rng = np.random.default_rng(9)  # the estimator on random bits, at a size that needs many levels
    n, levels = 300_000_000, distinct.levels_for(1 << 32)
    share = [2.0 ** -(i + 1) for i in range(levels - 1)] + [2.0 ** -(levels - 1)]
    got = []
    for _ in range(20):
        ones = [distinct.LEVEL - int(rng.binomial(distinct.LEVEL, np.exp(-rng.binomial(n, s) / distinct.LEVEL))) for s in share]
        base = next(i for i in range(levels) if ones[i] <= distinct.LEVEL * -np.expm1(-distinct.LOAD))
        got.append(2**base * sum(-distinct.LEVEL * np.log1p(-x / distinct.LEVEL) for x in ones[base:]))
    assert np.std(np.array(got) / n - 1) < 2 * distinct.relative_error(n, levels) and abs(np.mean(got) / n - 1) < distinct.relative_error(n, levels)


@pytest.mark.parametrize("planes, codes", [(1 << 26, 1 << 15), (1 << 14, 64)])
def test_deviating_reports_include_borderline_ones(spark, monkeypatch, planes, codes):
    monkeypatch.setattr(distinct, "PLANES", planes)
    monkeypatch.setattr(distinct, "CODES", codes)
    rng = random.Random(4)
    rows = [(rng.choice([None, *range(9)]), rng.choice([None, *range(4)]), rng.choice([None, 0, 1]), rng.randrange(3000)) for _ in range(6000)]
    df = spark.createDataFrame(rows, "day int, dump_id int, colour int, code long")
    sets, off, true = [], set(), {}
    for i in range(150):
        members, lo, hi = rng.choice([[], [0], [1, 1, 2], [0, 1, 2, 3], [9], [None, 2]]), rng.randrange(9), rng.randrange(9)
        d = [len({c for day, dump, col, c in rows if dump is not None and day is not None and dump in members and lo <= day <= hi and (x is None or col == x)}) for x in (None, 0, 1)]
        r = [None if rng.random() < 0.2 else rng.choice([n, n + n // 10, n + n // 10 + 1, n - n // 10, n - n // 10 - 1, 2 * n, 0]) for n in d]
        sets.append((i, members, lo, hi, *r))
        true[i] = d
        if any(x is not None and abs(x - n) * 10 > n for x, n in zip(r, d)):
            off.add(i)
    cells = distinct.cell_bitmaps(df, ["day", "dump_id", "colour"], "code", 2)
    s = spark.createDataFrame(sets, "set_id long, members array<int>, from_day int, to_day int, r long, r_0 long, r_1 long")
    got = distinct.deviating(df, cells, s, 2)
    assert {r.set_id for r in got.filter("off").collect()} == off and got.count() == 150 and got.filter("checked").count() > 0
    exact = {r.set_id: [r.distinct, r.distinct_0, r.distinct_1] for r in distinct.exact_counts(df, cells, s, 3000).collect()}
    assert all(exact.get(i, [0, 0, 0]) == d for i, d in true.items())
    estimates = {r.set_id: [r.distinct, r.distinct_0, r.distinct_1] for r in distinct.set_counts(cells, s, 2).collect()}
    assert all(abs(x - y) <= 6 * distinct.relative_error(3000, 2) * y + 3 for i, d in true.items() for x, y in zip(estimates.get(i, [0, 0, 0]), d))
    none = distinct.deviating(df.filter("false"), cells.filter("false"), s, 2)
    assert {r.set_id for r in none.filter("off").collect()} == {x[0] for x in sets if any(r for r in x[4:] if r)}


def test_heavy_hitters(spark):
    rng = random.Random(5)
    rows = [(u, rng.choice([7, 7, 8, 9, None, *range(100, 5000)]), rng.choice([0, 1, 5])) for u in range(20_000)]
    rows += [(u, c, 3000) for u, c in ((30_000, 42), (30_001, 43))]
    rows += rng.sample(rows, 2000)
    df = spark.createDataFrame(rows, "unit long, code long, amount long")
    total = defaultdict(int)
    for _, c, a in set(rows):
        total[c] += a if c is not None else 0
    whole = sum(total.values())
    assert {(r.code, r.total) for r in heavy.heavy_hitters(df, 42, 0.005).collect()} == {(c, n) for c, n in total.items() if c is not None and n >= 0.005 * whole}
    assert heavy.heavy_hitters(df.filter("false"), 42, 0.005).collect() == []
    assert heavy.heavy_hitters(df.withColumn("amount", F.lit(0).cast("long")), 42, 0.005).collect() == []
    for bits in (41, 42, 62):
        codes = np.random.default_rng(1).integers(0, 1 << bits, 1000)
        assert (heavy.Mix(bits).invert(heavy.Mix(bits)(codes)) == codes).all()


@pytest.mark.parametrize("buffer", [200_000, 500])
def test_fixed_size_samples(spark, monkeypatch, buffer):
    monkeypatch.setattr(sampling, "BUFFER", buffer)
    rows = [(i % 20_000, 1 if i % 20_000 < 9000 else (i % 20_000) % 5) for i in range(24_000)] + [(None, 1)] * 5
    records = spark.createDataFrame(rows, "record_id long, part int").repartition(5)
    jobs = [(1, None, 4, 100), (2, 1, 4, 50), (3, 1, 5, 10_000_000), (4, 99, 5, 10), (5, 1, None, 10), (6, 1, 5, 0), (7, None, -3, 3000), (8, 2, 1, None), (9, None, 9, 20_000), (10, None, 9, 19_999)]
    df = spark.createDataFrame(jobs, "job_id int, part int, seed long, sample_size long")
    got = sampling.fixed_size_samples(records, df).collect()
    count = defaultdict(int)
    for r in got:
        count[r.job_id] += 1
    one = sum(p == 1 for _, p in set(rows) if _ is not None)
    assert count == {1: 100, 2: 50, 3: one, 7: 3000, 9: 20_000, 10: 19_999}
    assert len({(r.job_id, r.record_id) for r in got}) == len(got) and {r.job_id: r.level for r in got}[1] > 0
    assert {(r.job_id, r.record_id) for r in sampling.fixed_size_samples(records.repartition(2), df).collect()} == {(r.job_id, r.record_id) for r in got}
    for job, size in ((1, 100), (7, 3000)):  # uniform: the mean of the numbers drawn is near the middle
        ids = [r.record_id for r in got if r.job_id == job]
        assert abs(np.mean(ids) - 9999.5) < 5 * 20_000 / (12 * size) ** 0.5
    assert sampling.fixed_size_samples(records.filter("false"), df).count() == 0
    assert sampling.fixed_size_samples(records, df.filter("false")).count() == 0


def greedy(seq, limit, unit):
    """Piece by piece from the left."""
    size, windows, i = len(seq), [], 0
    while i < size:
        if seq[i] in "ACGTacgt":
            j = i
            while j < size and seq[j] in "ACGTacgt":
                j += 1
            if j - i >= unit:
                windows.append((i, j))
            i = j
        else:
            i += 1
    if size <= limit:
        return [(0, size, None)], windows
    cuts = {0, size} | {x for w in windows for x in w}
    edges = [0, *[x for w in windows for x in w], size]
    for a, z in zip(edges[::2], edges[1::2]):
        cuts |= set(range(a, z, limit)) if z - a > limit else set()
    out, p = [], 0
    while p < size:
        legal = [c for c in cuts if p < c <= p + limit]
        if legal:
            out.append((p, max(legal), None))
            p = max(legal)
        else:
            w = next(i for i, (a, z) in enumerate(windows) if a <= p < z)
            out.append((p, p + limit, w))
            p = p + limit - min(unit, limit - 1)
    return out, windows


def test_splitting_matches_greedy(spark):
    rng = random.Random(6)
    rows = [(0, None, 5, 3), (1, "", 5, 3), (2, "ACGT", None, 3), (3, "ACGT" * 10, 0, 3), (4, "ACGT" * 10, 7, None), (5, "N" * 50, 7, 3), (6, "A" * 100_000, 1000, 21), (7, "acgtN" * 20_000, 999, 4), (8, "A" * 30, 4, 9)]
    rows += [(i, "".join(rng.choice(["A", "CG", "T" * rng.randrange(1, 40), "N", "-" * rng.randrange(1, 30)]) for _ in range(rng.randrange(1, 40))), rng.randrange(1, 60), rng.randrange(1, 12)) for i in range(10, 400)]
    df = spark.createDataFrame(rows + rows[::3], "read_id long, seq string, max_chunk int, kmer_size int").withColumn("start", F.lit("clash"))
    got = defaultdict(list)
    for r in splitting.split_oversized(df).collect():
        got[r.read_id].append((r.piece_no, r.start, r.end, r.cut_window, r.piece))
    for i, seq, limit, unit in rows:
        limit, unit = limit if limit and limit > 0 else 1 << 31, unit if unit and unit > 0 else 1
        want, _ = greedy(seq or "", limit, unit)
        assert sorted(got[i]) == [(n, a, z, w, seq and seq[a:z]) for n, (a, z, w) in enumerate(want)], (i, seq)
        assert all(z - a <= limit for a, z, _ in want)
    assert splitting.split_oversized(df.filter("false")).count() == 0


def first_numbers(rows):
    first = {}
    for s, k in rows:
        if k is not None and s is not None:
            first[k] = min(s, first.get(k, s))
    return first


@pytest.mark.parametrize("backwards", [False, True])
def test_seen_before_over_batches_and_resuming(spark, tmp_path, monkeypatch, backwards):
    monkeypatch.setattr(seen, "PACK", 16)
    rng = random.Random(7)
    rows = [(i, rng.choice([None, 1, 1, 1, *range(50)])) for i in range(2000)] + [(None, 3)]
    schema = "seq_no long, key long"
    told = lambda flags: {r.seq: r.seen_before for r in seen.settled(flags).collect()}
    first = first_numbers(rows)
    want = {s: s != first[k] for s, k in rows if k is not None and s is not None}
    parts = [rows[:700], rows[700:1300], rows[1300:]]
    now, stream = str(tmp_path / "now"), None
    got, displaced = [], 0
    for part in reversed(parts) if backwards else parts:  # three calls on one checkpoint
        spark.createDataFrame(part, schema).withColumn("bucket", F.lit("clash")).coalesce(2).write.mode("append").parquet(now)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(now)
        flags = seen.seen_before(stream, "key", "seq_no", 5, str(tmp_path / "state"))
        got += seen.repeats(flags).collect()
        displaced += flags.filter(F.col("kind") == seen.DISPLACED).count()
    assert sorted(r.seq for r in got) == sorted(s for s, seen_ in want.items() if seen_)  # each repeat once
    assert displaced > 0 or not backwards
    with pytest.raises(ValueError, match="buckets"):
        seen.seen_before(stream, "key", "seq_no", 6, str(tmp_path / "state"))
    whole = seen.seen_before(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(now), "key", "seq_no", 3)
    assert told(whole) == want and whole.filter(F.col("kind") != seen.DISPLACED).count() == len(want)
    spark.createDataFrame([], schema).write.parquet(str(tmp_path / "none"))
    assert seen.seen_before(spark.readStream.schema(schema).parquet(str(tmp_path / "none")), "key", "seq_no", 3).count() == 0


def test_wrong_answers_are_counted(spark):
    rng = random.Random(8)
    rows = [(i, rng.choice([None, *range(20)])) for i in range(300)]
    records = spark.createDataFrame(rows, "seq_no long, code long")
    first = first_numbers(rows)
    good = [(k, s, s != first[k]) for s, k in rows if k is not None]
    rate = lambda flags: seen.error_rate(spark.createDataFrame(flags, "key long, seq long, seen_before boolean"), records, "code", "seq_no").first()
    assert tuple(rate(good)) == (len(good), len(good) - 20, 0, 0.0)
    last = {k: s for k, s, _ in good}
    assert rate([(k, s, s != last[k]) for k, s, _ in good]).n_wrong == 40
    assert rate([(k, s, True) for k, s, _ in good]).n_wrong == 20 and rate([(k, s, False) for k, s, _ in good]).n_wrong == len(good) - 20
    assert rate(good[1:]).n_wrong >= 1 and rate([*good, (99, 7, False)]).n_wrong >= 1
    lost = [(k, s, s != first[k]) for k, s, _ in good if k != 3]  # a key that the state lost altogether
    assert rate(lost).n_wrong == sum(k == 3 for k, *_ in good)


def test_a_state_that_forgets_gives_a_rate_above_zero(spark, tmp_path):
    rows = [(i, i % 10) for i in range(100)]
    for n, part in enumerate((rows[:50], rows[50:])):
        spark.createDataFrame(part, "seq_no long, key long").coalesce(1).write.parquet(str(tmp_path / str(n)))
    told = [seen.settled(seen.seen_before(spark.readStream.schema("seq_no long, key long").parquet(str(tmp_path / str(n))), "key", "seq_no", 2)) for n in (0, 1)]  # each with a state of its own
    rate = seen.error_rate(told[0].unionByName(told[1]), spark.createDataFrame(rows, "seq_no long, key long"), "key", "seq_no").first()
    assert rate.n_wrong == 10 and rate.wrong_rate == 0.1
