import random

import pytest
from pyspark.sql import functions as F

from strandmill.operators import graph as G

COMP = str.maketrans("ACGT", "TGCA")


def rc(x):
    return x.translate(COMP)[::-1]


def canon(x):
    return min(x, rc(x))


def reads_df(spark, seqs):
    return spark.createDataFrame(list(enumerate(seqs)), "read_id long, seq string")


def query(spark, tmp_path, name, seqs):
    """The rows of a query over a table of these reads."""
    rows = [(i, 1, f"r{i}", x, None) for i, x in enumerate(seqs)]
    spark.createDataFrame(rows, "read_id long, file_id int, name string, seq string, qual array<int>").write.mode("overwrite").parquet(str(tmp_path / "reads_fastq.parquet"))
    return G.QUERIES[name](spark, str(tmp_path)).collect()


def random_reads(seed, *sizes):
    rng = random.Random(seed)
    return ["".join(rng.choice("ACGT") for _ in range(n)) for n in sizes]


def brute(seqs, k):
    """Coverage of canonical k-mers, and the successors of every oriented k-mer."""
    cov, nxt = {}, {}
    for s in seqs:
        for run in "".join(c if c in "ACGT" else " " for c in (s or "").upper()).split():
            for i in range(len(run) - k + 1):
                cov[canon(run[i : i + k])] = cov.get(canon(run[i : i + k]), 0) + 1
            for i in range(len(run) - k):
                a, b = run[i : i + k], run[i + 1 : i + k + 1]
                nxt.setdefault(a, set()).add(b)
                nxt.setdefault(rc(b), set()).add(rc(a))
    return cov, nxt


def brute_unitigs(cov, nxt):
    nodes = set(cov) | {rc(x) for x in cov}
    one = {a: next(iter(b)) for a, b in nxt.items() if len(b) == 1 and len(nxt.get(rc(next(iter(b))), ())) == 1}
    into = {b: a for a, b in one.items()}
    out, seen = set(), set()
    for n in nodes:
        if n in into or n in seen:
            continue
        path = [n]
        while path[-1] in one:
            path.append(one[path[-1]])
        seen |= set(path)
        seq = path[0] + "".join(p[-1] for p in path[1:])
        out.add(min(seq, rc(seq)))
    return out, nodes - seen


def test_edges_of_three_reads(spark):
    rows = {r.kmer: (r.coverage, r.edges) for r in G.build_graph(reads_df(spark, ["AAAAAAAA", "GGCT", "TAGG", None, "", "AC"]), 3).collect()}
    assert set(rows) == {"AAA", "AGC", "AGG", "CTA", "GCC"} and rows["AAA"][0] == 6
    assert rows["AAA"][1] == 1 | 8 << 4 and rows["AGC"][1] == 2 and rows["AGG"][1] == 1 << 4 and rows["CTA"][1] == 4 << 4 and rows["GCC"][1] == 8 << 4


@pytest.mark.parametrize("seed", range(3))
def test_unitigs_components_and_links(spark, seed):
    rng, k = random.Random(seed), 5
    base = ["".join(rng.choice("ACGT") for _ in range(60)) for _ in range(4)]
    seqs = base + [b[:30] + "N" + b[31:] for b in base] + [rc(base[0])[:40], "ACGTT" * 4, "A" * 9]
    cov, nxt = brute(seqs, k)
    nodes = G.build_graph(reads_df(spark, seqs), k)
    assert {r.kmer: r.coverage for r in nodes.collect()} == cov
    assert {(r.src, r.dst) for r in G.links(nodes).collect()} == {(a, b) for a, s in nxt.items() for b in s}
    want, rest = brute_unitigs(cov, nxt)
    got = G.unitigs(nodes).collect()
    assert sorted(r.seq for r in got if not r.cyclic) == sorted(want)
    circles = {canon(x) for x in rest}
    found = [canon(r.seq[i : i + k]) for r in got if r.cyclic for i in range(r.n_kmers)]
    assert set(found) == circles and len(found) <= 2 * len(circles)
    label = {x: x for x in cov}
    for _ in cov:
        for a, s in nxt.items():
            for b in s:
                low = min(label[canon(a)], label[canon(b)])
                label[canon(a)] = label[canon(b)] = low
    assert {r.kmer: r.component for r in G.components(nodes).collect()} == label


def test_a_circle_is_found_once(spark):
    circle = "ACCTGAGTCAATGCGTTAC"
    nodes = G.build_graph(reads_df(spark, [circle + circle[:7]]), 7)
    rows = G.unitigs(nodes).collect()
    assert [r.cyclic for r in rows] == [True] and rows[0].n_kmers == len(circle)


def test_tip_and_low_coverage(spark):
    nodes = G.build_graph(reads_df(spark, ["GCGTCCCAT", "CGTTT"]), 3)
    cut = G.clip_tips(nodes, 3, 3)
    assert {r.kmer for r in cut.collect()} == {r.kmer for r in nodes.collect()} - {"AAA", "AAC"}
    assert "GGACGC" in {x for r in G.unitigs(cut).collect() for x in (r.seq[:6], r.seq[-6:], rc(r.seq)[:6])}
    low = G.remove_low_coverage(G.build_graph(reads_df(spark, ["ACGGT", "ACGG", "TTACG"]), 3), 1)
    alive = {r.kmer for r in low.collect()}
    assert all(r.dst_kmer in alive for r in G.links(low).collect())


def test_bubble_is_found_and_removed(spark):
    left, right = "ACCTGAGTCAATG", "GGATCTTGCCTAA"
    seqs = [left + "A" + right] * 3 + [left + "C" + right]
    nodes = G.build_graph(reads_df(spark, seqs), 5)
    found = G.bubbles(nodes, 5, 51).collect()
    assert len(found) == 1
    paths = G.find_bubbles(nodes, 5).collect()
    assert {frozenset((r.a_seq, r.b_seq)) for r in paths} >= {frozenset((left[-5:] + x + right[:5] for x in "AC"))} and len(paths) == 2
    assert G.bubble_text(G.find_bubbles(nodes, 5)).filter("value LIKE '%a%'").count() >= 1
    means = {r.seq: r.mean_coverage for r in G.bubble_colours(G.find_bubbles(nodes, 5), nodes.withColumn("colour", F.lit(0)), 5).collect()}
    assert sorted(means.values()) == [1.0, 1.0, 3.0, 3.0]
    alive = {r.kmer for r in G.remove_bubbles(nodes, 5).collect()}
    assert alive == {canon(s[i : i + 5]) for s in seqs[:1] for i in range(len(s) - 4)}


def test_walks_neighbours_and_paths(spark):
    seqs = ["ACCTGAGTCAATGAGGATC"] * 3 + ["CAATGCC"]
    nodes = G.build_graph(reads_df(spark, seqs), 5)
    start = spark.createDataFrame([("ACCTG", canon("ACCTG"))], "node string, kmer string")
    walk = sorted(G.coverage_walks(nodes, start).collect(), key=lambda r: r.dist)
    assert walk[0].node + "".join(r.node[-1] for r in walk[1:]) == seqs[0]
    assert [r.dist for r in walk] == list(range(len(walk)))
    near = {r.kmer: r.depth for r in G.neighbourhood(nodes, start, depth=3).collect()}
    assert near == {canon(seqs[0][i : i + 5]): i for i in range(4)}
    assert {r.seq for r in G.paths_from(nodes, start, 2).collect()} == {seqs[0][: 5 + i] for i in range(3)}
    parts = G.components(nodes)
    assert {r.seq for r in G.consensus(nodes, parts).collect()} <= {seqs[0], rc(seqs[0])}


def test_empty_graph(spark):
    nodes = G.build_graph(reads_df(spark, ["N", None]), 5)
    assert G.unitigs(nodes).count() == 0 and G.components(nodes).count() == 0 and G.links(nodes).count() == 0
    assert G.export_lines(nodes, "gml").count() == 0 and all(len(G.wrapping(s)) == 2 for s in ("dot", "gexf", "ubigraph"))
    assert G.pair_signatures(reads_df(spark, ["ACGTACC"]), G.build_graph(reads_df(spark, ["ACGTACC"]), 5), 5).filter(F.col("bits") == 1).count() == 3


def test_every_part_has_a_consensus(spark, tmp_path):
    seqs = random_reads(1, 15, 20, 63, 101)
    rows = query(spark, tmp_path, "component_consensus", seqs)
    assert sorted((canon(r.seq), r.size) for r in rows) == sorted((canon(x), len(x) - 14) for x in seqs)


def test_walks_and_neighbourhoods_of_every_part(spark, tmp_path):
    seqs = random_reads(2, 30, 35, 40, 45, 50, 55, 60)
    walks = query(spark, tmp_path, "coverage_walks", seqs)
    assert {canon(r.node) for r in walks} == {canon(x[i : i + 15]) for x in seqs for i in range(len(x) - 14)}
    assert {r.dist for r in walks if r.node == r.start} == {0} and len({canon(r.start) for r in walks}) == len(seqs)
    near = query(spark, tmp_path, "neighbourhood", seqs)
    assert len({r.start for r in near}) == len(seqs)
    for x in seqs:
        at = {canon(x[i : i + 15]): i for i in range(len(x) - 14)}
        [start] = {r.start for r in near} & set(at)
        assert {r.kmer: r.depth for r in near if r.start == start} == {m: abs(i - at[start]) for m, i in at.items() if abs(i - at[start]) <= 10}


def test_each_start_has_its_own_limit(spark):
    seqs = random_reads(3, 60, 60)
    nodes = G.build_graph(reads_df(spark, seqs), 15)
    starts = spark.createDataFrame([(canon(x[:15]),) for x in seqs], "kmer string")
    near = G.neighbourhood(nodes, starts, depth=10, most=6).collect()
    assert {(r.start, r.kmer, r.depth) for r in near} == {(canon(x[:15]), canon(x[i : i + 15]), i) for x in seqs for i in range(6)}


def test_pair_links_look_at_whole_reads(spark, tmp_path):
    left, right, x, y = random_reads(4, 40, 40, 21, 21)
    seqs = [left + x + right, left + y + right, left[:17], None, "A" * 14]
    cov, nxt = brute(seqs, 15)
    want, _ = brute_unitigs(cov, nxt)
    unit = {canon(u[i : i + 15]): n for n, u in enumerate(want) for i in range(len(u) - 14)}
    pairs = {}
    for s in filter(None, seqs):
        mers = [unit[canon(s[i : i + 15])] for i in range(len(s) - 14)]
        h = (len(mers) + 1) // 2
        for p in {(a, b) for a in mers[:h] for b in mers[h:] if a != b}:
            pairs[p] = pairs.get(p, 0) + 1
    rows = query(spark, tmp_path, "pair_links", seqs)
    assert sorted(r.n for r in rows) == sorted(pairs.values()) and len({(r.a, r.b) for r in rows}) == len(pairs)
    got = {u for r in rows for u in (r.a, r.b)}
    assert len(got) == len({u for p in pairs for u in p})


def test_nested_tips_go_in_as_many_rounds_as_they_need(spark, tmp_path):
    rng, [main] = random.Random(5), random_reads(5, 200)
    leaves = [main[80:100]]
    for level in range(4):  # one branch off the main path that forks three times, five k-mers a level
        taken = main[100] if level == 0 else ""
        leaves = [x + c + "".join(rng.choice("ACGT") for _ in range(4)) for x in leaves for c in [y for y in "ACGT" if y != taken][: 1 if level == 0 else 2]]
    seqs = [main] * 3 + leaves
    nodes = G.build_graph(reads_df(spark, seqs), 15)
    with pytest.warns(UserWarning, match="2 rounds"):
        early = G.clip_tips(nodes, 15, 30, rounds=2).count()
    rows = {r.kmer for r in query(spark, tmp_path, "clipped_tips", seqs)}
    assert rows == {canon(main[i : i + 15]) for i in range(len(main) - 14)} and len(rows) < early


def test_the_query_returns_circles(spark, tmp_path):
    [circle, line] = random_reads(6, 40, 50)
    rows = query(spark, tmp_path, "unitigs", [circle + circle[:15], line])
    assert sorted(r.n_kmers for r in rows) == [36, 40]
    [found] = [r.seq for r in rows if r.n_kmers == 40]
    assert {canon(found[i : i + 15]) for i in range(40)} == {canon((circle * 2)[i : i + 15]) for i in range(40)}


def test_parts_are_labelled_in_one_task_or_after_contraction(spark, monkeypatch):
    rng = random.Random(4)
    names = [f"v{i:03d}" for i in rng.sample(range(1000), 120)]
    pairs = [*zip(names[:60], names[1:60]), *[tuple(rng.sample(names[60:100], 2)) for _ in range(30)], (names[3], names[3])]
    label = {n: n for n in names}
    for _ in names:
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    v, w = spark.createDataFrame([(n,) for n in names], "v string"), spark.createDataFrame(pairs, "v string, w string")
    written = []
    monkeypatch.setattr(G, "measured", lambda *a, _m=G.measured, **k: written.append(a[1]) or _m(*a, **k))
    for most in (G.TOGETHER, 20, 0):
        monkeypatch.setattr(G, "TOGETHER", most)
        written.clear()
        assert {r.v: r.label for r in G.connected(v, w).collect()} == label
        assert most < 100 or len(written) == 1  # a long path takes no rounds
    assert G.connected(v, w.filter("false")).filter("v = label").count() == len(names)


def test_a_neighbourhood_is_written_once_a_step_and_the_links_once(spark, monkeypatch):
    seq = "TTGACCTACGGATTCAGCATCGTA"
    g = G.build_graph(spark.createDataFrame([(1, seq)], "read_id long, seq string"), 7)
    written = []
    for name in ("materialise", "measured"):
        monkeypatch.setattr(G, name, lambda *a, _f=getattr(G, name), **k: written.append(a[1]) or _f(*a, **k))
    start = min(seq[:7], seq[:7][::-1].translate(str.maketrans("ACGT", "TGCA")))
    got = G.neighbourhood(g, spark.createDataFrame([(start,)], "kmer string"), 3)
    assert sorted(r.depth for r in got.collect()) == [0, 1, 2, 3]
    assert written == ["ways"] + ["near"] * 4


def brute_consensus(cov, nxt):
    """Of each part its size and the walks to both sides of its seed."""
    part = {}
    for x in sorted(cov):
        if x not in part:
            part[x], todo = x, [x]
            while todo:
                y = todo.pop()
                for z in map(canon, nxt.get(y, set()) | nxt.get(rc(y), set())):
                    if z not in part:
                        part[z] = x
                        todo.append(z)
    for name in set(part.values()):
        own = [x for x in part if part[x] == name]
        seed = min(own, key=lambda x: (-cov[x], len(nxt.get(x, ())) + (len(nxt.get(rc(x), ())) if x != rc(x) else 0), x))
        tails = []
        for x in (seed, rc(seed)):
            seen, tail = {seed}, ""
            while nxt.get(x):
                x = min(nxt[x], key=lambda y: (-cov[canon(y)], y[-1]))
                if canon(x) in seen:
                    break
                seen.add(canon(x))
                tail += x[-1]
            tails.append(tail)
        yield name, len(own), rc(tails[1]) + seed + tails[0]


@pytest.mark.parametrize("k", (4, 5, 7, 33))
def test_consensus_of_branched_parts_in_a_task_and_by_joins(spark, monkeypatch, k):
    seqs = [f"{x}N{x[:k + 9]}N{y[:k]}{x[20:]}" for x in random_reads(k, *[k + 30] * 6) for y in [x[::-1]]] + ["ACG" * 12, "A" * 40, "CA" * 20]
    cov, nxt = brute(seqs, k)
    want = sorted(brute_consensus(cov, nxt))
    nodes = G.materialise(G.build_graph(reads_df(spark, seqs), k))
    parts = G.components(nodes)
    for walked in (G.WALKED, 30) if k == 7 else (G.WALKED,):
        monkeypatch.setattr(G, "WALKED", walked)
        assert sorted(map(tuple, G.consensus(nodes, parts).collect())) == want
        assert sorted(map(tuple, G.consensus(nodes, parts, 10).collect())) == [x for x in want if x[1] >= 10]


def test_parts_that_a_task_holds_are_walked_in_batches(spark, monkeypatch):
    monkeypatch.setattr(G, "BULK", 8)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        seqs = random_reads(8, *range(15, 60, 3))
        nodes = G.materialise(G.build_graph(reads_df(spark, seqs), 13))
        rows = G.consensus(nodes, G.components(nodes)).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(map(tuple, rows)) == sorted(brute_consensus(*brute(seqs, 13)))


def test_a_consensus_of_any_length_is_whole_and_takes_no_rounds(spark, monkeypatch):
    [seq] = random_reads(9, 200_100)
    nodes = G.materialise(G.build_graph(reads_df(spark, [seq]), 31))
    written = []
    for name in ("materialise", "measured"):
        monkeypatch.setattr(G, name, lambda *a, _f=getattr(G, name), **k: written.append(a[1]) or _f(*a, **k))
    [row] = G.consensus(nodes, G.components(nodes)).collect()
    assert row.size == 200_070 and canon(row.seq) == canon(seq)
    assert sorted(written) == ["labels", "ways"]
