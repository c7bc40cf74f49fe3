from pyspark.sql import functions as F

from strandmill.operators import graph as G, walks


def rc(s):
    return s[::-1].translate(str.maketrans("ACGT", "TGCA"))


MIDDLE = "ACGGATTCAGC"
SEQS = ["TTGACCT" + MIDDLE + "GGAATGT", "CATCGTA" + MIDDLE + "CTTGTCC"]
K = 7


def graph(spark, seqs=SEQS):
    return G.build_graph(spark.createDataFrame(list(enumerate(seqs)), "read_id long, seq string"), K)


def walk_of(df, start):
    return [r.node for r in df.filter(F.col("start") == start).orderBy("dist").collect()]


def test_double_y_and_y_walks(spark):
    g = graph(spark)
    ends = {MIDDLE[:K], MIDDLE[-K:]}
    assert {r.kmer for r in walks.double_y(g).collect()} == {min(x, rc(x)) for x in ends}
    starts = [SEQS[0][:K], rc(SEQS[1][-K:]), SEQS[0][3 : 3 + K]]
    got = walks.y_walks(g, spark.createDataFrame([(x,) for x in starts], "node string"))
    first = SEQS[0][: 7 + K]  # up to the first k-mer of the middle, which is a double Y
    assert walk_of(got, starts[0]) == [first[i : i + K] for i in range(len(first) - K + 1)]
    assert walk_of(got, starts[2]) == [first[i : i + K] for i in range(3, len(first) - K + 1)]
    back = rc(SEQS[1])[: 7 + K]
    assert walk_of(got, starts[1]) == [back[i : i + K] for i in range(len(back) - K + 1)]
    one = graph(spark, [SEQS[0], "CATCGTA" + MIDDLE])  # a way in, but one way out: walked through
    whole = walk_of(walks.y_walks(one, spark.createDataFrame([(SEQS[0][:K],)], "node string")), SEQS[0][:K])
    assert whole == [SEQS[0][i : i + K] for i in range(len(SEQS[0]) - K + 1)]
    assert walks.double_y(g.filter("false")).count() == 0 and walks.y_walks(g, spark.createDataFrame([], "node string")).count() == 0


def test_paths_out_of_a_node(spark):
    g = graph(spark)
    branch = MIDDLE[-K:]
    got = {r.base: r.seq for r in walks.paths_out(g, spark.createDataFrame([(branch,), ("A" * K,)], "node string")).collect()}
    assert got == {"G": (MIDDLE + SEQS[0].split(MIDDLE)[1])[len(MIDDLE) - K + 1 :], "C": (MIDDLE + SEQS[1].split(MIDDLE)[1])[len(MIDDLE) - K + 1 :]}
    circle = "ACGGATTCAG"
    c = graph(spark, [circle + circle[:K]])
    (r,) = walks.paths_out(c, spark.createDataFrame([(circle[2 : 2 + K],)], "node string")).collect()
    assert r.seq == (circle * 3)[3 : 3 + len(circle) + K - 1]


def test_paths_between_two_nodes(spark):
    bubble = graph(spark, ["TTGACCTACGGATTCAGC", "TTGACCTTCGGATTCAGC"])
    node = lambda x: spark.createDataFrame([(x,)], "node string")
    start, end = "TTGACCT", "CGGATTC"
    got = sorted(r.seq for r in walks.paths_between(bubble, node(start), node(end), 20).collect())
    assert got == ["TTGACCTACGGATTC", "TTGACCTTCGGATTC"]
    assert walks.paths_between(bubble, node(start), node(end), 7).count() == 0 and walks.paths_between(bubble, node(start), node(end), 20, 0).count() == 0


def test_paths_between_has_the_joins_of_one_step_in_its_plan(spark):
    bubble = graph(spark, ["TTGACCTACGGATTCAGC", "TTGACCTTCGGATTCAGC"])
    node = lambda x: spark.createDataFrame([(x,)], "node string")
    plan = walks.paths_between(bubble, node("TTGACCT"), node("CGGATTC"), 12)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan
