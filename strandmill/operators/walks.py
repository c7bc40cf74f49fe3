"""Walks through branches of a graph: past ambiguous ways in, along every way out, and between two nodes."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from strandmill.functions import kmer as K
from strandmill.operators import graph as G
from strandmill.runtime import materialise


def double_y(nodes: DataFrame) -> DataFrame:
    """``(kmer)``: both ends of each unbranched path of two or more k-mers that branches beyond either end: Y this way and Y the other."""
    ends = G.unitigs(nodes).filter("n_kmers > 1 AND left_edges > 1 AND right_edges > 1")
    return ends.select(F.explode(F.array("head", "tail")).alias("node")).select(K.canonical(F.col("node")).alias("kmer")).distinct()


def y_walks(nodes: DataFrame, starts: DataFrame, longest: int = 200_000) -> DataFrame:
    """``(start, dist, node)``: from each oriented start on as long as there is one way out, however many ways in the next node has.

    A walk ends at a double Y, which is its last node, at a branch, a blunt end, ``longest`` nodes or a k-mer of its own.
    """
    marked = double_y(nodes)
    ways = G.links(nodes).join(nodes.select(F.col("kmer").alias("dst_kmer")), "dst_kmer", "left_semi").join(marked, "kmer", "left_anti")
    one = ways.groupBy("src").agg(F.min("dst").alias("to"), F.count("*").alias("n")).filter("n = 1")
    return G.follow(one.select(F.col("src").alias("node"), "to"), starts, longest)


def paths_out(nodes: DataFrame, starts: DataFrame) -> DataFrame:
    """``(start, base, seq)``: for each of the up to four ways out of an oriented node, the unbranched path behind it to its end, the start left out.

    A path that leads round in a circle ends before it comes back to the node it was entered at.
    """
    m = materialise(G.unitig_members(nodes), "members")
    whole = m.groupBy("head").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("dist", "node"))), lambda x: F.when(x["dist"] > 0, F.right(x["node"], F.lit(1))).otherwise(x["node"])), "").alias("whole"))
    ways = G.links(nodes).join(starts.select(F.col("node").alias("src")).distinct(), "src").select(F.col("src").alias("start"), "base", F.col("dst").alias("node"))
    at = ways.join(m.select("node", "head", "dist", "cyclic"), "node").join(whole, "head")
    place, k = (F.col("dist") + 1).cast("int"), F.length("start")
    rest = F.col("whole").substr(place, F.length("whole"))
    round_ = F.when(F.col("cyclic"), F.col("whole").substr(k, F.col("dist").cast("int"))).otherwise(F.lit(""))
    return at.select("start", "base", F.concat(rest, round_).alias("seq"))


def paths_between(nodes: DataFrame, starts: DataFrame, ends: DataFrame, steps: int, complexity: int = 8) -> DataFrame:
    """``(start, end, seq, steps)``: all paths of 1 to ``steps`` edges from one oriented node to another, past at most ``complexity`` branching nodes.

    The start counts as branching if it is. Both limits are parameters of the search: paths multiply at each branching node, so they bound the work of a start.
    """
    ways = G.links(nodes).join(nodes.select(F.col("kmer").alias("dst_kmer")), "dst_kmer", "left_semi").select(F.col("src").alias("at"), "dst", "base")
    ways = ways.join(G._oriented(nodes).select(F.col("node").alias("at"), (F.col("outs") > 1).cast("int").alias("branches")), "at")
    ways = materialise(ways, "ways")
    goals = materialise(ends.select(F.col("node").alias("at")).distinct().withColumn("ends", F.lit(True)), "goals")
    front = starts.select(F.col("node").alias("start"), F.col("node").alias("at"), F.col("node").alias("seq"), F.lit(0).alias("passed"))
    found = []
    for i in range(1, steps + 1):  # every step is a written table, so a plan has the joins of one step
        front = front.join(ways, "at").select("start", F.col("dst").alias("at"), F.concat("seq", "base").alias("seq"), (F.col("passed") + F.col("branches")).alias("passed")).filter(F.col("passed") <= complexity)
        front = materialise(front.join(goals, "at", "left"), "front")
        found.append(front.filter("ends").select("start", F.col("at").alias("end"), "seq", F.lit(i).alias("steps")))
        front = front.drop("ends")
    return reduce(DataFrame.unionByName, found)


def _branches(nodes: DataFrame) -> DataFrame:
    return G._oriented(nodes).filter("outs > 1").select("node")


_RC = "reverse(translate({x}, 'ACGT', 'TGCA'))"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "double_y": lambda s, d: double_y(G._graph(s, d)),
    "y_walks": lambda s, d: (lambda g: y_walks(g, G._both_ways(G._starts(g))))(G._graph(s, d)),
    "paths_out": lambda s, d: (lambda g: paths_out(g, _branches(g)))(G._graph(s, d)),
    "paths_between": lambda s, d: (lambda g: paths_between(g, _branches(g), _branches(g), 12, 3))(G._graph(s, d)),
}
_DOUBLE = f""", ye AS MATERIALIZED (SELECT DISTINCT least(x, {_RC.format(x="x")}) AS kmer FROM (SELECT unnest([head, tail]) AS x FROM uni WHERE n_kmers > 1 AND left_edges > 1 AND right_edges > 1))
"""
SQL = {
    "double_y": G._WALK_SQL + _DOUBLE + "SELECT kmer FROM ye",
    "y_walks": G._WALK_SQL + G._PARTS_SQL + _DOUBLE + f""", one AS MATERIALIZED (SELECT src, dst FROM lk JOIN o ON src = node WHERE outs = 1 AND lk.kmer NOT IN (SELECT kmer FROM ye)),
yw("start", dist, node, seen) AS (SELECT x, CAST(0 AS BIGINT), x, [least(x, {_RC.format(x="x")})] FROM (SELECT kmer AS x FROM seed UNION SELECT {_RC.format(x="kmer")} FROM seed)
  UNION ALL SELECT "start", dist + 1, dst, list_append(seen, least(dst, {_RC.format(x="dst")})) FROM yw JOIN one ON src = node WHERE NOT list_contains(seen, least(dst, {_RC.format(x="dst")})))
SELECT "start", dist, node FROM yw""",
    "paths_out": G._WALK_SQL + """, ends AS MATERIALIZED (SELECT head, seq FROM walk ANTI JOIN single ON tail = src) SELECT node AS "start", base, seq FROM o JOIN lk ON node = src JOIN ends ON dst = head WHERE outs > 1""",
    "paths_between": G._WALK_SQL + """, bw AS (SELECT node AS "start", node AS at_, node AS seq, 0 AS steps, 0 AS passed FROM o WHERE outs > 1
  UNION ALL SELECT "start", dst, seq || base, steps + 1, passed + CAST(outs > 1 AS INT) FROM bw JOIN lk ON at_ = src JOIN o ON at_ = node WHERE steps < 12 AND passed + CAST(outs > 1 AS INT) <= 3)
SELECT "start", at_ AS "end", seq, steps FROM bw SEMI JOIN (SELECT node FROM o WHERE outs > 1) b ON at_ = b.node WHERE steps > 0""",
}
