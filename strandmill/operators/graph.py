"""De Bruijn graph operators as joins on k-mers.

A graph is a DataFrame ``nodes`` of ``(kmer, coverage, edges)``: canonical k-mers with the edge byte of their two
orientations (low four bits forward, high four reverse; one bit a base). An oriented node is a k-mer as it is read, so the
orientation is part of the string. Walks along unbranched paths are list rankings by pointer doubling: the number of joins
is logarithmic in the length of the longest path, and every round is a written table.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from strandmill.functions import kmer as K
from strandmill.functions.seq import edge_bit, edge_count
from strandmill.operators.codes import LONGEST, neighbours, packed, reversed_codes
from strandmill.operators.kmers import FASTA_SQL, READS_SQL, count_kmers, fasta_reads, fastq_reads, kmers_sql, occurrences
from strandmill.runtime import materialise, measured

rc = K.reverse_complement


# -- building --------------------------------------------------------------------------------------------------------


def half_edges(reads: DataFrame, k: int, cut: int = 0) -> DataFrame:
    """``(kmer, reverse, base)``: both half edges of each pair of neighbours in a window, i.e. of each good k+1-mer."""
    x = F.col("x")
    a, b = F.substring(x, 1, k), F.substring(x, 2, k)
    ca, cb = K.canonical(a), K.canonical(b)
    out = F.struct(ca.alias("kmer"), (a != ca).alias("reverse"), F.substring(x, k + 1, 1).alias("base"))
    back = F.struct(cb.alias("kmer"), (b == cb).alias("reverse"), F.translate(F.substring(x, 1, 1), "ACGT", "TGCA").alias("base"))
    pairs = occurrences(reads, k + 1, cut=cut).select(F.col("kmer").alias("x"))  # canonical: both strands give the same two half edges
    return pairs.select(F.explode(F.array(out, back)).alias("e")).select("e.*")


def build_graph(reads: DataFrame, k: int, cut: int = 0) -> DataFrame:
    """Nodes with coverage and edge bytes, folded before the shuffle. Up to k = 31 one pass gives each k-mer with the bases beside it; beyond, k-mers and half edges meet in one aggregation."""
    if k <= LONGEST:
        packed = neighbours(reads, k, cut).groupBy("code").agg(F.sum("n").alias("coverage"), F.bit_or("edges").alias("edges"))
        return packed.select(K.unpack(F.col("code"), k).alias("kmer"), "coverage", "edges")
    edges = half_edges(reads, k, cut).select("kmer", F.lit(0).cast("bigint").alias("n"), edge_bit(F.col("base"), F.col("reverse")).alias("bit"))
    seen = occurrences(reads, k, cut=cut).select("kmer", F.lit(1).cast("bigint").alias("n"), F.lit(0).alias("bit"))
    return seen.unionByName(edges).groupBy("kmer").agg(F.sum("n").alias("coverage"), F.bit_or("bit").alias("edges"))


def links(nodes: DataFrame) -> DataFrame:
    """``(kmer, src, base, dst, dst_kmer)``: one row for each edge out of an oriented node; the target need not exist."""
    bits = F.array(*[F.struct(F.lit(o * 4 + i).alias("bit"), F.lit(o == 1).alias("reverse"), F.lit(b).alias("base")) for o in (0, 1) for i, b in enumerate("ACGT")])
    out = nodes.select("kmer", "edges", F.explode(bits).alias("b")).filter(F.expr("shiftright(edges, b.bit) & 1 = 1"))
    src = F.when(F.col("b.reverse"), rc(F.col("kmer"))).otherwise(F.col("kmer"))
    out = out.select("kmer", src.alias("src"), F.col("b.base").alias("base"))
    dst = F.concat(F.substring(F.col("src"), F.lit(2), F.length("src") - 1), F.col("base"))
    return out.withColumn("dst", dst).withColumn("dst_kmer", K.canonical(F.col("dst")))


def drop_dangling(nodes: DataFrame) -> DataFrame:
    """Clear the edge bits that lead to k-mers the graph doesn't hold."""
    alive = links(nodes).join(nodes.select(F.col("kmer").alias("dst_kmer")), "dst_kmer", "left_semi")
    bits = alive.groupBy("kmer").agg(F.bit_or(edge_bit(F.col("base"), F.col("src") != F.col("kmer"))).alias("kept"))
    return nodes.join(bits, "kmer", "left").select("kmer", "coverage", F.coalesce("kept", F.lit(0)).alias("edges"))


def remove_nodes(nodes: DataFrame, gone: DataFrame) -> DataFrame:
    """The graph without the k-mers of ``gone``, and without edges to them."""
    return drop_dangling(nodes.join(gone.select("kmer"), "kmer", "left_anti"))


def remove_low_coverage(nodes: DataFrame, most: int) -> DataFrame:
    """The graph without the nodes of coverage up to ``most`` and the edges to them."""
    return drop_dangling(nodes.filter(F.col("coverage") > most))


def degrees(nodes: DataFrame) -> DataFrame:
    """``(kmer, forward, reverse, kind)``: edges by side; ``X`` branches on both, ``Yf`` and ``Yr`` on one, ``blunt``, ``isolated``, ``path``."""
    f, r = edge_count(F.col("edges"), False), edge_count(F.col("edges"), True)
    kind = F.when((f > 1) & (r > 1), "X").when(f > 1, "Yf").when(r > 1, "Yr").when((f == 0) & (r == 0), "isolated").when((f == 0) | (r == 0), "blunt").otherwise("path")
    return nodes.select("kmer", f.alias("forward"), r.alias("reverse"), kind.alias("kind"))


# -- unbranched paths ------------------------------------------------------------------------------------------------


def _oriented(nodes: DataFrame) -> DataFrame:
    """``(node, kmer, coverage, outs, ins)`` of both orientations of every node."""
    f, r = edge_count(F.col("edges"), False), edge_count(F.col("edges"), True)
    both = F.array(F.struct(F.col("kmer").alias("node"), f.alias("outs"), r.alias("ins")), F.struct(rc(F.col("kmer")).alias("node"), r.alias("outs"), f.alias("ins")))
    return nodes.select("kmer", "coverage", F.explode(both).alias("o")).select("o.node", "kmer", "coverage", "o.outs", "o.ins")


def _rank(steps: DataFrame) -> DataFrame:
    """``(node, head, dist, cyclic)`` for ``(node, prev)`` where ``prev`` is null at a head; a cycle's head is its smallest node."""

    def double(table: DataFrame) -> tuple[DataFrame, int]:
        last = before = None
        while True:
            ahead = table.select(F.col("node").alias("ptr"), F.col("ptr").alias("p2"), F.col("head").alias("h2"), F.col("dist").alias("d2"), F.col("low").alias("l2"))
            going = table.filter("ptr IS NOT NULL").join(ahead, "ptr").select("node", F.col("p2").alias("ptr"), F.col("h2").alias("head"), (F.col("dist") + F.col("d2")).alias("dist"), F.least("low", "l2").alias("low"))
            active = F.col("ptr").isNotNull()
            before, state = measured(table.filter("ptr IS NULL").unionByName(going.select(table.columns)), "rank", before, n=F.count_if(active), low=F.sum(F.when(active, F.pmod(F.xxhash64("low"), F.lit(1 << 31)))))
            table = before
            if state["n"] == 0 or state == last:  # all done, or only cycles left, and their smallest nodes known
                return table, state["n"]
            last = state

    start = steps.select("node", F.col("prev").alias("ptr"), F.when(F.col("prev").isNull(), F.col("node")).alias("head"), F.when(F.col("prev").isNull(), 0).otherwise(1).cast("bigint").alias("dist"), F.col("node").alias("low"))
    table, rest = double(start)
    done = table.filter("ptr IS NULL").select("node", "head", "dist", F.lit(False).alias("cyclic"))
    if not rest:
        return done
    cycles = table.filter("ptr IS NOT NULL").select("node", "low").join(steps, "node")
    cut = cycles.select("node", F.when(F.col("node") != F.col("low"), F.col("prev")).alias("prev"))
    again, _ = double(cut.select("node", F.col("prev").alias("ptr"), F.when(F.col("prev").isNull(), F.col("node")).alias("head"), F.when(F.col("prev").isNull(), 0).otherwise(1).cast("bigint").alias("dist"), F.col("node").alias("low")))
    return done.unionByName(again.select("node", "head", "dist", F.lit(True).alias("cyclic")))


def unitig_members(nodes: DataFrame) -> DataFrame:
    """``(node, kmer, coverage, outs, ins, head, dist, cyclic)``: every oriented node's place on its unbranched path.

    A link is part of a path if it is the only one out of its source and the only one into its target.
    """
    o = _oriented(nodes)
    ways = links(nodes).select("src", F.col("dst").alias("node"))
    single = ways.join(o.filter("outs = 1").select(F.col("node").alias("src")), "src").join(o.filter("ins = 1").select("node"), "node")
    steps = o.select("node").join(single.select("node", F.col("src").alias("prev")), "node", "left")
    ranked = _rank(materialise(steps, "steps"))
    return o.join(ranked, "node")


def unitigs(nodes: DataFrame) -> DataFrame:
    """``(seq, n_kmers, avg_coverage, min_coverage, max_coverage, left_edges, right_edges, cyclic, head, tail)``, each path once.

    The two strands of a path are one unitig, the smaller sequence. ``left_edges`` and ``right_edges`` are the branches beyond
    its ends, 0 for a blunt end. A cycle starts at its smallest oriented node.
    """
    m = unitig_members(nodes)
    path = F.sort_array(F.collect_list(F.struct("dist", "node", "outs", "ins"))).alias("p")
    got = m.groupBy("head", "cyclic").agg(path, F.count("*").alias("n_kmers"), F.avg("coverage").alias("avg_coverage"), F.min("coverage").alias("min_coverage"), F.max("coverage").alias("max_coverage"))
    last = F.element_at("p", -1)
    seq = F.concat(F.get("p", F.lit(0))["node"], F.array_join(F.transform(F.slice("p", 2, F.greatest(F.size("p") - 1, F.lit(0))), lambda x: F.right(x["node"], F.lit(1))), ""))
    cols = ["n_kmers", "avg_coverage", "min_coverage", "max_coverage"]
    out = got.select(seq.alias("seq"), *cols, F.get("p", F.lit(0))["ins"].alias("left_edges"), last["outs"].alias("right_edges"), "cyclic", "head", last["node"].alias("tail"))
    smaller = (F.col("seq") <= rc(F.col("seq"))) | F.col("cyclic")
    once = out.filter(smaller)
    # The strands of a cycle start at different places; its k-mers as a set are the same, so the smallest one tells them apart.
    key = F.when(F.col("cyclic"), F.least("head", F.array_min(F.transform(F.sequence(F.lit(1), F.col("n_kmers").cast("int")), lambda i: rc(F.substring(F.col("seq"), i, F.length("head"))))))).otherwise(F.col("seq"))
    return once.withColumn("_k", key).filter(~F.col("cyclic") | (F.col("head") == F.col("_k"))).drop("_k")


def stop_reasons(contigs: DataFrame) -> DataFrame:
    """``(reason, n)`` over both ends of all unitigs."""
    name = lambda c: F.when(F.col("cyclic"), "cycle").when(F.col(c) == 0, "blunt").when(F.col(c) == 1, "joins").otherwise("branches")
    return contigs.select(F.explode(F.array(name("left_edges"), name("right_edges"))).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


def is_singleton(contigs: DataFrame, k: int, length: int) -> Column:
    """Short, and blunt on both sides, one blunt k-mer, or of mean coverage below 2."""
    l, r, n = F.col("left_edges"), F.col("right_edges"), F.col("n_kmers")
    return (F.length("seq") < length) & (((l == 0) & (r == 0)) | ((n == 1) & ((l == 0) | (r == 0))) | F.col("cyclic") | (F.col("avg_coverage") < 2))


def is_repetitive(k: int, graph_coverage: float) -> Column:
    """Branching on both sides, and short or of more than three times the graph's mean coverage."""
    return (F.col("left_edges") > 1) & (F.col("right_edges") > 1) & ((F.length("seq") < 2 * k) | (F.col("avg_coverage") > 3 * graph_coverage))


def contigs(nodes: DataFrame, k: int, length: int = 100) -> DataFrame:
    """Unitigs without singletons and repetitive paths."""
    mean = nodes.agg(F.avg("coverage")).first()[0] or 0.0
    u = unitigs(nodes)
    return u.filter(~is_singleton(u, k, length) & ~is_repetitive(k, mean))


# -- cleaning --------------------------------------------------------------------------------------------------------


def _path_kmers(chosen: DataFrame, k: int) -> DataFrame:
    """K-mers of sequences of a graph."""
    return chosen.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("seq") - k + 1), lambda i: K.canonical(F.substring(F.col("seq"), i, F.lit(k))))).alias("kmer")).distinct()


def clip_tips(nodes: DataFrame, k: int, length: int, rounds: int = 100) -> DataFrame:
    """Drop paths of fewer than ``length`` k-mers that are blunt on one side and end in a branch on the other.

    Of the tips at one junction all but the longest go in a round if every way into it is a tip. Rounds are synchronous and go on until nothing changes;
    if the last of ``rounds`` still removes something, a warning says so.
    """
    for _ in range(rounds):
        u = materialise(unitigs(nodes), "unitigs")
        one_end = ((F.col("left_edges") == 0) & (F.col("right_edges") > 0)) | ((F.col("left_edges") > 0) & (F.col("right_edges") == 0))
        short = u.filter(one_end & (F.col("n_kmers") < length) & ~F.col("cyclic"))
        out = F.when(F.col("right_edges") > 0, F.col("tail")).otherwise(rc(F.col("head")))
        tips = short.select("seq", "n_kmers", out.alias("src"))
        joined = tips.join(links(nodes).select("src", "dst"), "src")  # the junction, as it is entered
        ways = joined.join(_oriented(nodes).select(F.col("node").alias("dst"), "ins"), "dst").filter("ins > 1")
        w = Window.partitionBy("dst")
        ranked = ways.withColumns({"t": F.count("*").over(w), "r": F.row_number().over(w.orderBy(F.desc("n_kmers"), "seq"))})
        gone = materialise(_path_kmers(ranked.filter((F.col("t") < F.col("ins")) | (F.col("r") > 1)).select("seq"), k), "tips")
        if gone.isEmpty():
            break
        nodes = materialise(remove_nodes(nodes, gone), "clipped")
    else:
        warnings.warn(f"clip_tips stopped after {rounds} rounds; tips may be left", stacklevel=2)
    return nodes


def remove_low_paths(nodes: DataFrame, k: int, most: int) -> DataFrame:
    """Drop the unitigs all of whose nodes have coverage up to ``most``."""
    return remove_nodes(nodes, _path_kmers(unitigs(nodes).filter(F.col("max_coverage") <= most), k))


def bubbles(nodes: DataFrame, k: int, most: int) -> DataFrame:
    """``(start, end, a_seq, b_seq, a_coverage, b_coverage)``: two unitigs of up to ``most`` k-mers between the same two oriented nodes.

    Each unitig is taken in both directions; of the two strands of a bubble the one with the smaller pair of sequences stays.
    """
    u = unitigs(nodes).filter((F.col("left_edges") == 1) & (F.col("right_edges") == 1) & (F.col("n_kmers") <= most) & ~F.col("cyclic"))
    both = u.select(F.explode(F.array(F.struct("seq", "head", "tail"), F.struct(rc(F.col("seq")).alias("seq"), rc(F.col("tail")).alias("head"), rc(F.col("head")).alias("tail")))).alias("u"), "avg_coverage").select("u.*", "avg_coverage")
    ways = links(nodes)
    placed = both.join(ways.select(F.col("dst").alias("head"), F.col("src").alias("start")), "head").join(ways.select(F.col("src").alias("tail"), F.col("dst").alias("end")), "tail")
    side = lambda x: placed.select("start", "end", F.col("seq").alias(f"{x}_seq"), F.col("avg_coverage").alias(f"{x}_coverage"))
    pairs = side("a").join(side("b"), ["start", "end"]).filter("a_seq < b_seq")
    other = F.struct(F.least(rc(F.col("a_seq")), rc(F.col("b_seq"))), F.greatest(rc(F.col("a_seq")), rc(F.col("b_seq"))), rc(F.col("end")))
    return pairs.filter(F.struct(F.col("a_seq"), F.col("b_seq"), F.col("start")) <= other)


def find_bubbles(nodes: DataFrame, k: int, unitigs_deep: int = 3) -> DataFrame:
    """``(start, end, a_seq, b_seq, kind)``: two paths of up to ``unitigs_deep`` unitigs from a branch that first meet again at one oriented node.

    Paths begin at every oriented node with several ways out and go on from unitig to unitig, so a level crosses a whole
    unbranched path. Of the places where two paths with different first bases meet, the nearest counts. ``kind`` is ``X`` where the
    branch has several ways on its other side too, else ``f`` or ``r`` by its orientation. Only bubbles whose smaller path
    comes first are listed; each is found from both ends, as the walk may start at either.
    """
    m = materialise(unitig_members(nodes), "members")
    tails = m.groupBy("head").agg(F.max_by("node", "dist").alias("tail"), F.sort_array(F.collect_list(F.struct("dist", F.right("node", F.lit(1)).alias("b")))).alias("p"))
    body = tails.select(F.col("head").alias("at"), "tail", F.array_join(F.transform(F.slice("p", 2, F.greatest(F.size("p") - 1, F.lit(0))), lambda x: x["b"]), "").alias("more"))
    ways = links(nodes).join(nodes.select(F.col("kmer").alias("dst_kmer")), "dst_kmer", "left_semi").select("src", "dst", "base")
    o = _oriented(nodes)
    branch = o.filter("outs > 1").select(F.col("node").alias("start"), F.when(F.col("ins") > 1, "X").when(F.col("node") == F.col("kmer"), "f").otherwise("r").alias("kind"))
    front = branch.join(ways.withColumnRenamed("src", "start"), "start").select("start", "kind", F.col("base").alias("first"), F.col("dst").alias("at"), "base", F.lit(1).alias("depth")).withColumn("seq", F.col("base"))
    reached = front.select("start", "kind", "first", "at", "seq")
    for _ in range(unitigs_deep):
        front = front.join(body, "at").select("start", "kind", "first", F.col("tail").alias("src"), F.concat("seq", "more").alias("seq")).join(ways, "src").select("start", "kind", "first", F.col("dst").alias("at"), F.concat("seq", "base").alias("seq"))
        reached = reached.unionByName(front)
    reached = materialise(reached.filter("at <> start"), "reached")
    side = lambda x: reached.select("start", "kind", "at", F.col("first").alias(f"{x}_first"), F.col("seq").alias(f"{x}_seq"))
    met = side("a").join(side("b"), ["start", "kind", "at"]).filter("a_first < b_first")
    nearest = F.row_number().over(Window.partitionBy("start", "a_first", "b_first").orderBy(F.length("a_seq") + F.length("b_seq"), "a_seq", "b_seq", "at"))
    return met.withColumn("_n", nearest).filter("_n = 1").select("start", F.col("at").alias("end"), F.concat("start", "a_seq").alias("a_seq"), F.concat("start", "b_seq").alias("b_seq"), "kind")


def bubble_text(found: DataFrame) -> DataFrame:
    """``value``: the paths of bubbles as FASTA, bases that differ between the two in lower case where both are equally long.

    Bubbles are numbered within the first six bases of their start, so that no task numbers them all.
    """
    group = F.conv(F.translate(F.left("start", F.lit(6)), "ACGT", "0123"), 4, 10).cast("int")
    numbered = found.withColumn("g", group).withColumn("i", F.row_number().over(Window.partitionBy("g").orderBy("start", "end", "a_seq", "b_seq")))
    marked = lambda x, y: F.when(F.length(x) == F.length(y), F.array_join(F.transform(F.sequence(F.lit(1), F.length(x)), lambda i: F.when(F.substring(F.col(x), i, F.lit(1)) == F.substring(F.col(y), i, F.lit(1)), F.substring(F.col(x), i, F.lit(1))).otherwise(F.lower(F.substring(F.col(x), i, F.lit(1))))), "")).otherwise(F.col(x))
    entry = lambda p, x, y: F.concat(F.format_string(f">match_%d_%d_path_{p}\n", "g", "i"), marked(x, y))
    return numbered.select(F.explode(F.array(entry(0, "a_seq", "b_seq"), entry(1, "b_seq", "a_seq"))).alias("value"))


def bubble_colours(found: DataFrame, kmer_set: DataFrame, k: int) -> DataFrame:
    """``(start, end, seq, colour, mean_coverage)`` of each path by colour, over its inner k-mers; absent ones count 0 once the colour occurs."""
    paths = found.select("start", "end", F.explode(F.array("a_seq", "b_seq")).alias("seq"))
    inner = paths.filter(F.length("seq") >= k + 2).select("start", "end", "seq", F.explode(F.transform(F.sequence(F.lit(2), F.length("seq") - k), lambda i: K.canonical(F.substring(F.col("seq"), i, F.lit(k))))).alias("kmer"))
    hits = inner.join(kmer_set.select("kmer", "colour", "coverage"), "kmer").groupBy("start", "end", "seq", "colour").agg(F.sum("coverage").alias("c"))
    return hits.select("start", "end", "seq", "colour", (F.col("c") / (F.length("seq") - k - 1)).alias("mean_coverage"))


def remove_bubbles(nodes: DataFrame, k: int, most: int | None = None) -> DataFrame:
    """Of the branches of each bubble all but the one of the highest coverage go; of equal ones the smaller sequence stays."""
    found = bubbles(nodes, k, 10 * k + 1 if most is None else most)
    worse = F.when(F.col("a_coverage") >= F.col("b_coverage"), F.col("b_seq")).otherwise(F.col("a_seq"))
    return remove_nodes(nodes, _path_kmers(found.select(worse.alias("seq")), k))


def spurious_links(nodes: DataFrame, least: int = 40, spread: int = 1) -> DataFrame:
    """``(src, dst)`` of links A->B beside A->D and C->B, where A and B are well covered and D and C are nearly so.

    B has exactly the two ways in from A and C, A exactly the two ways out; 0 < cov(A) - cov(D) <= spread, and likewise for B and C.
    """
    o = _oriented(nodes)
    cov = lambda c: o.select(F.col("node").alias(c), F.col("coverage").alias(f"cov_{c}"))
    ways = links(nodes).select("src", "dst")
    ab = ways.select(F.col("src").alias("a"), F.col("dst").alias("b")).join(o.filter("outs = 2").select(F.col("node").alias("a"), F.col("coverage").alias("cov_a")), "a").join(o.filter("ins = 2").select(F.col("node").alias("b"), F.col("coverage").alias("cov_b")), "b")
    ab = ab.filter((F.col("cov_a") >= least) & (F.col("cov_b") >= least))
    ad = ab.join(ways.select(F.col("src").alias("a"), F.col("dst").alias("d")), "a").filter("d <> b").join(cov("d"), "d")
    both = ad.join(ways.select(F.col("dst").alias("b"), F.col("src").alias("c")), "b").filter("c <> a").join(cov("c"), "c")
    near = lambda x, y: (F.col(x) - F.col(y) > 0) & (F.col(x) - F.col(y) <= spread)
    return both.filter(near("cov_a", "cov_d") & near("cov_b", "cov_c")).select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct()


def remove_links(nodes: DataFrame, gone: DataFrame) -> DataFrame:
    """Clear both half edges of links ``(src, dst)``."""
    half = F.array(F.struct("src", F.right("dst", F.lit(1)).alias("base")), F.struct(rc(F.col("dst")).alias("src"), F.translate(F.left("src", F.lit(1)), "ACGT", "TGCA").alias("base")))
    bits = gone.select(F.explode(half).alias("h")).select(K.canonical(F.col("h.src")).alias("kmer"), edge_bit(F.col("h.base"), F.col("h.src") != K.canonical(F.col("h.src"))).alias("bit"))
    off = bits.groupBy("kmer").agg(F.bit_or("bit").alias("off"))
    return nodes.join(off, "kmer", "left").select("kmer", "coverage", F.col("edges").bitwiseAND(F.bitwise_not(F.coalesce("off", F.lit(0)))).alias("edges"))


# -- components and walks --------------------------------------------------------------------------------------------


#: Pairs that one task unites, at most, twice as many if they are numbers; more are contracted before.
TOGETHER = 2_000_000
#: Nodes of a part that one task walks through, at most; walks through larger parts are joins.
WALKED = 8_000_000
#: Rows from which on a task walks through the parts that it has in full.
BULK = 1 << 18


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(v, label)``: the smallest vertex of each connected part of all pairs of a task."""
    columns = [b.columns for b in batches]
    if not columns:
        return
    n = sum(len(c[0]) for c in columns)
    names = pa.chunked_array([c[i] for i in (0, 1) for c in columns]).combine_chunks().dictionary_encode()
    names = names.combine_chunks() if isinstance(names, pa.ChunkedArray) else names
    by_name = pc.array_sort_indices(names.dictionary).to_numpy()
    rank = np.empty(len(by_name), np.int64)
    rank[by_name] = np.arange(len(by_name))
    ends = rank[names.indices.to_numpy()]
    v, w, label = ends[:n], ends[n:], np.arange(len(by_name))
    while len(v):
        high, low = np.maximum(v, w), np.minimum(v, w)
        np.minimum.at(label, high, low)  # only tops are hooked, to smaller ones
        while (up := label[label]).tobytes() != label.tobytes():
            label = up
        v, w = label[v], label[w]
        v, w = v[v != w], w[v != w]
    ordered = names.dictionary.take(pa.array(by_name))
    yield pa.RecordBatch.from_arrays([ordered, ordered.take(pa.array(label))], names=["v", "label"])


def connected(vertices: DataFrame, pairs: DataFrame) -> DataFrame:
    """``(v, label)``: the smallest vertex of each connected part of ``(v, w)`` pairs.

    While there are more pairs than one task may hold, each vertex joins the one of the smallest hash among itself and its neighbours, and what has
    joined is one vertex from then on. The rest is united in one task, and the labels go back the same way.
    """
    kind = vertices.schema["v"].dataType.simpleString()
    once = lambda x: x.select(F.least("v", "w").alias("v"), F.greatest("v", "w").alias("w")).filter("v <> w").distinct()
    ways, seen = measured(once(pairs), "ways", n=F.count("*"))
    joins: list[DataFrame] = []
    while seen["n"] > TOGETHER * (1 + (kind == "bigint")):
        near = ways.unionByName(ways.select(F.col("w").alias("v"), F.col("v").alias("w")))
        hashed = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("x"))
        lowest = near.groupBy("v").agg(F.min(hashed("w")).alias("m"))
        joins.append(materialise(lowest.select("v", F.least(F.col("m"), hashed("v"))["x"].alias("to")), "joins"))
        at = lambda c: joins[-1].select(F.col("v").alias(c), F.col("to").alias(f"{c}_to"))
        ways, seen = measured(once(ways.join(at("v"), "v").join(at("w"), "w").select(F.col("v_to").alias("v"), F.col("w_to").alias("w"))), "ways", ways, n=F.count("*"))
    labels = ways.coalesce(1).mapInArrow(_united, f"v {kind}, label {kind}")
    for j in reversed(joins):
        labels = j.join(labels.withColumnRenamed("v", "to"), "to", "left").select("v", F.coalesce("label", "to").alias("label"))
    if joins:  # the last vertices have small hashes, not small names
        labels = materialise(labels, "labels")
        labels = labels.join(labels.groupBy("label").agg(F.min("v").alias("low")), "label").select("v", F.col("low").alias("label"))
    return materialise(vertices.join(labels, "v", "left").select("v", F.coalesce("label", "v").alias("label")), "labels")


def _length(nodes: DataFrame) -> int:
    """The length of the k-mers, 0 without any."""
    return (nodes.select(F.length("kmer")).first() or [0])[0]


def components(nodes: DataFrame) -> DataFrame:
    """``(kmer, component)``: the smallest k-mer of each connected part.

    The links are the pairs, as packed k-mers up to k = 31.
    """
    k = _length(nodes)
    if k > LONGEST:
        ways = links(nodes).select(F.col("kmer").alias("v"), F.col("dst_kmer").alias("w")).join(nodes.select(F.col("kmer").alias("w")), "w", "left_semi")
        return connected(nodes.select(F.col("kmer").alias("v")), ways).select(F.col("v").alias("kmer"), F.col("label").alias("component"))

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            code, edges = packed(b.column(0), k), b.column(1).to_numpy(zero_copy_only=False)
            for o, strand in enumerate((code, reversed_codes(code, k))):
                for base in range(4):
                    has = np.flatnonzero(edges >> (4 * o + base) & 1)
                    to = (strand[has] << 2 | base) & ((1 << 2 * k) - 1)
                    yield pa.RecordBatch.from_arrays([pa.array(code[has]), pa.array(np.minimum(to, reversed_codes(to, k)))], names=["v", "w"])

    vertices = nodes.select(K.pack(F.col("kmer")).alias("v"))
    ways = nodes.select("kmer", "edges").mapInArrow(coded, "v bigint, w bigint").join(vertices.withColumnRenamed("v", "w"), "w", "left_semi")
    return connected(vertices, ways).select(K.unpack(F.col("v"), k).alias("kmer"), K.unpack(F.col("label"), k).alias("component"))


def seeds(nodes: DataFrame, parts: DataFrame) -> DataFrame:
    """``(component, size, kmer)``: of every part its node of the highest coverage, then of the fewest edges, then the smallest."""
    order = F.struct(-F.col("coverage"), F.bit_count("edges"), F.col("kmer"))
    return nodes.join(parts, "kmer").groupBy("component").agg(F.count("*").alias("size"), F.min_by("kmer", order).alias("kmer"))


def follow(nexts: DataFrame, starts: DataFrame, longest: int = 200_000) -> DataFrame:
    """``(start, dist, node)``: the walk from each oriented start along ``nexts`` ``(node, to)``, one row a node: a rule of any kind.

    A walk ends where there is no next node, at ``longest`` nodes or where it would come back to a k-mer of its own. Reached sets double in every round.
    """
    jump = materialise(nexts.select("node", "to"), "jump")
    reached, seen = measured(starts.select(F.col("node").alias("start"), F.lit(0).cast("bigint").alias("dist"), "node"), "reached", n=F.count("*"))
    step, n = 1, seen["n"]
    while step < longest:
        far = reached.join(jump, "node").select("start", (F.col("dist") + step).alias("dist"), F.col("to").alias("node"))
        reached, seen = measured(reached.unionByName(far).groupBy("start", "node").agg(F.min("dist").alias("dist")).select("start", "dist", "node"), "reached", reached, n=F.count("*"))
        if seen["n"] == n:
            break
        n, step = seen["n"], step * 2
        jump = materialise(jump.join(jump.select(F.col("node").alias("to"), F.col("to").alias("to2")), "to").select("node", F.col("to2").alias("to")), "jump", jump)
    # Nodes reached by a walk that has gone round have kept their first distance; the walk is what is contiguous and new as a k-mer.
    w = Window.partitionBy("start", "k")
    first = reached.withColumn("k", K.canonical(F.col("node"))).withColumn("first", F.min("dist").over(w))
    twice = first.filter("dist > first").groupBy("start").agg(F.min("dist").alias("stop"))
    return reached.join(twice, "start", "left").filter((F.col("dist") < F.coalesce("stop", F.lit(longest))) & (F.col("dist") < longest)).select("start", "dist", "node")


def coverage_walks(nodes: DataFrame, starts: DataFrame, longest: int = 200_000) -> DataFrame:
    """``(start, dist, node)``: from each oriented start always on to the neighbour of the highest coverage, the first base of equals."""
    best = links(nodes).join(nodes.select(F.col("kmer").alias("dst_kmer"), F.col("coverage").alias("c")), "dst_kmer").groupBy("src").agg(F.min_by("dst", F.struct(-F.col("c"), F.col("base"))).alias("dst"))
    return follow(best.select(F.col("src").alias("node"), F.col("dst").alias("to")), starts, longest)


def _best_ways(code: np.ndarray, coverage: np.ndarray, edges: np.ndarray, k: int) -> np.ndarray:
    """Of each oriented node (twice the place of its k-mer in sorted ``code``, and 1 for the other strand) the neighbour of the highest coverage, the first base of equals; -1 without any."""
    back = reversed_codes(code, k)
    own = code == back  # a k-mer that is both its strands has the ways of both
    edges = np.where(own, (edges | edges >> 4) & 15, edges)
    best = np.full(2 * len(code), -1, np.int32 if 2 * len(code) < 1 << 31 else np.int64)
    for o, strand in enumerate((code, back)):
        most = np.full(len(code), -1, coverage.dtype)
        for base in range(4):
            at = np.flatnonzero(np.where(own, edges >> base, edges >> (4 * o + base)) & 1)
            to = (strand[at] << 2 | base) & ((1 << 2 * k) - 1)
            low = np.minimum(to, reversed_codes(to, k))
            found = np.minimum(np.searchsorted(code, low), len(code) - 1)
            better = (code[found] == low) & (coverage[found] > most[at])
            at, found = at[better], found[better]
            most[at] = coverage[found]
            best[2 * at + o] = 2 * found + (to != low)[better]
    return best


def _grown(part: np.ndarray, code: np.ndarray, coverage: np.ndarray, edges: np.ndarray, k: int) -> Iterator[tuple[int, int, bytes]]:
    """``(part, size, seq)`` for all nodes of some parts, sorted by part and code."""
    first = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
    size = np.diff(np.r_[first, len(part)])
    good = coverage == np.repeat(np.maximum.reduceat(coverage, first), size)
    bits = np.where(good, np.bitwise_count(edges), 99)
    good &= bits == np.repeat(np.minimum.reduceat(bits, first), size)
    seed = np.minimum.reduceat(np.where(good, np.arange(len(part)), len(part)), first)
    names, seed = part[first].tolist(), code[seed]
    del part, good, bits
    if len(first) > 1:  # else they are in order
        order = np.argsort(code, kind="stable")
        code, coverage, edges = code[order], coverage[order], edges[order]
    best = memoryview(_best_ways(code, coverage, edges, k))
    seen = bytearray(len(code)), bytearray(len(code))  # parts share no node
    letters = np.frombuffer(b"ACGT", np.uint8)
    for name, n, at in zip(names, size.tolist(), np.searchsorted(code, seed).tolist()):
        tails = []
        for o in (0, 1):
            i, been, path = 2 * at + o, seen[o], []
            been[at] = 1
            while (i := best[i]) >= 0 and not been[i >> 1]:
                been[i >> 1] = 1
                path.append(i)
            x = np.array(path, np.int64)
            last = np.where(x & 1, 3 - (code[x >> 1] >> 2 * (k - 1)), code[x >> 1] & 3)
            tails.append(last if o == 0 else 3 - last[::-1])
        middle = code[at] >> 2 * np.arange(k - 1, -1, -1) & 3
        yield name, n, letters[np.r_[tails[1], middle, tails[0]]].tobytes()


def _walked(nodes: DataFrame, parts: DataFrame, k: int, least: int) -> DataFrame:
    """``consensus`` of parts each of which one task can hold; a task has all nodes of its parts, sorted, and walks on arrays."""

    def grown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: list[str] = []  # of the parts held
        held: list[list[np.ndarray]] = [[], [], [], []]
        rows = 0

        def done(columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            found = [x for x in _grown(*[columns.pop(0) for _ in range(4)], k) if x[1] >= least]
            size = pa.array([x[1] for x in found], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([names[x[0]] for x in found], pa.string()), size, pa.array([x[2].decode() for x in found], pa.string())], names=["component", "size", "seq"])

        for b in batches:
            if not b.num_rows:
                continue
            x = b.column(0).dictionary_encode()  # sorted, so numbers go up
            again = bool(names) and names[-1] == x.dictionary[0].as_py()
            part = x.indices.to_numpy() + np.int32(len(names) - again)
            names += x.dictionary.to_pylist()[again:]
            for c, more in zip(held, (part, packed(b.column(1), k), *(b.column(i).to_numpy(zero_copy_only=False).copy() for i in (2, 3)))):
                c.append(more)
            rows += b.num_rows
            if rows >= BULK and held[0][0][0] != part[-1]:
                columns = [np.concatenate(c) for c in held]
                cut = int(np.searchsorted(columns[0], part[-1]))
                held, rows = [[c[cut:].copy()] for c in columns], len(columns[0]) - cut
                held[0][0][:] = 0
                yield from done([c[:cut] for c in columns])
                names = names[-1:]
        if rows:
            columns = []
            while held:  # a column at a time, as one part may fill the task
                columns.append(np.concatenate(held.pop(0)))
            yield from done(columns)

    rows = nodes.join(parts, "kmer").select("component", "kmer", "coverage", "edges")
    return rows.repartition("component").sortWithinPartitions("component", "kmer").mapInArrow(grown, "component string, size bigint, seq string")


def consensus(nodes: DataFrame, parts: DataFrame, least: int = 1) -> DataFrame:
    """``(component, size, seq)``: a coverage walk to both sides of the seed of each part of at least ``least`` nodes, however long.

    A part of up to ``WALKED`` nodes is walked through in the task that holds it; larger ones, and k-mers that can't be packed, are walked through by joins.
    """
    k = _length(nodes)
    sizes = parts.groupBy("component").agg(F.count("*").alias("size"))
    if k <= LONGEST:
        large = sizes.filter(F.col("size") > WALKED).select("component")
        if large.isEmpty():
            return _walked(nodes, parts, k, least)
        large = materialise(large, "large")
        big, rest = parts.join(large, "component", "left_semi"), parts.join(large, "component", "left_anti")
        return _walked(nodes, rest, k, least).unionByName(_joined(nodes.join(big, "kmer", "left_semi"), big, least))
    return _joined(nodes, parts, least)


def _joined(nodes: DataFrame, parts: DataFrame, least: int) -> DataFrame:
    """``consensus`` by joins over all nodes."""
    s = seeds(nodes, parts).filter(F.col("size") >= least)
    both = s.select(F.explode(F.array("kmer", rc(F.col("kmer")))).alias("node")).distinct()
    walks = coverage_walks(nodes, both, 1 << 62)
    grown = walks.groupBy("start").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("dist", "node"))), lambda x: F.when(x["dist"] > 0, F.right(x["node"], F.lit(1))).otherwise(F.lit(""))), "").alias("tail"))
    f, r = (grown.select(F.col("start").alias(c), F.col("tail").alias(t)) for c, t in (("kmer", "ahead"), ("back", "behind")))
    return s.withColumn("back", rc(F.col("kmer"))).join(f, "kmer").join(r, "back").select("component", "size", F.concat(rc(F.col("behind")), "kmer", "ahead").alias("seq"))


def neighbourhood(nodes: DataFrame, starts: DataFrame, depth: int = 10, most: int = 200) -> DataFrame:
    """``(start, kmer, depth)``: nodes up to ``depth`` steps around each start k-mer, the nearest ``most`` of each."""
    ways = materialise(links(nodes).select("kmer", "dst_kmer").join(nodes.select(F.col("kmer").alias("dst_kmer")), "dst_kmer", "left_semi").distinct(), "ways")
    new = seen = materialise(nodes.join(starts.select("kmer"), "kmer", "left_semi").select(F.col("kmer").alias("start"), "kmer", F.lit(0).alias("depth")), "near")
    for d in range(1, depth + 1):  # only new rows are written
        short = seen.groupBy("start").agg(F.count("*").alias("n")).filter(F.col("n") < most).select("start")
        front = new.join(short, "start", "left_semi").select("start", "kmer")
        far = front.join(ways, "kmer").select("start", F.col("dst_kmer").alias("kmer")).distinct().join(seen, ["start", "kmer"], "left_anti")
        new, found = measured(far.select("start", "kmer", F.lit(d).alias("depth")), "near", n=F.count("*"))
        if not found["n"]:
            break
        seen = seen.unionByName(new)
    nearest = F.row_number().over(Window.partitionBy("start").orderBy("depth", "kmer"))
    return seen.withColumn("_n", nearest).filter(F.col("_n") <= most).drop("_n")


def paths_from(nodes: DataFrame, starts: DataFrame, steps: int) -> DataFrame:
    """``(start, seq, steps)``: all paths of up to ``steps`` edges from oriented nodes; the number grows with the branches, not beyond ``steps`` levels."""
    ways = links(nodes).join(nodes.select(F.col("kmer").alias("dst_kmer")), "dst_kmer", "left_semi").select(F.col("src").alias("at"), "dst", "base")
    front = starts.select(F.col("node").alias("start"), F.col("node").alias("at"), F.col("node").alias("seq"), F.lit(0).alias("steps"))
    out = front
    for i in range(1, steps + 1):
        front = front.join(ways, "at").select("start", F.col("dst").alias("at"), F.concat("seq", "base").alias("seq"), F.lit(i).alias("steps"))
        out = out.unionByName(front)
    return out.select("start", "seq", "steps")


def pair_links(first: DataFrame, second: DataFrame, members: DataFrame, k: int) -> DataFrame:
    """``(a, b, n)``: pairs of different unitigs, by their head, that the mates of a pair fall on; at most 65,535 are counted."""
    at = members.select("kmer", F.col("head").alias("u")).groupBy("kmer").agg(F.min("u").alias("u"))
    on = lambda reads, c: occurrences(reads, k, "read_id").join(at, "kmer").select("read_id", F.col("u").alias(c)).distinct()
    both = on(first, "a").join(on(second, "b"), "read_id").filter("a <> b")
    return both.groupBy("a", "b").agg(F.least(F.count("*"), F.lit(65_535)).alias("n"))


def pair_signatures(reads: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """``(kmer, n_pairs, bits, all_bits)``: how many pairs a node occurs in, and their numbers as 63 bits, united and intersected."""
    found = occurrences(reads, k, "read_id").join(nodes.select("kmer"), "kmer", "left_semi")
    bit = F.expr("bigint(1) << int(pmod(read_id, 63))")
    once = found.groupBy("kmer", "read_id").agg(F.first(bit).alias("b"))  # a hot node's reads are folded task by task
    return once.groupBy("kmer").agg(F.count("*").alias("n_pairs"), F.bit_or("b").alias("bits"), F.bit_and("b").alias("all_bits"))


# -- export ----------------------------------------------------------------------------------------------------------

_SHAPES: dict[str, tuple[str, Callable[[], Column], Callable[[], Column], str]] = {
    "dot": ("digraph {\n", lambda: F.format_string('"%s" [label="%d"]', "kmer", "coverage"), lambda: F.format_string('"%s" -> "%s" [label="%s"]', "kmer", "dst_kmer", "base"), "}\n"),
    "gml": ("graph [ directed 1\n", lambda: F.format_string('node [ id "%s" coverage %d ]', "kmer", "coverage"), lambda: F.format_string('edge [ source "%s" target "%s" label "%s" ]', "kmer", "dst_kmer", "base"), "]\n"),
    "graphml": ('<graphml><graph edgedefault="directed">\n', lambda: F.format_string('<node id="%s"><data key="coverage">%d</data></node>', "kmer", "coverage"), lambda: F.format_string('<edge source="%s" target="%s"><data key="base">%s</data></edge>', "kmer", "dst_kmer", "base"), "</graph></graphml>\n"),
    "gexf": ('<gexf version="1.2"><graph defaultedgetype="directed">\n', lambda: F.format_string('<node id="%s" label="%d"/>', "kmer", "coverage"), lambda: F.format_string('<edge source="%s" target="%s" label="%s"/>', "kmer", "dst_kmer", "base"), "</graph></gexf>\n"),
    "biolayout": ("", lambda: F.format_string('//NODESIZE\t"%s"\t%d', "kmer", "coverage"), lambda: F.format_string('"%s"\t"%s"', "kmer", "dst_kmer"), ""),
    "ubigraph": ("", lambda: F.format_string("vertex %s %d", "kmer", "coverage"), lambda: F.format_string("edge %s %s %s", "kmer", "dst_kmer", "base"), ""),
}


def export_lines(nodes: DataFrame, shape: str) -> DataFrame:
    """``(part, value)``: lines of the nodes (1) and links (2) in a graph format; ``wrapping`` has what stands around them."""
    _, node, edge, _ = _SHAPES[shape]
    return nodes.select(F.lit(1).alias("part"), node().alias("value")).unionByName(links(nodes).select(F.lit(2).alias("part"), edge().alias("value")))


def wrapping(shape: str) -> tuple[str, str]:
    return _SHAPES[shape][0], _SHAPES[shape][3]


def write_graph(nodes: DataFrame, shape: str, path: str) -> None:
    """Write a graph as a folder of text whose files, one after another, are a valid document: what opens it, nodes, links, what closes it.

    A global sort by part and hash keeps that order and deals nodes and links out to all tasks.
    """
    ends = [(part, text.rstrip("\n")) for part, text in zip((0, 3), wrapping(shape)) if text.strip()]
    lines = export_lines(nodes, shape)
    if ends:
        lines = lines.unionByName(nodes.sparkSession.createDataFrame(ends, "part int, value string"))
    lines.orderBy("part", F.xxhash64("value")).select("value").write.mode("errorifexists").text(path)


# -- the test tables -------------------------------------------------------------------------------------------------

GRAPH_K = 15


def _graph(s: SparkSession, d: str, least: int = 0) -> DataFrame:
    g = build_graph(fastq_reads(s, d), GRAPH_K)
    return materialise(remove_low_coverage(g, least) if least else g, "graph")


def _starts(nodes: DataFrame) -> DataFrame:
    """The seed of every connected part, as an oriented node."""
    return materialise(seeds(nodes, components(nodes)).select("kmer", F.col("kmer").alias("node")), "seeds")


def _both_ways(starts: DataFrame) -> DataFrame:
    return starts.select("kmer", F.explode(F.array("node", rc(F.col("node")))).alias("node")).distinct()


def _coloured(s: SparkSession, d: str) -> DataFrame:
    """The contigs as colour 0 and the reads as colour 1."""
    sets = [count_kmers(reads(s, d), GRAPH_K).withColumn("colour", F.lit(c)) for c, reads in enumerate((fasta_reads, fastq_reads))]
    return sets[0].unionByName(sets[1])


def _halves(s: SparkSession, d: str, first: bool) -> DataFrame:
    """The two halves of each read as mates of a pair; they overlap by k-1 bases, so that each k-mer is in one of them."""
    n = F.greatest(F.floor((F.length("seq") - (GRAPH_K - 2)) / 2).cast("int"), F.lit(0))  # k-mers of the first half
    half = F.col("seq").substr(F.lit(1), n + (GRAPH_K - 1)) if first else F.col("seq").substr(n + 1, F.length("seq"))
    return fastq_reads(s, d).select("read_id", half.alias("seq"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "graph_nodes": lambda s, d: build_graph(fastq_reads(s, d), GRAPH_K),
    "graph_links": lambda s, d: links(_graph(s, d)).select("src", "dst"),
    "node_degrees": lambda s, d: degrees(_graph(s, d)),
    "branch_nodes": lambda s, d: degrees(_graph(s, d)).groupBy("kind").agg(F.count("*").alias("n")),
    "low_coverage_prune": lambda s, d: remove_low_coverage(_graph(s, d), 1),
    "unitigs": lambda s, d: unitigs(_graph(s, d)).select("n_kmers", "min_coverage", "max_coverage", "left_edges", "right_edges", "seq"),
    "unitig_stops": lambda s, d: stop_reasons(unitigs(_graph(s, d))),
    "contigs": lambda s, d: contigs(_graph(s, d), GRAPH_K).select("seq", "n_kmers"),
    "clipped_tips": lambda s, d: clip_tips(_graph(s, d), GRAPH_K, 2 * GRAPH_K),
    "low_paths_removed": lambda s, d: remove_low_paths(_graph(s, d), GRAPH_K, 1),
    "bubbles": lambda s, d: bubbles(_graph(s, d), GRAPH_K, 10 * GRAPH_K + 1),
    "bubbles_removed": lambda s, d: remove_bubbles(_graph(s, d), GRAPH_K),
    "bubble_paths": lambda s, d: find_bubbles(_graph(s, d), GRAPH_K),
    "bubble_fasta": lambda s, d: bubble_text(find_bubbles(_graph(s, d), GRAPH_K)),
    "bubble_colours": lambda s, d: bubble_colours(find_bubbles(_graph(s, d), GRAPH_K), _coloured(s, d), GRAPH_K),
    "pair_links": lambda s, d: (lambda g: pair_links(_halves(s, d, True), _halves(s, d, False), unitig_members(g), GRAPH_K))(_graph(s, d)),
    "pair_signatures": lambda s, d: pair_signatures(fastq_reads(s, d), _graph(s, d), GRAPH_K),
    "spurious_links": lambda s, d: spurious_links(_graph(s, d), 2, 1),
    "connected_components": lambda s, d: components(_graph(s, d)).groupBy("component").agg(F.count("*").alias("size")),
    "component_consensus": lambda s, d: (lambda g: consensus(g, components(g)))(_graph(s, d)),
    "coverage_walks": lambda s, d: (lambda g: coverage_walks(g, _both_ways(_starts(g))))(_graph(s, d)),
    "neighbourhood": lambda s, d: (lambda g: neighbourhood(g, _starts(g)))(_graph(s, d)),
    "paths_from": lambda s, d: (lambda g: paths_from(g, _oriented(g).filter("outs > 1").select("node"), 8))(_graph(s, d)),
    "graph_export": lambda s, d: export_lines(_graph(s, d), "dot").select("value"),
}
_MERS = f"{READS_SQL}, {kmers_sql('reads', GRAPH_K, 'rk')}, {kmers_sql('reads', GRAPH_K + 1, 'ek')}"
_GRAPH_SQL = f"""WITH {_MERS},
half AS (SELECT substr(kmer, 1, {GRAPH_K}) AS x, right(kmer, 1) AS b FROM ek UNION ALL SELECT reverse(translate(substr(kmer, 2), 'ACGT', 'TGCA')), translate(left(kmer, 1), 'ACGT', 'TGCA') FROM ek),
bits AS (SELECT least(x, reverse(translate(x, 'ACGT', 'TGCA'))) AS kmer, bit_or((1 << (instr('ACGT', b) - 1)) * CASE WHEN x <= reverse(translate(x, 'ACGT', 'TGCA')) THEN 1 ELSE 16 END) AS edges FROM half GROUP BY 1),
g AS (SELECT kmer, n AS coverage, CAST(coalesce(edges, 0) AS INT) AS edges FROM (SELECT kmer, count(*) AS n FROM rk GROUP BY kmer) LEFT JOIN bits USING (kmer)),
deg AS (SELECT *, CAST(bit_count(edges & 15) AS INT) AS forward, CAST(bit_count((edges >> 4) & 15) AS INT) AS reverse FROM g),
lk AS (SELECT kmer, src, base, substr(src, 2) || base AS dst FROM (SELECT kmer, CASE WHEN b < 4 THEN kmer ELSE reverse(translate(kmer, 'ACGT', 'TGCA')) END AS src, 'ACGT'[b % 4 + 1] AS base FROM g, range(8) t(b) WHERE (edges >> CAST(b AS INT)) & 1 = 1))
"""
_KIND = "CASE WHEN forward > 1 AND reverse > 1 THEN 'X' WHEN forward > 1 THEN 'Yf' WHEN reverse > 1 THEN 'Yr' WHEN forward = 0 AND reverse = 0 THEN 'isolated' WHEN forward = 0 OR reverse = 0 THEN 'blunt' ELSE 'path' END AS kind"
_RC = "reverse(translate({x}, 'ACGT', 'TGCA'))"
_WALK_SQL = (
    _GRAPH_SQL.replace("WITH", "WITH RECURSIVE", 1).replace("lk AS (", "lk AS MATERIALIZED (")
    + f""", o AS MATERIALIZED (SELECT kmer AS node, coverage, forward AS outs, reverse AS ins FROM deg UNION ALL SELECT {_RC.format(x="kmer")}, coverage, reverse, forward FROM deg),
single AS MATERIALIZED (SELECT src, dst FROM lk JOIN o a ON src = a.node AND a.outs = 1 JOIN o b ON dst = b.node AND b.ins = 1),
hops AS MATERIALIZED (SELECT src, dst, coverage FROM single JOIN o ON dst = node),
walk AS (SELECT node AS head, node AS tail, node AS seq, 1 AS n, coverage AS lo, coverage AS hi, coverage AS total FROM o ANTI JOIN single ON node = dst
         UNION ALL SELECT head, dst, seq || right(dst, 1), n + 1, least(lo, coverage), greatest(hi, coverage), total + coverage FROM walk JOIN hops ON tail = src),
uni AS MATERIALIZED (SELECT seq, CAST(n AS BIGINT) AS n_kmers, lo AS min_coverage, hi AS max_coverage, total / n AS avg_coverage, a.ins AS left_edges, b.outs AS right_edges, head, tail
        FROM (SELECT * FROM walk ANTI JOIN single ON tail = src) JOIN o a ON head = a.node JOIN o b ON tail = b.node WHERE seq <= {_RC.format(x="seq")})
"""
)
_NODES_SQL = f""", nh AS MATERIALIZED (SELECT tail AS node, least(tail, {_RC.format(x="tail")}) AS kmer, head FROM walk)"""
_PARTS_SQL = _NODES_SQL + f""", ed AS MATERIALIZED (SELECT DISTINCT a.head AS v, b.head AS w FROM lk JOIN nh a ON src = a.node JOIN nh b ON dst = b.node
  UNION SELECT a.head, b.head FROM nh a JOIN nh b ON b.node = {_RC.format(x="a.node")}),
both_ed AS MATERIALIZED (SELECT v, w FROM ed UNION SELECT w, v FROM ed),
cc(v, label) USING KEY (v) AS (SELECT head, head FROM nh GROUP BY head UNION SELECT e.w, min(c.label) FROM cc c JOIN both_ed e ON e.v = c.v JOIN recurring.cc r ON r.v = e.w WHERE c.label < r.label GROUP BY e.w),
parts AS MATERIALIZED (SELECT kmer, min(kmer) OVER (PARTITION BY label) AS component FROM (SELECT kmer, min(label) AS label FROM nh JOIN cc ON head = v GROUP BY kmer)),
sizes AS (SELECT component, count(*) AS size FROM parts GROUP BY component),
seed AS MATERIALIZED (SELECT component, kmer FROM (SELECT component, kmer, row_number() OVER (PARTITION BY component ORDER BY coverage DESC, bit_count(edges), kmer) AS r FROM parts JOIN g USING (kmer)) WHERE r = 1)
"""
_STEPS_SQL = f""", best AS MATERIALIZED (SELECT src, dst FROM (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY coverage DESC, base) AS r FROM lk JOIN o ON dst = node) WHERE r = 1),
cw("start", dist, node, seen) AS (SELECT x, CAST(0 AS BIGINT), x, [least(x, {_RC.format(x="x")})] FROM (SELECT kmer AS x FROM seed UNION SELECT {_RC.format(x="kmer")} FROM seed)
  UNION ALL SELECT "start", dist + 1, dst, list_append(seen, least(dst, {_RC.format(x="dst")})) FROM cw JOIN best ON src = node WHERE NOT list_contains(seen, least(dst, {_RC.format(x="dst")})))
"""
_KMERS_OF = "SELECT DISTINCT least(x, reverse(translate(x, 'ACGT', 'TGCA'))) AS kmer FROM (SELECT substr(seq, i, {k}) AS x FROM (SELECT seq, unnest(range(1, length(seq) - {k} + 2)) AS i FROM {source}))"


def _pruned_sql(gone: str) -> str:
    """The graph without the k-mers of a table, and without edges to them."""
    return f""", left_ AS MATERIALIZED (SELECT * FROM g ANTI JOIN {gone} USING (kmer)), l2 AS MATERIALIZED (SELECT kmer, src, base, least(dst, {_RC.format(x="dst")}) AS dk FROM lk),
kept AS (SELECT l2.kmer, bit_or((1 << (instr('ACGT', base) - 1)) * CASE WHEN src = l2.kmer THEN 1 ELSE 16 END) AS e FROM l2 SEMI JOIN left_ ON dk = left_.kmer GROUP BY l2.kmer)
SELECT kmer, coverage, CAST(coalesce(e, 0) AS INT) AS edges FROM left_ LEFT JOIN kept USING (kmer)"""


_PAIRS_SQL = f""", both_ AS (SELECT seq, head, tail, avg_coverage FROM uni WHERE left_edges = 1 AND right_edges = 1 AND n_kmers <= {10 * GRAPH_K + 1}
  UNION ALL SELECT {_RC.format(x="seq")}, {_RC.format(x="tail")}, {_RC.format(x="head")}, avg_coverage FROM uni WHERE left_edges = 1 AND right_edges = 1 AND n_kmers <= {10 * GRAPH_K + 1}),
pl AS (SELECT i.src AS s, q.dst AS e, seq, avg_coverage FROM both_ JOIN lk i ON i.dst = head JOIN lk q ON q.src = tail),
pr AS (SELECT a.s, a.e, a.seq AS x, b.seq AS y, a.avg_coverage AS cx, b.avg_coverage AS cy FROM pl a JOIN pl b ON a.s = b.s AND a.e = b.e AND a.seq < b.seq),
bub AS (SELECT * FROM pr WHERE (x, y, s) <= (least({_RC.format(x="x")}, {_RC.format(x="y")}), greatest({_RC.format(x="x")}, {_RC.format(x="y")}), {_RC.format(x="e")}))
"""
_FOUND_SQL = _WALK_SQL + f""", body AS MATERIALIZED (SELECT head, tail, substr(seq, {GRAPH_K + 1}) AS more FROM walk ANTI JOIN single ON tail = src),
rch(s, kind, first, at_, seq, depth) AS (SELECT node, CASE WHEN ins > 1 THEN 'X' WHEN node < {_RC.format(x="node")} THEN 'f' ELSE 'r' END, base, dst, base, 0 FROM o JOIN lk ON node = src WHERE outs > 1
  UNION ALL SELECT s, kind, first, dst, rch.seq || more || base, depth + 1 FROM rch JOIN body ON at_ = head JOIN lk ON src = tail WHERE depth < 3),
mt AS (SELECT a.s, a.kind, a.at_, a.seq AS x, b.seq AS y, row_number() OVER (PARTITION BY a.s, a.first, b.first ORDER BY length(a.seq) + length(b.seq), a.seq, b.seq, a.at_) AS r
  FROM rch a JOIN rch b ON a.s = b.s AND a.at_ = b.at_ AND a.first < b.first WHERE a.at_ <> a.s),
fb AS MATERIALIZED (SELECT s AS "start", at_ AS "end", s || x AS a_seq, s || y AS b_seq, kind FROM mt WHERE r = 1)
"""
_MARKED = "CASE WHEN length({x}) = length({y}) THEN array_to_string(list_transform(range(1, length({x}) + 1), lambda i: CASE WHEN {x}[i] = {y}[i] THEN {x}[i] ELSE lower({x}[i]) END), '') ELSE {x} END"
_SINGLETON = f"length(seq) < 100 AND ((left_edges = 0 AND right_edges = 0) OR (n_kmers = 1 AND (left_edges = 0 OR right_edges = 0)) OR avg_coverage < 2)"
_REPETITIVE = f"left_edges > 1 AND right_edges > 1 AND (length(seq) < {2 * GRAPH_K} OR avg_coverage > 3 * (SELECT avg(coverage) FROM g))"
SQL = {
    "pair_signatures": _GRAPH_SQL + "SELECT kmer, bit_or(CAST(1 AS BIGINT) << CAST(read_id % 63 AS INT)) AS bits, bit_and(CAST(1 AS BIGINT) << CAST(read_id % 63 AS INT)) AS all_bits, count(DISTINCT read_id) AS n_pairs FROM rk GROUP BY kmer",
    "unitigs": _WALK_SQL + "SELECT n_kmers, min_coverage, max_coverage, left_edges, right_edges, seq FROM uni",
    "contigs": _WALK_SQL + f"SELECT seq, n_kmers FROM uni WHERE NOT ({_SINGLETON}) AND NOT ({_REPETITIVE})",
    "unitig_stops": _WALK_SQL + "SELECT CASE x WHEN 0 THEN 'blunt' WHEN 1 THEN 'joins' ELSE 'branches' END AS reason, count(*) AS n FROM (SELECT left_edges AS x FROM uni UNION ALL SELECT right_edges FROM uni) GROUP BY 1",
    "low_paths_removed": _WALK_SQL + ", low AS (SELECT seq FROM uni WHERE max_coverage <= 1), gone AS MATERIALIZED (" + _KMERS_OF.format(k=GRAPH_K, source="low") + ")" + _pruned_sql("gone"),
    "bubbles": _WALK_SQL + _PAIRS_SQL + 'SELECT s AS "start", e AS "end", x AS a_seq, cx AS a_coverage, y AS b_seq, cy AS b_coverage FROM bub',
    "bubbles_removed": _WALK_SQL + _PAIRS_SQL + ", worse AS (SELECT CASE WHEN cx >= cy THEN y ELSE x END AS seq FROM bub), gone AS MATERIALIZED (" + _KMERS_OF.format(k=GRAPH_K, source="worse") + ")" + _pruned_sql("gone"),
    "bubble_paths": _FOUND_SQL + "SELECT * FROM fb",
    "bubble_fasta": _FOUND_SQL + f""", nr AS (SELECT *, row_number() OVER (PARTITION BY left("start", 6) ORDER BY "start", "end", a_seq, b_seq) AS i, list_reduce(list_transform(range(1, 7), lambda p: instr('ACGT', "start"[p]) - 1), lambda a, b: a * 4 + b) AS n FROM fb)
SELECT '>match_' || n || '_' || i || '_path_0' || chr(10) || {_MARKED.format(x="a_seq", y="b_seq")} AS value FROM nr UNION ALL SELECT '>match_' || n || '_' || i || '_path_1' || chr(10) || {_MARKED.format(x="b_seq", y="a_seq")} FROM nr""",
    "bubble_colours": _FOUND_SQL.replace(_MERS, f"{_MERS}, {FASTA_SQL}, {kmers_sql('fasta', GRAPH_K, 'ck')}", 1) + f""", cs AS (SELECT kmer, 0 AS colour, count(*) AS n FROM ck GROUP BY kmer UNION ALL SELECT kmer, 1, count(*) FROM rk GROUP BY kmer),
pth AS (SELECT "start", "end", unnest([a_seq, b_seq]) AS seq FROM fb), inr AS (SELECT "start", "end", seq, substr(seq, i, {GRAPH_K}) AS x FROM (SELECT *, unnest(range(2, length(seq) - {GRAPH_K} + 1)) AS i FROM pth))
SELECT "start", "end", seq, colour, c / (length(seq) - {GRAPH_K + 1}) AS mean_coverage FROM (SELECT "start", "end", seq, colour, CAST(sum(n) AS BIGINT) AS c FROM inr JOIN cs ON kmer = least(x, {_RC.format(x="x")}) GROUP BY "start", "end", seq, colour)""",
    "pair_links": (_WALK_SQL + _NODES_SQL).replace(_MERS, _MERS + f""", hn AS (SELECT read_id, seq, greatest((length(seq) - {GRAPH_K - 2}) // 2, 0) AS n FROM reads), h1 AS (SELECT read_id, substr(seq, 1, n + {GRAPH_K - 1}) AS seq FROM hn), h2 AS (SELECT read_id, substr(seq, n + 1) AS seq FROM hn), {kmers_sql('h1', GRAPH_K, 'p1')}, {kmers_sql('h2', GRAPH_K, 'p2')}""", 1)
    + """, at_ AS MATERIALIZED (SELECT kmer, min(head) AS u FROM nh GROUP BY kmer) SELECT a, b, least(count(*), 65535) AS n FROM (SELECT DISTINCT read_id, u AS a FROM p1 JOIN at_ USING (kmer)) JOIN (SELECT DISTINCT read_id, u AS b FROM p2 JOIN at_ USING (kmer)) USING (read_id) WHERE a <> b GROUP BY a, b""",
    "connected_components": _WALK_SQL + _PARTS_SQL + "SELECT * FROM sizes",
    "coverage_walks": _WALK_SQL + _PARTS_SQL + _STEPS_SQL + 'SELECT "start", dist, node FROM cw',
    "component_consensus": _WALK_SQL + _PARTS_SQL + _STEPS_SQL + f""", grown AS (SELECT "start", string_agg(CASE WHEN dist > 0 THEN right(node, 1) ELSE '' END, '' ORDER BY dist) AS tail FROM cw GROUP BY "start")
SELECT component, size, {_RC.format(x="b.tail")} || kmer || f.tail AS seq FROM seed JOIN sizes USING (component) JOIN grown f ON f."start" = kmer JOIN grown b ON b."start" = {_RC.format(x="kmer")}""",
    "neighbourhood": _WALK_SQL + _PARTS_SQL + f""", near AS (SELECT kmer AS "start", kmer AS k, 0 AS depth FROM seed UNION SELECT "start", least(dst, {_RC.format(x="dst")}), depth + 1 FROM near JOIN lk ON lk.kmer = k WHERE depth < 10)
SELECT "start", kmer, depth FROM (SELECT "start", k AS kmer, min(depth) AS depth, row_number() OVER (PARTITION BY "start" ORDER BY min(depth), k) AS r FROM near GROUP BY "start", k) WHERE r <= 200""",
    "spurious_links": _WALK_SQL + """SELECT DISTINCT ab.src, ab.dst FROM lk ab JOIN o a ON ab.src = a.node JOIN o b ON ab.dst = b.node JOIN lk ad ON ad.src = ab.src AND ad.dst <> ab.dst JOIN o d ON ad.dst = d.node
JOIN lk cb ON cb.dst = ab.dst AND cb.src <> ab.src JOIN o c ON cb.src = c.node WHERE a.outs = 2 AND b.ins = 2 AND a.coverage >= 2 AND b.coverage >= 2 AND a.coverage - d.coverage = 1 AND b.coverage - c.coverage = 1""",
    "paths_from": _WALK_SQL + """, paths AS (SELECT node AS "start", node AS at_, node AS seq, 0 AS steps FROM o WHERE outs > 1 UNION ALL SELECT "start", dst, seq || base, steps + 1 FROM paths JOIN lk ON at_ = src SEMI JOIN o ON dst = node WHERE steps < 8) SELECT "start", seq, steps FROM paths""",
    "graph_nodes": _GRAPH_SQL + "SELECT * FROM g",
    "graph_links": _GRAPH_SQL + "SELECT src, dst FROM lk",
    "node_degrees": _GRAPH_SQL + f"SELECT kmer, forward, reverse, {_KIND} FROM deg",
    "branch_nodes": _GRAPH_SQL + f"SELECT kind, count(*) AS n FROM (SELECT {_KIND} FROM deg) GROUP BY kind",
    "low_coverage_prune": _GRAPH_SQL.replace("lk AS (", "lk AS MATERIALIZED (").replace("g AS (", "g AS MATERIALIZED (") + ", gone AS MATERIALIZED (SELECT kmer FROM g WHERE coverage <= 1)" + _pruned_sql("gone"),
    "graph_export": _GRAPH_SQL + """SELECT '"' || kmer || '" [label="' || coverage || '"]' AS value FROM g UNION ALL SELECT '"' || kmer || '" -> "' || least(dst, reverse(translate(dst, 'ACGT', 'TGCA'))) || '" [label="' || base || '"]' FROM lk""",
}
