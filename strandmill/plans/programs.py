"""The programs: build a k-mer set, measure contamination, filter reads, look into a set; as functions and as a command line."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession, functions as F

from strandmill.operators import graph as G, kmers as M, walks as Y
from strandmill.runtime import materialise
from strandmill.sources import kmer_files as KF, readers as R, writers as W


def check_k(k: int) -> int:
    if k < 1 or k % 2 == 0:
        raise ValueError("the k-mer size must be odd and positive")
    return k


def scan(spark: SparkSession, paths: str | list[str], fmt: str, offset: int = 33, four_line: bool = False) -> DataFrame:
    """Reads with a ``read_id`` that is stable for one plan; qualities are null for formats without any, so a cutoff leaves their bases.

    ``four_line``: FASTQ files hold each record on four lines, and are split among tasks whatever their size.
    """
    if four_line and R.parse_format(fmt) == "FASTQ":
        reads = R.read_fastq(spark, paths, offset, four_line=True)
    else:
        reads = R.read_reads(spark, paths, fmt, offset)
    reads = reads if "qual" in reads.columns else reads.withColumn("qual", F.lit(None).cast("array<int>"))
    return materialise(reads.withColumn("read_id", F.monotonically_increasing_id()), "reads")


def load_set(spark: SparkSession, paths: str | list[str], fmt: str, k: int, offset: int = 33, cut: int = 0, four_line: bool = False) -> tuple[DataFrame, int]:
    """A merged set ``(kmer, coverage, edges)`` and its number of reads, from k-mer files or from reads."""
    if R.parse_format(fmt) in ("KMERS", "CTX"):
        paths = [paths] if isinstance(paths, str) else paths
        return M.merge_sets(*[KF.read_kmers(spark, p, k).select("kmer", "coverage", "edges") for p in paths]), sum(KF.total_reads(p) for p in paths)
    reads = scan(spark, paths, fmt, offset, four_line)
    return M.count_kmers(reads, k, cut).withColumn("edges", F.lit(0)), reads.count()


def build(spark: SparkSession, inputs: str | list[str], fmt: str, output: str, k: int = 21, offset: int = 33, cut: int = 0, four_line: bool = False) -> None:
    """Write the k-mer set of reads, or the union of k-mer files, to a new folder."""
    kmer_set, reads = load_set(spark, inputs, fmt, check_k(k), offset, cut, four_line)
    KF.write_kmers(kmer_set, output, k, reads)


def contamination(spark: SparkSession, reference: str, sample: str, fmt: str, output: str | None = None, histogram: str | None = None, k: int = 21, offset: int = 33, cut: int = 0, four_line: bool = False) -> DataFrame:
    """One row on how much of the reference the sample holds. With k-mer files as a sample no read can be looked at: 0 contaminated reads."""
    ref, ref_reads = load_set(spark, reference, "KMERS", check_k(k))
    if R.parse_format(fmt) in ("KMERS", "CTX"):
        own, n = load_set(spark, sample, fmt, k)
        heads = spark.createDataFrame([(n, 0)], "sample_reads bigint, contaminated_reads bigint")
        hits = None
    else:
        reads = scan(spark, sample, fmt, offset, four_line)
        own, hits = M.count_kmers(reads, k, cut), materialise(M.hits_per_read(reads, ref, k, cut), "hits")
        heads = hits.agg(F.count("*").alias("sample_reads"), F.count_if(F.col("hits") > 0).alias("contaminated_reads"))
    total = own.agg(F.count("*").alias("sample_kmers_total"))
    report = M.contamination_report(M.update_coverage(ref, own), reference, sample, k, ref_reads, M.beside(heads, total), F.col("sample_kmers_total"))
    if output:
        W.write_tsv(report, output)
    if histogram and hits is not None:
        W.write_tsv(M.hit_histogram(hits).orderBy("no_of_kmers"), histogram, "overwrite")
    return report


def filter_reads(spark: SparkSession, reference: str, read_1: str, output: str, read_2: str | None = None, fmt: str = "FASTQ", threshold: int = 0, print_contaminated: bool = False, k: int = 21, offset: int = 33, cut: int = 0, four_line: bool = False) -> DataFrame:
    """Route reads, or pairs by their first mate, into folders ``mate=<n>/bin=<name>`` and return the histogram of hits."""
    ref, _ = load_set(spark, reference, "KMERS", check_k(k))
    one = scan(spark, read_1, fmt, offset, four_line)
    hits = materialise(M.route(M.hits_per_read(one, ref, k, cut), threshold), "hits")
    wanted = hits if threshold <= 0 or print_contaminated else hits.filter("bin = 'clean'")
    mates = one.withColumn("mate", F.lit(1))
    if read_2:
        order = lambda df: df.withColumn("_one", F.lit(1).cast("bigint"))
        from strandmill.runtime import prefix_sums

        place = lambda df: prefix_sums(order(df), None, ["read_id"], "_one", "n").drop("_one")
        keys = place(one.select("read_id"))
        two = place(scan(spark, read_2, fmt, offset, four_line)).drop("read_id").join(keys, "n").drop("n")
        mates = mates.unionByName(two.withColumn("mate", F.lit(2)).select(mates.columns))
    W.write_reads(mates.join(wanted.select("read_id", "bin"), "read_id"), output, fmt, offset, by=["mate", "bin"])
    return M.hit_histogram(hits)


def info(spark: SparkSession, inputs: str, k: int, find: list[str] | None = None) -> dict[str, DataFrame]:
    """Summary, coverage spectrum and, for up to 100 k-mers, their rows."""
    if find and len(find) > 100:
        raise ValueError("at most 100 k-mers can be looked up")
    kmer_set, _ = load_set(spark, inputs, "KMERS", k)
    out = {"summary": M.set_summary(kmer_set), "spectrum": M.coverage_spectrum(kmer_set.filter("edges <> 0"), 0)}
    return out | ({"found": M.lookup(kmer_set, *find)} if find else {})


def assemble(spark: SparkSession, inputs: str | list[str], fmt: str, output: str, k: int = 21, offset: int = 33, cut: int = 0, low_coverage: int = 0, tip_length: int = 0, bubbles: bool = False, walk: str = "PERFECT_PATH", least_component: int = 1, shape: str | None = None, four_line: bool = False) -> DataFrame:
    """Build a graph, clean it in the order low coverage, low paths, tips, bubbles, and write contigs; returns them."""
    nodes = materialise(G.build_graph(scan(spark, inputs, fmt, offset, four_line), check_k(k), cut), "graph")
    if low_coverage:
        nodes = materialise(G.remove_low_paths(G.remove_low_coverage(nodes, low_coverage), k, low_coverage), "graph")
    if tip_length:
        nodes = G.clip_tips(nodes, k, tip_length)
    if bubbles:
        nodes = materialise(G.remove_bubbles(nodes, k), "graph")
    if walk == "COMPONENTS":
        found = G.consensus(nodes, G.components(nodes), least_component).select(F.xxhash64("component").alias("path_id"), "seq", F.lit(0.0).alias("avg_coverage"), F.lit(0).cast("bigint").alias("min_coverage"), F.lit(0).cast("bigint").alias("max_coverage"))
    elif walk == "PERFECT_PATH":
        found = G.contigs(nodes, k).select(F.xxhash64("head").alias("path_id"), "seq", "avg_coverage", "min_coverage", "max_coverage")
    elif walk == "Y_WALK":
        starts = G.seeds(nodes, G.components(nodes)).select(F.explode(F.array("kmer", G.rc(F.col("kmer")))).alias("node"))
        walked = materialise(Y.y_walks(nodes, starts), "walks").join(nodes.select("kmer", "coverage"), G.K.canonical(F.col("node")) == F.col("kmer"))
        ordered = F.sort_array(F.collect_list(F.struct("dist", "node")))
        per = walked.groupBy("start").agg(ordered.alias("p"), F.sum("coverage").alias("c"), F.count("*").alias("n"), F.min("coverage").alias("lo"), F.max("coverage").alias("hi"), F.max(F.when(F.col("dist") == 0, F.col("coverage"))).alias("own"))
        ahead = F.array_join(F.transform(F.filter("p", lambda x: x["dist"] > 0), lambda x: F.right(x["node"], F.lit(1))), "")
        per = per.select("start", ahead.alias("ahead"), "c", "n", "lo", "hi", "own")
        one, two = per.filter(F.col("start") == G.K.canonical(F.col("start"))), per.select(G.rc(F.col("start")).alias("start"), F.col("ahead").alias("behind"), F.col("c").alias("c2"), F.col("n").alias("n2"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
        found = one.join(two, "start").select(F.xxhash64("start").alias("path_id"), F.concat(G.rc(F.col("behind")), "start", "ahead").alias("seq"), ((F.col("c") + F.col("c2") - F.col("own")) / (F.col("n") + F.col("n2") - 1)).alias("avg_coverage"), F.least("lo", "lo2").alias("min_coverage"), F.greatest("hi", "hi2").alias("max_coverage"))
    else:
        raise ValueError(f"no walk {walk}")
    found = materialise(found, "contigs")
    W.contig_text(found).write.mode("errorifexists").text(output)
    if shape:
        G.write_graph(nodes, shape, f"{output}.{shape}")
    return found


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="strandmill")
    subs = top.add_subparsers(dest="program", required=True)

    def sub(name: str, fmt: str | None) -> argparse.ArgumentParser:
        p = subs.add_parser(name)
        p.add_argument("-k", "--kmer_size", type=int, default=21)
        p.add_argument("-n", "--mem_height", help="accepted, without effect")
        p.add_argument("-b", "--mem_width", help="accepted, without effect")
        p.add_argument("-p", "--quality_score_offset", type=int, default=33)
        p.add_argument("-q", "--quality_score_threshold", type=int, default=0)
        p.add_argument("-f", "--format", "--file_format", dest="format", default=fmt)
        p.add_argument("--four_line", action="store_true", help="FASTQ records are on four lines each: files are split among tasks")
        return p

    p = sub("build", "FASTQ")
    p.add_argument("-i", "--input"), p.add_argument("-o", "--output", required=True), p.add_argument("files", nargs="*")
    p = sub("contamination", "KMERS")
    p.add_argument("-r", "--reference_kmers", required=True), p.add_argument("-i", "--input", required=True), p.add_argument("-o", "--output"), p.add_argument("-t", "--histogram_output")
    p = sub("filter", "FASTQ")
    p.add_argument("-1", "--read_1", required=True), p.add_argument("-2", "--read_2"), p.add_argument("-r", "--reference", required=True), p.add_argument("-o", "--output_prefix", required=True)
    p.add_argument("-t", "--threashold", "--threshold", dest="threshold", type=int, default=0), p.add_argument("-c", "--print_contaminated", action="store_true")
    p = sub("info", "KMERS")
    p.add_argument("-i", "--input", required=True), p.add_argument("--find", nargs="*")
    p = sub("assemble", "FASTQ")
    p.add_argument("-i", "--input", required=True), p.add_argument("-o", "--output", required=True), p.add_argument("--low_coverage", type=int, default=0), p.add_argument("--tip_length", type=int, default=0)
    p.add_argument("--bubbles", action="store_true"), p.add_argument("-A", "--algorithm", default="PERFECT_PATH"), p.add_argument("--graph")
    return top


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.appName(f"strandmill {a.program}").getOrCreate()
    common = {"k": a.kmer_size, "offset": a.quality_score_offset, "cut": a.quality_score_threshold, "four_line": a.four_line}
    if a.program == "build":
        build(spark, a.files or a.input, "KMERS" if a.files else a.format, a.output, **common)
    elif a.program == "contamination":
        contamination(spark, a.reference_kmers, a.input, a.format, a.output, a.histogram_output, **common).show(truncate=False)
    elif a.program == "filter":
        filter_reads(spark, a.reference, a.read_1, a.output_prefix, a.read_2, a.format, a.threshold, a.print_contaminated, **common).orderBy("no_of_kmers").show(1000)
    elif a.program == "info":
        common.pop("four_line")
        for df in info(spark, a.input, a.kmer_size, a.find).values():
            df.show(1000, truncate=False)
    else:
        assemble(spark, a.input, a.format, a.output, low_coverage=a.low_coverage, tip_length=a.tip_length, bubbles=a.bubbles, walk=a.algorithm, shape=a.graph, **common)


if __name__ == "__main__":
    main()
