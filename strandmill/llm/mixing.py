"""Problem 9: mixing sources to target weights, small sources repeated at most a capped number of times.

Weighted fair queueing: a source's documents, shuffled anew for each repetition, get as virtual finish time the tokens of
their source so far divided by its weight. All sources are range-sorted by that time and cut off at the total budget.
Both running sums are distributed prefix sums, so a source of any size is spread over many tasks.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from strandmill.llm.tokens import token_lengths
from strandmill.runtime import materialise, prefix_sums, table


def _horizon(sources: list[dict], budget: int) -> float | None:
    """A virtual time after which nothing can be within the budget; None if the sources end before."""
    spare = sum(s["longest"] for s in sources)
    served = lambda v: sum(min(s["weight"] * v, s["tokens"] * s["repeats"]) for s in sources) - spare
    v = float(budget)
    while served(v) < budget:
        v *= 1.25
        if all(s["weight"] * v >= s["tokens"] * s["repeats"] for s in sources):
            return None
    return v


def mix(docs: DataFrame, targets: DataFrame, budget: int | None = None, seed: int = 0) -> DataFrame:
    """``(source, doc_id, use_no, n_tokens, finish, running_tokens)`` of the mixture, in the order of ``finish``.

    ``docs`` is ``(doc_id, source, n_tokens)``, ``targets`` ``(source, target_share, max_repeats)``, one row a source.
    Sources compare trimmed and in lower case; null ones, ones without a target and documents without tokens are left out.
    A target without documents, share or repeats can't be served: the others keep their shares relative to each other.
    Without a ``budget``, it is the largest at which every other source can still meet its share; a larger one lets
    sources run out, and the rest fill up. The number of targets is moderate: one row a source comes to the driver.
    """
    clean = F.lower(F.trim(F.col("source")))
    goal = targets.select(clean.alias("source"), "target_share", "max_repeats").filter("source IS NOT NULL AND target_share > 0 AND max_repeats > 0")
    rows = docs.select(clean.alias("source"), "doc_id", "n_tokens").filter("source IS NOT NULL AND n_tokens > 0")
    have = rows.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.max("n_tokens").alias("longest"))
    got = goal.join(have, "source").collect()
    spark, schema = docs.sparkSession, "source string, doc_id bigint, use_no int, n_tokens bigint, finish double, running_tokens bigint"
    if not got:
        return spark.createDataFrame([], schema)
    whole = math.fsum(r.target_share for r in got)
    sources = [{"source": r.source, "weight": r.target_share / whole, "repeats": r.max_repeats, "tokens": r.tokens, "longest": r.longest} for r in got]
    if budget is None:
        budget = math.floor(min(s["tokens"] * s["repeats"] / s["weight"] for s in sources))
    until = _horizon(sources, budget)
    for s in sources:
        s["uses"] = s["repeats"] if until is None else min(s["repeats"], math.floor(s["weight"] * until / s["tokens"]) + 1)
    plan = spark.createDataFrame([(s["source"], s["weight"], s["uses"]) for s in sources], "source string, weight double, uses int")
    uses = rows.join(F.broadcast(plan), "source").select("source", "doc_id", "n_tokens", "weight", F.explode(F.sequence(F.lit(0), F.col("uses") - 1)).alias("use_no"))
    uses = uses.withColumn("shuffle", F.xxhash64(F.lit(seed), "use_no", "doc_id"))
    queued = prefix_sums(uses, "source", ["use_no", "shuffle", "doc_id"], "n_tokens", "own").withColumn("finish", F.col("own") / F.col("weight"))
    if until is not None:
        queued = queued.filter(F.col("finish") <= until)
    merged = prefix_sums(queued.select("source", "doc_id", "use_no", "n_tokens", "finish"), None, ["finish", "source", "use_no", "doc_id"], "n_tokens", "running_tokens")
    return merged.filter(F.col("running_tokens") <= budget)


def _mixture(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    sizes = materialise(token_lengths(table(spark, sf_dir, "documents"), "doc_id", "text", "source"), "tokens")
    targets = table(spark, sf_dir, "mix_targets")
    return mix(sizes, targets), targets


def p9_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixture(spark, sf_dir)[0]


def _shares(mixed: DataFrame, targets: DataFrame, docs: DataFrame) -> DataFrame:
    """For each target what it is owed and what it got. ``owed_share`` is its share among the targets that can be served, null for the others.

    Fair queueing keeps every source within one document of its due, so that an actual share is off by at most ``bound``: the longest document of
    the source and, by its weight, those of all sources, over the tokens of the mixture.
    """
    clean = F.lower(F.trim("source")).alias("source")
    have = docs.select(clean, "doc_id", "n_tokens").filter("n_tokens > 0").groupBy("source").agg(F.count("*").alias("n_available"), F.max("n_tokens").alias("longest"))
    per = mixed.groupBy("source", "doc_id").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("u"))
    got = per.groupBy("source").agg(F.sum("t").alias("n_tokens"), F.count("*").alias("n_docs"), F.max("u").alias("most_uses"))
    all_ = Window.partitionBy()  # over one row a target
    out = targets.select(clean, "target_share", "max_repeats").join(have, "source", "left").join(got, "source", "left")
    weight = F.when((F.col("n_available") > 0) & (F.col("target_share") > 0) & (F.col("max_repeats") > 0), F.col("target_share"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    out = out.withColumns({"all_tokens": F.sum("n_tokens").over(all_), "owed_share": weight / F.sum(weight).over(all_), "spare": F.sum(F.when(weight.isNotNull(), F.col("longest"))).over(all_)})
    actual = F.coalesce(F.col("n_tokens") / F.col("all_tokens"), F.lit(0.0))
    out = out.withColumns({"actual_share": actual, "deviation": actual - F.col("owed_share"), "bound": (F.col("longest") + F.col("owed_share") * F.col("spare")) / F.col("all_tokens")})
    return out.select("source", "target_share", "max_repeats", zero("n_available"), zero("n_tokens"), zero("n_docs"), zero("most_uses"), "owed_share", "actual_share", "deviation", "bound")


def _measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = materialise(token_lengths(table(spark, sf_dir, "documents"), "doc_id", "text", "source"), "tokens")
    targets = table(spark, sf_dir, "mix_targets")
    return _shares(materialise(mix(sizes, targets), "mixed"), targets, sizes)


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each target its share, the share owed and the share reached, and how documents were used."""
    return _measured(spark, sf_dir)


def p9_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each target its documents, the share it is owed, and whether uses and the share reached keep their bounds."""
    uses = F.col("most_uses") <= F.coalesce("max_repeats", F.lit(0))
    return _measured(spark, sf_dir).select("source", "n_available", "owed_share", uses.alias("uses_hold"), F.coalesce(F.abs("deviation") <= F.col("bound"), F.col("n_tokens") == 0).alias("share_holds"))


SQL = {
    "p9_invariants": """WITH d AS (SELECT lower(trim(source)) AS source, count(*) AS n FROM documents WHERE length(text) > 0 GROUP BY 1),
t AS (SELECT lower(trim(m.source)) AS source, coalesce(n, 0) AS n, CASE WHEN n > 0 AND target_share > 0 AND max_repeats > 0 THEN target_share END AS w FROM mix_targets m LEFT JOIN d ON lower(trim(m.source)) = d.source)
SELECT source, n AS n_available, w / sum(w) OVER () AS owed_share, TRUE AS uses_hold, TRUE AS share_holds FROM t"""
}
QUERIES = {"p9_mixture": p9_mixture, "p9_shares": p9_shares, "p9_invariants": p9_invariants}
