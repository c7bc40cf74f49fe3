"""Problem 1: how often every distinct term occurs, and in how many records.

Pairs of term and record go through a range-partitioned external sort; a run-length scan over the sorted partitions
counts, for every term, its units, its summed weight and its distinct records. The sort key goes on past the term, so
a term with a third of all rows is spread over as many partitions as it fills; only the first and the last run of a
partition can go on elsewhere, and only those are put together afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from strandmill.functions.kmer import unpack
from strandmill.llm.kmer_rows import K, VALID_SQL, coded, weight
from strandmill.runtime import materialise, table

NO_RECORD = -(1 << 62)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of sorted (term, record, unit, weight) rows; one row a term, or several where it may go on in another partition."""
    kind, held, first = None, None, True  # held: the run still open: term, weight, units, records, first and last record, last unit

    def rows(runs: list, edge: bool) -> pa.RecordBatch:
        term, total, units, records, lo, hi = runs
        n = len(total)
        return pa.RecordBatch.from_arrays([pa.array(term, kind), pa.array(total), pa.array(units), pa.array(records), pa.array(lo), pa.array(hi), pa.array(np.full(n, edge))], names=["term", "total", "units", "records", "first_record", "last_record", "edge"])

    for b in batches:
        if not b.num_rows:
            continue
        term, kind = b.column(0), b.column(0).type
        rec, unit, w = (b.column(i).to_numpy(zero_copy_only=False) for i in (1, 2, 3))
        new_t = np.r_[True, pc.not_equal(term[1:], term[:-1]).to_numpy(zero_copy_only=False)]
        new_r, new_u = new_t.copy(), new_t.copy()
        new_r[1:] |= rec[1:] != rec[:-1]
        new_u[1:] |= new_r[1:] | (unit[1:] != unit[:-1])
        if held and held[0] == term[0].as_py():
            new_t[0], new_r[0] = False, rec[0] != held[5]
            new_u[0] = new_r[0] or unit[0] != held[6]
        at = np.flatnonzero(np.r_[True, new_t[1:]])
        total, units = np.add.reduceat(np.where(new_u, w, 0), at), np.add.reduceat(new_u.astype(np.int64), at)
        records = np.add.reduceat((new_r & (rec != NO_RECORD)).astype(np.int64), at)
        ends = np.r_[at[1:], len(w)] - 1
        lo, hi = rec[at].copy(), rec[ends].copy()
        terms = term.take(pa.array(at))
        if held:
            if not new_t[0]:
                total[0] += held[1]
                units[0] += held[2]
                records[0] += held[3]
                lo[0] = held[4]
            else:
                yield rows([[held[0]], *(np.array([x], np.int64) for x in held[1:6])], first)
                first = False
        head = 0
        if first and len(at) > 1:
            yield rows([terms[:1], total[:1], units[:1], records[:1], lo[:1], hi[:1]], True)
            first, head = False, 1
        if len(at) - 1 > head:
            yield rows([x[head:-1] for x in (terms, total, units, records, lo, hi)], False)
        held = (terms[-1].as_py(), int(total[-1]), int(units[-1]), int(records[-1]), int(lo[-1]), int(hi[-1]), int(unit[-1]))
    if held:
        yield rows([[held[0]], *(np.array([x], np.int64) for x in held[1:6])], True)


def term_frequencies(rows: DataFrame, term: str, record: str, unit: str, amount: str) -> DataFrame:
    """``(term, total, units, records)`` for every distinct term.

    ``unit`` identifies an occurrence: rows of the same term, record and unit are deliveries of one and count once, with
    the largest ``amount``. ``total`` sums the amounts, ``units`` counts the occurrences, ``records`` the distinct records.
    Null terms are no terms. A null unit is an occurrence of its own. A null record counts towards no record, a null or
    negative amount is 0. Other columns play no part. An empty table gives an empty result.
    """
    pairs = rows.filter(F.col(term).isNotNull()).select(
        F.col(term).alias("term"),
        F.coalesce(F.col(record).cast("bigint"), F.lit(NO_RECORD)).alias("record"),
        F.coalesce(F.col(unit).cast("bigint"), -1 - F.monotonically_increasing_id()).alias("unit"),
        weight(F.col(amount)).alias("amount"),
    )
    ranged = pairs.repartitionByRange("term", "record", "unit").sortWithinPartitions("term", "record", "unit", F.desc("amount"))
    kind = pairs.schema["term"].dataType.simpleString()
    runs = materialise(ranged.mapInArrow(_scan, f"term {kind}, total bigint, units bigint, records bigint, first_record bigint, last_record bigint, edge boolean"), "runs")
    inner = runs.filter(~F.col("edge")).select("term", "total", "units", "records")
    # Partitions are sorted, so two pieces of a term can share no record but those at their ends.
    ends = F.array_distinct(F.flatten(F.collect_list(F.array("first_record", "last_record"))))
    own = F.when(F.col("first_record") == F.col("last_record"), F.lit(1)).otherwise(F.lit(2)) - F.expr(f"int(first_record = {NO_RECORD})")
    pieces = runs.filter("edge").withColumn("_inner", F.col("records") - own)
    whole = pieces.groupBy("term").agg(F.sum("total").alias("total"), F.sum("units").alias("units"), (F.sum("_inner") + F.size(F.filter(ends, lambda r: r != NO_RECORD))).alias("records"))
    return inner.unionByName(whole)


def marked(frequencies: DataFrame, records: int, rare_below: int = 3, common_share: float = 0.5) -> DataFrame:
    """Add ``rare`` (total below ``rare_below``) and ``common`` (in at least ``common_share`` of all ``records``)."""
    return frequencies.withColumns({"rare": F.col("total") < rare_below, "common": (F.col("records") > 0) & (F.col("records") >= common_share * records)})


def _kmer_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    dumps = [r[0] for r in table(spark, sf_dir, "kmers_meta").select("dump_id").distinct().collect() if r[0] is not None]  # one row a dump
    rows = coded(table(spark, sf_dir, "kmers"), "dump_id", "record_id", "coverage").withColumn("dump_id", F.when(F.col("dump_id").isin(dumps), F.col("dump_id")))
    return marked(term_frequencies(rows, "code", "dump_id", "record_id", "coverage"), len(dumps))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = F.array_compact(F.array(F.when(F.col("rare"), F.lit("rare")), F.when(F.col("common"), F.lit("common"))))
    return _kmer_frequencies(spark, sf_dir).filter("rare or common").select(unpack(F.col("term"), K).alias("kmer"), F.explode(marks).alias("mark"))


def p1_term_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _kmer_frequencies(spark, sf_dir).select(unpack(F.col("term"), K).alias("kmer"), F.col("total").alias("coverage"), F.col("units").alias("n_records"), F.col("records").alias("n_dumps"), "rare", "common")


_TERMS_SQL = f"""WITH {VALID_SQL},
cov AS (SELECT c, CAST(sum(cov) AS BIGINT) AS coverage, count(*) AS n_records FROM recs GROUP BY c),
spread AS (SELECT c, count(DISTINCT dump_id) AS n_dumps FROM ok WHERE dump_id IN (SELECT dump_id FROM kmers_meta) GROUP BY c),
terms AS (SELECT c AS kmer, coverage, n_records, coalesce(n_dumps, 0) AS n_dumps, coverage < 3 AS rare,
                 coalesce(n_dumps, 0) * 2 >= (SELECT count(DISTINCT dump_id) FROM kmers_meta) AS common FROM cov LEFT JOIN spread USING (c))
"""
SQL = {
    "p1_found": _TERMS_SQL + "SELECT kmer, 'rare' AS mark FROM terms WHERE rare UNION ALL SELECT kmer, 'common' FROM terms WHERE common",
    "p1_term_frequency": _TERMS_SQL + "SELECT * FROM terms",
}
QUERIES = {"p1_found": p1_found, "p1_term_frequency": p1_term_frequency}
