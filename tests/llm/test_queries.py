"""Every query of the package, and the line parser's, on tables that are empty, full of nulls, or have more columns than expected."""

import duckdb
import pytest
from pyspark.sql import functions as F

from strandmill.llm.catalog import oracle_sql, queries
from strandmill.operators.parse_lines import QUERIES as PARSE, SQL as PARSE_SQL

SOURCE = "/root/testdata/sf0.001"
TABLES = ["kmers", "kmers_meta", "hash_table", "kmer_reader", "raw_reads", "reads_fastq", "subsampler", "reads_fasta", "documents", "mix_targets", "container_sizes"]
ALL = PARSE | queries()
CLASH = ["term", "record", "unit", "amount", "edge", "code", "piece", "bitmap", "draw", "level", "start", "end", "key", "first_seq", "n_tokens", "rank", "one", "bucket", "pack", "kind", "seq", "seed", "doc", "a", "b", "many", "chain", "reason", "_line", "_pid", "_local"]


# Queries whose SQL treats nulls in every column as the operators do. In the others SQL groups or compares null keys, which here are no keys.
SAME_WITH_NULLS = ["p2_found", "p2_accuracy", "p2_groups_accuracy", "p3_found", "p3_reads", "p5_sizes", "p8_invariants", "p9_invariants", "p10_found", "p10_chains"]


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    plain = lambda v: float(f"{v:.9g}") if isinstance(v, float) else v
    return sorted(repr([plain(r[i]) for i in order]) for r in rows)


def by_sql(folder, statement):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    got = con.execute(statement)
    return rows_of([c[0] for c in got.description], got.fetchall())


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    made = {}
    for kind in ("empty", "nulls", "wide"):
        at = tmp_path_factory.mktemp(kind)
        for t in TABLES:
            df = spark.read.parquet(f"{SOURCE}/{t}.parquet")
            if kind == "empty":
                df = df.filter("false")
            elif kind == "nulls":  # in every row about a third of the columns
                df = df.limit(1500).withColumns({c: F.when(F.pmod(F.xxhash64(F.lit(c), F.monotonically_increasing_id()), F.lit(3)) > 0, F.col(c)) for c in df.columns})
            else:
                df = df.withColumns({c: F.lit("clash") for c in CLASH if c not in df.columns})
            df.write.parquet(str(at / f"{t}.parquet"))
        made[kind] = str(at)
    return made


@pytest.mark.parametrize("name", list(ALL))
@pytest.mark.parametrize("kind", ["empty", "nulls", "wide"])
def test_query(spark, folders, name, kind):
    got = ALL[name](spark, folders[kind])
    rows = got.count()
    if kind == "empty":
        assert rows <= 9 and (rows == 0 or name in ("p2_groups", "p2_groups_accuracy", "p7_rate"))
    elif kind == "nulls" and name in SAME_WITH_NULLS:
        assert rows_of(got.columns, got.collect()) == by_sql(folders[kind], (PARSE_SQL | oracle_sql())[name])
    elif kind == "wide":
        assert rows == ALL[name](spark, SOURCE).count()
