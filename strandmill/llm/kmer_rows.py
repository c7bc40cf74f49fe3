"""The k-mer records that the operators of this package share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

K = 21

#: DuckDB's view of the same rows, for the oracle queries.
VALID_SQL = """
ok AS (SELECT *, least(u, reverse(translate(u, 'ACGT', 'TGCA'))) AS c
       FROM (SELECT *, upper(trim(kmer)) AS u FROM kmers) WHERE regexp_full_match(u, '[ACGT]{21}')),
recs AS (SELECT record_id, any_value(c) AS c, max(CASE WHEN coverage > 0 THEN coverage ELSE 0 END) AS cov FROM ok GROUP BY record_id)
"""


def _coding(k: int):
    if not 1 <= k <= 31:
        raise ValueError("k must be from 1 to 31 to fit a BIGINT")

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digit = np.full(256, 4, np.uint8)
        for i, pair in enumerate((b"Aa", b"Cc", b"Gg", b"Tt")):
            digit[list(pair)] = i
        up = np.int64(1) << (2 * np.arange(k, dtype=np.int64))
        for b in batches:
            text = pc.utf8_trim(b.column(0).cast(pa.string()), " ")
            rows = pc.fill_null(pc.equal(pc.binary_length(text), k), False)
            text = pa.concat_arrays([text.filter(rows)])
            n = len(text)
            got = np.frombuffer(text.buffers()[2], np.uint8)[: n * k].reshape(n, k) if n else np.zeros((0, k), np.uint8)
            d = digit[got]
            good = (d < 4).all(axis=1)
            d = d[good].astype(np.int64)
            codes = np.minimum(d @ up[::-1], (3 - d) @ up)
            keep = pa.array(np.flatnonzero(rows.to_numpy(zero_copy_only=False))[good])
            yield pa.RecordBatch.from_arrays([pa.array(codes), *(c.take(keep) for c in b.columns[1:])], names=["code", *b.schema.names[1:]])

    return code


def coded(kmers: DataFrame, *columns: str, k: int = K) -> DataFrame:
    """Rows with a valid k-mer, its packed canonical form as ``code``, and the named columns.

    The expressions of ``functions.kmer`` give the same codes; per row they take several times as long as these arrays do.
    """
    rows = kmers.select("kmer", *columns)
    schema = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[1:])
    return rows.mapInArrow(_coding(k), f"code bigint{schema}")


def weight(coverage: Column) -> Column:
    """Coverage with null and negative as 0."""
    return F.greatest(F.coalesce(coverage, F.lit(0)), F.lit(0)).cast("bigint")
