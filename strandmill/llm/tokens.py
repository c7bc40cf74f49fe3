"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the published pattern that splits text before the merges of this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def token_lengths(docs: DataFrame, ident: str, text: str, *carry: str, vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """``(ident, *carry, n_tokens)``; a null text has 0 tokens, special tokens in a text are ordinary text.

    ``vocabulary`` is a file of ranks that the driver reads; its content, about a megabyte, goes to every executor once.
    """
    spark = docs.sparkSession
    with open(vocabulary, "rb") as f:
        raw = spark.sparkContext.broadcast(f.read())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in raw.value.splitlines() if line)}
        encode = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        for b in batches:
            n = np.fromiter((len(encode(x)) if x else 0 for x in b.column(0).to_pylist()), np.int64, b.num_rows)
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(n)], names=[*b.schema.names[1:], "n_tokens"])

    kept = docs.select(F.col(text), ident, *carry)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[1:])
    return kept.mapInArrow(count, f"{schema}, n_tokens bigint")
