"""Problem 8: filling containers of fixed capacity with items, splitting only what exceeds the capacity alone.

Shortest-pack-first over the length histogram: from the longest length down, items go into the packs that are shortest so
far, or into new ones if even those have no room. Packs with the same content are one pattern with a count, so the work
depends on the number of lengths, at most the capacity, and not on the number of items. Each step gives a range of ranks
within a length to a range of containers; items find their container by their rank.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from strandmill.llm.tokens import token_lengths
from strandmill.runtime import materialise, prefix_sums, table


def pack_histogram(histogram: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int]], int]:
    """Placements ``(length, first rank, first container, offset)``, each good up to the length's next one, and the number of containers."""
    placed, packs, opened = [], [], 0  # packs, most room first: negative room, first container, number of containers
    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            if packs and -packs[0][0] >= length:
                room, base, count = heapq.heappop(packs)
                take = min(left, count)
                placed.append((length, rank, base, capacity + room))
                if -room > length:
                    heapq.heappush(packs, (room + length, base, take))
                if take < count:
                    heapq.heappush(packs, (room, base + take, count - take))
                left, rank = left - take, rank + take
                continue
            each = capacity // length  # a new pack stays the shortest one until it is full
            for count, items in ((left // each, each), (1, left % each)):
                if count and items:
                    for i in range(items):
                        placed.append((length, rank, opened, i * length))
                        rank += count
                    if capacity > items * length:
                        heapq.heappush(packs, (items * length - capacity, opened, count))
                    opened += count
            left = 0
    return placed, opened


def pack_items(items: DataFrame, capacities: dict[str, int]) -> DataFrame:
    """``(container, container_no, doc_id, part_no, start_token, n_tokens, at)`` for ``items`` of ``(doc_id, n_tokens)``.

    Every item is packed once for each kind of container. One of more tokens than the capacity fills containers of its own
    and only its rest, part ``n_tokens // capacity``, shares one. An item without tokens gets a null ``container_no``.
    Among items of one length the doc_id decides; doc_ids must be unique. The capacities are parameters, few of them; without any
    there is nothing to pack into.
    """
    spark, names = items.sparkSession, list(capacities)
    if not names:
        return spark.createDataFrame([], "container string, container_no bigint, doc_id bigint, part_no int, start_token bigint, n_tokens bigint, at bigint")
    if any(c is None or c < 1 for c in capacities.values()):
        raise ValueError("capacities must be positive")
    kinds = F.array(*[F.struct(F.lit(i).alias("kind"), F.lit(capacities[n]).cast("bigint").alias("capacity")) for i, n in enumerate(names)])
    sized = items.select("doc_id", F.coalesce("n_tokens", F.lit(0)).cast("bigint").alias("size"), F.explode(kinds).alias("k")).select("doc_id", "size", "k.kind", "k.capacity")
    parts = sized.withColumns({"full": F.floor(F.col("size") / F.col("capacity")), "rest": F.pmod("size", "capacity")}).withColumn("key", F.shiftleft(F.col("kind").cast("bigint"), 40) + F.col("rest"))
    # At most one group for each kind and length below its capacity, whatever the number of items.
    ranked = prefix_sums(parts.filter("rest > 0").select("key", "doc_id", "full", "capacity", "kind", "rest", F.lit(1).cast("bigint").alias("one")), "key", ["doc_id"], "one", "rank")
    counts = {r.key: r.n for r in parts.filter("rest > 0").groupBy("key").agg(F.count("*").alias("n")).collect()}
    at, base, offset, packed = [], [], [], []
    for i, name in enumerate(names):
        hist = {k & ((1 << 40) - 1): n for k, n in counts.items() if k >> 40 == i}
        rows, opened = pack_histogram(hist, capacities[name])
        packed.append(opened)
        for length, rank, first, start in rows:
            at.append(((i << 40) + length, rank)), base.append(first), offset.append(start)
    order = sorted(range(len(at)), key=at.__getitem__)
    key, rank = (np.array([at[j][x] for j in order], np.int64) for x in (0, 1))
    base, offset = np.array(base, np.int64)[order], np.array(offset, np.int64)[order]
    plan = spark.sparkContext.broadcast((key, rank, base, offset))  # bounded by the capacities, see above

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rank, base, offset = plan.value
        group, first = np.unique(key, return_index=True)
        comp = np.repeat(np.arange(len(group)), np.diff(np.r_[first, len(key)])).astype(np.int64) * (1 << 44) + rank
        for b in batches:
            k, r = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False) - 1
            p = np.searchsorted(comp, np.searchsorted(group, k).astype(np.int64) * (1 << 44) + r, "right") - 1
            yield pa.RecordBatch.from_arrays([*b.columns[2:], pa.array(base[p] + r - rank[p]), pa.array(offset[p])], names=[*b.schema.names[2:], "container_no", "at"])

    name = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("kind") + 1).alias("container")
    shared = ranked.select("key", "rank", "doc_id", "full", "capacity", "kind", "rest").mapInArrow(place, "doc_id bigint, full bigint, capacity bigint, kind int, rest bigint, container_no bigint, at bigint")
    shared = shared.select(name, "container_no", "doc_id", F.col("full").cast("int").alias("part_no"), (F.col("full") * F.col("capacity")).alias("start_token"), F.col("rest").alias("n_tokens"), "at")
    over = prefix_sums(parts.filter("full > 0").select("kind", "doc_id", "capacity", F.col("full").cast("bigint").alias("full")), "kind", ["doc_id"], "full", "upto")
    number = F.element_at(F.array(*[F.lit(n).cast("bigint") for n in packed]), F.col("kind") + 1)
    own = over.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("full") - 1)).alias("i"))
    own = own.select(name, (number + F.col("upto") - F.col("full") + F.col("i")).alias("container_no"), "doc_id", F.col("i").cast("int").alias("part_no"), (F.col("i") * F.col("capacity")).alias("start_token"), F.col("capacity").alias("n_tokens"), F.lit(0).cast("bigint").alias("at"))
    none = parts.filter("size = 0").select(name, F.lit(None).cast("bigint").alias("container_no"), "doc_id", F.lit(0).alias("part_no"), F.lit(0).cast("bigint").alias("start_token"), F.lit(0).cast("bigint").alias("n_tokens"), F.lit(0).cast("bigint").alias("at"))
    return shared.unionByName(own).unionByName(none)


def _capacities(spark: SparkSession, sf_dir: str) -> dict[str, int]:
    return {r.container: r.capacity_tokens for r in table(spark, sf_dir, "container_sizes").collect() if r.container and r.capacity_tokens}  # three rows


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = materialise(token_lengths(table(spark, sf_dir, "documents"), "doc_id", "text"), "tokens")
    return pack_items(sizes, _capacities(spark, sf_dir))


def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each kind of container how many there are and what share of their room is used."""
    caps = _capacities(spark, sf_dir)
    room = F.coalesce(*[F.when(F.col("container") == n, F.lit(c)) for n, c in caps.items()], F.lit(None).cast("int"))
    per = p8_containers(spark, sf_dir).filter("container_no IS NOT NULL").groupBy("container", "container_no").agg(F.sum("n_tokens").alias("t"))
    return per.groupBy("container").agg(F.count("*").alias("n_containers"), F.sum("t").alias("n_tokens"), F.max(F.col("t") - room).alias("most_over")).withColumn("fill", F.col("n_tokens") / (F.col("n_containers") * room))


def p8_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each kind of container what must hold: every document whole and once, no container over its capacity, nothing split that fits, nothing overlapping.

    Documents without a doc_id are packed, but can't be followed. ``tight``: the containers are at most a twentieth, and one, more than the tokens need.
    """
    caps = _capacities(spark, sf_dir)
    sizes = materialise(token_lengths(table(spark, sf_dir, "documents"), "doc_id", "text"), "tokens")
    packed = materialise(pack_items(sizes, caps), "packed") if caps else pack_items(sizes, caps)
    room = F.coalesce(*[F.when(F.col("container") == n, F.lit(c)) for n, c in caps.items()], F.lit(None).cast("int"))
    pieces = packed.filter("doc_id IS NOT NULL").groupBy("container", "doc_id").agg(F.sum("n_tokens").alias("got"), F.count("*").alias("parts"), F.sum(F.col("start_token")).alias("starts"))
    every = sizes.filter("doc_id IS NOT NULL").select("doc_id", F.col("n_tokens").alias("size"), F.explode(F.array(*[F.lit(n) for n in caps]).cast("array<string>")).alias("container"))
    both = every.join(pieces, ["container", "doc_id"], "full").withColumn("room", room)
    want = F.greatest(F.ceil(F.col("size") / F.col("room")), F.lit(1))
    one = lambda c: F.sum(c.cast("int"))
    docs = both.groupBy("container").agg(F.count("size").alias("n_docs"), one(~F.coalesce(F.col("got") == F.col("size"), F.lit(False))).alias("n_not_whole"), one(~F.coalesce((F.col("parts") == want) & (F.col("starts") == F.col("room") * want * (want - 1) / 2), F.lit(False))).alias("n_cut_wrongly"))
    inside = packed.filter("container_no IS NOT NULL").groupBy("container", "container_no").agg(F.sum("n_tokens").alias("t"), F.max(F.col("at") + F.col("n_tokens")).alias("top"), F.count_distinct("at").alias("places"), F.count("*").alias("items"))
    full = inside.withColumn("room", room).groupBy("container").agg(one((F.col("t") > F.col("room")) | (F.col("top") != F.col("t")) | (F.col("places") != F.col("items"))).alias("n_wrong"), (F.count("*") <= F.sum("t") / F.max("room") * 1.05 + 1).alias("tight"))
    return docs.join(full, "container", "left").select("container", "n_docs", "n_not_whole", "n_cut_wrongly", F.coalesce("n_wrong", F.lit(0)).alias("n_containers_wrong"), F.coalesce("tight", F.lit(True)).alias("tight"))


SQL = {"p8_invariants": "SELECT container, count(doc_id) AS n_docs, 0 AS n_not_whole, 0 AS n_cut_wrongly, 0 AS n_containers_wrong, TRUE AS tight FROM container_sizes CROSS JOIN documents WHERE container IS NOT NULL AND capacity_tokens > 0 GROUP BY container"}
QUERIES = {"p8_containers": p8_containers, "p8_fill": p8_fill, "p8_invariants": p8_invariants}
