"""Problem 10: long spans that stand verbatim in more than one record.

Collinear chaining. Of every text some k-mers are seeds: the smallest hashes of all windows of 64 consecutive k-mers, with
k such that a window spans ``SPAN`` characters, so that a common span of that length always has a seed in common. Seeds are
joined; matches of a pair that overlap on one diagonal melt into anchors. On the texts anchors grow to their full length, at
most a window to either side; those of at least ``SPAN`` characters are the exact runs that a pair shares, and they are chained
with gap costs through a Fenwick tree. A chain, aligned by its runs, is a passage that the two texts share up to edits. A
pair counts as soon as it has a chain. Equal texts are one class, and only its representative is compared. A row without a
doc_id is no record: it shares nothing, and nothing is shared with it.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from strandmill.runtime import materialise, table

SPAN, WINDOW = 200, 64
GAIN = 20  # a character of a run is worth as much as so many characters of gap
SLICE = 1 << 20
HOT = 1000  # texts with one seed beyond which its pairs are dealt out to several tasks
_B = 0x9E3779B97F4A7C15
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse, modulo 2^64."""
    if 0 not in _POWERS or len(_POWERS[0][0]) < n:
        size = max(n, SLICE)
        one = lambda b: np.cumprod(np.r_[np.uint64(1), np.full(size - 1, b, np.uint64)])
        _POWERS[0] = one(np.uint64(_B)), one(np.uint64(pow(_B, -1, 1 << 64)))
    return _POWERS[0][0][:n], _POWERS[0][1][:n]


def gram_hashes(codes: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of ``k`` code points: equal runs, equal hashes, wherever they stand."""
    n = len(codes)
    if n < k:
        return np.zeros(0, np.uint64)
    power, back = _powers(n)
    v = (codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    v ^= v >> np.uint64(32)
    v *= power
    sums = np.cumsum(v, out=v)
    h = sums[k - 1 :].copy()
    h[1:] -= sums[: n - k]
    h *= back[: n - k + 1]
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h |= np.uint64(1)
    return h


def _slide(x: np.ndarray, width: int, pick) -> np.ndarray:
    step = 1
    while step < width:
        x = pick(x[:-step], x[step:])
        step *= 2
    return x


def seeds(codes: np.ndarray, ends: np.ndarray, span: int = SPAN, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the seeds of texts that stand one after another in ``codes``; ``ends`` is, for each position, where its text ends."""
    k = span - window + 1
    if len(codes) < span:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = gram_hashes(codes, k)
    low = _slide(h, window, np.minimum)
    low[np.arange(len(low)) + span > ends[: len(low)]] = 0
    pad = np.zeros(window - 1, np.uint64)
    at = np.flatnonzero(_slide(np.r_[pad, low, pad], window, np.maximum) == h)
    return at, h[at]


def _seeding(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def made(ids: list[int], texts: list[str]) -> Iterator[pa.RecordBatch]:
        codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        sizes = np.array([len(t) for t in texts], np.int64)
        stops = np.cumsum(sizes)
        ends = np.repeat(stops, sizes)
        got = [(at + a, h) for a in range(0, max(len(codes) - SPAN + 1, 1), SLICE) for at, h in [seeds(codes[a : a + SLICE + SPAN - 1], ends[a : a + SLICE + SPAN - 1] - a)]]
        at, h = np.concatenate([x for x, _ in got]), np.concatenate([x for _, x in got])
        doc = np.searchsorted(stops, at, "right")
        at = at - (stops - sizes)[doc]
        order = np.lexsort((at, h, doc))
        doc, h, at = doc[order], h[order], at[order]
        twin = np.r_[False, (doc[1:] == doc[:-1]) & (h[1:] == h[:-1])]
        same = twin & np.r_[False, at[1:] == at[:-1]]  # from slices that overlap
        first = np.flatnonzero(~twin)
        many = np.add.reduceat((twin & ~same).astype(np.int64), first) > 0 if len(first) else np.zeros(0, bool)
        yield pa.RecordBatch.from_arrays([pa.array(h[first].view(np.int64)), pa.array(np.array(ids, np.int64)[doc[first]]), pa.array(at[first].astype(np.int32)), pa.array(many)], names=["seed", "doc", "pos", "many"])

    for b in batches:
        ids, texts, held = [], [], 0
        for i, t in zip(b.column(0).to_pylist(), b.column(1)):
            t = t.as_py()
            ids.append(i), texts.append(t)
            held += len(t)
            if held >= SLICE:
                yield from made(ids, texts)
                ids, texts, held = [], [], 0
        if ids:
            yield from made(ids, texts)


def chain(xs: list[int], ys: list[int], ns: list[int]) -> tuple[list[int], int]:
    """Number of the collinear chain of each run, best chains first, and the score of the best one.

    A chain scores ``GAIN`` for each character of its runs less one for each character of the gaps between them, on both
    sides. Prefix maxima over the ends in the second text come from a Fenwick tree.
    """
    count = len(ns)
    if count == 1:
        return [0], GAIN * ns[0]
    ranks = sorted({y + n for y, n in zip(ys, ns)})
    tree: list[tuple[int, int]] = [(-1, -1)] * (len(ranks) + 1)
    by_start, by_end = sorted(range(count), key=lambda i: xs[i]), sorted(range(count), key=lambda i: xs[i] + ns[i])
    score, before, done = [0] * count, [-1] * count, 0
    for j in by_start:
        while done < count and xs[by_end[done]] + ns[by_end[done]] <= xs[j]:
            i = by_end[done]
            value, r = (score[i] + xs[i] + ys[i] + 2 * ns[i], i), bisect_right(ranks, ys[i] + ns[i])
            while r < len(tree):
                if value > tree[r]:
                    tree[r] = value
                r += r & -r
            done += 1
        best, r = (-1, -1), bisect_right(ranks, ys[j])
        while r:
            best, r = max(best, tree[r]), r & (r - 1)
        gain = best[0] - xs[j] - ys[j] if best[1] >= 0 else 0
        score[j] = GAIN * ns[j] + max(gain, 0)
        before[j] = best[1] if gain > 0 else -1
    number, chains = [-1] * count, 0
    for j in sorted(range(count), key=lambda i: -score[i]):
        if number[j] < 0:
            while j >= 0 and number[j] < 0:
                number[j] = chains
                j = before[j]
            chains += 1
    return number, max(score)


PAIRS = "a bigint, b bigint, many boolean, pa array<int>, pb array<int>, n array<int>"


def _melting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Matches sorted by pair, diagonal and position, to one row a pair with its anchors."""
    k = SPAN - WINDOW + 1

    def pairs(cols: list[np.ndarray]) -> pa.RecordBatch:
        a, b, at, bt, many = cols
        pair = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]
        diagonal = bt - at
        new = pair | np.r_[True, (diagonal[1:] != diagonal[:-1]) | (at[1:] - at[:-1] > k)]
        first = np.flatnonzero(new)
        last = np.r_[first[1:], len(a)] - 1
        head = np.flatnonzero(pair[first])
        at_pair = np.flatnonzero(pair)
        offsets = pa.array(np.r_[head, len(first)].astype(np.int32))
        lists = [pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))) for x in (at[first], bt[first], at[last] - at[first] + k)]
        return pa.RecordBatch.from_arrays([pa.array(a[at_pair]), pa.array(b[at_pair]), pa.array(np.logical_or.reduceat(many, at_pair)), *lists], names=["a", "b", "many", "pa", "pb", "n"])

    held: list[np.ndarray] | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if held is not None:
            cols = [np.concatenate(x) for x in zip(held, cols)]
        a, b = cols[0], cols[1]
        cut = int(np.flatnonzero((a != a[-1]) | (b != b[-1]))[-1]) + 1 if (a[0], b[0]) != (a[-1], b[-1]) else 0
        if cut:
            yield pairs([c[:cut] for c in cols])
        held = [c[cut:] for c in cols]
    if held is not None:
        yield pairs(held)


def _extend(ta: str, tb: str, x: int, y: int, n: int) -> tuple[int, int]:
    """How far an anchor goes on to the left and to the right."""
    left = right = 0
    while x - left > 0 and y - left > 0 and ta[x - left - 1] == tb[y - left - 1]:
        left += 1
    x, y = x + n, y + n
    while x + right < len(ta) and y + right < len(tb) and ta[x + right] == tb[y + right]:
        right += 1
    return left, right


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _joined(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of positions at which two arrays are equal."""
    order = np.argsort(y, kind="stable")
    lo, hi = np.searchsorted(y[order], x, "left"), np.searchsorted(y[order], x, "right")
    i = np.repeat(np.arange(len(x)), hi - lo)
    return i, order[np.arange(len(i)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo) + lo[i]]


def _left_maximal(ha: np.ndarray, hb: np.ndarray, ca: np.ndarray, cb: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places ``(x, y)`` of equal hashes that nothing equal stands before. Places are grouped by hash and character before
    them, so that the inside of repeats makes no pairs."""

    def grouped(h: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        before = np.r_[np.int64(-1), c[: len(h) - 1].astype(np.int64)]
        order = np.lexsort((before, h))
        hs, bs = h[order], before[order]
        first = np.flatnonzero(np.r_[True, (hs[1:] != hs[:-1]) | (bs[1:] != bs[:-1])])
        return order, first, np.r_[first[1:], len(order)], hs[first], bs[first]

    oa, fa, la, xa, ba = grouped(ha, ca)
    ob, fb, lb, xb, bb = grouped(hb, cb)
    i, j = _joined(xa, xb)
    differs = (ba[i] != bb[j]) | (ba[i] < 0)
    for p, q in zip(i[differs].tolist(), j[differs].tolist()):
        for x in oa[fa[p] : la[p]].tolist():
            yield np.full(lb[q] - fb[q], x), ob[fb[q] : lb[q]]


def _equal_run(ca: np.ndarray, cb: np.ndarray, x: int, y: int) -> int:
    """How many characters from two places on are equal."""
    n, step, most = 0, 256, min(len(ca) - x, len(cb) - y)
    while n < most:
        m = min(step, most - n)
        if len(bad := np.flatnonzero(ca[x + n : x + n + m] != cb[y + n : y + n + m])):
            return n + int(bad[0])
        n, step = n + m, step * 2
    return n


def _all_runs(ta: str, tb: str) -> list[tuple[int, int, int]]:
    """All runs ``(start in a, start in b, length)`` of at least ``SPAN`` equal characters that go on to neither side."""
    ca, cb = _codes(ta), _codes(tb)
    out = []
    for xs, ys in _left_maximal(gram_hashes(ca, SPAN), gram_hashes(cb, SPAN), ca, cb):
        for x, y in zip(xs.tolist(), ys.tolist()):
            n = _equal_run(ca, cb, x, y)
            if n >= SPAN:  # equal hashes of unequal characters don't count
                out.append((x, y, n))
    return sorted(out)


def _runs(ta: str, tb: str, many: bool, xs: list[int], ys: list[int], ns: list[int]) -> list[tuple[int, int, int]]:
    if many:  # a seed repeats within a text, and the join has seen its first place only
        return _all_runs(ta, tb)
    grown = set()
    for x, y, n in zip(xs, ys, ns):
        left, right = _extend(ta, tb, x, y, n)
        if n + left + right >= SPAN and ta[x : x + n] == tb[y : y + n]:
            grown.add((x - left, y - left, n + left + right))
    return sorted(grown)


RUNS = "a bigint, b bigint, side int, start int, end int, chain int"
CHAINS = "a bigint, b bigint, n_runs int, longest int, score bigint"
PASSAGES = "a bigint, b bigint, chain int, a_start int, a_end int, b_start int, b_end int, n_runs int, n_equal int"


def _passages(runs: list[tuple[int, int, int]], number: list[int]) -> Iterator[tuple]:
    by: dict[int, list] = {}
    for c, run in zip(number, runs):
        by.setdefault(c, []).append(run)
    for c, g in by.items():
        yield c, min(x for x, *_ in g), max(x + n for x, _, n in g), min(y for _, y, _ in g), max(y + n for _, y, n in g), len(g), sum(n for *_, n in g)


def _aligning(schema: str):
    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for a, b, many, xs, ys, ns, ta, tb in zip(*(batch.column(i).to_pylist() for i in range(6)), batch.column(6), batch.column(7)):
                runs = _runs(ta.as_py(), tb.as_py(), many, xs, ys, ns)
                if not runs:
                    continue
                number, score = chain(*map(list, zip(*runs)))
                if schema == CHAINS:
                    out.append((a, b, len(runs), max(n for *_, n in runs), score))
                elif schema == PASSAGES:
                    out += [(a, b, *p) for p in _passages(runs, number)]
                else:
                    for (x, y, n), c in zip(runs, number):
                        out += [(a, b, 0, x, x + n, c), (a, b, 1, y, y + n, c)]
            fields = [f.split() for f in schema.split(", ")]
            cols = list(zip(*out)) or [[]] * len(fields)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if t == "bigint" else pa.int32()) for c, (_, t) in zip(cols, fields)], names=[n for n, _ in fields])

    return align


def text_classes(docs: DataFrame) -> DataFrame:
    """``(doc_id, rep, copies)`` of every document with a text of at least ``SPAN`` characters; equal texts share the smallest doc_id."""
    keyed = docs.filter((F.length("text") >= SPAN) & F.col("doc_id").isNotNull()).select("doc_id", F.md5("text").alias("h"))
    reps = keyed.groupBy("h").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"))
    return keyed.join(reps, "h").select("doc_id", "rep", "copies")


def _matches(found: DataFrame) -> DataFrame:
    """``(a, b, pa, pb, many)`` of each seed that two texts, a < b, have in common.

    A seed of more than ``HOT`` texts is dealt out: its texts on one side to several tasks, each of which gets all those on the other side.
    Seeds are made twice, for their counts and for the join: making them costs less than keeping them.
    """

    def met(left: DataFrame, right: DataFrame, *key: str) -> DataFrame:
        a, b = (x.select(*key, F.col("doc").alias(d), F.col("pos").alias(p), F.col("many").alias(m)) for x, d, p, m in ((left, "a", "pa", "ma"), (right, "b", "pb", "mb")))
        return a.join(b.hint("merge"), list(key)).filter("a < b").select("a", "b", "pa", "pb", (F.col("ma") | F.col("mb")).alias("many"))

    hot = materialise(found.groupBy("seed").agg(F.count("*").alias("texts")).filter(F.col("texts") > HOT).select("seed", F.ceil(F.col("texts") / HOT).cast("int").alias("deals")), "hot")
    if hot.isEmpty():
        return met(found, found, "seed")
    cold, warm = found.join(hot, "seed", "left_anti"), found.join(hot, "seed")
    dealt = warm.withColumn("deal", F.pmod(F.xxhash64("doc"), F.col("deals")).cast("int"))
    copied = warm.withColumn("deal", F.explode(F.sequence(F.lit(0), F.col("deals") - 1)))
    return met(cold, cold, "seed").unionByName(met(dealt, copied, "seed", "deal"))


def _chained(docs: DataFrame, classes: DataFrame, schema: str) -> DataFrame:
    """Seeds, matches, anchors, runs and chains of the class representatives, as rows of ``schema``."""
    texts = docs.select("doc_id", "text").join(classes.filter("doc_id = rep").select("doc_id"), "doc_id", "left_semi")
    found = texts.mapInArrow(_seeding, "seed bigint, doc bigint, pos int, many boolean")
    by_pair = _matches(found).repartition("a", "b").sortWithinPartitions("a", "b", F.col("pb") - F.col("pa"), "pa")
    pairs = by_pair.mapInArrow(_melting, PAIRS)
    both = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb")), "b")
    return both.select("a", "b", "many", "pa", "pb", "n", "ta", "tb").mapInArrow(_aligning(schema), schema)


def shared_runs(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """``(a, b, side, start, end, chain)``: spans of at least ``SPAN`` characters that two class representatives, a < b, share.

    ``side`` 0 places the span in a's text, 1 in b's. Texts that are null, empty or shorter than the span share nothing.
    """
    return _chained(docs, classes, RUNS)


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of documents with a chain, copies included, as the result's columns demand."""
    docs = _docs(spark, sf_dir)
    classes = materialise(text_classes(docs), "classes")
    pairs = _chained(docs, classes, CHAINS).select("a", "b")
    x, y = (classes.select(F.col("rep").alias(r), F.col("doc_id").alias(d)) for r, d in (("a", "x"), ("b", "y")))
    apart = pairs.join(x, "a").join(y, "b").select(F.least("x", "y").alias("doc_a"), F.greatest("x", "y").alias("doc_b"))
    copies = classes.filter("copies > 1").select("rep", "doc_id")
    within = copies.withColumnRenamed("doc_id", "doc_a").join(copies.withColumnRenamed("doc_id", "doc_b"), "rep").filter("doc_a < doc_b").select("doc_a", "doc_b")
    return apart.unionByName(within)


def p10_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each pair of class representatives its exact runs, the longest of them, and the score of the best chain."""
    docs = _docs(spark, sf_dir)
    return _chained(docs, materialise(text_classes(docs), "classes"), CHAINS).select(F.col("a").alias("doc_a"), F.col("b").alias("doc_b"), "n_runs", "longest", "score")


def _covered_parts(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """``(rep, start, end)``: the united stretches of each representative's text that also stand in another one's."""
    runs = shared_runs(docs, classes).select(F.when(F.col("side") == 0, F.col("a")).otherwise(F.col("b")).alias("rep"), "start", "end")
    longest = runs.groupBy("rep", "start").agg(F.max("end").alias("end"))  # at most one row for each position of a text
    w = Window.partitionBy("rep").orderBy("start")
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    islands = longest.withColumn("new", (reach.isNull() | (F.col("start") > reach)).cast("int")).withColumn("i", F.sum("new").over(w))
    return islands.groupBy("rep", "i").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("i")


def p10_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every document its stretches, from 0 and with exclusive ends, that also stand elsewhere; all of a text that has copies."""
    docs = _docs(spark, sf_dir)
    classes = materialise(text_classes(docs), "classes")
    copied = classes.filter("copies > 1").select("doc_id").join(docs, "doc_id").select("doc_id", F.lit(0).alias("start"), F.length("text").alias("end"))
    single = classes.filter("copies = 1").join(_covered_parts(docs, classes), "rep").select("doc_id", "start", "end")
    return single.unionByName(copied)


def p10_shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every document how much of its text also stands elsewhere, in how many stretches."""
    docs = _docs(spark, sf_dir)
    per = p10_spans(spark, sf_dir).groupBy("doc_id").agg(F.sum(F.col("end") - F.col("start")).alias("chars"), F.count("*").alias("n"))
    size, chars = F.coalesce(F.length("text"), F.lit(0)), F.coalesce("chars", F.lit(0))
    return docs.select("doc_id", size.alias("n_chars")).join(per, "doc_id", "left").select("doc_id", "n_chars", chars.alias("shared_chars"), F.when(F.col("n_chars") > 0, chars / F.col("n_chars")).otherwise(0.0).alias("shared_part"), F.coalesce("n", F.lit(0)).alias("n_spans"))


def p10_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fuzzy passages: one row a chain, between class representatives; ``likeness`` is the exact part of the longer side."""
    docs = _docs(spark, sf_dir)
    got = _chained(docs, materialise(text_classes(docs), "classes"), PASSAGES)
    return got.withColumn("likeness", F.col("n_equal") / F.greatest(F.col("a_end") - F.col("a_start"), F.col("b_end") - F.col("b_start")))


_GRAMS_SQL = """WITH g AS (SELECT doc_id, i, md5(substr(text, i, 200)) AS w FROM (SELECT doc_id, text, unnest(range(1, length(text) - 198)) AS i FROM documents WHERE length(text) >= 200)),
h AS (SELECT DISTINCT doc_id, w FROM g)"""
_SPANS_SQL = _GRAMS_SQL + """, m AS (SELECT w FROM h GROUP BY w HAVING count(*) > 1),
s AS (SELECT doc_id, i, CAST(i > coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), -1000) + 200 AS INT) AS new FROM g SEMI JOIN m USING (w)),
n AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM s),
spans AS (SELECT doc_id, CAST(min(i) - 1 AS INT) AS "start", CAST(max(i) + 199 AS INT) AS "end" FROM n GROUP BY doc_id, k)
"""
SQL = {
    "p10_found": _GRAMS_SQL + "SELECT DISTINCT a.doc_id AS doc_a, b.doc_id AS doc_b FROM h a JOIN h b ON a.w = b.w AND a.doc_id < b.doc_id",
    "p10_chains": """WITH RECURSIVE reps AS (SELECT min(doc_id) AS doc_id, text FROM documents WHERE length(text) >= 200 GROUP BY text),
g AS (SELECT doc_id, i, md5(substr(text, i, 200)) AS w FROM (SELECT doc_id, text, unnest(range(1, length(text) - 198)) AS i FROM reps)),
m AS (SELECT a.doc_id AS a, b.doc_id AS b, b.i - a.i AS d, a.i AS x FROM g a JOIN g b ON a.w = b.w AND a.doc_id < b.doc_id),
k AS (SELECT a, b, d, x, x - row_number() OVER (PARTITION BY a, b, d ORDER BY x) AS island FROM m),
runs AS (SELECT a, b, min(x) AS x, min(x) + d AS y, count(*) + 199 AS n FROM k GROUP BY a, b, d, island),
l AS MATERIALIZED (SELECT a, b, list(x ORDER BY x, y) AS xs, list(y ORDER BY x, y) AS ys, list(n ORDER BY x, y) AS ns, count(*) AS runs, max(n) AS longest FROM runs GROUP BY a, b),
s(a, b, j, scores) AS (
  SELECT a, b, 1, [20 * ns[1]] FROM l
  UNION ALL SELECT a, b, j + 1, list_append(scores, 20 * ns[j + 1] + greatest(0, coalesce(list_max(list_transform(range(1, j + 1),
    lambda i: CASE WHEN xs[i] + ns[i] <= xs[j + 1] AND ys[i] + ns[i] <= ys[j + 1] THEN scores[i] - (xs[j + 1] - xs[i] - ns[i]) - (ys[j + 1] - ys[i] - ns[i]) ELSE 0 END)), 0)))
  FROM s JOIN l USING (a, b) WHERE j < runs)
SELECT a AS doc_a, b AS doc_b, CAST(runs AS INT) AS n_runs, CAST(longest AS INT) AS longest, CAST(list_max(scores) AS BIGINT) AS score FROM s JOIN l USING (a, b) WHERE j = runs""",
    "p10_spans": _SPANS_SQL + "SELECT * FROM spans",
    "p10_shared": _SPANS_SQL + ", p AS (SELECT doc_id, CAST(sum(\"end\" - \"start\") AS BIGINT) AS c, count(*) AS n FROM spans GROUP BY doc_id) SELECT doc_id, coalesce(length(text), 0) AS n_chars, coalesce(c, 0) AS shared_chars, CASE WHEN length(text) > 0 THEN coalesce(c, 0) / length(text) ELSE 0 END AS shared_part, coalesce(n, 0) AS n_spans FROM documents LEFT JOIN p USING (doc_id)",
}
QUERIES = {"p10_found": p10_found, "p10_chains": p10_chains, "p10_spans": p10_spans, "p10_shared": p10_shared, "p10_passages": p10_passages}
