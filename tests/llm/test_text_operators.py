import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from strandmill.llm import mixing, packing, spans
from strandmill.llm.tokens import token_lengths
from strandmill.runtime import prefix_sums

WORDS = [f"w{i:x}" for i in range(900)]


def test_prefix_sums(spark):
    rng = random.Random(1)
    rows = [(rng.choice([None, "a", "a", "b"]), i, rng.choice([None, 0, 3, 5])) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, i long, v long").repartition(3)
    for group in ("g", None):
        run, want = defaultdict(int), {}
        for g, i, v in rows:
            run[g if group else 0] += v or 0
            want[i] = run[g if group else 0]
        assert {r.i: r.s for r in prefix_sums(df, group, ["i"], "v", "s").collect()} == want
    assert prefix_sums(df.filter("false"), "g", ["i"], "v", "s").count() == 0


def test_token_lengths(spark):
    import base64

    import tiktoken
    from strandmill.llm import tokens

    texts = [None, "", "hello world", "<|endoftext|>", "zażółć 日本語 🙂", "a" * 200_000]
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(tokens.VOCABULARY, "rb"))}
    enc = tiktoken.Encoding("x", pat_str=tokens.PATTERN, mergeable_ranks=ranks, special_tokens={})
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.n_tokens for r in token_lengths(df, "doc_id", "text").collect()} == {i: len(enc.encode_ordinary(t or "")) for i, t in enumerate(texts)}


def one_by_one(sizes, capacity):
    """Shortest pack first, one item at a time; the number of packs."""
    packs = []
    for s in sorted(sizes, reverse=True):
        short = min(packs, default=capacity)
        if short + s <= capacity:
            packs[packs.index(short)] += s
        else:
            packs.append(s)
    return len(packs)


def test_packing(spark):
    rng = random.Random(2)
    sizes = [rng.choice([None, 0, 7, 7, 7, rng.randrange(1, 60), rng.randrange(1, 400), 64, 128, 100_000]) if i % 50 == 0 else rng.choice([7, rng.randrange(1, 60), rng.randrange(1, 90)]) for i in range(3000)]
    df = spark.createDataFrame(list(enumerate(sizes)), "doc_id long, n_tokens long").withColumn("rank", F.lit("clash"))
    caps = {"small": 64, "big": 300}
    rows = packing.pack_items(df, caps).collect()
    for name, cap in caps.items():
        packs, parts = defaultdict(list), defaultdict(list)
        for r in rows:
            if r.container == name:
                packs[r.container_no].append((r["at"], r.n_tokens))
                parts[r.doc_id].append((r.part_no, r.start_token, r.n_tokens))
        empty = packs.pop(None)
        assert len(empty) == sum(not s for s in sizes) and all(n == 0 for _, n in empty)
        assert sorted(packs) == list(range(len(packs)))
        for items in packs.values():
            end = 0
            for at, n in sorted(items):
                assert at == end
                end = at + n
            assert end <= cap
        for i, s in enumerate(sizes):
            end = 0
            for k, (part, start, n) in enumerate(sorted(parts[i])):
                assert (part, start) == (k, end) and (n == cap or k == len(parts[i]) - 1)
                end += n
            assert end == (s or 0) and len(parts[i]) == max(1, -(-(s or 0) // cap))
        full = sum((s or 0) // cap for s in sizes)
        assert len(packs) == full + one_by_one([(s or 0) % cap for s in sizes if (s or 0) % cap], cap)
    assert packing.pack_items(df.filter("false"), caps).count() == 0
    with pytest.raises(ValueError):
        packing.pack_items(df, {"none": 0})


def test_mixing(spark):
    rng = random.Random(3)
    source = lambda: rng.choice([" Big ", "big", "BIG", "big", "mid", "mid", None, "stray"])
    docs = [(i, source(), rng.choice([None, 0, 5, 40, rng.randrange(1, 200)])) for i in range(4000)] + [(9000 + i, "tiny", 60) for i in range(20)]
    df = spark.createDataFrame(docs, "doc_id long, source string, n_tokens long")
    targets = spark.createDataFrame([("big", 0.5, 1), ("mid", 0.3, 2), ("Tiny", 0.1, 4), ("absent", 0.1, 3), (None, 0.2, 1)], "source string, target_share double, max_repeats int")
    rows = mixing.mix(df, targets, seed=1).collect()
    uses, got = defaultdict(int), defaultdict(int)
    size = {i: n for i, _, n in docs}
    for r in rows:
        uses[r.doc_id] += 1
        got[r.source] += r.n_tokens
        assert r.n_tokens == size[r.doc_id]
    whole = sum(got.values())
    limit = {"big": 1, "mid": 2, "tiny": 4}
    assert set(got) == set(limit) and all(uses[r.doc_id] <= limit[r.source] for r in rows)
    budget = int(20 * 60 * 4 / (0.1 / 0.9))
    assert budget - 200 * 3 <= whole <= budget
    assert all(abs(got[s] / whole - w / 0.9) < 0.03 for s, w in (("big", 0.5), ("mid", 0.3), ("tiny", 0.1)))
    order = sorted(rows, key=lambda r: r.running_tokens)
    assert [r.finish for r in order] == sorted(r.finish for r in rows) and order[-1].running_tokens == whole
    assert mixing.mix(df, targets, seed=1).orderBy("running_tokens").select("doc_id").collect() == [(r.doc_id,) for r in order]
    everything = mixing.mix(df, targets, budget=10**12).collect()  # every source runs out
    assert sum(r.n_tokens for r in everything) == sum((n or 0) * limit.get((s or "").strip().lower(), 0) for _, s, n in docs)
    assert mixing.mix(df.filter("false"), targets).collect() == [] and mixing.mix(df, targets.filter("false")).collect() == []


def brute(docs, span=200):
    where = defaultdict(set)
    for i, t in docs:
        for p in range(len(t or "") - span + 1):
            where[t[p : p + span]].add(i)
    pairs = {(a, b) for s in where.values() if len(s) > 1 for a in s for b in s if a < b}
    cover = {}
    for i, t in docs:
        mark = bytearray(len(t or ""))
        for p in range(len(t or "") - span + 1):
            if len(where[t[p : p + span]]) > 1:
                mark[p : p + span] = b"\1" * span
        cover[i] = sum(mark)
    return pairs, cover


@pytest.mark.parametrize("slice_, hot", [(1 << 20, 1000), (4096, 3)])
def test_shared_spans(spark, monkeypatch, tmp_path, slice_, hot):
    monkeypatch.setattr(spans, "SLICE", slice_)
    monkeypatch.setattr(spans, "HOT", hot)
    rng = random.Random(4)
    text = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    base = [text(300) for _ in range(6)]
    docs = [None, "", "short", "x" * 199, "HI MUM " * 40, "HI MUM " * 300 + text(50), "a" * 3000, text(60) + "a" * 700, "日本" * 150, text(20) + "日本" * 100 + "🙂"]
    for exact in (198, 199, 200, 201, 263, 264, 330):
        docs += [text(80) + "|" + base[0][:exact] + "|" + text(50), base[0][:exact], "~" + base[0][100 : 100 + exact] + "~"]
    for b in base[1:]:
        for _ in range(5):
            words = b.split(" ")
            for _ in range(rng.randrange(4)):
                words[rng.randrange(len(words))] = "edit"
            docs.append(" ".join(words))
        docs += [b, b, text(40) + b[:700] + text(30) + b[900:] + b[300:600]]
    docs.append(" ".join(base) * 3)
    rows = [(100 - i, t) for i, t in enumerate(docs)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"page_id": F.lit(1), "a": F.lit("clash"), "seed": F.lit(0)}).repartition(3)
    df.write.parquet(str(tmp_path / "documents.parquet"))
    pairs, cover = brute(rows)
    got = [tuple(r) for r in spans.p10_found(spark, str(tmp_path)).collect()]
    assert set(got) == pairs and len(got) == len(set(got))
    shared = {r.doc_id: r for r in spans.p10_shared(spark, str(tmp_path)).collect()}
    assert {i: r.shared_chars for i, r in shared.items()} == cover
    assert all(r.n_chars == len(dict(rows)[i] or "") for i, r in shared.items())
    stretches = defaultdict(list)
    for r in spans.p10_spans(spark, str(tmp_path)).collect():
        stretches[r.doc_id].append(r.end - r.start)
    assert all(sum(stretches[i]) == r.shared_chars and len(stretches[i]) == r.n_spans for i, r in shared.items())
    passages = spans.p10_passages(spark, str(tmp_path)).collect()
    assert all(0 < r.likeness and r.n_runs > 0 for r in passages)
    empty = df.filter("false")
    assert spans.shared_runs(empty, spans.text_classes(empty)).count() == 0


def best_chain(runs):
    best = [0] * len(runs)
    for j, (x, y, n) in enumerate(runs):  # sorted by x
        links = [best[i] - (x - p - m) - (y - q - m) for i, (p, q, m) in enumerate(runs[:j]) if p + m <= x and q + m <= y]
        best[j] = spans.GAIN * n + max([0, *links])
    return max(best)


def test_chains_have_the_best_score():
    rng = random.Random(5)
    for _ in range(200):
        runs = sorted(tuple(rng.randrange(1, hi) for hi in (4000, 4000, 60)) for _ in range(rng.randrange(1, 12)))
        number, score = spans.chain(*map(list, zip(*runs)))
        top = [r for r, c in zip(runs, number) if c == 0]
        gaps = sum(x - p - m + y - q - m for (p, q, m), (x, y, _) in zip(top, top[1:]))
        assert all(p + m <= x and q + m <= y for (p, q, m), (x, y, _) in zip(top, top[1:]))
        assert score == best_chain(runs) == spans.GAIN * sum(n for *_, n in top) - gaps and sorted(set(number)) == list(range(max(number) + 1))


def brute_runs(a, b):
    out = []
    for d in range(-len(a), len(b)):
        x = max(0, -d)
        while x < min(len(a), len(b) - d):
            n = 0
            while x + n < min(len(a), len(b) - d) and a[x + n] == b[x + n + d]:
                n += 1
            if n >= spans.SPAN:
                out.append((x, x + d, n))
            x += n + 1
    return sorted(out)


def test_passages_with_repeated_blocks(spark, tmp_path):
    rng = random.Random(9)
    text = lambda n: "".join(rng.choice("abcdefgh é") for _ in range(n))
    block, row, one = text(230), text(150), text(400)
    docs = [block + text(50) + block + text(80) + block, text(30) + block + text(20) + block, row * 4, text(10) + row * 3 + text(99), one + text(100) + row * 2, text(60) + one, "x" * 420, "y" + "x" * 300, "ab" * 150]
    spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    want = {(i, j): x for i, a in enumerate(docs) for j, b in enumerate(docs) if i < j and (x := brute_runs(a, b))}
    chains = {(r.doc_a, r.doc_b): (r.n_runs, r.longest, r.score) for r in spans.p10_chains(spark, str(tmp_path)).collect()}
    assert chains == {p: (len(x), max(n for *_, n in x), best_chain(x)) for p, x in want.items()} and (0, 1) in chains
    got = defaultdict(list)
    for r in spans.p10_passages(spark, str(tmp_path)).collect():
        got[r.a, r.b].append((r.chain, r.a_start, r.a_end, r.b_start, r.b_end, r.n_runs, r.n_equal))
    assert {p: sorted(x) for p, x in got.items()} == {p: sorted(spans._passages(x, spans.chain(*map(list, zip(*x)))[0])) for p, x in want.items()}


def test_chains_decide(spark, tmp_path, monkeypatch):
    rng = random.Random(10)
    block = ["".join(rng.choice("abcdefgh ") for _ in range(250)) for _ in range(2)]
    spark.createDataFrame([(1, block[0] + "-" * 9 + block[1]), (2, block[0] + block[1]), (3, block[1] + "+" + block[0])], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    score = lambda: {(r.doc_a, r.doc_b): r.score for r in spans.p10_chains(spark, str(tmp_path)).collect()}
    passages = lambda: spans.p10_passages(spark, str(tmp_path)).count()
    assert score() == {(1, 2): 20 * 500 - 9, (1, 3): 20 * 250, (2, 3): 20 * 250} and passages() == 5
    monkeypatch.setattr(spans, "chain", lambda xs, ys, ns: ([0] * len(ns), 0))
    assert set(score().values()) == {0} and passages() == 3
