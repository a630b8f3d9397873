import math
import struct
from collections import defaultdict

import pytest
import xxhash

from evalframe.llm import mixing as mx


def long_hash(x, seed):
    return xxhash.xxh64(struct.pack("<q", x), seed).intdigest()


def int_hash(x, seed):
    return xxhash.xxh64(struct.pack("<i", x), seed).intdigest()


def as_signed(h):
    return h - (1 << 64) if h >> 63 else h


def case():
    docs = []
    for src, n, size in (("big", 600, 20), ("mid", 120, 15), ("small", 30, 9), (None, 20, 7)):
        docs += [(len(docs) + i, " ".join(["w"] * (size + i % 5)), src, 1) for i in range(n)]
    docs += [(9000, None, "mid", 1), (9001, "", "small", 1), (9002, "lone " * 4000, "long", 1), (9003, " ", "blank", 1)]
    return docs


SCHEMA = "doc_id long, text string, source string, _src int"


def weights_of(total, cfg, budget):
    """The flattest exponent by plain bisection."""
    whole, n = sum(total.values()), len(total)

    def at(x):
        z = sum((t / whole) ** x for t in total.values())
        return {s: (t / whole) ** x / z for s, t in total.items()}

    def allowed(x):
        w = at(x)
        h = -sum(v * math.log(v) for v in w.values())
        repeat = max(w[s] * budget / total[s] for s in total)
        return (cfg.entropy is None or h <= cfg.entropy * math.log(n) + 1e-12) and (
            cfg.max_repeat is None or repeat <= max(cfg.max_repeat, budget / whole) + 1e-12
        )

    low, high = 0.0, 1.0
    if n < 2:
        return at(1.0)
    if allowed(low):
        return at(low)
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (low, mid) if allowed(mid) else (mid, high)
    return at(high)


def brute(docs, cfg):
    """(key, epoch, block, place) of every row of the mixture, and the quotas."""
    sizes = {i: len((t or "").split()) for i, t, *_ in docs}
    by = defaultdict(dict)
    for i, _, s, _ in docs:
        by[s or ""][i] = as_signed(int_hash(cfg.seed, long_hash(i, 42)))
    total = {s: sum(sizes[i] for i in d) for s, d in by.items()}
    total = {s: t for s, t in total.items() if t}
    budget = cfg.budget or sum(total.values())
    out, quotas = [], {}
    for s, w in weights_of(total, cfg, budget).items():
        quota = quotas[s] = int(w * budget * (1 + 1e-12) + 1e-6)
        order = sorted(by[s], key=lambda i: (by[s][i], i))
        most = max(cfg.block_tokens, -(-total[s] // cfg.most_blocks))
        blocks, run, start, bucket = defaultdict(list), 0, 0, None
        for i in order:
            if by[s][i] >> 44 != bucket:  # a block starts at a bucket
                start, bucket = run, by[s][i] >> 44
            blocks[min(start, total[s] - 1) // most].append(i)
            run += sizes[i]
        name = xxhash.xxh64(s.encode(), 42).intdigest()
        for epoch in range(-(-quota // total[s]) if quota else 0):
            seeded = lambda b: as_signed(int_hash(cfg.seed, int_hash(b, long_hash(epoch, name))))  # noqa: E731, B023
            at, left = 0, quota - epoch * total[s]
            for b in sorted(blocks, key=lambda b: (seeded(b), b)):
                if at >= left:
                    break
                used = at
                for i in blocks[b]:
                    used += sizes[i]
                    if used > left:
                        break
                    out.append((i, epoch, b, round((epoch * total[s] + at) / quota, 9)))
                at += sum(sizes[i] for i in blocks[b])
    return sorted(out), quotas


def check(spark, cfg, docs):
    df = spark.createDataFrame(docs, SCHEMA)
    rows = mx.mix_sources(df.repartition(3), cfg).collect()
    want, quotas = brute(docs, cfg)
    assert sorted((r.doc_id, r.epoch, r.block, round(r.place, 9)) for r in rows) == want
    sizes = {d[0]: len((d[1] or "").split()) for d in docs}
    used, blocks = defaultdict(int), defaultdict(int)
    for r in rows:
        assert r.n_tokens == sizes[r.doc_id]
        used[r.source or ""] += r.n_tokens
        blocks[r.source, r.epoch, r.block] += r.n_tokens
    for s, quota in quotas.items():
        assert quota - max(sizes[d[0]] for d in docs if (d[2] or "") == s) < used[s] <= quota
    assert all(t <= cfg.block_tokens + 4000 * (s == "long") + 24 for (s, _, _), t in blocks.items())
    w = {r.src: r for r in mx.source_weights(df.select(mx.F.coalesce("source", mx.F.lit("")).alias("src"), mx.F.size(mx.words(mx.F.col("text"))).cast("long").alias("n_tokens")), cfg).collect()}
    return w, rows


def test_entropy_target(spark):
    w, _ = check(spark, mx.Settings(entropy=0.8, max_repeat=None, block_tokens=500), case())
    h = -sum(r.weight * math.log(r.weight) for r in w.values()) / math.log(len(w))
    assert abs(h - 0.8) < 1e-6 and abs(sum(r.weight for r in w.values()) - 1) < 1e-9


def test_repetition_limit_budget_and_order(spark):
    cfg = mx.Settings(entropy=None, max_repeat=3.0, budget=30_000, block_tokens=200)
    w, rows = check(spark, cfg, case())
    assert 2.99 < max(r.weight * cfg.budget / r.tokens for r in w.values()) <= 3.0 + 1e-9
    order = [(r.epoch, r.block) for r in sorted((r for r in rows if r.source == "big"), key=lambda r: (r.place, r.turn))]
    assert order != sorted(order)  # blocks are permuted
    first = [r for r in rows if r.place < 0.5]
    for s in ("big", "mid", "small"):
        part = sum(r.n_tokens for r in first if r.source == s) / sum(r.n_tokens for r in rows if r.source == s)
        assert abs(part - 0.5) < 0.2


def test_edges(spark):
    docs = case()
    df = spark.createDataFrame(docs, SCHEMA)
    assert mx.mix_sources(df.limit(0)).count() == 0
    one = mx.mix_sources(df.where("source = 'long'"), mx.Settings(budget=12_000)).select("epoch").collect()
    assert sorted(r.epoch for r in one) == [0, 1, 2]
    assert mx.mix_sources(df.where("doc_id = 9000")).count() == 0
    twice = df.where("source = 'mid'")
    assert mx.mix_sources(twice.unionByName(twice)).count() == 2 * twice.count()
    odd = twice.select("doc_id", "text", "source", mx.F.lit(1).alias("u"), mx.F.lit(2).alias("bucket"), mx.F.lit(3).alias("_srcu"))
    assert {(r.u, r.bucket, r._srcu) for r in mx.mix_sources(odd).collect()} == {(1, 2, 3)}
    with pytest.raises(ValueError):
        mx.mix_sources(df.withColumn("epoch", mx.F.lit(1)))
