"""Buckets of the same ids, and groups of edited copies that link only through the least edited one."""

import random

from pyspark.sql import functions as F

from evalframe.llm import linking
from evalframe.llm import ngram_jaccard as nj


def test_buckets_of_the_same_ids_and_a_star_are_settled_in_few_pairs(spark):
    n, asked = 60, []
    hub = n // 2
    buckets = [(t, i) for t in range(40) for i in range(n)] + [(100 + t, hub) for t in range(3)] + [(100 + t, n + t) for t in range(3)]
    buckets += [(100 + t, n + 10 + t) for t in range(3)]
    keyed = spark.createDataFrame(buckets, "t long, id long").repartition(3)

    def verify(pairs, _):
        asked.extend(pairs.collect())
        return pairs.where((F.col("a") == hub) | (F.col("b") == hub)).select("a", "b")

    comp = linking.link_groups(keyed, lambda _: (None, verify))
    found = {r.node: r.component for r in comp.collect()}
    assert {i: found[i] for i in range(n)} == {i: 0 for i in range(n)}
    assert all(found[n + t] == found[n + 10 + t] == 0 for t in range(3))
    # Each is asked for once or twice: not in each of the forty buckets, nor against all others.
    assert len(asked) < 3 * n


def test_sets_just_under_the_threshold_do_not_pass_the_bits(spark):
    rnd = random.Random(5)
    base = [f"w{i}" for i in range(420)]
    docs = []
    for i in range(12):
        w = list(base)
        for k in rnd.sample(range(5, 410), 9 + i % 3):
            w[k] = f"e{i}_{k}"
        docs.append((i, " ".join(w)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    full = nj._full_sets(df, nj.Settings(n=4, threshold_pct=85), "doc_id", "text")
    rows = [r.asDict() for r in full.collect()]
    sets = spark.createDataFrame(full.collect(), full.schema)
    x, y = sets.alias("x"), sets.alias("y")
    side = lambda s: lambda c: F.col(f"{s}.{c}")
    passed = {(r.a, r.b) for r in x.join(y, (F.col("x.id") < F.col("y.id")) & nj._may_link(85)(side("x"), side("y"))).select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).collect()}
    like = {}
    for p in rows:
        for q in rows:
            if p["id"] < q["id"]:
                a, b = set(p["grams"]), set(q["grams"])
                like[p["id"], q["id"]] = 100 * len(a & b) / len(a | b)
    assert {k for k, v in like.items() if v >= 85} <= passed
    assert sum(v < 83 for v in like.values()) > 40 and not any(like[k] < 78 for k in passed)
