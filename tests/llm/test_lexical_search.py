import math
import random
import re
from collections import Counter

from evalframe.llm import lexical_search as ls

WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def terms(text):
    return [w.translate(LOWER) for w in WORD.findall(text or "")]


def brute(docs, items, top=10):
    """(item, rank, key, score) by scoring every document."""
    held = [(k, Counter(terms(t))) for k, t in docs if terms(t)]
    n, total = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(w for _, c in held for w in c)
    out = []
    for item, text in items:
        scored = []
        for key, c in held:
            m = 100 - 75 + (75 * sum(c.values()) * n) // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * ((10**9 * c[w]) // (1000 * c[w] + 8 * m)) for w in terms(text) if c[w])
            if s > 0:
                scored.append((-s, key is not None, key, s))
        scored.sort(key=lambda x: (x[0], x[1], x[2] or 0))
        out += [(item, i, x[2], x[3]) for i, x in enumerate(scored[:top], 1)]
    return sorted(out, key=repr)


def case(n=400):
    rnd = random.Random(11)
    vocab = [f"w{int(i)}" for i in range(120)] + ["Été", "X9", "the"]
    weights = [1 / (i + 1) for i in range(len(vocab))]
    docs = [(i, ", ".join(rnd.choices(vocab, weights, k=rnd.choice([1, 5, 40, 200])))) for i in range(n)]
    docs += [(1000 + i, docs[7][1]) for i in range(15)] + [(2000, None), (2001, "--"), (2002, "The THE the"), (None, docs[3][1])]
    items = [(i, " ".join(rnd.choices(vocab, k=rnd.choice([1, 3, 12, 30])))) for i in range(12)]
    items += [(100, None), (101, "!?"), (102, "nowhere found"), (103, docs[7][1]), (104, "the the w1 w1 w1")]
    return docs, items


def test_equals_brute_force(spark):
    docs, items = case()
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    b = spark.createDataFrame([*items, items[0]], "item_id long, text string")
    for cfg in (ls.Settings(), ls.Settings(shard_postings=150), ls.Settings(item_words=20), ls.Settings(top=3, shard_postings=300)):
        got = sorted(map(tuple, ls.search(d, b, cfg).collect()), key=repr)
        assert got == brute(docs, items, cfg.top)


def test_documents_that_cannot_win_are_skipped():
    """Lists of which one can be skipped as a whole once the heap is full."""
    n = 5000
    rare = (1000, [3, 40, 4000, ls._END], [1000, 999, 998])
    read = []

    class Watched(list):
        def __getitem__(self, i):
            read.append(i)
            return super().__getitem__(i)

    common = (5, [*range(n), ls._END], Watched([5] * n))
    assert sorted(ls.wand([rare, common], 3, 1), reverse=True) == [(1005, 3), (1004, 40), (1003, 4000)]
    assert len(read) < 50


def test_edges(spark):
    d = spark.createDataFrame([(1, "a b", 9), (2, "b", 9)], "doc_id int, text string, score int")
    b = spark.createDataFrame([("i", "b")], "item_id string, text string")
    assert [tuple(r) for r in ls.search(d, b).orderBy("rank").select("item", "rank", "key").collect()] == [("i", 1, 2), ("i", 2, 1)]
    assert ls.search(d.limit(0), b).count() == 0
    assert ls.search(d, b.limit(0)).columns == ["item", "rank", "key", "score"]
    two = spark.createDataFrame([("i", "b"), ("i", "a")], "item_id string, text string")
    assert ls.search(d, two).count() == 3
