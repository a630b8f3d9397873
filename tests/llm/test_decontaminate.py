import random
import re

from evalframe.llm import decontaminate as dc
from evalframe.llm.queries import op5_decontaminate

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def brute(text, items, window=10):
    words = WORD.findall((text or "").translate(LOWER))
    hit, found = set(), set()
    for item, t in items:
        seq = WORD.findall((t or "").translate(LOWER))
        size = min(window, len(seq))
        for i in range(len(seq) - size + 1 if seq else 0):
            for k in range(len(words) - size + 1):
                if words[k : k + size] == seq[i : i + size]:
                    hit |= set(range(k, k + size))
                    found.add(item)
    return len(words), len(hit), sorted(found)


def case():
    rnd = random.Random(3)
    vocab = ["a", "b", "C", "é", "É", "x1", "9", "déjà"]
    items = [(i, " ".join(rnd.choice(vocab) for _ in range(rnd.choice([1, 4, 9, 10, 11, 30])))) for i in range(12)]
    items += [(50, None), (51, "..."), (52, items[3][1]), (53, "only three words")]
    docs = [(i, ", ".join(rnd.choice(vocab) for _ in range(60))) for i in range(12)]
    docs += [(100 + i, f"zz {t}! yy only three words {t}") for i, t in items if t]
    docs += [(200, None), (201, ""), (202, "Only-three WORDS"), (203, "ONLY three word")]
    return docs, items


def test_spans_equal_brute_force(spark):
    docs, items = case()
    long_items = [x for x in items if len(WORD.findall(x[1] or "")) != 1]
    d = spark.createDataFrame([*docs, docs[0]], "doc_id long, text string")
    b = spark.createDataFrame(long_items, "item_id long, text string")
    want = {i: brute(t, long_items) for i, t in docs}
    for most in (500_000, 20):  # one automaton in every task, shards
        got = dc.find_contamination(d, b, dc.Limits(automaton_words=most, block_words=300), with_text=True).collect()
        assert len(got) == len(docs) + 1
        for r in got:
            n_hit = sum(s.end - s.start for s in r.spans)
            assert (r.n_words, n_hit, r.item_ids) == want[r.doc_id], r.doc_id
            assert len(WORD.findall((r.clean_text or "").translate(LOWER))) == r.n_words - n_hit


def test_clean_text_keeps_what_is_not_covered(spark):
    d = spark.createDataFrame([(1, "Before it. Only, three words! After.")], "doc_id long, text string")
    b = spark.createDataFrame([(1, "only three words")], "item_id long, text string")
    assert dc.find_contamination(d, b, with_text=True).first().clean_text == "Before it. ! After."


def test_query_and_empty_tables(spark, tmp_path):
    docs, items = case()
    schema = "doc_id long, text string, lang string"
    spark.createDataFrame([(i, t, None) for i, t in docs], schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.doc_id: r for r in op5_decontaminate(spark, str(tmp_path)).collect()}
    for i, t in docs:
        n, hit, found = brute(t, items)
        assert (got[i].n_words, got[i].n_hit, got[i].n_items, got[i].contaminated) == (n, hit, len(found), hit > 0)
    none = spark.createDataFrame([], "item_id long, text string")
    d = spark.createDataFrame(docs, "doc_id long, text string")
    assert dc.find_contamination(d, none).where("size(spans) > 0").count() == 0
    assert dc.find_contamination(d.limit(0), none).count() == 0


def test_clashes_keys_and_long_texts(spark):
    import pytest

    docs, items = case()
    rnd = random.Random(1)
    long = " ".join(f"n{rnd.randrange(10**6)}" for _ in range(200_000))
    seq = [t for _, t in items if len(WORD.findall((t or "").translate(LOWER))) >= 11][0]
    rows = [(1, long + " " + seq, 5, 6, "s"), (1, seq + " " + long, 5, 6, "s"), (1, None, 5, 6, "s")]
    d = spark.createDataFrame(rows, "doc_id long, text string, t1 int, shard int, items string")
    wide = [x for x in items if len(WORD.findall((x[1] or "").translate(LOWER))) >= 10]
    b = spark.createDataFrame([(f"i{i}", t) for i, t in wide], "item_id string, text string")
    for most in (500_000, 20):
        got = dc.find_contamination(d, b, dc.Limits(automaton_words=most)).collect()
        assert sorted(len(r.spans) for r in got) == [0, 1, 1] and all((r.t1, r.shard, r.items) == (5, 6, "s") for r in got)
        assert {i for r in got for i in r.item_ids} >= {f"i{i}" for i, t in wide if t == seq}
    with pytest.raises(ValueError):
        dc.find_contamination(d.withColumnRenamed("items", "spans"), b)


def test_a_batch_holds_the_words_of_one_text_at_a_time(spark, monkeypatch):
    import tracemalloc

    from evalframe.llm import decontaminate as dc

    held = {}
    monkeypatch.setattr(dc, "map_texts", lambda df, factory, *a, **b: held.update(factory=factory, **b) or df)
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    items = spark.createDataFrame([("i", " ".join(f"q{k}" for k in range(12)))], "item_id string, text string")
    dc.find_contamination(docs, items, with_text=True)
    fn = held["factory"]()
    texts = [b" ".join(b"w%d" % (k * i) for k in range(400)) for i in range(1000)]
    tracemalloc.start()
    n = fn(texts)[0]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n.to_pylist() == [400] * 1000 and held["rows"] <= 1000
    assert peak < 2 * sum(map(len, texts))
