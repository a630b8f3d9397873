import hashlib
import random

from evalframe.llm import substring_dedup as sd
from evalframe.llm.queries import op4_substring_dedup


def brute(docs, window=50):
    words = {i: (t or "").encode().split() for i, t in docs}
    first = {}
    for i in sorted(words):
        w = words[i]
        for k in range(len(w) - window + 1):
            first.setdefault(tuple(w[k : k + window]), i)
    out = {}
    for i, w in words.items():
        gone = set()
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < i:
                gone |= set(range(k, k + window))
        left = [x for k, x in enumerate(w) if k not in gone]
        out[i] = (len(w), len(gone), hashlib.sha256(b" ".join(left)).hexdigest())
    return out


def case():
    rnd = random.Random(5)
    def prose(n):
        return [rnd.choice(["été", "a", "b"]) + str(rnd.randrange(900)) for _ in range(n)]
    passage, longer = prose(60), prose(300)
    docs = []
    for i in range(40):
        w = prose(rnd.randrange(200))
        if i % 3 == 0:
            k = rnd.randrange(len(w) + 1)
            cut = passage[rnd.randrange(4) : 60 - rnd.randrange(12)]
            w = w[:k] + cut + w[k:]
        if i % 4 == 0:
            a = rnd.randrange(200)
            w = w + longer[a : a + 40 + rnd.randrange(60)]
        docs.append((100 - i, rnd.choice([" ", "\n", " \t"]).join(w)))
    same = docs[0][1]
    docs += [(200, same), (201, same.replace(" ", "  ")), (202, "x " * 200), (203, "x " * 60), (204, None), (205, "")]
    docs += [(206, " ".join(longer)), (207, " ".join(longer[:150] + ["edit"] + longer[151:])), (5, "x " * 49)]
    return docs


def test_query_equals_brute_force(spark, tmp_path):
    docs = case()
    df = spark.createDataFrame([(i, t, "s") for i, t in docs], "doc_id long, text string, source string")
    df.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in op4_substring_dedup(spark, str(tmp_path)).collect()}
    assert got == brute(docs)
    assert sum(r[1] > 0 for r in got.values()) > 10


def test_text_and_edges(spark):
    df = spark.createDataFrame([(2, "p q r s z"), (1, "a p q r s b"), (1, "a p q r s b")], "doc_id long, text string")
    cfg = sd.Settings(window=4, phrase=2)
    got = sorted((r.doc_id, r.clean_text) for r in sd.deduplicated_text(df, cfg).collect())
    assert got == [(1, "a p q r s b"), (1, "a p q r s b"), (2, "z")]
    assert sd.deduplicated_text(df.limit(0), cfg).count() == 0


def test_the_automaton_finds_the_occurrences(spark, monkeypatch):
    """Small shards and blocks give the same rows; with empty automata nothing but whole copies is found."""
    docs = case()
    df = spark.createDataFrame(docs, "doc_id long, text string")
    cfg = sd.Settings(shard_phrases=3, block_words=200)
    spans = {(r.doc_id, tuple(tuple(s) for s in r.spans)) for r in sd.find_repeats(df, cfg).collect()}
    assert spans == {(r.doc_id, tuple(tuple(s) for s in r.spans)) for r in sd.find_repeats(df).collect()}
    assert {i for i, _ in spans} == {i for i, x in brute(docs).items() if x[1]}

    def emptied(owners, cfg, text):
        return owners.sparkSession.createDataFrame([], "shard int, h bigint, numbers array<bigint>")

    monkeypatch.setattr(sd, "_phrases", emptied)
    left = {r.doc_id for r in sd.find_repeats(df).collect()}
    assert left < {i for i, _ in spans} and left == {200, 201}


def test_phrases_are_found_wherever_they_occur():
    import numpy as np

    from evalframe.llm.token_hash import WordHashes

    words = WordHashes().of("a b c a b c d a b".encode().split())
    shard = sd.Phrases()
    shard.add(7, sd.word_numbers(words[:3]))
    shard.add(8, sd.word_numbers(words[:3]))
    shard.compile()
    assert shard.occurrences(words, 3) == ([0, 0, 3, 3], [7, 8, 7, 8])
    empty = sd.Phrases()
    empty.compile()
    assert empty.occurrences(words, 3) == ([], []) and shard.occurrences(np.zeros(0, np.uint64), 3) == ([], [])


def test_repeated_keys_very_long_texts_and_clashing_names(spark):
    rnd = random.Random(3)
    passage = [f"p{k}" for k in range(70)]
    long = [f"w{rnd.randrange(10**6)}" for _ in range(300_000)]
    a, b = " ".join(long[:1000] + passage + long[1000:]), " ".join(["x"] + passage)
    docs = [(1, b), (2, a), (2, "y " + b), (2, "y " + b), (3, "short text"), (3, " ".join(passage))]
    df = spark.createDataFrame([(i, t, 1, 2, 3) for i, t in docs], "doc_id long, text string, key int, mark int, shard int")
    got = sorted((r.doc_id, len(r.clean_text.split()), r.key, r.mark, r.shard) for r in sd.deduplicated_text(df).collect())
    assert got == [(1, 71, 1, 2, 3), (2, 1, 1, 2, 3), (2, 1, 1, 2, 3), (2, 300_000, 1, 2, 3), (3, 0, 1, 2, 3), (3, 2, 1, 2, 3)]
