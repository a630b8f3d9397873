import random

from evalframe.llm import ngram_jaccard as nj
from evalframe.llm.queries import op2_ngram_jaccard


def shingles(text, n=4):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def brute(docs, n=4, pct=85):
    sets = {i: shingles(t, n) for i, t in docs}
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= pct * len(x | y):
                ra, rb = root(a), root(b)
                up[max(ra, rb)] = min(ra, rb)
    return {i: (len(sets[i]), root(i)) for i in ids}


def case():
    rnd = random.Random(11)
    prose = lambda n: [f"w{rnd.randrange(3000)}" for _ in range(n)]
    docs, key = [], 1000
    passage = prose(60)
    for size in (5, 20, 60, 78, 90, 96, 120, 300, 900):
        base = prose(size)
        for _ in range(14):
            w = list(base)
            for _ in range(rnd.randrange(0, max(2, size // 25))):
                w[rnd.randrange(len(w))] = f"e{rnd.randrange(10**6)}"
            if rnd.random() < 0.3:
                w = w[rnd.randrange(1 + size // 12) :]
            docs.append((key, " ".join(w)))
            key -= 1
        docs.append((key, " ".join(prose(size) + passage)))
        key -= 1
    docs += [(2000, None), (2001, ""), (2002, " \n"), (2003, "A b"), (2004, "a  B"), (2005, "a b c"), (2006, "a b c d")]
    docs += [(2007, docs[0][1].upper()), (2008, docs[100][1]), (2009, "é É"), (2010, "É é")]
    return docs


def test_query_equals_brute_force(spark, tmp_path):
    docs = case()
    df = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, n long")
    df.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in op2_ngram_jaccard(spark, str(tmp_path)).collect()}
    want = brute(docs)
    assert got == want
    assert len({c for _, c in want.values()}) < len(want) - 60


def test_default_settings_and_empty(spark):
    docs = [(i, " ".join(f"v{k}" for k in range(50) if k != 49 - i)) for i in range(3)]
    df = spark.createDataFrame([*docs, docs[0]], "doc_id long, text string")
    got = sorted((r.doc_id, r.component_id) for r in nj.near_duplicates(df).collect())
    want = brute(docs, 5, 80)
    assert got == sorted([(i, c) for i, (_, c) in want.items()] + [(0, want[0][1])])
    assert nj.near_duplicates(df.limit(0)).count() == 0
