import random

import numpy as np
from pyspark.sql import functions as F

from evalframe.llm import quality_model as qm
from evalframe.llm import toxicity as tx


def prose(rnd, n=60):
    return ". ".join(" ".join(f"w{rnd.randrange(300)}" for _ in range(8)) for _ in range(n // 8)) + "."


def test_toxicity_finds_documents_and_sentences(spark):
    rnd = random.Random(1)
    rows = []
    for i in range(400):
        parts = prose(rnd).split(". ")
        if i % 4 == 0:
            parts[2] = f"you vileword{rnd.choice('abc')} thing w1"
        rows.append((i, ". ".join(parts), int(i % 4 == 0)))
    rows += [(1000, None, 1), (1001, "", 0), (1002, "...", None)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    got = {r.doc_id: r for r in tx.score_toxicity(docs, labels, F.col("doc_id") % 2 == 0).collect()}
    assert len(got) == 403 and got[1000].score == got[1001].score == 0.0
    for i, _, y in rows[:400]:
        assert got[i].predicted == y
        assert [s.n for s in got[i].sentences] == ([2] if y else [])


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b. c")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert 0 <= tx.score_toxicity(docs, none, F.lit(True)).first().score <= 1
    assert tx.score_toxicity(docs.limit(0), none, F.lit(True)).count() == 0


def test_quality_model_separates_and_keeps_rows(spark):
    rnd = random.Random(2)
    rows = []
    for i in range(600):
        t = prose(rnd, 40)
        if i % 3 == 0:
            t = " ".join(w + rnd.choice(["%%%", "&&&"]) for w in t.split()) if i % 2 else t.upper()
        rows.append((i, t, int(i % 3 != 0)))
    rows += [(1000, None, 0), (1001, "", None)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, quality int")
    got = {r.doc_id: r for r in qm.score_quality(docs, labels, F.col("doc_id") % 4 < 2).collect()}
    assert len(got) == 602 and all(0 <= r.score <= 1 for r in got.values())
    assert np.mean([got[i].predicted == y for i, _, y in rows[:600]]) > 0.98
    none = labels.limit(0)
    assert qm.score_quality(docs, none, F.lit(True)).count() == 602
    assert qm.score_quality(docs.limit(0), none, F.lit(True)).count() == 0


def test_pairs_learn_what_no_single_feature_shows():
    rnd = np.random.default_rng(0)
    x = np.zeros((4000, len(qm.FEATURES)))
    x[:, 0], x[:, 1] = rnd.random(4000), rnd.random(4000)
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = qm.fit(x, y)
    assert (0, 1) in model.pairs and ((model.score(x) > 0.5) == y).mean() > 0.95
