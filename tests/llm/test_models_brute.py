"""Scores of the trained models against plain sums over their parameters, and training that repeated rows don't change."""

import math
import random

import pytest
from pyspark.sql import functions as F

from evalframe.llm import language_id as li
from evalframe.llm import quality_model as qm
from evalframe.llm import toxicity as tx


def texts(rnd, n):
    out = []
    for i in range(n):
        words = [f"w{rnd.randrange(200)}" for _ in range(rnd.randrange(1, 60))]
        bad = i % 3 == 0
        out.append((i, " ".join(w + "%$" if bad else w for w in words) + (". you vileone now." if bad else "."), int(bad)))
    return [*out, (900, None, 0), (901, "", 1), (902, "x " * 200_000, 0), (903, out[0][1], 1), (903, out[0][1], 1)]


@pytest.fixture(scope="module")
def tables(spark):
    rows = texts(random.Random(9), 240)
    docs = spark.createDataFrame([(i, t, "c", 1) for i, t, _ in rows], "doc_id long, text string, _y string, k int")
    labels = spark.createDataFrame([(i, y, 1 - y) for i, _, y in rows], "doc_id long, toxic int, quality int")
    return rows, docs, labels


def test_quality_scores_are_sums_of_table_entries(tables):
    rows, docs, labels = tables
    usable = F.col("doc_id") % 2 == 0
    model = qm.train(docs, labels, usable)
    got = {r.doc_id: r.score for r in qm.score_quality(docs, labels, usable).collect()}

    def place(edges, v):
        return sum(v >= e for e in edges)

    for i, t, _ in rows:
        x = qm.features(None if t is None else t.encode())
        z = model.bias + sum(table[place(e, v)] for e, table, v in zip(model.edges, model.tables, x))
        for (a, b), table in zip(model.pairs, model.pair_tables):
            z += table[place(model.pair_edges[a], x[a])][place(model.pair_edges[b], x[b])]
        assert got[i] == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-9)


def test_toxicity_scores_are_noisy_or_of_sentences(tables):
    rows, docs, labels = tables
    train = F.col("doc_id") % 2 == 1
    weights, bias = tx.fit(tx.sample(docs, labels, "toxic", train, 3000, "doc_id", "text"))
    got = {r.doc_id: r for r in tx.score_toxicity(docs, labels, train).collect()}
    for i, t, _ in rows:
        clean, bad = 1.0, []
        parts = [p.split() for p in "".join(c.lower() if c.isalnum() else "\n" if c in ".!?\n" else " " for c in t or "").split("\n")]
        for n, words in enumerate(w for w in parts if w):
            seen = sum(weights.get(f, 0.0) for w in dict.fromkeys(words) for f in {w.encode(), *(b"^" + w.encode()[:k] for k in (4, 5, 6) if len(w) >= k)})
            p = 1 / (1 + math.exp(-max(-30, min(30, bias + seen))))
            clean *= 1 - min(p, 1 - 1e-12)
            bad += [n] * (p >= 0.7)
        assert got[i].score == pytest.approx(1 - clean, abs=1e-9) and [s.n for s in got[i].sentences] == bad


def test_repeated_and_clashing_rows_change_nothing(spark, tables):
    rows, docs, labels = tables
    twice_docs, twice_labels = docs.unionByName(docs), labels.unionByName(labels)
    for score, usable in ((qm.score_quality, F.col("doc_id") % 2 == 0), (tx.score_toxicity, F.col("doc_id") % 2 == 0)):
        once = {r.doc_id: r.score for r in score(docs, labels, usable).collect()}
        again = score(twice_docs, twice_labels, usable).collect()
        assert len(again) == 2 * len(rows) and all(r.score == once[r.doc_id] and r._y == "c" for r in again)
        with pytest.raises(ValueError):
            score(docs.withColumnRenamed("k", "score"), labels, usable)


def test_language_posterior_is_the_product_of_the_evidence(spark):
    """Likelihood x declaration x host prior, multiplied out in Python over all pages."""
    rnd = random.Random(3)
    words = {"aa": "kato minos ruta selo", "bb": "shruth grumm blopf wuxz"}
    say = lambda lang, n: " ".join(rnd.choice(words[lang].split()) for _ in range(n))
    docs = spark.createDataFrame([(i, say(lang, 20), lang) for i, lang in enumerate(["aa", "bb"] * 20)], "doc_id long, text string, lang string")
    pages = []
    for i in range(60):
        lang = "aa" if i % 3 else "bb"
        told = {0: "aa", 1: "bb", 2: "zz"}[i % 5 % 3]
        pages.append((i, f"http://h{i % 4}.example.{'x' if i % 4 < 2 else 'y'}/", f'<html lang="{told}"><p>{say(lang, i % 4)}</p> 1 < 2 {say(lang, 1)}'))
    cfg = li.Settings()
    model = li.fit(docs, cfg)
    names, table = model
    got = {r.page_id: r for r in li.identify(spark.createDataFrame(pages, "page_id long, url string, html string"), model, cfg).collect()}

    facts = {}
    for i, url, html in pages:
        grams = li.trigrams(li.visible(html.encode()))
        ll = [cfg.weight * sum(table[k, g] for g in grams) for k in range(2)]
        ll = [max(x - max(ll), -cfg.most_nats) for x in ll]
        p = [math.exp(x) / sum(map(math.exp, ll)) for x in ll]
        host = url.split("/")[2]
        facts[i] = (ll, p, host, host.rsplit(".", 1)[1], html[12:14] if html[12:14] in names else "")
    total = [sum(f[1][k] for f in facts.values()) for k in range(2)]
    base = [(t + 1) / (len(facts) + 2) for t in total]
    for i, (ll, p, host, suffix, told) in facts.items():
        of = lambda c, v, k: sum(f[1][k] for f in facts.values() if f[c] == v)
        n = lambda c, v: sum(f[c] == v for f in facts.values())
        post = []
        for k in range(2):
            sp = (of(3, suffix, k) + cfg.suffix_prior * base[k]) / (n(3, suffix) + cfg.suffix_prior)
            hp = (max(of(2, host, k) - p[k], 0) + cfg.host_prior * sp) / (n(2, host) - 1 + cfg.host_prior)
            guess = 0.1 if told == "" else 0.8 if told == names[k] else 0.1
            said = (of(4, told, k) + cfg.declared_prior * guess) / (total[k] + cfg.declared_prior)
            post.append(math.exp(ll[k]) * hp * said)
        want = [x / sum(post) for x in post]
        assert got[i].posterior == pytest.approx(want, abs=1e-9) and got[i].lang == names[want.index(max(want))]


def test_plain_texts_keep_what_stands_after_a_bracket(spark):
    docs = spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate([("kato minos ruta", "aa"), ("shruth grumm", "bb")] * 5)], "doc_id long, text string, lang string")
    model = li.fit(docs, usable=F.col("doc_id") < 8)
    rows = spark.createDataFrame([(1, "if a < kato minos ruta kato", None)], "doc_id long, text string, url string")
    assert li.identify(rows, model, key="doc_id", html="text", markup=False).first().text_lang == "aa"
    assert li.visible(b"if a < b then the rest") == b"if a < b then the rest" and li.visible(b"x<br/>y</p><!-- z -->") .split() == [b"x", b"y"]
