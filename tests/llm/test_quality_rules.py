import re

from evalframe.llm import quality_rules as qr

TEXTS = [
    None, "", "   \n\t ", "one", "a b c d e f g h", "a b c d e f g h " * 3, "x y z  w", "l1 a\nl1 a\n\n\nl2\nl1 a",
    "the " * 40, "a#b $$ %%% <p> & |", " ".join(f"w{i % 9}" for i in range(60)), "\x0b\x0ca\rb", "é ü 😀 😀",
    " ".join(f"u{i}" for i in range(500)) + " " + " ".join(f"u{i}" for i in range(100, 120)),
]


def brute(text):
    t = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    wins = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    seen = {}
    for w in wins:
        seen[w] = seen.get(w, 0) + 1
    hit = {j for i, w in enumerate(wins) if seen[w] > 1 for j in range(i, i + 8)}
    return (
        len(words), sum(map(len, words)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit),
    )


def test_counts_equal_brute_force(spark):
    df = spark.createDataFrame([(i, t, "en") for i, t in enumerate(TEXTS)], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in qr.text_counts(df).collect()}
    for i, t in enumerate(TEXTS):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(t), t


def test_binomial_cdf(spark):
    from math import comb

    df = spark.createDataFrame([(k, n) for n in (1, 10, 300) for k in (0, 1, 5) if k <= n], "k long, n long")
    for r in df.select("k", "n", qr.binomial_cdf(df.k, df.n, 0.03).alias("p")).collect():
        want = sum(comb(r.n, i) * 0.03**i * 0.97 ** (r.n - i) for i in range(r.k + 1))
        assert abs(r.p - want) < 1e-9


def test_rules_reject_junk_and_respect_the_risk(spark):
    plain = " ".join(f"word{i}" for i in range(40))
    junk = " ".join(f"w{i}%%%&&&" for i in range(40))
    rows = [(i, plain + f" p{i}", None) for i in range(1800)] + [(5000 + i, junk + f" j{i}", None) for i in range(50)]
    docs = spark.createDataFrame([*rows, rows[0]], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1) for i in range(1800)] + [(5001, None)], "doc_id long, quality int")
    got = {r.doc_id: r.kept for r in qr.quality_rules(docs, labels).collect()}
    assert all(got[i] for i in range(1800)) and not any(got[5000 + i] for i in range(50))
    assert qr.quality_rules(docs, labels).count() == 1851


def test_without_labels_only_base_rules_hold(spark):
    docs = spark.createDataFrame([(1, "a " * 30, "x"), (2, None, None)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    got = {r.doc_id: (r.base_failed, r.kept) for r in qr.quality_rules(docs, labels).collect()}
    assert got == {1: (True, False), 2: (True, False)}
    assert qr.quality_rules(docs.limit(0), labels).count() == 0


def test_chosen_cutoffs_equal_those_of_the_sql(spark, tmp_path):
    """Enough labelled documents for cutoffs in two strata; the verdicts are those of the query's SQL."""
    import random

    import duckdb

    from evalframe.llm import oracles
    from evalframe.llm.queries import op1_quality_rules

    rnd = random.Random(4)
    docs, labels = [], []
    for i in range(5200):
        lang = ("xx", "yy", "zz")[0 if i < 2500 else 1 if i < 5000 else 2]
        words = [f"word{rnd.randrange(10**6)}" for _ in range(24)]
        if i % 50 == 0:
            words = [w + "%%&" for w in words]
        if i % 50 == 1:
            words = words[:12] * 2
        docs.append((i, " ".join(words) + ("\nline" * 9 if i % 50 == 2 else ""), lang))
        labels.append((i, int(i % 50 > 2)))
    docs += [(6000, None, None), (6001, "", "xx"), (6002, "%% " * 50_000 + " ".join(f"v{k}" for k in range(50_000)), "xx")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {r.doc_id: tuple(r) for r in op1_quality_rules(spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    cur = con.execute(oracles.quality_rules())
    names = [d[0] for d in cur.description]
    cols = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    want = {r[names.index("doc_id")]: tuple(r[names.index(c)] for c in cols) for r in cur.fetchall()}
    assert got == want
    judged = {i: got[i][-1] for i, _ in labels if not got[i][-2]}
    junk = [i for i in judged if i % 50 <= 2 and i < 5000]
    assert junk and sum(judged[i] for i in junk) < len(junk) and all(judged[i] for i in judged if i % 50 > 2)
    # 200 labels are too few for a cutoff in the third stratum: only the base rules judge there.
    assert all(judged[i] for i in judged if i >= 5000)
