import random

import corpus_pipeline as cp
from evalframe.llm import line_dedup as ld
from evalframe.llm import queries


def squeeze(line):
    return " ".join(w for w in "".join(" " if c <= " " else c for c in line).split(" ") if w).lower()


def grams(line):
    return {line[i : i + 12] for i in range(len(line) - 11)} or {line}


def brute(docs):
    """Independent of the operator: every 12 characters, 0.8, short lines by equality; keeps each group's first."""
    where = {}
    for key, t in docs:
        for pos, x in enumerate(t.split("\n")):
            if squeeze(x):
                where.setdefault(squeeze(x), []).append((key, pos))
    long = sorted(x for x in where if len(x) >= 20)
    up = {x: x for x in where}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(long):
        for b in long[i + 1 :]:
            sa, sb = grams(a), grams(b)
            if 100 * len(sa & sb) >= 80 * len(sa | sb):
                up[root(b)] = root(a)
    groups = {}
    for x in where:
        groups.setdefault(root(x), []).extend(where[x])
    gone = {p for g in groups.values() for p in set(g) if p != min(g)}
    return {key: "\n".join(x for k, x in enumerate(t.split("\n")) if (key, k) not in gone) for key, t in docs}


def case():
    rnd = random.Random(9)
    han = lambda n: "".join(chr(rnd.randrange(0x4E00, 0x4F00)) for _ in range(n))
    prose = han(150)
    tabs = "\t".join(f"{rnd.randrange(10**6)}" for _ in range(30))
    small = " ".join(rnd.choice(["a", "an", "ox", "cat", "dog", "is", "it", "or"]) for _ in range(70))
    url = lambda: "https://www." + "".join(rnd.choice("abcdefgh/") for _ in range(40))
    long = " ".join("".join(rnd.choice("abcdefé") for _ in range(rnd.randrange(1, 9))) for _ in range(60))
    lines = [
        prose, prose[:70] + "一" + prose[71:], prose[:12] + han(138), han(150),
        tabs, tabs.replace("\t", "  "), tabs[:12] + "\t" + "\t".join(f"{rnd.randrange(10**6)}" for _ in range(28)),
        small, small[:90] + "b" + small[91:], small + "\r",
        *(url() for _ in range(6)),
        long, long[:200] + "X" + long[201:], long.replace(" ", "\t "), "tail of piece " + long,
        "question 12: is it a or b", "question 12: an ox or a cat",
        "menu", " Menu\r", "短い文。", "短い文。", "", "",
    ]
    lines += ["x" * 63 + "abcdefghijkl"[:n] for n in range(10, 13)]
    rnd.shuffle(lines)
    return [(100 - i, "\n".join(lines[i::7])) for i in range(7)]


def test_every_position_equals_brute_force(spark):
    docs = case()
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: r.text for r in ld.dedup_lines(df.repartition(3)).collect()}
    want = brute(docs)
    assert got == want
    left = "\n".join(got.values())
    assert left.count("https://www.") == 6 and left.count("question 12:") == 2
    assert left.lower().count("menu") == 1 and left.count("短い文。") == 1


def test_query_and_pipeline_take_every_position(spark, tmp_path):
    docs = [(i, t, "en", "a", len(t)) for i, t in case()]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars int")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    want = brute([d[:2] for d in docs])
    lost = {k: len(t.split("\n")) - len(want[k].split("\n")) for k, t, *_ in docs}
    assert {r.doc_id: r.n_removed for r in queries.op8_line_dedup(spark, str(tmp_path)).collect()} == lost
    assert {r.doc_id: r.text for r in cp.lines(spark, df, str(tmp_path)).collect()} == want
