import random
import re

import pytest

from evalframe.llm import line_dedup as ld


def squeeze(line):
    return re.sub(r"[\x00-\x20]+", " ", line).strip(" ").lower()


def grams(line, size=12):
    return {line[i : i + size] for i in range(len(line) - size + 1)} or {line}


def brute(docs, cfg=ld.Settings()):
    """All pairs of lines, all positions; keeps the first place of each group."""
    lines = {}
    for key, t in docs:
        for pos, x in enumerate([] if t is None else t.split("\n")):
            if squeeze(x):
                lines.setdefault(squeeze(x), []).append((key, pos))
    texts = sorted(lines)
    sets = {x: grams(x, cfg.shingle) for x in texts if len(x) >= cfg.min_chars}
    up = {x: x for x in texts}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(texts):
        for b in texts[i + 1 :]:
            if a in sets and b in sets and 100 * len(sets[a] & sets[b]) >= cfg.threshold_pct * len(sets[a] | sets[b]):
                up[root(b)] = root(a)
    groups = {}
    for x in texts:
        groups.setdefault(root(x), []).extend(lines[x])
    gone = {p for g in groups.values() for p in set(g) if p != min(g)}
    return {
        key: None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if (key, k) not in gone)
        for key, t in docs
    }


def case():
    rnd = random.Random(4)
    line = lambda n: " ".join("".join(rnd.choice("abcdeéß") for _ in range(rnd.randrange(2, 9))) for _ in range(n))
    bases = [line(30) for _ in range(6)] + ["License: all rights reserved by the authors."]
    docs = []
    for i in range(40):
        parts = [line(rnd.randrange(1, 25)) for _ in range(4)]
        b = rnd.choice(bases)
        words = b.split(" ")
        if len(words) > 20 and rnd.random() < 0.7:
            words[rnd.randrange(len(words))] = "edited"
        parts.insert(rnd.randrange(4), " ".join(words))
        if i % 5 == 0:
            parts += ["", "short", "short", b.upper()]
        docs.append((500 - i, "\n".join(parts)))
    return [*docs, (600, None), (601, ""), (602, "\n\n"), (603, docs[0][1]), (604, "one line only, but long enough\t here")]


def test_equals_brute_force(spark):
    docs = case()
    df = spark.createDataFrame([(i, t, "k", 7, 1, "x") for i, t in docs], "doc_id long, text string, drop string, pos int, h1 int, line string")
    got = ld.dedup_lines(df.repartition(3), n_removed="n_removed").collect()
    assert len(got) == len(docs) and all(r.drop == "k" and r.pos == 7 and r.h1 == 1 and r.line == "x" for r in got)
    assert {r.doc_id: r.text for r in got} == brute(docs)
    assert sum(r.n_removed for r in got) > 30


def test_lines_that_only_share_a_word_or_a_beginning_stay(spark):
    lines = [
        "we go to the big zoo today", "he is in the old hut today",
        "https://example.org/a/report-2019.pdf", "https://example.org/b/minutes-and-notes.html",
        "今天的天气非常好我们去公园散步然后回家", "今天的天气非常好我们去公园散不了步因为下雨所以大家都留在办公室里",
        "question 12: is it a or b", "question 12: an ox or a cat",
        "supercalifragilisticexpialidocious a b", "supercalifragilistic c d e f g h i",
    ]
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    got = {r.doc_id: r.text for r in ld.dedup_lines(df).collect()}
    assert got == brute(list(enumerate(lines))) == dict(enumerate(lines))


def test_lines_of_one_repeated_piece_and_very_long_ones(spark):
    rnd = random.Random(2)
    long = " ".join(f"{rnd.randrange(10**5)}" for _ in range(20_000))
    docs = [(1, "=" * 5000), (2, "=" * 4000), (3, "ab" * 3000), (4, "ba" * 3000 + "x" * 40), (5, long), (6, "new " + long[50:])]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: r.text for r in ld.dedup_lines(df).collect()}
    assert got == brute(docs)
    assert got[2] == "" and got[6] == "" and got[4]


def test_recall_of_edited_lines(spark):
    """Lines edited down to similarities from 0.8 up: at least 95 in 100 pairs are found."""
    rnd = random.Random(6)
    docs, near = [], 0
    for i in range(400):
        a = "".join(rnd.choice("abcdefghij äö") for _ in range(rnd.randrange(60, 700)))
        b = a
        for _ in range(rnd.randrange(1, 4)):
            at = rnd.randrange(len(b))
            b = b[:at] + "#" + b[at + rnd.randrange(2) :]
        x, y = grams(squeeze(a)), grams(squeeze(b))
        if 100 * len(x & y) >= 80 * len(x | y):
            near += 1
            docs += [(2 * i, a), (2 * i + 1, b)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    found = ld.find_repeated_lines(df).count()
    assert near > 150 and 0.95 * near <= found <= near


def test_a_bucket_of_lines_that_do_not_link(spark):
    """Many lines share most of their text, too little to link: all are held against each other, none goes."""
    rnd = random.Random(8)
    shared = "".join(rnd.choice("abcdefgh ") for _ in range(300))
    own = lambda: "".join(rnd.choice("klmnopqr ") for _ in range(120))
    docs = [(i, shared + own()) for i in range(60)]
    docs.append((99, docs[30][1] + " and"))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert {r.doc_id: r.text for r in ld.dedup_lines(df).collect()} == brute(docs)


def test_repeated_rows_empty_tables_and_clashes(spark):
    t = "the very same line of some length\nanother line that is here twice\nanother line that is here twice"
    df = spark.createDataFrame([(1, t), (1, t)], "doc_id long, text string")
    got = [r.text for r in ld.dedup_lines(df).collect()]
    assert got == ["\n".join(t.split("\n")[:2])] * 2
    assert ld.dedup_lines(df.limit(0)).count() == 0
    odd = df.toDF("key", "component")
    assert [r.component for r in ld.dedup_lines(odd, key="key", text="component").collect()] == got
    with pytest.raises(ValueError):
        ld.dedup_lines(df, n_removed="text")
