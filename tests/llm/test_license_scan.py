import random
import re

from pyspark.sql import functions as F

from evalframe.llm import license_scan as lc

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def words_of(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(text, templates):
    """Every template at every place, word by word."""
    ws, out = words_of(text), []
    for t in templates:
        seq = words_of(t.text)
        for start in range(-len(seq), len(ws)):
            inside = [(ws[start + q], w) for q, w in enumerate(seq) if 0 <= start + q < len(ws)]
            same = sum(a == b for a, b in inside)
            part = [a for a, _ in inside]
            stands = lambda p: any(part[i : i + len(p)] == p for i in range(len(part) - len(p) + 1))
            if same and same >= t.coverage * len(seq) - 1e-9 and all(stands(words_of(p)) for p in t.phrases):
                out.append((t.name, start, same / len(seq)))
    return sorted(out)


def case():
    rnd = random.Random(5)
    vocab = ["the", "of", "license", "mit", "any", "déjà", "Software", "copy", "x"]
    filler = lambda n: " ".join(rnd.choice(vocab) for _ in range(n))
    texts = [None, "", "...", "MIT License", "mit-license MIT LICENSE\nmit licence", "Mit\tLicense " * 400, filler(300)]
    for t in lc.TEMPLATES:
        seq = t.text.split()
        changed = [w if rnd.random() > 0.12 else "zz" for w in seq]
        texts += [f"{filler(5)} {t.text}, {filler(9)}", f"{filler(3)} {' '.join(changed)} {filler(3)} {t.text.upper()}", " ".join(seq[1:]), " ".join(seq[:-1])]
    return list(enumerate(texts))


def test_places_equal_brute_force(spark):
    docs = case()
    for templates in (lc.TEMPLATES, tuple(lc.Template(t.name, t.label, t.text, (), 0.3) for t in lc.CLAUSES)):
        got = lc.scan_licenses(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), templates).collect()
        assert len(got) == len(docs)
        found = 0
        for r in got:
            assert r.n_words == len(words_of(r.text))
            want = brute(r.text, templates)
            assert sorted((p.template, p.start, p.coverage) for p in r.places) == want, r.text
            found += len(want)
        assert found > 100


def test_labels_of_notices(spark):
    told = {
        "Licensed under CC BY-NC 4.0.": {"cc-by-nc"},
        "Released under the MIT License.": {"mit"},
        "This work is licensed under the GNU General Public License, version 3.": {"gpl", "gpl-3.0"},
        "# Licensed under the Apache License,\n# Version 2.0 (the 'Licence'); you may not use this file\n# except in compliance with the License.": {"apache", "apache-2.0"},
        "a license to print money, apache and mit students": set(),
    }
    docs = spark.createDataFrame([(t,) for t in told], "text string")
    for r in lc.scan_licenses(docs).collect():
        assert {p.label for p in r.places} == told[r.text], r.text


def test_empty_repeated_and_clashing(spark):
    docs = spark.createDataFrame([(1, "MIT license", "a", 5), (1, "MIT license", "a", 5), (None, None, None, None)], "doc_id int, text string, places string, n_words int")
    got = lc.scan_licenses(docs)
    assert got.columns == ["doc_id", "text", "n_words", "places"]
    assert sorted((r.doc_id or 0, r.n_words, len(r.places)) for r in got.collect()) == [(0, 0, 0), (1, 2, 1), (1, 2, 1)]
    assert lc.scan_licenses(docs.limit(0)).count() == 0
    assert lc.scan_licenses(docs.where("doc_id = 1"), ()).agg(F.sum(F.size("places"))).first()[0] == 0


def test_very_long_text(spark):
    text = "x y " * 300_000 + "apache license " + "z " * 10
    r = lc.scan_licenses(spark.createDataFrame([(1, text)], "doc_id int, text string")).first()
    assert r.n_words == 600_012 and [(p.template, p.start) for p in r.places] == [("apache license", 600_000)]
