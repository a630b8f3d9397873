import random

from evalframe.llm import language_id as li

WORDS = {"aa": "kato minos ruta selo pavi", "bb": "shruth grumm blopf wuxz thrak", "cc": "eioua oiae uauio aeio ieuo"}


def text(rnd, lang, n=30):
    return " ".join(rnd.choice(WORDS[lang].split()) for _ in range(n))


def test_evidence_is_fused(spark):
    rnd = random.Random(6)
    docs = [(i, text(rnd, lang), lang) for i, lang in enumerate([*WORDS] * 40)] + [(900, None, "aa"), (901, "kato", None)]
    pages = []
    for i in range(300):
        lang = [*WORDS][i % 3]
        declared = "bb" if i % 30 == 0 else lang
        pages.append((i, f"https://{lang}{i % 5}.example.{lang}/p", f'<html lang="{declared}"><script>grumm</script><p>{text(rnd, lang)}</p>'))
    pages += [
        (1000, "https://aa1.example.aa/x", None), (1001, "https://user@cc2.example.cc:80/", "<p></p>"), (1002, None, '<html lang="bb-XX">'),
        (1003, "https://aa1.example.aa/", "<html lang=zz><p>1 2 3</p>"), (1004, None, text(rnd, "cc")), (1004, None, text(rnd, "cc")),
    ]
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    p = spark.createDataFrame([(*x, "h") for x in pages], "page_id long, url string, html string, host string")
    rows = li.identify(p.repartition(3), li.fit(d)).collect()
    assert len(rows) == len(pages)
    got = {r.page_id: r for r in rows}
    assert all(got[i].lang == [*WORDS][i % 3] for i in range(300))
    assert [got[i].lang for i in (1000, 1001, 1002, 1003, 1004)] == ["aa", "cc", "bb", "aa", "cc"]
    assert got[1001].host == "cc2.example.cc" and got[1001].suffix == "cc" and got[1000].text_lang is None
    assert all(abs(sum(r.posterior) - 1) < 1e-9 for r in rows)


def test_empty_tables(spark):
    d = spark.createDataFrame([], "doc_id long, text string, lang string")
    p = spark.createDataFrame([(1, "http://h.x/", "<p>a</p>")], "page_id long, url string, html string")
    assert li.identify(p, li.fit(d)).first().lang is None
    d = spark.createDataFrame([(1, "kato", "aa")], "doc_id long, text string, lang string")
    assert li.identify(p.limit(0), li.fit(d)).count() == 0
