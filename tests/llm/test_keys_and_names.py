"""Rows that repeat a key, null and text keys, and clashing names."""


import corpus_pipeline
from evalframe.llm import decontaminate as dc
from evalframe.llm import line_dedup as ld
from evalframe.llm import substring_dedup as sd
from evalframe.llm import warc

SHARED, OWN = "the shared boilerplate line of this site", "an entirely unique sentence that occurs nowhere else"


def test_rows_of_a_key_with_different_texts_keep_their_own_lines(spark):
    rows = [(1, SHARED), (7, SHARED), (7, OWN), (7, f"{OWN} twice over\n{SHARED}\nlast"), (None, SHARED), (None, f"{SHARED}\nof null")]
    got = ld.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), n_removed="n")
    # Null is the smallest key; of its two texts one keeps the line.
    texts = [(r.doc_id, r.text) for r in got.collect()]
    assert sorted(t for k, t in texts if k is not None) == sorted(["", "", OWN, f"{OWN} twice over\nlast"])
    assert sum(SHARED in t for _, t in texts) == 1 and sum("of null" in t for _, t in texts) == 1


def test_equal_rows_of_a_key_are_one_document(spark):
    rows = [(1, f"{SHARED}\n{SHARED}"), (1, f"{SHARED}\n{SHARED}"), (2, f"{OWN}\n{SHARED}")]
    got = ld.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), n_removed="n")
    assert sorted((r.doc_id, r.text, r.n) for r in got.collect()) == [(1, SHARED, 1), (1, SHARED, 1), (2, OWN, 1)]


def test_the_pipeline_keeps_texts_that_share_a_key(spark):
    a = " ".join(f"w{i}" for i in range(40))
    b = " ".join(f"x{i}" for i in range(40))
    rows = [(1, a, "en", "s", 9), (7, a, "en", "s", 9), (7, b, "en", "s", 9), (None, f"{b} y", "en", "s", 9), (8, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.near_duplicates(spark, docs, "")
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=repr) == sorted([(1, a), (None, f"{b} y"), (8, None)], key=repr)
    far = corpus_pipeline.near_duplicates(spark, docs.where("doc_id is not null"), "")
    assert sorted(((r.doc_id, r.text) for r in far.collect()), key=repr) == sorted([(1, a), (7, b), (8, None)], key=repr)
    lined = corpus_pipeline.lines(spark, spark.createDataFrame([(1, SHARED, "en", "s", 1), (7, SHARED, "en", "s", 1), (7, OWN, "en", "s", 1)], docs.schema), "")
    assert sorted((r.doc_id, r.text, r.n_chars) for r in lined.collect()) == [(1, SHARED, len(SHARED)), (7, OWN, len(OWN))]


def test_items_without_an_id_cover_words(spark):
    text = " ".join(f"w{i}" for i in range(12))
    items = spark.createDataFrame([(None, text), (None, "w2 w3"), (5, f"{text} more"), (4, "w2 w3")], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"a {text} b"), (2, "w2 w3"), (3, None)], "doc_id long, text string")
    for most in (500_000, 5):
        got = dc.find_contamination(docs, items, dc.Limits(automaton_words=most)).orderBy("doc_id").collect()
        assert [r.item_ids for r in got] == [[4, 5], [4], []]
        assert [sum(s.end - s.start for s in r.spans) for r in got] == [12, 2, 0]


def test_archives_of_text_keys(spark):
    keys = ["a", "b c/d", "x\r\ny: 1", "100%", "é", None]
    pages = spark.createDataFrame([(k, f"http://h/{i}", "same" if i < 2 else f"page {i}") for i, k in enumerate(keys)], "page_id string, url string, html string")
    captures = warc.with_referred(warc.assemble(warc.read_records(spark, warc.write_archives(pages)), "string"))
    got = {r.page_id: (r.response.kind, r.refers_to) for r in captures.collect()}
    assert got == {k: ("revisit", "a") if k == "b c/d" else ("response", None) for k in keys}


def test_names_of_results_and_of_helpers_in_the_input(spark):
    text = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(1, text, "x", "y", 1), (2, f"{text} end", "x", "y", 2)], "doc_id long, text string, clean_text string, spans string, spans_ int")
    got = sd.deduplicated_text(docs).orderBy("doc_id")
    assert got.columns == ["doc_id", "text", "spans", "spans_", "clean_text"]
    assert [(r.clean_text, r.spans, r.spans_) for r in got.collect()] == [(text, "y", 1), ("end", "y", 2)]
