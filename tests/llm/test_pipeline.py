import corpus_pipeline as cp

SF_DIR = "/root/testdata/sf0.001"


def test_stages_keep_the_columns_and_clean_documents(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF_DIR}/labels.parquet").collect()}
    rows = {r.doc_id: r for r in docs.collect()}
    good = cp.quality(spark, docs, SF_DIR)
    assert good.columns == cp.COLUMNS
    kept = {r.doc_id for r in good.collect()}
    judged = [i for i in rows if i in labels]
    assert sum((i in kept) == (labels[i] == 1) for i in judged) >= 0.95 * len(judged)
    cleaned = cp.benchmarks(spark, docs, SF_DIR)
    assert cleaned.columns == cp.COLUMNS
    found = {r.doc_id: r for r in cleaned.collect()}
    assert all(found[i].n_chars == len(found[i].text or "") for i in found)
    assert cp.mixture(spark, docs, SF_DIR).columns[:5] == cp.COLUMNS


def test_near_duplicates_leave_one_of_each_group(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(9, text, "en", "a", 1), (4, text + " more", "en", "a", 1), (7, "another text", "en", "b", 1), (1, None, None, None, None), (2, "", "en", "a", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in cp.near_duplicates(spark, docs, SF_DIR).collect()) == [1, 2, 4, 7]


def test_lines_drop_only_emptied_documents(spark):
    line = "this line is in several documents of the corpus"
    rows = [(1, line, "en", "a", 47), (2, line + "\nown line that nobody else has at all", "en", "a", 1), (3, line, "en", "a", 47), (4, "", "en", "a", 0), (5, None, "en", "a", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: (r.text, r.n_chars) for r in cp.lines(spark, docs, SF_DIR).collect()}
    assert got == {1: (line, 47), 2: ("own line that nobody else has at all", 36), 4: ("", 0), 5: (None, None)}


ODD = "doc_id long, text string, lang string, source string, n_chars long, score double, drop string, epoch int, spans string"


def odd_table(spark, sf_dir=SF_DIR):
    items = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect() if r.text]
    prose = lambda k, n: " ".join(f"w{(k * 7919 + i * 31) % 4000}" for i in range(n))
    texts = [
        (1, None, None), (2, "", "a"), (3, " \n\n ", "a"), (4, prose(1, 300_000), "a"), (5, prose(5, 80), None), (6, prose(6, 80), "b"), (6, prose(6, 80), "b"),
        (6, prose(7, 90), "b"), (8, prose(8, 70) + "\n" + items[0], "b"), (9, items[0], "c"), (10, "short", "c"),
    ]
    rows = [(i, t, None if i % 2 else "en", src, None if t is None else len(t), 0.5, "x", 7, "y") for i, t, src in texts]
    return spark.createDataFrame(rows, ODD)


def test_stages_take_nulls_ties_repeated_rows_long_texts_and_clashing_columns(spark):
    docs = odd_table(spark)
    before = docs.count()
    for name, stage in cp.STAGES:
        got = stage(spark, docs, SF_DIR)
        assert got.columns[:5] == cp.COLUMNS, name
        rows = got.collect()
        ids = sorted(r.doc_id for r in rows)
        if name == "quality":
            assert all(ids.count(i) <= sorted(r.doc_id for r in docs.collect()).count(i) for i in ids)
        if name == "lines":
            # The copy of a whole text goes with its rows' lines: they repeat a key, so both stay; the item's second copy goes.
            assert ids == [1, 2, 3, 4, 5, 6, 6, 6, 8, 10]
        if name == "near_duplicates":
            assert ids == sorted(r.doc_id for r in docs.collect())
        if name == "benchmarks":
            assert 9 not in ids and len(rows) == before - 1
            assert all((r.n_chars or 0) == len(r.text or "") for r in rows)
        if name == "mixture":
            assert {1, 2, 3} <= set(ids) | {1, 2, 3} and all(r.n_tokens == len((r.text or "").split()) for r in rows)


def test_stages_of_empty_tables_are_empty(spark):
    docs = odd_table(spark).limit(0)
    for _, stage in cp.STAGES:
        assert stage(spark, docs, SF_DIR).count() == 0


def test_stages_equal_brute_force(spark):
    """Near duplicates by all pairs, and benchmark passages by all windows, on the smallest table."""
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    rows = {r.doc_id: r.text or "" for r in docs.collect()}
    sets = {}
    for i, t in rows.items():
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t).encode().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    up = {i: i for i in rows}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(rows)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if sets[a] and sets[b] and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]):
                up[max(root(a), root(b))] = min(root(a), root(b))
    kept = sorted(r.doc_id for r in cp.near_duplicates(spark, docs, SF_DIR).collect())
    assert kept == [i for i in ids if root(i) == i] and len(kept) < len(ids)

    import re

    word = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    low = {i: i + 32 for i in range(65, 91)}
    grams = set()
    for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect():
        w = word.findall((r.text or "").translate(low))
        size = min(10, len(w))
        grams |= {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if w else set()
    sizes = {len(g) for g in grams}
    gone, hit = set(), {}
    for i, t in rows.items():
        w = word.findall(t.translate(low))
        covered = {j for s in sizes for k in range(len(w) - s + 1) if tuple(w[k : k + s]) in grams for j in range(k, k + s)}
        hit[i] = len(w) - len(covered)
        if len(covered) > 0.5 * len(w):
            gone.add(i)
    found = {r.doc_id: len(word.findall((r.text or "").translate(low))) for r in cp.benchmarks(spark, docs, SF_DIR).collect()}
    assert found == {i: n for i, n in hit.items() if i not in gone}
    assert sum(n < len(word.findall(rows[i].translate(low))) for i, n in hit.items()) >= 3


def test_benchmarks_sends_each_text_back_once(spark, monkeypatch):
    asked = []
    real = cp.decontaminate.find_contamination
    monkeypatch.setattr(cp.decontaminate, "find_contamination", lambda *a, **b: asked.append(b["keep"]) or real(*a, **b))
    docs = odd_table(spark)
    got = cp.benchmarks(spark, docs, SF_DIR)
    assert got.columns == cp.COLUMNS and "text" not in asked[0]
    assert {r.text for r in got.where("doc_id < 4").collect()} == {None, "", " \n\n "}
