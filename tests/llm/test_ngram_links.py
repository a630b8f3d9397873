from itertools import combinations

from test_ngram_jaccard import case, shingles

from evalframe.llm import ngram_jaccard as nj


def test_links_and_members_are_all_similar_pairs(spark):
    docs = case()
    df = spark.createDataFrame(docs, "doc_id long, text string")
    links, members = nj.near_duplicate_links(df.repartition(3), nj.Settings(n=4, threshold_pct=85))
    rep = {r.doc_id: r.rep for r in members.collect()}
    linked = [(r.a, r.b) for r in links.collect()]
    sets = {i: shingles(t) for i, t in docs}
    same = lambda a, b: sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])
    want = {(a, b) for a, b in combinations(sorted(sets), 2) if same(a, b)}
    got = {(a, b) for a, b in combinations(sorted(sets), 2) if rep[a] == rep[b] or tuple(sorted((rep[a], rep[b]))) in set(linked)}
    assert got == want and len(rep) == len(docs)
    assert len(linked) == len(set(linked)) and all(a < b for a, b in linked)
    groups = {(rep[a], rep[b]) for a, b in want if rep[a] != rep[b]}
    assert len(linked) == len({tuple(sorted(p)) for p in groups}) > 20
