"""Beyond the counted limit of a broadcast, joins by sorting give the same rows."""

import random

import pytest

from evalframe.llm import common, line_dedup, ngram_jaccard, substring_dedup


def corpus(spark):
    rnd = random.Random(12)
    words = [f"word{i}" for i in range(400)]
    texts = ["\n".join(" ".join(rnd.choices(words, k=12)) for _ in range(8)) for _ in range(30)]
    for i in range(20):  # near copies, shared lines and passages
        lines = texts[i % 7].split("\n")
        lines[rnd.randrange(8)] += f" changed {i}"
        texts.append("\n".join(lines))
    texts += [None, "", texts[0], texts[1] + "\n" + texts[2]]
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)


RUNS = {
    "op2": lambda d: ngram_jaccard.near_duplicates(d),
    "op4": lambda d: substring_dedup.deduplicated_text(d),
    "op8": lambda d: line_dedup.dedup_lines(d, n_removed="n"),
}


@pytest.mark.parametrize("name", RUNS)
def test_without_broadcasts(spark, monkeypatch, name):
    docs = corpus(spark)
    want = sorted(map(tuple, RUNS[name](docs).collect()), key=repr)
    for module in (common, line_dedup, ngram_jaccard, substring_dedup):
        monkeypatch.setattr(module, "BROADCAST_KEYS", 0, raising=False)
    assert sorted(map(tuple, RUNS[name](docs).collect()), key=repr) == want
