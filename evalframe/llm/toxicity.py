"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's probability is logistic in the weights of its
words and word beginnings; the document's is the noisy-or of its sentences. Only document
labels are used: the noisy-or likelihood is climbed by Adam on the driver, over a bounded
sample of labelled documents (`sample_per_class`, whole texts). The sentence scores then
locate the offending sentences.

Edge cases: null and empty texts have no sentence and score 0; missing or null labels are not
used; with no labels of either class every score is the prior; repeated rows score alike; a key
that repeats, in the table or the labels, is one row of the training (toxic if any label says so);
very long texts are read whole; an empty table gives an empty result; columns named as the added
ones raise.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalframe.llm.batches import ALNUM, map_texts

#: As ALNUM, but sentence ends become a line feed.
_SENTENCES = bytes(10 if b in b".!?\n" else ALNUM[b] for b in range(256))
_CACHE = 400_000


@dataclass(frozen=True)
class Settings:
    sample_per_class: int = 3000
    max_features: int = 20_000
    min_docs: int = 5
    steps: int = 600
    rate: float = 0.1
    l2: float = 1e-5
    threshold: float = 0.7


def sentences(text: bytes | None) -> list[list[bytes]]:
    """Each sentence's distinct words in order: a word repeated in a sentence is no more evidence."""
    parts = (text or b"").translate(_SENTENCES).split(b"\n")
    return [list(dict.fromkeys(w)) for s in parts if (w := s.split())]


def word_features(word: bytes) -> set[bytes]:
    """The word and its beginnings of four to six bytes, marked as such."""
    return {word, *(b"^" + word[:k] for k in (4, 5, 6) if len(word) >= k)}


def fit(rows: list[tuple[bytes | None, int]], cfg: Settings = Settings()) -> tuple[dict[bytes, float], float]:
    """Feature weights and bias. Features: the most telling by smoothed log odds of document counts."""
    bags = [sentences(t) for t, _ in rows]
    y = np.array([label for _, label in rows], float)
    keep = [k for k, b in enumerate(bags) if b]
    if not keep or y.min() == y.max():
        return {}, float(np.clip(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)), -8, 8)) if len(y) else 0.0
    bags, y = [bags[k] for k in keep], y[keep]
    seen: tuple[Counter, Counter] = (Counter(), Counter())
    for bag, label in zip(bags, y):
        seen[int(label)].update({f for w in {w for s in bag for w in s} for f in word_features(w)})
    n = (len(y) - y.sum(), y.sum())
    total = seen[0] + seen[1]
    odds = {
        f: np.log((seen[1][f] + 0.5) / (n[1] + 1)) - np.log((seen[0][f] + 0.5) / (n[0] + 1))
        for f, k in total.items()
        if k >= cfg.min_docs
    }
    # Significance of the odds: log odds over its standard error.
    rank = {f: abs(v) / np.sqrt(1 / (seen[1][f] + 0.5) + 1 / (seen[0][f] + 0.5)) for f, v in odds.items()}
    vocab = {f: k for k, f in enumerate(sorted(rank, key=lambda f: (-rank[f], f))[: cfg.max_features]) if rank[f] > 3.5}
    vocab = {f: k for k, f in enumerate(vocab)}
    ids: dict[bytes, list[int]] = {}
    doc_of, sent, feat = [], [], []
    for d, bag in enumerate(bags):
        for s in bag:
            at = len(doc_of)
            doc_of.append(d)
            for w in s:
                if w not in ids:
                    ids[w] = [vocab[f] for f in word_features(w) if f in vocab]
            found = [k for w in s for k in ids[w]]
            sent.extend([at] * len(found))
            feat.extend(found)
    doc_of, sent, feat = np.array(doc_of), np.array(sent, int), np.array(feat, int)
    w, b = np.zeros(len(vocab)), -3.0
    m, v = np.zeros(len(vocab) + 1), np.zeros(len(vocab) + 1)
    for step in range(1, cfg.steps + 1):
        z = b + np.bincount(sent, w[feat], minlength=len(doc_of))
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        clean = np.exp(np.bincount(doc_of, np.log1p(-np.minimum(p, 1 - 1e-12)), minlength=len(y)))
        pos = np.maximum(1 - clean, 1e-12)
        pull = np.where(y[doc_of] == 1, p * clean[doc_of] / pos[doc_of], -p) / len(y)
        g = np.append(np.bincount(feat, pull[sent], minlength=len(vocab)) - cfg.l2 * w, pull.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = cfg.rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
        w, b = w + move[:-1], b + move[-1]
    return {f: float(w[k]) for f, k in vocab.items() if abs(w[k]) > 0.02}, float(b)


class Scorer:
    def __init__(self, weights: dict[bytes, float], bias: float) -> None:
        self.weights, self.bias, self.words = weights, bias, {}

    def sentence_scores(self, text: bytes | None) -> np.ndarray:
        bag = sentences(text)
        if not bag:
            return np.zeros(0)
        if len(self.words) > _CACHE:
            self.words.clear()
        words, weights = self.words, self.weights
        z = []
        for s in bag:
            total = self.bias
            for w in s:
                v = words.get(w)
                if v is None:
                    v = words[w] = sum(weights.get(f, 0.0) for f in word_features(w)) if weights else 0.0
                total += v
            z.append(total)
        return 1 / (1 + np.exp(-np.clip(np.array(z), -30, 30)))


def sample(docs: DataFrame, labels: DataFrame, label: str, train: Column, most: int, key: str, text: str) -> list:
    """(text, label) of at most `most` labelled documents a class, whole, the first by a hash of the key."""
    usable = labels.where(train & F.col(label).isin(0, 1)).groupBy(F.col(key).alias("k")).agg(F.max(label).cast("int").alias("y"))
    parts = [usable.where(F.col("y") == c).orderBy(F.xxhash64("k"), "k").limit(most) for c in (0, 1)]
    chosen = parts[0].unionByName(parts[1])
    # At most 2 * most rows, one a key: bounded by the parameter, so it may be broadcast and collected.
    texts = docs.select(F.col(key).alias("k"), F.col(text).cast("binary").alias("t")).join(F.broadcast(chosen), "k")
    rows = texts.groupBy("k", "y").agg(F.min("t").alias("t")).collect()
    return sorted(((None if r.t is None else bytes(r.t), r.y) for r in rows), key=lambda r: (r[0] or b"", r[1]))


def score_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    train: Column,
    cfg: Settings = Settings(),
    key: str = "doc_id",
    text: str = "text",
    keep: list[str] | None = None,
) -> DataFrame:
    """keep columns plus score, predicted and sentences: (number, score) of those at the threshold or above."""
    clash = {"score", "predicted", "sentences"} & set(docs.columns if keep is None else keep)
    if clash:
        raise ValueError(f"there are columns {sorted(clash)} already")
    rows = sample(docs, labels, "toxic", train, cfg.sample_per_class, key, text)
    model = docs.sparkSession.sparkContext.broadcast(fit(rows, cfg))
    threshold = cfg.threshold

    def factory():
        scorer = Scorer(*model.value)

        def fn(texts):
            scores, bad = [], []
            for t in texts:
                p = scorer.sentence_scores(t)
                scores.append(float(-np.expm1(np.log1p(-np.minimum(p, 1 - 1e-12)).sum())) if len(p) else 0.0)
                bad.append([{"n": int(i), "score": float(p[i])} for i in np.flatnonzero(p >= threshold)])
            return [
                pa.array(scores, pa.float64()),
                pa.array([int(s >= threshold) for s in scores], pa.int32()),
                pa.array(bad, pa.list_(pa.struct([("n", pa.int32()), ("score", pa.float64())]))),
            ]

        return fn

    fields = "score double, predicted int, sentences array<struct<n:int,score:double>>"
    return map_texts(docs, factory, fields, keep, text)
