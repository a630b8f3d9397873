"""Quality classifier: a generalised additive model with pairwise interactions.

Text features are cut into bins. Cyclic boosting visits the features in turn; each visit fits a
shallow tree to the gradient over that feature's bins and adds it to the feature's lookup table,
so no feature is favoured by order. Then the pairs that explain most of what is left get tables
of their own in the same way. A score is the sum of table entries, made for a whole batch at once.

Training takes the features (not the texts) of at most `sample_rows` labelled documents, chosen
by a hash of the key; scoring covers every whole text. Edge cases: null and empty texts have
zero features and get a score like any other; missing or null labels are not used; labels of
one class only, or none, give that class's smoothed rate to all; repeated rows score alike; a key
that repeats, in the table or the labels, is one row of the training (its lesser features and
label); a very long text has features like any other; an empty table gives an empty result;
columns named as the added ones raise.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalframe.llm.batches import map_texts

FEATURES = (
    "log_words", "word_length", "symbols", "upper", "digits", "spread_marks", "bangs", "bars", "non_ascii",
    "distinct_words", "same_next", "repeated_4grams", "dup_lines", "line_words", "short_words", "stops", "top_word",
)


#: An odd multiplier: four words as one number of 64 bits.
_ODD = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Settings:
    sample_rows: int = 20_000
    bins: int = 32
    pair_bins: int = 12
    pairs: int = 6
    rounds: int = 120
    pair_rounds: int = 60
    rate: float = 0.15
    leaves: int = 3
    min_weight: float = 5.0  # hessian a leaf needs: some 20 undecided documents
    threshold: float = 0.3


def features(text: bytes | None) -> list[float]:
    t = text or b""
    w = t.split()
    n = len(w)
    if not n:
        return [0.0] * len(FEATURES)
    count = np.bincount(np.frombuffer(t, np.uint8), minlength=256)
    size = max(1, int(count[33:].sum()))
    kinds: dict[bytes, int] = {}
    for x in w:
        kinds[x] = kinds.get(x, 0) + 1
    ids = dict(zip(kinds, range(len(kinds))))
    a = np.fromiter(map(ids.__getitem__, w), np.int64, n)
    u = a.astype(np.uint64)
    four = ((u[:-3] * _ODD + u[1:-2]) * _ODD + u[2:-1]) * _ODD + u[3:] if n > 3 else u[:0]
    lines = [x for x in t.split(b"\n") if x.strip()]
    marks = sum(int(count[c]) for c in b"#*$%&|<>@^~_=+{}[]\\")
    letters = max(1, int(count[65:91].sum() + count[97:123].sum()))
    return [
        float(np.log(n)), size / n, marks / size, int(count[65:91].sum()) / letters, int(count[48:58].sum()) / size,
        sum(1 for x in w if x[-1] in b"#*$%&!|") / n, int(count[33]) / size, kinds.get(b"|", 0) / n,
        int(count[128:].sum()) / size, len(kinds) / n, float((a[1:] == a[:-1]).mean()) if n > 1 else 0.0,
        1 - len(np.unique(four)) / len(four) if len(four) else 0.0, 1 - len(set(lines)) / len(lines), n / len(lines),
        sum(1 for x in w if len(x) <= 3) / n, sum(int(count[c]) for c in b".!?") / n, max(kinds.values()) / n,
    ]


def bin_edges(x: np.ndarray, most: int) -> np.ndarray:
    """Inner edges between at most `most` bins of about equal counts; ties share a bin."""
    return np.unique(np.quantile(x, np.linspace(0, 1, most + 1)[1:-1])) if len(x) else np.zeros(0)


def tree_1d(g: np.ndarray, h: np.ndarray, leaves: int, least: float) -> np.ndarray:
    """Values per bin of a tree grown best split first on summed gradients and hessians."""
    parts, value = [(0, len(g))], np.zeros(len(g))
    gain = lambda a, b: a * a / (b + 1.0)
    while len(parts) < leaves:
        best = (1e-9, None, 0)
        for a, b in parts:
            G, H = g[a:b].cumsum(), h[a:b].cumsum()
            if b - a < 2:
                continue
            left, hl, right, hr = G[:-1], H[:-1], G[-1] - G[:-1], H[-1] - H[:-1]
            won = np.where((hl >= least) & (hr >= least), gain(left, hl) + gain(right, hr) - gain(G[-1], H[-1]), 0)
            at = int(won.argmax())
            if won[at] > best[0]:
                best = (won[at], (a, b), a + at + 1)
        if best[1] is None:
            break
        a, b = best[1]
        parts.remove((a, b))
        parts += [(a, best[2]), (best[2], b)]
    for a, b in parts:
        value[a:b] = g[a:b].sum() / (h[a:b].sum() + 1.0)
    return value


def tree_2d(g: np.ndarray, h: np.ndarray, least: float) -> tuple[np.ndarray, float]:
    """Values per cell of the best tree of one split on an axis and one on the other in each half; its gain."""
    best = (0.0, np.zeros_like(g))
    for flip in (False, True):
        G, H = (g.T, h.T) if flip else (g, h)
        for cut in range(1, G.shape[0]):
            value = np.zeros_like(G)
            won = -(G.sum() ** 2) / (H.sum() + 1.0)
            for rows in (slice(0, cut), slice(cut, None)):
                v = tree_1d(G[rows].sum(0), H[rows].sum(0), 2, least)
                value[rows] = v
                for x in np.unique(v):
                    m = v == x
                    won += G[rows].sum(0)[m].sum() ** 2 / (H[rows].sum(0)[m].sum() + 1.0)
            if won > best[0]:
                best = (won, value.T if flip else value)
    return best[1], best[0]


@dataclass
class Model:
    bias: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pair_edges: list[np.ndarray]
    pairs: list[tuple[int, int]]
    pair_tables: list[np.ndarray]

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.bias)
        for k, (edges, table) in enumerate(zip(self.edges, self.tables)):
            z += table[np.searchsorted(edges, x[:, k], "right")]
        coarse = {k: np.searchsorted(self.pair_edges[k], x[:, k], "right") for p in self.pairs for k in p}
        for (i, j), table in zip(self.pairs, self.pair_tables):
            z += table[coarse[i], coarse[j]]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, cfg: Settings = Settings()) -> Model:
    n, k = len(y), len(FEATURES)
    x = x.reshape(n, k)
    bias = float(np.log((y.sum() + 0.5) / (n - y.sum() + 0.5))) if n else 0.0
    edges = [bin_edges(x[:, f], cfg.bins) for f in range(k)]
    pair_edges = [bin_edges(x[:, f], cfg.pair_bins) for f in range(k)]
    model = Model(bias, edges, [np.zeros(len(e) + 1) for e in edges], pair_edges, [], [])
    if not n or y.min() == y.max():
        return model
    at = [np.searchsorted(edges[f], x[:, f], "right") for f in range(k)]
    z = np.full(n, bias)

    def slopes():
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        return y - p, np.maximum(p * (1 - p), 1e-9)

    for _ in range(cfg.rounds):
        for f in range(k):
            g, h = slopes()
            size = len(edges[f]) + 1
            step = cfg.rate * tree_1d(np.bincount(at[f], g, size), np.bincount(at[f], h, size), cfg.leaves, cfg.min_weight)
            model.tables[f] += step
            z += step[at[f]]
    coarse = [np.searchsorted(pair_edges[f], x[:, f], "right") for f in range(k)]

    def grid(v, i, j):
        shape = (len(pair_edges[i]) + 1, len(pair_edges[j]) + 1)
        return np.bincount(coarse[i] * shape[1] + coarse[j], v, shape[0] * shape[1]).reshape(shape)

    g, h = slopes()
    gains = {p: tree_2d(grid(g, *p), grid(h, *p), cfg.min_weight)[1] for p in combinations(range(k), 2)}
    model.pairs = sorted((p for p in gains if gains[p] > 0), key=lambda p: (-gains[p], p))[: cfg.pairs]
    model.pair_tables = [np.zeros((len(pair_edges[i]) + 1, len(pair_edges[j]) + 1)) for i, j in model.pairs]
    for _ in range(cfg.pair_rounds):
        for table, (i, j) in zip(model.pair_tables, model.pairs):
            g, h = slopes()
            step = cfg.rate * tree_2d(grid(g, i, j), grid(h, i, j), cfg.min_weight)[0]
            table += step
            z += step[coarse[i], coarse[j]]
    return model


def _with_features(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    def factory():
        return lambda texts: [pa.array([features(t) for t in texts], pa.list_(pa.float64()))]

    return map_texts(df, factory, "features array<double>", keep, text, rows=1000)


def train(
    docs: DataFrame, labels: DataFrame, usable: Column, cfg: Settings = Settings(), key: str = "doc_id", text: str = "text"
) -> Model:
    rows = labels.where(usable & F.col("quality").isin(0, 1)).groupBy(F.col(key).alias("k")).agg(F.min("quality").cast("int").alias("_y"))
    # Bounded by sample_rows, so it may be broadcast and its features collected: one row a key.
    chosen = rows.orderBy(F.xxhash64("k"), "k").limit(cfg.sample_rows)
    texts = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).join(F.broadcast(chosen), "k")
    got = _with_features(texts, "t", ["k", "_y"]).groupBy("k", "_y").agg(F.min("features").alias("features")).toPandas()
    got = sorted(zip(map(tuple, got["features"]), got["_y"]))
    x = np.array([f for f, _ in got], float).reshape(len(got), len(FEATURES))
    return fit(x, np.array([y for _, y in got], float), cfg)


def score_quality(
    docs: DataFrame,
    labels: DataFrame,
    usable: Column,
    cfg: Settings = Settings(),
    key: str = "doc_id",
    text: str = "text",
    keep: list[str] | None = None,
) -> DataFrame:
    """keep columns plus score (the probability of label 1) and predicted (score at the threshold or above)."""
    clash = {"score", "predicted"} & set(docs.columns if keep is None else keep)
    if clash:
        raise ValueError(f"there are columns {sorted(clash)} already")
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, usable, cfg, key, text))
    threshold = cfg.threshold

    def factory():
        def fn(texts):
            x = np.array([features(t) for t in texts], float).reshape(len(texts), len(FEATURES))
            s = model.value.score(x)
            return [pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32), pa.int32())]

        return fn

    return map_texts(docs, factory, "score double, predicted int", keep, text, rows=1000)
