import math
import random

import numpy as np

from evalframe.llm import whitening as wh
from evalframe.llm.queries import op13_whitening


def vectors(n=300, d=9, seed=2):
    rnd = np.random.default_rng(seed)
    return (rnd.normal(size=(n, d)) @ rnd.normal(size=(d, d))).astype(np.float64).tolist()


def brute(rows):
    x = np.array([[math.floor(64 * c) + 1_000_000 for c in v] for v in rows], np.int64)
    n, s = len(x), x.sum(axis=0)
    y = [[int(n * a - b) for a, b in zip(row, s)] for row in x.tolist()]
    centred = np.array(y, float) / n
    e, v = np.linalg.eigh(centred.T @ centred / n)
    e, v = e[::-1], v[:, ::-1]
    return [sum(a * a for a in row) for row in y], e / e.sum(), centred @ v / np.sqrt(e)


def run(spark, rows, parts=7, cfg=wh.Settings(), kind="array<double>"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(rows)], f"vec_id long, embedding {kind}").repartition(parts)
    rows, fit = wh.fit_whitening(df, cfg=cfg)
    return df, fit, None if fit is None else wh.whiten(rows, fit, keep=["vec_id"])


def test_equals_eigenvectors_of_the_covariance(spark):
    rows = vectors()
    bad = [None, [], [1.0] * 8, [None] + [1.0] * 8, [float("nan")] * 9, [float("inf")] + [0.0] * 8]
    squares, explained, z = brute(rows)
    for cfg in (wh.Settings(), wh.Settings(fan=2), wh.Settings(components=4)):
        _, fit, out = run(spark, rows + bad, cfg=cfg)
        got = {r.vec_id: r for r in out.collect()}
        k = min(9, cfg.components)
        assert sorted(got) == list(range(300)) and fit.n == 300
        assert [int(got[i].deviation) for i in range(300)] == squares
        assert np.allclose(fit.explained(), explained[:k], rtol=1e-9)
        mine = np.array([got[i].whitened for i in range(300)])
        signs = np.sign((mine * z[:, :k]).sum(axis=0))
        assert mine.shape == (300, k) and np.allclose(mine * signs, z[:, :k], atol=1e-8)
        assert wh.identity_error(out, fit.n) < 1e-9


def test_deviation_beyond_64_bits_is_exact(spark):
    rnd = random.Random(4)
    rows = [[float(rnd.randrange(-(2**44), 2**44)) for _ in range(3)] for _ in range(40)]
    squares, _, _ = brute(rows)
    got = {r.vec_id: int(r.deviation) for r in run(spark, rows)[2].collect()}
    assert [got[i] for i in range(40)] == squares and max(squares) > 1 << 64


def test_edges(spark):
    assert run(spark, [])[1] is None and run(spark, [None, []])[1] is None
    one = run(spark, [[1.0, 2.0]])[2].collect()
    assert [(r.deviation, r.whitened) for r in one] == [(0, [])]
    flat = run(spark, [[float(i), 5.0, 2.0 * i] for i in range(30)])  # one direction only
    assert len(flat[1].eigenvalues) == 1 and wh.identity_error(flat[2], 30) < 1e-9
    same = spark.createDataFrame([(1, [1.0, 0.0], "a"), (1, [1.0, 0.0], "a"), (None, [0.0, 3.0], None)], "k int, embedding array<float>, whitened string")
    rows, fit = wh.fit_whitening(same)
    out = wh.whiten(rows, fit)
    assert out.columns == ["k", "embedding", "deviation", "whitened"] and out.count() == 3


def test_query_over_the_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    table = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    squares, explained, z = brute([r.embedding for r in table])
    at = {r.vec_id: i for i, r in enumerate(table)}
    rows = op13_whitening(spark, sf).collect()
    assert len(rows) == 32 * len(table)
    mine = np.zeros((len(table), 32))
    for r in rows:
        assert r.n == len(table) and r.deviation == squares[at[r.vec_id]] and r.identity_error < 1e-9
        assert abs(r.explained / explained[r.component - 1] - 1) < 1e-9
        mine[at[r.vec_id], r.component - 1] = r.whitened
    assert np.allclose(np.abs(mine), np.abs(z[:, :32]), atol=1e-6)
