"""Embedding whitening by TSQR: no covariance is formed to find the components.

Entries c become whole numbers x = floor(64 c) + 1,000,000, so that the sums S of each dimension over
the n vectors are exact, and so is n x - S. Each task brings its centred rows (n x - S) / n to a
triangle R by QR decompositions of one batch after the other; triangles are merged by QR in a tree of
shuffled groups until one is left, and the singular values and right vectors of the last R are the
square roots of n times the covariance's eigenvalues and its eigenvectors.

The input is read in each pass (lengths and sums, triangles, check, result), so it must not change in between.
What the driver gets is bounded by the dimension d: the sums, the d x d numbers of the last
triangle, and 32 x 32 of a check.

Edge cases: vectors that are null, empty, or hold null or non-finite entries, or entries that are not
whole doubles after scaling (2**52 and more), are dropped, as are those whose length is not the
commonest (the longest of equally common ones). Repeated rows and null keys count like others.
Components without variance (of an eigenvalue under d * 1e-13 of the largest) are not given, so equal
vectors and a single one have rows with empty lists. An empty table gives an empty one. A column named
like a result column is replaced by it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RESULTS = ("deviation", "whitened")


@dataclass(frozen=True)
class Settings:
    components: int = 32
    scale: int = 64
    offset: int = 1_000_000
    #: Triangles merged by one task of the tree.
    fan: int = 16


@dataclass(frozen=True)
class Fit:
    """n, the sums by dimension, eigenvalues by falling size and the unit eigenvectors as columns."""

    n: int
    sums: np.ndarray
    eigenvalues: np.ndarray
    vectors: np.ndarray
    trace: float

    def explained(self) -> list[float]:
        return [float(e / self.trace) for e in self.eigenvalues]


def _usable(vector: Column, cfg: Settings) -> Column:
    fine = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float(2**52) / cfg.scale)
    return vector.isNotNull() & (F.size(vector) > 0) & F.forall(vector, fine)


def _rows(batch: pa.RecordBatch, at: int, cfg: Settings) -> np.ndarray:
    """The batch's vectors as whole numbers, a row each."""
    column = batch.column(at)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return (np.floor(flat * cfg.scale).astype(np.int64) + cfg.offset).reshape(len(column), -1)


def usable_vectors(df: DataFrame, vector: str, cfg: Settings = Settings()) -> tuple[DataFrame, int]:
    """Rows with vectors that can be used, and their length (0 if there are none)."""
    fine = df.where(_usable(F.col(vector), cfg))
    size = F.size(F.col(vector))
    most = fine.groupBy(size.alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    d = most.d if most else 0
    return fine.where(size == d), d


def _sums(vectors: DataFrame, d: int, cfg: Settings) -> tuple[int, np.ndarray]:
    def add(batches):
        n, total = 0, np.zeros(d, object)
        for b in batches:
            x = _rows(b, 0, cfg)
            small = not len(x) or int(np.abs(x).max()) * len(x) < 1 << 62
            n, total = n + len(x), total + (x if small else x.astype(object)).sum(axis=0).astype(object)
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([list(map(str, total))], pa.list_(pa.string()))], names=["n", "s"])

    parts = vectors.mapInArrow(add, "n bigint, s array<string>").where("n > 0")
    cells = parts.select("n", F.posexplode("s").alias("i", "v")).groupBy("i").agg(F.sum("n").alias("n"), F.sum(F.col("v").cast("decimal(38,0)")).alias("v"))
    rows = sorted((r.i, r.n, int(r.v)) for r in cells.collect())
    return (rows[0][1] if rows else 0), np.array([v for _, _, v in rows], object)


def _centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """x - S / n: the whole number n x - S first."""
    return _spread(x, n, sums).astype(np.float64) / n


def _spread(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n x - S, exactly: as 64-bit numbers about the mean's whole part where they suffice, else as Python's."""
    near = np.array([s // n for s in sums], np.int64)
    rest = np.array([int(s - n * int(m)) for s, m in zip(sums, near)], object)
    off = x - near
    if len(off) and int(np.abs(off).max() + 1) * n >= 1 << 62:
        return n * off.astype(object) - rest
    return n * off - rest.astype(np.int64)


def _squares(y: np.ndarray) -> list[int]:
    """Sums of squares by row, exactly."""
    if y.dtype != object and len(y) and int(np.abs(y).max()) ** 2 * y.shape[1] < 1 << 62:
        return (y * y).sum(axis=1).tolist()
    y = y.astype(object)
    return (y * y).sum(axis=1).tolist() if len(y) else []


def _triangle(rows: np.ndarray, r: np.ndarray) -> np.ndarray:
    return np.linalg.qr(np.vstack([r, rows]), mode="r")


def _packed(r: np.ndarray) -> bytes:
    return np.ascontiguousarray(r, np.float64).tobytes()


def triangle(vectors: DataFrame, d: int, n: int, sums: np.ndarray, cfg: Settings) -> np.ndarray:
    """R of all centred rows, merged in a tree."""

    def own(batches):
        r = np.zeros((0, d))
        for b in batches:
            x = _centred(_rows(b, 0, cfg), n, sums)
            for i in range(0, len(x), 4 * d + 1024):
                r = _triangle(x[i : i + 4 * d + 1024], r)
        yield pa.RecordBatch.from_arrays([pa.array([_packed(r)] * bool(len(r)), pa.binary())], names=["r"])

    def merged(batches):
        r = np.zeros((0, d))
        for b in batches:
            for packed in b.column(0).to_pylist():
                r = _triangle(np.frombuffer(packed).reshape(-1, d), r)
        yield pa.RecordBatch.from_arrays([pa.array([_packed(r)] * bool(len(r)), pa.binary())], names=["r"])

    tree, width = vectors.mapInArrow(own, "r binary"), max(1, vectors.rdd.getNumPartitions())
    while width > 1:
        width = -(-width // cfg.fan)
        tree = tree.repartition(width).mapInArrow(merged, "r binary")
    return np.frombuffer(bytes(tree.first().r)).reshape(-1, d)


def fit_whitening(df: DataFrame, vector: str = "embedding", cfg: Settings = Settings()) -> tuple[DataFrame, Fit | None]:
    """The rows that can be used and the fit to them; None if there are none."""
    rows, d = usable_vectors(df, vector, cfg)
    if not d:
        return rows, None
    vectors = rows.select(vector)
    n, sums = _sums(vectors, d, cfg)
    _, sigma, right = np.linalg.svd(triangle(vectors, d, n, sums, cfg))
    # By the largest entry of each vector, so that a run gives the signs of another.
    right = right[: len(sigma)]
    right = right * np.sign(right[np.arange(len(right)), np.abs(right).argmax(axis=1)])[:, None]
    values = sigma**2 / n
    given = (values > d * 1e-13 * values[0]) & (np.arange(len(values)) < cfg.components) if values[0] > 0 else np.zeros(len(values), bool)
    return rows, Fit(n, sums, values[given], right[given].T.copy(), float(values.sum()))


def whiten(rows: DataFrame, fit: Fit, vector: str = "embedding", cfg: Settings = Settings(), keep: list[str] | None = None) -> DataFrame:
    """keep columns plus deviation (sum over the dimensions of (n x - S) squared, exact) and whitened, a number a component."""
    keep = [c for c in (rows.columns if keep is None else keep) if c not in RESULTS]
    src = rows.select(*dict.fromkeys([*keep, vector]))
    at, kept = src.columns.index(vector), [src.columns.index(c) for c in keep]
    n, sums, turn = fit.n, fit.sums, fit.vectors / np.sqrt(fit.eigenvalues)

    def run(batches):
        for b in batches:
            y = _spread(_rows(b, at, cfg), n, sums)
            z = (y.astype(np.float64) / n) @ turn
            flat = pa.array(z.reshape(-1))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(z) + 1) * z.shape[1], pa.int32()), flat)
            squares = pa.array(list(map(str, _squares(y))), pa.string())
            yield pa.RecordBatch.from_arrays([b.column(i) for i in kept] + [squares, lists], names=[*keep, *RESULTS])

    kinds = ", ".join([f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in src.select(*keep).schema] + ["deviation string", "whitened array<double>"])
    return src.mapInArrow(run, kinds).withColumn("deviation", F.col("deviation").cast("decimal(38,0)"))


def identity_error(whitened: DataFrame, n: int) -> float:
    """Largest absolute entry of the covariance of whitened less the identity; 0 without components."""

    def gram(batches):
        total, outer = None, None
        for b in batches:
            z = b.column(0).flatten().to_numpy().reshape(len(b), -1)
            total, outer = (z.sum(axis=0), z.T @ z) if total is None else (total + z.sum(axis=0), outer + z.T @ z)
        if total is not None:
            both = np.vstack([total, outer]).reshape(-1)
            yield pa.RecordBatch.from_arrays([pa.array([both.tolist()], pa.list_(pa.float64()))], names=["g"])

    parts = whitened.select("whitened").mapInArrow(gram, "g array<double>")
    cells = {r.i: r.v for r in parts.select(F.posexplode("g").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v")).collect()}
    k = int((np.sqrt(1 + 4 * len(cells)) - 1) / 2 + 0.5)
    if not k:
        return 0.0
    both = np.array([cells[i] for i in range(len(cells))]).reshape(k + 1, k) / n
    return float(np.abs(both[1:] - np.outer(both[0], both[0]) - np.eye(k)).max())
