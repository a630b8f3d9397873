"""What several operators share: shared storage, checked broadcasts, components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that separate words: space and the control characters tab to carriage return.
SPACE = r"[\x20\x09-\x0D]"
#: Key sets up to this many 8-byte keys (about 16 MB) may be broadcast.
BROADCAST_KEYS = 2_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; one of this machine is set only where none is named and the master is local."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="evalframe-")
        spark.sparkContext.setCheckpointDir(path)
        path = spark.sparkContext.getCheckpointDir()
    return path.rstrip("/")


def new_path(spark: SparkSession, kind: str) -> str:
    return f"{shared_dir(spark)}/evalframe-{kind}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, kind: str = "step", rows: int | None = None) -> DataFrame:
    """Write df as Parquet in the shared folder and read it: cuts lineage and survives lost executors.

    rows, if it is known about how many there are, keeps small tables from being written in many files.
    """
    spark = df.sparkSession
    path = new_path(spark, kind)
    (df if rows is None else df.coalesce(parts(rows))).write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def parts(rows: int) -> int:
    """Partitions for so many rows of a few numbers: a task takes up to 100,000, and there are eight at least."""
    return max(8, -(-rows // 100_000))


def discard(*frames: DataFrame | None) -> None:
    """Delete tables that materialize wrote and nothing reads any more."""
    for df in frames:
        path = getattr(df, "stored_at", None)
        if path:
            jvm = df.sparkSession._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def semi_join(df: DataFrame, keys: DataFrame, on: list[str], n_keys: int) -> DataFrame:
    """Rows of df whose key is in keys; broadcast only a key set whose counted size is small."""
    return df.join(F.broadcast(keys) if n_keys <= BROADCAST_KEYS else keys.hint("merge"), on, "left_semi")


def only_ids(facts: DataFrame, pairs: DataFrame) -> DataFrame:
    """Rows of facts whose id stands in the stored pairs (a, b), if these are few enough to be broadcast; else all."""
    if 2 * pairs.count() > BROADCAST_KEYS:
        return facts
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    return facts.join(F.broadcast(ids), "id", "left_semi")


def has_repeated_keys(docs: DataFrame, key: str, text: str) -> bool:
    """Whether a key stands on rows with different texts."""
    mark = F.xxhash64(text)
    same = docs.groupBy(key).agg(F.min(mark).alias("_lo"), F.max(mark).alias("_hi"))
    return not same.where("_lo <> _hi").isEmpty()


def join_small(df: DataFrame, small: DataFrame, on: list[str], n_rows: int, how: str = "left") -> DataFrame:
    """Join with a table of few columns; broadcast it only when its counted size is small."""
    return df.join(F.broadcast(small) if n_rows <= BROADCAST_KEYS // 4 else small.hint("merge"), on, how)


def words(text: Column) -> Column:
    """Words between separators, null as none; native."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), "")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of the graph's nodes, component being its smallest node.

    Distributed union-find by contraction: every node that has a smaller neighbour hangs on the least
    one, chains are shortened by pointer jumping, and the edges between what hangs on nothing are the
    next round's graph, which has at most half as many nodes with an edge. Aggregates are minima, combined
    before the shuffle, and joins are of stored tables, one side unique, so a hub with a large part of all
    edges is split. Rounds and jumps grow with the logarithm of the graph. Empty input gives an empty result.
    """
    cur = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    cur = materialize(cur, "edges")
    n, hung = cur.count(), []
    while n:
        on = _jumped(materialize(cur.groupBy("u").agg(F.min("v").alias("v")), "hung", n), n)
        hung.append(on)
        x, y = (on.select(F.col("u").alias(f"_{s}"), F.col("v").alias(f"_{s}r")).hint("merge") for s in "uv")
        up = cur.join(x, F.col("u") == F.col("_u")).join(y, F.col("v") == F.col("_v"), "left")
        left, right = F.col("_ur"), F.coalesce("_vr", "v")
        nxt = up.select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v")).where("u <> v")
        nxt = materialize(nxt.coalesce(parts(n)).distinct(), "edges", n)
        discard(cur)
        cur, n = nxt, nxt.count()
    discard(cur)
    # A node hangs once; where it hung on a node that hung later, that one's place is its own.
    found = edges.sparkSession.createDataFrame([], edges.select(F.col(a).alias("node"), F.col(a).alias("component")).schema)
    for on in reversed(hung):
        later = found.select(F.col("node").alias("_v"), "component").hint("merge")
        placed = on.join(later, F.col("v") == F.col("_v"), "left").select(F.col("u").alias("node"), F.coalesce("component", "v").alias("component"))
        placed = materialize(placed.unionByName(found), "found")
        discard(on, found)
        found = placed
    return found.unionByName(found.select(F.col("component").alias("node"), "component").distinct())


def _jumped(on: DataFrame, n: int) -> DataFrame:
    """on (u hangs on v) with every v replaced by the node at the end of its chain."""
    while True:
        up = on.select(F.col("u").alias("_v"), F.col("v").alias("_r"))
        nxt = on.join(up.hint("merge"), F.col("v") == F.col("_v"), "left")
        nxt = materialize(nxt.select("u", F.coalesce("_r", "v").alias("v"), F.col("_r").isNotNull().alias("moved")), "hung", n)
        moved = not nxt.where("moved").isEmpty()
        discard(on)
        on = nxt.select("u", "v")
        on.stored_at = nxt.stored_at
        if not moved:
            return on
