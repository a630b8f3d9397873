"""Ranked lexical search: WAND in each document shard, the shards' heaps merged.

1. One pass over the documents keeps of each text its length in terms and the counts of those terms
   that items hold, as a stored table: a row a document.
2. From that table come how many documents and terms there are, and in how many documents each term
   of the items stands.
3. A task takes the rows of its splits in shards of `shard_postings` counts, so its memory is bounded.
   It makes the shard's postings with each count's exact impact, the largest impact of each term,
   and runs every item through them: cursors are ordered by document, the pivot is the first at which
   the largest impacts together reach the heap's threshold, documents before it can't be among the
   first `top` and are skipped, a document at which the cursors meet is scored. A task's later shards
   start from the threshold that its earlier ones reached.
4. The heaps of all shards are merged by one window over items, each task's part cut to `top` first.

Score of a document: the sum over the item's terms, repeats included, of
w * (10**9 tf div (1000 tf + 8 m)) with w = floor(1000 ln((2 N + 2) / (2 df + 1))), m = 25 + (75 n N div L);
whole numbers, so that no order of adding changes a rank.

Items are held by every task in blocks of up to `item_words` words, counted first; more words make more blocks,
each of which is a pass of its own, so neither the driver nor a task holds them all.

Terms: A-Z lower-cased, runs of digits, ASCII letters and non-ASCII characters.
Edge cases: null and empty texts have no terms and count in no number; items without terms, or of terms that no
document holds, have no rows; equal scores go by the smaller key, null before others; equal rows of items
count once, items of one name with different texts are ranked each; repeated documents are ranked each;
empty tables give empty results; further columns of either table are not read.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left
from collections import Counter
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from evalframe.llm.batches import ALNUM, map_texts
from evalframe.llm.common import discard, materialize


@dataclass(frozen=True)
class Settings:
    top: int = 10
    #: Counts of terms that a task holds at once.
    shard_postings: int = 3_000_000
    #: Words of the items that tasks hold at once.
    item_words: int = 200_000


#: Past every document of a shard.
_END = 1 << 62


def terms(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(ALNUM).split()


def wand(lists: list[tuple[int, list[int], list[int]]], top: int, least: int) -> list[tuple[int, int]]:
    """(score, document) of the first `top` by score and then number, of those that reach `least`.

    lists: of each term its largest impact, its documents in order with _END behind them, and their impacts.
    """
    heap: list[tuple[int, int]] = []
    cursors = [[docs[0], most, 0, docs, impacts] for most, docs, impacts in lists]
    need = max(least, 1)
    while True:
        cursors.sort()
        bound, pivot = 0, _END
        for k, c in enumerate(cursors):
            bound += c[1]
            if bound >= need:
                pivot = c[0]
                break
        if pivot == _END:
            break
        if cursors[0][0] == pivot:
            score = 0
            for c in cursors:
                if c[0] != pivot:
                    break
                at = c[2]
                score += c[4][at]
                c[2] = at = at + 1
                c[0] = c[3][at]
            if score >= need:
                if len(heap) < top:
                    heapq.heappush(heap, (score, -pivot))
                else:
                    heapq.heapreplace(heap, (score, -pivot))
                if len(heap) == top:
                    need = max(need, heap[0][0] + 1)  # an equal score of a later document is behind
        else:
            for c in cursors[:k]:
                if c[0] < pivot:
                    c[2] = at = bisect_left(c[3], pivot, c[2] + 1)
                    c[0] = c[3][at]
    return [(s, -d) for s, d in heap]


class Shard:
    """Postings of some documents: by term the largest impact, the documents and their impacts."""

    def __init__(self, lengths: np.ndarray, sizes: np.ndarray, ids: np.ndarray, counts: np.ndarray, weights: np.ndarray, n_docs: int, n_terms: int) -> None:
        norm = 25 + np.array([75 * int(x) * n_docs // n_terms for x in lengths], np.int64)
        doc = np.repeat(np.arange(len(lengths)), sizes)
        impact = weights[ids] * ((1_000_000_000 * counts) // (1000 * counts + 8 * norm[doc]))
        order = np.lexsort((doc, ids))
        ids, doc, impact = ids[order], doc[order], impact[order]
        self.known, at = np.unique(ids, return_index=True)
        self.bounds = dict(zip(self.known.tolist(), zip(at.tolist(), [*at[1:].tolist(), len(ids)])))
        self.doc, self.impact = doc, impact
        self.lists: dict[int, tuple[int, list[int], list[int]]] = {}

    def of(self, term: int) -> tuple[int, list[int], list[int]] | None:
        if term not in self.bounds:
            return None
        if term not in self.lists:
            a, b = self.bounds[term]
            impacts = self.impact[a:b]
            self.lists[term] = int(impacts.max()), [*self.doc[a:b].tolist(), _END], impacts.tolist()
        return self.lists[term]

    def first(self, item: Counter, top: int, least: int) -> list[tuple[int, int]]:
        lists = []
        for term, times in item.items():
            if (found := self.of(term)) and found[0]:
                most, docs, impacts = found
                lists.append((most * times, docs, impacts if times == 1 else [times * x for x in impacts]))
        return wand(lists, top, least) if lists else []


def _items(items: DataFrame, item: str, text: str, cfg: Settings) -> tuple[DataFrame, int]:
    """Different rows of items (item, text) and the number of blocks they are dealt into."""
    rows = items.select(F.col(item).alias("item"), F.col(text).cast("string").alias("text")).where("text IS NOT NULL").distinct()
    # A term and its separator are two bytes at least.
    words = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0] // 2
    return rows, max(1, -(-words // cfg.item_words))


def term_counts(docs: DataFrame, vocab: dict[bytes, int], key: str, text: str) -> DataFrame:
    """key, n (terms of the text), ids and counts: those of the vocabulary's terms that the text holds; texts without terms are left out."""
    shared = docs.sparkSession.sparkContext.broadcast(vocab)

    def factory():
        known = shared.value

        def fn(texts):
            n, sizes, ids, counts = [], [0], [], []
            for t in texts:
                found = terms(t)
                n.append(len(found))
                held = Counter(map(known.get, found))
                held.pop(None, None)
                ids += held.keys()
                counts += held.values()
                sizes.append(len(ids))
            offsets = pa.array(sizes, pa.int32())
            return [pa.array(n, pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32())), pa.ListArray.from_arrays(offsets, pa.array(counts, pa.int64()))]

        return fn

    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    return map_texts(rows, factory, "n bigint, ids array<int>, counts array<bigint>", ["key"]).where("n > 0")


def _search_block(docs: DataFrame, rows: list, kind_of_item: str, key: str, text: str, cfg: Settings) -> DataFrame | None:
    """item, number (of the item in its block), key, score of the documents that are first in their shard."""
    spark = docs.sparkSession
    rows = sorted(rows, key=lambda r: (r.text, str(r.item)))
    vocab: dict[bytes, int] = {}
    items = [Counter(vocab.setdefault(w, len(vocab)) for w in terms(r.text.encode())) for r in rows]
    if not vocab:
        return None
    counted = materialize(term_counts(docs, vocab, key, text), "counts")
    total = counted.agg(F.count(F.lit(1)).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    seen = counted.select(F.explode("ids").alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("df")).collect()
    weights = np.zeros(len(vocab), np.int64)
    for r in seen:
        weights[r.id] = math.floor(1000 * math.log((2 * total.docs + 2) / (2 * r.df + 1)))
    shared = spark.sparkContext.broadcast((items, weights, total.docs, total.terms))
    top, most = cfg.top, cfg.shard_postings
    kind = to_arrow_type(docs.schema[key].dataType)

    def shards(batches):
        held, size = [], 0
        for b in batches:
            held.append(b)
            size += len(b.column(2).flatten())
            if size >= most:
                yield pa.Table.from_batches(held).combine_chunks()
                held, size = [], 0
        if size:
            yield pa.Table.from_batches(held).combine_chunks()

    def search(batches):
        items, weights, n_docs, n_terms = shared.value
        least = [1] * len(items)
        for t in shards(batches):
            t = t.take(pc.sort_indices(t.column("key"), null_placement="at_start")).combine_chunks()
            lists = [t.column(c).combine_chunks() for c in ("ids", "counts")]
            sizes = pc.list_value_length(lists[0]).to_numpy(zero_copy_only=False)
            ids, counts = (x.flatten().to_numpy(zero_copy_only=False).astype(np.int64) for x in lists)
            shard = Shard(t.column("n").to_numpy(), sizes, ids, counts, weights, n_docs, n_terms)
            out: tuple[list, list, list] = ([], [], [])
            for i, item in enumerate(items):
                found = shard.first(item, top, least[i])
                if len(found) == top:
                    least[i] = max(least[i], min(s for s, _ in found))
                for score, doc in found:
                    for column, v in zip(out, (i, doc, score)):
                        column.append(v)
            keys = t.column("key").combine_chunks().take(pa.array(out[1], pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), keys.cast(kind), pa.array(out[2], pa.int64())], names=["number", "key", "score"])

    searched = counted.where(F.size("ids") > 0).mapInArrow(search, f"number int, key {docs.schema[key].dataType.simpleString()}, score bigint")
    rank = F.row_number().over(W.partitionBy("number").orderBy(F.desc("score"), F.col("key").asc_nulls_first()))
    first = searched.withColumn("rank", rank).where(F.col("rank") <= top)
    # Stored, as the table of counts goes; at most `top` rows an item.
    first = materialize(first, "first")
    discard(counted)
    names = spark.createDataFrame([(i, r.item) for i, r in enumerate(rows)], f"number int, item {kind_of_item}")
    return first.join(F.broadcast(names), "number").select("item", "rank", "key", "score")


def search(
    docs: DataFrame, items: DataFrame, cfg: Settings = Settings(), key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """Each item's first `top` documents of a score above 0: item, rank (int, from 1), key, score (long)."""
    table, blocks = _items(items, item, item_text, cfg)
    block = F.pmod(F.xxhash64("item", "text"), F.lit(blocks))
    parts = []
    for b in range(blocks):
        rows = table.where(block == b).collect()
        found = _search_block(docs, rows, table.schema["item"].dataType.simpleString(), key, text, cfg) if rows else None
        if found is not None:
            parts.append(found)
    if parts:
        return reduce(DataFrame.unionByName, parts)
    none = table.select("item", F.lit(0).alias("rank")).limit(0).crossJoin(docs.select(F.col(key).alias("key")).limit(0))
    return none.select("item", "rank", "key", F.lit(0).cast("long").alias("score"))
