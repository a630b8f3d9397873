"""Benchmark decontamination by a generalised suffix automaton of the test items.

The automaton holds every substring of every normalised item (sequences of word numbers). A
document streams through it; the longest match ending at each word says whether a window (a
given number of consecutive item words, or a whole shorter item) ends there. Words covered by
windows form the spans that are removed; a document whose covered share passes a limit is
marked for removal as a whole.

A benchmark of up to `automaton_words` words, which is counted first, is one automaton that every
task holds. A larger one never passes the driver: its items are dealt into shards of about that
many words, and documents go to the shards that may hold a window of theirs. Windows are stood for
by the least of their `seed`-word hashes, so a document goes where it shares one with an item;
items shorter than a window have shards of their own, through which every text goes. A task reads
its rows sorted by shard and block, items first, builds that shard's automaton once and streams
the block's texts; texts are told apart by two hashes, so equal ones are streamed once.

Normalised words: A-Z lower-cased, runs of digits, ASCII letters and non-ASCII characters.
Edge cases: null or empty texts and items have no words and no hits; an item whose id is null
covers words like any other and is not listed; equal items are all listed; repeated rows are treated alike; empty tables give empty results; documents keep all
their columns, and the result columns replace none (a clash raises).
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from evalframe.llm.batches import ALNUM, map_texts
from evalframe.llm.common import discard, join_small, materialize
from evalframe.llm.token_hash import WordHashes, signed, sliding_min, windows

_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


@dataclass(frozen=True)
class Limits:
    window: int = 10
    max_coverage: float = 0.5  # above this share of covered words the whole document should go
    #: Words of items in one automaton (some 200 bytes a word); a larger benchmark is dealt into shards.
    automaton_words: int = 500_000
    seed: int = 5
    #: Words of documents that one building of a shard's automaton serves.
    block_words: int = 5_000_000


ADDED = ("n_words", "spans", "item_ids", "over_limit", "clean_text")


class SuffixAutomaton:
    """Of several sequences; next maps, suffix links and longest lengths by state."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]

    def add(self, seq: list[int]) -> None:
        last = 0
        for c in seq:
            last = self._extend(last, c)

    def _state(self, length: int, edges: dict[int, int], link: int) -> int:
        self.next.append(edges)
        self.length.append(length)
        self.link.append(link)
        return len(self.next) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        """The state of p's longest string followed by c, cut out of q if q's is longer."""
        if self.length[p] + 1 == self.length[q]:
            return q
        clone = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def _extend(self, p: int, c: int) -> int:
        if c in self.next[p]:
            return self._split(p, c, self.next[p][c])
        new = self._state(self.length[p] + 1, {}, 0)
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, c, self.next[p][c])
        return new


class Matcher:
    """Finds windows of items in token streams."""

    def __init__(self, items: list[tuple[object, bytes | None]], window: int) -> None:
        self.window = window
        self.vocab: dict[bytes, int] = {}
        self.automaton = SuffixAutomaton()
        self.items_at: dict[tuple[int, ...], list] = {}
        self.short: set[int] = set()
        for item, text in items:
            seq = [self.vocab.setdefault(w, len(self.vocab)) for w in (text or b"").translate(ALNUM).split()]
            if not seq:
                continue
            self.automaton.add(seq)
            size = min(window, len(seq))
            if size < window:
                self.short.add(size)
            for key in {tuple(seq[i : i + size]) for i in range(len(seq) - size + 1)}:
                self.items_at.setdefault(key, []).append(item)
        self.least = min(self.short, default=window)

    def scan(self, tokens: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Maximal covered spans (start, end) in words, and the items that have a window there."""
        n = len(tokens)
        if n < self.least or not self.vocab:
            return [], set()
        ids = np.fromiter(map(self.vocab.get, tokens, repeat(-1)), np.int64, n)
        known = np.flatnonzero(np.diff(np.concatenate(([0], ids >= 0, [0])).astype(np.int8)))
        spans: list[tuple[int, int]] = []
        items: set = set()
        for a, b in known.reshape(-1, 2):
            if b - a >= self.least:
                self._run(int(a), ids[a:b].tolist(), spans, items)
        merged: list[tuple[int, int]] = []
        for a, b in sorted(spans):
            if merged and a <= merged[-1][1]:
                merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
            else:
                merged.append((a, b))
        return merged, items

    def _run(self, start: int, ids: list[int], spans: list, items: set) -> None:
        nxt, link, length = self.automaton.next, self.automaton.link, self.automaton.length
        sizes = sorted({*self.short, self.window})
        state = matched = 0
        for i, c in enumerate(ids):
            while state and c not in nxt[state]:
                state = link[state]
                matched = length[state]
            to = nxt[state].get(c)
            if to is None:
                continue
            state, matched = to, matched + 1
            for size in sizes:
                if matched < size:
                    break
                found = self.items_at.get(tuple(ids[i - size + 1 : i + 1]))
                if found:
                    items.update(found)
                    spans.append((start + i - size + 1, start + i + 1))


def _tokens(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(ALNUM).split()


def _benchmark(benchmark: DataFrame, limits: Limits, item: str, text: str) -> tuple[list | None, DataFrame]:
    """The items if they are few enough to be held by every task, and the table of them (item, text)."""
    table = benchmark.select(F.col(item).alias("item"), F.col(text).alias("text")).where(F.col("text").isNotNull())
    # A word and its separator are two bytes at least.
    words = table.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0] // 2
    if words > limits.automaton_words:
        return None, table
    rows = table.select("item", F.col("text").cast("binary")).collect()
    return sorted(((r[0], bytes(r[1])) for r in rows), key=lambda x: (x[0] is None, x[0] if x[0] is not None else 0, x[1])), table


def _marks() -> list[Column]:
    return [F.xxhash64("text").alias("t1"), F.xxhash64("text", F.lit(1)).alias("t2")]


def _seeds(df: DataFrame, limits: Limits, keep: list[str]) -> DataFrame:
    """keep, n_words and seeds: the distinct least seed-word hashes of the text's windows."""
    window, seed = limits.window, min(limits.seed, limits.window)

    def factory():
        hashes = WordHashes()

        def fn(texts):
            n, seeds = [], []
            for t in texts:
                words = _tokens(t)
                n.append(len(words))
                seeds.append(signed(np.unique(sliding_min(windows(hashes.of(words), seed), window - seed + 1))))
            return [pa.array(n, pa.int64()), pa.array(seeds, pa.list_(pa.int64()))]

        return fn

    return map_texts(df, factory, "n_words bigint, seeds array<bigint>", keep, "text", rows=1000)


def _sharded(docs: DataFrame, table: DataFrame, limits: Limits) -> DataFrame:
    """t1, t2, spans, items: what each different text has of the items, from all the shards it went to."""
    item_type = table.schema["item"].dataType
    known = materialize(_seeds(table, limits, ["item", "text"]).where("n_words > 0"), "items")
    long = F.col("n_words") >= limits.window
    sums = {r.long: r.words for r in known.groupBy(long.alias("long")).agg(F.sum("n_words").alias("words")).collect()}
    n_long, n_short = (-(-sums.get(kind, 0) // limits.automaton_words) for kind in (True, False))
    number = F.xxhash64("item", "text")
    shard = F.when(long, F.pmod(number, F.lit(max(n_long, 1)))).otherwise(n_long + F.pmod(number, F.lit(max(n_short, 1))))
    items = materialize(known.withColumn("shard", shard.cast("int")), "items")
    places = materialize(items.where(long).select(F.explode("seeds").alias("s"), "shard").distinct(), "seeds")

    texts = docs.where("text IS NOT NULL").select("text", *_marks())
    seen = materialize(_seeds(texts, limits, ["t1", "t2"]).dropDuplicates(["t1", "t2"]), "seen")
    route = seen.select("t1", "t2", "n_words", F.explode("seeds").alias("s")).join(places.hint("merge"), "s").drop("s").distinct()
    every = seen.where("n_words > 0").select("t1", "t2", "n_words", F.explode(F.sequence(F.lit(n_long), F.lit(n_long + n_short - 1))).alias("shard"))
    route = materialize(route.unionByName(every) if n_short else route, "route")
    blocks = route.groupBy("shard").agg(F.greatest(F.ceil(F.sum("n_words") / limits.block_words), F.lit(1)).cast("int").alias("blocks"))
    blocks = materialize(blocks, "blocks")
    n_blocks = blocks.count()
    route = join_small(route, blocks, ["shard"], n_blocks, "inner")
    route = route.select("t1", "t2", "shard", F.pmod(F.xxhash64("t1", "t2"), "blocks").cast("int").alias("block"))
    streamed = texts.dropDuplicates(["t1", "t2"]).join(route.hint("merge"), ["t1", "t2"])

    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    rows = join_small(items, blocks, ["shard"], n_blocks, "inner").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("shard", "block", F.lit(0).alias("kind"), "item", none("bigint", "t1"), none("bigint", "t2"), "text")
    rows = rows.unionByName(streamed.select("shard", "block", F.lit(1).alias("kind"), none(item_type, "item"), "t1", "t2", "text"))
    rows = rows.repartition("shard", "block").sortWithinPartitions("shard", "block", "kind")
    window = limits.window
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def located(batches):
        at, held, matcher = None, [], None
        for b in batches:
            kept, spans, found = [], [], []
            for i, (shard, block, kind, item, text) in enumerate(zip(*(b.column(k).to_pylist() for k in (0, 1, 2, 3, 6)))):
                if (shard, block) != at:
                    at, held, matcher = (shard, block), [], None
                if kind == 0:
                    held.append((item, text.encode()))
                    continue
                if matcher is None:
                    matcher, held = Matcher(held, window), []
                s, names = matcher.scan(_tokens(text.encode()))
                if s:
                    kept.append(i)
                    spans.append([{"start": x, "end": y} for x, y in s])
                    found.append(_named(names))
            rows_at = pa.array(kept, pa.int64())
            cols = [b.column(4).take(rows_at), b.column(5).take(rows_at), pa.array(spans, span), pa.array(found, pa.list_(b.column(3).type))]
            yield pa.RecordBatch.from_arrays(cols, names=["t1", "t2", "spans", "items"])

    kind = item_type.simpleString()
    parts = rows.mapInArrow(located, f"t1 bigint, t2 bigint, spans array<struct<start:int,end:int>>, items array<{kind}>")
    # A text has a row a shard at most; spans of different shards may overlap and are united when they are used.
    out = materialize(parts, "found").groupBy("t1", "t2").agg(
        F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("items")).alias("items")
    )
    out = materialize(out, "found")
    discard(known, items, places, seen, route, blocks)
    return out


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    limits: Limits = Limits(),
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    keep: list[str] | None = None,
    with_text: bool = False,
) -> DataFrame:
    """keep columns plus n_words, spans (in words), item_ids (sorted), over_limit, and clean_text if asked."""
    keep = docs.columns if keep is None else keep
    clash = sorted({*ADDED[: 4 + with_text]} & set(keep))
    if clash:
        raise ValueError(f"there are columns {clash} already")
    few, table = _benchmark(benchmark, limits, item, item_text)
    window, most = limits.window, limits.max_coverage
    shared = docs.sparkSession.sparkContext.broadcast(few) if few is not None else None
    found: list[str] = []
    if shared is None:
        hits = _sharded(docs.select(F.col(text).alias("text")), table, limits)
        name = "_hits"
        while any(c.startswith(name) for c in docs.columns):
            name += "_"
        found = [f"{name}spans", f"{name}items"]
        marked = docs.withColumns({f"{name}1": F.xxhash64(text), f"{name}2": F.xxhash64(text, F.lit(1))})
        hits = hits.withColumnsRenamed({"t1": f"{name}1", "t2": f"{name}2", "spans": found[0], "items": found[1]})
        docs = marked.join(hits.hint("merge"), [f"{name}1", f"{name}2"], "left")

    def factory():
        matcher = Matcher(shared.value, window) if shared is not None else None

        def fn(texts, *told):
            n, spans, items = [], [], []
            for k, t in enumerate(texts):  # the words of one text at a time
                words = _tokens(t)
                if matcher is not None:
                    s, i = matcher.scan(words)
                else:
                    s, i = _union([(x["start"], x["end"]) for x in told[0][k] or ()], []), set(told[1][k] or ())
                n.append(len(words))
                spans.append(s)
                items.append(i)
            hit = [sum(b - a for a, b in s) for s in spans]
            cols = [
                pa.array(n, pa.int64()),
                pa.array([[{"start": a, "end": b} for a, b in s] for s in spans],
                         pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
                pa.array([_named(i) for i in items], pa.list_(arrow_item)),
                pa.array([h > most * k for h, k in zip(hit, n)], pa.bool_()),
            ]
            if with_text:
                cleaned = [t if not s else _cut(t, s) for t, s in zip(texts, spans)]
                cols.append(pa.array(cleaned, pa.binary()).cast(pa.string()))
            return cols

        return fn

    kind = table.schema["item"].dataType.simpleString()
    arrow_item = to_arrow_type(table.schema["item"].dataType)
    fields = f"n_words bigint, spans array<struct<start:int,end:int>>, item_ids array<{kind}>, over_limit boolean"
    return map_texts(docs, factory, fields + ", clean_text string" * with_text, keep, text, with_row=found, rows=1000)


def _named(items: set) -> list:
    """In order; an item without an id covers words and is not named."""
    return sorted(i for i in items if i is not None)


def _union(a: list, b: list) -> list:
    out: list = []
    for x, y in sorted([*a, *b]):
        if out and x <= out[-1][1]:
            out[-1] = (out[-1][0], max(y, out[-1][1]))
        else:
            out.append((x, y))
    return out


def _cut(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the spans' bytes, from each span's first word to its last."""
    at = [m.span() for m in _WORD.finditer(text)]
    out, last = [], 0
    for a, b in spans:
        out.append(text[last : at[a][0]])
        last = at[b - 1][1]
    return b"".join([*out, text[last:]])
