"""Removal of passages that repeat across documents, by repeated-phrase automata.

1. Each distinct word sequence is kept once, by its smallest key. Every window of `window` words
   is stood for by the least of its `phrase`-word hashes (its anchor), so equal windows have
   equal anchors and a document emits about one anchor per (window - phrase) / 2 words.
2. Anchors found in two or more documents are confirmed as recurring phrases; the smallest
   document that has one owns it and gives its words. An owner's phrases stay together: owners are
   dealt into shards by a hash, so many that a shard holds `shard_phrases` phrases on average.
3. A document goes to the shards whose owners share a confirmed phrase with it: few, as copied
   text comes from few places. A shard's phrases, as sequences of word numbers, are compiled once
   per block of documents (at most `block_words` words or one document) into an Aho-Corasick
   automaton (pyahocorasick), through which the documents stream; it finds where the phrases
   occur, and with that the windows that may recur. Documents bring no positions, only their text.
4. Those windows' hashes are aggregated to the smallest document that holds them; in every
   larger document they are removed.

Word numbers are 32-bit hashes, so what the automaton finds is compared by the phrase's 64-bit
hash; windows are compared by 64-bit hashes of their words' 64-bit hashes. All windows are judged
on the input. Counts and groups are aggregated before each shuffle and joined as pairs (hash,
key), so a passage in a third of all documents only makes a skewed join, which Spark splits, and
many blocks; per document, lists are bounded by the document's own length. A task reads its rows
sorted by block, phrases first, and holds one automaton at a time.

Edge cases: null and empty texts have no words; documents shorter than a window lose nothing;
rows that repeat a key and text are treated alike, and a key's own repeats never count against
it; rows that repeat a key with different texts lose what each of them repeats; empty tables
give empty results; other columns are kept by `remove_spans`, whatever their names but `spans`
and `_text_mark`.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalframe.llm.batches import map_texts
from evalframe.llm.common import BROADCAST_KEYS, discard, join_small, materialize
from evalframe.llm.token_hash import WordHashes, signed, sliding_min, windows


#: Hash of a row's text: tells apart rows that repeat a key with different texts.
MARK = "_text_mark"


@dataclass(frozen=True)
class Settings:
    window: int = 50
    phrase: int = 16
    shard_phrases: int = 20_000  # some 20 MB of automaton
    block_words: int = 2_000_000


def _anchors(docs: DataFrame, cfg: Settings, keep: list[str], text: str) -> DataFrame:
    """keep columns, n_words, hash of the word sequence (two longs), anchors of its windows (distinct)."""
    window, phrase = cfg.window, cfg.phrase

    def factory():
        hashes = WordHashes()

        def fn(texts):
            n, hi, lo, anchors = [], [], [], []
            for t in texts:
                w = (t or b"").split()
                d = xxhash.xxh3_128_intdigest(b" ".join(w))
                n.append(len(w))
                hi.append((d >> 64) - (1 << 63))
                lo.append((d & ((1 << 64) - 1)) - (1 << 63))
                if len(w) < window:
                    anchors.append(None)
                else:
                    least = sliding_min(windows(hashes.of(w), phrase), window - phrase + 1)
                    anchors.append(signed(np.unique(least)))
            return [
                pa.array(n, pa.int64()), pa.array(hi, pa.int64()), pa.array(lo, pa.int64()),
                pa.array(anchors, pa.list_(pa.int64())),
            ]

        return fn

    return map_texts(docs, factory, "n_words bigint, s1 bigint, s2 bigint, anchors array<bigint>", keep, text)


def _phrases(owners: DataFrame, cfg: Settings, text: str) -> DataFrame:
    """shard, h, numbers: the words of the phrases that a document owns; owners has its text, shard and owned (hashes)."""
    phrase = cfg.phrase

    def texts(batches):
        hashes = WordHashes()
        for b in batches:
            shards, found, numbers = [], [], []
            for shard, t, owned in zip(*(b.column(i).to_pylist() for i in range(3))):
                words = hashes.of((t or "").encode().split())
                grams = signed(windows(words, phrase))
                at = np.flatnonzero(np.isin(grams, np.array(owned, np.int64)))
                h, first = np.unique(grams[at], return_index=True)
                for v, p in zip(h.tolist(), at[first].tolist()):
                    shards.append(shard)
                    found.append(v)
                    numbers.append(word_numbers(words[p : p + phrase]))
            cols = [pa.array(shards, pa.int32()), pa.array(found, pa.int64()), pa.array(numbers, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(cols, names=["shard", "h", "numbers"])

    return owners.select("shard", text, "owned").mapInArrow(texts, "shard int, h bigint, numbers array<bigint>")


def word_numbers(words: np.ndarray) -> list[int]:
    """Word hashes as the automaton's letters, of 32 bits."""
    return (words >> np.uint64(32)).astype(np.int64).tolist()


class Phrases:
    """An automaton of phrases as sequences of word numbers."""

    def __init__(self) -> None:
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)

    def add(self, h: int, numbers: list[int]) -> None:
        key = tuple(numbers)
        # Phrases that differ in 64 bits but not in their words' 32 share an entry.
        self.automaton.add_word(key, (*self.automaton.get(key, ()), h))

    def compile(self) -> None:
        if len(self.automaton):
            self.automaton.make_automaton()

    def occurrences(self, words: np.ndarray, phrase: int) -> tuple[list[int], list[int]]:
        """Starts and hashes of all phrases in a sequence of word hashes."""
        starts, found = [], []
        if len(self.automaton) and len(words) >= phrase:
            for end, named in self.automaton.iter(tuple(word_numbers(words))):
                for h in named:
                    starts.append(end - phrase + 1)
                    found.append(h)
        return starts, found


def _recurring_windows(rows: DataFrame, cfg: Settings, key_type) -> DataFrame:
    """key, mark, starts, hashes of the windows that hold a phrase of the block as their anchor.

    rows: shard, block, kind (0: a phrase, 1: a document), key, mark, text, h, numbers; sorted by these within partitions.
    """
    window, phrase = cfg.window, cfg.phrase

    def located(batches):
        hashes, at, phrases, ready = WordHashes(), None, Phrases(), False
        for b in batches:
            starts, found, kept = [], [], []
            cols = [b.column(i).to_pylist() for i in (0, 1, 2, 5, 6, 7)]
            for i, (shard, block, kind, text, h, numbers) in enumerate(zip(*cols)):
                if (shard, block) != at:
                    at, phrases, ready = (shard, block), Phrases(), False
                if kind == 0:
                    phrases.add(h, numbers)
                    continue
                if not ready:
                    phrases.compile()
                    ready = True
                words = hashes.of((text or "").encode().split())
                where, named = phrases.occurrences(words, phrase)
                if not where or len(words) < window:
                    continue
                grams = windows(words, phrase)
                where = np.array(where)
                held = where[signed(grams)[where] == np.array(named, np.int64)]
                least = sliding_min(grams, window - phrase + 1)
                k = np.flatnonzero(np.isin(least, grams[held]))
                kept.append(i)
                starts.append(k.astype(np.int32))
                found.append(signed(windows(words, window)[k]))
            at_rows = pa.array(kept, pa.int64())
            out = [b.column(3).take(at_rows), b.column(4).take(at_rows), pa.array(starts, pa.list_(pa.int32())), pa.array(found, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(out, names=["key", "mark", "starts", "hashes"])

    added = T._parse_datatype_string("mark bigint, starts array<int>, hashes array<bigint>")
    schema = T.StructType([T.StructField("key", key_type), *added.fields])
    return rows.mapInArrow(located, schema)


def find_repeats(docs: DataFrame, cfg: Settings = Settings(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document that loses words: key, MARK, spans (start, end) in words, sorted and disjoint."""
    window = cfg.window
    docs = docs.select(F.col(key).alias("key"), F.xxhash64(text).alias("mark"), F.col(text).alias("text"))
    seen = materialize(_anchors(docs, cfg, ["key", "mark"], "text"), "anchors")
    long = seen.where(F.col("n_words") >= window)
    first = materialize(long.groupBy("s1", "s2").agg(F.min("key").alias("first")), "first")
    # Stored, so that the join shuffles both sides itself and can split a hot text's partition.
    marked = long.join(first.hint("merge"), ["s1", "s2"])
    marked = materialize(marked.select("key", "mark", "n_words", "first", F.when(F.col("key") == F.col("first"), F.col("anchors")).alias("anchors")), "marked")
    copies = marked.where("key <> first").select("key", "mark", F.lit(0).alias("start"), F.col("n_words").cast("int").alias("end"))
    reps = marked.where("key = first").select("key", "mark", "n_words", F.explode("anchors").alias("a"))
    shared = reps.groupBy("a").agg(F.min("key").alias("owner"), F.max("key").alias("hi")).where("owner <> hi").select("a", "owner")
    shared = materialize(shared, "phrases")
    shards = max(1, -(-shared.count() // cfg.shard_phrases))
    shard = F.pmod(F.xxhash64("owner"), F.lit(shards)).cast("int").alias("shard")

    # Documents and the shards they go to; blocks of a shard, so that none has more words than asked for.
    route = reps.join(shared.hint("merge"), "a").select("key", "mark", "n_words", shard).distinct()
    route = materialize(route, "route")
    blocks = route.groupBy("shard").agg(F.ceil(F.sum("n_words") / cfg.block_words).cast("int").alias("blocks"))
    blocks = materialize(blocks, "blocks")
    n_route, n_blocks = route.count(), blocks.count()
    route = join_small(route, blocks, ["shard"], n_blocks, "inner")
    route = route.select("key", "mark", "shard", F.pmod(F.xxhash64("key", F.lit(3)), "blocks").cast("int").alias("block"))
    streamed = docs.join(F.broadcast(route) if n_route <= BROADCAST_KEYS // 2 else route.hint("merge"), ["key", "mark"])

    owned = materialize(shared.groupBy(F.col("owner").alias("key"), shard).agg(F.collect_list("a").alias("owned")), "owned")
    size = owned.agg(F.coalesce(F.sum(F.size("owned") + 1), F.lit(0))).first()[0]
    owners = docs.join(F.broadcast(owned) if size <= BROADCAST_KEYS else owned.hint("merge"), "key")
    # An owner's key may stand on several texts: each phrase is taken once.
    words = materialize(_phrases(owners, cfg, "text").dropDuplicates(["shard", "h"]), "automata")
    words = join_small(words, blocks, ["shard"], n_blocks, "inner")
    words = words.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))

    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    rows = words.select("shard", "block", F.lit(0).alias("kind"), none(docs.schema["key"].dataType, "key"), none("bigint", "mark"), none("string", "text"), "h", "numbers")
    rows = rows.unionByName(streamed.select(
        "shard", "block", F.lit(1).alias("kind"), "key", "mark", "text", none("bigint", "h"), none("array<bigint>", "numbers")
    ))
    rows = rows.repartition("shard", "block").sortWithinPartitions("shard", "block", "kind")
    runs = materialize(_recurring_windows(rows, cfg, docs.schema["key"].dataType), "windows")
    pairs = runs.select("key", "mark", F.explode(F.arrays_zip("starts", "hashes")).alias("w"))
    pairs = pairs.select("key", "mark", F.col("w.starts").alias("p"), F.col("w.hashes").alias("h"))
    owner = pairs.groupBy("h").agg(F.min("key").alias("lo"), F.max("key").alias("hi")).where("lo <> hi").select("h", "lo")
    # Stored, as the first texts are.
    owner = materialize(owner, "owners")
    late = pairs.join(owner.hint("merge"), "h").where(F.col("key") > F.col("lo"))
    starts = late.groupBy("key", "mark").agg(F.sort_array(F.collect_set("p")).alias("p"))
    whole = copies.distinct().select("key", "mark", F.array(F.struct("start", "end")).alias("spans"))
    spans = materialize(whole.unionByName(_runs(starts, window)).withColumnsRenamed({"key": key, "mark": MARK}), "spans")
    discard(seen, first, marked, shared, route, blocks, owned, words, runs, owner)
    return spans


def _runs(starts: DataFrame, window: int) -> DataFrame:
    """Sorted window starts to spans: a span ends where the next start lies past its end."""
    first = F.filter("p", lambda x, i: (i == 0) | (x > F.get("p", i - 1) + window))
    last = F.filter("p", lambda x, i: (i == F.size("p") - 1) | (F.get("p", i + 1) > x + window))
    spans = F.transform(
        F.arrays_zip(first.alias("a"), last.alias("b")),
        lambda s: F.struct(s["a"].alias("start"), (s["b"] + window).alias("end")),
    )
    return starts.select("key", "mark", spans.alias("spans"))


def join_spans(docs: DataFrame, spans: DataFrame, key: str = "doc_id", text: str = "text", name: str = "spans") -> DataFrame:
    """docs with their spans in a column of that name, null where they lose nothing; broadcast only behind a count."""
    size = spans.agg(F.coalesce(F.sum(F.size("spans") + 1), F.lit(0))).first()[0]
    marked = docs.withColumn(MARK, F.xxhash64(text))
    spans = spans.withColumnRenamed("spans", name)
    return marked.join(F.broadcast(spans) if size <= BROADCAST_KEYS else spans.hint("merge"), [key, MARK], "left").drop(MARK)


def remove_spans(
    docs: DataFrame,
    fields: list[tuple[str, str, pa.DataType]],
    make: Callable[[list[bytes], list[bytes]], tuple],
    text: str = "text",
    keep: list[str] | None = None,
    name: str = "spans",
) -> DataFrame:
    """keep columns plus the fields (name, Spark type, Arrow type) that make gives for (all words, kept words).

    docs has the column of join_spans, of the same name.
    """
    types = [t for _, _, t in fields]

    def factory():
        def fn(texts, spans):
            rows = []
            for t, s in zip(texts, spans):
                w = (t or b"").split()
                rows.append(make(w, w if not s else [x for a, b in _gaps(s, len(w)) for x in w[a:b]]))
            return [pa.array([r[k] for r in rows], t) for k, t in enumerate(types)]

        return fn

    return map_texts(docs, factory, ", ".join(f"{n} {t}" for n, t, _ in fields), keep, text, with_row=[name])


def deduplicated_text(docs: DataFrame, cfg: Settings = Settings(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs plus clean_text: the kept words joined by single spaces; a column of that name is replaced, any other stays."""
    name = "spans"
    while name in docs.columns:
        name += "_"
    joined = join_spans(docs, find_repeats(docs, cfg, key, text), key, text, name)
    fields = [("clean_text", "string", pa.string())]
    keep = [c for c in docs.columns if c != "clean_text"]
    return remove_spans(joined, fields, lambda _, left: (b" ".join(left).decode(),), text, keep, name)


def _gaps(spans: list[dict], n: int):
    at = 0
    for s in spans:
        yield at, s["start"]
        at = s["end"]
    yield at, n
