"""Fuzzy line dedup by MinHash, in DataFrame functions only.

Lines are compared by their shingles, the `shingle` characters at every position, after collapsing
runs of separators (controls and spaces), trimming and lower-casing.

1. Equal lines are one from the start: a line is named by two 64-bit hashes.
2. Signature: every position of a line's UTF-8 form gives one hash. It names one of the
   signature's values and competes for its minimum (one permutation, cut into bins); a hash too
   large to be one of the `per_value` smallest a bin may expect is dropped before the aggregation.
   A value without a shingle borrows the next one's. A line in which few different shingles
   repeat so often that all of them were dropped is hashed again with nothing dropped.
3. Bands of `rows` values name buckets: of pairs at the threshold over 99 % share one.
4. Candidates are decided by the exact Jaccard similarity of their sets of shingles, now of
   characters. Components come from distributed union-find (see linking: a bucket's pairs are
   not all made).
5. Of each component the line with the smallest (key, line number) is kept, every other
   occurrence goes.

Edge cases: blank lines are never removed; null and empty texts stay as they are; lines whose
normalised form is shorter than `min_chars` lose their exact copies only; equal rows
of a key are one document and lose the same lines, rows of a key with different texts are told
apart by their text; a null key is a key like others, the smallest; very long lines are shingled whole;
empty tables give empty results; other columns stay, whatever their names, but one named as
`n_removed` raises.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalframe.llm.common import BROADCAST_KEYS, discard, has_repeated_keys, join_small, materialize, only_ids, semi_join
from evalframe.llm.linking import link_groups


@dataclass(frozen=True)
class Settings:
    shingle: int = 12
    threshold_pct: int = 80
    bands: int = 6
    rows: int = 2
    min_chars: int = 20
    per_value: int = 4


def normal_line(line: Column) -> Column:
    """Runs of separators as one space, none at the ends, lower case; single spaces are not rewritten."""
    collapsed = F.regexp_replace(line, r"[\x00-\x1F][\x00-\x20]*|\x20[\x00-\x20]+", " ")
    # Most lines hold none: a search is cheaper than a replacement.
    odd = F.contains(line, F.lit("  ")) | line.rlike(r"[\x00-\x1F]")
    return F.lower(F.trim(F.when(odd, collapsed).otherwise(line)))


def _lines(docs: DataFrame, cfg: Settings, key: str, text: str) -> DataFrame:
    """key, mark, pos, h1, h2, and line (normalised; null where shorter than min_chars) of the lines that are not blank.

    mark tells texts of one key apart; it is null where no key has several.
    """
    mark = F.xxhash64(text) if has_repeated_keys(docs, key, text) else F.lit(None).cast("long")
    df = docs.select(F.col(key).alias("key"), mark.alias("mark"), F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    # A test of the line as it stands: one of the normalised form would normalise every line twice.
    df = df.where(F.col("line").rlike(r"[^\x00-\x20]")).withColumn("line", normal_line(F.col("line")))
    long = F.when(F.length("line") >= cfg.min_chars, F.col("line"))
    return df.select("key", "mark", "pos", F.xxhash64("line").alias("h1"), F.xxhash64("line", F.lit(1)).alias("h2"), long.alias("line"))


def _minima(lines: DataFrame, cfg: Settings, thin: bool) -> DataFrame:
    """h1, h2 and the minimum of each of the signature's values, null where no shingle competed for it."""
    k, span = cfg.bands * cfg.rows, 1 << 31
    n = F.greatest(F.octet_length("line") - (cfg.shingle - 1), F.lit(1))
    rows = lines.where("line is not null").select("h1", "h2", F.col("line").cast("binary").alias("b"), n.alias("n"))
    rows = rows.select("h1", "h2", "b", "n", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("i"))
    rows = rows.select("h1", "h2", "n", "i", F.xxhash64(F.substring("b", F.col("i"), F.lit(cfg.shingle))).alias("g"))
    rank = F.col("g").bitwiseAND(F.lit(span - 1))
    competes = rank * F.col("n") < F.lit(k * cfg.per_value * span) if thin else F.lit(True)
    # Position 1 keeps its row, so that a line of which every hash is dropped shows.
    rows = rows.where(competes | (F.col("i") == 1))
    value = F.when(competes, F.pmod(F.shiftright("g", 33), F.lit(k))).alias("value")
    rows = rows.select("h1", "h2", value, rank.cast("int").alias("rank"))
    return rows.groupBy("h1", "h2").agg(*(F.min(F.when(F.col("value") == i, F.col("rank"))).alias(f"m{i}") for i in range(k)))


def _signatures(lines: DataFrame, cfg: Settings) -> list[DataFrame]:
    """h1, h2, m0, m1, ...: one row for each different line of at least min_chars, in one or two stored tables."""
    some = F.coalesce(*(f"m{i}" for i in range(cfg.bands * cfg.rows))).isNotNull()
    found = materialize(_minima(lines, cfg, thin=True), "signatures")
    few = materialize(found.where(~some).select("h1", "h2"), "few")
    n_few = few.count()
    if not n_few:
        discard(few)
        return [found]
    # Each line once: the rest is as many rows as lines that repeat themselves, not as their copies.
    again = semi_join(lines.where("line is not null").select("h1", "h2", "line"), few, ["h1", "h2"], 2 * n_few)
    whole = materialize(_minima(again.dropDuplicates(["h1", "h2"]), cfg, thin=False), "signatures", n_few)
    discard(few)
    return [found, whole]


def _bands(signed: list[DataFrame], cfg: Settings) -> DataFrame:
    """t, id: the buckets of each line. An empty value borrows the next one that is not, marked by the distance."""
    k = cfg.bands * cfg.rows
    # Where the first table has no value at all, the second has the line.
    some = F.coalesce(*(f"m{i}" for i in range(k))).isNotNull()
    named = reduce(DataFrame.unionByName, (df.where(some) for df in signed)).select(F.col("h1").alias("id"), *(F.col(f"m{i}").cast("long").alias(f"v{i}") for i in range(k)))
    step = 1
    while step < k:  # each round doubles how far a value may come from
        far = lambda i: F.col(f"v{(i + step) % k}") + F.lit(step << 32)  # noqa: E731, B023
        named = named.select("id", *(F.coalesce(f"v{i}", far(i)).alias(f"v{i}") for i in range(k)))
        step *= 2
    band = lambda b: F.xxhash64(F.lit(b), *(f"v{b * cfg.rows + r}" for r in range(cfg.rows)))
    return named.select("id", F.explode(F.array(*(band(b) for b in range(cfg.bands)))).alias("t"))


def shingle_set(line: Column, size: int) -> Column:
    """Distinct hashes of a line's characters by `size`, at every position; of a shorter line, of itself."""
    # Four bytes a character, so that a shingle is cut out without counting; bound once for all positions.
    cut = lambda b: F.transform(
        F.sequence(F.lit(1), F.greatest(F.octet_length(b) - (4 * size - 1), F.lit(1)), F.lit(4)),
        lambda i: F.xxhash64(F.substring(b, i, F.lit(4 * size))),
    )
    return F.array_distinct(F.get(F.transform(F.array(F.encode(line, "UTF-32")), cut), F.lit(0)))


#: Words of 64 bits that a set's shingles flip.
BITS = tuple(f"o{i}" for i in range(16))


def _may_link(pct: int):
    """Sizes near enough, and the sets' bits differ in no more places than the sets may."""

    def test(x, y):
        low, high = F.least(x("size"), y("size")), F.greatest(x("size"), y("size"))
        odd = sum((F.bit_count(x(o).bitwiseXOR(y(o))) for o in BITS), F.lit(0))
        return (low * 100 >= high * pct) & (odd * (100 + pct) <= (low + high) * (100 - pct))

    return test


def _facts(texts: DataFrame, size: int) -> DataFrame:
    """id, size, o0 to o15: the size of each line's set and the bits that its members flip."""
    # The set is made in a projection of its own and a set is never empty, so the outer form, which nothing is
    # inferred for, changes no row: what takes the members one by one is compiled, which it is not around a lambda.
    g = texts.select("id", shingle_set(F.col("line"), size).alias("set")).select("id", F.explode_outer("set").alias("g"))
    g = g.select("id", F.expr("shiftleft(1L, cast(g & 63 AS int))").alias("bit"), F.expr("cast(shiftright(g, 6) & 15 AS int)").alias("word"))
    flips = (F.bit_xor(F.when(F.col("word") == i, F.col("bit")).otherwise(F.lit(0).cast("long"))).alias(o) for i, o in enumerate(BITS))
    return g.groupBy("id").agg(F.count(F.lit(1)).alias("size"), *flips)


def find_repeated_lines(docs: DataFrame, cfg: Settings = Settings(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, mark, drop: the sorted numbers of a text's lines that go; only texts that lose any. mark is null where the key has one text."""
    lines = materialize(_lines(docs, cfg, key, text), "lines")
    signed = _signatures(lines, cfg)
    held: list[DataFrame] = []

    def prepare(ids: DataFrame):
        # Lines that share a bucket with another: their texts are what candidates are decided by.
        ids = materialize(ids.select(F.col("id").alias("h1")), "ids")
        texts = semi_join(lines.where("line is not null").select("h1", "h2", "line"), ids, ["h1"], ids.count())
        # A line's id is its first hash. Of lines that share it but not the second, one stands in the links.
        texts = texts.groupBy(F.col("h1").alias("id")).agg(F.min("h2").alias("h2"), F.min_by("line", "h2").alias("line"))
        texts = materialize(texts, "texts")
        facts = materialize(_facts(texts, cfg.shingle), "facts")
        discard(ids)
        held.extend((texts, facts))

        def verify(pairs: DataFrame, thinned: bool) -> DataFrame:
            if not thinned:
                u, v = (facts.select([F.col(c).alias(f"{side}_{c}") for c in facts.columns]).hint("merge") for side in "uv")
                pairs = pairs.join(u, F.col("a") == F.col("u_id")).join(v, F.col("b") == F.col("v_id"))
                pairs = pairs.where(may(lambda c: F.col(f"u_{c}"), lambda c: F.col(f"v_{c}"))).select("a", "b")
            # Only the texts of these pairs are moved: a round of few pairs does not shuffle all candidates' lines.
            pairs = materialize(pairs, "pairs")
            near = only_ids(texts, pairs)
            x = near.select(F.col("id").alias("a"), F.col("line").alias("la"))
            y = near.select(F.col("id").alias("b"), F.col("line").alias("lb"))
            both = pairs.join(x.hint("merge"), "a").join(y.hint("merge"), "b")
            both = both.select("a", "b", shingle_set(F.col("la"), cfg.shingle).alias("sa"), shingle_set(F.col("lb"), cfg.shingle).alias("sb"))
            # Exploded, so that the test stays behind the projection that makes the sets and what they share, once each.
            both = both.select("a", "b", "sa", "sb", F.explode(F.array(F.size(F.array_intersect("sa", "sb")))).alias("c"))
            union = F.size("sa") + F.size("sb") - F.col("c")
            return both.where(F.col("c") * 100 >= union * cfg.threshold_pct).select("a", "b")

        return facts, verify

    may = _may_link(cfg.threshold_pct)
    comp = link_groups(_bands(signed, cfg), prepare, may)
    texts = held[0]
    named = comp.withColumnRenamed("node", "id").join(texts.select("id", "h2").hint("merge"), "id")
    named = materialize(named.select(F.col("id").alias("h1"), "h2", "component"), "named")
    discard(*signed, *held, comp)

    # Groups are components, or else equal lines.
    occ = join_small(lines.select("key", "mark", "pos", "h1", "h2"), named, ["h1", "h2"], named.count())
    other = F.when(F.col("component").isNull(), F.col("h2")).otherwise(F.lit(0))
    occ = occ.select("key", "mark", "pos", F.coalesce("component", "h1").alias("g1"), other.alias("g2"))
    keep = occ.groupBy("g1", "g2").agg(F.min(F.struct("key", "mark", "pos")).alias("keep"), F.count(F.lit(1)).alias("n"))
    # Stored, so that the join with it can split a hot line.
    keep = materialize(keep.where("n > 1").select("g1", "g2", "keep"), "keep")
    kept = F.col("key").eqNullSafe(F.col("keep.key")) & F.col("mark").eqNullSafe(F.col("keep.mark")) & (F.col("pos") == F.col("keep.pos"))
    gone = occ.join(keep.hint("merge"), ["g1", "g2"]).where(~kept)
    out = gone.groupBy(F.col("key").alias(key), "mark").agg(F.sort_array(F.collect_set("pos")).alias("drop"))
    out = materialize(out, "dropped")
    discard(lines, named, keep)
    return out


def drop_lines(docs: DataFrame, dropped: DataFrame, key: str = "doc_id", text: str = "text", n_removed: str | None = None) -> DataFrame:
    """docs without the dropped lines, all columns and rows kept; n_removed names a column for their number."""
    if n_removed in docs.columns:
        raise ValueError(f"there is a column {n_removed} already")
    size = dropped.agg(F.coalesce(F.sum(F.size("drop") + 1), F.lit(0))).first()[0]
    # Clashing names: the list, and what it is joined by, travel under names that no column has.
    name = "_drop"
    while any(c.startswith(name) for c in docs.columns):
        name += "_"
    gone = dropped.select(F.col(key).alias(f"{name}key"), F.col("mark").alias(f"{name}mark"), F.col("drop").alias(name))
    same = F.col(key).eqNullSafe(F.col(f"{name}key")) & (F.col(f"{name}mark").isNull() | (F.col(f"{name}mark") == F.xxhash64(text)))
    joined = docs.join(F.broadcast(gone) if size <= BROADCAST_KEYS else gone.hint("merge"), same, "left")
    # A mark for each line up to the last that goes: false for those between two that go, true for these.
    between = lambda p, i: p - F.coalesce(F.get(name, i - 1), F.lit(-1)) - 1
    marks = F.flatten(F.transform(name, lambda p, i: F.concat(F.array_repeat(F.lit(False), between(p, i)), F.array(F.lit(True)))))
    kept = F.array_compact(F.zip_with(F.split(text, "\n"), marks, lambda x, m: F.when(F.coalesce(m, F.lit(False)), F.lit(None)).otherwise(x)))
    cleaned = F.when(F.col(name).isNull(), F.col(text)).otherwise(F.array_join(kept, "\n"))
    cols = [cleaned.alias(c) if c == text else F.col(c) for c in docs.columns]
    return joined.select(*cols, *([F.coalesce(F.size(name), F.lit(0)).alias(n_removed)] if n_removed else []))


def dedup_lines(docs: DataFrame, cfg: Settings = Settings(), key: str = "doc_id", text: str = "text", n_removed: str | None = None) -> DataFrame:
    return drop_lines(docs, find_repeated_lines(docs, cfg, key, text), key, text, n_removed)
