"""DuckDB SQL that gives the rows of those queries that SQL can express."""

from __future__ import annotations

from evalframe.llm.license_scan import TEMPLATES, split
from evalframe.llm.quality_rules import Limits

_WORD = r"[^\x20\x09-\x0D]+"


def quality_rules(limits: Limits = Limits()) -> str:
    tests = [(r, c) for r in limits.rules for c in r.cutoffs]
    hit = lambda r, c: f"{r.part} * 100 > {c} * {r.whole}"
    level = f"{limits.level} / ((SELECT count(*) FROM seen) * {len(tests)})"

    def admitted(r, c):
        k = f"k_{r.name}_{c}"
        cdf = (
            f"list_sum(list_transform(range(0, {k} + 1), lambda i: exp(lgamma(n_good + 1) - lgamma(i + 1) - lgamma(n_good - i + 1)"
            f" + i * ln({limits.risk}) + (n_good - i) * ln(1 - {limits.risk}))))"
        )
        return f"CASE WHEN {k} < n_good * {limits.risk} AND {cdf} <= {level} THEN {c} END"

    cuts = ", ".join(f"least({', '.join(admitted(r, c) for c in r.cutoffs)}) AS cut_{r.name}" for r in limits.rules)
    counts = ", ".join(f"count(*) FILTER (WHERE {hit(r, c)}) AS k_{r.name}_{c}" for r, c in tests)
    fails = " OR ".join(f"coalesce({r.part} * 100 > cut_{r.name} * {r.whole}, false)" for r in limits.rules)
    return rf"""
WITH w AS (
  SELECT doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '{_WORD}') AS ws FROM documents
), win AS (
  SELECT doc_id, i, array_to_string(ws[i:i + 7], ' ') AS g FROM w, LATERAL (SELECT unnest(range(1, len(ws) - 6)) AS i)
), rep AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM win) WHERE n > 1
), cov AS (
  SELECT doc_id, sum(least(8, coalesce(nx - i, 8))) AS n
  FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nx FROM rep) GROUP BY doc_id
), c AS (
  SELECT doc_id, stratum, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls,
         coalesce(cov.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN cov USING (doc_id)
), counts AS (
  SELECT *, len(ls)::BIGINT AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
         (n_words < {limits.min_words} OR n_repeat_words * 100 > n_words * {limits.max_repeat_pct}) AS base_failed FROM c
), seen AS (
  SELECT stratum, count(*) AS n_good, {counts} FROM counts
  WHERE NOT base_failed AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) GROUP BY stratum
), cuts AS (SELECT stratum, {cuts} FROM seen)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT ({fails}) AS kept
FROM counts LEFT JOIN cuts USING (stratum)"""


NGRAM_JACCARD = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') AS ws
  FROM documents
), g AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + 3], ' ') AS s
  FROM w, LATERAL (SELECT unnest(range(1, greatest(2, len(ws) - 2))) AS i) WHERE len(ws) > 0
), n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id
), l AS (
  SELECT x.doc_id AS a, y.doc_id AS b FROM g x JOIN g y ON x.s = y.s AND x.doc_id <> y.doc_id
  JOIN n nx ON nx.doc_id = x.doc_id JOIN n ny ON ny.doc_id = y.doc_id
  GROUP BY x.doc_id, y.doc_id HAVING 100 * count(*) >= 85 * (any_value(nx.n) + any_value(ny.n) - count(*))
), r AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(c.c, d.doc_id) AS component_id
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a AS doc_id, min(b) AS c FROM r GROUP BY a) c USING (doc_id)"""

SUBSTRING_DEDUP = rf"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS ws FROM documents
), win AS (
  SELECT doc_id, i, array_to_string(ws[i:i + 49], ' ') AS g FROM w, LATERAL (SELECT unnest(range(1, len(ws) - 48)) AS i)
), gone AS (
  SELECT DISTINCT doc_id, i + k AS p
  FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY g) AS f FROM win), range(50) AS t(k) WHERE doc_id > f
), word AS (SELECT doc_id, unnest(ws) AS x, unnest(range(1, len(ws) + 1)) AS p FROM w
), kept AS (
  SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS s, count(*) AS n FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id
)
SELECT doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(kept.n, 0))::BIGINT AS n_removed,
       sha256(coalesce(kept.s, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)"""

_ITEM_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

DECONTAMINATE = rf"""
WITH d AS (SELECT doc_id, {_ITEM_WORDS} AS ws FROM documents
), b AS (SELECT item_id, {_ITEM_WORDS} AS ws FROM benchmark
), iw AS (
  SELECT DISTINCT item_id, least(10, len(ws)) AS size, array_to_string(ws[i:i + least(10, len(ws)) - 1], ' ') AS g
  FROM b, LATERAL (SELECT unnest(range(1, len(ws) - least(10, len(ws)) + 2)) AS i) WHERE len(ws) > 0
), dw AS (
  SELECT doc_id, i, size, array_to_string(ws[i:i + size - 1], ' ') AS g
  FROM d, (SELECT DISTINCT size FROM iw), LATERAL (SELECT unnest(range(1, len(ws) - size + 2)) AS i)
), m AS (SELECT doc_id, i, size, item_id FROM dw JOIN iw USING (size, g)
), hit AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM m, range(10) AS t(k) WHERE k < size GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n, string_agg(s, ',' ORDER BY s) AS s
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM m) GROUP BY doc_id
)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(hit.n, 0)::BIGINT AS n_hit, coalesce(items.n, 0)::BIGINT AS n_items,
       sha256(coalesce(items.s, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)"""

_B32 = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'"
#: Base32 of a 40-digit hexadecimal text: eight times 20 bits, each as four letters.
_BASE32 = f"""array_to_string(list_transform(range(0, 8), lambda k: array_to_string(list_transform([15, 10, 5, 0],
  lambda s: substr({_B32}, (((('0x' || substr(h, k * 5 + 1, 5))::BIGINT >> s) & 31) + 1)::INTEGER, 1)), '')), '')"""

WARC = f"""
WITH p AS (SELECT page_id, url, coalesce(html, '') AS t, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT page_id, url, octet_length(encode(t)) AS n, {_BASE32} AS digest, min(page_id) OVER (PARTITION BY t) AS first FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, digest AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to, 3::INT AS n_records, 'GET' AS request_method,
       '/' || regexp_extract(regexp_replace(coalesce(url, ''), '^[a-zA-Z]+://', ''), '^[^/]*/(.*)$', 1) AS request_path
FROM f"""


def _rows(rows: list[tuple]) -> str:
    told = lambda v: "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)
    return ", ".join("(" + ", ".join(map(told, r)) + ")" for r in rows)


def license_scan() -> str:
    """Every template's words at every relative position, without an index."""
    names = [(k, t.label, t.base, len(t.words), t.need, len(t.phrases)) for k, t in enumerate(TEMPLATES)]
    words = [(k, q, w.decode()) for k, t in enumerate(TEMPLATES) for q, w in enumerate(t.words)]
    phrases = [(k, i, j, len(split(p.encode())), w.decode()) for k, t in enumerate(TEMPLATES) for i, p in enumerate(t.phrases) for j, w in enumerate(split(p.encode()))]
    return rf"""
WITH d AS (SELECT doc_id, {_ITEM_WORDS} AS ws FROM documents
), t(k, label, base, size, need, n_phrases) AS (VALUES {_rows(names)}
), tw(k, q, x) AS (VALUES {_rows(words)}
), tp(k, i, j, size, x) AS (VALUES {_rows(phrases)}
), w AS (SELECT doc_id, unnest(ws) AS x, unnest(range(0, len(ws))) AS p FROM d
), a AS (
  SELECT doc_id, k, p - q AS start, count(*) AS same FROM w JOIN tw USING (x) JOIN t USING (k)
  GROUP BY doc_id, k, p - q HAVING count(*) >= any_value(need)
), f AS (SELECT doc_id, k, i, p - j AS start, any_value(size) AS size FROM w JOIN tp USING (x) GROUP BY doc_id, k, i, p - j HAVING count(*) = any_value(size)
), ok AS (
  SELECT a.doc_id, a.k, a.start, any_value(a.same / t.size) AS coverage
  FROM a JOIN t ON t.k = a.k JOIN f ON f.doc_id = a.doc_id AND f.k = a.k AND f.start >= a.start AND f.start + f.size <= a.start + t.size
  GROUP BY a.doc_id, a.k, a.start HAVING count(DISTINCT f.i) = any_value(t.n_phrases)
), s AS (
  SELECT doc_id, count(*) FILTER (WHERE base) AS n_base, min(start) FILTER (WHERE base) AS first_word, max(start) FILTER (WHERE base) AS last_word,
         string_agg(DISTINCT CASE WHEN base THEN label END, ',' ORDER BY CASE WHEN base THEN label END) AS base_labels,
         string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(coverage) AS score
  FROM ok JOIN t USING (k) GROUP BY doc_id
)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score
FROM d LEFT JOIN s USING (doc_id)"""


LEXICAL_SEARCH = rf"""
WITH d AS (SELECT doc_id, {_ITEM_WORDS} AS ws FROM documents
), it AS (SELECT item_id, x, count(*) AS times FROM (SELECT item_id, unnest({_ITEM_WORDS}) AS x FROM benchmark) GROUP BY item_id, x
), c AS (SELECT count(*) AS n, sum(len(ws)) AS l FROM d WHERE len(ws) > 0
), tf AS (SELECT doc_id, x, count(*) AS tf FROM (SELECT doc_id, unnest(ws) AS x FROM d) GROUP BY doc_id, x
), w AS (
  SELECT x, floor(1000 * ln(CAST(2 * any_value(n) + 2 AS DOUBLE) / (2 * count(*) + 1)))::BIGINT AS w FROM tf, c GROUP BY x
), m AS (SELECT doc_id, 100 - 75 + CAST((75 * len(ws) * n) // l AS BIGINT) AS m FROM d, c WHERE len(ws) > 0
), s AS (
  SELECT item_id, doc_id, CAST(sum(times * w * CAST((1000000000 * tf) // (1000 * tf + 8 * m) AS BIGINT)) AS BIGINT) AS score
  FROM it JOIN tf USING (x) JOIN w USING (x) JOIN m USING (doc_id) GROUP BY item_id, doc_id
), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10"""
