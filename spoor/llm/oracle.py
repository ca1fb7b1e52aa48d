"""DuckDB SQL for the queries of this folder that SQL can express."""

from __future__ import annotations

from spoor.llm.quality import LIMITS, LINE_LIMIT, MIN_WORDS
from spoor.llm.repeats import WINDOW


def _gram(n: int) -> str:
    """Words inside an n-gram that the text has twice, and inside one that it has had before."""
    gram = " || ' ' || ".join(["w", *(f"lead(w, {k}) OVER o" for k in range(1, n))])
    return f"""
gram_{n} AS (
  SELECT doc_id, i, w, {gram} AS g FROM tokens WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
seen_{n} AS (
  SELECT doc_id, i, w, g IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, g) > 1 AS twice,
         g IS NOT NULL AND row_number() OVER (PARTITION BY doc_id, g ORDER BY i) > 1 AS again
  FROM gram_{n}),
cover_{n} AS (
  SELECT doc_id, count(*) FILTER (WHERE twice) AS words,
         coalesce(sum(length(w)) FILTER (WHERE again), 0) AS chars
  FROM (SELECT doc_id, w, max(twice) OVER o AS twice, max(again) OVER o AS again FROM seen_{n}
        WINDOW o AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW))
  GROUP BY doc_id)"""


QUALITY = rf"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
words AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM texts),
tokens AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM words),
lines AS (
  SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id, line) AS k
  FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM texts)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
dups AS (
  SELECT doc_id, count(*) FILTER (WHERE k > 1) AS n,
         coalesce(sum(length(line)) FILTER (WHERE k > 1), 0) AS dup, sum(length(line)) AS chars
  FROM lines GROUP BY doc_id),
{", ".join(_gram(n).strip() for n in (3, *LIMITS))},
found AS (
  SELECT w.doc_id, len(ws) AS n_words,
         CAST(coalesce(list_sum([length(x) FOR x IN ws]), 0) AS BIGINT) AS word_chars,
         length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         coalesce(d.n, 0) AS n_dup_lines, coalesce(c3.words, 0) AS n_repeat_words,
         coalesce(d.dup / d.chars, 0) > {LINE_LIMIT}
         {" ".join(f"OR coalesce(c{n}.chars, 0) > {limit} * word_chars" for n, limit in LIMITS.items())} AS bad
  FROM words w LEFT JOIN dups d USING (doc_id)
  {" ".join(f"LEFT JOIN cover_{n} c{n} USING (doc_id)" for n in (3, *LIMITS))})
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words OR bad) AS kept
FROM found"""

REPEATS = f"""
WITH d AS (
  SELECT doc_id, encode(coalesce(text, '')) AS b, octet_length(encode(coalesce(text, ''))) AS n
  FROM documents),
w AS (
  SELECT doc_id, i, md5(b[i + 1 : i + {WINDOW}]) AS s
  FROM (SELECT doc_id, b, unnest(range(n - {WINDOW - 1})) AS i FROM d)),
f AS (SELECT s, min(doc_id) AS first FROM w GROUP BY s),
hit AS (
  SELECT w.doc_id, w.i, lag(w.i) OVER (PARTITION BY w.doc_id ORDER BY w.i) AS before
  FROM w JOIN f USING (s) WHERE f.first < w.doc_id),
run AS (
  SELECT doc_id, i, count(*) FILTER (WHERE before IS NULL OR i > before + {WINDOW}) OVER (
           PARTITION BY doc_id ORDER BY i) AS k FROM hit),
span AS (SELECT doc_id, k, min(i) AS a, max(i) + {WINDOW} AS e FROM run GROUP BY ALL),
gap AS (SELECT *, lag(e, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS from_ FROM span),
r AS (
  SELECT doc_id, sum(e - a) AS n_removed, count(*) AS n_spans, max(e) AS last,
         string_agg(hex(b[from_ + 1 : a]), '' ORDER BY a) AS kept
  FROM gap JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, CAST(d.n AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(kept || hex(b[last + 1 :]), hex(b)))) AS kept_sha256
FROM d LEFT JOIN r USING (doc_id)"""

def _field(value: str) -> str:
    return f"CASE WHEN {value} IS NULL THEN '-' ELSE strlen({value}::VARCHAR) || ':' || {value}::VARCHAR END"


def _leaf(n_chars: str) -> str:
    fields = ("doc_id", "source", "lang", n_chars, "text")
    return "sha256(" + " || ".join(_field(f) for f in fields) + ")"


def _levels(name: str, leaves: str) -> str:
    """Nodes of all levels, and the siblings of the leaves."""
    return f"""
{name} AS (
  SELECT g, 0 AS l, i, n, h FROM {leaves}
  UNION ALL
  SELECT g, l + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM {name}
  WHERE n > 1 GROUP BY g, l, i // 2, n),
{name}_steps AS (
  SELECT d.id, v.l, (d.i >> v.l) % 2 = 1 AS is_left, s.h
  FROM {leaves} d JOIN (SELECT DISTINCT g, l FROM {name} WHERE n > 1) v USING (g)
  LEFT JOIN {name} s ON s.g = d.g AND s.l = v.l AND s.i = xor(d.i >> v.l, 1))"""


# CRC-32 of the decimal id, bit by bit.
_BITS = (
    "[((ord(t[1 + j // 8]) >> (j % 8)) & 1)::UBIGINT FOR j IN range(8 * length(t))]"
)
_CRC = f"""xor(4294967295, list_reduce(list_concat([4294967295::UBIGINT], {_BITS}),
    lambda c, b: xor(c >> 1, CASE WHEN xor(c, b) % 2 = 1 THEN 3988292384::UBIGINT ELSE 0::UBIGINT END)))"""

MANIFEST = f"""
WITH RECURSIVE marked AS (
  SELECT *, doc_id::VARCHAR AS t, coalesce('=' || lang, '') AS g, {_leaf("n_chars")} AS h,
         {_leaf("(n_chars + 1)")} AS more
  FROM documents),
leaves AS (
  SELECT doc_id, g, h, row_number() OVER (ORDER BY g, doc_id NULLS FIRST, h) AS id,
         row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, h) - 1 AS i,
         count(*) OVER (PARTITION BY g) AS n,
         CASE WHEN n_chars IS NOT NULL AND {_CRC} % 7 = 0 THEN more ELSE h END AS offered
  FROM marked),
{_levels("tree", "leaves").strip()},
subroots AS (
  SELECT g AS id, '' AS g, h, row_number() OVER (ORDER BY g) - 1 AS i, count(*) OVER () AS n
  FROM tree WHERE n = 1),
{_levels("top", "subroots").strip()},
steps AS (
  SELECT id, l, is_left, h, row_number() OVER (PARTITION BY id ORDER BY l) AS k FROM (
    SELECT id, l, is_left, h FROM tree_steps
    UNION ALL
    SELECT leaves.id, 1000 + l, is_left, s.h
    FROM leaves JOIN top_steps s ON s.id = leaves.g)),
folded AS (
  SELECT id, 0 AS k, offered AS h FROM leaves
  UNION ALL
  SELECT id, f.k + 1, sha256(CASE WHEN s.h IS NULL THEN f.h WHEN is_left THEN s.h || f.h
                             ELSE f.h || s.h END)
  FROM folded f JOIN steps s USING (id) WHERE s.k = f.k + 1),
ends AS (SELECT id, arg_max(h, k) AS folded_root FROM folded GROUP BY id),
proofs AS (SELECT id, string_agg(h, '' ORDER BY k) AS siblings FROM steps GROUP BY id)
SELECT doc_id, leaves.h AS leaf, s.h AS subroot, t.h AS root,
       sha256(coalesce(siblings, '')) AS proof_sha256, folded_root, folded_root = t.h AS verified
FROM leaves JOIN subroots s ON s.id = leaves.g JOIN ends ON ends.id = leaves.id
LEFT JOIN proofs ON proofs.id = leaves.id CROSS JOIN (SELECT h FROM top WHERE n = 1) t"""

_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

RANKED = f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, unnest({_TERMS}) AS t FROM documents),
tfs AS (SELECT r, doc_id, t, count(*) AS tf FROM docs GROUP BY ALL),
lengths AS (SELECT r, sum(tf)::BIGINT AS n FROM tfs GROUP BY r),
totals AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_terms FROM lengths),
weights AS (
  SELECT t, floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1)))::BIGINT AS w
  FROM tfs, totals GROUP BY t, n_docs),
asked AS (
  SELECT q, item_id, t, count(*) AS times
  FROM (SELECT row_number() OVER () AS q, item_id, unnest({_TERMS}) AS t FROM benchmark)
  GROUP BY ALL),
scores AS (
  SELECT q, item_id, r, doc_id, sum(
    w * times * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + ((25 * n * n_docs) // n_terms))))
  )::BIGINT AS score
  FROM asked JOIN tfs USING (t) JOIN weights USING (t) JOIN lengths USING (r), totals
  GROUP BY ALL),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) AS rank
  FROM scores WHERE score > 0)
SELECT item_id, rank::INT AS rank, doc_id, score FROM ranked WHERE rank <= 20"""

CAPS = """
WITH RECURSIVE v AS (
  SELECT row_number() OVER () AS r, vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
good AS (
  SELECT * FROM v WHERE label IS NOT NULL AND len(e) > 0 AND list_bool_and([x IS NOT NULL AND isfinite(x) FOR x IN e])
  AND list_bool_or([x <> 0 FOR x IN e])),
pairs AS (
  SELECT a.r AS a, b.r AS b FROM good a JOIN good b ON a.label = b.label AND len(a.e) = len(b.e)
  WHERE a.r <> b.r AND list_cosine_similarity(a.e, b.e) >= 0.93),
reach AS (
  SELECT r, r AS s FROM v
  UNION
  SELECT reach.r, pairs.b FROM reach JOIN pairs ON pairs.a = reach.s),
least AS (SELECT reach.r, min(v.vec_id) AS id FROM reach JOIN v ON v.r = reach.s GROUP BY reach.r),
links AS (SELECT a AS r, count(*) AS n FROM pairs GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, id AS component_id, vec_id IS NOT DISTINCT FROM id AS kept
FROM v JOIN least USING (r) LEFT JOIN links USING (r)"""

ORACLE = {
    "op8_quality": QUALITY,
    "op10_repeats": REPEATS,
    "op11_ranked": RANKED,
    "op12_manifest": MANIFEST,
    "op13_caps": CAPS,
}
