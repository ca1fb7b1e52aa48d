"""The SQL counterpart of every query that SQL can express."""

from __future__ import annotations

SPLIT = "TIMESTAMP '2024-01-16'"
DIM = 32

# ------------------------------------------------ shared pieces

FLOWS = """
flows AS (
  SELECT CAST(user_id AS VARCHAR) AS entity, ts,
         event_type || ' k:' || json_extract_string(props, '$.k') AS line
  FROM events)"""

SETS = f"""{FLOWS},
r AS (SELECT DISTINCT entity AS device, line FROM flows WHERE ts < {SPLIT}),
q AS (SELECT DISTINCT entity AS query, line FROM flows WHERE ts >= {SPLIT})"""

OVERLAP = f"""{SETS},
rs AS (SELECT device, count(*) AS n_r FROM r GROUP BY device),
qs AS (SELECT query, count(*) AS n_q FROM q GROUP BY query),
found AS (SELECT query, device, count(*) AS h FROM q JOIN r USING (line) GROUP BY ALL),
pairs AS (
  SELECT query, device, n_q, n_r, coalesce(h, 0) AS hit_count
  FROM qs CROSS JOIN rs LEFT JOIN found USING (query, device)),
scored AS (
  SELECT query, device, hit_count,
         CAST(hit_count AS DOUBLE) / (n_q + n_r - hit_count) AS jaccard,
         CAST(hit_count AS DOUBLE) AS exact_hit_count
  FROM pairs)"""


def _overlap_ranked(method: str) -> str:
    return f"""{OVERLAP},
ranked AS (
  SELECT query, device, {method} AS score, hit_count,
         row_number() OVER (PARTITION BY query ORDER BY {method} DESC, device) AS rank
  FROM scored),
expected AS (
  SELECT qs.query, qs.query AS expected, score, rank
  FROM qs LEFT JOIN ranked ON ranked.query = qs.query AND ranked.device = qs.query)"""


def _overlap_top(method: str) -> str:
    return f"""WITH {_overlap_ranked(method)}
SELECT query, device, round(score, 6) AS score, hit_count, rank FROM ranked WHERE rank <= 5"""


def _overlap_rank(method: str) -> str:
    return f"""WITH {_overlap_ranked(method)}
SELECT query, expected, round(score, 6) AS score, rank FROM expected"""


METRICS = """count(*) AS queries,
  round(avg(CASE WHEN rank = 1 THEN 1.0 ELSE 0.0 END), 6) AS top1,
  round(avg(CASE WHEN rank <= 5 THEN 1.0 ELSE 0.0 END), 6) AS topk,
  round(coalesce(avg(1.0 / rank), 0.0), 6) AS mrr,
  round(coalesce(avg(rank), 0.0), 6) AS mean_rank"""


def _overlap_metrics(method: str) -> str:
    return f"WITH {_overlap_ranked(method)}\nSELECT {METRICS} FROM expected"


BLANKS = r"' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160)"

LINES = f"""
split AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS raw,
         unnest(range(len(string_split(text, chr(10))))) AS pos
  FROM documents),
lines AS (SELECT doc_id, pos, trim(raw, {BLANKS}) AS line FROM split
          WHERE trim(raw, {BLANKS}) <> '')"""

DISTINCT_LINES = f"""{LINES},
firsts AS (SELECT doc_id, min(pos) AS pos, line FROM lines GROUP BY doc_id, line)"""

REDUCTION = f"""{DISTINCT_LINES},
after AS (SELECT doc_id, sum(length(line)) + count(*) - 1 AS n FROM firsts GROUP BY doc_id),
sizes AS (
  SELECT d.doc_id, length(d.text) AS original_size,
         CAST(coalesce(a.n, 0) AS BIGINT) AS flattened_size
  FROM documents d LEFT JOIN after a USING (doc_id))"""


def _percent(before: str, after: str) -> str:
    return (
        f"CASE WHEN {before} = 0 THEN 0.0 ELSE"
        f" round((1.0 - CAST({after} AS DOUBLE) / CAST({before} AS DOUBLE)) * 100, 2) END"
    )


# One row per expected line of the documents built from events.
RENDERED = """
ev AS (
  SELECT event_id AS doc_id, event_type, value, json_extract_string(props, '$.k') AS k
  FROM events),
tail AS (
  SELECT *, CASE event_type
    WHEN 'signup' THEN 'controller:' || (CASE WHEN CAST(k AS INT) % 2 = 0 THEN 'dns'
         ELSE 'gateway' END) || ' ipv4 udp dst-port:' || k
    WHEN 'click' THEN 'local eth:0x0800 mac:00:00:00:00:00:' || k ||
         ' ipv4 tcp (direction-initiated:from-device) dst:h' || k || '.example dst-port:443'
    WHEN 'view' THEN 'ipv6 icmpv6 src:fe80::' || k || '/64'
    WHEN 'purchase' THEN 'ipv4 igmp dst:224.0.0.' || k || '/32'
    WHEN 'error' THEN 'ipv4 tcp (direction-initiated:to-device) src:10.1.0.' || k ||
         '/32 ipv6 udp (direction-initiated:to-device) src-port:' || k
    END AS text
  FROM ev WHERE NOT value > 100),
rendered AS (
  SELECT doc_id, 0 AS acl_pos, 1 AS ace_pos, 'egress ' || text AS line FROM tail
  UNION ALL SELECT doc_id, 0, 2, 'egress ' || text FROM tail
  UNION ALL SELECT doc_id, 1, 0, 'ingress ipv4 1' FROM tail
  UNION ALL SELECT doc_id, 1, 1, 'ingress' FROM tail
  UNION ALL SELECT doc_id, 3, 0, 'eth:None' FROM tail),
compacted AS (
  SELECT doc_id, min(acl_pos) AS acl_pos, arg_min(ace_pos, acl_pos * 1000 + ace_pos) AS ace_pos,
         line
  FROM rendered GROUP BY doc_id, line)"""

# Characters of a document: the fixed frame plus the block of matches, twice.
MATCH_LENGTH = """CASE event_type
    WHEN 'signup' THEN length('{"ietf-mud:mud":{"controller":"urn:x:' ||
      (CASE WHEN CAST(k AS INT) % 2 = 0 THEN 'dns' ELSE 'gateway' END) ||
      '"},"ipv4":{"protocol":17},"udp":{"destination-port":{"operator":"eq","port":' || k || '}}}')
    WHEN 'click' THEN length('{"ietf-mud:mud":{"local-networks":[null],"controller":""},' ||
      '"eth":{"ethertype":"0x0800","destination-mac-address":"00:00:00:00:00:' || k || '"},' ||
      '"ipv4":{"protocol":6,"ietf-acldns:dst-dnsname":"h' || k || '.example",' ||
      '"destination-ipv4-network":"10.0.0.' || k || '/32"},' ||
      '"tcp":{"ietf-mud:direction-initiated":"from-device",' ||
      '"source-port":{"operator":"range","lower-port":1,"upper-port":' || k || '},' ||
      '"destination-port":{"operator":"eq","port":443}}}')
    WHEN 'view' THEN length('{"ipv6":{"protocol":58,"source-ipv6-network":"fe80::' || k ||
      '/64"},"ipv4":{},"icmp":{"type":8}}')
    WHEN 'purchase' THEN length(
      '{"ipv4":{"protocol":2,"destination-ipv4-network":"224.0.0.' || k || '/32"}}')
    WHEN 'error' THEN length('{"ipv4":{"protocol":"6","ietf-acldns:src-dnsname":"",' ||
      '"source-ipv4-network":"10.1.0.' || k || '/32"},"ipv6":{"protocol":17},' ||
      '"tcp":{"ietf-mud:direction-initiated":"to-device",' ||
      '"source-port":{"operator":"eq","port":' || k || '}},' ||
      '"udp":{"ietf-mud:direction-initiated":"to-device"}}')
    END"""
FRAME_LENGTH = """(length('{"ietf-access-control-list:access-lists":{"acl":[{"name":"from-x","aces":{"ace":[')
    + length('"no object",{"matches":') + length('},{"matches":')
    + length('}]}},{"name":"to-x","aces":{"ace":[{"matches":{"ipv4":{"protocol":1}}},')
    + length('{"matches":{}}]}},')
    + length('{"aces":null},{"aces":{"ace":[{"matches":{"eth":{"ethertype":null}}}]}}]}}'))"""

# ------------------------------------------------ labels

VARIANT = """source || (['', '_compact', '_test_3', '_loo_1_compact', '_family_x_test_2',
  '_ipbits24', '_ipbits8_family_y', '_compact_v2'])[doc_id % 8 + 1]"""


def _clean(name: str) -> str:
    base = f"(CASE WHEN ends_with({name}, '_compact') THEN {name}[:-9] ELSE {name} END)"
    cuts = " ".join(
        f"WHEN contains({base}, '{m}') THEN string_split({base}, '{m}')[1]"
        for m in ("_test_", "_loo_", "_family_", "_ipbits")
    )
    return f"(CASE {cuts} ELSE {base} END)"


# ------------------------------------------------ vectors

BANK = """
raw_bank AS (
  SELECT CAST(label AS VARCHAR) AS device, vec_id AS row_id,
         'rule ' || CAST(vec_id % 97 AS VARCHAR) AS text,
         [CAST(x AS DOUBLE) FOR x IN embedding] AS v
  FROM embeddings),
bank AS (
  SELECT device, row_id, text,
         [x / (CASE WHEN n = 0 THEN 1.0 ELSE n END) FOR x IN v] AS v
  FROM (SELECT *, sqrt(list_dot_product(v, v)) AS n FROM raw_bank))"""

VARIANTS = f"""{BANK},
queries AS (
  SELECT CAST((CAST(device AS INT) + 1) % 10 AS VARCHAR) || '_test_' ||
         CAST(row_id % 7 AS VARCHAR) AS query,
         CAST((CAST(device AS INT) + 1) % 10 AS VARCHAR) AS expected, row_id, v
  FROM bank)"""

MAXSIM = f"""{VARIANTS},
best AS (
  SELECT q.query, q.row_id, r.device, max(list_dot_product(q.v, r.v)) AS s
  FROM queries q CROSS JOIN bank r GROUP BY ALL),
scored AS (SELECT query, device, avg(s) AS score FROM best GROUP BY ALL),
owners AS (SELECT DISTINCT query, expected FROM queries)"""


def _pooled(source: str, vector: str, *keys: str) -> str:
    """Mean per dimension of a vector column, not scaled."""
    names = ", ".join(keys)
    return f"""(
  SELECT {names}, list(m ORDER BY dim) AS v FROM (
    SELECT {names}, dim, avg(x) AS m FROM (
      SELECT {names}, unnest({vector}) AS x, unnest(range(len({vector}))) AS dim FROM {source})
    GROUP BY ALL)
  GROUP BY {names})"""


COSINE = """CASE WHEN sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b})) = 0
  THEN 0.0 ELSE list_dot_product({a}, {b}) /
  (sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b}))) END"""

# The plain mean pools the vectors as they are, the episodes pool unit vectors.
POOLED = f"""{VARIANTS},
raw_queries AS (
  SELECT q.query, q.expected, b.v FROM queries q JOIN raw_bank b USING (row_id)),
qm AS {_pooled("raw_queries", "v", "query", "expected")},
rm AS {_pooled("raw_bank", "v", "device")},
scored AS (
  SELECT qm.query, rm.device, {COSINE.format(a="qm.v", b="rm.v")} AS score
  FROM qm CROSS JOIN rm),
owners AS (SELECT DISTINCT query, expected FROM queries)"""

RANKED = """
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, device) AS rank
  FROM scored),
expected_ranks AS (
  SELECT o.query, o.expected, k.score, k.rank
  FROM owners o LEFT JOIN ranked k ON k.query = o.query AND k.device = o.expected)"""


def _top(pieces: str) -> str:
    return f"""WITH {pieces}, {RANKED}
SELECT query, device, round(score, 6) AS score, rank FROM ranked WHERE rank <= 5"""


def _rank(pieces: str) -> str:
    return f"""WITH {pieces}, {RANKED}
SELECT query, expected, round(score, 6) AS score, rank FROM expected_ranks"""


def _bag(source: str) -> str:
    """``(text, v)``: hashed bag of tokens of each distinct ``text``, unit length, as float."""
    return f"""
texts AS (SELECT DISTINCT text FROM {source}),
tokens AS (
  SELECT text, unnest(string_split_regex(text, '\\s+')) AS token FROM texts),
counted AS (
  SELECT text, CAST('0x' || substr(md5(token), 1, 8) AS BIGINT) % {DIM} AS dim, count(*) AS n
  FROM tokens WHERE token <> '' GROUP BY ALL),
bags AS (
  SELECT text, dim, CAST(n / sqrt(sum(n * n) OVER (PARTITION BY text)) AS FLOAT) AS value
  FROM counted)"""


SEMANTIC = f"""{SETS},
rules AS (SELECT DISTINCT line AS text FROM flows), {_bag("rules")},
raw_sims AS (
  SELECT a.text AS x, b.text AS y, sum(CAST(a.value AS DOUBLE) * CAST(b.value AS DOUBLE)) AS s
  FROM bags a JOIN bags b USING (dim) GROUP BY ALL),
sims AS (
  SELECT x, y, s / (sqrt(nx.n) * sqrt(ny.n)) AS s FROM raw_sims
  JOIN (SELECT x AS text, s AS n FROM raw_sims WHERE x = y) nx ON nx.text = x
  JOIN (SELECT x AS text, s AS n FROM raw_sims WHERE x = y) ny ON ny.text = y),
best AS (
  SELECT t.text AS line, r.device, max(coalesce(s.s, 0.0)) AS s
  FROM rules t CROSS JOIN r LEFT JOIN sims s ON s.x = t.text AND s.y = r.line GROUP BY ALL),
scored AS (
  SELECT q.query, best.device, avg(best.s) AS score FROM q JOIN best USING (line) GROUP BY ALL),
owners AS (SELECT DISTINCT query, query AS expected FROM q)"""


# ------------------------------------------------ episodes


def _episodes(mode: str) -> str:
    kept, size = (0, 3) if mode == "strict-unseen" else (2, 4)
    return f"""{BANK},
firsts AS (SELECT device, text, min(row_id) AS row_id FROM bank GROUP BY ALL),
drawn AS (
  SELECT f.*, e.n AS episode, count(*) OVER (PARTITION BY device, e.n) AS texts,
         row_number() OVER (PARTITION BY device, e.n ORDER BY
           md5(concat_ws('|', '1729', device, CAST(e.n AS VARCHAR), text)), text) - 1 AS pos
  FROM firsts f CROSS JOIN (SELECT unnest(range(5)) AS n) e),
episodes AS (
  SELECT device || '/{mode}/' || lpad(CAST(episode AS VARCHAR), 3, '0') AS episode_id,
         '{mode}' AS mode, device AS expected, pos,
         CASE WHEN pos < {kept} THEN 'exact' ELSE 'unseen' END AS role, text, row_id
  FROM drawn WHERE texts > {size} AND pos < {size})"""


def _episode_scores(mode: str) -> str:
    return f"""{_episodes(mode)},
ids AS (SELECT DISTINCT episode_id, expected FROM episodes),
devices AS (SELECT DISTINCT device FROM bank),
kept AS (
  SELECT i.episode_id, b.device, b.row_id, b.text, b.v
  FROM ids i CROSS JOIN bank b
  WHERE NOT EXISTS (SELECT 1 FROM episodes e WHERE e.episode_id = i.episode_id
                    AND e.role = 'unseen' AND e.text = b.text)),
qrows AS (SELECT e.episode_id, e.row_id, e.text, b.v FROM episodes e
          JOIN bank b USING (row_id)),
pairs AS (SELECT episode_id, device FROM ids CROSS JOIN devices),
best AS (
  SELECT q.episode_id, q.row_id, k.device, max(list_dot_product(q.v, k.v)) AS s
  FROM qrows q JOIN kept k USING (episode_id) GROUP BY ALL),
maxsim AS (SELECT episode_id, device, avg(s) AS score FROM best GROUP BY ALL),
kept_texts AS (SELECT DISTINCT episode_id, device, text FROM kept),
kept_sizes AS (SELECT episode_id, device, count(*) AS n FROM kept_texts GROUP BY ALL),
sizes AS (SELECT episode_id, count(DISTINCT text) AS n FROM episodes GROUP BY ALL),
hits AS (
  SELECT e.episode_id, k.device, count(*) AS h
  FROM episodes e JOIN kept_texts k USING (episode_id, text) GROUP BY ALL),
qm AS {_pooled("qrows", "v", "episode_id")},
rm AS {_pooled("kept", "v", "episode_id", "device")},
mean_pool AS (
  SELECT episode_id, rm.device, {COSINE.format(a="qm.v", b="rm.v")} AS score
  FROM qm JOIN rm USING (episode_id)),
scored AS (
  SELECT p.episode_id AS query, 'maxsim' AS method, p.device,
         round(coalesce(m.score, 0.0), 9) AS o, coalesce(m.score, 0.0) AS score
  FROM pairs p LEFT JOIN maxsim m USING (episode_id, device)
  UNION ALL
  SELECT p.episode_id, 'mean_pool', p.device, round(coalesce(m.score, 0.0), 9),
         coalesce(m.score, 0.0)
  FROM pairs p LEFT JOIN mean_pool m USING (episode_id, device)
  UNION ALL
  SELECT p.episode_id, 'exact_hit_count', p.device, CAST(coalesce(h, 0) AS DOUBLE),
         CAST(coalesce(h, 0) AS DOUBLE)
  FROM pairs p LEFT JOIN hits USING (episode_id, device)
  UNION ALL
  SELECT episode_id, 'jaccard', device, j, j FROM (
    SELECT p.episode_id, p.device,
           CAST(coalesce(h, 0) AS DOUBLE) / (s.n + coalesce(k.n, 0) - coalesce(h, 0)) AS j
    FROM pairs p JOIN sizes s USING (episode_id)
    LEFT JOIN hits USING (episode_id, device)
    LEFT JOIN kept_sizes k USING (episode_id, device))),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query, method ORDER BY o DESC, device) AS rank
  FROM scored),
expected_ranks AS (
  SELECT i.episode_id AS query, i.expected, k.method, k.score, k.rank
  FROM ids i JOIN ranked k ON k.query = i.episode_id AND k.device = i.expected)"""


def _episode_top(mode: str) -> str:
    return f"""WITH {_episode_scores(mode)}
SELECT query, method, device, round(score, 6) AS score, rank FROM ranked WHERE rank <= 5"""


def _episode_ranks(mode: str) -> str:
    return f"""WITH {_episode_scores(mode)}
SELECT query, expected, method, round(score, 6) AS score, rank FROM expected_ranks"""


def _episode_summary(mode: str) -> str:
    metrics = METRICS.replace("count(*) AS queries,\n", "")
    return f"""WITH {_episode_scores(mode)}
SELECT method, {metrics} FROM expected_ranks GROUP BY method"""


PARTIAL = _episodes("partial")

# ------------------------------------------------ windows


def _windows(closed: bool) -> str:
    limit = (
        "WHERE w + INTERVAL 7 DAY <= (SELECT max(ts) - INTERVAL 1 DAY FROM flows)"
        if closed
        else ""
    )
    return f"""WITH {FLOWS},
r AS (SELECT DISTINCT entity AS device, line FROM flows WHERE ts < {SPLIT}),
buckets AS (
  SELECT entity, line, time_bucket(INTERVAL 7 DAY, ts, TIMESTAMP '1970-01-01') AS w FROM flows),
q AS (SELECT DISTINCT w, entity, line FROM buckets {limit}),
rs AS (SELECT device, count(*) AS n_r FROM r GROUP BY device),
qs AS (SELECT w, entity, count(*) AS n_q FROM q GROUP BY ALL),
found AS (SELECT w, entity, device, count(*) AS h FROM q JOIN r USING (line) GROUP BY ALL),
pairs AS (
  SELECT w, entity, device, coalesce(h, 0) AS hit_count,
         CAST(coalesce(h, 0) AS DOUBLE) / (n_q + n_r - coalesce(h, 0)) AS score
  FROM qs CROSS JOIN rs LEFT JOIN found USING (w, entity, device)),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY w, entity ORDER BY score DESC, device) AS rank
  FROM pairs)
SELECT strftime(w, '%Y-%m-%d %H:%M:%S') AS window_start, entity, device,
       round(score, 6) AS score, hit_count, rank
FROM ranked WHERE rank <= 5"""


MEANING = f"""WITH {SEMANTIC},
windows AS (
  SELECT DISTINCT time_bucket(INTERVAL 7 DAY, ts, TIMESTAMP '1970-01-01') AS w, entity, line
  FROM flows),
means AS (
  SELECT w, entity, device, avg(s) AS score FROM windows JOIN best USING (line) GROUP BY ALL),
places AS (
  SELECT *, row_number() OVER (
           PARTITION BY w, entity ORDER BY round(score, 9) DESC, device) AS rank
  FROM means)
SELECT strftime(w, '%Y-%m-%d %H:%M:%S') AS window_start, entity, device,
       round(score, 6) AS score, rank
FROM places WHERE rank <= 5"""

_PATH = f"""(CASE doc_id % 3 WHEN 0 THEN {VARIANT} || '.txt'
  WHEN 1 THEN {VARIANT} || '/' || lang || '.txt'
  ELSE lang || '_loo_9/deep/' || {VARIANT} || '.v1.txt' END)"""

ORACLE = {
    "ordered_distinct_lines": f"WITH {DISTINCT_LINES}\nSELECT doc_id, pos, line FROM firsts",
    "reduction_stats": f"""WITH {REDUCTION}
SELECT doc_id, original_size, flattened_size,
       original_size - flattened_size AS reduction_bytes,
       {_percent("original_size", "flattened_size")} AS reduction_percent
FROM sizes""",
    "reduction_summary": f"""WITH {REDUCTION},
totals AS (
  SELECT count(*) AS file_count, CAST(sum(original_size) AS BIGINT) AS total_original_size,
         CAST(sum(flattened_size) AS BIGINT) AS total_flattened_size FROM sizes)
SELECT *, total_original_size - total_flattened_size AS total_reduction_bytes,
       {_percent("total_original_size", "total_flattened_size")} AS total_reduction_percent
FROM totals""",
    "render_rules": f"WITH {RENDERED}\nSELECT doc_id, acl_pos, ace_pos, line FROM rendered",
    "compact_profiles": f"WITH {RENDERED}\nSELECT doc_id, acl_pos, ace_pos, line FROM compacted",
    "compact_profile_stats": f"""WITH {RENDERED},
after AS (SELECT doc_id, sum(length(line)) + count(*) - 1 AS n FROM compacted GROUP BY doc_id),
sizes AS (
  SELECT doc_id, {FRAME_LENGTH} + 2 * ({MATCH_LENGTH}) AS original_size,
         CAST(n AS BIGINT) AS flattened_size
  FROM tail JOIN after USING (doc_id))
SELECT doc_id, original_size, flattened_size,
       original_size - flattened_size AS reduction_bytes,
       {_percent("original_size", "flattened_size")} AS reduction_percent
FROM sizes""",
    "quarantined_profiles": """
SELECT event_id AS doc_id, 60 AS n_chars FROM events WHERE value > 100""",
    "corpus_counts": f"""WITH {FLOWS}
SELECT count(DISTINCT entity) AS profiles, count(*) AS rule_instances,
       count(DISTINCT line) AS unique_rules FROM flows""",
    "corpus_sketch": f"""WITH {FLOWS}
SELECT count(*) AS rule_instances, count(DISTINCT line) AS unique_rules,
       count(DISTINCT entity) AS profiles, true AS unique_rules_near, true AS profiles_near
FROM flows""",
    "profile_sets": f"""WITH {FLOWS}
SELECT entity, count(DISTINCT line) AS rules FROM flows GROUP BY entity""",
    "last_wins": f"""WITH {FLOWS},
days AS (SELECT DISTINCT entity, strftime(ts, '%Y-%m-%d') AS day, line FROM flows)
SELECT entity, day, line FROM days
WHERE (entity, day) IN (SELECT entity, max(day) FROM days GROUP BY entity)""",
    "clean_labels": f"""WITH n AS (SELECT doc_id, {VARIANT} AS name FROM documents)
SELECT doc_id, name, {_clean("name")} AS label FROM n""",
    "expected_labels": f"""WITH n AS (SELECT doc_id, {_PATH} AS path FROM documents),
parts AS (
  SELECT doc_id, path, CASE WHEN contains(path, '/') THEN string_split(path, '/')[1]
         ELSE regexp_replace(path, '\\.[^.]+$', '') END AS name FROM n)
SELECT doc_id, path, {_clean("name")} AS expected FROM parts""",
    "jaccard_topk": _overlap_top("jaccard"),
    "jaccard_topk_hot": _overlap_top("jaccard"),
    "hit_topk": _overlap_top("exact_hit_count"),
    "jaccard_expected_rank": _overlap_rank("jaccard"),
    "jaccard_expected_rank_hot": _overlap_rank("jaccard"),
    "hit_expected_rank": _overlap_rank("exact_hit_count"),
    "hit_expected_rank_hot": _overlap_rank("exact_hit_count"),
    "jaccard_metrics": _overlap_metrics("jaccard"),
    "hit_metrics": _overlap_metrics("exact_hit_count"),
    "exact_report": f"""WITH {_overlap_ranked("jaccard")}
SELECT e.query, e.expected, e.rank, t.rank - 1 AS place, t.device,
       round(t.score, 6) AS score, t.hit_count
FROM expected e JOIN ranked t ON t.query = e.query AND t.rank <= 5""",
    "l2_normalise": f"""WITH {BANK}
SELECT row_id, dim, round(value, 6) AS value FROM (
  SELECT row_id, unnest(v) AS value, unnest(range(len(v))) AS dim FROM bank)""",
    "mean_pool": f"""WITH {BANK},
m AS {_pooled("raw_bank", "v", "device")}
SELECT device, dim, round(value / n, 6) AS value FROM (
  SELECT device, sqrt(list_dot_product(v, v)) AS n, unnest(v) AS value,
         unnest(range(len(v))) AS dim FROM m)""",
    "mean_pool_topk": _top(POOLED),
    "mean_pool_expected_rank": _rank(POOLED),
    "maxsim_topk": _top(MAXSIM),
    "maxsim_topk_tiled": _top(MAXSIM),
    "maxsim_expected_rank": _rank(MAXSIM),
    "maxsim_expected_rank_tiled": _rank(MAXSIM),
    "maxsim_metrics": f"WITH {MAXSIM}, {RANKED}\nSELECT {METRICS} FROM expected_ranks",
    "semantic_topk": _top(SEMANTIC),
    "semantic_expected_rank": _rank(SEMANTIC),
    "episodes_strict": f"""WITH {_episodes("strict-unseen")}
SELECT episode_id, mode, expected, pos, role, text, row_id FROM episodes""",
    "episodes_partial": f"""WITH {PARTIAL}
SELECT episode_id, mode, expected, pos, role, text, row_id FROM episodes""",
    "masked_reference": f"""WITH {PARTIAL},
gone AS (
  SELECT e.episode_id, count(*) AS rows_removed
  FROM episodes e JOIN bank b USING (text) WHERE e.role = 'unseen' GROUP BY ALL)
SELECT episode_id, rows_removed, (SELECT count(*) FROM bank) - rows_removed AS rows_left
FROM gone""",
    "masked_own_profile": f"""WITH {PARTIAL}
SELECT DISTINCT i.episode_id, b.text
FROM (SELECT DISTINCT episode_id, expected FROM episodes) i JOIN bank b ON b.device = i.expected
WHERE (i.episode_id, b.text) NOT IN (
  SELECT (episode_id, text) FROM episodes WHERE role = 'unseen')""",
    "episode_counts": f"""WITH {_episodes("strict-unseen")}
SELECT count(DISTINCT episode_id) AS episode_count, count(DISTINCT expected) AS device_count
FROM episodes""",
    "episode_topk_strict": _episode_top("strict-unseen"),
    "episode_topk_partial": _episode_top("partial"),
    "episode_ranks_strict": _episode_ranks("strict-unseen"),
    "episode_ranks_partial": _episode_ranks("partial"),
    "episode_ranks_partial_tiled": _episode_ranks("partial"),
    "episode_summary_strict": _episode_summary("strict-unseen"),
    "episode_summary_partial": _episode_summary("partial"),
    "whiten_leading": """SELECT i.range AS i, j.range AS j,
       CASE WHEN i.range = j.range THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS covariance,
       CAST(16 AS BIGINT) AS dim
FROM range(16) i, range(16) j WHERE EXISTS (FROM embeddings)""",
    "whiten_stage": f"""WITH {BANK}
SELECT row_id, CAST(16 AS BIGINT) AS dim, 1.0::DOUBLE AS length FROM bank""",
    "whiten_covariance": """WITH d AS (SELECT max(len(embedding)) AS dim FROM embeddings)
SELECT i.range AS i, j.range AS j, CASE WHEN i.range = j.range THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS covariance,
       CAST(d.dim AS BIGINT) AS dim
FROM d, range((SELECT dim FROM d)) i, range((SELECT dim FROM d)) j""",
    "whiten_energy": f"""WITH {BANK},
one AS (
  SELECT row_id, unnest(range(len(v))) AS i, unnest(v) AS x, unnest(v) / sqrt(list_dot_product(v, v)) AS u
  FROM bank),
centred AS (SELECT row_id, i, u - avg(u) OVER (PARTITION BY i) AS c FROM one),
scatter AS (
  SELECT a.i, b.i AS j, sum(a.c * b.c) AS s FROM centred a JOIN centred b USING (row_id) GROUP BY ALL)
SELECT (SELECT count(*) FROM embeddings) AS rows,
       round(sum(s) FILTER (WHERE i = j), 4) AS second, round(sum(s * s), 2) AS fourth
FROM scatter""",
    "whiten_metadata": """
SELECT count(*) AS input_rows, count(*) AS reference_rows,
       CAST(max(len(embedding)) AS BIGINT) AS input_dim,
       CAST(max(len(embedding)) AS BIGINT) AS rank,
       CAST(least(256, max(len(embedding))) AS BIGINT) AS k
FROM embeddings""",
    "embed_per_rule": f"""WITH {LINES}, {_bag("(SELECT line AS text FROM lines)")}
SELECT l.doc_id, l.pos, b.dim, round(CAST(b.value AS DOUBLE), 6) AS value
FROM lines l JOIN bags b ON b.text = l.line""",
    "embed_in_runs": f"""WITH {LINES}, {_bag("(SELECT line AS text FROM lines)")}
SELECT l.doc_id, l.pos, b.dim, round(CAST(b.value AS DOUBLE), 6) AS value
FROM lines l JOIN bags b ON b.text = l.line""",
    "embed_mean": f"""WITH {LINES}, {_bag("(SELECT line AS text FROM lines)")},
sums AS (
  SELECT l.doc_id, b.dim, sum(CAST(b.value AS DOUBLE)) AS s
  FROM lines l JOIN bags b ON b.text = l.line GROUP BY ALL)
SELECT doc_id, dim, round(CAST(CAST(
         s / sqrt(sum(s * s) OVER (PARTITION BY doc_id)) AS FLOAT) AS DOUBLE), 6) AS value
FROM sums""",
    "embed_whole": f"""WITH {_bag("documents")}
SELECT d.doc_id, b.dim, round(CAST(b.value AS DOUBLE), 6) AS value
FROM documents d JOIN bags b USING (text)""",
    "runtime_window_match": _windows(closed=False),
    "runtime_window_meaning": MEANING,
    "runtime_stream_match": _windows(closed=True),
    "runtime_stream_late": f"""WITH {FLOWS},
first AS (SELECT max(ts) - INTERVAL 1 DAY AS watermark FROM flows WHERE ts >= {SPLIT}),
buckets AS (
  SELECT entity, line, time_bucket(INTERVAL 7 DAY, ts, TIMESTAMP '1970-01-01') AS w
  FROM flows WHERE ts < {SPLIT} AND entity IS NOT NULL AND line IS NOT NULL)
SELECT strftime(w, '%Y-%m-%d %H:%M:%S') AS window_start, entity, line, count(*) AS flows
FROM buckets WHERE w + INTERVAL 7 DAY <= (SELECT watermark FROM first) GROUP BY ALL""",
}
