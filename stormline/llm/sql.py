"""SQL counterparts of the queries that SQL can express."""

from __future__ import annotations

OP7 = r"""
WITH docs AS (
  SELECT row_number() OVER () AS n, doc_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents
), items AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark
), places AS (
  SELECT item, words, least(len(words), 10) AS span, unnest(range(1, len(words) - least(len(words), 10) + 2)) AS s FROM items
  WHERE len(words) > 0
), windows AS (
  SELECT DISTINCT item, span, array_to_string(words[s:s + span - 1], ' ') AS w FROM places
), runs AS (
  SELECT n, span, s, array_to_string(words[s:s + span - 1], ' ') AS w FROM (
    SELECT n, words, span, unnest(range(1, len(words) - span + 2)) AS s
    FROM docs, (SELECT DISTINCT span FROM windows) WHERE len(words) >= span)
), met AS (
  SELECT n, s, span, item FROM runs JOIN windows USING (span, w)
), hit AS (
  SELECT n, count(DISTINCT p) AS n_hit FROM (SELECT n, unnest(range(s, s + span)) AS p FROM met) GROUP BY n
), named AS (
  SELECT n, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS list FROM (SELECT DISTINCT n, item FROM met) GROUP BY n
)
SELECT doc_id, len(words) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hit USING (n) LEFT JOIN named USING (n)
"""

OP9 = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), marked AS (
  SELECT *, coalesce(lag(role) OVER w <> role, true) AS opens,
    length(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '[', '&lsqb;')) AS text_chars,
    length(replace(replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '[', '&lsqb;'), chr(10), '&nl;')) AS role_chars
  FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(text_chars + CASE WHEN opens THEN 8 + role_chars + 1 + 7 ELSE 8 END) AS BIGINT) AS formatted_chars
FROM marked GROUP BY conv_id
"""

OP10 = r"""
WITH rows AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents
)
SELECT doc_id, min(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
  doc_id = min(doc_id) OVER (PARTITION BY norm) AS kept, sha256(norm) AS text_sha256
FROM rows
"""



def _raking(rounds: int) -> str:
    """The steps of the raking, each a table of its own."""
    steps, last = [], "c0"
    for k in range(3 * rounds):
        side = ("source", "lang", "topic")[k % 3]
        steps.append(f"c{k + 1} AS MATERIALIZED (SELECT * REPLACE (w * t_{side} / sum(w) OVER (PARTITION BY {side}) AS w) FROM {last})")
        last = f"c{k + 1}"
    return ", ".join(steps) + f", raked AS (SELECT source, lang, topic, round(w / tokens, 6) AS rate FROM {last})"


def _target(side: str, power: float) -> str:
    return (f"t_{side} AS (SELECT {side}, pow(sum(tokens), {power}) / sum(pow(sum(tokens), {power})) OVER ()"
            f" * sum(sum(tokens)) OVER () AS t_{side} FROM cells GROUP BY {side})")


OP8 = rf"""
WITH texts AS (
  SELECT doc_id, source, lang, coalesce(text, '') AS text,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS n_tokens FROM documents
), rows AS (
  SELECT doc_id, source, lang, n_tokens, CASE WHEN n_tokens = 0 THEN 'empty' WHEN n_tokens >= 1000 THEN 'long form'
    WHEN n_tokens < 8 * (length(text) - length(replace(text, chr(10), '')) + 1) THEN 'listing' ELSE 'prose' END AS topic
  FROM texts
), cells AS MATERIALIZED (
  SELECT source, lang, topic, sum(n_tokens)::DOUBLE AS tokens FROM rows WHERE n_tokens > 0 GROUP BY ALL
), {_target('source', 0.5)}, {_target('lang', 0.7)}, {_target('topic', 0.7)},
c0 AS MATERIALIZED (
  SELECT c.*, t_source, t_lang, t_topic, tokens AS w FROM cells c
  JOIN t_source s ON c.source IS NOT DISTINCT FROM s.source JOIN t_lang l ON c.lang IS NOT DISTINCT FROM l.lang
  JOIN t_topic t ON c.topic = t.topic
), {_raking(10)}, rated AS (
  SELECT r.*, coalesce(k.rate, 1.0) AS rate,
    ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT / 4503599627370496.0 AS draw
  FROM rows r LEFT JOIN raked k ON r.source IS NOT DISTINCT FROM k.source AND r.lang IS NOT DISTINCT FROM k.lang
    AND r.topic = k.topic
)
SELECT doc_id, source, lang, topic, n_tokens, rate,
  CAST(floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END AS BIGINT) AS copies
FROM rated
"""


def _clustering(rounds: int) -> str:
    """The rounds of the clustering, each an assignment and the centroids after it."""
    steps = []
    for k in range(rounds + 1):
        steps.append(f"""a{k} AS MATERIALIZED (
  SELECT n, any_value(x) AS x, min(ROW(d, c)) AS best FROM (
    SELECT n, x, c, CAST(list_sum(list_transform(range(1, 65), lambda i: (x[i] - m[i]) * (x[i] - m[i]))) AS BIGINT) AS d
    FROM vectors, m{k}) GROUP BY n
)""")
        if k < rounds:
            steps.append(f"""m{k + 1} AS MATERIALIZED (
  SELECT c, coalesce(mean, m) AS m FROM m{k} LEFT JOIN (
    SELECT c, list(CAST(floor(total / members) AS BIGINT) ORDER BY i) AS mean FROM (
      SELECT best[2] AS c, i, sum(x[i]) AS total, count(*) AS members FROM a{k}, range(1, 65) AS r(i) GROUP BY ALL
    ) GROUP BY c) USING (c)
)""")
    return ", ".join(steps)


OP11 = rf"""
WITH vectors AS MATERIALIZED (
  SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * x::DOUBLE) AS BIGINT)) AS x
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: isfinite(x))) = 64
), m0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('2:' || coalesce(vec_id::VARCHAR, '')), x) - 1 AS c, x AS m FROM vectors
  QUALIFY c < 40
), {_clustering(5)}, found AS (
  SELECT vec_id, best[2] AS cluster, best[1] AS distance FROM a5 JOIN vectors USING (n)
)
SELECT vec_id, CAST(cluster AS INTEGER) AS cluster, distance,
  CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(m, ',')) AS centroid_sha256
FROM found JOIN m5 ON c = cluster
"""

OP12 = r"""
WITH crc_table AS (
  SELECT list(list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b) ORDER BY b) AS t
  FROM range(256) AS r(b)
), texts AS (
  SELECT row_number() OVER () AS n, doc_id, true AS own, text FROM documents
  UNION ALL SELECT -row_number() OVER (), NULL, false, text FROM benchmark
), counted AS (
  SELECT n, doc_id, own, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM texts
), features AS MATERIALIZED (
  SELECT n, own, unnest(words) AS w FROM counted
), distinct_words AS (
  SELECT DISTINCT w, hex(w) AS h FROM features
), hashed AS MATERIALIZED (
  SELECT w, xor(list_reduce(range(1, len(h) // 2 + 1),
    lambda c, i: xor(c >> 8, t[(xor(c, ('0x' || substr(h, 2 * i - 1, 2))::BIGINT) & 255) + 1]), 4294967295), 4294967295) % 10000 AS bucket
  FROM distinct_words, crc_table
), counts AS (
  SELECT bucket, count(*) FILTER (own) AS s, count(*) FILTER (NOT own) AS t FROM features JOIN hashed USING (w) GROUP BY bucket
), gains AS (
  SELECT bucket, CAST(floor(1000 * ln(((t + 1)::DOUBLE * (sum(s) OVER () + 10000)::DOUBLE)
    / ((s + 1)::DOUBLE * (sum(t) OVER () + 10000)::DOUBLE))) AS BIGINT) AS gain FROM counts
), weights AS (
  SELECT n, count(*) AS n_features, CAST(floor(sum(gain) / count(*)) AS BIGINT) AS weight
  FROM features JOIN hashed USING (w) JOIN gains USING (bucket) WHERE own GROUP BY n
), scored AS (
  SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln(
    (('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
  FROM counted LEFT JOIN weights USING (n) WHERE own
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS LAST) AS place,
    count(*) FILTER (n_features >= 20) OVER () AS fit FROM scored
)
SELECT doc_id, n_features AS n_words, n_features, weight, score,
  CASE WHEN n_features >= 20 AND place <= 10 * fit // 100 THEN place END AS rank
FROM placed
"""

ORACLE = {"op11_centroid_clustering": OP11, "op12_importance_resampling": OP12, "op8_mixing": OP8, "op7_decontamination": OP7, "op9_chat_format": OP9, "op10_exact_dedup": OP10}
