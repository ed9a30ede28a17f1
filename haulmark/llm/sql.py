"""The registered queries that SQL can express, as DuckDB statements on the given tables."""

from __future__ import annotations

from haulmark.llm import chat_format, line_dedup, source_mixing

_WORD = r"[^\x20\x09-\x0D]+"


def _escaped(column: str) -> str:
    out = f"replace({column}, '\\', '\\\\')"
    for mark in sorted(chat_format.CONTROLS, key=len, reverse=True):
        out = f"replace({out}, '{mark}', '{mark[0]}\\{mark[1:]}')"
    return out


_MARKS = len(chat_format.START + chat_format.MIDDLE + chat_format.END) + 1

OP2_CHAT_FORMAT = f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length({_escaped("role")}) + length({_escaped("text")}) + {_MARKS}) AS BIGINT) AS formatted_chars
FROM turns GROUP BY conv_id
"""

OP7_SOURCE_MIXING = f"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '{_WORD}')), 0) AS BIGINT) AS size,
    md5('{source_mixing.SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS place FROM documents),
sources AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight,
    source_size * 2 AS cap, CAST(sum(source_size) OVER () AS DOUBLE) * 1.5 AS total FROM sources),
tested AS (
  SELECT *, cap * CAST(sum(weight) OVER later AS DOUBLE)
      <= weight * (total - CAST(coalesce(sum(cap) OVER earlier, 0) AS DOUBLE)) AS is_full
  FROM weighed
  WINDOW earlier AS (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
    later AS (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
targets AS (
  SELECT source, source_size, CASE WHEN is_full THEN CAST(cap AS DOUBLE)
    ELSE weight * (total - CAST(coalesce(sum(cap) FILTER (is_full) OVER (), 0) AS DOUBLE))
      / CAST(sum(weight) FILTER (NOT is_full) OVER () AS DOUBLE) END AS target FROM tested),
plan AS (
  SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE CAST(floor(target) AS BIGINT) // source_size END AS whole,
    CAST(floor(target) AS BIGINT) AS words FROM targets),
places AS (
  SELECT source, place, CAST(sum(size) AS BIGINT) AS group_size,
    CAST(sum(sum(size)) OVER (PARTITION BY source ORDER BY place) - sum(size) AS BIGINT) AS before
  FROM sized GROUP BY source, place)
SELECT d.doc_id, d.size, p.source_size, p.target,
  CAST(whole * size + CASE WHEN group_size = 0 THEN 0
    ELSE size * greatest(0, least(words - whole * source_size - before, group_size)) // group_size END AS BIGINT) AS taken
FROM sized d JOIN plan p ON d.source IS NOT DISTINCT FROM p.source
  JOIN places g ON d.source IS NOT DISTINCT FROM g.source AND d.place = g.place
"""

OP1_LINE_DEDUP = f"""
WITH cut AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents),
spread AS (
  SELECT doc_id, unnest(lines) AS line, unnest(range(1, len(lines) + 1)) AS i FROM cut),
held AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS p FROM spread
  WHERE regexp_matches(line, '{_WORD}')),
pairs AS (SELECT doc_id, p, line, lead(line) OVER (PARTITION BY doc_id ORDER BY p) AS following FROM held),
ranked AS (
  SELECT doc_id, p, row_number() OVER (PARTITION BY line, following ORDER BY doc_id, p) AS copy FROM pairs
  WHERE following IS NOT NULL),
gone AS (
  SELECT DISTINCT h.doc_id, h.i FROM held h
  JOIN ranked r ON r.doc_id = h.doc_id AND r.copy > 1 AND h.p IN (r.p, r.p + 1)
  UNION
  SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY line ORDER BY doc_id, p) AS copy FROM held
    WHERE len(regexp_extract_all(line, '{_WORD}')) >= {line_dedup.LONG_LINE}) WHERE copy > 1),
kept AS (
  SELECT s.doc_id, string_agg(line, chr(10) ORDER BY s.i) AS text FROM spread s ANTI JOIN gone g
  ON s.doc_id = g.doc_id AND s.i = g.i GROUP BY s.doc_id),
counted AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT c.doc_id, CAST(coalesce(len(lines), 0) AS BIGINT) AS n_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_deleted,
  CASE WHEN c.text IS NOT NULL THEN coalesce(k.text, '') END AS text
FROM cut c LEFT JOIN kept k ON k.doc_id = c.doc_id LEFT JOIN counted g ON g.doc_id = c.doc_id
"""

OP3_METRIC_SEARCH = """
WITH points AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, p.vec_id, CAST(list_inner_product(q.v, p.v) AS BIGINT) AS score
  FROM points q JOIN points p ON p.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 20
"""

# CRC-32 of the decimal id, bit by bit.
_CRC32 = """xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(CAST(conv_id AS VARCHAR), ''),
    lambda x: CAST(ascii(x) AS BIGINT))), lambda acc, b: list_reduce(list_concat([xor(acc, b)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
    lambda x, y: xor(x >> 1, (x & 1) * 3988292384))))"""

OP11_PREFIX_TRIE = f"""
WITH own AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS place
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT conv_id, conv_id - conv_id % 20 AS donor, {_CRC32} % 4 AS h FROM (SELECT DISTINCT conv_id FROM own)),
parts AS (
  SELECT c.conv_id, 0 AS part, place, role, text FROM convs c JOIN own d ON d.conv_id = c.donor AND d.place <= h
  UNION ALL SELECT o.conv_id, 1, place, role, text FROM own o JOIN convs c ON c.conv_id = o.conv_id WHERE place > h),
rebuilt AS (
  SELECT c.conv_id, coalesce(list({{'role': role, 'text': text}} ORDER BY part, place) FILTER (place IS NOT NULL), []) AS turns
  FROM convs c LEFT JOIN parts p ON p.conv_id = c.conv_id GROUP BY c.conv_id),
prefixes AS (
  SELECT conv_id, len(turns) AS size, unnest(range(0, len(turns) + 1)) AS depth, turns FROM rebuilt),
nodes AS (
  SELECT list_slice(turns, 1, depth) AS node, depth, min(conv_id) AS conv_id, count(*) AS n_convs, max(size) = depth AS is_leaf,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (size = depth), '')) AS ends_sha256
  FROM prefixes GROUP BY list_slice(turns, 1, depth), depth),
valued AS (
  SELECT *, (n_convs - 1) * CASE WHEN depth = 0 THEN 0 ELSE len(regexp_extract_all(node[depth].text, '{_WORD}')) END AS saved FROM nodes),
above AS (SELECT list_slice(node, 1, up) AS node, is_leaf, saved, depth - up AS down
  FROM (SELECT *, unnest(range(0, depth + 1)) AS up FROM valued)),
summed AS (
  SELECT node, sum(saved) AS saved_tokens, count(*) FILTER (is_leaf) AS n_leaves, count(*) FILTER (down = 1) AS n_children FROM above GROUP BY node)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, n.n_convs, s.n_children, s.n_leaves,
  CAST(s.saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
FROM nodes n JOIN summed s ON s.node = n.node LEFT JOIN nodes p ON n.depth > 0 AND p.node = list_slice(n.node, 1, n.depth - 1)
"""

ORACLE_SQL: dict[str, str] = {"op1_line_dedup": OP1_LINE_DEDUP, "op2_chat_format": OP2_CHAT_FORMAT, "op3_metric_search": OP3_METRIC_SEARCH, "op7_source_mixing": OP7_SOURCE_MIXING, "op11_prefix_trie": OP11_PREFIX_TRIE}
