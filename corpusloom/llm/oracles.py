"""DuckDB statements of the queries that SQL can express."""

from __future__ import annotations

from corpusloom.llm import embedding_dedup, line_dedup, quality

_SPACE_WORD = r"[^\x20\x09-\x0D]+"
_ASCII_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

OP1 = rf"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_ASCII_WORD}') AS w
  FROM documents),
items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_ASCII_WORD}') AS w
  FROM benchmark),
starts AS (SELECT item_id, w, least(10, len(w)) AS m, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS a FROM items WHERE len(w) > 0),
windows AS (SELECT DISTINCT item_id, m, array_to_string(w[a : a + m - 1], ' ') AS gram FROM starts),
lengths AS (SELECT DISTINCT m FROM windows),
places AS (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS a FROM words, lengths WHERE len(w) >= m),
grams AS (SELECT doc_id, m, a, array_to_string(w[a : a + m - 1], ' ') AS gram FROM places),
found AS (SELECT doc_id, a, m, item_id FROM grams JOIN windows USING (m, gram)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(a, a + m)) AS p FROM found) GROUP BY doc_id),
named AS (
  SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM found WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(hit.n, 0)::BIGINT AS n_hit, coalesce(named.n, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated
FROM words LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)
"""

OP6 = rf"""
WITH cut AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_SPACE_WORD}') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
places AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS a, w FROM cut WHERE len(w) >= 3),
grams AS (SELECT doc_id, a, w[a : a + 2] AS gram FROM places),
repeated AS (SELECT doc_id, a FROM grams QUALIFY count(*) OVER (PARTITION BY doc_id, gram) > 1),
covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([a, a + 1, a + 2]) AS p FROM repeated) GROUP BY doc_id),
facts AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, len(lines)::BIGINT AS n_lines,
    coalesce(n, 0)::BIGINT AS n_repeat_words,
    len(list_filter(lines, lambda x: regexp_matches(x, '{quality.BULLET}'))) AS n_bullets,
    len(list_filter(lines, lambda x: regexp_matches(x, '{quality.ELLIPSIS}'))) AS n_ellipses,
    len(list_filter(w, lambda x: regexp_matches(x, '{quality.NO_LETTER}'))) AS n_no_letter,
    coalesce(list_max(map_values(list_histogram(w))), 0) AS n_top_word
  FROM cut LEFT JOIN covered USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 100 * n_symbols > 25 * n_words
    OR 100 * n_dup_lines > 50 * n_lines OR word_chars < 2 * n_words OR word_chars > 20 * n_words
    OR 100 * n_bullets > 90 * n_lines OR 100 * n_ellipses > 30 * n_lines OR 100 * n_no_letter > 50 * n_words
    OR 100 * n_top_word > 30 * n_words) AS kept
FROM facts
"""

OP8 = rf"""
WITH rows AS (SELECT doc_id, source, text, string_split(text, chr(10)) AS lines FROM documents),
bare AS (SELECT doc_id, source, unnest(range(1, len(lines) + 1)) AS pos, lines FROM rows),
lines AS (
  SELECT doc_id, source, pos, lines[pos] AS line, regexp_replace(regexp_replace(lines[pos], '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', '') AS bare
  FROM bare),
shared AS (SELECT bare FROM lines WHERE bare <> '' GROUP BY bare HAVING count(DISTINCT source) >= {line_dedup.MIN_SITES}),
kept AS (
  SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) FILTER (shared.bare IS NULL) AS text, count(*) AS n, count(shared.bare) AS gone
  FROM lines LEFT JOIN shared ON lines.bare = shared.bare GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_lines, coalesce(gone, 0)::BIGINT AS n_removed,
  CASE WHEN rows.text IS NOT NULL THEN length(coalesce(kept.text, ''))::BIGINT END AS n_chars,
  CASE WHEN rows.text IS NOT NULL THEN sha256(coalesce(kept.text, '')) END AS kept_sha256
FROM rows LEFT JOIN kept USING (doc_id)
"""

# Lengths of the markers: 8 code points each. An escape adds one per backslash and per control string.
_ESCAPED = r"length(regexp_replace(replace({0}, '\', '\\'), '([<\[])(\||/?s>|</?SYS>>|/?INST\])', '\1\\\2', 'g'))"

OP9 = f"""
WITH rows AS (
  SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
turns AS (
  SELECT conv_id, coalesce(role, '') AS r, coalesce(text, '') AS t,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS k
  FROM rows),
loss AS (SELECT conv_id, coalesce(string_agg(t, '' ORDER BY k) FILTER (r = 'assistant'), '') AS t FROM turns GROUP BY conv_id)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(r || chr(10) || turns.t || chr(10), '' ORDER BY k)) AS turns_sha256,
  any_value(length(loss.t))::BIGINT AS loss_chars, any_value(sha256(loss.t)) AS loss_sha256,
  sum(24 + {_ESCAPED.format("r")} + {_ESCAPED.format("turns.t")})::BIGINT AS formatted_chars
FROM turns JOIN loss USING (conv_id) GROUP BY conv_id
"""

# CRC-32 of a short ASCII text, bit by bit.
_CRC32 = (
    "xor(list_reduce(list_transform(string_split({0}, ''), lambda x: ord(x)::BIGINT), lambda c, b: "
    "list_reduce(range(8), lambda d, i: CASE WHEN d & 1 = 1 THEN xor(d >> 1, 3988292384) ELSE d >> 1 END, xor(c, b)), "
    "4294967295::BIGINT), 4294967295)"
)


def _field(value: str) -> str:
    return f"coalesce(strlen({value}::VARCHAR)::VARCHAR || ':' || {value}::VARCHAR, '-')"


def _leaf(n_chars: str) -> str:
    return f"sha256({' || '.join(_field(x) for x in ('doc_id', 'source', 'lang', n_chars, 'text'))})"


# Nodes of all levels; a level of one node is the last.
_TREE = """
  SELECT {group}, 0 AS level, pos, digest, n FROM {leaves}
  UNION ALL
  SELECT {group}, level + 1, pos // 2, sha256(string_agg(digest, '' ORDER BY pos)), (any_value(n) + 1) // 2
  FROM {tree} WHERE n > 1 GROUP BY {group}, level, pos // 2"""

OP11 = f"""
WITH RECURSIVE rows AS (
  SELECT doc_id, lang, {_leaf("n_chars")} AS digest,
    CASE WHEN {_CRC32.format("doc_id::VARCHAR")} % 7 = 0 AND n_chars IS NOT NULL THEN {_leaf("(n_chars + 1)")} END AS tampered
  FROM documents),
leaves AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, digest) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n,
    dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS g
  FROM rows),
low AS ({_TREE.format(group="g", leaves="leaves", tree="low")}),
subroots AS (SELECT 0 AS top, g AS pos, digest, count(*) OVER () AS n FROM low WHERE n = 1),
high AS ({_TREE.format(group="top", leaves="subroots", tree="high")}),
steps AS (
  SELECT l.g, l.pos, low.level, max(o.digest) FILTER (o.pos < l.pos >> low.level) AS a, max(o.digest) FILTER (o.pos > l.pos >> low.level) AS b
  FROM leaves l JOIN low ON low.g = l.g AND low.pos = l.pos >> low.level AND low.n > 1
  LEFT JOIN low o ON o.g = l.g AND o.level = low.level AND o.pos = xor(low.pos, 1)
  GROUP BY ALL
  UNION ALL
  SELECT l.g, l.pos, 1000 + high.level, max(o.digest) FILTER (o.pos < l.g >> high.level), max(o.digest) FILTER (o.pos > l.g >> high.level)
  FROM leaves l JOIN high ON high.pos = l.g >> high.level AND high.n > 1
  LEFT JOIN high o ON o.level = high.level AND o.pos = xor(high.pos, 1)
  GROUP BY ALL),
proofs AS (
  SELECT g, pos, string_agg(coalesce(a, '') || coalesce(b, ''), '' ORDER BY level) AS proof,
    list({{'a': coalesce(a, ''), 'b': coalesce(b, '')}} ORDER BY level) AS way
  FROM steps GROUP BY g, pos),
folded AS (
  SELECT doc_id, l.digest AS leaf, s.digest AS subroot, (SELECT digest FROM high WHERE n = 1) AS root, sha256(coalesce(proof, '')) AS proof_sha256,
    list_reduce(list_transform(coalesce(way, []), lambda s: s.a || '|' || s.b), lambda acc, s: sha256(split_part(s, '|', 1) || acc || split_part(s, '|', 2)),
      coalesce(tampered, l.digest)) AS folded_root
  FROM leaves l JOIN subroots s ON s.pos = l.g LEFT JOIN proofs p ON p.g = l.g AND p.pos = l.pos)
SELECT *, folded_root = root AS verified FROM folded
"""


OP13 = f"""
WITH RECURSIVE given AS (
  SELECT vec_id, embedding::DOUBLE[] AS v, row_number() OVER () AS k FROM embeddings),
valid AS (
  SELECT *, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS size FROM given
  WHERE len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.k AS a, b.k AS b, b.vec_id FROM valid a JOIN valid b
  ON len(a.v) = len(b.v) AND a.k <> b.k AND list_dot_product(a.v, b.v) / (a.size * b.size) >= {embedding_dedup.THRESHOLD}),
reached AS (SELECT k AS a, k AS b FROM given UNION SELECT reached.a, links.b FROM reached JOIN links ON reached.b = links.a),
classes AS (SELECT a, min(vec_id) AS component_id FROM reached JOIN given ON reached.b = given.k GROUP BY a),
degrees AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, coalesce(vec_id = component_id, false) AS kept
FROM given JOIN classes ON classes.a = given.k LEFT JOIN degrees ON degrees.a = given.k
"""


def oracle_sql() -> dict[str, str]:
    """Not op2 (CRC-32), op3 and op7 (files and training), op4 (draws), op5 (keyed hashes), op10 (XXH64), op12 (suffix trees)."""
    return {"op1_decontamination": OP1, "op6_quality": OP6, "op8_line_dedup": OP8, "op9_chat": OP9, "op11_merkle": OP11, "op13_embeddings": OP13}
