"""DuckDB statements that state the expected result of each query."""

from __future__ import annotations

from corpusloom.operators.tokenize import TOKEN_PATTERN
from corpusloom.operators.vocab import DEFAULT_MAX_VOCAB
from corpusloom.plans.queries import (
    BATCH, CHUNK, EPOCH, LENGTH, LONG_SHARD, MAX_DOCS, PHASES, SEED, SHARD_SIZE, VAL_SHARDS, VECTOR_DIMS,
)

OFFSET = EPOCH % PHASES * LENGTH // PHASES

WORDS = f"""
counted AS (
  SELECT token, count(*) AS occurrences
  FROM (SELECT unnest(regexp_extract_all(text, '{TOKEN_PATTERN}')) AS token FROM documents)
  GROUP BY token),
vocab AS (
  SELECT token, occurrences, (row_number() OVER (ORDER BY occurrences DESC, token) + 3)::INTEGER AS token_id
  FROM counted ORDER BY occurrences DESC, token LIMIT {DEFAULT_MAX_VOCAB - 5}),
ident AS (SELECT (count(*) + 5)::INTEGER AS vocab_size FROM vocab)
"""


def _ids(table: str, keys: str) -> str:
    """CTE ids(keys, place, id): the words' ids, then the separator."""
    return f"""
found AS (SELECT {keys}, regexp_extract_all(text, '{TOKEN_PATTERN}') AS w FROM {table}),
ids AS (
  SELECT {keys}, place, coalesce(token_id, 3) AS id
  FROM (SELECT {keys}, unnest(w) AS token, generate_subscripts(w, 1) AS place FROM found)
  LEFT JOIN vocab USING (token)
  UNION ALL SELECT {keys}, len(w) + 1, 2 FROM found)
"""


STREAM = f"""WITH {WORDS}, {_ids("documents", "doc_id")},
stream AS (
  SELECT doc_id, place, id, row_number() OVER (ORDER BY doc_id, place) - 1 AS pos FROM ids)
"""


def _join(value: str, order: str, sep: str = ",") -> str:
    return f"string_agg(({value})::VARCHAR, '{sep}' ORDER BY {order})"


def _windows(offset: int = 0, where: str = "true", shift: str = "0") -> str:
    """CTE win(seq_idx, spot, id): tokens of complete windows."""
    return f"""
placed AS (SELECT (pos - {shift} - {offset}) // {LENGTH} AS seq_idx, (pos - {shift} - {offset}) % {LENGTH} AS spot, id
           FROM stream WHERE pos - {shift} >= {offset} AND {where}),
win AS (SELECT seq_idx, spot, id FROM placed
        WHERE seq_idx < (SELECT (count(*)) // {LENGTH} FROM placed))
"""


def _window_rows(offset: int, epoch: int, where: str = "true", shift: str = "0", keep: str = "true") -> str:
    return f"""{STREAM}, {_windows(offset, where, shift)}
SELECT {epoch}::INTEGER AS epoch, seq_idx, {_join("id", "spot")} AS input_ids FROM win WHERE {keep} GROUP BY seq_idx"""


def _key(*parts: str) -> str:
    text = " || ':' || ".join(f"({p})::VARCHAR" for p in parts)
    return f"('0x' || substr(md5({text}), 1, 15))::BIGINT"


def _draw(*parts: str) -> str:
    return f"({_key(*parts)} >> 28)"


PERMUTED = f"""{STREAM},
total AS (SELECT count(*) // {LENGTH} AS n FROM stream),
perm AS (
  SELECT seq_idx, row_number() OVER (ORDER BY {_key("1", str(SEED + EPOCH), "seq_idx")}, seq_idx) - 1 AS pos
  FROM (SELECT unnest(range((SELECT n FROM total))) AS seq_idx))
"""

# The order with each window's first token.
ORDERED = f"""{PERMUTED}, {_windows()},
firsts AS (SELECT seq_idx, pos, id AS first_id FROM win JOIN perm USING (seq_idx) WHERE spot = 0)
"""



def _recursive(ctes: str) -> str:
    return ctes.replace("WITH", "WITH RECURSIVE", 1)


def _keyed(seqs: str) -> str:
    """CTE keyed(seq_idx, pos): the Feistel network's order of the ids 0..n-1 of ``seqs``, to be used with RECURSIVE."""
    moved = {half: _key("5", str(SEED + EPOCH), "kk", half) for half in ("l", "r")}
    return f"""
ids_of AS (SELECT DISTINCT seq_idx FROM {seqs}),
sides AS (
  SELECT n, a, greatest((n + a - 1) // a, 1) AS b
  FROM (SELECT n, unnest(range(root, 64 * root + 1)) AS a FROM (
    SELECT count(*) AS n, floor(sqrt(greatest(count(*) - 1, 0)))::BIGINT + 1 AS root FROM ids_of))
  ORDER BY greatest((a - n % a) % a, 16), a LIMIT 1),
feistel AS (
  SELECT seq_idx, 0 AS k, seq_idx // b AS l, seq_idx % b AS r FROM ids_of, sides
  UNION ALL
  SELECT seq_idx, kk + 1, CASE WHEN kk % 2 = 0 THEN (l + {moved["r"]} % a) % a ELSE l END,
         CASE WHEN kk % 2 = 1 THEN (r + {moved["l"]} % b) % b ELSE r END
  FROM (SELECT seq_idx, k % 8 AS kk, l, r, a, b FROM feistel, sides WHERE k < 8 OR l * b + r >= n)),
keyed AS (SELECT seq_idx, l * b + r AS pos FROM feistel, sides WHERE k = 8 AND l * b + r < n)
"""


SHARDED = f"""{STREAM},
sharded AS (
  SELECT (pos // {SHARD_SIZE})::INTEGER AS shard_index, pos % {SHARD_SIZE} AS spot, id, doc_id,
         CASE WHEN pos // {SHARD_SIZE} < {VAL_SHARDS} THEN 'val' ELSE 'train' END AS split
  FROM stream),
shards AS (
  SELECT shard_index, split, count(*) AS shard_tokens,
         printf('fineweb_%s_%06d.bin', split, shard_index) AS name
  FROM sharded GROUP BY shard_index, split),
headers AS (
  SELECT shards.*, 20240520 AS magic, 3 AS version, shard_tokens::INTEGER AS token_count, vocab_size,
         1 AS pad_id, 0 AS cls_id, 2 AS sep_id, vocab_size - 1 AS mask_id
  FROM shards, ident)
"""

CHUNKS = f"""{SHARDED}
SELECT split, shard_index, spot // {CHUNK} * {CHUNK} AS start, {_join("id", "spot")} AS tokens
FROM sharded GROUP BY ALL"""

# Documents as sequences, padded per batch of neighbouring documents.
DOC_BATCHES = f"""{STREAM},
sizes AS (SELECT doc_id, doc_id // {BATCH} AS batch_id, count(*) AS n FROM ids GROUP BY doc_id),
lengths AS (SELECT batch_id, (max(n) + 7) // 8 * 8 AS padded_length FROM sizes GROUP BY batch_id)
"""


def _padded(value: str) -> str:
    return f"""{DOC_BATCHES},
padded AS (
  SELECT doc_id, batch_id, place, id FROM ids JOIN sizes USING (doc_id)
  UNION ALL
  SELECT doc_id, batch_id, unnest(range(n + 1, padded_length + 1)) AS place, {value}
  FROM sizes JOIN lengths USING (batch_id))
"""


def _masked(probability: float) -> str:
    """CTE masked(seq_idx, spot, id, label): the label is -100 where nothing is predicted."""
    limit = int(probability * 2**32)
    return f"""
masked AS (
  SELECT seq_idx, spot, id,
         CASE WHEN id NOT IN (0, 1, 2) AND {_draw("2", str(SEED), str(EPOCH), "seq_idx", "spot")} < {limit}
              THEN id ELSE -100 END AS label
  FROM win)
"""


HIDDEN = "CASE WHEN label = -100 THEN id ELSE (SELECT vocab_size - 1 FROM ident) END"

STEPS = """WITH steps AS (
  SELECT user_id AS run, event_id AS step, sqrt(value) AS loss, event_type,
         CASE WHEN event_type <> 'error' THEN (props->>'$.k')::DOUBLE END AS num_masked
  FROM events)
"""


def _spans(source: str, length: int, sentinels: int, first: int = 60000) -> str:
    """From CTE ``source``(seq_idx, k, start, len) to a row per window: the corrupted input and its target."""
    sentinel = f"{first} + k % {sentinels}"
    return f"""
inside AS (SELECT win.seq_idx, win.spot, win.id, k, start FROM win JOIN {source} s
           ON s.seq_idx = win.seq_idx AND win.spot >= s.start AND win.spot < s.start + s.len),
outside AS (SELECT seq_idx, spot, id FROM win ANTI JOIN inside USING (seq_idx, spot)),
inputs AS (SELECT seq_idx, spot, id FROM outside UNION ALL SELECT seq_idx, start, {sentinel} FROM {source}),
targets AS (SELECT seq_idx, k, -1 AS spot, {sentinel} AS id FROM {source}
            UNION ALL SELECT seq_idx, k, spot, id FROM inside)
"""


# Spans drawn from the window length, as (seq_idx, k, start, len).
BUDGET = int(LENGTH * 0.15)
SAMPLED = f"""
drawn AS (
  SELECT seq_idx, k, greatest(floor(ln(1 - {_draw("3", str(SEED), str(EPOCH), "seq_idx", "k")} / 4294967296.0::DOUBLE)
                              / ln(1 - 1 / 3.0::DOUBLE))::INTEGER, 1) AS g
  FROM (SELECT DISTINCT seq_idx FROM win), (SELECT unnest(range({BUDGET})) AS k)),
upto AS (SELECT *, sum(g) OVER (PARTITION BY seq_idx ORDER BY k) - g AS taken FROM drawn),
lens AS (SELECT seq_idx, k, least(g, {BUDGET} - taken)::INTEGER AS len FROM upto WHERE taken < {BUDGET}),
gapped AS (
  SELECT seq_idx, k, len,
         {_draw("4", str(SEED), str(EPOCH), "seq_idx", "k")}
           % greatest(1, ({LENGTH - BUDGET}) // (count(*) OVER (PARTITION BY seq_idx) + 1)) AS gap
  FROM lens),
sampled AS (
  SELECT seq_idx, k, len,
         (sum(gap + len) OVER (PARTITION BY seq_idx ORDER BY k) - len)::INTEGER AS start
  FROM gapped)
"""

EMITTED = f"""
fixed AS (
  SELECT seq_idx, k,
         CASE k WHEN 0 THEN s WHEN 1 THEN s + 3 WHEN 2 THEN s + 40 ELSE {LENGTH - 2} END AS start,
         CASE k WHEN 0 THEN 3 WHEN 1 THEN 1 WHEN 2 THEN s + 5 ELSE 2 END AS len
  FROM (SELECT DISTINCT seq_idx, seq_idx % 3 AS s FROM win), (SELECT unnest(range(4)) AS k))
"""

VECTORS = f"""
vectors AS (
  SELECT t AS token_id, embedding AS vec
  FROM (SELECT unnest(range((SELECT vocab_size FROM ident))) AS t)
  JOIN embeddings ON vec_id = t % (SELECT count(*) FROM embeddings))
"""


def _stripes(world: int, drop_last: bool) -> str:
    if drop_last:
        source = f"SELECT seq_idx, first_id, pos FROM firsts, total WHERE pos < n // {world} * {world}"
    else:
        source = f"""SELECT seq_idx, first_id, unnest(range(pos, (n + {world - 1}) // {world} * {world}, n)) AS pos
                     FROM firsts, total"""
    return f"""{ORDERED}
SELECT (pos % {world})::INTEGER AS rank, pos // {world} AS local_pos, seq_idx, first_id FROM ({source})"""


def _tokens_of(table: str, keys: str) -> str:
    return f"""WITH {WORDS}, {_ids(table, keys)}
SELECT {keys}, count(*)::INTEGER AS n, {_join("id", "place")} AS tokens FROM ids GROUP BY ALL"""


VECTOR_MIX = " + ".join(["0.0::DOUBLE", *(f"{i + 1} * vec[{i + 1}]::DOUBLE" for i in range(VECTOR_DIMS))])

LOOKED_UP = f"""{STREAM}, {_windows()}, {VECTORS}
SELECT seq_idx, spot::INTEGER AS pos, id AS token_id,
       round({VECTOR_MIX}, 6) AS vec_mix
FROM win JOIN vectors ON token_id = id"""

EMBEDDED = f"""{STREAM}, {VECTORS},
used AS (SELECT doc_id, id, count(*) AS times FROM ids WHERE id <> 1 GROUP BY ALL),
sizes AS (SELECT doc_id, sum(times) AS n FROM used GROUP BY doc_id),
flat AS (SELECT doc_id, times, unnest(vec)::DOUBLE AS v, generate_subscripts(vec, 1) AS d
         FROM used JOIN vectors ON token_id = id)
SELECT doc_id AS seq_idx, (d - 1)::INTEGER AS dim, round(sum(v * times) / any_value(n), 6) AS value
FROM flat JOIN sizes USING (doc_id) GROUP BY doc_id, d"""


def oracle_sql() -> dict[str, str]:
    val_tokens = f"{VAL_SHARDS * SHARD_SIZE}"
    found = {
        "document_scan": "SELECT doc_id, length(text)::INTEGER AS n_chars FROM documents",
        "doc_cap": f"SELECT doc_id, length(text)::INTEGER AS n_chars FROM documents ORDER BY doc_id LIMIT {MAX_DOCS}",
        "build_vocab": f"WITH {WORDS} SELECT token, occurrences, token_id FROM vocab",
        "tokenize_docs": _tokens_of("documents", "doc_id"),
        "tokenize_turns": _tokens_of("conversations", "conv_id, turn"),
        "tokenize_joined": _tokens_of("benchmark", "item_id"),
        "token_range_guard": f"""WITH {WORDS}, {_ids("documents", "doc_id")}
            SELECT doc_id, count(*) AS violations FROM ids
            WHERE id * 2 - 10 NOT BETWEEN 0 AND 65535 GROUP BY doc_id""",
        "stream_offsets": f"""{STREAM}
            SELECT doc_id, min(pos) AS start, max(pos) + 1 AS "end" FROM stream GROUP BY doc_id""",
        "shard_cut": f"""{SHARDED}
            SELECT shard_index, min(spot) AS start, {_join("id", "spot")} AS tokens
            FROM sharded GROUP BY doc_id, shard_index""",
        "shard_names": f"{SHARDED} SELECT shard_index, split, name, shard_tokens FROM shards",
        "shard_headers": f"""{SHARDED}
            SELECT split, shard_index, name, 1024 + 2 * shard_tokens AS file_bytes, magic, version, token_count,
                   vocab_size, pad_id, cls_id, sep_id, mask_id FROM headers""",
        "split_totals": f"""{SHARDED}
            SELECT split, count(*) AS num_shards, sum(shard_tokens)::BIGINT AS total_tokens
            FROM shards GROUP BY split""",
        "shard_offsets": f"""{SHARDED}
            SELECT split, shard_index, token_end - shard_tokens AS token_start, token_end
            FROM (SELECT *, (sum(shard_tokens) OVER (PARTITION BY split ORDER BY shard_index))::BIGINT AS token_end
                  FROM shards)""",
        "asof_position": f"""{SHARDED},
            starts AS (SELECT doc_id, min(pos) AS position FROM stream GROUP BY doc_id),
            catalog AS (SELECT shard_index, (sum(shard_tokens) OVER (ORDER BY shard_index) - shard_tokens)::BIGINT
                        AS token_start FROM shards)
            SELECT doc_id, position, shard_index, position - token_start AS local_offset
            FROM starts ASOF JOIN catalog ON position >= token_start""",
        "shard_roundtrip": CHUNKS,
        "shard_roundtrip_long": f"""{STREAM}
            SELECT 'train' AS split, (pos // {LONG_SHARD})::INTEGER AS shard_index,
                   pos % {LONG_SHARD} // {CHUNK} * {CHUNK} AS start, {_join("id", "pos")} AS tokens
            FROM stream GROUP BY ALL""",
        "header_consistency": f"""{SHARDED},
            changed AS (SELECT name, split, shard_index, vocab_size + (shard_index % 3 = 2)::INTEGER AS vocab_size,
                               pad_id + (shard_index % 5 = 4)::INTEGER AS pad_id FROM headers),
            first AS (SELECT split, arg_min(vocab_size, name) AS v, arg_min(pad_id, name) AS p
                      FROM changed GROUP BY split),
            pairs AS (SELECT name, 'vocab_size' AS field, vocab_size AS value, v AS expected
                      FROM changed JOIN first USING (split)
                      UNION ALL SELECT name, 'pad_id', pad_id, p FROM changed JOIN first USING (split))
            SELECT name, field, value, expected FROM pairs WHERE value <> expected""",
        "vocab_check": f"""{SHARDED}
            SELECT name, 'vocab_size' AS field, vocab_size AS header_value, vocab_size AS vocab_value, 'ok' AS status
            FROM headers
            UNION ALL SELECT name, 'pad_id', pad_id, 1, 'ok' FROM headers
            UNION ALL SELECT name, 'sep_id', sep_id, 2, 'ok' FROM headers
            UNION ALL SELECT name, 'mask_id', mask_id, vocab_size - 2, 'mismatch' FROM headers
            UNION ALL SELECT name, 'cls_id', cls_id, 99, 'warning' FROM headers""",
        "windows_fixed": _window_rows(0, 0),
        "windows_epoch_offset": _window_rows(OFFSET, EPOCH),
        "windows_from_shards": _window_rows(OFFSET, EPOCH, shift=val_tokens),
        "windows_across_chunks": _window_rows(0, 0, where=f"pos < {val_tokens}"),
        "window_lookup": _window_rows(0, 0, keep=f"seq_idx = (SELECT count(*) // {LENGTH} // 2 FROM stream)"),
        "window_lookup_in_shards": _window_rows(
            0, 0, where=f"pos < {val_tokens}", keep=f"seq_idx = {SHARD_SIZE // LENGTH}"
        ),
        "seq_count": f"""{STREAM}
            SELECT epoch::INTEGER AS epoch, epoch % {PHASES} * {LENGTH} // {PHASES} AS "offset",
                   greatest(n - epoch % {PHASES} * {LENGTH} // {PHASES}, 0) // {LENGTH} AS num_sequences
            FROM (SELECT count(*) AS n FROM stream), (SELECT unnest(range(8)) AS epoch)""",
        "keyed_permutation": f"""{_recursive(STREAM)}, {_windows()}, {_keyed("win")}
            SELECT seq_idx, pos, seq_idx AS back, id AS first_id FROM win JOIN keyed USING (seq_idx) WHERE spot = 0""",
        "keyed_resume": f"""{_recursive(STREAM)}, {_windows(OFFSET, shift=val_tokens)}, {_masked(0.30)}, {_keyed("win")}
            SELECT (pos - n * 9 // 10) // {BATCH} AS batch_id, ((pos - n * 9 // 10) % {BATCH})::INTEGER AS pos_in_batch, seq_idx,
                   {_join(HIDDEN, "spot")} AS input_ids, {_join("label", "spot")} AS labels
            FROM masked JOIN keyed USING (seq_idx), sides WHERE pos >= n * 9 // 10
            GROUP BY seq_idx, pos, n""",
        "manifest_generations": f"""{STREAM}
            SELECT g::BIGINT AS generation, printf('fineweb_%s_%06d.bin', CASE WHEN i < {VAL_SHARDS} THEN 'val' ELSE 'train' END, i) AS name,
                   count(*) AS tokens
            FROM (SELECT g, pos // size AS i FROM stream, (VALUES (1, {SHARD_SIZE}), (2, {SHARD_SIZE // 2})) AS t(g, size))
            GROUP BY g, i""",
        "windows_stream": f"SELECT seq_idx, input_ids FROM ({_window_rows(0, 0, shift=val_tokens)})",
        "epoch_permutation": f"{ORDERED} SELECT {EPOCH}::INTEGER AS epoch, seq_idx, pos, first_id FROM firsts",
        "resume_tail": f"{ORDERED} SELECT pos, seq_idx, first_id FROM firsts, total WHERE pos >= n // 3",
        "state_roundtrip": f"{ORDERED} SELECT pos, seq_idx, first_id FROM firsts, total WHERE pos >= n // 5 * 3",
        "rank_stripes_drop": _stripes(3, True),
        "rank_stripes_pad": _stripes(7, False),
        "batches_drop_last": f"""{ORDERED}
            SELECT pos // {BATCH} AS batch_id, (pos % {BATCH})::INTEGER AS pos_in_batch, seq_idx, first_id
            FROM firsts, total WHERE pos < n // {BATCH} * {BATCH}""",
        "loader_order": f"""{ORDERED},
            rest AS (SELECT seq_idx, first_id, unnest(range(pos - 10, (n - 10 + 2) // 3 * 3, n - 10)) AS pos
                     FROM firsts, total WHERE pos >= 10)
            SELECT (pos % 3)::INTEGER AS rank, pos // 3 // {BATCH} AS batch_id,
                   (pos // 3 % {BATCH})::INTEGER AS pos_in_batch, seq_idx, first_id FROM rest""",
        "state_resume": f"""{ORDERED},
            newest AS (SELECT user_id AS run, max(event_id) AS step FROM events GROUP BY user_id)
            SELECT run, pos AS index, n - pos AS num_left, seq_idx, first_id
            FROM newest, total JOIN firsts ON pos = step % n""",
        "latest_state": """
            WITH named AS (
              SELECT user_id AS run, 'step_' || event_id || CASE WHEN event_type = 'error' THEN '.tmp' ELSE '.pt' END
                     AS name FROM events),
            numbered AS (
              SELECT run, name, CASE WHEN regexp_matches(name, '^step_[0-9]+\\.pt$')
                                     THEN regexp_extract(name, '[0-9]+')::BIGINT END AS step FROM named)
            SELECT run, max(step) AS step, arg_max(name, step) AS name FROM numbered GROUP BY run""",
        "pad_batches": f"""{_padded("1")}
            SELECT batch_id, (doc_id % {BATCH})::INTEGER AS pos_in_batch, count(*)::INTEGER AS length,
                   {_join("id", "place")} AS input_ids
            FROM padded GROUP BY batch_id, doc_id""",
        "padded_lengths": f"{DOC_BATCHES} SELECT batch_id, padded_length FROM lengths",
        "batch_assembly": f"""{PERMUTED}, {_windows()},
            joined AS (SELECT pos // {BATCH} AS batch_id, pos % {BATCH} AS p, seq_idx, {_join("id", "spot")} AS ids
                       FROM win JOIN perm USING (seq_idx), total WHERE pos < n // {BATCH} * {BATCH}
                       GROUP BY pos, seq_idx)
            SELECT batch_id, {_join("seq_idx", "p")} AS seq_idx, {_join("ids", "p")} AS input_ids
            FROM joined GROUP BY batch_id""",
        "attention_mask": f"""{_padded("1")}
            SELECT doc_id AS seq_idx, {_join("(id <> 1)::INTEGER", "place", "")} AS attention_mask
            FROM padded GROUP BY doc_id""",
        "special_mask": f"""{STREAM}, {_windows()}
            SELECT seq_idx, {_join("(id IN (0, 1, 2))::INTEGER", "spot", "")} AS special_mask
            FROM win GROUP BY seq_idx""",
        "mlm_mask": f"""{STREAM}, {_windows()}, {_masked(0.30)}
            SELECT seq_idx, {_join(HIDDEN, "spot")} AS input_ids,
                   {_join("(id <> 1)::INTEGER", "spot", "")} AS attention_mask, {_join("label", "spot")} AS labels
            FROM masked GROUP BY seq_idx""",
        "electra_inputs": f"""{STREAM}, {_windows()}, {_masked(0.15)}
            SELECT seq_idx, {_join("id", "spot")} AS input_ids, {_join(HIDDEN, "spot")} AS masked_input_ids,
                   {_join("(id <> 1)::INTEGER", "spot", "")} AS attention_mask, {_join("label", "spot")} AS mlm_labels,
                   {_join("(label <> -100)::INTEGER", "spot", "")} AS is_masked
            FROM masked GROUP BY seq_idx""",
        "mask_counts": f"""{STREAM}, {_windows()}, {_masked(0.30)}
            SELECT seq_idx // {BATCH} AS batch_id, count(*) FILTER (label <> -100) AS num_masked,
                   count(*) FILTER (id NOT IN (0, 1, 2)) AS num_eligible,
                   round(count(*) FILTER (label <> -100) / count(*) FILTER (id NOT IN (0, 1, 2)), 9) AS ratio
            FROM masked GROUP BY batch_id""",
        "mlm_batches": f"""{STREAM}, {_windows(OFFSET, shift=val_tokens)}, {_masked(0.30)},
            total AS (SELECT max(seq_idx) + 1 AS n FROM win),
            perm AS (
              SELECT seq_idx, row_number() OVER (ORDER BY {_key("1", str(SEED + EPOCH), "seq_idx")}, seq_idx) - 1 AS pos
              FROM (SELECT DISTINCT seq_idx FROM win))
            SELECT pos // {BATCH} AS batch_id, (pos % {BATCH})::INTEGER AS pos_in_batch, seq_idx,
                   {_join(HIDDEN, "spot")} AS input_ids, {_join("label", "spot")} AS labels
            FROM masked JOIN perm USING (seq_idx), total WHERE pos < n // {BATCH} * {BATCH}
            GROUP BY seq_idx, pos""",
        "span_budget": f"""{STREAM}
            SELECT doc_id, count(*)::INTEGER AS n, floor(count(*) * 0.15::DOUBLE)::INTEGER AS budget
            FROM ids GROUP BY doc_id""",
        "span_emit": f"""{STREAM}, {_windows()}, {EMITTED}, {_spans("fixed", LENGTH, 3)}
            SELECT seq_idx, i.input_ids, t.labels
            FROM (SELECT seq_idx, {_join("id", "spot")} AS input_ids FROM inputs GROUP BY seq_idx) i
            JOIN (SELECT seq_idx, {_join("id", "k, spot")} AS labels FROM targets GROUP BY seq_idx) t USING (seq_idx)""",
        "span_sampling": f"""{STREAM}, {_windows()}, {SAMPLED}
            SELECT seq_idx, {_join("len", "k")} AS lengths, {_join("start", "k")} AS starts,
                   {_join("len", "k")} AS used
            FROM sampled GROUP BY seq_idx""",
        "span_corruption": f"""{STREAM}, {_windows()}, {SAMPLED}, {_spans("sampled", LENGTH, 100)},
            gathered AS (
              SELECT seq_idx, i.ids, t.labels FROM
                (SELECT seq_idx, list(id ORDER BY spot) AS ids FROM inputs GROUP BY seq_idx) i
                JOIN (SELECT seq_idx, list(id ORDER BY k, spot) AS labels FROM targets GROUP BY seq_idx) t
                USING (seq_idx)),
            wide AS (
              SELECT seq_idx,
                     list_resize(ids, (max(len(ids)) OVER b + 7) // 8 * 8, 1) AS ids,
                     list_resize(labels, (max(len(labels)) OVER b + 7) // 8 * 8, -100) AS labels
              FROM gathered WINDOW b AS (PARTITION BY seq_idx // {BATCH}))
            SELECT seq_idx, array_to_string(ids, ',') AS input_ids,
                   array_to_string([(x <> 1)::INTEGER FOR x IN ids], '') AS attention_mask,
                   array_to_string(labels, ',') AS labels,
                   array_to_string([(x <> -100)::INTEGER FOR x IN labels], '') AS decoder_attention_mask
            FROM wide""",
        "target_padding": f"""{_padded("-100")}
            SELECT doc_id AS seq_idx, {_join("id", "place")} AS labels,
                   {_join("(id <> -100)::INTEGER", "place", "")} AS decoder_attention_mask
            FROM padded GROUP BY doc_id""",
        "valid_labels": f"""{STREAM}, {_windows()}, {_masked(0.30)}
            SELECT seq_idx, coalesce({_join("label", "spot")} FILTER (label <> -100), '') AS labels
            FROM masked GROUP BY seq_idx""",
        "eval_summary": f"""{STEPS},
            summed AS (SELECT run, sum(loss * coalesce(trunc(num_masked), 1))
                                   / greatest(sum(coalesce(trunc(num_masked), 1)), 1) AS eval_loss
                       FROM steps GROUP BY run)
            SELECT run, round(eval_loss, 6) AS eval_loss, round(exp(least(eval_loss, 100)), 3) AS perplexity
            FROM summed""",
        "train_summary": f"""{STEPS},
            prior AS (SELECT run, CASE WHEN run % 3 = 2 THEN 0.0 ELSE sum(loss) END AS loss_sum,
                             CASE run % 3 WHEN 0 THEN count(*) WHEN 1 THEN max(step) ELSE 0 END AS loss_steps
                      FROM steps WHERE event_type = 'signup' GROUP BY run),
            parts AS (SELECT * FROM prior
                      UNION ALL SELECT run, sum(loss), count(*) FROM steps WHERE event_type <> 'signup' GROUP BY run)
            SELECT run, sum(loss_steps)::BIGINT AS loss_steps,
                   round(sum(loss_sum) / greatest(sum(loss_steps), 1), 6) AS train_loss
            FROM parts GROUP BY run""",
        "running_loss": f"""{STEPS}
            SELECT run, step, round(avg(loss) OVER (PARTITION BY run ORDER BY step), 6) AS mean_loss FROM steps""",
        "log_cadence": f"""{STEPS}
            SELECT run, step, printf('step=%d loss=%.4f ppl=%.2f', step, loss, exp(least(loss, 100))) AS line
            FROM steps WHERE step % 10 = 0""",
        "eval_cadence": f"""{STEPS}
            SELECT run, step, round(exp(least(loss, 100)), 3) AS perplexity FROM steps WHERE (step + 1) % 25 = 0""",
        "masked_xent": f"""
            WITH scored AS (
              SELECT vec_id, vec_id // {BATCH} AS batch, label, embedding::DOUBLE[] AS logits,
                     vec_id % 3 = 0 OR vec_id // {BATCH} % 5 = 0 AS ignored FROM embeddings),
            top AS (SELECT *, list_max(logits) AS m FROM scored),
            lost AS (
              SELECT batch, CASE WHEN NOT ignored
                THEN m + ln(list_sum([exp(x - m) FOR x IN logits])) - logits[label + 1] END AS loss FROM top)
            SELECT batch, round(coalesce(avg(loss), 0), 6) AS loss,
                   nullif(count(loss), 0)::DOUBLE AS num_masked FROM lost GROUP BY batch""",
        "token_vector_lookup": LOOKED_UP,
        "token_vector_lookup_joined": LOOKED_UP,
        "masked_mean_pool": EMBEDDED,
        "embed_joined": EMBEDDED,
        "masked_mean_pool_states": """
            SELECT label, (d - 1)::INTEGER AS dim,
                   round(coalesce(sum(v::DOUBLE) FILTER (vec_id % 3 <> 0), 0) / greatest(count(*) FILTER (vec_id % 3 <> 0), 1e-9), 6) AS value
            FROM (SELECT vec_id, label, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS d FROM embeddings)
            GROUP BY label, d""",
        "mean_pool": """
            SELECT label, (d - 1)::INTEGER AS dim, round(avg(v::DOUBLE), 6) AS value
            FROM (SELECT label, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS d FROM embeddings)
            GROUP BY label, d""",
        "incremental_packing": CHUNKS,
    }
    # Other ways to the same result.
    same = {"mlm_sql": "mlm_mask", "masked_xent_blocks": "masked_xent", "asof_position_merged": "asof_position"}
    return found | {name: found[other] for name, other in same.items()}
