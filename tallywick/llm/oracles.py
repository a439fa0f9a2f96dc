"""DuckDB SQL for the queries of this subpackage that SQL can express; the others have plain versions in the tests."""

from __future__ import annotations

import math

from . import quality

_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_NORMAL = rf"regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

_RULES = {
    "symbols": "least(100, 100 * n_symbols // greatest(n_words, 1))",
    "dup_lines": "least(100, 100 * n_dup_lines // greatest(n_lines, 1))",
    "repeats": "least(100, 100 * n_repeat_words // greatest(n_words, 1))",
    "sameness": "least(100, 100 * (n_words - n_distinct) // greatest(n_words, 1))",
}
_EACH = quality.RISK / len(_RULES)
_LOST, _KEPT = math.log(_EACH), math.log(1 - _EACH)
_BINS = " UNION ALL ".join(f"SELECT stratum, '{r}' AS rule, {r} AS cutoff, good FROM holdout" for r in _RULES)
_WIDE = ", ".join(f"min(cutoff) FILTER (rule = '{r}') AS cut_{r}" for r in _RULES)
_OVER = " OR ".join(f"coalesce({r} >= cut_{r}, FALSE)" for r in _RULES)

_OP3 = rf"""WITH w AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
runs AS (SELECT rid, s, array_to_string(words[s:s + 7], ' ') AS run FROM w, unnest(range(1, len(words) - 6)) t(s) WHERE len(words) >= 8),
twice AS (SELECT rid, s FROM runs QUALIFY count(*) OVER (PARTITION BY rid, run) > 1),
cover AS (SELECT rid, count(DISTINCT p) AS n FROM twice, unnest(range(s, s + 8)) t(p) GROUP BY rid),
m AS (SELECT rid, doc_id, stratum, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines, len(list_distinct(words)) AS n_distinct, coalesce(cover.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN cover USING (rid)),
d AS (SELECT * EXCLUDE (lines), len(lines) AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words AS base_failed FROM m),
s AS (SELECT *, {", ".join(f"{v} AS {k}" for k, v in _RULES.items())} FROM d),
known AS (SELECT doc_id, min(quality) > 0 AS good FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id),
holdout AS (SELECT * FROM s JOIN known USING (doc_id) WHERE NOT base_failed),
tests AS (SELECT greatest(1, count(DISTINCT stratum)) * {len(_RULES)} AS n FROM holdout),
bins AS (SELECT stratum, rule, cutoff, count(*) FILTER (good) AS good, count(*) FILTER (NOT good) AS bad FROM ({_BINS}) GROUP BY ALL),
sums AS (SELECT stratum, rule, cutoff, (sum(good) OVER (PARTITION BY stratum, rule))::BIGINT AS n_good, (sum(good) OVER up)::BIGINT AS n_lost, (sum(bad) OVER up)::BIGINT AS n_caught FROM bins
  WINDOW up AS (PARTITION BY stratum, rule ORDER BY cutoff DESC ROWS UNBOUNDED PRECEDING)),
fit AS (SELECT * FROM sums, tests WHERE cutoff > 0 AND n_lost < {_EACH} * n_good AND n_caught > {quality.COST} * n_lost
  AND list_sum(list_transform(range(0, n_lost + 1), lambda i: exp(lgamma(n_good + 1) - lgamma(i + 1) - lgamma(n_good - i + 1) + i * {_LOST} + (n_good - i) * {_KEPT}))) <= {quality.DELTA} / n
  QUALIFY row_number() OVER (PARTITION BY stratum, rule ORDER BY n_caught - {quality.COST} * n_lost DESC, cutoff DESC) = 1),
cuts AS (SELECT stratum, {_WIDE} FROM fit GROUP BY stratum)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT ({_OVER}) AS kept FROM s LEFT JOIN cuts USING (stratum)"""

_OP5 = r"""WITH turns AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, i, CASE i WHEN 0 THEN 'user' ELSE 'assistant' END, '<|im_end|><|im_start|>assistant ok' FROM range(2) t(i))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(role) + length(text) + len(regexp_extract_all(text, '<\\*\|')) + length('<|im_start|><|im_end|>') + 2) AS BIGINT) AS formatted_chars
FROM turns GROUP BY conv_id"""

_OP7 = rf"""WITH dw AS (SELECT row_number() OVER () AS rid, doc_id, {_NORMAL} AS w FROM documents),
iw AS (SELECT item_id, {_NORMAL} AS w FROM benchmark),
wins AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[s:s + least(len(w), 10) - 1], ' ') AS gram FROM iw, unnest(range(1, greatest(len(w) - 9, 1) + 1)) t(s) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM wins),
grams AS (SELECT rid, s, n, array_to_string(w[s:s + n - 1], ' ') AS gram FROM dw, sizes, unnest(range(1, len(w) - n + 2)) t(s) WHERE len(w) >= n),
hits AS (SELECT rid, s, n, item_id FROM grams JOIN wins USING (gram, n)),
cover AS (SELECT rid, count(DISTINCT p) AS n_hit FROM hits, unnest(range(s, s + n)) t(p) GROUP BY rid),
names AS (SELECT rid, count(DISTINCT item_id) AS n_items, array_to_string(list_sort(list(DISTINCT CAST(item_id AS VARCHAR)) FILTER (item_id IS NOT NULL)), ',') AS ids FROM hits GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN cover USING (rid) LEFT JOIN names USING (rid)"""

_OP8 = """WITH RECURSIVE entries AS (SELECT n, list_reduce(list_prepend(n::BIGINT, range(8)::BIGINT[]), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS e FROM range(256) t(n)),
crc_table AS (SELECT list(e ORDER BY n) AS t FROM entries),
rows AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
plain AS (SELECT doc_id, length(h) // 2 + 1 AS size,
  xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, length(h), 2), lambda i: ('0x' || substr(h, i + 1, 2))::BIGINT)), lambda c, b: xor(c >> 8, t[CAST(xor(c, b) & 255 AS BIGINT) + 1])), 4294967295) AS text_crc32
  FROM rows, crc_table),
records AS (SELECT *, concat_ws('/', coalesce(CAST(doc_id AS VARCHAR), ''), size, text_crc32) AS record, row_number() OVER (PARTITION BY doc_id, size, text_crc32) - 1 AS copy FROM plain),
keyed AS (SELECT *, ('0x' || substr(md5(record || CASE WHEN copy > 0 THEN '/' || copy ELSE '' END), 1, 7))::BIGINT AS bits FROM records),
sized AS (SELECT doc_id, size, text_crc32, bits % 4096 AS virtual_slot, (bits // 4096) % 16 AS cell FROM keyed),
slots AS (SELECT virtual_slot, CAST(sum(size) AS BIGINT) AS bytes, row_number() OVER (ORDER BY sum(size) DESC, virtual_slot) AS n FROM sized GROUP BY virtual_slot),
deal(n, virtual_slot, shard, loads) AS (
  SELECT 0::BIGINT, -1::BIGINT, -1::BIGINT, list_transform(range(16), lambda i: 0::BIGINT)
  UNION ALL SELECT s.n, s.virtual_slot, list_position(loads, list_min(loads))::BIGINT - 1,
    list_transform(loads, lambda x, i: CASE WHEN i = list_position(loads, list_min(loads)) THEN x + bytes ELSE x END) FROM deal JOIN slots s ON s.n = deal.n + 1)
SELECT doc_id, size, text_crc32, 'bytes' AS law, CAST(shard AS INT) AS shard, row_number() OVER (PARTITION BY shard ORDER BY sized.virtual_slot, cell, doc_id, size, text_crc32) - 1 AS slot,
  CAST(NULL AS INT) AS grown_shard, CAST(sized.virtual_slot AS INT) AS virtual_slot, 1 AS map_version FROM sized JOIN deal ON deal.virtual_slot = sized.virtual_slot"""

ORACLES: dict[str, str] = {
    "op3_quality_rules": _OP3,
    "op5_chat_formatting": _OP5,
    "op7_benchmark_decontamination": _OP7,
    "op8_sharding": _OP8,
}
