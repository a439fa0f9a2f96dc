"""DuckDB SQL for the queries of the catalogue, written apart from the operators."""

from __future__ import annotations

from .cases import BOXED

N = 14
_DIMS = range(N)


def _list(form: str) -> str:
    return ", ".join(form.format(i=i) for i in _DIMS)


def _sum(form: str) -> str:
    return " + ".join(form.format(i=i) for i in _DIMS)


def _weighed(prefix: str) -> str:
    """A sum that tells dimensions and clusters apart."""
    return f"CAST(sum(({' + '.join(f'{prefix}{i}::BIGINT * {i + 1}' for i in _DIMS)}) * (cluster_id + 1)) AS BIGINT) AS sum_{prefix}"


def _fixed(x: str) -> str:
    return f"CASE WHEN {x} <= -1 THEN -10000 ELSE CAST(TRUNC(LEAST(GREATEST({x}, 0::FLOAT), 1::FLOAT) * 10000::FLOAT + 0.5::FLOAT) AS INT) END"


_DIST = _sum("(q{i} - d{i})::BIGINT * (q{i} - d{i})::BIGINT")

_PLAIN = """WITH plain AS (
  SELECT *, CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS INT) AS k, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before,
    user_id % 10 AS u FROM events
), tx AS (
  SELECT event_id, CAST(event_type = 'error' AS INT) AS label, CAST(value * 20 AS FLOAT) AS amount, CAST(event_id % 12 + 1 AS FLOAT) AS installments, ts, before,
    CAST((user_id % 40 + 1) * 25 AS FLOAT) AS avg_amount, CAST(event_id % 23 AS FLOAT) AS recent, k % 10 IN (u, (u + 1) % 10, (u + 3) % 10) AS known,
    ['5411','5812','5912','5944','7801','7802','7995','4511','5311','5999','9999','0000'][k % 12 + 1] AS mcc, CAST((k + 1) * 30 AS FLOAT) AS shop_amount,
    event_type IN ('click', 'view') AS online, event_type = 'purchase' AS present, CAST((event_id % 1300)::DOUBLE * 0.8::DOUBLE AS FLOAT) AS home_km,
    CAST((event_id % 700)::DOUBLE * 1.7::DOUBLE AS FLOAT) AS last_km, extract(hour FROM ts) AS hour, isodow(ts) - 1 AS weekday,
    CASE WHEN before IS NULL THEN 0 ELSE GREATEST(0, date_diff('minute', date_trunc('minute', before), date_trunc('minute', ts))) END AS minutes,
    CASE k % 12 WHEN 0 THEN 0.15 WHEN 1 THEN 0.30 WHEN 2 THEN 0.20 WHEN 3 THEN 0.45 WHEN 4 THEN 0.80 WHEN 5 THEN 0.75 WHEN 6 THEN 0.85 WHEN 7 THEN 0.35
      WHEN 8 THEN 0.25 ELSE 0.50 END::FLOAT AS risk, u, user_id
  FROM plain
)"""
_FEATURES = [
    "amount / 10000::FLOAT", "installments / 12::FLOAT", "(amount / avg_amount) / 10::FLOAT", "hour::FLOAT / 23::FLOAT", "weekday::FLOAT / 6::FLOAT",
    "CASE WHEN before IS NULL THEN -1::FLOAT ELSE LEAST(minutes::FLOAT / 1440::FLOAT, 1::FLOAT) END",
    "CASE WHEN before IS NULL THEN -1::FLOAT ELSE LEAST(last_km / 1000::FLOAT, 1::FLOAT) END",
    "home_km / 1000::FLOAT", "recent / 20::FLOAT", "CASE WHEN online THEN 1::FLOAT ELSE 0::FLOAT END", "CASE WHEN present THEN 1::FLOAT ELSE 0::FLOAT END",
    "CASE WHEN known THEN 0::FLOAT ELSE 1::FLOAT END", "risk", "shop_amount / 10000::FLOAT",
]
_TX = f"{_PLAIN}, qx AS (SELECT event_id, label, {', '.join(f'{_fixed(x)} AS d{i}' for i, x in enumerate(_FEATURES))} FROM tx)"
_EMB = f"""WITH qx AS (SELECT vec_id AS event_id, CAST(label < 3 AS INT) AS label, {', '.join(f'{_fixed(f"embedding[{i + 1}]")} AS d{i}' for i in _DIMS)} FROM embeddings)"""
_PAIRS = f"""qs AS (SELECT event_id AS qid, {_list('d{i} AS q{i}')} FROM qx WHERE event_id % 100 = 0),
pairs AS (SELECT qid, event_id AS nid, label, {_DIST} AS dist FROM qs, qx),
near AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, nid) AS rank FROM pairs QUALIFY rank <= 5),
others AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, nid) AS rank FROM pairs WHERE nid <> qid QUALIFY rank <= 5),
votes AS (SELECT qid, CAST(sum(label) AS INT) AS fraud_count FROM others GROUP BY qid)"""


def _dim(rows: str, group: str) -> str:
    """The widest dimension of each group."""
    variance = [f"sum(d{i}::BIGINT * d{i}::BIGINT)::DOUBLE / count(*)::DOUBLE - (sum(d{i}::BIGINT)::DOUBLE / count(*)::DOUBLE) * (sum(d{i}::BIGINT)::DOUBLE / count(*)::DOUBLE)" for i in _DIMS]
    return f"SELECT {group}, count(*) AS n, list_position(v, list_max(v)) AS dim FROM (SELECT {group}, [{', '.join(variance)}] AS v, count(*) AS c FROM {rows} GROUP BY {group}) s JOIN {rows} USING ({group}) GROUP BY {group}, v"


def _halve(name: str, rows: str, offset: int) -> str:
    return f"""{name}_dim AS ({_dim(rows, 'node')}),
{name} AS (SELECT event_id, label, {_list('d{i}')}, node + CASE WHEN row_number() OVER (PARTITION BY node ORDER BY [{_list('d{i}')}][dim], event_id) > n // 2 THEN {offset} ELSE 0 END AS node
  FROM {rows} JOIN {name}_dim USING (node))"""


_K4 = f"""{_EMB}, level0 AS (SELECT *, 0 AS node FROM qx),
{_halve('level1', 'level0', 2)},
{_halve('level2', 'level1', 1)},
stats AS (SELECT node AS cluster_id, count(*) AS n_rows, {_list('CAST((sum(d{i}::BIGINT) + count(*) // 2) // count(*) AS INT) AS c{i}')}, {_list('min(d{i}) AS lo{i}')}, {_list('max(d{i}) AS hi{i}')} FROM level2 GROUP BY node),
qs AS (SELECT event_id AS qid, {_list('d{i} AS q{i}')} FROM qx WHERE event_id % 100 = 0),
ranks AS (SELECT qid, cluster_id, {_sum('(q{i} - c{i})::BIGINT * (q{i} - c{i})::BIGINT')} AS dist, row_number() OVER (PARTITION BY qid ORDER BY dist, cluster_id) AS probe_rank FROM qs, stats)"""

_P03 = """(q5 = -10000 AND q6 = -10000 AND ((q9 = 10000 AND q10 = 0 AND q7 BETWEEN 800 AND 900 AND q2 BETWEEN 1000 AND 2000 AND q12 = 2000)
 OR (q9 = 0 AND q10 = 10000 AND q7 BETWEEN 3500 AND 4000 AND q2 = 10000 AND q12 = 8000 AND q8 <= 4000)))"""



def _clusters(rows: str, levels: int, more: str = "", members: str = "TRUE") -> str:
    """2 ** levels clusters of the rows that are ``members``, their centres, and the queries."""
    steps = ",\n".join(_halve(f"level{n + 1}", f"level{n}", (1 << levels) >> (n + 1)) for n in range(levels))
    return f"""{rows}, level0 AS (SELECT *, 0 AS node FROM qx WHERE {members}),
{steps},
stats AS (SELECT node AS cluster_id, count(*) AS n_rows, {_list('CAST((sum(d{i}::BIGINT) + count(*) // 2) // count(*) AS INT) AS c{i}')} FROM level{levels} GROUP BY node),
qs AS (SELECT event_id AS qid, {_list('d{i} AS q{i}')} FROM qx WHERE event_id % 100 = 0{more})"""


_WIDE = f"""{_P03} OR (q9 >= 10000 AND q10 = 0 AND q2 >= 5000 AND q7 BETWEEN 3000 AND 3600 AND (q12 = 3000 OR q12 >= 8500))"""
_LATE = """q9 = 10000 AND q10 = 0 AND q11 = 0 AND q12 = 3000 AND q2 = 10000 AND q5 BETWEEN 250 AND 350 AND q6 BETWEEN 300 AND 450 AND q7 BETWEEN 3300 AND 3500
 AND q8 = 2000 AND q0 BETWEEN 1400 AND 1550"""
_DENY = "q5 = -10000 AND q6 = -10000 AND q9 = 0 AND q10 = 10000 AND q7 <= 1000 AND q2 BETWEEN 5000 AND 10000 AND q12 = 2500"


def _policy(levels: int, probes: int, ambiguous: int, most: int, more: str = "", members: str = "TRUE", copies: int = 2) -> str:
    """qid and fraud_count: ``probes``, then (ambiguous) the exact neighbours, then (by the predicates) ``most`` probes, where a neighbour of a cluster of rank ``ambiguous`` + 1 to ``most`` counts twice (``copies`` 1: once)."""
    n = 1 << levels
    return f"""{_clusters(_TX, levels, more, members)},
ranks AS (SELECT qid, cluster_id, row_number() OVER (PARTITION BY qid ORDER BY {_sum('(q{i} - c{i})::BIGINT * (q{i} - c{i})::BIGINT')}, cluster_id) AS r FROM qs, stats),
pairs AS (SELECT qid, r, label, event_id AS nid, {_DIST} AS dist FROM qs JOIN ranks USING (qid) JOIN level{levels} ON node = cluster_id WHERE event_id <> qid),
top AS (SELECT qid, upto, r, label, nid, dist, row_number() OVER (PARTITION BY qid, upto ORDER BY dist, nid) AS n FROM pairs, (VALUES ({probes}), ({most}), ({n})) t(upto) WHERE r <= upto QUALIFY n <= 5),
counts AS (SELECT qid, upto, sum(label) AS f FROM top GROUP BY ALL),
twice AS (SELECT qid, label, row_number() OVER (PARTITION BY qid ORDER BY dist, nid, copy) AS n FROM top, range({copies}) c(copy) WHERE upto = {n} AND (copy = 0 OR r BETWEEN {ambiguous + 1} AND {most}) QUALIFY n <= 5),
doubled AS (SELECT qid, sum(label) AS f FROM twice GROUP BY qid),
first AS (SELECT qid, f AS f1, f BETWEEN 2 AND 4 OR (f = 1 AND q9 = 0) AS unsure FROM counts JOIN qs USING (qid) WHERE upto = {probes}),
second AS (SELECT qid, unsure, CASE WHEN unsure THEN f ELSE f1 END AS f2 FROM first JOIN counts USING (qid) WHERE upto = {n}),
third AS (SELECT s.qid, f2, CASE WHEN unsure THEN d.f ELSE c.f END AS f3 FROM second s JOIN counts c ON s.qid = c.qid AND c.upto = {most} JOIN doubled d ON s.qid = d.qid)
SELECT qid, CAST(CASE WHEN f2 < 3 AND ({_WIDE}) THEN CASE WHEN f3 < 3 AND {_LATE} THEN 3 ELSE f3 END WHEN f2 >= 3 AND {_DENY} THEN f3 ELSE f2 END AS INT) AS fraud_count
FROM third JOIN qs USING (qid)"""


def _answers(copies: int, more: str = "") -> str:
    """The answers to every hundredth transaction by an index of the others."""
    return f"""SELECT event_id, parse_ok, fraud_count, fraud_count < 3 AS approved,
      '{{"approved":' || CASE WHEN fraud_count < 3 THEN 'true' ELSE 'false' END || ',"fraud_score":' || CAST(fraud_count / 5.0::DOUBLE AS VARCHAR) || '}}' AS response
    FROM (SELECT qid AS event_id, TRUE AS parse_ok, fraud_count FROM ({_policy(4, 2, 4, 8, members="event_id % 100 <> 0", copies=copies)}){more})"""


_BOXED = " UNION ALL SELECT * FROM (VALUES " + ", ".join(str((-1 - i, *q)) for i, q in enumerate(BOXED)) + ") b"

#: What is read from the texts of cases.py that are taken, by their number; all others are refused.
_GRAMMAR = """SELECT CAST(c AS INT) AS case_id, coalesce(ok, FALSE) AS parse_ok, CAST(installments AS BIGINT) AS installments, CAST(cents AS INT) AS cents, known, merchant, mcc, is_online, coalesce(has_last, FALSE) AS has_last
FROM range(58) n(c) LEFT JOIN (VALUES
  (0, TRUE, 3, 150, NULL, NULL, NULL, NULL, FALSE), (1, TRUE, 2, NULL, NULL, NULL, NULL, NULL, FALSE), (2, TRUE, 4, NULL, NULL, NULL, NULL, NULL, FALSE), (3, TRUE, 5, NULL, NULL, NULL, NULL, NULL, FALSE),
  (11, TRUE, NULL, NULL, NULL, NULL, NULL, NULL, FALSE), (12, TRUE, NULL, NULL, NULL, NULL, NULL, NULL, TRUE), (21, TRUE, 12, NULL, NULL, NULL, NULL, NULL, FALSE), (22, TRUE, -3, NULL, NULL, NULL, NULL, NULL, FALSE),
  (31, TRUE, 7, 725, NULL, NULL, NULL, NULL, FALSE), (32, TRUE, NULL, -5, NULL, NULL, NULL, NULL, FALSE), (41, TRUE, NULL, NULL, '', NULL, NULL, NULL, FALSE), (42, TRUE, NULL, NULL, 'a,b', NULL, NULL, NULL, FALSE),
  (46, TRUE, NULL, NULL, NULL, '007, }', '0042', NULL, FALSE), (49, TRUE, NULL, NULL, NULL, NULL, NULL, TRUE, FALSE), (51, TRUE, 6, NULL, NULL, NULL, NULL, NULL, FALSE), (52, TRUE, NULL, NULL, NULL, NULL, NULL, NULL, FALSE)
) t(n, ok, installments, cents, known, merchant, mcc, is_online, has_last) ON n = c"""

ORACLES: dict[str, str] = {
    "score_transactions": f"{_TX}, {_PAIRS} SELECT qid AS event_id, fraud_count, fraud_count / 5.0::DOUBLE AS fraud_score, fraud_count < 3 AS approved FROM votes",
    "tx_features": f"{_TX} SELECT event_id, {_list('d{i} AS q{i}')} FROM qx",
    "quantize_embeddings": f"{_EMB} SELECT event_id AS vec_id, {_list('d{i} AS q{i}')} FROM qx",
    "mcc_lookup": f"{_PLAIN} SELECT event_id, mcc, CAST(round(risk * 100) AS INT) AS risk_percent FROM tx",
    "known_merchants": f"{_PLAIN} SELECT event_id, known FROM tx",
    "minutes_between": f"{_PLAIN} SELECT event_id, CAST(minutes AS BIGINT) AS minutes FROM tx",
    "hour_weekday": f"{_PLAIN} SELECT event_id, CAST(hour AS INT) AS hour, CAST(weekday AS INT) AS weekday FROM tx",
    "payload_roundtrip": f"""{_PLAIN} SELECT event_id, TRUE AS parse_ok, event_id % 12 + 1 AS installments, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS requested_at, event_id % 23 AS tx_count_24h,
      concat_ws(',', u, (u + 1) % 10, (u + 3) % 10) AS known, CAST(plain.k % 10 AS VARCHAR) AS merchant, mcc, online AS is_online, present AS card_present, before IS NOT NULL AS has_last
      FROM tx JOIN (SELECT event_id, k FROM plain) plain USING (event_id)""",
    "payload_grammar": _GRAMMAR,
    "pairwise_l2": f"{_EMB}, {_PAIRS} SELECT qid, nid, dist FROM pairs",
    "knn5": f"{_EMB}, {_PAIRS} SELECT qid, CAST(rank AS INT) AS rank, nid, dist FROM near",
    "knn5_vote": f"{_EMB}, {_PAIRS} SELECT qid, fraud_count, fraud_count < 3 AS approved FROM votes",
    "max_variance_dim": f"{_EMB}, one AS (SELECT *, 0 AS node FROM qx), widest AS ({_dim('one', 'node')}) SELECT CAST(dim - 1 AS INT) AS dim FROM widest",
    "split_k4": f"{_K4} SELECT event_id AS vec_id, CAST(node AS INT) AS cluster_id FROM level2",
    "cluster_stats_k4": f"{_K4} SELECT * REPLACE (CAST(cluster_id AS INT) AS cluster_id) FROM stats",
    "top_centroids": f"{_K4} SELECT qid, CAST(probe_rank AS INT) AS probe_rank, CAST(cluster_id AS INT) AS cluster_id, dist FROM ranks",
    "ivf_probe_vote": f"""{_K4}, near AS (SELECT qid, label, {_DIST} AS dist, event_id AS nid, row_number() OVER (PARTITION BY qid ORDER BY {_DIST}, event_id) AS r
      FROM ranks JOIN qs USING (qid) JOIN level2 ON level2.node = ranks.cluster_id WHERE probe_rank <= 2 AND event_id <> qid QUALIFY r <= 5)
      SELECT qid, CAST(sum(label) AS INT) AS fraud_count FROM near GROUP BY qid""",
    "bbox_repair_vote": f"{_EMB}, {_PAIRS} SELECT qid, fraud_count, fraud_count < 3 AS approved FROM votes",
    "policy_flags": f"""{_TX}, q AS (SELECT event_id, {_list('d{i} AS q{i}')} FROM qx) SELECT event_id,
      {_P03} OR (q9 >= 10000 AND q10 = 0 AND q2 >= 5000 AND q7 BETWEEN 3000 AND 3600 AND (q12 = 3000 OR q12 >= 8500)) AS approval_repair, {_P03} AS boundary_approval,
      q9 = 10000 AND q10 = 0 AND q11 = 0 AND q12 = 3000 AND q2 = 10000 AND q5 BETWEEN 250 AND 350 AND q6 BETWEEN 300 AND 450 AND q7 BETWEEN 3300 AND 3500 AND q8 = 2000 AND q0 BETWEEN 1400 AND 1550 AS late_denial,
      q5 = -10000 AND q6 = -10000 AND q9 = 0 AND q10 = 10000 AND q7 <= 1000 AND q2 BETWEEN 5000 AND 10000 AND q12 = 2500 AS denial_repair, q9 = 0 AS ambiguous_at_1, TRUE AS ambiguous_at_3 FROM q""",
    **dict.fromkeys(("json_references", "flat_references"), f"{_EMB} SELECT row_number() OVER (ORDER BY event_id) - 1 AS orig_id, label, {_list('d{i} AS q{i}')} FROM qx"),
    "stratified_sample": """WITH rows AS (SELECT vec_id AS orig_id, CAST(label < 3 AS INT) AS label FROM embeddings),
      ranked AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY orig_id) - 1 AS i FROM rows),
      sizes AS (SELECT count(*) FILTER (label = 1) AS n1, count(*) FILTER (label = 0) AS n0 FROM rows),
      budgets AS (SELECT *, LEAST(CAST(floor(200 * 0.55::DOUBLE) AS BIGINT), n1) AS b1 FROM sizes), both_ AS (SELECT *, LEAST(200 - b1, n0) AS b0 FROM budgets),
      steps AS (SELECT *, CASE WHEN n1 > b1 THEN n1 // b1 ELSE 1 END AS s1, CASE WHEN n0 > b0 THEN n0 // b0 ELSE 1 END AS s0 FROM both_),
      picked AS (SELECT orig_id, label, i FROM ranked, steps WHERE i % (CASE label WHEN 1 THEN s1 ELSE s0 END) = 0 AND i // (CASE label WHEN 1 THEN s1 ELSE s0 END) < CASE label WHEN 1 THEN b1 ELSE b0 END)
      SELECT orig_id, label, row_number() OVER (ORDER BY i, label DESC) - 1 AS position FROM picked""",
    "ivf_faithful_vote": _policy(4, 2, 4, 8),
    "ivf_default_vote": _policy(8, 8, 24, 128, _BOXED),
    "payload_scores": _answers(1, " UNION ALL SELECT * FROM (VALUES (-1, FALSE, 0), (-2, FALSE, 0), (-3, FALSE, 0)) b"),
    "stream_scores": _answers(2),
    "index_roundtrip": f"""{_clusters(_EMB, 4)},
      boxes AS (SELECT node AS cluster_id, {_list('min(d{i}) AS lo{i}')}, {_list('max(d{i}) AS hi{i}')} FROM level4 GROUP BY node),
      c AS (SELECT count(*) AS clusters, CAST(sum(n_rows) AS BIGINT) AS n_rows, {_weighed('c')}, {_weighed('lo')}, {_weighed('hi')} FROM stats JOIN boxes USING (cluster_id)),
      m AS (SELECT count(*) AS members, CAST(sum(label) AS BIGINT) AS labels, CAST(sum(event_id * (cluster_id + 1)) AS BIGINT) AS sum_id, {_weighed('d')} FROM (SELECT *, node AS cluster_id FROM level4))
      SELECT version, c.*, m.*, 3 AS probes, 5 AS ambiguous_probes, 9 AS most_probes, TRUE AS repair FROM c, m, (VALUES ('built'), ('loaded')) t(version)""",
    "decision_table": "SELECT CAST(range AS INT) AS fraud_count, range / 5.0::DOUBLE AS fraud_score, range < 3 AS approved FROM range(6)",
}
