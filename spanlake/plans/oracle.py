"""ANSI SQL for DuckDB: the same results, computed the direct way.

``CTE`` holds named building blocks; :func:`sql` puts a final SELECT behind the
blocks it needs. The fixed values restate those of sources/tabular.py.
"""

from __future__ import annotations

import re

BASE = 1_704_151_800
BASE_US = BASE * 1_000_000
W = 60
L = 900


def tid(key: str) -> str:
    return f"rpad(reverse(lower(to_hex(({key}) + 1))), 32, '0')"


def sid(key: str, line: str) -> str:
    return f"rpad(reverse(lower(to_hex(({key}) * 16 + ({line}) + 1))), 16, '0')"


def start_us(key: str) -> str:
    return f"({BASE_US} + (({key}) * 400000) % 2592000000000)"


def minute(us: str) -> str:
    return f"((({us}) - {BASE_US}) // 60000000)"


def u01(*parts: str) -> str:
    return f"(('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 8))::BIGINT / 4294967296.0)"


CTE: dict[str, str] = {}

CTE["root_rows"] = f"""
SELECT o_orderkey AS key, {tid('o_orderkey')} AS trace_id, {sid('o_orderkey', '0')} AS span_id, '' AS parent_span_id,
  'frontend' AS service_name, {start_us('o_orderkey')} AS s_us,
  (350000 + (o_custkey % 1500) * 100)
    * CASE WHEN {minute(start_us('o_orderkey'))} % 23 IN (14, 15) THEN 3 ELSE 1 END AS d_us,
  CASE WHEN o_orderkey % 50 = 0 THEN 2 ELSE 1 END AS status_code, 2000000 AS delay_us, 'priority=' || o_orderpriority AS attributes
FROM orders"""

CTE["line_base"] = f"""
SELECT *, {start_us('key')} + ln * 15000 + pk % 997 - CASE WHEN service_name = 'inventory' THEN 40000 ELSE 0 END AS s_us
FROM (SELECT l_orderkey AS key, l_linenumber::BIGINT AS ln, l_partkey AS pk, l_suppkey AS sk, l_quantity::BIGINT AS qty, 'flag=' || l_returnflag AS attributes,
  CASE l_linenumber WHEN 1 THEN 'checkout' WHEN 2 THEN 'catalog'
    WHEN 3 THEN CASE WHEN l_suppkey % 2 = 0 THEN 'payments' ELSE 'inventory' END
    WHEN 4 THEN 'inventory' WHEN 5 THEN 'shipping' WHEN 6 THEN 'search' WHEN 7 THEN 'notifications' END AS service_name
  FROM lineitem)"""

CTE["line_rows"] = f"""
SELECT key, {tid('key')} AS trace_id, {sid('key', 'ln')} AS span_id,
  CASE WHEN key % 101 = 3 AND ln = 5 THEN {sid('key', 'ln')}
       WHEN key % 97 = 5 AND ln = 1 THEN {sid('key', '3')}
       WHEN key % 89 = 7 AND ln = 2 THEN ''
       ELSE {sid('key', '(ln - 1) // 2')} END AS parent_span_id,
  service_name, s_us,
  (CASE WHEN ln <= 2 THEN 120000 WHEN ln <= 6 THEN 40000 ELSE 0 END + qty * 1000 + (sk % 89) * 10)
    * CASE WHEN {minute('s_us')} % 23 IN (14, 15) AND ln = 5 THEN 8
           WHEN {minute('s_us')} % 23 IN (14, 15) AND ln = 2 THEN 4 ELSE 1 END AS d_us,
  CASE WHEN ({minute('s_us')} % 19 = 15 AND ln = 6 AND sk % 2 = 0) OR pk % 40 = 0 THEN 2 ELSE 1 END AS status_code,
  CASE WHEN key % 29 = 0 AND ln = 3 THEN 120000000 ELSE 2000000 + (pk % 1009) * 1000 END AS delay_us, attributes
FROM line_base"""

_COLUMNS = """key, trace_id, span_id, parent_span_id, service_name, 'handle ' || service_name AS span_name,
  s_us * 1000 AS start_ns, (s_us + d_us) * 1000 AS end_ns, status_code, (s_us + d_us + delay_us) * 1000 AS ingested_ns, attributes"""
_NEWEST = """row_number() OVER (PARTITION BY trace_id, span_id ORDER BY ingested_ns DESC, parent_span_id DESC,
  service_name DESC, span_name DESC, start_ns DESC, end_ns DESC, status_code DESC, attributes DESC)"""

CTE["sent"] = f"SELECT {_COLUMNS} FROM (SELECT * FROM root_rows UNION ALL SELECT * FROM line_rows)"
CTE["raw_lines"] = f"""
SELECT {_COLUMNS} FROM line_rows WHERE NOT (service_name = 'payments' AND {minute('s_us')} % 17 = 12)"""
CTE["raw"] = f"SELECT {_COLUMNS} FROM root_rows WHERE key % 13 <> 4 UNION ALL SELECT * FROM raw_lines"
#: For streams: only spans that had arrived when their window closed.
SEEN_RAW = f"""
SELECT * FROM (SELECT {_COLUMNS} FROM root_rows WHERE key % 13 <> 4 UNION ALL SELECT * FROM raw_lines)
WHERE ingested_ns <= (start_ns // 60000000000 * 60 + 90) * 1000000000"""
CTE["received"] = CTE["raw"]
CTE["closed"] = "SELECT (max(ingested_ns) - 30000000000) // 60000000000 * 60 AS until FROM received"
CTE["spans"] = f"""
SELECT *, (start_ns // 60000000000) * 60 AS window_start
FROM (SELECT *, {_NEWEST} AS newest FROM raw) WHERE newest = 1"""
CTE["line_spans"] = f"""
SELECT *, (start_ns // 60000000000) * 60 AS window_start
FROM (SELECT *, {_NEWEST} AS newest FROM raw_lines) WHERE newest = 1"""
CTE["any_pairs"] = """
SELECT c.trace_id, p.span_id AS parent_id, c.span_id AS child_id, p.window_start AS p_window, c.window_start,
  p.service_name AS caller, c.service_name AS callee, p.start_ns AS p_start, p.end_ns AS p_end,
  c.start_ns AS c_start, c.end_ns AS c_end, c.status_code
FROM spans c JOIN spans p ON p.trace_id = c.trace_id AND p.span_id = c.parent_span_id WHERE c.parent_span_id <> ''"""
CTE["pairs"] = "SELECT * FROM any_pairs WHERE p_window = window_start"
CTE["kinds"] = """
SELECT s.*, CASE WHEN s.parent_span_id = '' THEN 'root' WHEN p.span_id IS NULL THEN 'orphan' ELSE 'linked' END AS kind
FROM spans s LEFT JOIN spans p
  ON p.trace_id = s.trace_id AND p.window_start = s.window_start AND p.span_id = s.parent_span_id AND s.parent_span_id <> ''"""
CTE["walk"] = """
SELECT trace_id, window_start, span_id, span_id AS seed, kind AS seed_kind, 0::BIGINT AS dist FROM kinds WHERE kind <> 'linked'
UNION ALL
SELECT k.trace_id, k.window_start, k.span_id, w.seed, w.seed_kind, w.dist + 1
FROM walk w JOIN kinds k ON k.trace_id = w.trace_id AND k.window_start = w.window_start AND k.parent_span_id = w.span_id
  AND k.kind = 'linked'"""
CTE["seeds"] = """
SELECT k.*, w.seed, w.seed_kind, w.dist FROM kinds k LEFT JOIN walk w USING (trace_id, window_start, span_id)"""
CTE["classes"] = """
SELECT trace_id, span_id, window_start, CASE WHEN kind = 'orphan' THEN 'orphan_missing_parent'
  WHEN seed IS NULL THEN 'cycle_rejected' ELSE 'ok' END AS classification FROM seeds"""
CTE["canonical"] = """
SELECT trace_id, window_start, span_id AS root_span_id, service_name AS root_service FROM (
  SELECT *, row_number() OVER (PARTITION BY trace_id, window_start ORDER BY start_ns, span_id) AS rn
  FROM spans WHERE parent_span_id = '') WHERE rn = 1"""
CTE["summaries"] = """
SELECT *, incompleteness_reason = '' AS complete FROM (
  SELECT a.trace_id, a.window_start, coalesce(d.depth, 0)::INTEGER AS depth, span_count, coalesce(c.root_service, '') AS root_service,
    CASE WHEN roots = 0 THEN 'missing_root' WHEN roots > 1 THEN 'multiple_roots' WHEN orphan_count > 0 THEN 'orphan_missing_parent'
      WHEN cyclic > 0 THEN 'cycle_rejected' ELSE '' END AS incompleteness_reason, orphan_count
  FROM (SELECT trace_id, window_start, count(*) AS span_count, count(*) FILTER (kind = 'root') AS roots,
          count(*) FILTER (kind = 'orphan') AS orphan_count, count(*) FILTER (seed IS NULL) AS cyclic
        FROM seeds GROUP BY ALL) a
  LEFT JOIN canonical c USING (trace_id, window_start)
  LEFT JOIN (SELECT trace_id, window_start, seed AS root_span_id, max(dist) + 1 AS depth FROM walk GROUP BY ALL) d
    USING (trace_id, window_start, root_span_id))"""
_STATS = """count(*) AS call_count, count(*) FILTER (status_code = 2) AS error_count,
  quantile_cont(ms, 0.5) AS p50, quantile_cont(ms, 0.95) AS p95, quantile_cont(ms, 0.99) AS p99"""
CTE["calls"] = """
SELECT window_start, 'service' AS target_type, '' AS caller, service_name AS callee, service_name AS target,
  (end_ns - start_ns) / 1e6 AS ms, status_code, start_ns AS lo_ns, start_ns AS hi_ns, true AS same_window FROM spans
UNION ALL
SELECT window_start, 'edge', caller, callee, caller || '->' || callee, (c_end - c_start) / 1e6, status_code,
  least(p_start, c_start), greatest(p_start, c_start), p_window = window_start FROM any_pairs"""
CTE["stats"] = f"""
SELECT window_start, target_type, caller, callee, target, {_STATS} FROM calls WHERE same_window GROUP BY ALL"""
CTE["gaps"] = """
SELECT window_start, caller, callee, count(*) AS n, median(c_start - p_start) AS median_gap FROM pairs GROUP BY ALL"""
CTE["typical"] = """
SELECT window_start, median_gap AS typical_gap FROM (SELECT *, row_number() OVER (PARTITION BY window_start
  ORDER BY abs(median_gap), median_gap, caller, callee) AS rn FROM gaps) WHERE rn = 1"""
CTE["primary_edges"] = """
SELECT window_start, callee, caller, n, median_gap FROM (SELECT *, row_number() OVER (PARTITION BY window_start, callee
  ORDER BY n DESC, caller) AS rn FROM gaps) WHERE rn = 1"""
CTE["offsets"] = """
SELECT DISTINCT window_start, 'frontend' AS service_name, 0::BIGINT AS offset_ns, 0::BIGINT AS confidence FROM gaps
UNION ALL
SELECT p.window_start, p.callee, round_even(o.offset_ns + (p.median_gap - t.typical_gap), 0)::BIGINT, p.n
FROM offsets o JOIN primary_edges p ON p.window_start = o.window_start AND p.caller = o.service_name
  AND p.callee <> p.caller AND p.callee <> 'frontend'
JOIN typical t ON t.window_start = p.window_start"""
CTE["spine"] = f"""
SELECT unnest(range((SELECT min(window_start) FROM spans), (SELECT max(window_start) FROM spans) + 1, {W})) AS window_start"""
CTE["lookback"] = f"""
SELECT g.window_start AS as_of, c.target_type, c.caller, c.callee, c.target, c.ms, c.status_code
FROM spine g JOIN calls c ON c.lo_ns >= (g.window_start - {L}) * 1000000000 AND c.hi_ns < g.window_start * 1000000000"""
CTE["history"] = f"""
SELECT g.window_start AS as_of, s.target_type, s.target, count(*) AS window_count_observed,
  median(call_count) AS call_rate_median, mad(call_count::DOUBLE) AS call_rate_mad
FROM spine g JOIN stats s ON s.window_start >= g.window_start - {L} AND s.window_start < g.window_start GROUP BY ALL"""
CTE["baselines"] = """
SELECT b.*, coalesce(h.call_rate_median, 0.0) AS call_rate_median, coalesce(h.call_rate_mad, 0.0) AS call_rate_mad,
  coalesce(h.window_count_observed, 0) AS window_count_observed, b.call_count_observed >= 30 AS ready
FROM (SELECT as_of, target_type, caller, callee, target, count(*) AS call_count_observed, median(ms) AS latency_median_ms,
        mad(ms) AS latency_mad_ms, (count(*) FILTER (status_code = 2))::DOUBLE / count(*) AS error_rate
      FROM lookback GROUP BY ALL) b
LEFT JOIN history h USING (as_of, target_type, target)"""
CTE["d_percentile"] = """
SELECT window_start, target_type, caller, callee, target, 'percentile_deviation' AS detector,
  CASE WHEN z > 7.0 THEN 'critical' ELSE 'warning' END AS severity, observed AS observed_value,
  latency_median_ms AS baseline_value, z AS deviation
FROM (SELECT *, greatest(z95, z99) AS z, CASE WHEN z95 > z99 THEN p95 ELSE p99 END AS observed
  FROM (SELECT s.*, b.latency_median_ms, (p95 - latency_median_ms) / (1.4826 * latency_mad_ms) AS z95,
          (p99 - latency_median_ms) / (1.4826 * latency_mad_ms) AS z99
        FROM stats s JOIN baselines b ON b.as_of = s.window_start AND b.target_type = s.target_type AND b.target = s.target
        WHERE b.ready AND latency_mad_ms > 0)) WHERE z > 3.5"""
CTE["d_error"] = """
SELECT window_start, target_type, caller, callee, target, 'error_rate' AS detector,
  CASE WHEN z > 6.0 THEN 'critical' ELSE 'warning' END AS severity, p1 AS observed_value, p2 AS baseline_value, z AS deviation
FROM (SELECT *, (p1 - p2) / sqrt(pooled * (1 - pooled) * (1.0 / n1 + 1.0 / n2)) AS z
  FROM (SELECT s.*, s.call_count AS n1, b.call_count_observed AS n2, s.error_count::DOUBLE / s.call_count AS p1,
          b.error_rate AS p2, (s.error_count + b.error_rate * b.call_count_observed) / (s.call_count + b.call_count_observed) AS pooled
        FROM stats s JOIN baselines b ON b.as_of = s.window_start AND b.target_type = s.target_type AND b.target = s.target
        WHERE b.ready AND s.call_count >= 10) WHERE pooled > 0 AND pooled < 1) WHERE z > 3.0"""
CTE["d_rate"] = """
SELECT window_start, target_type, caller, callee, target, 'call_rate' AS detector,
  CASE WHEN z IS NULL OR -z > 6.0 THEN 'critical' ELSE 'warning' END AS severity, observed AS observed_value,
  med AS baseline_value, coalesce(z, CASE WHEN med > 0 THEN (observed - med) / med ELSE 0.0 END) AS deviation
FROM (SELECT b.as_of AS window_start, b.target_type, b.caller, b.callee, b.target, b.call_rate_median AS med,
        coalesce(s.call_count, 0)::DOUBLE AS observed,
        CASE WHEN b.call_rate_mad > 0 THEN (coalesce(s.call_count, 0) - b.call_rate_median) / (1.4826 * b.call_rate_mad) END AS z
      FROM baselines b LEFT JOIN stats s ON b.as_of = s.window_start AND b.target_type = s.target_type AND b.target = s.target
      WHERE b.ready)
WHERE CASE WHEN z IS NULL THEN med > 0 AND observed < 0.5 * med ELSE z < -3.0 END"""
CTE["detections"] = "SELECT * FROM d_percentile UNION ALL SELECT * FROM d_error UNION ALL SELECT * FROM d_rate"


def _grouped(source: str, by: str = "") -> str:
    return f"""
SELECT {by} target_type || ':' || target || ':' || detector || ':' || min(window_start) AS incident_id,
  target_type, caller, callee, target, detector, min(window_start) AS start_window, max(window_start) AS end_window,
  count(*) AS window_count, arg_max(severity, rank) AS peak_severity, arg_max(deviation, rank) AS peak_deviation
FROM (SELECT *, sum(fresh) OVER (PARTITION BY {by} target_type, target, detector ORDER BY window_start) AS run,
        row(CASE severity WHEN 'critical' THEN 2 ELSE 1 END, abs(deviation), -window_start) AS rank
      FROM (SELECT *, CASE WHEN window_start - lag(window_start) OVER (PARTITION BY {by} target_type, target, detector
              ORDER BY window_start) <= {W} THEN 0 ELSE 1 END AS fresh FROM {source}))
GROUP BY {by} target_type, caller, callee, target, detector, run"""


CTE["grouped"] = _grouped("detections")
CTE["topology"] = "SELECT DISTINCT caller, callee FROM stats WHERE target_type = 'edge'"
CTE["recent"] = f"""
SELECT g.window_start AS as_of, d.* FROM spine g JOIN detections d
  ON d.window_start BETWEEN g.window_start - 300 AND g.window_start"""
CTE["r_grouped"] = _grouped("recent", "as_of,")


def _suppression(prefix: str, source: str, by: str = "") -> None:
    """last incident per key, links between them, path walk, roots and marks."""
    using = f"{by}, " if by else ""
    on = f"AND b.{by} = a.{by}" if by else ""
    CTE[f"{prefix}latest"] = f"""
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {using} target_type, target, detector ORDER BY start_window DESC) AS rn
  FROM {source}) WHERE rn = 1"""
    CTE[f"{prefix}links"] = f"""
SELECT {'a.' + by + ',' if by else ''} a.incident_id, b.incident_id AS down_id
FROM {prefix}latest a JOIN topology t ON t.caller = a.callee
JOIN {prefix}latest b ON b.target_type = 'service' AND b.callee = t.callee AND b.detector = a.detector {on}
WHERE a.target_type = 'service' AND a.start_window <= b.end_window AND b.start_window <= a.end_window"""
    CTE[f"{prefix}path"] = f"""
SELECT {using} incident_id AS origin, incident_id AS cur, [incident_id] AS path, false AS done
FROM {prefix}latest WHERE target_type = 'service'
UNION ALL
SELECT {'w.' + by + ',' if by else ''} w.origin, l.down_id, list_append(w.path, l.down_id), list_contains(w.path, l.down_id)
FROM {prefix}path w JOIN {prefix}links l ON l.incident_id = w.cur {'AND l.' + by + ' = w.' + by if by else ''} WHERE NOT w.done"""
    CTE[f"{prefix}roots"] = f"""
SELECT {'w.' + by + ',' if by else ''} w.origin AS incident_id, arg_min(i.incident_id, i.target) AS root_id
FROM {prefix}path w JOIN {prefix}latest i ON i.incident_id = w.cur {'AND i.' + by + ' = w.' + by if by else ''}
WHERE w.done OR NOT EXISTS (SELECT 1 FROM {prefix}links l WHERE l.incident_id = w.cur {'AND l.' + by + ' = w.' + by if by else ''})
GROUP BY {'w.' + by + ',' if by else ''} w.origin"""
    CTE[f"{prefix}marks"] = f"""
SELECT {using} incident_id, root_id FROM {prefix}roots WHERE root_id <> incident_id
UNION ALL
SELECT {'a.' + by + ',' if by else ''} a.incident_id, r.root_id
FROM {prefix}latest a JOIN {prefix}latest b ON b.target_type = 'service' AND b.callee = a.callee AND b.detector = a.detector {on}
JOIN {prefix}roots r ON r.incident_id = b.incident_id {'AND r.' + by + ' = b.' + by if by else ''}
WHERE a.target_type = 'edge' AND a.start_window <= b.end_window AND b.start_window <= a.end_window"""
    CTE[f"{prefix}incidents"] = f"""
SELECT i.*, m.root_id IS NOT NULL AS derived, coalesce(m.root_id, '') AS root_cause_incident_id
FROM {source} i LEFT JOIN {prefix}marks m USING ({using} incident_id)"""


_suppression("", "grouped")
_suppression("r_", "r_grouped", "as_of")

RUN = f"'run-' || (((start_ns) - {BASE * 10**9}) // 2400000000000)"
CTE["gt_spans"] = f"""
SELECT 'run-' || (({start_us('key')} - {BASE_US}) // 2400000000) AS run_id, trace_id, span_id, parent_span_id, service_name,
  {start_us('key')} * 1000 AS generated_at, start_ns
FROM (SELECT *, {_NEWEST} AS newest FROM sent) WHERE newest = 1"""
CTE["gt_edges"] = """
SELECT c.run_id, c.trace_id, p.service_name AS caller_service, c.service_name AS callee_service, c.generated_at
FROM gt_spans c JOIN gt_spans p ON p.run_id = c.run_id AND p.trace_id = c.trace_id AND p.span_id = c.parent_span_id
WHERE c.parent_span_id <> ''"""
CTE["gt_offsets"] = """
SELECT DISTINCT run_id, service_name, CASE WHEN service_name = 'inventory' THEN -40000000 ELSE 0 END::BIGINT AS offset_ns
FROM gt_spans WHERE service_name <> 'frontend'"""
CTE["gt_incidents"] = f"""
SELECT run_id, type || '-' || m AS incident_id, type, target_service, target_edge, {BASE} + m * 60.0 + shift AS start_time,
  {BASE} + m * 60.0 + shift + seconds AS end_time, magnitude
FROM (SELECT DISTINCT run_id, (start_ns - {BASE * 10**9}) // 60000000000 AS m FROM gt_spans WHERE service_name = 'frontend') x
JOIN (VALUES ('edge_disappearance', 17, 12, '', 'checkout->payments', 0.0, 59.0, 1.0),
             ('error_burst', 19, 15, 'search', '', 0.5, 59.0, 0.5),
             ('latency_spike', 23, 14, 'shipping', '', 10.0, 100.0, 8.0)) v(type, every, slot, target_service, target_edge, shift, seconds, magnitude)
  ON m % every = slot
WHERE run_id <> 'run-1'"""
CTE["ranges"] = """
SELECT run_id, min(generated_at) AS lo_ns, max(generated_at) AS hi_ns, min(generated_at) - 30000000000 AS from_ns,
  max(generated_at) + 30000000000 AS to_ns FROM gt_spans GROUP BY run_id"""
CTE["landed"] = """
SELECT DISTINCT g.run_id, s.trace_id, s.span_id FROM spans s JOIN (SELECT DISTINCT run_id, trace_id FROM gt_spans) g USING (trace_id)"""
CTE["e_classes"] = """
SELECT g.run_id, s.trace_id, s.span_id, s.classification FROM classes s JOIN (SELECT DISTINCT run_id, trace_id FROM gt_spans) g USING (trace_id)"""
CTE["found_edges"] = """
SELECT DISTINCT r.run_id, s.caller, s.callee FROM stats s JOIN ranges r
  ON s.window_start * 1000000000 BETWEEN r.from_ns AND r.to_ns WHERE s.target_type = 'edge'"""
CTE["edges_prf"] = """
SELECT *, CASE WHEN edge_precision + edge_recall > 0 THEN 2 * edge_precision * edge_recall / (edge_precision + edge_recall) ELSE 0.0 END AS edge_f1
FROM (SELECT *, CASE WHEN found_edge_count > 0 THEN edge_true_positive_count / found_edge_count::DOUBLE ELSE 0.0 END AS edge_precision,
        CASE WHEN true_edge_count > 0 THEN edge_true_positive_count / true_edge_count::DOUBLE ELSE 0.0 END AS edge_recall
  FROM (SELECT coalesce(t.run_id, f.run_id) AS run_id, count(t.run_id) AS true_edge_count, count(f.run_id) AS found_edge_count,
          count(*) FILTER (t.run_id IS NOT NULL AND f.run_id IS NOT NULL) AS edge_true_positive_count
        FROM (SELECT DISTINCT run_id, caller_service, callee_service FROM gt_edges) t
        FULL JOIN found_edges f ON f.run_id = t.run_id AND f.caller = t.caller_service AND f.callee = t.callee_service
        GROUP BY 1))"""
CTE["attachment"] = """
SELECT run_id, count(*) FILTER (here) AS attachment_denominator, count(*) FILTER (here AND classification = 'ok') AS attachment_correct,
  count(*) FILTER (NOT here) AS orphan_denominator, count(*) FILTER (NOT here AND classification = 'orphan_missing_parent') AS orphan_correct
FROM (SELECT g.run_id, c.classification, p.span_id IS NOT NULL AS here
  FROM gt_spans g JOIN landed l ON l.run_id = g.run_id AND l.trace_id = g.trace_id AND l.span_id = g.span_id
  LEFT JOIN e_classes c ON c.run_id = g.run_id AND c.trace_id = g.trace_id AND c.span_id = g.span_id
  LEFT JOIN landed p ON p.run_id = g.run_id AND p.trace_id = g.trace_id AND p.span_id = g.parent_span_id
  WHERE g.parent_span_id <> '') GROUP BY run_id"""
CTE["true_inc"] = """
SELECT run_id, incident_id, type, CASE WHEN target_edge <> '' THEN 'edge' ELSE 'service' END AS target_type,
  CASE WHEN target_edge <> '' THEN target_edge ELSE target_service END AS target,
  CASE type WHEN 'error_burst' THEN 'error_rate' WHEN 'edge_disappearance' THEN 'call_rate' ELSE 'percentile_deviation' END AS detector,
  start_time, end_time, magnitude FROM gt_incidents"""
CTE["run_inc"] = """
SELECT r.run_id, i.* FROM incidents i JOIN ranges r ON i.start_window * 1000000000 BETWEEN r.from_ns AND r.to_ns"""
CTE["matched"] = """
SELECT t.*, coalesce(m.matches, 0) AS matches, m.matches IS NOT NULL AS detected, m.first_window
FROM true_inc t LEFT JOIN (SELECT t.run_id, t.incident_id, count(*) AS matches, min(f.start_window) AS first_window
  FROM true_inc t JOIN run_inc f ON f.run_id = t.run_id AND f.target_type = t.target_type AND f.target = t.target
    AND f.detector = t.detector AND f.start_window <= t.end_time AND t.start_time <= f.end_window GROUP BY ALL) m
USING (run_id, incident_id)"""
CTE["root_cause"] = """
SELECT run_id, count(*) AS root_cause_total, count(*) FILTER (good) AS root_cause_correct FROM (
  SELECT d.run_id, EXISTS (SELECT 1 FROM true_inc t JOIN run_inc n ON n.run_id = t.run_id AND n.target = t.target
      WHERE t.run_id = d.run_id AND n.incident_id = d.root_cause_incident_id
        AND d.start_window <= t.end_time AND t.start_time <= d.end_window) AS good
  FROM run_inc d WHERE d.derived AND EXISTS (SELECT 1 FROM true_inc t WHERE t.run_id = d.run_id
    AND d.start_window <= t.end_time AND t.start_time <= d.end_window)) GROUP BY run_id"""
CTE["incident_prf"] = """
SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall)
    WHEN precision + recall = 0 THEN 0.0 END AS f1
FROM (SELECT *, CASE WHEN found_incident_count > 0 THEN true_positive_count / found_incident_count::DOUBLE END AS precision,
        CASE WHEN true_incident_count > 0 THEN true_positive_count / true_incident_count::DOUBLE END AS recall
  FROM (SELECT r.run_id, (SELECT count(*) FROM true_inc t WHERE t.run_id = r.run_id) AS true_incident_count,
      (SELECT count(DISTINCT (f.target_type, f.target, f.detector)) FROM run_inc f WHERE f.run_id = r.run_id AND NOT f.derived
        AND (NOT EXISTS (SELECT 1 FROM true_inc t WHERE t.run_id = f.run_id)
          OR EXISTS (SELECT 1 FROM true_inc t WHERE t.run_id = f.run_id AND f.start_window <= t.end_time AND t.start_time <= f.end_window))
      ) AS found_incident_count,
      (SELECT count(*) FROM matched m WHERE m.run_id = r.run_id AND m.detected) AS true_positive_count
    FROM ranges r))"""
CTE["healthy"] = """
SELECT r.run_id, (SELECT count(*) FROM detections d WHERE d.window_start * 1000000000 BETWEEN r.from_ns AND r.to_ns) AS total_detection_count,
  CASE WHEN NOT EXISTS (SELECT 1 FROM true_inc t WHERE t.run_id = r.run_id) AND r.hi_ns > r.lo_ns
    THEN (SELECT count(*) FROM detections d WHERE d.window_start * 1000000000 BETWEEN r.from_ns AND r.to_ns)
      / ((r.hi_ns - r.lo_ns) / 1e9 / 3600) END AS healthy_control_detections_per_hour
FROM ranges r"""
CTE["middle"] = f"""
SELECT t.run_id, t.incident_id, t.type, t.target_type, t.target, t.start_time, coalesce(s.call_count, 0) AS call_count,
  coalesce(s.error_count, 0) AS error_count, coalesce(s.p99, 0.0) AS p99
FROM true_inc t LEFT JOIN stats s ON s.target_type = t.target_type AND s.target = t.target
  AND s.window_start <= (t.start_time + t.end_time) / 2 AND s.window_start > (t.start_time + t.end_time) / 2 - {W}"""
CTE["before"] = """
SELECT t.run_id, t.incident_id, arg_max(b.latency_median_ms, b.as_of) AS latency_median_ms, arg_max(b.call_rate_median, b.as_of) AS call_rate_median
FROM true_inc t LEFT JOIN baselines b ON b.target_type = t.target_type AND b.target = t.target AND b.as_of <= t.start_time AND b.ready
GROUP BY ALL"""
CTE["observed"] = """
SELECT run_id, incident_id, CASE
  WHEN type IN ('latency_spike', 'latency_tail') THEN CASE WHEN call_count > 0 AND latency_median_ms > 0 THEN p99 / latency_median_ms END
  WHEN type = 'error_burst' THEN CASE WHEN call_count > 0 THEN error_count / call_count::DOUBLE END
  ELSE CASE WHEN call_rate_median > 0 THEN 1 - call_count / call_rate_median END END AS observed_magnitude
FROM middle JOIN before USING (run_id, incident_id)"""
CTE["depth_walk"] = """
SELECT caller AS service, 0::BIGINT AS depth FROM topology WHERE caller NOT IN (SELECT callee FROM topology)
UNION
SELECT t.callee, d.depth + 1 FROM depth_walk d JOIN topology t ON t.caller = d.service WHERE d.depth < 20"""
CTE["depths"] = "SELECT service, min(depth) AS depth FROM depth_walk GROUP BY service"


def sql(final: str, **instead: str) -> str:
    """WITH ... final, with the blocks that ``final`` needs, in definition order.

    ``instead`` replaces blocks by name for this text.
    """
    needed: set[str] = set()
    blocks_of = CTE | instead

    def visit(text: str) -> None:
        for word in set(re.findall(r"[A-Za-z_]+", text)):
            if word in blocks_of and word not in needed:
                needed.add(word)
                visit(blocks_of[word])

    visit(final)
    blocks = [f"{name} AS ({body.strip()})" for name, body in blocks_of.items() if name in needed]
    if not blocks:
        return final
    return "WITH RECURSIVE " + ",\n".join(blocks) + "\n" + final.strip()
