"""DuckDB SQL for every registered query, written from the operator
definitions (not from the Spark code): the expected entry of each event is
derived directly from the ``events`` row, so the Spark side's render -> parse
round trip is checked, not repeated."""

from __future__ import annotations

# Expected parsed entry per event (kind-0 line), see sources/tables.py.
EV = """
ev AS (
  SELECT
    event_id * 2 AS line_id,
    event_id,
    CASE WHEN event_id % 2 = 0 THEN 'json' ELSE 'plain' END AS line_format,
    date_trunc('millisecond', ts) AS ts,
    CASE WHEN event_id % 5 = 2 AND event_id % 2 = 0 THEN date_trunc('millisecond', ts) + INTERVAL 2 HOUR
         WHEN event_id % 5 = 2 THEN date_trunc('millisecond', ts) - INTERVAL 330 MINUTE
         ELSE date_trunc('millisecond', ts) END AS wall_ts,
    CASE WHEN event_id % 5 = 2 AND event_id % 2 = 0 THEN '+02:00'
         WHEN event_id % 5 = 2 THEN '-05:30' ELSE '+00:00' END AS tz_offset,
    CASE WHEN event_id % 4 = 0 THEN upper(event_type) ELSE event_type END AS level,
    concat('user ', user_id, ' ', event_type, ' step ', event_id % 5) AS message,
    concat(event_type, '/handler.go:', user_id % 7) AS source,
    concat('u', user_id) AS "user",
    CASE WHEN event_id % 2 = 0 THEN 'notifications' ELSE '' END AS log_source,
    CASE WHEN event_id % 2 = 0 THEN concat('a', event_id) ELSE '' END AS ack_id,
    CASE WHEN event_id % 2 = 0 THEN event_type ELSE '' END AS type,
    CASE WHEN event_id % 2 = 1 THEN ''
         WHEN value < 100 THEN 'Sent' ELSE 'Received' END AS status,
    CASE WHEN event_id % 2 = 0 THEN
      concat('cents=', CAST(round(value * 100) AS BIGINT), ', props=', replace(props, ' ', ''),
             ', retry=', CASE WHEN event_id % 3 = 0 THEN 'true' ELSE 'false' END)
    ELSE concat('cents=', CAST(round(value * 100) AS BIGINT), ', k=', json_extract_string(props, '$.k'))
    END AS extras_text,
    1 AS w
  FROM events
)"""

ENTRY_COLS = ('line_id, ts, wall_ts, tz_offset, level, message, source, "user", '
              'log_source, ack_id, type, status, extras_text')


def _with(body: str) -> str:
    return f"WITH {EV}\n{body}"


def _top(item_expr: str, name: str, where: str, k: int = 10) -> str:
    return _with(f"""
, c AS (SELECT {item_expr} AS {name}, CAST(sum(w) AS BIGINT) AS count FROM ev WHERE {where} GROUP BY 1)
SELECT {name}, count, CAST(row_number() OVER (ORDER BY count DESC, {name}) AS INTEGER) AS rank
FROM c ORDER BY count DESC, {name} LIMIT {k}""")


def _count(item_expr: str, name: str) -> str:
    return _with(f"SELECT {item_expr} AS {name}, CAST(sum(w) AS BIGINT) AS count FROM ev GROUP BY 1")


def _bucket_level(item_expr: str, name: str) -> str:
    return _with(
        f"SELECT {item_expr} AS {name}, upper(level) AS level, CAST(sum(w) AS BIGINT) AS count "
        f"FROM ev GROUP BY 1, 2"
    )


ERR_MSG = "CASE WHEN length(message) > 50 THEN left(message, 50) || '...' ELSE message END"
PATTERN = ("array_to_string(list_slice(list_filter(regexp_split_to_array(message, '\\s+'), "
           "lambda x: x <> ''), 1, 2), ' ')")

SQL: dict[str, str] = {
    "parse_plain": _with(f"SELECT {ENTRY_COLS} FROM ev WHERE line_format = 'plain'"),
    "parse_json": _with(f"SELECT {ENTRY_COLS} FROM ev WHERE line_format = 'json'"),
    "parse_timestamps": _with("SELECT line_id, ts, wall_ts, tz_offset FROM ev"),
    "rejects": """
SELECT event_id * 2 + 1 AS line_id,
  CASE WHEN event_type = 'error' AND event_id % 2 = 0 THEN 'invalid_json'
       WHEN event_type = 'error' THEN 'invalid_format'
       ELSE 'bad_timestamp' END AS reason,
  CASE WHEN event_type = 'error' AND event_id % 2 = 0 THEN 'json' ELSE 'plain' END AS line_format
FROM events
WHERE event_type = 'error' OR (event_type = 'signup' AND event_id % 2 = 1)""",
    "extras_text": _with("SELECT line_id, extras_text FROM ev"),
    "filter_level": _with(f"SELECT {ENTRY_COLS} FROM ev WHERE lower(level) = 'error'"),
    "filter_user": _with(f"SELECT {ENTRY_COLS} FROM ev WHERE contains(lower(\"user\"), 'u12')"),
    "filter_time": _with(
        f"SELECT {ENTRY_COLS} FROM ev WHERE ts >= TIMESTAMP '2024-01-05 00:00:00' "
        f"AND ts <= TIMESTAMP '2024-01-12 12:30:00'"
    ),
    "filter_search": _with(
        f"SELECT {ENTRY_COLS} FROM ev WHERE contains(lower(message), 'k=4') "
        f"OR contains(lower(source), 'k=4') OR contains(lower(extras_text), 'k=4')"
    ),
    "filter_regex": _with(
        f"SELECT {ENTRY_COLS} FROM ev WHERE regexp_matches(message, 'handler\\.go:[35]$|^u1[0-9]$') "
        f"OR regexp_matches(source, 'handler\\.go:[35]$|^u1[0-9]$') "
        f"OR regexp_matches(extras_text, 'handler\\.go:[35]$|^u1[0-9]$') "
        f"OR regexp_matches(\"user\", 'handler\\.go:[35]$|^u1[0-9]$')"
    ),
    "filter_all": _with(
        f"SELECT {ENTRY_COLS} FROM ev WHERE lower(level) = 'click' AND contains(lower(\"user\"), 'u1') "
        f"AND ts >= TIMESTAMP '2024-01-03 00:00:00' AND ts <= TIMESTAMP '2024-01-20 00:00:00' "
        f"AND (contains(lower(message), 'step') OR contains(lower(source), 'step') "
        f"     OR contains(lower(extras_text), 'step')) "
        f"AND (regexp_matches(message, 'handler\\.go:[0-6]') OR regexp_matches(source, 'handler\\.go:[0-6]') "
        f"     OR regexp_matches(extras_text, 'handler\\.go:[0-6]') OR regexp_matches(\"user\", 'handler\\.go:[0-6]'))"
    ),
    "browse_filter": _with(
        f"SELECT {ENTRY_COLS} FROM ev WHERE contains(lower(message), 'view') "
        f"OR contains(lower(level), 'view') OR contains(lower(source), 'view')"
    ),
    "merge_sorted": _with("SELECT line_id, ts, level, message FROM ev ORDER BY ts, event_id"),
    "total_and_range": _with("""
SELECT CAST(sum(w) AS BIGINT) AS total, count(*) AS unique_rows,
  CAST(sum(w) AS BIGINT) AS total_with_duplicates,
  min(ts) AS start_ts, max(ts) AS end_ts,
  CAST(round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6) AS BIGINT) AS duration_s,
  CAST(sum(CASE WHEN upper(level) IN ('ERROR', 'FATAL') THEN w ELSE 0 END) AS BIGINT) AS error_count,
  round(sum(CASE WHEN upper(level) IN ('ERROR', 'FATAL') THEN w ELSE 0 END) * 100.0 / sum(w), 6) AS error_rate,
  false AS is_deduplicated
FROM ev"""),
    "level_counts": _count("upper(level)", "level"),
    "level_share": _with("""
, c AS (SELECT upper(level) AS level, CAST(sum(w) AS BIGINT) AS count FROM ev GROUP BY 1)
SELECT level, count, round(count * 100.0 / (SELECT sum(count) FROM c), 6) AS share_pct FROM c"""),
    "error_rate": _with("""
SELECT CAST(sum(CASE WHEN upper(level) IN ('ERROR', 'FATAL') THEN w ELSE 0 END) AS BIGINT) AS error_count,
  CAST(sum(w) AS BIGINT) AS total,
  round(sum(CASE WHEN upper(level) IN ('ERROR', 'FATAL') THEN w ELSE 0 END) * 100.0 / sum(w), 6) AS error_rate
FROM ev"""),
    "top_sources": _top("source", "source", "source <> ''"),
    "top_users": _top('"user"', '"user"', "\"user\" <> ''"),
    "top_errors": _top(ERR_MSG, "message", "lower(level) IN ('error', 'fatal')"),
    "by_hour": _count("CAST(hour(wall_ts) AS INTEGER)", "hour"),
    "by_weekday": _count("dayname(wall_ts)", "weekday"),
    "by_month": _count("monthname(wall_ts)", "month"),
    "hour_level": _bucket_level("CAST(hour(wall_ts) AS INTEGER)", "hour"),
    "weekday_level": _bucket_level("dayname(wall_ts)", "weekday"),
    "month_level": _bucket_level("monthname(wall_ts)", "month"),
    "dominant_level": _with("""
, hl AS (SELECT CAST(hour(wall_ts) AS INTEGER) AS hour, upper(level) AS level, CAST(sum(w) AS BIGINT) AS count
         FROM ev GROUP BY 1, 2),
  r AS (SELECT *, row_number() OVER (PARTITION BY hour ORDER BY count DESC, level) AS rn,
               sum(count) OVER (PARTITION BY hour) AS total FROM hl)
SELECT hour, CAST(total AS BIGINT) AS total, level AS dominant, count AS top_count,
  round(count * 100.0 / total, 6) AS share_pct,
  CASE WHEN count * 100.0 / total >= 50 THEN
    CASE level WHEN 'ERROR' THEN 'error' WHEN 'FATAL' THEN 'error' WHEN 'CRITICAL' THEN 'error'
               WHEN 'WARN' THEN 'warning' WHEN 'WARNING' THEN 'warning'
               WHEN 'INFO' THEN 'info' WHEN 'DEBUG' THEN 'debug' ELSE 'none' END
  ELSE 'none' END AS level_class
FROM r WHERE rn = 1"""),
    "peak_hours": _top("CAST(hour(wall_ts) AS INTEGER)", "hour", "true", 3),
    "hour_bars": _with("""
, c AS (SELECT CAST(hour(wall_ts) AS INTEGER) AS hour, CAST(sum(w) AS BIGINT) AS count FROM ev GROUP BY 1)
SELECT hour, count, CAST(floor(count / (SELECT max(count) FROM c) * 15) AS BIGINT) AS bar FROM c"""),
    "weekday_bars": _with("""
, c AS (SELECT dayname(wall_ts) AS weekday, CAST(sum(w) AS BIGINT) AS count FROM ev GROUP BY 1)
SELECT weekday, count, CAST(floor(count / (SELECT max(count) FROM c) * 15) AS BIGINT) AS bar FROM c"""),
    "month_bars": _with("""
, m AS (SELECT CAST(i AS INTEGER) AS month_no, monthname(make_date(2000, CAST(i AS INTEGER), 1)) AS month
        FROM range(1, 13) t(i)),
  c AS (SELECT monthname(wall_ts) AS month, CAST(sum(w) AS BIGINT) AS count FROM ev GROUP BY 1),
  j AS (SELECT m.month_no, m.month, CAST(coalesce(c.count, 0) AS BIGINT) AS count FROM m LEFT JOIN c USING (month))
SELECT month_no, month, count, CAST(floor(count / (SELECT max(count) FROM j) * 30) AS BIGINT) AS bar FROM j"""),
    "patterns": _top(PATTERN, "pattern", f"{PATTERN} <> ''"),
    "notif_types": _top("type", "type", "log_source = 'notifications' AND type <> ''"),
    "notif_statuses": _top("status", "status", "log_source = 'notifications' AND status <> ''"),
}

_STAT_ITEMS = f"""
, items AS (
  SELECT 'level' AS stat, upper(level) AS item, w FROM ev
  UNION ALL SELECT 'source', source, w FROM ev WHERE source <> ''
  UNION ALL SELECT 'user', "user", w FROM ev WHERE "user" <> ''
  UNION ALL SELECT 'error', {ERR_MSG}, w FROM ev WHERE lower(level) IN ('error', 'fatal')
  UNION ALL SELECT 'hour', CAST(hour(wall_ts) AS VARCHAR), w FROM ev
  UNION ALL SELECT 'weekday', dayname(wall_ts), w FROM ev
  UNION ALL SELECT 'month', monthname(wall_ts), w FROM ev
  UNION ALL SELECT 'hour_level', CAST(hour(wall_ts) AS VARCHAR) || '|' || upper(level), w FROM ev
  UNION ALL SELECT 'weekday_level', dayname(wall_ts) || '|' || upper(level), w FROM ev
  UNION ALL SELECT 'month_level', monthname(wall_ts) || '|' || upper(level), w FROM ev
  UNION ALL SELECT 'pattern', {PATTERN}, w FROM ev WHERE {PATTERN} <> ''
  UNION ALL SELECT 'notif_type', type, w FROM ev WHERE log_source = 'notifications' AND type <> ''
  UNION ALL SELECT 'notif_status', status, w FROM ev WHERE log_source = 'notifications' AND status <> ''
), c AS (SELECT stat, item, CAST(sum(w) AS BIGINT) AS count FROM items GROUP BY 1, 2)
, r AS (SELECT stat, item, count,
  CAST(row_number() OVER (PARTITION BY stat ORDER BY count DESC, item) AS INTEGER) AS rank FROM c)
SELECT * FROM r
WHERE stat NOT IN ('source', 'user', 'error', 'pattern', 'notif_type', 'notif_status') OR rank <= 10"""

SQL["report_stats"] = _with(_STAT_ITEMS)


# --- near-duplicate trimming -------------------------------------------------
# --- fixed values: normalisation rules, stated apart from the code they check ---
NORMALIZE_RULES = (
    (r"\b[0-9a-f]{8}\b", "ID_SHORT"),
    (r"\b[0-9a-f]{32}\b", "ID_LONG"),
    (r"\b[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}\b", "UUID"),
    (r"\b([0-9a-f]{6,31})\b", "ID"),
    (r"\d{4}[-/]\d{1,2}[-/]\d{1,2}", "DATE"),
    (r"\d{1,2}[-/]\d{1,2}[-/]\d{2,4}", "DATE"),
    (r"\d{1,2}:\d{1,2}(:\d{1,2})?(\.\d+)?", "TIME"),
    (r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}", "IP"),
    (r"(([0-9a-f]{1,4}:){7}|::)[0-9a-f]{1,4}", "IPV6"),
    (r"\d+(\.\d+)?ms", "DURATION_MS"),
    (r"\d+(\.\d+)?s", "DURATION_S"),
    (r"\d+(\.\d+)?ns", "DURATION_NS"),
    (r"\d+(\.\d+)?[mu]s", "DURATION_US"),
    (r"\b\d{1,9}\b", "NUMBER"),
    (r'"[^"]*"', "STRING"),
    (r"'[^']*'", "STRING"),
    (r"\b([a-zA-Z0-9_-]+\.)+[a-zA-Z0-9_-]+\b", "PATH"),
    (r"\b\d+\.\d+\.\d+\b", "VERSION"),
)

_GO_SPACE_CHARS = "\t\n\x0b\x0c\r \x85\xa0 " + "".join(
    chr(c) for c in range(0x2000, 0x200B)) + "    　"


def duck_norm(col: str) -> str:
    e = f"lower({col})"
    for pattern, repl in NORMALIZE_RULES:
        e = f"regexp_replace({e}, '{pattern.replace(chr(39), chr(39) * 2)}', '{repl}', 'g')"
    e = f"regexp_replace({e}, '[\\t\\n\\f\\r ]+', ' ', 'g')"
    return f"trim({e}, '{_GO_SPACE_CHARS}')"


DOC_ENTRIES = "ent AS (SELECT doc_id AS id, coalesce(lang, '') AS lvl_raw, coalesce(source, '') AS src_raw, coalesce(text, '') AS msg FROM documents)"
EVENT_ENTRIES = f"""{EV},
ent AS (SELECT event_id AS id, level AS lvl_raw, source AS src_raw, message AS msg FROM ev)"""


def nodes_sql(entries: str) -> str:
    return f"""{entries},
n0 AS (SELECT id, lower(lvl_raw) AS lvl, lower(src_raw) AS lsrc, {duck_norm('msg')} AS norm FROM ent),
nodes AS (SELECT min(id) AS id, lvl, lsrc, norm, count(*) AS weight FROM n0 GROUP BY lvl, lsrc, norm)"""


def edges_sql(entries: str) -> str:
    return nodes_sql(entries) + """,
nb AS (SELECT id, lvl, lsrc, norm, strlen(norm) AS nlen,
         CASE WHEN norm = '' THEN []::VARCHAR[] ELSE string_split(norm, ' ') END AS w FROM nodes),
nc AS (SELECT *, list_distinct(w) AS ws, len(w) AS nw FROM nb),
sp AS (SELECT x.s AS s1, y.s AS s2 FROM (SELECT DISTINCT lsrc AS s FROM nc) x, (SELECT DISTINCT lsrc AS s FROM nc) y
       WHERE x.s = y.s OR (strlen(x.s) > 0 AND strlen(y.s) > 0 AND
             1 - levenshtein(x.s, y.s) / greatest(strlen(x.s), strlen(y.s)) > 0.7)),
p AS (SELECT a.id AS a, b.id AS b, a.nlen AS l1, b.nlen AS l2, a.nw AS n1, b.nw AS n2, len(a.ws) AS d1
      FROM nc a JOIN sp ON sp.s1 = a.lsrc JOIN nc b ON a.lvl = b.lvl AND b.lsrc = sp.s2 AND a.id < b.id
       AND (2 * least(a.nlen, b.nlen) > greatest(a.nlen, b.nlen) OR a.nlen + b.nlen = 0)),
r AS (SELECT p.*, x.norm AS m1, y.norm AS m2,
             CASE WHEN x.norm = y.norm THEN true
                  WHEN contains(x.norm, y.norm) OR contains(y.norm, x.norm) THEN true
                  WHEN NOT (2 * least(n1, n2) >= greatest(n1, n2)) THEN false
             END AS early FROM p JOIN nodes x ON x.id = p.a JOIN nodes y ON y.id = p.b),
wl AS (SELECT id, word, count(*) AS k FROM (SELECT id, unnest(w) AS word FROM nc) GROUP BY ALL),
cc AS (SELECT r.a, r.b, sum(wl.k) AS c FROM (SELECT a, b FROM r WHERE early IS NULL) r JOIN wl ON wl.id = r.b
       JOIN wl wd ON wd.id = r.a AND wd.word = wl.word GROUP BY r.a, r.b),
jj AS (SELECT r.*, coalesce(cc.c, 0) AS c, r.d1 + r.n2 - coalesce(cc.c, 0) AS tot
       FROM r LEFT JOIN cc ON cc.a = r.a AND cc.b = r.b),
edges AS (SELECT a, b FROM jj WHERE CASE
   WHEN early IS NOT NULL THEN early
   WHEN tot = 0 THEN false
   WHEN c / tot >= CAST(0.8 AS DOUBLE) THEN true
   WHEN c / tot >= CAST(0.8 AS DOUBLE) * CAST(0.8 AS DOUBLE) THEN
     1 - levenshtein(lower(m1), lower(m2)) / greatest(strlen(m1), strlen(m2)) >= CAST(0.8 AS DOUBLE)
   ELSE false END)"""


def trim_sql(entries: str) -> str:
    """Greedy leaders by a recursive CTE over the nodes in input order."""
    return edges_sql(entries) + """,
ordered AS (SELECT id, weight, CAST(row_number() OVER (ORDER BY id) AS BIGINT) AS k FROM nodes),
inc AS (SELECT o.k, list(oa.k) FILTER (WHERE oa.k IS NOT NULL) AS incs
        FROM ordered o LEFT JOIN edges e ON e.b = o.id LEFT JOIN ordered oa ON oa.id = e.a GROUP BY o.k),
rec(k, leaders) AS (
  SELECT CAST(0 AS BIGINT), CAST([] AS BIGINT[])
  UNION ALL
  SELECT rec.k + 1,
    CASE WHEN list_has_any(rec.leaders, coalesce(inc.incs, CAST([] AS BIGINT[]))) THEN rec.leaders
         ELSE list_append(rec.leaders, rec.k + 1) END
  FROM rec JOIN inc ON inc.k = rec.k + 1),
fin AS (SELECT leaders FROM rec ORDER BY k DESC LIMIT 1),
lead AS (SELECT unnest(leaders) AS k FROM fin),
assign AS (
  SELECT o.k, o.weight,
    CASE WHEN o.k IN (SELECT k FROM lead) THEN o.k
         ELSE (SELECT min(x) FROM (SELECT unnest(i.incs) AS x) t WHERE x IN (SELECT k FROM lead)) END AS leader_k
  FROM ordered o JOIN inc i ON i.k = o.k),
counts AS (SELECT leader_k, CAST(sum(weight) AS BIGINT) AS duplicate_count FROM assign GROUP BY leader_k),
trimmed AS (SELECT o.id, c.duplicate_count FROM counts c JOIN ordered o ON o.k = c.leader_k)"""


SQL["normalize"] = "SELECT doc_id, " + duck_norm("coalesce(text, '')") + " AS norm FROM documents"
SQL["exact_collapse"] = "WITH " + nodes_sql(DOC_ENTRIES) + "\nSELECT id AS node_id, lvl, lsrc, weight FROM nodes"
SQL["similar_pairs"] = "WITH " + edges_sql(DOC_ENTRIES) + "\nSELECT a AS a_id, b AS b_id FROM edges"
SQL["trim"] = "WITH RECURSIVE " + trim_sql(EVENT_ENTRIES) + """
SELECT t.id AS event_id, ev.level, ev.source, ev.message, t.duplicate_count
FROM trimmed t JOIN ev ON ev.event_id = t.id"""
SQL["trim_documents"] = "WITH RECURSIVE " + trim_sql(DOC_ENTRIES) + """
SELECT t.id AS doc_id, coalesce(d.lang, '') AS level, coalesce(d.source, '') AS source, t.duplicate_count
FROM trimmed t JOIN documents d ON d.doc_id = t.id"""
SQL["trim_report"] = "WITH RECURSIVE " + trim_sql(DOC_ENTRIES) + """
SELECT (SELECT count(*) FROM documents) AS original, (SELECT count(*) FROM trimmed) AS final,
       (SELECT count(*) FROM documents) - (SELECT count(*) FROM trimmed) AS removed"""
SQL["dedup_summary"] = "WITH RECURSIVE " + trim_sql(DOC_ENTRIES) + """
SELECT CAST(sum(CASE WHEN duplicate_count > 1 THEN duplicate_count ELSE 1 END) AS BIGINT) AS total,
  count(*) AS unique_rows,
  CAST(sum(greatest(duplicate_count, 1)) AS BIGINT) AS total_with_duplicates,
  max(duplicate_count) > 1 AND sum(greatest(duplicate_count, 1)) > count(*) AS is_deduplicated
FROM trimmed"""


# --- tail sample, bundle and exports ------------------------------------------
NL = "chr(10)"
TS_TEXT = "strftime(wall_ts, '%Y-%m-%d %H:%M:%S')"
ZONE = "CASE WHEN tz_offset = '+00:00' THEN 'Z' ELSE tz_offset END"
FRAC = ("CASE WHEN rtrim(strftime(wall_ts, '%f'), '0') = '' THEN '' "
        "ELSE '.' || rtrim(strftime(wall_ts, '%f'), '0') END")
BLOCK = (f"concat(i, '. [', {TS_TEXT}, '] [', level, '] ', source, ': ', message, {NL}, "
         f"CASE WHEN \"user\" <> '' THEN concat('   User: ', \"user\", {NL}) ELSE '' END, "
         f"CASE WHEN source <> '' THEN concat('   Source: ', source, {NL}) ELSE '' END, "
         f"CASE WHEN extras_text <> '' THEN concat('   Extras: ', extras_text, {NL}) ELSE '' END, {NL})")
TAIL = """, tail AS (SELECT * FROM ev ORDER BY event_id DESC LIMIT 100),
t AS (SELECT CAST(row_number() OVER (ORDER BY event_id) AS INTEGER) AS i, * FROM tail)"""

SQL["tail_sample"] = _with(TAIL + "\nSELECT i, line_id, level, message FROM t")
SQL["bundle_lines"] = _with(TAIL + f"\nSELECT i, {BLOCK} AS block FROM t")
SQL["bundle_prompt"] = _with(TAIL + f""", b AS (SELECT i, {BLOCK} AS block FROM t)
SELECT count(*) AS entries, CAST(count(*) AS BIGINT) AS represented, false AS has_duplicates,
  concat(count(*), ' server log entries') AS description,
  concat('Log excerpt with ', count(*), ' server log entries:', {NL}, {NL},
         string_agg(block, '' ORDER BY i), {NL},
         'Say what went wrong, since when, and what to look at next.') AS prompt,
  'You read server logs for the people who run the server. '
  || 'Name the faults first, then causes, then next steps.' AS instructions
FROM b""")
SQL["conversation_bundles"] = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS level, coalesce(text, '') AS message,
                  TIMESTAMP '2024-01-01 00:00:00' + to_hours(conv_id) + to_minutes(turn) AS wall_ts
           FROM conversations),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rd FROM c),
t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM r WHERE rd <= 5),
b AS (SELECT conv_id, i, concat(i, '. [', {TS_TEXT}, '] [', level, '] : ', message, {NL}, {NL}) AS block FROM t)
SELECT conv_id, count(*) AS entries, CAST(count(*) AS BIGINT) AS represented, false AS has_duplicates,
  concat(count(*), ' server log entries') AS description,
  concat('Log excerpt with ', count(*), ' server log entries:', {NL}, {NL},
         string_agg(block, '' ORDER BY i), {NL},
         'Say what went wrong, since when, and what to look at next.') AS prompt,
  'You read server logs for the people who run the server. '
  || 'Name the faults first, then causes, then next steps.' AS instructions
FROM b GROUP BY conv_id"""
SQL["preview"] = "WITH RECURSIVE " + trim_sql(DOC_ENTRIES) + """
SELECT t.id AS doc_id,
  concat(CASE WHEN length(coalesce(d.text, '')) > 80 THEN left(d.text, 77) || '...' ELSE coalesce(d.text, '') END,
         CASE WHEN t.duplicate_count > 1 THEN concat(' (×', t.duplicate_count, ')') ELSE '' END) AS preview
FROM trimmed t JOIN documents d ON d.doc_id = t.id"""
SQL["csv_rows"] = _with(f"""SELECT line_id,
  strftime(wall_ts, '%Y-%m-%dT%H:%M:%S') || {ZONE} AS "Timestamp",
  level AS "Level", source AS "Source", message AS "Message", "user" AS "User",
  log_source AS "LogSource", ack_id AS "AckID", type AS "Type", status AS "Status",
  extras_text AS "Extras" FROM ev""")
SQL["json_rows"] = _with(f"""SELECT line_id, concat(
  '{{"timestamp":"', strftime(wall_ts, '%Y-%m-%dT%H:%M:%S'), {FRAC}, {ZONE}, '"',
  ',"level":', to_json(level), ',"message":', to_json(message), ',"source":', to_json(source),
  ',"user":', to_json("user"),
  CASE WHEN log_source <> '' THEN concat(',"log_source":', to_json(log_source), ',"ack_id":', to_json(ack_id),
       ',"type":', to_json(type), ',"status":', to_json(status)) ELSE '' END,
  ',"extras":{{',
  CASE WHEN line_format = 'json' THEN concat('"cents":', to_json(CAST(CAST(round(e.value * 100) AS BIGINT) AS VARCHAR)),
       ',"props":', to_json(replace(e.props, ' ', '')), ',"retry":',
       CASE WHEN ev.event_id % 3 = 0 THEN '"true"' ELSE '"false"' END)
  ELSE concat('"cents":', to_json(CAST(CAST(round(e.value * 100) AS BIGINT) AS VARCHAR)),
       ',"k":', to_json(json_extract_string(e.props, '$.k'))) END,
  '}}}}') AS json
FROM ev JOIN events e ON e.event_id = ev.event_id""")
SQL["pretty_rows"] = _with(f"""SELECT line_id, concat(
  {TS_TEXT}, ' [', level, '] ', source, ' → ', message, {NL},
  CASE WHEN "user" <> '' THEN concat('  User: ', "user", {NL}) ELSE '' END,
  CASE WHEN source <> '' THEN concat('  Source: ', source, {NL}) ELSE '' END,
  CASE WHEN log_source = 'notifications' THEN concat('  Log Source: ', log_source, {NL},
       CASE WHEN ack_id <> '' THEN concat('  Ack ID: ', ack_id, {NL}) ELSE '' END,
       CASE WHEN type <> '' THEN concat('  Type: ', type, {NL}) ELSE '' END,
       CASE WHEN status <> '' THEN concat('  Status: ', status, {NL}) ELSE '' END) ELSE '' END,
  CASE WHEN line_format = 'json' THEN concat('  cents: ', CAST(round(e.value * 100) AS BIGINT), {NL},
       '  props: ', replace(e.props, ' ', ''), {NL},
       '  retry: ', CASE WHEN ev.event_id % 3 = 0 THEN 'true' ELSE 'false' END, {NL})
  ELSE concat('  cents: ', CAST(round(e.value * 100) AS BIGINT), {NL},
       '  k: ', json_extract_string(e.props, '$.k'), {NL}) END,
  repeat('-', 80)) AS text
FROM ev JOIN events e ON e.event_id = ev.event_id""")


# --- files, time order, weights ------------------------------------------------
SQL["scan_files"] = _with("""
SELECT ts, wall_ts, tz_offset, level, message, source, "user", log_source, ack_id, type, status, extras_text FROM ev""")
SQL["tail_by_time"] = _with(""", tail AS (SELECT * FROM ev ORDER BY ts DESC, event_id DESC LIMIT 100)
SELECT CAST(row_number() OVER (ORDER BY ts, event_id) AS INTEGER) AS i, line_id, level, message FROM tail""")
EVENT_TIME_ENTRIES = f"""{EV},
tev AS (SELECT row_number() OVER (ORDER BY ts, event_id) AS tid, * FROM ev),
ent AS (SELECT tid AS id, level AS lvl_raw, source AS src_raw, message AS msg FROM tev)"""
SQL["trim_by_time"] = "WITH RECURSIVE " + trim_sql(EVENT_TIME_ENTRIES) + """
SELECT tev.event_id, tev.level, tev.source, tev.message, t.duplicate_count
FROM trimmed t JOIN tev ON tev.tid = t.id"""
SQL["weighted_levels"] = "WITH RECURSIVE " + trim_sql(EVENT_ENTRIES) + """
SELECT upper(ev.level) AS level, CAST(sum(t.duplicate_count) AS BIGINT) AS count
FROM trimmed t JOIN ev ON ev.event_id = t.id GROUP BY 1"""


# --- source pairs, packets, appended trim, report and array as rows ----------------
SQL["source_pairs"] = _with(""", s AS (
  SELECT DISTINCT lower(source) AS s FROM (SELECT source FROM ev UNION ALL SELECT coalesce(source, '') FROM documents)
  WHERE source <> '')
SELECT a.s AS a_source, b.s AS b_source, CAST(levenshtein(a.s, b.s) AS INTEGER) AS edits FROM s a JOIN s b ON a.s < b.s
WHERE 1 - levenshtein(a.s, b.s) / greatest(strlen(a.s), strlen(b.s)) > 0.7::DOUBLE""")

_PACKED = """, pk AS (
  SELECT *, event_id // 500 AS packet, event_id % 4 AS member_idx FROM ev),
names AS (SELECT unnest([0, 1, 3]) AS member_idx, unnest(['srv/logs/app.txt', 'notification_2.txt', 'srv\\logs\\b.txt']) AS member)
"""
SQL["packet_entries"] = _with(_PACKED + """
SELECT concat('packet-', lpad(packet::VARCHAR, 6, '0'), '.zip') AS packet, member, ts, wall_ts, tz_offset, level, message,
       source, "user", log_source, ack_id, type, status, extras_text
FROM pk JOIN names USING (member_idx) WHERE packet % 7 <> 6 AND NOT (packet % 5 = 2 AND member_idx = 3)""")
SQL["packet_status"] = """
WITH names AS (SELECT unnest([0, 1, 3]) AS member_idx,
                      unnest(['srv/logs/app.txt', 'notification_2.txt', 'srv\\logs\\b.txt']) AS member),
l AS (SELECT event_id // 500 AS packet, event_id % 4 AS member_idx,
        1 + CASE WHEN event_type = 'error' OR (event_type = 'signup' AND event_id % 2 = 1) THEN 1 ELSE 0 END AS n FROM events),
p AS (SELECT DISTINCT packet FROM l),
n AS (SELECT packet, member_idx, sum(n) AS lines FROM l GROUP BY ALL)
SELECT concat('packet-', lpad(packet::VARCHAR, 6, '0'), '.zip') AS packet_path, member_idx::INTEGER AS member_idx, member,
  CASE WHEN packet % 5 = 2 AND member_idx = 3 THEN 0 ELSE coalesce(lines, 0) END::BIGINT AS lines,
  CASE WHEN packet % 5 = 2 AND member_idx = 3 THEN 'member cannot be extracted' END AS problem
FROM p CROSS JOIN names LEFT JOIN n USING (packet, member_idx) WHERE packet % 7 <> 6
UNION ALL
SELECT concat('packet-', lpad(packet::VARCHAR, 6, '0'), '.zip'), NULL, NULL, 0, 'not a zip archive' FROM p WHERE packet % 7 = 6"""
SQL["trim_appended"] = SQL["trim_documents"]
SQL["search_indexed"] = SQL["filter_search"]

_REPORT = _with(_STAT_ITEMS.rsplit("SELECT * FROM r", 1)[0] + f"""
, one AS (
  SELECT CAST(sum(w) AS BIGINT) AS total, min_by(wall_ts, ts) AS first_wall, max_by(wall_ts, ts) AS last_wall,
    CAST(round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6) AS BIGINT) AS s,
    CAST(sum(CASE WHEN upper(level) IN ('ERROR', 'FATAL') THEN w ELSE 0 END) AS DOUBLE) AS errors FROM ev)
, head AS (SELECT concat(total, ' entries • ', CASE WHEN s >= 3600 THEN concat(s // 3600, 'h') ELSE '' END,
    CASE WHEN s >= 60 THEN concat(s % 3600 // 60, 'm') ELSE '' END, s % 60, 's • Error rate: ',
    printf('%.1f', errors / total * 100), '%') AS line FROM one)
, months AS (SELECT i, monthname(make_date(2000, CAST(i AS INTEGER), 1)) AS item FROM range(1, 13) t(i))
, days AS (SELECT i, dayname(make_date(2000, 1, CAST(i + 1 AS INTEGER))) AS item FROM range(1, 8) t(i))
, mb AS (SELECT i, item, coalesce(count, 0) AS count FROM months LEFT JOIN (SELECT * FROM r WHERE stat = 'month') USING (item))
, db AS (SELECT i, item, count FROM days JOIN (SELECT * FROM r WHERE stat = 'weekday' AND count > 0) USING (item))
, hb AS (SELECT CAST(item AS INTEGER) AS i, item, count FROM r WHERE stat = 'hour' AND count > 0)
""")


def _cut_items(stat: str, label: str, cut: int = 0, mark: str = "(") -> str:
    item = f"CASE WHEN length(item) > {cut} THEN left(item, {cut}) || '...' ELSE item END" if cut else "item"
    return (f"SELECT '{label}: ' || string_agg(concat({item}, '{mark}', count, ')'), ' • ' ORDER BY rank) AS line "
            f"FROM r WHERE stat = '{stat}' AND rank <= 3 AND count > 0 HAVING count(*) > 0")


def _bar(name: str, table: str, width: int) -> str:
    return (f"SELECT concat({name}, ': ', repeat('█', CAST(floor(count / (SELECT max(count) FROM {table}) * {width}) "
            f"AS INTEGER)), ' (', count, ')') AS line, i FROM {table}")


def _report(parts: list[str]) -> str:
    """The parts' lines, numbered; a part may give its lines' order as ``i``."""
    union = "\nUNION ALL BY NAME ".join(f"SELECT {k} AS part, * FROM ({p})" for k, p in enumerate(parts))
    return (f"{_REPORT}, every AS ({union})\n"
            "SELECT CAST(row_number() OVER (ORDER BY part, coalesce(i, 0)) AS INTEGER) AS line_no, line FROM every")


_LEVELS = "SELECT 'Levels: ' || string_agg({}, ' • ' ORDER BY rank) AS line FROM r, one WHERE stat = 'level' AND rank <= 100"
_SAY = "SELECT '{}' AS line, 0 AS i".format
SQL["report_compact"] = _report([
    _SAY(""), _SAY("LOG ANALYSIS"), "SELECT line FROM head", _SAY(""), _LEVELS.format("concat(item, ':', count)"),
    _cut_items("source", "Sources"), _cut_items("error", "Top Errors", 30), _cut_items("hour", "Peak Hours", 0, "h("), _SAY("")])
_LONG, _DAYS = " FROM one WHERE s >= 720 * 3600", " FROM one WHERE s >= 24 * 3600"
_NOTED = " WHERE EXISTS (SELECT 1 FROM r WHERE stat = 'notif_type')"
_STATED = _NOTED + " AND EXISTS (SELECT 1 FROM r WHERE stat = 'notif_status')"
_LISTED = "SELECT concat('  ', item, ': ', count) AS line, rank AS i FROM r WHERE stat = '{}'"
SQL["report_verbose"] = _report([
    _SAY(""), _SAY("=== LOG ANALYSIS ==="), "SELECT line FROM head",
    "SELECT concat(strftime(first_wall, '%Y-%m-%d %H:%M:%S'), ' to ', strftime(last_wall, '%Y-%m-%d %H:%M:%S')) AS line FROM one",
    _LEVELS.format("concat(item, ':', count, '(', printf('%.0f', count / total * 100), '%)')"),
    _cut_items("source", "Sources"), _cut_items("error", "Top Errors", 40),
    _SAY("Activity by Month:") + _LONG, _bar("rpad(item, 9, ' ')", "mb", 30) + _LONG.replace(" FROM one", "").replace(
        "s >=", "(SELECT s FROM one) >="), _SAY("") + _LONG,
    _SAY("Notification Statistics:") + _NOTED, _SAY("Notification Types:") + _NOTED, _LISTED.format("notif_type"),
    _SAY("Notification Statuses:") + _STATED, _LISTED.format("notif_status"), _SAY("") + _NOTED,
    _SAY("Activity by Hour:"), _bar("concat(lpad(item, 2, '0'), ':00')", "hb", 15), _SAY(""),
    _SAY("Activity by Day of Week:") + _DAYS, _bar("left(item, 3)", "db", 15) + _DAYS.replace(" FROM one", "").replace(
        "s >=", "(SELECT s FROM one) >="), _SAY("") + _DAYS,
    _SAY(""), _SAY("=== END OF ANALYSIS ==="), _SAY("")])

_J = f"""strftime(wall_ts, '%Y-%m-%dT%H:%M:%S'), {FRAC}, {ZONE}"""
SQL["json_array"] = _with(f"""SELECT ev.event_id, concat(
  CASE WHEN ev.event_id = (SELECT min(event_id) FROM events) THEN '[' || {NL} ELSE '' END,
  '  {{', {NL}, '    "timestamp": "', {_J}, '",', {NL}, '    "level": ', to_json(level), ',', {NL},
  '    "message": ', to_json(message), ',', {NL}, '    "source": ', to_json(source), ',', {NL},
  '    "user": ', to_json("user"), ',', {NL},
  CASE WHEN log_source <> '' THEN concat('    "log_source": ', to_json(log_source), ',', {NL},
    '    "ack_id": ', to_json(ack_id), ',', {NL}, '    "type": ', to_json(type), ',', {NL},
    '    "status": ', to_json(status), ',', {NL}) ELSE '' END,
  '    "extras": {{', {NL}, '      "cents": ', to_json(CAST(CAST(round(e.value * 100) AS BIGINT) AS VARCHAR)), ',', {NL},
  CASE WHEN line_format = 'json' THEN concat('      "props": ', to_json(replace(e.props, ' ', '')), ',', {NL},
    '      "retry": ', CASE WHEN ev.event_id % 3 = 0 THEN '"true"' ELSE '"false"' END)
  ELSE concat('      "k": ', to_json(json_extract_string(e.props, '$.k'))) END, {NL},
  '    }}', {NL}, '  }}',
  CASE WHEN ev.event_id = (SELECT max(event_id) FROM events) THEN {NL} || ']' ELSE ',' END) AS value
FROM ev JOIN events e ON e.event_id = ev.event_id""")
