"""The same questions in SQL, for DuckDB, over the same tables.

Nothing here is used by the engine. Patterns, words, ports and limits in the statements are
fixed values that results depend on. Each statement starts from `events`, rebuilds the
derived log table in SQL, and answers its query in the most direct way SQL has.
"""

from __future__ import annotations

LOGS = """
base AS (
  SELECT event_id AS log_id, event_type AS kind,
         CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
         make_timestamp(epoch_us(date_trunc('day', ts))
                        + (epoch_us(ts) - epoch_us(date_trunc('day', ts))) // 240) AS "timestamp",
         '10.0.' || CAST((user_id // 15) // 256 AS VARCHAR) || '.' || CAST((user_id // 15) % 256 AS VARCHAR) AS source_ip
  FROM events),
fields AS (
  SELECT *,
    CASE WHEN kind IN ('error', 'signup') THEN 22 WHEN kind = 'purchase' THEN 3306
         WHEN k % 4 = 0 THEN NULL ELSE 8000 + k % 40 END AS destination_port,
    CASE WHEN kind IN ('error', 'signup', 'purchase') THEN 'TCP' WHEN k % 5 = 0 THEN NULL
         WHEN k % 2 = 0 THEN 'UDP' ELSE 'TCP' END AS protocol,
    CASE kind WHEN 'error' THEN 'auth.log' WHEN 'signup' THEN 'auth.log' WHEN 'purchase' THEN 'sql.log'
              WHEN 'view' THEN 'ufw.log' WHEN 'click' THEN 'iptables' END AS log_source,
    CASE kind WHEN 'error' THEN 'SSH_FAILED_LOGIN' WHEN 'signup' THEN 'SSH_LOGIN_SUCCESS'
              WHEN 'purchase' THEN 'SQL_AUTH_FAILED' WHEN 'view' THEN 'UFW_TRAFFIC'
              WHEN 'click' THEN 'CONNECTION_ATTEMPT' END AS event_type,
    CASE WHEN kind = 'purchase' AND k % 10 = 0 THEN 'CRITICAL' WHEN kind IN ('purchase', 'error') THEN 'HIGH'
         WHEN kind = 'click' THEN 'MEDIUM' ELSE 'LOW' END AS severity,
    CASE WHEN kind IN ('error', 'signup') THEN 'user' || CAST(k % 7 AS VARCHAR) END AS username,
    strftime("timestamp", '%b') || ' ' || lpad(CAST(day("timestamp") AS VARCHAR), 2, ' ') || ' '
      || strftime("timestamp", '%H:%M:%S') AS stamp
  FROM base),
logs AS (
  SELECT log_id, "timestamp", source_ip, destination_port, protocol, log_source, event_type, severity, username,
    CASE
      WHEN kind = 'error' THEN stamp || ' host1 sshd[' || CAST(log_id AS VARCHAR) || ']: Failed password for '
        || CASE WHEN k % 3 = 0 THEN 'invalid user ' ELSE '' END || username || ' from ' || source_ip
        || ' port ' || CAST(40000 + k AS VARCHAR) || ' ssh2'
      WHEN kind = 'signup' THEN stamp || ' host1 sshd[' || CAST(log_id AS VARCHAR) || ']: Accepted password for '
        || username || ' from ' || source_ip || ' port ' || CAST(40000 + k AS VARCHAR) || ' ssh2'
      WHEN kind = 'purchase' THEN strftime("timestamp", '%Y-%m-%dT%H:%M:%S') || ' db1 mysqld: '
        || CASE WHEN k % 10 = 0 THEN 'select 1; -- ' WHEN k % 3 = 1 THEN 'denied login mysql' ELSE 'login denied mysql' END
        || ' from ' || source_ip
      ELSE stamp || ' host1 kernel: ' || CASE WHEN kind = 'view' THEN '[UFW AUDIT] ' ELSE '[1.5] ' END
        || 'IN=eth0 OUT= SRC=' || source_ip || ' DST=10.9.9.9' || coalesce(' PROTO=' || protocol, '')
        || coalesce(' DPT=' || CAST(destination_port AS VARCHAR), '')
        || CASE WHEN kind = 'view' THEN '' WHEN k % 3 = 0 THEN ' SYN URGP=0' WHEN k % 3 = 1 THEN ' ACK URGP=0' ELSE ' DROP' END
    END AS raw_log
  FROM fields)"""


def over_logs(query: str, *ctes: str, recursive: bool = False) -> str:
    """A statement over the derived log table, with further named parts before the query."""
    return f"WITH {'RECURSIVE ' if recursive else ''}{', '.join([LOGS, *ctes])}\n{query}"


_AS_OF = "TIMESTAMP '2024-01-30 00:02:00'"
_LAST_DAY = f"{_AS_OF} - INTERVAL 24 HOUR AND {_AS_OF}"


def _within(statement: str, bounds: str) -> str:
    """The statement over the rows of a period alone."""
    return statement.replace("\nlogs AS (", "\nall_logs AS (", 1).replace(
        "  FROM fields)", f'  FROM fields),\nlogs AS (SELECT * FROM all_logs WHERE "timestamp" BETWEEN {bounds})', 1)


def _iso(column: str) -> str:
    return (f"strftime({column}, '%Y-%m-%dT%H:%M:%S') || "
            f"CASE WHEN epoch_us({column}) % 1000000 = 0 THEN '' ELSE strftime({column}, '.%f') END")


def chain(name: str, candidates: str, keys: str, width: str) -> str:
    """Windows among candidate instants: hop to the first candidate after the last cover."""
    listed = keys.split(", ")
    same = " AND ".join(f"q.{k} IS NOT DISTINCT FROM h.{k}" for k in listed)
    of_h = ", ".join(f"h.{k}" for k in listed)
    return f"""{name} AS (
  SELECT {keys}, min(t0) AS t0 FROM {candidates} GROUP BY {keys}
  UNION ALL
  SELECT {of_h}, (SELECT min(q.t0) FROM {candidates} q WHERE {same} AND q.t0 > h.t0 + {width}) AS t0
  FROM {name} h WHERE h.t0 IS NOT NULL)"""


# --- brute force -----------------------------------------------------------------------

_FAILED = "failed AS (SELECT * FROM logs WHERE event_type = 'SSH_FAILED_LOGIN')"
_LOGIN_ANCHORS = """login_anchors AS (
  SELECT source_ip, "timestamp" AS t0,
         count(*) OVER w AS n, max("timestamp") OVER w AS until
  FROM failed
  WINDOW w AS (PARTITION BY source_ip ORDER BY "timestamp"
               RANGE BETWEEN CURRENT ROW AND INTERVAL 15 MINUTE FOLLOWING))"""
_LOGIN_QUALIFYING = "login_q AS (SELECT DISTINCT source_ip, t0, n, until FROM login_anchors WHERE n >= 5)"
_LOGIN_WINDOWS = """login_windows AS (
  SELECT q.source_ip, q.t0 AS window_start, q.until AS window_end, q.n AS attempt_count
  FROM login_q q JOIN login_hops h ON q.source_ip = h.source_ip AND q.t0 = h.t0)"""
BRUTE_PARTS = (_FAILED, _LOGIN_ANCHORS, _LOGIN_QUALIFYING,
               chain("login_hops", "login_q", "source_ip", "INTERVAL 15 MINUTE"), _LOGIN_WINDOWS)

BRUTE_DETECTIONS = """brute AS (
  SELECT f.source_ip, count(*) AS total_attempts,
         count(DISTINCT nullif(username, '')) AS unique_usernames_attempted,
         min("timestamp") AS first_attempt, max("timestamp") AS last_attempt,
         any_value(w.window_count) AS window_count,
         CASE WHEN count(*) >= 50 OR any_value(w.window_count) >= 5 THEN 'CRITICAL'
              WHEN count(*) >= 20 OR any_value(w.window_count) >= 3 THEN 'HIGH'
              WHEN count(*) >= 10 THEN 'MEDIUM' ELSE 'LOW' END AS severity
  FROM failed f
  JOIN (SELECT source_ip, count(*) AS window_count FROM login_windows GROUP BY source_ip) w
    ON f.source_ip = w.source_ip
  GROUP BY f.source_ip)"""

# --- port scan -------------------------------------------------------------------------

# Only rows with a source and a port take part, in anchors, counts and totals alike.
_SCAN_ROWS = "scan_rows AS (SELECT * FROM logs WHERE source_ip <> '' AND destination_port IS NOT NULL)"
_SCAN_ANCHORS = """scan_q AS (
  SELECT a.source_ip, a.t0, count(*) AS n, count(DISTINCT l.destination_port) AS k, max(l."timestamp") AS until
  FROM (SELECT DISTINCT source_ip, "timestamp" AS t0 FROM scan_rows) a
  JOIN scan_rows l ON l.source_ip = a.source_ip AND l."timestamp" BETWEEN a.t0 AND a.t0 + INTERVAL 10 MINUTE
  GROUP BY a.source_ip, a.t0 HAVING count(DISTINCT l.destination_port) >= 10)"""
_SCAN_WINDOWS = """scan_windows AS (
  SELECT q.source_ip, q.n AS attempt_count, q.k AS unique_ports, q.t0 AS window_start, q.until AS window_end
  FROM scan_q q JOIN scan_hops h ON q.source_ip = h.source_ip AND q.t0 = h.t0
  WHERE (SELECT count(*) FROM scan_rows l WHERE l.source_ip = q.source_ip) >= 20)"""
SCAN_PARTS = (_SCAN_ROWS, _SCAN_ANCHORS, chain("scan_hops", "scan_q", "source_ip", "INTERVAL 10 MINUTE"), _SCAN_WINDOWS)

SCAN_DETECTIONS = """scan AS (
  SELECT l.source_ip, count(*) AS total_attempts, count(DISTINCT destination_port) AS unique_ports_attempted,
         list_slice(list_sort(list(DISTINCT destination_port) FILTER (WHERE destination_port IS NOT NULL)), 1, 100) AS port_list,
         min("timestamp") AS first_attempt, max("timestamp") AS last_attempt,
         any_value(w.window_count) AS window_count,
         CASE WHEN count(DISTINCT destination_port) >= 50 OR any_value(w.window_count) >= 6 OR count(*) >= 500 THEN 'CRITICAL'
              WHEN count(DISTINCT destination_port) >= 25 OR any_value(w.window_count) >= 4 OR count(*) >= 200 THEN 'HIGH'
              WHEN count(DISTINCT destination_port) >= 10 OR any_value(w.window_count) >= 2 OR count(*) >= 50 THEN 'MEDIUM'
              ELSE 'LOW' END AS severity
  FROM scan_rows l
  JOIN (SELECT source_ip, count(*) AS window_count FROM scan_windows GROUP BY source_ip) w ON l.source_ip = w.source_ip
  GROUP BY l.source_ip)"""

# --- floods (60 s; 8 rows per source, or 20 rows of 3 sources per target) ----------------

_SOURCE_HOPS = chain("source_hops", "source_instants", "source_ip", "INTERVAL 60 SECOND")
SINGLE_PARTS = (
    'source_instants AS (SELECT DISTINCT source_ip, "timestamp" AS t0 FROM logs)',
    _SOURCE_HOPS,
    """source_windows AS (
  SELECT h.source_ip, h.t0, least(h.t0 + INTERVAL 60 SECOND, any_value(e.last)) AS closed, count(*) AS n
  FROM source_hops h
  JOIN logs l ON l.source_ip = h.source_ip AND l."timestamp" BETWEEN h.t0 AND h.t0 + INTERVAL 60 SECOND
  JOIN (SELECT source_ip, max("timestamp") AS last FROM logs GROUP BY source_ip) e ON e.source_ip = h.source_ip
  WHERE h.t0 IS NOT NULL GROUP BY h.source_ip, h.t0 HAVING count(*) >= 8)""",
)
SINGLE_DETECTIONS = """single AS (
  SELECT l.source_ip, count(*) AS total_requests, any_value(w.peak) AS peak_request_rate,
         CASE WHEN max("timestamp") > min("timestamp")
              THEN count(*) / ((epoch_us(max("timestamp")) - epoch_us(min("timestamp"))) / 60000000.0)
              ELSE count(*) END AS avg_request_rate,
         list_sort(list(DISTINCT destination_port) FILTER (WHERE destination_port <> 0)) AS port_list,
         list_sort(list(DISTINCT protocol) FILTER (WHERE protocol <> '')) AS protocol_list,
         min("timestamp") AS first_request, max("timestamp") AS last_request, any_value(w.window_count) AS window_count,
         CASE WHEN any_value(w.peak) >= 1000 OR any_value(w.window_count) >= 10 THEN 'CRITICAL'
              WHEN any_value(w.peak) >= 500 OR any_value(w.window_count) >= 5 THEN 'HIGH'
              WHEN any_value(w.peak) >= 200 OR any_value(w.window_count) >= 3 THEN 'MEDIUM' ELSE 'LOW' END AS severity
  FROM logs l
  JOIN (SELECT source_ip, count(*) AS window_count, max(n) / 1.0 AS peak FROM source_windows GROUP BY source_ip) w
    ON l.source_ip = w.source_ip
  GROUP BY l.source_ip)"""

TARGET_PARTS = (
    'target_instants AS (SELECT DISTINCT destination_port, protocol, "timestamp" AS t0 FROM logs)',
    chain("target_hops", "target_instants", "destination_port, protocol", "INTERVAL 60 SECOND"),
    """target_rows AS (
  SELECT h.destination_port, h.protocol, h.t0, l.source_ip
  FROM target_hops h
  JOIN logs l ON l.destination_port IS NOT DISTINCT FROM h.destination_port
             AND l.protocol IS NOT DISTINCT FROM h.protocol
             AND l."timestamp" BETWEEN h.t0 AND h.t0 + INTERVAL 60 SECOND
  WHERE h.t0 IS NOT NULL)""",
    """target_windows AS (
  SELECT t.destination_port AS target_port, t.protocol AS target_protocol, t.t0 AS window_start,
         least(t.t0 + INTERVAL 60 SECOND, any_value(e.last)) AS window_end,
         count(*) AS request_count, count(DISTINCT source_ip) AS unique_ip_count
  FROM target_rows t
  JOIN (SELECT destination_port, protocol, max("timestamp") AS last FROM logs GROUP BY ALL) e
    ON e.destination_port IS NOT DISTINCT FROM t.destination_port AND e.protocol IS NOT DISTINCT FROM t.protocol
  GROUP BY t.destination_port, t.protocol, t.t0
  HAVING count(*) >= 20 AND count(DISTINCT source_ip) >= 3)""",
)
TARGET_DETECTIONS = """
target_ips AS (
  SELECT destination_port, protocol, source_ip, count(*) AS requests,
         row_number() OVER (PARTITION BY destination_port, protocol ORDER BY count(*) DESC, source_ip) AS place
  FROM logs GROUP BY destination_port, protocol, source_ip),
distributed AS (
  SELECT l.destination_port AS target_port, l.protocol AS target_protocol,
         any_value(i.n_ips) AS source_ip_count, count(*) AS total_requests,
         any_value(w.peak) AS peak_request_rate,
         CASE WHEN max("timestamp") > min("timestamp")
              THEN count(*) / ((epoch_us(max("timestamp")) - epoch_us(min("timestamp"))) / 60000000.0)
              ELSE count(*) END AS avg_request_rate,
         any_value(w.peak_ips) AS peak_unique_ips, any_value(i.ips) AS ip_list,
         min("timestamp") AS first_request, max("timestamp") AS last_request, any_value(w.window_count) AS window_count,
         CASE WHEN any_value(w.peak) >= 2000 OR any_value(i.n_ips) >= 50 OR any_value(w.window_count) >= 10 THEN 'CRITICAL'
              WHEN any_value(w.peak) >= 1000 OR any_value(i.n_ips) >= 25 OR any_value(w.window_count) >= 5 THEN 'HIGH'
              WHEN any_value(w.peak) >= 500 OR any_value(i.n_ips) >= 15 OR any_value(w.window_count) >= 3 THEN 'MEDIUM'
              ELSE 'LOW' END AS severity
  FROM logs l
  JOIN (SELECT target_port, target_protocol, count(*) AS window_count, max(request_count) / 1.0 AS peak,
               max(unique_ip_count) AS peak_ips FROM target_windows GROUP BY ALL) w
    ON w.target_port IS NOT DISTINCT FROM l.destination_port AND w.target_protocol IS NOT DISTINCT FROM l.protocol
  JOIN (SELECT destination_port, protocol, count(*) AS n_ips,
               list(source_ip ORDER BY place) FILTER (WHERE place <= 20) AS ips FROM target_ips GROUP BY ALL) i
    ON i.destination_port IS NOT DISTINCT FROM l.destination_port AND i.protocol IS NOT DISTINCT FROM l.protocol
  GROUP BY l.destination_port, l.protocol)"""


# --- parsing: from the rendered text only ------------------------------------------------

_LINES = r"""lines AS (
  SELECT log_id, raw_log, lower(raw_log) AS low, log_source,
    CASE WHEN regexp_matches(raw_log, '^\d{4}-') THEN CAST(replace(substr(raw_log, 1, 19), 'T', ' ') AS TIMESTAMP)
         ELSE strptime('2024 ' || regexp_extract(raw_log, '[A-Z][a-z]{2} +\d{1,2} \d{2}:\d{2}:\d{2}', 0), '%Y %b %d %H:%M:%S')
    END AS "timestamp",
    nullif(regexp_extract(raw_log, 'Failed password for (?:invalid user )?(\w+) from ([\d.]+)', 1), '') AS failed_user,
    nullif(regexp_extract(raw_log, 'Failed password for (?:invalid user )?(\w+) from ([\d.]+)', 2), '') AS failed_ip,
    nullif(regexp_extract(raw_log, 'Accepted password for (\w+) from ([\d.]+)', 1), '') AS accepted_user,
    nullif(regexp_extract(raw_log, 'Accepted password for (\w+) from ([\d.]+)', 2), '') AS accepted_ip,
    nullif(regexp_extract(raw_log, 'SRC=([\d.]+)', 1), '') AS src,
    CAST(nullif(regexp_extract(raw_log, 'DPT=(\d+)', 1), '') AS INTEGER) AS dpt,
    nullif(regexp_extract(raw_log, 'PROTO=(\w+)', 1), '') AS proto,
    nullif(regexp_extract(raw_log, '\b((?:\d{1,3}\.){3}\d{1,3})\b', 1), '') AS ip,
    CAST(nullif(regexp_extract(raw_log, ':(\d{1,5})\b', 1), '') AS INTEGER) AS colon_port,
    nullif(regexp_extract(raw_log, ':\d{1,5}\b|port\s+\d{1,5}', 0), '') AS port_text
  FROM logs)"""

_RECORD = '''SELECT log_id, "timestamp", {ip} AS source_ip, CAST({port} AS INTEGER) AS destination_port, {protocol} AS protocol,
  '{source}' AS log_source, {event} AS event_type, {severity} AS severity, {user} AS username, raw_log FROM lines WHERE {where}'''


def _record(source, ip, port, protocol, event, severity, where, user="NULL::VARCHAR"):
    return _RECORD.format(source=source, ip=ip, port=port, protocol=protocol, event=event,
                          severity=severity, user=user, where=where)


_BY_PRODUCT = ("CASE WHEN contains(raw_log, '1433') OR contains(low, 'mssql') {more} THEN 1433 "
               "WHEN contains(raw_log, '3306') OR contains(low, 'mysql') THEN 3306 "
               "WHEN contains(raw_log, '5432') OR contains(low, 'postgres') THEN 5432 {last} END")
_SQL_PORT = ("coalesce(nullif(CASE WHEN port_text IS NOT NULL THEN CAST(regexp_extract(port_text, '\\d+', 0) AS INTEGER) ELSE "
             + _BY_PRODUCT.format(more="OR contains(low, 'sql server')",
                                  last="WHEN contains(raw_log, '1521') OR contains(low, 'oracle') THEN 1521")
             + " END, 0), 1433)")
_INJECTION = r"regexp_matches(raw_log, '(?:union|select|insert|delete|update|drop|exec|execute).*?(?:--|;|/\*|\*/)', 'i')"
_DENIED = r"regexp_matches(raw_log, '(?:failed|denied|error|unauthorized).*?(?:login|connection|authentication).*?(?:mysql|postgres|mssql|sql)', 'i')"
_CONNECTED = r"regexp_matches(raw_log, '(?:mysql|postgres|mssql|sql server).*?(?:connection|login|auth).*?from\s+([\d.]+)', 'i')"
_PORTED = "regexp_matches(raw_log, '1433|3306|5432|1521')"
_ABOUT_SQL = (r"(regexp_matches(raw_log, '(?:mysql|postgres|mssql|sql).*?(?:connection|login|auth).*?(?:failed|denied|error)', 'i') "
              r"OR regexp_matches(raw_log, 'port\s+(?:1433|3306|5432)', 'i'))")
_ALARM = "regexp_matches(low, 'denied|blocked|rejected|failed|error|attack|intrusion')"

P_AUTH = "p_auth AS (" + _record("auth.log", "failed_ip", "22", "'TCP'", "'SSH_FAILED_LOGIN'", "'HIGH'",
                                 "failed_ip IS NOT NULL", "failed_user") + " UNION ALL " + _record(
    "auth.log", "accepted_ip", "22", "'TCP'", "'SSH_LOGIN_SUCCESS'", "'LOW'",
    "failed_ip IS NULL AND accepted_ip IS NOT NULL", "accepted_user") + ")"
_UFW_HOT = "coalesce(dpt IN (22, 23, 1433, 3306), false)"
P_UFW = "p_ufw AS (" + _record(
    "ufw.log", "src", "dpt", "proto", f"CASE WHEN {_UFW_HOT} THEN 'SUSPICIOUS_PORT_ACCESS' ELSE 'UFW_TRAFFIC' END",
    f"CASE WHEN {_UFW_HOT} THEN 'HIGH' ELSE 'LOW' END", "contains(raw_log, '[UFW') AND src IS NOT NULL") + ")"
_NET_HOT = "coalesce(dpt IN (22, 23, 1433, 3306, 3389, 5432), false)"
_BLOCKED = "(contains(raw_log, 'DROP') OR contains(raw_log, 'REJECT'))"
_OPENING = "(contains(raw_log, 'SYN') AND NOT contains(raw_log, 'ACK'))"
P_IPTABLES = "p_iptables AS (" + _record(
    "iptables", "src", "dpt", "proto",
    f"CASE WHEN {_BLOCKED} THEN 'IPTABLES_BLOCKED' WHEN dpt IN (1433, 3306, 5432) THEN 'SQL_ACCESS_ATTEMPT' "
    f"WHEN {_NET_HOT} THEN 'SUSPICIOUS_PORT_ACCESS' WHEN {_OPENING} THEN 'CONNECTION_ATTEMPT' ELSE 'IPTABLES_TRAFFIC' END",
    f"CASE WHEN {_BLOCKED} OR {_OPENING} THEN 'MEDIUM' WHEN {_NET_HOT} THEN 'HIGH' ELSE 'LOW' END",
    "contains(raw_log, 'kernel:') AND src IS NOT NULL") + ")"
P_SQL = "p_sql AS (" + _record(
    "sql.log", "ip", _SQL_PORT, "'TCP'",
    f"CASE WHEN {_INJECTION} THEN 'SQL_INJECTION_ATTEMPT' WHEN {_DENIED} THEN 'SQL_AUTH_FAILED' "
    f"WHEN {_CONNECTED} THEN 'SQL_CONNECTION_ATTEMPT' WHEN {_PORTED} THEN 'SQL_PORT_ACCESS' ELSE 'SQL_ACCESS_ATTEMPT' END",
    f"CASE WHEN {_INJECTION} THEN 'CRITICAL' WHEN {_DENIED} THEN 'HIGH' WHEN {_CONNECTED} THEN 'MEDIUM' ELSE 'HIGH' END",
    "ip IS NOT NULL") + ")"
_SSH = "coalesce(failed_ip, accepted_ip) IS NOT NULL"
P_SYSLOG = "p_syslog AS (" + " UNION ALL ".join([
    _record("syslog", "coalesce(failed_ip, accepted_ip)", "22", "'TCP'",
            "CASE WHEN contains(raw_log, 'Failed password') THEN 'SSH_FAILED_LOGIN' ELSE 'SSH_LOGIN_SUCCESS' END",
            "CASE WHEN contains(raw_log, 'Failed password') THEN 'HIGH' ELSE 'LOW' END", _SSH),
    _record("syslog", "ip", f"coalesce(nullif(colon_port, 0), {_BY_PRODUCT.format(more='', last='')}, 1433)", "'TCP'",
            "CASE WHEN regexp_matches(low, 'failed|denied|error') THEN 'SQL_AUTH_FAILED' ELSE 'SQL_ACCESS_ATTEMPT' END",
            "'HIGH'", f"NOT ({_SSH}) AND ip IS NOT NULL AND {_ABOUT_SQL}"),
    _record("syslog", "ip", "colon_port", "NULL::VARCHAR",
            f"CASE WHEN {_ALARM} THEN 'SYSLOG_SECURITY_EVENT' ELSE 'SYSLOG_ENTRY' END",
            f"CASE WHEN {_ALARM} THEN 'MEDIUM' ELSE 'LOW' END", f"NOT ({_SSH}) AND ip IS NOT NULL AND NOT {_ABOUT_SQL}"),
]) + ")"
_ALL_PARSERS = (_LINES, P_AUTH, P_UFW, P_IPTABLES, P_SQL, P_SYSLOG)


def _first_of(*tables: str) -> str:
    """Per line, the record of the first parser that has one."""
    out = []
    for i, table in enumerate(tables):
        earlier = "".join(f" AND NOT EXISTS (SELECT 1 FROM {t} e WHERE e.log_id = p.log_id)" for t in tables[:i])
        out.append(f"SELECT p.* FROM {table} p WHERE true{earlier}")
    return " UNION ALL ".join(out)


def _hinted() -> str:
    of = {"p_auth": "auth.log", "p_ufw": "ufw.log", "p_iptables": "iptables", "p_sql": "sql.log"}
    by_hint = " UNION ALL ".join(
        f"SELECT p.* FROM {t} p JOIN lines l ON l.log_id = p.log_id WHERE l.log_source = '{h}'" for t, h in of.items())
    return (f"SELECT * FROM (WITH hinted AS ({by_hint}), rest AS ({_first_of('p_sql', 'p_auth', 'p_ufw', 'p_iptables', 'p_syslog')}) "
            "SELECT * FROM hinted UNION ALL SELECT * FROM rest r WHERE NOT EXISTS (SELECT 1 FROM hinted h WHERE h.log_id = r.log_id))")


# --- reputation ------------------------------------------------------------------------

REPUTATION_PARTS = ("""answers AS (
  SELECT source_ip AS ip, c, v, CASE v WHEN 0 THEN lo ELSE hi END AS cached_at,
         (c % 4 <> 3 OR v = 0) AS known, (c + v) % 13 AS m, c % 7 AS s, 40 + c % 30 AS u
  FROM (SELECT source_ip, CAST(count(*) AS INTEGER) AS c, min("timestamp") AS lo, max("timestamp") AS hi FROM logs GROUP BY source_ip),
       (VALUES (0), (1)) AS versions(v))""",
    """reputations AS (
  SELECT ip, known AND m > 0 AS detected,
         CASE WHEN known THEN CAST(trunc((m / (m + s + u)) * 100) AS INTEGER) ELSE 0 END AS reputation_score,
         CASE WHEN NOT known THEN 'UNKNOWN' WHEN m >= 10 THEN 'CRITICAL' WHEN m >= 5 THEN 'HIGH'
              WHEN m >= 2 OR s >= 5 THEN 'MEDIUM' WHEN m >= 1 OR s >= 1 THEN 'LOW' ELSE 'CLEAN' END AS threat_level,
         CASE WHEN known THEN m END AS malicious_count, CASE WHEN known THEN s END AS suspicious_count,
         CASE WHEN known THEN m + s + u END AS total_engines,
         CASE WHEN known THEN strftime(make_timestamp((1700000000 + c) * 1000000::BIGINT), '%Y-%m-%dT%H:%M:%S') END AS last_analysis_date,
         CASE WHEN known THEN CASE WHEN c % 5 = 0 THEN '' ELSE 'C' || CAST(c % 5 AS VARCHAR) END END AS country,
         CAST(CASE WHEN known THEN 1000 + c % 50 END AS BIGINT) AS asn,
         CASE WHEN known THEN 'owner' || CAST(c % 4 AS VARCHAR) END AS as_owner,
         CASE WHEN known THEN array_to_string(list_sort(list_distinct(['kind' || CAST(c % 3 AS VARCHAR), 'kind' || CAST(c % 2 AS VARCHAR)])), ',')
              ELSE '' END AS categories,
         CASE WHEN known THEN array_to_string(list_transform(range(0, least(m, 10)),
              lambda i: CASE WHEN i % 3 = 0 THEN 'Malicious' ELSE 'name' || CAST(i AS VARCHAR) END), ',') ELSE '' END AS detection_names,
         CASE WHEN known THEN 'https://www.virustotal.com/gui/ip-address/' || ip END AS virustotal_url,
         cached_at, c
  FROM answers)""",
    "newest AS (SELECT * EXCLUDE (c) FROM reputations r WHERE cached_at = (SELECT max(cached_at) FROM reputations q WHERE q.ip = r.ip) "
    "QUALIFY row_number() OVER (PARTITION BY ip ORDER BY detected DESC) = 1)",
    "half AS (SELECT * FROM newest WHERE asn % 2 = 0)",
)
_RANK = ("CASE {0} WHEN 'LOW' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'HIGH' THEN 3 WHEN 'CRITICAL' THEN 4 ELSE 0 END")
_LIFTED = ("CASE WHEN h.detected AND h.threat_level IN ('MEDIUM', 'HIGH', 'CRITICAL') AND "
           + _RANK.format("h.threat_level") + " > " + _RANK.format("{0}.severity") + " THEN h.threat_level ELSE {0}.severity END AS severity")
_FLOOD_UNION = """flood_all AS (
  SELECT 'SINGLE_IP_FLOOD' AS attack_type, NULL::INTEGER AS target_port, NULL::VARCHAR AS target_protocol, first_request,
         last_request, severity, peak_request_rate, avg_request_rate, total_requests, CAST(1 AS BIGINT) AS source_ip_count, window_count,
         [source_ip] AS ips FROM single
  UNION ALL
  SELECT 'DISTRIBUTED_FLOOD', target_port, target_protocol, first_request, last_request, severity, peak_request_rate,
         avg_request_rate, total_requests, source_ip_count, window_count, ip_list FROM distributed)"""


# --- threats and reports ---------------------------------------------------------------

_THREATS = """threat_list AS (
  SELECT 'brute_force' AS detector, severity FROM brute UNION ALL SELECT 'ddos', severity FROM flood_all
  UNION ALL SELECT 'port_scan', severity FROM scan)"""
_SUMMARY = """summary AS (
  SELECT count(*) FILTER (WHERE detector = 'brute_force') AS total_brute_force_attacks,
         count(*) FILTER (WHERE detector = 'ddos') AS total_ddos_attacks,
         count(*) FILTER (WHERE detector = 'port_scan') AS total_port_scan_attacks, count(*) AS total_threats,
         count(*) FILTER (WHERE severity = 'CRITICAL') AS critical_threats, count(*) FILTER (WHERE severity = 'HIGH') AS high_threats,
         count(*) FILTER (WHERE severity = 'MEDIUM') AS medium_threats, count(*) FILTER (WHERE severity = 'LOW') AS low_threats
  FROM threat_list)"""
_SCORE = """scored AS (
  SELECT score AS security_score, CASE WHEN score >= 80 THEN 'SECURE' WHEN score >= 60 THEN 'MODERATE'
         WHEN score >= 40 THEN 'WARNING' ELSE 'CRITICAL' END AS security_status
  FROM (SELECT greatest(0, 100 - least(20 * critical_threats, 80) - least(10 * high_threats, 60)
                           - least(5 * medium_threats, 40) - least(low_threats, 20)) AS score FROM summary))"""
_SOURCES = f"""sources AS (
  SELECT ip, CAST(sum(b) AS BIGINT) AS brute_force_attacks, CAST(sum(d) AS BIGINT) AS ddos_attacks,
         CAST(sum(a) AS BIGINT) AS total_attempts, CASE max(r) WHEN 4 THEN 'CRITICAL' WHEN 3 THEN 'HIGH' WHEN 2 THEN 'MEDIUM' ELSE 'LOW' END AS severity
  FROM (SELECT source_ip AS ip, 1 AS b, 0 AS d, total_attempts AS a, {_RANK.format('severity')} AS r FROM brute
        UNION ALL SELECT unnest(ips), 0, 1, total_requests, {_RANK.format('severity')} FROM flood_all
        UNION ALL SELECT source_ip, 0, 0, total_attempts, {_RANK.format('severity')} FROM scan)
  GROUP BY ip),
top_sources AS (SELECT * FROM sources ORDER BY total_attempts DESC, ip LIMIT 20)"""
_MALICIOUS = """classed AS (
  SELECT t.ip, t.total_attempts, coalesce(h.threat_level, 'UNKNOWN') AS threat_level, coalesce(h.reputation_score, 0) AS reputation_score,
         CASE WHEN h.ip IS NULL THEN 'unknown' WHEN detected OR h.threat_level IN ('CRITICAL', 'HIGH') THEN 'malicious'
              WHEN h.threat_level = 'MEDIUM' OR coalesce(suspicious_count, 0) > 0 THEN 'suspicious' ELSE 'clean' END AS class
  FROM top_sources t LEFT JOIN half h ON h.ip = t.ip),
analysis AS (
  SELECT count(*) AS total_ips_checked, count(*) FILTER (WHERE class = 'malicious') AS malicious_ips,
         count(*) FILTER (WHERE class = 'suspicious') AS suspicious_ips, count(*) FILTER (WHERE class = 'clean') AS clean_ips,
         count(*) FILTER (WHERE class = 'unknown') AS unknown_ips,
         list(ip || '/' || threat_level ORDER BY total_attempts DESC, ip) FILTER (WHERE class = 'malicious') AS entries,
         list(ip ORDER BY total_attempts DESC, ip) FILTER (WHERE class = 'malicious') AS names
  FROM classed)"""
_PORTS = """top_port_rows AS (
  SELECT destination_port AS port, count(*) AS n, min(protocol) AS protocol FROM logs
  WHERE destination_port IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10)"""
_ADVICE = """advice_rules AS (
  SELECT 1 AS rule_no, 0 AS place, 'CRITICAL: ' || critical_threats || ' critical threat(s) detected. Immediate action required - consider blocking source IPs and reviewing firewall rules.' AS text
  FROM summary WHERE critical_threats > 0
  UNION ALL SELECT 2, 0, 'High number of brute force attacks detected (' || total_brute_force_attacks || '). Consider implementing IP-based rate limiting and fail2ban.'
  FROM summary WHERE total_brute_force_attacks > 10
  UNION ALL SELECT 3, 0, 'DDoS attacks detected (' || total_ddos_attacks || '). Consider implementing DDoS protection services and rate limiting at the firewall level.'
  FROM summary WHERE total_ddos_attacks > 0
  UNION ALL SELECT 4, 0, 'High volume of HIGH severity logs (' || count(*) || '). Review and optimize firewall rules to reduce false positives.'
  FROM logs WHERE severity = 'HIGH' HAVING count(*) > 1000
  UNION ALL SELECT 5, -n, 'High traffic on port ' || port || ' detected. Ensure this port is properly secured and access is restricted.'
  FROM top_port_rows WHERE port IN (22, 23, 1433, 3306, 3389)
  UNION ALL SELECT 6, 0, 'CRITICAL: ' || malicious_ips || ' known malicious IP(s) detected in threat sources. Immediately block these IPs in your firewall: '
         || array_to_string(list_slice(names, 1, 5), ', ') FROM analysis WHERE malicious_ips > 0
  UNION ALL SELECT 7, 0, 'Warning: ' || suspicious_ips || ' suspicious IP(s) detected. Monitor these IPs closely and consider implementing additional security measures.'
  FROM analysis WHERE suspicious_ips > 0),
advice AS (
  SELECT * FROM advice_rules UNION ALL
  SELECT 99, 0, 'No critical issues detected. Continue monitoring and maintain current security posture.'
  WHERE NOT EXISTS (SELECT 1 FROM advice_rules))"""
_ISO = "CASE WHEN date_trunc('second', {0}) = {0} THEN strftime({0}, '%Y-%m-%dT%H:%M:%S') ELSE strftime({0}, '%Y-%m-%dT%H:%M:%S.%f') END"
_SUMMARY_LINES = (("Total Threats", "total_threats"), ("Critical Threats", "critical_threats"), ("High Threats", "high_threats"),
                  ("Medium Threats", "medium_threats"), ("Low Threats", "low_threats"))
_TOP_IP_ROWS = ("(SELECT source_ip, count(*) AS n, count(*) FILTER (WHERE severity = 'HIGH') AS h, count(*) FILTER (WHERE severity = 'MEDIUM') AS m, "
                "count(*) FILTER (WHERE severity = 'LOW') AS l FROM logs GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10)")
_BRUTE_LINE = f"source_ip || '|' || total_attempts || '|' || severity || '|' || {_ISO.format('first_attempt')} || '|' || {_ISO.format('last_attempt')}"


def _report_lines() -> str:
    constant = lambda section, line, *texts: [f"SELECT {section} AS section_no, {line} AS line_no, '{t}' AS line" for t in texts]
    rows = lambda section, text, source: f"SELECT {section}, 2, {text} FROM {source}"
    parts = [
        *constant(1, 0, "Firewall Security Report", "Generated:|2100-01-01T00:00:00", "Report Type:|CUSTOM",
                  "Period:|2000-01-01T00:00:00 to 2100-01-01T00:00:00"),
        *constant(2, 0, "SUMMARY"), "SELECT 2, 0, 'Total Logs|' || count(*) FROM logs",
        "SELECT 2, 0, 'Security Score|' || security_score FROM scored", "SELECT 2, 0, 'Security Status|' || security_status FROM scored",
        *[f"SELECT 2, 0, '{label}|' || {column} FROM summary" for label, column in _SUMMARY_LINES],
        *constant(3, 0, "LOG STATISTICS - SEVERITY DISTRIBUTION", "Severity|Count"),
        rows(3, "severity || '|' || count(*)", "logs GROUP BY severity"),
        *constant(4, 0, "LOG STATISTICS - EVENT TYPE DISTRIBUTION", "Event Type|Count"),
        rows(4, "event_type || '|' || count(*)", "logs GROUP BY event_type"),
        *constant(5, 0, "TOP SOURCE IPs", "IP Address|Total Count|HIGH|MEDIUM|LOW"),
        rows(5, "source_ip || '|' || n || '|' || h || '|' || m || '|' || l", _TOP_IP_ROWS),
        *constant(6, 0, "TOP PORTS", "Port|Count|Protocol"),
        rows(6, "port || '|' || n || '|' || coalesce(protocol, '')", "top_port_rows"),
        *constant(7, 0, "TIME BREAKDOWN", "Time|Total Logs|High Severity"),
        rows(7, "strftime(date_trunc('day', \"timestamp\"), '%Y-%m-%dT%H:%M:%S') || '|' || count(*) || '|' || count(*) FILTER (WHERE severity = 'HIGH')",
             "logs GROUP BY date_trunc('day', \"timestamp\")"),
        *constant(8, 0, "BRUTE FORCE ATTACKS", "Source IP|Total Attempts|Severity|First Attempt|Last Attempt"),
        rows(8, _BRUTE_LINE, "brute"),
        *constant(9, 0, "DDOS ATTACKS", "Attack Type|Source IP Count|Total Requests|Peak Rate (req/min)|Target Port|Target Protocol|Severity|First Request|Last Request"),
        rows(9, "attack_type || '|' || source_ip_count || '|' || total_requests || '|' || CAST(CAST(peak_request_rate AS DOUBLE) AS VARCHAR) || '|' || "
             "coalesce(CAST(target_port AS VARCHAR), '') || '|' || coalesce(target_protocol, '') || '|' || severity || '|' || "
             f"{_ISO.format('first_request')} || '|' || {_ISO.format('last_request')}", "flood_all"),
        *constant(10, 0, "PORT SCAN ATTACKS", "Source IP|Total Attempts|Unique Ports|Severity|First Attempt|Last Attempt"),
        rows(10, f"source_ip || '|' || total_attempts || '|' || unique_ports_attempted || '|' || severity || '|' || {_ISO.format('first_attempt')} || '|' || {_ISO.format('last_attempt')}", "scan"),
        *constant(11, 0, "TOP THREAT SOURCES", "IP Address|Brute Force Attacks|DDoS Attacks|Total Attempts|Severity"),
        rows(11, "ip || '|' || brute_force_attacks || '|' || ddos_attacks || '|' || total_attempts || '|' || severity", "top_sources"),
        *constant(12, 0, "RECOMMENDATIONS"),
        rows(12, "row_number() OVER (ORDER BY rule_no, place, text) || '. ' || text", "advice"),
        *[line for n in range(1, 12) for line in constant(n, 3, "")],
    ]
    return "\nUNION ALL ".join(parts)


def _print_lines() -> str:
    entry = lambda section, name, value: f"SELECT {section} AS section_no, 0 AS line_no, '{name}|{value}' AS line"
    of = lambda section, line, text, source: f"SELECT {section}, {line}, {text} FROM {source}"
    names = ("total_brute_force_attacks", "total_ddos_attacks", "total_port_scan_attacks", "total_threats",
             "critical_threats", "high_threats", "medium_threats", "low_threats")
    parts = [
        entry(1, "title", "CUSTOM Security Report"), entry(1, "generated_at", "2100-01-01T00:00:00"),
        entry(1, "start", "2000-01-01T00:00:00"), entry(1, "end", "2100-01-01T00:00:00"), entry(1, "report_type", "CUSTOM"),
        entry(2, "title", "Firewall Security Report"), entry(2, "subtitle", "CUSTOM Report"),
        entry(2, "generated", "2100-01-01 00:00:00 UTC"), entry(2, "period", "2000-01-01T00:00:00 to 2100-01-01T00:00:00"),
        of(3, 0, "'total_logs|' || count(*)", "logs"), of(3, 0, "'security_score|' || security_score", "scored"),
        of(3, 0, "'security_status|' || security_status", "scored"), *[of(3, 0, f"'{n}|' || {n}", "summary") for n in names],
        of(4, 2, "'severity_distribution|' || severity || '|' || count(*)", "logs GROUP BY severity"),
        of(4, 2, "'event_type_distribution|' || event_type || '|' || count(*)", "logs GROUP BY event_type"),
        of(4, 2, "'protocol_distribution|' || protocol || '|' || count(*)", "logs WHERE protocol IS NOT NULL GROUP BY protocol"),
        "SELECT 5, 0, 'IP Address|Total Count|HIGH|MEDIUM|LOW'",
        of(5, 2, "source_ip || '|' || n || '|' || h || '|' || m || '|' || l", _TOP_IP_ROWS),
        "SELECT 6, 0, 'Source IP|Total Attempts|Severity|First Attempt|Last Attempt'", of(6, 2, _BRUTE_LINE, "brute"),
        "SELECT 7, 0, 'Attack Type|Source IPs|Total Requests|Peak Rate|Target Port|Severity'",
        of(7, 2, "attack_type || '|' || source_ip_count || '|' || total_requests || '|' || printf('%.2f req/min', CAST(peak_request_rate AS DOUBLE)) || '|' || "
           "coalesce(CAST(nullif(target_port, 0) AS VARCHAR), '') || '|' || severity", "flood_all"),
        of(8, 2, "text", "advice"),
    ]
    return "\nUNION ALL ".join(parts)


# --- retention: the oldest rows go in batches of 70 until a third of the bytes is left ----

_SIZED = """sized AS (
  SELECT *, strlen(raw_log) + 200 AS bytes, row_number() OVER (ORDER BY "timestamp", log_id) AS place FROM logs)"""
_GONE = """gone AS (
  SELECT least((SELECT count(*) FROM sized), CAST(ceil(min(place) / 70.0) AS BIGINT) * 70) AS n
  FROM (SELECT place, sum(bytes) OVER (ORDER BY place) AS gone_bytes FROM sized)
  WHERE (SELECT sum(bytes) FROM sized) - gone_bytes <= (SELECT CAST(sum(bytes) AS BIGINT) // 3 FROM sized))"""


def statements() -> dict[str, str]:
    flood_parts = (*SINGLE_PARTS, SINGLE_DETECTIONS, *TARGET_PARTS, TARGET_DETECTIONS)
    detections = (*BRUTE_PARTS, BRUTE_DETECTIONS, *SCAN_PARTS, SCAN_DETECTIONS, *flood_parts)
    rec = lambda query, *ctes: over_logs(query, *ctes, recursive=True)
    shown = 'log_id, "timestamp", source_ip, destination_port, protocol, log_source, event_type, severity, username, raw_log'
    out = {
        # brute force
        "brute_force": rec("SELECT * FROM brute", *BRUTE_PARTS, BRUTE_DETECTIONS),
        "brute_force_windows": rec("SELECT * FROM login_windows", *BRUTE_PARTS),
        "brute_force_attempts": rec(
            'SELECT w.source_ip, w.window_start, f."timestamp", f.username, f.log_id FROM login_windows w '
            'JOIN failed f ON f.source_ip = w.source_ip AND f."timestamp" BETWEEN w.window_start AND w.window_end',
            *BRUTE_PARTS),
        "brute_force_usernames": over_logs(
            "SELECT DISTINCT source_ip, username FROM failed WHERE username <> ''", _FAILED),
        "ip_timeline": over_logs(
            'SELECT "timestamp", username, log_id FROM failed WHERE source_ip = \'10.0.0.3\'', _FAILED),
        "ip_timeline_total": over_logs(
            "SELECT '10.0.0.3' AS source_ip, count(*) AS total_attempts FROM failed WHERE source_ip = '10.0.0.3'", _FAILED),
        # port scan
        "port_scan": rec(
            "SELECT source_ip, total_attempts, unique_ports_attempted, array_to_string(port_list, ',') AS ports_attempted, "
            "first_attempt, last_attempt, window_count, severity FROM scan", *SCAN_PARTS, SCAN_DETECTIONS),
        "port_scan_windows": rec("SELECT * FROM scan_windows", *SCAN_PARTS),
        "port_scan_window_details": rec(
            """SELECT w.source_ip, w.window_start, w.window_end, w.attempt_count, w.unique_ports,
  (SELECT array_to_string(list_slice(list_sort(list(DISTINCT l.destination_port) FILTER (WHERE l.destination_port IS NOT NULL)), 1, 50), ',')
   FROM scan_rows l WHERE l.source_ip = w.source_ip AND l."timestamp" BETWEEN w.window_start AND w.window_end) AS ports,
  (SELECT array_to_string(list_slice(list(l.log_id ORDER BY l."timestamp", l.log_id), 1, 50), ',')
   FROM scan_rows l WHERE l.source_ip = w.source_ip AND l."timestamp" BETWEEN w.window_start AND w.window_end) AS attempts
FROM scan_windows w""", *SCAN_PARTS),
        # floods
        "single_flood_windows": rec(
            "SELECT source_ip, n AS request_count, round(n / 1.0, 4) AS request_rate_per_min, t0 AS window_start, "
            "closed AS window_end FROM source_windows", *SINGLE_PARTS),
        "single_ip_flood": rec(
            "SELECT source_ip, total_requests, round(peak_request_rate, 4) AS peak_request_rate, "
            "round(avg_request_rate, 4) AS avg_request_rate, array_to_string(port_list, ',') AS target_ports, "
            "array_to_string(protocol_list, ',') AS target_protocols, first_request, last_request, window_count, severity "
            "FROM single", *SINGLE_PARTS, SINGLE_DETECTIONS),
        "single_flood_window_counts": rec(
            'SELECT w.source_ip, w.t0 AS window_start, nullif(l.destination_port, 0) AS port, l.protocol, count(*) AS requests '
            'FROM source_windows w JOIN logs l ON l.source_ip = w.source_ip '
            'AND l."timestamp" BETWEEN w.t0 AND w.t0 + INTERVAL 60 SECOND GROUP BY ALL', *SINGLE_PARTS),
        "distributed_flood_windows": rec(
            """SELECT target_port, target_protocol, window_start, window_end, request_count, unique_ip_count,
  round(request_count / 1.0, 4) AS request_rate_per_min,
  (SELECT string_agg(ip || '=' || CAST(c AS VARCHAR), ',' ORDER BY c DESC, ip) FROM (
     SELECT r.source_ip AS ip, count(*) AS c FROM target_rows r
     WHERE r.destination_port IS NOT DISTINCT FROM w.target_port AND r.protocol IS NOT DISTINCT FROM w.target_protocol
       AND r.t0 = w.window_start GROUP BY r.source_ip ORDER BY c DESC, ip LIMIT 10)) AS top_attacking_ips
FROM target_windows w""", *TARGET_PARTS),
        "distributed_flood": rec(
            "SELECT target_port, target_protocol, source_ip_count, total_requests, round(peak_request_rate, 4) AS peak_request_rate, "
            "round(avg_request_rate, 4) AS avg_request_rate, peak_unique_ips, array_to_string(ip_list, ',') AS source_ips, "
            "first_request, last_request, window_count, severity FROM distributed", *TARGET_PARTS, TARGET_DETECTIONS),
        # filters and browsing
        "log_filter": over_logs(
            f"SELECT {shown} FROM logs WHERE severity = 'HIGH' AND protocol = 'TCP' AND destination_port = 3306 "
            "AND \"timestamp\" >= TIMESTAMP '2024-01-03 00:00:00' AND \"timestamp\" <= TIMESTAMP '2024-01-20 00:03:00'"),
        "log_search": over_logs(
            f"SELECT {shown} FROM logs WHERE regexp_matches(source_ip, 'INVALID user|10\\.0\\.0\\.[37]$', 'i') "
            "OR regexp_matches(raw_log, 'INVALID user|10\\.0\\.0\\.[37]$', 'i') "
            "OR coalesce(regexp_matches(username, 'INVALID user|10\\.0\\.0\\.[37]$', 'i'), false)"),
        "log_page": over_logs(f'SELECT {shown} FROM logs ORDER BY "timestamp" DESC, log_id LIMIT 50 OFFSET 100'),
        "log_page_stored": over_logs(f'SELECT {shown} FROM logs ORDER BY "timestamp" DESC, log_id LIMIT 50 OFFSET 100'),
        "logs_by_hour_stored": over_logs(
            "SELECT strftime(\"timestamp\", '%Y-%m-%dT%H:00:00') AS hour, count(*) AS count FROM logs "
            "WHERE \"timestamp\" BETWEEN TIMESTAMP '2024-01-05 00:02:30' AND TIMESTAMP '2024-01-29 00:03:00' GROUP BY 1"),
        "log_page_by_severity": over_logs(f"SELECT {shown} FROM logs ORDER BY severity, log_id LIMIT 40 OFFSET 80"),
        "log_page_info": over_logs(
            "SELECT count(*) AS total, 3 AS page, 50 AS page_size, CAST(ceil(count(*) / 50.0) AS BIGINT) AS total_pages "
            "FROM logs WHERE severity = 'HIGH'"),
        "log_lookup": over_logs(f"SELECT {shown} FROM logs WHERE log_id = 77"),
        "log_defaults": over_logs(
            "SELECT log_id, \"timestamp\", source_ip, CASE WHEN log_id % 3 = 0 THEN 'unknown' ELSE log_source END AS log_source, "
            "CASE WHEN log_id % 5 = 0 THEN 'UNKNOWN' ELSE event_type END AS event_type, "
            "CASE WHEN log_id % 7 = 0 THEN 'LOW' ELSE severity END AS severity, raw_log FROM logs WHERE log_id % 11 <> 0"),
        "recent_activity": over_logs(f'SELECT {shown} FROM logs ORDER BY "timestamp" DESC, log_id LIMIT 50'),
        # statistics
        "total_logs": over_logs("SELECT count(*) AS total_logs FROM logs"),
        "severity_counts": over_logs("SELECT severity, count(*) AS count FROM logs GROUP BY severity"),
        "event_type_counts": over_logs("SELECT event_type, count(*) AS count FROM logs GROUP BY event_type"),
        "protocol_counts": over_logs("SELECT protocol, count(*) AS count FROM logs WHERE protocol IS NOT NULL GROUP BY protocol"),
        "logs_by_hour": over_logs(
            "SELECT strftime(\"timestamp\", '%Y-%m-%dT%H:00:00') AS hour, count(*) AS count FROM logs GROUP BY 1"),
        "top_ips": over_logs(
            "SELECT source_ip, count(*) AS count, count(*) FILTER (WHERE severity = 'HIGH') AS high, "
            "count(*) FILTER (WHERE severity = 'MEDIUM') AS medium, count(*) FILTER (WHERE severity = 'LOW') AS low "
            "FROM logs GROUP BY source_ip ORDER BY 2 DESC, 1 LIMIT 10"),
        "top_ports": over_logs(
            "SELECT destination_port AS port, count(*) AS count, min(protocol) AS protocol FROM logs "
            "WHERE destination_port IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10"),
        "severity_share": over_logs(
            "SELECT severity, count(*) AS count, CAST(floor(count(*) * 100 / sum(count(*)) OVER () + 0.5) AS BIGINT) AS percent "
            "FROM logs GROUP BY severity"),
        "top_event_types": over_logs(
            "SELECT replace(event_type, '_', ' ') AS event_type, count(*) AS count FROM logs GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10"),
        "stats_bundle": over_logs(
            """SELECT 'total_logs' AS statistic, 'all' AS key, count(*) AS count, NULL AS detail FROM logs
UNION ALL SELECT 'severity_counts', severity, count(*), NULL FROM logs GROUP BY severity
UNION ALL SELECT 'event_type_counts', event_type, count(*), NULL FROM logs GROUP BY event_type
UNION ALL SELECT 'protocol_counts', protocol, count(*), NULL FROM logs WHERE protocol IS NOT NULL GROUP BY protocol
UNION ALL SELECT 'logs_by_hour', strftime("timestamp", '%Y-%m-%dT%H:00:00'), count(*), NULL FROM logs
  WHERE "timestamp" BETWEEN TIMESTAMP '2024-01-30 00:02:00' - INTERVAL 24 HOUR AND TIMESTAMP '2024-01-30 00:02:00' GROUP BY 2
UNION ALL (SELECT 'top_source_ips', source_ip, count(*), concat_ws(',',
    'HIGH=' || nullif(count(*) FILTER (WHERE severity = 'HIGH'), 0), 'MEDIUM=' || nullif(count(*) FILTER (WHERE severity = 'MEDIUM'), 0),
    'LOW=' || nullif(count(*) FILTER (WHERE severity = 'LOW'), 0)) FROM logs GROUP BY source_ip ORDER BY 3 DESC, 2 LIMIT 10)
UNION ALL (SELECT 'top_ports', CAST(destination_port AS VARCHAR), count(*), min(protocol) FROM logs WHERE destination_port IS NOT NULL
  GROUP BY destination_port ORDER BY 3 DESC, destination_port LIMIT 10)"""),
        "time_breakdown": over_logs(
            "SELECT strftime(\"timestamp\", '%Y-%m-%dT00:00:00') AS time, count(*) AS count, "
            "count(*) FILTER (WHERE severity = 'HIGH') AS high_severity FROM logs GROUP BY 1"),
    }
    # parsing
    for name in ("auth", "ufw", "iptables", "sql", "syslog"):
        out[f"parse_{name}"] = over_logs(f"SELECT * FROM p_{name}", *_ALL_PARSERS)
    out.update({
        "parse_routed": over_logs(_hinted(), *_ALL_PARSERS),
        "parse_unhinted": over_logs(_first_of("p_sql", "p_auth", "p_ufw", "p_iptables", "p_syslog"), *_ALL_PARSERS),
        "parse_specific_first": over_logs(_first_of("p_auth", "p_ufw", "p_iptables", "p_sql", "p_syslog"), *_ALL_PARSERS),
        "parse_failures": over_logs(
            "SELECT log_id AS line_id, raw_log AS line, log_source AS log_source_hint FROM lines l "
            "WHERE NOT EXISTS (SELECT 1 FROM p_ufw p WHERE p.log_id = l.log_id)", *_ALL_PARSERS),
        "ingest_summary": over_logs(
            "SELECT n > 0 AS success, n AS ingested_count, t - n AS failed_count, t AS total_received, "
            "'Successfully ingested ' || n || ' log(s). ' || (t - n) || ' failed to parse.' AS message "
            "FROM (SELECT (SELECT count(*) FROM p_auth) AS n, (SELECT count(*) FROM logs) AS t)", *_ALL_PARSERS),
        # reputation
        "reputation_normalize": over_logs("SELECT * EXCLUDE (c) FROM reputations", *REPUTATION_PARTS),
        "reputation_latest": over_logs("SELECT * FROM newest", *REPUTATION_PARTS),
        "reputation_known_at": over_logs(
            "SELECT ip, threat_level, cached_at, cached_at > TIMESTAMP '2024-01-30 00:02:00' - INTERVAL 24 HOUR AS is_fresh "
            "FROM reputations r WHERE cached_at = (SELECT max(cached_at) FROM reputations q WHERE q.ip = r.ip "
            "AND q.cached_at <= TIMESTAMP '2024-01-30 00:02:00')", *REPUTATION_PARTS),
        "reputation_lookup": over_logs(
            """SELECT i.ip, coalesce(detected, false) AS detected, coalesce(reputation_score, 0) AS reputation_score,
  coalesce(threat_level, 'UNKNOWN') AS threat_level,
  CASE WHEN h.ip IS NULL THEN 'Unable to fetch reputation' END AS error,
  CASE WHEN h.ip IS NULL THEN 'unknown' WHEN detected OR threat_level IN ('CRITICAL', 'HIGH') THEN 'malicious'
       WHEN threat_level = 'MEDIUM' OR coalesce(suspicious_count, 0) > 0 THEN 'suspicious' ELSE 'clean' END AS class
FROM (SELECT DISTINCT source_ip AS ip FROM logs) i LEFT JOIN half h ON h.ip = i.ip""", *REPUTATION_PARTS),
        "logs_enriched": over_logs(
            f"SELECT l.log_id, l.source_ip, {_LIFTED.format('l')}, h.threat_level, h.reputation_score "
            "FROM logs l LEFT JOIN half h ON h.ip = l.source_ip", *REPUTATION_PARTS),
        "brute_force_enriched": rec(
            f"SELECT b.source_ip, b.total_attempts, {_LIFTED.format('b')}, h.threat_level FROM brute b "
            "LEFT JOIN half h ON h.ip = b.source_ip", *BRUTE_PARTS, BRUTE_DETECTIONS, *REPUTATION_PARTS),
        "flood_reputation": rec(
            "SELECT attack_type, target_port, target_protocol, first_request, severity, d.ip, "
            "coalesce(h.threat_level, 'UNKNOWN') AS threat_level, "
            "CASE WHEN h.ip IS NULL THEN 'Unable to fetch reputation' END AS error "
            "FROM (SELECT * EXCLUDE (ips), unnest(ips) AS ip FROM flood_all) d LEFT JOIN half h ON h.ip = d.ip",
            *flood_parts, _FLOOD_UNION, *REPUTATION_PARTS),
    })
    # threats, reports and the dashboard
    seen = (*detections, _FLOOD_UNION, _THREATS, _SUMMARY, _SCORE, _SOURCES)
    full = (*seen, *REPUTATION_PARTS, _MALICIOUS, _PORTS, _ADVICE)
    out.update({
        "flood_detections": rec(
            "SELECT attack_type, array_to_string(ips, ',') AS source_ips, source_ip_count, total_requests, "
            "round(peak_request_rate, 4) AS peak_request_rate, round(avg_request_rate, 4) AS avg_request_rate, target_port, "
            "target_protocol, first_request, last_request, window_count, severity FROM flood_all", *flood_parts, _FLOOD_UNION),
        "flood_filter": rec(
            "SELECT attack_type, target_port, target_protocol, total_requests, severity FROM flood_all "
            "WHERE severity = 'CRITICAL' AND list_contains(ips, '10.0.0.3')", *flood_parts, _FLOOD_UNION),
        "threat_summary": rec("SELECT * FROM summary", *seen),
        "threat_levels": rec("SELECT detector, severity, count(*) AS detections FROM threat_list GROUP BY ROLLUP (detector, severity)", *seen),
        "active_threats": rec("SELECT critical_threats + high_threats AS active_threats FROM summary", *seen),
        "security_score": rec("SELECT * FROM scored", *seen),
        "threat_sources": rec("SELECT * FROM sources", *seen),
        "top_threat_sources": rec("SELECT * FROM top_sources", *seen),
        "threat_source_reputation": rec("SELECT * FROM classed", *full),
        "malicious_ip_analysis": rec(
            "SELECT * EXCLUDE (entries, names), coalesce(array_to_string(entries, ','), '') AS malicious_ip_list FROM analysis", *full),
        "threat_labels": rec(
            """SELECT label, source, count(*) AS detections FROM (
  SELECT 'Brute Force' AS label, source_ip AS source FROM brute UNION ALL SELECT 'Port Scan', source_ip FROM scan
  UNION ALL SELECT replace(attack_type, '_', ' '), 'Unknown' FROM flood_all) GROUP BY ALL""", *seen),
        "active_alerts": rec(
            f"""SELECT type, source_ip, severity, detected_at, description, threat_count FROM (
  SELECT 'BRUTE_FORCE' AS type, source_ip, severity, last_attempt AS detected_at,
         'Brute force attack: ' || total_attempts || ' failed login attempts' AS description, total_attempts AS threat_count
  FROM (SELECT * FROM brute ORDER BY total_attempts DESC, source_ip LIMIT 5)
  UNION ALL SELECT 'DDOS', ips[1], severity, last_request,
         CASE attack_type WHEN 'DISTRIBUTED_FLOOD' THEN 'Distributed DDoS: ' || source_ip_count || ' IPs, ' || total_requests || ' requests'
              ELSE 'Single IP flood: ' || total_requests || ' requests' END, total_requests
  FROM (SELECT * FROM flood_all ORDER BY {_RANK.format('severity')} DESC, peak_request_rate DESC, array_to_string(ips, ',') LIMIT 5)
  UNION ALL SELECT 'PORT_SCAN', source_ip, severity, last_attempt,
         'Port scan detected: ' || unique_ports_attempted || ' unique ports attempted', total_attempts
  FROM (SELECT * FROM scan ORDER BY {_RANK.format('severity')} DESC, unique_ports_attempted DESC, total_attempts DESC, source_ip LIMIT 5))
WHERE severity IN ('CRITICAL', 'HIGH')
ORDER BY {_RANK.format('severity')} DESC, detected_at DESC, type, source_ip, description LIMIT 10""", *seen),
        "recommendations": rec("SELECT rule_no, text FROM advice", *full),
        "report_summary": rec(
            "SELECT (SELECT count(*) FROM logs) AS total_logs, scored.*, summary.* FROM scored, summary", *full),
        "report_sections": rec(_report_lines(), *full),
        "report_print_sections": rec(_print_lines(), *full),
        "report_json": rec(
            rf"""SELECT 'summary' AS section, concat_ws('|', (SELECT count(*) FROM logs), security_score, security_status, total_threats,
    critical_threats, high_threats, medium_threats, low_threats) AS value FROM scored, summary
UNION ALL SELECT 'report', 'CUSTOM|2000-01-01T00:00:00|2100-01-01T00:00:00'
UNION ALL SELECT 'severity_distribution', severity || '|' || count(*) FROM logs GROUP BY severity
UNION ALL SELECT 'event_type_distribution', event_type || '|' || count(*) FROM logs GROUP BY event_type
UNION ALL SELECT 'protocol_distribution', protocol || '|' || count(*) FROM logs WHERE protocol IS NOT NULL GROUP BY protocol
UNION ALL (SELECT 'top_source_ips', concat_ws('|', source_ip, count(*), count(*) FILTER (WHERE severity = 'HIGH'),
    count(*) FILTER (WHERE severity = 'MEDIUM'), count(*) FILTER (WHERE severity = 'LOW')) FROM logs
  GROUP BY source_ip ORDER BY count(*) DESC, source_ip LIMIT 10)
UNION ALL (SELECT 'top_ports', concat_ws('|', destination_port, count(*), coalesce(min(protocol), '-')) FROM logs
  WHERE destination_port IS NOT NULL GROUP BY destination_port ORDER BY count(*) DESC, destination_port LIMIT 10)
UNION ALL SELECT 'brute_force_attacks', concat_ws('|', source_ip, total_attempts, severity, {_iso('first_attempt')}, {_iso('last_attempt')}) FROM brute
UNION ALL SELECT 'ddos_attacks', concat_ws('|', attack_type, source_ip_count, total_requests, round(peak_request_rate, 4),
    coalesce(CAST(target_port AS VARCHAR), '-'), coalesce(target_protocol, '-'), severity, {_iso('first_request')}, {_iso('last_request')}) FROM flood_all
UNION ALL SELECT 'port_scan_attacks', concat_ws('|', source_ip, total_attempts, unique_ports_attempted, severity,
    {_iso('first_attempt')}, {_iso('last_attempt')}) FROM scan
UNION ALL SELECT 'top_threat_sources', concat_ws('|', ip, total_attempts, severity) FROM top_sources
UNION ALL SELECT 'recommendations', text FROM advice""", *full),
        "log_page_deep": over_logs(f'SELECT {shown} FROM logs ORDER BY "timestamp" DESC, log_id LIMIT 50 OFFSET 7450'),
        "log_page_deep_by_severity": over_logs(f"SELECT {shown} FROM logs ORDER BY severity, log_id LIMIT 40 OFFSET 7960"),
        "log_page_by_source": over_logs(f"SELECT {shown} FROM logs ORDER BY source_ip DESC, log_id LIMIT 30 OFFSET 2970"),
        "detection_order": rec(
            f"""SELECT 'brute_force' AS detector, row_number() OVER (ORDER BY total_attempts DESC, source_ip) AS place,
  source_ip AS key, total_attempts AS size FROM brute
UNION ALL SELECT 'port_scan', row_number() OVER (ORDER BY {_RANK.format('severity')} DESC, unique_ports_attempted DESC,
  total_attempts DESC, source_ip), source_ip, total_attempts FROM scan
UNION ALL SELECT 'ddos', row_number() OVER (ORDER BY {_RANK.format('severity')} DESC, peak_request_rate DESC,
  array_to_string(ips, ',')), array_to_string(ips, ','), total_requests FROM flood_all""", *seen),
        "port_scan_enriched": rec(
            f"SELECT b.source_ip, b.total_attempts, {_LIFTED.format('b')}, h.threat_level FROM scan b "
            "LEFT JOIN half h ON h.ip = b.source_ip", *SCAN_PARTS, SCAN_DETECTIONS, *REPUTATION_PARTS),
        "dashboard_top_ips_all_time": over_logs(
            """SELECT source_ip, count(*) AS total_logs, count(*) FILTER (WHERE severity = 'HIGH') AS high,
  count(*) FILTER (WHERE severity = 'MEDIUM') AS medium, count(*) FILTER (WHERE severity = 'LOW') AS low,
  max("timestamp") AS last_seen FROM logs GROUP BY source_ip ORDER BY 2 DESC, 1 LIMIT 10"""),
        "table_round_trip": over_logs(f"SELECT {shown} FROM logs"),
        "reputation_stored": over_logs("SELECT * FROM newest", *REPUTATION_PARTS),
        "parse_odd_lines": over_logs(
            """SELECT log_id, seen AS "timestamp", source_ip, port AS destination_port, protocol, 'syslog' AS log_source, event AS event_type,
  level AS severity, NULL AS username, line AS raw_log
FROM (
  SELECT log_id, source_ip, TIMESTAMP '2024-06-01 12:00:00' AS seen, NULL AS port, NULL AS protocol, 'SYSLOG_ENTRY' AS event, 'LOW' AS level,
    'gw app: hello from ' || source_ip AS line FROM logs WHERE log_id % 5 = 1
  UNION ALL SELECT log_id, source_ip, TIMESTAMP '2024-03-03 04:05:06', 22, 'TCP', 'SSH_FAILED_LOGIN', 'HIGH',
    'Mar  3 04:05:06 gw sshd[7]: Invalid user bob from ' || source_ip FROM logs WHERE log_id % 5 = 2
  UNION ALL SELECT log_id, source_ip, TIMESTAMP '2024-06-01 12:00:00', 3306, 'TCP', 'SQL_AUTH_FAILED', 'HIGH',
    'mysql login failed for ' || source_ip FROM logs WHERE log_id % 5 = 3
  UNION ALL SELECT log_id, source_ip, TIMESTAMP '2024-02-03 04:05:06', 5, NULL, 'SYSLOG_SECURITY_EVENT', 'MEDIUM',
    '2024-02-03T04:05:06 gw app: traffic blocked from ' || source_ip FROM logs WHERE log_id % 5 = 4)"""),
        "brute_force_last_day": _within(rec("SELECT * FROM brute", *BRUTE_PARTS, BRUTE_DETECTIONS), _LAST_DAY),
        "port_scan_last_day": _within(rec(
            "SELECT source_ip, attempt_count, unique_ports, window_start, window_end FROM scan_windows", *SCAN_PARTS), _LAST_DAY),
        "single_flood_last_hour": _within(rec(
            "SELECT source_ip, n AS request_count, round(n / 1.0, 4) AS request_rate_per_min, t0 AS window_start, "
            "closed AS window_end FROM source_windows", *SINGLE_PARTS), f"{_AS_OF} - INTERVAL 1 HOUR AND {_AS_OF}"),
        "daily_report": _within(rec(
            "SELECT (SELECT count(*) FROM logs) AS total_logs, scored.*, summary.* FROM scored, summary", *full),
            "TIMESTAMP '2024-01-30 00:00:00' AND TIMESTAMP '2024-01-30 23:59:59.999999'"),
        "weekly_report": _within(rec(
            "SELECT (SELECT count(*) FROM logs) AS total_logs, scored.*, summary.* FROM scored, summary", *full),
            f"TIMESTAMP '2024-01-23 00:00:00' AND {_AS_OF}"),
        "dashboard_top_ips": over_logs(
            """SELECT l.source_ip, count(*) AS total_logs, count(*) FILTER (WHERE severity = 'HIGH') AS high,
  count(*) FILTER (WHERE severity = 'MEDIUM') AS medium, count(*) FILTER (WHERE severity = 'LOW') AS low,
  any_value(s.seen) AS last_seen
FROM logs l JOIN (SELECT source_ip, max("timestamp") AS seen FROM logs GROUP BY source_ip) s ON s.source_ip = l.source_ip
WHERE "timestamp" BETWEEN TIMESTAMP '2024-01-30 00:02:00' - INTERVAL 7 DAY AND TIMESTAMP '2024-01-30 00:02:00'
GROUP BY l.source_ip ORDER BY 2 DESC, 1 LIMIT 10"""),
        "health_24h": over_logs(
            """SELECT count(*) FILTER (WHERE recent) AS total_logs_24h, count(*) FILTER (WHERE recent AND severity = 'HIGH') AS high_severity_logs_24h,
  max("timestamp") AS last_log_timestamp
FROM (SELECT *, "timestamp" BETWEEN TIMESTAMP '2024-01-30 00:02:00' - INTERVAL 24 HOUR AND TIMESTAMP '2024-01-30 00:02:00' AS recent FROM logs)"""),
        "dashboard_score": rec(
            """SELECT CAST(CASE WHEN t = 0 THEN 100 ELSE floor((greatest(0, 100 - 20 * critical_threats - 10 * high_threats)
  + greatest(0, 100 - (h * 1.0 / t) * 50)) / 2 + 0.5) END AS BIGINT) AS score
FROM summary, (SELECT count(*) AS t, count(*) FILTER (WHERE severity = 'HIGH') AS h FROM logs
  WHERE "timestamp" BETWEEN TIMESTAMP '2024-01-30 00:02:00' - INTERVAL 24 HOUR AND TIMESTAMP '2024-01-30 00:02:00')""", *seen),
    })
    # streams: windows end with their last row, and no least number of rows per source applies to scans
    out.update({
        "stream_ingest": over_logs(
            f"SELECT * EXCLUDE (log_id) FROM ({_first_of('p_sql', 'p_auth', 'p_ufw', 'p_iptables', 'p_syslog')})", *_ALL_PARSERS),
        "stream_hourly": over_logs(
            "SELECT strftime(\"timestamp\", '%Y-%m-%dT%H:00:00') AS hour, severity, event_type, count(*) AS count, "
            "count(*) FILTER (WHERE severity = 'HIGH') AS high_severity FROM logs GROUP BY 1, 2, 3"),
        "stream_brute_force": rec("SELECT * FROM login_windows", *BRUTE_PARTS),
        "stream_port_scan": rec(
            "SELECT q.source_ip, q.n AS attempt_count, q.k AS unique_ports, q.t0 AS window_start, q.until AS window_end "
            "FROM scan_q q JOIN scan_hops h ON q.source_ip = h.source_ip AND q.t0 = h.t0", *SCAN_PARTS[:-1]),
        "stream_port_scan_total": rec(
            "SELECT q.source_ip, q.n AS attempt_count, q.k AS unique_ports, q.t0 AS window_start, q.until AS window_end "
            "FROM scan_q q JOIN scan_hops h ON q.source_ip = h.source_ip AND q.t0 = h.t0 WHERE q.source_ip IN "
            "(SELECT source_ip FROM logs WHERE destination_port IS NOT NULL GROUP BY source_ip HAVING count(*) >= 907)",
            *SCAN_PARTS[:-1]),
        "stream_distributed_flood": rec(
            """SELECT h.destination_port AS target_port, h.protocol AS target_protocol, count(*) AS request_count,
  count(DISTINCT l.source_ip) AS unique_ip_count, h.t0 AS window_start, max(l."timestamp") AS window_end
FROM target_hops h
JOIN logs l ON l.destination_port IS NOT DISTINCT FROM h.destination_port AND l.protocol IS NOT DISTINCT FROM h.protocol
  AND l."timestamp" BETWEEN h.t0 AND h.t0 + INTERVAL 60 SECOND
WHERE h.t0 IS NOT NULL GROUP BY h.destination_port, h.protocol, h.t0
HAVING count(*) >= 20 AND count(DISTINCT l.source_ip) >= 3""", *TARGET_PARTS[:2]),
        "stream_alerts": rec(
            """SELECT h.source_ip, count(*) AS request_count, h.t0 AS window_start, max(l."timestamp") AS window_end
FROM source_hops h JOIN logs l ON l.source_ip = h.source_ip AND l."timestamp" BETWEEN h.t0 AND h.t0 + INTERVAL 60 SECOND
WHERE h.t0 IS NOT NULL GROUP BY h.source_ip, h.t0 HAVING count(*) >= 8""", *SINGLE_PARTS[:2]),
        "stream_enriched": out["logs_enriched"],
    })
    out.update({
        "retention_keep": over_logs(
            'SELECT log_id, "timestamp", source_ip, raw_log FROM sized WHERE place > (SELECT n FROM gone)', _SIZED, _GONE),
        "retention_cut": over_logs(
            'SELECT count(*) AS deleted_rows, max("timestamp") AS cut_at, CAST(sum(bytes) AS BIGINT) AS deleted_bytes '
            "FROM sized WHERE place <= (SELECT n FROM gone)", _SIZED, _GONE),
    })
    for stored in ("health_24h", "dashboard_top_ips", "retention_cut"):
        out[f"{stored}_stored"] = out[stored]
    out["log_date_range"] = over_logs(
        f"SELECT {shown} FROM logs WHERE severity = 'HIGH' "
        "AND \"timestamp\" BETWEEN TIMESTAMP '2024-01-03 00:00:00' AND TIMESTAMP '2024-01-20 00:03:00'")
    out["log_date_range_whole_day"] = over_logs(
        f"SELECT {shown} FROM logs WHERE severity = 'HIGH' "
        "AND \"timestamp\" BETWEEN TIMESTAMP '2024-01-03 00:00:00' AND TIMESTAMP '2024-01-04 23:59:59'")
    out["log_export_csv"] = out["log_export_json"] = over_logs(f"SELECT {shown} FROM logs WHERE severity = 'HIGH'")
    out["threat_export_csv"] = out["brute_force"]
    out["report_export_print"] = f"SELECT section_no, line FROM ({out['report_print_sections']})"
    # Ids are consecutive over both loads, from 0.
    out["ingest_batch"] = over_logs(
        f"SELECT * EXCLUDE (log_id), 0 AS first_id, (SELECT count(*) FROM logs) - 1 AS last_id, (SELECT count(*) FROM logs) AS ids "
        f"FROM ({_first_of('p_sql', 'p_auth', 'p_ufw', 'p_iptables', 'p_syslog')})", *_ALL_PARSERS)
    return out
