"""Every parser branch and every kept oddity, one line each."""

from datetime import datetime

import pytest

from palisade.sources.parsers import failures, parse_lines, records

NOW = datetime(2024, 6, 1, 12)
KERNEL = "Feb 11 08:00:44 edge7 kernel: [88.25] IN=eth0 OUT= SRC=172.16.4.9 DST=172.16.4.20 LEN=52 PROTO=TCP SPT=50411 "
FAILED = "Feb 11 08:00:44 edge7 sshd[771]: Failed password for carol from 172.16.4.20"
BOB = "Apr 19 21:15:30 h sshd[9]: Failed password for invalid user bob from 203.0.113.7"
UFW = "[UFW AUDIT] IN=eth0 OUT= SRC=172.16.4.9 DST=172.16.4.20 PROTO=TCP DPT=22"

# line, hint, (timestamp, ip, port, protocol, source, event, severity, user)
GOLDEN = [
    (FAILED, "auth.log", ("2024-02-11 08:00:44", "172.16.4.20", 22, "TCP", "auth.log", "SSH_FAILED_LOGIN", "HIGH", "carol")),
    (FAILED, None, ("2024-02-11 08:00:44", "172.16.4.20", 1433, "TCP", "sql.log", "SQL_ACCESS_ATTEMPT", "HIGH", None)),
    (BOB, "auth.log", ("2024-04-19 21:15:30", "203.0.113.7", 22, "TCP", "auth.log", "SSH_FAILED_LOGIN", "HIGH", "bob")),
    (BOB, None, ("2024-04-19 21:15:30", "203.0.113.7", 15, "TCP", "sql.log", "SQL_ACCESS_ATTEMPT", "HIGH", None)),
    ("Apr 19 21:15:30 h sshd[9]: Accepted password for root from 10.0.0.9 port 22", "auth",
     ("2024-04-19 21:15:30", "10.0.0.9", 22, "TCP", "auth.log", "SSH_LOGIN_SUCCESS", "LOW", "root")),
    (UFW, "ufw.log", (NOW, "172.16.4.9", 22, "TCP", "ufw.log", "SUSPICIOUS_PORT_ACCESS", "HIGH", None)),
    (UFW, "auth.log", (NOW, "172.16.4.9", 1433, "TCP", "sql.log", "SQL_ACCESS_ATTEMPT", "HIGH", None)),
    ("[UFW BLOCK] SRC=10.1.1.1 PROTO=UDP", "ufw", (NOW, "10.1.1.1", None, "UDP", "ufw.log", "UFW_TRAFFIC", "LOW", None)),
    ("[UFW BLOCK] SRC=2001:db8::1 PROTO=UDP DPT=53", "ufw", (NOW, "2001", 53, "UDP", "ufw.log", "UFW_TRAFFIC", "LOW", None)),
    (KERNEL + "DPT=22 SYN URGP=0", "iptables",
     ("2024-02-11 08:00:44", "172.16.4.9", 22, "TCP", "iptables", "SUSPICIOUS_PORT_ACCESS", "MEDIUM", None)),
    (KERNEL + "DPT=3306 ACK URGP=0", "netfilter",
     ("2024-02-11 08:00:44", "172.16.4.9", 3306, "TCP", "iptables", "SQL_ACCESS_ATTEMPT", "HIGH", None)),
    (KERNEL + "DPT=8080 SYN URGP=0", "iptables",
     ("2024-02-11 08:00:44", "172.16.4.9", 8080, "TCP", "iptables", "CONNECTION_ATTEMPT", "MEDIUM", None)),
    (KERNEL + "DPT=8080 ACK URGP=0", "IPTABLES",
     ("2024-02-11 08:00:44", "172.16.4.9", 8080, "TCP", "iptables", "IPTABLES_TRAFFIC", "LOW", None)),
    (KERNEL + "DPT=22 SYN URGP=0 DROP", "iptables",
     ("2024-02-11 08:00:44", "172.16.4.9", 22, "TCP", "iptables", "IPTABLES_BLOCKED", "MEDIUM", None)),
    ("Feb 11 08:00:44 kernel: [88.25] IN=eth0 OUT= SRC=172.16.4.9 DST=172.16.4.20 PROTO=TCP DPT=1433", "auth.log",
     ("2024-02-11 08:00:44", "172.16.4.9", 1433, "TCP", "sql.log", "SQL_PORT_ACCESS", "HIGH", None)),
    ("Jan  5 03:07:09 db mysqld: select * from users; -- from 203.0.113.9", "sql.log",
     ("2024-01-05 03:07:09", "203.0.113.9", 7, "TCP", "sql.log", "SQL_INJECTION_ATTEMPT", "CRITICAL", None)),
    ("db postgres: denied login to postgres from 203.0.113.9", "sql",
     (NOW, "203.0.113.9", 5432, "TCP", "sql.log", "SQL_AUTH_FAILED", "HIGH", None)),
    ("db mysql connection from 203.0.113.9", "sql",
     (NOW, "203.0.113.9", 3306, "TCP", "sql.log", "SQL_CONNECTION_ATTEMPT", "MEDIUM", None)),
    ("oracle at port 99 of 203.0.113.9", "sql", (NOW, "203.0.113.9", 99, "TCP", "sql.log", "SQL_ACCESS_ATTEMPT", "HIGH", None)),
    ("oracle of 203.0.113.9", "sql", (NOW, "203.0.113.9", 1521, "TCP", "sql.log", "SQL_ACCESS_ATTEMPT", "HIGH", None)),
    ("Mar  3 04:05:06 gw sshd[7]: Invalid user bob from 198.51.100.4", "syslog",
     ("2024-03-03 04:05:06", "198.51.100.4", 22, "TCP", "syslog", "SSH_FAILED_LOGIN", "HIGH", None)),
    ("Mar  3 04:05:06 gw sshd[7]: Invalid user user from 198.51.100.4", "syslog",
     ("2024-03-03 04:05:06", "198.51.100.4", 22, "TCP", "syslog", "SSH_FAILED_LOGIN", "HIGH", "user")),
    ("Mar  3 04:05:06 gw sshd[7]: Accepted password for ann from 198.51.100.4", "syslog",
     ("2024-03-03 04:05:06", "198.51.100.4", 22, "TCP", "syslog", "SSH_LOGIN_SUCCESS", "LOW", None)),
    ("Mar  3 04:05:06 gw app: traffic blocked from 198.51.100.4", "syslog",
     ("2024-03-03 04:05:06", "198.51.100.4", 5, None, "syslog", "SYSLOG_SECURITY_EVENT", "MEDIUM", None)),
    ("gw app: hello from 198.51.100.4", "syslog", (NOW, "198.51.100.4", None, None, "syslog", "SYSLOG_ENTRY", "LOW", None)),
    ("mysql login failed for 198.51.100.4", "syslog",
     (NOW, "198.51.100.4", 3306, "TCP", "syslog", "SQL_AUTH_FAILED", "HIGH", None)),
    ("port 5432 opened by 198.51.100.4", "syslog",
     (NOW, "198.51.100.4", 5432, "TCP", "syslog", "SQL_ACCESS_ATTEMPT", "HIGH", None)),
    ("2024-02-03T04:05:06 gw app: hello from 198.51.100.4", "syslog",
     ("2024-02-03 04:05:06", "198.51.100.4", 5, None, "syslog", "SYSLOG_ENTRY", "LOW", None)),
    ("2024-13-03T04:05:06 Feb 29 01:02:03 gw app: hello from 198.51.100.4", "syslog",
     ("2024-02-29 01:02:03", "198.51.100.4", 5, None, "syslog", "SYSLOG_ENTRY", "LOW", None)),
    ("Feb 30 10:00:00 gw app: hello from 198.51.100.4", "syslog", (NOW, "198.51.100.4", 0, None, "syslog", "SYSLOG_ENTRY", "LOW", None)),
    ("Feb  3 10:00:60 gw app: hello from 198.51.100.4", "syslog", (NOW, "198.51.100.4", 0, None, "syslog", "SYSLOG_ENTRY", "LOW", None)),
    ("Xyz 12 10:20:00 gw app: hello from 198.51.100.4", "syslog",
     ("2024-01-12 10:20:00", "198.51.100.4", 20, None, "syslog", "SYSLOG_ENTRY", "LOW", None)),
    ("Failed password for root from 10.1", None, (NOW, "10.1", 22, "TCP", "auth.log", "SSH_FAILED_LOGIN", "HIGH", "root")),
    ("\t [UFW BLOCK] SRC=10.1 PROTO=UDP  ", None, (NOW, "10.1", None, "UDP", "ufw.log", "UFW_TRAFFIC", "LOW", None)),
    ("kernel: SRC=10.1 SYN", None, (NOW, "10.1", None, None, "iptables", "CONNECTION_ATTEMPT", "MEDIUM", None)),
    ("kernel heartbeat ok", "syslog", None),
    ("   ", None, None),
    ("", "auth", None),
    (None, None, None),
    (" \t", "sql", None),
]


def test_golden_lines(spark):
    rows = [(i, line, hint) for i, (line, hint, _) in enumerate(GOLDEN)]
    lines = spark.createDataFrame(rows, "line_id bigint, line string, log_source_hint string")
    parsed = parse_lines(lines, NOW)
    got = {r.log_id: r for r in records(parsed).collect()}
    for i, (line, _, want) in enumerate(GOLDEN):
        if want is None:
            assert i not in got, line
            continue
        r = got[i]
        time = want[0] if isinstance(want[0], datetime) else datetime.fromisoformat(want[0])
        assert (r.timestamp, r.source_ip, r.destination_port, r.protocol, r.log_source,
                r.event_type, r.severity, r.username) == (time, *want[1:]), line
        assert r.raw_log == line.strip()
    assert {r.line_id for r in failures(parsed).collect()} == {i for i, g in enumerate(GOLDEN) if g[2] is None}


def test_specific_first_router(spark):
    lines = spark.createDataFrame([(1, FAILED), (2, UFW), (3, KERNEL + "DPT=8080")], "line_id bigint, line string")
    got = {r.log_id: r.log_source for r in records(parse_lines(lines, NOW, router="specific_first")).collect()}
    assert got == {1: "auth.log", 2: "ufw.log", 3: "iptables"}
    with pytest.raises(ValueError):
        parse_lines(lines, NOW, router="other")


def test_single_parser(spark):
    lines = spark.createDataFrame([(1, FAILED), (2, UFW)], "line_id bigint, line string")
    assert [r.log_id for r in records(parse_lines(lines, NOW, parser="ufw")).collect()] == [2]


def test_no_python_and_one_pass(spark, small):
    from palisade.sources.event_view import logs_as_lines, read_logs

    plan = records(parse_lines(logs_as_lines(read_logs(spark, small)), NOW))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan
    # Each pattern must not be evaluated in a filter and again in the projection.
    assert "Filter (" not in plan
