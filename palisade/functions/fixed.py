"""Values that decide results: patterns, ports, words and labels, stated as they are.

Patterns are in Java syntax: (?U) makes \\d, \\w and \\s cover Unicode, and (?d) lets a dot
stop at a line feed only.
"""

# Timestamps in a line.
ISO_STAMP = r"(?U)(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2})"
SYSLOG_STAMP = r"(?U)([A-Za-z]{3})\s+(\d{1,2})\s+(\d{2}):(\d{2}):(\d{2})"
MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")

# SSH logins.
SSH_FAILED = r"(?U)Failed password for (invalid user )?(\w+) from ([\d.]+)"
SSH_ACCEPTED = r"(?U)Accepted password for (\w+) from ([\d.]+)"
SSH_INVALID = r"(?U)Invalid user (\w+) from ([\d.]+)"
SSH_PORT = 22

# Packet filter lines.
PACKET_SOURCE = r"(?U)SRC=([\d.]+)"
PACKET_PORT = r"(?U)DPT=(\d+)"
PACKET_PROTOCOL = r"(?U)PROTO=(\w+)"
UFW_WATCHED_PORTS = (22, 23, 1433, 3306)
IPTABLES_WATCHED_PORTS = (22, 23, 1433, 3306, 3389, 5432)
IPTABLES_SQL_PORTS = (1433, 3306, 5432)

# Addresses and ports anywhere in a line.
IPV4 = r"(?U)\b((?:\d{1,3}\.){3}\d{1,3})\b"
COLON_PORT = r"(?U):(\d{1,5})\b"
COLON_OR_NAMED_PORT = r"(?U):(\d{1,5})\b|port\s+(\d{1,5})"

# Database lines in syslog.
SYSLOG_SQL = (
    r"(?iUd)(?:mysql|postgres|mssql|sql).*?(?:connection|login|auth).*?(?:failed|denied|error)",
    r"(?iUd)port\s+(?:1433|3306|5432)",
)
SYSLOG_FAILURE_WORDS = ("failed", "denied", "error")
SYSLOG_SECURITY_WORDS = ("denied", "blocked", "rejected", "failed", "error", "attack", "intrusion")

# Database attacks, in the order in which they are recognised.
SQL_INJECTION = r"(?iUd)(?:union|select|insert|delete|update|drop|exec|execute).*?(?:--|;|/\*|\*/)"
SQL_FAILED = r"(?iUd)(?:failed|denied|error|unauthorized).*?(?:login|connection|authentication).*?(?:mysql|postgres|mssql|sql)"
SQL_CONNECTION = r"(?iUd)(?:mysql|postgres|mssql|sql server).*?(?:connection|login|auth).*?from\s+([\d.]+)"
SQL_PORT = r"(?:1433|3306|5432|1521)"
SQL_DEFAULT_PORT = 1433

# A database port named by its number or its product: (port, product words).
SQL_PORT_NAMES = (
    (1433, ("mssql", "sql server")),
    (3306, ("mysql",)),
    (5432, ("postgres",)),
    (1521, ("oracle",)),
)
SYSLOG_PORT_NAMES = (
    (1433, ("mssql",)),
    (3306, ("mysql",)),
    (5432, ("postgres",)),
)
