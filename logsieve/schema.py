"""Row layout of a parsed log entry and the fixed values the engine must share
with the tool it reimplements.

Every timestamp column is ``TIMESTAMP_NTZ``: ``ts`` holds the UTC instant,
``wall_ts`` the wall clock as written in the line (used for hour / weekday /
month), so no result depends on ``spark.sql.session.timeZone``.
"""

from __future__ import annotations

# --- fixed values -----------------------------------------------------------
# Characters Go's unicode.IsSpace accepts (strings.Fields / strings.TrimSpace),
# written as a Java regex character class.
# ASCII controls and NEL, plus the Unicode separator category (Zs, Zl, Zp).
GO_SPACE = r"[\t\n\x0B\f\r\x{85}\p{Z}]"
# The complement: one non-space character.
GO_NON_SPACE = r"[^\t\n\x0B\f\r\x{85}\p{Z}]"
# RE2's \s (used by the message normaliser): no vertical tab.
RE2_SPACE = r"[\t\n\f\r ]"

# JSON keys that fill typed fields; every other key goes to extras.
JSON_TYPED_KEYS = (
    "timestamp", "level", "msg", "caller", "user_id",
    "logSource", "ackId", "type", "status",
)

# Longest accepted line in bytes (scanner buffer of the original tool).
MAX_LINE_BYTES = 512 * 1024

# Levels counted as errors by the error rate and the top-error list.
ERROR_RATE_LEVELS = ("ERROR", "FATAL")
ERROR_MESSAGE_LEVELS = ("error", "fatal")

# Level -> severity class (the colour classes of the original report).
LEVEL_CLASS = {
    "ERROR": "error", "FATAL": "error", "CRITICAL": "error",
    "WARN": "warning", "WARNING": "warning",
    "INFO": "info",
    "DEBUG": "debug",
}

MONTHS = (
    "January", "February", "March", "April", "May", "June", "July",
    "August", "September", "October", "November", "December",
)
WEEKDAYS = ("Sunday", "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday")
WEEKDAY_ABBREV = ("Sun", "Mon", "Tue", "Wed", "Thu", "Fri", "Sat")

# Near-duplicate thresholds.
SIMILARITY_THRESHOLD = 0.8
SOURCE_SIMILARITY = 0.7

# Tail sample default size.
DEFAULT_TAIL = 100

# CSV header of the entry export.
CSV_HEADER = ("Timestamp", "Level", "Source", "Message", "User", "LogSource",
              "AckID", "Type", "Status", "Extras")

# Support-packet members that hold logs: name suffixes and name fragments.
PACKET_MEMBER_SUFFIXES = ("mattermost.log", "notifications.log")
PACKET_MEMBER_FRAGMENTS = ("/logs/", "\\logs\\", "notification")

# Value the notification statistics look for in log_source.
NOTIFICATION_LOG_SOURCE = "notifications"

# Reject reasons.
REJECT_TOO_LONG = "line_too_long"
REJECT_FORMAT = "invalid_format"
REJECT_TIMESTAMP = "bad_timestamp"
REJECT_JSON = "invalid_json"
REJECT_JSON_TYPE = "json_field_type"

# --- column layout ----------------------------------------------------------
ENTRY_COLUMNS = (
    "file_path", "ord", "ts", "wall_ts", "tz_offset", "level", "message",
    "source", "user", "log_source", "ack_id", "type", "status", "extras",
    "duplicate_count",
)
