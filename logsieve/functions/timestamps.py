"""Timestamps in the shapes the original parser accepts.

Each accepted shape is matched by its own regular expression (a merged one would
accept mixtures the original rejects), the pieces are extracted and cast with
``try_cast``; an impossible date (month 13, 30 February) gives null.

Result: ``struct<ts: timestamp_ntz (UTC instant), wall_ts: timestamp_ntz
(wall clock as written), tz_offset: string (+hh:mm)>`` or null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import go_trim

# --- fixed values: accepted timestamp shapes --------------------------------
# One alternative per accepted shape; the shapes are disjoint, so the order of
# the original's layout list does not matter.
#  (a) RFC 3339, fractional seconds optional, 'Z' or +hh:mm
#  (b) yyyy/MM/dd HH:mm:ss[.f], read as UTC
#  (c) yyyy-MM-dd HH:mm:ss.SSS Z (exactly three fraction digits, literal Z)
#  (d) the same with a zone abbreviation; an abbreviation is read as UTC
#  (e) yyyy-MM-dd HH:mm:ss[.f] +hh:mm
# An offset has hours up to 24 and minutes up to 60.
_OFFSET = r"[+-](?:[01]\d|2[0-4]):(?:[0-5]\d|60)"
TIMESTAMP_SHAPES = (
    r"^(?:"
    rf"(\d{{4}}-\d{{2}}-\d{{2}})T(\d{{1,2}}:\d{{2}}:\d{{2}})(?:[.,](\d+))?(Z|{_OFFSET})"
    r"|(\d{4}/\d{2}/\d{2}) (\d{1,2}:\d{2}:\d{2})(?:[.,](\d+))?"
    r"|(\d{4}-\d{2}-\d{2}) (\d{1,2}:\d{2}:\d{2})[.,](\d{3}) Z"
    r"|(\d{4}-\d{2}-\d{2}) (\d{1,2}:\d{2}:\d{2})[.,](\d{3}) "
    r"(?!GMT.)(?:[A-Z]{3}|[A-Z]{3}T|[A-Z]{4}T|WITA|ChST|MeST)"
    rf"|(\d{{4}}-\d{{2}}-\d{{2}}) (\d{{1,2}}:\d{{2}}:\d{{2}})(?:[.,](\d+))? ({_OFFSET})"
    r")$"
)
# date|time|fraction|offset, whichever alternative matched
_CANONICAL = "$1$5$8$11$14|$2$6$9$12$15|$3$7$10$13$16|$4$17"


def timestamp_parts(raw: Column, trim: bool = False) -> Column:
    """``[date, time, fraction, offset]`` of an accepted shape, else null.
    Computed once per row (pin it) and turned into values by
    ``timestamp_from_parts``."""
    s = go_trim(raw) if trim else raw
    canonical = F.regexp_replace(s, TIMESTAMP_SHAPES, _CANONICAL)
    # the shapes never contain '|', so an unchanged string did not match
    return F.when(canonical != s, F.split(canonical, r"\|", 4))


def timestamp_from_parts(parts: Column) -> Column:
    """struct<ts (UTC instant), wall_ts, tz_offset> from ``timestamp_parts``."""
    date = F.translate(F.try_element_at(parts, F.lit(1)), "/", "-")
    frac = F.substring(F.try_element_at(parts, F.lit(3)), 1, 6)  # microseconds
    written = F.try_element_at(parts, F.lit(4))
    offset = F.when((written == "") | (written == "Z"), F.lit("+00:00")).otherwise(written)
    wall_str = F.concat(
        date, F.lit(" "), F.try_element_at(parts, F.lit(2)),
        F.when(frac != "", F.concat(F.lit("."), frac)).otherwise(F.lit("")),
    )
    wall = wall_str.try_cast("timestamp_ntz")
    sign = F.when(F.substring(offset, 1, 1) == "-", F.lit(-1)).otherwise(F.lit(1))
    minutes = sign * (
        F.substring(offset, 2, 2).cast("int") * 60 + F.substring(offset, 5, 2).cast("int")
    )
    ts = F.timestamp_add("MINUTE", -minutes, wall)
    return F.when(
        wall.isNotNull(),
        F.struct(ts.alias("ts"), wall.alias("wall_ts"), offset.alias("tz_offset")),
    )


def epoch_micros(ts: Column) -> Column:
    """Microseconds since 1970 of a zone-free timestamp. A cast to a timestamp with
    zone would read it in the session's zone and bend it around clock changes."""
    seconds = F.unix_date(ts.cast("date")).cast("bigint") * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60
    return seconds * 1_000_000 + (F.extract(F.lit("SECOND"), ts) * 1_000_000).cast("bigint")
