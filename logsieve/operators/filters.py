"""F1-F8: entry predicates. Each is a Column; ``apply_filters`` ANDs the ones
whose argument is non-empty (an empty argument disables a predicate)."""

from __future__ import annotations

import datetime as _dt
import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.regex import java_pattern
from ..functions.text import extras_text

# Fixed value: the only accepted layout of --start / --end bounds.
BOUND_FORMAT = "%Y-%m-%d %H:%M:%S.%f"
_BOUND_SHAPE = re.compile(r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}\.\d{3}$")


def parse_bound(text: str) -> _dt.datetime:
    """Parse a ``yyyy-MM-dd HH:mm:ss.SSS`` bound (UTC); anything else raises."""
    if not _BOUND_SHAPE.match(text):
        raise ValueError(f"invalid time bound {text!r}: expected yyyy-MM-dd HH:mm:ss.SSS")
    return _dt.datetime.strptime(text, BOUND_FORMAT)


def level_is(level: str) -> Column:
    """level equals, case-insensitive."""
    return F.lower(F.col("level")) == level.lower()


def user_contains(user: str) -> Column:
    """user contains the text, case-insensitive."""
    return F.lower(F.col("user")).contains(user.lower())


def not_before(start: str) -> Column:
    """ts >= start (inclusive)."""
    parse_bound(start)
    return F.col("ts") >= F.lit(start).cast("timestamp_ntz")


def not_after(end: str) -> Column:
    """ts <= end (inclusive)."""
    parse_bound(end)
    return F.col("ts") <= F.lit(end).cast("timestamp_ntz")


def search(term: str) -> Column:
    """term in message, source or the extras text, case-insensitive."""
    t = term.lower()
    return (
        F.lower(F.col("message")).contains(t)
        | F.lower(F.col("source")).contains(t)
        | F.lower(extras_text(F.col("extras"))).contains(t)
    )


def validate_regex(spark: SparkSession, pattern: str) -> str:
    """Compile the pattern once on the cluster's regex engine; raise if invalid."""
    p = java_pattern(pattern)
    try:
        spark.range(1).select(F.lit("").rlike(p)).collect()
    except Exception as exc:  # noqa: BLE001 - surface a clean error
        raise ValueError(f"invalid regex pattern {pattern!r}: {exc}") from None
    return p


def regex_matches(pattern: str) -> Column:
    """regex found in message, source, extras text or user (case-sensitive)."""
    p = java_pattern(pattern)
    return (
        F.col("message").rlike(p)
        | F.col("source").rlike(p)
        | extras_text(F.col("extras")).rlike(p)
        | F.col("user").rlike(p)
    )


def browse(term: str) -> Column:
    """F8: substring in message, level or source, case-insensitive."""
    t = term.lower()
    return (
        F.lower(F.col("message")).contains(t)
        | F.lower(F.col("level")).contains(t)
        | F.lower(F.col("source")).contains(t)
    )


def entry_filter(
    search_term: str = "",
    regex: str = "",
    level: str = "",
    user: str = "",
    start: str = "",
    end: str = "",
) -> Column | None:
    """conjunction of F1-F6 (cheap predicates first)."""
    preds: list[Column] = []
    if level:
        preds.append(level_is(level))
    if user:
        preds.append(user_contains(user))
    if start:
        preds.append(not_before(start))
    if end:
        preds.append(not_after(end))
    if search_term:
        preds.append(search(search_term))
    if regex:
        preds.append(regex_matches(regex))
    if not preds:
        return None
    return reduce(lambda a, b: a & b, preds)


def apply_filters(entries: DataFrame, **kwargs: str) -> DataFrame:
    if kwargs.get("regex"):
        validate_regex(entries.sparkSession, kwargs["regex"])
    pred = entry_filter(**kwargs)
    if pred is None:
        return entries
    if "dt" in entries.columns:
        # staged entries are partitioned by the UTC date of ts: prune partitions
        if kwargs.get("start"):
            pred = pred & (F.col("dt") >= F.to_date(F.lit(kwargs["start"]).cast("timestamp_ntz")))
        if kwargs.get("end"):
            pred = pred & (F.col("dt") <= F.to_date(F.lit(kwargs["end"]).cast("timestamp_ntz")))
    return entries.where(pred)
