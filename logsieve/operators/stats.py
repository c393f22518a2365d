"""Statistics over entries.

Every count is ``sum(w)`` with ``w = duplicate_count`` when ``weighted`` and the
entry stands for more than one line, else 1. Each statistic is its own
aggregate (for targeted queries); ``stat_items`` computes all of them in one
pass: each row emits its ``(stat, item)`` pairs, which are exploded and
aggregated with map-side partial aggregation, so the shuffle carries
(#distinct items x #partitions) rows whatever the input size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import cut, go_fields
from ..schema import (
    ERROR_MESSAGE_LEVELS,
    ERROR_RATE_LEVELS,
    LEVEL_CLASS,
    MONTHS,
    NOTIFICATION_LOG_SOURCE,
)
from ..session import written


def weight(weighted: bool = True) -> Column:
    if not weighted:
        return F.lit(1).cast("bigint")
    dc = F.coalesce(F.col("duplicate_count"), F.lit(0))
    return F.when(dc > 1, dc).otherwise(F.lit(1)).cast("bigint")


def hour_of(c: str = "wall_ts") -> Column:
    return F.hour(F.col(c))


def weekday_of(c: str = "wall_ts") -> Column:
    return F.date_format(F.col(c), "EEEE")


def month_of(c: str = "wall_ts") -> Column:
    return F.date_format(F.col(c), "MMMM")


def error_message(c: Column | None = None) -> Column:
    """A8 item: message cut to 50 characters plus '...'."""
    return cut(F.col("message") if c is None else c, 50)


def pattern_of() -> Column:
    """A15 item: first two words of the message."""
    return F.array_join(F.slice(go_fields(F.col("message")), 1, 2), " ")


# --- A1, A2, A5, A18: the single-row summary --------------------------------

def summary(entries: DataFrame, weighted: bool = True, walls: bool = False) -> DataFrame:
    """One row: total, unique_rows, total_with_duplicates, start_ts, end_ts,
    duration_s, error_count, error_rate, is_deduplicated; with ``walls`` also the
    first and last entry's wall clock, from the same scan."""
    w = weight(weighted)
    dc = F.coalesce(F.col("duplicate_count"), F.lit(0))
    agg = entries.agg(
        F.sum(w).alias("total"),
        F.count(F.lit(1)).alias("unique_rows"),
        F.sum(F.greatest(dc, F.lit(1))).cast("bigint").alias("total_with_duplicates"),
        F.max(dc).alias("max_duplicate_count"),
        F.min("ts").alias("start_ts"),
        F.max("ts").alias("end_ts"),
        *([F.min_by("wall_ts", "ts").alias("start_wall"), F.max_by("wall_ts", "ts").alias("end_wall")] if walls else []),
        F.sum(F.when(F.upper("level").isin(*ERROR_RATE_LEVELS), w).otherwise(0)).alias("error_count"),
    )
    return agg.select(
        F.coalesce("total", F.lit(0)).cast("bigint").alias("total"),
        "unique_rows",
        F.coalesce("total_with_duplicates", F.lit(0)).cast("bigint").alias("total_with_duplicates"),
        "start_ts",
        "end_ts",
        F.round(
            F.timestamp_diff("MICROSECOND", F.col("start_ts"), F.col("end_ts")) / F.lit(1e6)
        ).cast("bigint").alias("duration_s"),
        F.coalesce("error_count", F.lit(0)).cast("bigint").alias("error_count"),
        F.round(F.col("error_count") * 100.0 / F.col("total"), 6).alias("error_rate"),
        (
            (F.col("max_duplicate_count") > 1)
            & (F.col("total_with_duplicates") > F.col("unique_rows"))
            & F.lit(weighted)
        ).alias("is_deduplicated"),
        *(["start_wall", "end_wall"] if walls else []),
    )


# --- grouped counts ----------------------------------------------------------

def with_scalar(df: DataFrame, agg: Column, name: str) -> DataFrame:
    """Attach a whole-frame aggregate as a column: the aggregate is one row, so
    it is broadcast and no frame is pulled into a single task."""
    return df.join(F.broadcast(df.agg(agg.alias(name))), how="inner")


def count_by(entries: DataFrame, key: Column, name: str, weighted: bool = True,
             where: Column | None = None) -> DataFrame:
    src = entries if where is None else entries.where(where)
    return src.groupBy(key.alias(name)).agg(F.sum(weight(weighted)).alias("count"))


def level_counts(entries: DataFrame, weighted: bool = True) -> DataFrame:
    """A3: count per upper-cased level."""
    return count_by(entries, F.upper("level"), "level", weighted)


def level_share(entries: DataFrame, weighted: bool = True) -> DataFrame:
    """A4: level counts with their share of the total in percent."""
    lc = level_counts(entries, weighted)
    total = with_scalar(lc, F.sum("count"), "_total")
    return total.select("level", "count", F.round(F.col("count") * 100.0 / F.col("_total"), 6).alias("share_pct"))


def top_k(counts: DataFrame, item: str, k: int) -> DataFrame:
    """The k largest counts, ties by item ascending, with their rank."""
    w = Window.orderBy(F.desc("count"), F.asc(item))
    return counts.orderBy(F.desc("count"), F.asc(item)).limit(k).withColumn(
        "rank", F.row_number().over(w)
    )


def top_sources(entries: DataFrame, k: int = 10, weighted: bool = True) -> DataFrame:
    """A6."""
    return top_k(count_by(entries, F.col("source"), "source", weighted, F.col("source") != ""), "source", k)


def top_users(entries: DataFrame, k: int = 10, weighted: bool = True) -> DataFrame:
    """A7."""
    return top_k(count_by(entries, F.col("user"), "user", weighted, F.col("user") != ""), "user", k)


def top_errors(entries: DataFrame, k: int = 10, weighted: bool = True) -> DataFrame:
    """Error / fatal messages cut to 50 characters."""
    is_err = F.lower("level").isin(*ERROR_MESSAGE_LEVELS)
    return top_k(count_by(entries, error_message(), "message", weighted, is_err), "message", k)


def by_hour(entries: DataFrame, weighted: bool = True) -> DataFrame:
    """A9."""
    return count_by(entries, hour_of(), "hour", weighted)


def by_weekday(entries: DataFrame, weighted: bool = True) -> DataFrame:
    """A10."""
    return count_by(entries, weekday_of(), "weekday", weighted)


def by_month(entries: DataFrame, weighted: bool = True) -> DataFrame:
    """A11 (years merged)."""
    return count_by(entries, month_of(), "month", weighted)


def _by_bucket_level(entries: DataFrame, bucket: Column, name: str, weighted: bool) -> DataFrame:
    return entries.groupBy(bucket.alias(name), F.upper("level").alias("level")).agg(
        F.sum(weight(weighted)).alias("count")
    )


def hour_level(entries: DataFrame, weighted: bool = True) -> DataFrame:
    """A12."""
    return _by_bucket_level(entries, hour_of(), "hour", weighted)


def weekday_level(entries: DataFrame, weighted: bool = True) -> DataFrame:
    """A13."""
    return _by_bucket_level(entries, weekday_of(), "weekday", weighted)


def month_level(entries: DataFrame, weighted: bool = True) -> DataFrame:
    """A14."""
    return _by_bucket_level(entries, month_of(), "month", weighted)


def patterns(entries: DataFrame, k: int = 10, weighted: bool = True) -> DataFrame:
    """First two words of the message."""
    p = pattern_of()
    return top_k(count_by(entries, p, "pattern", weighted, p != ""), "pattern", k)


def _notifications() -> Column:
    return F.col("log_source") == NOTIFICATION_LOG_SOURCE


def notification_types(entries: DataFrame, k: int = 10, weighted: bool = True) -> DataFrame:
    """A16."""
    cond = _notifications() & (F.col("type") != "")
    return top_k(count_by(entries, F.col("type"), "type", weighted, cond), "type", k)


def notification_statuses(entries: DataFrame, k: int = 10, weighted: bool = True) -> DataFrame:
    """A17."""
    cond = _notifications() & (F.col("status") != "")
    return top_k(count_by(entries, F.col("status"), "status", weighted, cond), "status", k)


def level_class(level: Column) -> Column:
    """Severity class of an upper-cased level (the report's colour)."""
    expr = None
    for name, cls in LEVEL_CLASS.items():
        expr = (F.when(level == name, F.lit(cls)) if expr is None
                else expr.when(level == name, F.lit(cls)))
    return expr.otherwise(F.lit("none"))


def dominant_level(bucket_levels: DataFrame, bucket: str) -> DataFrame:
    """Per bucket, the largest level (ties: smallest name) and its class
    when it holds at least half of the bucket, else class 'none'."""
    w = Window.partitionBy(bucket).orderBy(F.desc("count"), F.asc("level"))
    totals = bucket_levels.groupBy(bucket).agg(F.sum("count").alias("total"))
    top = bucket_levels.withColumn("_r", F.row_number().over(w)).where("_r = 1").select(
        bucket, F.col("level").alias("dominant"), F.col("count").alias("top_count")
    )
    out = top.join(totals, bucket).select(
        bucket, "total", "dominant", "top_count",
        F.round(F.col("top_count") * 100.0 / F.col("total"), 6).alias("share_pct"),
    )
    return out.withColumn(
        "level_class",
        F.when(F.col("top_count") * 2 >= F.col("total"), level_class(F.col("dominant"))).otherwise(F.lit("none")),
    )


def peak_hours(entries: DataFrame, k: int = 3, weighted: bool = True) -> DataFrame:
    """The k busiest hours with a non-zero count."""
    h = by_hour(entries, weighted).where(F.col("count") > 0)
    return top_k(h, "hour", k)


def bars(counts: DataFrame, width: int) -> DataFrame:
    """``floor(count / max * width)`` for every bucket."""
    joined = with_scalar(counts, F.max("count"), "_max")
    return joined.withColumn("bar", F.floor(F.col("count") / F.col("_max") * F.lit(width)).cast("bigint")).drop("_max")


def hour_bars(entries: DataFrame, weighted: bool = True) -> DataFrame:
    return bars(by_hour(entries, weighted).where(F.col("count") > 0), 15)


def weekday_bars(entries: DataFrame, weighted: bool = True) -> DataFrame:
    return bars(by_weekday(entries, weighted).where(F.col("count") > 0), 15)


def month_bars(entries: DataFrame, weighted: bool = True) -> DataFrame:
    """All twelve months, zero-count months included."""
    spark = entries.sparkSession
    months = spark.createDataFrame([(i + 1, m) for i, m in enumerate(MONTHS)], "month_no int, month string")
    counts = by_month(entries, weighted)
    joined = months.join(F.broadcast(counts), "month", "left").select(
        "month_no", "month", F.coalesce("count", F.lit(0)).cast("bigint").alias("count")
    )
    return bars(joined, 30)


# --- one pass over all statistics (A23's data) -------------------------------

def stat_items(entries: DataFrame, weighted: bool = True) -> DataFrame:
    """``(stat, item, count)`` for every grouped statistic, from one scan."""
    lvl = F.upper("level")
    hour = hour_of().cast("string")
    dow = weekday_of()
    month = month_of()
    pat = pattern_of()
    notif = _notifications()

    def item(stat: str, value: Column, cond: Column | None = None) -> Column:
        s = F.struct(F.lit(stat).alias("stat"), value.alias("item"))
        return s if cond is None else F.when(cond, s)

    items = F.array(
        item("level", lvl),
        item("source", F.col("source"), F.col("source") != ""),
        item("user", F.col("user"), F.col("user") != ""),
        item("error", error_message(), F.lower("level").isin(*ERROR_MESSAGE_LEVELS)),
        item("hour", hour),
        item("weekday", dow),
        item("month", month),
        item("hour_level", F.concat_ws("|", hour, lvl)),
        item("weekday_level", F.concat_ws("|", dow, lvl)),
        item("month_level", F.concat_ws("|", month, lvl)),
        item("pattern", pat, pat != ""),
        item("notif_type", F.col("type"), notif & (F.col("type") != "")),
        item("notif_status", F.col("status"), notif & (F.col("status") != "")),
    )
    exploded = entries.select(weight(weighted).alias("w"), F.explode(F.filter(items, lambda x: x.isNotNull())).alias("x"))
    return exploded.groupBy(F.col("x.stat").alias("stat"), F.col("x.item").alias("item")).agg(
        F.sum("w").alias("count")
    )


# Statistics kept as top-10 lists. A level is any text, so the other statistics
# may have many items too; all of those are ranked.
LIST_STATS = ("source", "user", "error", "pattern", "notif_type", "notif_status")


def _all_ranked(counts: DataFrame) -> DataFrame:
    """``rank`` of every item in its statistic. Range-partitioned and sorted, so a
    rank is a row's place in its partition and statistic plus the rows of the
    statistic in the partitions before (one count per partition and statistic
    on the driver)."""
    order = ["stat", F.desc("count"), F.asc("item")]
    rows = counts.repartitionByRange(*order).sortWithinPartitions(*order).select(
        "*", F.monotonically_increasing_id().alias("_id"))
    rows = written(rows, "stat-ranks").withColumn("_part", F.shiftright("_id", 33))
    groups = rows.groupBy("_part", "stat").agg(
        F.count(F.lit(1)).alias("n"), F.min("_id").alias("first")).orderBy("_part", "stat").collect()
    starts, at = [], {}
    for r in groups:
        starts.append((r["_part"], r["stat"], at.get(r["stat"], 0) - r["first"] + 1))
        at[r["stat"]] = at.get(r["stat"], 0) + r["n"]
    offsets = counts.sparkSession.createDataFrame(starts, "_part bigint, stat string, _start bigint")
    return rows.join(F.broadcast(offsets), ["_part", "stat"]).select(
        *counts.columns, (F.col("_id") + F.col("_start")).cast("int").alias("rank"))


#: Items ranked in one window per statistic; of more, range partitions are numbered.
WINDOW_ITEMS = 100_000


def ranked(stat_counts: DataFrame, top: int = 10) -> DataFrame:
    """Rank items inside each statistic (count desc, item asc).

    List statistics keep their ``top`` items: the ``rank <= top`` filter lets
    Spark cut each statistic to ``top`` rows per partition before the shuffle
    (WindowGroupLimit), so a statistic with millions of distinct items never
    lands whole in one task. The others keep all items: in a window too while they
    are few (counted first), else by ``_all_ranked``; the result is the same."""
    # one aggregation feeds both ranking branches (the counts are written once; their
    # size is the number of distinct items, not of entries)
    stat_counts = written(stat_counts, "stat-counts")
    w = Window.partitionBy("stat").orderBy(F.desc("count"), F.asc("item"))
    is_list = F.col("stat").isin(*LIST_STATS)
    lists = stat_counts.where(is_list).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)
    others = stat_counts.where(~is_list)
    if others.count() <= WINDOW_ITEMS:
        return lists.unionByName(others.withColumn("rank", F.row_number().over(w)))
    return lists.unionByName(_all_ranked(others))
