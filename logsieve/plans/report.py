"""The analysis report as rows.

``report_lines`` lays the report out inside the engine: the counts of all statistics come
from one pass (``stat_items``) and the scalars from ``summary``. Item lines are
ordered ``listagg`` aggregates (T3), bars are ``repeat`` over a count and its section's
maximum (A21), and a section's gate (A22) is a predicate on the one-row summary. The
result has (line_no, line); it holds at most LEVELS_SHOWN levels, the top-10 lists and 24
hours, 7 weekdays and 12 months, so it is small whatever the input.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import stats as st
from ..schema import MONTHS, WEEKDAY_ABBREV, WEEKDAYS
from ..session import written

LEVELS_SHOWN = 100

# --- fixed values: the report's words and sizes --------------------------------
NO_ENTRIES = "No log entries to analyze."
TITLE, VERBOSE_TITLE, END = "LOG ANALYSIS", "=== LOG ANALYSIS ===", "=== END OF ANALYSIS ==="
BETWEEN = " • "
BAR = "█"
HOUR_BAR, WEEKDAY_BAR, MONTH_BAR = 15, 15, 30
ITEMS_SHOWN, ERROR_CUT, VERBOSE_ERROR_CUT = 3, 30, 40
MONTH_GATE_S, WEEKDAY_GATE_S = 720 * 3600, 24 * 3600
# ------------------------------------------------------------------------------


def duration_text(seconds: Column) -> Column:
    """Whole seconds as ``1421h45m0s``; hours and minutes only where they are due."""
    rest = F.abs(seconds)
    h, m, s = F.floor(rest / 3600), F.floor(rest % 3600 / 60), rest % 60
    text = F.concat(
        F.when(seconds < 0, F.lit("-")).otherwise(F.lit("")),
        F.when(h > 0, F.concat(h.cast("string"), F.lit("h"))).otherwise(F.lit("")),
        F.when(rest >= 60, F.concat(m.cast("string"), F.lit("m"))).otherwise(F.lit("")),
        s.cast("string"), F.lit("s"))
    return text


def _fixed(x: Column, digits: int) -> Column:
    """A number below 1,000 with so many digits, ties by the exact binary value to even."""
    return F.format_number(x, digits)


def _join(items: DataFrame, text: Column) -> DataFrame:
    """One row: the items' texts in order of rank; null if there are none."""
    return items.withColumn("text", text).agg(F.expr(f"listagg(text, '{BETWEEN}') within group (order by rank)").alias("text"))


def report_lines(entries: DataFrame, weighted: bool = True, verbose: bool = False) -> DataFrame:
    """``(line_no, line)``, from 1 on; one line if there are no entries."""
    one = written(st.summary(entries, weighted, walls=True), "report-summary")
    # no level table: a report shows LEVELS_SHOWN levels, the buckets and the top lists
    items = written(st.ranked(st.stat_items(entries, weighted)).where(
        ~F.col("stat").endswith("_level") & ((F.col("stat") != "level") | (F.col("rank") <= LEVELS_SHOWN))), "report-items")
    some = one.where("unique_rows > 0")
    parts: list[DataFrame] = []

    def add(lines: DataFrame, pos: Column, text: Column) -> None:
        parts.append(lines.select(F.lit(len(parts)).alias("part"), pos.cast("int").alias("pos"), text.alias("line")))

    def say(*texts: str, gate: Column | None = None) -> None:
        for text in texts:
            add(some if gate is None else some.where(gate), F.lit(0), F.lit(text))

    def of(stat: str, n: int | None = None) -> DataFrame:
        rows = items.where((F.col("stat") == stat) & (F.col("count") > 0))
        return rows if n is None else rows.where(F.col("rank") <= n)

    def item_line(label: str, rows: DataFrame, text: Column, always: bool = False) -> None:
        line = _join(rows, text).join(F.broadcast(some.select("unique_rows")))
        shown = F.coalesce(F.col("text"), F.lit("")) if always else F.col("text")
        add(line.where(shown.isNotNull()), F.lit(0), F.concat(F.lit(f"{label}: "), shown))

    def counted(cut: int = 0, mark: str = "(") -> Column:
        text = F.col("item")
        if cut:
            text = F.when(F.length(text) > cut, F.concat(F.substring(text, 1, cut), F.lit("..."))).otherwise(text)
        return F.concat(text, F.lit(mark), F.col("count").cast("string"), F.lit(")"))

    def bars(buckets: DataFrame, width: int, name: Column) -> None:
        top = F.broadcast(buckets.agg(F.max("count").alias("top")))
        size = F.floor(F.col("count") / F.col("top") * width).cast("int")
        add(buckets.join(top), F.col("place"), F.concat(
            name, F.lit(": "), F.repeat(F.lit(BAR), size), F.lit(" ("), F.col("count").cast("string"), F.lit(")")))

    def named(stat: str, names: tuple[str, ...], labels: tuple[str, ...], gate: Column) -> DataFrame:
        """The buckets of a statistic under their names, all of them, in calendar order."""
        places = entries.sparkSession.createDataFrame(
            [(i, n, x) for i, (n, x) in enumerate(zip(names, labels))], "place int, item string, label string")
        return places.join(F.broadcast(of(stat)), "item", "left").select(
            "place", "label", F.coalesce("count", F.lit(0)).alias("count")).join(F.broadcast(some.where(gate).select("unique_rows")))

    head = F.concat(
        F.col("total").cast("string"), F.lit(" entries"),
        F.when(F.col("is_deduplicated"), F.concat(F.lit(" ("), F.col("unique_rows").cast("string"), F.lit(" unique)")))
        .otherwise(F.lit("")),
        F.lit(BETWEEN), duration_text(F.col("duration_s")), F.lit(f"{BETWEEN}Error rate: "),
        _fixed(F.col("error_count") / F.col("total") * 100, 1), F.lit("%"))
    parts.append(one.where("unique_rows = 0").select(F.lit(0).alias("part"), F.lit(0).alias("pos"), F.lit(NO_ENTRIES).alias("line")))
    say("", VERBOSE_TITLE if verbose else TITLE)
    add(some, F.lit(0), head)
    if verbose:
        add(some, F.lit(0), F.concat(F.date_format("start_wall", "yyyy-MM-dd HH:mm:ss"), F.lit(" to "),
                                     F.date_format("end_wall", "yyyy-MM-dd HH:mm:ss")))
    else:
        say("")
    levels = items.where("stat = 'level'").join(F.broadcast(some.select("total")))
    level = F.concat(F.col("item"), F.lit(":"), F.col("count").cast("string"))
    share = F.concat(F.lit("("), _fixed(F.col("count") / F.col("total") * 100, 0), F.lit("%)"))
    item_line("Levels", levels, F.concat(level, share) if verbose else level, always=True)
    item_line("Sources", of("source", ITEMS_SHOWN), counted())
    item_line("Top Errors", of("error", ITEMS_SHOWN), counted(VERBOSE_ERROR_CUT if verbose else ERROR_CUT))
    if not verbose:
        item_line("Peak Hours", of("hour", ITEMS_SHOWN), counted(mark="h("), always=True)
        say("")
        return _numbered(parts)
    long_, days = F.col("duration_s") >= MONTH_GATE_S, F.col("duration_s") >= WEEKDAY_GATE_S
    say("Activity by Month:", gate=long_)
    bars(named("month", MONTHS, MONTHS, long_), MONTH_BAR, F.rpad("label", 9, " "))
    say("", gate=long_)
    noted = F.broadcast(of("notif_type").agg(F.count(F.lit(1)).alias("n")).where("n > 0"))
    stated = F.broadcast(of("notif_status").agg(F.count(F.lit(1)).alias("n")).where("n > 0"))
    pair = F.concat(F.lit("  "), F.col("item"), F.lit(": "), F.col("count").cast("string"))
    for label in ("Notification Statistics:", "Notification Types:"):
        add(noted, F.lit(0), F.lit(label))
    add(of("notif_type"), F.col("rank"), pair)
    add(noted.join(stated.drop("n")), F.lit(0), F.lit("Notification Statuses:"))
    add(of("notif_status").join(noted.drop("n")), F.col("rank"), pair)
    add(noted, F.lit(0), F.lit(""))
    say("Activity by Hour:")
    bars(of("hour").withColumn("place", F.col("item").cast("int")), HOUR_BAR,
         F.concat(F.lpad("item", 2, "0"), F.lit(":00")))
    say("")
    say("Activity by Day of Week:", gate=days)
    bars(named("weekday", WEEKDAYS, WEEKDAY_ABBREV, days).where("count > 0"), WEEKDAY_BAR, F.col("label"))
    say("", gate=days)
    say("", END, "")
    return _numbered(parts)


def _numbered(parts: list[DataFrame]) -> DataFrame:
    """A few hundred lines at most, so one task may number them."""
    every = reduce(DataFrame.unionByName, parts)
    return every.select(F.row_number().over(Window.orderBy("part", "pos")).alias("line_no"), "line")


def analysis_report(entries: DataFrame, weighted: bool = True, verbose: bool = False) -> list[str]:
    """The report's lines, as the command prints them."""
    return [r["line"] for r in report_lines(entries, weighted, verbose).orderBy("line_no").collect()]


def write_report(spark: SparkSession, lines: list[str] | DataFrame, path: str) -> None:
    """K4: the report text to a folder (one small file); ``lines``: as rows or as a list."""
    if isinstance(lines, DataFrame):
        rows = lines.orderBy("line_no").select(F.col("line").alias("value"))
    else:
        rows = spark.createDataFrame([(x,) for x in lines], "value string")
    rows.coalesce(1).write.mode("overwrite").text(path)
