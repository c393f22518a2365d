"""K1-K5: entry exports. Each ``*_rows`` function is a column projection (one
row per entry, distributed); the writers persist them with Spark's own sinks
(JSON Lines / CSV / text folders). ``json_array_lines`` / ``write_json_array`` give the
single indented array: its pieces are rows in input order, so it may have any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import extras_text
from ..schema import CSV_HEADER, NOTIFICATION_LOG_SOURCE


def _frac_trimmed(ts: Column) -> Column:
    f = F.regexp_replace(F.date_format(ts, "SSSSSS"), "0+$", "")
    return F.when(f == "", F.lit("")).otherwise(F.concat(F.lit("."), f))


def _zone(offset: Column) -> Column:
    return F.when(offset == "+00:00", F.lit("Z")).otherwise(offset)


def rfc3339(wall: Column, offset: Column, fraction: bool = True) -> Column:
    """Entry time with its own offset; 'Z' for a zero offset."""
    base = F.date_format(wall, "yyyy-MM-dd'T'HH:mm:ss")
    return F.concat(base, _frac_trimmed(wall) if fraction else F.lit(""), _zone(offset))


# --- fixed values: what the original's JSON encoder escapes beyond quotes, backslashes
# and control characters; control characters are written with small hex digits
HTML_ESCAPES = {"<": r"\u003c", ">": r"\u003e", "&": r"\u0026", "\u2028": r"\u2028", "\u2029": r"\u2029"}
HEX_LETTERS = ("0B", "0E", "0F", "1A", "1B", "1C", "1D", "1E", "1F")


def _escaped(json: Column) -> Column:
    """JSON text with the original encoder's escapes (these characters only occur in strings)."""
    for char, code in HTML_ESCAPES.items():
        json = F.replace(json, F.lit(char), F.lit(code))
    small = json
    for digits in HEX_LETTERS:  # after an even number of backslashes
        small = F.regexp_replace(small, rf"(?<!\\)((?:\\\\)*)\\u00{digits}", rf"$1\\u00{digits.lower()}")
    return F.when(json.rlike(r"\\u00[01][A-F]"), small).otherwise(json)


def json_string(c: Column) -> Column:
    """A string as JSON text, quotes included."""
    text = F.to_json(F.struct(c.alias("v")))  # {"v":"..."}
    return _escaped(F.substring(text, F.lit(6), F.length(text) - 6))


def _blank_to_null(c: str) -> Column:
    return F.when(F.col(c) != "", F.col(c))


def json_object(entries: DataFrame | None = None) -> Column:
    """K1: one entry as a JSON object; empty strings, empty extras and a zero
    duplicate count are omitted; extras keys sorted."""
    extras = F.when(
        F.size("extras") > 0, F.map_from_entries(F.array_sort(F.map_entries("extras")))
    )
    dc = F.when(F.coalesce(F.col("duplicate_count"), F.lit(0)) != 0, F.col("duplicate_count"))
    return _escaped(F.to_json(
        F.struct(
            rfc3339(F.col("wall_ts"), F.col("tz_offset")).alias("timestamp"),
            F.col("level").alias("level"),
            F.col("message").alias("message"),
            _blank_to_null("source").alias("source"),
            _blank_to_null("user").alias("user"),
            _blank_to_null("log_source").alias("log_source"),
            _blank_to_null("ack_id").alias("ack_id"),
            _blank_to_null("type").alias("type"),
            _blank_to_null("status").alias("status"),
            extras.alias("extras"),
            dc.alias("duplicate_count"),
        ),
        {"ignoreNullFields": "true"},
    ))


def json_rows(entries: DataFrame) -> DataFrame:
    return entries.select("*", json_object().alias("json"))


def write_json_lines(entries: DataFrame, path: str, mode: str = "overwrite") -> None:
    """K1/K3 at scale: one JSON object per line, one file per partition."""
    json_rows(entries).select(F.col("json").alias("value")).write.mode(mode).text(path)


def json_item() -> Column:
    """K1: one entry as an element of the indented array, without the comma after it."""
    def line(name: str, value: Column) -> Column:
        return F.concat(F.lit(f'    "{name}": '), value)

    def unless_blank(name: str) -> Column:
        return F.when(F.col(name) != "", line(name, json_string(F.col(name))))

    extras = F.array_join(F.transform(F.array_sort(F.map_entries("extras")), lambda e: F.concat(
        F.lit("      "), json_string(e["key"]), F.lit(": "), json_string(e["value"]))), ",\n")
    count = F.coalesce(F.col("duplicate_count"), F.lit(0))
    return F.concat(F.lit("  {\n"), F.concat_ws(
        ",\n",
        line("timestamp", json_string(rfc3339(F.col("wall_ts"), F.col("tz_offset")))),
        line("level", json_string(F.coalesce("level", F.lit("")))),
        line("message", json_string(F.coalesce("message", F.lit("")))),
        *[unless_blank(c) for c in ("source", "user", "log_source", "ack_id", "type", "status")],
        F.when(F.size("extras") > 0, line("extras", F.concat(F.lit("{\n"), extras, F.lit("\n    }")))),
        F.when(count != 0, line("duplicate_count", count.cast("string")))), F.lit("\n  }"))


def json_array_lines(entries: DataFrame) -> DataFrame:
    """K1's single indented array as rows (ord, value), one for each entry: joined by line
    ends in order of ``ord``, which is an entry's own place, they are the array. The
    first and the last place come from one aggregate, so commas and brackets need no
    pass over neighbours. No entries: the one row ``[]``."""
    ends = F.broadcast(entries.agg(F.min("ord").alias("_first"), F.max("ord").alias("_last")))
    items = entries.select("ord", json_item().alias("_item")).join(ends).select("ord", F.concat(
        F.when(F.col("ord") == F.col("_first"), F.lit("[\n")).otherwise(F.lit("")), F.col("_item"),
        F.when(F.col("ord") == F.col("_last"), F.lit("\n]")).otherwise(F.lit(","))).alias("value"))
    none = ends.where("_first is null").select(F.col("_first").alias("ord"), F.lit("[]").alias("value"))
    return items.unionByName(none)


def write_json_array(entries: DataFrame, path: str, mode: str = "overwrite") -> None:
    """K1/K3: the array as a text folder. The sort is a range sort over the cluster, so the part
    files, joined in order of their names, are the original's one file."""
    json_array_lines(entries).orderBy("ord").select("value").write.mode(mode).text(path)


def csv_columns() -> list[Column]:
    """K2: the ten export columns (no duplicate count), time in RFC 3339 seconds."""
    values = (
        rfc3339(F.col("wall_ts"), F.col("tz_offset"), fraction=False),
        F.col("level"), F.col("source"), F.col("message"), F.col("user"),
        F.col("log_source"), F.col("ack_id"), F.col("type"), F.col("status"),
        extras_text(F.col("extras")),
    )
    return [v.alias(h) for v, h in zip(values, CSV_HEADER)]


def csv_rows(entries: DataFrame) -> DataFrame:
    return entries.select(*csv_columns())


def write_csv(entries: DataFrame, path: str, mode: str = "overwrite") -> None:
    (csv_rows(entries).write.mode(mode)
     .option("header", True).option("quote", '"').option("escape", '"')
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
     .csv(path))


def pretty_block() -> Column:
    """K5: the human-readable block of one entry (no terminal colours)."""
    dc = F.coalesce(F.col("duplicate_count"), F.lit(0))
    notif = F.col("log_source") == NOTIFICATION_LOG_SOURCE

    def line(label: str, col: str, cond: Column | None = None) -> Column:
        c = (F.col(col) != "") if cond is None else cond
        return F.when(c, F.concat(F.lit(f"  {label}: "), F.col(col), F.lit("\n"))).otherwise(F.lit(""))

    extras_lines = F.array_join(
        F.transform(F.array_sort(F.map_entries("extras")),
                    lambda e: F.concat(F.lit("  "), e["key"], F.lit(": "), e["value"], F.lit("\n"))),
        "",
    )
    return F.concat(
        F.date_format("wall_ts", "yyyy-MM-dd HH:mm:ss"), F.lit(" ["), F.col("level"), F.lit("] "),
        F.col("source"), F.lit(" → "), F.col("message"),
        F.when(dc > 1, F.concat(F.lit(" (repeated "), dc.cast("string"), F.lit(" times)"))).otherwise(F.lit("")),
        F.lit("\n"),
        line("User", "user"),
        line("Source", "source"),
        line("Log Source", "log_source", notif),
        line("Ack ID", "ack_id", notif & (F.col("ack_id") != "")),
        line("Type", "type", notif & (F.col("type") != "")),
        line("Status", "status", notif & (F.col("status") != "")),
        extras_lines,
        F.lit("-" * 80),
    )


def pretty_rows(entries: DataFrame) -> DataFrame:
    return entries.select("*", pretty_block().alias("text"))


# --- fixed values: what is said about no entries, and under the last one -------
NO_ENTRIES = "No log entries found matching your criteria."
FOOTER = "Displayed {} log entries"


def pretty_footer(entries: DataFrame) -> DataFrame:
    """K5's last line: how many entries were shown, or that there are none."""
    n = entries.agg(F.count(F.lit(1)).alias("n"))
    told = F.concat(F.lit(FOOTER.split("{}")[0]), F.col("n").cast("string"), F.lit(FOOTER.split("{}")[1]))
    return n.select(F.when(F.col("n") == 0, F.lit(NO_ENTRIES)).otherwise(told).alias("text"))


def write_pretty(entries: DataFrame, path: str, mode: str = "overwrite") -> None:
    """K5: all blocks in input order and the footer, as a text folder. The range
    sort leaves the parts in order; the footer is the last one."""
    write_text(pretty_rows(entries).orderBy("ord"), "text", path, mode)
    write_text(pretty_footer(entries).coalesce(1), "text", path, "append")


def write_text(rows: DataFrame, column: str, path: str, mode: str = "overwrite") -> None:
    """K4/K5: one text column to a text folder."""
    rows.select(F.col(column).alias("value")).write.mode(mode).text(path)
