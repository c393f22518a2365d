"""Registered queries: one callable ``(spark, sf_dir) -> DataFrame`` per
operator, run over the driver's whole tables. Column names match the DuckDB
oracle in ``oracle.py``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import extras_text
from ..operators import filters as flt
from ..operators import stats as st
from ..sources import tables as tb
from ..session import dropped, scratch
from ..sources.staging import source_state, stage

Query = Callable[[SparkSession, str], DataFrame]

ENTRY_OUT = ("line_id", "ts", "wall_ts", "tz_offset", "level", "message", "source",
             "user", "log_source", "ack_id", "type", "status")

# --- fixed values: filter arguments of the registered filter queries --------
FILTER_LEVEL = "ERROR"
FILTER_USER = "U12"
FILTER_START = "2024-01-05 00:00:00.000"
FILTER_END = "2024-01-12 12:30:00.000"
FILTER_SEARCH = "K=4"
FILTER_REGEX = r"handler\.go:[35]$|^u1[0-9]$"
FILTER_ALL = dict(level="click", user="u1", start="2024-01-03 00:00:00.000",
                  end="2024-01-20 00:00:00.000", search_term="step", regex=r"handler\.go:[0-6]")
BROWSE_TERM = "VIEW"


def _parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rendered event lines, parsed once per session and staged as Parquet."""
    state = source_state(spark, f"{sf_dir.rstrip('/')}/events.parquet")
    return stage(spark, "event_parsed", state, lambda: tb.event_parsed(spark, sf_dir))


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parsed(spark, sf_dir).where(F.col("parse_error").isNull()).drop("parse_error", "value")


def _entry_rows(df: DataFrame) -> DataFrame:
    return df.select(*ENTRY_OUT, extras_text(F.col("extras")).alias("extras_text"))


def q_parse_plain(spark, sf_dir):
    return _entry_rows(_entries(spark, sf_dir).where(F.col("line_format") == "plain"))


def q_parse_json(spark, sf_dir):
    return _entry_rows(_entries(spark, sf_dir).where(F.col("line_format") == "json"))


def q_parse_timestamps(spark, sf_dir):
    return _entries(spark, sf_dir).select("line_id", "ts", "wall_ts", "tz_offset")


def q_rejects(spark, sf_dir):
    parsed = _parsed(spark, sf_dir)
    return parsed.where(F.col("parse_error").isNotNull()).select(
        "line_id", F.col("parse_error").alias("reason"), "line_format"
    )


def q_extras_text(spark, sf_dir):
    return _entries(spark, sf_dir).select("line_id", extras_text(F.col("extras")).alias("extras_text"))


def _filtered(spark, sf_dir, **kw):
    return _entry_rows(flt.apply_filters(_entries(spark, sf_dir), **kw))


def q_filter_level(spark, sf_dir):
    return _filtered(spark, sf_dir, level=FILTER_LEVEL)


def q_filter_user(spark, sf_dir):
    return _filtered(spark, sf_dir, user=FILTER_USER)


def q_filter_time(spark, sf_dir):
    return _filtered(spark, sf_dir, start=FILTER_START, end=FILTER_END)


def q_filter_search(spark, sf_dir):
    return _filtered(spark, sf_dir, search_term=FILTER_SEARCH)


def q_filter_regex(spark, sf_dir):
    return _filtered(spark, sf_dir, regex=FILTER_REGEX)


def q_filter_all(spark, sf_dir):
    return _filtered(spark, sf_dir, **FILTER_ALL)


def q_browse_filter(spark, sf_dir):
    return _entry_rows(_entries(spark, sf_dir).where(flt.browse(BROWSE_TERM)))


def q_merge_sorted(spark, sf_dir):
    return _entries(spark, sf_dir).orderBy("ts", "ord").select("line_id", "ts", "level", "message")


def q_total_and_range(spark, sf_dir):
    return st.summary(_entries(spark, sf_dir))


def q_level_counts(spark, sf_dir):
    return st.level_counts(_entries(spark, sf_dir))


def q_level_share(spark, sf_dir):
    return st.level_share(_entries(spark, sf_dir))


def q_error_rate(spark, sf_dir):
    return st.summary(_entries(spark, sf_dir)).select("error_count", "total", "error_rate")


def q_top_sources(spark, sf_dir):
    return st.top_sources(_entries(spark, sf_dir))


def q_top_users(spark, sf_dir):
    return st.top_users(_entries(spark, sf_dir))


def q_top_errors(spark, sf_dir):
    return st.top_errors(_entries(spark, sf_dir))


def q_by_hour(spark, sf_dir):
    return st.by_hour(_entries(spark, sf_dir))


def q_by_weekday(spark, sf_dir):
    return st.by_weekday(_entries(spark, sf_dir))


def q_by_month(spark, sf_dir):
    return st.by_month(_entries(spark, sf_dir))


def q_hour_level(spark, sf_dir):
    return st.hour_level(_entries(spark, sf_dir))


def q_weekday_level(spark, sf_dir):
    return st.weekday_level(_entries(spark, sf_dir))


def q_month_level(spark, sf_dir):
    return st.month_level(_entries(spark, sf_dir))


def q_dominant_level(spark, sf_dir):
    return st.dominant_level(st.hour_level(_entries(spark, sf_dir)), "hour")


def q_peak_hours(spark, sf_dir):
    return st.peak_hours(_entries(spark, sf_dir))


def q_hour_bars(spark, sf_dir):
    return st.hour_bars(_entries(spark, sf_dir))


def q_weekday_bars(spark, sf_dir):
    return st.weekday_bars(_entries(spark, sf_dir))


def q_month_bars(spark, sf_dir):
    return st.month_bars(_entries(spark, sf_dir))


def q_patterns(spark, sf_dir):
    return st.patterns(_entries(spark, sf_dir))


def q_notif_types(spark, sf_dir):
    return st.notification_types(_entries(spark, sf_dir))


def q_notif_statuses(spark, sf_dir):
    return st.notification_statuses(_entries(spark, sf_dir))


def q_report_stats(spark, sf_dir):
    return st.ranked(st.stat_items(_entries(spark, sf_dir)))


QUERIES: dict[str, Query] = {
    "parse_plain": q_parse_plain,
    "parse_json": q_parse_json,
    "parse_timestamps": q_parse_timestamps,
    "rejects": q_rejects,
    "extras_text": q_extras_text,
    "filter_level": q_filter_level,
    "filter_user": q_filter_user,
    "filter_time": q_filter_time,
    "filter_search": q_filter_search,
    "filter_regex": q_filter_regex,
    "filter_all": q_filter_all,
    "browse_filter": q_browse_filter,
    "merge_sorted": q_merge_sorted,
    "total_and_range": q_total_and_range,
    "level_counts": q_level_counts,
    "level_share": q_level_share,
    "error_rate": q_error_rate,
    "top_sources": q_top_sources,
    "top_users": q_top_users,
    "top_errors": q_top_errors,
    "by_hour": q_by_hour,
    "by_weekday": q_by_weekday,
    "by_month": q_by_month,
    "hour_level": q_hour_level,
    "weekday_level": q_weekday_level,
    "month_level": q_month_level,
    "dominant_level": q_dominant_level,
    "peak_hours": q_peak_hours,
    "hour_bars": q_hour_bars,
    "weekday_bars": q_weekday_bars,
    "month_bars": q_month_bars,
    "patterns": q_patterns,
    "notif_types": q_notif_types,
    "notif_statuses": q_notif_statuses,
    "report_stats": q_report_stats,
}


# --- near-duplicate trimming ---------------------------------------------------

def _documents_state(spark, sf_dir):
    return source_state(spark, f"{sf_dir.rstrip('/')}/documents.parquet")


def _trimmed_docs(spark, sf_dir):
    """Trimmed document entries, computed once per session for the queries on them."""
    from ..operators.dedup import trim

    with scratch():
        return stage(spark, "document_trim", _documents_state(spark, sf_dir),
                     lambda: trim(_docs(spark, sf_dir)), date_col=None, codec="zstd")


def _docs(spark, sf_dir):
    """Document entries with their normalised message, staged once per session."""
    from ..functions.similarity import normalize

    return stage(
        spark, "document_entries", _documents_state(spark, sf_dir),
        lambda: tb.spread(tb.document_entries(spark, sf_dir)).withColumn("norm", normalize(F.col("message"))),
        date_col=None, codec="zstd",
    )


def q_normalize(spark, sf_dir):
    from ..functions.similarity import normalize

    docs = tb.table(spark, sf_dir, "documents").select("doc_id", "text")
    return tb.spread(docs).select("doc_id", normalize(F.coalesce("text", F.lit(""))).alias("norm"))


def q_exact_collapse(spark, sf_dir):
    from ..operators.dedup import entry_nodes

    nodes = entry_nodes(_docs(spark, sf_dir))
    return nodes.select(F.col("node.p").alias("node_id"), "lvl", "lsrc", "weight")


def q_similar_pairs(spark, sf_dir):
    from ..operators.dedup import _node_attrs, entry_nodes, numbered_nodes, similar_edges

    nodes = numbered_nodes(entry_nodes(_docs(spark, sf_dir)).drop("row"))
    pairs = similar_edges(_node_attrs(nodes))
    ids = nodes.select("seq", F.col("node.p").alias("id"))
    a = ids.select(F.col("seq").alias("a"), F.col("id").alias("a_id"))
    b = ids.select(F.col("seq").alias("b"), F.col("id").alias("b_id"))
    return pairs.join(a, "a").join(b, "b").select("a_id", "b_id")


def q_trim(spark, sf_dir):
    from ..operators.dedup import trim

    return trim(_entries(spark, sf_dir)).select(
        F.col("ord.p").alias("event_id"), "level", "source", "message", "duplicate_count"
    )


def q_trim_documents(spark, sf_dir):
    return _trimmed_docs(spark, sf_dir).select(
        F.col("ord.p").alias("doc_id"), "level", "source", "duplicate_count"
    )


def q_trim_report(spark, sf_dir):
    from ..operators.dedup import trim_report

    return trim_report(_docs(spark, sf_dir), _trimmed_docs(spark, sf_dir))


def q_dedup_summary(spark, sf_dir):
    s = st.summary(_trimmed_docs(spark, sf_dir), weighted=True)
    return s.select("total", "unique_rows", "total_with_duplicates", "is_deduplicated")


QUERIES.update({
    "normalize": q_normalize,
    "exact_collapse": q_exact_collapse,
    "similar_pairs": q_similar_pairs,
    "trim": q_trim,
    "trim_documents": q_trim_documents,
    "trim_report": q_trim_report,
    "dedup_summary": q_dedup_summary,
})


# --- tail sample, bundle and exports ------------------------------------------

TAIL_N = 100
CONVERSATION_TAIL_N = 5


def q_tail_sample(spark, sf_dir):
    from ..operators.bundle import tail_sample

    return tail_sample(_entries(spark, sf_dir), TAIL_N).select("i", "line_id", "level", "message")


def q_bundle_lines(spark, sf_dir):
    from ..operators.bundle import bundle_lines, tail_sample

    return bundle_lines(tail_sample(_entries(spark, sf_dir), TAIL_N)).select("i", "block")


def q_bundle_prompt(spark, sf_dir):
    from ..operators.bundle import bundle_lines, bundle_prompt, tail_sample

    return bundle_prompt(bundle_lines(tail_sample(_entries(spark, sf_dir), TAIL_N)))


def q_conversation_bundles(spark, sf_dir):
    from ..operators.bundle import bundle_lines, bundle_prompt, tail_per_group

    conv = tb.conversation_entries(spark, sf_dir)
    lines = bundle_lines(tail_per_group(conv, "conv_id", CONVERSATION_TAIL_N))
    return bundle_prompt(lines, group="conv_id")


def q_preview(spark, sf_dir):
    from ..operators.bundle import preview

    return preview(_trimmed_docs(spark, sf_dir)).select(F.col("ord.p").alias("doc_id"), "preview")


def q_csv_rows(spark, sf_dir):
    from ..sinks import csv_columns

    return _entries(spark, sf_dir).select("line_id", *csv_columns())


def q_json_rows(spark, sf_dir):
    from ..sinks import json_object

    return _entries(spark, sf_dir).select("line_id", json_object().alias("json"))


def q_pretty_rows(spark, sf_dir):
    from ..sinks import pretty_block

    return _entries(spark, sf_dir).select("line_id", pretty_block().alias("text"))


QUERIES.update({
    "tail_sample": q_tail_sample,
    "bundle_lines": q_bundle_lines,
    "bundle_prompt": q_bundle_prompt,
    "conversation_bundles": q_conversation_bundles,
    "preview": q_preview,
    "csv_rows": q_csv_rows,
    "json_rows": q_json_rows,
    "pretty_rows": q_pretty_rows,
})


# --- files, time order, weights ------------------------------------------------

def _event_files(spark, sf_dir) -> list[str]:
    """The rendered event lines as two folders of text files (even and odd
    events) below the checkpoint folder, written once per session."""
    from ..session import ensure_checkpoint_dir

    state = source_state(spark, f"{sf_dir.rstrip('/')}/events.parquet")
    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/event-files-{state[:16]}"
    paths = [f"{root}/even", f"{root}/odd"]
    lines = tb.event_lines(spark, sf_dir)
    for k, path in enumerate(paths):
        jvm = spark.sparkContext._jvm
        done = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        if not done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
            lines.where(F.col("ord.p") % 2 == k).select("value").write.mode("overwrite").text(path)
    return paths


def q_scan_files(spark, sf_dir):
    """Text files, read, parsed and merged by time."""
    from ..sources.files import read_log_files

    entries, _ = read_log_files(spark, _event_files(spark, sf_dir))
    return entries.select(*[c for c in ENTRY_OUT if c != "line_id"], extras_text(F.col("extras")).alias("extras_text"))


def q_tail_by_time(spark, sf_dir):
    from ..operators.bundle import tail_sample
    from ..sources.files import time_ordered

    return tail_sample(time_ordered(_entries(spark, sf_dir)), TAIL_N).select("i", "line_id", "level", "message")


def q_trim_by_time(spark, sf_dir):
    from ..operators.dedup import trim
    from ..sources.files import time_ordered

    return trim(time_ordered(_entries(spark, sf_dir))).select(
        F.col("ord.p").alias("event_id"), "level", "source", "message", "duplicate_count")


def q_weighted_levels(spark, sf_dir):
    from ..operators.dedup import trim

    return st.level_counts(trim(_entries(spark, sf_dir)), weighted=True)


QUERIES.update({
    "scan_files": q_scan_files,
    "tail_by_time": q_tail_by_time,
    "trim_by_time": q_trim_by_time,
    "weighted_levels": q_weighted_levels,
})


# --- source pairs, packets, appended trim, report and array as rows ----------------

def q_source_pairs(spark, sf_dir):
    """D5 as a table: the sources of events and documents."""
    from ..operators.source_pairs import source_pairs

    return source_pairs(_entries(spark, sf_dir).select("source").unionByName(
        tb.document_entries(spark, sf_dir).select("source")))


def _packets(spark, sf_dir):
    """The support packets made of the event lines, as a written table of (path, content)."""
    state = source_state(spark, f"{sf_dir.rstrip('/')}/events.parquet")
    return stage(spark, "event_packets", state, lambda: tb.event_packets(spark, sf_dir), date_col=None)


def q_packet_entries(spark, sf_dir):
    from ..sources.packets import Packets

    entries = Packets(spark, _packets(spark, sf_dir)).entries()
    return entries.select(F.col("file_path").alias("packet"), "member", *[c for c in ENTRY_OUT if c != "line_id"],
                          extras_text(F.col("extras")).alias("extras_text"))


def q_packet_status(spark, sf_dir):
    from ..sources.packets import packet_status

    return packet_status(spark, _packets(spark, sf_dir))


def q_trim_appended(spark, sf_dir):
    """Three deliveries of documents, one after the other: the trim of the whole."""
    from ..operators.dedup import trim_appended, trimmed_entries

    docs = _docs(spark, sf_dir)
    top = docs.agg(F.max("ord.p")).first()[0] or 0
    leaders = None
    for k in range(3):
        place = F.least(F.lit(2), F.floor(F.col("ord.p") * 3 / F.lit(top + 1)))
        before, leaders = leaders, trim_appended(leaders, docs.where(place == k))
        if before is not None:
            dropped(before)
    return trimmed_entries(leaders).select(F.col("ord.p").alias("doc_id"), "level", "source", "duplicate_count")


def q_report_compact(spark, sf_dir):
    from .report import report_lines

    return report_lines(_entries(spark, sf_dir))


def q_report_verbose(spark, sf_dir):
    from .report import report_lines

    return report_lines(_entries(spark, sf_dir), verbose=True)


def q_json_array(spark, sf_dir):
    from ..sinks import json_array_lines

    return json_array_lines(_entries(spark, sf_dir)).select(F.col("ord.p").alias("event_id"), "value")


def q_search_indexed(spark, sf_dir):
    """F5 with the files' trigram filters: the rows of filter_search."""
    from ..operators.search_index import build_index, search

    table = _parsed(spark, sf_dir)
    index = build_index(table)
    return _entry_rows(search(table, index, FILTER_SEARCH).where(F.col("parse_error").isNull()))


QUERIES.update({
    "search_indexed": q_search_indexed,
    "source_pairs": q_source_pairs,
    "packet_entries": q_packet_entries,
    "packet_status": q_packet_status,
    "trim_appended": q_trim_appended,
    "report_compact": q_report_compact,
    "report_verbose": q_report_verbose,
    "json_array": q_json_array,
})
