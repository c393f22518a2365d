"""The original tool's three entry flows as functions (no flag parsing):
read -> filter -> optional trim -> one output. Outputs are separate choices,
not a flag precedence (SURVEY Q11)."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, SparkSession

from .. import sinks
from ..operators.dedup import trim as trim_entries
from ..sources.files import read_log_file, read_log_files
from ..sources.packets import packet_entries
from .report import analysis_report, write_report


def file_entries(spark: SparkSession, paths: list[str], **filters: str) -> DataFrame:
    """``file`` command: one path -> its entries in line order; several paths
    -> missing ones skipped with a warning, the rest merged by time."""
    if len(paths) == 1:
        return read_log_file(spark, paths[0], **filters)
    entries, missing = read_log_files(spark, paths, **filters)
    for path in missing:
        warnings.warn(f"file '{path}' does not exist, skipped", stacklevel=2)
    return entries


def notification_entries(spark: SparkSession, path: str, **filters: str) -> DataFrame:
    """``notification`` command: exactly one file, no sort."""
    return read_log_file(spark, path, **filters)


def support_packet_entries(spark: SparkSession, packets: str | list[str], **filters: str) -> DataFrame:
    """``support-packet`` command: log members of the packet(s), zip order."""
    return packet_entries(spark, packets, **filters)


def process(entries: DataFrame, output: str = "analyze", trim: bool = False,
            trim_json_path: str | None = None, path: str | None = None,
            verbose: bool = False):
    """The common tail of every command.

    ``output``: ``analyze`` (report lines; written to ``path`` when given),
    ``json`` (the indented array to ``path``, else the rows with their JSON text in input
    order), ``raw`` (pretty text rows), ``csv`` (written to ``path``). With ``trim`` the entries
    are deduplicated first (and written as a JSON array to ``trim_json_path``);
    the analysis then counts each kept entry once, as the original does."""
    spark = entries.sparkSession
    if trim:
        entries = trim_entries(entries)
        if trim_json_path:
            sinks.write_json_array(entries, trim_json_path)
    if output == "analyze":
        lines = analysis_report(entries, weighted=not trim, verbose=verbose)
        if path:
            write_report(spark, lines, path)
        return lines
    if output == "json":
        if path:
            sinks.write_json_array(entries, path)
            return None
        return sinks.json_rows(entries).orderBy("ord")
    if output == "raw":
        rows = sinks.pretty_rows(entries)
        if path:
            sinks.write_pretty(entries, path)
            return None
        return rows.orderBy("ord")
    if output == "csv":
        if not path:
            raise ValueError("csv output needs a path")
        sinks.write_csv(entries, path)
        return None
    raise ValueError(f"unknown output {output!r}")
