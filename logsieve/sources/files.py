"""Log files as one distributed scan.

``read_log_lines`` resolves the given paths (files, folders or globs) on the
driver's file-system client (metadata only), reports the missing ones, and
reads all existing files with a single ``spark.read.text`` scan that splits by
size. Each line keeps its file, the file's argument index and its position
(split start + monotonically increasing id), which restores the original line
order. Lines end at '\\n'; a trailing '\\r' is dropped, as a line scanner does.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.parse import parse_lines
from ..functions.timestamps import epoch_micros
from ..operators.filters import apply_filters


@dataclass
class LogScan:
    lines: DataFrame
    missing: list[str] = field(default_factory=list)

    def parsed(self) -> DataFrame:
        return parse_lines(self.lines)

    def entries(self) -> DataFrame:
        """The parsed rows (rejects left out)."""
        return self.parsed().where(F.col("parse_error").isNull()).drop("parse_error")

    def rejects(self) -> DataFrame:
        """Unparseable lines with the reason, as a queryable table."""
        return self.parsed().where(F.col("parse_error").isNotNull()).select(
            "file_path", "ord", "value", F.col("parse_error").alias("reason")
        )


def _resolve(spark: SparkSession, paths: list[str]) -> tuple[list[tuple[int, str]], list[str]]:
    """(argument index, file URI) of every file below the arguments, and the
    arguments that match nothing. Metadata only; URIs are encoded like Spark's
    ``_metadata.file_path``."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()

    def uri(path) -> str:
        # through a new Path: one spelling (file:/x, not file:///x), as the scan reports it
        return jvm.org.apache.hadoop.fs.Path(path.toString()).toUri().toString()

    found: list[tuple[int, str]] = []
    missing: list[str] = []
    for idx, p in enumerate(paths):
        hp = jvm.org.apache.hadoop.fs.Path(p)
        fs = hp.getFileSystem(conf)
        statuses = fs.globStatus(hp)
        if statuses is None or len(statuses) == 0:
            missing.append(p)
            continue
        for st in statuses:
            if not st.isDirectory():
                found.append((idx, uri(st.getPath())))
                continue
            files = fs.listFiles(st.getPath(), True)
            while files.hasNext():
                path = files.next().getPath()
                if not path.getName().startswith(("_", ".")):
                    found.append((idx, uri(path)))
    return found, missing


#: File lists up to this long are broadcast to the scan.
BROADCAST_FILES = 100_000


def read_log_lines(spark: SparkSession, paths: str | list[str]) -> LogScan:
    """One scan over every existing path; missing paths are listed, not fatal.
    A file named by several arguments is read for each, as the original does."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    found, missing = _resolve(spark, paths)
    if not found:
        empty = spark.createDataFrame([], "file_path string, ord struct<f:bigint,n:string,p:bigint,s:bigint>, value string")
        return LogScan(empty, missing)
    unescape = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    files = sorted({unescape(spark.sparkContext._jvm.java.net.URI(u)).toString() for _, u in found})
    raw = (
        spark.read.option("lineSep", "\n").text(files)
        .select(
            F.regexp_replace("value", "\r$", "").alias("value"),
            F.col("_metadata.file_path").alias("file_path"),
            F.col("_metadata.file_block_start").alias("block_start"),
            F.monotonically_increasing_id().alias("row_id"),
        )
    )
    if len({i for i, _ in found}) > 1:
        # one row per file: the lines themselves are not shuffled
        args = spark.createDataFrame([(i, u) for i, u in found], "arg_idx bigint, file_path string")
        raw = raw.join(F.broadcast(args) if len(found) <= BROADCAST_FILES else args, "file_path")
    else:
        raw = raw.withColumn("arg_idx", F.lit(found[0][0]).cast("bigint"))
    lines = raw.select(
        "file_path",
        F.struct(
            F.col("arg_idx").alias("f"),
            F.col("file_path").alias("n"),
            F.col("block_start").alias("p"),
            F.col("row_id").alias("s"),
        ).alias("ord"),
        "value",
    )
    return LogScan(lines, missing)


def time_ordered(entries: DataFrame) -> DataFrame:
    """Time becomes the input order (ties: argument, file, line), for every
    operator after a merge: ``ord`` leads with the time."""
    return entries.withColumn("ord", F.struct(
        epoch_micros(F.col("ts")).alias("f"),
        F.concat(F.lpad(F.col("ord.f").cast("string"), 10, "0"), F.lit(" "), F.col("ord.n")).alias("n"),
        F.col("ord.p").alias("p"), F.col("ord.s").alias("s")))


def read_log_file(spark: SparkSession, path: str, **filters: str) -> DataFrame:
    """Entries of one file (or a notification log), filtered.
    Raises if the file does not exist."""
    scan = read_log_lines(spark, [path])
    if scan.missing:
        raise FileNotFoundError(f"file '{path}' does not exist")
    return apply_filters(scan.entries(), **filters)


def read_log_files(spark: SparkSession, paths: list[str], require_entries: bool = True,
                   **filters: str) -> tuple[DataFrame, list[str]]:
    """Entries of many files sorted by time (ties by input order), plus the
    missing paths. Raises when nothing is left, like the original."""
    scan = read_log_lines(spark, paths)
    entries = apply_filters(scan.entries(), **filters)
    if require_entries and entries.isEmpty():
        raise ValueError("no valid log entries found in any of the provided files")
    return time_ordered(entries).orderBy("ord"), scan.missing
