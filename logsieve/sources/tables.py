"""Adapters from the driver's Parquet tables to raw log lines and entries.

``event_lines`` renders every ``events`` row as a real log line (JSON for even
ids, plain text for odd ids, five timestamp shapes) and adds one malformed line
for every ``error`` event and every odd ``signup`` event, so the parser, the
reject route and all statistics run on text that grows with the table.
``document_entries`` / ``conversation_entries`` map the text tables to entries
(whole texts, never prefixes) for the near-duplicate and tail operators.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.parse import parse_lines
from ..functions.text import pinned

# Columns read from each table (the scans prune to these).
EVENT_COLUMNS = ("event_id", "ts", "user_id", "event_type", "value", "props")
# Events that a task renders and parses, about: a few bytes of Parquet become a long line.
TASK_EVENTS = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Parsing is CPU-heavy per row: when a scan yields fewer splits than the
    cluster has cores (a small file, one row group), hash-spread the rows
    first. Large inputs already come in many splits and are left alone."""
    try:
        sc = df.sparkSession.sparkContext
        few = df.rdd.getNumPartitions() < sc.defaultParallelism
    except Exception:  # noqa: BLE001 - no RDD view (e.g. a remote session)
        return df
    return df.repartition(sc.defaultParallelism) if few else df


def bounded_tasks(df: DataFrame, rows: int) -> DataFrame:
    """``df`` dealt over tasks of about ``rows`` rows, one for each core at least: by the
    rows, not by the splits, whose rows are bounded by compressed bytes only (or by nothing,
    as a row group is not split). Dealt by all columns, so it needs no sort."""
    n = math.ceil(df.count() / rows)
    return df.repartition(max(n, df.sparkSession.sparkContext.defaultParallelism), *df.columns)


# --- fixed values: how an event is written as a log line ---------------------
#   level     event_type, upper-cased when event_id % 4 = 0
#   time      millisecond text; shape by event_id % 5:
#             0 'yyyy-MM-dd HH:mm:ss.SSS Z'   1 'yyyy-MM-ddTHH:mm:ss.SSSZ'
#             2 'yyyy-MM-dd HH:mm:ss.SSS +02:00' (even id) / '-05:30' (odd id),
#               wall clock shifted by the offset
#             3 'yyyy/MM/dd HH:mm:ss.SSS'     4 'yyyy-MM-dd HH:mm:ss.SSS UTC'
#   message   'user <user_id> <event_type> step <event_id % 5>'
#   caller    '<event_type>/handler.go:<user_id % 7>'
#   user      'u<user_id>'
#   cents     round(value * 100)
#   status    'Sent' when value < 100 else 'Received'
_RENDER = (
    "event_id",
    "CASE WHEN event_id % 4 = 0 THEN upper(event_type) ELSE event_type END AS lvl",
    "date_trunc('MILLISECOND', ts) AS ms",
    "CASE WHEN event_id % 5 = 2 THEN"
    " CASE WHEN event_id % 2 = 0 THEN '+02:00' ELSE '-05:30' END END AS off",
    "concat('user ', user_id, ' ', event_type, ' step ', event_id % 5) AS msg",
    "concat(event_type, '/handler.go:', user_id % 7) AS caller",
    "concat('u', user_id) AS usr",
    "get_json_object(props, '$.k') AS k",
    "props",
    "CAST(round(value * 100) AS BIGINT) AS cents",
    "CASE WHEN value < 100 THEN 'Sent' ELSE 'Received' END AS status",
    "event_type",
    "user_id",
)

_TS_TEXT = """
  CASE event_id % 5
    WHEN 0 THEN concat(date_format(wall, 'yyyy-MM-dd HH:mm:ss.SSS'), ' Z')
    WHEN 1 THEN concat(date_format(wall, "yyyy-MM-dd'T'HH:mm:ss.SSS"), 'Z')
    WHEN 2 THEN concat(date_format(wall, 'yyyy-MM-dd HH:mm:ss.SSS'), ' ', off)
    WHEN 3 THEN date_format(wall, 'yyyy/MM/dd HH:mm:ss.SSS')
    ELSE concat(date_format(wall, 'yyyy-MM-dd HH:mm:ss.SSS'), ' UTC')
  END AS ts_text
"""

_JSON_OBJECT = """
  to_json(named_struct(
    'timestamp', ts_text, 'level', lvl, 'msg', msg, 'caller', caller,
    'user_id', usr, 'logSource', 'notifications', 'ackId', concat('a', event_id),
    'type', event_type, 'status', status, 'cents', cents,
    'retry', event_id % 3 = 0)) AS obj
"""

_GOOD_LINE = """
  CASE WHEN event_id % 2 = 0 THEN
    concat(substring(obj, 1, length(obj) - 1), ',"props":', props, '}')
  ELSE
    concat(lvl, ' [', ts_text, '] ', msg, ' caller="', caller, '" user_id=', usr,
           ' k=', k, ' cents=', cents)
  END
"""

_BAD_LINE = """
  CASE
    WHEN event_type = 'error' AND event_id % 2 = 0 THEN
      concat('{"timestamp":"', ts_text, '","level":"error","msg":"user ', user_id, ' err')
    WHEN event_type = 'error' THEN
      concat('error: connection reset for user ', user_id)
    WHEN event_type = 'signup' AND event_id % 2 = 1 THEN
      concat('info [', date_format(ms, 'yyyy-MM-dd'), ' 24:00:00.000 Z] signup retry user ', user_id)
  END
"""


def event_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw lines ``(file_path, ord, line_id, value)`` rendered from ``events``."""
    ev = bounded_tasks(table(spark, sf_dir, "events").select(*EVENT_COLUMNS), TASK_EVENTS)
    # pinned stages: each rendered piece is computed once per row
    staged = pinned(ev.selectExpr(*_RENDER), wall=F.expr(
        "CASE WHEN off = '+02:00' THEN ms + INTERVAL 2 HOURS "
        "WHEN off = '-05:30' THEN ms - INTERVAL '5:30' HOUR TO MINUTE "
        "ELSE ms END"))
    staged = pinned(staged, ts_text=F.expr(_TS_TEXT.replace("AS ts_text", "")))
    staged = pinned(staged, obj=F.expr(_JSON_OBJECT.replace("AS obj", "")))
    lines = staged.selectExpr(
        "event_id",
        f"array(named_struct('kind', 0L, 'value', {_GOOD_LINE}),"
        f"      named_struct('kind', 1L, 'value', {_BAD_LINE})) AS lines",
    ).selectExpr("event_id", "inline(lines)").where("value IS NOT NULL")
    return lines.select(
        F.lit("events").alias("file_path"),
        F.struct(
            F.lit(0).cast("bigint").alias("f"),
            F.lit("events").alias("n"),
            F.col("event_id").alias("p"),
            F.col("kind").alias("s"),
        ).alias("ord"),
        (F.col("event_id") * 2 + F.col("kind")).alias("line_id"),
        "value",
    )


def event_parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rendered lines, parsed; ``parse_error`` set on rejects."""
    return parse_lines(event_lines(spark, sf_dir))


def event_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parsed entries from ``events`` (rejects removed)."""
    return (
        event_parsed(spark, sf_dir)
        .where(F.col("parse_error").isNull())
        .drop("parse_error", "value")
    )


# --- fixed values: how event lines are packed into support packets ---------------
#   packet    event_id // PACKET_EVENTS; no zip at all where packet % 7 = 6
#   members   in this order; an event's lines are in member event_id % 4
#   damage    where packet % 5 = 2 the last member's data has a wrong checksum
PACKET_EVENTS = 500
PACKET_MEMBERS = ("srv/logs/app.txt", "notification_2.txt", "config.json", "srv\\logs\\b.txt")


def _packet(frame):
    """The zip of one packet's lines (at most PACKET_EVENTS events)."""
    import io
    import zipfile

    import pandas as pd

    number = int(frame["packet"].iloc[0])
    rows = frame.sort_values("line_id")
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for k, name in enumerate(PACKET_MEMBERS):
            lines = rows["value"][(rows["line_id"] // 2) % len(PACKET_MEMBERS) == k]
            info = zipfile.ZipInfo(name, (2024, 1, 1, 0, 0, 0))
            info.compress_type = zipfile.ZIP_STORED if k == 3 else zipfile.ZIP_DEFLATED
            z.writestr(info, "".join(x + "\n" for x in lines))
            stored_at = info.header_offset + 30 + len(info.filename.encode())
    content = bytearray(out.getvalue())
    if number % 5 == 2:
        content[stored_at:stored_at + 1] = b"#"
    return pd.DataFrame({"path": [f"packet-{number:06d}.zip"],
                         "content": [b"no zip" if number % 7 == 6 else bytes(content)]})


def event_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(path, content)``: the event lines as support packets, some damaged."""
    lines = event_lines(spark, sf_dir).select(
        F.floor(F.col("ord.p") / PACKET_EVENTS).cast("bigint").alias("packet"), "line_id", "value")
    return lines.groupBy("packet").applyInPandas(_packet, "path string, content binary")


def document_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as entries: level=lang, source=source, message=whole text,
    input order = doc_id, time = 2024-01-01 + doc_id minutes."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return docs.select(
        F.lit("documents").alias("file_path"),
        F.struct(
            F.lit(0).cast("bigint").alias("f"),
            F.lit("documents").alias("n"),
            F.col("doc_id").alias("p"),
            F.lit(0).cast("bigint").alias("s"),
        ).alias("ord"),
        F.col("doc_id").alias("line_id"),
        F.expr("TIMESTAMP_NTZ'2024-01-01 00:00:00' + make_dt_interval(0, 0, doc_id, 0)").alias("ts"),
        F.expr("TIMESTAMP_NTZ'2024-01-01 00:00:00' + make_dt_interval(0, 0, doc_id, 0)").alias("wall_ts"),
        F.lit("+00:00").alias("tz_offset"),
        F.coalesce("lang", F.lit("")).alias("level"),
        F.coalesce("text", F.lit("")).alias("message"),
        F.coalesce("source", F.lit("")).alias("source"),
        F.lit("").alias("user"),
        F.lit("").alias("log_source"),
        F.lit("").alias("ack_id"),
        F.lit("").alias("type"),
        F.lit("").alias("status"),
        F.create_map().cast("map<string,string>").alias("extras"),
        F.lit(0).cast("bigint").alias("duplicate_count"),
    )


def conversation_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``conversations`` as entries: one per turn, level=role, message=whole
    text, input order = (conv_id, turn), group key ``conv_id``."""
    conv = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return conv.select(
        F.col("conv_id"),
        F.lit("conversations").alias("file_path"),
        F.struct(
            F.col("conv_id").alias("f"),
            F.lit("conversations").alias("n"),
            F.col("turn").alias("p"),
            F.lit(0).cast("bigint").alias("s"),
        ).alias("ord"),
        F.col("turn").alias("line_id"),
        F.expr("TIMESTAMP_NTZ'2024-01-01 00:00:00' + make_dt_interval(0, conv_id, turn, 0)").alias("ts"),
        F.expr("TIMESTAMP_NTZ'2024-01-01 00:00:00' + make_dt_interval(0, conv_id, turn, 0)").alias("wall_ts"),
        F.lit("+00:00").alias("tz_offset"),
        F.coalesce("role", F.lit("")).alias("level"),
        F.coalesce("text", F.lit("")).alias("message"),
        F.lit("").alias("source"),
        F.lit("").alias("user"),
        F.lit("").alias("log_source"),
        F.lit("").alias("ack_id"),
        F.lit("").alias("type"),
        F.lit("").alias("status"),
        F.create_map().cast("map<string,string>").alias("extras"),
        F.lit(0).cast("bigint").alias("duplicate_count"),
    )
