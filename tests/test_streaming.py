"""Streaming: the parser and a windowed level count over a folder of files."""

import os
import tempfile

from logsieve.streaming.live import stream_entries, windowed_level_counts


def test_stream_level_counts(spark):
    d = tempfile.mkdtemp(prefix="logsieve-stream-")
    with open(os.path.join(d, "a.log"), "w") as fh:
        fh.write("\n".join([
            "info [2025-01-01 10:00:00.000 Z] a",
            "error [2025-01-01 10:10:00.000 Z] b",
            "info [2025-01-01 11:00:00.000 Z] c",
            "garbage line",
        ]) + "\n")
    counts = windowed_level_counts(stream_entries(spark, d))
    q = (counts.writeStream.outputMode("complete").format("memory").queryName("lvl_stream").start())
    try:
        q.processAllAvailable()
        rows = {(r.window_start.hour, r.level): r["count"] for r in spark.sql("SELECT * FROM lvl_stream").collect()}
    finally:
        q.stop()
    assert rows == {(10, "INFO"): 1, (10, "ERROR"): 1, (11, "INFO"): 1}
