"""Files, multi-file merge, missing paths, zip packets, command flows."""

import datetime as dt
import json
import os
import random
import tempfile
import zipfile

import pytest
from logsieve.operators.bundle import tail_sample
from logsieve.operators.dedup import trim
from logsieve.schema import MAX_LINE_BYTES
from logsieve.sources.files import read_log_file, read_log_files, read_log_lines
from logsieve.sources.packets import Packets, is_log_member, packet_entries, packet_status
from pyspark.sql import functions as F

HARBOUR = ['info [2031-06-11 04:20:10.000 Z] Gate opened caller="quay/gate.go:7" berth=12',
           'fatal [2031-06-11 04:48:00.250 Z] Crane stalled caller="quay/crane.go:310" load="18t"']
TOWER = ['debug [2031-06-11 04:31:05.000 Z] Radar sweep caller="tower/radar.go:64" range=40',
         'info [2031-06-11 04:55:30.500 Z] Pilot boarded caller="tower/pilot.go:18" user_id="p-77"']
DEPOT = ['warn [2031-06-11 04:25:00.000 Z] Fuel below mark caller="depot/fuel.go:202" litres=900',
         'info [2031-06-11 04:40:45.000 Z] Gate opened caller="quay/gate.go:7" berth=3']
IN_TIME = ["Gate opened", "Fuel below mark", "Radar sweep", "Gate opened", "Crane stalled", "Pilot boarded"]


@pytest.fixture(scope="module")
def port():
    d = os.path.join(tempfile.mkdtemp(prefix="logsieve-test-"), "sp ace+ü")
    os.makedirs(d)
    paths = []
    for name, lines in (("harbour.log", HARBOUR), ("tower.log", TOWER), ("depot.log", DEPOT)):
        p = os.path.join(d, name)
        with open(p, "w") as fh:
            fh.write("\n".join(lines) + "\r\n")
        paths.append(p)
    return d, paths


def test_merge_by_time(spark, port):
    d, paths = port
    entries, missing = read_log_files(spark, paths)
    assert missing == [] and [r.message for r in entries.collect()] == IN_TIME
    assert [r.user for r in entries.collect() if r.message == "Pilot boarded"] == ['"p-77"']
    folder, _ = read_log_files(spark, [d])
    assert [r.message for r in folder.collect()] == IN_TIME


def test_time_is_the_input_order_of_later_steps(spark, port):
    from logsieve.plans.commands import process

    _, paths = port
    e, _ = read_log_files(spark, paths)
    assert [r.message for r in tail_sample(e, 2).collect()] == IN_TIME[-2:]
    assert [json.loads(r.json)["message"] for r in process(e, "json").collect()] == IN_TIME
    assert [r.text.split(" → ")[1].split("\n")[0] for r in process(e, "raw").collect()] == IN_TIME
    kept = {r.message: (r.duplicate_count, r.extras["berth"]) for r in trim(e).collect() if r.message == "Gate opened"}
    assert kept == {"Gate opened": (2, "12")}  # the earlier line leads


def test_scan_plan_has_no_shuffle(spark, port, capsys):
    _, paths = port
    read_log_lines(spark, paths).lines.explain()
    plan = capsys.readouterr().out
    assert "NestedLoop" not in plan and "Exchange hash" not in plan and plan.count("BroadcastHashJoin") == 1


def test_argument_order_with_escaped_paths(spark, port):
    _, paths = port
    scan = read_log_lines(spark, [paths[1], paths[0]])
    rows = scan.entries().orderBy("ord").collect()
    assert [r.message for r in rows] == ["Radar sweep", "Pilot boarded", "Gate opened", "Crane stalled"]
    assert [r.ord.f for r in rows] == [0, 0, 1, 1] and scan.rejects().count() == 0


def test_filters_over_files(spark, port):
    _, paths = port
    assert read_log_files(spark, paths, level="info")[0].count() == 3
    e, _ = read_log_files(spark, paths, start="2031-06-11 04:25:00.000", end="2031-06-11 04:48:00.250")
    assert e.count() == 4
    with pytest.raises(ValueError):
        read_log_files(spark, paths, start="2031-06-11T04:25:00")


def test_missing_paths(spark, port):
    from logsieve.plans.commands import file_entries

    d, paths = port
    nope = os.path.join(d, "nope.log")
    e, missing = read_log_files(spark, [paths[0], nope])
    assert e.count() == 2 and missing == [nope]
    with pytest.warns(UserWarning, match="nope.log"):
        file_entries(spark, [paths[0], nope])
    with pytest.raises(FileNotFoundError):
        read_log_file(spark, nope)
    with pytest.raises(ValueError):
        read_log_files(spark, [nope])


def test_member_predicate():
    assert is_log_member("logs/mattermost.log") and is_log_member("x/notifications.log")
    assert is_log_member("a/logs/other.txt") and is_log_member("a\\logs\\b.txt")
    assert is_log_member("notification_2.txt") and not is_log_member("config.json")


def test_packets(spark, port):
    d, _ = port
    p = os.path.join(d, "packet.zip")
    with zipfile.ZipFile(p, "w") as z:
        z.writestr("srv/logs/mattermost.log", "\n".join(TOWER))
        z.writestr("config.json", '{"a": 1}')
        z.writestr("srv/notifications.log", "\n".join(HARBOUR))
    rows = packet_entries(spark, p).orderBy("ord").collect()
    assert [r.message for r in rows] == ["Radar sweep", "Pilot boarded", "Gate opened", "Crane stalled"]
    assert packet_entries(spark, p, level="debug").count() == 1


def test_packet_problems_are_told(spark, port):
    d, _ = port
    p, bad = os.path.join(d, "broken.zip"), os.path.join(d, "not-a-zip.zip")
    with zipfile.ZipFile(p, "w", compression=zipfile.ZIP_STORED) as z:
        z.writestr("a/logs/good.log", "\n".join(HARBOUR))
        z.writestr("a/logs/bad.log", "\n".join(TOWER))
        z.writestr("a/logs/endless.log", "x" * (3 * MAX_LINE_BYTES) + "\n" + HARBOUR[0])
    raw = bytearray(open(p, "rb").read())
    at = raw.find(TOWER[1].encode())
    raw[at:at + 5] = b"XXXXX"  # breaks the member's checksum
    open(p, "wb").write(bytes(raw))
    open(bad, "w").write("no zip")
    rows = packet_entries(spark, p).orderBy("ord").collect()
    assert [r.message for r in rows] == ["Gate opened", "Crane stalled", "Gate opened"]
    status = {(r.packet_path.rsplit("/", 1)[1], r.member): (r.lines, r.problem)
              for r in packet_status(spark, [p, bad]).collect()}
    assert status == {
        ("broken.zip", "a/logs/good.log"): (2, None), ("broken.zip", "a/logs/endless.log"): (2, None),
        ("broken.zip", "a/logs/bad.log"): (0, "member cannot be extracted"),
        ("not-a-zip.zip", None): (0, "not a zip archive")}
    with pytest.raises(ValueError, match="not-a-zip"):
        packet_entries(spark, [p, bad])


def test_packets_as_a_table(spark):
    """Any table of (path, content); every way of compression; damage in the middle of a member."""
    import io

    rnd = random.Random(8)
    noise = ["".join(rnd.choice("abcdefghijklmnop") for _ in range(90)) for _ in range(3000)]
    methods = (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED, zipfile.ZIP_BZIP2, zipfile.ZIP_LZMA)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for k, method in enumerate(methods):
            z.writestr(f"m{k}/logs/x.log", "\n".join([*HARBOUR, *noise]), method)
        z.writestr("empty/logs/x.log", "")
        z.writestr("cut/logs/x.log", "\n".join([*HARBOUR, *noise]), zipfile.ZIP_DEFLATED)
        at = z.getinfo("cut/logs/x.log").header_offset + 40_000
    raw = bytearray(out.getvalue())
    raw[at:at + 50] = bytes(50)
    rows = [("a.zip", bytes(raw)), ("b.zip", b""), ("c.zip", None)]
    table = spark.createDataFrame(rows, "path string, content binary").repartition(3)
    opened = Packets(spark, table)
    n = 2 + len(noise)
    assert sorted(map(str, (tuple(r) for r in opened.status().collect()))) == sorted(map(str, [
        *[("a.zip", k, f"m{k}/logs/x.log", n, None) for k in range(4)], ("a.zip", 4, "empty/logs/x.log", 0, None),
        ("a.zip", 5, "cut/logs/x.log", 0, "member cannot be extracted"),
        ("b.zip", None, None, 0, "not a zip archive"), ("c.zip", None, None, 0, "not a zip archive")]))
    lines = opened.lines().orderBy("packet_path", "member_idx", "line_no").collect()
    assert [r.value for r in lines] == [*HARBOUR, *noise] * 4
    assert [r.line_no for r in lines[:n]] == list(range(n))
    assert [r.message for r in opened.entries().orderBy("ord").collect()] == ["Gate opened", "Crane stalled"] * 4


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_time_order_is_the_same_in_every_session_zone(spark, zone):
    """Around a clock change a local clock skips and repeats hours; entries do not."""
    from logsieve.functions.timestamps import epoch_micros

    times = ["2024-03-10 01:59:59.5", "2024-03-10 02:30:00", "2024-03-10 03:00:00", "2024-11-03 01:15:00.000001",
             "2024-11-03 06:30:00", "1969-12-31 23:59:59.999999", "1900-01-01 00:00:00"]
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        df = spark.createDataFrame([(t,) for t in times], "t string").select(F.col("t").cast("timestamp_ntz").alias("ts"))
        got = [r[0] for r in df.select(epoch_micros(F.col("ts"))).collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    zero = dt.datetime(1970, 1, 1)
    assert got == [(dt.datetime.fromisoformat(t) - zero) // dt.timedelta(microseconds=1) for t in times]


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_merge_order_in_another_zone(spark, tmp_path, zone):
    texts = {"a.log": ['info [2024-03-10 03:00:00.000 Z] Harbour closed for the night caller="a/b.go:1"'],
             "b.log": ['info [2024-03-10 02:30:00.000 Z] Harbour closed for the night caller="a/b.go:2"']}
    for name, lines in texts.items():
        (tmp_path / name).write_text("\n".join(lines) + "\n")
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        e, _ = read_log_files(spark, [str(tmp_path / n) for n in texts])
        assert [r.source for r in e.collect()] == ["a/b.go:2", "a/b.go:1"]
        assert [r.source for r in tail_sample(e, 1).collect()] == ["a/b.go:1"]
        assert [(r.source, r.duplicate_count) for r in trim(e).collect()] == [("a/b.go:2", 2)]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_command_flow(spark, port):
    from logsieve.plans.commands import file_entries, process

    _, paths = port
    e = file_entries(spark, paths)
    assert any(x.startswith("6 entries") for x in process(e, "analyze"))
    d = tempfile.mkdtemp(prefix="logsieve-cmd-")
    process(e, "csv", path=os.path.join(d, "out"))
    assert os.path.exists(os.path.join(d, "out", "_SUCCESS"))
    process(e, "raw", path=os.path.join(d, "raw"))
    text = [r.value for r in spark.read.text(os.path.join(d, "raw")).collect()]
    assert "Displayed 6 log entries" in text
    trimmed = process(e, "analyze", trim=True, trim_json_path=os.path.join(d, "trim"))
    assert any(x.startswith("5 entries") for x in trimmed)


def test_event_tasks_and_staged_writers_are_bounded_by_rows(spark, tmp_path, monkeypatch):
    # one row group, so one split holds all rows; some rows twice, some ids null
    from logsieve.sources import tables as tb

    rows = spark.range(0, 4000, 1, 1).selectExpr(
        "CASE WHEN id % 50 = 0 THEN NULL ELSE id div 2 END AS event_id",
        "TIMESTAMP_NTZ'2024-02-03 04:05:06' + make_dt_interval(0, 0, 0, id % 40) AS ts", "id % 9 AS user_id",
        "'view' AS event_type", "cast(id as double) AS value", "concat('{\"k\": ', id, '}') AS props")
    rows.coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    monkeypatch.setattr(tb, "TASK_EVENTS", 100)
    lines = tb.event_lines(spark, str(tmp_path))
    assert lines.rdd.getNumPartitions() >= 40
    sizes = lines.groupBy(F.spark_partition_id().alias("k")).count().agg(F.max("count"), F.sum("count")).first()
    assert sizes[0] < 300 and sizes[1] == 3920
    dealt = tb.bounded_tasks(rows, 100)
    assert dealt.exceptAll(rows).isEmpty() and rows.exceptAll(dealt).isEmpty()
    assert tb.bounded_tasks(rows.where("user_id < 0"), 100).isEmpty()
