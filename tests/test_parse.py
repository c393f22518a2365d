"""Golden lines (plain text, JSON, timestamps, rejects)."""

import datetime as dt

from logsieve.functions.parse import parse_lines
from logsieve.functions.text import extras_text
from pyspark.sql import functions as F


def parse(spark, lines):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, value string")
    out = parse_lines(df).withColumn("x", extras_text(F.col("extras")))
    return {r["i"]: r for r in out.collect()}


def test_plain_golden(spark):
    r = parse(spark, [
        'trace [2029-11-03 08:15:09.404 Z] Parcel weighed twice caller="scale/belt.go:51" lane=4 '
        'tag=/p/q7/zz parcel=9kq2wmx user_id=clerk-31 grams=1250',
        'notice [2029-11-03 08:15:09.404 Z] Shift begun user_id=kim site=10.9.8.7',
        "a line of prose without any bracket",
        "",
    ])
    a = r[0]
    assert a.parse_error is None and a.level == "trace" and a.message == "Parcel weighed twice"
    assert a.source == "scale/belt.go:51" and a.user == "clerk-31"
    assert a.x == "grams=1250, lane=4, parcel=9kq2wmx, tag=/p/q7/zz"
    assert a.ts == dt.datetime(2029, 11, 3, 8, 15, 9, 404000)
    b = r[1]
    assert b.message == "Shift begun" and b.user == "kim" and b.source == ""
    assert b.x == "site=10.9.8.7"
    assert r[2].parse_error == "invalid_format" and r[3].parse_error == "invalid_format"


def test_plain_known_differences(spark):
    r = parse(spark, [
        'info [2029-11-03 08:15:09.404 Z] x printed="2028-05-06 07:08:09.100 +02:00" a=1 a=2 user_id="u1"',
        "2028-05-06T07:08:09.100Z [NOTE] belt.restart user_id=kim site=10.9.8.7",
    ])
    # quoted values with spaces are cut at the first space; last duplicate wins;
    # user_id keeps its quotes
    assert r[0].x == 'a=2, printed="2028-05-06' and r[0].user == '"u1"'
    # the bracket holds the level, so the time does not parse
    assert r[1].parse_error == "bad_timestamp"


GOOD = '"timestamp":"2029-11-03T08:15:09.404Z","level":"note","msg":"m"'


def test_json_golden(spark):
    r = parse(spark, [
        '{"timestamp":"2029-11-03T08:15:09.404Z","level":"trace","msg":"Parcel weighed",'
        '"caller":"scale/belt.go:51","user_id":"KIM","lane":"4","tag":"/p/q7",'
        '"parcel":"9k","fault":"none","grams":"1250"}',
        '{"timestamp":"2029-11-04 06:30:00.125 +01:00","level":"note","msg":"Tariff",'
        '"open":false,"zones":{"north":300000,"east":true},"n":1e6}',
        '{"timestamp":"2029-11-03T08:15:09.404Z","level":"note","msg":"read \\"twice\\""}',
        '{"timestamp":"2029-11-03T08:15:09.404Z","level":"note","msg":"cut off he',
        "{}",
        '{"timestamp":"2029-11-03T08:15:09.404Z","level":"note","msg":"x","logSource":"notifications",'
        '"ackId":"a1","type":"message","status":"Sent"}',
        '{"timestamp":"2029-11-03T08:15:09.404Z","level":5,"msg":"x"}',
        '{"timestamp":"2029-11-03T08:15:09.404Z","level":"note","msg":"x"}]',
        "  {\"timestamp\":\" 2029-11-03T08:15:09.404Z \",\"Level\":\"warn\",\"msg\":\"odd case\"}  ",
    ])
    a = r[0]
    assert a.level == "trace" and a.source == "scale/belt.go:51" and a.user == "KIM"
    assert a.x == "fault=none, grams=1250, lane=4, parcel=9k, tag=/p/q7"
    b = r[1]
    assert b.ts == dt.datetime(2029, 11, 4, 5, 30, 0, 125000)
    assert b.wall_ts.hour == 6 and b.tz_offset == "+01:00"
    assert b.x == 'n=1000000, open=false, zones={"east":true,"north":300000}'
    assert r[2].message == 'read "twice"' and r[2].x == ""
    assert r[3].parse_error == "invalid_json"
    assert r[4].parse_error == "bad_timestamp"
    n = r[5]
    assert (n.log_source, n.ack_id, n.type, n.status, n.x) == ("notifications", "a1", "message", "Sent", "")
    assert r[6].parse_error == "json_field_type"
    assert r[7].parse_error == "invalid_json"
    odd = r[8]
    assert odd.parse_error is None and odd.level == "warn" and odd.x == "Level=warn"


def test_json_repeated_keys_and_numbers(spark):
    r = parse(spark, [
        "{%s,\"msg\":\"first\",\"msg\":\"second\",\"a\":1,\"a\":2}" % GOOD,
        '{%s,"o":{"a":1,"a":2}}' % GOOD,
        '{%s,"a":1e-7,"b":0.0000001,"c":1.5e10,"d":1e21,"e":{"n":1e6,"s":"x,1.0,"},"f":0.10,"g":-2.5,'
        '"h":12345678901234567890,"i":[1.0,2e-9],"j":0.00001234,"k":100.0}' % GOOD,
        '{%s,"level":1,"level":"x"}' % GOOD,
        '{%s,"MSG":"odd","msg":null}' % GOOD,
    ])
    assert r[0].message == "second" and r[0].x == "a=2"
    assert r[1].x == 'o={"a":2}'
    assert r[2].x == ('a=1e-7, b=1e-7, c=15000000000, d=1e+21, e={"n":1000000,"s":"x,1.0,"}, f=0.1, g=-2.5, '
                      "h=12345678901234567890, i=[1,2e-9], j=0.00001234, k=100")
    assert r[3].parse_error == "json_field_type" and r[4].message == "odd"


def test_timestamp_shapes(spark):
    r = parse(spark, [
        "info [2025/01/02 03:04:05] a",
        "info [2025-01-02 03:04:05.123 EST] a",
        "info [2025-01-02 3:04:05.1234567 -05:30] a",
        "info [2025-02-30 03:04:05.123 Z] a",
        "info [2025-01-02T03:04:05+01:00] a",
        "info [2025-01-02 03:04:05.1234 Z] a",
        "info [2025-01-02 03:04:05 +01:00] a",
        "info [2025] a",
        "info [2025-01-02T03:04:05+99:99] a",
        "info [2025-01-02T03:04:05+24:60] a",
    ])
    assert r[0].ts == dt.datetime(2025, 1, 2, 3, 4, 5)
    assert r[1].ts == dt.datetime(2025, 1, 2, 3, 4, 5, 123000)
    assert r[2].ts == dt.datetime(2025, 1, 2, 8, 34, 5, 123456) and r[2].wall_ts.hour == 3
    assert r[3].parse_error == "bad_timestamp"
    assert r[4].ts == dt.datetime(2025, 1, 2, 2, 4, 5)
    assert r[5].parse_error == "bad_timestamp"  # 'Z' shape needs exactly 3 digits
    assert r[6].ts == dt.datetime(2025, 1, 2, 2, 4, 5)
    assert r[7].parse_error == "bad_timestamp"
    assert r[8].parse_error == "bad_timestamp"  # an offset has hours up to 24, minutes up to 60
    assert r[9].ts == dt.datetime(2025, 1, 1, 2, 4, 5)


def test_line_too_long_is_quarantined(spark):
    long_line = "info [2025-01-02 03:04:05.123 Z] " + "x" * (512 * 1024)
    r = parse(spark, [long_line, "info [2025-01-02 03:04:05.123 Z] ok"])
    assert r[0].parse_error == "line_too_long" and r[1].parse_error is None
