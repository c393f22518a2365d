"""F5/F6 details and the K1 time format with offsets."""

import json

import pytest
from logsieve.functions.parse import parse_lines
from logsieve.operators.filters import apply_filters
from logsieve.sinks import json_object


def entries(spark, lines):
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    return parse_lines(df).where("parse_error IS NULL")


LINES = [
    'info [2025-01-01 10:00:00.000 Z] Login ok caller="auth/login.go:55" user_id=alice k=v1',
    'error [2025-01-01 11:00:00.000 +01:00] Disk full caller="disk/io.go:9" user_id=bob path=/var',
    '{"timestamp":"2025-01-01T12:00:00.5Z","level":"warn","msg":"Slow","caller":"db/q.go:1","user_id":"carol"}',
]


def test_regex_and_search(spark):
    e = entries(spark, LINES)
    got = {r.message for r in apply_filters(e, regex=r"(?P<file>io|q)\.go").collect()}
    assert got == {"Disk full", "Slow"}
    assert {r.message for r in apply_filters(e, search_term="PATH=/VAR").collect()} == {"Disk full"}
    assert {r.message for r in apply_filters(e, regex="^bob$").collect()} == {"Disk full"}
    with pytest.raises(ValueError):
        apply_filters(e, regex="(unclosed")


def test_json_export_time_and_omissions(spark):
    e = entries(spark, LINES)
    out = {r.message: json.loads(r.j) for r in e.select("message", json_object().alias("j")).collect()}
    assert out["Login ok"]["timestamp"] == "2025-01-01T10:00:00Z"
    assert out["Disk full"]["timestamp"] == "2025-01-01T11:00:00+01:00"
    assert out["Slow"]["timestamp"] == "2025-01-01T12:00:00.5Z"
    assert "log_source" not in out["Slow"] and "extras" not in out["Slow"]
    assert out["Login ok"]["extras"] == {"k": "v1"}


CASES = [  # pattern, text, found: what RE2 says
    (r"[[:digit:]]+", "digit word", False), (r"[[:digit:]]+", "word 7", True), (r"caf\b", "café", True),
    (r"\bfé", "afé", False), (r"^b$", "b\n", False), (r"a.b", "a\rb", True), (r"a.b", "a\nb", False),
    (r"(?i)STRASSE|É", "é", True), (r"[a&&b]", "&", True), (r"[^[:alpha:]]", "abc", False), (r"\s", "\x0b", False),
    (r"\pL+\d", "ж7", True), (r"\p{Greek}", "α", True), (r"a{2}", "aa", True), (r"x{,2}", "x{,2}", True),
    (r"\Qa.b\E", "a.b", True), (r"(?P<n>o|p)+?q", "opq", True), (r"[]a]", "]", True), (r"(?m)^b$", "a\nb\nc", True),
]


def test_patterns_mean_what_re2_means(spark):
    from pyspark.sql import functions as F

    from logsieve.functions.regex import java_pattern

    for pattern, text, found in CASES:
        row = spark.range(1).select(F.lit(text).rlike(java_pattern(pattern))).first()
        assert row[0] is found, (pattern, text)
    for refused in (r"a(?=b)", r"(?<!a)b", r"(a)\1", r"a++", r"(?U)a+", r"\Z", r"(?>a)", r"a{1001}", r"[[:nope:]]"):
        with pytest.raises(ValueError):
            java_pattern(refused)
