"""The D5 pair table against the gate on all pairs of small fixtures."""

import random

from greedy_reference import lev, source_similar
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from logsieve.operators.source_pairs import source_pairs


def brute(sources):
    names = sorted({s.lower() for s in sources if s}, key=lambda s: s.encode())
    return sorted((a, b, lev(a.encode(), b.encode())) for i, a in enumerate(names) for b in names[i + 1:]
                  if source_similar(a, b))


def found(spark, sources):
    df = spark.createDataFrame([(s,) for s in sources], "source string")
    return sorted(tuple(r) for r in source_pairs(df).collect())


def edited(rnd, s, n):
    for _ in range(n):
        k = rnd.randrange(len(s) + 1)
        s = rnd.choice([s[:k] + rnd.choice("abé/.") + s[k:], s[:k] + s[k + 1:], s[:k] + "x" + s[k + 1:]])
    return s


def test_edited_sources(spark):
    rnd = random.Random(6)
    base = ["app/web/handlers.go:187", "db/conn.go", "x", "ab", "naïve/straße.go:1", "a" * 40, "api/v4/users/login.go:33"]
    sources = [None, "", "X", *base]
    for s in base:
        sources += [edited(rnd, s, rnd.randrange(1, 1 + max(2, len(s) // 3))) for _ in range(25)]
    got = found(spark, sources)
    assert got == brute(sources) and len(got) > 200


def test_nothing(spark):
    assert found(spark, []) == [] and found(spark, ["", None, "one"]) == []


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="ab:é", min_size=0, max_size=14), min_size=2, max_size=40))
def test_any_sources(spark, sources):
    assert found(spark, sources) == brute(sources)
