"""The bounded sample: its size, its weights and its plan."""

from logsieve.llm.sampling import bounded_sample


def test_sample_is_bounded_and_weighted(spark):
    rows = [(i, "hot" if i % 10 else f"rare{i % 30}") for i in range(20_000)] + [(None, "hot")]
    labels = spark.createDataFrame(rows, "doc_id long, kind string")
    got = bounded_sample(labels, "kind", 50).collect()
    size = {}
    for _, kind in rows:
        size[kind] = size.get(kind, 0) + 1
    by = {}
    for r in got:
        by.setdefault(r.kind, []).append(r)
    assert {k: len(v) for k, v in by.items()} == dict.fromkeys(size, 50)
    assert all(r.group_n == size[r.kind] for r in got)
    again = bounded_sample(labels.repartition(7), "kind", 50).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    assert bounded_sample(labels.limit(0), "kind", 50).count() == 0


def test_labels_are_cut_before_any_shuffle(spark, tmp_path, capsys):
    """One exchange by group, above the threshold; the sizes come to the scan."""
    path = str(tmp_path / "labels")
    spark.range(50_000).selectExpr("id AS doc_id", "id % 2 AS toxic").write.parquet(path)
    bounded_sample(spark.read.parquet(path), "toxic", 50).explain()
    plan = capsys.readouterr().out.split("Initial Plan")[0]
    lines = plan.splitlines()
    exchange = next(i for i, x in enumerate(lines) if "Exchange hashpartitioning(toxic" in x)
    cut = next(i for i, x in enumerate(lines) if "Filter" in x and "group_n" in x or "BroadcastHashJoin" in x)
    assert exchange < cut and plan.count("Exchange hashpartitioning") == 1 and "SortMergeJoin" not in plan
