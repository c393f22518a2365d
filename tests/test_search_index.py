"""Skipping files by trigram filters: the same rows, fewer files."""

import glob
import os

from logsieve.operators.filters import apply_filters
from logsieve.operators.search_index import build_index, candidate_files, search
from logsieve.sources.tables import event_entries
from sample_paths import SF_SMALL
from pyspark.sql import functions as F


def test_search_reads_candidate_files_only(spark, tmp_path):
    path = str(tmp_path / "entries")
    e = event_entries(spark, SF_SMALL)
    for k, word in enumerate(("Zebra crossing", "quiet harbour", "ünïcode Straße")):
        part = e.where(f"ord.p % 3 = {k}").withColumn(
            "message", F.concat(F.col("message"), F.lit(" "), F.lit(word))).coalesce(1)
        part.write.mode("append").parquet(path)
    table = spark.read.parquet(path)
    index = build_index(table)
    assert index.select("file").distinct().count() == 3
    for term in ("ZEBRA", "harbour", "STRASSE", "straße", "step 1", "K=4", "xy", "", "no such text", "handler.go:3"):
        want = sorted(r.line_id for r in apply_filters(table, search_term=term).select("line_id").collect())
        assert sorted(r.line_id for r in search(table, index, term).select("line_id").collect()) == want, term
    assert candidate_files(index, "zebra").count() == 1 and candidate_files(index, "no such text").count() == 0
    # the files that are skipped are not even opened
    kept = candidate_files(index, "zebra").first().file
    for f in glob.glob(os.path.join(path, "*.parquet")):
        if os.path.basename(f) != os.path.basename(kept):
            open(f, "wb").write(b"damaged")
    assert search(table, index, "zebra").count() == e.where("ord.p % 3 = 0").count()


def test_bitmaps_are_made_of_distinct_bits(spark, tmp_path, monkeypatch):
    """The bitmaps' aggregate sorts its input in a task: it gets each bit of a file once."""
    from logsieve.operators import search_index

    rows = [(f"common words {i % 3}", "a.go:1", {"k": "v"}) for i in range(3000)]
    spark.createDataFrame(rows, "message string, source string, extras map<string,string>").coalesce(1).write.parquet(
        str(tmp_path / "t"))
    made = []
    monkeypatch.setattr(search_index, "written", lambda df, name: made.append(df) or df)
    index = search_index.build_index(spark.read.parquet(str(tmp_path / "t")))
    plan = made[0]._jdf.queryExecution().optimizedPlan()
    fed = spark.read.parquet(str(tmp_path / "t"))
    assert index.count() > 0 and fed.count() == 3000
    # the bitmaps' aggregate stands on one that has the file and the bit as keys
    text = plan.toString()
    top, below = text.index("bitmap_construct_agg"), text.rindex("Aggregate [file")
    assert below > top and "bit#" in text[below:text.index("\n", below)].split("]")[0]
