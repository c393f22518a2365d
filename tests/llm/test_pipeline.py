"""The pipeline's stages at the smallest size."""

import corpus_pipeline
from logsieve.sources.tables import table

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, SF, "documents")
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "toxicity", "near_duplicates", "decontamination", "personal_data", "mixing"]
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == [*docs.columns, "copy_no"]
    rows = out.collect()
    assert 0 < len({r.doc_id for r in rows}) <= docs.count()
    assert len({(r.doc_id, r.copy_no) for r in rows}) == len(rows)
