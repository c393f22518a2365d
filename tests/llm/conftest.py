import pytest

from logsieve.session import local_session

#: Extra columns whose names clash with columns the operators use inside.
CLASH = ("size", "row", "key", "copies", "g", "c", "sub", "root", "label", "score", "rule", "host")


@pytest.fixture(scope="session")
def spark():
    return local_session("*", 8)


@pytest.fixture()
def docs(spark):
    """documents from (doc_id, text[, lang, source]) rows, with clashing columns."""
    def make(rows):
        rows = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", *["x"] * len(CLASH)) for r in rows]
        return spark.createDataFrame(
            rows, "doc_id long, text string, lang string, source string, " + ", ".join(f"{c} string" for c in CLASH))
    return make
