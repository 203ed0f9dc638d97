import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Rows of (doc_id, text) or of all columns as documents; extra: names of further, clashing columns."""

    def make(rows, extra=()):
        full = [(r[0], r[1], *(r[2:] or ("en", "src0", None if r[1] is None else len(r[1])))) for r in rows]
        schema = DOCS + "".join(f", `{x}` string" for x in extra)
        return spark.createDataFrame([(*r, *("x" for _ in extra)) for r in full], schema)

    return make


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")
