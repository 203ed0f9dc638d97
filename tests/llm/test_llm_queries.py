import duckdb
import pytest

import corpus_pipeline
from changeloom.llm import queries

SF = "/root/testdata/sf0.001"


def plain(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_against_duckdb(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    frame = queries.QUERIES[name](spark, SF)
    cols = sorted(frame.columns)
    got = sorted((tuple(map(plain, r)) for r in frame.select(*cols).collect()), key=repr)
    names = ", ".join(f'"{c}"' for c in cols)
    assert got == sorted((tuple(map(plain, r)) for r in con.sql(f"SELECT {names} FROM ({queries.ORACLE_SQL[name]})").fetchall()), key=repr)


def test_every_operator_has_a_query():
    numbers = [int(n[2:].split("_")[0]) for n in queries.QUERIES]
    assert sorted(numbers) == list(range(1, 14))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "exact_dedup", "jaccard_join", "mix_sources", "sentencepiece"]


@pytest.mark.parametrize("name", ["op1_secret_structure", "op3_quality_cotraining", "op5_sentencepiece_unigram", "op8_token_counts", "op9_media_columns", "op10_mix_sources"])
def test_one_row_for_each_document(spark, small, name):
    out = queries.QUERIES[name](spark, SF)
    assert sorted(r.doc_id for r in out.select("doc_id").collect()) == sorted(r.doc_id for r in small.select("doc_id").collect())


def test_neighbours_against_all_rows(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM '{SF}/embeddings.parquet'")
    want = con.sql("SELECT a.vec_id, b.vec_id FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0 QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY list_inner_product(a.v, b.v) DESC, b.vec_id) <= 20").fetchall()
    got = [(r.query_id, r.vec_id) for r in queries.QUERIES["op12_nearest_multi_index"](spark, SF).collect()]
    assert len(got) == len(want) and len({*got} & {*want}) >= 0.9 * len(want)
