import corpus_pipeline
from test_exact_dedup import brute as equal_texts
from test_jaccard_join import brute as near_texts

from changeloom.llm import quality
from changeloom.llm.pieces import DEFAULT_MODEL, Vocabulary
from changeloom.llm.sentencepiece_codec import decode

SF = "/root/testdata/sf0.001"


def test_stages_against_plain_python(spark, small):
    docs, (q, e, j, m, t) = small, [f for _, f in corpus_pipeline.STAGES]
    model = quality.fit_quality(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    good = {r.doc_id for r in quality.score_quality(docs, model).where("kept").collect()}
    one = q(spark, docs, SF).cache()
    assert one.columns == docs.columns and {r.doc_id for r in one.collect()} == good and 0 < len(good) < docs.count()
    rows = [(r.doc_id, r.text) for r in one.collect()]
    two = e(spark, one, SF).cache()
    assert {r.doc_id for r in two.collect()} == {keep for keep, _ in equal_texts(rows).values()} and two.columns == docs.columns
    rows = [(r.doc_id, r.text) for r in two.collect()]
    three = j(spark, two, SF).cache()
    assert sorted(r.doc_id for r in three.collect()) == sorted({c for c, _, _ in near_texts(rows).values()}) and three.columns == docs.columns
    four = m(spark, three, SF).cache()
    assert four.columns == docs.columns and {r.doc_id for r in four.collect()} <= {r.doc_id for r in three.collect()}
    strings = Vocabulary.load(DEFAULT_MODEL).strings
    assert sorted(decode(r.ids, strings) for r in t(spark, four, SF).collect()) == sorted(r.text for r in four.collect())


def test_run_is_the_stages(spark):
    rows = lambda df: sorted((r.doc_id, r.ids) for r in df.collect())
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, f in corpus_pipeline.STAGES:
        docs = f(spark, docs, SF)
    assert rows(corpus_pipeline.run(spark, SF)) == rows(docs)


def test_stages_take_odd_tables(spark, make_docs):
    docs = make_docs([(1, None), (2, ""), (3, "a b c d e f"), (3, "a b c d e f"), (None, "word " * 50)], ("_key", "tag"))
    for _, f in corpus_pipeline.STAGES:
        docs = f(spark, docs, SF)
    assert docs.count() >= 1
    empty = make_docs([])
    for _, f in corpus_pipeline.STAGES:
        empty = f(spark, empty, SF)
    assert empty.count() == 0
