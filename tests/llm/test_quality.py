import numpy as np

from changeloom.llm import quality

LABELS = "doc_id long, quality int, toxic int"


def corpus(n=600):
    random = np.random.default_rng(1)
    rows, labels = [], []
    for i in range(n):
        good = i % 3 != 0
        words = random.choice(["the", "of", "and", "river", "stone", "house", "green", "water"], 40)
        text = " ".join(words) if good else " ".join(w + "$$%%" for w in words[:10]) + " spam spam spam spam"
        rows.append((i, text, "en", f"src{i % 4}", len(text)))
        if i % 2 == 0:
            labels.append((i, int(good), 0))
    return rows, labels


def test_held_out_accuracy_and_filter(spark, make_docs):
    rows, labels = corpus()
    docs = make_docs(rows, ("kept", "p_good"))
    model = quality.fit_quality(docs, spark.createDataFrame(labels, LABELS))
    assert model.text is not None and sum(model.exchanged) > 0
    out = quality.score_quality(docs, model).collect()
    assert len(out) == len(rows)
    right = [r.kept == (r.doc_id % 3 != 0) for r in out if r.doc_id % 2]
    assert np.mean(right) > 0.97
    kept = quality.keep_good(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(r.kept for r in out)


def test_the_pool_is_all_other_rows(spark, make_docs):
    """Every document that is not fitted and that a view is sure of is exchanged, none is left out, and sums are those of plain Python."""
    rows, labels = corpus()
    rows += [(None, rows[0][1], "en", "src0", 5)] * 3
    docs, labels = make_docs(rows), spark.createDataFrame(labels, LABELS)
    model = quality.fit_quality(docs, labels, max_labelled=80)
    views = docs.select("doc_id", "text", *quality.COLUMNS).mapInArrow(quality._views, quality.FEATURE_SCHEMA)
    fitted = {r.doc_id for r in docs.where("doc_id IS NOT NULL").join(labels, "doc_id").orderBy("doc_id").limit(80).collect()}
    to_text, to_meta = quality.what_is_sure(views, model, fitted, 0.6)
    cells, sums = {}, {}
    for i, text, lang, source, n_chars in rows:
        if i in fitted:
            continue
        units, buckets = quality.text_features(text.encode()), quality.meta_buckets(lang, source, n_chars)
        by_text, by_meta, _ = (float(p[0]) for p in model.chances(quality.text_matrix(units[None]), quality.meta_matrix(np.array([buckets]))))
        for p, table, key, add in ((by_text, cells, buckets, 1), (by_meta, sums, buckets[1], np.array([1, *units], np.int64))):
            if p >= 0.6 or p <= 1 - 0.6:
                table[int(p >= 0.6), key] = table.get((int(p >= 0.6), key), 0) + add
    assert sum(to_meta.n) == sum(cells.values()) > 300 and sorted(to_meta.n) == sorted(cells.values())
    assert [(int(y), int(n)) for y, n in zip(to_text.y, to_text.n, strict=True)] == [(v, int(t[0])) for (v, _), t in sorted(sums.items())] and len(sums) > 0
    for got, (_, total) in zip(to_text.x, sorted(sums.items()), strict=True):
        assert np.allclose(got, total[1:] / total[0] / quality.UNIT, atol=1e-6)


def test_scores_against_plain_python(spark, small):
    """Each score from the weights by plain sums, and the decisions on all labels, fitted or not."""
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    model = quality.fit_quality(small, labels, max_labelled=120)
    out = {r.doc_id: r for r in quality.score_quality(small, model).collect()}
    for r in small.collect():
        units, where = quality.text_features((r.text or "").encode()), quality.meta_buckets(r.lang, r.source, r.n_chars)
        text = sum(float(w) * int(u) / quality.UNIT for w, u in zip(model.text.weights, units, strict=True)) + model.text.bias
        meta = sum(float(model.meta.weights[64 * i + b]) for i, b in enumerate(where)) + model.meta.bias
        odds = [m.scale[0] * x + m.scale[1] for m, x in ((model.text, text), (model.meta, meta))]
        want = 1 / (1 + np.exp(-np.clip(sum(odds) - model.prior, -40, 40)))
        assert abs(out[r.doc_id].p_good - want) < 1e-3 and out[r.doc_id].kept == (out[r.doc_id].p_good >= 0.5)
    order = sorted(r.doc_id for r in labels.collect())
    assert np.mean([out[r.doc_id].kept == (r.quality > 0) for r in labels.collect() if r.doc_id in order and r.doc_id in out]) > 0.9


def test_labels_held_out_are_told_as_well_with_rounds_as_without(spark):
    """A third of the labels is in no fit at all; labels are exchanged both ways, and the rounds cost no accuracy."""
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    out = labels.where("doc_id % 3 = 0 AND quality IS NOT NULL")
    right = {}
    for rounds in (0, 3):
        model = quality.fit_quality(docs, labels.where("doc_id % 3 > 0"), rounds=rounds)
        scores = quality.score_quality(docs, model).join(out, "doc_id").collect()
        assert len(scores) > 50
        right[rounds] = np.mean([r.kept == (r.quality > 0) for r in scores])
    assert min(model.exchanged) > 0 and right[3] >= right[0] and right[3] > 0.95


def test_repeated_ids_give_the_same_fit_in_any_order(spark, make_docs):
    rows, labels = corpus(300)
    rows += [(i, text + " other", lang, "else", n) for i, text, lang, _, n in rows[:60]]
    labels = spark.createDataFrame(labels, LABELS)
    a, b = (quality.fit_quality(make_docs(r), labels) for r in (rows, rows[::-1]))
    assert np.array_equal(a.text.weights, b.text.weights) and np.array_equal(a.meta.weights, b.meta.weights)


def test_calibration_and_combination():
    random = np.random.default_rng(0)
    y = random.integers(0, 2, 4000)
    x = (y + random.normal(0, 1.2, 4000)).astype(np.float32)[:, None]
    model = quality.Logistic.fit(x[:2000], y[:2000].astype(np.float32)).calibrated(x[2000:3000], y[2000:3000])
    p = quality.sigmoid(model.odds(x[3000:]))
    assert abs(p.mean() - y[3000:].mean()) < 0.05


def test_odd_rows(spark, make_docs):
    rows, labels = corpus(300)
    odd = [(1000, None, None, None, None), (1001, "", "en", "src0", 0), (None, "x " * 200_000, "en", "src0", None), (1002, "é", "xx", "new", -5), (1002, "é", "xx", "new", -5)]
    labels += [(0, None, 0), (None, 1, 0), (77777, 1, 0), (2, 0, 0)]
    docs = make_docs(rows + odd)
    out = quality.score_quality(docs, quality.fit_quality(docs, spark.createDataFrame(labels, LABELS)))
    assert out.count() == len(rows) + len(odd) and out.where("p_good IS NULL OR isnan(p_good)").count() == 0


def test_without_labels_or_rows(spark, make_docs):
    docs, none = make_docs([(1, "a b"), (2, "c d")]), spark.createDataFrame([], LABELS)
    assert quality.keep_good(docs, quality.fit_quality(docs, none)).count() == 2
    one_class = spark.createDataFrame([(1, 0, 0), (2, 0, 0)], LABELS)
    assert quality.keep_good(docs, quality.fit_quality(docs, one_class)).count() == 0
    empty = make_docs([])
    assert quality.score_quality(empty, quality.fit_quality(empty, none)).count() == 0
