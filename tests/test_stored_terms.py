"""Term counts are stored in columns, and only texts are shuffled to make them."""
from shelfsense.operators import ml
from shelfsense.operators import similarity as sim
from shelfsense.session import stored


def test_terms_are_made_where_their_document_is(spark):
    df = spark.createDataFrame([(1, "red fox red"), (1, "red fox"), (None, "blue fox"), (2, None)], "id long, t string")
    tf = sim.term_counts(df, "id", "t", 2, None)
    p = tf._jdf.queryExecution().executedPlan().toString()
    assert p.count("Exchange") == 1 and p.index("HashAggregate") < p.index("Generate") < p.index("Exchange")
    assert sorted(map(tuple, tf.collect()), key=str) == sorted([(1, "red", 3), (1, "fox", 2), (1, "red fox", 2), (1, "fox red", 1),
                                                                (None, "blue", 1), (None, "fox", 1), (None, "blue fox", 1)], key=str)


def test_weights_are_stored_as_columns(spark):
    df = spark.createDataFrame([(1, "red fox"), (2, "red dog"), (None, "dog fox")], "id long, t string")
    w, _ = sim.tfidf(df, "id", "t", stopwords=None)
    files = stored(w).inputFiles()
    assert files and all(f.endswith(".parquet") for f in files) and any("/stored-" in f for f in w.inputFiles())
    s = stored(w)
    assert s.schema.names == w.schema.names and sorted(map(str, s.collect())) == sorted(map(str, w.collect()))
    assert stored(w.where("false")).count() == 0


def test_folds_share_the_term_counts(spark, monkeypatch):
    """The stages of a fold's own pipeline are the IDF and the estimator."""
    seen = []
    fit = ml.CrossValidator.fit
    monkeypatch.setattr(ml.CrossValidator, "fit", lambda self, df: seen.append([type(s).__name__ for s in self.getEstimator().getStages()]) or fit(self, df))
    rows = [(f"{'good fine' if i % 2 else 'bad poor'} word{i % 5}", str(i % 2)) for i in range(60)]
    got = ml.tune(spark.createDataFrame(rows, "text string, label string"), "text", "label", folds=2, grid_c=(1.0,)).collect()
    assert [s[0] for s in seen] == ["IDF", "IDF"] and all(len(s) == 2 for s in seen)
    assert [r["family"] for r in got] == ["logistic_regression", "linear_svm"] and all(r["weighted_f1"] == 1.0 for r in got)
