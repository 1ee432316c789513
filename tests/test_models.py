"""Training pipelines on a separable fixture: exact weights, metric floors, persistence."""

import pytest
from pyspark.sql import functions as F

from threatloom.operators import dataset as ds
from threatloom.operators import models as md
from threatloom.operators import terms as tm
from threatloom.session import materialize, scratch_path

SPAM = ("free prize claim now", "urgent verify your account", "win cash today", "click here http://bit.ly/x free gift")
HAM = ("lunch at noon tomorrow", "the report is attached", "see you at the meeting", "thanks for the help")


@pytest.fixture(scope="module")
def messages(spark):
    rows = [(i, f"{(SPAM if i % 2 else HAM)[i // 2 % 4]} note {'abcdefgh'[i % 8]}{'xyz'[i % 3]}", i % 2) for i in range(160)]
    return spark.createDataFrame(rows, "msg_id long, text string, label int")


@pytest.fixture(scope="module")
def parts(messages):
    rows = ds.holdout_split(materialize(md.prepare_spam(messages, "text", tm.SMS_SETTINGS), "spam"), "msg_id")
    return [materialize(rows.filter(F.col("split") == n).drop("split"), n) for n in ("train", "test")]


def test_weights_equal_counted_ones_and_shuffle_nothing(parts):
    train = parts[0]
    vectorizer = md.fit_vectorizer(train, "msg_id", "terms", tm.SMS_SETTINGS)
    weights = tm.tfidf(vectorizer.transform(train), vectorizer.stages[0].vocabulary, "tfidf", "msg_id")
    assert "Exchange" not in weights._jdf.queryExecution().executedPlan().toString()
    got = {(r["msg_id"], r["term"]): r["weight"] for r in weights.collect()}
    counts = tm.term_counts(train, "msg_id")
    vocab = tm.vocabulary(tm.term_statistics(counts), train.count(), *tm.SMS_SETTINGS[:3])
    raw = {(r["msg_id"], r["term"]): r["tf"] * r["idf"] for r in counts.join(vocab.drop("tf", "df"), "term").collect()}
    norm = {}
    for (k, _), w in raw.items():
        norm[k] = norm.get(k, 0.0) + w * w
    want = {(k, t): w / norm[k] ** 0.5 for (k, t), w in raw.items()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


@pytest.mark.parametrize("estimator", [
    md.Estimator("naive_bayes"), md.Estimator("logistic_regression", iterations=50),
    md.Estimator("random_forest", trees=10, depth=5),
], ids=lambda e: e.name)
def test_spam_models_separate(parts, estimator):
    train, test = parts
    row = md.evaluate(md.predict(md.train_spam(train, "msg_id", estimator=estimator), test)).first()
    assert row["accuracy"] >= 0.95 and row["roc_auc"] >= 0.95


def test_exact_naive_bayes_separates(parts):
    train, test = parts
    vectorizer = md.fit_vectorizer(train, "msg_id", "terms", tm.SMS_SETTINGS)
    terms = md.leaves(vectorizer)[0].vocabulary
    labels = train.select("msg_id", "label")
    vocab = train.sparkSession.createDataFrame([(t,) for t in terms], "term string")
    model = tm.naive_bayes(tm.tfidf(vectorizer.transform(train), terms, "tfidf", "msg_id", "label"), vocab)
    weights = tm.tfidf(vectorizer.transform(test), terms, "tfidf", "msg_id")
    out = tm.naive_bayes_scores(weights, test, tm.log_priors(labels), model, "msg_id").join(test.select("msg_id", "label"), "msg_id")
    assert out.count() == test.count() and out.filter("prediction <> label").count() == 0


def test_phishing_trees_importances_and_persistence(spark, messages):
    rows = materialize(md.prepare_phishing(messages, "text", ("com", "tk")), "phishing")
    model = md.train_phishing(rows, "msg_id", md.Estimator("boosted_trees", rounds=2, depth=3))
    path = scratch_path(spark, "model")
    md.save_model(model, path, md.model_stats(spark, model))
    before = {r["msg_id"]: r["spam_prob"] for r in md.predict(model, rows).collect()}
    after = {r["msg_id"]: r["spam_prob"] for r in md.predict(md.load_model(path), rows).collect()}
    assert before == after
    top = md.feature_importance(spark, model, 5).collect()
    assert top and top[0]["importance"] == max(r["importance"] for r in top)
    assert spark.read.parquet(f"{path}/feature_names").count() == len(md.feature_names(model))


@pytest.mark.parametrize("name", ["logistic_regression", "random_forest", "random_forest_bounded"])
def test_predictions_are_not_sent_the_session(parts, name):
    estimator = md.Estimator(name, trees=2, depth=2, iterations=5)
    model = md.leaves(md.train_spam(parts[0], "msg_id", estimator=estimator))[-1]
    assert not model.hasSummary  # it holds the session, and a predicting function holds the model


def test_reloaded_classifier_predicts_alike(parts):
    train, test = parts
    front = md.fit_vectorizer(train, "msg_id", "terms", tm.SMS_SETTINGS, out="features")
    fitted = md.Estimator("logistic_regression", iterations=20).build(train.count()).fit(front.transform(train))
    assert fitted.hasSummary
    rows = [{r["msg_id"]: r["spam_prob"] for r in md.predict(md.PipelineModel([front, m]), test).collect()} for m in (fitted, md.without_summary(fitted))]
    assert rows[0] == rows[1]
