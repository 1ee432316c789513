"""Queries over term statistics, TF-IDF, classifiers and training pipelines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threatloom import rules
from threatloom.functions import text as tx
from threatloom.operators import dataset as ds
from threatloom.operators import models as md
from threatloom.operators import phishing as ph
from threatloom.operators import spam as sp
from threatloom.operators import terms as tm
from threatloom.plans import fixtures as fx
from threatloom.plans.fixtures import with_views
from threatloom.plans.registry import registry
from threatloom.plans import sqltext as sq
from threatloom.plans.detect import FULL_SQL, flat_verdict
from threatloom.plans.texts import CLEAN_SQL, STEMS_SQL, STOP_WORDS
from threatloom.session import materialize, scratch_path
from threatloom.sources import readers as rd

QUERIES, ORACLES, query = registry()


# ------------------------------------------------------------------ terms
def _processed_sql(key: str, clean: str = CLEAN_SQL) -> str:
    """cleaned, then processed: key, label, cleaned without stop words and with stems."""
    stops = ", ".join(f"'{w}'" for w in STOP_WORDS)
    return clean + f""",
pieces AS (SELECT {key}, label, unnest(string_split(cleaned, ' ')) AS word, generate_subscripts(string_split(cleaned, ' '), 1) AS i FROM cleaned),
words AS (SELECT DISTINCT word FROM pieces),
{STEMS_SQL},
processed AS (SELECT {key}, any_value(label) AS label, coalesce(string_agg(stem, ' ' ORDER BY i) FILTER (word NOT IN ({stops})), '') AS cleaned
  FROM pieces JOIN stems USING (word) GROUP BY {key})"""


def _terms_sql(source: str, key: str, longest: int) -> str:
    """docs: key, label, terms -> tf: key, term, tf."""
    grams = "t"
    for n in range(2, longest + 1):
        piece = " || ' ' || ".join(f"t[i + {k}]" if k else "t[i]" for k in range(n))
        grams = f"list_concat({grams}, list_transform(range(1, len(t) - {n - 2}), lambda i: {piece}))"
    return rf"""toks AS (SELECT {key} AS k, label, regexp_extract_all(cleaned, '\b\w\w+\b') AS t FROM {source}),
tf AS (SELECT k, term, count(*) AS tf FROM (SELECT k, unnest({grams}) AS term FROM toks) GROUP BY ALL),
stats AS (SELECT term, sum(tf)::BIGINT AS tf, count(*) AS df FROM tf GROUP BY term)"""


def _vocab_sql(source: str, settings) -> str:
    size, low, share, _ = settings
    return f"""vocab AS (SELECT term, tf, df, ln((n + 1) / (df + 1)) + 1 AS idf FROM (
    SELECT stats.*, (SELECT count(*) FROM {source})::DOUBLE AS n FROM stats)
  WHERE df >= {low} AND df <= n * {share}::DOUBLE ORDER BY stats_tf DESC, term LIMIT {size})""".replace("stats_tf", "tf")


WEIGHTS_SQL = """raw AS (SELECT k, term, tf.tf * idf AS w FROM tf JOIN vocab USING (term)),
weights AS (SELECT k, term, w / sqrt(sum(w * w) OVER (PARTITION BY k)) AS weight FROM raw)"""
_SPAM_SQL = _processed_sql("msg_id") + ",\n" + _terms_sql("processed", "msg_id", 2)


def _spam_terms(spark: SparkSession, folder: str, settings=tm.SMS_SETTINGS) -> DataFrame:
    """Key, label and terms of the messages, stop words dropped and stemmed."""
    m = fx.messages(spark, folder).select("msg_id", "text", "label")
    return md.prepare_spam(m, "text", settings, STOP_WORDS).select("msg_id", "label", "terms")


def _spam(spark: SparkSession, folder: str) -> DataFrame:
    """The same, written once for several passes."""
    return materialize(_spam_terms(spark, folder), "spam")


@query(with_views(_SPAM_SQL + " SELECT term, tf, df FROM stats", "messages"))
def agg_term_df_tf(spark: SparkSession, folder: str) -> DataFrame:
    """Corpus and document frequency of every 1-2-gram of stems."""
    return tm.term_statistics(tm.term_counts(_spam_terms(spark, folder), "msg_id"))


def _vocabulary(prepared: DataFrame, key: str, settings) -> DataFrame:
    size, low, share, _ = settings
    n_docs = prepared.count()
    return tm.vocabulary(tm.corpus_statistics(prepared, "terms", n_docs), n_docs, size, low, share)


@query(with_views(_SPAM_SQL + ",\n" + _vocab_sql("processed", tm.SMS_SETTINGS)
                  + " SELECT term, tf, df, round(idf, 9) AS idf FROM vocab", "messages"))
def top_vocabulary(spark: SparkSession, folder: str) -> DataFrame:
    """Top terms by corpus frequency within the document-frequency bounds."""
    vocab = _vocabulary(_spam(spark, folder), "msg_id", tm.SMS_SETTINGS)
    return vocab.select("term", "tf", "df", F.round("idf", 9).alias("idf"))


def _weights(prepared: DataFrame, key: str, settings, *carried: str) -> tuple[DataFrame, list[str]]:
    """Unit-length TF-IDF entries of prepared rows, and the vocabulary."""
    model = md.fit_vectorizer(prepared, key, "terms", settings)
    terms = md.leaves(model)[0].vocabulary
    return tm.tfidf(model.transform(prepared), terms, "tfidf", key, *carried), terms


@query(with_views(_SPAM_SQL + ",\n" + _vocab_sql("processed", tm.SMS_SETTINGS) + ",\n" + WEIGHTS_SQL
                  + " SELECT k AS msg_id, term, round(weight, 9) AS weight FROM weights", "messages"))
def ml_tfidf_weights(spark: SparkSession, folder: str) -> DataFrame:
    """Unit-length TF-IDF weights of the messages (1-2-grams of stems, 3,000 terms)."""
    weights, _ = _weights(_spam(spark, folder), "msg_id", tm.SMS_SETTINGS)
    return weights.select("msg_id", "term", F.round("weight", 9).alias("weight"))


_CLEAN_DIALOGUE = CLEAN_SQL.replace("cleaned AS (SELECT msg_id, label", "cleaned AS (SELECT talk_id, label").replace(
    "lower(text)", "lower(dialogue)").replace("FROM messages", "FROM dialogues")


@query(with_views(_processed_sql("talk_id", _CLEAN_DIALOGUE) + ",\n" + _terms_sql("processed", "talk_id", 3) + ",\n" + _vocab_sql("processed", tm.DIALOGUE_SETTINGS) + ",\n" + WEIGHTS_SQL
                  + " SELECT k AS talk_id, term, round(weight, 9) AS weight FROM weights", "dialogues"))
def ml_tfidf_dialogue(spark: SparkSession, folder: str) -> DataFrame:
    """TF-IDF weights of the dialogues (1-3-grams of stems, 5,000 terms)."""
    d = md.prepare_spam(fx.dialogue_rows(spark, folder), "dialogue", tm.DIALOGUE_SETTINGS, STOP_WORDS)
    weights, _ = _weights(materialize(d.select("talk_id", "terms"), "dialogues"), "talk_id", tm.DIALOGUE_SETTINGS)
    return weights.select("talk_id", "term", F.round("weight", 9).alias("weight"))


_NB_SQL = _SPAM_SQL + ",\n" + _vocab_sql("processed", tm.SMS_SETTINGS) + ",\n" + WEIGHTS_SQL + """,
sums AS (SELECT term, sum(weight) FILTER (label = 0) AS w0, sum(weight) FILTER (label = 1) AS w1 FROM weights JOIN toks USING (k) GROUP BY term),
lp AS (SELECT term, ln((coalesce(w0, 0) + 1) / sum(coalesce(w0, 0) + 1) OVER ()) AS lp0, ln((coalesce(w1, 0) + 1) / sum(coalesce(w1, 0) + 1) OVER ()) AS lp1
  FROM vocab LEFT JOIN sums USING (term)),
prior AS (SELECT ln((count(*) - sum(label))::DOUBLE / count(*)) AS p0, ln(sum(label)::DOUBLE / count(*)) AS p1 FROM toks),
s AS (SELECT k, sum(weight * (lp1 - lp0)) AS gain FROM weights JOIN lp USING (term) GROUP BY k),
f AS (SELECT toks.k AS msg_id, coalesce(gain, 0) + p1 - p0 AS margin FROM prior, toks LEFT JOIN s USING (k)),
nb AS (SELECT msg_id, round(1 / (1 + exp(-margin)), 6) AS spam_prob, (margin > 0)::INT AS prediction FROM f)"""


def _naive_bayes(spark: SparkSession, folder: str) -> DataFrame:
    """msg_id, spam_prob (6 digits), prediction of every message by the exact model of all messages."""
    prepared = _spam(spark, folder)
    weights, terms = _weights(prepared, "msg_id", tm.SMS_SETTINGS, "label")
    weights = materialize(weights, "weights")
    vocab = spark.createDataFrame([(t,) for t in terms], "term string")  # bounded by max_terms
    labels = prepared.select("msg_id", "label")
    likelihoods = materialize(tm.naive_bayes(weights, vocab), "likelihoods")
    out = tm.naive_bayes_scores(weights, labels, tm.log_priors(labels), likelihoods, "msg_id")
    return out.withColumns({"spam_prob": F.round("spam_prob", 6)})


@query(with_views(_NB_SQL + " SELECT * FROM nb", "messages"))
def ml_naive_bayes_sql(spark: SparkSession, folder: str) -> DataFrame:
    """Exact multinomial naive Bayes on TF-IDF weights, as grouped sums and logs."""
    return _naive_bayes(spark, folder)


@query(with_views(_NB_SQL + """ SELECT msg_id, spam_prob >= 0.75 AS is_spam, CASE WHEN spam_prob >= 0.75 THEN 'spam' ELSE 'ham' END AS prediction,
  round(CASE WHEN spam_prob >= 0.75 THEN spam_prob ELSE 1 - spam_prob END, 6) AS confidence FROM nb""", "messages"))
def det_spam_model(spark: SparkSession, folder: str) -> DataFrame:
    """Spam decision of every message by a trained model: its probability and the 0.75 rule."""
    scored = fx.messages(spark, folder).select("msg_id", "text").join(_naive_bayes(spark, folder).select("msg_id", "spam_prob"), "msg_id")
    return sp.with_spam_result(scored, "text", "spam_prob").select("msg_id", "is_spam", "prediction", F.round("confidence", 6).alias("confidence"))


_MODEL_SQL = "(SELECT nb.spam_prob FROM nb WHERE nb.msg_id = j.msg_id)"


@query(with_views(_NB_SQL + ",\n" + sq.prepared("messages") + ",\n" + sq.detector(ml=_MODEL_SQL) + " " + FULL_SQL, "messages"))
def det_phishing_model(spark: SparkSession, folder: str) -> DataFrame:
    """Full phishing verdict with a trained model's probability as the model part of the ensemble."""
    scored = fx.messages(spark, folder).select("msg_id", "text").join(_naive_bayes(spark, folder).select("msg_id", "spam_prob"), "msg_id")
    return flat_verdict(ph.with_phishing_result(scored, "text", ml=F.col("spam_prob"), suffixes=fx.DETECTOR_SUFFIXES), "msg_id")


# ------------------------------------------------------------------ training
def _trained_sql(part: str, settings=tm.SMS_SETTINGS) -> str:
    """After toks and tf: vocabulary (vocab) and weights of all rows (weights), fitted on the ``train`` rows of ``part``."""
    size, low, share, _ = settings
    return f"""{part},
counts AS (SELECT term, sum(tf) AS tf, count(*) AS df FROM tf JOIN held USING (k) WHERE part = 'train' GROUP BY term),
vocab AS (SELECT term, ln((n + 1) / (df + 1)) + 1 AS idf FROM (
    SELECT *, (SELECT count(*) FROM held WHERE part = 'train')::DOUBLE AS n FROM counts)
  WHERE df >= {low} AND df <= n * {share}::DOUBLE ORDER BY tf DESC, term LIMIT {size}),
{WEIGHTS_SQL}"""


_HELD_SQL = """held AS (SELECT msg_id AS k, label, CASE WHEN row_number() OVER (PARTITION BY label ORDER BY md5('42|' || msg_id))
  <= ceil(count(*) OVER (PARTITION BY label) * 0.2::DOUBLE) THEN 'test' ELSE 'train' END AS part FROM processed)"""
_FITTED_SQL = _SPAM_SQL + ",\n" + _trained_sql(_HELD_SQL)
# with the smoothed class prior of the library's estimator
_PREDICT_SQL = _FITTED_SQL + """,
sums AS (SELECT term, sum(weight) FILTER (label = 0) AS w0, sum(weight) FILTER (label = 1) AS w1
  FROM weights JOIN held USING (k) WHERE part = 'train' GROUP BY term),
lp AS (SELECT term, ln((coalesce(w1, 0) + 1) / sum(coalesce(w1, 0) + 1) OVER ()) - ln((coalesce(w0, 0) + 1) / sum(coalesce(w0, 0) + 1) OVER ()) AS gain
  FROM vocab LEFT JOIN sums USING (term)),
prior AS (SELECT ln(sum(label) + 1.0) - ln(count(*) - sum(label) + 1.0) AS p FROM held WHERE part = 'train'),
s AS (SELECT k, sum(weight * gain) AS gain FROM weights JOIN lp USING (term) GROUP BY k),
f AS (SELECT k AS msg_id, label, coalesce(gain, 0) + p AS margin FROM prior, held LEFT JOIN s USING (k) WHERE part = 'test')"""


def _held_out(rows: DataFrame, key: str, text: str, settings, name: str, kept: str = "terms") -> tuple[DataFrame, DataFrame]:
    """80/20 holdout of ``rows``: key, label and terms of the train and the test part.

    The split is found on slim rows, and ``kept`` is written once, with it. A table of 1-3-grams holds each word six
    times: with ``cleaned`` only the stemmed words are written, and n-grams are cut where they are read.
    """
    split = md.prepare_spam(ds.holdout_split(rows, key), text, settings, STOP_WORDS)
    written = materialize(split.select(key, "label", kept, "split"), name)
    if kept != "terms":
        written = tm.with_ngrams(written, kept, settings[3])
    return tuple(written.filter(F.col("split") == n).select(key, "label", "terms") for n in ("train", "test"))


def _spam_parts(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """80/20 holdout of the prepared messages."""
    return _held_out(fx.messages(spark, folder).select("msg_id", "text", "label"), "msg_id", "text", tm.SMS_SETTINGS, "holdout")


def _phishing_parts(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """train / val / test of the messages, split on slim rows; features and terms are written once, without the text."""
    m = fx.messages(spark, folder).select(F.col("msg_id").alias("key"), "text", "label")
    rows = md.prepare_phishing(ds.stratified_split(m, "key"), "text", fx.DETECTOR_SUFFIXES)
    split = materialize(rows.drop("text"), "phishing")
    return {n: split.filter(F.col("split") == n).drop("split") for n in ("train", "val", "test")}


def _spam_metrics(spark: SparkSession, folder: str, estimator: md.Estimator) -> DataFrame:
    train, test = _spam_parts(spark, folder)
    return md.evaluate(md.predict(md.train_spam(train, "msg_id", estimator=estimator), test))


@query()
def ml_naive_bayes(spark: SparkSession, folder: str) -> DataFrame:
    """Naive Bayes on the 80/20 holdout: metrics row."""
    return _spam_metrics(spark, folder, md.Estimator("naive_bayes"))


@query()
def ml_logistic_regression(spark: SparkSession, folder: str) -> DataFrame:
    return _spam_metrics(spark, folder, md.Estimator("logistic_regression"))


@query()
def ml_random_forest(spark: SparkSession, folder: str) -> DataFrame:
    return _spam_metrics(spark, folder, md.Estimator("random_forest"))


@query(with_views(_PREDICT_SQL + """ SELECT msg_id, label, (margin > 0)::INT AS prediction, round(1 / (1 + exp(margin)), 6) AS ham_prob,
  round(1 / (1 + exp(-margin)), 6) AS spam_prob FROM f""", "messages"))
def ml_predict(spark: SparkSession, folder: str) -> DataFrame:
    """Class and both probabilities for every message of the test part."""
    train, test = _spam_parts(spark, folder)
    return md.predict(md.train_spam(train, "msg_id"), test).select(
        "msg_id", "label", "prediction", F.round("ham_prob", 6).alias("ham_prob"), F.round("spam_prob", 6).alias("spam_prob"))


@query()
def ml_evaluate(spark: SparkSession, folder: str) -> DataFrame:
    """Evaluation of a saved and reloaded model on the test part."""
    train, test = _spam_parts(spark, folder)
    path = scratch_path(spark, "model")
    md.save_model(md.train_spam(train, "msg_id", estimator=md.Estimator("logistic_regression")), path)
    return md.evaluate(md.predict(md.load_model(path), test))


@query(with_views(_FITTED_SQL + " SELECT 'NaiveBayesModel' AS model_type, count(*)::INT AS vocabulary_size FROM vocab", "messages"))
def agg_model_stats(spark: SparkSession, folder: str) -> DataFrame:
    train, _ = _spam_parts(spark, folder)
    return md.model_stats(spark, md.train_spam(train, "msg_id"))


_RAW_TERMS_SQL = r"""toks AS (SELECT msg_id AS k, label, regexp_extract_all(strip_accents(lower(text)), '[\p{L}\p{N}_]{2,}') AS t FROM messages),
tf AS (SELECT k, term, count(*) AS tf FROM (SELECT k, unnest(list_concat(t, list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]))) AS term FROM toks) GROUP BY ALL),
"""
_TRAIN_SQL = """held AS (SELECT msg_id AS k, label, CASE WHEN row_number() OVER (PARTITION BY label ORDER BY md5('42|' || msg_id)) - 1
  < trunc(count(*) OVER (PARTITION BY label) * 0.7::DOUBLE) THEN 'train' ELSE 'other' END AS part FROM messages)"""


@query(with_views(_RAW_TERMS_SQL + _trained_sql(_TRAIN_SQL) + """
SELECT k AS key, (51 + (SELECT count(*) FROM vocab))::INT AS size, count(term)::INT AS n_terms
  FROM held LEFT JOIN weights USING (k) WHERE part = 'train' GROUP BY k""", "messages"))
def ml_assembled_features(spark: SparkSession, folder: str) -> DataFrame:
    """51 custom features and TF-IDF side by side as one sparse vector: its size and its TF-IDF entries."""
    from pyspark.ml import PipelineModel
    from pyspark.ml.feature import VectorAssembler

    from threatloom.operators.features import COMBINED_FEATURES

    train = _phishing_parts(spark, folder)["train"]
    front = PipelineModel([
        md.fit_vectorizer(train, "key", "terms", tm.SMS_SETTINGS),
        VectorAssembler(inputCols=[*COMBINED_FEATURES, "tfidf"], outputCol="features"),
    ])
    wide, terms = F.unwrap_udt("features"), F.unwrap_udt("tfidf")
    # the assembler stores a vector densely where that is smaller: size is then the length of its values
    size = F.coalesce(wide["size"], F.size(wide["values"]))
    return front.transform(train).select("key", size.alias("size"), F.size(terms["indices"]).alias("n_terms"))


@query()
def ml_gbt(spark: SparkSession, folder: str) -> DataFrame:
    """Boosted trees on combined features and TF-IDF: metrics on the test split."""
    parts = _phishing_parts(spark, folder)
    return md.evaluate(md.predict(md.train_phishing(parts["train"], "key", md.Estimator("boosted_trees")), parts["test"]))


@query()
def ml_train_stats(spark: SparkSession, folder: str) -> DataFrame:
    """Training statistics: sample counts and validation metrics."""
    parts = _phishing_parts(spark, folder)
    model = md.train_phishing(parts["train"], "key", md.Estimator("random_forest_bounded"))
    n = parts["train"].count()
    return md.evaluate(md.predict(model, parts["val"]), "val_samples").withColumns({
        "model_type": F.lit("random_forest"), "train_samples": F.lit(n)
    })


@query()
def ml_pipeline_splits(spark: SparkSession, folder: str) -> DataFrame:
    """Training from given splits: fit on train, metrics on val and test."""
    parts = _phishing_parts(spark, folder)
    model = md.train_phishing(parts["train"], "key", md.Estimator("logistic_regression"))
    rows = [md.evaluate(md.predict(model, parts[n]), "samples").withColumns({"split": F.lit(n)}) for n in ("val", "test")]
    return ds.union_all(rows)


@query()
def ml_pipeline_unified(spark: SparkSession, folder: str) -> DataFrame:
    """One classifier on messages and dialogues together (1-3-grams, 5,000 terms)."""
    sms = fx.messages(spark, folder).select(F.concat(F.lit("m"), "msg_id").alias("key"), F.col("text").alias("message"), "label")
    talk = fx.dialogue_rows(spark, folder).select(F.col("talk_id").alias("key"), F.col("dialogue").alias("message"), "label")
    corpus = rd.combined_corpus(sms, talk)
    train, test = _held_out(corpus, "key", "message", tm.DIALOGUE_SETTINGS, "unified", "cleaned")
    model = md.train_spam(train, "key", tm.DIALOGUE_SETTINGS)
    return md.evaluate(md.predict(model, test))


@query()
def top_feature_importance(spark: SparkSession, folder: str) -> DataFrame:
    """Top 20 features by absolute coefficient."""
    parts = _phishing_parts(spark, folder)
    model = md.train_phishing(parts["train"], "key", md.Estimator("logistic_regression"))
    return md.feature_importance(spark, model)


@query()
def ml_pipeline_dialogue(spark: SparkSession, folder: str) -> DataFrame:
    """Classifier on dialogues alone (1-3-grams of stems, 5,000 terms)."""
    talk = fx.dialogue_rows(spark, folder).select(F.col("talk_id").alias("key"), "dialogue", "label")
    train, test = _held_out(talk, "key", "dialogue", tm.DIALOGUE_SETTINGS, "dialogues", "cleaned")
    return md.evaluate(md.predict(md.train_spam(train, "key", tm.DIALOGUE_SETTINGS), test))


@query()
def ml_pipeline_single_file(spark: SparkSession, folder: str) -> DataFrame:
    """Training from one file: the vectoriser is fitted on all rows before the split."""
    parts = _phishing_parts(spark, folder)
    every = ds.union_all(parts.values())
    model = md.train_phishing(parts["train"], "key", md.Estimator("logistic_regression"), fit_vectorizer_on=every)
    return md.evaluate(md.predict(model, parts["test"]))
