"""Training pipelines: vectoriser + classifier, evaluation rows, importances, persistence.

Vectors stay sparse throughout; training, scoring and metrics are distributed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    GBTClassifier,
    LogisticRegression,
    NaiveBayes,
    RandomForestClassifier,
)
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threatloom import rules
from threatloom.functions import text as tx
from threatloom.operators import features as fe
from threatloom.operators import metrics as mt
from threatloom.operators import terms as tm
from threatloom.session import materialize, scratch_path


@dataclass(frozen=True)
class Estimator:
    """Classifier settings by name.

    The size fields default to the full settings (None: 100 trees of depth 30,
    or 200 of depth 20 for the bounded forest) and can be lowered for trial runs.
    """

    name: str = "naive_bayes"
    trees: int | None = None
    depth: int | None = None
    rounds: int = 200
    iterations: int = 1000

    def build(self, n_train: int):
        common = {"featuresCol": "features", "labelCol": "label"}
        if self.name == "naive_bayes":
            return NaiveBayes(modelType="multinomial", smoothing=1.0, **common)
        if self.name == "logistic_regression":
            # C = 1.0 as a penalty per row
            return LogisticRegression(
                maxIter=self.iterations, tol=1e-4, regParam=1.0 / max(n_train, 1), elasticNetParam=0.0,
                standardization=False, **common
            )
        if self.name == "random_forest":
            return RandomForestClassifier(
                numTrees=self.trees or 100, maxDepth=self.depth or 30, seed=rules.SEED, **common
            )
        if self.name == "random_forest_bounded":
            return RandomForestClassifier(
                numTrees=self.trees or 200, maxDepth=self.depth or 20, minInstancesPerNode=2, seed=rules.SEED, **common
            )
        if self.name == "boosted_trees":
            return GBTClassifier(
                maxIter=self.rounds, maxDepth=self.depth or 6, stepSize=0.1, subsamplingRate=0.8,
                featureSubsetStrategy="0.8", seed=rules.SEED, **common
            )
        raise ValueError(f"unknown model: {self.name}")


def fit_vectorizer(train: DataFrame, key: str, terms: str, settings: tuple[int, int, float, int], out: str = "tfidf") -> PipelineModel:
    """TF-IDF vectoriser fitted on ``train``: counts x (idf + 1), unit length.

    The vocabulary comes from the distributed term statistics (ties by term);
    at most ``max_terms`` rows reach the driver.
    """
    max_terms, min_df, max_share, _ = settings
    n_docs = train.count()
    vocab = tm.vocabulary(tm.corpus_statistics(train, terms, n_docs), n_docs, max_terms, min_df, max_share)
    rows = vocab.orderBy("term").collect()  # bounded by max_terms
    if not rows:
        raise ValueError("empty vocabulary: lower min_df or raise max_share")
    counter = CountVectorizerModel.from_vocabulary([r["term"] for r in rows], terms, "__tf")
    scaler = ElementwiseProduct(
        scalingVec=Vectors.dense([r["idf"] for r in rows]), inputCol="__tf", outputCol="__scaled"
    )
    unit = Normalizer(p=2.0, inputCol="__scaled", outputCol=out)
    return PipelineModel([counter, scaler, unit])


def prepare_spam(df: DataFrame, text: str, settings: tuple[int, int, float, int], stop_words: list[str] | None = None) -> DataFrame:
    """Append ``cleaned`` (stop words dropped, stemmed when a stop list is given) and ``terms``."""
    cleaned = df.withColumns({"cleaned": tx.clean(F.col(text))})
    if stop_words:
        kept = cleaned.withColumns({"cleaned": tx.drop_stop_words(F.col("cleaned"), stop_words)})
        cleaned = tm.stem_texts(kept, "cleaned", "cleaned")
    return tm.with_ngrams(cleaned, "cleaned", settings[3])


def prepare_phishing(df: DataFrame, text: str, suffixes) -> DataFrame:
    """Append the 51 combined features and ``terms`` of the accent-free raw text."""
    plain = fe.with_combined_features(df, text, suffixes=suffixes).withColumns(
        {"__plain": tx.strip_accents(F.col(text))}
    )
    return tm.with_ngrams(plain, "__plain", tm.SMS_SETTINGS[3]).drop("__plain")


def without_summary(model):
    """A fitted classifier read back from the shared folder if it has a training summary.

    The summary holds the session, and the functions that predict hold the model: each task would be sent the session,
    which can't be serialized once it holds, say, an observation.
    """
    if not getattr(model, "hasSummary", False):
        return model
    path = scratch_path(SparkSession.active(), "classifier")
    model.write().save(path)
    return type(model).load(path)


def written_vectors(vectors: DataFrame) -> DataFrame:
    """Label and features, written: a trainer reads its input up to four times before it keeps it, and would cut,
    look up and weigh all terms each time."""
    return materialize(vectors.select("label", "features"), "vectors")


def train_spam(train: DataFrame, key: str, settings=tm.SMS_SETTINGS, estimator: Estimator = Estimator()) -> PipelineModel:
    """Vectoriser + classifier on a prepared training set (``terms``, ``label``)."""
    vectorizer = fit_vectorizer(train, key, "terms", settings, out="features")
    model = Pipeline(stages=[estimator.build(train.count())]).fit(written_vectors(vectorizer.transform(train)))
    return PipelineModel([vectorizer, PipelineModel([without_summary(m) for m in model.stages])])


def train_phishing(train: DataFrame, key: str, estimator: Estimator = Estimator("boosted_trees"),
                   use_tfidf: bool = True, fit_vectorizer_on: DataFrame | None = None) -> PipelineModel:
    """Combined features (and TF-IDF) + classifier on a prepared training set.

    ``fit_vectorizer_on`` lets single-file training fit the vectoriser on all
    rows before the split, as the single-file mode of the trainer does.
    """
    stages, inputs = [], list(fe.COMBINED_FEATURES)
    if use_tfidf:
        base = train if fit_vectorizer_on is None else fit_vectorizer_on
        stages.append(fit_vectorizer(base, key, "terms", tm.SMS_SETTINGS))
        inputs.append("tfidf")
    stages.append(VectorAssembler(inputCols=inputs, outputCol="features"))
    front = PipelineModel(stages)
    model = estimator.build(train.count()).fit(written_vectors(front.transform(train)))
    return PipelineModel([front, without_summary(model)])


def predict(model: PipelineModel, prepared: DataFrame) -> DataFrame:
    """Append prediction (INT), ham_prob and spam_prob."""
    scored = model.transform(prepared)
    p = vector_to_array("probability")
    return scored.withColumns({
        "prediction": F.col("prediction").cast("int"), "ham_prob": p[0], "spam_prob": p[1]
    })


def evaluate(predicted: DataFrame, n_name: str = "test_samples") -> DataFrame:
    """One row: sample count, accuracy, precision, recall, f1, roc_auc, tn, fp, fn, tp."""
    # scored once: three narrow columns
    slim = materialize(predicted.select("label", "prediction", F.col("spam_prob").alias("score")), "scored")
    matrix = materialize(mt.confusion(slim), "confusion")
    scores = mt.metrics_of(matrix).withColumns({"k": F.lit(1)})
    auc = mt.roc_auc(slim).withColumns({"k": F.lit(1)})
    return matrix.withColumns({"k": F.lit(1)}).join(scores, "k").join(auc, "k").select(
        (F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp")).alias(n_name),
        "accuracy", "precision", "recall", "f1", "roc_auc", "tn", "fp", "fn", "tp",
    )


def leaves(model) -> list:
    """Fitted stages of nested pipelines, in order."""
    if isinstance(model, PipelineModel):
        return [leaf for stage in model.stages for leaf in leaves(stage)]
    return [model]


def feature_names(model: PipelineModel, prepared_names: list[str] | None = None) -> list[str]:
    """Custom feature names (if assembled), then tfidf_<index>."""
    vocabulary = next((s.vocabulary for s in leaves(model) if isinstance(s, CountVectorizerModel)), [])
    custom = fe.COMBINED_FEATURES if any(isinstance(s, VectorAssembler) for s in leaves(model)) else []
    return list(custom) + [f"tfidf_{i}" for i in range(len(vocabulary))]


def feature_importance(spark: SparkSession, model: PipelineModel, top: int = 20) -> DataFrame:
    """feature, importance: tree importances or absolute coefficients (model-sized, ties by name)."""
    last = leaves(model)[-1]
    if hasattr(last, "featureImportances"):
        values = last.featureImportances.toArray()
    elif hasattr(last, "coefficients"):
        values = abs(last.coefficients.toArray())
    else:
        return spark.createDataFrame([], "feature string, importance double")
    names = feature_names(model)
    rows = [(n, float(v)) for n, v in zip(names, values, strict=True)]
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(
        F.desc("importance"), "feature"
    ).limit(top)


def model_stats(spark: SparkSession, model: PipelineModel) -> DataFrame:
    """One row: model_type, vocabulary_size."""
    stages = leaves(model)
    size = next((len(s.vocabulary) for s in stages if isinstance(s, CountVectorizerModel)), 0)
    return spark.createDataFrame([(type(stages[-1]).__name__, size)], "model_type string, vocabulary_size int")


def save_model(model: PipelineModel, path: str, stats: DataFrame | None = None) -> None:
    """Write the fitted pipeline, its feature names and (optionally) its metrics under ``path``."""
    spark = SparkSession.active()
    model.write().overwrite().save(f"{path}/model")
    names = [(i, n) for i, n in enumerate(feature_names(model))]
    spark.createDataFrame(names, "position int, name string").write.mode("overwrite").parquet(f"{path}/feature_names")
    if stats is not None:
        stats.write.mode("overwrite").json(f"{path}/stats")


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(f"{path}/model")
