"""Training input is written once and slim."""

import pytest

from threatloom.operators import models as md
from threatloom.operators import terms as tm
from threatloom.plans import learn
from threatloom.session import materialize

WORDS = ("free prize claim", "lunch at noon", "verify account now", "report attached here")


class Reached(Exception):
    pass


class Trainer:
    def fit(self, rows):
        raise Reached(rows)


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    docs = [(i, f"{WORDS[i % 4]} {'abcdefgh'[i % 8] * 3}") for i in range(60)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    talk = [(i, t, WORDS[(i + t) % 4]) for i in range(30) for t in range(2)]
    spark.createDataFrame(talk, "conv_id long, turn int, text string").write.parquet(f"{folder}/conversations.parquet")
    return folder


@pytest.mark.parametrize("train", [md.train_spam, md.train_phishing])
def test_trainers_read_written_vectors(spark, monkeypatch, train):
    rows = [(i, WORDS[i % 4], i % 2) for i in range(40)]
    prepared = md.prepare_phishing(spark.createDataFrame(rows, "k long, text string, label int"), "text", ("com",))
    monkeypatch.setattr(md.Estimator, "build", lambda self, n: Trainer())
    monkeypatch.setattr(md, "Pipeline", lambda stages: stages[0])
    with pytest.raises(Reached) as found:
        train(prepared, "k", estimator=md.Estimator())
    got = found.value.args[0]
    assert "UDF" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted(got.columns) == ["features", "label"] and got.count() == 40


@pytest.mark.parametrize("query", ["ml_pipeline_unified", "ml_pipeline_dialogue"])
def test_no_table_of_ngrams_is_written(spark, monkeypatch, tables, query):
    written = []

    def kept(df, name):
        written.append(df.dtypes)
        return materialize(df, name)

    monkeypatch.setattr(learn, "materialize", kept)
    row = getattr(learn, query)(spark, tables).first()
    assert row["test_samples"] > 0
    assert len(written) == 1 and not any(kind.startswith("array") for _, kind in written[0])


def test_held_out_parts_are_the_prepared_rows(spark, monkeypatch, tables):
    words = learn.fx.messages(spark, tables).select("msg_id", "text", "label")
    want = {(r["msg_id"], r["label"], tuple(r["terms"])) for r in md.prepare_spam(words, "text", tm.DIALOGUE_SETTINGS, learn.STOP_WORDS).collect()}
    for kept in ("terms", "cleaned"):
        parts = learn._held_out(words, "msg_id", "text", tm.DIALOGUE_SETTINGS, "held", kept)
        got = [{(r["msg_id"], r["label"], tuple(r["terms"])) for r in p.collect()} for p in parts]
        assert got[0] | got[1] == want and not got[0] & got[1] and len(got[1]) == 12
