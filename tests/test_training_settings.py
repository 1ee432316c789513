"""The training queries use the full settings of their estimators."""

import pytest

from threatloom.operators import models as md
from threatloom.plans import learn


class Reached(Exception):
    pass


@pytest.mark.parametrize("query, name", [
    ("ml_gbt", "boosted_trees"), ("ml_train_stats", "random_forest_bounded"), ("ml_pipeline_splits", "logistic_regression"),
    ("ml_pipeline_single_file", "logistic_regression"), ("top_feature_importance", "logistic_regression"),
])
def test_full_settings(monkeypatch, query, name):
    def train(rows, key, estimator, **options):
        raise Reached(estimator)

    monkeypatch.setattr(learn, "_phishing_parts", lambda *_: dict.fromkeys(("train", "val", "test")))
    monkeypatch.setattr(learn.ds, "union_all", lambda parts: None)
    monkeypatch.setattr(learn.md, "train_phishing", train)
    with pytest.raises(Reached) as found:
        getattr(learn, query)(None, None)
    assert found.value.args == (md.Estimator(name),)
