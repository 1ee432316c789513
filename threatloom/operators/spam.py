"""Spam decision on top of a spam probability column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threatloom import rules
from threatloom.functions import text as tx
from threatloom.operators import features as fe


def with_spam_result(
    df: DataFrame, text: str, probability: str, cleaned: str | None = None, threshold: float = rules.SPAM_THRESHOLD
) -> DataFrame:
    """Append is_spam, prediction, confidence, probabilities and details.

    The verdict uses ``threshold``; ``details.raw_prediction`` keeps the
    model's own argmax.  Rows without text or probability become error rows.
    """
    t, p = F.col(text), F.col(probability).cast("double")
    failed = t.isNull() | p.isNull()
    spam = ~failed & (p >= threshold)
    processed = tx.clean(t) if cleaned is None else F.col(cleaned)
    return df.withColumns({
        "is_spam": F.coalesce(spam, F.lit(False)),
        "prediction": F.when(failed, "error").when(spam, "spam").otherwise("ham"),
        "confidence": F.when(failed, None).when(spam, p).otherwise(1.0 - p),
        "probabilities": F.when(~failed, F.struct((1.0 - p).alias("ham"), p.alias("spam"))),
        "details": F.when(~failed, F.struct(
            fe.explain_features(t, tx.fold(t)).alias("features"),
            F.length(processed).alias("processed_text_length"),
            F.length(t).alias("original_text_length"),
            F.lit(threshold).alias("threshold_applied"),
            F.when(p > 0.5, "spam").otherwise("ham").alias("raw_prediction"),
        )),
        "error": F.when(t.isNull(), "text is null").when(p.isNull(), "probability is null"),
    })

