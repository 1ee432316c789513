"""Mixing of sources to target weights along a curriculum."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threatloom.llm.common import unused, word_count
from threatloom.session import materialize

#: Integrated weights of the sources in code-point order, repeating.
WEIGHTS = (1, 2, 3)
#: Weight schedules, repeating: factors of the weight at the start and the end of training, linear between; mean 1.
RAMPS = ((1.5, 0.5), (1.0, 1.0), (0.5, 1.5))
MAX_REPEATS = 3
#: Rows of a hash bucket that one task sorts, on average.
BUCKET_ROWS = 20_000


def source_targets(sizes: DataFrame, weights=WEIGHTS, ramps=RAMPS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """``source, source_size, target, ramp_start, ramp_end`` from ``sizes(source, size)``, one row per source.

    A source's share is the integral of its schedule over training, ``weight * (start + end) / 2``. Shares take all
    words; a target stops at ``max_repeats`` times the source's size and the excess goes to the others by weight. This
    level is found in one pass: with the sources in the order of cap over weight, it is the first one that all later
    sources can take. Empty sources get target 0.
    """
    def cycle(values):
        return F.element_at(F.array(*[F.lit(float(x)) for x in values]), (F.col("i") % len(values) + 1).cast("int"))

    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = (
        sizes.withColumn("i", F.row_number().over(by_name) - 1)
        .withColumn("ramp_start", cycle([a for a, _ in ramps])).withColumn("ramp_end", cycle([b for _, b in ramps]))
        .withColumn("w", cycle(weights) * (F.col("ramp_start") + F.col("ramp_end")) / 2)
        .withColumn("cap", F.col("size") * max_repeats)
    )
    by_cap = Window.orderBy(F.col("cap") / F.col("w"), "i")
    all_rows = Window.partitionBy()
    level = (F.sum("size").over(all_rows) - F.col("caps_before")) / F.col("w_from")
    return (
        w.withColumn("caps_before", F.sum("cap").over(by_cap.rowsBetween(Window.unboundedPreceding, -1)))
        .withColumn("caps_before", F.coalesce("caps_before", F.lit(0)))
        .withColumn("w_from", F.sum("w").over(by_cap.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level", level)
        .withColumn("level", F.max(F.when(F.col("level") <= F.col("cap") / F.col("w"), F.col("level"))).over(all_rows))
        .select("source", F.col("size").alias("source_size"),
                F.coalesce(F.least(F.col("cap").cast("double"), F.col("w") * F.col("level")), F.lit(0.0)).alias("target"),
                "ramp_start", "ramp_end")
    )


def _plan(docs: DataFrame, key: str, text: str, source: str, weights, ramps, max_repeats: int) -> DataFrame:
    """Per row its size, its source's figures, ``start`` (words before it in its source's stream) and ``taken``."""
    rows = materialize(docs.select(
        F.col(key).alias("key"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"),
        F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")).alias("h"),
        F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("row_hash"),
    ), "mix-rows")
    totals = materialize(rows.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")), "mix-sources")
    most = totals.agg(F.max("n")).first()[0] or 0
    digits = max(1, math.ceil(math.log(max(most, 1) / BUCKET_ROWS + 1, 16)))
    rows = rows.withColumn("bucket", F.substring("h", 1, digits))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy("source", "bucket").agg(F.sum("size").alias("b")).select(
        F.col("source").alias("s"), F.col("bucket").alias("o"), F.coalesce(F.sum("b").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("source", "bucket").orderBy("h", "key", "size", "row_hash").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    summed = rows.withColumn("upto", F.sum("size").over(inside)).join(
        offsets, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("o")))
    targets = source_targets(totals.drop("n"), weights, ramps, max_repeats).withColumnRenamed("source", "t")
    passes = F.expr("cast(floor(target) as bigint) div greatest(source_size, 1L)")
    words = F.floor("target").cast("bigint")
    return (
        summed.join(targets, F.col("source").eqNullSafe(F.col("t")))
        .withColumn("start", F.col("offset") + F.col("upto") - F.col("size"))
        .withColumn("passes", passes).withColumn("rest", words - F.col("passes") * F.col("source_size"))
        .withColumn("taken", F.col("passes") * F.col("size")
                    + F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("start"))))
    )


def _position(start):
    """Inverse of the integrated schedule at the share of the target's words that comes before ``start``."""
    a, b, u = F.col("ramp_start"), F.col("ramp_end"), start / F.floor("target")
    return F.when(a == b, u).otherwise((F.sqrt(a * a + (b * b - a * a) * u) - a) / (b - a))


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights=WEIGHTS, ramps=RAMPS,
        max_repeats: int = MAX_REPEATS) -> DataFrame:
    """What a mix of the sources takes of every row: ``key, source, size, source_size, target, taken, position``.

    A source is a stream in the order of md5(key), repeated as often as its target needs; ``taken`` counts a row's words
    in the stream's first ``floor(target)`` words, so that every source meets its target to the word (the last row of a
    source can be cut). ``position`` in [0, 1) is the time of a row's first word: its cumulative demand put through the
    inverse of the source's integrated schedule; NULL where nothing is taken. Running sums go through (source, hash
    bucket) totals, so a source with a third of all rows is many small sorts.

    NULL and empty texts have size 0 and take nothing; NULL is a source of its own, the last one; an empty table gives
    no rows; repeated rows count each (a tie in key, size and text has no order, but the same rows as results); columns
    other than the three named don't matter.
    """
    return _plan(docs, key, text, source, weights, ramps, max_repeats).select(
        "key", "source", "size", "source_size", "target", "taken",
        F.when(F.col("taken") > 0, _position(F.col("start"))).alias("position"))


def mixed_rows(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights=WEIGHTS,
               ramps=RAMPS, max_repeats: int = MAX_REPEATS, n_chars: str | None = None) -> DataFrame:
    """The mix itself: the input's columns, a row for each time that a row is taken, range-sorted by training position.

    A row taken for 2.5 times its words comes twice whole and once cut after half its words, each at the position of its
    pass through the source; rows of which nothing is taken are left out. Rows alike in key, source and text share
    evenly what they are given. ``n_chars`` names a column that is the text's length. Columns named like a helper stay as they are; for NULLs and empty tables see ``mix``.
    """
    k, s, h, n, i, p, c = (unused(docs.columns, "mix_" + x) for x in ("key", "source", "hash", "size", "start", "position", "copy"))
    t, q, a, b, g, z = (unused(docs.columns, "mix_" + x) for x in ("taken", "twins", "a", "b", "goal", "all"))
    plan = (
        _plan(docs, key, text, source, weights, ramps, max_repeats).where("taken > 0")
        .groupBy(F.col("key").alias(k), F.col("source").alias(s), F.col("row_hash").alias(h))
        .agg(F.sum("taken").alias(t), F.count("*").alias(q), F.min("start").alias(i), F.max("size").alias(n),
             F.first("ramp_start").alias(a), F.first("ramp_end").alias(b), F.first("target").alias(g),
             F.first("source_size").alias(z))
        .withColumn(t, F.expr(f"{t} div {q}"))
    )
    own = unused(docs.columns + plan.columns, "mix_own")
    wide = docs.withColumn(own, F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")))
    joined = wide.join(plan, wide[key].eqNullSafe(plan[k]) & wide[source].eqNullSafe(plan[s]) & (wide[own] == plan[h]))
    left = F.least(F.col(n), F.col(t) - (F.col(c) - 1) * F.col(n))
    lead = F.when(F.col(text).rlike(r"^[\x20\x09-\x0D]"), 1).otherwise(0)
    pieces = F.split(F.col(text), r"(?<=[\x20\x09-\x0D])(?=[^\x20\x09-\x0D])")
    cut = F.array_join(F.slice(pieces, F.lit(1), (left + lead).cast("int")), "")
    u = (F.col(i) + (F.col(c) - 1) * F.col(z)) / F.floor(g)
    at = F.when(F.col(a) == F.col(b), u).otherwise(
        (F.sqrt(F.col(a) * F.col(a) + (F.col(b) * F.col(b) - F.col(a) * F.col(a)) * u) - F.col(a)) / (F.col(b) - F.col(a)))
    mixed = (
        joined.withColumn(c, F.explode(F.expr(f"sequence(1L, cast(ceil({t} / {n}) as bigint))")))
        .withColumn(p, at)
        .withColumn(text, F.when(left < F.col(n), cut).otherwise(F.col(text)))
    )
    if n_chars is not None:
        length = F.when(left < F.col(n), F.length(text)).otherwise(F.col(n_chars))
        mixed = mixed.withColumn(n_chars, length.cast(docs.schema[n_chars].dataType))
    return mixed.sort(p, k, c).select(*docs.columns)
