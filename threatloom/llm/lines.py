"""Removal of lines that are boilerplate of their site."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threatloom.llm.common import WORD, unused
from threatloom.session import materialize

#: A line is boilerplate if more than this share of its host's pages contain it ...
RATIO = 0.02
#: ... and at least this many pages do.
MIN_PAGES = 5
#: Boilerplate lines that are broadcast (16 bytes each); beyond, the pages are joined by a shuffle.
BROADCAST_LINES = 200_000


def _ids(line: Column) -> tuple[Column, Column]:
    """Two independent 64-bit hashes that stand for a line."""
    return F.xxhash64(line), F.xxhash64(F.lit(1), line)


def line_frequencies(docs: DataFrame, text: str = "text", host: str = "source") -> DataFrame:
    """``host, a, b, pages, host_pages`` of every line with a word: its hashes, its pages and all pages of its host.

    A host's pages are its distinct texts, so that copies of a page don't make its lines frequent; a line counts once a
    page. Pages count in two partially aggregated steps, so neither a large host nor a line on all pages is one group.
    """
    page = F.struct(*[h.alias(n) for h, n in zip(_ids(F.col(text)), ("p", "q"))])
    lines = F.array_distinct(F.filter(F.split(F.col(text), "\n"), lambda x: x.rlike(WORD)))
    a, b = _ids(F.col("line"))
    pages = docs.where(F.col(text).isNotNull()).select(F.col(host).alias("host"), page.alias("page"), F.explode(lines).alias("line"))
    pages = pages.select("host", "page", a.alias("a"), b.alias("b")).distinct()
    found = pages.groupBy("host", "a", "b").agg(F.count("*").alias("pages"))
    texts = docs.select(F.col(host).alias("h"), page.alias("page")).distinct()
    totals = texts.groupBy("h").agg(F.count("*").alias("host_pages"))
    return found.join(totals, F.col("host").eqNullSafe(F.col("h"))).drop("h")


def with_clean_lines(docs: DataFrame, text: str = "text", host: str = "source", ratio: float = RATIO,
                     min_pages: int = MIN_PAGES, count: str = "n_dropped") -> DataFrame:
    """``docs`` with the boilerplate lines taken out of ``text``, and the number of dropped lines in ``count``.

    Lines are what newlines separate; kept ones stay as they are and in order, and so do lines without a word. Pages
    meet a short list of their host's boilerplate (each such line is on more than ``ratio`` of the pages, so a host has
    at most its lines a page over ``ratio`` of them); texts are never shuffled unless all lists together are too large
    to broadcast. NULL texts stay NULL, NULL hosts are a host of their own, repeated rows are one page and each cleaned,
    an empty table gives no rows, columns named like a helper stay as they are. A text of boilerplate only gets empty.
    """
    often = line_frequencies(docs, text, host).where(
        (F.col("pages") >= min_pages) & (F.col("pages") > ratio * F.col("host_pages")))
    h, a, b, keep = (unused(docs.columns + [count], x) for x in ("line_host", "line_a", "line_b", "line_keep"))
    lists = materialize(
        often.groupBy(F.col("host").alias(h)).agg(F.collect_list("a").alias(a), F.collect_list("b").alias(b)), "boilerplate")
    lines = lists.agg(F.coalesce(F.sum(F.size(a)), F.lit(0))).first()[0]
    if lines <= BROADCAST_LINES:
        lists = F.broadcast(lists)
    joined = docs.join(lists, docs[host].eqNullSafe(lists[h]), "left")

    def stays(line: Column) -> Column:
        x, y = _ids(line)
        return ~(F.array_contains(a, x) & F.array_contains(b, y)) | ~line.rlike(WORD)

    split = F.split(F.col(text), "\n")
    return (
        joined.withColumn(keep, F.when(F.col(a).isNotNull(), F.filter(split, stays)))
        .withColumn(count, F.coalesce(F.size(split) - F.size(keep), F.lit(0)).cast("bigint"))
        .withColumn(text, F.coalesce(F.array_join(keep, "\n"), F.col(text)))
        .select(*[c for c in docs.columns], count)
    )


def without_boilerplate(docs: DataFrame, text: str = "text", host: str = "source", n_chars: str | None = None, **options) -> DataFrame:
    """``docs`` with clean texts and their own columns; ``n_chars`` names a column that is the text's length."""
    count = unused(docs.columns, "n_dropped")
    clean = with_clean_lines(docs, text, host, count=count, **options)
    if n_chars is not None:
        clean = clean.withColumn(n_chars, F.when(F.col(count) > 0, F.length(text)).otherwise(F.col(n_chars)).cast(docs.schema[n_chars].dataType))
    return clean.select(*docs.columns)
