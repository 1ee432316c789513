"""Fill-in-the-middle: documents cut into prefix, middle and suffix, and put together in another order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What is never cut: a line with its end, or the last line without one.
UNIT = r"[^\n]*\n|[^\n]+"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Percent of the documents that are transformed, and of these, in the form that puts the suffix first.
RATE, SPM_RATE = 100, 50
SEED = 7


def _draw(key: Column, seed: int, i: int) -> Column:
    """The i-th 8-digit group, from 1, of the key's hash."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digest, 8 * i - 7, 8), 16, 10).cast("bigint")


def restore(output: Column, form: Column) -> Column:
    """The text that a transformed document was made from."""
    def between(left: str, right: str | None) -> Column:
        at = F.locate(left, output) + len(left)
        return F.substring(output, at, F.length(output) if right is None else F.locate(right, output) - at)

    psm = F.concat(between(PREFIX, SUFFIX), between(MIDDLE, None), between(SUFFIX, MIDDLE))
    spm = F.concat(between(PREFIX, MIDDLE), between(MIDDLE, None), between(SUFFIX, PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def with_infill(docs: DataFrame, key: str = "doc_id", text: str = "text", unit: str = UNIT, rate: int = RATE, spm_rate: int = SPM_RATE,
                seed: int = SEED) -> DataFrame:
    """``docs`` with ``infill``: a struct of ``n, form, prefix_chars, middle_chars, output``.

    ``regexp_count`` gives a text's units; two hashes of the key draw the cuts a <= b among them. A pattern of the row's
    own counts, ``(unit){a}``, ``(unit){b - a}`` and the rest, matches the whole text once, and the replacement puts its
    three groups in the order of the form. The counted groups are possessive: the matcher steps from unit to unit and
    never goes back, so a match takes linear time and no stack, whatever the number of units.

    Empty and NULL texts, texts that hold a marker and those that ``rate`` leaves out are plain: the text as it is, NULL
    lengths. A NULL key draws like an empty one; rows are independent and repeated rows come out alike; an empty table
    gives no rows; a column called ``infill`` is replaced, all others stay.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    n = F.regexp_count(whole, F.lit(unit)).cast("bigint")
    h = [_draw(F.col(key), seed, i) for i in (1, 2, 3, 4)]
    a, b = F.least(h[0] % (n + 1), h[1] % (n + 1)), F.greatest(h[0] % (n + 1), h[1] % (n + 1))
    held = F.lit(False)
    for marker in (PREFIX, SUFFIX, MIDDLE):
        held = held | F.contains(whole, F.lit(marker))
    form = F.when((whole == "") | held | (h[2] % 100 >= rate), "plain").when(h[3] % 100 < spm_rate, "spm").otherwise("psm")
    pattern = F.concat(F.lit(rf"(?s)\A((?:{unit}){{"), a.cast("string"), F.lit(rf"}}+)((?:{unit}){{"), (b - a).cast("string"), F.lit(r"}+)(.*+)\z"))
    order = F.when(form == "psm", f"{PREFIX}$1{SUFFIX}$3{MIDDLE}$2").otherwise(f"{SUFFIX}$3{PREFIX}$1{MIDDLE}$2")
    output = F.when(form == "plain", whole).otherwise(F.regexp_replace(whole, pattern, order))
    out = F.struct(n.alias("n"), form.alias("form"), output.alias("output"))
    rows = docs.withColumn("infill", out)
    made, kind = F.col("infill.output"), F.col("infill.form")
    to = F.when(kind == "psm", F.locate(SUFFIX, made)).when(kind == "spm", F.locate(MIDDLE, made))
    start = F.when(kind == "psm", F.lit(1)).otherwise(F.locate(PREFIX, made)) + len(PREFIX)
    middle = F.when(kind != "plain", F.length(made) - F.locate(MIDDLE, made) - len(MIDDLE) + 1)
    return rows.withColumn("infill", F.struct(
        "infill.n", "infill.form", (to - start).cast("bigint").alias("prefix_chars"), middle.cast("bigint").alias("middle_chars"), "infill.output"))
