"""Term statistics, TF-IDF, exact naive Bayes in SQL form and vocabulary stemming."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threatloom.functions import text as tx

# Vectoriser settings, (max terms, min df, max df share, longest n-gram)
SMS_SETTINGS = (3000, 2, 0.8, 2)
DIALOGUE_SETTINGS = (5000, 2, 0.85, 3)


def with_ngrams(df: DataFrame, cleaned: str, longest: int, out: str = "terms") -> DataFrame:
    """Append the array of 1..n-grams over tokens of two or more word characters."""
    return (
        df.withColumns({"__tok": tx.model_tokens(F.col(cleaned))})
        .withColumns({out: tx.ngrams(F.col("__tok"), 1, longest)})
        .drop("__tok")
    )


def term_counts(df: DataFrame, key: str, terms: str = "terms") -> DataFrame:
    """key, term, tf.  Counted inside the row: sort the array, keep run starts - no shuffle."""
    # No filter on the computed array: predicate pushdown would copy the whole
    # n-gram expression below it.  Rows without terms vanish in ``inline``.
    staged = df.select(key, F.sort_array(terms).alias("__s"))
    n = F.size("__s")
    starts = F.filter(
        F.when(n > 0, F.sequence(F.lit(1), n)),
        lambda i: (i == 1) | (F.element_at("__s", i) != F.element_at("__s", F.greatest(i - 1, F.lit(1)))),
    )
    runs = staged.withColumns({"__b": starts})
    entries = F.transform(
        "__b",
        lambda i, k: F.struct(
            F.element_at("__s", i).alias("term"),
            (F.coalesce(F.get("__b", k + 1), n + 1) - i).cast("long").alias("tf"),
        ),
    )
    return runs.select(key, F.inline(entries))


def term_statistics(counts: DataFrame) -> DataFrame:
    """term, tf, df.  Each (row, term) pair occurs once, so df is a plain count; map-side combined."""
    return counts.groupBy("term").agg(F.sum("tf").alias("tf"), F.count("*").alias("df"))


#: Rows whose terms one task adds up.
TASK_ROWS = 5_000


def corpus_statistics(df: DataFrame, terms: str, n_docs: int) -> DataFrame:
    """term, tf, df of the ``n_docs`` rows: ``term_statistics(term_counts(df, key, terms))``, counted part by part.

    A part of an Arrow batch codes its terms and counts codes, so that only its distinct terms leave the task, once each.
    They go straight to the shuffle: a task holds no table of all its terms, most of which occur once in a corpus. The
    tasks behind the shuffle grow in number with the rows, not in size.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _parts(batch.column(0)):
                coded = part.flatten().dictionary_encode(null_encoding="encode")
                if not len(coded):
                    continue
                codes, n = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), len(coded.dictionary)
                size = pc.fill_null(pc.list_value_length(part), 0).to_numpy(zero_copy_only=False)
                pairs = np.sort(np.repeat(np.arange(len(part)), size) * n + codes)
                firsts = pairs[np.concatenate([[True], pairs[1:] != pairs[:-1]])]
                yield pa.RecordBatch.from_arrays([
                    coded.dictionary, pa.array(np.bincount(codes, minlength=n).astype(np.int64)),
                    pa.array(np.bincount(firsts % n, minlength=n).astype(np.int64)),
                ], names=["term", "tf", "df"])

    counted = df.select(terms).mapInArrow(count, "term string, tf bigint, df bigint")
    tasks = n_docs // TASK_ROWS
    usual = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = counted.repartition(tasks, "term") if tasks > usual else counted.repartition("term")
    return dealt.groupBy("term").agg(F.sum("tf").alias("tf"), F.sum("df").alias("df"))


def vocabulary(statistics: DataFrame, n_docs: int, max_terms: int, min_df: int, max_share: float) -> DataFrame:
    """term, df, idf of the top terms by corpus frequency (ties by term) within the df bounds.

    At most ``max_terms`` rows; the top-k runs per task and merges
    (TakeOrderedAndProject), no global sort.
    """
    df = F.col("df")
    bounded = statistics.filter((df >= min_df) & (df <= n_docs * max_share))
    top = bounded.orderBy(F.desc("tf"), "term").limit(max_terms)
    return top.select("term", "tf", "df", (F.log(F.lit(n_docs + 1) / (df + 1)) + 1).alias("idf"))


def tfidf(vectors: DataFrame, terms: list[str], vector: str, *carried: str) -> DataFrame:
    """``carried`` columns, term, weight: the entries of sparse unit-length TF-IDF vectors over ``terms``.

    Row by row: nothing shuffles by key, and a label can be carried along.
    """
    v = F.unwrap_udt(vector)
    names = F.array(*[F.lit(t) for t in terms])
    entries = F.transform(
        F.arrays_zip(v["indices"].alias("i"), v["values"].alias("x")),
        lambda e: F.struct(F.element_at(names, e["i"] + 1).alias("term"), e["x"].alias("weight")),
    )
    return vectors.select(*carried, F.inline(entries))


def log_priors(labels: DataFrame) -> tuple[float, float]:
    """Unsmoothed log class shares of a 0/1 label (two numbers)."""
    row = labels.agg(F.count("*"), F.sum("label")).first()
    n, ones = int(row[0]), int(row[1] or 0)
    if not 0 < ones < n:
        raise ValueError("naive Bayes needs both classes")
    return math.log((n - ones) / n), math.log(ones / n)


def naive_bayes(weights: DataFrame, vocab: DataFrame, alpha: float = 1.0) -> DataFrame:
    """Multinomial naive Bayes as grouped sums and logs: term, lp0, lp1.

    ``weights`` carries the label; the per-term sums combine on the map side,
    and from there on data is bounded by the vocabulary.
    """
    by_class = [F.sum(F.when(F.col("label") == c, F.col("weight"))).alias(f"w{c}") for c in (0, 1)]
    sums = weights.groupBy("term").agg(*by_class)
    smoothed = [(F.coalesce(f"w{c}", F.lit(0.0)) + F.lit(alpha)).alias(f"w{c}") for c in (0, 1)]
    full = vocab.select("term").join(sums, "term", "left").select("term", *smoothed)
    everything = Window.partitionBy()  # at most max_terms rows
    return full.select(
        "term", *[F.log(F.col(f"w{c}") / F.sum(f"w{c}").over(everything)).alias(f"lp{c}") for c in (0, 1)]
    )


def naive_bayes_scores(weights: DataFrame, keys: DataFrame, priors: tuple[float, float], likelihoods: DataFrame, key: str) -> DataFrame:
    """key, spam_prob, prediction; rows without known terms get the prior."""
    gain = F.sum(F.col("weight") * (F.col("lp1") - F.col("lp0"))).alias("gain")
    per_row = weights.join(likelihoods, "term").groupBy(key).agg(gain)
    margin = F.coalesce("gain", F.lit(0.0)) + F.lit(priors[1] - priors[0])
    return keys.select(key).join(per_row, key, "left").select(
        key, (1 / (1 + F.exp(-margin))).alias("spam_prob"), (margin > 0).cast("int").alias("prediction")
    )


# ------------------------------------------------------------------ stemming
# Porter's algorithm with the extensions of the widely used implementation: irregular words, -ies and -ied of short
# words, -y after a vowel, -alli, -fulli and -logi.  Written once as SQL over a column ``w``, for distinct words; it
# runs here and, with the other dialect's names, in the checks.  A consonant y is kept as Y while the steps run.
# Irregular words and suffix tables of the published algorithm
IRREGULAR = {
    "sky": "sky", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "news": "news", "innings": "inning",
    "inning": "inning", "outings": "outing", "outing": "outing", "cannings": "canning", "canning": "canning",
    "howe": "howe", "proceed": "proceed", "exceed": "exceed", "succeed": "succeed",
}
STEP2 = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("bli", "ble"),
    ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"),
    ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"),
    ("iviti", "ive"), ("biliti", "ble"), ("fulli", "ful"),
)
STEP3 = (
    ("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""),
)
STEP4 = (
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti",
    "ous", "ive", "ize",
)
_V, _C = "[aeiouy]", "[^aeiouy]"
_M0 = f"{_V}{_C}"  # measure over 0
_M1 = f"{_V}{_C}+{_V}+{_C}"  # measure over 1


def stem_steps(has: str, group: str, every: str = "") -> list[str]:
    """The steps as SQL expressions of ``w``, each to run on the result of the one before.

    ``has`` is the template of a regex test, ``group`` the name of the first group in a replacement and ``every`` the
    argument that makes a replacement global, as the dialects have them.
    """
    def test(pattern: str) -> str:
        return has.format("w", pattern)

    def cut(pattern: str, new: str) -> str:
        return f"regexp_replace(w, '{pattern}', '{new}')"

    def table(rows, measure: str) -> str:
        return " ".join(f"WHEN {test(old + '$')} THEN {cut(f'^(.*{measure}.*){old}$', group + new)}" for old, new in rows)

    irregular = " ".join(f"WHEN w = '{word}' THEN '{stem}='" for word, stem in IRREGULAR.items())
    double = f"substring(lower(w), length(w) - 1, 1) = substring(lower(w), length(w) - 2, 1) AND {test(_C + '[|]$')}"
    cvc = f"{_C}{_V}[^aeiouywxY]"
    ion = f"WHEN {test('ion$')} THEN CASE WHEN {test('[st]ion$')} THEN {cut(f'^(.*{_M1}.*)ion$', group)} ELSE w END"
    before, after = STEP4[:STEP4.index("ion")], STEP4[STEP4.index("ion") + 1:]
    steps = [
        # done words end in =
        f"CASE {irregular} WHEN length(w) <= 2 THEN concat(w, '=') ELSE {cut('^y', 'Y')} END",
        f"regexp_replace(w, '([aeiou])y', '{group}Y'{every})",
        f"regexp_replace(w, 'yy', 'yY'{every})",
        f"CASE WHEN {test('sses$')} THEN {cut('es$', '')} WHEN {test('ies$')} THEN CASE WHEN length(w) = 4 THEN {cut('s$', '')} ELSE {cut('es$', '')} END"
        f" WHEN {test('ss$')} THEN w ELSE {cut('s$', '')} END",
        f"CASE WHEN {test('ied$')} THEN CASE WHEN length(w) = 4 THEN {cut('d$', '')} ELSE {cut('ed$', '')} END"
        f" WHEN {test('eed$')} THEN {cut(f'^(.*{_M0}.*)eed$', group + 'ee')}"
        f" WHEN {test(_V + '.*ed$')} THEN {cut('ed$', '|')} WHEN {test(_V + '.*ing$')} THEN {cut('ing$', '|')} ELSE w END",
        # a bar marks a removed -ed or -ing
        f"CASE WHEN NOT {test('[|]$')} THEN w WHEN {test('(at|bl|iz)[|]$')} THEN {cut('[|]$', 'e')}"
        f" WHEN {double} THEN CASE WHEN {test('[lsz][|]$')} THEN {cut('[|]$', '')} ELSE {cut('.[|]$', '')} END"
        f" WHEN {test(_M0 + '.*[|]$')} AND NOT {test(_M1 + '.*[|]$')} AND ({test(cvc + '[|]$')} OR {test(f'^{_V}{_C}[|]$')}) THEN {cut('[|]$', 'e')}"
        f" ELSE {cut('[|]$', '')} END",
        cut(f"^(.+{_C})y$", group + "i"),
        cut(f"^(.*{_M0}.*)alli$", group + "al"),
        f"CASE {table(STEP2, _M0)} WHEN {test('logi$')} THEN {cut(f'^(.*{_M0}.*)ogi$', group + 'og')} ELSE w END",
        f"CASE {table(STEP3, _M0)} ELSE w END",
        f"CASE {table([(x, '') for x in before], _M1)} {ion} {table([(x, '') for x in after], _M1)} ELSE w END",
        f"CASE WHEN {test(_M1 + '.*e$')} THEN {cut('e$', '')} WHEN {test(_M0 + '.*e$')} AND NOT {test(cvc + 'e$')} AND NOT {test(f'^{_V}{_C}e$')}"
        f" THEN {cut('e$', '')} ELSE w END",
        f"CASE WHEN {test('ll$')} THEN {cut(f'^(.*{_M1}.*)l$', group)} ELSE w END",
    ]
    kept = [steps[0], *[f"CASE WHEN {test('=$')} THEN w ELSE {step} END" for step in steps[1:]]]
    return [*kept, "lower(regexp_replace(w, '=$', ''))"]


def stem_vocabulary(words: DataFrame, column: str = "word") -> DataFrame:
    """word, stem of the distinct lower-case words: cost follows the vocabulary, not the tokens; built-in functions only."""
    stems = words.select(F.col(column).alias("word")).distinct().withColumns({"w": F.col("word")})
    for step in stem_steps("({0} RLIKE '{1}')", "$1"):
        stems = stems.withColumns({"w": F.expr(step)})
    return stems.withColumnRenamed("w", "stem")


_MEASURE0, _MEASURE1 = re.compile(_M0), re.compile(_M1)
_VOWEL, _CONSONANT = re.compile(_V), re.compile(_C)
_CVC = f"{_C}{_V}[^aeiouywxY]"
_SHORT, _CVC_END = re.compile(f"{_CVC}$|^{_V}{_C}$"), re.compile(f"{_CVC}e$|^{_V}{_C}e$")
_VOWEL_Y = re.compile("([aeiou])y")
#: Suffix, replacement and measure of the three tables, in their order, by the last letter of the suffix.
_RULES = [
    {end: [(old, new, measure) for old, new in table if old[-1] == end] for end in {old[-1] for old, _ in table}}
    for table, measure in ((STEP2, _MEASURE0), (STEP3, _MEASURE0), ([(x, "") for x in STEP4], _MEASURE1))
]


def _measured(pattern: re.Pattern, w: str, cut: int) -> bool:
    """Whether the part before the last ``cut`` letters holds the measure."""
    return pattern.search(w, 0, len(w) - cut) is not None


@lru_cache(maxsize=1 << 17)
def stem(word: str) -> str:
    """Stem of one lower-case word, by the same tables as ``stem_steps``."""
    if word in IRREGULAR or len(word) <= 2:
        return IRREGULAR.get(word, word)
    w = word
    if "y" in w:
        w = _VOWEL_Y.sub(r"\1Y", "Y" + w[1:] if w[0] == "y" else w).replace("yy", "yY")
    if w.endswith("ies"):
        w = w[:-1] if len(w) == 4 else w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-2] if w.endswith("sses") else w[:-1]
    bare = None
    if w.endswith("ied"):
        w = w[:-1] if len(w) == 4 else w[:-2]
    elif w.endswith("eed"):
        w = w[:-1] if _measured(_MEASURE0, w, 3) else w
    elif w.endswith("ed") and _VOWEL.search(w, 0, len(w) - 2):
        bare = w[:-2]
    elif w.endswith("ing") and _VOWEL.search(w, 0, len(w) - 3):
        bare = w[:-3]
    if bare is not None:
        double = len(bare) > 1 and bare[-1].lower() == bare[-2].lower() and _CONSONANT.match(bare[-1])
        short = _MEASURE0.search(bare) and not _MEASURE1.search(bare) and _SHORT.search(bare)
        if bare.endswith(("at", "bl", "iz")) or (short and not double):
            bare += "e"
        elif double and bare[-1] not in "lsz":
            bare = bare[:-1]
        w = bare
    if w.endswith("y") and len(w) > 2 and _CONSONANT.match(w[-2]):
        w = w[:-1] + "i"
    if w.endswith("alli") and _measured(_MEASURE0, w, 4):
        w = w[:-2]
    for at, rules in enumerate(_RULES):
        hit = next((x for x in rules.get(w[-1:], ()) if w.endswith(x[0])), None)
        if hit:
            old, new, measure = hit
            if _measured(measure, w, len(old)) and (old != "ion" or w[-4:-3] in ("s", "t")):
                w = w[:len(w) - len(old)] + new
        elif at == 0 and w.endswith("logi") and _measured(_MEASURE0, w, 3):
            w = w[:-1]
    if w.endswith("e") and (_measured(_MEASURE1, w, 1) or (_measured(_MEASURE0, w, 1) and not _CVC_END.search(w))):
        w = w[:-1]
    return (w[:-1] if w.endswith("ll") and _measured(_MEASURE1, w, 1) else w).lower()


#: Words or terms that a Python task codes at once.
PART_WORDS = 500_000


def _parts(lists: pa.ListArray, most: int = PART_WORDS) -> Iterator[pa.ListArray]:
    """A list column in parts of consecutive rows with at most ``most`` elements in all, or of one row."""
    ends = np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(lists):
        done = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + most, "right")))
        yield lists.slice(at, to - at)
        at = to


def _stemmed_part(texts: pa.Array) -> pa.Array:
    words = pc.split_pattern(texts, " ")
    coded = words.flatten().dictionary_encode()
    stems = pa.array([stem(w) for w in coded.dictionary.to_pylist()], pa.string()).take(coded.indices)
    size = pc.fill_null(pc.list_value_length(words), 0)
    offsets = pa.concat_arrays([pa.array([0], pa.int32()), pc.cumulative_sum(size).cast(pa.int32())])
    return pc.binary_join(pa.ListArray.from_arrays(offsets, stems, mask=texts.is_null()), " ")


#: Bytes of texts that a Python task stems at once.
PART_BYTES = 4 << 20


@F.arrow_udf(T.StringType())
def _stemmed(texts: pa.Array) -> pa.Array:
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    out, at = [], 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PART_BYTES, "right")))
        out.append(_stemmed_part(texts.slice(at, to - at)))
        at = to
    return pa.concat_arrays(out) if out else pa.array([], pa.string())


def stem_texts(df: DataFrame, cleaned: str, out: str = "processed") -> DataFrame:
    """Replace every word of a cleaned text by its stem; NULL stays NULL, rows need no key.

    Row-local: nothing shuffles and nothing is written. An Arrow batch is cut into words and coded as a dictionary, so
    that only its distinct words are stemmed, and only those that the worker's bounded cache does not hold.
    """
    return df.withColumns({out: _stemmed(F.col(cleaned))})
