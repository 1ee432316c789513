"""Text scalar functions: every function takes and returns Columns.

Pattern matching works on *folded* text (lower case, with the four letters
that Unicode case folding maps onto ASCII replaced), so patterns need no
case-insensitive flag.  ``(?Ud)`` gives Unicode ``\\w \\d \\s \\b`` and makes
``.``, ``^`` and ``$`` know ``\\n`` only.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterable
from functools import cache, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from threatloom import rules
from threatloom.rules import Rule

# Unicode white space, as stripped and split on
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    + "".join(chr(c) for c in range(0x2000, 0x200B))
    + "\u2028\u2029\u202f\u205f\u3000"
)
FLAGS = "(?Ud)"
# Letters that Unicode matching takes for ASCII ones, and those
FOLDED, FOLDS = "İıſK", "iisk"
SPACE = r"[\s\x1c-\x1f]"
NON_SPACE = r"[^\s\x1c-\x1f]"
DIGIT = r"[\p{Nd}²³¹⁰⁴-⁹₀-₉①-⑨]"
# Contact and URL patterns.  The e-mail form carries an anchor
# (start of the run, or end of the previous match) that keeps it linear.
URL_PATTERN = r'https?://[^\s\x1c-\x1f<>"{}|\\^`\[\]]+'
LOOSE_URL_PATTERN = r"https?://[a-z!$-_]+"
EMAIL_PATTERN = (
    r"(?:\G|(?<![a-z0-9._%+-]))[a-z0-9._%+-]++@[a-z0-9.-]+\.[a-z]{2,}"
)
PHONE_PATTERN = r"(?:\+?\d{1,3}[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}"
LONG_NUMBER_PATTERN = r"\b\d{10,}\b"
# a whitespace-delimited token with an inner '@', anchored at the token start
AT_TOKEN_PATTERN = rf"(?<!{NON_SPACE}){NON_SPACE}[^\s\x1c-\x1f@]*+@{NON_SPACE}+"
CURRENCY_CHARS = ("$", "£", "€", "¥")


def any_of(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def total(columns: Iterable[Column]) -> Column:
    """Left-to-right sum, so floating-point results do not depend on layout."""
    return reduce(lambda a, b: a + b, columns)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times inside one expression."""
    return F.element_at(F.transform(F.array(value), body), 1)


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def strip(c: Column) -> Column:
    """Trim Unicode white space at both ends (SQL ``trim`` knows the space only)."""
    return F.btrim(c, F.lit(WHITESPACE))


def fold(c: Column) -> Column:
    """Lower case plus the folds that Unicode matching applies to ASCII letters."""
    return F.when(contains_any(c, FOLDED), F.lower(F.translate(c, FOLDED, FOLDS))).otherwise(F.lower(c))


def quote(value: str) -> str:
    """SQL string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def literals(values: Iterable[str]) -> Column:
    """Constant array of strings (folded to one literal by the optimizer)."""
    return F.expr("array(" + ", ".join(map(quote, values)) + ")")


def one_of(c: Column, values: Iterable[str]) -> Column:
    values = tuple(values)
    return F.array_contains(literals(values), c) if values else F.lit(False)


def contains_any(c: Column | str, words: Iterable[str]) -> Column:
    """True if any word occurs.

    A column *name* gives a flat OR of byte searches that compiles into the
    stage (use it for long texts); a Column works inside lambdas too.
    """
    words = tuple(words)
    if not words:
        return F.lit(False)
    if isinstance(c, str):
        return F.expr(" OR ".join(f"contains({c}, {quote(w)})" for w in words))
    return F.exists(literals(words), lambda w: c.contains(w))


def contains_count(c: Column | str, words: Iterable[str]) -> Column:
    """How many of the words occur (presence, not occurrences)."""
    words = tuple(words)
    if not words:
        return F.lit(0)
    if isinstance(c, str):
        return F.expr(" + ".join(f"CAST(contains({c}, {quote(w)}) AS INT)" for w in words))
    return F.size(F.filter(literals(words), lambda w: c.contains(w)))


def matches(c: Column, pattern: str) -> Column:
    return c.rlike(FLAGS + pattern)


def match_count(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(FLAGS + pattern))


def char_count(c: Column, ascii_chars: str) -> Column:
    """Occurrences of any of the given ASCII characters, without regex or arrays."""
    return total(
        F.octet_length(c) - F.octet_length(F.replace(c, F.lit(ch), F.lit(""))) for ch in ascii_chars
    )


def as_column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def rule_count(folded: Column | str, rule: Rule) -> Column:
    hits = match_count(as_column(folded), rule.pattern)
    if not rule.anchors:
        return hits
    return F.when(contains_any(folded, rule.anchors), hits).otherwise(0)


def rule_hit(folded: Column | str, rule: Rule) -> Column:
    hit = matches(as_column(folded), rule.scan or rule.pattern)
    return (contains_any(folded, rule.anchors) & hit) if rule.anchors else hit


def family_count(folded: Column | str, family: Iterable[Rule]) -> Column:
    """Sum of match counts.  One pass per pattern: overlapping patterns count twice."""
    return total(rule_count(folded, r) for r in family)


def words(c: Column) -> Column:
    """Whitespace tokens; an empty text has none."""
    return F.filter(F.split(strip(c), FLAGS + SPACE + "+"), lambda w: w != "")


def word_count(c: Column) -> Column:
    return match_count(c, NON_SPACE + "+")


def norm_hash(c: Column) -> Column:
    """md5 of the lower-cased, stripped text: the deduplication key."""
    return F.md5(strip(F.lower(c)))


def clean(c: Column) -> Column:
    """Model text: lower, drop URLs, e-mails, long numbers and non-letters, squeeze blanks.

    Texts without the letters of a URL or the sign of an e-mail skip that step.
    """
    def letters(t: Column) -> Column:
        t = F.regexp_replace(t, FLAGS + LONG_NUMBER_PATTERN, "")
        t = F.regexp_replace(t, FLAGS + r"[^a-zA-Z\s\x1c-\x1f]", "")
        return strip(F.regexp_replace(t, FLAGS + SPACE + "+", " "))

    def mails(t: Column) -> Column:
        return let(F.when(t.contains("@"), F.regexp_replace(t, FLAGS + AT_TOKEN_PATTERN, "")).otherwise(t), letters)

    def urls(t: Column) -> Column:
        found = F.regexp_replace(t, FLAGS + rf"http{NON_SPACE}+|www{NON_SPACE}+", "")
        return let(F.when(t.contains("http") | t.contains("www"), found).otherwise(t), mails)

    return let(F.lower(c), urls)


def drop_stop_words(cleaned: Column, stop_words: Iterable[str]) -> Column:
    """Remove stop words from a cleaned text (single blanks between words)."""
    return F.array_join(F.filter(F.split(cleaned, " "), lambda w: ~one_of(w, stop_words)), " ")


@cache
def _unmarked() -> tuple[str, str, dict[str, str]]:
    """Characters whose compatibility decomposition without marks is one character, those characters (marks have
    none), and the others with their longer forms; Hangul syllables apart.  Made from the Unicode tables."""
    one, to, marks, longer = [], [], [], {}
    for code in (*range(0x80, 0xAC00), *range(0xD7A4, 0xD800), *range(0xE000, 0x110000)):
        c = chr(code)
        if unicodedata.combining(c):
            marks.append(c)
            continue
        plain = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        if plain == c:
            continue
        if len(plain) == 1:
            one.append(c)
            to.append(plain)
        else:
            longer[c] = plain
    return "".join(one + marks), "".join(to), longer


@cache
def _hangul() -> tuple[str, list[str]]:
    """Hangul syllables and, in the same order, their first, second and third letters (blank: none)."""
    syllables = [chr(x) for x in range(0xAC00, 0xD7A4)]
    parts = [unicodedata.normalize("NFKD", s).ljust(3) for s in syllables]
    return "".join(syllables), ["".join(p[i] for p in parts) for i in range(3)]


def _ranges(chars: Iterable[str]) -> str:
    """Characters as ranges of a regex class.  Java tests a class of single characters one by one, for every character
    of a text; the leading test spares the common ones all of it."""
    codes = sorted(map(ord, chars))
    starts = [a for a, before in zip(codes, [-2, *codes]) if a != before + 1]
    ends = [a for a, after in zip(codes, [*codes[1:], -2]) if a + 1 != after]
    parts = "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in zip(starts, ends))
    return rf"[^\x{{0}}-\x{{{codes[0] - 1:x}}}]&&[{parts}]"


def strip_accents(c: Column) -> Column:
    """Lower case without accents: compatibility decomposition (NFKD), combining marks dropped.

    A text of ASCII characters alone is its lower case.
    """
    return let(F.lower(c), lambda low: F.when(F.octet_length(low) == F.length(low), low).otherwise(let(_decomposed(low), _spelt)))


def _decomposed(low: Column) -> Column:
    """All but Hangul syllables."""
    source, target, longer = _unmarked()
    names = _ranges(longer)
    # a text with ligatures, fractions and the like is cut around them; few texts have any
    pieces = F.split(low, rf"(?<=[{names}])|(?=[{names}])")
    table = F.create_map(*[F.lit(x) for pair in longer.items() for x in pair])
    long_form = F.array_join(F.transform(pieces, lambda p: F.coalesce(F.when(F.length(p) == 1, F.try_element_at(table, p)), p)), "")
    return F.translate(F.when(low.rlike(f"[{names}]"), long_form).otherwise(low), source, target)


def _spelt(plain: Column) -> Column:
    """Hangul syllables by their letters."""
    syllables, letters = _hangul()
    split = F.split(plain, "(?<=[가-힣])|(?=[가-힣])")
    spelt = F.array_join(F.transform(split, lambda p: F.when(p.rlike("^[가-힣]$"), F.rtrim(F.concat(*[F.translate(p, syllables, x) for x in letters]))).otherwise(p)), "")
    return F.when(plain.rlike("[가-힣]"), spelt).otherwise(plain)


def model_tokens(c: Column) -> Column:
    """Tokens of two or more word characters."""
    return F.regexp_extract_all(c, F.lit(FLAGS + r"\b\w\w+\b"), F.lit(0))


def ngrams(tokens: Column, low: int, high: int) -> Column:
    """All n-grams for n in [low, high], blank-joined, in position order per n.

    ``tokens`` must be an existing column, not an expression: it is used once
    per n and per offset.
    """
    def of_size(n: int) -> Column:
        if n == 1:
            return tokens
        last = F.size(tokens) - (n - 1)

        def term(i: Column) -> Column:
            return F.concat_ws(" ", *[F.element_at(tokens, i + k) for k in range(n)])

        return F.when(last >= 1, F.transform(F.sequence(F.lit(1), last), term)).otherwise(
            F.array().cast("array<string>")
        )

    return F.concat(*[of_size(n) for n in range(low, high + 1)])


def extract_urls(c: Column) -> Column:
    """URLs with their original case; rows without a scheme separator skip the regex."""
    return F.when(
        c.contains("://"), F.regexp_extract_all(c, F.lit("(?Uid)" + URL_PATTERN), F.lit(0))
    ).otherwise(F.array().cast("array<string>"))


def extract_urls_loose(c: Column) -> Column:
    """Second URL pattern: case-sensitive scheme, one flat character class."""
    return F.when(
        c.contains("://"),
        F.regexp_extract_all(c, F.lit(r"https?://[a-zA-Z!$-_]+"), F.lit(0)),
    ).otherwise(F.array().cast("array<string>"))


def email_count(folded: Column) -> Column:
    return F.when(folded.contains("@"), match_count(folded, EMAIL_PATTERN)).otherwise(0)


def at_token_count(c: Column) -> Column:
    return F.when(c.contains("@"), match_count(c, AT_TOKEN_PATTERN)).otherwise(0)


def phone_count(c: Column, digits: Column | None = None) -> Column:
    """Phone numbers; texts with fewer than ten digits skip the regex when the digit count is at hand."""
    found = match_count(c, PHONE_PATTERN)
    return found if digits is None else F.when(digits >= 10, found).otherwise(0)


def upper_count(c: Column) -> Column:
    return F.length(c) - F.length(F.regexp_replace(c, r"\p{IsUppercase}+", ""))


def digit_count(c: Column) -> Column:
    return match_count(c, DIGIT)


def entropy(c: Column) -> Column:
    """Base-2 character entropy of the lower-cased text, relative to the original length."""
    def of(low: Column) -> Column:
        n, n_low = F.length(c).cast("double"), F.length(low)

        def term(acc: Column, ch: Column) -> Column:
            p = (n_low - F.length(F.replace(low, ch, F.lit("")))) / n
            return acc - p * F.log2(p)

        return F.aggregate(F.array_distinct(F.split(low, "")), F.lit(0.0), term)

    return F.when(F.length(c) > 0, let(F.lower(c), of)).otherwise(F.lit(0.0))


def scan_type(stripped: Column, folded: Column | str) -> Column:
    """url / sms / email, from the look of the text."""
    is_url = (stripped.startswith("http://") | stripped.startswith("https://")) & (
        F.size(F.split(stripped, FLAGS + SPACE + "+", rules.URL_MAX_TOKENS + 1)) <= rules.URL_MAX_TOKENS
    )
    is_sms = (F.length(stripped) < rules.SMS_MAX_CHARS) & any_of(
        rule_hit(folded, r) for r in rules.SMS_RULES
    )
    return F.when(is_url, "url").when(is_sms, "sms").otherwise("email")


def short(c: Column) -> Column:
    """True for texts that are missing or too short to analyse."""
    return F.length(strip(text_or_empty(c))) < rules.MIN_ANALYSED_CHARS


def echo(c: Column) -> Column:
    """Shortened echo of the input for reports."""
    n = rules.ECHO_CHARS
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)

