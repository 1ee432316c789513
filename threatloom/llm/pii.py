"""Personal data: base patterns, and spans that weak labelers find together. Column expressions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threatloom.session import materialize

KINDS = ("email", "ip", "card", "phone")
#: Posterior from which on a candidate is personal data.
THRESHOLD = 0.9
#: Rounds of expectation-maximisation at most.
ROUNDS = 60
#: Code points before a candidate that the context labeler reads.
CONTEXT = 40

# The contract's patterns. Starts are tied to the start of a run, or to the end of the last match, and
# runs are possessive where giving back can't help, so that a search is linear in the text.
_LOCAL = r"A-Za-z0-9._%+-"
EMAIL = rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Single blanks or hyphens between digits are marked first, so that a card is one run of a class (no nested repetition).
_MARK = "\u0001"
CARD = rf"[0-9][0-9{_MARK}]++"

# Candidates beside the base spans.
#: Card groups inside longer runs of digits, national phone numbers, and addresses written around their signs.
EXTRA = {
    "card": rf"(?<![0-9])(?:[0-9]{{16}}|[0-9]{{15}}|[0-9]{{4}}(?:{_MARK}[0-9]{{4}}){{3}}|[0-9]{{4}}{_MARK}[0-9]{{6}}{_MARK}[0-9]{{5}})(?![0-9])",
    "phone": r"(?<![0-9+.(-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[-.\x20])[0-9]{3}[-.\x20][0-9]{4}(?![0-9-])",
    "email": rf"(?<![{_LOCAL}])[A-Za-z0-9][A-Za-z0-9._%+-]{{0,63}}\x20?[\[(](?i:at)[\])]\x20?[A-Za-z0-9-]{{1,63}}(?:\.[A-Za-z]{{2,24}}){{1,3}}",
}
#: Gazetteers: issuer prefixes of cards, area codes and top-level domains that exist.
CARD_ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[47]|6011|65|35)"
AREA_CODES = r"^\(?[2-9][0-9]{2}"
DOMAINS = r"(?i)\.(?:com|org|net|edu|gov|info|io|co|uk|de|fr|es|it|nl|eu|ch|at|be)$"
#: Words before a candidate that speak for personal data, and against it.
CONTEXT_FOR = r"(?i)\b(?:tel|t[eé]l[eé]fono|t[eé]l[eé]phone|telefon|phone|call|mobile|cell|fax|card|visa|mastercard|credit|kart[e]?|carte|tarjeta|mail|e-mail|email|correo|contact|write|reach)\b"
CONTEXT_AGAINST = r"(?i)\b(?:isbn|issn|order|invoice|serial|version|ref|item|sku|part|doi|id)\b"

#: Matches of a text whose offsets are summed up together.
SPAN_BLOCK = 128

LABELERS = ("pattern", "gazetteer", "context", "boundary")


def spans(text: Column, pattern: str) -> Column:
    """``array<struct<s, e, m>>``: code-point offsets and texts of all matches, leftmost and non-overlapping.

    Offsets are running sums of gaps and matches. They are taken in blocks, first over the blocks' lengths and then within
    each block, so that appending to an array never copies more than a block.
    """
    found, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.transform(F.split(text, pattern, -1), F.length)
    empty, starts = F.array().cast("array<struct<s:int,e:int,m:string>>"), F.array().cast("array<int>")
    # the last gap has no match
    once = F.array(F.struct(F.arrays_zip(found.alias("m"), gaps.alias("g")).alias("items")))  # a name, so that it is made once
    return F.flatten(F.transform(once, lambda x: _placed(x["items"], empty, starts)))


def _placed(items: Column, empty: Column, starts: Column) -> Column:
    last = F.floor((F.size(items) - 1) / SPAN_BLOCK).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), last), lambda k: F.slice(items, k * SPAN_BLOCK + 1, F.lit(SPAN_BLOCK)))
    sized = F.transform(blocks, lambda x: F.struct(x.alias("x"), F.aggregate(x, F.lit(0), lambda n, y: n + y["g"] + F.coalesce(F.length(y["m"]), F.lit(0))).alias("n")))
    placed = F.aggregate(
        sized, F.struct(F.lit(0).alias("at"), starts.alias("out")),
        lambda acc, x: F.struct((acc["at"] + x["n"]).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])

    def within(block: Column) -> Column:
        return F.aggregate(
            block["x"]["x"], F.struct(block["at"].alias("at"), empty.alias("out")),
            lambda acc, x: F.when(x["m"].isNull(), acc).otherwise(F.struct(
                (acc["at"] + x["g"] + F.length(x["m"])).alias("at"),
                F.concat(acc["out"], F.array(F.struct((acc["at"] + x["g"]).alias("s"), (acc["at"] + x["g"] + F.length(x["m"])).alias("e"), x["m"].alias("m")))).alias("out"))),
            lambda acc: acc["out"])

    return F.flatten(F.transform(F.arrays_zip(sized.alias("x"), placed.alias("at")), within))


def digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of at most 19 digits passes the Luhn check."""
    at = F.sequence(F.lit(1), F.length(number))
    value = F.transform(at, lambda i: F.substring(F.reverse(number), i, F.lit(1)).cast("int") * (F.lit(2) - i % 2))
    return F.aggregate(value, F.lit(0), lambda s, v: s + v - F.when(v > 9, 9).otherwise(0)) % 10 == 0


def _valid(kind: str, m: Column) -> Column:
    n = F.length(digits(m))
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda p: p.cast("double") <= 255)
    if kind == "card":
        return F.when(n.between(12, 19), luhn(digits(m))).otherwise(False)
    if kind == "phone":
        return n.between(9, 15)
    return F.lit(True)


def _base(text: Column, marked: Column) -> dict[str, Column]:
    found = {"email": spans(text, EMAIL), "ip": spans(text, IP), "card": spans(marked, CARD), "phone": spans(text, PHONE)}
    return {k: _where(v, k) for k, v in found.items()}


def _where(found: Column, kind: str) -> Column:
    return F.filter(found, lambda x: _valid(kind, x["m"]))


def _votes(kind: str, text: Column, s: Column, e: Column, m: Column) -> list[Column]:
    """The labelers' votes on a candidate: 1 for personal data, 0 against it, -1 for no opinion."""
    plain = digits(m)
    if kind == "card":
        pattern = F.when(luhn(plain), 1).otherwise(0)
        gazetteer = F.when(plain.rlike(CARD_ISSUERS), 1).otherwise(0)
    elif kind == "phone":
        # groups held together by one kind of separator, or the area code in brackets
        pattern = F.when(m.rlike(r"^\(|^[0-9]{3}([-.\x20])[0-9]{3}\1|^\+"), 1).otherwise(0)
        gazetteer = F.when(m.rlike(r"^\+"), -1).when(m.rlike(AREA_CODES), 1).otherwise(0)
    elif kind == "email":
        pattern = F.when(m.rlike(r"@|\x20?[\[(]"), 1).otherwise(0)
        gazetteer = F.when(m.rlike(DOMAINS), 1).otherwise(-1)
    else:
        pattern = F.when(m.rlike(r"^0|\.0[0-9]"), 0).otherwise(1)
        gazetteer = F.when(m.rlike(r"^(?:0|127|255)\."), 0).otherwise(-1)
    before = F.substring(text, F.greatest(s + 1 - CONTEXT, F.lit(1)), F.least(s, F.lit(CONTEXT)))
    context = F.when(before.rlike(CONTEXT_AGAINST), 0).when(before.rlike(CONTEXT_FOR), 1).otherwise(-1)
    around = F.concat(F.substring(text, F.greatest(s, F.lit(1)), F.when(s > 0, 1).otherwise(0)), F.lit("|"), F.substring(text, e + 1, F.lit(1)))
    boundary = F.when(around.rlike(r"^[\p{L}\p{N}_=/]|\|[\p{L}\p{N}_=/]$"), 0).otherwise(1)
    return [pattern, gazetteer, context, boundary]


def find_candidates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, base, found``: the base spans, and all candidates with their votes, of every row's whole text.

    ``base`` and ``found`` are arrays of ``(s, e, rank, votes)``, rank being the kind's place in ``KINDS``. Candidates
    are the base spans and, where they overlap none of these, matches of the looser ``EXTRA`` patterns.
    """
    # most texts have neither sign and skip all other patterns
    rows = docs.select(F.col(key).alias("key"), F.when(F.col(text).rlike(r"[0-9@]|\((?i:at)\)|\[(?i:at)\]"), F.col(text)).alias("text"))
    rows = rows.withColumn("marked", F.regexp_replace(F.translate("text", _MARK, "\u0002"), r"(?<=[0-9])[\x20-](?=[0-9])", _MARK))
    rows = rows.withColumns({f"b_{k}": v for k, v in _base(F.col("text"), F.col("marked")).items()})
    base = F.concat(*[F.col(f"b_{k}") for k in KINDS])
    rows = rows.withColumns({
        f"x_{k}": F.filter(spans(F.col("marked" if k == "card" else "text"), pattern),
                           lambda x: ~F.exists(base, lambda y: (x["s"] < y["e"]) & (y["s"] < x["e"])))
        for k, pattern in EXTRA.items()})

    def voted(name: str, kind: str) -> Column:
        return F.transform(F.col(name), lambda x: F.struct(
            x["s"].alias("s"), x["e"].alias("e"), F.lit(KINDS.index(kind)).alias("rank"),
            F.concat_ws("", *[(v + 1).cast("string") for v in _votes(kind, F.col("text"), x["s"], x["e"], x["m"])]).alias("votes")))

    none = F.array().cast("array<struct<s:int,e:int,rank:int,votes:string>>")
    return rows.select(
        "key", F.coalesce(F.concat(*[voted(f"b_{k}", k) for k in KINDS]), none).alias("base"),
        F.coalesce(F.concat(*[voted(f"x_{k}", k) for k in EXTRA]), none).alias("extra"))


def estimate_reliabilities(counts: list[tuple[int, str, int]], rounds: int = ROUNDS) -> dict[tuple[int, str], float]:
    """Posterior of each ``(rank, votes)`` pattern from pattern counts, by expectation-maximisation.

    Labelers are taken to err independently given the truth; each has a hit rate and a false-alarm rate over the cases
    where it votes, shared by the kinds, and each kind has its own share of true candidates. Starts from the majority;
    rates are smoothed by one case. The input is bounded by kinds times vote patterns, whatever the corpus.
    """
    post = {(k, v): min(0.95, max(0.05, v.count("2") / max(1, 4 - v.count("0")))) for k, v, _ in counts}
    for _ in range(rounds):
        share, hit, alarm = {}, [[1.0, 2.0] for _ in LABELERS], [[0.5, 2.0] for _ in LABELERS]
        for k, v, n in counts:
            p = post[k, v]
            a = share.setdefault(k, [1.0, 2.0])
            a[0] += n * p
            a[1] += n
            for i, x in enumerate(v):
                if x != "0":
                    hit[i][0] += n * p * (x == "2")
                    hit[i][1] += n * p
                    alarm[i][0] += n * (1 - p) * (x == "2")
                    alarm[i][1] += n * (1 - p)
        new = {}
        for k, v, _ in counts:
            odds = math.log(share[k][0] / (share[k][1] - share[k][0]))
            for i, x in enumerate(v):
                if x != "0":
                    h, f = hit[i][0] / hit[i][1], alarm[i][0] / alarm[i][1]
                    # a labeler is at least as good as chance: keeps the two classes from changing places
                    h, f = min(max(h, 0.5), 0.999), max(min(f, 0.5), 0.001)
                    odds += math.log(h / f) if x == "2" else math.log((1 - h) / (1 - f))
            new[k, v] = 1 / (1 + math.exp(-max(-500.0, min(500.0, odds))))
        change = max((abs(new[c] - post[c]) for c in new), default=0)
        post = new
        if change < 1e-9:
            break
    return post


def train_classifier(counts: list[tuple[int, str, int]], post: dict[tuple[int, str], float]) -> dict[tuple[int, int, str], float]:
    """Log-odds weights of the final span classifier: naive Bayes over (kind, labeler, vote) and a bias per kind.

    Trained on all candidates, each counting as positive by its posterior. Key ``(rank, -1, "")`` is the bias.
    """
    mass: dict[tuple[int, int, str], list[float]] = {}
    for k, v, n in counts:
        p = post[k, v]
        for i, x in [(-1, ""), *enumerate(v)]:
            cell = mass.setdefault((k, i, x), [0.0, 0.0])
            cell[0] += n * p
            cell[1] += n * (1 - p)
    weights = {}
    for (k, i, x), (yes, no) in mass.items():
        total = mass[k, -1, ""]
        weights[k, i, x] = math.log((yes + 0.5) / (no + 0.5)) if i < 0 else math.log(
            (yes + 0.5) / (total[0] + 1.5) / ((no + 0.5) / (total[1] + 1.5)))
    return weights


def _score(rank: Column, votes: Column, weights: dict[tuple[int, int, str], float]) -> Column:
    out = F.lit(0.0)
    for i in range(-1, len(LABELERS)):
        pairs = [F.when((rank == k) & (votes.substr(i + 1, 1) == x if i >= 0 else F.lit(True)), F.lit(w))
                 for (k, j, x), w in sorted(weights.items()) if j == i]
        if pairs:
            out = out + F.coalesce(*pairs, F.lit(0.0))
    return out


def find_personal_data(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``key, n_email, n_ip, n_card, n_phone, base, spans`` of every row: base spans, and all spans with the method's.

    Spans are ``array<struct<s, rank, e>>`` in that order, in code points, the end exclusive. Regex, gazetteer, context
    and boundary labelers vote on base spans and on looser candidates; the counts of vote patterns over all rows give the
    labelers' reliabilities (EM) and then a span classifier; candidates beside the base that it takes for personal data
    are added. Base spans always stay. Texts are read once: patterns and votes go through a written table without texts.

    NULL and empty texts have no spans; repeated rows are searched each; an empty table gives no rows; other columns
    don't matter. Without candidates nothing is learned and the base spans are the result.
    """
    found = materialize(find_candidates(docs, key, text), "candidates")
    every = found.select(F.explode(F.concat("base", "extra")).alias("c"))
    counts = [tuple(r) for r in every.groupBy("c.rank", "c.votes").count().collect()]
    weights = train_classifier(counts, estimate_reliabilities(counts))
    odds = math.log(threshold / (1 - threshold))
    more = F.filter("extra", lambda c: _score(c["rank"], c["votes"], weights) >= odds)

    def number(rank: int) -> Column:
        return F.size(F.filter("base", lambda c: c["rank"] == rank)).cast("bigint")

    def plain(spans_: Column) -> Column:
        return F.array_sort(F.transform(spans_, lambda c: F.struct(c["s"].alias("s"), c["rank"].alias("rank"), c["e"].alias("e"))))

    return found.select(
        "key", *[number(i).alias(f"n_{k}") for i, k in enumerate(KINDS)],
        plain(F.col("base")).alias("base"), plain(F.concat(F.col("base"), more)).alias("spans"))


def span_text(spans_: Column) -> Column:
    """``kind:start:end`` of all spans, comma-joined."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans_, lambda c: F.concat_ws(":", F.element_at(kinds, c["rank"] + 1), c["s"], c["e"])), ",")
