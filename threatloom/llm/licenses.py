"""License scans: a positional index of rare words of license notices, and key phrases that must stand in place."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threatloom.session import materialize

#: What separates words; A-Z count as a-z.
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

#: Phrases whose places are counted, and their labels.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: Public license notices as ``(label, words, phrases that must stand in them)``. A label may have several.
NOTICES = [
    ("agpl-3.0", "gnu affero general public license version 3", ["gnu affero general public license"]),
    ("apache-2.0", "licensed under the apache license version 2 0", ["apache license version 2 0"]),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0",
     ["except in compliance with the license"]),
    ("boost-1.0", "distributed under the boost software license version 1 0", ["boost software license version 1 0"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
     ["redistribution and use in source and binary forms", "the following conditions are met"]),
    ("bsd-3-clause", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this"
     " software without specific prior written permission", ["endorse or promote products derived from this software"]),
    ("cc-by-4.0", "licensed under cc by 4 0", ["cc by 4 0"]),
    ("cc-by-4.0", "licensed under a creative commons attribution 4 0 international license", ["creative commons attribution 4 0"]),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", ["cc by nc 4 0"]),
    ("cc-by-nc-nd-4.0", "licensed under cc by nc nd 4 0", ["cc by nc nd 4 0"]),
    ("cc-by-nc-sa-4.0", "licensed under cc by nc sa 4 0", ["cc by nc sa 4 0"]),
    ("cc-by-nd-4.0", "licensed under cc by nd 4 0", ["cc by nd 4 0"]),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", ["cc by sa 4 0"]),
    ("cc-by-sa-4.0", "licensed under a creative commons attribution sharealike 4 0 international license", ["creative commons attribution sharealike 4 0"]),
    ("cc0-1.0", "cc0 1 0 universal public domain dedication", ["cc0 1 0 universal"]),
    ("gpl-2.0", "licensed under the gnu general public license version 2", ["gnu general public license version 2"]),
    ("gpl-2.0-or-later", "under the terms of the gnu general public license as published by the free software foundation either version 2 of the license"
     " or at your option any later version", ["published by the free software foundation", "either version 2 of the license"]),
    ("gpl-3.0", "licensed under the gnu general public license version 3", ["gnu general public license version 3"]),
    ("gpl-3.0-or-later", "under the terms of the gnu general public license as published by the free software foundation either version 3 of the license"
     " or at your option any later version", ["published by the free software foundation", "either version 3 of the license"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
     ["with or without fee is hereby granted"]),
    ("lgpl", "gnu lesser general public license", ["gnu lesser general public license"]),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software"
     " to deal in the software without restriction", ["permission is hereby granted free of charge", "to deal in the software without restriction"]),
    ("mit", "released under the mit license", ["the mit license"]),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ["mozilla public license v 2 0"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["released into the public domain"]),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages"
     " arising from the use of this software", ["in no event will the authors be held liable"]),
]
#: Function words; all other words of the notices are license words.
COMMON = frozenset("a an and any are as at be by except for from in into is it its may met not of on or that the this to under will with you your".split())

#: Of a notice's words that a file holds, those with the highest inverse document frequency that are looked up.
RARE_WORDS = 8
#: Places of one notice in a file that are this far apart still align: words may be missing or put in between.
SLACK = 4
#: Least share, in percent, of the notice's rarest words' weight that an alignment must hold.
MIN_SHARE = 60


def license_words(notices: list = NOTICES, base: dict[str, str] = BASE) -> list[str]:
    texts = [t for _, text, keys in notices for t in (text, *keys)] + list(base)
    return sorted({w for t in texts for w in t.split()} - COMMON)


def _places(phrase: str, field: str) -> str:
    """Places of a phrase in ``words`` as SQL, an array of structs of ``field`` and ``p``.

    The phrase's longest license word is looked up among the hits, the other words must stand around it.
    """
    parts = phrase.split()
    if re.search(SEPARATORS, "".join(parts)):
        raise ValueError(f"not words of small letters and digits: {phrase}")
    at = max((j for j, w in enumerate(parts) if w not in COMMON), key=lambda j: (len(parts[j]), -j))
    around = [f"get(words, x.p + {j - at}) <=> '{w}'" for j, w in enumerate(parts) if j != at]
    test = " and ".join([f"x.w = '{parts[at]}'", *around])
    return f"transform(filter(hits, x -> {test}), x -> struct({field}, x.p - {at} as p))"


def file_hits(docs: DataFrame, key: str = "doc_id", text: str = "text", notices: list = NOTICES, base: dict[str, str] = BASE) -> DataFrame:
    """``key, n_words, base, keys, hits`` of every row's whole text.

    ``hits`` are all places of license words, ``base`` the places of base phrases with their labels, ``keys`` those of
    the notices' key phrases with their numbers in the sorted list of all.
    """
    # the Kelvin sign is the one character beyond ASCII whose small form is an ASCII letter alone: it must stay another one
    plain = F.lower(F.replace(F.coalesce(F.col(text), F.lit("")), F.lit("K"), F.lit("ĸ")))
    rows = docs.select(F.col(key).alias("key"), F.filter(F.split(plain, SEPARATORS), lambda w: w != "").alias("words"))
    listed = license_words(notices, base)
    found = F.transform("words", lambda w, i: F.when(w.isin(listed), F.struct(w.alias("w"), i.alias("p"))))
    rows = rows.withColumn("hits", F.filter(found, lambda x: x.isNotNull()))
    phrases = sorted({k for _, _, keys in notices for k in keys})
    labelled = ", ".join(_places(p, f"'{label}' as label") for p, label in base.items())
    numbered = ", ".join(_places(p, f"{i} as k") for i, p in enumerate(phrases))
    some = F.size("hits") > 0
    return rows.select(
        "key", F.size("words").cast("bigint").alias("n_words"), F.when(some, F.expr(f"concat({labelled})")).alias("base"),
        F.when(some, F.expr(f"concat({numbered})")).alias("keys"), F.when(some, F.col("hits")).alias("hits"))


def inverse_frequencies(hits: DataFrame) -> dict[str, int]:
    """``floor(1000 * ln(1 + rows / (rows with the word + 1)))`` for each license word of ``hits``, over all rows."""
    n = hits.count()
    words = hits.select(F.explode(F.array_distinct("hits.w")).alias("w"))
    return {r["w"]: math.floor(1000 * math.log(1 + n / (r["count"] + 1))) for r in words.groupBy("w").count().collect()}


def _bins(offset: Column, slack: int) -> Column:
    """Two overlapping rows of bins: any two offsets at most ``slack`` apart share one."""
    return F.array(2 * F.floor(offset / (2 * slack)), 2 * F.floor((offset + slack) / (2 * slack)) + 1)


def notice_matches(hits: DataFrame, notices: list = NOTICES, rare_words: int = RARE_WORDS, slack: int = SLACK, min_share: int = MIN_SHARE) -> DataFrame:
    """``row, label, share`` of the notices found in ``hits(row, keys, hits)``, a written table.

    Of a notice's words in a file the ``rare_words`` ones with the highest inverse document frequency are looked up. Each
    of their places votes for the places where the notice would begin; a bin of such places holds words once. It is a
    match if it has ``min_share`` percent of the weight of the notice's rarest words and all of its key phrases.
    """
    spark = hits.sparkSession
    idf = inverse_frequencies(hits)
    top = math.floor(1000 * math.log(1 + hits.count()))  # a word that no file has is as rare as can be
    phrases = sorted({k for _, _, keys in notices for k in keys})
    postings, key_postings, facts = [], [], []
    for t, (label, text, keys) in enumerate(notices):
        words = text.split()
        own = {w: idf.get(w, top) for w in words if w not in COMMON}
        postings += [(t, w, i, own[w]) for i, w in enumerate(words) if w in own]
        for k in keys:
            parts = k.split()
            key_postings += [(t, phrases.index(k), i) for i in range(len(words)) if words[i:i + len(parts)] == parts]
        facts.append((t, label, len(keys), sum(sorted(own.values(), reverse=True)[:rare_words])))
    postings = spark.createDataFrame(postings, "t int, w string, at int, idf bigint")
    key_postings = spark.createDataFrame(key_postings, "t int, k int, at int")
    facts = spark.createDataFrame(facts, "t int, label string, n_keys int, weight bigint")

    # without a key phrase no notice can match: such rows need no look-up
    asked = hits.where(F.size("keys") > 0)
    places = asked.select("row", F.explode("hits").alias("x")).select("row", "x.w", "x.p").join(F.broadcast(postings), "w")
    rank = F.dense_rank().over(Window.partitionBy("row", "t").orderBy(F.col("idf").desc(), "w"))
    rare = places.withColumn("rank", rank).where(F.col("rank") <= rare_words)
    votes = rare.select("row", "t", F.explode(_bins(F.col("p") - F.col("at"), slack)).alias("bin"), "w", "idf").distinct()
    aligned = votes.groupBy("row", "t", "bin").agg(F.sum("idf").alias("idf"))
    aligned = aligned.join(F.broadcast(facts), "t").where(100 * F.col("idf") >= min_share * F.col("weight"))
    stand = asked.select("row", F.explode("keys").alias("x")).select("row", "x.k", "x.p").join(F.broadcast(key_postings), "k")
    stand = stand.select("row", "t", F.explode(_bins(F.col("p") - F.col("at"), slack)).alias("bin"), "k").distinct()
    stand = stand.groupBy("row", "t", "bin").agg(F.count("*").alias("keys"))
    return aligned.join(stand, ["row", "t", "bin"]).where(F.col("keys") == F.col("n_keys")).groupBy("row", "label").agg(
        F.max(F.col("idf") / F.col("weight")).alias("share"))


def scan_licenses(docs: DataFrame, key: str = "doc_id", text: str = "text", notices: list = NOTICES, base: dict[str, str] = BASE,
                  **options) -> DataFrame:
    """``key, n_words, base, matches, score`` of every row.

    ``base`` is ``array<struct<label, p>>``, all places of base phrases as word positions from 0; ``matches`` is
    ``array<struct<label, share>>`` of the notices found (``notice_matches``), by label; ``score`` is 1 with a base place
    and else the largest share, 0 without a match. Built-in functions only. Texts are read once; what is written and
    shuffled are the places of license words, and only rows with a key phrase shuffle at all.

    NULL and empty texts have no words; repeated rows and NULL keys are scanned each; an empty table gives no rows;
    other columns don't matter. ``notices`` is small: it is broadcast as a table of its words' places.
    """
    hits = file_hits(docs, key, text, notices, base).withColumn("row", F.monotonically_increasing_id())
    hits = materialize(hits, "license-hits")
    found = notice_matches(hits, notices, **options)
    found = found.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("label", "share"))).alias("matches"))
    some = F.coalesce(F.size("keys"), F.lit(0)) > 0
    none = F.array().cast("array<struct<label:string,share:double>>")
    with_keys = hits.where(some).join(found, "row", "left").select("key", "n_words", "base", F.coalesce("matches", none).alias("matches"))
    rows = with_keys.union(hits.where(~some).select("key", "n_words", "base", none))
    rows = rows.withColumn("base", F.coalesce("base", F.array().cast("array<struct<label:string,p:int>>")))
    best = F.coalesce(F.array_max("matches.share"), F.lit(0.0))
    return rows.withColumn("score", F.when(F.size("base") > 0, F.lit(1.0)).otherwise(best))


def joined(labels: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(labels)), ",")
