"""Lookups that are joins at table scale: labels, hashes, suffixes, block and allow lists.

Plain equi-joins: Catalyst broadcasts a side only when its size statistics are
below ``spark.sql.autoBroadcastJoinThreshold`` and otherwise sorts or hashes
both sides, so no list has to fit on one machine.  Probe sides may be skewed;
the list side is made distinct, so each row meets at most one partner and
adaptive execution can split hot keys.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threatloom.functions import text as tx
from threatloom.functions import url as ux

MAX_SUFFIXES = 50_000
#: Tasks over which the rows without a key are spread in a lookup.
NULL_SALTS = 64


def load_suffixes(table: DataFrame, column: str = "suffix") -> tuple[str, ...]:
    """Public suffixes as a literal list for row-local expressions.

    The size is checked before anything is collected; larger lists go through
    ``split_hosts``.
    """
    distinct = table.select(F.lower(column).alias("s")).filter(F.length("s") > 0).distinct()
    rows = distinct.limit(MAX_SUFFIXES + 1).collect()
    if len(rows) > MAX_SUFFIXES:
        raise ValueError(f"more than {MAX_SUFFIXES} suffixes: use split_hosts() with the table")
    return tuple(sorted(r[0] for r in rows))


def split_hosts(df: DataFrame, host: str, suffixes: DataFrame) -> DataFrame:
    """Append subdomain, domain, suffix using a suffix *table* of any size.

    Rules as in ``url.longest_suffix``: plain, ``*.name`` and ``!name``.  Works
    on distinct hosts: explode the trailing label sequences, equi-join the
    rules, keep the longest match (partial aggregation), then join back.
    """
    hosts = df.select(F.lower(host).alias("__h")).distinct()
    labels = F.split("__h", r"\.")
    rule = F.lower("suffix")
    kind = F.when(rule.startswith("!"), 2).when(rule.startswith("*."), 1).otherwise(0)
    name = F.when(kind == 2, F.expr("substring(lower(suffix), 2)")).when(kind == 1, F.expr("substring(lower(suffix), 3)")).otherwise(rule)
    listed = suffixes.select(name.alias("__c"), kind.alias("__kind")).distinct()
    # the candidate's own name for plain rules and exceptions, its parent's for wildcards
    tried = hosts.select("__h", F.explode(ux.suffix_candidates(labels)).alias("__t")).select("__h", "__t", F.explode(F.array(
        F.struct(F.col("__t").alias("name"), F.lit(False).alias("wild")),
        F.struct(F.when(F.col("__t").contains("."), ux.parent(F.col("__t"))).alias("name"), F.lit(True).alias("wild")),
    )).alias("__p"))
    n = F.length("__t")
    hits = (
        tried.join(listed, (F.col("__p.name") == F.col("__c")) & (F.col("__p.wild") == (F.col("__kind") == 1)))
        .groupBy("__h")
        .agg(F.max(F.when(F.col("__kind") < 2, n)).alias("__len"), F.max(F.when(F.col("__kind") == 2, F.length(ux.parent(F.col("__t"))))).alias("__except"))
        .select("__h", F.expr("right(__h, coalesce(__except, __len))").alias("__suffix"))
    )
    joined = df.withColumns({"__h": F.lower(host)}).join(hits, "__h", "left")
    ipv4 = F.col(host).rlike(ux._IPV4)
    suffix = F.when(ipv4, "").otherwise(F.coalesce("__suffix", F.lit("")))
    return (
        joined.withColumns({"__dom": ux.domain_parts(F.col(host), suffix)})
        .withColumns({n: F.col(f"__dom.{n}") for n in ("subdomain", "domain", "suffix")})
        .drop("__h", "__suffix", "__dom")
    )


def flag_listed(df: DataFrame, key: Column, listed: DataFrame, column: str, name: str) -> DataFrame:
    """Left join: append a boolean ``name`` telling whether the key is listed.

    Rows without a key are spread by a salt of their other columns, so they
    don't meet in one task.
    """
    marks = listed.select(F.col(column).alias("__k"), F.lit(0).alias("__zero")).filter(F.col("__k").isNotNull()).distinct()
    simple = [F.col(c) for c, kind in df.dtypes if not kind.startswith(("map", "variant"))]
    salt = F.when(key.isNull(), F.pmod(F.xxhash64(*simple), F.lit(NULL_SALTS)).cast("int")).otherwise(0) if simple else F.lit(0)
    return (
        df.withColumns({"__probe": key, "__salt": salt})
        .join(marks.withColumns({"__hit": F.lit(True)}), (F.col("__probe") == F.col("__k")) & (F.col("__salt") == F.col("__zero")), "left")
        .withColumns({name: F.coalesce("__hit", F.lit(False))})
        .drop("__probe", "__salt", "__k", "__zero", "__hit")
    )


def keep_listed(df: DataFrame, key: Column, listed: DataFrame, column: str) -> DataFrame:
    marks = listed.select(F.col(column).alias("__k"))
    return df.join(marks, key == F.col("__k"), "left_semi")


def drop_listed(df: DataFrame, key: Column, listed: DataFrame, column: str) -> DataFrame:
    marks = listed.select(F.col(column).alias("__k")).filter(F.col("__k").isNotNull())
    return df.join(marks, key == F.col("__k"), "left_anti")


def registered_domain(url: Column, suffixes: Iterable[str]) -> Column:
    """Lower-cased domain.suffix of a URL."""
    return F.lower(tx.let(ux.host_parts(url, suffixes), lambda d: F.concat_ws(".", d["domain"], d["suffix"])))


def map_labels(df: DataFrame, label: str, mapping: DataFrame) -> DataFrame:
    """Left join against a (name, canonical) table; misses become unknown."""
    names = mapping.select(F.col("name").alias("__n"), F.col("canonical").alias("__c"))
    return (
        df.withColumns({"__l": tx.strip(F.lower(label))})
        .join(names, F.col("__l") == F.col("__n"), "left")
        .withColumns({"canonical_label": F.coalesce("__c", F.lit("unknown"))})
        .drop("__l", "__n", "__c")
    )
