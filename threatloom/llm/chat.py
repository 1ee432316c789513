"""Linking of tool calls and their results in conversations."""

from __future__ import annotations

import json
import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threatloom.session import materialize

CALLS = "conv bigint, turn bigint, seq int, id string, name string, arguments string, after array<string>"
RESULTS = "conv bigint, turn bigint, seq int, id string, content string"
#: Rows of schemas that are broadcast; more are joined by a shuffle.
BROADCAST_SCHEMAS = 10_000

_MESSAGE = "tool_calls array<struct<id:string,name:string,arguments:string,after:array<string>>>"


def parse_messages(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """``(calls, results)`` from messages in the usual JSON form.

    A call stands in an assistant's ``{"tool_calls": [{"id", "name", "arguments", "after"}]}``, ``after`` naming calls
    that must come first; a result is a ``tool`` message ``{"tool_call_id", "content"}``. Other messages, NULLs and
    malformed JSON give no rows.
    """
    rows = messages.select(F.col(conv).cast("bigint").alias("conv"), F.col(turn).cast("bigint").alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))
    calls = rows.where("role = 'assistant' and text like '%\"tool_calls\"%'").select(
        "conv", "turn", F.posexplode(F.from_json("text", _MESSAGE)["tool_calls"]).alias("seq", "c")
    ).select("conv", "turn", "seq", "c.id", "c.name", "c.arguments", "c.after")
    results = rows.where("role = 'tool'").select(
        "conv", "turn", F.lit(0).alias("seq"), F.get_json_object("text", "$.tool_call_id").alias("id"),
        F.get_json_object("text", "$.content").alias("content"))
    return calls, results


def turns_as_calls(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """``(calls, results)`` of plain conversations: each user turn calls ``reply`` and the next turn, if the assistant's, is its result.

    Ids are ``conv-turn``; a call comes after the call two turns before it. System turns are calls of ``configure``,
    which nobody answers. NULL texts are JSON null; NULL conversations, turns or roles give no rows.
    """
    c, t = F.col("conv"), F.col("turn")
    rows = messages.select(F.col(conv).cast("bigint").alias("conv"), F.col(turn).cast("bigint").alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))
    rows = rows.where("conv is not null and turn is not null")
    name = F.when(F.col("role") == "system", "configure").otherwise("reply")
    arguments = F.to_json(F.struct(F.col("turn"), F.col("text")), {"ignoreNullFields": "false"})
    calls = rows.where("role in ('user', 'system')").select(
        "conv", "turn", F.lit(0).alias("seq"), F.concat_ws("-", c, t).alias("id"), name.alias("name"), arguments.alias("arguments"),
        F.when((F.col("role") == "user") & (t >= 2), F.array(F.concat_ws("-", c, t - 2))).otherwise(F.array().cast("array<string>")).alias("after"))
    results = rows.where("role = 'assistant'").select(
        "conv", "turn", F.lit(0).alias("seq"), F.concat_ws("-", c, t - 1).alias("id"), F.col("text").alias("content"))
    return calls, results


def canonical(value) -> str:
    """JSON with sorted keys and no blanks; whole floats as integers; characters beyond ASCII as they are."""
    def plain(x):
        if isinstance(x, dict):
            return {k: plain(v) for k, v in x.items()}
        if isinstance(x, list):
            return [plain(v) for v in x]
        return int(x) if isinstance(x, float) and math.isfinite(x) and x == int(x) and abs(x) < 2 ** 53 else x

    return json.dumps(plain(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False)


_TYPES = {
    "object": lambda x: isinstance(x, dict), "array": lambda x: isinstance(x, list), "string": lambda x: isinstance(x, str),
    "boolean": lambda x: isinstance(x, bool), "null": lambda x: x is None,
    "integer": lambda x: not isinstance(x, bool) and (isinstance(x, int) or isinstance(x, float) and x.is_integer()),
    "number": lambda x: isinstance(x, (int, float)) and not isinstance(x, bool),
}


def schema_error(value, schema: dict, path: str = "$") -> str | None:
    """The first violation of a JSON schema (type, enum, required, properties, additionalProperties, items, bounds)."""
    kinds = schema.get("type")
    if kinds and not any(_TYPES.get(k, lambda _: False)(value) for k in ([kinds] if isinstance(kinds, str) else kinds)):
        return f"{path}: not {kinds if isinstance(kinds, str) else ' or '.join(kinds)}"
    if "enum" in schema and value not in schema["enum"]:
        return f"{path}: not in enum"
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        if value < schema.get("minimum", value) or value > schema.get("maximum", value):
            return f"{path}: out of range"
    if isinstance(value, str) and not schema.get("minLength", 0) <= len(value) <= schema.get("maxLength", len(value)):
        return f"{path}: length"
    if isinstance(value, dict):
        fields = schema.get("properties", {})
        for k in schema.get("required", []):
            if k not in value:
                return f"{path}.{k}: missing"
        for k in sorted(value):
            if k in fields:
                if error := schema_error(value[k], fields[k], f"{path}.{k}"):
                    return error
            elif schema.get("additionalProperties", True) is False:
                return f"{path}.{k}: unknown"
    if isinstance(value, list) and "items" in schema:
        for i, x in enumerate(value):
            if error := schema_error(x, schema["items"], f"{path}[{i}]"):
                return error
    return None


def _refuse(constant: str):
    raise ValueError(constant)


def check_arguments(arguments: str | None, schema: str | None) -> tuple[str | None, str | None]:
    """``(canonical JSON, error)`` of one call's arguments; without JSON or schema an error says so."""
    try:
        value = json.loads(arguments, parse_constant=_refuse) if arguments is not None else None
        text = canonical(value)
    except (ValueError, RecursionError):
        return None, "$: not JSON"
    if schema is None:
        return text, "no schema"
    try:
        return text, schema_error(value, json.loads(schema))
    except (ValueError, RecursionError, AttributeError, TypeError):
        return text, "schema not usable"


def topological_levels(calls: DataFrame) -> DataFrame:
    """``conv, id, level``: longest chain of ``after`` links before a call; NULL in or behind a cycle. One row per id.

    Chains go by pointer jumping: a call with one predecessor points to it, and each round doubles how far it points,
    until it reaches an end, a call with none or several. Rounds follow the logarithm of the longest chain; a round that
    brings nobody to an end leaves only calls in or behind cycles. Calls with several predecessors are then placed over
    the shortened links between ends, one round per level of such calls. Links to unknown calls don't count, repeated
    ones count once, NULL conversations and ids give no rows.
    """
    key = ["conv", "id"]
    nodes = calls.where("conv is not null and id is not null").select(*key).distinct()
    links = calls.select("conv", "id", F.explode("after").alias("before")).distinct()
    links = materialize(links.join(nodes.withColumnRenamed("id", "before"), ["conv", "before"], "left_semi").select(*key, "before"), "call-links")
    degree = links.groupBy(*key).agg(F.count("*").alias("k"), F.min("before").alias("before"))
    one = F.coalesce(F.col("k") == 1, F.lit(False))
    chains = materialize(nodes.join(degree, key, "left").select(
        *key, F.when(one, F.col("before")).otherwise(F.col("id")).alias("up"), one.cast("bigint").alias("steps"), (~one).alias("ends"),
        (F.coalesce("k", F.lit(0)) > 1).alias("several")), "call-chains")
    waiting = chains.where("not ends").count()
    while waiting:
        to = chains.select("conv", F.col("id").alias("up"), F.col("up").alias("next"), F.col("steps").alias("more"), F.col("ends").alias("arrived"))
        jumped = chains.where("not ends").join(to, ["conv", "up"]).select(
            *key, F.col("next").alias("up"), (F.col("steps") + F.col("more")).alias("steps"), F.col("arrived").alias("ends"), "several")
        chains = materialize(chains.where("ends").unionByName(jumped), "call-chains")
        still = chains.where("not ends").count()
        if still == waiting:
            break
        waiting = still
    ends = chains.where("ends and steps = 0")
    placed = ends.where("not several").select(*key, F.lit(0).cast("bigint").alias("level"))
    short = links.join(ends.where("several").select(*key), key, "left_semi").join(
        chains.select("conv", F.col("id").alias("before"), F.col("up"), (F.col("steps") + 1).alias("plus"), "ends"), ["conv", "before"])
    short = materialize(short.select(*key, F.when(F.col("ends"), F.col("up")).alias("up"), "plus"), "call-links")
    while not short.isEmpty():
        level = placed.select("conv", F.col("id").alias("up"), "level")
        known = short.join(level, ["conv", "up"], "left").groupBy(*key).agg(
            F.max(F.col("level") + F.col("plus")).alias("level"), F.bool_and(F.col("level").isNotNull()).alias("ready"))
        ready = materialize(known.where("ready").select(*key, "level"), "call-levels")
        if ready.isEmpty():
            break
        placed = materialize(placed.unionByName(ready), "call-levels")
        short = materialize(short.join(ready, key, "left_anti"), "call-links")
    at = placed.select("conv", F.col("id").alias("up"), "level")
    reached = F.when(F.col("ends"), F.col("level") + F.col("steps")).cast("int").alias("level")
    return chains.join(at, ["conv", "up"], "left").select(*key, reached)


def link_calls(calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """One row per call and per result, linked by identifier: ``conv, turn, seq, kind, id, status, level, error, json``.

    Calls and results meet in an equi-join on ``(conv, id)``. ``status``: ``linked``; ``unanswered`` call; ``orphan``
    result; ``early`` if the result stands before its call; ``repeated`` for all but the first of an id in turn order
    (rows alike in turn and seq count as one); ``unnamed`` without conversation or id. A conversation's topological order
    is ``(level, turn, seq, kind)``: level is 0 throughout if all ``after`` links point backward in turns, and the
    longest chain otherwise, NULL around cycles; a result has its call's level. ``error`` is the first violation of the
    call's schema in ``schemas(name, schema)``, NULL if valid; ``json`` the canonical form of a call
    ``{"arguments", "id", "name"}`` or result ``{"content", "id"}``.

    Order comes as a key, not as a rank, so that a conversation of any length is never one group. ``schemas`` must have
    unique names. Links to unknown calls don't count. Empty tables give no rows.
    """
    first_call = calls.where("id is not null").groupBy("conv", "id").agg(F.min(F.struct("turn", "seq")).alias("at"))
    first_result = results.where("id is not null").groupBy("conv", "id").agg(F.min(F.struct("turn", "seq")).alias("at"))
    pair = first_call.withColumnRenamed("at", "call_at").join(first_result.withColumnRenamed("at", "result_at"), ["conv", "id"], "full")
    levels = topological_levels(calls).withColumn("placed", F.lit(True))
    level = F.when(F.col("placed"), F.col("level")).otherwise(0).alias("level")
    pair = materialize(pair.join(levels, ["conv", "id"], "left").select("conv", "id", "call_at", "result_at", level), "call-pairs")

    def placed(rows: DataFrame, own: str, other: str, missing: str) -> DataFrame:
        at = F.struct("turn", "seq")
        rows = rows.join(pair, ["conv", "id"], "left")
        status = (
            F.when(F.col("conv").isNull() | F.col("id").isNull(), "unnamed").when(at != F.col(own), "repeated")
            .when(F.col(other).isNull(), missing).when(F.col("result_at.turn") < F.col("call_at.turn"), "early").otherwise("linked"))
        known = F.col("call_at").isNotNull() | F.col("result_at").isNotNull()
        return rows.withColumns({"status": status, "level": F.when(known, F.col("level")).otherwise(0)})

    by_name = schemas.select(F.col("name").alias("schema_name"), "schema")
    if by_name.count() <= BROADCAST_SCHEMAS:
        by_name = F.broadcast(by_name)

    @F.pandas_udf("json string, error string")
    def checked(ids: pd.Series, names: pd.Series, arguments: pd.Series, schema: pd.Series) -> pd.DataFrame:
        out = []
        for i, name, value, rule in zip(ids, names, arguments, schema):
            text, error = check_arguments(value, rule)
            head = canonical({"id": i, "name": name})[1:]
            out.append((None if text is None else f'{{"arguments":{text},{head}', error))
        return pd.DataFrame(out, columns=["json", "error"])

    @F.pandas_udf("string")
    def result_json(ids: pd.Series, contents: pd.Series) -> pd.Series:
        return pd.Series([canonical({"content": x, "id": i}) for i, x in zip(ids, contents)], dtype=object)

    done = placed(calls, "call_at", "result_at", "unanswered").join(by_name, F.col("name") == F.col("schema_name"), "left")
    done = done.withColumn("checked", checked(F.col("id"), F.col("name"), F.col("arguments"), F.col("schema")))
    answers = placed(results, "result_at", "call_at", "orphan")
    return done.select("conv", "turn", "seq", F.lit("call").alias("kind"), "id", "status", "level", "checked.error", "checked.json").union(
        answers.select("conv", "turn", "seq", F.lit("result"), "id", "status", "level", F.lit(None).cast("string"),
                       result_json(F.col("id"), F.col("content"))))
