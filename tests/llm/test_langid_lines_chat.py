"""Languages on held-out documents, lines by a loop, tool calls by hand."""

import json
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from threatloom.llm import chat, langid, lines


def test_held_out_accuracy(spark, folder, rows):
    from threatloom.llm.queries import QUERIES

    got = {r["doc_id"]: r for r in QUERIES["op10_language"](spark, folder).collect()}
    docs = rows("documents", "doc_id, text, lang")
    held = [(d, lang) for d, _, lang in docs if zlib.crc32(str(d).encode()) % 4 == 2]
    assert {d for d, r in got.items() if r["held_out"]} == {d for d, _ in held} and len(got) == len(docs)
    assert sum(got[d]["lang_pred"] == lang for d, lang in held) >= 0.98 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_code_lengths_follow_the_definition():
    texts = {"aa": b"abracadabra cabra", "bb": b"bolero bombo lebo"}
    codes = []
    for j, t in enumerate(texts.values()):
        s = langid.normalise(t)
        c = Counter(int.from_bytes(s[i:i + 4], "big") for i in range(len(s) - 3))
        codes += [(j, k, n) for k, n in c.items()]
    lang, code, n = (np.array(x) for x in zip(*codes))
    langid_min, langid.MIN_CONTEXT = langid.MIN_CONTEXT, 1
    try:
        trees = langid.ContextTrees(list(texts), lang, code, n)
    finally:
        langid.MIN_CONTEXT = langid_min

    def bits(j, s):
        total = 0.0
        for i in range(3, len(s)):
            for order in (3, 2, 1, 0, -1):
                if order < 0:
                    total += np.log2(trees.size)
                    break
                seen = Counter()
                for jj, k, m in codes:
                    w = int(k).to_bytes(4, "big")
                    if jj == j and w[3 - order:3] == s[i - order:i]:
                        seen[w[3]] += m
                if not seen:
                    continue
                t, d = sum(seen.values()), len(seen)
                if seen[s[i]]:
                    total -= np.log2(seen[s[i]] / (t + d))
                    break
                total -= np.log2(d / (t + d))
        return total

    for text in (b"abra bolero", b"zzz", b"cabo lera ab"):
        s = langid.normalise(text)
        known = bytes(b if trees.table[b] else 0 for b in s)
        assert trees.lengths(s) == pytest.approx([bits(0, known), bits(1, known)], rel=1e-4)


def test_language_edges(spark):
    docs = spark.createDataFrame([(i, t, la, "x") for i, (t, la) in enumerate(
        [("the cat sat on the mat", "en"), ("le chat est sur la table", "fr"), (None, "fr"), ("12 ½ ² !!", "en"), ("", None), ("the the the", None),
         ("la table " * 200_000, "fr"), ("über", None)])] * 2, "doc_id bigint, text string, lang string, score string")
    got = langid.with_language(docs, langid.fit(docs), into=("pred", "p")).collect()
    assert [r["pred"] for r in got][:7] == ["en", "fr", "und", "und", "und", "en", "fr"] and got[7]["pred"] in ("en", "fr")
    assert [r["p"] for r in got if r["pred"] == "und"] == [0.0] * 6 and got[0]["score"] == "x"
    none = langid.with_language(docs, langid.fit(docs.limit(0)), into=("pred", "p"))
    assert {r["pred"] for r in none.collect()} == {"und"}
    assert langid.with_language(docs.limit(0), langid.fit(docs), into=("pred", "p")).count() == 0


def clean(docs, ratio, least):
    pages, often = Counter(), Counter()
    for host, text in {(h, t) for _, t, h in docs}:
        pages[host] += 1
        often.update((host, x) for x in set((text or "").split("\n")) if x.split())
    bad = {k for k, n in often.items() if n >= least and n > ratio * pages[k[0]]}
    return [(d, t if t is None else "\n".join(x for x in t.split("\n") if (h, x) not in bad)) for d, t, h in docs]


@pytest.mark.parametrize("broadcast", [200_000, 0])
def test_lines_against_a_loop(spark, monkeypatch, broadcast):
    monkeypatch.setattr(lines, "BROADCAST_LINES", broadcast)
    docs = [(i, f"menu {i % 3}\nbody {i}\n\nfooter\n body {i // 2}", f"h{i % 4}") for i in range(200)]
    docs += [(500 + i, "copied\ntext", "h0") for i in range(50)] + [(600, None, "h0"), (601, "", None), (602, "footer\nx", None), (603, "footer\n" * 40_000, "h1")]
    frame = spark.createDataFrame([(*r, 1) for r in docs], "doc_id bigint, text string, source string, line_host int")
    got = [(r["doc_id"], r["text"]) for r in lines.without_boilerplate(frame, ratio=0.2).collect()]
    assert sorted(got, key=lambda r: r[0]) == sorted(clean(docs, 0.2, lines.MIN_PAGES), key=lambda r: r[0])
    assert lines.without_boilerplate(frame).columns == frame.columns and lines.without_boilerplate(frame.limit(0)).count() == 0
    got = {r["doc_id"]: r["text"] for r in lines.without_boilerplate(frame, ratio=0.2).collect()}
    assert got[500] == "copied\ntext" and got[603] == "" and got[602] == "footer\nx"


SCHEMAS = [("f", json.dumps({"type": "object", "required": ["x"], "properties": {"x": {"type": "integer", "minimum": 0}, "y": {"enum": ["a", None]}}, "additionalProperties": False})), ("broken", "{")]


def linked(spark, calls, results):
    frame = chat.link_calls(spark.createDataFrame(calls, chat.CALLS), spark.createDataFrame(results, chat.RESULTS), spark.createDataFrame(SCHEMAS, "name string, schema string"))
    return {(r["conv"], r["turn"], r["seq"], r["kind"]): r for r in frame.collect()}


def test_linking_validation_and_canonical_json(spark):
    calls = [
        (1, 1, 0, "a", "f", '{"y": "a", "x": 2.0}', []), (1, 1, 1, "b", "f", '{"x": -1}', ["a"]), (1, 3, 0, "a", "f", '{"x": 1}', []),
        (1, 4, 0, "c", "g", '{"é": [1, {"b": null, "a": true}]}', ["zzz"]), (2, 0, 0, "a", "f", "{x", []), (2, 0, 1, None, "f", None, None),
        (None, 0, 0, "a", "broken", "{}", []), (3, 5, 0, "late", "f", '{"z": NaN}', []),
    ]
    results = [(1, 2, 0, "a", "ok"), (1, 2, 1, "a", "again"), (1, 2, 2, "q", None), (3, 4, 0, "late", 'qu"ote'), (9, 0, 0, None, "x")]
    got = linked(spark, calls, results)
    assert len(got) == len(calls) + len(results)
    status = {k: r["status"] for k, r in got.items()}
    assert status == {
        (1, 1, 0, "call"): "linked", (1, 1, 1, "call"): "unanswered", (1, 3, 0, "call"): "repeated", (1, 4, 0, "call"): "unanswered",
        (2, 0, 0, "call"): "unanswered", (2, 0, 1, "call"): "unnamed", (None, 0, 0, "call"): "unnamed", (3, 5, 0, "call"): "early",
        (1, 2, 0, "result"): "linked", (1, 2, 1, "result"): "repeated", (1, 2, 2, "result"): "orphan", (3, 4, 0, "result"): "early", (9, 0, 0, "result"): "unnamed"}
    assert got[1, 1, 0, "call"]["json"] == '{"arguments":{"x":2,"y":"a"},"id":"a","name":"f"}' and got[1, 1, 0, "call"]["error"] is None
    assert got[1, 1, 1, "call"]["error"] == "$.x: out of range" and got[1, 4, 0, "call"]["error"] == "no schema"
    assert got[1, 4, 0, "call"]["json"] == '{"arguments":{"é":[1,{"a":true,"b":null}]},"id":"c","name":"g"}'
    assert got[2, 0, 0, "call"]["error"] == "$: not JSON" and got[2, 0, 0, "call"]["json"] is None
    assert got[None, 0, 0, "call"]["error"] == "schema not usable" and got[3, 5, 0, "call"]["error"] == "$: not JSON"
    assert got[3, 4, 0, "result"]["json"] == '{"content":"qu\\"ote","id":"late"}'


def test_topological_levels(spark):
    # conversation 1 points backward; 2 forward (c after d after e); 3 has a cycle x-y and z behind it
    calls = [(1, 1, 0, "a", "f", "{}", []), (1, 2, 0, "b", "f", "{}", ["a"]), (2, 1, 0, "c", "f", "{}", ["d", "e"]), (2, 2, 0, "d", "f", "{}", ["e"]), (2, 3, 0, "e", "f", "{}", ["none"]),
             (3, 1, 0, "x", "f", "{}", ["y"]), (3, 2, 0, "y", "f", "{}", ["x"]), (3, 3, 0, "z", "f", "{}", ["y"]), (3, 4, 0, "w", "f", "{}", [])]
    got = linked(spark, calls, [(2, 4, 0, "c", "r")])
    assert {r["id"]: r["level"] for k, r in got.items() if k[3] == "call"} == {"a": 0, "b": 1, "c": 2, "d": 1, "e": 0, "x": None, "y": None, "z": None, "w": 0}
    assert got[2, 4, 0, "result"]["level"] == 2
    assert linked(spark, [], []) == {}


def longest_chains(links):
    """Levels by repeated relaxation; NULL for what a cycle keeps waiting."""
    level, left = {}, dict(links)
    while ready := [n for n, before in left.items() if all(b in level for b in before)]:
        level.update({n: max((level[b] + 1 for b in left[n]), default=0) for n in ready})
        left = {n: b for n, b in left.items() if n not in level}
    return {n: level.get(n) for n in links}


def test_topological_levels_against_brute_force(spark):
    rnd, calls, low = random.Random(5), [], {}
    shapes = [(40, 1, True), (30, 2, True), (25, 3, False), (60, 1, False), (12, 12, True)]
    for conv, (n, fan, forward) in enumerate(shapes):
        links = {f"n{i}": sorted({f"n{rnd.randrange(i if forward and i else n)}" for _ in range(rnd.randint(0, fan))} if i else set()) for i in range(n)}
        low.update({(conv, k): v for k, v in longest_chains(links).items()})
        calls += [(conv, rnd.randrange(99), 0, k, "f", "{}", [*before, *before[:1], "unknown"]) for k, before in links.items()]
    chain = {f"c{i}": [f"c{i - 1}"] if i else [] for i in range(300)} | {"loop": ["loop"], "behind": ["loop"], "both": ["c299", "behind"]}
    low.update({(9, k): v for k, v in longest_chains(chain).items()})
    calls += [(9, 1, 0, k, "f", "{}", before) for k, before in chain.items()]
    calls += [(None, 1, 0, "n1", "f", "{}", ["n0"]), (0, 1, 0, None, "f", "{}", ["n0"]), calls[3]]
    rows = chat.topological_levels(spark.createDataFrame(calls, chat.CALLS)).collect()
    assert len(rows) == len(low) and {(r["conv"], r["id"]): r["level"] for r in rows} == low
    assert low[9, "c299"] == 299 and low[9, "both"] is None and any(low[2, f"n{i}"] is None for i in range(25))


def test_parsing_messages(spark):
    text = json.dumps({"tool_calls": [{"id": "a", "name": "f", "arguments": '{"x":1}', "after": []}, {"id": "b", "name": "g", "arguments": "{}"}]})
    rows = [(1, 1, "assistant", text), (1, 2, "tool", '{"tool_call_id": "a", "content": "5"}'), (1, 3, "assistant", '{"tool_calls": oops'), (1, 4, "tool", "?"), (1, 5, None, None)]
    calls, results = chat.parse_messages(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"))
    assert [(r["seq"], r["id"], r["arguments"]) for r in calls.collect()] == [(0, "a", '{"x":1}'), (1, "b", "{}")]
    assert [(r["turn"], r["id"], r["content"]) for r in results.collect()] == [(2, "a", "5"), (4, None, None)]
