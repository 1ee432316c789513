"""License scans: phrases against plain Python, notices planted whole, damaged and scattered."""

import random
import re

import pytest

from threatloom.llm import licenses


def words(text):
    lowered = (text or "").translate({i: i + 32 for i in range(65, 91)})
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def places(text):
    w = words(text)
    return sorted((label, i) for p, label in licenses.BASE.items() for i in range(len(w)) if w[i:i + len(p.split())] == p.split())


def scan(spark, texts, **options):
    frame = spark.createDataFrame([(i, t, 9, "x") for i, t in enumerate(texts)], "doc_id bigint, text string, row int, hits string")
    got = licenses.scan_licenses(frame.repartition(3), **options).collect()
    return [r.asDict() for r in sorted(got, key=lambda r: r["key"])]


def filler(rng, n):
    return " ".join(rng.choice(["lorem", "version", "software", "the", "use", "2", "0", "4", "of", "Ünder", "x"]) for _ in range(n))


def test_base_places_are_those_of_plain_python(spark):
    rng = random.Random(3)
    parts = ["GNU", "General", "public", "License", "licenſe", "LİCENSE", "apache", "mit", "cc", "BY", "by", "by2", "Kit", "K", "é"]
    texts = [rng.choice([" ", "-", ", ", "\n"]).join(rng.choices(parts, k=rng.randrange(0, 40))) for _ in range(300)]
    texts += [None, "", " .,", "MIT\x00License", "MITLicense", "the_mit_license", "cc by cc by", "GNU general public license " * 3, "ccxby", "mitélicense"]
    for t, r in zip(texts, scan(spark, texts)):
        assert r["n_words"] == len(words(t)), t
        assert sorted((b["label"], b["p"]) for b in r["base"]) == places(t), t
        assert r["score"] == 1 if r["base"] else 0 <= r["score"] <= 1


@pytest.mark.parametrize("number", range(len(licenses.NOTICES)))
def test_every_notice_is_found_in_its_own_words(spark, number, found_notices):
    label, _, _ = licenses.NOTICES[number]
    whole, damaged, scattered, none = (found_notices[4 * number + i] for i in range(4))
    assert label in whole and label in damaged
    assert label not in scattered and not none


@pytest.fixture(scope="module")
def found_notices(spark):
    rng = random.Random(8)
    texts = []
    for _, text, keys in licenses.NOTICES:
        texts.append(f"{filler(rng, 30)} {text.upper().replace(' ', '; ')} {filler(rng, 30)}")
        # one word more where no key phrase stands
        w = text.split()
        inside = set()
        for k in keys:
            k = k.split()
            for i in range(len(w)):
                if w[i:i + len(k)] == k:
                    inside |= set(range(i + 1, i + len(k)))
        free = [i for i in range(len(w) + 1) if i not in inside]
        w.insert(rng.choice(free), "quux")
        texts.append(" ".join(w))
        # all the words, far from each other, and the key phrases with a word in between
        shuffled = text.split()
        rng.shuffle(shuffled)
        texts.append("\n".join(f"{x} {filler(rng, 12)}" for x in shuffled) + " zz ".join("\n" + k.replace(" ", " zz ") for k in keys))
        texts.append(filler(rng, 80))
    return [{m["label"] for m in r["matches"]} for r in scan(spark, texts)]


def test_key_phrase_alone_or_notice_without_it_is_no_match(spark):
    mit = next(n for n in licenses.NOTICES if n[1].startswith("permission is hereby granted free"))
    far = mit[2][0] + " lorem" * 50 + " " + mit[2][1]
    without = mit[1].replace("restriction", "limits")
    full, phrases, cut = scan(spark, [mit[1], far, without])
    assert [m["label"] for m in full["matches"]] == ["mit"] and full["score"] == 1
    assert phrases["matches"] == [] == cut["matches"] and phrases["score"] == 0


def test_long_repeated_and_odd_rows(spark):
    long = "word " * 200_000 + "Released under the MIT License.\n" * 3_000
    frame = spark.createDataFrame([(None, long), (5, long), (5, long), (5, None)], "doc_id bigint, text string")
    got = licenses.scan_licenses(frame).collect()
    assert len(got) == 4
    for r in got:
        if r["n_words"]:
            assert len(r["base"]) == 3_000 and [m["label"] for m in r["matches"]] == ["mit"]
    assert licenses.scan_licenses(frame.limit(0)).collect() == []


def test_rare_words_go_by_the_whole_corpus(spark):
    texts = ["mit license"] * 3 + ["apache"] + ["other words"] * 6
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    idf = licenses.inverse_frequencies(licenses.file_hits(frame))
    assert idf == {"mit": 1252, "license": 1252, "apache": 1791}


def test_main_path_is_native(spark):
    frame = spark.createDataFrame([(1, "the mit license")], "doc_id bigint, text string")
    plan = licenses.scan_licenses(frame)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "InPandas" not in plan
