"""Feed files hold their texts compressed, in parts that keep the line order."""

from threatloom.plans import ingest

WORDS = ("free prize claim", "lunch at noon", "verify account now", "report attached here")


def test_feed_files_are_compressed_and_in_order(spark, monkeypatch, tmp_path):
    docs = [(i, f"{WORDS[i % 4]} {'abcdefgh'[i % 8] * 3}") for i in range(60)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(ingest, "scratch_path", lambda *_: str(tmp_path / "feeds"))
    rows = ingest.src_ordered_feed_files(spark, str(tmp_path)).collect()
    files = list((tmp_path / "feeds").rglob("part-*"))
    assert files and all(f.name.endswith(".csv.lz4") for f in files)
    firsts = {}
    for i, text in docs:
        for n in range(3 * i, 3 * i + 3):
            at = (n % 4, 0 if i % 5 == 0 else 1, n)
            firsts[text] = min(firsts.get(text, (9,)), (*at, "phishing" if i % 7 == 0 else "legitimate"))
    sources = [s for s, _, _ in ingest.rules.FEED_SOURCES]
    assert sorted(tuple(r) for r in rows) == sorted((t, v[3], sources[v[0]]) for t, v in firsts.items())
