"""Hand-computed verdicts and the documented quirks."""

import pytest
from pyspark.sql import functions as F

from threatloom import rules
from threatloom.functions import url as ux
from threatloom.operators import features as fe
from threatloom.plans import fixtures as fx
from threatloom.operators import phishing as ph
from threatloom.operators import spam as sp
from threatloom.operators import threats as th


def verdict(spark, text, **kw):
    return ph.with_phishing_result(spark.createDataFrame([(text,)], "text string"), "text", suffixes=fx.DETECTOR_SUFFIXES, **kw).first()


def url_row(spark, url):
    return fe.with_url_features(spark.createDataFrame([(url,)], "u string"), "u", suffixes=fx.DETECTOR_SUFFIXES).first()


@pytest.mark.parametrize("url, flag", [
    ("http://facebook.com/", 1), ("http://apple.com", 1), ("http://paypal.com", 0), ("http://10.0.0.1/", 1),
    ("http://[fe80::1]/", 1), ("http://[::1]/", 0),
])
def test_ip_quirk(spark, url, flag):
    assert url_row(spark, url)["has_ip_address"] == flag


def test_url_vector(spark):
    r = url_row(spark, " http://u@shop-12.co.uk:8080/a//b;p?x=1&x=2&y=&z%41=3#f ")
    assert (r["domain_length"], r["path_length"], r["path_depth"], r["query_param_count"]) == (20, 5, 2, 2)
    assert (r["has_double_slash"], r["has_at_symbol"], r["has_hexadecimal"], r["tld_length"]) == (1, 1, 1, 5)
    assert (r["has_hyphen_in_domain"], r["consecutive_digits"], r["subdomain_count"]) == (1, 2, 0)


def test_unparsable_url_gives_zeros(spark):
    r = url_row(spark, "http://[broken/")
    assert all(r[n] == 0.0 for n in fe.URL_FEATURES)


@pytest.mark.parametrize("host, parts", [
    ("a.b.example.co.uk", ("a.b", "example", "co.uk")), ("localhost", ("", "localhost", "")),
    ("x.localhost", ("x", "localhost", "")), ("192.168.0.1", ("", "192.168.0.1", "")), ("co.uk", ("", "", "co.uk")),
    ("Face.Example.NET", ("Face", "Example", "NET")),
])
def test_host_parts(spark, host, parts):
    got = spark.createDataFrame([(f"http://{host}/p",)], "u string").select(
        ux.host_parts(F.col("u"), fx.DETECTOR_SUFFIXES)).first()[0]
    assert tuple(got) == parts


def test_neutral_models_start_at_0225(spark):
    r = verdict(spark, "plain words here")
    assert (r["confidence"], r["threat_level"], r["is_phishing"], r["phishing_type"]) == (0.225, "NONE", False, "EMAIL")


@pytest.mark.parametrize("text", [None, "", "ok", "  a "])
def test_short_text(spark, text):
    r = verdict(spark, text)
    assert (r["confidence"], r["phishing_type"], r["threat_level"]) == (0.0, "NONE", "NONE")
    assert r["indicators"] == [] and r["details"] is None and r["recommendation"] == rules.EMPTY_RECOMMENDATION


def test_full_verdict(spark):
    r = verdict(spark, "Please confirm your password at http://paypal.secure-login.tk/verify")
    url = r["urls_analyzed"][0]
    assert url["score"] == pytest.approx(0.8) and url["is_suspicious"]
    assert url["reasons"] == ["Suspicious TLD: .tk", "Brand name in subdomain (possible typosquatting)",
                              "Suspicious keywords in URL (3)"]
    assert r["indicators"] == ["Possible paypal impersonation detected", "Suspicious domain: secure-login.tk",
                               "Suspicious phrases detected (1)"]
    # .3*.5 + .25*.08 + .2*.8 + .1*.8 + .15*.5, two signals only
    assert r["confidence"] == pytest.approx(0.485) and r["threat_level"] == "HIGH" and not r["is_phishing"]
    assert r["phishing_type"] == "URL" and r["brand_impersonation"]["brand"] == "paypal"


def test_boost_needs_three_signals(spark):
    text = "Please confirm your password at http://paypal.secure-login.tk/verify"
    r = verdict(spark, text, ml=F.lit(0.7))
    assert r["confidence"] == pytest.approx(round(0.545 * 1.2, 4))


def test_suspicion_uses_the_uncapped_sum(spark):
    r = verdict(spark, "http://paypal.login.verify.a.b.c@1.tk/x http://1.2.3.4/@bit.ly/login/verify")
    assert [u["score"] for u in r["urls_analyzed"]] == [pytest.approx(1.0), pytest.approx(1.0)]


def test_critical_from_indicators_alone(spark):
    r = verdict(spark, "urgent enter your pin payment winner amazon http://x.tk http://bit.ly/1")
    assert len(r["indicators"]) >= 5 and r["threat_level"] == "CRITICAL"


def test_brand_ties_go_by_name(spark):
    low, urls = F.lit("google and amazon"), F.array().cast("array<string>")
    assert spark.range(1).select(ph.top_brand(ph.brand_mentions(low, urls))).first()[0] == "amazon"


def test_brand_in_url_counts_twice(spark):
    text = "amazon amazon google http://google.com/google"
    low, urls = F.lit(text), F.array(F.lit("http://google.com/google"))
    assert spark.range(1).select(ph.top_brand(ph.brand_mentions(low, urls))).first()[0] == "google"


def test_spam_threshold(spark):
    df = spark.createDataFrame([("a", 0.75), ("b", 0.6), ("c", None), (None, 0.9)], "t string, p double")
    rows = sp.with_spam_result(df, "t", "p").collect()
    assert [r["prediction"] for r in rows] == ["spam", "ham", "error", "error"]
    assert rows[1]["confidence"] == pytest.approx(0.4) and rows[1]["details"]["raw_prediction"] == "spam"
    assert rows[2]["error"] == "probability is null" and rows[3]["error"] == "text is null"


def threat(spark, text, label=None, score=None):
    df = spark.createDataFrame([(text, label, score)], "t string, l string, s double")
    return th.with_threat_result(df, "t", F.col("l"), F.col("s")).first()["threat"]


@pytest.mark.parametrize("text", [
    "Congratulations! You've won $1,000,000. Click here to claim: http://bit.ly/fake123",
    "URGENT: Your account has been suspended. Verify immediately at http://192.168.1.1/verify",
])
def test_threats_name_phishing(spark, text):
    t = threat(spark, text, "PHISHING", 0.9)
    assert t["is_threat"] and t["threat_type"] == "PHISHING" and t["threat_indicators"][0] == "ML Phishing Score: 0.90"


def test_model_free_threat_stays_below_056(spark):
    t = threat(spark, "urgent bit.ly western union ceo .exe http://1.2.3.4@x.tk")
    assert t["confidence"] <= 0.56 + 1e-9 and len(t["matches"]) == 5
    assert threat(spark, "lunch?", "phishing", 0.99)["confidence"] == 0.0   # label test is case-sensitive


def test_only_the_last_alternative_carries_the_tail(spark):
    assert "social_engineering" in threat(spark, "ask the ceo")["matches"]
    assert threat(spark, "ask the manager")["matches"] == {}


def test_attacks(spark):
    df = spark.createDataFrame([("x' or '1'='1 <SCRIPT> ; cat /x ../",), ("fine",), (None,)], "p string")
    rows = th.with_intrusion_result(df, "p").collect()
    assert rows[0]["attack_types"] == ["sql_injection", "xss", "command_injection", "path_traversal"]
    assert [r["confidence"] for r in rows] == [0.9, 0.1, 0.1] and not rows[2]["is_intrusion"]


def test_file_scan(spark):
    packed = bytes(range(256)) * 4
    df = spark.createDataFrame([("a.exe", packed), ("b.EXE", packed), ("c.txt", b""), ("d.txt", b"bad")], "path string, content binary")
    known = df.filter("path = 'd.txt'").select(F.sha2("content", 256).alias("sha256"))
    rows = {r["path"]: r for r in th.with_file_scan(df, known.union(known)).collect()}
    assert len(rows) == 4
    assert (rows["a.exe"]["scan_result"], rows["b.EXE"]["scan_result"]) == ("SUSPICIOUS", "CLEAN")
    assert rows["a.exe"]["byte_entropy"] == pytest.approx(8.0) and rows["c.txt"]["byte_entropy"] == 0.0
    assert rows["d.txt"]["scan_result"] == "MALICIOUS"
