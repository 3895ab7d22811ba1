import datetime

from pyspark.sql import functions as F

from sievework.functions import dates, text
from sievework.operators import validity


def test_reasons_in_order(spark):
    long = "a calm text " * 20
    cases = [
        (200, "text/html; charset=utf-8", long, "https://a.example/x", ""), (404, None, long, None, "http_status_404"), (200, "image/png", long, "", "unsupported_content_type_image/png"),
        (200, "text/html", long + "Verify you are  human", "", "human_verification"), (200, "text/html", "sign in to continue", "https://a.example/login", "login_wall|insufficient_text"),
        (200, "text/html", long + "continue with google", "https://a.example/loginx", ""), (503, "text/html", None, None, "http_status_503|insufficient_text"), (None, "", long + "complete the captcha", None, "captcha"),
    ]
    df = spark.createDataFrame([c[:4] for c in cases], "s int, k string, t string, u string")
    got = validity.with_reasons(df, "s", "k", "t", "u").select(F.array_join("reasons", "|")).collect()
    assert [r[0] for r in got] == [c[4] for c in cases]


def test_page_dates_by_precedence(spark):
    ld = '<script type="application/ld+json">[{"a": {"datePublished": "2026-03-01"}}, {"dateModified": "2026-04-01T10:00:00Z"}]</script><script type="application/ld+json">{bad</script>'
    rows = [
        (1, ld + '<meta name="date" content="2026-02-01">', "2026-05-05", "u"), (2, ld, None, "u"), (3, '<meta property="article:published_time" content="2026-02-02"><meta name="last-modified" content="2026-02-03">', "", "u"),
        (4, '<meta name="date" content="nonsense"><time datetime="2026-01-01">x</time>', None, "/2025/01/01/"), (5, "", None, "https://a.example/2025/01/02/x"), (6, None, None, None),
    ]
    df = spark.createDataFrame(rows, "k bigint, body string, native string, url string")
    none = (None, None)
    pair = lambda x: (x["day"], x["source"]) if x else none
    got = {r["k"]: (*pair(r["published"]), r["updated"] and r["updated"]["day"]) for r in validity.page_dates(df, "k", "body", "url", ["native"]).collect()}
    day = datetime.date
    assert got == {
        1: (day(2026, 5, 5), "connector_native", day(2026, 4, 1)), 2: (day(2026, 3, 1), "json_ld", day(2026, 4, 1)), 3: (day(2026, 2, 2), "html_meta", day(2026, 2, 3)),
        4: (day(2026, 1, 1), "time_element", None), 5: (day(2025, 1, 2), "url_pattern", None), 6: (None, None, None),
    }


def test_observed_dates_and_freshness(spark):
    rows = [(1, "2026-01-05", None, None, [[["x", "until 2026/02/03"], ["20260301", None]]], 30), (2, "2026-01-05", "2026-03-30", None, None, 30), (3, None, None, "2026-04-01T23:00:00-0500", None, 30), (4, None, None, None, None, 30), (5, "2027-01-01", None, None, None, 30), (6, "2026-01-05", None, None, None, None)]
    df = spark.createDataFrame(rows, "k bigint, p string, o string, u string, t array<array<array<string>>>, w int").withColumn("url", F.lit(""))
    dated = validity.page_dates(df, "k", None, "url", ["p"], ["u"], ["o"], "t").join(df.select("k", "w"), "k")
    got = {r["k"]: (r["date_field"], r["age_days"], r["status"]) for r in validity.with_freshness(dated, F.lit("2026-03-31").cast("date"), F.col("w")).collect()}
    assert got == {1: ("observed_at", 30, "fresh"), 2: ("observed_at", 1, "fresh"), 3: ("updated_at", -1, "future_dated"), 4: (None, None, "undated"), 5: ("published_at", -276, "future_dated"), 6: (None, None, "not_applicable")}


def test_written_forms_of_dates(spark):
    cases = [("2026-01-05T23:30-0500", "2026-01-05", "2026-01-06"), ("2026-01-05 0130Z", "2026-01-05", "2026-01-05"), ("2026-01-05T01+03:00", "2026-01-05", "2026-01-04"), (" 2026-01-05\n", "2026-01-05", "2026-01-05"), ("2026-02-30", None, None), ("2026-01-05T25:00", None, None), ("5/1/2026", None, None), ("", None, None), (None, None, None)]
    df = spark.createDataFrame([(c[0],) for c in cases], "t string")
    got = df.select(dates.iso_date(F.col("t")).cast("string"), dates.utc_date(F.col("t")).cast("string"), dates.recency(F.col("t"), F.lit("2026-02-01").cast("date"))).collect()
    assert [tuple(r) for r in got] == [(*c[1:], 8.0 if c[1] else 0.0) for c in cases]


def test_text_helpers(spark):
    df = spark.createDataFrame([("llm A vs. llm B", "access-token", "<p>a &amp; b&eacute;</p>"), ("one topic", "monkey", None)], "c string, k string, h string")
    got = df.select(validity.secret_key(F.col("k")), text.without_tags(F.col("h")), text.facet_slug(F.col("c"))).collect()
    assert [list(r) for r in got] == [[True, "a & bé", "llm_a_vs_llm_b"], [False, "", "one_topic"]]


def test_addresses_that_may_be_shown(spark):
    cases = {"https://U:p@A.example/x?q=1": ("", "https://a.example/x"), "HTTP://A.example.:80": ("http://a.example/", "http://a.example."), "https://a.example:8443/p#f": ("https://a.example:8443/p", "https://a.example:8443/p"), "ftp://a.example/": ("", "ftp://a.example/"), "": ("", "")}
    df = spark.createDataFrame([(u,) for u in cases], "u string")
    got = {r[0]: tuple(r[1:]) for r in df.select("u", text.public_url(F.col("u")), F.regexp_replace(text.shown_url(F.col("u")), ":80$", "")).collect()}
    assert got == cases
