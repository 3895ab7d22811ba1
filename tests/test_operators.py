import json
import random

import pytest
from pyspark.sql import functions as F

from sievework.functions import dates, text
from sievework.operators import claims, content, copies, execution, relevance, rows
from sievework.plans import catalog, pages
from sievework.sources import records, sinks
from sievework.streaming import ingest

EVIDENCE = "ordinal bigint, evidence_id string, source_id string, connector string, title string, url string, publisher string, text string"


def test_url_forms(spark):
    urls = ["HTTPS://A.Example/x//y/?q=1#f", "https://a.example", "https://a.example/", "", None, "no scheme/path/", "https://u:p@www.A.example:8080/z"]
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    u = F.col("u")
    got = df.select(text.canonical_page(u), text.canonical_resource(u), text.canonical_posting(u), text.host(u)).collect()
    assert [tuple(r) for r in got] == [
        ("https://a.example/x//y", "https://a.example/x/y?q=1", "https://a.example/x//y", "a.example"),
        ("https://a.example", "https://a.example/", "https://a.example/", "a.example"), ("https://a.example", "https://a.example/", "https://a.example/", "a.example"),
        ("", "/", "/", ""), ("", "/", "/", ""), ("no scheme/path", "no scheme/path", "no scheme/path", ""),
        ("https://u:p@www.a.example:8080/z", "https://u:p@www.a.example:8080/z", "https://u:p@www.a.example:8080/z", "a.example"),
    ]


def test_tokens_and_white_space(spark):
    r = spark.createDataFrame([("C++ and  Café x.y-z C++", None, "")], "a string, b string, c string").select(text.tokens(F.col("a")), text.normal(F.col("a")), text.tokens(F.col("b")), text.normal(F.col("b")), text.tokens(F.col("c"))).first()
    assert list(r) == [["c++", "and", "caf", "x.y-z"], "c++ and café x.y-z c++", [], "", []]


def test_dates(spark):
    vals = ["2026-07-01", "2026-07-01T23:30:00-08:00", "20260701", "2026/07/01", "2026-02-30", "", None, "2026-07-01\n"]
    got = [r[0] and str(r[0]) for r in spark.createDataFrame([(v,) for v in vals], "v string").select(dates.iso_date(F.col("v"))).collect()]
    assert got == ["2026-07-01", "2026-07-01", None, None, None, None, None, "2026-07-01"]  # white space around a date is no part of it
    u = ["/2024/01/05/x-20250203", "/120240105/", "2024-13-01", None]
    assert [r[0] and str(r[0]) for r in spark.createDataFrame([(v,) for v in u], "v string").select(dates.latest_date(F.col("v"))).collect()] == ["2025-02-03", None, None, None]
    s, a = dates.freshness(F.col("d"), F.col("w"), F.col("o"), F.col("p"))
    df = spark.createDataFrame([("2026-07-31", 30, None, "2026-07-01"), ("2026-08-01", 30, "", "2026-07-01"), ("2026-06-01", 30, None, "2026-07-01"), ("2026-06-01", 30, None, None), ("2026-06-01", None, None, "2026-05-01")], "d string, w int, o string, p string")
    assert [tuple(r) for r in df.select(s, a).collect()] == [("fresh", 30), ("stale", 31), ("future_dated", -30), ("undated", None), ("not_applicable", None)]


def test_posts_are_dated_by_ids_of_any_length(spark):
    ids = [0, 1, (1 << 22) - 1, 1 << 22, (1 << 63) - 1, 1 << 63, (1 << 64) - 1, 5_999_999 * 4194304 * 1000000 - 1, (9_000_000_000_000_000_000 << 22) + 4194303, ((1 << 63) - 1 - 1288834974657 << 22) + 4194303, (1 << 63) - 1288834974657 << 22, 10**27, 10**60]
    want = [ms if (ms := (i >> 22) + 1288834974657) < 1 << 63 else None for i in ids]
    df = spark.createDataFrame([(k, f"https://x.com/a/status/{i}?s=20") for k, i in enumerate(ids)] + [(98, "https://y.com/a/status/1"), (99, None)], "k int, url string").orderBy("k")
    assert [r[0] for r in df.select(dates.snowflake_millis(dates.status_id(F.col("url")))).collect()] == [*want, None, None]
    # timestamps hold microseconds, so end a thousand times sooner
    assert [r[0] for r in df.select(F.unix_millis(dates.status_url_instant(F.col("url")))).collect()] == [ms if ms and ms < 1 << 53 else None for ms in want] + [None, None]


def test_post_dates_of_large_event_ids(spark, tmp_path):
    ids = [1, 3, 2199023, 2199024, 2199025, 5999999, 10_000_000_000, 9_000_000_000_001]
    spark.createDataFrame([(i,) for i in ids], "event_id bigint").write.parquet(str(tmp_path / "events.parquet"))
    got = {tuple(r) for r in pages.post_dates(spark, str(tmp_path)).collect()}
    assert got == {(i, i * 1000000 + 1288834974657) for i in ids if i % 3}


def test_snowflake_dates_of_large_event_ids(spark, tmp_path):
    ids = [-5, 0, 2199023, 2199024, 5999999, 10_000_000_000, 9_000_000_000_001]
    spark.createDataFrame([(i,) for i in [*ids, None]], "event_id bigint").write.parquet(str(tmp_path / "events.parquet"))
    got = {tuple(r) for r in catalog.snowflake_dates(spark, str(tmp_path)).collect()}
    assert got == {(i, i * 1000000 + 1288834974657) for i in ids} | {(None, None)}
    short = spark.createDataFrame([(-1,), (-4194305,), (4194303,)], "i bigint").select(F.unix_millis(dates.snowflake_instant(F.col("i"))))
    assert [r[0] - 1288834974657 for r in short.collect()] == [-1, -2, 0]


def test_positions_are_dense_on_any_partitioning(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k")).repartition(7)
    got = rows.with_position(df, ["k"], "n").collect()
    assert sorted((r["k"], r["n"]) for r in got) == [(i, i + 1) for i in range(1000)]
    assert rows.with_position(df.limit(0), ["k"], "n").count() == 0


def greedy(data):
    origins, contents, out = set(), set(), []
    for o, a, b in sorted(data):
        if a not in origins and b not in contents:
            origins.add(a)
            contents.add(b)
            out.append(o)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_independent_rows_equal_the_greedy_pass(spark, seed):
    r = random.Random(seed)
    data = [(i, f"o{r.randrange(12)}", f"c{r.randrange(12)}") for i in range(80)]
    got = copies.independent(spark.createDataFrame(data, "k bigint, o string, c string"), "k", "o", "c")
    assert sorted(x["k"] for x in got.collect()) == greedy(data)


def test_clusters_hot_key_nulls_and_ties(spark):
    data = [(i, None, "s", "web", f"t{i}" if i % 2 else None, "https://h.example/x?a=%d" % i, None, None) for i in range(300)] + [(300, "e", "s", "web", None, None, None, None), (301, "e", "s", "web", None, "", "", "")]
    df = spark.createDataFrame(data, EVIDENCE)
    got = copies.clusters(df).collect()
    assert [(r["copies"], r["first_ordinal"], r["titles"]) for r in got] == [(300, 0, "t1")]
    rep = copies.representatives(copies.keyed(df).select("copy_key", "ordinal", F.lit(1).alias("score"))).collect()
    assert sorted(r["ordinal"] for r in rep) == [0, 300, 301]
    assert copies.clusters(df.limit(0)).count() == 0


def test_relevance_preview_and_coverage(spark):
    data = [(0, "gpu supply", "GPU supply", "text", "h1"), (1, "gpu supply", "gpu", "", "h1"), (2, "gpu supply", None, None, None), (3, "", "x", "y", "h2"), (4, "gpu supply", "supply", "gpu", "h3")]
    df = spark.createDataFrame(data, "ordinal bigint, q string, t string, b string, e string")
    s = relevance.with_relevance(df, F.col("q"), F.col("t"), F.col("b"), F.col("e"), F.lit(None).cast("string"))
    assert [r["relevance"] for r in s.orderBy("ordinal").collect()] == [0.45, 0.225, 0.0, 0.0, 0.4]
    assert [r["ordinal"] for r in relevance.preview(s, "q", "e").orderBy("rank").collect()] == [0, 4]
    assert {r["q"]: r["status"] for r in relevance.facet_coverage(s, "q").collect()} == {"gpu supply": "covered", "": "missing"}


def test_claims_and_conflicts(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(["growth and decline", "growth", None, "", "nothing"])], "ordinal bigint, t string")
    got = {r["spec"]: (r["n_rows"], r["first_ordinals"], r["verdict"]) for r in claims.spec_counts(df, F.lower("t"), {"g": ("growth",), "d": ("decline",), "n": ("zzz",)}).collect()}
    assert got == {"g": (2, "0|1", "supported"), "d": (1, "0", "needs_more_evidence"), "n": (0, "", "missing")}
    assert [tuple(r) for r in claims.conflicts(df, F.lower("t"), {"x": (("growth",), ("decline",)), "y": (("growth",), ("zzz",))}).collect()] == [("x", 2, 1)]


def test_html_blocks_and_void_quirk():
    doc = "<nav>menu</nav><h1>Title</h1><p>One <b>two<br>three</b></p><table>out<tr><td>a</td><td>b</td></tr><tr><td> </td></tr></table><form><input></form><p>after</p>"
    assert content.parse_blocks(doc, strict_void=True) == [("Title", "Title"), ("Title", "One two three"), ("Title", "a | b"), ("Title", "after")]
    assert content.parse_blocks(doc) == [("Title", "Title"), ("Title", "One two three"), ("Title", "a | b")]
    assert content.parse_blocks("") == [] and content.parse_blocks("<" * 1000)


def test_inline_tags_part_words_and_tables_have_limits():
    assert content.parse_blocks("<p>a<b>b</b>c</p>") == [("", "a b c")]
    assert content.parse_blocks("<tr><td>no table</td></tr>") == [("", "no table")]
    cell = "<td>" + "x" * 600 + "</td>"
    blocks, tables = content.parse_html("<table>" + f"<tr>{cell * 25}</tr>" * 60 + "</table><table><tr><td></td></tr></table>")
    assert len(tables) == 1 and len(tables[0]) == 50 and {len(r) for r in tables[0]} == {20} and len(tables[0][0][0]) == 500 and len(blocks) == 50
    assert content.parse_html("<table><tr><td>lost</td></tr>")[1] == []


def test_extraction_by_media_type(spark):
    rows = [
        (1, b"<h2>H</h2><p>t</p>", "Text/HTML; charset=utf-8"), (2, b'{"b": [1, {"c": null}], "a": {"x": "y"}}', "application/ld+json"), (3, b"{bad", "application/json"), (4, b"a\n \nb", "text/plain"),
        (5, b"%PDF", "application/pdf"), (6, b"x", "image/png"), (7, None, "text/plain"), (8, b"x" * 2_000_001, "text/csv"), (9, b"<p></p>", None),
    ]
    df = spark.createDataFrame(rows, "k bigint, b binary, t string")
    got = {r["k"]: (r["text"] if r["k"] != 8 else len(r["text"]), r["valid"], r["reasons"], r["warnings"]) for r in content.extracted(df, "k", "b", "t").collect()}
    assert got == {
        1: ("H\nt", True, [], []), 2: ("b[0]: 1\nb[1].c: None\na.x: y", True, [], []), 3: ("", False, ["json_extraction_failed"], []), 4: ("a\nb", True, [], []), 5: ("", False, ["pdf_extractor_unavailable"], []),
        6: ("", False, ["unsupported_content_type"], []), 7: ("", False, ["empty_content"], []), 8: (2_000_000, True, [], ["content_truncated"]), 9: ("", False, ["unsupported_content_type"], []),
    }
    assert content.extract(b"%PDF", "application/pdf", lambda data: " page \n one ")[1] == "page one"
    assert content.extract(b"%PDF", "application/pdf", lambda data: 1 / 0)[5] == ["pdf_extraction_failed"]
    assert len(content.flat_json(list(range(500)))) == 200


def test_sanitation(spark):
    doc = {"title": "ok", "session_id": "s", "prior_authorization": "kept", "deep": [{"api_key": "k", "note": "token=abc1"}], "argv": ["/usr/bin/tool", "--token", "abc", "--password=xyz", "-v"]}
    df = spark.createDataFrame([(json.dumps(doc),), ("{bad",), (None,)], "d string")
    got = [r["s"] for r in df.select(content.sanitized(F.col("d")).alias("s")).collect()]
    assert json.loads(got[0]["clean"]) == {"title": "ok", "prior_authorization": "kept", "deep": [{"note": "token=[REDACTED]"}], "argv": ["tool", "--token", "[REDACTED]", "--password=[REDACTED]", "-v"]}
    assert got[0]["paths"] == ["argv[3]", "deep[0].api_key", "deep[0].note", "session_id"]
    assert all(x is None or (x["clean"] is None and x["paths"] is None) for x in got[1:])


def test_rows_for_analysis(spark):
    df = spark.createDataFrame([("p1", "T", [("H", "a" * 30), ("I", "b" * 30)], "old", 7), ("p2", None, [], "kept", 8), ("p3", "U", None, None, 9)], "id string, title string, b array<struct<heading string, text string>>, text string, extra int")
    got = [tuple(r[c] for c in ("parent_id", "chunk_index", "title", "text", "is_chunk", "extra")) for r in content.chunk_rows(df, "id", "title", "b", "text", 40).orderBy("extra", "chunk_index").collect()]
    assert got == [("p1", 1, "T — H", "a" * 30, True, 7), ("p1", 2, "T — I", "b" * 30, True, 7), (None, None, None, "kept", False, 8), (None, None, "U", None, False, 9)]


def test_chains_with_exclusions(spark):
    rows = [(1, "a", "s", "o1", "c1"), (2, "b", "s", "o1", "c2"), (3, "", "s", "o2", "c3"), (4, "d", "s", "o3", "c1"), (5, "a", "n", "o9", "c9"), (6, "e", "n", "o1", "c8"), (7, "f", "n", "o7", "c1"), (8, None, "n", "o8", "c7")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "k bigint, id string, side string, o string, c string, claim string")
    support = copies.independent(df.where("side = 's'"), "k", "o", "c", "id", "claim")
    oppose = copies.independent(df.where("side = 'n'"), "k", "o", "c", "id", "claim", support)
    assert [r["k"] for r in support.orderBy("k").collect()] == [1] and [r["k"] for r in oppose.orderBy("k").collect()] == [7]
    got = claims.chain_stances(support, oppose, spark.createDataFrame([("x",), ("y",)], "claim string"))
    assert sorted(tuple(r) for r in got.collect()) == [("x", 1, 1, "conflicted", "medium"), ("y", 0, 0, "needs_more_evidence", "low")]


def test_first_values_of_a_hot_key(spark):
    df = spark.range(20_000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("key"), "id")
    got = {r["key"]: (r["n"], r["values"]) for r in claims.first_values(df, ["key"], "id", "id", 12).where("key = 'hot' or key = '1'").collect()}
    assert got == {"hot": (6667, list(range(0, 36, 3))), "1": (1, [1])}


def packed(blocks, most):
    out = []
    for h, t in blocks:
        t = " ".join((t or "").split())
        while t:
            p, t = t[:most], t[most:]
            if out and len(out[-1][1]) + 1 + len(p) <= most:
                out[-1] = (out[-1][0], out[-1][1] + "\n" + p)
            else:
                out.append((h or "", p))
    return out


def test_chunks_equal_the_plain_packing(spark):
    r = random.Random(5)
    pages = [[(f"h{i}", "w" * r.randrange(0, 60) + " x") for i in range(r.randrange(0, 9))] for _ in range(30)] + [[], [(None, None)], [("h", "z" * 500)]]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(pages)], "k bigint, b array<struct<heading string, text string>>")
    got = {}
    for x in content.chunks(df, "k", "b", 50).orderBy("k", "chunk_index").collect():
        got.setdefault(x["k"], []).append((x["heading"], x["text"]))
    assert got == {i: p for i, b in enumerate(pages) if (p := packed(b, 50))}
    with pytest.raises(ValueError):
        content.chunks(df, "k", "b", 0)


def test_redaction_and_body_status(spark):
    v = ["Authorization: Bearer abc.def", "cookie: a=b; c=d", "https://x.example/?token=abc&y=1", "api_key = 'zzz'", "plain text", None, "tokens were counted"]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in v], "t string").select(content.redact(F.col("t"))).collect()]
    assert got == ["authorization=Bearer [REDACTED]", "cookie=[REDACTED]", "https://x.example/?token=[REDACTED]&y=1", "api_key=[REDACTED]", "plain text", None, "tokens were counted"]
    b = [None, "  ", "Verify you are human " + "x" * 3000, "verify you are human", "404 Not Found", "Loading… powered by x", "fine"]
    assert [r[0] for r in spark.createDataFrame([(x,) for x in b], "t string").select(content.body_status(F.col("t"))).collect()] == ["empty", "empty", "usable", "access_blocked", "not_found_or_closed", "javascript_shell", "usable"]


def test_redaction_has_all_passes(spark):
    want = {
        "set-cookie: a=b; c=d": "set-cookie=[REDACTED]",
        "authorization: Basic abc": "authorization=Basic [REDACTED]",
        "authorization=abc123 and more": "authorization=[REDACTED] and more",
        "sent bearer abc.def": "sent Bearer [REDACTED]",
        "/x?sid=abc&y=1": "/x?sid=[REDACTED]&y=1",
        "run --password hunter2 --token abc --depth 3": "run --password [REDACTED] --token [REDACTED] --depth 3",
        "auth: abc": "auth=[REDACTED]",
        "session_id=abc session=def": "session_id=[REDACTED] session=[REDACTED]",
        "storage_state=abc": "storage_state=[REDACTED]",
        "x-auth = abc": "x-auth=[REDACTED]",
        "github_pat_" + "a1" * 12: "[REDACTED]",
        "auth_type=basic": "auth_type=basic",
        "--prior-authorization yes": "--prior-authorization yes",
    }
    df = spark.createDataFrame([(x,) for x in want], "t string")
    assert {r["t"]: r["clean"] for r in df.select("t", content.redact(F.col("t")).alias("clean")).collect()} == want


def test_reconcile_and_fingerprint(spark):
    planned = spark.createDataFrame([(1,), (2,), (3,)], "query_id bigint")
    rec = spark.createDataFrame([(1, "error"), (1, "ok"), (2, "error"), (2, "error")], "query_id bigint, status string")
    assert {r["query_id"]: r["outcome"] for r in execution.reconcile(planned, rec, ("error",)).collect()} == {1: "executed", 2: "failed", 3: "skipped"}
    a = execution.fingerprint(rec, [F.col("query_id"), F.col("status")]).first()["fingerprint"]
    assert a == execution.fingerprint(rec.orderBy("status"), [F.col("query_id"), F.col("status")]).first()["fingerprint"] != execution.fingerprint(rec.limit(3), [F.col("query_id"), F.col("status")]).first()["fingerprint"]


def test_suffix_join_and_substitute(spark):
    r = spark.createDataFrame([(1, "a.b.example"), (2, "b.example"), (3, "other.example"), (4, None)], "ordinal bigint, host string")
    o = spark.createDataFrame([("b.example", "B"), ("a.b.example", "AB")], "domain string, owner string")
    assert {x["ordinal"]: x["owner"] for x in rows.join_by_suffix(r, "host", o, "domain").collect()} == {1: "AB", 2: "B"}
    kids = spark.createDataFrame([(2, 1)], "ordinal bigint, part int")
    assert sorted(((x["ordinal"], x["part"]) for x in rows.substitute(r, kids, "ordinal", "ordinal").collect()), key=repr) == [(1, None), (2, 1), (3, None), (4, None)]


def test_json_lines_and_payloads(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"title": "x", "url": "u", "more": 1}\n\n[1]\n{bad\n{"title": "y"}\n')
    good, bad = records.json_lines(spark, [str(tmp_path / "a.jsonl")])
    assert sorted(r["title"] for r in good.collect()) == ["x", "y"] and bad.count() == 2
    p = spark.createDataFrame([('{"results": [{"name": "n", "link": "l"}, {"title": {"login": "q"}}]}',), ("[{\"title\": \"t\"}]",), ('{"title": "o"}',), ("bad",)], "body string")
    assert sorted(r["item_title"] for r in records.payload_items(p, "body").collect()) == ["n", "o", "q", "t"]
    feed = spark.createDataFrame([('[{"id": "1", "text": "Dev", "hostedUrl": "u", "categories": {"location": "NY"}, "createdAt": 1709701037159}]',)], "body string")
    assert tuple(records.job_feed(feed, "body", "lever").first()) == ("1", "Dev", "u", "NY", True, "2024-03-06 04:57:17.159")
    assert records.manual(spark, [{"url": "u"}, {}, {"title": "t"}], 2).select("title").toPandas()["title"].tolist() == ["u", "Manual evidence 2"]


def test_sinks(spark, tmp_path):
    df = spark.range(100).select(F.col("id").alias("ordinal")).repartition(5)
    sinks.write_json_lines(df, str(tmp_path / "o"))
    lines = [x for f in sorted((tmp_path / "o").glob("part-*")) for x in f.read_text().split()]
    assert lines == ['{"ordinal":%d}' % i for i in range(100)]
    r = spark.createDataFrame([("k1", "ok", 1), ("k2", "failed", 2)], "cache_key string, status string, v int")
    sinks.write_cache(r, str(tmp_path / "c"))
    assert [x["cache_key"] for x in sinks.read_cache(spark, str(tmp_path / "c"), r, 1.5).collect()] == ["k1"]
    assert sinks.read_cache(spark, str(tmp_path / "none"), r).count() == 0
    assert sinks.reserve_folder(str(tmp_path), "run").endswith("run") and sinks.reserve_folder(str(tmp_path), "run").endswith("run--02")
    sinks.append_journal(str(tmp_path / "j"), {"a": 1, "at": 2})
    assert (tmp_path / "j").read_text() == '{"a": 1, "at": 2}\n'


def test_stream_drops_redeliveries(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("".join('{"ordinal": %d, "evidence_id": "e%d", "url": "https://h.example/p?x=%d", "captured_at": "2026-05-01T00:00:0%d"}\n' % (i, i % 3, i, i) for i in range(6)))
    q = ingest.first_deliveries(ingest.read(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("firsts").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("firsts").count() == 3


def test_json_documents_and_overlays(spark, tmp_path):
    sinks.write_json(spark, str(tmp_path / "state.json"), {"a": "é", "b": [1]})
    assert (tmp_path / "state.json").read_text() == '{\n  "a": "é",\n  "b": [\n    1\n  ]\n}\n'
    assert sinks.read_json(spark, str(tmp_path / "state.json")) == {"a": "é", "b": [1]} and sinks.read_json(spark, str(tmp_path / "none.json")) == {}
    for folder, name, doc in (("one", "a", '{"id": "x", "v": 1}'), ("one", "b", '{"id": "y", "v": 1}'), ("two", "a", '{"id": "x", "v": 2}'), ("two", "z", "[1]")):
        (tmp_path / folder).mkdir(exist_ok=True)
        (tmp_path / folder / f"{name}.json").write_text(doc)
    got = {r["id"]: json.loads(r["document"])["v"] for r in records.keyed_documents(spark, [str(tmp_path / "one"), str(tmp_path / "two")]).collect()}
    assert got == {"x": 2, "y": 1}


def test_comparison_sides(spark):
    cases = {"llm A vs. llm B frameworks": ["llm A", "llm B"], "a  VERSUS b compared to a": ["a", "b"], "one topic": [], "vs x": [], "": []}
    df = spark.createDataFrame([(x,) for x in cases], "t string")
    assert {r["t"]: r["s"] for r in df.select("t", text.comparison_sides(F.col("t")).alias("s")).collect()} == cases


def test_fetched_pages_carry_all_reasons(spark):
    rows = [(1, "<h1>T</h1><p>" + "word " * 40 + '</p><time datetime="2026-02-03">x</time>', "text/html", 200, "https://a.example/2026/01/01"), (2, "", "text/html", 404, "u"), (3, "plain " * 40, "text/plain", None, "https://a.example/20260105/x"), (4, None, None, None, None)]
    df = spark.createDataFrame(rows, "k bigint, b string, t string, s int, u string")
    got = {r["k"]: (r["valid"], r["reasons"], r["published"] and str(r["published"]["day"])) for r in content.fetched(df, "k", "b", "t", "s", "u").collect()}
    assert got == {1: (True, [], "2026-02-03"), 2: (False, ["empty_content", "http_status_404", "insufficient_text"], None), 3: (True, [], "2026-01-05"), 4: (False, ["unsupported_content_type"], None)}
