"""The queries of the core, each with the SQL that states the same where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sievework.functions import dates, text
from sievework.operators import claims, content, copies, execution, instants, relevance, rows, validity
from sievework.plans.registry import KEYED as _KEYED
from sievework.plans.registry import ORACLE, QUERIES, query
from sievework.plans.registry import SP as _SP
from sievework.plans.registry import base as _base
from sievework.plans.registry import host as _host
from sievework.plans.registry import normal as _normal
from sievework.plans.registry import page as _page
from sievework.plans.registry import part as _part
from sievework.plans.registry import slug as _slug
from sievework.plans.registry import squeeze as _squeeze
from sievework.plans.registry import tokens as _tokens
from sievework.plans.specs import CONFLICTS, ENTITIES, LABELS, SPECS
from sievework.session import materialise, table

FLAGSHIP = "representatives"

def _evidence(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "false_positive_evidence")


@query()
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    values = instants.pages_values(table(spark, d, "fetched_pages")).unionByName(instants.b1_values(table(spark, d, "b1_rows")))
    out = instants.normalise_instants(spark, values, table(spark, d, "sites")).where("micros is not null")
    return out.select("tbl", "ordinal", "field_name", instants.instant_text(F.col("micros")).alias("instant"))


@query("""
SELECT ordinal, row_number() OVER (ORDER BY ordinal) AS position, 'ev-' || lpad((row_number() OVER (ORDER BY ordinal))::VARCHAR, greatest(4, length((row_number() OVER (ORDER BY ordinal))::VARCHAR))::INTEGER, '0') AS evidence_ref,
 evidence_id AS source_evidence_id, coalesce(nullif(source_id, ''), nullif(connector, ''), 'unknown') AS source_id, coalesce(nullif(connector, ''), 'unknown') AS connector, coalesce(title, '') AS title, coalesce(url, '') AS url
FROM false_positive_evidence""")
def normalised_rows(spark: SparkSession, d: str) -> DataFrame:
    return rows.normalise(_evidence(spark, d))


@query(f"SELECT ordinal, length({_normal('title')}) AS title_chars, length({_normal('text')}) AS text_chars, sha256({_normal('text')}) AS content_hash FROM false_positive_evidence")
def normal_text(spark: SparkSession, d: str) -> DataFrame:
    n = text.normal
    return _evidence(spark, d).select("ordinal", F.length(n(F.col("title"))).cast("bigint").alias("title_chars"), F.length(n(F.col("text"))).cast("bigint").alias("text_chars"), text.content_hash(F.col("text")).alias("content_hash"))


@query(f"SELECT token, count(*) AS n_rows FROM (SELECT unnest({_tokens('text')}) AS token FROM false_positive_evidence) GROUP BY token")
def token_counts(spark: SparkSession, d: str) -> DataFrame:
    return _evidence(spark, d).select(F.explode(text.tokens(F.col("text"))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n_rows"))


@query(rf"""
SELECT ordinal, {_page('url')} AS page_url,
 {_base('url')} || CASE WHEN p = '' THEN '/' ELSE p END || CASE WHEN {_part('url', 4)} <> '' THEN '?' || {_part('url', 4)} ELSE '' END AS resource_url,
 {_base('url')} || CASE WHEN regexp_replace({_part('url', 3)}, '/+$', '') = '' THEN '/' ELSE regexp_replace({_part('url', 3)}, '/+$', '') END AS posting_url, {_host('url')} AS host
FROM (SELECT ordinal, url, regexp_replace(regexp_replace({_part('url', 3)}, '/+', '/', 'g'), '/$', '') AS p FROM false_positive_evidence)""")
def canonical_urls(spark: SparkSession, d: str) -> DataFrame:
    u = F.col("url")
    return _evidence(spark, d).select("ordinal", text.canonical_page(u).alias("page_url"), text.canonical_resource(u).alias("resource_url"), text.canonical_posting(u).alias("posting_url"), text.host(u).alias("host"))


@query(f"WITH {_KEYED} SELECT ordinal, copy_key FROM k")
def copy_keys(spark: SparkSession, d: str) -> DataFrame:
    return copies.keyed(_evidence(spark, d)).select("ordinal", "copy_key")


@query(f"""WITH {_KEYED}, n AS (SELECT copy_key, count(*) AS copies, min(ordinal) AS first_ordinal FROM k GROUP BY 1),
 c AS (SELECT *, row_number() OVER (ORDER BY copy_key) AS cluster FROM n),
 f AS (SELECT copy_key, ordinal, title, row_number() OVER (PARTITION BY copy_key ORDER BY ordinal) AS r FROM k)
SELECT cluster, c.copy_key, copies, first_ordinal, coalesce(string_agg(nullif(title, ''), '|' ORDER BY ordinal), '') AS titles FROM c JOIN f ON f.copy_key = c.copy_key AND r <= 3 WHERE copies > 1 GROUP BY ALL""")
def copy_clusters(spark: SparkSession, d: str) -> DataFrame:
    return copies.clusters(_evidence(spark, d))


def _score() -> F.Column:
    """A row's score in hundredths, by how well it is described."""
    confidence = F.coalesce(F.nullif(F.lower("source_confidence"), F.lit("")), F.lit("medium"))
    return (
        F.when(confidence == "high", 15).when(confidence == "medium_high", 10).when(confidence == "medium_low", -10).when(confidence == "low", -20).otherwise(0)
        + F.when(F.startswith("url", F.lit("https://")), 5).when(text.filled(F.col("url")) == "", -12).otherwise(0)
        + F.when(text.filled(F.col("title")) != "", 3).otherwise(-4)
        + F.when(F.length(F.coalesce("text", F.lit(""))) >= 240, 5).when(text.filled(F.col("text")) == "", -10).otherwise(0) + 50
    )


_SCORE = """(CASE coalesce(nullif(lower(source_confidence), ''), 'medium') WHEN 'high' THEN 15 WHEN 'medium_high' THEN 10 WHEN 'medium_low' THEN -10 WHEN 'low' THEN -20 ELSE 0 END
 + CASE WHEN url LIKE 'https://%' THEN 5 WHEN coalesce(url, '') = '' THEN -12 ELSE 0 END + CASE WHEN coalesce(title, '') <> '' THEN 3 ELSE -4 END
 + CASE WHEN length(coalesce(text, '')) >= 240 THEN 5 WHEN coalesce(text, '') = '' THEN -10 ELSE 0 END + 50)"""


@query(f"WITH {_KEYED}, s AS (SELECT copy_key, ordinal, {_SCORE} AS score FROM k) SELECT copy_key, ordinal, score FROM (SELECT *, row_number() OVER (PARTITION BY copy_key ORDER BY score DESC, ordinal) AS r FROM s) WHERE r = 1")
def representatives(spark: SparkSession, d: str) -> DataFrame:
    return copies.representatives(copies.keyed(_evidence(spark, d)).withColumn("score", _score()).select("copy_key", "ordinal", "score"))


@query(f"""WITH {_KEYED} SELECT count(*) AS n_rows, count(DISTINCT copy_key) AS n_unique, count(nullif(evidence_id, '')) - count(DISTINCT nullif(evidence_id, '')) AS id_collisions,
 sum({_SCORE})::BIGINT AS score_sum, sum(CASE WHEN {_SCORE} >= 72 THEN 1 ELSE 0 END)::BIGINT AS high_tier, sum(CASE WHEN {_SCORE} >= 45 AND {_SCORE} < 72 THEN 1 ELSE 0 END)::BIGINT AS medium_tier FROM k""")
def quality_report(spark: SparkSession, d: str) -> DataFrame:
    s = copies.keyed(_evidence(spark, d)).withColumn("score", _score()).select("copy_key", "score", F.nullif("evidence_id", F.lit("")).alias("id"))
    return s.agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("copy_key").alias("n_unique"), (F.count("id") - F.count_distinct("id")).alias("id_collisions"), F.sum("score").alias("score_sum"),
        F.sum(F.when(F.col("score") >= 72, 1).otherwise(0)).alias("high_tier"), F.sum(F.when(F.col("score").between(45, 71), 1).otherwise(0)).alias("medium_tier"),
    )


@query("SELECT coalesce(nullif(connector, ''), 'unknown') AS connector, source_confidence, count(*) AS n_rows FROM false_positive_evidence GROUP BY ALL")
def source_mix(spark: SparkSession, d: str) -> DataFrame:
    return _evidence(spark, d).groupBy(text.filled(F.col("connector"), F.lit("unknown")).alias("connector"), "source_confidence").agg(F.count(F.lit(1)).alias("n_rows"))


_ORIGIN = rf"""CASE WHEN coalesce(publisher, '') <> '' THEN 'publisher:' || {_slug('publisher')}
 WHEN {_host('url')} IN ('github.com', 'gitlab.com') AND len(list_filter(string_split({_part('url', 3)}, '/'), lambda p: p <> '')) >= 2 THEN 'repo:' || {_host('url')} || '/' || {_slug("list_filter(string_split(" + _part('url', 3) + ", '/'), lambda p: p <> '')[1]")} || '/' || {_slug("list_filter(string_split(" + _part('url', 3) + ", '/'), lambda p: p <> '')[2]")}
 WHEN {_host('url')} <> '' THEN 'host:' || {_host('url')} ELSE 'row:' || {_slug("coalesce(nullif(evidence_id, ''), 'unknown')")} END"""


@query(f"SELECT ordinal, {_ORIGIN} AS origin FROM false_positive_evidence")
def origins(spark: SparkSession, d: str) -> DataFrame:
    return _evidence(spark, d).select("ordinal", text.origin_key(F.col("url"), F.col("publisher"), F.col("evidence_id")).alias("origin"))


@query(f"""WITH RECURSIVE l AS MATERIALIZED (SELECT ordinal, {_ORIGIN} AS origin, left(sha256({_normal('text')}), 16) AS content, row_number() OVER (ORDER BY ordinal) AS k FROM false_positive_evidence),
 g AS (SELECT 0::BIGINT AS k, 0::BIGINT AS ordinal, ''::VARCHAR AS origin, []::VARCHAR[] AS origins, []::VARCHAR[] AS contents, false AS took
  UNION ALL SELECT k, ordinal, origin, CASE WHEN took THEN list_append(origins, origin) ELSE origins END, CASE WHEN took THEN list_append(contents, content) ELSE contents END, took
  FROM (SELECT l.*, g.origins, g.contents, NOT list_contains(g.origins, l.origin) AND NOT list_contains(g.contents, l.content) AS took FROM g JOIN l ON l.k = g.k + 1))
SELECT ordinal, origin FROM g WHERE took""")
def independent_rows(spark: SparkSession, d: str) -> DataFrame:
    r = _evidence(spark, d).select("ordinal", text.origin_key(F.col("url"), F.col("publisher"), F.col("evidence_id")).alias("origin"), F.substring(text.content_hash(F.col("text")), 1, 16).alias("content"))
    return copies.independent(r, "ordinal", "origin", "content").select("ordinal", "origin")


@query(f"SELECT source_id, count(*) AS n_rows, count(DISTINCT {_ORIGIN}) AS n_origins, count(*) >= 2 AND count(DISTINCT {_ORIGIN}) = 1 AS concentrated FROM false_positive_evidence GROUP BY 1")
def source_concentration(spark: SparkSession, d: str) -> DataFrame:
    r = _evidence(spark, d).select("source_id", text.origin_key(F.col("url"), F.col("publisher"), F.col("evidence_id")).alias("o"))
    return r.groupBy("source_id").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("o").alias("n_origins")).withColumn("concentrated", (F.col("n_rows") >= 2) & (F.col("n_origins") == 1))


def _iso(c: str) -> str:
    plain = rf"regexp_replace({c}, '^\s+|\s+$', '', 'g')"
    return rf"CASE WHEN regexp_matches({plain}, '{dates.ISO[:-1]}\z') THEN try_strptime(left({plain}, 10), '%Y-%m-%d')::DATE END"


@query(f"""SELECT ordinal, CASE WHEN window_days IS NULL THEN 'not_applicable' WHEN age IS NULL THEN 'undated' WHEN age < 0 THEN 'future_dated' WHEN age <= window_days THEN 'fresh' ELSE 'stale' END AS status,
 CASE WHEN window_days IS NOT NULL THEN age END AS age_days FROM (SELECT ordinal, window_days, date_diff('day', {_iso('published_at')}, {_iso('as_of')}) AS age FROM b1_rows)""")
def freshness_status(spark: SparkSession, d: str) -> DataFrame:
    status, age = dates.freshness(F.col("as_of"), F.col("window_days"), F.col("published_at"))
    return table(spark, d, "b1_rows").select("ordinal", status.alias("status"), age.cast("bigint").alias("age_days"))


@query("SELECT event_id, (event_id * 4194304 * 1000000 >> 22) + 1288834974657 AS made_ms FROM events")
def snowflake_dates(spark: SparkSession, d: str) -> DataFrame:
    ident = F.col("event_id").cast("decimal(19,0)") * F.lit(4194304) * F.lit(1000000)  # of more than 64 bits from 2,199,024 on
    return table(spark, d, "events").select("event_id", dates.snowflake_millis(ident).alias("made_ms"))


def _scored(spark: SparkSession, d: str) -> DataFrame:
    return relevance.with_relevance(table(spark, d, "b4_results"), F.col("topic"), F.col("title"), F.col("snippet"), F.col("host"), F.lit(None).cast("string"))


_COV = "coalesce(round(len(list_intersect(q, {0})) / nullif(len(q), 0)::DOUBLE, 6), 0)"
_REL = f"""r AS (SELECT *, round({_COV.format('t')} * 0.45 + {_COV.format('b')} * 0.35 + {_COV.format('e')} * 0.15, 6) AS relevance
 FROM (SELECT *, {_tokens('topic')} AS q, {_tokens('title')} AS t, {_tokens('snippet')} AS b, {_tokens('host')} AS e FROM b4_results))"""


@query(f"WITH {_REL} SELECT ordinal, relevance, array_to_string(list_sort(list_intersect(q, list_concat(t, b, e))), '|') AS matched_terms FROM r")
def row_relevance(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d).select("ordinal", "relevance", "matched_terms")


@query(f"""WITH {_REL}, f AS (SELECT topic, host, ordinal, relevance FROM r WHERE relevance > 0 QUALIFY row_number() OVER (PARTITION BY topic, host ORDER BY relevance DESC, ordinal) = 1)
SELECT topic, host, ordinal, relevance, row_number() OVER (PARTITION BY topic ORDER BY relevance DESC, ordinal) AS rank FROM f QUALIFY rank <= 20""")
def relevance_preview(spark: SparkSession, d: str) -> DataFrame:
    return relevance.preview(_scored(spark, d), "topic", "host")


@query(f"WITH {_REL} SELECT topic, count(*) AS rows_seen, sum(CASE WHEN relevance >= 0.15 THEN 1 ELSE 0 END)::BIGINT AS rows_relevant, min(CASE WHEN relevance >= 0.15 THEN ordinal END) AS first_relevant, CASE WHEN sum(CASE WHEN relevance >= 0.15 THEN 1 ELSE 0 END) > 0 THEN 'covered' ELSE 'missing' END AS status FROM r GROUP BY 1")
def facet_coverage(spark: SparkSession, d: str) -> DataFrame:
    return relevance.facet_coverage(_scored(spark, d), "topic")


@query(f"""WITH {_REL}, f AS (SELECT topic, host, ordinal, relevance FROM r WHERE relevance > 0 QUALIFY row_number() OVER (PARTITION BY topic, host ORDER BY relevance DESC, ordinal) = 1),
 p AS (SELECT ordinal, relevance FROM f QUALIFY row_number() OVER (PARTITION BY topic ORDER BY relevance DESC, ordinal) <= 20)
SELECT ordinal, relevance, part FROM (SELECT ordinal, relevance, 0 AS part FROM p UNION ALL SELECT ordinal, relevance, 1 FROM r WHERE ordinal NOT IN (SELECT ordinal FROM p)) ORDER BY part, relevance DESC, ordinal LIMIT 10""")
def key_rows(spark: SparkSession, d: str) -> DataFrame:
    scored = materialise(_scored(spark, d).select("topic", "host", "ordinal", "relevance"), "scored")
    return relevance.key_rows(relevance.preview(scored, "topic", "host"), scored)


_DOC = "lower(concat_ws(' ', title, text, publisher, connector))"


def _doc() -> F.Column:
    return F.lower(F.concat_ws(" ", "title", "text", "publisher", "connector"))


def _any(terms: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({_DOC}, '{t}')" for t in terms) + ")"


@query(" UNION ALL ".join(f"""SELECT '{s}' AS spec, count(*) AS n_rows, coalesce(array_to_string(list_sort(list(ordinal))[1:12], '|'), '') AS first_ordinals,
 CASE WHEN count(*) >= 2 THEN 'supported' WHEN count(*) > 0 THEN 'needs_more_evidence' ELSE 'missing' END AS verdict FROM false_positive_evidence WHERE {_any(t)}""" for s, t in SPECS.items()))
def claim_scores(spark: SparkSession, d: str) -> DataFrame:
    return claims.spec_counts(_evidence(spark, d), _doc(), SPECS)


@query("SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{s}' AS set_id, count(*) FILTER (WHERE {_any(a)}) AS n_support, count(*) FILTER (WHERE {_any(b)}) AS n_oppose FROM false_positive_evidence" for s, (a, b) in CONFLICTS.items()) + ") WHERE n_support > 0 AND n_oppose > 0")
def conflict_flags(spark: SparkSession, d: str) -> DataFrame:
    return claims.conflicts(_evidence(spark, d), _doc(), CONFLICTS)


@query("SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{e}' AS name, count(*) AS n_rows FROM false_positive_evidence WHERE contains({_DOC}, '{e.lower()}')" for e in ENTITIES) + ") WHERE n_rows > 0")
def entity_presence(spark: SparkSession, d: str) -> DataFrame:
    return claims.presence(_evidence(spark, d), _doc(), ENTITIES)


def _term_sql(t: str) -> str:
    if len(t) <= 4 and t.isascii():
        return f"regexp_matches(n, '(?:^|[^a-z0-9]){t}(?:[^a-z0-9]|$)')"
    return f"contains(n, '{t}')"


_LABEL_SCORES = {n: " + ".join(f"CASE WHEN {_term_sql(t)} THEN {max(1, len(t.split()))} ELSE 0 END" for t in terms) for n, terms in LABELS.items()}


@query(f"""SELECT ordinal, CASE WHEN top < 1 THEN 'generic' {' '.join(f"WHEN s_{n} = top THEN '{n}'" for n in LABELS)} END AS label, top AS score FROM (SELECT *, greatest({', '.join(f's_{n}' for n in LABELS)}) AS top
 FROM (SELECT ordinal, {', '.join(f'{x} AS s_{n}' for n, x in _LABEL_SCORES.items())} FROM (SELECT ordinal, {_normal("concat_ws(' ', title, text)")} AS n FROM false_positive_evidence)))""")
def topic_labels(spark: SparkSession, d: str) -> DataFrame:
    norm = F.col("norm")
    score = {n: sum((F.when(text.holds_term(norm, t), max(1, len(t.split()))).otherwise(0) for t in terms), F.lit(0)) for n, terms in LABELS.items()}
    return relevance.best_label(_evidence(spark, d).select("ordinal", text.normal(F.concat_ws(" ", "title", "text")).alias("norm")), "ordinal", score)


@query()
def html_blocks(spark: SparkSession, d: str) -> DataFrame:
    return content.html_blocks(table(spark, d, "adversarial_rows"), "ordinal", "body")


_B = f"trim(regexp_replace(lower(replace(coalesce(body, ''), '…', ' ')), '{_SP}', ' ', 'g'))"


@query(f"""SELECT ordinal, CASE WHEN b = '' THEN 'empty'
 WHEN contains(b, 'you''ve been blocked by network security') OR contains(b, 'you’ve been blocked by network security') OR (contains(b, '403 error') AND (contains(b, 'request blocked') OR contains(b, 'cloudfront'))) OR (contains(b, 'the request could not be satisfied') AND contains(b, 'cloudfront'))
  OR (length(b) <= 2000 AND ({' OR '.join(f"contains(b, '{m}')" for m in content.BLOCKED_MARKS)})) THEN 'access_blocked'
 WHEN {' OR '.join(f"contains(b, '{m}')" for m in content.CLOSED_MARKS)} THEN 'not_found_or_closed'
 WHEN length(b) <= 500 AND ((starts_with(b, 'loading') AND contains(b, 'powered by')) OR contains(b, 'enable javascript to view this page') OR contains(b, 'please enable javascript to continue')) THEN 'javascript_shell' ELSE 'usable' END AS body_status
FROM (SELECT ordinal, {_B} AS b FROM adversarial_rows)""")
def body_status(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "adversarial_rows").select("ordinal", content.body_status(F.col("body")).alias("body_status"))


@query()
def redacted_text(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "documents").select("doc_id", content.redact(F.col("text")).alias("clean"), "text")
    return r.select("doc_id", F.coalesce(F.col("clean") != F.col("text"), F.lit(False)).alias("had_secret"), F.length("clean").alias("n_chars"))


@query("SELECT event_id, json_extract_string(props, '$.' || k) AS value, k AS key FROM (SELECT event_id, props, unnest(json_keys(props)) AS k FROM events WHERE json_valid(props)) ORDER BY 1")
def json_fields(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", F.explode(F.from_json("props", "map<string,string>")).alias("key", "value"))
    return e.select("event_id", "key", "value")


@query("SELECT event_type AS status, count(*) AS n_records FROM events GROUP BY 1")
def execution_status_counts(spark: SparkSession, d: str) -> DataFrame:
    return execution.status_counts(table(spark, d, "events").select(F.col("event_type").alias("status")))


@query("""SELECT c_custkey AS query_id, count(event_id) AS n_records, CASE WHEN count(event_id) = 0 THEN 'skipped' WHEN bool_and(event_type = 'error') THEN 'failed' ELSE 'executed' END AS outcome
FROM customer LEFT JOIN events ON user_id = c_custkey GROUP BY 1""")
def query_reconciliation(spark: SparkSession, d: str) -> DataFrame:
    planned = table(spark, d, "customer").select(F.col("c_custkey").alias("query_id"))
    records = table(spark, d, "events").select(F.col("user_id").alias("query_id"), F.col("event_type").alias("status"))
    return execution.reconcile(planned, records, ("error",))


@query(f"SELECT DISTINCT {_page('url')} AS page_url FROM b4_results WHERE {_page('url')} NOT IN (SELECT {_page('url')} FROM fetched_pages WHERE url IS NOT NULL) AND {_page('url')} <> ''")
def unfetched_urls(spark: SparkSession, d: str) -> DataFrame:
    key = text.canonical_page(F.col("url")).alias("page_url")
    return table(spark, d, "b4_results").select(key).where("page_url <> ''").distinct().join(table(spark, d, "fetched_pages").where("url is not null").select(key), "page_url", "left_anti")


@query(r"""SELECT ordinal, domain, publisher FROM (SELECT e.ordinal, s.domain, s.publisher, row_number() OVER (PARTITION BY e.ordinal ORDER BY length(s.domain) DESC) AS r
FROM b4_results e JOIN (SELECT regexp_replace(host, '^(?:www|news|docs|jobs)\.', '') AS domain, min(publisher) AS publisher FROM sites GROUP BY 1) s ON e.host = s.domain OR ends_with(e.host, '.' || s.domain)) WHERE r = 1""")
def host_owners(spark: SparkSession, d: str) -> DataFrame:
    owners = table(spark, d, "sites").groupBy(F.regexp_replace("host", r"^(?:www|news|docs|jobs)\.", "").alias("domain")).agg(F.min("publisher").alias("publisher"))
    return rows.join_by_suffix(table(spark, d, "b4_results").select("ordinal", "host"), "host", owners, "domain").select("ordinal", "domain", "publisher")


@query("SELECT o_orderkey, (SELECT arg_max(c_mktsegment, c_custkey) FROM customer c WHERE c.c_nationkey = n.c_nationkey) AS c_mktsegment FROM orders LEFT JOIN customer n ON o_custkey = n.c_custkey")
def last_per_key_lookup(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    o = table(spark, d, "orders").join(c.select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey", "left")
    return rows.last_value_lookup(o, "c_nationkey", c, "c_custkey", "c_mktsegment").select("o_orderkey", "c_mktsegment")


@query("SELECT o_custkey, o_orderkey, o_orderstatus FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1")
def first_per_identity(spark: SparkSession, d: str) -> DataFrame:
    first = F.min_by(F.struct("o_orderkey", "o_orderstatus"), F.struct("o_orderdate", "o_orderkey"))
    return table(spark, d, "orders").groupBy("o_custkey").agg(first.alias("f")).select("o_custkey", "f.o_orderkey", "f.o_orderstatus")


@query(r"""SELECT ordinal, i - 1 AS position, u AS found_url FROM (SELECT ordinal, unnest(l) AS u, generate_subscripts(l, 1) AS i
FROM (SELECT ordinal, list_transform(regexp_extract_all(text, 'https?://[^\s<>"''()\[\]]+'), lambda u: regexp_replace(u, '[.,;:!?]+$', '')) AS l FROM false_positive_evidence))
QUALIFY row_number() OVER (PARTITION BY ordinal, u ORDER BY i) = 1""")
def written_urls(spark: SparkSession, d: str) -> DataFrame:
    return _evidence(spark, d).select("ordinal", F.posexplode(text.found_urls(F.col("text"))).alias("position", "found_url")).withColumn("position", F.col("position").cast("bigint"))


@query()
def progress_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    return execution.fingerprint(_evidence(spark, d), [text.canonical_page(F.col("url")), text.content_hash(F.col("text"))])


def _strip(c: str) -> str:
    out = f"regexp_replace(coalesce({c}, ''), '<[^>]*>', ' ', 'g')"
    for entity, ch in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
        out = f"replace({out}, '{entity}', '{ch}')"
    return f"trim(regexp_replace({out}, '{_SP}', ' ', 'g'))"


@query(f"SELECT ordinal, {_strip('body')} AS plain FROM adversarial_rows")
def tagless_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "adversarial_rows").select("ordinal", text.without_tags(F.col("body")).alias("plain"))


@query(f"SELECT ordinal, coalesce(nullif(regexp_replace(regexp_replace(lower(coalesce(topic, '')), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), ''), 'facet') AS facet, left({_squeeze('topic')}, 120) AS short FROM b4_results")
def topic_slugs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "b4_results").select("ordinal", text.facet_slug(F.col("topic")).alias("facet"), text.compact(F.col("topic")).alias("short"))


def _sql_reasons() -> str:
    t, kind = _normal("body"), "trim(split_part(lower(coalesce(content_type, '')), ';', 1))"
    count = lambda marks: "(" + " + ".join(f"contains(t, '{m}')::INT" for m in marks) + ")"
    known = " OR ".join(f"starts_with(kind, '{p}')" for p in validity.TEXT_TYPES)
    p, f = count(validity.LOGIN_PHRASES), count(validity.LOGIN_FIELDS)
    paths = ", ".join(f"'{x}'" for x in validity.LOGIN_PATHS)
    each = [
        "CASE WHEN status >= 400 THEN 'http_status_' || status END", f"CASE WHEN kind <> '' AND NOT ({known}) THEN 'unsupported_content_type_' || kind END",
        *[f"CASE WHEN contains(t, '{m.replace(chr(39), chr(39) * 2)}') THEN '{r}' END" for r, m in validity.BLOCK_MARKS],
        f"CASE WHEN (list_has_any(string_split(lower({_part('url', 3)}), '/'), [{paths}]) AND {p} > 0) OR {p} >= 2 OR ({p} > 0 AND {f} >= 3) THEN 'login_wall' END",
        "CASE WHEN length(t) < 1000 AND (contains(t, 'complete the captcha') OR contains(t, 'captcha challenge')) THEN 'captcha' END", f"CASE WHEN length(t) < {validity.LEAST_CHARS} THEN 'insufficient_text' END",
    ]
    return f"SELECT ordinal, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), '|') AS reasons FROM (SELECT ordinal, list_filter([{', '.join(each)}], lambda x: x IS NOT NULL) AS l FROM (SELECT *, {t} AS t, {kind} AS kind FROM adversarial_rows))"


@query(_sql_reasons())
def invalid_reasons(spark: SparkSession, d: str) -> DataFrame:
    r = validity.with_reasons(table(spark, d, "adversarial_rows"), "status", "content_type", "body", "url")
    return r.select("ordinal", F.array_join("reasons", "|").alias("reasons"))


@query("""SELECT host, count(*) AS n_rows, CASE min(CASE network_status WHEN 'rate_limit' THEN 1 WHEN 'robots_denied' THEN 2 WHEN 'retry_exhausted' THEN 3 ELSE 4 END)
 WHEN 1 THEN 'rate_limit' WHEN 2 THEN 'robots_denied' WHEN 3 THEN 'retry_exhausted' ELSE 'ready' END AS outcome FROM fetched_pages GROUP BY 1""")
def host_outcomes(spark: SparkSession, d: str) -> DataFrame:
    return validity.host_outcomes(table(spark, d, "fetched_pages"), "host", "network_status")


@query("SELECT evidence_id, max(ordinal) AS ordinal, arg_max(source_id, ordinal) AS source_id FROM false_positive_evidence GROUP BY 1")
def last_delivery(spark: SparkSession, d: str) -> DataFrame:
    r = _evidence(spark, d).groupBy("evidence_id").agg(F.max_by(F.struct("ordinal", "source_id"), "ordinal").alias("r"))
    return r.select("evidence_id", "r.ordinal", "r.source_id")


@query("SELECT source_id, count(DISTINCT publisher) AS n_publishers, count(*) AS n_rows FROM false_positive_evidence GROUP BY 1 HAVING count(DISTINCT publisher) > 1")
def spread_sources(spark: SparkSession, d: str) -> DataFrame:
    return _evidence(spark, d).groupBy("source_id").agg(F.count_distinct("publisher").alias("n_publishers"), F.count(F.lit(1)).alias("n_rows")).where("n_publishers > 1")


@query("SELECT ordinal, len(list_filter(string_split_regex(text, '\\r\\n|[\\n\\r]'), lambda l: trim(l) <> '')) AS n_lines FROM fetched_pages WHERE text <> ''".replace("\\\\", "\\"))
def text_lines(spark: SparkSession, d: str) -> DataFrame:
    kept = F.filter(F.split("text", r"\r\n|[\n\r]"), lambda x: F.trim(x) != "")
    return table(spark, d, "fetched_pages").where("text <> ''").select("ordinal", F.size(kept).cast("bigint").alias("n_lines"))


@query(f"SELECT topic, ordinal, page_url, row_number() OVER (PARTITION BY topic ORDER BY result_rank, ordinal) AS position FROM (SELECT topic, ordinal, result_rank, {_page('url')} AS page_url FROM b4_results WHERE url IS NOT NULL QUALIFY row_number() OVER (PARTITION BY topic, {_page('url')} ORDER BY result_rank, ordinal) = 1) QUALIFY position <= 10")
def next_candidates(spark: SparkSession, d: str) -> DataFrame:
    page = text.canonical_page(F.col("url")).alias("page_url")
    first = table(spark, d, "b4_results").where("url is not null").select("topic", "ordinal", "result_rank", page).groupBy("topic", "page_url").agg(F.min(F.struct("result_rank", "ordinal")).alias("r"))
    n = F.row_number().over(Window.partitionBy("topic").orderBy("result_rank", "ordinal"))
    return first.select("topic", "r.ordinal", "r.result_rank", "page_url").withColumn("position", n).where("position <= 10").drop("result_rank")


from sievework.plans import evidence as _evidence_queries, pages as _page_queries, records as _record_queries  # noqa: E402, F401  register their queries
