"""Queries on pages: dates and freshness, extraction, chunks, addresses, and what must not be shown."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.functions import dates, text
from sievework.operators import content, relevance, rows, validity
from sievework.plans.registry import base, part, query, squeeze, tokens
from sievework.session import table

_ISO = dates.ISO.replace("$", r"\z")


def _iso(c: str) -> str:
    plain = rf"regexp_replace({c}, '^\s+|\s+$', '', 'g')"
    return f"CASE WHEN regexp_matches({plain}, '{_ISO}') THEN try_strptime(left({plain}, 10), '%Y-%m-%d')::DATE END"


def _utc(c: str) -> str:
    plain = rf"regexp_replace(regexp_replace({c}, '^\s+|\s+$', '', 'g'), ' ', 'T')"
    return f"CASE WHEN {_iso(c)} IS NOT NULL THEN (try_cast({plain} AS TIMESTAMPTZ) AT TIME ZONE 'UTC')::DATE END"


_DAY = r"20\d{2}(?:--|//)(?:0[1-9]|1[0-2])(?:--|//)(?:0[1-9]|[12]\d|3[01])|20\d{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])"


def _latest(c: str) -> str:
    """The SQL of dates.latest_date: all but digits is doubled, so that a date's neighbours can be looked at without being used up."""
    found = rf"regexp_extract_all(regexp_replace(coalesce({c}, ''), '(\D)', '\1\1', 'g'), '(?:^|\D)({_DAY})(?:\D|$)', 1)"
    return f"list_max(list_filter(list_transform({found}, lambda x: try_strptime(regexp_replace(x, '[-/]', '', 'g'), '%Y%m%d')::DATE), lambda x: x IS NOT NULL))"


@query(f"SELECT ordinal, {_latest('url')} AS in_url, {_latest('published_at')} AS in_date_field FROM fetched_pages")
def url_dates(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "fetched_pages").select("ordinal", dates.latest_date(F.col("url")).alias("in_url"), dates.latest_date(F.col("published_at")).alias("in_date_field"))


_AS_OF = "DATE '2026-04-30'"
_DATED = f"""dated AS (SELECT ordinal, window_days, {_iso('published_at')} AS own_p, {_latest('url')} AS url_p, {_iso('updated_at')} AS own_u, {_iso('observed_at')} AS own_o, {_latest('flat')} AS table_o
 FROM (SELECT *, CASE WHEN ordinal % 4 <> 0 THEN (ordinal % 4) * 300 END AS window_days, array_to_string(flatten(flatten(page_tables)), ' | ') AS flat FROM fetched_pages)),
 picked AS (SELECT *, coalesce(own_p, url_p) AS published, CASE WHEN own_p IS NOT NULL THEN 'connector_native' WHEN url_p IS NOT NULL THEN 'url_pattern' END AS p_source, coalesce(own_o, table_o) AS observed,
  CASE WHEN own_o IS NOT NULL THEN 'connector_native' WHEN table_o IS NOT NULL THEN 'table_observation' END AS o_source FROM dated)"""


def _dated(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "fetched_pages").withColumn("window_days", F.expr("CASE WHEN ordinal % 4 <> 0 THEN cast(ordinal % 4 AS int) * 300 END"))
    found = validity.page_dates(pages, "ordinal", None, "url", ["published_at"], ["updated_at"], ["observed_at"], "page_tables")
    return found.withColumn("window_days", F.expr("CASE WHEN ordinal % 4 <> 0 THEN cast(ordinal % 4 AS int) * 300 END"))


@query(f"WITH {_DATED} SELECT ordinal, published, p_source AS published_source, CASE p_source WHEN 'connector_native' THEN 'high' WHEN 'url_pattern' THEN 'low' END AS published_confidence, own_u AS updated, observed, o_source AS observed_source, CASE o_source WHEN 'connector_native' THEN 'high' WHEN 'table_observation' THEN 'medium' END AS observed_confidence FROM picked")
def temporal_metadata(spark: SparkSession, d: str) -> DataFrame:
    return _dated(spark, d).select(
        "ordinal", F.col("published.day").alias("published"), F.col("published.source").alias("published_source"), F.col("published.confidence").alias("published_confidence"), F.col("updated.day").alias("updated"),
        F.col("observed.day").alias("observed"), F.col("observed.source").alias("observed_source"), F.col("observed.confidence").alias("observed_confidence"),
    )


@query(f"""WITH {_DATED}, w AS (SELECT *, CASE WHEN window_days IS NOT NULL THEN coalesce(observed, published, own_u) END AS day FROM picked)
SELECT ordinal, CASE WHEN window_days IS NULL THEN NULL WHEN observed IS NOT NULL THEN 'observed_at' WHEN published IS NOT NULL THEN 'published_at' WHEN own_u IS NOT NULL THEN 'updated_at' END AS date_field, day AS date, date_diff('day', day, {_AS_OF})::INTEGER AS age_days,
 CASE WHEN window_days IS NULL THEN 'not_applicable' WHEN day IS NULL THEN 'undated' WHEN day > {_AS_OF} THEN 'future_dated' WHEN date_diff('day', day, {_AS_OF}) <= window_days THEN 'fresh' ELSE 'stale' END AS status FROM w""")
def page_freshness(spark: SparkSession, d: str) -> DataFrame:
    return validity.with_freshness(_dated(spark, d), F.expr(_AS_OF), F.col("window_days")).select("ordinal", "date_field", "date", "age_days", "status")


@query(rf"""SELECT ordinal, u AS ranking_date, CASE WHEN regexp_matches(h, '^\d{{4}}-\d{{2}}-\d{{2}}\z') THEN try_strptime(h, '%Y-%m-%d')::DATE END AS target_date, (u + INTERVAL 30 DAY)::DATE AS valid_until,
 CASE WHEN age <= 30 THEN 8.0 WHEN age <= 180 THEN 6.0 WHEN age <= 365 THEN 4.0 WHEN age <= 730 THEN 2.0 ELSE 0.0 END::DOUBLE AS recency FROM (SELECT *, date_diff('day', u, as_of::DATE) AS age FROM (SELECT *, {_utc('published_at')} AS u, left(regexp_replace(published_at, '^\s+', ''), 10) AS h FROM b1_rows))""")
def written_dates(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("published_at")
    return table(spark, d, "b1_rows").select("ordinal", dates.utc_date(c).alias("ranking_date"), dates.leading_date(c).alias("target_date"), dates.valid_until(dates.utc_date(c), 30).alias("valid_until"), dates.recency(c, dates.iso_date(F.col("as_of"))).alias("recency"))


@query("SELECT event_id, (event_id * 4194304 * 1000000 >> 22) + 1288834974657 AS made_ms FROM events WHERE event_id % 3 <> 0")
def post_dates(spark: SparkSession, d: str) -> DataFrame:
    ident = (F.col("event_id").cast("decimal(19,0)") * F.lit(4194304) * F.lit(1000000)).cast("string")  # of more than 64 bits from 2,199,024 on
    url = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("https://y.com/a/status/"), ident)).otherwise(F.concat(F.lit("https://WWW.X.com/some.one/status/"), ident, F.lit("?s=20")))
    posts = table(spark, d, "events").select("event_id", dates.status_id(url).alias("post")).where("post is not null")
    return posts.select("event_id", dates.snowflake_millis(F.col("post")).alias("made_ms"))


@query()
def page_dates(spark: SparkSession, d: str) -> DataFrame:
    found = validity.page_dates(table(spark, d, "adversarial_rows"), "ordinal", "body", "url")
    return found.select("ordinal", F.col("published.day").alias("published"), F.col("published.source").alias("source"), F.col("published.confidence").alias("confidence"), F.col("updated.day").alias("updated"))


# --- extraction -----------------------------------------------------------------------------------------------------


@query()
def extracted_pages(spark: SparkSession, d: str) -> DataFrame:
    e = content.extracted(table(spark, d, "adversarial_rows"), "ordinal", "body", "content_type")
    return e.select("ordinal", "media_type", F.length("text").alias("n_chars"), F.size("blocks").alias("n_blocks"), F.size("tables").alias("n_tables"), "valid", F.array_join("reasons", "|").alias("reasons"))


@query()
def fetched_content(spark: SparkSession, d: str) -> DataFrame:
    f = content.fetched(table(spark, d, "adversarial_rows"), "ordinal", "body", "content_type", "status", "url")
    return f.select("ordinal", F.length("text").alias("n_chars"), F.size("blocks").alias("n_blocks"), "valid", F.array_join("reasons", "|").alias("reasons"), F.col("published.day").alias("published"), F.col("updated.day").alias("updated"))


@query("SELECT event_id, k || ': ' || json_extract_string(props, '$.' || k) AS line FROM (SELECT event_id, props, unnest(json_keys(props)) AS k FROM events WHERE json_valid(props))")
def json_lines(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.explode(content.json_lines(F.col("props"))).alias("line"))


_LINE_SP = r"[\x{09}-\x{0D}\x{1C}-\x{20}\x{85}\p{Z}]+"


@query(f"""SELECT ordinal, i AS line_index, line FROM (SELECT ordinal, unnest(l) AS line, generate_subscripts(l, 1) - 1 AS i FROM
 (SELECT ordinal, list_filter(string_split_regex(text, '\\r\\n|[\\n\\r\\x{{0B}}\\x{{0C}}\\x{{1C}}-\\x{{1E}}\\x{{85}}\\x{{2028}}\\x{{2029}}]'), lambda x: trim(regexp_replace(x, '{_LINE_SP}', ' ', 'g')) <> '') AS l FROM fetched_pages WHERE text <> ''))""")
def page_lines(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "fetched_pages").where("text <> ''").select("ordinal", F.posexplode(content.text_lines(F.col("text"))).alias("line_index", "line")).withColumn("line_index", F.col("line_index").cast("bigint"))


@query()
def page_chunks(spark: SparkSession, d: str) -> DataFrame:
    return content.chunks(table(spark, d, "fetched_pages"), "ordinal", "content_blocks").select("ordinal", "chunk_index", "heading", "chunk_id", F.length("text").alias("n_chars"))


@query()
def analysis_rows(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "fetched_pages").select("ordinal", F.concat(F.lit("page-"), "ordinal").alias("evidence_id"), F.get("content_blocks", F.lit(0))["text"].alias("title"), "content_blocks", "text", "url", "http_status")
    return content.chunk_rows(pages, "evidence_id", "title", "content_blocks", "text").select("ordinal", "evidence_id", "parent_id", "chunk_index", "is_chunk", "title", F.length("text").alias("n_chars"))


@query("SELECT o_orderkey, 'order' AS kind FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 30) UNION ALL SELECT l_orderkey, 'line' FROM lineitem WHERE l_quantity > 30")
def substituted_rows(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").where("l_quantity > 30").select(F.col("l_orderkey").alias("o_orderkey"), F.lit("line").alias("kind"))
    return rows.substitute(table(spark, d, "orders").select("o_orderkey", F.lit("order").alias("kind")), lines, "o_orderkey", "o_orderkey")


# --- addresses ------------------------------------------------------------------------------------------------------

_SHAPED = """x AS (SELECT ordinal, publisher, evidence_id, CASE ordinal % 6 WHEN 0 THEN url WHEN 1 THEN replace(url, '://', '://user:pw@') WHEN 2 THEN regexp_replace(url, '^(https?://[^/?#]+)', '\\1:443') WHEN 3 THEN regexp_replace(url, '^https?://[^/?#]+', 'https://www.x.com') WHEN 4 THEN regexp_replace(url, '^(https?://[^/?#]+)', '\\1:8080') ELSE upper(url) END AS u FROM false_positive_evidence)""".replace("\\\\", "\\")


def _shaped(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "false_positive_evidence")
    u, k = F.col("url"), F.col("ordinal") % 6
    at = lambda to: F.regexp_replace(u, "^(https?://[^/?#]+)", to)
    made = F.when(k == 0, u).when(k == 1, F.replace(u, F.lit("://"), F.lit("://user:pw@"))).when(k == 2, at("$1:443")).when(k == 3, at("https://www.x.com")).when(k == 4, at("$1:8080")).otherwise(F.upper(u))
    return e.select("ordinal", "publisher", "evidence_id", made.alias("u"))


_SCHEME, _NET, _PATH = f"lower({part('u', 1)})", f"lower({part('u', 2)})", part("u", 3)
_H, _PORT = rf"regexp_extract({_NET}, '^(?:[^@]*@)?(\[[^\]]*\]|[^:]*)(?::(\d*))?$', 1)", rf"regexp_extract({_NET}, '^(?:[^@]*@)?(\[[^\]]*\]|[^:]*)(?::(\d*))?$', 2)"
_BARE = rf"regexp_replace({_NET}, '^www\.', '')"
_WHO = "regexp_replace(regexp_replace(lower(coalesce(publisher, '')), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')"
_RES = f"{base('u')} || CASE WHEN pp = '' THEN '/' ELSE pp END || CASE WHEN {part('u', 4)} <> '' THEN '?' || {part('u', 4)} ELSE '' END"


@query(rf"""WITH {_SHAPED} SELECT ordinal,
 CASE WHEN {_SCHEME} IN ('http', 'https') AND {_H} <> '' AND NOT contains({_NET}, '@') THEN {_SCHEME} || '://' || rtrim({_H}, '.') || CASE WHEN {_PORT} = '' OR ({_SCHEME} = 'http' AND {_PORT} = '80') OR ({_SCHEME} = 'https' AND {_PORT} = '443') THEN '' ELSE ':' || {_PORT} END || CASE WHEN {_PATH} = '' THEN '/' ELSE {_PATH} END ELSE '' END AS public_url,
 CASE WHEN {_SCHEME} <> '' THEN {_SCHEME} || ':' ELSE '' END || CASE WHEN {_H} <> '' THEN '//' || {_H} || CASE WHEN {_PORT} <> '' THEN ':' || {_PORT} ELSE '' END ELSE '' END || {_PATH} AS shown_url,
 CASE WHEN {_BARE} IN ('x.com', 'twitter.com', 'reddit.com') AND {_WHO} <> '' THEN {_BARE} || ':' || {_WHO} WHEN {_BARE} <> '' THEN {_BARE} ELSE {_RES} END AS poster,
 CASE WHEN lower({squeeze('publisher')}) <> '' THEN 'publisher:' || lower({squeeze('publisher')}) WHEN {_BARE} <> '' THEN 'host:' || {_BARE} ELSE 'row:' || coalesce(evidence_id, ordinal::VARCHAR) END AS family, {_H} AS request_host
FROM (SELECT *, regexp_replace(regexp_replace({_PATH}, '/+', '/', 'g'), '/$', '') AS pp FROM x)""")
def shown_addresses(spark: SparkSession, d: str) -> DataFrame:
    from sievework.operators.execution import first_host

    u = F.col("u")
    return _shaped(spark, d).select(
        "ordinal", text.public_url(u).alias("public_url"), text.shown_url(u).alias("shown_url"), text.poster_key(u, F.lit(None).cast("string"), F.col("publisher")).alias("poster"),
        text.family_key(u, F.lit(None).cast("string"), F.col("publisher"), F.coalesce("evidence_id", F.col("ordinal").cast("string"))).alias("family"), first_host(F.lit(None).cast("string"), u).alias("request_host"),
    )


@query(rf"""SELECT ordinal, coalesce(nullif({squeeze(r"regexp_replace(regexp_replace(t, '#([0-9A-Za-z_])', '\1', 'g'), '(?i)\b(?:github|open source|repo|repositories)\b', ' ', 'g')")}, ''), t) AS repository_query,
 url_encode(t) AS quoted_raw, trim(t || CASE WHEN contains(lower({squeeze('t')}), 'cache hits') THEN '' ELSE ' cache hits' END) AS with_terms,
 coalesce(nullif(left(regexp_replace(regexp_replace(lower(t), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 64), ''), 'research-run') AS run_slug, regexp_replace(lower(t), '[^a-z0-9]+', '', 'g') AS company_slug
FROM (SELECT ordinal, '#Open Source repo ' || topic AS t FROM b4_results)""")
def query_texts(spark: SparkSession, d: str) -> DataFrame:
    t = F.concat(F.lit("#Open Source repo "), F.col("topic"))
    return table(spark, d, "b4_results").select("ordinal", text.repository_query(t).alias("repository_query"), F.replace(text.quoted(t), F.lit("+"), F.lit("%20")).alias("quoted_raw"), text.with_terms(t, "cache hits").alias("with_terms"), text.run_slug(t).alias("run_slug"), text.company_slug(t).alias("company_slug"))


_LINK_TEXT = "coalesce(title, '') || ' [' || coalesce(title, '-') || '](' || coalesce(url, '') || ') see ' || coalesce(url, '') || ', also https://other.example/a.'"


@query(r"""SELECT ordinal, row_number() OVER (PARTITION BY ordinal ORDER BY i) - 1 AS position, u AS url FROM (SELECT * FROM (SELECT ordinal, unnest(l) AS u, generate_subscripts(l, 1) AS i FROM (SELECT ordinal, list_filter(list_transform(list_concat(
  regexp_extract_all(t, '\[[^\]]+\]\((https?://[^\s)]+)\)', 1), regexp_extract_all(t, '(https?://[^\s<>\])]+)', 1)), lambda u: regexp_replace(u, '[.,]+$', '')), lambda u: regexp_matches(u, '^https?://[^/?#]+')) AS l
 FROM (SELECT ordinal, """ + _LINK_TEXT + r""" AS t FROM b4_results))) QUALIFY row_number() OVER (PARTITION BY ordinal, u ORDER BY i) = 1)""")
def linked_urls(spark: SparkSession, d: str) -> DataFrame:
    t = F.concat(F.coalesce("title", F.lit("")), F.lit(" ["), F.coalesce("title", F.lit("-")), F.lit("]("), F.coalesce("url", F.lit("")), F.lit(") see "), F.coalesce("url", F.lit("")), F.lit(", also https://other.example/a."))
    found = table(spark, d, "b4_results").select("ordinal", F.posexplode(text.linked_urls(t)).alias("position", "x"))
    return found.select("ordinal", F.col("position").cast("bigint").alias("position"), F.col("x.url").alias("url"))


# --- repositories ---------------------------------------------------------------------------------------------------

_RQ = "memory steel large brushed"


@query(f"""WITH w AS (SELECT p_partkey, {tokens(f"'{_RQ}'")} AS q, {tokens('p_name')} AS t, {tokens('p_type')} AS b, {tokens('p_brand')} AS o, p_retailprice, p_size, DATE '2026-04-30' - (p_partkey % 1000)::INTEGER AS pushed FROM part),
 s AS (SELECT p_partkey, coalesce(round(list_sum(list_transform(q, lambda x: CASE WHEN list_contains(t, x) THEN 1.0 WHEN list_contains(o, x) THEN 0.8 WHEN list_contains(b, x) THEN 0.4 ELSE 0.0 END))::DOUBLE / nullif(len(q), 0), 6), 0.0) AS relevance,
  least(24, 4 * log10(p_retailprice + 1)) + least(6, 2 * log10(p_size + 1)) AS adoption, CASE WHEN p_partkey % 1000 <= 30 THEN 8.0 WHEN p_partkey % 1000 <= 180 THEN 6.0 WHEN p_partkey % 1000 <= 365 THEN 4.0 WHEN p_partkey % 1000 <= 730 THEN 2.0 ELSE 0.0 END AS recency,
  CASE WHEN p_size > 40 THEN -35.0 ELSE 0.0 END AS penalty FROM w),
 r AS (SELECT *, round(relevance * 100 + adoption + recency + penalty, 4) AS score FROM s)
SELECT p_partkey, relevance, score AS rank_score, row_number() OVER (ORDER BY score DESC, p_partkey) AS engine_rank FROM r""")
def repository_rank(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    score, _ = relevance.text_relevance(F.lit(_RQ), F.col("p_name"), F.col("p_type"), F.col("p_brand"))
    pushed = F.date_format(F.date_sub(F.lit("2026-04-30").cast("date"), (F.col("p_partkey") % 1000).cast("int")), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    scored = relevance.with_rank_score(p.withColumn("relevance", score), F.col("relevance"), F.col("p_retailprice"), F.col("p_size"), dates.recency(pushed, F.lit("2026-04-30").cast("date")), F.col("p_size") > 40)
    placed = scored.select("p_partkey", "relevance", "rank_score", (-F.col("rank_score")).alias("down"))
    return rows.with_position(placed, ["down", "p_partkey"], "engine_rank").drop("down")


# --- what must not be shown -----------------------------------------------------------------------------------------


def _alternatives(words: tuple[str, ...]) -> str:
    return "|".join(words)


_PLAIN_KEY = "regexp_replace(regexp_replace(lower(k), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')"
_LIST = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
_KEYS = "SELECT DISTINCT source || suffix AS k FROM documents, (VALUES (''), ('_token'), ('.Api-Key'), ('_session_count'), ('_total')) v(suffix) WHERE source IS NOT NULL UNION SELECT unnest(['Set-Cookie', 'prior_authorization', 'prior_authorization_token', 'preauthorization note', 'authorization_code', 'auth header', 'author', 'tokens', 'X-Auth', 'sid', 'side'])"


@query(f"SELECT k AS name, regexp_matches(p, '(?:{_alternatives(validity.SECRET_ENDS)})$') OR (NOT regexp_matches(p, '^(?:{_alternatives(validity.DOMAIN_STARTS)})') AND (list_contains({_LIST(validity.SECRET_NAMES)}, p) OR regexp_matches(p, '^(?:{_alternatives(validity.SECRET_STARTS)})') OR list_has_any(string_split(p, '_'), {_LIST(validity.SECRET_WORDS)}))) AS secret FROM (SELECT k, {_PLAIN_KEY} AS p FROM ({_KEYS}))")
def secret_keys(spark: SparkSession, d: str) -> DataFrame:
    ends = F.explode(F.array(*map(F.lit, ("", "_token", ".Api-Key", "_session_count", "_total"))))
    made = table(spark, d, "documents").where("source is not null").select("source").distinct().select("source", ends.alias("e")).select(F.concat("source", "e").alias("name"))
    more = spark.createDataFrame([(x,) for x in ("Set-Cookie", "prior_authorization", "prior_authorization_token", "preauthorization note", "authorization_code", "auth header", "author", "tokens", "X-Auth", "sid", "side")], "name string")
    return made.unionByName(more).distinct().withColumn("secret", validity.secret_key(F.col("name")))


@query()
def sanitized_rows(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "false_positive_evidence").select("ordinal", F.to_json(F.struct("evidence_id", "title", "url", "text", F.col("source_id").alias("session_id"))).alias("document"))
    s = e.select("ordinal", content.sanitized(F.col("document")).alias("s")).select("ordinal", "s.*")
    return s.select("ordinal", F.array_join("paths", "|").alias("paths"), F.sha2("clean", 256).alias("digest"))


@query("SELECT 'artifact sanitation redacted/dropped sensitive field(s) in ' || ordinal || ': session_id' AS warning FROM b4_results")
def sanitation_warnings(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "b4_results").select("ordinal", content.sanitized(F.to_json(F.struct("title", F.lit("x").alias("session_id")))).alias("s"))
    return content.sanitation_warnings(e.select("ordinal", "s.paths"), "ordinal", "paths")


