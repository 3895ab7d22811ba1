"""Queries on records of requests and on captured answers of services."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.operators import execution, quality
from sievework.plans.registry import query
from sievework.session import table
from sievework.sources import records as sources

_STATUS = "CASE event_type WHEN 'error' THEN CASE event_id % 3 WHEN 0 THEN 'failed' WHEN 1 THEN 'rate_limit' ELSE 'timeout' END WHEN 'click' THEN 'warning' ELSE 'ok' END"
_CAUSE = "CASE WHEN event_type = 'error' AND event_id % 2 = 0 THEN CASE event_id % 4 WHEN 0 THEN 'network_timeout' ELSE 'tls_failure' END END"


def _records(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", "user_id", F.expr(_STATUS).alias("status"), F.expr(_CAUSE).alias("failure_reason"))


@query(f"SELECT status, count(*) AS n_records FROM (SELECT {_STATUS} AS status FROM events WHERE event_id % 2 = 0 UNION ALL SELECT {_STATUS} FROM events WHERE event_id % 2 = 1 UNION ALL SELECT 'unknown' FROM region) GROUP BY 1")
def merged_passes(spark: SparkSession, d: str) -> DataFrame:
    r = _records(spark, d)
    return execution.request_totals(execution.merged(r.where("event_id % 2 = 0"), r.where("event_id % 2 = 1"), table(spark, d, "region").select("r_regionkey", F.lit(None).cast("string").alias("status"))))


@query(f"SELECT user_id, CASE WHEN bool_or(status IN ('ok', 'warning', 'cache_hit')) THEN 'checked' ELSE 'failed' END AS outcome FROM (SELECT user_id, {_STATUS} AS status FROM events) GROUP BY 1")
def checked_keys(spark: SparkSession, d: str) -> DataFrame:
    return execution.checked(_records(spark, d), "user_id")


@query(f"""WITH r AS (SELECT user_id, {_STATUS} AS status, {_CAUSE} AS cause FROM events), g AS (SELECT user_id, bool_and(status IN ('failed', 'rate_limit', 'retry_exhausted', 'robots_denied', 'timeout')) AS bad, list_sort(list(DISTINCT cause) FILTER (cause IS NOT NULL)) AS causes FROM r GROUP BY 1)
SELECT c_custkey AS user_id, CASE WHEN len(coalesce(causes, [])) > 0 THEN 'infrastructure_unavailable' ELSE 'no_executable_sources' END AS reason, array_to_string(coalesce(causes, []), '|') AS causes FROM customer LEFT JOIN g ON user_id = c_custkey WHERE coalesce(bad, true)""")
def request_failures(spark: SparkSession, d: str) -> DataFrame:
    planned = table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"))
    return execution.failures(planned, _records(spark, d), "user_id").withColumn("causes", F.array_join("causes", "|"))


@query("SELECT count(*) AS total, count(*) FILTER (event_type = 'view') AS completed, count(*) FILTER (event_id % 2 = 0 AND event_id % 3 <> 0 AND event_type <> 'view') AS pending_human_actions, count(*) FILTER (event_id % 5 = 0 AND event_id % 3 = 0 AND event_type <> 'view') AS advisory_coverage_gaps FROM events")
def challenge_totals(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    made = e.select(F.when(F.col("event_type") == "view", "completed").alias("status"), (F.col("event_id") % 2 == 0).alias("human_action_required"), F.when(F.col("event_id") % 3 == 0, False).alias("blocking"), (F.col("event_id") % 5 == 0).alias("coverage_missing"))
    return execution.challenge_totals(made)


@query("""SELECT 5::BIGINT AS allowed, sum(CASE WHEN event_id % 4 = 0 THEN 2 WHEN event_type = 'error' THEN 1 ELSE 0 END)::BIGINT AS attempted, sum(CASE WHEN event_id % 4 = 0 THEN 1 ELSE 0 END)::BIGINT AS completed, 'paid_call_completed' AS stop_reason FROM events WHERE user_id % 2 = 0""")
def paid_calls(spark: SparkSession, d: str) -> DataFrame:
    own = F.col("event_id") % 4 == 0
    made = table(spark, d, "events").select(
        F.col("event_id").alias("ordinal"), F.when(F.col("user_id") % 2 == 0, "paid").otherwise("free").alias("connector"), F.when(F.col("event_type") == "error", "failed").otherwise("ok").alias("status"), F.lit(1).alias("attempts"),
        F.when(own, 2).alias("paid_calls_attempted"), F.when(own, 1).alias("paid_calls_completed"), F.lit(None).cast("string").alias("stop_reason"),
    )
    return execution.costs(made, "paid", True, 5)


@query("SELECT n_nationkey AS id, CASE WHEN n_nationkey % 3 = 0 THEN 'over' ELSE n_name END AS label FROM nation UNION ALL SELECT 1000 + r_regionkey, 'over' FROM region")
def overlaid(spark: SparkSession, d: str) -> DataFrame:
    base = table(spark, d, "nation").select(F.col("n_nationkey").cast("bigint").alias("id"), F.col("n_name").alias("label"))
    over = base.where("id % 3 = 0").select("id", F.lit("over").alias("label")).unionByName(table(spark, d, "region").select((F.col("r_regionkey") + 1000).cast("bigint").alias("id"), F.lit("over").alias("label")))
    return execution.overlay(base, over, "id")


@query("SELECT event_id, sha256('{\"p0\":' || coalesce('\"' || event_type || '\"', 'null') || ',\"p1\":' || user_id || ',\"p2\":null}') AS request_key FROM events")
def request_keys(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", execution.request_key(F.col("event_type"), F.col("user_id"), F.lit(None).cast("string")).alias("request_key"))


@query("SELECT event_id, round(least(4.0, 0.25 * power(2, greatest(0, event_id % 7 - 1))) * (0.5 + 0.5 * ((user_id % 11) / 10.0)), 3) AS delay FROM events WHERE user_id % 11 < 11")
def retry_delays(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", execution.retry_delay((F.col("event_id") % 7).cast("int"), 0.25, 4.0, (F.col("user_id") % 11) / 10.0).alias("delay"))


@query("SELECT count(*) AS check_count, count(*) FILTER (p_size > 20) AS available_count, count(*) FILTER (p_partkey % 2 = 0 AND p_size <= 20) AS required_failure_count, count(*) FILTER (p_partkey % 2 <> 0 AND p_size <= 20) AS optional_missing_count FROM part")
def readiness(spark: SparkSession, d: str) -> DataFrame:
    return execution.readiness(table(spark, d, "part").select((F.col("p_size") > 20).alias("available"), (F.col("p_partkey") % 2 == 0).alias("required")))


@query("SELECT topic, max(ordinal) AS ordinal, arg_max(url, ordinal) AS url FROM b4_results GROUP BY 1")
def latest_by_id(spark: SparkSession, d: str) -> DataFrame:
    return quality.latest_rows(table(spark, d, "b4_results").select("topic", "ordinal", F.coalesce("url", F.lit("")).alias("u"), "url"), "topic", "ordinal").select("topic", "ordinal", "url")


@query("SELECT url, min(ordinal) AS ordinal FROM b4_results WHERE coalesce(url, '') <> '' GROUP BY 1")
def unique_urls(spark: SparkSession, d: str) -> DataFrame:
    return sources.unique_urls(table(spark, d, "b4_results"), "ordinal").select("url", "ordinal")


# --- captured answers -----------------------------------------------------------------------------------------------


def _answers(spark: SparkSession, d: str) -> DataFrame:
    """Captured answers of a search provider: one for each result; some with an error code, some without results."""
    b = table(spark, d, "b4_results")
    item = F.struct(F.col("url").alias("link"), "title", F.col("snippet").alias("content"))
    results = F.when(F.col("ordinal") % 11 != 0, F.array(item, item))
    return b.select("ordinal", F.to_json(F.struct(F.when(F.col("ordinal") % 7 == 0, 3).otherwise(0).alias("code"), F.struct(results.alias("results")).alias("data"))).alias("body"))


@query(r"""SELECT ordinal, r AS raw_rank, left(coalesce(nullif(trim(title), ''), trim(url)), 500) AS title, trim(url) AS url, regexp_replace(lower(regexp_extract(trim(url), '^https?://([^/?#]*)', 1)), '^www\.', '') AS publisher, left(coalesce(trim(snippet), ''), 2000) AS text
FROM b4_results, (VALUES (1), (2)) v(r) WHERE ordinal % 7 <> 0 AND ordinal % 11 <> 0 AND regexp_matches(trim(url), '^https?://[^/?#]+')""")
def search_results(spark: SparkSession, d: str) -> DataFrame:
    return sources.search_results(_answers(spark, d), "body", "nested")[0].drop("source_class")


@query("SELECT ordinal, CASE WHEN ordinal % 7 = 0 THEN 'provider error 3' ELSE 'malformed payload' END AS warning FROM b4_results WHERE ordinal % 7 = 0 OR ordinal % 11 = 0")
def search_warnings(spark: SparkSession, d: str) -> DataFrame:
    return sources.search_results(_answers(spark, d), "body", "nested")[1]


@query("""SELECT p_partkey, p_name AS title, 'https://code.example/' || p_partkey AS url, p_brand AS author, 'Repository: ' || p_name || ' Description: ' || p_type || ' Stars: ' || p_size || ' Archived: ' || CASE WHEN p_size > 40 THEN 'True' ELSE 'False' END || ' Topics: ' || p_brand || ', parts' AS text, p_size::BIGINT AS stars, p_size > 40 AS archived FROM part""")
def repositories(spark: SparkSession, d: str) -> DataFrame:
    item = F.struct(F.col("p_name").alias("full_name"), F.concat(F.lit("https://code.example/"), "p_partkey").alias("html_url"), F.col("p_type").alias("description"), F.col("p_size").alias("stargazers_count"), (F.col("p_size") > 40).alias("archived"), F.array("p_brand", F.lit("parts")).alias("topics"), F.struct(F.col("p_brand").alias("login")).alias("owner"))
    made = table(spark, d, "part").select("p_partkey", F.to_json(F.struct(F.array(item).alias("items"))).alias("body"))
    return sources.repositories(made, "body").select("p_partkey", "title", "url", "author", "text", "stars", "archived")


@query("""SELECT ordinal, row_number() OVER (PARTITION BY ordinal ORDER BY i) - 1 AS position, u AS url FROM (SELECT ordinal, i, u FROM (SELECT ordinal, unnest(l) AS u, generate_subscripts(l, 1) AS i FROM (SELECT ordinal, [trim(url), 'ftp://a.example', 'https://cited.example/' || ordinal % 3, trim(url)] AS l FROM b4_results))
 WHERE regexp_matches(u, '^https?://[^/?#]+') QUALIFY row_number() OVER (PARTITION BY ordinal, u ORDER BY i) = 1)""")
def cited_urls(spark: SparkSession, d: str) -> DataFrame:
    cited = F.concat(F.lit("https://cited.example/"), (F.col("ordinal") % 3).cast("string"))
    note = F.struct(F.lit("url_citation").alias("type"), cited.alias("url"), F.struct(F.col("url").alias("url")).alias("url_citation"))
    other = F.struct(F.lit("note").alias("type"), F.lit("https://ignored.example/").alias("url"), F.struct(F.lit(None).cast("string").alias("url")).alias("url_citation"))
    body = F.struct(F.array("url", F.lit("ftp://a.example")).alias("citations"), F.array(F.struct(F.array(F.struct(F.array(note, other).alias("annotations"))).alias("content"))).alias("output"))
    made = table(spark, d, "b4_results").select("ordinal", F.to_json(body, {"ignoreNullFields": "false"}).alias("body"))
    return sources.citations(made, "body").withColumn("position", F.col("position").cast("bigint"))


@query(f"""SELECT ordinal, left(coalesce(text, ''), 4000) AS text, coalesce(content_valid, false) AS is_final_page, list_has_any(coalesce(content_invalid_reasons, []), [{', '.join(f"'{r}'" for r in sources.BLOCKED_REASONS)}]) AS access_blocked FROM fetched_pages""")
def page_evidence(spark: SparkSession, d: str) -> DataFrame:
    return sources.page_rows(table(spark, d, "fetched_pages")).select("ordinal", "text", "is_final_page", "access_blocked")


@query("SELECT ordinal, 'Opening ' || ordinal AS title, 'https://jobs.b.example/jobs/' || ordinal AS url FROM b4_results WHERE ordinal % 2 = 0")
def job_links(spark: SparkSession, d: str) -> DataFrame:
    o = F.col("ordinal").cast("string")
    html = F.concat(F.lit("<p>x</p><a href='/about'>About</a><a href='https://c.example/jobs/1'>Elsewhere</a><a href='../"), F.when(F.col("ordinal") % 2 == 0, "jobs/").otherwise("news/"), o, F.lit("'>Opening\n <b>"), o, F.lit("</b></a><a href='/jobs/2'></a>"))
    pages = table(spark, d, "b4_results").select("ordinal", html.alias("html"), F.lit("https://jobs.b.example/list/all").alias("base"))
    return sources.job_links(pages, "ordinal", "html", "base", ("b.example",))


@query(r"""SELECT url, (min({'r': result_rank, 'o': ordinal})).r AS result_rank, (min({'r': result_rank, 'o': ordinal})).o AS ordinal FROM (SELECT trim(url) AS url, result_rank, ordinal FROM b4_results WHERE regexp_matches(trim(url), '^https?://[^/?#]+'))
WHERE url NOT IN (SELECT url FROM fetched_pages WHERE url IS NOT NULL) GROUP BY 1 ORDER BY 2, 3 LIMIT 40""")
def refetch_candidates(spark: SparkSession, d: str) -> DataFrame:
    seen = table(spark, d, "fetched_pages").where("url is not null")
    return sources.candidates(table(spark, d, "b4_results"), seen, ["result_rank", "ordinal"], 40)


@query("SELECT ordinal, list_extract(string_split(regexp_replace(p, '/+$', ''), '/'), -1) || '#' || left(sha256(p), 12) AS reference FROM (SELECT ordinal, '/data/' || topic || '/' || coalesce(host, '') || '.jsonl' AS p FROM b4_results)")
def path_references(spark: SparkSession, d: str) -> DataFrame:
    from sievework.functions.text import path_reference

    p = F.concat(F.lit("/data/"), F.col("topic"), F.lit("/"), F.coalesce("host", F.lit("")), F.lit(".jsonl"))
    return table(spark, d, "b4_results").select("ordinal", path_reference(p).alias("reference"))


@query(r"""SELECT ordinal, array_to_string(list_transform(string_split_regex(topic || '  Compared to ' || host || ' Frameworks', '(?i)\s+(?:versus|vs\.|vs|compared to)\s+'),
 lambda x: trim(regexp_replace(x, '(?i) (?:inference engines?|frameworks?|projects?|repositories|comparison)\s*$', ''), ' ,:;-')), '|') AS sides FROM b4_results WHERE host IS NOT NULL""")
def comparison_sides(spark: SparkSession, d: str) -> DataFrame:
    from sievework.functions.text import comparison_sides as sides

    c = F.concat(F.col("topic"), F.lit("  Compared to "), F.col("host"), F.lit(" Frameworks"))
    return table(spark, d, "b4_results").where("host is not null").select("ordinal", F.array_join(sides(c), "|").alias("sides"))
