"""Queries on the quality of evidence, on what supports claims, and on what matters to a query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.functions import text
from sievework.operators import claims, copies, quality, relevance, validity
from sievework.plans.registry import host, normal, page, part, query, slug, squeeze, tokens
from sievework.plans.specs import CLAIMS, CONFLICTS, MATRIX, SIDES
from sievework.session import materialise, table


def evidence(spark: SparkSession, d: str) -> DataFrame:
    """Evidence rows and fetched pages as rows of one frame; position tells them apart and orders them."""
    none = lambda kind: F.lit(None).cast(kind)
    rows = table(spark, d, "false_positive_evidence").select(
        (F.col("ordinal") * 2).alias("position"), "evidence_id", "source_id", "connector", "title", "url", none("string").alias("final_url"), "publisher", "text", "source_confidence", F.when(F.col("connector") == "external_jsonl", "directory").alias("source_kind"),
        none("int").alias("http_status"), none("string").alias("content_type"), none("boolean").alias("content_valid"), none("array<string>").alias("content_invalid_reasons"),
    )
    pages = table(spark, d, "fetched_pages").select(
        (F.col("ordinal") * 2 + 1).alias("position"), F.concat(F.lit("page-"), F.col("ordinal")).alias("evidence_id"), F.col("host").alias("source_id"), F.lit("web_page").alias("connector"), F.get("content_blocks", F.lit(0))["text"].alias("title"), "url", "final_url", none("string").alias("publisher"),
        "text", F.nullif("date_confidence", F.lit("")).alias("source_confidence"), F.lit("platform_search_page").alias("source_kind"), "http_status", "content_type", "content_valid", "content_invalid_reasons",
    )
    pages = pages.withColumn("source_kind", F.when(F.col("position") % 7 == 1, F.col("source_kind")))
    return rows.unionByName(pages)


_EV = """ev AS (SELECT ordinal * 2 AS position, evidence_id, source_id, connector, title, url, NULL::VARCHAR AS final_url, publisher, text, source_confidence, CASE WHEN connector = 'external_jsonl' THEN 'directory' END AS source_kind,
  NULL::INTEGER AS http_status, NULL::VARCHAR AS content_type, NULL::BOOLEAN AS content_valid, NULL::VARCHAR[] AS carried FROM false_positive_evidence
 UNION ALL SELECT ordinal * 2 + 1, 'page-' || ordinal, host, 'web_page', content_blocks[1].text, url, final_url, NULL, text, nullif(date_confidence, ''), CASE WHEN (ordinal * 2 + 1) % 7 = 1 THEN 'platform_search_page' END,
  http_status, content_type, content_valid, content_invalid_reasons FROM fetched_pages)"""


def _quote(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _web(t: str, kind: str, url: str, short: str) -> list[str]:
    """The SQL of validity.page_reasons, on normalised text t."""
    count = lambda marks: "(" + " + ".join(f"contains({t}, {_quote(m)})::INT" for m in marks) + ")"
    known = " OR ".join(f"starts_with({kind}, '{p}')" for p in validity.TEXT_TYPES)
    p, f = count(validity.LOGIN_PHRASES), count(validity.LOGIN_FIELDS)
    paths = ", ".join(_quote(x) for x in validity.LOGIN_PATHS)
    return [
        f"CASE WHEN {kind} <> '' AND NOT ({known}) THEN 'unsupported_content_type_' || {kind} END", *[f"CASE WHEN contains({t}, {_quote(m)}) THEN '{r}' END" for r, m in validity.BLOCK_MARKS],
        f"CASE WHEN (list_has_any(string_split(lower({part(url, 3)}), '/'), [{paths}]) AND {p} > 0) OR {p} >= 2 OR ({p} > 0 AND {f} >= 3) THEN 'login_wall' END",
        f"CASE WHEN length({t}) < 1000 AND (contains({t}, 'complete the captcha') OR contains({t}, 'captcha challenge')) THEN 'captcha' END", f"CASE WHEN length({t}) < {validity.LEAST_CHARS} AND {short} THEN 'insufficient_text' END",
    ]


_WHY = ", ".join(_web("t", "kind", "coalesce(nullif(final_url, ''), url)", "(http_status IS NOT NULL OR content_type IS NOT NULL OR final_url IS NOT NULL)"))
_REASONED = f"""{_EV}, r0 AS (SELECT *, {normal('text')} AS t, trim(split_part(lower(coalesce(content_type, '')), ';', 1)) AS kind, list_filter(coalesce(carried, []), lambda r: coalesce(r, '') <> '') AS held FROM ev),
 r1 AS (SELECT *, list_filter(list_concat(held, [CASE WHEN len(held) = 0 AND content_valid = false THEN 'explicit_invalid' END, CASE WHEN http_status >= 400 THEN 'http_status_' || http_status END],
   CASE WHEN lower(connector) = 'web_page' THEN [{_WHY}] ELSE [] END), lambda r: r IS NOT NULL) AS l FROM r0),
 r AS (SELECT * EXCLUDE (l, t, kind, held, carried), list_filter(l, lambda x, i: list_position(l, x) = i) AS reasons FROM r1)"""

_CONF = "coalesce(nullif(lower(source_confidence), ''), 'medium')"
_SIGNALS = f"""[CASE lower(coalesce(connector, '')) WHEN '' THEN {{'reason': 'missing_connector', 'n': -10}} {' '.join(f"WHEN '{c}' THEN {{'reason': '{why}', 'n': {n}}}" for c, (why, n) in quality.RELIABILITY.items())} ELSE {{'reason': 'connector_present', 'n': 0}} END,
 {{'reason': CASE WHEN {_CONF} <> 'medium' THEN 'source_confidence_' || {_CONF} END, 'n': CASE {_CONF} {' '.join(f"WHEN '{c}' THEN {n}" for c, n in quality.CONFIDENCE.items())} ELSE 0 END}},
 CASE WHEN {' OR '.join(f"contains(lower(coalesce(source_kind, '')), '{w}')" for w in quality.AUTHORITATIVE)} THEN {{'reason': 'source_kind_authoritative', 'n': 10}} ELSE {{'reason': NULL, 'n': 0}} END,
 CASE WHEN url LIKE 'https://%' THEN {{'reason': 'https_url', 'n': 5}} WHEN coalesce(url, '') = '' THEN {{'reason': 'missing_url', 'n': -12}} ELSE {{'reason': NULL, 'n': 0}} END,
 CASE WHEN coalesce(title, '') <> '' THEN {{'reason': NULL, 'n': 3}} ELSE {{'reason': 'missing_title', 'n': -4}} END,
 CASE WHEN length(coalesce(text, '')) >= 240 THEN {{'reason': 'substantive_excerpt', 'n': 5}} WHEN coalesce(text, '') = '' THEN {{'reason': 'missing_text', 'n': -10}} ELSE {{'reason': NULL, 'n': 0}} END]"""
_DEDUPE = f"""CASE WHEN coalesce(url, '') <> '' THEN 'url:' || {page('url')} WHEN {normal('title')} || '|' || left({normal('text')}, 240) <> '|' THEN 'text:' || left(sha1({normal('title')} || '|' || left({normal('text')}, 240)), 16)
 ELSE 'row:' || lpad(position::VARCHAR, greatest(4, length(position::VARCHAR))::INTEGER, '0') END"""
_QUALITY = f"""{_REASONED}, q0 AS (SELECT *, len(reasons) = 0 AS valid, {_SIGNALS} AS signals FROM r),
 q1 AS (SELECT *, CASE WHEN valid THEN greatest(0, least(100, 50 + list_sum(list_transform(signals, lambda s: s.n))))::INTEGER ELSE 0 END AS hundredths,
  valid AND NOT (coalesce(source_kind, '') = 'platform_search_page') AS claim_eligible, {_DEDUPE} AS dedupe_key FROM q0),
 q AS (SELECT *, CASE WHEN hundredths >= 72 THEN 'high' WHEN hundredths >= 45 THEN 'medium' ELSE 'low' END AS quality_tier FROM q1),
 n AS (SELECT dedupe_key, count(*) AS copies, row_number() OVER (ORDER BY dedupe_key) AS number FROM q GROUP BY 1),
 u AS (SELECT q.*, CASE WHEN copies > 1 THEN 'dup-' || lpad(number::VARCHAR, greatest(4, length(number::VARCHAR))::INTEGER, '0') END AS duplicate_cluster_id,
  copies > 1 AND row_number() OVER (PARTITION BY q.dedupe_key ORDER BY valid DESC, hundredths DESC, position) > 1 AS is_duplicate FROM q JOIN n USING (dedupe_key))"""


def enriched(spark: SparkSession, d: str) -> DataFrame:
    """The frame with quality and copies, written once, as several operators read it."""
    known = materialise(quality.with_quality(evidence(spark, d), "position"), "quality")
    return quality.with_duplicates(known, quality.clusters(known, "position"), "position")


@query(f"WITH {_REASONED} SELECT position, array_to_string(reasons, '|') AS reasons FROM r")
def evidence_reasons(spark: SparkSession, d: str) -> DataFrame:
    return quality.with_reasons(evidence(spark, d)).select("position", F.array_join("content_invalid_reasons", "|").alias("reasons"))


@query(f"WITH {_REASONED} SELECT reason, count(*) AS n_rows FROM (SELECT unnest(reasons) AS reason FROM r) GROUP BY 1")
def reason_counts(spark: SparkSession, d: str) -> DataFrame:
    return quality.reason_counts(quality.with_reasons(evidence(spark, d)), "content_invalid_reasons")


@query(f"""WITH {_QUALITY} SELECT position, valid AS content_valid, claim_eligible, hundredths / 100.0 AS quality_score, quality_tier,
 array_to_string(CASE WHEN valid THEN list_filter(list_transform(signals, lambda s: s.reason), lambda x: x IS NOT NULL) ELSE list_concat(['invalid_content'], list_transform(reasons, lambda x: 'invalid_' || x)) END, '|') AS quality_reasons FROM q""")
def quality_scores(spark: SparkSession, d: str) -> DataFrame:
    e = quality.with_quality(evidence(spark, d), "position")
    return e.select("position", "content_valid", "claim_eligible", "quality_score", "quality_tier", F.array_join("quality_reasons", "|").alias("quality_reasons"))


@query(f"WITH {_QUALITY} SELECT position, duplicate_cluster_id, is_duplicate FROM u")
def duplicate_rows(spark: SparkSession, d: str) -> DataFrame:
    return enriched(spark, d).select("position", "duplicate_cluster_id", "is_duplicate")


_REPORT = f"""WITH {_QUALITY}, report AS (SELECT count(*) AS row_count, count(*) FILTER (NOT valid) AS invalid_evidence_count, count(*) FILTER (NOT claim_eligible) AS claim_ineligible_count, count(DISTINCT nullif(evidence_id, '')) AS unique_evidence_id_count,
 count(nullif(evidence_id, '')) - count(DISTINCT nullif(evidence_id, '')) AS evidence_id_collision_count, count(*) FILTER (NOT is_duplicate) AS unique_evidence_count, count(DISTINCT duplicate_cluster_id) AS duplicate_cluster_count,
 round(sum(hundredths) / (count(*) * 100.0), 3) AS average_quality_score, count(*) FILTER (quality_tier = 'high') AS high_tier, count(*) FILTER (quality_tier = 'medium') AS medium_tier, count(*) FILTER (quality_tier = 'low') AS low_tier,
 count(*) FILTER (valid AND NOT claim_eligible) AS discovery_only_count, count(*) FILTER (is_duplicate) AS duplicate_row_count FROM u)"""


@query(_REPORT + " SELECT * FROM report")
def evidence_report(spark: SparkSession, d: str) -> DataFrame:
    return quality.report(enriched(spark, d))


@query(f"WITH {_QUALITY} SELECT 'tier' AS kind, quality_tier AS value, count(*) AS n_rows FROM q GROUP BY ALL UNION ALL SELECT 'connector', coalesce(nullif(connector, ''), 'unknown'), count(*) FROM q GROUP BY ALL")
def quality_counts(spark: SparkSession, d: str) -> DataFrame:
    return quality.counts_by(quality.with_quality(evidence(spark, d), "position"))


_PLAIN = normal("concat_ws(' ', title, text)")


def _holds(c: str, terms: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({c}, {_quote(t)})" for t in terms) + ")"


_FLAGS = f"""WITH {_QUALITY}, m AS (SELECT position, evidence_id, {_PLAIN} AS t FROM u WHERE claim_eligible AND coalesce(evidence_id, '') <> ''),
 c AS ({' UNION ALL '.join(f"SELECT '{s}' AS flag_id, coalesce(list(evidence_id ORDER BY position) FILTER ({_holds('t', a)}), [])[1:12] AS s, coalesce(list(evidence_id ORDER BY position) FILTER ({_holds('t', b)}), [])[1:12] AS o FROM m" for s, (a, b) in CONFLICTS.items())}),
 f AS (SELECT flag_id, array_to_string(s, '|') AS support_ids, array_to_string(o, '|') AS oppose_ids, s, o FROM c WHERE len(s) > 0 AND len(o) > 0)"""


@query(_FLAGS + " SELECT flag_id, support_ids, oppose_ids FROM f")
def conflict_evidence(spark: SparkSession, d: str) -> DataFrame:
    f = quality.conflict_flags(quality.with_quality(evidence(spark, d), "position"), "position", CONFLICTS)
    return f.select("flag_id", F.array_join("support_ids", "|").alias("support_ids"), F.array_join("oppose_ids", "|").alias("oppose_ids"))


@query(_REPORT.replace("WITH ", _FLAGS + ", ", 1).replace(_QUALITY + ", report", "report", 1) + """, w AS (SELECT *, (SELECT count(*) FROM f) AS n_conflicts FROM report) SELECT unnest(list_filter([
 CASE WHEN invalid_evidence_count > 0 THEN invalid_evidence_count || ' invalid evidence row(s) excluded from claims.' END, CASE WHEN discovery_only_count > 0 THEN discovery_only_count || ' discovery-only evidence row(s) excluded from claims.' END,
 CASE WHEN evidence_id_collision_count > 0 THEN evidence_id_collision_count || ' evidence id collision(s) detected; normalize before synthesis.' END,
 CASE WHEN duplicate_cluster_count > 0 THEN duplicate_row_count || ' duplicate evidence row(s) detected across ' || duplicate_cluster_count || ' cluster(s).' END,
 CASE WHEN low_tier > 0 THEN low_tier || ' low-quality evidence row(s) need source review.' END, CASE WHEN n_conflicts > 0 THEN n_conflicts || ' directional conflict flag(s) need review before synthesis.' END], lambda x: x IS NOT NULL)) AS warning FROM w""")
def quality_warnings(spark: SparkSession, d: str) -> DataFrame:
    e = materialise(enriched(spark, d), "enriched")
    flags = quality.conflict_flags(e, "position", CONFLICTS).agg(F.count(F.lit(1)).alias("n_conflicts"))
    return quality.warnings(quality.report(e), flags)


@query(f"WITH {_QUALITY} SELECT coalesce(nullif(connector, ''), 'unknown') AS connector, count(*) AS n_rows FROM q WHERE claim_eligible GROUP BY 1")
def eligible_source_mix(spark: SparkSession, d: str) -> DataFrame:
    return quality.source_mix(quality.with_quality(evidence(spark, d), "position"))


# --- claims ---------------------------------------------------------------------------------------------------------

_MAP_TEXT = "lower(concat_ws(' ', title, text))"
_SIDED = f"""{_QUALITY}, s AS ({' UNION ALL '.join(f"SELECT position, '{c}' AS claim, CASE WHEN {_holds(_MAP_TEXT, a)} THEN 'support' ELSE 'oppose' END AS side FROM u WHERE {_holds(_MAP_TEXT, a)} <> {_holds(_MAP_TEXT, b)}" for c, (a, b) in CLAIMS.items())})"""


def _known(spark: SparkSession, d: str) -> DataFrame:
    """The frame with quality, written once for what reads it more than once."""
    return materialise(quality.with_quality(evidence(spark, d), "position").select("position", "evidence_id", "title", "url", "final_url", "publisher", "connector", "text", "claim_eligible"), "quality")


def _sided(e: DataFrame) -> DataFrame:
    """position, evidence_id, claim, side, origin, content: the eligible rows of each claim's sides, written once."""
    mapped = e.where("claim_eligible").withColumn("__m", claims.polarities(F.lower(F.concat_ws(" ", "title", "text")), CLAIMS))
    each = mapped.select("position", "evidence_id", text.origin_key(text.filled(F.col("final_url"), F.col("url")), F.col("publisher"), text.filled(F.col("evidence_id"), F.col("title"))).alias("origin"), text.content_hash(F.col("text")).alias("content"), F.explode("__m").alias("claim", "side"))
    return materialise(each, "sided")


@query(f"WITH {_SIDED} SELECT position, claim, side FROM s")
def claim_polarities(spark: SparkSession, d: str) -> DataFrame:
    e = evidence(spark, d)
    return e.select("position", F.explode(claims.polarities(F.lower(F.concat_ws(" ", "title", "text")), CLAIMS)).alias("claim", "side"))


def _chains(e: DataFrame) -> tuple[DataFrame, DataFrame]:
    s = _sided(e)
    support = copies.independent(s.where("side = 'support'"), "position", "origin", "content", "evidence_id", "claim")
    return support, copies.independent(s.where("side = 'oppose'"), "position", "origin", "content", "evidence_id", "claim", support)


_ORIGIN_EV = rf"""CASE WHEN coalesce(publisher, '') <> '' THEN 'publisher:' || {slug('publisher')}
 WHEN {host('w')} IN ('github.com', 'gitlab.com') AND len(list_filter(string_split({part('w', 3)}, '/'), lambda p: p <> '')) >= 2 THEN 'repo:' || {host('w')} || '/' || {slug("list_filter(string_split(" + part('w', 3) + ", '/'), lambda p: p <> '')[1]")} || '/' || {slug("list_filter(string_split(" + part('w', 3) + ", '/'), lambda p: p <> '')[2]")}
 WHEN {host('w')} <> '' THEN 'host:' || {host('w')} ELSE 'row:' || {slug("coalesce(nullif(evidence_id, ''), nullif(title, ''), 'unknown')")} END"""
#: The greedy pass itself, one row a step: of each claim first the rows that support it, then those that oppose it, which find the ids and origins of the former taken.
_GREEDY = f"""WITH RECURSIVE {_SIDED}, o AS (SELECT s.claim, s.side, u.position, u.evidence_id, {_ORIGIN_EV} AS origin, sha256({normal('text')}) AS content
  FROM s JOIN (SELECT *, coalesce(nullif(final_url, ''), url) AS w FROM u) u USING (position) WHERE claim_eligible AND coalesce(evidence_id, '') <> ''),
 l AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY claim, side DESC, position) AS k FROM o),
 g AS (SELECT 0::BIGINT AS k, ''::VARCHAR AS claim, ''::VARCHAR AS side, 0::BIGINT AS position, ''::VARCHAR AS origin, []::VARCHAR[] AS ids, []::VARCHAR[] AS origins, []::VARCHAR[] AS contents, false AS took
  UNION ALL SELECT x.k, x.claim, x.side, x.position, x.origin, CASE WHEN x.took THEN list_append(x.ids, x.evidence_id) ELSE x.ids END, CASE WHEN x.took THEN list_append(x.origins, x.origin) ELSE x.origins END, CASE WHEN x.took THEN list_append(x.contents, x.content) ELSE x.contents END, x.took
  FROM (SELECT y.*, NOT list_contains(ids, evidence_id) AND NOT list_contains(origins, origin) AND NOT list_contains(contents, content) AS took
   FROM (SELECT l.k, l.claim, l.side, l.position, l.evidence_id, l.origin, l.content, CASE WHEN g.claim = l.claim THEN g.ids ELSE [] END AS ids, CASE WHEN g.claim = l.claim THEN g.origins ELSE [] END AS origins, CASE WHEN g.claim = l.claim AND g.side = l.side THEN g.contents ELSE [] END AS contents
    FROM g JOIN l ON l.k = g.k + 1) y) x)"""


@query(_GREEDY + " SELECT claim, side, position, origin FROM g WHERE took")
def claim_chain_rows(spark: SparkSession, d: str) -> DataFrame:
    support, oppose = _chains(quality.with_quality(evidence(spark, d), "position"))
    row = lambda df, side: df.select("claim", F.lit(side).alias("side"), "position", "origin")
    return row(support, "support").unionByName(row(oppose, "oppose"))


_STANCES = _GREEDY + f""", h AS (SELECT claim, count(*) FILTER (took AND side = 'support') AS n_support, count(*) FILTER (took AND side = 'oppose') AS n_oppose FROM g WHERE k > 0 GROUP BY 1 UNION ALL
  SELECT claim, 0, 0 FROM (VALUES {', '.join(f"('{c}')" for c in CLAIMS)}) v(claim) WHERE claim NOT IN (SELECT claim FROM l)),
 st AS (SELECT *, CASE WHEN n_support > 0 AND n_oppose > 0 THEN 'conflicted' WHEN n_support >= 2 THEN 'supported' WHEN n_oppose >= 2 THEN 'opposed' ELSE 'needs_more_evidence' END AS stance,
  CASE WHEN n_support > 0 AND n_oppose > 0 THEN 'medium' WHEN n_support >= 2 OR n_oppose >= 2 THEN 'high' ELSE 'low' END AS ceiling FROM h)"""


def _stances(spark: SparkSession, e: DataFrame) -> DataFrame:
    return claims.chain_stances(*_chains(e), spark.createDataFrame([(c,) for c in CLAIMS], "claim string"))


@query(_STANCES + " SELECT claim, n_support, n_oppose, stance, ceiling FROM st")
def claim_chains(spark: SparkSession, d: str) -> DataFrame:
    return _stances(spark, quality.with_quality(evidence(spark, d), "position"))


_DOCUMENT = "lower(concat_ws(' ', title, text, publisher, connector))"


def _spec_sql(specs: dict) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{n}' AS spec, '{side}' AS side, count(*) AS evidence_count, coalesce(list(evidence_id ORDER BY position), [])[1:12] AS ids, coalesce(list(coalesce(evidence_id, '') || ': ' || coalesce(title, '') ORDER BY position), [])[1:3] AS strongest,
 CASE WHEN count(*) >= {max(1, least)} THEN 'supported' WHEN count(*) > 0 THEN 'partially_supported' ELSE 'insufficient_evidence' END AS verdict FROM u WHERE claim_eligible AND coalesce(evidence_id, '') <> '' AND {_holds(_DOCUMENT, terms)}"""
        for n, (side, terms, least) in specs.items()
    )


def _documents(spark: SparkSession, d: str, e: DataFrame | None = None) -> DataFrame:
    known = (quality.with_quality(evidence(spark, d), "position") if e is None else e).where("coalesce(evidence_id, '') <> ''")
    return claims.documents(known, F.lower(F.concat_ws(" ", "title", "text", "publisher", "connector")), text.filled(F.col("text")))


@query(f"WITH {_QUALITY} SELECT position, md5({_DOCUMENT}) AS document, left(coalesce(text, ''), 500) AS excerpt FROM u WHERE claim_eligible AND coalesce(evidence_id, '') <> ''")
def claim_documents(spark: SparkSession, d: str) -> DataFrame:
    return _documents(spark, d).select("position", F.md5(F.col("document").cast("binary")).alias("document"), "excerpt")


@query(f"WITH {_QUALITY} SELECT spec, side, evidence_count, array_to_string(ids, '|') AS evidence_ids, array_to_string(strongest, '|') AS strongest, verdict FROM ({_spec_sql(MATRIX)})")
def matrix_rows(spark: SparkSession, d: str) -> DataFrame:
    m = claims.scored_specs(_documents(spark, d), MATRIX)
    return m.select("spec", "side", "evidence_count", F.array_join("evidence_ids", "|").alias("evidence_ids"), F.array_join("strongest", "|").alias("strongest"), "verdict")


@query(f"""WITH {_QUALITY}, m AS ({_spec_sql(MATRIX)}), c AS (SELECT count(*) FILTER (verdict = 'supported' AND side = 'demand') AS demand, count(*) FILTER (verdict = 'supported' AND side = 'constraint') AS "constraint" FROM m)
SELECT *, CASE WHEN demand > 0 AND "constraint" > 0 THEN 'demand_outpacing_near_term_supply' WHEN demand > 0 THEN 'strong_demand_supply_gap_unconfirmed' ELSE 'needs_more_evidence' END AS gap_assessment FROM c""")
def gap_assessment(spark: SparkSession, d: str) -> DataFrame:
    return claims.gap(claims.scored_specs(_documents(spark, d), MATRIX))


@query(f"WITH {_QUALITY} " + " UNION ALL ".join(f"SELECT '{side}' AS side, '{n}' AS name, count(*) AS n_rows FROM u WHERE claim_eligible AND coalesce(evidence_id, '') <> '' AND contains({_DOCUMENT}, '{n.lower()}') HAVING count(*) > 0" for side, names in SIDES.items() for n in names))
def entities_by_side(spark: SparkSession, d: str) -> DataFrame:
    docs = _documents(spark, d)
    found = claims.matches(docs.select("document"), F.col("document"), {f"{side}|{n}": (n,) for side, names in SIDES.items() for n in names})
    return found.groupBy(F.substring_index("spec", "|", 1).alias("side"), F.substring_index("spec", "|", -1).alias("name")).agg(F.count(F.lit(1)).alias("n_rows"))


_CLAIM_SPECS = {c: ("claim", a, 2) for c, (a, _) in CLAIMS.items()}
_REVIEW = _STANCES + f""", sc AS ({_spec_sql(_CLAIM_SPECS)}), rv AS (SELECT spec, evidence_count, ids, stance, ceiling, CASE WHEN stance IN ('conflicted', 'opposed') THEN stance WHEN stance = 'needs_more_evidence' AND evidence_count > 0 THEN stance ELSE verdict END AS verdict FROM sc JOIN st ON claim = spec)"""


def _reviewed(spark: SparkSession, d: str) -> DataFrame:
    e = _known(spark, d)
    return claims.reviewed(claims.scored_specs(_documents(spark, d, e), _CLAIM_SPECS), _stances(spark, e))


@query(_REVIEW + " SELECT spec, evidence_count, stance, ceiling, verdict FROM rv")
def claim_review(spark: SparkSession, d: str) -> DataFrame:
    return _reviewed(spark, d).select("spec", "evidence_count", "stance", "ceiling", "verdict")


_OVERALL = _REVIEW.replace("WITH RECURSIVE " + _QUALITY, _FLAGS.replace("WITH ", "WITH RECURSIVE ", 1), 1)


@query(_OVERALL + f""", tt AS (SELECT count(*) FILTER (verdict = 'supported') AS n_supported, count(*) FILTER (verdict = 'partially_supported') AS n_partial, coalesce(bool_or(stance = 'conflicted'), false) AS chained, flatten(list(ids)) AS cited FROM rv),
 cc AS (SELECT tt.*, (SELECT count(*) FROM f WHERE len(list_distinct(list_concat(f.s, f.o))) > 1 AND list_has_any(tt.cited, list_concat(f.s, f.o))) AS n_conflicts FROM tt),
 bb AS (SELECT *, CASE WHEN n_supported >= {len(CLAIMS)} THEN 'supported' WHEN n_supported + n_partial >= {len(CLAIMS)} THEN 'partially_supported' ELSE 'needs_more_evidence' END AS base, CASE WHEN n_supported >= {len(CLAIMS)} THEN 'high' WHEN n_supported = 0 THEN 'low' ELSE 'medium' END AS sure FROM cc)
SELECT CASE WHEN chained OR (n_conflicts > 0 AND base <> 'needs_more_evidence') THEN 'conflicted' ELSE base END AS stance, CASE WHEN sure = 'high' AND (n_conflicts > 0 OR chained) THEN 'medium' ELSE sure END AS confidence, n_supported, n_partial, n_conflicts FROM bb""")
def overall_stance(spark: SparkSession, d: str) -> DataFrame:
    n = len(CLAIMS)
    flags = quality.conflict_flags(quality.with_quality(evidence(spark, d), "position"), "position", CONFLICTS)
    return claims.overall(_reviewed(spark, d), flags, n, n, n)


# --- relevance ------------------------------------------------------------------------------------------------------

#: A query plan: one query for each of five values of the data, which is the query's id and its facet.
_TOPIC = "evidence coverage of memory contracts and hiring plans"
_QUERIES = (("q1", "cache hits and model serving", "model serving", True), ("q2", "salary bands", "salary_bands", True), ("q3", "claim review of source diversity", "review", False))
_SPECS = (*_QUERIES, (None, None, "never_planned", True))
_QID = "CASE position % 5 WHEN 0 THEN 'q1' WHEN 1 THEN 'q2' WHEN 2 THEN 'q3' WHEN 3 THEN 'q9' END"
_FACET = "CASE position % 5 WHEN 0 THEN 'model serving' WHEN 1 THEN 'salary_bands' WHEN 2 THEN 'review' END"
_COV = "coalesce(round(len(list_intersect(qt, {0})) / nullif(len(qt), 0)::DOUBLE, 6), 0)"
_RELEVANT = f"""{_QUALITY}, pl AS (SELECT * FROM (VALUES {', '.join(f"('{i}', '{t}')" for i, t, _, _ in _QUERIES)}) v(qid, qtext)), z0 AS (SELECT u.*, {_QID} AS query_id, {_FACET} AS facet FROM u),
 z1 AS (SELECT z0.*, coalesce(qtext, '{_TOPIC}') AS query_text FROM z0 LEFT JOIN pl ON qid = query_id),
 z2 AS (SELECT *, {tokens('query_text')} AS qt, {tokens('title')} AS ti, {tokens('text')} AS bo, {tokens('publisher')} AS en, {tokens('facet')} AS fa FROM z1),
 z AS (SELECT *, round({_COV.format('ti')} * 0.45 + {_COV.format('bo')} * 0.35 + {_COV.format('en')} * 0.15 + {_COV.format('fa')} * 0.05, 6) AS relevance, array_to_string(list_sort(list_intersect(qt, list_concat(ti, bo, en, fa))), '|') AS matched_terms FROM z2)"""


def _relevant(spark: SparkSession, d: str) -> DataFrame:
    e = enriched(spark, d).withColumn("query_id", F.expr(_QID)).withColumn("facet", F.expr(_FACET))
    plan = spark.createDataFrame([(i, t) for i, t, _, _ in _QUERIES], "query_id string, query string")
    asked = relevance.with_query(e, plan, "query_id", "query", _TOPIC)
    return relevance.with_relevance(asked, F.col("query_text"), F.col("title"), F.col("text"), F.col("publisher"), F.col("facet"))


@query(f"WITH {_RELEVANT} SELECT position, query_text, relevance, matched_terms FROM z")
def evidence_relevance(spark: SparkSession, d: str) -> DataFrame:
    return _relevant(spark, d).select("position", "query_text", "relevance", "matched_terms")


_FAMILY = rf"""CASE WHEN lower({squeeze('publisher')}) <> '' THEN 'publisher:' || lower({squeeze('publisher')}) WHEN regexp_replace(lower({part('w', 2)}), '^www\.', '') <> '' THEN 'host:' || regexp_replace(lower({part('w', 2)}), '^www\.', '') ELSE 'row:' || position END"""
_PREVIEW = f"""{_RELEVANT}, fm AS (SELECT *, {_FAMILY} AS family FROM (SELECT *, coalesce(nullif(final_url, ''), url) AS w FROM z) WHERE claim_eligible AND NOT is_duplicate AND relevance > 0 AND coalesce(evidence_id, '') <> ''),
 best AS (SELECT * FROM fm QUALIFY row_number() OVER (PARTITION BY family ORDER BY relevance DESC, hundredths DESC, evidence_id) = 1), pv AS (SELECT *, row_number() OVER (ORDER BY relevance DESC, hundredths DESC, evidence_id) AS rank FROM best QUALIFY rank <= 20)"""


def _previewed(rows: DataFrame) -> DataFrame:
    fit = rows.where("claim_eligible and not is_duplicate and coalesce(evidence_id, '') <> ''")
    family = text.family_key(text.filled(F.col("final_url"), F.col("url")), F.lit(None).cast("string"), F.col("publisher"), F.col("position"))
    return relevance.preview(fit.withColumn("family", family), None, "family", "quality_score", "evidence_id")


@query(f"WITH {_PREVIEW} SELECT rank, family, evidence_id, relevance FROM pv")
def evidence_preview(spark: SparkSession, d: str) -> DataFrame:
    return _previewed(_relevant(spark, d)).select(F.col("rank").cast("bigint").alias("rank"), "family", "evidence_id", "relevance")


@query(f"""WITH {_PREVIEW}, ke AS (SELECT evidence_id, 0 AS part, rank::DOUBLE AS x, 0::DOUBLE AS y FROM pv UNION ALL SELECT evidence_id, 1, -relevance, -hundredths / 100.0 FROM z WHERE NOT is_duplicate AND coalesce(evidence_id, '') <> '' AND evidence_id NOT IN (SELECT evidence_id FROM pv))
SELECT row_number() OVER (ORDER BY part, x, y, evidence_id) AS place, evidence_id FROM ke QUALIFY place <= 25""")
def key_evidence(spark: SparkSession, d: str) -> DataFrame:
    r = materialise(_relevant(spark, d).select("position", "evidence_id", "final_url", "url", "publisher", "claim_eligible", "is_duplicate", "relevance", "quality_score"), "relevant")
    return relevance.key_evidence(_previewed(r), r, "evidence_id", 25).withColumn("place", F.col("place").cast("bigint"))


_PLANNED = f"""WITH {_RELEVANT}, sp AS (SELECT facet, bool_or(required) AS required, count(query_id) > 0 AS planned, count(query_id) AS n_queries FROM (VALUES {', '.join(f"({'NULL' if i is None else _quote(i)}, '{f}', {r})" for i, _, f, r in _SPECS)}) v(query_id, facet, required) GROUP BY 1),
 fy AS (SELECT sp.*, (SELECT count(*) FROM z WHERE claim_eligible AND NOT is_duplicate AND relevance >= 0.15 AND z.facet = sp.facet) AS relevant_yield FROM sp),
 fc AS (SELECT *, CASE WHEN relevant_yield > 0 THEN 'covered' WHEN planned THEN 'missing' ELSE 'omitted_by_budget' END AS status FROM fy)"""


def _planned(spark: SparkSession, d: str) -> DataFrame:
    specs = spark.createDataFrame([(i, f, r) for i, _, f, r in _SPECS], "query_id string, facet string, required boolean")
    return relevance.planned_coverage(_relevant(spark, d).where("claim_eligible and not is_duplicate"), specs, "facet")


@query(_PLANNED + " SELECT * FROM fc")
def planned_facets(spark: SparkSession, d: str) -> DataFrame:
    return _planned(spark, d)


@query(_PLANNED + " SELECT count(*) FILTER (required) AS required_facets, count(*) FILTER (required AND relevant_yield > 0) AS required_facets_covered, count(*) FILTER (required AND relevant_yield = 0) AS missing_required_facets, count(*) FILTER (required AND NOT planned) AS omitted_required_facets FROM fc")
def facet_summary(spark: SparkSession, d: str) -> DataFrame:
    return relevance.coverage_summary(_planned(spark, d))
