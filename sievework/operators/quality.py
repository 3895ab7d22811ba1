"""Quality of evidence rows: why a row is invalid, what it may support, its score, tier and copies, and the report on all rows.

Rows may lack any of the columns named here; a missing column counts as null. Nothing is collected but the report's
own few rows. Defined results: a null status, type, window or age tests nothing; a row without text has the reasons
that its fetch gives it; an empty table gives a report of zeros.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sievework.functions.text import copy_key, filled, normal
from sievework.operators import validity
from sievework.operators.claims import any_term, first_values
from sievework.operators.rows import with_position

# Connectors by reliability, adjustments by confidence (both in hundredths), words of authoritative kinds,
# and what marks rows that only point to content.
RELIABILITY = {"finance_quote": ("high_reliability_connector", 25), "web_page": ("medium_reliability_connector", 12), "rss": ("medium_reliability_connector", 12), "manual": ("manual_or_logged_in_source", -5), "browser_audit": ("manual_or_logged_in_source", -5), "logged_in_url": ("manual_or_logged_in_source", -5)}
CONFIDENCE = {"high": 15, "medium_high": 10, "medium": 0, "medium_low": -10, "low": -20}
AUTHORITATIVE = ("official", "ir", "regulatory")
DISCOVERY_KINDS, DISCOVERY_IDS, DISCOVERY_CLASS = ("platform_search_page",), ("platform_search_pages",), "discovery_only"
SUPPORTS, OPPOSES = ("for", "positive", "support", "supported", "supports"), ("against", "negative", "oppose", "opposed", "opposes")


def optional(rows: DataFrame, name: str, kind: str = "string") -> Column:
    """A column of rows, or null where it is missing."""
    return F.col(name) if name in rows.columns else F.lit(None).cast(kind)


def _low(rows: DataFrame, name: str) -> Column:
    return F.lower(F.coalesce(optional(rows, name), F.lit("")))


def _text(rows: DataFrame) -> Column:
    return filled(optional(rows, "text"), optional(rows, "text_excerpt"))


def _url(rows: DataFrame) -> Column:
    return filled(optional(rows, "url"), optional(rows, "source_url"))


def with_reasons(rows: DataFrame, into: str = "content_invalid_reasons") -> DataFrame:
    """rows with the distinct reasons in their order why each cannot support claims: carried ones, flags, the status, and for fetched pages what they hold.

    The normalised text of fetched pages is a column of a projection below, so that it is made once and not for each mark.
    """
    carried = F.filter(F.coalesce(optional(rows, "content_invalid_reasons", "array<string>"), F.array().cast("array<string>")), lambda r: F.coalesce(r, F.lit("")) != "")
    none = F.size(carried) == 0
    flagged = F.coalesce(optional(rows, "content_invalid", "boolean"), F.lit(False)) | ~F.coalesce(optional(rows, "content_valid", "boolean"), F.lit(True))
    blocked = F.coalesce(optional(rows, "access_blocked", "boolean"), F.lit(False))
    status = optional(rows, "http_status").cast("string")
    number = status.try_cast("int")
    fetched = (_low(rows, "connector") == "web_page") | F.coalesce(optional(rows, "transport_fetched", "boolean"), F.lit(False))
    described = F.lit(False)
    for name in ("http_status", "content_type", "final_url", "access_blocked"):
        described |= optional(rows, name).isNotNull()
    pdf = F.coalesce(optional(rows, "extracted_content", "boolean"), F.lit(False))
    seen = rows.withColumns({"__t": F.when(fetched, normal(_text(rows))), "__k": validity.media_type(optional(rows, "content_type"))})
    page = validity.page_reasons(F.col("__k"), F.col("__t"), filled(optional(rows, "final_url"), _url(rows)), pdf, described)
    own = [
        F.when(none & flagged, "explicit_invalid").when(none & blocked, "access_blocked"),
        F.when(number >= 400, F.concat(F.lit("http_status_"), number.cast("string"))).when(status.isNotNull() & number.isNull(), "invalid_http_status"),
    ]
    held = F.when(F.col("__t").isNotNull(), F.array_compact(F.array(*page))).otherwise(F.array().cast("array<string>"))
    return seen.withColumn(into, F.array_distinct(F.concat(carried, F.array_compact(F.array(*own)), held))).drop("__t", "__k")


def claim_eligible(rows: DataFrame, reasons: Column) -> Column:
    """Whether a row may support claims: valid, accepted if it was judged, in time if it has a window, and not a mere pointer to content."""
    fresh, age = _low(rows, "freshness_status"), optional(rows, "age_days").cast("string")
    days = age.try_cast("double")
    timely = ~fresh.isin("stale", "future_dated") & (age.isNull() | F.coalesce((days >= 0) & (days < float("inf")), F.lit(False))) & (optional(rows, "freshness_window_days").isNull() | (fresh == "fresh"))
    content = ~_low(rows, "source_kind").isin(*DISCOVERY_KINDS) & ~_low(rows, "source_id").isin(*DISCOVERY_IDS) & (_low(rows, "source_class") != DISCOVERY_CLASS)
    return (F.size(reasons) == 0) & F.coalesce(optional(rows, "disposition") == "accepted", F.lit(True)) & timely & content


def polarity(rows: DataFrame, mapped: Column, eligible: Column) -> Column:
    """support, oppose or null: the entry of a claim's map, else the row's own polarity; only of rows that may support claims."""
    value = F.lower(filled(mapped, optional(rows, "claim_polarity"), optional(rows, "polarity")))
    return F.when(eligible & value.isin(*SUPPORTS), "support").when(eligible & value.isin(*OPPOSES), "oppose")


def _each_signal(rows: DataFrame) -> list[Column]:
    """What counts for or against a row, in order: (reason or null, hundredths)."""
    pair = lambda reason, n: F.struct(F.lit(reason).cast("string").alias("reason"), F.lit(n).alias("n"))
    connector, kind, url, text = _low(rows, "connector"), F.lower(filled(optional(rows, "source_kind"), optional(rows, "entity_type"))), _url(rows), _text(rows)
    confidence = F.lower(filled(optional(rows, "source_confidence"), optional(rows, "confidence"), F.lit("medium")))
    reliability = F.when(connector == "", pair("missing_connector", -10))
    for name, (reason, n) in RELIABILITY.items():
        reliability = reliability.when(connector == name, pair(reason, n))
    grade = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for c in CONFIDENCE.items() for x in c]), confidence), F.lit(0))
    official = F.lit(False)
    for word in AUTHORITATIVE:
        official |= F.contains(kind, F.lit(word))
    return [
        reliability.otherwise(pair("connector_present", 0)),
        F.struct(F.when(confidence != "medium", F.concat(F.lit("source_confidence_"), confidence)).alias("reason"), grade.alias("n")),
        F.when(official, pair("source_kind_authoritative", 10)).otherwise(pair(None, 0)),
        F.when(url.startswith("https://"), pair("https_url", 5)).when(url == "", pair("missing_url", -12)).otherwise(pair(None, 0)),
        F.when(filled(optional(rows, "title")) != "", pair(None, 3)).otherwise(pair("missing_title", -4)),
        F.when(F.length(text) >= 240, pair("substantive_excerpt", 5)).when(text == "", pair("missing_text", -10)).otherwise(pair(None, 0)),
    ]


def with_quality(rows: DataFrame, position: str) -> DataFrame:
    """rows with content_valid, content_invalid_reasons, claim_eligible, quality_score, quality_tier, quality_reasons and dedupe_key.

    Scores are added in whole hundredths and bounded by 0 and 1; invalid rows have 0. The reasons are found once, in a
    projection of their own, as all else depends on them.
    """
    known = with_reasons(rows, "__reasons").withColumn("__signals", F.array(*_each_signal(rows)))
    reasons, valid = F.col("__reasons"), F.size("__reasons") == 0
    total = F.aggregate("__signals", F.lit(50), lambda n, s: n + s["n"])
    score = F.when(valid, F.greatest(F.lit(0), F.least(F.lit(100), total)) / 100).otherwise(0.0)
    found = F.filter(F.transform("__signals", lambda s: s["reason"]), lambda r: r.isNotNull())
    why = F.when(valid, found).otherwise(F.concat(F.array(F.lit("invalid_content")), F.transform(reasons, lambda r: F.concat(F.lit("invalid_"), r))))
    out = (
        known.withColumn("claim_eligible", claim_eligible(rows, reasons)).withColumn("content_valid", valid).withColumn("content_invalid_reasons", reasons)
        .withColumn("quality_score", score).withColumn("quality_reasons", why).withColumn("quality_tier", tier(F.col("quality_score")))
    )
    return out.withColumn("dedupe_key", copy_key(_url(rows), optional(rows, "title"), _text(rows), F.col(position))).drop("__reasons", "__signals")


def tier(score: Column) -> Column:
    return F.when(score >= 0.72, "high").when(score >= 0.45, "medium").otherwise("low")


def clusters(enriched: DataFrame, position: str) -> DataFrame:
    """dedupe_key, cluster_id, copies, keeper: keys of two rows or more, numbered among all keys in sorted order.

    Rows that only point to content take no part. The keeper is the row that stands for the key: valid before invalid,
    accepted before others, the highest score, then the first. One partial aggregate, so a hot key costs no more.
    """
    part = enriched.where((_low(enriched, "source_class") != DISCOVERY_CLASS) & (_low(enriched, "disposition") != DISCOVERY_CLASS))
    rank = F.struct("content_valid", F.coalesce(optional(enriched, "disposition") == "accepted", F.lit(False)), "quality_score", -F.col(position))
    keys = part.groupBy("dedupe_key").agg(F.count(F.lit(1)).alias("copies"), F.max_by(position, rank).alias("keeper"))
    return with_position(keys, ["dedupe_key"], "__n").where("copies > 1").withColumn("cluster_id", F.format_string("dup-%04d", "__n")).drop("__n")


def with_duplicates(enriched: DataFrame, found: DataFrame, position: str) -> DataFrame:
    """enriched with duplicate_cluster_id and is_duplicate, by the clusters of its keys."""
    part = (_low(enriched, "source_class") != DISCOVERY_CLASS) & (_low(enriched, "disposition") != DISCOVERY_CLASS)
    joined = enriched.join(found.select("dedupe_key", "cluster_id", "keeper"), "dedupe_key", "left")
    inside = part & F.col("cluster_id").isNotNull()
    return joined.withColumn("duplicate_cluster_id", F.when(inside, F.col("cluster_id"))).withColumn("is_duplicate", inside & (F.col("keeper") != F.col(position))).drop("cluster_id", "keeper")


def _hits(c: Column) -> Column:
    return F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("bigint")


def report(enriched: DataFrame) -> DataFrame:
    """One row: counts of rows, invalid and ineligible ones, ids and their collisions, unique rows, clusters, tiers, and the mean score."""
    ident = F.nullif(optional(enriched, "evidence_id"), F.lit(""))
    hundredths = F.sum(F.round(F.col("quality_score") * 100).cast("bigint"))
    return enriched.agg(
        F.count(F.lit(1)).alias("row_count"), _hits(~F.col("content_valid")).alias("invalid_evidence_count"), _hits(~F.col("claim_eligible")).alias("claim_ineligible_count"),
        F.count_distinct(ident).alias("unique_evidence_id_count"), (F.count(ident) - F.count_distinct(ident)).alias("evidence_id_collision_count"),
        (F.count(F.lit(1)) - _hits(F.col("is_duplicate"))).alias("unique_evidence_count"), F.count_distinct("duplicate_cluster_id").alias("duplicate_cluster_count"),
        F.coalesce(F.round(F.try_divide(hundredths, F.count(F.lit(1)) * F.lit(100)), 3), F.lit(0.0)).alias("average_quality_score"),
        *[_hits(F.col("quality_tier") == t).alias(f"{t}_tier") for t in ("high", "medium", "low")],
        _hits(F.col("content_valid") & ~F.col("claim_eligible")).alias("discovery_only_count"), _hits(F.col("is_duplicate")).alias("duplicate_row_count"),
    )


def counts_by(enriched: DataFrame) -> DataFrame:
    """kind, value, n_rows: rows by tier and by connector, from one pass."""
    each = F.array(F.struct(F.lit("tier").alias("kind"), F.col("quality_tier").alias("value")), F.struct(F.lit("connector").alias("kind"), filled(F.col("connector"), F.lit("unknown")).alias("value")))
    return enriched.select(F.explode(each).alias("c")).groupBy("c.kind", "c.value").agg(F.count(F.lit(1)).alias("n_rows"))


def warnings(report_row: DataFrame, n_conflicts: DataFrame) -> DataFrame:
    """warning: what a reader of the report should look at; report_row and n_conflicts have one row each."""
    n = lambda c: F.col(c).cast("string")
    each = [
        F.when(F.col("invalid_evidence_count") > 0, F.concat(n("invalid_evidence_count"), F.lit(" invalid evidence row(s) excluded from claims."))),
        F.when(F.col("discovery_only_count") > 0, F.concat(n("discovery_only_count"), F.lit(" discovery-only evidence row(s) excluded from claims."))),
        F.when(F.col("evidence_id_collision_count") > 0, F.concat(n("evidence_id_collision_count"), F.lit(" evidence id collision(s) detected; normalize before synthesis."))),
        F.when(F.col("duplicate_cluster_count") > 0, F.concat(n("duplicate_row_count"), F.lit(" duplicate evidence row(s) detected across "), n("duplicate_cluster_count"), F.lit(" cluster(s)."))),
        F.when(F.col("low_tier") > 0, F.concat(n("low_tier"), F.lit(" low-quality evidence row(s) need source review."))),
        F.when(F.col("n_conflicts") > 0, F.concat(n("n_conflicts"), F.lit(" directional conflict flag(s) need review before synthesis."))),
    ]
    return report_row.withColumn("n_conflicts", n_conflicts.scalar()).select(F.explode(F.array_compact(F.array(*each))).alias("warning"))


def conflict_flags(enriched: DataFrame, position: str, sets: dict[str, tuple[tuple[str, ...], tuple[str, ...]]]) -> DataFrame:
    """flag_id, support_ids, oppose_ids: of each set with claim-eligible rows on both sides, the ids of the first 12 of each.

    A caller's own sets replace the defaults, and an empty dict turns the test off. Rows without an id do not count.
    """
    text = normal(F.concat_ws(" ", optional(enriched, "title"), optional(enriched, "text"), optional(enriched, "text_excerpt")))
    sides = [F.when(any_term(F.col("__t"), terms), F.struct(F.lit(n).alias("flag_id"), F.lit(s).alias("side"))) for n, both in sets.items() for s, terms in zip(("support", "oppose"), both)]
    part = enriched.where(F.col("claim_eligible") & (filled(F.col("evidence_id")) != "")).select(F.col(position).alias("__p"), F.col("evidence_id").alias("__id"), text.alias("__t"))
    none = F.array().cast("array<struct<flag_id:string,side:string>>")
    hits = part.select("__p", "__id", F.explode(F.array_compact(F.array(*sides)) if sides else none).alias("h")).select("h.flag_id", "h.side", "__p", "__id")
    first = first_values(hits, ["flag_id", "side"], "__p", "__id", 12)
    at = lambda s: F.max(F.when(F.col("side") == s, F.col("values")))
    both = first.groupBy("flag_id").agg(at("support").alias("support_ids"), at("oppose").alias("oppose_ids"))
    return both.where("support_ids is not null and oppose_ids is not null")


def source_mix(enriched: DataFrame) -> DataFrame:
    """connector, n_rows of the rows that may support claims."""
    return enriched.where("claim_eligible").groupBy(filled(F.col("connector"), F.lit("unknown")).alias("connector")).agg(F.count(F.lit(1)).alias("n_rows"))


def latest_rows(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Of each key the last row, whole."""
    n = F.row_number().over(W.partitionBy(key).orderBy(F.desc(order)))
    return rows.withColumn("__n", n).where("__n = 1").drop("__n")


def reason_counts(rows: DataFrame, reasons: str) -> DataFrame:
    """reason, n_rows: how many rows have each reason; rows without one give none."""
    return rows.select(F.explode(F.array_distinct(reasons)).alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n_rows"))
