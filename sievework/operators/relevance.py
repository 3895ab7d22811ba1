"""Relevance of rows to a query, bounded previews, and coverage of facets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sievework.functions.text import tokens


def coverage(wanted: Column, have: Column) -> Column:
    """Share of the wanted tokens that a text has, rounded to 6 digits; 0 without any."""
    return F.coalesce(F.round(F.try_divide(F.size(F.array_intersect(wanted, have)), F.size(wanted)), 6), F.lit(0.0))


# What the parts of a row weigh in its relevance, and what a term counts where it is found.
WEIGHTS = (("title", 0.45), ("body", 0.35), ("entity", 0.15), ("facet", 0.05))
TERM_TITLE, TERM_TOPIC, TERM_BODY = 1.0, 0.8, 0.4
#: Least relevance of a row that covers its facet.
LEAST = 0.15


def with_relevance(rows: DataFrame, query: Column, title: Column, body: Column, entity: Column, facet: Column) -> DataFrame:
    """rows with relevance, relevance_components and matched_terms: weighted shares of the query's tokens in title, body, entity and facet.

    Components are rounded to 6 digits before they are weighed, and so is the sum. A query without tokens gives 0.
    """
    r = rows.withColumns({f"__{n}": tokens(c) for n, c in zip(("query", "title", "body", "entity", "facet"), (query, title, body, entity, facet))})
    parts = {n: coverage(F.col("__query"), F.col(f"__{n}")) for n, _ in WEIGHTS}
    score = F.round(sum((parts[n] * w for n, w in WEIGHTS[1:]), parts["title"] * WEIGHTS[0][1]), 6)
    every = F.concat(*[F.col(f"__{n}") for n, _ in WEIGHTS])
    out = r.withColumn("relevance", score).withColumn("relevance_components", F.struct(*[c.alias(n) for n, c in parts.items()])).withColumn("matched_terms", F.array_join(F.array_sort(F.array_intersect("__query", every)), "|"))
    return out.drop("__query", *[f"__{n}" for n, _ in WEIGHTS])


def with_query(rows: DataFrame, queries: DataFrame, query_id: str, query: str, default: str) -> DataFrame:
    """rows with the column query_text: the query of their id, or the default. queries has each id once and stays small beside rows."""
    known = queries.select(F.col(query_id).alias("__qid"), F.nullif(F.col(query), F.lit("")).alias("__q"))
    return rows.join(known, F.col(query_id) == F.col("__qid"), "left").withColumn("query_text", F.when(F.col("__qid").isNull(), default).otherwise(F.coalesce("__q", F.lit(default)))).drop("__qid", "__q")


def text_relevance(query: Column, title: Column, text: Column, topics: Column) -> tuple[Column, Column]:
    """Relevance and matched terms: each distinct term of the query counts where it weighs most, title, topics or text; the mean over all terms."""
    q, t, b, o = tokens(query), tokens(title), tokens(text), tokens(topics)
    each = F.transform(q, lambda x: F.when(F.array_contains(t, x), TERM_TITLE).when(F.array_contains(o, x), TERM_TOPIC).when(F.array_contains(b, x), TERM_BODY).otherwise(0.0))
    total = F.aggregate(each, F.lit(0.0), lambda n, x: n + x)
    return F.coalesce(F.round(F.try_divide(total, F.size(q)), 6), F.lit(0.0)), F.filter(q, lambda x: F.array_contains(F.concat(t, o, b), x))


def with_rank_score(rows: DataFrame, relevance: Column, stars: Column, forks: Column, recency: Column, archived: Column) -> DataFrame:
    """rows with the parts of a repository's rank and their sum, to 4 digits: relevance leads, adoption and upkeep follow, archived ones fall back."""
    number = lambda c: F.greatest(F.lit(0.0), F.coalesce(c.cast("string").try_cast("double"), F.lit(0.0)))
    adoption = F.least(F.lit(24.0), 4 * F.log10(number(stars) + 1)) + F.least(F.lit(6.0), 2 * F.log10(number(forks) + 1))
    penalty = F.when(F.coalesce(archived, F.lit(False)), -35.0).otherwise(0.0)
    total = F.round(relevance * 100 + adoption + recency + penalty, 4)
    return rows.withColumns({"topical_relevance": F.round(relevance * 100, 4), "adoption": F.round(adoption, 4), "maintenance_recency": recency, "archived_penalty": penalty, "rank_score": total})


def preview(scored: DataFrame, group: str | None, family: str, quality: str | None = None, ident: str = "ordinal", most: int = 20) -> DataFrame:
    """The best rows, one of each family, at most `most` (of each group): by relevance, then quality, then id. Rows without relevance are left out.

    Rows that may not support claims and copies should be gone. Families are reduced to their best row first, with
    partial aggregation, so that only those are ranked.
    """
    g = [group] if group else []
    q = [F.col(quality).alias("quality")] if quality else [F.lit(0.0).alias("quality")]
    flat = scored.where("relevance > 0").select(*g, family, F.col(ident), "relevance", *q)
    # the smallest of (-relevance, -quality, id), as ids may be texts
    best = flat.groupBy(*g, family).agg(F.min(F.struct((-F.col("relevance")).alias("r"), (-F.col("quality")).alias("q"), F.col(ident).alias("i"))).alias("b"))
    back = best.select(*g, family, F.col("b.i").alias(ident), (-F.col("b.r")).alias("relevance"), (-F.col("b.q")).alias("__quality"))
    order = [F.desc("relevance"), F.desc("__quality"), F.col(ident)]
    if not group:
        # a plain ordered limit keeps `most` rows of each task; the window then sees no more than these
        back = back.orderBy(*order).limit(most)
    ranked = back.withColumn("rank", F.row_number().over(W.partitionBy(*g).orderBy(*order)))
    return ranked.where(F.col("rank") <= most).drop("__quality")


def facet_coverage(scored: DataFrame, group: str, least: float = LEAST) -> DataFrame:
    """group, rows_seen, rows_relevant, first_relevant, status of each group of rows."""
    ok = F.col("relevance") >= least
    agg = scored.groupBy(group).agg(F.count(F.lit(1)).alias("rows_seen"), F.sum(F.when(ok, 1).otherwise(0)).alias("rows_relevant"), F.min(F.when(ok, F.col("ordinal"))).alias("first_relevant"))
    return agg.withColumn("status", F.when(F.col("rows_relevant") > 0, "covered").otherwise("missing"))


def planned_coverage(rows: DataFrame, specs: DataFrame, facet: str, least: float = LEAST) -> DataFrame:
    """facet, required, planned, n_queries, relevant_yield, status: one row for each facet asked for, also those that no row has.

    rows: those that may support claims and are no copies, with relevance. specs: facet, required, query_id (null for a
    facet that no query looks for); many rows for a facet. 'covered' with a relevant row, 'missing' if only planned,
    else 'omitted_by_budget'. Rows are counted before they meet the specifications.
    """
    asked = specs.where(F.coalesce(facet, F.lit("")) != "").groupBy(facet).agg(F.bool_or("required").alias("required"), (F.count("query_id") > 0).alias("planned"), F.count("query_id").alias("n_queries"))
    found = rows.where(F.col("relevance") >= least).groupBy(facet).agg(F.count(F.lit(1)).alias("n"))
    n = F.coalesce("n", F.lit(0))
    status = F.when(n > 0, "covered").when(F.col("planned"), "missing").otherwise("omitted_by_budget")
    return asked.join(found, facet, "left").select(facet, "required", "planned", "n_queries", n.alias("relevant_yield"), status.alias("status"))


def coverage_summary(planned: DataFrame) -> DataFrame:
    """required_facets, covered, missing and omitted ones among them."""
    count = lambda c: F.coalesce(F.sum(F.when(F.col("required") & c, 1).otherwise(0)), F.lit(0)).cast("bigint")
    return planned.agg(count(F.lit(True)).alias("required_facets"), count(F.col("relevant_yield") > 0).alias("required_facets_covered"), count(F.col("relevant_yield") == 0).alias("missing_required_facets"), count(~F.col("planned")).alias("omitted_required_facets"))


def key_evidence(preview_rows: DataFrame, rows: DataFrame, ident: str, most: int = 10) -> DataFrame:
    """place, ident: the preview's rows in their order, then other rows that are no copies by relevance, quality and id; at most `most` in all.

    rows: ident, relevance, quality_score, is_duplicate. Both parts are ordered limits before they meet.
    """
    a = preview_rows.select(ident, F.lit(0).alias("part"), F.col("rank").cast("double").alias("x"), F.lit(0.0).alias("y")).orderBy("x").limit(most)
    shown = preview_rows.select(ident)
    rest = rows.where(~F.col("is_duplicate") & (F.coalesce(F.col(ident), F.lit("")) != "")).join(shown, ident, "left_anti")
    b = rest.select(ident, F.lit(1).alias("part"), (-F.col("relevance")).alias("x"), (-F.col("quality_score")).alias("y")).orderBy("x", "y", ident).limit(most)
    n = F.row_number().over(W.partitionBy().orderBy("part", "x", "y", ident))  # at most twice `most` rows
    return a.unionByName(b).select(n.alias("place"), ident).where(F.col("place") <= most)


def key_rows(preview_rows: DataFrame, all_rows: DataFrame, most: int = 10) -> DataFrame:
    """The preview's rows first, then the other rows by relevance; at most `most` in all."""
    a = preview_rows.select("ordinal", "relevance", F.lit(0).alias("part"))
    b = all_rows.join(preview_rows.select("ordinal"), "ordinal", "left_anti").select("ordinal", "relevance", F.lit(1).alias("part"))
    return a.unionByName(b).orderBy("part", F.desc("relevance"), "ordinal").limit(most)


def best_label(texts: DataFrame, key: str, scored: dict[str, Column], least: int = 1, other: str = "generic") -> DataFrame:
    """key, label, score: the label of the highest score, the first listed on ties; other below least."""
    each = F.array(*[F.struct(s.alias("score"), F.lit(-i).alias("at"), F.lit(n).alias("label")) for i, (n, s) in enumerate(scored.items())])
    top = F.array_max(each)
    return texts.select(key, F.when(top["score"] >= least, top["label"]).otherwise(other).alias("label"), top["score"].alias("score"))
