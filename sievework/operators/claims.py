"""Keyword specifications against rows: matches, verdict counts, conflicts, presence.

Specifications are configuration, a short list that is known to the driver. Each row tests them by expressions
and yields one row for each that holds, so no join of rows with specifications takes place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def any_term(text: Column, terms: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for t in terms:
        out |= F.contains(text, F.lit(t.lower()))
    return out


def matches(rows: DataFrame, text: Column, specs: dict[str, tuple[str, ...]]) -> DataFrame:
    """rows with spec: one row for each specification of which a term occurs in the text."""
    hit = F.array_compact(F.array(*[F.when(any_term(text, terms), F.lit(name)) for name, terms in specs.items()]))
    return rows.withColumn("spec", F.explode(hit))


def first_values(rows: DataFrame, keys: list[str], order: str, value: str, most: int) -> DataFrame:
    """keys, n, values: how many rows each key has, and the values of its first ones in the order of order.

    The first rows of a key are among the first of each of 256 parts of it, so that a key with a third of all rows is
    never gathered: parts are ranked by a bounded window and only their heads go on.
    """
    parted = rows.select(*keys, F.col(order).alias("__o"), F.col(value).alias("__v"), F.pmod(F.xxhash64(order), F.lit(256)).alias("__part"))
    w = W.partitionBy(*keys, "__part")
    heads = parted.withColumn("__r", F.row_number().over(w.orderBy("__o"))).withColumn("__n", F.count(F.lit(1)).over(w)).where(F.col("__r") <= most)
    total = F.sum(F.when(F.col("__r") == 1, F.col("__n")))
    first = F.slice(F.array_sort(F.collect_list(F.struct("__o", "__v"))), 1, most)
    return heads.groupBy(*keys).agg(total.alias("n"), F.transform(first, lambda x: x["__v"]).alias("values"))


def spec_counts(rows: DataFrame, text: Column, specs: dict[str, tuple[str, ...]], least: int = 2) -> DataFrame:
    """spec, n_rows, first_ordinals (up to 12), verdict; specifications without a match have 0."""
    spark = rows.sparkSession
    found = matches(rows.select("ordinal", text.alias("__text")), F.col("__text"), specs).select("spec", "ordinal")
    agg = first_values(found, ["spec"], "ordinal", "ordinal", 12)
    names = spark.createDataFrame([(s,) for s in specs], "spec string")
    n = F.coalesce("n", F.lit(0))
    verdict = F.when(n >= least, "supported").when(n > 0, "needs_more_evidence").otherwise("missing")
    return names.join(agg, "spec", "left").select("spec", n.cast("bigint").alias("n_rows"), F.coalesce(F.array_join("values", "|"), F.lit("")).alias("first_ordinals"), verdict.alias("verdict"))


def conflicts(rows: DataFrame, text: Column, sets: dict[str, tuple[tuple[str, ...], tuple[str, ...]]]) -> DataFrame:
    """set_id, n_support, n_oppose of the sets that have rows on both sides; a row may be on both."""
    agg = rows.select(text.alias("__t")).agg(*[F.sum(F.when(any_term(F.col("__t"), side), 1).otherwise(0)).alias(f"{name}|{i}") for name, both in sets.items() for i, side in enumerate(both)])
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("set_id"), F.coalesce(F.col(f"`{n}|0`"), F.lit(0)).alias("n_support"), F.coalesce(F.col(f"`{n}|1`"), F.lit(0)).alias("n_oppose")) for n in sets]))
    return agg.select(each.alias("c")).select("c.*").where("n_support > 0 and n_oppose > 0")


def presence(rows: DataFrame, text: Column, names: tuple[str, ...]) -> DataFrame:
    """name, n_rows of each name that occurs in any text."""
    return matches(rows.select(text.alias("__t")), F.col("__t"), {n: (n,) for n in names}).groupBy(F.col("spec").alias("name")).agg(F.count(F.lit(1)).alias("n_rows"))


def polarities(text: Column, specs: dict[str, tuple[tuple[str, ...], tuple[str, ...]]], known: Column | None = None, own: Column | None = None) -> Column:
    """Map of claim to 'support' or 'oppose': where the text holds terms of just one side. Entries of known stay, and rows with a polarity of their own get none."""
    each = []
    for name, (support, oppose) in specs.items():
        a, b = any_term(text, support), any_term(text, oppose)
        each.append(F.when(a != b, F.struct(F.lit(name).alias("k"), F.when(a, "support").otherwise("oppose").alias("v"))))
    found = F.array_compact(F.array(*each))
    if own is not None:
        found = F.when(F.coalesce(own, F.lit("")) == "", found).otherwise(F.array().cast("array<struct<k:string,v:string>>"))
    if known is None:
        return F.map_from_entries(found)
    kept = F.coalesce(known, F.create_map().cast("map<string,string>"))
    return F.map_concat(kept, F.map_from_entries(F.filter(found, lambda e: ~F.map_contains_key(kept, e["k"]))))


def chain_stances(support: DataFrame, oppose: DataFrame, claims: DataFrame, least: int = 2) -> DataFrame:
    """claim, n_support, n_oppose, stance, ceiling: of each claim by its independent rows on both sides.

    Rows on both sides make it conflicted; least of one side supported or opposed; all else needs more evidence.
    """
    count = lambda d, n: d.groupBy("claim").agg(F.count(F.lit(1)).alias(n))
    both = claims.join(count(support, "__s"), "claim", "left").join(count(oppose, "__o"), "claim", "left").select("claim", F.coalesce("__s", F.lit(0)).alias("n_support"), F.coalesce("__o", F.lit(0)).alias("n_oppose"))
    s, o = F.col("n_support"), F.col("n_oppose")
    stance = F.when((s > 0) & (o > 0), "conflicted").when(s >= least, "supported").when(o >= least, "opposed").otherwise("needs_more_evidence")
    ceiling = F.when((s > 0) & (o > 0), "medium").when((s >= least) | (o >= least), "high").otherwise("low")
    return both.withColumn("stance", stance).withColumn("ceiling", ceiling)


def documents(rows: DataFrame, text: Column, body: Column) -> DataFrame:
    """Rows that may support claims, with what specifications are held against and an excerpt of up to 500 characters."""
    return rows.where("claim_eligible").select("position", "evidence_id", "title", "url", "connector", text.alias("document"), F.substring(body, 1, 500).alias("excerpt"))


def scored_specs(docs: DataFrame, specs: dict[str, tuple[str, tuple[str, ...], int]]) -> DataFrame:
    """spec, side, evidence_count, evidence_ids (first 12), strongest (first 3 as 'id: title'), verdict; specs: side, terms, least number of rows (0 counts as 1)."""
    spark = docs.sparkSession
    found = matches(docs.select("position", F.struct("evidence_id", F.coalesce("title", F.lit("")).alias("title")).alias("d"), "document"), F.col("document"), {n: terms for n, (_, terms, _) in specs.items()})
    agg = first_values(found.select("spec", "position", "d"), ["spec"], "position", "d", 12)
    plan = spark.createDataFrame([(n, side, max(1, least)) for n, (side, _, least) in specs.items()], "spec string, side string, least int")
    n = F.coalesce("n", F.lit(0))
    verdict = F.when(n >= F.col("least"), "supported").when(n > 0, "partially_supported").otherwise("insufficient_evidence")
    ids = F.coalesce(F.transform("values", lambda d: d["evidence_id"]), F.array().cast("array<string>"))
    best = F.coalesce(F.transform(F.slice("values", 1, 3), lambda d: F.concat(d["evidence_id"], F.lit(": "), d["title"])), F.array().cast("array<string>"))
    return plan.join(agg, "spec", "left").select("spec", "side", n.cast("bigint").alias("evidence_count"), ids.alias("evidence_ids"), best.alias("strongest"), verdict.alias("verdict"))


def gap(matrix: DataFrame) -> DataFrame:
    """gap_assessment by the supported nodes on the side of demand and on that of constraints. One row."""
    n = lambda side: F.coalesce(F.sum(F.when((F.col("verdict") == "supported") & (F.col("side") == side), 1).otherwise(0)), F.lit(0)).cast("bigint")
    counted = matrix.agg(F.count(F.lit(1)).alias("n"), n("demand").alias("demand"), n("constraint").alias("constraint"))
    demand, both = F.col("demand") > 0, (F.col("demand") > 0) & (F.col("constraint") > 0)
    return counted.select("demand", "constraint", F.when(F.col("n") == 0, "not_applicable").when(both, "demand_outpacing_near_term_supply").when(demand, "strong_demand_supply_gap_unconfirmed").otherwise("needs_more_evidence").alias("gap_assessment"))


def reviewed(scored: DataFrame, stances: DataFrame) -> DataFrame:
    """scored with stance, ceiling and the verdict that the chains leave: conflicted and opposed ones override it, and so does need of more evidence where there is some."""
    s = F.col("stance")
    verdict = F.when(s.isin("conflicted", "opposed"), s).when((s == "needs_more_evidence") & (F.col("evidence_count") > 0), s).otherwise(F.col("verdict"))
    joined = scored.join(stances.select(F.col("claim").alias("spec"), "stance", "ceiling"), "spec", "left")
    return joined.withColumn("verdict", verdict)


def overall(review: DataFrame, flags: DataFrame, for_supported: int, for_partial: int, for_high: int, any_document: bool = True) -> DataFrame:
    """stance, confidence, n_supported, n_partial, n_conflicts: of all claims, lowered by conflicts that their evidence is part of.

    flags: support_ids and oppose_ids of conflicts. One counts if a claim cites one of its ids and its sides are not
    one and the same single row. review and flags have a row for each claim and set.
    """
    n = lambda v: F.coalesce(F.sum(F.when(F.col("verdict") == v, 1).otherwise(0)), F.lit(0)).cast("bigint")
    totals = review.agg(n("supported").alias("n_supported"), n("partially_supported").alias("n_partial"), F.bool_or(F.col("stance") == "conflicted").alias("chained"), F.flatten(F.collect_list("evidence_ids")).alias("cited"))
    held = flags.agg(F.collect_list(F.struct("support_ids", "oppose_ids")).alias("flags"))
    two = lambda f: F.size(F.array_distinct(F.concat(f["support_ids"], f["oppose_ids"]))) > 1
    hit = F.size(F.filter("flags", lambda f: two(f) & F.arrays_overlap(F.col("cited"), F.concat(f["support_ids"], f["oppose_ids"]))))
    t = totals.withColumn("flags", held.scalar()).withColumn("n_conflicts", hit.cast("bigint"))
    base = F.when(F.col("n_supported") >= for_supported, "supported").when(F.col("n_supported") + F.col("n_partial") >= for_partial, "partially_supported").otherwise("needs_more_evidence")
    conflict = (F.col("n_conflicts") > 0) & (base != "needs_more_evidence")
    chained = F.coalesce("chained", F.lit(False))
    sure = F.when(F.col("n_supported") >= for_high, "high").when(F.col("n_supported") == 0, "low").otherwise("medium" if any_document else "low")
    confidence = F.when((sure == "high") & ((F.col("n_conflicts") > 0) | chained), "medium").otherwise(sure)
    return t.select(F.when(conflict | chained, "conflicted").otherwise(base).alias("stance"), confidence.alias("confidence"), "n_supported", "n_partial", "n_conflicts")
