"""Queries of the operators in this subpackage, and their SQL where SQL can state them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.llm import boilerplate, encode, exact_copies, mixing, mojibake, near_copies, residue, truncation, visual_form
from sievework.session import materialise, table


def _encoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows as tuples of integers, written once, as each query reads them twice."""
    return materialise(exact_copies.encode(table(spark, sf_dir, "false_positive_evidence"), "ordinal", exact_copies.EVIDENCE), "records")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_copies.copies(_encoded(spark, sf_dir), "ordinal").select(F.col("first_key").alias("first_ordinal"), F.col("copy_key").alias("copy_ordinal"))


def p2_collapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_copies.collapse(exact_copies.encode(table(spark, sf_dir, "false_positive_evidence"), "ordinal", exact_copies.EVIDENCE), "ordinal").select(F.col("first_key").alias("first_ordinal"), "copies")


def p2_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As p2_collapsed, with the rows that take no part as records of one copy."""
    return exact_copies.records(table(spark, sf_dir, "false_positive_evidence"), _encoded(spark, sf_dir), "ordinal").select(F.col("first_key").alias("first_ordinal"), "copies")


def _residue_parts(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """Evidence and probes in one form: tbl, key, host, text, titled, status."""
    host = lambda c: F.regexp_extract(F.lower(F.col(c)), "://([^/:?#]+)", 1)
    evidence = table(spark, sf_dir, "false_positive_evidence").select(F.lit("false_positive_evidence").alias("tbl"), F.col("ordinal").alias("key"), host("url").alias("host"), "text", F.col("title").isNotNull().alias("titled"), F.lit(None).cast("double").alias("status"))
    probes = table(spark, sf_dir, "adversarial_rows").select(F.lit("adversarial_rows").alias("tbl"), F.col("ordinal").alias("key"), host("url").alias("host"), F.col("body").alias("text"), F.coalesce(F.col("body").contains("<title>"), F.lit(False)).alias("titled"), F.col("status").cast("double"))
    return [evidence, probes]


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = _residue_parts(spark, sf_dir)
    model = residue.fit(parts)
    return residue.residue(parts[0].unionByName(parts[1]), model, ["tbl", "key"]).withColumnRenamed("key", "ordinal")


def p3_usable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that stay: all with a text that is no residue."""
    parts = _residue_parts(spark, sf_dir)
    scored = residue.score(parts[0].unionByName(parts[1]), residue.fit(parts), ["tbl", "key"])
    return scored.where("score <= 0.5").select("tbl", F.col("key").alias("ordinal"))


def p3_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the labelled probes on hosts that were not trained on: how many the classifier gets right."""
    parts = _residue_parts(spark, sf_dir)
    model = residue.fit(parts)
    labelled = table(spark, sf_dir, "adversarial_rows").where("expected_valid is not null and body is not null").select(F.col("ordinal").alias("key"), "expected_valid")
    unseen = parts[1].where(residue.bucket(F.coalesce("host", F.lit(""))) == 0).join(labelled, "key").drop("expected_valid")
    scored = residue.score(unseen, model, ["key"]).join(labelled, "key")
    return scored.groupBy("expected_valid").agg(F.count(F.lit(1)).alias("n_rows"), F.sum(F.when((F.col("score") > 0.5) != F.col("expected_valid"), 1).otherwise(0)).alias("n_right"))


def _evidence_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "false_positive_evidence").where("text <> ''")
    return rows.select("ordinal", F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.col("text")).alias("text"))


def _near(spark: SparkSession, sf_dir: str) -> near_copies.Found:
    return near_copies.links(visual_form.common_form(_evidence_texts(spark, sf_dir), ["ordinal"], "text"), "ordinal", "form", near_copies.FOUND)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies.expand(_near(spark, sf_dir)).select(F.col("key_a").alias("ordinal_a"), F.col("key_b").alias("ordinal_b"))


def p4_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row that takes part, with the class of its words and the number of classes that is linked to."""
    return near_copies.linked(_near(spark, sf_dir)).withColumnRenamed("key", "ordinal")


def p4_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies.groups(_near(spark, sf_dir)).select(F.col("key").alias("ordinal"), "group_id")


def _cut(spark: SparkSession, sf_dir: str) -> list[tuple[str, DataFrame]]:
    parts = (("false_positive_evidence", "source_id", "text"), ("b4_results", "host", "snippet"))
    return [(name, truncation.judge(table(spark, sf_dir, name), ["ordinal"], source, text)) for name, source, text in parts]


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = [judged.where("cut").select(F.lit(name).alias("tbl"), "ordinal") for name, judged in _cut(spark, sf_dir)]
    return a.unionByName(b)


def p5_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = [truncation.rates(judged).select(F.lit(name).alias("tbl"), "*") for name, judged in _cut(spark, sf_dir)]
    return a.unionByName(b)


def _split(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "fetched_pages")
    return boilerplate.split(pages, "ordinal", "content_blocks", boilerplate.fit(pages, "ordinal", "content_blocks"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _split(spark, sf_dir).select("ordinal", F.explode("rest").alias("block_index")).withColumn("block_index", F.col("block_index").cast("bigint"))


def p6_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page's text without furniture: its main blocks, joined by line breaks; null for pages without blocks."""
    pages = table(spark, sf_dir, "fetched_pages").select("ordinal", "content_blocks")
    main = F.array_join(F.transform("main", lambda i: F.get(F.col("content_blocks"), i)["text"]), "\n")
    return pages.join(_split(spark, sf_dir), "ordinal", "left").select("ordinal", main.alias("main_text"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = [
        visual_form.same_looks(table(spark, sf_dir, name), "ordinal", text).select(F.lit(name).alias("tbl"), F.col("key_a").alias("ordinal_a"), F.col("key_b").alias("ordinal_b"))
        for name, text in (("false_positive_evidence", "text"), ("adversarial_rows", "body"))
    ]
    return pairs[0].unionByName(pairs[1])


def p7_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text's form for comparisons, and clean, the text for readers: in one form too, but with the letters of its own script."""
    out = None
    for name, text in (("false_positive_evidence", "text"), ("adversarial_rows", "body")):
        rows = table(spark, sf_dir, name)
        both = visual_form.common_form(rows, ["ordinal"], text).join(visual_form.readable_form(rows, ["ordinal"], text), "ordinal")
        each = both.select(F.lit(name).alias("tbl"), "ordinal", "form", "clean")
        out = each if out is None else out.unionByName(each)
    return out


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode.encode(table(spark, sf_dir, "documents"), ["doc_id"], "text")


def _mixed(spark: SparkSession, sf_dir: str):
    counted = encode.encode(table(spark, sf_dir, "documents").join(table(spark, sf_dir, "mix_targets").select("source"), "source", "left_semi"), ["doc_id", "source"], "text", counts=True)
    return mixing.mix(materialise(counted, "token-counts"), "doc_id", "source", table(spark, sf_dir, "mix_targets"))


def p9_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixed(spark, sf_dir)[0]


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen, found = _mixed(spark, sf_dir)
    return mixing.shares(chosen, "source", found)


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mojibake.garbled(table(spark, sf_dir, "documents"), "doc_id", "text").select("doc_id")


def p10_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mojibake.garbled(table(spark, sf_dir, "documents"), "doc_id", "text").withColumnRenamed("restored", "text")


QUERIES = {"p2_found": p2_found, "p2_collapsed": p2_collapsed, "p2_records": p2_records, "p3_found": p3_found, "p3_usable": p3_usable, "p3_validation": p3_validation, "p4_found": p4_found, "p4_classes": p4_classes, "p4_groups": p4_groups, "p5_found": p5_found, "p5_rates": p5_rates, "p6_found": p6_found, "p6_main_text": p6_main_text, "p7_found": p7_found, "p7_forms": p7_forms, "p8_ids": p8_ids, "p9_mixture": p9_mixture, "p9_shares": p9_shares, "p10_found": p10_found, "p10_restored": p10_restored}

_P2 = r"""
WITH r AS (
  SELECT ordinal,
         regexp_replace(replace(lower(CASE WHEN instr(url, '?') > 0 THEN substr(url, 1, instr(url, '?') - 1) ELSE url END), 'ß', 'ss'), '[^\p{L}\p{N}]+', '', 'g')
         || CASE WHEN instr(url, '?') > 0 THEN '?' || array_to_string(list_sort(list_transform(regexp_split_to_array(substr(url, instr(url, '?') + 1), '[&;]'),
              lambda p: regexp_replace(replace(lower(p), 'ß', 'ss'), '[^\p{L}\p{N}]+', '', 'g'))), '') ELSE '' END AS u,
         regexp_replace(replace(lower(title), 'ß', 'ss'), '[^\p{L}\p{N}]+', '', 'g') AS t
  FROM false_positive_evidence WHERE url IS NOT NULL AND title IS NOT NULL),
g AS (SELECT ordinal, min(ordinal) OVER (PARTITION BY u, t) AS first_ordinal, count(*) OVER (PARTITION BY u, t) AS copies
      FROM r WHERE u NOT IN ('', '?') AND t <> '')
"""
ORACLE = {
    "p2_found": _P2 + "SELECT first_ordinal, ordinal AS copy_ordinal FROM g WHERE ordinal <> first_ordinal",
    "p2_collapsed": _P2 + "SELECT first_ordinal, copies FROM g WHERE ordinal = first_ordinal",
    "p2_records": _P2 + "SELECT first_ordinal, copies FROM g WHERE ordinal = first_ordinal UNION ALL SELECT ordinal, 1 FROM false_positive_evidence WHERE ordinal NOT IN (SELECT ordinal FROM r WHERE u NOT IN ('', '?') AND t <> '')",
}
