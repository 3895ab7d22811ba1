"""Row numbering, lookups and set operations on evidence rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sievework.functions.text import filled
from sievework.session import materialise


def with_position(rows: DataFrame, order: list[str], into: str) -> DataFrame:
    """rows with their position from 1 in the order of the columns order.

    Rows are range-partitioned, sorted and numbered inside their partition, and written once; each partition starts
    where the ones before it end. One shuffle, and no task sees all rows. order should tell all rows apart; ties are
    numbered in any order.
    """
    inside = F.lit((1 << 33) - 1)  # Spark's ids hold the partition above 33 bits that count its rows
    kept = materialise(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id()), "positions")
    part = F.shiftright("__id", 33)
    sizes = kept.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()  # one row for each partition
    starts, total = [], 0
    for r in sorted(sizes, key=lambda r: r["p"]):
        starts.append((r["p"], total))
        total += r["n"]
    # as many rows as there are partitions
    start = rows.sparkSession.createDataFrame(starts, "__part bigint, __start bigint")
    n = F.col("__id").bitwiseAND(inside) + 1 + F.col("__start")
    return kept.join(F.broadcast(start), part == F.col("__part")).withColumn(into, n).drop("__id", "__part", "__start")


def normalise(rows: DataFrame) -> DataFrame:
    """Evidence rows with defaults for missing fields and a reference ev-0001, ev-0002, ... by arrival."""
    with_defaults = rows.select(
        "ordinal", F.col("evidence_id").alias("source_evidence_id"), filled(F.col("source_id"), F.col("connector"), F.lit("unknown")).alias("source_id"),
        filled(F.col("connector"), F.lit("unknown")).alias("connector"), filled(F.col("title")).alias("title"), filled(F.col("url")).alias("url"),
    )
    return with_position(with_defaults, ["ordinal"], "position").withColumn("evidence_ref", F.format_string("ev-%04d", "position"))


def first_by(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("__n", F.row_number().over(W.partitionBy(*key).orderBy(*order))).where("__n = 1").drop("__n")


def last_value_lookup(rows: DataFrame, key: str, table: DataFrame, order: str, value: str) -> DataFrame:
    """rows with the value that the last row of table has for the key; null where table lacks it."""
    last = table.groupBy(key).agg(F.max_by(value, order).alias(value))
    return rows.join(last, key, "left")


def substitute(parents: DataFrame, children: DataFrame, parent_key: str, child_key: str) -> DataFrame:
    """Parents that have no children, and all children."""
    return parents.join(children.select(F.col(child_key).alias(parent_key)).distinct(), parent_key, "left_anti").unionByName(children, allowMissingColumns=True)


def suffixes(host: Column) -> Column:
    """A host and all its parent domains, the longest first."""
    parts = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts) - i + 1), "."))


def join_by_suffix(rows: DataFrame, host: str, owners: DataFrame, domain: str) -> DataFrame:
    """rows with the columns of owners whose domain is the row's host or its longest known parent domain."""
    each = rows.withColumn("__d", F.explode(suffixes(F.col(host)))).join(owners.withColumnRenamed(domain, "__d"), "__d")
    return each.withColumn("__n", F.row_number().over(W.partitionBy("ordinal").orderBy(F.length("__d").desc()))).where("__n = 1").drop("__n").withColumnRenamed("__d", domain)
