"""Clusters of copies, their representatives, and rows that stand for independent origins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sievework.functions.text import copy_key, filled
from sievework.operators.rows import with_position
from sievework.session import discard, materialise


def keyed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("copy_key", copy_key(F.col("url"), F.col("title"), F.col("text"), F.col("ordinal")))


def clusters(rows: DataFrame) -> DataFrame:
    """Keys of two rows or more: cluster number among all keys in sorted order, size, first row, up to 3 titles of the first 3 rows.

    The first rows are kept by a bounded aggregate, so a key with a third of all rows is merged from partial results.
    """
    first = F.slice(F.array_sort(F.collect_list(F.struct("ordinal", "title"))), 1, 3)
    n = F.row_number().over(W.partitionBy("copy_key", "part").orderBy("ordinal"))
    # of each key, only the first 3 rows of each of 64 parts can be among its first 3
    heads = keyed(rows).select("copy_key", "ordinal", "title", F.pmod("ordinal", F.lit(64)).alias("part"))
    few = heads.withColumn("n", n).where("n <= 3").groupBy("copy_key").agg(first.alias("first"))
    sizes = heads.groupBy("copy_key").agg(F.count(F.lit(1)).alias("copies"), F.min("ordinal").alias("first_ordinal"))
    numbered = with_position(sizes, ["copy_key"], "cluster").where("copies > 1")
    titles = F.array_join(F.filter(F.transform("first", lambda s: filled(s["title"])), lambda t: t != ""), "|")
    return numbered.join(few, "copy_key").select("cluster", "copy_key", "copies", "first_ordinal", titles.alias("titles"))


def representatives(scored: DataFrame) -> DataFrame:
    """copy_key, ordinal of the row that stands for the key: the highest score, the first on ties. Partial before the shuffle."""
    return scored.groupBy("copy_key").agg(F.max_by("ordinal", F.struct("score", -F.col("ordinal"))).alias("ordinal"), F.max("score").alias("score"))


def independent(rows: DataFrame, key: str, origin: str, content: str, ident: str | None = None, within: str | None = None, excluded: DataFrame | None = None) -> DataFrame:
    """The rows a greedy pass in the order of key accepts: a row is taken if no row taken before shares its origin, its content or its id.

    ident: the column of ids; rows without an id are never taken. within: a column whose values have a pass each.
    excluded: rows (within, ident, origin) whose ids and origins count as taken, though not their contents.

    In rounds: a row that is first among the open rows of its origin, its content and its id is taken, and all open rows
    that share one of these with it are closed. A round is a few small aggregates and joins over written tables; the
    first row of each pass is taken in any round, and what it closes is gone. A hot origin or content is reduced to
    one row by partial aggregates before it is joined.
    """
    w, names = [within] if within else [], [origin, content, *([ident] if ident else [])]
    start = rows.select(*w, key, *names)
    if ident:
        start = start.where(F.coalesce(ident, F.lit("")) != "")
    if excluded is not None:
        for n in (ident, origin):
            start = start.join(excluded.select(*w, n).distinct(), [*w, n], "left_anti")
    open_rows, taken = materialise(start, "open-rows"), None
    while not open_rows.isEmpty():
        first = open_rows
        for n in names:
            first = first.join(open_rows.groupBy(*w, n).agg(F.min(key).alias(f"__{n}")), [*w, n]).where(F.col(key) == F.col(f"__{n}")).drop(f"__{n}")
        won = materialise(first.select(*w, key, *names), "taken-rows")
        taken = won if taken is None else taken.unionByName(won)
        left = open_rows
        for n in names:
            left = left.join(won.select(*w, n).distinct(), [*w, n], "left_anti")
        before, open_rows = open_rows, materialise(left.select(*w, key, *names), "open-rows")
        discard(before)
    return rows.select(*w, key, *names).limit(0) if taken is None else taken
