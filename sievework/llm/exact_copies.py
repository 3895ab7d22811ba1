"""Records that differ in nothing but white space, letter case, punctuation and field order.

Each column is dictionary-encoded: every distinct value is canonicalised once, and the canonical
value gets an integer, the smallest row id at which it occurs (no two canonical values of a column
share one, and no counter or global sort is needed). Records become sorted tuples of
(field, value id) and are grouped by these tuples of integers.

Defined results: a record takes part if each of its fields is filled and keeps a letter or digit;
all others are records of their own (in records; collapse leaves them out). Row ids must be unique and not null. Letter case is compared
in lower case, with ß as ss, which it becomes in capitals. An empty table gives an empty result.
Columns of the input other than those named are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.session import materialise

#: All that is neither letter nor digit.
_NOISE = r"[^\p{L}\p{N}]+"


def bare(text: Column) -> Column:
    """Letters and digits of a text, without letter case."""
    return F.regexp_replace(F.replace(F.lower(text), F.lit("ß"), F.lit("ss")), _NOISE, "")


def bare_url(url: Column) -> Column:
    """As bare, with the parameters after the first ? sorted."""
    head, rest = F.substring_index(url, "?", 1), F.substr(url, F.instr(url, "?") + 1)
    return F.concat(bare(head), F.when(F.instr(url, "?") > 0, F.concat(F.lit("?"), F.array_join(F.array_sort(F.transform(F.split(rest, "[&;]"), bare)), ""))).otherwise(""))


def dictionary(rows: DataFrame, key: str, column: str, canon: Callable[[Column], Column]) -> DataFrame:
    """Each distinct value of a column with the integer of its canonical form: columns value, value_id."""
    seen = rows.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.min(key).alias("__first"))
    # written, so that each distinct value is canonicalised once and not again for each use of the dictionary
    each = materialise(seen.select("value", "__first", F.unhex(F.md5(canon(F.col("value")).cast("binary"))).alias("__canon")), "dictionary")
    nothing = [F.unhex(F.md5(F.lit(x).cast("binary"))) for x in ("", "?")]
    each = each.where(~F.col("__canon").isin(*nothing))
    # spellings meet their value's integer in a join, so that no list of spellings is ever held in one place
    ids = each.groupBy("__canon").agg(F.min("__first").alias("value_id"))
    return each.join(ids, "__canon").select("value", "value_id")


def encode(rows: DataFrame, key: str, columns: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """Rows whose columns are all filled, as key and record: the sorted array of (field, value id)."""
    out = rows.select(key, *columns)
    for i, (c, canon) in enumerate(columns.items()):
        d = dictionary(rows, key, c, canon).withColumnRenamed("value_id", f"__id{i}").withColumnRenamed("value", f"__v{i}")
        out = out.join(d, out[c] == d[f"__v{i}"]).drop(c, f"__v{i}")
    return out.select(key, F.array_sort(F.array(*[F.struct(F.lit(i).alias("field"), F.col(f"__id{i}").alias("value_id")) for i in range(len(columns))])).alias("record"))


def collapse(encoded: DataFrame, key: str) -> DataFrame:
    """One row for each record: its first key and the number of copies."""
    return encoded.groupBy("record").agg(F.min(key).alias("first_key"), F.count(F.lit(1)).alias("copies"))


def records(rows: DataFrame, encoded: DataFrame, key: str) -> DataFrame:
    """As collapse, and one row for each row that takes no part, as a record of its own."""
    alone = rows.select(key).join(encoded.select(key), key, "left_anti").select(F.col(key).alias("first_key"), F.lit(1).cast("bigint").alias("copies"))
    return collapse(encoded, key).select("first_key", "copies").unionByName(alone)


def copies(encoded: DataFrame, key: str) -> DataFrame:
    """One row for each row that is not the first of its record: first_key, copy_key."""
    firsts = collapse(encoded, key).where("copies > 1").drop("copies")
    return encoded.join(firsts, "record").where(F.col(key) != F.col("first_key")).select("first_key", F.col(key).alias("copy_key"))


#: How the columns of evidence rows are canonicalised.
EVIDENCE = {"url": bare_url, "title": bare}
