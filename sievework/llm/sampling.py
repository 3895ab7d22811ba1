"""Bounded samples for training, of which little more than the sample itself travels to the driver."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def smallest_hashes(rows: DataFrame, key: str, most: int, fit: Column) -> pd.DataFrame:
    """Of the rows for which fit holds, the `most` with the smallest hashes of their keys, at the driver.

    All rows are counted without a filter, which the files' footers answer. Rows whose hash is above what twice `most` rows
    are expected to have are left out in the scan, so that tasks send few others; only if too few fit are the rows read again.
    """
    place = F.pmod(F.xxhash64(key), F.lit(1 << 53)) / F.lit(float(1 << 53))
    share = 2.0 * most / max(1, rows.count())
    good = rows.where(fit).withColumn("__place", place)
    first = lambda df: df.orderBy("__place", key).limit(most).drop("__place").toPandas()
    if share < 1.0 and len(got := first(good.where(F.col("__place") < share))) >= most:
        return got
    return first(good)
