"""Writers: ordered JSON lines, a cache of results by key, and an append-only journal."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.session import children, exists, write_file

# Outcomes that are never cached.
UNCACHED = ("failed", "rate_limit", "robots_denied", "retry_exhausted", "timeout")


def write_json_lines(rows: DataFrame, path: str, order: str = "ordinal") -> None:
    """JSON lines whose files, in the order of their names, hold the rows in order; range-partitioned, so written in parallel."""
    rows.repartitionByRange(order).sortWithinPartitions(order).write.mode("errorifexists").json(path)


def write_cache(results: DataFrame, path: str) -> None:
    """Results with cache_key and status, partitioned by the first two digits of the key's hash; failed ones are left out."""
    kept = results.where(~F.col("status").isin(*UNCACHED)).withColumn("cached_at", F.current_timestamp()).withColumn("bucket", F.substring(F.sha2("cache_key", 256), 1, 2))
    kept.write.mode("append").partitionBy("bucket").parquet(path)


def read_cache(spark: SparkSession, path: str, keys: DataFrame, max_age_hours: float | None = None) -> DataFrame:
    """The latest cached result of each key, not older than max_age_hours; empty if there is no cache."""
    if not exists(spark, path) or not children(spark, path):
        return keys.limit(0)
    kept = spark.read.parquet(path).drop("bucket")
    if max_age_hours is not None:
        kept = kept.where(F.col("cached_at") >= F.current_timestamp() - F.make_dt_interval(hours=F.lit(int(max_age_hours)), secs=F.lit(max_age_hours % 1 * 3600).cast("decimal(18,6)")))
    others = [c for c in kept.columns if c not in ("cache_key", "cached_at")]
    latest = kept.join(keys.select("cache_key").distinct(), "cache_key", "left_semi").groupBy("cache_key").agg(F.max_by(F.struct(*others), "cached_at").alias("r"))
    return latest.select("cache_key", "r.*")


def append_journal(path: str, event: dict) -> None:
    """One line for an event, in a single write, so that writers at the same time do not mix."""
    line = json.dumps(event | {"at": event.get("at", time.time())}, sort_keys=True, ensure_ascii=False) + "\n"
    fd = os.open(path, os.O_WRONLY | os.O_APPEND | os.O_CREAT, 0o644)
    try:
        os.write(fd, line.encode())
    finally:
        os.close(fd)


def reserve_folder(root: str, name: str) -> str:
    """A new folder name, name--02, name--03, ... below root."""
    for i in range(1, 10_000):
        path = os.path.join(root, name if i == 1 else f"{name}--{i:02d}")
        try:
            os.makedirs(path)
            return path
        except FileExistsError:
            continue
    raise RuntimeError(f"no free folder for {name}")


def write_json(spark: SparkSession, path: str, value: dict) -> None:
    """One JSON document with an indent of 2 and a line break at the end, in any file system that Spark knows."""
    write_file(spark, path, (json.dumps(value, indent=2, ensure_ascii=False) + "\n").encode())


def read_json(spark: SparkSession, path: str) -> dict:
    """The document that write_json wrote; empty if there is none or it cannot be read."""
    if not exists(spark, path):
        return {}
    try:
        return dict(json.loads(spark.read.text(path, wholetext=True).first()["value"]))
    except (TypeError, ValueError):
        return {}
