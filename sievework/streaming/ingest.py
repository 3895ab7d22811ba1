"""Evidence that arrives as JSON lines: deduplicated and aggregated as a stream, late rows within a bound."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.functions.text import canonical_page, filled

SCHEMA = "ordinal bigint, evidence_id string, source_id string, connector string, title string, url string, text string, captured_at timestamp"


def read(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_trigger).json(folder)


def first_deliveries(rows: DataFrame, late: str = "7 days") -> DataFrame:
    """Rows without redeliveries: one for each evidence id and page, of those that arrive within `late` of each other. State older than that is dropped."""
    keyed = rows.withColumn("page", canonical_page(F.col("url"))).withColumn("source_id", filled(F.col("source_id"), F.lit("unknown")))
    return keyed.withWatermark("captured_at", late).dropDuplicatesWithinWatermark(["evidence_id", "page"])


def daily_counts(rows: DataFrame, late: str = "7 days") -> DataFrame:
    """Rows by day and source, final once the watermark has passed the day."""
    return rows.withWatermark("captured_at", late).groupBy(F.window("captured_at", "1 day"), "source_id").agg(F.count(F.lit(1)).alias("n_rows"))
