"""Reviews as a stream: an extension beyond the weekly batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T


def landed_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def cleaned_stream(reviews: DataFrame, late: str = "7 days") -> DataFrame:
    """Deduplicated within the watermark, scrubbed, with the native content rules. Which of two repeated rows survives
    depends on arrival; the batch operators decide by order."""
    once = reviews.withColumn("posted_at", F.col("posted_at").cast("timestamp")).withWatermark("posted_at", late).dropDuplicatesWithinWatermark(["source", "review_id"])
    text = T.scrub(T.merge_fields(F.col("title"), F.col("body")))
    return once.withColumn("text", text).where(~T.has_emoji(F.col("title"), F.col("body")) & (T.substantive_tokens(F.col("text")) >= 5) & ~T.is_non_english(F.col("text")))


def weekly_counts(cleaned: DataFrame) -> DataFrame:
    """(window, product, n) of weeks that start on Monday."""
    week = F.window("posted_at", "7 days", "7 days", "4 days")
    return cleaned.groupBy(week.alias("week"), "product").agg(F.count(F.lit(1)).alias("n"))
