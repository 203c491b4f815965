"""Merged, scrubbed, filtered and deduplicated texts with counts that add up."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import materialize


def cleaned(reviews: DataFrame, source_order: tuple[str, ...] = ("app_store", "play_store"), least_tokens: int = 5) -> DataFrame:
    """(source, seq, review_id, text, text_hash, drop_reason) of every review; drop_reason short, lang, dedup or null.

    Title and body are merged and scrubbed; texts of fewer than ``least_tokens`` substantive tokens are short (so is what
    scrubbing emptied), then the language is judged, then the first row of each hash by source order and ``seq``
    survives. The texts are written once, as two steps read them. Only hashes that occur again are joined, and they are written
    before, so that adaptive execution splits one that many rows share. Rows without title and body count as short.
    """
    order = F.coalesce(F.array_position(F.array(*[F.lit(s) for s in source_order]), F.col("source")), F.lit(0))
    def judged(t):
        why = F.when(T.substantive_tokens(t) < least_tokens, "short").when(T.is_non_english(t), "lang")
        return F.struct(t.alias("text"), why.alias("why"))

    scrubbed = T.let(T.scrub(T.merge_fields(F.col("title"), F.col("body"))), judged)
    rows = reviews.select("source", "seq", F.concat_ws(":", "source", "review_id").alias("review_id"), order.alias("_ord"), scrubbed.alias("j"))
    once = materialize(rows.select("source", "seq", "review_id", "_ord", "j.text", F.col("j.why").alias("_why")))
    hashed = once.withColumn("text_hash", T.text_hash(F.col("text")))
    first = materialize(hashed.where("_why is null").groupBy("text_hash").agg(F.min(F.struct("_ord", "seq")).alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n"))
    joined = hashed.join(first, "text_hash", "left")
    reason = F.coalesce(F.col("_why"), F.when(F.struct("_ord", "seq") > F.col("_first"), "dedup"))
    return joined.select("source", "seq", "review_id", "text", "text_hash", reason.alias("drop_reason"))


def corpus_stats(rows: DataFrame, by: list[str]) -> DataFrame:
    """Counts of ``cleaned`` rows, checked to add up: total_in = total_out + dropped_short + dropped_lang + dedup_count."""
    r = F.col("drop_reason")
    out = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total_in"),
        F.count_if(r.isNull()).alias("total_out"),
        F.lit(0).cast("long").alias("dropped_pii"),
        *[F.count_if(F.coalesce(r == k, F.lit(False))).alias(n) for k, n in (("short", "dropped_short"), ("lang", "dropped_lang"), ("dedup", "dedup_count"))],
    )
    adds_up = F.col("total_in") == F.col("total_out") + F.col("dropped_pii") + F.col("dropped_short") + F.col("dropped_lang") + F.col("dedup_count")
    return out.where(F.coalesce(F.assert_true(adds_up, "counts do not add up").isNull(), F.lit(True)))
