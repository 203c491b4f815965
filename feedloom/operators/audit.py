"""The run log: latest states, lookups and the decision whether a run repeats one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STATUSES = ("ok", "partial", "failed", "skipped")


def latest_state(events: DataFrame, at: str = "event_at") -> DataFrame:
    """One row for each run_id: its last event."""
    rest = [c for c in events.columns if c != "run_id"]
    last = events.groupBy("run_id").agg(F.max_by(F.struct(*rest), F.col(at)).alias("_row"))
    return last.select("run_id", *[F.col("_row")[c].alias(c) for c in rest])


def recent(runs: DataFrame, n: int, by: list[str] | None = None) -> DataFrame:
    """The last ``n`` runs by start, of each group if ``by`` is given; ties by run_id."""
    order = [F.desc("started_at"), F.col("run_id")]
    if not by:
        return runs.orderBy(*order).limit(n)
    return runs.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= n)


def real_send() -> Column:
    return F.col("gmail_message_id").isNotNull() & ~F.coalesce("forced", F.lit(False)) & ~F.coalesce("dry_run", F.lit(False))


def prior_sends(runs: DataFrame) -> DataFrame:
    """For each product and week the last run that really sent."""
    return recent(runs.where(real_send()), 1, ["product", "iso_week"]).drop("rank")


def repeated_sends(runs: DataFrame) -> DataFrame:
    """(product, iso_week, n) that break the rule of one real send."""
    return runs.where(real_send()).groupBy("product", "iso_week").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def decisions(plans: DataFrame, runs: DataFrame) -> DataFrame:
    """``plans`` (product, iso_week, force) with ``decision``, from one pass over the log."""
    seen = runs.groupBy("product", "iso_week").agg(F.bool_or(real_send()).alias("sent"), F.bool_or(F.col("status") == "partial").alias("partial"))
    decision = F.when(F.col("force"), "FORCE_RESEND").when(F.col("sent"), "SKIP_ALREADY_SENT").when(F.col("partial"), "RETRY_EMAIL_ONLY").otherwise("PROCEED")
    return plans.join(seen, ["product", "iso_week"], "left").withColumn("decision", decision).drop("sent", "partial")


def counts(runs: DataFrame) -> DataFrame:
    """(product, n_runs, n_drafts, n_pending)."""
    return runs.groupBy("product").agg(
        F.count(F.lit(1)).alias("n_runs"), F.count("gmail_draft_id").alias("n_drafts"), F.count_if(F.col("status").isin("partial", "failed")).alias("n_pending")
    )


def worst_exit(runs: DataFrame, by: list[str]) -> DataFrame:
    """(by, exit_code): the greatest code; 0 ok or skipped, 2 partial, 1 failed."""
    code = F.when(F.col("status").isin("ok", "skipped"), 0).when(F.col("status") == "partial", 2).otherwise(1)
    return runs.groupBy(*by).agg(F.max(code).alias("exit_code"))
