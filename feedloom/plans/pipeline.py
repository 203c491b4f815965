"""The phases of a run in order, each a DataFrame of the one before."""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import audit, clean, clusters, ingest, report, themes
from ..session import materialize
from ..sources.audit_log import AuditLog
from ..sources.landed import write_artifact
from .runplan import Config, RunPlan

EMBEDDER = "hashed-256"
CACHE = "model_version string, text_hash string, vector array<float>, created_at timestamp"
SENT = ("sent", "drafted", "skipped_already_sent", "dry_run")  # states of a delivery that end a run well
# Delivery: (plan, blocks, subject, html, text) -> values of the run log, and ``email_status``.
Sender = Callable[..., dict]


class PhaseFailure(RuntimeError):
    def __init__(self, phase: int, reason: str):
        super().__init__(f"phase {phase}: {reason}")
        self.phase, self.reason = phase, reason


@dataclass
class Outcome:
    status: str
    funnel: DataFrame | None = None
    stats: DataFrame | None = None
    cleaned: DataFrame | None = None
    reason: str | None = None
    themes: DataFrame | None = None
    blocks: DataFrame | None = None
    counts: dict = field(default_factory=dict)


def scoped(plan: RunPlan, config: Config, landed: DataFrame) -> DataFrame:
    """The landed reviews of the plan's product and sources, capped for each source before any filter."""
    own = landed.where((F.col("product") == plan.product.slug) & F.col("source").isin(*plan.sources))
    return ingest.cap_per_source(own, config.max_reviews_per_source)


def run(plan: RunPlan, config: Config, landed: DataFrame) -> Outcome:
    """Ingest and clean; ``skipped`` below the minimum volume, ``failed`` without any review."""
    lo, hi = plan.window_start.strftime("%Y-%m-%d %H:%M:%S.%f"), plan.window_end.strftime("%Y-%m-%d %H:%M:%S.%f")
    rows = scoped(plan, config, landed)
    funnel = ingest.funnel(rows, lo, hi)
    kept = ingest.drop_reasons(rows, lo, hi).where("drop_reason is null").drop("drop_reason")
    judged = clean.cleaned(kept)
    stats = clean.corpus_stats(judged, [])
    row = stats.first()
    total = row["total_out"] if row else 0
    if not row or not row["total_in"]:
        return Outcome("failed", funnel, stats, reason="no_reviews")
    if total < config.n_min_reviews:
        return Outcome("skipped", funnel, stats, reason=f"too_few_reviews:{total}<{config.n_min_reviews}")
    rated = kept.select("source", "seq", "rating", "posted_at")
    return Outcome("ok", funnel, stats, judged.where("drop_reason is null").join(rated, ["source", "seq"]))


def themed(clusters: DataFrame, reviews: DataFrame, by: list[str], provider: themes.ThemeProvider | None = None) -> DataFrame:
    """(by, theme): the parsed answer for each cluster, themes without a title left out."""
    lines = themes.prompt_lines(clusters, reviews, by)
    return answered(themes.prompts(lines, by), by, provider)


def answered(prompts: DataFrame, by: list[str], provider: themes.ThemeProvider | None = None) -> DataFrame:
    prompts = prompts.withColumn("cluster_key", F.concat_ws("|", *by))
    answers = (provider or themes.ExtractiveProvider()).answers(prompts)
    return themes.parsed(prompts.select(*by, "cluster_key").join(answers, "cluster_key")).where("theme is not null").select(*by, "theme")


def clustered(reviews: DataFrame, cache: DataFrame, most: int = 5, least_bucket: int = 5, embedder=None) -> tuple[DataFrame, DataFrame, DataFrame, bool]:
    """(clusters, members, fresh, fallback) of the cleaned reviews of one run.

    Reviews are embedded with the cache, reduced and labelled by density; the ``most`` best clusters (cluster_id, size, avg_rating,
    centroid_review_ids, rank) and their members (cluster_id, review_id) come out, with the ``fresh`` rows for the cache. Where too much is noise, the
    latest reviews of each bucket of ratings stand for clusters instead. A run's reviews are bounded by the cap for each source.
    """
    vectors, fresh = clusters.embed_with_cache(reviews.select("text_hash", "text"), cache, EMBEDDER, embedder)
    fresh = materialize(fresh)
    rows = materialize(reviews.join(vectors, "text_hash").select("review_id", "rating", "posted_at", "vector", F.lit(0).alias("run")))
    labels = materialize(clusters.density_labels(clusters.reduced(rows, "vector").drop("vector"), ["run"], "review_id", "reduced").drop("run"))
    judged = clusters.noise_ratio(labels, "label").first()
    if judged["n"] and not judged["fallback"]:
        own = rows.join(labels, "review_id").where(F.col("label") != clusters.NOISE)
        members = own.select(F.col("label").alias("cluster_id"), "review_id", "rating")
        near = clusters.nearest_to_centroid(own, "review_id", "label", "vector").select(F.col("label").alias("cluster_id"), "rank", "review_id")
    else:
        buckets = clusters.rating_buckets(rows, least_bucket, "review_id")
        bucket = F.when(F.col("rating") <= 2, 0).when(F.col("rating") == 3, 1).when(F.col("rating") >= 4, 2)
        members = rows.select(bucket.alias("cluster_id"), "review_id", "rating").join(buckets.select(F.col("bucket").alias("cluster_id")).distinct(), "cluster_id")
        near = buckets.select(F.col("bucket").alias("cluster_id"), "rank", "review_id")
    typical = near.groupBy("cluster_id").agg(F.array_sort(F.collect_list(F.struct("rank", "review_id"))).alias("t")).select("cluster_id", F.transform("t", lambda x: x["review_id"]).alias("centroid_review_ids"))
    sizes = clusters.assembled(members, ["cluster_id"], "review_id", "rating").drop("first_member")
    top = clusters.top_clusters(sizes.join(typical, "cluster_id").withColumn("_all", F.lit(0)), most, ["_all"]).drop("_all")
    return materialize(top), members.select("cluster_id", "review_id"), fresh, bool(judged["fallback"] or not judged["n"])


def execute(spark: SparkSession, plan: RunPlan, config: Config, landed: DataFrame, log: AuditLog, root: str, provider: themes.ThemeProvider | None = None, sender: Sender | None = None) -> Outcome:
    """A whole run: decide by the log, ingest, clean, cluster, theme, compose, hand over, record.

    Artifacts (raw, clean, clusters, themes, doc_report, and email as text) are written below ``root``, partitioned by run_id; the embedding cache is shared
    by all runs. A run that was really sent is skipped unless forced. Without ``sender`` nothing leaves the engine and the run counts as a dry one. The log holds the
    run as failed, in flight, from the start, so that a lost driver leaves a trace.
    """
    log.check_version()
    asked = spark.createDataFrame([(plan.product.slug, plan.iso_week, plan.force_resend)], "product string, iso_week string, force boolean")
    decision = audit.decisions(asked, log.state()).first()["decision"]
    if decision == "SKIP_ALREADY_SENT":
        return Outcome("skipped", reason="already_sent")
    log.insert(
        run_id=plan.run_id, product=plan.product.slug, iso_week=plan.iso_week, started_at=dt.datetime.now(dt.UTC), status="failed", error="in_flight", window_start=plan.window_start, window_end=plan.window_end,
        llm_model=plan.llm_model, forced=plan.force_resend, dry_run=plan.dry_run or sender is None, doc_id=plan.product.pulse_doc_id or None,
    )
    done: dict = {}
    try:
        out = _phases(spark, plan, config, landed, root, provider, sender, done)
    except PhaseFailure as e:
        out = Outcome("failed", reason=e.reason)
        done |= {"failed_phase": e.phase, "error": e.reason}
    except Exception as e:
        log.update(plan.run_id, **done, status="failed", error=f"{type(e).__name__}: {e}", ended_at=dt.datetime.now(dt.UTC))
        raise
    log.update(plan.run_id, **{"error": out.reason, **done}, status=out.status, ended_at=dt.datetime.now(dt.UTC))
    return out


def _phases(spark, plan, config, landed, root, provider, sender, done: dict) -> Outcome:
    out = run(plan, config, landed)
    write_artifact(scoped(plan, config, landed), root, "raw", plan.run_id, "parquet")
    stats = out.stats.first()
    done["corpus_stats_json"] = json.dumps(stats.asDict() if stats else {})
    if out.status == "failed":
        raise PhaseFailure(1, out.reason)
    if out.status == "skipped":
        return out
    reviews = materialize(out.cleaned.drop("drop_reason"))
    write_artifact(reviews, root, "clean", plan.run_id, "parquet")

    try:
        cache = spark.read.schema(CACHE).parquet(f"{root}/embedding_cache")
        cache.limit(1).count()
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        cache = spark.createDataFrame([], CACHE)
    found, members, fresh, fallback = clustered(reviews, cache)
    fresh.write.mode("append").parquet(f"{root}/embedding_cache")
    done["cluster_count"] = found.count()
    if not done["cluster_count"]:
        raise PhaseFailure(3, "no_clusters")
    write_artifact(found, root, "clusters", plan.run_id, "parquet")

    by = ["cluster_id"]
    prompts = themes.prompts(themes.prompt_lines(found, reviews, by), by).join(found.select("cluster_id", "rank"), by).withColumn("_all", F.lit(0))
    calls = materialize(themes.token_budget(prompts, ["_all"], ["rank"], "prompt", config.total_token_cap).where("admitted"))
    done["total_tokens"] = int(calls.agg(F.sum("estimate")).first()[0] or 0)
    answers = answered(calls.select(*by, "prompt"), by, provider).join(found.select("cluster_id", "rank"), by).withColumn("run", F.lit(0))
    kept = materialize(themes.surviving(answers, members.withColumn("run", F.lit(0)), reviews, ["run", *by], "rank", ["run"]).drop("run"))
    done["theme_count"] = kept.count()
    if not done["theme_count"]:
        raise PhaseFailure(4, "no_validated_themes")
    write_artifact(kept, root, "themes", plan.run_id, "json")

    missing = ingest.missing_sources(spark.createDataFrame([(s,) for s in plan.sources], "source string"), reviews, ["source"])
    gone = sorted(r["source"] for r in missing.collect())  # of the plan's few sources
    head = spark.createDataFrame(
        [(plan.run_id, plan.product.slug, plan.iso_week, plan.window_start, plan.window_end, plan.llm_model, list(plan.sources), gone, stats["total_in"], stats["total_out"], fallback)],
        "run_id string, product string, week string, window_start timestamp, window_end timestamp, llm_model string, sources array<string>, missing_sources array<string>, total_in long, total_out long, fallback_used boolean",
    )
    numbered = kept.select(F.lit(plan.run_id).alias("run_id"), F.col("rank").alias("theme_no"), "title", "summary", "quotes", "action_ideas")
    blocks = materialize(report.doc_blocks(head, numbered, ["run_id"]))
    write_artifact(blocks.drop("run_id"), root, "doc_report", plan.run_id, "json")
    titles = [r["title"] for r in kept.orderBy("rank").limit(3).collect()]
    subject = report.email_subject(plan.product.display_name or plan.product.slug, plan.window_end)
    footer = report.email_footer(plan.llm_model, plan.window_start, plan.window_end, plan.sources)
    html, text = report.email_html(subject, titles, footer), report.email_text(subject, titles, footer)
    write_artifact(spark.createDataFrame([("html", html), ("text", text)], "kind string, body string"), root, "email", plan.run_id, "json")

    anchor = blocks.where("anchor is not null").first()["anchor"]
    receipt = {"email_status": "dry_run"} if sender is None or plan.dry_run else dict(sender(plan, blocks, subject, html, text))
    status = "ok" if receipt.pop("email_status", None) in SENT else "partial"
    done |= {"doc_section_anchor": anchor, **receipt}
    return Outcome(status, out.funnel, out.stats, reviews, themes=kept, blocks=blocks, counts={k: done[k] for k in ("cluster_count", "theme_count", "total_tokens")})


def weekly(spark: SparkSession, config: Config, plans: list[RunPlan], landed: DataFrame, log: AuditLog, root: str, **with_) -> dict[str, str]:
    """run_id -> status of a run of each plan, one after the other; a run that breaks counts as failed and the next one starts."""
    out = {}
    for plan in plans:
        try:
            out[plan.run_id] = execute(spark, plan, config, landed, log, root, **with_).status
        except Exception:
            out[plan.run_id] = "failed"
    return out


def exit_code(statuses) -> int:
    """The worst of 0 (ok, skipped), 2 (partial) and 1 (failed), by number."""
    return max((0 if s in ("ok", "skipped") else 2 if s == "partial" else 1 for s in statuses), default=0)
