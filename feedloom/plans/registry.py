"""Registered queries of the core operators; ``oracles.py`` has their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import calendar as C
from ..functions import text as T
from ..functions.vectors import cosine_distance
from ..operators import audit, clean, clusters, dashboard, ingest, report, themes
from ..sources import landed
from .oracles import oracle_sql  # noqa: F401  (part of the registry)

Query = Callable[[SparkSession, str], DataFrame]
WINDOW = ("2026-03-01 00:00:00", "2026-04-26 23:59:59.999999")


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _long(c: Column, name: str) -> Column:
    return c.cast("long").alias(name)


def merge_title_body(s, d):
    return _t(s, d, "raw_review").select("seq", T.merge_fields(F.col("title"), F.col("body")).alias("text"))


def text_normalize_hash(s, d):
    t = F.col("text")
    return _t(s, d, "clean_review").select("seq", T.normalize_for_match(t).alias("normalized"), T.text_hash(t).alias("hash"))


def text_hash_check(s, d):
    """How many stored hashes agree with the text."""
    same = F.when(F.col("text_hash").isNull(), "none").when(F.col("text_hash") == T.text_hash(F.col("text")), "same").otherwise("other")
    return _t(s, d, "clean_review").groupBy(same.alias("state")).agg(F.count(F.lit(1)).alias("n"))


def emoji_flag(s, d):
    return _t(s, d, "raw_review").select("seq", T.has_emoji(F.col("title"), F.col("body")).alias("has_emoji"))


def letters_filter(s, d):
    return _t(s, d, "raw_review").select("seq", _long(T.letter_count(F.col("body")), "letters"), (T.letter_count(F.col("body")) < 4).alias("too_short"))


def token_filter(s, d):
    return _t(s, d, "clean_review").select("seq", _long(T.substantive_tokens(F.col("text")), "n"), (T.substantive_tokens(F.col("text")) < 5).alias("too_short"))


def language_gate(s, d):
    return _t(s, d, "raw_review").select("seq", T.detect_language(F.col("body")).alias("lang"), T.is_non_english(F.col("body")).alias("non_english"))


def pii_counts(s, d):
    counts = T.scrub_counts(F.col("text"))
    return _t(s, d, "documents").select("doc_id", *[c.alias(k) for k, c in counts.items() if k in ("url", "email")])


def pii_scrub(s, d):
    return _t(s, d, "documents").select("doc_id", T.scrub(F.col("text")).alias("text"), *[c.alias(k) for k, c in T.scrub_counts(F.col("text")).items()])


def synthetic_ids(s, d):
    r = _t(s, d, "raw_review")
    return r.select("seq", T.synthetic_id(F.col("author"), F.col("posted_at"), F.col("body")).alias("synthetic_id"), F.concat_ws(":", "source", "review_id").alias("prefixed_id"))


def iso_weeks(s, d):
    week = C.iso_week(F.col("posted_at"))
    return _t(s, d, "raw_review").groupBy(week.alias("iso_week"), C.quarter_label(week).alias("quarter")).agg(F.count(F.lit(1)).alias("n"))


def week_windows(s, d):
    lo, hi = C.week_window(F.col("iso_week"))
    return _t(s, d, "pulse_run").select("run_id", C.is_iso_week(F.col("iso_week")).alias("valid"), lo.cast("timestamp_ntz").alias("window_start"), hi.cast("timestamp_ntz").alias("window_end"), C.quarter_label(F.col("iso_week")).alias("quarter"))


def last_completed_weeks(s, d):
    return _t(s, d, "pulse_run").select("run_id", C.last_completed_week(F.col("started_at").cast("timestamp")).alias("week"))


def week_ranges(s, d):
    by = _t(s, d, "pulse_run").groupBy("product").agg(F.min("iso_week").alias("first"), F.max("iso_week").alias("last"))
    return C.week_range(by, "first", "last").select("product", "week")


def source_resolution(s, d):
    return ingest.resolve_sources(_t(s, d, "product_registry")).select("slug", F.array_join("sources", ",").alias("sources"))


def window_filter(s, d):
    at = F.col("posted_at")
    return _t(s, d, "raw_review").where(at.between(F.lit(WINDOW[0]).cast("timestamp_ntz"), F.lit(WINDOW[1]).cast("timestamp_ntz"))).select("seq", "source", "posted_at")


def window_dedup(s, d):
    at = F.col("posted_at")
    rows = _t(s, d, "raw_review").where(at.between(F.lit(WINDOW[0]).cast("timestamp_ntz"), F.lit(WINDOW[1]).cast("timestamp_ntz")))
    return ingest.first_wins(rows.select("source", "review_id", "seq", "rating", "body"), ["source", "review_id"], ["seq"])


def ingest_funnel(s, d):
    return ingest.funnel(_t(s, d, "raw_review"), *WINDOW)


def source_cap(s, d):
    return ingest.cap_per_source(_t(s, d, "raw_review"), 500).select("source", "seq")


def source_caps(s, d):
    return ingest.source_status(_t(s, d, "raw_review"), 500)


def union_of_sources(s, d):
    raw = _t(s, d, "raw_review").select("source", "seq")
    parts = {x: raw.where(F.col("source") == x) for x in ("app_store", "play_store", "web_forum")}
    return ingest.union_sources(parts)[1]


def union_rows(s, d):
    raw = _t(s, d, "raw_review").select("source", "seq", "rating")
    return ingest.union_sources({x: raw.where(F.col("source") == x) for x in ("app_store", "play_store", "web_forum")})[0]


def missing_sources(s, d):
    want = ingest.resolve_sources(_t(s, d, "product_registry")).select(F.col("slug").alias("product"), F.explode("sources").alias("source"))
    return report.source_notes(ingest.missing_sources(want, _t(s, d, "clean_review"), ["product", "source"]))


def payload_fields(s, d):
    return _t(s, d, "raw_review").select("seq", _long(landed.payload_rating(F.col("raw")), "payload_rating"), _long(landed.payload_helpful(F.col("raw")), "helpful"))


def _cleaned(s, d):
    return clean.cleaned(_t(s, d, "raw_review"))


def clean_reasons(s, d):
    return _cleaned(s, d).select("seq", "review_id", "drop_reason")


def corpus_stats(s, d):
    return clean.corpus_stats(_cleaned(s, d), ["source"])


def dedup_first_hash(s, d):
    return ingest.first_wins(_t(s, d, "clean_review").where("text_hash is not null").select("text_hash", "seq", "review_id"), ["text_hash"], ["seq"])


def embedding_cache_misses(s, d):
    return clusters.cache_misses(_t(s, d, "clean_review"), _t(s, d, "embedding_cache"), ["text_hash"])


def cache_upsert(s, d):
    cache = _t(s, d, "embedding_cache").select("text_hash", "model_version", "cache_id", "created_at")
    fresh = cache.where(F.col("cache_id") % 3 == 0).withColumn("cache_id", F.col("cache_id") + 1_000_000).withColumn("created_at", F.col("created_at") + F.expr("INTERVAL 1 DAY"))
    return clusters.upsert(cache, fresh, ["model_version", "text_hash"], "created_at").select("model_version", "text_hash", "cache_id")


def _labelled(s, d):
    """Vectors with given labels; label 9 stands for noise."""
    return _t(s, d, "embeddings").withColumn("label", F.when(F.col("label") == 9, -1).otherwise(F.col("label")))


def centroid_topn(s, d):
    return clusters.nearest_to_centroid(_labelled(s, d), "vec_id", "label", "embedding").select("label", _long(F.col("rank"), "rank"), "vec_id", F.round("distance", 4).alias("distance"))


def cosine_to_centroid(s, d):
    rows = _labelled(s, d)
    far = rows.join(clusters.centroids(rows, "label", "embedding"), "label")
    return far.groupBy("label").agg(F.count(F.lit(1)).alias("size"), F.round(F.avg(cosine_distance(F.col("embedding"), F.col("centroid"))), 4).alias("mean_distance"))


def noise_share(s, d):
    return clusters.noise_ratio(_labelled(s, d), "label").withColumn("ratio", F.round("ratio", 6))


def _members(s, d):
    """(run_id, cluster_id, review_id, rating): listed members that exist, each once."""
    listed = themes.exploded_ids(_t(s, d, "review_cluster"), ["run_id", "cluster_id"], "member_review_ids").select("run_id", "cluster_id", "review_id").distinct()
    known = _t(s, d, "clean_review").groupBy("review_id").agg(F.min_by("rating", "seq").alias("rating"))
    return listed.join(known, "review_id")


def cluster_assemble(s, d):
    out = clusters.assembled(_members(s, d), ["run_id", "cluster_id"], "review_id", "rating")
    return out.select("run_id", "cluster_id", "size", F.round("avg_rating", 4).alias("avg_rating"), "first_member")


def rating_histogram(s, d):
    return clusters.rating_histogram(_members(s, d), ["run_id", "cluster_id"], "rating")


def cluster_rank(s, d):
    top = clusters.top_clusters(_t(s, d, "review_cluster").select("run_id", "cluster_id", "size", "avg_rating"), 2, ["run_id"])
    return top.select("run_id", "cluster_id", _long(F.col("rank"), "rank"), F.round("score", 4).alias("score"))


def fallback_buckets(s, d):
    return clusters.rating_buckets(_t(s, d, "clean_review"), 5).select(_long(F.col("bucket"), "bucket"), _long(F.col("rank"), "rank"), "seq", "size")


def cluster_density(s, d):
    """Density labels of all vectors, in runs of about a thousand drawn by a hash of the id."""
    rows = _t(s, d, "embeddings").select("vec_id", "embedding")
    runs = max(1, rows.count() // 1000)
    return clusters.density_labels(rows.withColumn("run", F.pmod(F.xxhash64("vec_id"), F.lit(runs))), ["run"], "vec_id", "embedding")


def reduce_dims(s, d):
    out = clusters.reduced(_t(s, d, "embeddings"), "embedding")
    return out.select("vec_id", F.transform("reduced", lambda x: F.round(x, 6)).alias("reduced"))


def silhouette_sampled(s, d):
    return clusters.silhouette(_labelled(s, d), "vec_id", "label", "embedding").select("n", F.round("silhouette", 6).alias("silhouette"))


def hashed_embeddings(s, d):
    return clusters.hashed_embedding(_t(s, d, "clean_review"), "seq", "text").select("seq", F.transform("vector", lambda x: F.round(x.cast("double"), 6)).alias("vector"))


def prompt_lines(s, d):
    return themes.prompt_lines(_t(s, d, "review_cluster"), _t(s, d, "clean_review"), ["run_id", "cluster_id"]).select("run_id", "cluster_id", _long(F.col("rank"), "rank"), "line")


def _quotes(s, d):
    """Two quotes for each typical review: the first 40 characters of its text, and one that nobody wrote."""
    lines = themes.exploded_ids(_t(s, d, "review_cluster"), ["run_id", "cluster_id"], "centroid_review_ids").select("run_id", "cluster_id", "review_id").distinct()
    known = _t(s, d, "clean_review").groupBy("review_id").agg(F.min_by("text", "seq").alias("text"))
    quote = F.explode(F.array(T.escape_markup(F.left(F.col("text"), F.lit(40))), F.concat(F.lit("never said "), F.left(F.col("text"), F.lit(9)))))
    return lines.join(known, "review_id").select("run_id", "cluster_id", "review_id", quote.alias("quote"))


def _member_ids(s, d):
    return themes.exploded_ids(_t(s, d, "review_cluster"), ["run_id", "cluster_id"], "member_review_ids")


def quote_validate(s, d):
    good = themes.valid_quotes(_quotes(s, d), _member_ids(s, d), _t(s, d, "clean_review"), ["run_id", "cluster_id"])
    return good.groupBy("run_id", "cluster_id").agg(F.count(F.lit(1)).alias("n_valid"))


def title_dedup(s, d):
    """Theme titles of each run in cluster order, without near repeats; a run has a few clusters. The first five words
    of a cluster's first typical review stand for its title."""
    lead = _t(s, d, "review_cluster").select("run_id", "cluster_id", F.col("centroid_review_ids")[0].alias("review_id"))
    known = _t(s, d, "clean_review").groupBy("review_id").agg(F.min_by("text", "seq").alias("text"))
    titled = lead.join(known, "review_id").select("run_id", "cluster_id", F.concat_ws(" ", F.slice(T.tokens(F.col("text")), 1, 5)).alias("title"))
    titles = titled.groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("cluster_id", "title"))).alias("t"))
    kept = themes.dedup_titles(F.transform("t", lambda x: x["title"]))
    return titles.select("run_id", F.size("t").cast("long").alias("n"), F.array_join(kept, " / ").alias("kept"))


def theme_answers(s, d):
    from .pipeline import themed

    return themed(_t(s, d, "review_cluster"), _t(s, d, "clean_review"), ["run_id", "cluster_id"]).select("run_id", "cluster_id", F.col("theme.title").alias("title"))


def action_word_limit(s, d):
    """The sentences of each document as action ideas; those of at most twelve words."""
    ideas = F.split("text", r"\. ")
    return _t(s, d, "documents").select("doc_id", F.size(themes.short_actions(ideas)).cast("long").alias("n_short"), F.left("text", F.lit(60)).alias("title"))


def token_budget_running(s, d):
    """Admission of each run's calls, one for each cluster, in order: a bounded running sum."""
    lines = themes.prompt_lines(_t(s, d, "review_cluster"), _t(s, d, "clean_review"), ["run_id", "cluster_id"])
    calls = themes.prompts(lines, ["run_id", "cluster_id"])
    return themes.token_budget(calls, ["run_id"], ["cluster_id"], "prompt", 2_500).select("run_id", "cluster_id", "estimate", "running", "admitted")


def latest_states(s, d):
    """Runs after a second event for every third of them."""
    runs = _t(s, d, "pulse_run").select("run_id", "started_at", "status", F.col("started_at").alias("event_at"))
    later = runs.where(F.substring("run_id", 1, 1).isin("0", "3", "6", "9", "c", "f")).withColumn("status", F.lit("ok")).withColumn("event_at", F.col("event_at") + F.expr("INTERVAL 1 HOUR"))
    return audit.latest_state(runs.unionByName(later)).select("run_id", "status", "event_at")


def repeated_sends(s, d):
    return audit.repeated_sends(_t(s, d, "pulse_run"))


def anchor_slug(s, d):
    r = _t(s, d, "pulse_run")
    a = T.anchor(F.col("product"), F.col("iso_week"))
    return r.select("run_id", a.alias("anchor"), (a == F.col("doc_section_anchor")).alias("as_stored"), report.idempotency_key(F.col("product"), F.col("iso_week"), F.lit("1")).alias("key"), report.deep_link(F.col("run_id"), a).alias("link"))


def anchor_membership(s, d):
    runs = _t(s, d, "pulse_run")
    anchors = runs.where("status = 'ok'").select(F.col("doc_section_anchor").alias("anchor")).dropna().distinct()
    mine = runs.select("run_id", T.anchor(F.col("product"), F.col("iso_week")).alias("anchor"))
    return mine.join(anchors, "anchor", "left_semi")


def doc_blocks(s, d):
    """Reports over the given clusters: each cluster's number stands for its title, its first typical review gives the quote."""
    runs = _t(s, d, "pulse_run").select("run_id", "product", F.col("iso_week").alias("week"), "window_start", "window_end", "llm_model", F.col("forced").alias("fallback_used"))
    per_run = _t(s, d, "review_cluster").groupBy("run_id").agg(F.sum("size").alias("total_out"), (F.sum("size") + 7).alias("total_in"))
    reports = runs.join(per_run, "run_id").withColumn("sources", F.array(F.lit("app_store"), F.lit("play_store"))).withColumn("missing_sources", F.when(F.col("total_out") < 40, F.array(F.lit("play_store"))))
    none = F.array().cast("array<string>")
    themes_ = _t(s, d, "review_cluster").select(
        "run_id", F.col("cluster_id").alias("theme_no"), F.concat(F.lit("Theme "), "cluster_id").alias("title"), F.concat("size", F.lit(" reviews")).alias("summary"),
        F.transform(F.slice("centroid_review_ids", 1, 1), lambda x: F.struct(F.concat(F.lit("said in "), x).alias("text"), x.alias("review_id"))).alias("quotes"),
        F.when(F.col("avg_rating") < 3, F.array(F.lit("Fix it"))).otherwise(none).alias("action_ideas"),
    )
    return report.doc_blocks(reports, themes_, ["run_id"]).select("run_id", _long(F.col("block_no"), "block_no"), "type", "text", "anchor", "attribution")


def surviving_themes(s, d):
    """The answers of the built-in provider after quote check, title dedup and limits."""
    from .pipeline import themed

    by = ["run_id", "cluster_id"]
    answers = themed(_t(s, d, "review_cluster"), _t(s, d, "clean_review"), by).withColumn("rank", F.col("cluster_id"))
    out = themes.surviving(answers, _member_ids(s, d), _t(s, d, "clean_review"), by, "rank", ["run_id"])
    return out.select("run_id", "cluster_id", "title", F.array_join(F.transform("quotes", lambda q: q["review_id"]), ",").alias("quoted"))


def utf16_lengths(s, d):
    return _t(s, d, "raw_review").select("seq", _long(T.utf16_length(F.col("body")), "units"), _long(F.length("body"), "chars"))


def recent_runs(s, d):
    return audit.recent(_t(s, d, "pulse_run"), 10).select("run_id", "product", "started_at", "status")


def prior_send(s, d):
    return audit.prior_sends(_t(s, d, "pulse_run")).select("product", "iso_week", "run_id", "gmail_message_id")


def partial_runs(s, d):
    return audit.recent(_t(s, d, "pulse_run").where("status = 'partial'"), 1, ["product", "iso_week"]).select("product", "iso_week", "run_id")


def run_decision(s, d):
    plans = _t(s, d, "pulse_run").select("product", "iso_week").distinct().withColumn("force", F.col("iso_week") == "2026-W07")
    return audit.decisions(plans, _t(s, d, "pulse_run")).select("product", "iso_week", "decision")


def run_counts(s, d):
    return audit.counts(_t(s, d, "pulse_run"))


def worst_exit(s, d):
    return audit.worst_exit(_t(s, d, "pulse_run"), ["iso_week"]).select("iso_week", _long(F.col("exit_code"), "exit_code"))


def latest_run(s, d):
    reg = _t(s, d, "product_registry").select(F.col("slug").alias("product"), "display_name", dashboard.team_name(F.get("email_recipients", F.lit(0))).alias("team"))
    last = dashboard.latest_good(_t(s, d, "pulse_run").select("product", "run_id", "started_at", "iso_week", "status"))
    return reg.join(last, "product", "left").withColumn("started", dashboard.shown_time(F.col("started_at")))


def activity_feed(s, d):
    runs = _t(s, d, "pulse_run").withColumn("doc_id", F.col("doc_section_anchor"))  # the table has no document id
    return dashboard.activity(runs).select("product", _long(F.col("rank"), "rank"), "run_id", "label", "colour", F.date_format("started_at", "yyyy-MM-dd").alias("day"))


def _themes(s, d):
    return dashboard.enriched_themes(_t(s, d, "review_cluster"), _t(s, d, "clean_review"), ["run_id", "cluster_id"], "member_review_ids")


def theme_enrich_priority(s, d):
    return dashboard.prioritised(_themes(s, d), ["run_id"], "cluster_id").select("run_id", "cluster_id", "review_count", F.round("avg_rating", 4).alias("avg_rating"), _long(F.col("position"), "position"), "priority", "priority_colour")


def pulse_summary(s, d):
    out = dashboard.summary(_themes(s, d), ["run_id"])
    value, direction = dashboard.sentiment_display(F.round("mean_rating", 4))
    return out.select("run_id", value.alias("shown"), direction.alias("direction"), "n_themes", F.round("mean_rating", 4).alias("mean_rating"), "level", F.round("sentiment", 4).alias("sentiment"), "mood", "urgent")


def star_strip(s, d):
    full, half = dashboard.stars(F.col("avg_rating"))
    return _t(s, d, "review_cluster").select("run_id", "cluster_id", _long(full, "full"), half.alias("half"))


def quote_cut(s, d):
    return _t(s, d, "clean_review").select("seq", dashboard.shown_quote(F.col("text")).alias("shown"))


def header_lookup(s, d):
    """Messages whose payload headers hold a value: event properties as headers."""
    rows = _t(s, d, "events").select(F.col("event_id").alias("message_id"), F.from_json("props", "map<string,string>").alias("headers"))
    return report.header_matches(rows, "69", 20).select("message_id")


def audit_error_cut(s, d):
    return _t(s, d, "documents").select("doc_id", T.truncate_bytes(F.col("text"), 300).alias("cut"))


def event_days(s, d):
    """Tumbling days of events: the batch form of the weekly stream counts."""
    return _t(s, d, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))


_ALL = (
    corpus_stats, merge_title_body, text_normalize_hash, text_hash_check, emoji_flag, letters_filter, token_filter, language_gate, pii_counts, pii_scrub, synthetic_ids, iso_weeks, week_windows, last_completed_weeks,
    week_ranges, source_resolution, window_filter, window_dedup, ingest_funnel, source_cap, source_caps, union_of_sources, union_rows, missing_sources, payload_fields, clean_reasons, dedup_first_hash, embedding_cache_misses, cache_upsert,
    centroid_topn, cosine_to_centroid, noise_share, cluster_assemble, rating_histogram, cluster_rank, fallback_buckets, cluster_density, reduce_dims, silhouette_sampled, hashed_embeddings, prompt_lines, quote_validate,
    title_dedup, theme_answers, action_word_limit, token_budget_running, latest_states, repeated_sends, anchor_slug, anchor_membership, doc_blocks, surviving_themes, utf16_lengths, recent_runs, prior_send, partial_runs, run_decision, run_counts, worst_exit, latest_run,
    activity_feed, theme_enrich_priority, pulse_summary, star_strip, quote_cut, header_lookup, audit_error_cut, event_days,
)


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in _ALL}
