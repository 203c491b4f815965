from __future__ import annotations

import datetime as dt
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from feedloom.functions import calendar as C
from feedloom.operators import audit, clean, clusters, dashboard, ingest, report, themes
from feedloom.operators.components import connected_components
from feedloom.plans import pipeline, runplan
from feedloom.sources import landed
from feedloom.sources.audit_log import AuditLog
from feedloom.streaming import live

REVIEW = "seq long, source string, review_id string, product string, rating int, title string, body string, posted_at timestamp"
AT = dt.datetime(2026, 4, 15, 10, 0)
WINDOW = ("2026-03-01 00:00:00", "2026-04-26 23:59:59.999999")


def reviews(spark, rows):
    return spark.createDataFrame(rows, REVIEW)


def r(seq, body, title=None, source="app_store", rid=None, rating=4, at=AT):
    return (seq, source, rid or f"r{seq}", "p", rating, title, body, at)


def test_weeks(spark):
    rows = spark.createDataFrame([("2026-W17",), ("2025-W53",), ("2026-W53",), ("2026-W00",), ("2026-W54",), ("2026W10",), (None,)], "w string")
    got = {x.w: x for x in rows.select("w", C.is_iso_week(F.col("w")).alias("ok"), C.week_window(F.col("w"))[0].cast("string").alias("a"), C.week_window(F.col("w"))[1].cast("string").alias("b"), C.quarter_label(F.col("w")).alias("q")).collect()}
    assert (got["2026-W17"].ok, got["2026-W17"].a, got["2026-W17"].b, got["2026-W17"].q) == (True, "2026-03-01 00:00:00", "2026-04-26 23:59:59.999999", "Q2 2026")
    assert [got[w].ok for w in ("2025-W53", "2026-W53", "2026-W00", "2026-W54", "2026W10", None)] == [False, True, False, False, False, False]
    assert got["2026-W53"].q == "Q4 2026" and got["2026W10"].q == "Current Period"
    ranges = spark.createDataFrame([("2025-W51", "2026-W02"), ("2026-W05", "2026-W03")], "a string, b string")
    assert [x.week for x in C.week_range(ranges, "a", "b").orderBy("week").collect()] == ["2025-W51", "2025-W52", "2026-W01", "2026-W02"]
    day = spark.createDataFrame([(dt.datetime(2025, 12, 29),), (dt.datetime(2027, 1, 1),)], "t timestamp")
    assert [x[0] for x in day.select(C.iso_week(F.col("t"))).collect()] == ["2026-W01", "2026-W53"]
    assert day.limit(1).select(C.last_completed_week(F.lit(dt.datetime(2026, 4, 26, 19, 0)))).first()[0] == "2026-W17"


def test_funnel_charges_the_first_rule(spark):
    en = "the app is good and it works for my family every day"
    de = "die App ist nicht gut und ich bin mit der Seite sehr unzufrieden"
    rows = [r(1, en), r(2, en, at=dt.datetime(2020, 1, 1)), r(3, en, rid="r1"), r(4, en, title="😀"), r(5, de), r(6, "abc"), r(7, "abcd"), r(8, "123456"), r(9, "x", rid="r4"), r(10, en, at=dt.datetime(2026, 3, 1)), r(11, en, at=None), r(12, None), (13, None, None, None, None, None, None, AT)]
    got = {x.seq: x.drop_reason for x in ingest.drop_reasons(reviews(spark, rows), *WINDOW).collect()}
    assert got == {1: None, 2: "window", 3: "dup", 4: "emoji", 5: "lang", 6: "short", 7: None, 8: "short", 9: "dup", 10: None, 11: "window", 12: "short", 13: "short"}
    total = ingest.funnel(reviews(spark, rows), *WINDOW).agg(F.sum("total_in"), F.sum("kept"), F.sum("total_dropped")).first()
    assert tuple(total) == (13, 3, 10)
    assert ingest.funnel(reviews(spark, []), *WINDOW).count() == 0


def test_cap_union_missing(spark):
    rows = reviews(spark, [r(i, "x", source="app_store" if i % 3 else "play_store") for i in range(12)])
    assert sorted(x.seq for x in ingest.cap_per_source(rows, 2).collect()) == [0, 1, 2, 3]
    merged, stats = ingest.union_sources({"app_store": rows, "web": rows.limit(0)})
    assert merged.count() == 12 and {x.source: x.status for x in stats.collect()} == {"app_store": "ok", "web": "empty"}
    reg = spark.createDataFrame([("a", "1", None), ("b", "", "2")], "slug string, app_store_id string, play_store_id string")
    assert {x.slug: x.sources for x in ingest.resolve_sources(reg).collect()} == {"a": ["app_store"], "b": ["play_store"]}
    first = ingest.first_wins(rows.withColumn("k", F.lit(None).cast("string")), ["k"], ["seq"]).collect()
    assert [x.seq for x in first] == [0]


def test_clean_adds_up_and_first_wins(spark):
    text = "the app is good and it works for my family"
    rows = [r(5, text, source="play_store"), r(9, text), r(1, "too short"), r(2, "me@x.org", title="a@b.org"), r(3, "die App ist nicht gut und ich bin mit der Seite sehr unzufrieden"), r(4, None, title=None)]
    got = {x.seq: x.drop_reason for x in clean.cleaned(reviews(spark, rows)).collect()}
    assert got == {5: "dedup", 9: None, 1: "short", 2: "short", 3: "lang", 4: "short"}
    stats = clean.corpus_stats(clean.cleaned(reviews(spark, rows)), []).first()
    assert (stats.total_in, stats.total_out, stats.dropped_short, stats.dropped_lang, stats.dedup_count, stats.dropped_pii) == (6, 1, 3, 1, 1, 0)


def test_centroids_and_buckets(spark):
    v = spark.createDataFrame([(i, 0 if i < 3 else 1 if i < 5 else -1, [float(i == j) for j in range(6)]) for i in range(6)], "id int, label int, v array<float>")
    assert {x.label: x.size for x in clusters.centroids(v, "label", "v").collect()} == {0: 3, 1: 2}
    near = clusters.nearest_to_centroid(v, "id", "label", "v", 2).collect()
    assert sorted((x.label, x["rank"], x.id) for x in near) == [(0, 1, 0), (0, 2, 1), (1, 1, 3), (1, 2, 4)]
    assert clusters.noise_ratio(v, "label").first().ratio == pytest.approx(1 / 6)
    assert clusters.noise_ratio(v.limit(0), "label").first().fallback is True
    six = reviews(spark, [r(i, "x", rating=(1, 3, 5)[i % 3], at=AT + dt.timedelta(minutes=i)) for i in range(18)])
    assert {x.bucket for x in clusters.rating_buckets(six, 5).collect()} == {0, 1, 2}
    assert [x.seq for x in clusters.rating_buckets(six, 5).where("bucket = 0").orderBy("rank").collect()] == [15, 12, 9, 6, 3]
    assert clusters.rating_buckets(six.where("rating <> 3 or seq < 6"), 5).select("bucket").distinct().count() == 2


def test_rank_prefers_large_and_negative(spark):
    rows = spark.createDataFrame([(0, 3, 4.5), (1, 3, 1.5), (2, 20, 3.0), (3, 5, 3.0), (4, 2, None)], "cluster_id int, size int, avg_rating double")
    assert [x.cluster_id for x in clusters.top_clusters(rows, 4).collect()] == [2, 3, 1, 0]
    assert clusters.top_clusters(rows.limit(0), 4).count() == 0


def test_density_labels_find_blobs(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(c, 0.1, (20, 4)) for c in (0, 5)] + [rng.uniform(-20, 20, (5, 4))])
    labels = clusters.hierarchy_labels(x, 5)
    assert len(set(labels[:20])) == 1 and len(set(labels[20:40])) == 1 and labels[0] != labels[20] and min(labels[0], labels[20]) >= 0
    assert (clusters.hierarchy_labels(x[:3], 5) == -1).all()
    df = spark.createDataFrame([("g", i, [float(z) for z in v]) for i, v in enumerate(x)], "g string, id int, v array<float>")
    assert clusters.density_labels(df, ["g"], "id", "v").where("label >= 0").count() >= 40
    assert clusters.silhouette(df.withColumn("label", (F.col("id") < 20).cast("int")), "id", "label", "v").first().n == 45
    assert clusters.density_labels(df.limit(0), ["g"], "id", "v").count() == 0


def test_cache_and_upsert(spark):
    cache = spark.createDataFrame([("m", "a", 1, AT), ("m", "b", 2, AT)], "model_version string, text_hash string, cache_id int, created_at timestamp")
    want = spark.createDataFrame([("a", 1), ("c", 2), ("c", 3), (None, 4)], "text_hash string, cache_id int")
    assert [x.text_hash for x in clusters.cache_misses(want, cache, ["text_hash"]).collect()] == ["c"]
    fresh = cache.where("cache_id = 1").withColumn("cache_id", F.lit(7))
    got = clusters.upsert(cache, fresh, ["model_version", "text_hash"], "created_at")
    assert sorted(x.cache_id for x in got.collect()) == [2, 7]


def test_quotes_titles_budget(spark):
    rev = spark.createDataFrame([("a", 1, "App crashes on start. Really & truly <bad>"), ("b", 2, "all fine"), ("a", 3, "later text")], "review_id string, seq int, text string")
    members = spark.createDataFrame([(0, "a"), (1, "b")], "cluster_id int, review_id string")
    quotes = [("crashes  on\tstart", 0, "a"), ("never said", 0, "a"), ("all fine", 0, "b"), ("x", 0, "zz"), ("", 0, "a"), ("  ", 0, "a"), ("&lt;bad&gt;", 0, "a"), (None, 0, "a")]
    q = spark.createDataFrame([(c, i, t) for t, c, i in quotes], "cluster_id int, review_id string, quote string")
    assert {x.quote for x in themes.valid_quotes(q, members, rev, ["cluster_id"]).collect()} == {"crashes  on\tstart", "&lt;bad&gt;"}
    t = spark.createDataFrame([(["App crashes home screen", "Home screen app crashes", "Login fails"], ["do it", " ".join("x" * 13)])], "t array<string>, a array<string>")
    row = t.select(themes.dedup_titles(F.col("t")).alias("t"), themes.short_actions(F.col("a")).alias("a")).first()
    assert row.t == ["App crashes home screen", "Login fails"] and row.a == ["do it"]
    calls = spark.createDataFrame([("p", i, "x" * 400) for i in range(4)], "p string, i int, text string")
    assert [x.admitted for x in themes.token_budget(calls, ["p"], ["i"], "text", 1300).orderBy("i").collect()] == [True, True, False, False]


def test_prompt_to_theme(spark):
    c = spark.createDataFrame([(0, ["a", "gone", "b"]), (1, ["gone"])], "cluster_id int, centroid_review_ids array<string>")
    rev = spark.createDataFrame([("a", 1, "App <crashes> on start"), ("b", 2, "slow & heavy")], "review_id string, seq int, text string")
    got = pipeline.themed(c, rev, ["cluster_id"]).collect()
    assert len(got) == 1 and got[0].theme.title == "App <crashes> on start" and got[0].theme.quotes[0].review_id == "a"
    bad = spark.createDataFrame([("null",), ("{broken",), (None,), ('{"title": "t"}',)], "answer string")
    assert [x.theme is not None for x in themes.parsed(bad).collect()] == [False, False, False, True]


def test_report(spark):
    days = dt.datetime(2026, 3, 1), dt.datetime(2026, 4, 26)
    reports = spark.createDataFrame(
        [("r1", "my-app", "2026-W17", *days, "m1", ["app_store", "play_store"], ["play_store"], 40, 31, True, 9), ("r2", "other", "2026-W17", *days, None, ["app_store"], None, 9, 8, None, 9)],
        "run_id string, product string, week string, window_start timestamp, window_end timestamp, llm_model string, sources array<string>, missing_sources array<string>, total_in long, total_out long, fallback_used boolean, title int",
    )
    q = "array<struct<text: string, review_id: string>>"
    t = spark.createDataFrame([("r1", 1, "T" * 90, "s", [("q", "id1")], ["a"]), ("r1", 0, "first", "s0", None, None)], f"run_id string, theme_no int, title string, summary string, quotes {q}, action_ideas array<string>")
    rows = report.doc_blocks(reports, t, ["run_id"]).orderBy("run_id", "block_no").collect()
    got = [(x.type, x.text, x.attribution) for x in rows if x.run_id == "r1"]
    assert got == [
        ("heading_2", "Week of 2026-04-26 (ISO 2026-W17) — 31 reviews", None), ("heading_3", "first", None), ("paragraph", "s0", None), ("heading_3", "T" * 80, None), ("paragraph", "s", None), ("blockquote", "q", "id1"),
        ("heading_3", "Action ideas", None), ("bullet", "a", None), ("paragraph", "LLM: m1 · Window: 2026-03-01 → 2026-04-26 · Sources: app_store=40, play_store=40", None),
        ("paragraph", "Low-volume week — themes derived by rating bucket, not clustering.", None), ("paragraph", "Play Store unavailable this week.", None),
    ]
    assert [x.anchor for x in rows] == ["pulse-my-app-2026-W17"] + [None] * 10 + ["pulse-other-2026-W17", None]
    assert report.doc_blocks(reports.limit(0), t, ["run_id"]).count() == 0
    big = ["<t>" * 20, "x" * 60_000, "y"]
    assert len(report.email_html("S", big, "f").encode()) <= 50_000 and "&lt;t&gt;" in report.email_html("S", big, "f")
    assert report.email_text("Sub", ["a", "b", "c", "d"], "f").splitlines()[:5] == ["Sub", "", "- a", "- b", "- c"]
    with pytest.raises(ValueError):
        report.email_text(report.LINK, ["a"], "f")
    assert report.email_subject("My App", days[1]) == "Weekly Pulse — My App — Week of 2026-04-26"


def test_links(spark):
    link = spark.createDataFrame([(report.LINK + "!",)], "b string").select(report.replace_link(F.col("b"), F.lit("u")))
    assert link.first()[0] == "u!"
    with pytest.raises(Exception, match="no link mark"):
        spark.createDataFrame([("x",)], "b string").select(report.replace_link(F.col("b"), F.lit("u"))).collect()


RUN = "run_id string, product string, iso_week string, started_at timestamp, status string, gmail_message_id string, gmail_draft_id string, forced boolean, dry_run boolean"


@pytest.mark.parametrize(
    "runs, force, want",
    [
        ([], False, "PROCEED"),
        ([("ok", "m", False, False)], False, "SKIP_ALREADY_SENT"),
        ([("ok", "m", False, False)], True, "FORCE_RESEND"),
        ([("ok", "m", True, False)], False, "PROCEED"),
        ([("ok", "m", False, True)], False, "PROCEED"),
        ([("partial", None, False, False)], False, "RETRY_EMAIL_ONLY"),
        ([("partial", None, None, None), ("ok", "m", None, None)], False, "SKIP_ALREADY_SENT"),
    ],
)
def test_decision(spark, runs, force, want):
    log = spark.createDataFrame([(f"r{i}", "p", "2026-W10", AT, s, m, None, f, d) for i, (s, m, f, d) in enumerate(runs)], RUN)
    plans = spark.createDataFrame([("p", "2026-W10", force)], "product string, iso_week string, force boolean")
    assert audit.decisions(plans, log).first().decision == want


def test_audit_log(spark, tmp_path):
    log = AuditLog(spark, str(tmp_path / "log"))
    assert log.state().count() == 0

    def event(run, status="failed", sent=None, at=AT):
        return spark.createDataFrame([(run, "p", "2026-W10", AT, status, sent, at)], "run_id string, product string, iso_week string, started_at timestamp, status string, gmail_message_id string, event_at timestamp")

    log.append(event("a"), new_runs=True)
    log.append(event("a", "ok", "m1", AT + dt.timedelta(hours=1)))
    assert [x.status for x in log.state().collect()] == ["ok"]
    with pytest.raises(ValueError, match="exists"):
        log.append(event("a"), new_runs=True)
    with pytest.raises(ValueError, match="real send"):
        log.append(event("b", "ok", "m2"))
    with pytest.raises(ValueError, match="status"):
        log.append(event("c", "odd"))


def test_dashboard(spark):
    t = spark.createDataFrame([("r", 0, ["a", "b", "x"]), ("r", 1, []), ("r", 2, None), ("r", 3, ["b", "b"])], "run_id string, cluster_id int, ids array<string>")
    ratings = spark.createDataFrame([("a", 1, 1), ("b", 2, 4), ("a", 3, 5)], "review_id string, seq int, rating int")
    e = dashboard.enriched_themes(t, ratings, ["run_id", "cluster_id"], "ids")
    got = {x.cluster_id: (x.review_count, x.avg_rating) for x in e.collect()}
    assert got == {0: (3, 2.5), 1: (0, None), 2: (0, None), 3: (2, 4.0)}
    p = {x.cluster_id: x.priority for x in dashboard.prioritised(e, ["run_id"], "cluster_id").collect()}
    assert p == {0: "Top Priority", 3: "High Priority", 1: "High Priority", 2: "Priority"}
    s = dashboard.summary(e, ["run_id"]).first()
    assert (s.n_themes, s.level, s.mood, s.urgent) == (4, "High", "bearish", 1)


def test_read_side_texts(spark):
    runs = spark.createDataFrame([("a", "p", "2026-W10", 5, "ok", "d1", None), ("b", "p", "2026-W11", 4, "ok", "", "doc"), ("c", "p", "2026-W12", 3, "failed", None, None), ("e", "p", "2026-W13", 2, "ok", "d", "x")], "run_id string, product string, iso_week string, started_at int, status string, gmail_draft_id string, doc_id string")
    got = [(x.label, x.colour) for x in dashboard.activity(runs).orderBy("rank").collect()]
    assert got == [("Drafted weekly pulse for 2026-W10", "#22c55e"), ("Updated Pulse Doc for 2026-W11", "#22c55e"), ("Run failed for 2026-W12", "#9ca3af")]
    mails = spark.createDataFrame([("growth.team-one_x@a.example",), (None,), ("",)], "m string").select(dashboard.team_name(F.col("m")).alias("t")).collect()
    assert [x.t for x in mails] == ["Growth Team One X", None, ""]
    shown = spark.createDataFrame([(4.0,), (3.0,), (None,), (3.5,)], "a double").select(*dashboard.sentiment_display(F.col("a"))).collect()
    assert [tuple(x) for x in shown] == [("+10.0%", "up"), ("-10.0%", "down"), ("0.0", "neutral"), ("+0.0%", "up")]
    cut = spark.createDataFrame([("a" * 130,), ("short",), (None,)], "t string").select(dashboard.shown_quote(F.col("t")).alias("s")).collect()
    assert [x.s for x in cut] == ["a" * 120 + "…", "short", None]


def test_themes_survive_only_with_a_valid_quote(spark):
    rev = spark.createDataFrame([("x", 1, "The chart is slow & late"), ("y", 2, "other text"), ("z", 3, "not a member")], "review_id string, seq long, text string")
    members = spark.createDataFrame([("r", c, i) for c in range(5) for i in ("x", "y")], "run_id string, cluster_id int, review_id string")
    one = lambda title, quotes, ideas=("do it",): (title, "s", quotes, list(ideas))
    answers = [
        ("r", 0, one("Slow chart today", [("chart is slow &amp; late", "x"), ("invented", "x")], ["short one", " ".join(["w"] * 13)])), ("r", 1, one("No quote", [("never said", "y")])), ("r", 2, one("slow CHART today", [("other", "y")])),
        ("r", 3, one("L" * 90, [("not a member", "z"), ("other text", "y")])), ("r", 4, None),
    ]
    df = spark.createDataFrame([(*a, a[1]) for a in answers], "run_id string, cluster_id int, theme struct<title: string, summary: string, quotes: array<struct<text: string, review_id: string>>, action_ideas: array<string>>, rank int")
    got = {x.cluster_id: x for x in themes.surviving(df, members, rev, ["run_id", "cluster_id"], "rank", ["run_id"]).collect()}
    assert set(got) == {0, 3} and got[3].title == "L" * 60 and [q.review_id for q in got[3].quotes] == ["y"]
    assert got[0].action_ideas == ["short one"] and len(got[0].quotes) == 1
    assert themes.surviving(df.limit(0), members, rev, ["run_id", "cluster_id"], "rank", ["run_id"]).count() == 0


def test_components(spark):
    edges = [(1, 2), (2, 3), (5, 4), (7, 7), (9, 8), (8, 10), (10, 11), (11, 12), (12, 9), (3, 1), (None, 4)] + [(100, i) for i in range(101, 160)]
    got = {x.node: x.component for x in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4} | {i: 8 for i in range(8, 13)} | {i: 100 for i in range(100, 160)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
    path = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")
    assert {x.component for x in connected_components(path).collect()} == {0}


@pytest.fixture
def skewed(spark):
    """Settings under which a few thousand rows are a skewed partition."""
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "10KB", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8KB", "spark.sql.shuffle.partitions": "8"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield lambda df: (df.collect(), df._jdf.queryExecution().executedPlan().toString())[1]
    for k, v in before.items():
        spark.conf.set(k, v)


def test_hot_keys_are_split(spark, skewed):
    """One id, one text or one node has half of all rows."""
    text = "concat('the app is good and it works for my family ', if(id % 2 = 0, '', cast(id as string)), repeat('x', 10))"
    rows = spark.range(6000).repartition(6).selectExpr("id as seq", "'app_store' as source", "if(id % 2 = 0, 'hot', cast(id as string)) as review_id", "'t' as title", f"{text} as body", "timestamp'2026-03-10 00:00:00' as posted_at")
    assert "skew=true" in skewed(ingest.drop_reasons(rows, *WINDOW))
    judged = clean.cleaned(rows)
    assert "skew=true" in skewed(judged) and judged.where("drop_reason is null").count() == 3001
    f = ingest.funnel(rows, *WINDOW).first()
    assert (f.total_in, f.dedup_dropped, f.kept) == (6000, 2999, 3001)


def test_components_of_a_hub_leave_no_files_behind(spark):
    from feedloom import session

    before = len(session._OWN)
    edges = spark.range(1, 3000).selectExpr("0L as a", "id as b").unionByName(spark.range(3000, 3100).selectExpr("id as a", "id + 1 as b"))
    assert {(x.component, x["count"]) for x in connected_components(edges).groupBy("component").count().collect()} == {(0, 3000), (3000, 101)}
    assert len(session._OWN) == before + 1


def test_landed_sources(spark, tmp_path):
    entry = {"id": {"label": "1"}, "im:rating": {"label": "4"}, "title": {"label": "t"}, "content": {"label": "b"}, "author": {"name": {"label": "n"}}, "updated": {"label": "2026-04-15T10:00:00-07:00"}, "im:version": {"label": "1.0"}}
    pages = {"feed": {"entry": [entry, {**entry, "im:rating": {"label": "9"}}, {k: v for k, v in entry.items() if k != "author"}, {k: v for k, v in entry.items() if k != "id"}]}}
    (tmp_path / "page.json").write_text(json.dumps(pages))
    got = landed.feed_pages(spark, str(tmp_path / "page.json"), "p").collect()
    assert len(got) == 2 and {x.rating for x in got} == {4} and {x.review_id[:6] for x in got} == {"1", "synth_"}
    (tmp_path / "rows.jsonl").write_text('{"reviewId":"g1","content":"c","score":5,"at":"2026-04-15T10:00:00Z"}\n\n{"reviewId":"g2","content":"c","score":5}\n')
    assert [x.review_id for x in landed.store_rows(spark, str(tmp_path / "rows.jsonl"), "p").collect()] == ["g1"]
    path = landed.write_artifact(spark.range(3), str(tmp_path), "clean", "r1")
    landed.write_artifact(spark.range(5), str(tmp_path), "clean", "r2")
    landed.write_artifact(spark.range(2), str(tmp_path), "clean", "r1")
    assert spark.read.json(path).count() == 7


def test_feed_pages_are_read_as_far_as_needed(spark, tmp_path):
    entry = lambda i, day: {"id": {"label": str(i)}, "im:rating": {"label": "4"}, "content": {"label": "b"}, "author": {"name": {"label": "n"}}, "updated": {"label": f"2026-04-{day:02d}T10:00:00Z"}}

    def status(pages, most=100):
        folder = tmp_path / str(len(list(tmp_path.iterdir())))
        folder.mkdir()
        for n, page in pages.items():
            (folder / f"page-{n}.json").write_text(page if isinstance(page, str) else json.dumps({"feed": {"entry": page} if page is not None else {}}))
        rows, one = landed.feed_in_order(spark, str(folder), "p", dt.datetime(2026, 4, 10), most)
        r = one.first()
        return sorted(int(x.review_id) for x in rows.collect()), r.status, r.pages, r.capped

    three = {1: [entry(1, 20), entry(2, 19)], 2: [entry(3, 15), entry(4, 12)], 3: [entry(5, 11)]}
    assert status(three) == ([1, 2, 3, 4, 5], "ok", 3, False)
    assert status({**three, 2: [entry(3, 15), entry(4, 2)]}) == ([1, 2, 3, 4], "ok", 2, False)
    assert status({1: three[1], 3: three[3]}) == ([1, 2], "ok", 1, False)
    assert status({**three, 2: "{broken"}) == ([1, 2], "ok", 1, False)
    assert status({**three, 1: "{broken"}) == ([], "failed", 0, False)
    assert status({1: None}) == ([], "empty", 0, False)
    assert status({1: [{"title": {"label": "the app itself"}}], 2: three[2]}) == ([], "empty", 0, False)
    assert status({n: [entry(n, 20)] for n in range(1, 12)}) == (list(range(1, 12)), "ok", 11, False)
    assert status(three, 3) == ([1, 2, 3], "ok", 3, True)


def test_failed_sources_and_artifacts(spark, tmp_path):
    some = spark.createDataFrame([("a", 1)], "source string, seq int")
    rows, stats = ingest.union_sources({"a": some, "b": None, "c": some.limit(0)})
    assert rows.count() == 1 and {(x.source, x.status) for x in stats.collect()} == {("a", "ok"), ("b", "failed"), ("c", "empty")} and not ingest.nothing_came(stats)
    rows, stats = ingest.union_sources({"a": None, "b": None})
    assert rows is None and ingest.nothing_came(stats)
    landed.write_artifact(spark.createDataFrame([("text", f"Subject \n\nlink {report.LINK}\n")], "kind string, body string"), str(tmp_path), "email", "r1")
    assert landed.read_email(spark, str(tmp_path), "r1", report.LINK) == ("Subject", "Subject \n\nlink") and landed.read_email(spark, str(tmp_path), "r2", report.LINK) == ("", "")
    assert landed.read_artifact(spark, str(tmp_path), "nothing", "r1").count() == 0


def test_run_plan_and_pipeline(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"n_min_reviews": 1, "products": [{"slug": "p", "app_store_id": "1", "pulse_doc_id": "${DOC_OF_P}"}]}))
    with pytest.raises(runplan.PlanError):
        runplan.load_config(str(tmp_path / "c.json"))
    import os

    os.environ["DOC_OF_P"] = "d1"
    config = runplan.load_config(str(tmp_path / "c.json"))
    now = dt.datetime(2026, 5, 1, tzinfo=dt.UTC)
    plan = runplan.build_plan(config, "p", "2026-W17", now=now)
    assert plan.sources == ("app_store",) and plan.draft_only and str(plan.window_start)[:10] == "2026-03-01"
    for bad in ({"slug": "q"}, {"slug": "p", "week": "2026-W30"}, {"slug": "p", "week": "2026-W60"}, {"slug": "p", "force_resend": True}):
        with pytest.raises(runplan.PlanError):
            runplan.build_plan(config, now=now, **bad)
    assert runplan.week_range("2025-W51", "2026-W02") == ["2025-W51", "2025-W52", "2026-W01", "2026-W02"]
    rows = reviews(spark, [r(1, "the app is good and it works for my family"), r(2, "x", source="play_store")])
    assert pipeline.run(plan, config, rows).status == "ok"
    assert pipeline.run(plan, config, rows.limit(0)).status == "failed"


def test_whole_run(spark, data, tmp_path):
    from feedloom.plans.runplan import Config, Product

    landed_ = spark.read.parquet(f"{data.replace('sf0.001', 'sf0.01')}/raw_review.parquet")
    config = Config(n_min_reviews=5, products={"fintrail": Product("fintrail", "Fin Trail", "1", "2", "doc1")})
    log, root, now = AuditLog(spark, str(tmp_path / "log")), str(tmp_path / "out"), dt.datetime(2026, 5, 1, tzinfo=dt.UTC)
    plan = lambda **k: runplan.build_plan(config, "fintrail", "2026-W17", now=now, **k)
    sent = lambda *a: {"email_status": "sent", "gmail_message_id": "m1", "doc_revision_id": "7"}
    first = plan()
    out = pipeline.execute(spark, first, config, landed_, log, root, sender=sent)
    assert out.status == "ok" and 0 < out.counts["theme_count"] <= out.counts["cluster_count"] <= 5
    row = log.get(first.run_id)
    assert (row.status, row.error, row.gmail_message_id, row.doc_id, row.schema_version) == ("ok", None, "m1", "doc1", 1) and row.ended_at and json.loads(row.corpus_stats_json)["total_out"] > 5
    kinds = [x.type for x in out.blocks.orderBy("block_no").collect()]
    assert kinds[0] == "heading_2" and "blockquote" in kinds
    for name in ("raw", "clean", "clusters", "themes", "doc_report", "email"):
        assert (tmp_path / "out" / name / f"run_id={first.run_id}").is_dir()
    cached = spark.read.parquet(f"{root}/embedding_cache").count()
    again = pipeline.execute(spark, plan(), config, landed_, log, root, sender=sent)
    assert (again.status, again.reason) == ("skipped", "already_sent") and log.state().count() == 1
    forced = pipeline.execute(spark, plan(force_resend=True), config, landed_, log, root)
    assert forced.status == "ok" and spark.read.parquet(f"{root}/embedding_cache").count() == cached
    few = plan(force_resend=True)
    assert pipeline.execute(spark, few, Config(n_min_reviews=10_000, products=config.products), landed_, log, root).reason.startswith("too_few_reviews:") and log.get(few.run_id).status == "skipped"

    class Silent:
        def answers(self, prompts):
            return prompts.select("cluster_key", F.lit("null").alias("answer"))

    mute = plan(force_resend=True)
    assert pipeline.execute(spark, mute, config, landed_, log, root, provider=Silent()).status == "failed"
    assert (log.get(mute.run_id).failed_phase, log.get(mute.run_id).error) == (4, "no_validated_themes")
    statuses = pipeline.weekly(spark, config, [plan(force_resend=True)], landed_.drop("body"), log, root)
    assert list(statuses.values()) == ["failed"] and log.get(next(iter(statuses))).error not in (None, "in_flight")
    assert [pipeline.exit_code(x) for x in ([], ["ok", "skipped"], ["ok", "partial"], ["failed"], ["failed", "partial"])] == [0, 0, 2, 1, 2]


def test_log_updates(spark, tmp_path):
    log = AuditLog(spark, str(tmp_path / "log"))
    assert log.get("x") is None
    log.insert(run_id="x", product="p", iso_week="2026-W10", started_at=dt.datetime(2026, 3, 9, tzinfo=dt.UTC), status="failed", error="e" * 9000)
    assert len(log.get("x").error.encode()) == 8192 + len("…[truncated]".encode())
    log.update("x", status="ok", theme_count=3, error=None)
    assert (log.get("x").status, log.get("x").theme_count, log.get("x").error, log.get("x").forced) == ("ok", 3, None, False)
    for bad, error in (({"product": "q"}, ValueError), ({"nonsense": 1}, ValueError), ({"status": "odd"}, ValueError)):
        with pytest.raises(error):
            log.update("x", **bad)
    with pytest.raises(KeyError):
        log.update("y", status="ok")
    with pytest.raises(ValueError):
        log.insert(run_id="x", product="p", iso_week="2026-W10", started_at=dt.datetime(2026, 3, 9, tzinfo=dt.UTC), status="ok")
    log.append(log.events().limit(1).withColumn("schema_version", F.lit(9)).withColumn("run_id", F.lit("z")))
    with pytest.raises(RuntimeError, match="version"):
        log.check_version()


def test_stream(spark, tmp_path):
    text = "the app is good and it works for my family"
    reviews(spark, [r(1, text), r(2, text, rid="r1"), r(3, text), r(4, "short")]).write.parquet(str(tmp_path / "in"))
    stream = live.landed_stream(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema)
    query = live.weekly_counts(live.cleaned_stream(stream)).writeStream.outputMode("complete").format("memory").queryName("weekly").start()
    query.processAllAvailable()
    query.stop()
    assert [(x.product, x.n) for x in spark.table("weekly").collect()] == [("p", 2)]


def test_pushdown(spark, data):
    plan = spark.read.parquet(f"{data}/raw_review.parquet").where(F.col("posted_at") >= F.lit(WINDOW[0]).cast("timestamp_ntz")).select("seq")._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(posted_at" in plan and "body" not in plan.split("ReadSchema")[1]


def test_vectors_themselves_are_returned(spark, data):
    from feedloom.plans import registry

    reduced = registry.reduce_dims(spark, data).limit(50).collect()
    assert len({tuple(r.reduced) for r in reduced}) > 1
    embedded = registry.hashed_embeddings(spark, data).limit(50).collect()
    assert len({tuple(r.vector) for r in embedded}) > 1
    assert all(abs(sum(x * x for x in r.vector) - 1) < 1e-3 or not any(r.vector) for r in embedded)
