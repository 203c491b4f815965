"""From landed reviews to the reviews of a window: cap, window, first-wins dedup, content filters, reconciled counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import materialize


def resolve_sources(registry: DataFrame) -> DataFrame:
    """``registry`` with ``sources``: the sources of which a non-empty store id is set."""
    def on(store: str, name: str) -> Column:
        return F.when(F.coalesce(F.col(store), F.lit("")) != "", name)

    return registry.withColumn("sources", F.array_compact(F.array(on("app_store_id", "app_store"), on("play_store_id", "play_store"))))


def cap_per_source(reviews: DataFrame, most: int) -> DataFrame:
    """The first ``most`` rows of each source by ``seq``; runs as a partial top-n before the shuffle."""
    rank = F.row_number().over(Window.partitionBy("source").orderBy("seq"))
    return reviews.withColumn("_rank", rank).where(F.col("_rank") <= most).drop("_rank")


def first_wins(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row for each key, the first in ``order``; the row is carried as a struct through a combined minimum,
    so a hot key costs one row for each map task. Rows with a null in a key form a key of their own."""
    rest = [c for c in rows.columns if c not in keys]
    lead = F.struct(*order, *[c for c in rest if c not in order])
    best = rows.groupBy(*keys).agg(F.min_by(lead, F.struct(*order)).alias("_row"))
    return best.select(*[F.col(c) if c in keys else F.col("_row")[c].alias(c) for c in rows.columns])


def drop_reasons(reviews: DataFrame, start: str, end: str) -> DataFrame:
    """``reviews`` with ``drop_reason``, the first rule that fails: window, dup, emoji, lang, short; null if kept.

    Duplicates are counted inside the window and before the content rules: an id is seen even if its first row is
    dropped later. Only keys and the order travel through the shuffle that finds them; ids that occur again are written before they are joined, so
    that adaptive execution splits one that many rows share.
    """
    inside, content = _rules(start, end)
    return _with_reason(reviews.withColumn("_in", inside), content)


def _rules(start: str, end: str) -> tuple[Column, Column]:
    """(whether a review lies in the window, the first content rule it breaks)."""
    lo, hi = F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")
    inside = F.coalesce(F.col("posted_at").cast("timestamp").between(lo, hi), F.lit(False))
    body = F.coalesce(F.col("body"), F.lit(""))
    content = F.when(T.has_emoji(F.col("title"), F.col("body")), "emoji").when(T.is_non_english(T.strip(body)), "lang").when(T.letter_count(body) < 4, "short")
    return inside, content


def _with_reason(rows: DataFrame, content: Column) -> DataFrame:
    """``rows`` (source, review_id, seq, _in) with ``drop_reason`` instead of _in."""
    seen = rows.where("_in").groupBy("source", "review_id").agg(F.min("seq").alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    tagged = rows.join(materialize(seen), ["source", "review_id"], "left")
    reason = F.when(~F.col("_in"), "window").when(F.col("seq") > F.col("_first"), "dup").otherwise(content)
    return tagged.withColumn("drop_reason", reason).drop("_in", "_first")


def funnel(reviews: DataFrame, start: str, end: str) -> DataFrame:
    """(source, total_in, window_dropped, dedup_dropped, emoji_dropped, lang_dropped, short_dropped, kept, total_dropped)."""
    r = F.col("drop_reason")
    names = (("window", "window_dropped"), ("dup", "dedup_dropped"), ("emoji", "emoji_dropped"), ("lang", "lang_dropped"), ("short", "short_dropped"))
    inside, content = _rules(start, end)
    judged = reviews.select("source", "review_id", "seq", inside.alias("_in"), content.alias("_content"))  # no text is shuffled
    return _with_reason(judged, F.col("_content")).groupBy("source").agg(
        F.count(F.lit(1)).alias("total_in"),
        *[F.count_if(F.coalesce(r == k, F.lit(False))).alias(n) for k, n in names],
        F.count_if(r.isNull()).alias("kept"),
        F.count_if(r.isNotNull()).alias("total_dropped"),
    )


def source_status(reviews: DataFrame, most: int) -> DataFrame:
    """(source, n, capped): how many rows each source has after ``cap_per_source``, and whether the cap was reached."""
    return reviews.groupBy("source").agg(F.least(F.count(F.lit(1)), F.lit(most)).alias("n"), (F.count(F.lit(1)) >= most).alias("capped"))


def union_sources(parts: dict[str, DataFrame | None], least: int = 1) -> tuple[DataFrame | None, DataFrame]:
    """All rows of the sources, and one status row for each: ok, empty below ``least`` rows, or failed for a source without a DataFrame.

    One failed source doesn't stop the others; see ``nothing_came``. The rows are None if all failed.
    """
    rows, stats = None, None
    for source, df in sorted(parts.items()):
        if df is None:
            session = next((x for x in parts.values() if x is not None), None)
            one = (session.sparkSession if session is not None else SparkSession.active()).createDataFrame([(source, 0, "failed")], "source string, n long, status string")
        else:
            one = df.agg(F.lit(source).alias("source"), F.count(F.lit(1)).alias("n")).withColumn("status", F.when(F.col("n") >= least, "ok").otherwise("empty"))
            rows = df if rows is None else rows.unionByName(df, allowMissingColumns=True)
        stats = one if stats is None else stats.unionByName(one)
    return rows, stats


def nothing_came(stats: DataFrame) -> bool:
    """Whether no source is ok and no row came: then a run cannot go on."""
    row = stats.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.bool_or(F.col("status") == "ok"), F.lit(False)).alias("ok")).first()
    return not row["n"] and not row["ok"]


def missing_sources(configured: DataFrame, present: DataFrame, keys: list[str]) -> DataFrame:
    """The configured keys without a row in ``present``."""
    return configured.select(*keys).distinct().join(present.select(*keys).distinct(), keys, "left_anti")
