"""Theming: prompt lines, answers in JSON, quote checks, title dedup, limits and budgets."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


class ThemeProvider(Protocol):
    """Turns (cluster_key, prompt) rows into (cluster_key, answer) rows, ``answer`` a JSON text or null."""

    def answers(self, prompts: DataFrame) -> DataFrame: ...


class ExtractiveProvider:
    """Built-in provider without a model: the title is the start of the first review, which is also the quote."""

    def answers(self, prompts: DataFrame) -> DataFrame:
        first = T.unescape_markup(F.regexp_extract("prompt", r'(?s)<review id="([^"]*)">(.*?)</review>', 2))
        id_ = F.regexp_extract("prompt", r'(?s)<review id="([^"]*)">(.*?)</review>', 1)
        answer = F.to_json(
            F.struct(
                F.concat_ws(" ", F.slice(T.tokens(first), 1, 6)).alias("title"), F.substring(first, 1, 200).alias("summary"),
                F.array(F.struct(F.substring(first, 1, 120).alias("text"), id_.alias("review_id"))).alias("quotes"), F.array(F.lit("Look into the reports")).alias("action_ideas"),
            )
        )
        return prompts.select("cluster_key", F.when(first != "", answer).alias("answer"))


ANSWER = "title string, summary string, quotes array<struct<text: string, review_id: string>>, action_ideas array<string>"


def exploded_ids(clusters: DataFrame, by: list[str], ids: str) -> DataFrame:
    """(by, rank, review_id): one row for each listed id."""
    return clusters.select(*by, F.posexplode(ids).alias("rank", "review_id"))


def prompt_lines(clusters: DataFrame, reviews: DataFrame, by: list[str], ids: str = "centroid_review_ids") -> DataFrame:
    """(by, rank, line): a tagged, escaped line for each listed review that exists; repeated reviews count once."""
    known = reviews.select("review_id", "seq", "text").groupBy("review_id").agg(F.min_by("text", "seq").alias("text"))
    line = F.concat(F.lit('<review id="'), F.col("review_id"), F.lit('">'), T.escape_markup(F.coalesce("text", F.lit(""))), F.lit("</review>"))
    return exploded_ids(clusters, by, ids).join(known, "review_id").select(*by, "rank", "review_id", line.alias("line"))


def prompts(lines: DataFrame, by: list[str]) -> DataFrame:
    """(by, prompt): the lines of each cluster in order; a prompt holds the few typical reviews, never all members."""
    return lines.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("rank", "line"))).alias("l")).select(*by, F.concat_ws("\n", F.transform("l", lambda x: x["line"])).alias("prompt"))


def parsed(answers: DataFrame, column: str = "answer") -> DataFrame:
    """``answers`` with ``theme``; null for null, JSON null and malformed texts."""
    theme = F.from_json(column, ANSWER, {"mode": "PERMISSIVE"})
    return answers.withColumn("theme", F.when(theme["title"].isNotNull(), theme))


def valid_quotes(quotes: DataFrame, members: DataFrame, reviews: DataFrame, by: list[str]) -> DataFrame:
    """The rows of ``quotes`` (by, review_id, quote) that are a non-empty part of a member review of their cluster.

    Both sides are normalised; the quote is unescaped first. Rows are matched by id, so there is no product of rows.
    """
    needle = T.normalize_for_match(T.unescape_markup(F.col("quote")))
    known = reviews.groupBy("review_id").agg(F.min_by("text", "seq").alias("text"))
    own = members.select(*by, "review_id").distinct()
    joined = quotes.join(own, [*by, "review_id"]).join(known, "review_id").withColumn("_n", needle)
    return joined.where((F.col("_n") != "") & F.contains(T.normalize_for_match(F.col("text")), F.col("_n"))).select(*quotes.columns)


def surviving(answers: DataFrame, members: DataFrame, reviews: DataFrame, by: list[str], rank: str, within: list[str], limit: float = 0.7) -> DataFrame:
    """(by, rank, title, summary, quotes, action_ideas): the themes that are kept.

    ``answers`` has by, ``rank`` and theme (see ``parsed``). Quotes that no member review holds are dropped, and with them a theme that
    has none left; titles are cut to 60 characters and actions of more than twelve words left out; of themes of the same ``within``
    whose titles are nearly the same the first by ``rank`` stays. A theme's quotes and a run's themes are few and are nested.
    """
    theme = answers.where("theme is not null").select(*by, rank, "theme")
    said = theme.select(*by, F.posexplode("theme.quotes").alias("_at", "_q")).select(*by, "_at", F.col("_q.review_id").alias("review_id"), F.col("_q.text").alias("quote"))
    good = valid_quotes(said, members, reviews, by).groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("_at", F.col("quote").alias("text"), "review_id"))).alias("_q"))
    kept = theme.join(good, by).select(
        *by, rank, F.left("theme.title", F.lit(60)).alias("title"), F.coalesce("theme.summary", F.lit("")).alias("summary"),
        F.transform("_q", lambda q: F.struct(q["text"].alias("text"), q["review_id"].alias("review_id"))).alias("quotes"),
        F.coalesce(short_actions(F.filter("theme.action_ideas", lambda a: a.isNotNull())), F.array().cast("array<string>")).alias("action_ideas"),
    )
    titles = kept.groupBy(*within).agg(F.array_sort(F.collect_list(F.struct(rank, *[c for c in by if c not in within], "title"))).alias("_all"))

    def keep(acc: Column, t: Column) -> Column:
        return F.when(F.exists(acc, lambda k: T.jaccard(k["title"], t["title"]) > limit), acc).otherwise(F.concat(acc, F.array(t)))

    first = titles.select(*within, F.aggregate("_all", F.slice("_all", 1, 0), keep).alias("_kept"))
    ids = first.select(*within, F.explode("_kept").alias("_k")).select(*within, *[F.col("_k")[c].alias(c) for c in by if c not in within])
    return kept.join(ids, by, "left_semi")


def dedup_titles(titles: Column, limit: float = 0.7) -> Column:
    """Titles in order, without those that share more than ``limit`` of their words with a title kept before."""
    def keep(acc: Column, t: Column) -> Column:
        return F.when(F.exists(acc, lambda k: T.jaccard(k, t) > limit), acc).otherwise(F.concat(acc, F.array(t)))

    return F.aggregate(titles, F.array().cast("array<string>"), keep)


def short_actions(actions: Column, most_words: int = 12) -> Column:
    return F.filter(actions, lambda a: T.word_count(a) <= most_words)


def token_budget(calls: DataFrame, by: list[str], order: list[str], text: str, budget: int, extra: int = 500) -> DataFrame:
    """``calls`` with estimate, running total and whether the call is admitted: a quarter of its characters and ``extra``."""
    estimate = (F.floor(F.length(F.coalesce(F.col(text), F.lit(""))) / 4) + extra).cast("long")
    run = F.sum("estimate").over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return calls.withColumn("estimate", estimate).withColumn("running", run).withColumn("admitted", F.col("running") <= budget)
