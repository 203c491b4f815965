"""Read side: themes with ratings, levels, sentiment, activity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def enriched_themes(themes: DataFrame, ratings: DataFrame, by: list[str], ids: str) -> DataFrame:
    """(by, review_count, avg_rating): number of listed ids, matched or not, and the mean of the ratings found."""
    listed = themes.select(*by, F.explode_outer(ids).alias("review_id"))
    known = ratings.groupBy("review_id").agg(F.min_by("rating", "seq").alias("rating"))
    return listed.join(known, "review_id", "left").groupBy(*by).agg(F.count("review_id").alias("review_count"), F.avg("rating").alias("avg_rating"))


# Labels and colours of the read side.
TOP, HIGH, OTHER = "Top Priority", "High Priority", "Priority"
RED, ORANGE, BLUE, GREEN, GREY = "#ef4444", "#f97316", "#3b82f6", "#22c55e", "#9ca3af"
DRAFTED, UPDATED = "Drafted weekly pulse for ", "Updated Pulse Doc for "
TIME_FORMAT = "dd/MM/yyyy, HH:mm:ss"


def prioritised(themes: DataFrame, by: list[str], theme: str) -> DataFrame:
    """``themes`` with position, label and colour: the first is top, the next two high; ties in size by ``theme``."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("review_count"), theme)) - 1
    at = F.col("position")
    label = F.when(at == 0, TOP).when(at <= 2, HIGH).otherwise(OTHER)
    colour = F.when(at == 0, RED).when(at <= 2, ORANGE).otherwise(BLUE)
    return themes.withColumn("position", place).withColumn("priority", label).withColumn("priority_colour", colour)


def pulse_level(average: Column) -> Column:
    return F.when(average < 3.5, "High").when(average < 4.2, "Medium").otherwise("Low")


def sentiment(average: Column) -> Column:
    """Signed distance of the mean rating from 3.5 in percent points of 20 each."""
    return (average - 3.5) * 20


def sentiment_label(average: Column) -> Column:
    return F.when(average.isNull(), "neutral").when(sentiment(average) >= 0, "bullish").otherwise("bearish")


def sentiment_display(average: Column) -> tuple[Column, Column]:
    """(value, direction): the sentiment with its sign, to one decimal, and up or down; 0.0 and neutral without a rating."""
    delta = sentiment(average)
    value = F.concat(F.when(delta >= 0, "+").otherwise(""), F.format_string("%.1f", delta), F.lit("%"))
    return F.when(average.isNull(), "0.0").otherwise(value), F.when(average.isNull(), "neutral").when(delta >= 0, "up").otherwise("down")


def summary(themes: DataFrame, by: list[str]) -> DataFrame:
    """(by, n_themes, mean_rating, level, sentiment, mood, urgent): urgent themes have an average below 4."""
    mean = F.avg("avg_rating")
    return themes.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_themes"), mean.alias("mean_rating"), pulse_level(mean).alias("level"), sentiment(mean).alias("sentiment"),
        sentiment_label(mean).alias("mood"), F.count_if(F.col("avg_rating") < 4).alias("urgent"),
    )


def latest_good(runs: DataFrame) -> DataFrame:
    """The last ok or partial run of each product."""
    rest = [c for c in runs.columns if c != "product"]
    last = runs.where(F.col("status").isin("ok", "partial")).groupBy("product").agg(F.max_by(F.struct(*rest), F.struct("started_at", "run_id")).alias("_row"))
    return last.select("product", *[F.col("_row")[c].alias(c) for c in rest])


def activity(runs: DataFrame, n: int = 3) -> DataFrame:
    """The last ``n`` runs of each product with a label and a colour: drafted if there is a draft, else updated if there is a document, else its status."""
    rank = F.row_number().over(Window.partitionBy("product").orderBy(F.desc("started_at"), "run_id"))
    drafted, updated = F.coalesce("gmail_draft_id", F.lit("")) != "", F.coalesce("doc_id", F.lit("")) != ""
    label = F.when(drafted, F.concat(F.lit(DRAFTED), "iso_week")).when(updated, F.concat(F.lit(UPDATED), "iso_week")).otherwise(F.concat(F.lit("Run "), "status", F.lit(" for "), "iso_week"))
    return runs.withColumn("rank", rank).where(F.col("rank") <= n).withColumn("label", label).withColumn("colour", F.when(drafted | updated, GREEN).otherwise(GREY))


def team_name(email: Column) -> Column:
    """A team's name from an e-mail address: the words before the @, each with a capital; null for null."""
    words = F.filter(F.split(F.regexp_replace(F.split(email, "@")[0], "[._-]", " "), r"\s+"), lambda w: w != "")
    return F.array_join(F.transform(words, F.initcap), " ")


def shown_time(at: Column) -> Column:
    return F.date_format(at, TIME_FORMAT)


def shown_quote(text: Column, most: int = 120) -> Column:
    """A quote cut to ``most`` characters, with an ellipsis if something is missing."""
    return F.when(F.length(text) > most, F.concat(F.rtrim(F.left(text, F.lit(most))), F.lit("…"))).otherwise(text)


def stars(average: Column) -> tuple[Column, Column]:
    """(full, half) stars."""
    full = F.floor(average).cast("int")
    return full, (average - full >= 0.5)
