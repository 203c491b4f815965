"""Readers of landed review pages and writers of run artifacts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import synthetic_id

REVIEW = (
    "source string, review_id string, product string, rating int, title string, body string, author string, "
    "locale string, posted_at timestamp, app_version string, fetched_at timestamp, raw string"
)
ENTRY = (
    "struct<id: struct<label: string>, `im:rating`: struct<label: string>, title: struct<label: string>, content: struct<label: string>, "
    "author: struct<name: struct<label: string>>, updated: struct<label: string>, `im:version`: struct<label: string>>"
)


def payload_rating(raw: Column) -> Column:
    """The rating inside a feed payload; null for other payloads and cut-off JSON."""
    return F.try_variant_get(F.try_parse_json(raw), '$["im:rating"].label', "int")


def payload_helpful(raw: Column) -> Column:
    return F.try_variant_get(F.try_parse_json(raw), "$.thumbsUpCount", "int")


def _feed(spark: SparkSession, path: str) -> DataFrame:
    """(page, entries, fetched_at) of landed feed pages; the page is the number at the end of the file's name, entries null if the file is no feed."""
    pages = spark.read.schema(f"feed struct<entry: array<{ENTRY}>>").option("multiLine", True).json(path)
    page = F.expr("try_cast(regexp_extract(_metadata.file_name, '([0-9]+)[.][a-z.]*$', 1) as int)")
    return pages.select(F.coalesce(page, F.lit(1)).alias("page"), F.col("feed.entry").alias("entries"), F.col("feed").isNotNull().alias("read"), F.col("_metadata.file_modification_time").alias("fetched_at"))


def _feed_reviews(pages: DataFrame, product: str) -> DataFrame:
    e = pages.select("page", "fetched_at", F.posexplode("entries").alias("place", "e"))
    rows = e.select(
        F.lit("app_store").alias("source"), F.col("e.id.label").alias("_id"), F.lit(product).alias("product"), F.expr("try_cast(e.`im:rating`.label as int)").alias("rating"),
        F.col("e.title.label").alias("title"), F.coalesce("e.content.label", F.lit("")).alias("body"), F.col("e.author.name.label").alias("author"), F.lit(None).cast("string").alias("locale"),
        F.try_to_timestamp("e.updated.label").alias("posted_at"), F.col("e.im:version.label").alias("app_version"), "fetched_at", F.to_json("e").alias("raw"), "page", "place",
    )
    good = rows.where(F.col("author").isNotNull() & F.col("rating").between(1, 5) & F.col("posted_at").isNotNull())
    return good.withColumn("review_id", F.coalesce("_id", synthetic_id(F.col("author"), F.col("posted_at"), F.col("body")))).drop("_id")


def feed_pages(spark: SparkSession, path: str, product: str) -> DataFrame:
    """Reviews of landed feed pages (one JSON document to a file, ``feed.entry[]``). Entries without author or rating
    and ratings outside 1 to 5 are no reviews; a missing id is made up from author, time and body."""
    return _feed_reviews(_feed(spark, path), product).drop("page", "place")


def feed_in_order(spark: SparkSession, path: str, product: str, window_start, most: int) -> tuple[DataFrame, DataFrame]:
    """(reviews, status) of feed pages read in the order of their numbers, newest reviews first, as far as they are needed.

    The last page is the one whose oldest review lies before ``window_start``; before a page that is missing, cannot be read or holds no
    review, reading ends too. At most ``most`` reviews are kept, the first by page and place. ``status`` (source, status, pages, n, capped) is one row:
    failed if the first page cannot be read, empty without a review, else ok.
    """
    pages = _feed(spark, path)
    rows = _feed_reviews(pages, product)
    seen = pages.groupBy("page").agg(F.bool_and("read").alias("read")).join(rows.groupBy("page").agg(F.count(F.lit(1)).alias("n"), F.min("posted_at").alias("oldest")), "page", "left")
    # a feed has a few pages: their table is one row each
    known = seen.withColumn("k", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("page"))).withColumn("first", F.min("page").over(Window.partitionBy(F.lit(0))))
    bad = ~F.col("read") | (F.coalesce("n", F.lit(0)) == 0) | (F.col("page") != F.col("first") + F.col("k") - 1)
    ends = known.agg(
        F.coalesce(F.least(F.min(F.when(bad, F.col("k") - 1)), F.min(F.when(F.col("oldest") < F.lit(window_start), F.col("k")))), F.max("k"), F.lit(0)).alias("last"),
        F.min("first").alias("first"), F.coalesce(F.min_by("read", "page"), F.lit(False)).alias("read"),
    )
    end = ends.first()
    wanted = rows.where((F.col("page") - F.lit(end["first"] or 0)) < end["last"])
    ranked = wanted.withColumn("_r", F.row_number().over(Window.partitionBy("product").orderBy("page", "place"))).where(F.col("_r") <= most)
    status = ranked.agg(F.lit("app_store").alias("source"), F.count(F.lit(1)).alias("n")).select(
        "source", F.when(F.lit(not end["read"]), "failed").when(F.col("n") == 0, "empty").otherwise("ok").alias("status"), F.lit(end["last"]).alias("pages"), "n", (F.col("n") >= most).alias("capped")
    )
    return ranked.drop("_r", "page", "place"), status


def store_rows(spark: SparkSession, path: str, product: str, locale: str = "en_IN") -> DataFrame:
    """Reviews of landed scraper rows (JSON lines); rows without a time are dropped, the title is always null."""
    rows = spark.read.schema("reviewId string, userName string, content string, score int, at timestamp, appVersion string").json(path)
    payload = F.to_json(F.struct(*rows.columns, F.when(F.col("reviewId").isNull(), True).alias("synthetic_id")))
    return rows.where(F.col("at").isNotNull() & F.col("score").between(1, 5)).select(
        F.lit("play_store").alias("source"), F.coalesce("reviewId", synthetic_id(F.col("userName"), F.col("at"), F.col("content"))).alias("review_id"), F.lit(product).alias("product"),
        F.col("score").alias("rating"), F.lit(None).cast("string").alias("title"), F.coalesce("content", F.lit("")).alias("body"), F.col("userName").alias("author"), F.lit(locale).alias("locale"),
        F.col("at").alias("posted_at"), F.col("appVersion").alias("app_version"), F.col("_metadata.file_modification_time").alias("fetched_at"), payload.alias("raw"),
    )


def review_lines(spark: SparkSession, path: str) -> DataFrame:
    """Reviews of JSON lines; blank lines give no row, lines that are no JSON a row of nulls, which is dropped."""
    return spark.read.schema(REVIEW).json(path).where(F.col("review_id").isNotNull())


def write_artifact(rows: DataFrame, root: str, name: str, run_id: str, fmt: str = "json") -> str:
    """Write rows below ``root/name/run_id=...``; writing the same run again replaces only its own partition."""
    path = f"{root}/{name}"
    rows.withColumn("run_id", F.lit(run_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").format(fmt).save(path)
    return path


def read_artifact(spark: SparkSession, root: str, name: str, run_id: str, fmt: str = "json") -> DataFrame:
    """The rows that ``write_artifact`` wrote for a run; an empty DataFrame without columns if there are none."""
    try:
        return spark.read.format(fmt).load(f"{root}/{name}/run_id={run_id}")
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], "run_id string").drop("run_id")
        raise


def read_email(spark: SparkSession, root: str, run_id: str, mark: str) -> tuple[str, str]:
    """(subject, text) of a run's e-mail, the link mark removed; empty if there is none."""
    rows = read_artifact(spark, root, "email", run_id)
    found = rows.where("kind = 'text'").first() if "kind" in rows.columns else None
    text = found["body"].replace(mark, "").strip() if found else ""
    return (text.splitlines() or [""])[0].strip(), text
