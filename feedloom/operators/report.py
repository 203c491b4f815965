"""Report blocks, keys and links."""

from __future__ import annotations

import html

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

# The mark that delivery replaces by the link, and the form of the link.
LINK = "{{PULSE_DEEP_LINK}}"
DOCUMENT = "https://docs.google.com/document/d/"
HEADING_LENGTH = 80


def idempotency_key(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", *parts), 256)


def deep_link(doc_id: Column, anchor: Column) -> Column:
    return F.concat(F.lit(DOCUMENT), doc_id, F.lit("/edit#heading="), anchor)


def replace_link(body: Column, url: Column) -> Column:
    """``body`` with its link mark replaced; an error where the mark is missing."""
    return F.when(F.contains(body, F.lit(LINK)), F.replace(body, F.lit(LINK), url)).otherwise(F.raise_error(F.lit("the text has no link mark")))


def _block(kind: str, text: Column, anchor: Column | None = None, attribution: Column | None = None) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(F.lit(kind).alias("type"), text.alias("text"), (anchor if anchor is not None else none).alias("anchor"), (attribution if attribution is not None else none).alias("attribution"))


_NO_BLOCKS = "array<struct<type: string, text: string, anchor: string, attribution: string>>"


def theme_blocks(title: Column, summary: Column, quotes: Column, ideas: Column) -> Column:
    """The blocks of one theme: heading, summary, quotes with their review, and the action ideas if there are any. ``quotes`` is an array of (text, review_id)."""
    none = F.array().cast(_NO_BLOCKS)
    said = F.coalesce(F.transform(quotes, lambda q: _block("blockquote", q["text"], attribution=q["review_id"])), none)
    listed = F.when(F.size(ideas) > 0, F.concat(F.array(_block("heading_3", F.lit("Action ideas"))), F.transform(ideas, lambda a: _block("bullet", a))))
    return F.concat(F.array(_block("heading_3", F.left(title, F.lit(HEADING_LENGTH))), _block("paragraph", summary)), said, F.coalesce(listed, none))


def doc_blocks(reports: DataFrame, themes: DataFrame, by: list[str]) -> DataFrame:
    """(by, block_no, type, text, anchor, attribution): the blocks of each report in order.

    ``reports`` has by, product, week, window_start, window_end, llm_model, sources, missing_sources (arrays), total_in, total_out and
    fallback_used; ``themes`` by, theme_no, title, summary, quotes and action_ideas. The heading, the only block with an anchor, comes first, then the themes
    by number, a line on how the report was made, and notes on a fallback and on sources without data. A report without themes has the rest. The
    themes of a report are few, as only the best clusters get one, so they are nested.
    """
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    own = themes.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("theme_no", theme_blocks(F.col("title"), F.col("summary"), F.col("quotes"), F.col("action_ideas")).alias("blocks")))).alias("_t"))
    none = F.array().cast(_NO_BLOCKS)
    head = _block("heading_2", F.concat(F.lit("Week of "), day("window_end"), F.lit(" (ISO "), "week", F.lit(") — "), F.col("total_out").cast("string"), F.lit(" reviews")), T.anchor(F.col("product"), F.col("week")))
    counts = F.array_join(F.transform("sources", lambda x: F.concat(x, F.lit("="), F.col("total_in").cast("string"))), ", ")
    foot = _block("paragraph", F.concat(F.lit("LLM: "), F.coalesce("llm_model", F.lit("")), F.lit(" · Window: "), day("window_start"), F.lit(" → "), day("window_end"), F.lit(" · Sources: "), counts))
    fallback = F.when(F.col("fallback_used"), F.array(_block("paragraph", F.lit("Low-volume week — themes derived by rating bucket, not clustering."))))
    gone = F.transform("missing_sources", lambda x: _block("paragraph", missing_note(x)))
    blocks = F.concat(F.array(head), F.coalesce(F.flatten(F.transform("_t", lambda x: x["blocks"])), none), F.array(foot), F.coalesce(fallback, none), F.coalesce(gone, none))
    return reports.join(own, by, "left").select(*by, F.posexplode(blocks).alias("block_no", "b")).select(*by, "block_no", "b.type", "b.text", "b.anchor", "b.attribution")


def missing_note(source: Column) -> Column:
    return F.concat(F.initcap(F.replace(source, F.lit("_"), F.lit(" "))), F.lit(" unavailable this week."))


def source_notes(missing: DataFrame) -> DataFrame:
    """``missing`` with a note for each source without data."""
    return missing.withColumn("note", missing_note(F.col("source")))


def email_subject(display_name: str, window_end) -> str:
    return f"Weekly Pulse — {display_name} — Week of {window_end:%Y-%m-%d}"


def email_footer(llm_model: str, window_start, window_end, sources) -> str:
    return f"LLM: {llm_model} · Window: {window_start:%Y-%m-%d} → {window_end:%Y-%m-%d} · Sources: {', '.join(sources)}"


def one_link(body: str) -> str:
    """``body`` if it has exactly one link mark, else an error."""
    if body.count(LINK) != 1:
        raise ValueError(f"the text must hold its link mark once, not {body.count(LINK)} times")
    return body


def email_html(subject: str, titles: list[str], footer: str, most_bytes: int = 50_000) -> str:
    """The e-mail of at most three titles, of one if three make it larger than ``most_bytes``; all texts are escaped."""
    def render(some: list[str]) -> str:
        rows = "".join(f"<li>{html.escape(t)}</li>" for t in some)
        return f'<h2>{html.escape(subject)}</h2><ul>{rows}</ul><p><a href="{LINK}">Full report</a></p><p>{html.escape(footer)}</p>'

    out = render(titles[:3])
    return one_link(out if len(out.encode()) <= most_bytes else render(titles[:1]))


def email_text(subject: str, titles: list[str], footer: str) -> str:
    """The same as plain text; its first line is the subject."""
    return one_link("\n".join([subject, "", *(f"- {t}" for t in titles[:3]), "", f"Full report: {LINK}", "", footer, ""]))


def required_tools(servers: DataFrame) -> DataFrame:
    """``servers`` (required, available: arrays) with ``missing``."""
    return servers.withColumn("missing", F.array_sort(F.array_except("required", "available")))


def header_matches(messages: DataFrame, value: str, limit: int) -> DataFrame:
    """Up to ``limit`` messages, by id, of which a header has the value."""
    return messages.where(F.array_contains(F.map_values("headers"), value)).orderBy("message_id").limit(limit)
