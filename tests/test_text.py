from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from feedloom.functions import text as T


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "text, want",
    [
        ("Email me at user@example.com please", "Email me at [email] please"),
        ("a@b.org and C@D.COM", "[email] and [email]"),
        ("user [at] example [dot] com", "[email]"),
        ("user at example dot com", "[email]"),
        ("+91 98765 43210", "[phone]"),
        ("098-765-4321", "[phone]"),
        ("+1 (415) 555-0100", "[phone]"),
        ("9 8 7 6 5 4 3 2 1 0", "[phone]"),
        ("123456789012", "[account]"),
        ("1234567890123456", "[account]"),
        ("123456789", "123456789"),
        ("in 2024", "in 2024"),
        ("version 9.5.0", "version 9.5.0"),
        ("₹500", "₹500"),
        ("https://site.com/user@mail.com/profile", "[url]"),
        ("١٢٣٤٥٦٧٨٩٠١٢", "[account]"),
        ("ends 123456789012.", "ends 123456789012."),
        ("", ""),
        (None, None),
    ],
)
def test_scrub(spark, text, want):
    assert one(spark, T.scrub(F.col("t")), t=text) == want


def test_scrub_strict_and_counts(spark):
    assert one(spark, T.scrub(F.col("t"), strict=True), t="ends 123456789012.") == "ends [account]."
    counts = T.scrub_counts(F.col("t"))
    row = spark.createDataFrame([("https://a.b/c https://d.e me@x.org 123456789012",)], "t string").select(*[c.alias(k) for k, c in counts.items()]).first()
    assert row.asDict() == {"url": 2, "email": 1, "phone": 0, "account": 1}


@pytest.mark.parametrize("text, want", [("é", "é"), ("word1   word2\t\tword3", "word1 word2 word3"), ("a​b", "ab"), ("a\nb", "a\nb"), ("  Keep, Case! 😀 ", "Keep, Case! 😀"), ("", ""), (None, None)])
def test_normalize(spark, text, want):
    assert one(spark, T.normalize_for_match(F.col("t")), t=text) == want


@pytest.mark.parametrize("text, want", [("good 😀", True), ("🇮🇳", True), ("☀", True), ("यह अच्छा है", False), ("plain", False)])
def test_emoji(spark, text, want):
    assert one(spark, T.has_emoji(F.lit(None).cast("string"), F.col("t")), t=text) is want


@pytest.mark.parametrize("text, want", [("one two three four", 4), ("one two three four five", 5), ("😀 👍", 0), ("[url]", 1), ("a b !! c", 3), (" ", 0)])
def test_tokens(spark, text, want):
    assert one(spark, T.substantive_tokens(F.col("t")), t=text) == want


def test_merge_and_letters(spark):
    assert one(spark, T.merge_fields(F.col("a"), F.col("b")), a="  Title ", b=" body") == "Title\nbody"
    assert one(spark, T.merge_fields(F.col("a"), F.col("b")), a=None, b="  ") == ""
    assert one(spark, T.letter_count(F.col("t")), t="ab1éक") == 4


@pytest.mark.parametrize(
    "text, lang", [("the app is not good and that is my view of it", "en"), ("die App ist nicht gut und ich bin mit der Seite unzufrieden", "de"), ("je ne suis pas content et les frais sont pour une page", "fr"), ("यह ऐप अच्छा है और तेज़ है", "hi"), ("приложение постоянно закрывается без ошибки", "ru"), ("xyz", None), ("", None)]
)
def test_language(spark, text, lang):
    assert one(spark, T.detect_language(F.col("t")), t=text) == lang


def test_language_gate_needs_seven_words(spark):
    assert one(spark, T.is_non_english(F.col("t")), t="die App ist nicht gut") is False
    assert one(spark, T.is_non_english(F.col("t")), t="die App ist nicht gut und ich weine") is True


def test_truncate_escape_jaccard(spark):
    cut = one(spark, T.truncate_bytes(F.col("t"), 5), t="äöü")
    assert cut == "äö\ufffd…[truncated]"
    assert one(spark, T.truncate_bytes(F.col("t"), 6), t="äöü") == "äöü"
    assert one(spark, T.unescape_markup(T.escape_markup(F.col("t"))), t="a <b> & c") == "a <b> & c"
    assert one(spark, T.jaccard(F.col("a"), F.col("b")).cast("string"), a="App crashes home screen", b="Home screen app crashes") == "1.0"
    assert one(spark, T.jaccard(F.col("a"), F.col("b")).cast("string"), a="", b=" ") == "1.0"
    assert one(spark, T.utf16_length(F.col("t")).cast("string"), t="a😀") == "3"
    assert one(spark, T.anchor(F.col("t"), F.lit("2026-W16")), t="My  Ürün App!") == "pulse-my-r-n-app-2026-W16"
