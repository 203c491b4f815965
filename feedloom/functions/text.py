"""Text expressions. Every function maps null to null unless it says otherwise and works on whole texts."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

SPACE = r"[\s\x1c-\x1f]"

# Ranges of pictographs, patterns of personal data and their order.
EMOJI = (
    r"[\x{1F600}-\x{1F64F}\x{1F300}-\x{1F5FF}\x{1F680}-\x{1F6FF}\x{1F900}-\x{1F9FF}\x{1FA00}-\x{1FA6F}"
    r"\x{1FA70}-\x{1FAFF}\x{1F1E0}-\x{1F1FF}\x{2600}-\x{26FF}\x{2700}-\x{27BF}\x{2B00}-\x{2BFF}]"
)
INVISIBLE = r"[\x{200B}-\x{200F}\x{2028}\x{2029}\x{FEFF}\x{00AD}\x{202A}-\x{202F}]"
URL = r"(?iU)https?://\S+"
EMAIL = r"(?iU)\b[A-Z0-9._%+\-]+@[A-Z0-9.\-]+\.[A-Z]{2,}\b"
EMAIL_SPELLED = (
    r"(?iU)\b[A-Z0-9._%+\-]+\s*(?:\(\s*at\s*\)|\[\s*at\s*\]|at)\s*[A-Z0-9.\-]+"
    r"\s*(?:\(\s*dot\s*\)|\[\s*dot\s*\]|dot)\s*[A-Z]{2,}\b"
)
PHONE = (
    r"(?U)(?:\+(?=\d[\d\s\-().]{7,}\d)\d(?:[\s\-().]*\d){6,}"
    r"|\(?\d{3,5}\)?[\s\-.]\d{3,5}(?:[\s\-.]\d{2,})+|(?:\d\s){6,}\d)"
)
ACCOUNT = r"(?U)(?<!\.)\b\d{10,16}\b(?!\.)"
ACCOUNT_STRICT = r"(?U)\b\d{10,16}\b"
ARABIC_INDIC = "٠١٢٣٤٥٦٧٨٩"

# Frequent function words by which the built-in detector tells languages apart.
FUNCTION_WORDS = {
    "en": ("the", "and", "is", "was", "for", "with", "that", "this", "not", "are", "have", "my", "it", "to", "of", "after", "on"),
    "de": ("der", "die", "das", "und", "ist", "nicht", "ich", "mit", "ein", "auf", "wird", "meine", "wurde", "schon", "seit"),
    "fr": ("le", "les", "est", "des", "une", "pas", "je", "pour", "dans", "sur", "avec", "sans", "mon", "depuis", "et"),
    "es": ("el", "los", "las", "es", "una", "por", "con", "para", "que", "mi", "muy", "sin", "pero", "desde", "y"),
    "pt": ("o", "os", "uma", "não", "com", "para", "que", "meu", "minha", "mas", "são", "muito", "sem", "há", "e"),
}


@F.pandas_udf(StringType())
def _nfc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFC", t))


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, rf"(?U)^{SPACE}+|{SPACE}+$", "")


def tokens(text: Column) -> Column:
    """Array of the pieces between runs of white space; empty for blank text."""
    return F.filter(F.split(text, rf"(?U){SPACE}+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(tokens(text))


def merge_fields(*fields: Column) -> Column:
    """Stripped fields joined by a line break; blank and null ones are left out, an empty string if all are."""
    return F.concat_ws("\n", *[F.nullif(strip(c), F.lit("")) for c in fields])


def normalize_for_match(text: Column) -> Column:
    """NFC, no invisible characters, runs of blanks and tabs as one blank, stripped; case and punctuation stay."""
    composed = _nfc(text)
    return strip(F.regexp_replace(F.regexp_replace(composed, INVISIBLE, ""), r"[ \t]+", " "))


def text_hash(text: Column) -> Column:
    return F.sha2(normalize_for_match(text), 256)


def has_emoji(*fields: Column) -> Column:
    """Whether any field holds a pictograph; null fields count as empty."""
    return F.concat_ws(" ", *fields).rlike(EMOJI)


def letter_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"\p{L}"))


def substantive_tokens(text: Column) -> Column:
    """Number of tokens with a letter, a digit or an underscore."""
    return F.size(F.filter(tokens(text), lambda w: w.rlike(r"[\p{L}\p{N}_]")))


def detect_language(text: Column) -> Column:
    """en, de, fr, es, pt, hi or ru by script and function words; null if inconclusive.

    Stays inside the JVM. A text with three Devanagari or five Cyrillic letters is decided by script; else the language
    with most function words wins, if it has at least two and no other has as many.
    """
    names = F.array(*[F.lit(k) for k in FUNCTION_WORDS])

    def judge(ws: Column) -> Column:
        counts = F.array(*[F.size(_among(ws, v)) for v in FUNCTION_WORDS.values()])
        return let(counts, lambda n: let(F.array_max(n), lambda most: F.when((most >= 2) & (F.size(F.filter(n, lambda x: x == most)) == 1), F.element_at(names, F.array_position(n, most).cast("int")))))

    return (
        F.when(F.regexp_count(text, F.lit(r"[\x{0900}-\x{097F}]")) >= 3, "hi")
        .when(F.regexp_count(text, F.lit(r"[\x{0400}-\x{04FF}]")) >= 5, "ru")
        .otherwise(let(F.split(F.lower(text), r"[^\p{L}\p{M}]+"), judge))
    )


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _among(words: Column, known: tuple[str, ...]) -> Column:
    return F.filter(words, lambda w: w.isin(*known))


def is_non_english(text: Column, least_words: int = 7) -> Column:
    """Whether a text of at least ``least_words`` words is in another language; inconclusive texts are kept (false)."""
    return F.coalesce((word_count(text) >= least_words) & (detect_language(text) != "en"), F.lit(False))


def scrub_steps(text: Column, strict: bool = False) -> list[tuple[str, Column, str]]:
    """The chain of rewrites as (kind, text before the step, pattern); each step sees the result of the one before."""
    now = F.translate(text, ARABIC_INDIC, "0123456789")
    steps = []
    for kind, pattern in (("url", URL), ("email", EMAIL), ("email", EMAIL_SPELLED), ("phone", PHONE), ("account", ACCOUNT_STRICT if strict else ACCOUNT)):
        steps.append((kind, now, pattern))
        now = F.regexp_replace(now, pattern, f"[{kind}]")
    return steps


def scrub(text: Column, strict: bool = False) -> Column:
    """``text`` with URLs, e-mail addresses, phone and account numbers as placeholders.

    A number beside a full stop is left alone (it may be part of a version) unless ``strict``.
    """
    kind, before, pattern = scrub_steps(text, strict)[-1]
    return F.regexp_replace(before, pattern, f"[{kind}]")


def scrub_counts(text: Column) -> dict[str, Column]:
    """Number of replacements of each kind."""
    out: dict[str, Column] = {}
    for kind, before, pattern in scrub_steps(text):
        n = F.regexp_count(before, F.lit(pattern)).cast("long")
        out[kind] = out[kind] + n if kind in out else n
    return out


def iso_format(ts: Column) -> Column:
    """``2026-03-01T10:00:00+00:00``, with six digits of the second if it is not whole."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    return F.concat(whole, F.when(F.date_format(ts, "SSSSSS") != "000000", F.concat(F.lit("."), F.date_format(ts, "SSSSSS"))).otherwise(""), F.lit("+00:00"))


def synthetic_id(author: Column, posted_at: Column, body: Column) -> Column:
    """``synth_`` and 16 hex digits of a hash of author, time and the first 200 characters of the body."""
    key = F.concat(F.coalesce(author, F.lit("")), F.lit("|"), iso_format(posted_at), F.lit("|"), F.substring(F.coalesce(body, F.lit("")), 1, 200))
    return F.concat(F.lit("synth_"), F.substring(F.sha2(key, 256), 1, 16))


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


def anchor(product: Column, week: Column) -> Column:
    return F.concat(F.lit("pulse-"), slug(product), F.lit("-"), week)


def utf16_length(text: Column) -> Column:
    """Number of UTF-16 code units."""
    return (F.octet_length(F.encode(text, "UTF-16LE")) / 2).cast("int")


def escape_markup(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def unescape_markup(text: Column) -> Column:
    """Reverses ``escape_markup``, the ampersand first."""
    return F.replace(F.replace(F.replace(text, F.lit("&amp;"), F.lit("&")), F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">"))


def truncate_bytes(text: Column, most: int = 8192, suffix: str = "…[truncated]") -> Column:
    """At most ``most`` bytes of UTF-8, with a suffix if anything was cut; a character cut in two becomes a replacement character."""
    head = F.make_valid_utf8(F.substring(F.encode(text, "UTF-8"), 1, most).cast("string"))
    return F.when(F.octet_length(text) > most, F.concat(head, F.lit(suffix))).otherwise(text)


def jaccard(a: Column, b: Column) -> Column:
    """Share of common words of two texts, in lower case; 1 if neither has a word."""
    x, y = F.array_distinct(tokens(F.lower(a))), F.array_distinct(tokens(F.lower(b)))
    union = F.size(F.array_union(x, y))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(x, y)) / union)
