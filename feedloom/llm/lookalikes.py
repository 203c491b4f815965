"""Problem 3: texts that look the same but differ in their characters."""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize

# Letters of other scripts that are drawn like a Latin letter, and that letter.
_CYRILLIC = "аеорсухіјѕһԁԛԝӏАВЕКМНОРСТУХІЈЅԚԜӀ"
_CYRILLIC_AS = "aeopcyxijshdqwlABEKMHOPCTYXIJSQWI"
_GREEK = "οναρυιγΑΒΕΖΗΙΚΜΝΟΡΤΥΧϲϳ"
_GREEK_AS = "ovapuiyABEZHIKMNOPTYXcj"
_OTHER = "օսցհոզɡɑıѵѴԌ"
_OTHER_AS = "oughnqgaivVG"
_ARMENIAN_CHEROKEE = "ՏՕՍᎪᏴᏟᎬᏀᎻᎫᏦᏞᎷᏢᏚᎢᏙᎳᏃ"
_ARMENIAN_CHEROKEE_AS = "SOUABCEGHJKLMPSTVWZ"
_ROMAN = "ⅠⅤⅩⅬⅭⅮⅯⅰⅴⅹⅼⅽⅾⅿ"
_ROMAN_AS = "IVXLCDMivxlcdm"
# Ligatures and the letters they stand for.
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st", "ĳ": "ij", "Ĳ": "IJ", "ŉ": "ʼn", "ǆ": "dž", "ǉ": "lj", "ǌ": "nj"}


@lru_cache(maxsize=1)
def tables() -> tuple[str, str, str]:
    """(characters, their replacements, characters to delete), for ``translate``.

    Built by rule: wide, narrow and font variants of a letter stand for the plain one; every kind of space but the ordinary
    one becomes it; format characters, soft hyphens and variation selectors vanish; look-alike letters, also under
    an accent, become the Latin letter (under the same accent).
    """
    alike = dict(zip(_CYRILLIC + _GREEK + _OTHER + _ARMENIAN_CHEROKEE + _ROMAN, _CYRILLIC_AS + _GREEK_AS + _OTHER_AS + _ARMENIAN_CHEROKEE_AS + _ROMAN_AS))
    pairs, gone = dict(alike), []
    for point in range(0xA0, sys.maxunicode + 1):
        char = chr(point)
        category = unicodedata.category(char)
        if category in ("Cn", "Co", "Cs"):
            continue
        if category == "Cf" or 0xFE00 <= point <= 0xFE0F or 0xE0100 <= point <= 0xE01EF or point in (0x034F, 0x115F, 0x1160, 0x3164, 0xFFA0):
            gone.append(char)
            continue
        if category == "Zs":
            pairs[char] = " "
            continue
        kind, _, rest = unicodedata.decomposition(char).partition(" ")
        if kind in ("<wide>", "<narrow>", "<font>"):
            plain = unicodedata.normalize("NFKC", char)
            if len(plain) == 1:
                pairs[char] = alike.get(plain, plain)
        elif kind and kind[0] != "<":
            parts = unicodedata.normalize("NFD", char)
            if parts[0] in alike:
                plain = unicodedata.normalize("NFC", alike[parts[0]] + parts[1:])
                if len(plain) == 1:
                    pairs[char] = plain
    return "".join(pairs), "".join(pairs.values()), "".join(gone)


def consistent(text: Column) -> Column:
    """``text`` with look-alikes replaced by rule (see ``tables``); ASCII texts are passed through unchanged."""
    old, new, gone = tables()
    out = F.translate(text, old + gone, new)
    for ligature, letters in LIGATURES.items():
        out = F.replace(out, F.lit(ligature), F.lit(letters))
    return F.when(text.rlike(r"[^\x00-\x7F]"), out).otherwise(text)


def consistent_text(text: str) -> str:
    """The same mapping for Python code."""
    if text.isascii():
        return text
    return unicodedata.normalize("NFC", text.translate(_python_table()))


@lru_cache(maxsize=1)
def _python_table() -> dict:
    old, new, gone = tables()
    return {ord(a): b for a, b in zip(old, new)} | {ord(g): None for g in gone} | {ord(a): b for a, b in LIGATURES.items()}


@lru_cache(maxsize=1)
def _bare_letters() -> tuple[str, str]:
    """(letters with an accent, and marks; the letters without), for ``translate``; marks vanish. Hangul is left out, see ``_coarse``."""
    pairs, gone = {}, []
    for point in range(0xA0, sys.maxunicode + 1):
        char = chr(point)
        category = unicodedata.category(char)
        if category[0] == "M":
            gone.append(char)
        elif category[0] == "L" and not 0xAC00 <= point <= 0xD7A3:
            kind = unicodedata.decomposition(char)
            if kind and kind[0] != "<":
                pairs[char] = unicodedata.normalize("NFD", char)[0]
    return "".join([*pairs, *gone]), "".join(pairs.values())


# Letters of these scripts, and pictographs, have weights of their own in the collation: texts that differ in one are never equal.
_KEPT = r"[^\x20-\x7E\p{IsLatin}\p{IsGreek}\p{IsCyrillic}\p{IsDevanagari}\p{IsBengali}\p{IsTamil}\p{IsArabic}\p{IsHebrew}\p{IsHan}\p{IsHiragana}\p{IsKatakana}\x{1F300}-\x{1F3FA}\x{1F400}-\x{1F64F}\x{1F680}-\x{1F6FF}\x{1F900}-\x{1FAFF}]+|\p{Lm}+|(?![\x20-\x7E])[\p{N}\p{P}\p{C}\p{Sk}]+"


def _coarse(mapped: Column) -> Column:
    """A hash that is equal for texts equal under the collation: what is left without accents, of ASCII and of the letters of the larger scripts."""
    bare = F.regexp_replace(F.translate(mapped, *_bare_letters()), _KEPT, "")
    return F.xxhash64(F.when(mapped.rlike(r"[^\x20-\x7E]"), bare).otherwise(mapped))


def _classed(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(strings, members): the strings of every class (tbl, e1, e2, text, canonical), and the rows that hold them (tbl, row_id, e1, e2).

    ``e1`` and ``e2`` are hashes of the string as it stands. Texts are mapped in one scan, which keeps their hashes only; the texts
    of coarse groups with at least two different strings are read once more, and of each string one is looked at.
    """
    spark = rows.sparkSession
    base = rows.select("tbl", F.col("row_id").cast("long").alias("row_id"), "text").where("text is not null")
    hashes = (F.xxhash64("text").alias("e1"), F.xxhash64("text", F.lit(1)).alias("e2"))
    prints = materialize(base.select("tbl", "row_id", *hashes, _coarse(consistent(F.col("text"))).alias("coarse")))
    texts = prints.groupBy("tbl", "coarse", "e1", "e2").agg(F.count(F.lit(1)).alias("n"))
    # groups are written before they are joined, so that adaptive execution can split a hot one
    mixed = materialize(texts.groupBy("tbl", "coarse").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("tbl", "coarse"))
    some = materialize(prints.join(mixed, ["tbl", "coarse"]))
    wanted = some.select("tbl", "row_id", "e1", "e2").groupBy("tbl", "e1", "e2").agg(F.min("row_id").alias("row_id"))
    strings = base.select("*", *hashes).join(wanted, ["tbl", "row_id", "e1", "e2"]).groupBy("tbl", "e1", "e2").agg(F.min("text").alias("text"))
    mapped = materialize(strings.withColumn("mapped", consistent(F.col("text"))).withColumn("coarse", _coarse(F.col("mapped"))))
    classes = spark.sql(
        """
        select tbl, coarse, collate(mapped, 'UNICODE') as form, min(text) as canonical
        from {mapped}
        group by tbl, coarse, collate(mapped, 'UNICODE')
        having min(text) <> max(text)
        """,
        mapped=mapped,
    )
    found = spark.sql(
        """
        select s.tbl, s.e1, s.e2, s.text, c.canonical
        from {mapped} s join {classes} c
        on s.tbl = c.tbl and s.coarse = c.coarse and collate(s.mapped, 'UNICODE') = c.form
        """,
        mapped=mapped,
        classes=classes,
    )
    found = materialize(found)
    members = some.join(found.select("tbl", "e1", "e2"), ["tbl", "e1", "e2"]).select("tbl", "row_id", "e1", "e2")
    return found, members


def look_alike_rows(rows: DataFrame) -> DataFrame:
    """(tbl, row_id, text, canonical): the rows that look like a row of other characters in the same table.

    ``rows`` has tbl, row_id, text; further columns are ignored. The mapped texts are grouped under the accent- and case-sensitive
    Unicode collation (which also ignores what cannot be seen and takes separate and composed accents as the same), in
    SQL; ``canonical``, the same for all rows of a class, is the least of its texts by code point. Null texts
    belong to no class; an empty text is a text. A first grouping by a hash that the collation cannot tell
    apart leaves only groups with at least two different strings, and of each string one row, so copies of one
    string, however many, are never sorted or joined as texts. Repeated rows each give a row.
    """
    strings, members = _classed(rows)
    return members.join(strings, ["tbl", "e1", "e2"]).select("tbl", "row_id", "text", "canonical")


def look_alike_classes(rows: DataFrame) -> DataFrame:
    """(tbl, row_id, class_id, class_rows, class_texts): each row that looks like a row of other characters, with its class.

    ``class_id`` is the class's smallest row_id, ``class_rows`` its number of rows, ``class_texts`` that of its different strings. See
    ``look_alike_rows``.
    """
    strings, members = _classed(rows)
    named = strings.select("tbl", "e1", "e2", F.xxhash64("canonical").alias("c1"), F.xxhash64("canonical", F.lit(1)).alias("c2"))
    found = materialize(members.join(named, ["tbl", "e1", "e2"]))
    texts = named.groupBy("tbl", "c1", "c2").agg(F.count(F.lit(1)).alias("class_texts"))
    sizes = found.groupBy("tbl", "c1", "c2").agg(F.min("row_id").alias("class_id"), F.count(F.lit(1)).alias("class_rows"))
    classes = materialize(sizes.join(texts, ["tbl", "c1", "c2"]))
    return found.join(classes, ["tbl", "c1", "c2"]).select("tbl", "row_id", "class_id", "class_rows", "class_texts")


def look_alike_pairs(rows: DataFrame, salt_rows: int = 2000) -> DataFrame:
    """(tbl, row_a, row_b), row_a < row_b: rows of one class whose texts are not the same string.

    The different strings of a class are paired, and rows meet through these pairs, so rows of one string are never compared. Strings
    of more than ``salt_rows`` rows are cut, and every pair of cuts is a key of its own. A pair
    of rows is listed once, also where rows are repeated.
    """
    strings, members = _classed(rows)
    members = materialize(members.distinct())
    named = strings.select("tbl", "e1", "e2", F.xxhash64("canonical").alias("c1"), F.xxhash64("canonical", F.lit(1)).alias("c2"))
    size = members.groupBy("tbl", "e1", "e2").agg(F.ceil(F.count(F.lit(1)) / salt_rows).cast("int").alias("cuts"))
    sized = materialize(named.join(size, ["tbl", "e1", "e2"]))
    one, two = (sized.select("tbl", "c1", "c2", *[F.col(c).alias(f"{c}_{side}") for c in ("e1", "e2", "cuts")]) for side in "ab")
    pairs = one.join(two, ["tbl", "c1", "c2"]).where("e1_a < e1_b or (e1_a = e1_b and e2_a < e2_b)")
    keys = pairs.withColumn("salt_a", F.explode(F.sequence(F.lit(0), F.col("cuts_a") - 1))).withColumn("salt_b", F.explode(F.sequence(F.lit(0), F.col("cuts_b") - 1)))
    cut = members.join(size, ["tbl", "e1", "e2"]).withColumn("salt", F.pmod("row_id", "cuts").cast("int"))
    side = lambda x: cut.select("tbl", F.col("row_id").alias(f"row_{x}"), *[F.col(c).alias(f"{c}_{x}") for c in ("e1", "e2", "salt")])
    met = keys.join(side("a"), ["tbl", "e1_a", "e2_a", "salt_a"]).join(side("b"), ["tbl", "e1_b", "e2_b", "salt_b"])
    return met.where("row_a <> row_b").select("tbl", F.least("row_a", "row_b").alias("row_a"), F.greatest("row_a", "row_b").alias("row_b")).distinct()
