"""Problem 5: records that are the same except for formatting, case, punctuation or order."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .words import words, words_of

_LOW40 = (1 << 40) - 1
_LOW62 = (1 << 62) - 1


def multiset_hash(fields: dict[str, Column], seed: int = 0) -> list[Column]:
    """Order-free hash of the bag of (field name, word) pairs: their number and two masked sums of their hashes.

    Addition commutes, so neither words nor fields are sorted; the sums are masked and cannot overflow. A null field
    counts as an empty one.
    """

    def hashed(name: str, text: Column) -> Column:
        return F.transform(F.coalesce(words(text), F.array().cast("array<string>")), lambda w: F.xxhash64(F.lit(name), w, F.lit(seed)))

    pairs = F.concat(*[hashed(name, c) for name, c in fields.items()])
    one = F.aggregate(pairs, F.lit(0).cast("long"), lambda acc, h: (acc + h.bitwiseAND(F.lit(_LOW40))).bitwiseAND(F.lit(_LOW62)))
    two = F.aggregate(pairs, F.lit(0).cast("long"), lambda acc, h: (acc + F.xxhash64(h, F.lit(seed + 1)).bitwiseAND(F.lit(_LOW40))).bitwiseAND(F.lit(_LOW62)))
    return [F.size(pairs).cast("long").alias("n_words"), one.alias("h1"), two.alias("h2")]


def copy_sets(rows: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(keep, copy) for each row that holds the same words equally often, in every field, as an earlier row.

    ``keep`` is the smallest ``key`` of the set. Rows are fingerprinted by ``multiset_hash`` and grouped by fingerprint (a count and a
    minimum, combined before the shuffle). In groups of several members one row of each distinct record, told by two hashes of its fields as
    they stand, is compared with the group's first row through the word counts of every field. Records that share a fingerprint
    by accident are grouped once more under other seeds. Nothing is sorted: grouping and joins go by hash tables, of which
    the smaller side is held; grouped sides are written first, so that a hot fingerprint is split. Rows with a null key or no word in any field belong to no
    set; repeated keys are one row.
    """
    fresh = {f: F.col(f) for f in fields}
    base = rows.select(F.col(key).alias("key"), *fields).where(F.col("key").isNotNull())
    print_, record = ["n_words", "h1", "h2"], ["e1", "e2"]
    todo, found = base, None
    for seed in range(0, 8, 2):
        # a null field is marked by its place, so that it isn't taken for the next one
        stands = [x for f in fields for x in (F.col(f), F.col(f).isNull())]
        prints = materialize(todo.select("key", *multiset_hash(fresh, seed), F.xxhash64(*stands).alias("e1"), F.xxhash64(*stands, F.lit(1)).alias("e2")).where("n_words > 0"))
        groups = materialize(prints.groupBy(*print_).agg(F.min("key").alias("keep"), F.max("key").alias("last")).where("keep <> last").drop("last"))
        members = materialize(prints.join(groups.hint("shuffle_hash"), print_).select("key", "keep", *record).distinct())
        first = members.where("key = keep").select("keep", *[F.col(c).alias(f"{c}_keep") for c in record])
        others = members.groupBy("keep", *record).agg(F.min("key").alias("key")).join(first.hint("shuffle_hash"), "keep").where("e1 <> e1_keep or e2 <> e2_keep").select("key", "keep", *record)
        others = materialize(others)
        left = base.select("key", *fields).join(others.hint("shuffle_hash"), "key")
        right = base.select(F.col("key").alias("keep"), *[F.col(f).alias(f"{f}__keep") for f in fields]).join(others.select("keep").distinct().hint("shuffle_hash"), "keep")
        checked = left.join(right.hint("shuffle_hash"), "keep").mapInPandas(_compare(fields, record), "keep long, e1 long, e2 long")
        wrong = materialize(checked.distinct())
        good = members.where("key <> keep").select("keep", F.col("key").alias("copy"), *record)
        if not wrong.limit(1).count():
            good = good.select("keep", "copy")
            return (good if found is None else found.unionByName(good)).distinct()
        right_ones = good.join(wrong.hint("shuffle_hash"), ["keep", *record], "left_anti").select("keep", "copy")
        found = right_ones if found is None else found.unionByName(right_ones)
        todo = base.join(good.join(wrong.hint("shuffle_hash"), ["keep", *record], "left_semi").select(F.col("copy").alias("key")).distinct().hint("shuffle_hash"), "key")
    raise RuntimeError("fingerprints collide under four seeds")


def _compare(fields: list[str], record: list[str]):
    """The records that don't hold the same words as the first row of their group."""

    def differ(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            ok = pd.Series(True, index=f.index)
            for name in fields:
                a, b = f[name].fillna(""), f[f"{name}__keep"].fillna("")
                ok &= pd.Series([x == y or Counter(words_of(x)) == Counter(words_of(y)) for x, y in zip(a, b)], index=f.index, dtype=bool)
            yield f.loc[~ok, ["keep", *record]]

    return differ


def collapsed(rows: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """One row per distinct record: all columns of its first row, and ``n_copies``, the size of its set (1 if alone)."""
    sets = materialize(copy_sets(rows, key, fields))
    counts = sets.groupBy(F.col("keep").alias(key)).agg((F.count(F.lit(1)) + 1).alias("n_copies"))
    first = rows.join(sets.select(F.col("copy").alias(key)).hint("shuffle_hash"), key, "left_anti")
    return first.join(counts.hint("shuffle_hash"), key, "left").withColumn("n_copies", F.coalesce("n_copies", F.lit(1).cast("long")))
