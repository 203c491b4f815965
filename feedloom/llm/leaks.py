"""Problem 7: passages of held-out items inside a corpus."""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .words import words, words_of

K1, B = 1.2, 0.75
BLOCK = 16
PASSAGE = 40
SHARD_ITEMS = 20_000  # items of one index, which is broadcast


@dataclass
class ItemIndex:
    """Inverted index of the items: postings with BM25 impacts, cut into blocks with their largest impact.

    ``masks`` has a bit for each ``BLOCK`` neighbouring items in which a term occurs.
    """

    ids: list[int]
    run: int
    postings: dict[str, tuple[list[int], list[float], list[int], list[float]]]
    top: dict[str, float]
    need: list[float]
    least: float
    grams: list[set]
    masks: dict[str, int]

    @classmethod
    def build(cls, items: list[tuple[int, str]], run: int) -> "ItemIndex":
        bags = [(i, words_of(t)) for i, t in sorted(items)]
        bags = [(i, w) for i, w in bags if len(w) >= run]
        n, mean = len(bags), float(np.mean([len(w) for _, w in bags])) if bags else 1.0
        df = Counter(t for _, w in bags for t in set(w))
        lists: dict[str, list] = {}
        need, grams = [], []
        for at, (_, w) in enumerate(bags):
            weight = {}
            for t, tf in Counter(w).items():
                idf = np.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5))
                weight[t] = float(idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(w) / mean)))
                lists.setdefault(t, []).append((at, weight[t]))
            runs = [tuple(w[s : s + run]) for s in range(len(w) - run + 1)]
            grams.append(set(runs))
            # whatever passage holds one of the runs scores at least this much
            need.append(min(sum(weight[t] for t in set(r)) for r in runs) - 1e-9)
        postings = {}
        for t, p in lists.items():
            at, w = [x for x, _ in p], [y for _, y in p]
            postings[t] = (at, w, at[BLOCK - 1 :: BLOCK] + ([at[-1]] if len(at) % BLOCK else []), [max(w[s : s + BLOCK]) for s in range(0, len(w), BLOCK)])
        masks = {}
        for t, p in postings.items():
            bits = 0
            for at in p[0]:
                bits |= 1 << (at // BLOCK)
            masks[t] = bits
        return cls([i for i, _ in bags], run, postings, {t: max(p[3]) for t, p in postings.items()}, need, min(need, default=np.inf), grams, masks)

    def retrieve(self, terms: set[str], blocks: int = -1) -> list[int]:
        """Items, in the ``blocks`` whose bits are set, whose score for the query ``terms`` reaches their threshold: block-max WAND."""
        terms = [t for t in terms if t in self.top]
        if sum(self.top[t] for t in terms) < self.least:
            return []
        cursors = [[self.postings[t], 0, self.top[t]] for t in terms]
        out = []
        while cursors:
            cursors.sort(key=lambda c: c[0][0][c[1]])
            bound, pivot = 0.0, -1
            for i, c in enumerate(cursors):
                bound += c[2]
                if bound >= self.least:
                    pivot = i
                    break
            if pivot < 0:
                break
            item = cursors[pivot][0][0][cursors[pivot][1]]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0][0][cursors[pivot + 1][1]] == item:
                pivot += 1
            # shallow: the blocks in which the item would lie
            ceiling, ends = 0.0, []
            later = blocks >> (item // BLOCK)
            if not later:
                break
            skip = 0 if later & 1 else (item // BLOCK + (later & -later).bit_length() - 1) * BLOCK
            if not skip:
                for c in cursors[: pivot + 1]:
                    last, peak = c[0][2], c[0][3]
                    b = bisect_left(last, item, c[1] // BLOCK)
                    if b < len(last):
                        ceiling += peak[b]
                        ends.append(last[b])
            if skip:
                target = skip
            elif ceiling >= self.least:
                if cursors[0][0][0][cursors[0][1]] == item:
                    score, alive = 0.0, []
                    for c in cursors:
                        if c[0][0][c[1]] == item:
                            score += c[0][1][c[1]]
                            c[1] += 1
                        if c[1] < len(c[0][0]):
                            alive.append(c)
                    cursors = alive
                    if score >= self.need[item]:
                        out.append(item)
                    continue
                target = item
            else:
                target = min(ends) + 1 if ends else item + 1
                if pivot + 1 < len(cursors):
                    target = min(target, cursors[pivot + 1][0][0][cursors[pivot + 1][1]])
                target = max(target, item + 1)
            alive = []
            for i, c in enumerate(cursors):
                if i <= pivot and c[0][0][c[1]] < target:
                    at = c[0][0]
                    c[1] = bisect_left(at, target, c[1])
                if c[1] < len(c[0][0]):
                    alive.append(c)
            cursors = alive
        return out

    def _stretches(self, w: list[str]) -> Iterator[tuple[int, int, int]]:
        """(start, end, blocks) of the stretches of words that can hold a run: any ``run`` of their words occur in one of these blocks of items."""
        masks, run = [self.masks.get(t, 0) for t in w], self.run
        start = 0
        for i, mask in enumerate([*masks, 0]):
            if mask:
                continue
            if i - start >= run:
                # common blocks of 1, 2, 4, ... words from each place on, up to a run
                common, width = masks[start:i], 1
                while width < run:
                    step = min(width, run - width)
                    common = [x & y for x, y in zip(common, common[step:])]
                    width += step
                first, blocks = None, 0
                for at, x in enumerate([*common, 0]):
                    if x:
                        first = at if first is None else first
                        blocks |= x
                    elif first is not None:
                        yield start + first, start + at - 1 + run, blocks
                        first, blocks = None, 0
            start = i + 1

    def sizes(self) -> dict[int, int]:
        """Item id -> number of its distinct runs; texts with the same id count together."""
        every: dict[int, set] = {}
        for i, g in zip(self.ids, self.grams):
            every.setdefault(i, set()).update(g)
        return {i: len(g) for i, g in every.items()}

    def leaks_of(self, text: str) -> dict[int, int]:
        """Item id -> number of its distinct runs that the text holds, for items with at least one."""
        out: dict[int, set] = {}
        w = words_of(text)
        for start, end, blocks in self._stretches(w):
            for s in range(start, end - self.run + 1, PASSAGE - self.run + 1):
                part = w[s : min(end, s + PASSAGE)]
                hits = self.retrieve(set(part), blocks)
                if hits:
                    runs = {tuple(part[j : j + self.run]) for j in range(len(part) - self.run + 1)}
                    for item in hits:
                        both = runs & self.grams[item]
                        if both:
                            out.setdefault(self.ids[item], set()).update(both)
        return {i: len(r) for i, r in out.items()}


def leaked_items(documents: DataFrame, items: DataFrame, run: int = 10, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """(item_id, doc_id, runs, item_runs): documents that hold at least ``run`` consecutive words of an item.

    ``runs`` of the item's ``item_runs`` distinct runs of ``run`` words were found. Items are indexed with BM25 impacts; the whole text of
    every document is cut into passages of 40 words that overlap by ``run`` - 1, each passage queries the index by
    block-max WAND, and all items above their threshold are compared run by run. An item's threshold is
    the least score of its own runs, so no passage that holds one is missed. Passages are left out where no block of items has all words of
    any run, as then no item has. Documents are only scanned, never shuffled.

    An index of at most ``shard_items`` items is broadcast. More items are indexed one shard after the other, each with a scan of its own, whose
    result is written before the next index is built, so one index at a time is held.

    Null texts and ids, and items of fewer than ``run`` words, give no row. Repeated documents each give their rows;
    of items with the same id the distinct runs count together.
    """
    spark = documents.sparkSession
    source = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").alias("item_text")).where("item_id is not null and item_text is not null")
    shards = max(1, -(-source.count() // shard_items))
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null and text is not null")
    out = None
    for s in range(shards):
        part = source.where(F.pmod(F.xxhash64("item_id"), F.lit(shards)) == s).toPandas()
        index = ItemIndex.build(list(zip(part["item_id"], part["item_text"])), run)
        shared = spark.sparkContext.broadcast((index, index.sizes()))

        def scan(frames: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            index, sizes = shared.value
            for frame in frames:
                rows = [(i, d, n, sizes[i]) for d, t in zip(frame["doc_id"], frame["text"]) for i, n in index.leaks_of(t).items()]
                yield pd.DataFrame(rows, columns=["item_id", "doc_id", "runs", "item_runs"]).astype("int64")

        found = docs.mapInPandas(scan, "item_id long, doc_id long, runs long, item_runs long")
        if shards > 1:
            found = materialize(found)
            shared.unpersist()
        out = found if out is None else out.unionByName(found)
    return out.groupBy("item_id", "doc_id").agg(F.max("runs").alias("runs"), F.max("item_runs").alias("item_runs"))


def with_answers(leaks: DataFrame, documents: DataFrame, items: DataFrame, answer: str) -> DataFrame:
    """``leaks`` and ``answer_found``: whether the document holds the words of the item's column ``answer``, next to each other, too.

    Items without a word in it have null; of several rows with one id any counts.
    """
    joined = lambda c: F.concat(F.lit(" "), F.array_join(words(c), " "), F.lit(" "))
    said = documents.select(F.col("doc_id").cast("long").alias("doc_id"), joined(F.col("text")).alias("said"))
    want = items.select(F.col("item_id").cast("long").alias("item_id"), joined(F.col(answer)).alias("want")).where("want <> '  '").distinct()
    found = leaks.join(want, "item_id", "left").join(said, "doc_id").select(*[leaks[c] for c in leaks.columns], F.expr("case when want is not null then position(want in said) > 0 end").alias("hit"))
    return found.groupBy(*leaks.columns).agg(F.max("hit").alias("answer_found"))
