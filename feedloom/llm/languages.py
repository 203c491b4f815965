"""Problem 6: the language of each document and of each stretch of a mixed one."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lookalikes import consistent_text

LANGUAGES = ("en", "de", "fr", "es", "pt", "hi", "ru")
# Codes of the languages above with three letters, and ways to leave a locale open.
CODES = {"eng": "en", "deu": "de", "ger": "de", "fra": "fr", "fre": "fr", "spa": "es", "por": "pt", "hin": "hi", "rus": "ru"}
OPEN = ("", "und", "n/a")

TRAIN_ROWS = 1500  # of each language: the bound of the labelled sample
BUCKETS = 1 << 15
WIDTH = 16
CLIP = 3.0
_END = re.compile(r"[.!?।;|…:][\"'”»)\]]*$|^[|–—-]+$")
_LETTERS = re.compile(r"[^\W\d_]")
_LATIN = re.compile(r"[A-Za-zÀ-ɏ]")
_ALIEN = re.compile(r"[Ͱ-ԯ０-ｚ­͏​-‏⁠-⁤﻿]")


def locale_language(locale: Column) -> Column:
    """The language a locale names, null where it names none: the part before ``-`` or ``_``, in any case."""
    code = F.lower(F.trim(F.regexp_extract(F.coalesce(locale, F.lit("")), r"^\s*([^-_]*)", 1)))
    pairs = F.create_map(*[F.lit(x) for pair in CODES.items() for x in pair])
    return F.when(F.lower(F.trim(F.coalesce(locale, F.lit("")))).isin(*OPEN), None).otherwise(F.coalesce(pairs[code], code))


def fold(token: str) -> str:
    """The lower-case letters of a token, look-alikes and invisible characters of a mixed token undone."""
    if not token.isascii() and _ALIEN.search(token) and (_LATIN.search(token) or not re.search("[а-яё]{3}", token)):
        token = consistent_text(token).lower()
    return token.strip(".,;:!?\"'()[]«»“”„।…–—-*#")


def subwords(word: str) -> np.ndarray:
    """Buckets of a word's hashed subwords: the word itself and its runs of one to four characters, with its ends marked."""
    w = f"<{word}>"
    out = [zlib.crc32(w.encode()) % BUCKETS]
    for n in (2, 3, 4):
        out += [zlib.crc32(w[i : i + n].encode()) % BUCKETS for i in range(len(w) - n + 1)]
    return np.array(out, np.int64)


def speaks(token: str) -> bool:
    """Whether a token counts for a language: no digit, no address, handle or markup in it."""
    return not any(c.isdigit() or c in "@/_[]\\#" for c in token) and _LETTERS.search(token) is not None


class LanguageModel:
    """Averaged hashed subword embeddings with a linear softmax, trained by stochastic gradient descent."""

    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.embed = rng.normal(0, 0.05, (BUCKETS, WIDTH)).astype(np.float32)
        self.out = np.zeros((WIDTH, len(LANGUAGES)), np.float32)
        self.out[: len(LANGUAGES)] = np.eye(len(LANGUAGES), dtype=np.float32)[:WIDTH]
        self.heat, self.least = 0.5, 0.5

    def fit(self, texts: list[str], labels: list[int], rounds: int = 5, rate: float = 30.0, batch: int = 64, seed: int = 9) -> "LanguageModel":
        """Each step sees a window of 3 to 15 words of each text. After three rounds, texts the model contradicts are set
        aside: their labels are taken to be wrong. A tenth of the texts is held out to calibrate the rejection."""
        rng = np.random.default_rng(seed)
        cache: dict[str, np.ndarray] = {}
        docs = []
        for t in texts:
            words = [fold(w) for w in t.lower().split() if speaks(w)]
            docs.append([cache[w] if w in cache else cache.setdefault(w, subwords(w)) for w in words if w])
        y = np.array(labels, np.int64)
        usable = np.array([i for i, d in enumerate(docs) if len(d) >= 3], np.int64)
        rng.shuffle(usable)
        held, train = usable[: len(usable) // 10], usable[len(usable) // 10 :]
        for r in range(rounds):
            if r == 3:
                guess = self._scores([np.concatenate(docs[i]) for i in train])
                train = train[guess.argmax(1) == y[train]]
            step = rate * (1 - r / rounds)
            # every language as often as the most frequent one, and enough steps where rows are few
            kinds = [train[y[train] == k] for k in np.unique(y[train])]
            each = max(max((len(k) for k in kinds), default=0), 1000)
            turn = np.concatenate([rng.permutation(np.resize(rng.permutation(k), each)) for k in kinds]) if kinds else train
            rng.shuffle(turn)
            for s in range(0, len(turn), batch):
                rows = turn[s : s + batch]
                bags = []
                for i in rows:
                    n = int(rng.integers(3, 16))
                    at = int(rng.integers(0, max(1, len(docs[i]) - n + 1)))
                    bags.append(np.concatenate(docs[i][at : at + n]))
                size = np.array([len(b) for b in bags])
                flat, owner = np.concatenate(bags), np.repeat(np.arange(len(bags)), size)
                mean = np.zeros((len(bags), WIDTH), np.float32)
                np.add.at(mean, owner, self.embed[flat])
                mean /= size[:, None]
                z = mean @ self.out
                p = np.exp(z - z.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                p[np.arange(len(rows)), y[rows]] -= 1
                p /= len(rows)
                back = (p @ self.out.T) / size[:, None]
                self.out -= 0.02 * step * (mean.T @ p)
                np.add.at(self.embed, flat, -step * back[owner])
        self._calibrate(docs, y, held)
        return self

    def _scores(self, bags: list[np.ndarray]) -> np.ndarray:
        return np.array([self.embed[b].mean(0) @ self.out for b in bags]).reshape(-1, len(LANGUAGES))

    def _votes(self, words: list[np.ndarray]) -> np.ndarray:
        """Clipped logits of each word relative to its best language, so no single word decides."""
        z = np.array([self.embed[w].mean(0) @ self.out for w in words])
        return np.maximum(z - z.max(1, keepdims=True), -CLIP)

    def confidence(self, z: np.ndarray) -> np.ndarray:
        """Probability of the best language of a stretch from the sums of its words' votes."""
        p = np.exp((z - z.max(-1, keepdims=True)) * self.heat)
        return 1 / p.sum(-1)

    def _calibrate(self, docs: list, y: np.ndarray, held: np.ndarray, precision: float = 0.99) -> None:
        """The temperature that fits held-out windows of five words best, and the confidence above which at least
        ``precision`` of them are right."""
        sums, truth = [], []
        for i in held:
            votes = self._votes(docs[i])
            whole = votes.sum(0).argmax()
            for s in range(0, len(votes) - 4, 5):
                sums.append(votes[s : s + 5].sum(0))
                truth.append(whole)
        if not sums:
            return
        z, t = np.array(sums), np.array(truth)
        z -= z.max(1, keepdims=True)

        def loss(heat: float) -> float:
            return float(np.mean(np.log(np.exp(z * heat).sum(1)) - heat * z[np.arange(len(t)), t]))

        self.heat = min((0.1, 0.2, 0.3, 0.4, 0.6, 0.8, 1.0, 1.3), key=loss)
        conf, right = self.confidence(z), z.argmax(1) == t
        order = np.argsort(-conf)
        share = np.cumsum(right[order]) / np.arange(1, len(order) + 1)
        good = np.flatnonzero(share >= precision)
        self.least = float(np.clip(conf[order][good[-1]] if len(good) else 0.9, 0.5, 0.9))

    def word(self, token: str) -> np.ndarray:
        """The logits of a word, and at the end its weight: 0 if it counts for no language."""
        w = fold(token) if speaks(token) else ""
        out = np.zeros(len(LANGUAGES) + 1, np.float32)
        if w:
            out[:-1] = self._votes([subwords(w)])[0]
            out[-1] = 1
        return out


class Segmenter:
    """Assigns each word a language by Viterbi search: words vote, changing the language costs less between sentences."""

    INSIDE, BETWEEN = 14.0, 5.0
    LOOSE = 9.0  # inside, where a text has no sentence ends

    def __init__(self, model: LanguageModel):
        self.model, self.known = model, {}
        self.rows: list[np.ndarray] = [np.zeros(len(LANGUAGES) + 1, np.float32)]

    def _index(self, token: str) -> int:
        low = token.lower()
        at = self.known.get(low)
        if at is None:
            at = len(self.rows)
            self.rows.append(self.model.word(low))
            self.known[low] = at
        return at

    def segments(self, texts: list[str]) -> list[list[tuple[int, int, int, float, int]]]:
        """For each text its stretches (first word, end, language, confidence, voting words); language -1 if rejected."""
        if len(self.known) > 400_000:
            self.known.clear()
            del self.rows[1:]
        tokens = [t.split() for t in texts]
        ids = [[self.known.get(w.lower()) or self._index(w) for w in ws] for ws in tokens]
        table = np.vstack(self.rows)
        out: list = [[] for _ in texts]
        order = sorted(range(len(texts)), key=lambda i: len(tokens[i]))
        at = 0
        while at < len(order):
            n = max(1, min(2048, 400_000 // max(1, len(tokens[order[at]]))))
            rows = [i for i in order[at : at + n] if tokens[i]]
            if rows and len(tokens[rows[-1]]) > 2 * len(tokens[rows[0]]) + 20:
                rows = [i for i in rows if len(tokens[i]) <= 2 * len(tokens[rows[0]]) + 20]
            at += max(1, len(rows) + sum(not tokens[i] for i in order[at : at + n]))
            if rows:
                self._viterbi(rows, tokens, ids, table, out)
        return out

    def _viterbi(self, rows, tokens, ids, table, out) -> None:
        size = np.array([len(ids[i]) for i in rows])
        t = int(size.max())
        grid = np.zeros((len(rows), t), np.int64)
        cost = np.full((len(rows), t), self.INSIDE, np.float32)
        for r, i in enumerate(rows):
            grid[r, : size[r]] = ids[i]
            ends = [k + 1 for k, w in enumerate(tokens[i][:-1]) if _END.search(w)]
            if len(ends) * 25 < size[r] - 12:
                cost[r] = self.LOOSE
            cost[r, ends] = self.BETWEEN
        emit = table[grid]
        votes = emit[:, :, -1]
        emit = emit[:, :, :-1]
        best = emit[:, 0].copy()
        stay = np.zeros((t, len(rows), len(LANGUAGES)), bool)
        top = np.zeros((t, len(rows)), np.int8)
        for k in range(1, t):
            lead = best.argmax(1)
            switch = best[np.arange(len(rows)), lead][:, None] - cost[:, k][:, None]
            stay[k] = best >= switch
            top[k] = lead
            best = np.where(stay[k], best, switch) + emit[:, k]
        path = np.zeros((len(rows), t), np.int8)
        now = best.argmax(1)
        for k in range(t - 1, -1, -1):
            path[:, k] = now
            now = np.where(stay[k][np.arange(len(rows)), now], now, top[k]) if k else now
        changed = (path != path[:, :1]).any(1)
        total = np.cumsum(emit, 1)
        count = np.cumsum(votes, 1)
        for r, i in enumerate(rows):
            cuts = [0, *(np.flatnonzero(np.diff(path[r, : size[r]])) + 1).tolist(), int(size[r])] if changed[r] else [0, int(size[r])]
            for a, b in zip(cuts, cuts[1:]):
                z = total[r, b - 1] - (total[r, a - 1] if a else 0)
                n = float(count[r, b - 1] - (count[r, a - 1] if a else 0))
                conf = float(self.model.confidence(z))
                lang = int(path[r, a]) if n and conf >= self.model.least else -1
                out[i].append((a, b, lang, conf, int(n)))


def _share(most: int, n: int) -> int:
    """Below which of 2^63 hash values a row is drawn, so that ``most`` of ``n`` are; never none."""
    return min((1 << 63) - 1, max(1, int(min(1.0, most / n) * (1 << 63))))


def labelled_sample(rows: DataFrame, text: str, locale: str, most: int = TRAIN_ROWS, key: str | None = None) -> tuple[list[str], list[int]]:
    """About ``most`` texts, or all, of each language by their locale, chosen by a 63-bit hash of ``key`` and text; some labels will be wrong.

    Only counts are shuffled, one for each language. Never more than twice ``most`` texts of all languages together are collected, also
    where one text is repeated without end.
    """
    lang = locale_language(F.col(locale))
    some = rows.select(F.col(text).alias("t"), lang.alias("l"), F.col(key or text).alias("k")).where(F.col("l").isin(*LANGUAGES) & F.col("t").isNotNull() & (F.length("t") >= 40))
    counts = {r["l"]: r["count"] for r in some.groupBy("l").count().collect()}
    cut = F.lit(0)
    for name, n in counts.items():
        cut = F.when(F.col("l") == name, _share(most, n)).otherwise(cut)
    drawn = some.where(F.shiftrightunsigned(F.xxhash64("k", "t", F.lit(3)), 1) < cut)
    got = drawn.select("l", "t").limit(2 * most * len(LANGUAGES)).toPandas().sort_values(["l", "t"], ignore_index=True)
    return got["t"].tolist(), [LANGUAGES.index(x) for x in got["l"]]


def language_segments(rows: DataFrame, key: str, text: str, locale: str, least_votes: int = 4, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """(key, locale_lang, n_words, start, end, lang, confidence, votes): the stretches of one language of every text.

    Averaged hashed subword embeddings with a linear softmax, trained in numpy by stochastic gradient descent on at most ``train_rows``
    rows of each language that their locale names (wrong labels are set aside on the way), score every word; a Viterbi
    search over the whole text finds the stretches. A stretch whose confidence lies below the calibrated bound, or
    of fewer than ``least_votes`` voting words beside a longer one, gets the language null. Words count from 0, split at white
    space. Rows with a null key, null or blank text give no row; without a labelled row every language is null.
    """
    schema = "key long, locale_lang string, n_words int, start int, end int, lang string, confidence double, votes int"

    def rows_of(k, loc, stretches):
        return [(k, loc, stretches[-1][1], a, b, LANGUAGES[g] if g >= 0 else None, round(c, 4), v) for a, b, g, c, v in stretches]

    return _scan(rows, key, text, locale, least_votes, train_rows, rows_of, schema)


def _scan(rows: DataFrame, key: str, text: str, locale: str, least_votes: int, train_rows: int, rows_of, schema: str) -> DataFrame:
    """``rows_of(key, locale's language, stretches)`` of every text that has words."""
    texts, labels = labelled_sample(rows, text, locale, train_rows, key)
    model = LanguageModel().fit(texts, labels) if texts else None
    shared = rows.sparkSession.sparkContext.broadcast(model)
    src = rows.select(F.col(key).alias("key"), locale_language(F.col(locale)).alias("locale_lang"), F.col(text).alias("t")).where("key is not null and t is not null")
    names = [f.split()[0] for f in schema.split(", ")]

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        segmenter = Segmenter(shared.value) if shared.value is not None else None
        for frame in frames:
            got = []
            texts = frame["t"].tolist()
            found = segmenter.segments(texts) if segmenter else [[(0, len(t.split()), -1, 0.0, 0)] if t.split() else [] for t in texts]
            for k, loc, stretches in zip(frame["key"], frame["locale_lang"], found):
                if len(stretches) > 1:
                    most = max(s[4] for s in stretches)
                    stretches = [s if s[4] >= least_votes or s[4] == most else (*s[:2], -1, *s[3:]) for s in stretches]
                if stretches:
                    got += rows_of(k, loc, stretches)
            yield pd.DataFrame(got, columns=names)

    return src.mapInPandas(scan, schema)


def wrong_labels(rows: DataFrame, key: str = "seq", text: str = "body", locale: str = "locale", least_words: int = 8) -> DataFrame:
    """(seq, lang): the languages of the texts with a missing or wrong locale or of several languages.

    Only texts of at least ``least_words`` words. One row for each language of the text. See ``language_segments``.
    """

    def rows_of(k, loc, stretches):
        langs = {LANGUAGES[s[2]] for s in stretches if s[2] >= 0}
        wrong = stretches[-1][1] >= least_words and (loc is None or len(langs) > 1 or loc not in langs)
        return [(k, x) for x in sorted(langs)] if wrong else []

    found = _scan(rows, key, text, locale, 4, TRAIN_ROWS, rows_of, "key long, lang string")
    return found.withColumnRenamed("key", key)
