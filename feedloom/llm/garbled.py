"""Problem 9: text decoded with the wrong character encoding."""

from __future__ import annotations

import math
import re
import unicodedata
import uuid
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The encodings in which UTF-8 bytes are commonly misread.
CODECS = ("cp1252", "latin-1", "mac_roman", "cp437", "cp850", "cp1251", "koi8_r", "cp1250", "iso8859_15")
VOCABULARY = 100_000  # pieces of clean text in the model: the most frequent ones
BEAM = 50  # open words kept at each place of the search for lost bytes
RARE = 5e-6  # share of all pieces below which a word counts as unknown
LOST = "\ufffd"
_CONTROL = re.compile("[\x80-\x9f]")
_PIECE = regex.compile(r"[\p{L}\p{M}\p{N}]+|[^\p{L}\p{M}\p{N}\x00-\x7F]")
_SIGN = regex.compile(r"[^\p{L}\p{M}\p{N}\x00-\x7F]")
_SPACES = re.compile(r"([ \t\r\n]+)")


def misread(byte: int, codec: str) -> str:
    """The character as which ``codec`` reads a byte; bytes it leaves undefined come out as C1 controls."""
    try:
        return bytes([byte]).decode(codec)
    except UnicodeDecodeError:
        return chr(byte)


def garble(text: str, codec: str) -> str:
    return "".join(misread(b, codec) for b in text.encode())


def _class(codec: str, values) -> str:
    return "[" + "".join(re.escape(misread(b, codec)) for b in values) + "]"


@lru_cache(maxsize=1)
def suspicious() -> re.Pattern:
    """What clean text hardly holds: C1 controls, replacement characters, and complete UTF-8 sequences as one of the
    encodings misreads them."""
    parts = [f"[\x80-\x9f{LOST}]"]
    for codec in CODECS:
        tail = _class(codec, (b for b in range(0x80, 0xC0) if misread(b, codec) not in "ёЁ"))
        # two-byte leads of Latin, Greek, Cyrillic and Arabic letters
        lead = _class(codec, [*range(0xC2, 0xC6), *range(0xCE, 0xD2), 0xD8, 0xD9])
        parts += [lead + tail, _class(codec, range(0xE0, 0xF0)) + tail + "{2}", _class(codec, range(0xF0, 0xF5)) + tail + "{3}"]
    return re.compile("|".join(parts))


@lru_cache(maxsize=1)
def _sequences() -> dict[str, tuple[re.Pattern, dict[int, int]]]:
    """For each encoding what a complete UTF-8 sequence looks like in it, and its characters' bytes, for ``translate``."""
    out = {}
    for codec in CODECS:
        tail = _class(codec, range(0x80, 0xC0))
        shape = f"{_class(codec, range(0xC2, 0xE0))}{tail}|{_class(codec, range(0xE0, 0xF0))}{tail}{{2}}|{_class(codec, range(0xF0, 0xF5))}{tail}{{3}}"
        out[codec] = re.compile(shape), {ord(misread(b, codec)): b for b in range(0x80, 0x100)}
    return out


@lru_cache(maxsize=1 << 16)
def _kind(char: str) -> str:
    """What stands beside a symbol: digit, Latin letter (a), other letter or mark (b), space or other."""
    category = unicodedata.category(char)
    if category[0] in "LMN" and category != "Nd":
        return "a" if char < "\u0250" or "LATIN" in unicodedata.name(char, "") else "b"
    return "d" if category == "Nd" else "s" if char.isspace() else "o"


@lru_cache(maxsize=1 << 16)
def _script(char: str) -> str:
    """The first word of the name of a letter or mark, which names its script; signs have none. Kana and Han count as one."""
    if unicodedata.category(char)[0] not in "LM":
        return ""
    word = unicodedata.name(char, "?").split()[0].split("-")[0]
    return "CJK" if word in ("HIRAGANA", "KATAKANA", "CJK") else word


class Restorer:
    """Noisy-channel decoder of garbled text under the frequencies of the words and symbols of clean text.

    Spans whose bytes are all there are encoded back first, as a whole and in one encoding, whatever characters they stand for. What stays
    damaged goes through a lattice of misread byte sequences, with wildcards for lost bytes, searched by Viterbi: each character seen in
    clean text has its garbled forms, read in each encoding, twice in the same, with the C1 controls dropped, and as lost
    bytes. A path through a token takes each character either as it stands or as part of such a form; the best path is the most
    probable original, by the words and symbols it yields and a fixed cost for each damaged character.

    ``pieces`` counts words and symbols of clean text, symbols also by the kind of their neighbours.
    """

    COST, WILD, UNKNOWN = 3.0, 4.0, 2.5
    COMPLETE = 4.0  # gain for each complete sequence that is explained
    SWITCH = 8.0  # for reading a token, or a whole text, in another single-byte encoding

    def __init__(self, pieces: dict[str, int], beam: int = BEAM):
        total = sum(pieces.values()) + 1
        self.beam = beam
        self.log = {p: math.log(n / total) for p, n in pieces.items()}
        self.floor = -math.log(total) - 1.5
        self.rare = math.log(max(RARE, 1.5 / total))
        self.words = sorted(p for p in pieces if p[0] != "\0")
        self.letters: dict[str, int] = {}
        self.pairs: set[str] = set()  # neighbouring letters, not both ASCII, of known words
        for p, n in pieces.items():
            if p[0] != "\0" and not p.isascii():
                for c in p:
                    if not c.isascii():
                        self.letters[c] = self.letters.get(c, 0) + n
                        if len(c.upper()) == 1 and c.upper() != c:
                            self.letters[c.upper()] = self.letters.get(c.upper(), 0) + max(1, n // 20)
                if self.log[p] >= self.rare:
                    self.pairs.update(a + b for a, b in zip(p, p[1:]) if not (a.isascii() and b.isascii()))
        self.forms: dict[str, list[tuple[str, float]]] = {}
        seen = set()
        for c in sorted(self.letters, key=lambda c: (-self.letters[c], c)):
            if _CONTROL.match(c) or c == LOST:
                continue
            whole: dict[str, float] = {}
            for codec in CODECS:
                once = garble(c, codec)
                twice = garble(once, codec)
                for form, cost in ((once, self.COST), (twice, self.COST + 1)):
                    bare = _CONTROL.sub("", form)
                    whole.setdefault(form, cost)
                    whole.setdefault(bare, self.WILD if form != bare else cost)
                    whole.setdefault(form.rstrip("\xa0"), self.WILD)  # a no-break space may have become an ordinary one
                    whole.setdefault(_CONTROL.sub(LOST, form), self.WILD)
            for n in range(1, len(c.encode()) + 1):
                whole.setdefault(LOST * n, self.WILD)
            for form, cost in whole.items():
                if form and form != c and not form.isascii() and (form, c) not in seen:
                    seen.add((form, c))
                    self.forms.setdefault(form, []).append((c, cost))
        self.by_first: dict[str, list[str]] = {}
        for form in self.forms:
            self.by_first.setdefault(form[0], []).append(form)
        for f in self.by_first.values():
            f.sort(key=len, reverse=True)
        self.cache: dict[str, list[tuple[float, str, int, str]]] = {}
        self.lattice: dict[str, tuple[str, int]] = {}
        self.fine: dict[str, bool] = {}
        self.calm: set[str] = set()
        self.scores: dict[str, float] = {}
        self.others: dict[str, dict[tuple[str, str], tuple[str, float, bool]]] = {}

    def _words_score(self, token: str) -> tuple[float, bool]:
        """(score, whether all are known) of the words and non-ASCII characters of a token."""
        score, known = 0.0, True
        for w in _PIECE.findall(token):
            known &= w.lower() in self.log
            score += self._word(w)
        return score, known

    def _swapped(self, token: str) -> dict[tuple[str, str], tuple[str, float, bool]]:
        """For each pair (encoding read in, true encoding): the token's reading, what it gains in score, whether its words are all known."""
        got = self.others.get(token)
        if got is None:
            got, now, scores = {}, self._words_score(token)[0], {}
            for read in CODECS:
                try:
                    raw = token.encode(read)
                except UnicodeEncodeError:
                    continue
                for true in CODECS:
                    try:
                        text = raw.decode(true)
                    except UnicodeDecodeError:
                        continue
                    if text != token and not _CONTROL.search(text):
                        if text not in scores:
                            scores[text] = self._words_score(text)
                        score, known = scores[text]
                        got[read, true] = text, score - now, known
            if len(self.others) > 50_000:
                self.others.clear()
            self.others[token] = got
        return got

    def _fine(self, token: str) -> bool:
        """Whether a token holds no rare word of other than ASCII letters."""
        got = self.fine.get(token)
        if got is None:
            got = all(w.isascii() or self.log.get(w.lower(), self.floor) >= self.rare for w in _PIECE.findall(token))
            if len(self.fine) > 500_000:
                self.fine.clear()
            self.fine[token] = got
        return got

    def reread(self, tokens: list[str]) -> list[str]:
        """The tokens after reading single-byte text that was decoded in another single-byte encoding.

        All non-ASCII tokens are read in one pair of encodings if that gains enough over the whole text and the words of 0.7 of them become known; else a
        token of unknown words is, if it gains as much and all its words become known.
        """
        odd = [i for i, t in enumerate(tokens) if not t.isascii() and LOST not in t and not self._fine(t)]
        if not odd:
            return tokens
        at = [i for i, t in enumerate(tokens) if t and not t.isascii() and LOST not in t]
        pairs = {p for i in odd for p in self._swapped(tokens[i])}
        gain = dict.fromkeys(pairs, 0.0) if len(at) > 2 else {}
        for i, n in Counter(tokens[i] for i in at).items() if gain else ():
            got = self._swapped(i)
            for p in pairs:
                gain[p] += n * (got[p][1] if p in got else -self.SWITCH)
        best = max(gain, key=lambda p: (gain[p], p), default=None)
        out = list(tokens)
        whole = best is not None and gain[best] > self.SWITCH * 2 and sum(self._swapped(tokens[i]).get(best, ("", 0, False))[2] for i in at) >= 0.7 * len(at)
        for i in at if whole else odd:
            if whole:
                found = self._swapped(tokens[i]).get(best)
            else:
                fit = [x for x in self._swapped(tokens[i]).values() if x[2] and x[1] > self.SWITCH and self._odd(tokens[i], x[0])] if not self._words_score(tokens[i])[1] else []
                found = max(fit, key=lambda x: (x[1], x[0]), default=None)
            if found:
                out[i] = found[0]
        return out

    @staticmethod
    def _odd(token: str, read: str) -> bool:
        """Whether a token alone gives reason to read it otherwise: two characters or more change, or one that is no letter inside a word."""
        changed = [i for i, (a, b) in enumerate(zip(token, read)) if a != b]
        return len(changed) > 1 or any(_kind(token[i]) not in "ab" and _kind(read[i]) in "ab" for i in changed)

    def _word(self, w: str) -> float:
        got = self.scores.get(w)
        if got is None:
            low = w.lower()
            got = self.log[low] if low in self.log else self.floor - self.UNKNOWN * sum(not c.isascii() for c in w) if w else 0.0
            if len(self.scores) > 500_000:
                self.scores.clear()
            self.scores[w] = got
        return got

    def _unseen(self, s: str, at: int) -> bool:
        """Whether the characters at a place and after it never stand side by side in clean text."""
        a, b = s[at], s[at + 1]
        if "\x80" <= a <= "\x9f" or "\x80" <= b <= "\x9f":
            return True
        ka, kb = _kind(a), _kind(b)
        if ka in "ab" and kb in "ab":
            return (a + b).lower() not in self.pairs
        for word in (regex.search(r"[\p{L}\p{M}\p{N}]*\Z", s[: at + 1])[0] if not a.isascii() else "", regex.match(r"[\p{L}\p{M}\p{N}]*", s, pos=at + 1)[0] if not b.isascii() else ""):
            if word and word.lower() not in self.log:
                return True
        before = _kind(s[at - 1]) if at else "s"
        after = _kind(s[at + 2]) if at + 2 < len(s) else "s"
        return (ka in "os" and not a.isascii() and "\0" + before + a + kb not in self.log) or (kb in "os" and not b.isascii() and "\0" + ka + b + after not in self.log)

    def encoded_back(self, token: str, codec: str) -> tuple[str, int]:
        """(token, their number) after putting the character for each complete UTF-8 sequence misread in ``codec``.

        A sequence of which all neighbours are seen in clean text stays. A character that clean text lacks is put only if it is a Latin letter or
        a common sign, or if another letter of the token is of its script and no letter but ASCII ones is of another.
        """
        shape, bytes_of = _sequences()[codec]
        parts, last, put = [], 0, []
        for m in shape.finditer(token):
            if not any(self._unseen(token, at) for at in range(m.start(), m.end() - 1)):
                continue
            try:
                char = bytes(m.group().translate(bytes_of).encode("latin-1")).decode()
            except UnicodeError:
                continue
            parts += [token[last : m.start()], char]
            put.append(char)
            last = m.end()
        if not put:
            return token, 0
        text = "".join([*parts, token[last:]])
        scripts = Counter(_script(c) for c in text if not c.isascii())
        latin = any(c.isascii() and c.isalpha() for c in text)
        for c in put:
            script = _script(c)
            if c in self.letters or c.lower() in self.letters or script in ("LATIN", "COMBINING") or c < "\xc0" or "\u02b0" <= c < "\u0370" or not script and ("\u2000" <= c < "\u3040" or c >= "\U0001f000"):
                continue
            if not script or scripts[script] < 2 or (latin and script != "CJK" and scripts[script] < 4) or set(scripts) - {script, "", "COMBINING"}:
                return token, 0
        return text, len(put)

    def _value(self, text: str, put: int) -> float:
        return self._words_score(text)[0] + self.COMPLETE * put - sum(a.islower() and b.isupper() for a, b in zip(text, text[1:]))

    def options(self, token: str) -> list[tuple[float, str, int, str]]:
        """(value, text, restored characters, encoding) of the ways to encode a token back, from the best value on; the token itself among them."""
        got = self.cache.get(token)
        if got is None:
            found = {token: (self._value(token, 0), 0, "")}
            todo = [(token, 0, "", 0, 0.0)]
            while todo:
                text, put, first, depth, mixed = todo.pop()
                if depth == 3 or text.isascii() or (self._words_score(text)[1] and not _CONTROL.search(text)):
                    continue  # text may have been misread up to three times
                for codec in CODECS:
                    new, k = self.encoded_back(text, codec)
                    other = mixed + (self.COMPLETE - 1) * (bool(first) and codec != first)  # misread twice, in two encodings, is rare
                    value = self._value(new, put + k) - other
                    if k and (new not in found or value > found[new][0]):
                        found[new] = value, put + k, first or codec
                        todo.append((new, put + k, first or codec, depth + 1, other))
            got = sorted(((value, text, k, codec) for text, (value, k, codec) in found.items()), key=lambda x: (-x[0], x[1]))[:6]
            if len(self.cache) > 200_000:
                self.cache.clear()
            self.cache[token] = got
        return got

    def restore(self, token: str, votes: Counter | None = None) -> tuple[str, int]:
        """(original, number of damaged characters) of a token without spaces; of nearly equal options the one in the encoding with most ``votes``."""
        found = self.options(token)
        value, now, n, codec = found[0]
        if votes and len(found) > 1:
            value, now, n, codec = max((x for x in found if x[0] >= value - 2), key=lambda x: (votes[x[3]] if x[3] else 0, x[0]))
        if n and not self.suspect(now):
            return now, n
        got, k = self._searched(now)
        if n and not self._words_score(got)[1]:  # with bytes lost, what seemed whole may not have been
            other, m = self._searched(token)
            if m and self._words_score(other)[0] > self._words_score(got)[0]:
                return other, m
        return got, k + n

    def _searched(self, token: str) -> tuple[str, int]:
        got = self.lattice.get(token)
        if got is None:
            # of a token whose letters are all lost nothing can be known
            blank = LOST in token and not any(c.isalnum() for c in token)
            got = self._viterbi(token) if not blank and self.suspect(token) else (token, 0)
            if LOST in token and not self._words_score(got[0])[1]:
                got = token, 0  # nothing known comes out: the lost characters stay lost
            if len(self.lattice) > 200_000:
                self.lattice.clear()
            self.lattice[token] = got
        return got

    def suspect(self, token: str) -> bool:
        """Whether something of a token may be what a damaged character has become: lost bytes, controls, or a form that is no part of clean text."""
        if LOST in token or _CONTROL.search(token):
            return True
        if all(w.lower() in self.log for w in _PIECE.findall(token)) and not any(self._unseen(token, at) for at in range(len(token) - 1) if not token[at : at + 2].isascii()):
            return any(len(w) == 1 and not w.isascii() and w in self.forms for w in _PIECE.findall(token))
        return any(c in self.by_first for c in token if not c.isascii())

    def _hope(self, w: str) -> float:
        """Guides the beam: a prefix that no known word has will cost about as much as an unknown word."""
        if not w or w[0] == "\0":
            return -7.0 if w else 0.0
        low = w.lower()
        at = bisect_left(self.words, low)
        return -7.0 if at < len(self.words) and self.words[at].startswith(low) else self.floor - 1

    def _close(self, word: str, after: str) -> float:
        """Log probability of the word or, after a NUL, the symbol that ends before ``after``."""
        if word.startswith("\0"):
            found = self.log.get(word + after)
            return found if found is not None else min(self.log.get(word[2:], self.floor - self.UNKNOWN) - 3, self.floor)
        return self._word(word)

    def _viterbi(self, s: str) -> tuple[str, int]:
        beams: list[dict[str, tuple[float, str, int]]] = [{} for _ in range(len(s) + 1)]
        beams[0][""] = (0.0, "", 0)

        def step(to: int, word: str, score: float, text: str, n: int, char: str) -> None:
            kind = _kind(char)
            if kind in "abd" and not word.startswith("\0"):
                word += char
            else:
                score += self._close(word, kind)
                word = char if kind in "abd" else "\0" + (_kind(text[-1]) if text else "s") + char if not char.isascii() else ""
            old = beams[to].get(word)
            if old is None or score > old[0]:
                beams[to][word] = (score, text + char, n)

        for at in range(len(s)):
            states = beams[at].items()
            if len(states) > self.beam:
                states = sorted(states, key=lambda x: -(x[1][0] + self._hope(x[0])))[: self.beam]
            forms = [f for f in self.by_first.get(s[at], ()) if s.startswith(f, at)]
            for word, (score, text, n) in states:
                step(at + 1, word, score, text, n, s[at])
                for form in forms:
                    for char, cost in self.forms[form]:
                        step(at + len(form), word, score - cost, text, n + 1, char)
            beams[at] = {}
        best = max(((score + self._close(w, "s"), text, n) for w, (score, text, n) in beams[len(s)].items()), key=lambda x: (x[0], -x[2], x[1]))
        return best[1], best[2]

    def garbled_still(self, token: str) -> int:
        """Replacement characters, C1 controls and sequences in an unknown word that a misread character may have left."""
        if token.isascii():
            return 0
        n = sum(c == LOST or "\x80" <= c <= "\x9f" for c in token)
        if n or self._words_score(token)[1]:
            return n
        return max(self.encoded_back(token, codec)[1] for codec in CODECS)

    def plainly_fine(self, text: str) -> bool:
        """Whether nothing in a text can be changed, told by its tokens, each looked at once."""
        if text.isascii():
            return True
        fresh = set(_tokens(text)) - self.calm
        odd = {z for z in fresh if not z.isascii() and (self.suspect(z) or not self._fine(z) or len(self.options(z)) > 1)}
        self.calm |= fresh - odd
        if len(self.calm) > 1_000_000:
            self.calm.clear()
        return not odd

    def restore_text(self, text: str) -> tuple[str, int, int]:
        """(text with restored spans, restored characters, characters that stay lost)."""
        if self.plainly_fine(text):
            return text, 0, 0
        out, n, lost = [], 0, 0
        tokens = _SPACES.split(text)
        votes: Counter = Counter()
        for token in tokens:
            if not token.isascii() and len(found := self.options(token)) > 1:
                votes.update({codec: n for value, _, n, codec in found if codec and value >= found[0][0] - 0.5})
        for token, other in zip(tokens, self.reread(tokens)):
            if token.isascii():
                out.append(token)
                continue
            got, k = self.restore(token, votes)
            if other != token and (not k or self._words_score(other)[0] >= self._words_score(got)[0]):
                got, k = other, sum(a != b for a, b in zip(token, other))
            out.append(got)
            n += k
            lost += self.garbled_still(got) if k or got == token and (LOST in got or _CONTROL.search(got)) else 0
        return "".join(out), n, lost


_MODELS: dict[str, Restorer] = {}  # of this Python worker, which runs many tasks, so that a token is looked at once


def _tokens(text: str) -> list[str]:
    """The tokens between ordinary spaces, tabs and line ends, some of them empty."""
    return text.replace("\n", " ").replace("\r", " ").replace("\t", " ").split(" ")


def _pieces_of(token: str) -> list[str]:
    """Words and symbols of a token in lower case, and each symbol with the kinds of its neighbours: NUL, kind, symbol, kind."""
    low = token.lower()
    found = _PIECE.findall(low)
    if not low.isascii():
        for m in _SIGN.finditer(low):
            at = m.start()
            found.append("\0" + (_kind(low[at - 1]) if at else "s") + low[at] + (_kind(low[at + 1]) if at + 1 < len(low) else "s"))
    return found


def clean_pieces(documents: DataFrame) -> dict[str, int]:
    """Frequencies of words and non-ASCII characters over all documents without suspicious sequences.

    Counted in one pass with partial sums; what is collected is the most frequent ``VOCABULARY`` pieces, a fixed
    bound on a model, not on the documents.
    """

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: Counter = Counter()  # of tokens, which are cut into pieces once each
        look, seen, bad = suspicious(), set(), set()

        def counted() -> pd.DataFrame:
            pieces: Counter = Counter()
            for token, n in total.items():
                for piece in _pieces_of(token):
                    pieces[piece] += n
            total.clear()
            return pd.DataFrame({"p": list(pieces), "n": list(pieces.values())}, columns=["p", "n"]).astype({"p": "object", "n": "int64"})

        for frame in frames:
            for t in frame["text"]:
                tokens = _tokens(t)
                if not t.isascii():
                    fresh = set(tokens) - seen
                    bad.update(z for z in fresh if not z.isascii() and look.search(z))
                    seen |= fresh
                    if not bad.isdisjoint(tokens):
                        continue
                total.update(tokens)
            if len(seen) > 1_000_000:
                seen, bad = set(), set()
            if len(total) > 500_000:
                yield counted()
        yield counted()

    counted = documents.select("text").where("text is not null").mapInPandas(count, "p string, n long").groupBy("p").agg(F.sum("n").alias("n"))
    top = counted.orderBy(F.desc("n"), "p").limit(VOCABULARY).toPandas()
    return dict(zip(top["p"], top["n"].astype(int)))


def garbled_documents(documents: DataFrame) -> DataFrame:
    """(doc_id, restored, n_restored, n_lost): the documents whose text holds a sequence left by wrong decoding.

    ``restored`` is the text with every damaged span replaced by its most probable original; ``n_lost`` counts replacement
    characters and C1 controls for which none was found. A document is listed when the most probable reading of any of its
    tokens holds damage, or when such a character is there. Whole texts are read; documents are only
    scanned. Null texts and ids give no row; an empty table gives none.
    """
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null and text is not null")
    pieces = documents.sparkSession.sparkContext.broadcast(clean_pieces(docs))

    model_key = uuid.uuid4().hex

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if model_key not in _MODELS:
            _MODELS.clear()
            _MODELS[model_key] = Restorer(pieces.value)
        model = _MODELS[model_key]
        for frame in frames:
            rows = []
            for i, t in zip(frame["doc_id"], frame["text"]):
                got, n, lost = model.restore_text(t)
                if n or lost:
                    rows.append((i, got, n, lost))
            yield pd.DataFrame(rows, columns=["doc_id", "restored", "n_restored", "n_lost"]).astype({"doc_id": "int64", "n_restored": "int64", "n_lost": "int64"})

    some = docs.where(F.col("text").rlike(r"[^\x00-\x7F]"))
    return some.mapInPandas(scan, "doc_id long, restored string, n_restored long, n_lost long")

