"""Problem 2: personal data inside free text."""

from __future__ import annotations

import re
import sys
import unicodedata
import zlib
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import discard, materialize
from .boosting import Boosted
from .lookalikes import LIGATURES, tables

KINDS = ("email", "phone", "id_number", "address", "name")
PLACEHOLDER = {k: f"[{k}]" for k in KINDS}
COMMON = 0.001  # share of the texts from which on a word counts as a common one
TOGETHER = 22  # place, among the features of a name, of whether its words are found together elsewhere
PART = 23  # place, among the features of a name, of what the word before it is
RARE = 3  # times, in so many texts as weigh as one, up to which a name is hardly ever said
_DIGIT = re.compile(r"\d")
SCALE_ROWS = 8_000  # texts that weigh as one in training; with more rows, what all of them hold counts by that much less, and rare means that many times more often
MADE_UP = 12_000  # lines made up for training
FLUSH = 200_000  # different keys a task counts before it hands them on
KEPT = 20_000  # contexts and features of which what was found is kept, as the same ones come again and again

_PLAIN = re.compile("[\x00-\x7f¡-¬®-ɏऀ-॥॰-ॿ–-„…€₹★\U0001f300-\U0001faff]*\\Z")


@lru_cache(maxsize=1)
def _table() -> dict[int, str | None]:
    """Character by character: look-alikes, widths, spaces, invisible characters, digits of any script."""
    old, new, gone = tables()
    table: dict[int, str | None] = {ord(a): b for a, b in zip(old, new)} | {ord(g): None for g in gone} | {ord(a): b for a, b in LIGATURES.items()}
    for point in range(0x80, sys.maxunicode + 1):
        if unicodedata.category(chr(point)) == "Nd":
            table[point] = str(unicodedata.decimal(chr(point)))
    return table


def plain(text: str) -> str:
    return text if _PLAIN.match(text) else text.translate(_table())


def lower(text: str) -> str:
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def _words(low: str) -> list[str]:
    """The words of a text in lower case, in their order."""
    return (_ASCII_WORD if low.isascii() else _WORD).findall(low)


def _spellings(word: str) -> list[str]:
    """A lower-case word in plain characters as it comes out when written so, with a capital, or in capitals: look-alikes differ by case."""
    capital = lambda c: c if c.isascii() else lower(plain(c.upper()))
    first = next((i for i, c in enumerate(word) if not c.isascii()), len(word))
    return list(dict.fromkeys([plain(word), plain(word[:first]) + "".join(map(capital, word[first : first + 1])) + plain(word[first + 1 :]), "".join(map(capital, word))]))


def _cue(*words: str) -> re.Pattern:
    return re.compile("|".join(x for w in words for x in _spellings(w)))


def _any(text: str) -> frozenset[str]:
    return frozenset(x for w in text.split() for x in _spellings(w))


# What comes before a name, by its part in the sentence, and what often follows one. They are features only: names are
# proposed wherever two words may be one.
_CLOSING = _any("regards wishes cheers sincerely yours truly thanks greetings respectfully love signed gruß grüße grüßen hochachtungsvoll cordialement salutations amicalement merci saludos atentamente cordialmente gracias abrazo abrazos abraço abraços abracos atenciosamente cumprimentos obrigado obrigada уважением пожеланиями доброго спасибо सादर धन्यवाद शुभकामनाएं")
_ROLE = _any("agent manager executive rep representative officer advisor adviser employee colleague friend neighbour neighbor boss supervisor teacher doctor chef driver clerk assistant consultant operator lady cousin brother sister uncle aunt wife husband accountant lawyer mitarbeiter mitarbeiterin berater beraterin kollege kollegin freund freundin chefin conseiller conseillère collègue ami amie directeur directrice agente asesor asesora gerente amigo amiga compañero compañera atendente colega funcionário consultor сотрудник сотрудница менеджер оператор коллега друг подруга консультант एजेंट मैनेजर दोस्त प्रबंधक")
_INTRO = _any("is am i'm name named called nom nombre nome heiße heisse m'appelle appelle llamo chamo зовут имя नाम")
_TOWARDS = _any("you with to by from ask asked met kudos dear hi hello told contacted reached mit von an bei avec par à con por com para с от к से को")
_FOLLOWS = _any("was is were has had did does never told said promised closed wrote answered called hung from at who and again ist war hat est était a es fue era foi не был была है ने था थी the my your our")
# Words of names of places, firms, things and times, which are written like names of people.
_THINGS = _any("new san saint santa bad los las el la der die das the north south east west upper lower great old big monday tuesday wednesday thursday friday saturday sunday january february march april may june july august september october november december montag dienstag mittwoch donnerstag freitag samstag sonntag lundi mardi mercredi jeudi vendredi samedi dimanche lunes martes miércoles jueves viernes sábado domingo bank app apps pay money support team wallet invest pro plus lite note tab max mini card plan fund funds store service services customer care update version android galaxy phone pixel iphone ipad google play apple windows mode dark light black white red blue morning evening night app's inc ltd gmbh group market markets capital finance insurance fondo fonds banco banque konto")
_TITLE = r"(?:mr|mrs|ms|miss|dr|prof|herr|frau|mme|sra?)"
_TITLED = re.compile(rf"(?<![\w'’-])(?P<title>{_TITLE})\b\.?\s+(?P<name>[^\W\d_][\w'’-]+)")
_WORD = re.compile(r"[^\W\d_][\w'’-]+")
_ASCII_WORD = re.compile(r"[a-z][a-z0-9_'-]+")  # the same in lower-case ASCII, several times faster
_SPLIT_WORDS = re.compile(rf"({_WORD.pattern})")
# Any two neighbouring words, with or without a comma, or a letter with a point and a word; overlapping.
_PART = r"[^\W\d_](?:[^\W\d_]|['’-])+(?![\ẁ-ͯ])"
_PAIR = re.compile(rf"(?<![\w'’.-])(?=(?:(?P<ini>[^\W\d_])\.\s*(?P<fam2>{_PART})|(?P<fam>{_PART}),\s*(?P<giv>{_PART})|(?P<giv3>{_PART})\s+(?P<fam3>{_PART})))")
_LAST_WORD, _NEXT_WORD = re.compile(r"([^\W\d_][\w'’-]*+)[^\w.!?]*+\Z"), re.compile(r"[^\w.!?\n]*([^\W\d_][\w'’-]*)")
# A capital and, not consumed, what makes it the first of two words written as names; begun by a set so that the engine can skip to it.
_CAPPED = re.compile(r"[A-ZÀ-ÖØ-ÞА-ЯЁ](?<![\w'’.-][A-ZÀ-ÖØ-ÞА-ЯЁ])(?=(?:\.\s*|[\w'’-]++,?\s++)[A-ZÀ-ÖØ-ÞА-ЯЁ][\w'’-]*[^\W\d_A-ZÀ-ÖØ-ÞА-ЯЁ](?![\w'’-]))")
_ASCII_CAPPED = re.compile(r"[A-Z](?<![A-Za-z0-9_'.-][A-Z])(?=(?:\.\s*|[A-Za-z0-9_'-]++,?\s++)[A-Z][A-Za-z0-9_'-]*[a-z](?![A-Za-z0-9_'-]))")
# Words beside which numbers and addresses of a kind stand, and numbers that are no items.
_PHONE = _cue(r"\bcall", r"\bphon", r"\bmobile\b", r"\bcell\b", r"\blandline\b", r"\bdial", r"my number", r"\breach", r"\btext\b", r"\bring\b", r"whats?app", r"\btel\b", r"\bfax\b", r"t[eé]l[eé]f", r"telefon", r"\bhandy\b", r"erreichbar", r"rückruf", r"appele", r"joignable", r"portable", r"\bligue", r"\bllám", r"llame", r"\bmóvil", r"celular", r"\bruf", r"звон", r"телефон", r"мобильн", r"फ़ोन", r"फोन", r"मोबाइल")
_ID = _cue(r"\bpan\b", r"aad?haa?r", r"\bssn\b", r"passp", r"\biban\b", r"\baccount\b", r"\bcard\b", r"ausweis", r"reisepass", r"steuer", r"konto", r"identi", r"\bid\b", r"documento", r"документ", r"паспорт", r"\bинн\b", r"снилс", r"карт[аыу]", r"сч[её]т", r"पहचान", r"आधार", r"पैन", r"खाता", r"pi[eè]ce", r"carte", r"compte", r"social", r"\btax\b", r"licen[cs]e", r"\bcpf\b", r"\bcnpj\b", r"\brg\b", r"\bdni\b", r"\bnie\b", r"cuenta", r"conta\b", r"tarjeta", r"cartão", r"pasaporte", r"passaporte")
_ADDRESS = _cue(r"\blive", r"\bliving\b", r"\bmoved\b", r"\bship", r"deliver", r"courier", r"parcel", r"letter", r"\bflat\b", r"\bhome\b", r"\boffice\b", r"wohn", r"liefer", r"adress", r"habit", r"domicil", r"\bvivo\b", r"resid", r"\bmor[oa]", r"endereço", r"dirección", r"direccion", r"живу", r"прожива", r"доставк", r"адрес", r"पता", r"रहत", r"addres")
_TICKET = _cue(r"ticket", r"\bcase\b", r"\border\b", r"\bref", r"complaint", r"dossier", r"\bcaso\b", r"vorgang", r"\bnr\b", r"protocolo", r"обращение", r"заказ", r"शिकायत", r"invoice", r"rechnung", r"facture", r"factura", r"fatura", r"\bbill\b", r"bestell", r"commande", r"pedido", r"#", r"№", r"n\.º", r"réf")
_CODE = _cue(r"\bcode\b", r"\botp\b", r"\bpin\b", r"código", r"कोड", r"\bкод\b")
_MONEY = _cue(r"[₹€£$₽]\s*$", r"\b(?:rs|inr|eur|usd)\.?\s*$", r"charged\s*$", r"total\s*$", r"paid\s*$")
_MONEY_AFTER = _cue(r"^\s*(?:[₹€£$₽%]|rupees|percent|euros?|руб|dollars?|inr|eur|usd)")
_DATE = _cue(r"\bon\s*$", r"between", r"since", r"version", r"build", r"rated", r"released?", r"until", r"dated?", r"\bam\s*$", r"\ble\s*$")
_AMOUNT = re.compile(r"\d{1,3}(?:,\d{2,3})+(?:\.\d{1,2})?|\d{1,3}(?:[.\s]\d{3})+,\d{2}|\d+\.\d{2}")
_SENTENCE = re.compile(r"(?:[^\W\d_]{4}|\d|\))[.!?।]\s|[|\n]")
_CALENDAR = re.compile(r"(?:19|20)\d\d[-./](?:0?[1-9]|1[0-2])[-./](?:0?[1-9]|[12]\d|3[01])(?!\d)|(?:0?[1-9]|[12]\d|3[01])[-./](?:0?[1-9]|1[0-2]|[12]\d|3[01])[-./](?:19|20)\d\d(?!\d)")

# Words for kinds of streets and dwellings.
_STREET = plain(r"(?:street|st|road|rd|lane|ln|avenue|ave|court|crescent|drive|boulevard|blvd|square|terrace|gardens|circus|parkway|nagar|residency|colony|marg|vihar|enclave|rue|allée|impasse|calle|avda|avenida|paseo|rua|travessa|praça|улица|улице|ул|проспект|проспекте|переулок|переулке|набережная)")
_GENERATORS = {
    "email": re.compile(r"[a-z0-9][a-z0-9._%+-]*(?:\s*@\s*[a-z0-9-]+(?:\.[a-z0-9-]+)+|\s*(?:@|[\[(]\s*at\s*[\])])\s*[a-z0-9-]+(?:(?:\.|\s*[\[(]\s*dot\s*[\])]\s*|\sdot\s)[a-z0-9-]+)+|\sat\s[a-z0-9-]+(?:\sdot\s[a-z0-9-]+)+)"),
    "digits": re.compile(r"\+?\(?\d(?:[\s().\-/,]{0,3}\d){6,}"),
    "spelled": re.compile(r"\b(?:(?:zero|oh|one|two|three|four|five|six|seven|eight|nine|double|triple)\b[\s,.\-]*){7,}"),
    "pan": re.compile(r"(?<![a-z\d])[a-z]{5}\s?\d{4}\s?[a-z](?![a-z\d])"),
    "iban": re.compile(r"(?<![a-z\d])[a-z]{2}\d{2}(?:\s?[a-z\d]{4}){2,7}(?:\s?[a-z\d]{1,3})?(?![a-z\d])"),
    "letters": re.compile(r"(?<![a-z\d])[a-z]{1,3}-?\d{5,9}(?:-?[a-z])?(?![a-z\d])|(?<![a-z\d])[a-z]{2}(?:\s?\d{2}){3}\s?[a-z](?![a-z\d])"),
    "number_first": re.compile(rf"(?:(?:flat|house|plot|apt|door)\s*(?:no\.?\s*)?)?\b\d{{1,5}}(?:\s?/\s?[a-z]|[a-z])?,?\s+(?:[^\W\d_][\w'’.-]*\.?,?\s+){{0,3}}{_STREET}\b\.?(?:\s+(?:du|de|des|de la|del|los|das|do)?\s*[^\W\d_][\w'’-]*)?"),
    "flat": re.compile(rf"\b(?:flat|house no\.?|plot|apt)\s*\d{{1,5}}\b[^.!?\n]{{0,60}}?\b{_STREET}\b"),
    "street_first": re.compile(rf"\b{_STREET}\b\.?\s+(?:[^\W\d_][\w'’-]*\s*){{1,5}},?\s*(?:д\.?\s*)?\d{{1,5}}"),
    "compound": re.compile(r"\b[^\W\d_]{3,}(?:straße|strasse|gasse|weg|platz|allee|ring|ufer|damm)\s+\d{1,4}\s?[a-z]?\b"),
}
_NUMBER_KINDS = {"digits": ("phone", "id_number"), "spelled": ("phone",), "pan": ("id_number",), "iban": ("id_number",), "letters": ("id_number",), "email": ("email",), "number_first": ("address",), "flat": ("address",), "street_first": ("address",), "compound": ("address",)}
_GEN_NO = {g: i for i, g in enumerate(_NUMBER_KINDS)}
# What numbers of a kind can't be without in plain text, whose digits are ASCII ones; each begins with a digit so that the engine can skip to it.
_NUMBERS = re.compile(r"[0-9][0-9\s().\-/,]*")
_WITHOUT = {
    "digits": re.compile(r"[0-9](?:[\s().\-/,]{0,3}[0-9]){6}"),
    "pan": re.compile(r"[0-9]{4}\s?[a-z]"),
    "iban": re.compile(r"[0-9]{2}(?<=[a-z][a-z][0-9]{2})"),
    "letters": re.compile(r"[0-9]{2}(?:[0-9]{3}(?:(?<=[a-z][0-9]{5})|(?<=[a-z]-[0-9]{5}))|\s?[0-9]{2}\s?[0-9]{2}\s?[a-z])"),
}
_LETTERS_TOO = re.compile(r"[0-9]{2}(?:(?<=[a-z][a-z][0-9]{2})|[0-9]{2}\s?[a-z]|[0-9]{3}(?:(?<=[a-z][0-9]{5})|(?<=[a-z]-[0-9]{5}))|\s?[0-9]{2}\s?[0-9]{2}\s?[a-z])")  # any of the last three
_TITLES = frozenset(("mr", "mrs", "ms", "miss", "dr", "prof", "herr", "frau", "mme", "sr", "sra"))
_SPOKEN = frozenset(("zero", "oh", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "double", "triple"))
_STREET_WORDS = frozenset(re.findall(r"[^\W\d_][\w'’-]+", _STREET))
_ANY_STREET = re.compile(rf"\b{_STREET}\b")
_TAIL = re.compile(plain(r"(?:,?\s*кв\.?\s*\d+)?(?:\.|,)?(?:,?\s+(?:apt|unit|suite)\s*\d+)?(?:\s*[,–-]?\s*(?:\d+\.?º?o?\s\w,\s*)?(?:sector\s*\d+,\s*)?(?:\d{5,6}\s+)?[^\W\d_][\w'’-]+(?:\s*[,–-]\s*(?:[a-z]{2}\s+)?\d{5,6}|\s+\d{5,6})?)?"))


def _often(share: float) -> float:
    """How common a word is, in four steps: the very share would tell which word it is."""
    return 0.0 if share <= 0 else 1.0 if share < 0.01 else 2.0 if share < 0.1 else 3.0


def _luhn(digits: str) -> bool:
    """Whether the check digit of a card number fits."""
    if not 13 <= len(digits) <= 19:
        return False
    other = sum(sum(divmod(2 * int(c), 10)) for c in digits[-2::-2])
    return (other + sum(int(c) for c in digits[-1::-2])) % 10 == 0


@lru_cache(maxsize=KEPT)
def _around(before: str, after: str) -> tuple[list[float], float]:
    """Features of what stands before and after a number or address, in lower case: those that stand together in ``Finder._features``, and the last one."""
    near = before[-20:]
    phone, number = bool(_PHONE.search(before)), bool(_ID.search(before))
    return [
        float(phone or bool(_PHONE.search(after[:14]))), float(number), float(bool(_ADDRESS.search(before))), float(bool(_TICKET.search(near))), float(bool(_CODE.search(near))),
        float(bool(_MONEY.search(before))), float(bool(_MONEY_AFTER.search(after))), float(bool(_DATE.search(near))),
    ], float(phone) - float(number)


class Finder:
    """Proposes overlapping spans with high recall, scores them with boosted trees, and keeps the best that pass."""

    def __init__(self, share: dict[str, float], every: dict[str, float] | None = None, pairs: dict[str, float] | None = None):
        self.share = share  # of the texts that hold a word, not counted where it is written as part of a name: common words are rarely names
        self.every = share if every is None else every  # the same, counted everywhere
        self.pairs = pairs or {}  # of those that hold two words side by side, as products and places are called again and again
        self.trees: Boosted | None = None
        self.names: Boosted | None = None  # which are far more often proposed than right
        self.least = dict.fromkeys(KINDS, 0.5)
        self._scored: dict[tuple, float] = {}  # of names, by their features

    def _number_spans(self, low: str, words: set[str]) -> list[tuple[int, int, str]]:
        """(start, end, generator) of the numbers and addresses proposed in a plain text in lower case."""
        spans: list[tuple[int, int, str]] = []
        if "@" in low or ("at" in low and "dot" in low):
            spans += [(m.start(), m.end(), "email") for m in _GENERATORS["email"].finditer(low)]
        numbers = _NUMBERS.findall(low)
        if numbers:
            lettered = _LETTERS_TOO.search(low)
            for g, gate in _WITHOUT.items():
                if (lettered if g != "digits" else max(map(len, numbers)) >= 7) and gate.search(low):
                    spans += [(m.start(), m.end(), g) for m in _GENERATORS[g].finditer(low)]
            compound = "straße" in low or "strasse" in low or "gasse" in low or "weg " in low or "platz " in low or "allee " in low or "ring " in low or "ufer " in low or "damm " in low
            if compound or not words.isdisjoint(_STREET_WORDS):
                for g in ("number_first", "flat", "street_first", "compound") if _ANY_STREET.search(low) else ("compound",):
                    for m in _GENERATORS[g].finditer(low):
                        tail = _TAIL.match(low, m.end())
                        spans.append((m.start(), tail.end() if tail else m.end(), g))
        if not words.isdisjoint(_SPOKEN) and sum(map(low.count, _SPOKEN)) >= 7:
            spans += [(m.start(), m.end(), "spelled") for m in _GENERATORS["spelled"].finditer(low)]
        return spans

    def candidates(self, text: str, names: bool = True) -> Iterator[tuple[int, int, str, Sequence[float]]]:
        """(start, end, kind, features) of the spans proposed in a plain text; names only if wanted."""
        low = lower(text)
        words = set(_words(low))
        for start, end, g in self._number_spans(low, words):
            if g == "digits":  # without a bracket around it, with letters that belong to it
                start += low[start] == "(" and ")" not in low[start:end]
                while start and low[start - 1].isalnum() and low[start - 1].isascii():
                    start -= 1
                while end < len(low) and low[end].isalnum() and low[end].isascii():
                    end += 1
            shared = self._features(text, low, start, end, g)
            for kind in _NUMBER_KINDS[g]:
                yield start, end, kind, [*shared, float(KINDS.index(kind))]
        if names:
            yield from self._names(text, low, words)

    def _names(self, text: str, low: str, words: set[str]) -> Iterator[tuple[int, int, str, Sequence[float]]]:
        done = set()
        for m in _TITLED.finditer(low) if not words.isdisjoint(_TITLES) else ():
            done.add((m.start(), m.end()))
            yield m.start(), m.end(), "name", self._name_features(text, low, m.start(), m.start("name"), m.end(), 0)
        for place in self._pair_places(text, low, words):
            m = _PAIR.match(low, place)
            if not m:
                continue
            at = m.lastindex  # of the second word, in the same alternative as the first
            start, second, end = m.start(at - 1), m.start(at), m.end(at)
            if (start, end) in done or m[at - 1] == m[at]:
                continue
            yield start, end, "name", self._name_features(text, low, start, second, end, at)

    def _features(self, text: str, low: str, start: int, end: int, g: str) -> list[float]:
        s, raw = low[start:end], text[start:end]
        before, after = low[max(0, start - 48) : start], low[end : end + 28]
        before = before[max((stop.end() for stop in _SENTENCE.finditer(before)), default=0) :]
        around, phone_or_id = _around(before, after)
        groups = [len(x) for x in re.findall(r"\d+", s)]
        digits = sum(groups)
        letters = sum(c.isalpha() for c in s)
        head = 0
        while head < len(s) and s[head].isalpha():
            head += 1
        out = [
            float(_GEN_NO[g]), float(digits), float(len(groups)), float(max(groups, default=0)), float(groups[-1] if groups else 0), float(groups[0] if groups else 0), float(letters), float(head),
            float(len(groups) >= 3 and all(x == 4 for x in groups[:3])), float(groups == [3, 2, 4]), float(groups in ([4, 2, 2], [2, 2, 4], [1, 2, 4], [2, 1, 4], [1, 1, 4], [4, 1, 1], [4, 1, 2], [4, 2, 1])), float(len(groups) >= 7 and max(groups) == 1),
            float(s.startswith("+")), float("(" in s[:2]), float(s[:1] == "0" or s[1:2] == "0"), float("," in s), float(s.count(".")), float("-" in s), float("/" in s), float("@" in s),
            float("dot" in s), *around, float(bool(re.search(r"\d{5,6}", s))), float(len(s)), float(s[:1].isdigit()),
            float(bool(re.search(r"[\w]$", before))), float(bool(re.match(r"[\w]", after))), float(bool(re.search(r"\b(?:apt|flat|house|tower|sector)\b", s))),
            float(bool(_CALENDAR.search(s))), float(_luhn("".join(c for c in s if c.isdigit()))), float(bool(_AMOUNT.fullmatch(s))), float(not before.strip()), float(not after.strip()), phone_or_id,
        ]
        words = _WORD.findall(s)
        if words and g in ("number_first", "flat", "street_first", "compound"):
            shares = [self.share.get(w, 0.0) for w in words]
            caps = sum(w[:1].isupper() for w in re.findall(r"[^\W\d_][\w'’-]+", raw)) / len(words)
            out += [*map(_often, (max(shares), min(shares), shares[0], shares[-1])), caps, float(raw.isupper()), float(text.isupper() or text.islower())]
        else:
            out += [0.0] * 7
        return out

    def _pair_places(self, text: str, low: str, words: set[str]) -> list[int]:
        """Where a name may begin: at or one word before a word that is not common, and where two words are written as names."""
        places = {m.start() for m in (_ASCII_CAPPED if text.isascii() else _CAPPED).finditer(text)}
        for w in words.difference(self.share):
            at = low.find(w)
            while at >= 0:
                if not at or not (low[at - 1].isalnum() or low[at - 1] in "_'’-"):
                    places.add(at)
                    start = at
                    while start and (low[start - 1].isspace() or low[start - 1] in ",."):
                        start -= 1
                    while start and (low[start - 1].isalnum() or low[start - 1] in "_'’-"):
                        start -= 1
                    places.add(start)
                at = low.find(w, at + len(w))
        return sorted(places)

    def _name_features(self, text: str, low: str, start: int, second: int, end: int, at: int) -> tuple:
        """The features of a name; ``at``: its form, 0 with a title."""
        before, after = low[max(0, start - 24) : start], low[end : end + 24]
        last, following = _LAST_WORD.search(before), _NEXT_WORD.match(after)
        prior = last[1].removesuffix("'s").removesuffix("’s") if last else ""
        one, two = low[start:second].strip(" ,.\n"), low[second:end]
        shares = 0.0 if at in (0, 2) else self.share.get(low[start:second].rstrip().removesuffix(","), 0.0), self.share.get(two, 0.0)
        left = before.rstrip(" \t")
        part = 1 if prior in _CLOSING else 2 if prior in _ROLE else 3 if prior in _INTRO else 4 if prior in _TOWARDS else 0
        return (
            at, *map(_often, shares), text[start].isupper(), text[second].isupper(), text[start:end].isupper(), text[end - 1].islower(),
            _often(self.share.get(prior, 0.0)) if last else -1, _often(self.share.get(following[1], 0.0)) if following else -1, not left or left[-1] in ".!?:;|\n", "\n" in low[start:end], not low[start:end].isascii(),
            min(second - start, 4), min(end - second, 4), "'" in low[start:end] or "’" in low[start:end], "-" in low[start:end], text[end : end + 24].isupper(), following is not None and following[1] in _FOLLOWS,
            one in _THINGS, two in _THINGS, _often(self.every.get(one, 0.0)), _often(self.every.get(two, 0.0)), " ".join(low[start:end].split()) in self.pairs,
            part, part == 1, part == 2, part == 3, not after.strip(), not before.strip(), "," in left[-1:], following is not None and text[end + following.start(1)].isupper(),
        )

    def spans(self, texts: list[str]) -> list[list[tuple[int, int, str]]]:
        """The accepted spans of each plain text, best first where they overlap."""
        rows, owner, place = [], [], []
        for i, t in enumerate(texts):
            for start, end, kind, features in self.candidates(t):
                rows.append(features)
                owner.append(i)
                place.append((start, end, kind))
        out: list[list[tuple[int, int, str]]] = [[] for _ in texts]
        if rows:
            new = list(dict.fromkeys(f for f, (*_, kind) in zip(rows, place) if kind == "name" and f not in self._scored))
            if len(self._scored) + len(new) > KEPT:  # a name has the same features as many another one
                self._scored.clear()
                new = list(dict.fromkeys(f for f, (*_, kind) in zip(rows, place) if kind == "name"))
            self._scored.update(zip(new, self._score(new, np.ones(len(new), bool)).tolist()))
            others = [j for j, (*_, kind) in enumerate(place) if kind != "name"]
            score = np.array([self._scored[f] if kind == "name" else 0.0 for f, (*_, kind) in zip(rows, place)])
            score[others] = self._score([rows[j] for j in others], np.zeros(len(others), bool))
            enough = np.flatnonzero(score >= np.array([self.least[kind] for *_, kind in place]))
            for j in enough[np.argsort(-score[enough], kind="stable")].tolist():
                start, end, kind = place[j]
                if all(end <= a or start >= b for a, b, _ in out[owner[j]]):
                    out[owner[j]].append((start, end, kind))
        return out

    def _score(self, rows: list[Sequence[float]], named: np.ndarray) -> np.ndarray:
        score = np.empty(len(rows))
        for trees, on in ((self.trees, np.flatnonzero(~named)), (self.names, np.flatnonzero(named))):
            if len(on):
                score[on] = trees.predict(np.array([rows[i] for i in on], np.float64)) if trees else 0.0
        return score

    def calm(self, sentence: str) -> list[tuple[int, int, Sequence[float]]] | None:
        """The names proposed in a sentence, or none if it may hold an item: a number or address is proposed, or a name, of uncommon words that are not found together elsewhere, in a place where names stand."""
        low = lower(sentence)
        words = set(_words(low))
        if self._number_spans(low, words):
            return None
        out = []
        for start, end, _, f in self._names(sentence, low, words):
            if min(f[1], f[2]) == 0 and f[PART] and not f[TOGETHER]:
                return None
            out.append((start, end, f))
        return out

    def fit(self, lines: list[tuple[str, list[tuple[int, int, str]]]], alone: pd.DataFrame | None = None, often: dict[str, float] | None = None) -> "Finder":
        """Train on lines with known items; the last fifth calibrates the thresholds, at the best F score of each kind, recall counting twice.

        ``alone``: (features, held, rare, weight) of the names proposed in the sentences of the texts as they stand, in which nothing is
        taken for an item; ``held`` for those that calibrate. ``often``: the weights of what is said there more than ``RARE`` times.
        """
        x, y, kinds, line, said = [], [], [], [], []
        for n, (text, items) in enumerate(lines):
            for start, end, kind, features in self.candidates(text):
                hit = (start, end, kind) in items if kind == "name" else any(kind == k and min(end, b) - max(start, a) >= 0.6 * (b - a) for a, b, k in items)
                x.append(features)
                y.append(hit)
                kinds.append(kind)
                line.append(n)
                said.append(_said(text[start:end]) if kind == "name" else "")
        times, often = Counter(said), often or {}
        bare, held = [not lines[n][1] for n in line], [n >= len(lines) * 4 // 5 for n in line]
        rare = [w != "" and times[w] + often.get(w, 0.0) <= RARE for w in said]
        weight = [1.0] * len(x)
        if alone is not None:
            x += [[float(c) - 1 for c in f] for f in alone["features"]]
            y += [False] * len(alone)
            kinds += ["name"] * len(alone)
            bare += [True] * len(alone)
            held, rare, weight = held + alone["held"].tolist(), rare + alone["rare"].tolist(), weight + alone["weight"].tolist()
        ys, kinds_, bare, held, rare, weight = np.array(y, np.float64), np.array(kinds), np.array(bare, bool), np.array(held, bool), np.array(rare, bool), np.array(weight)
        named = kinds_ == "name"
        some = lambda on: (np.array([x[i] for i in np.flatnonzero(on)], np.float64), ys[on], weight[on])
        self.trees = Boosted().fit(*some(~held & ~named))
        self.names = Boosted(trees=90, depth=5).fit(*some(~held & named)) if (~held & named).any() else None
        # what is taken for a name with a capital in a line without items, and said in hardly any other line, may be one: not taught, not counted
        self._scored.clear()
        doubt = np.zeros(len(x), bool)
        on = np.flatnonzero(named & bare & rare)
        doubt[on] = self._score([x[i] for i in on], named[on]) >= 0.4
        if doubt.any():
            self.names = Boosted().fit(*some(~held & named & ~doubt))
        held &= ~doubt
        score = self._score([x[i] for i in np.flatnonzero(held)], named[held])
        for kind in KINDS:
            on = kinds_[held] == kind
            if on.any():
                p, t, w = score[on], ys[held][on], weight[held][on]
                grid = np.arange(0.3, 0.96 if kind == "name" else 0.71, 0.05)
                # what is false in a text as it stands counts ten times: names are that much rarer there
                often_ = w * np.where((kinds_[held][on] == "name") & bare[held][on], 10, 1)
                f = [3 * (w * ((p >= c) & (t > 0))).sum() / max(1, often_[p >= c].sum() + 2 * (w * (t > 0)).sum()) for c in grid]
                best = np.flatnonzero(np.array(f) >= max(f) - 1e-12)
                self.least[kind] = float(grid[best[len(best) // 2]])
        return self


def _said(words: str) -> str:
    """Words proposed as a name, if there is a capital in them."""
    low = lower(words)
    return "" if low == words else low


# What items stand in, as general sentences of seven languages; none is taken from a table.
HOMES = {
    "email": ["You can get hold of me under {}.", "Invoices usually go to {} but none came", "I registered with {} last year.", "drop a line: {}", "login {} stopped working", "(see {})", "{}", "My user name is {} since May.", "Kontakt läuft über {}.", "Meine Adresse lautet {}", "Mon courriel : {}", "On peut me joindre via {}.", "Mi correo electrónico es {}", "Respondan a {} por favor.", "Podem responder para {}.", "Endereço eletrônico: {}", "Почта для связи: {}", "Пришлите ответ на {}.", "संपर्क: {}", "जवाब {} पर भेजें।"],
    "phone": ["My landline is {}.", "Dial {} any evening.", "Try ringing my wife under {}", "text {} if details are missing", "Tel. {}", "cell: {}", "You already have {} on file.", "WhatsApp me {}", "please phone {} tomorrow", "{}", "{} is where I pick up.", "Nobody called back on {}!", "Telefonisch erreichbar unter {}.", "Handy: {}", "Rückruf bitte an {}", "Joignable au {} le soir.", "Mon portable : {}", "Llámenme al {}.", "Mi móvil es el {}", "Telefone de contato {}", "Meu celular: {}.", "Мой телефон {}", "Перезвоните на {}.", "मेरा मोबाइल नंबर {} है।", "इस नंबर पर बात करें: {}", "इस फोन {} पर"],
    "id_number": ["Social security no. {}", "My tax number {} is on the form.", "passport no {} was refused", "The driving licence {} expired.", "national ID: {}", "They printed my whole card number {} in the mail.", "debit card {} was charged twice", "The IBAN is {}.", "bank account {} was debited", "aadhar card number {}", "Aadhaar no. is {}", "PAN card {} got rejected", "Meine Steuernummer {} fehlt.", "Personalausweis Nr. {}", "Reisepass {} abgelaufen", "Kontonummer {} stimmt.", "Numéro de sécurité sociale {}", "carte d'identité n° {}", "Mon compte {} est bloqué.", "Mi DNI es {}", "Número de cuenta {}.", "pasaporte {} vencido", "CPF {}", "Meu RG {} foi recusado", "Conta bancária {}.", "ИНН {}", "паспорт {}", "Номер карты {}.", "Счёт {} закрыт.", "आधार संख्या {}", "पैन कार्ड {}", "मेरा खाता {} बंद है।"],
    "address": ["We moved to {} in spring.", "My flat is at {}.", "Deliver the parcel to {}", "registered office: {}", "Home: {}", "The letter was sent to {} and got lost.", "I have lived at {} for years", "{}", "Lieferadresse: {}", "Wir wohnen jetzt {}.", "Das Paket ging an {}.", "Domicilié au {}", "Notre adresse : {}.", "Mi domicilio es {}.", "Resido en {}", "Endereço: {}", "Moramos na {}.", "Проживаю по адресу {}", "Доставка на {}.", "घर का पता {}", "मैं {} में रहता हूँ।"],
    "name": [
        "Best wishes {}", "Yours sincerely,\n{}", "Cheers, {}", "Warm regards\n{}", "Many thanks, {}", "signed: {}", "Mit freundlichen Grüßen {}", "Viele liebe Grüße\n{}", "Bien cordialement, {}", "Meilleures salutations\n{}", "Un saludo, {}", "Atentamente\n{}", "Um abraço, {}", "Atenciosamente\n{}", "Всего доброго, {}", "С наилучшими пожеланиями,\n{}", "सादर, {}", "धन्यवाद\n{}",
        "I am {} and I pay for this.", "My name's {}.", "Name: {}", "Hello, {} here, a customer since May.", "{} here.", "Ich heiße {}.", "Je m'appelle {}.", "Me llamo {} y pago cada mes.", "Meu nome é {}.", "Меня зовут {}.", "मेरा नाम {} है।",
        "Your employee {} hung up.", "a rep called {} made it worse", "The supervisor {} refused again.", "customer care executive {} lied", "I talked with {} twice.", "My colleague {} saw it too.", "ask {} about it", "Kudos to {}!", "My neighbour {} left too.", "The manager, {}, shrugged.", "An officer by the name of {} signed it.", "I got a mail from {} about it.", "Dear {},", "Die Mitarbeiterin {} war nett.", "Ich habe mit {} gesprochen.", "La conseillère {} a raccroché.", "J'ai parlé avec {}.", "El asesor {} no sabía nada.", "Hablé con {} ayer.", "O atendente {} desligou.", "Falei com {} ontem.", "Сотрудник {} бросил трубку.", "Я говорил с {} вчера.", "एजेंट {} ने फोन काट दिया।", "मैंने {} से बात की।",
        "{} was very helpful.", "{} is impolite", "{} never called back.", "{} promised a refund", "{} from billing solved it.", "{} at the counter knew nothing", "{} closed my complaint twice.", "Yesterday {} told me to wait.", "After days {} answered.", "Then {} hung up on me.", "thank you {}", "{}", "{}: never again", "{} war unfreundlich", "{} hat nie geantwortet.", "{} n'a jamais répondu.", "{} fue muy grosero.", "{} foi grosseiro", "{} не ответил.", "{} ने जवाब नहीं दिया।",
    ],
}


def training_lines(surroundings: list[str], blank: Finder | None, n: int = MADE_UP, seed: int = 21) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """Lines with items of every kind, and with what is easily taken for one, between sentences of real texts.

    All names, streets, towns and numbers are made up of syllables and digits here; a sentence is used as
    surroundings only if no generator proposes a span in it, names outside their usual places aside, so hardly anything personal is
    taught as harmless; ``blank``, not trained yet, proposes. Those sentences also stand alone, as lines without an item; without
    ``blank`` the surroundings are such sentences already and don't.
    """
    rng = np.random.default_rng(seed)

    def pick(*xs):
        return xs[int(rng.integers(len(xs)))]

    def num(k, first=None):
        return "".join(str(int(d)) for d in rng.integers(0, 10, k)) if first is None else first + num(k - len(first))

    def upper(k):
        return "".join(pick(*"ABCDEFGHIJKLMNOPQRSTUVWXYZ") for _ in range(k))

    def syllables(k):
        return "".join(pick("ba", "ce", "dol", "fin", "gar", "hul", "jor", "kem", "lun", "mar", "nis", "ov", "pel", "qua", "ros", "sten", "tav", "ul", "vik", "wen", "yor", "zan", "ri", "na", "sha", "mit", "er", "al") for _ in range(k))

    def word(k=None):
        return syllables(k or int(rng.integers(2, 4))).capitalize()

    def email():
        user = word().lower() + pick("", ".", "_", "-") + pick("", word(1).lower()) + pick("", num(2), "+" + word(1).lower())
        host, tld = pick("", "mail.") + word().lower() + pick("", "-" + word(1).lower()), pick("example", "test", "com", "org", "net", "co.uk", "in", "de", "fr", "ru")
        at, dot = pick(("@", "."), ("@", "."), ("@", "."), (" @ ", "."), (" (at) ", " (dot) "), (" [at] ", " [dot] "), ("(at)", "."), (" at ", " dot "))
        out = user + at + host.replace(".", dot) + dot + tld.replace(".", dot)
        return out.upper() if rng.random() < 0.15 else out

    def phone():
        cc, sep = pick("+1", "+44", "+49", "+91", "+33", "+34", "+55", "+7", "0049", "+" + num(2)), pick(" ", "-", ".", "")
        a, b, c = num(3), num(3), num(4)
        spoken = " ".join(pick("zero", "oh", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "double five") for _ in range(int(rng.integers(9, 12))))
        return pick(a + sep + b + sep + c, a + sep + b + sep + c, f"({a}) {b}-{c}", f"({a}){b}/{c}", f"{cc} ({a}) {b}-{c}", f"{cc}{sep}{num(5)}{sep}{num(5)}", f"{cc}{sep}{num(10)}", f"{cc} {num(2)} {num(5)} {num(3)}", f"{num(5)} {num(5)}", f"{pick('6', '7', '9')}{num(2)} {num(3)} {num(3)}", f"0{num(3)} {num(4)} {num(3)}", f"0{num(3)} {num(7)}", f"0{num(4)}{pick(' ', '/', '-')}{num(6)}", f"0{num(3)} {num(3)} {num(4)}", "0" + num(1) + "".join(" " + num(2) for _ in range(4)), " ".join(num(10)), spoken, num(10), num(10, pick("6", "7", "8", "9")), f"{num(4)}-{num(4)}", f"({num(2)}) 9{num(4)}-{num(4)}", f"8 ({num(3)}) {num(3)}-{num(2)}-{num(2)}")

    def id_number():
        out = pick(
            f"{upper(5)}{num(4)}{upper(1)}", f"{upper(5)} {num(4)} {upper(1)}", f"{num(4)} {num(4)} {num(4)}", f"{num(4)}-{num(4)}-{num(4)}", num(12), f"{num(4)} {num(4)} {num(4)} {num(4)}", f"{num(4)}-{num(4)}-{num(4)}-{num(4)}", num(16), f"3{num(3)} {num(6)} {num(5)}",
            f"{num(3)}-{num(2)}-{num(4)}", f"{num(3)} {num(2)} {num(4)}", upper(1) + num(7), upper(2) + num(7), upper(1) + num(8), num(9), num(12, "00"), num(11), upper(2) + num(2) + " " + " ".join(num(4) for _ in range(4)) + " " + num(2), upper(2) + num(20), upper(2) + num(2) + upper(4) + num(14), f"{upper(2)}{num(2)} {upper(4)} {num(4)} {num(4)} {num(2)}",
            f"{num(3)}.{num(3)}.{num(3)}-{num(2)}", f"{num(8)}{upper(1)}", f"{upper(2)} {num(2)} {num(2)} {num(2)} {upper(1)}", f"{num(2)} {num(2)} {num(6)}", f"{num(4)} {num(6)}", f"{num(1)} {num(2)} {num(2)} {num(2)} {num(3)} {num(3)} {num(2)}",
        )
        return out.lower() if rng.random() < 0.1 else out

    def address():
        kind = pick("Street", "St", "St.", "Road", "Rd.", "Lane", "Avenue", "Ave", "Court", "Crescent", "Drive", "Square", "Terrace", "Gardens", "Circus", "Boulevard")
        name, town, n = pick(word(), word(), word() + " " + word(1), "Old " + word(), "North " + word()), word(), str(int(rng.integers(1, 400))) + pick("", "", "", "A", "b")
        return pick(f"{n} {name} {kind}, {town}", f"{n} {name} {kind}, {town}", f"{n} {name} {kind}", f"{n} {name} {kind}, {town} {num(5)}", f"{n} {name} {kind}, Apt {num(2)}\n{town}, {upper(2)} {num(5)}", f"House No {n}, {num(1)}th Cross, {name} Nagar, {town} - {num(6)}", f"Flat {n}, Tower {upper(1)}, {name} Residency, Sector {num(2)}, {town}", f"{n}/{pick(*'abc')} {name} {kind} {town} {num(6)}".lower(), f"{word()}{pick('straße', 'gasse', 'weg', 'platz', 'allee', 'ring')} {n}, {num(5)} {town}", f"{n} {pick('rue', 'avenue', 'allée', 'boulevard')} {pick('du', 'des', 'de la')} {word()}, {num(5)} {town}", f"{pick('Calle de los', 'Avda. de', 'Calle', 'Paseo de')} {word()} {n}, 2.º B, {num(5)} {town}", f"{pick('Rua das', 'Travessa do', 'Rua', 'Avenida')} {word()}, {n}, {num(5)} {town}", f"{pick('ул.', 'улица', 'проспект')} {word()}, {pick('', 'д. ')}{n}, {town}")

    def name(plainly=False):
        given, family = word(int(rng.integers(1, 3))), pick("", "", "", "", "", "", "", "O'", "D'", word(2) + "-") + word()
        if len(given) < 3:
            given = word(2)
        out = pick(*[f"{given} {family}"] * 6, f"{family}, {given}", f"{given[0]}. {family}", f"{pick('Mr.', 'Mr', 'Mrs', 'Ms.', 'Dr.', 'Prof.', 'Herr', 'Frau', 'Sr.')} {family}")
        return out if plainly else pick(*[out] * 7, out.upper(), out.lower(), out.lower())

    make = {"email": email, "phone": phone, "id_number": id_number, "address": address, "name": name}
    code = lambda k=7: "".join(pick(*"ABCDEFGHJKMNPQRSTUVWXYZ23456789") for _ in range(k))
    day = lambda: pick(f"20{num(2)}-{int(rng.integers(1, 13)):02d}-{int(rng.integers(1, 29)):02d}", f"{int(rng.integers(1, 29)):02d}{pick('/', '.', '-')}{int(rng.integers(1, 13)):02d}{pick('/', '.', '-')}20{num(2)}")
    hour = lambda: f"{int(rng.integers(0, 24)):02d}:{num(1)}0"
    signs = ("₹", "$", "€", "£", "Rs. ", "INR ")
    others = [
        lambda: f"It broke {pick('on', 'since', 'until')} {day()}{pick('', ' ' + hour(), ' 10', ' and ' + day())}.", lambda: f"Posted {day()} {hour()}:{num(2)}", lambda: f"{day()} to {day()}", lambda: f"Am {day()} war alles weg.", lambda: f"The bill says {pick(*signs)}{num(2)},{num(3)}.{num(2)} before {num(2)}% tax.", lambda: f"I paid {num(1)},{num(2)},{num(3)} {pick('rupees', 'euros', 'USD')} in {num(2)} rates of {num(5)}.{num(2)}", lambda: f"{pick(*signs)}{num(7)} is missing",
        lambda: f"Support ticket {pick('', '#', 'no. ')}{pick(code(), num(7), num(8), code(3) + '-' + num(6))} was never read.", lambda: f"Invoice {pick(num(3) + '-' + num(2) + '-' + num(4), num(8), code(2) + num(6), num(4) + '-' + num(4))} is unpaid.", lambda: f"Reference {pick(code(3) + '-' + code(4), num(9), code(9))}", lambda: f"order {pick('no. ', '#', '')}{pick(num(8), num(10), num(3) + '-' + num(7))} not shipped", lambda: f"See case {num(7)}.", lambda: f"Vorgang {pick(num(8), code(8))} ist offen.", lambda: f"Dossier n° {num(8)}", lambda: f"Pedido {num(9)} perdido", lambda: f"Заказ № {num(8)}", lambda: f"शिकायत संख्या {num(8)}",
        lambda: f"The one-time code was {pick(num(6), num(3) + ' ' + num(3), num(8))}.", lambda: f"OTP {num(6)} expired", lambda: f"pin {num(4)} {num(4)}", lambda: f"{pick('Version', 'version', 'v')} {num(2)}.{num(1)}.{num(1)}.{num(4)}", lambda: f"Build {num(2)}.{num(1)}.{num(4)} and {num(1)}.{num(1)}.{num(1)}.{num(3)} on Android {num(2)}.", lambda: f"Follow @{word().lower()}{pick('', '_' + num(2))} for news", lambda: f"I scored {num(7)} points in {num(3)} days.", lambda: f"hash {code(12).lower()}",
        lambda: f"The {word()} {pick('basket', 'theme', 'plan', 'widget', 'Pro', 'Plus', 'Lite')} and the {word()} {pick('vault', 'card', 'screen', 'tab', 'Fund', 'Plan')} look good.", lambda: f"{word()} {pick('Bank', 'App', 'Pay', 'Money', 'Support', 'Team', 'Wallet', 'Invest')} {pick('was', 'is', 'never')} slow.", lambda: f"I flew to {pick('New ', 'San ', 'Bad ', 'Saint ')}{word()} {pick('last', 'on', 'every')} {pick('Monday', 'Friday', 'summer')}.", lambda: f"{pick('Monday', 'Friday', 'Last')} {pick('Morning', 'Evening', 'Night')} it {pick('crashed', 'froze')}.", lambda: f"On my {word()} {pick('Pro', 'Note', 'Tab', 'X')} {num(2)} it {pick('hangs', 'closes')}.", lambda: f"{pick('Very', 'Really', 'So')} {pick('Good', 'Bad', 'Slow')} {pick('App', 'Service')}",
        lambda: f"{pick('Regards to', 'Thanks to', 'Kudos to', 'Cheers to')} {pick('the whole crew', 'everyone involved', 'all developers', 'nobody')}.", lambda: f"The {pick('agent', 'manager', 'executive', 'clerk')} {pick('said sorry twice', 'just laughed', 'knew nothing', 'transferred me again')}.", lambda: f"I spoke to {pick('someone else', 'three different people', 'a robot voice', 'sales again')}.", lambda: f"This is {pick('pretty annoying', 'beyond me', 'not okay', 'rather sad')}.", lambda: f"Ask {pick('customer support', 'any user', 'them yourself')}.", lambda: f"{pick('Mr', 'Dr')} {pick('nobody', 'know it all')} says no.",
        lambda: f"After {num(2)} days on {pick('the road', 'a long street', 'the main square')} I gave up.", lambda: f"{num(2)} {pick('users', 'people', 'shops')} in the {pick('court', 'square', 'lane')} agree.", lambda: f"I live at {pick('my parents', 'the coast', 'the other end of town')}.", lambda: "my number [phone]", lambda: "mail [email], card [id_number]", lambda: f"at {num(1)} dot {num(2)} percent", lambda: f"{pick('one two three', 'five or six', 'one, two, nine')} stars",
    ]
    calm = [s for s in surroundings if blank is None or blank.calm(s) is not None] or [""]
    lines = []
    for _ in range(n):
        parts, items, loose = [pick(*calm)] if rng.random() < 0.6 else [], [], False
        for _ in range(int(rng.integers(1, 3))):
            if rng.random() < 0.6:
                kind = pick(*KINDS, "name", "name")
                home, loose_here = pick(*HOMES[kind]), kind == "name" and rng.random() < 0.45
                if loose_here:  # a name, written as one, may stand in any place of any sentence
                    loose = True
                    words = pick(*calm).replace("{", "").replace("}", "").split()
                    at = int(rng.integers(0, len(words) + 1))
                    home = " ".join([*words[:at], "{}", *words[at:]])
                parts.append((home, name(True) if loose_here else make[kind](), kind))
            else:
                parts.append(pick(*others)())
        if rng.random() < 0.5:
            parts.append(pick(*calm))
        text, join = "", pick(" ", " ", " ", "\n", " | ")
        for part in parts:
            if text:
                text += join
            if isinstance(part, tuple):
                home, value, kind = part
                a, b = home.split("{}")
                items.append((len(text) + len(plain(a)), len(text) + len(plain(a)) + len(plain(value)), kind))
                text += plain(a) + plain(value) + plain(b)
            else:
                text += plain(part)
        style = 1.0 if loose else rng.random()
        text = text.lower() if style < 0.08 else text.upper() if style < 0.16 and len(text.upper()) == len(text) else text
        lines.append((text, items))
    lines += [(s, []) for s in calm if blank is not None]  # the real share of word pairs that are no names; the few names among them count little
    return [lines[i] for i in rng.permutation(len(lines))]


# The end of a sentence or line; it begins with a set so that the engine can skip to it.
_STOP = re.compile(r"[.!?।\n](?:(?<=\n)|\s+)")


def _sentences(texts: list[str]) -> list[str]:
    out = []
    for text in texts:
        at = 0
        for m in _STOP.finditer(text):
            out.append(text[at : m.start() + (m[0] != "\n")])
            at = m.end()
        out.append(text[at:])
    return [s.strip() for s in out if 10 <= len(s) <= 160]


# Words that begin with a capital, side by side; characters beyond the first plane would make the set slow.
_CAPITAL = "".join(c for c in map(chr, range(0x10000)) if c.isupper() and c.isalnum())
_BEYOND = re.compile("[\U00010000-\U0010ffff]")
_BESIDE = re.compile(rf"[{_CAPITAL}][\w'’-]++(?:[ .,]++[{_CAPITAL}][\w'’-]++)+")
_ASCII_BESIDE = re.compile(r"[A-Z][A-Za-z0-9_'-]++(?:[ .,]++[A-Z][A-Za-z0-9_'-]++)+")


def plain_words(text: str) -> set[str]:
    """The words of a text in lower case, but for those written with a capital beside another such word, as names are."""
    return _plain_and_all_words(text)[0]


def _plain_and_all_words(text: str) -> list[set[str]]:
    low = lower(text)
    words = _words(low)
    every = set(words)
    if text.isupper():
        return [set(), every]
    if not text.isascii() and ("Σ" in text or _BEYOND.search(text)):  # the lower case of Σ depends on what is around it
        return [_plain_words(text), every]
    beside: list[str] = []
    for m in (_ASCII_BESIDE if text.isascii() else _BESIDE).finditer(text):
        before = text[m.start() - 1 : m.start()]
        if before.isalnum() or before in ("_", "'", "’", "-"):  # it may begin within a word
            return [_plain_words(text), every]
        beside += _words(low[m.start() : m.end()])
    return [every.difference(w for w in set(beside) if words.count(w) == beside.count(w)) if beside else every, every]


def _plain_words(text: str) -> set[str]:
    """The same word by word."""
    parts = _SPLIT_WORDS.split(text)  # what is between words, and words, in turn
    words, between = parts[1::2], parts[2::2]
    capital = [w[0].isupper() for w in words]
    beside = [i for i, (a, b) in enumerate(zip(capital, capital[1:])) if a and b and not between[i].strip(" .,")]
    named = {*beside, *(i + 1 for i in beside)}
    return {lower(w) for i, w in enumerate(words) if i not in named}


def _counted(rows: DataFrame, keys: Callable[[str], list], names: list[str]) -> DataFrame:
    """(what, key, n): the number of rows (column ``text``) in which ``keys`` finds a key; it gives a set for each of ``names``."""

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count = [Counter() for _ in names]
        for frame in frames:
            for text in frame["text"]:
                for c, found in zip(count, keys(text)):
                    c.update(found)
            if sum(map(len, count)) > FLUSH:
                yield from handed_on(count)
                count = [Counter() for _ in names]
        yield from handed_on(count)

    def handed_on(count: list[Counter]) -> Iterator[pd.DataFrame]:
        for what, c in zip(names, count):
            yield pd.DataFrame({"what": pd.Series([what] * len(c), dtype=object), "key": pd.Series(list(c), dtype=object), "n": np.fromiter(c.values(), np.int64, len(c))})

    return rows.mapInPandas(scan, "what string, key string, n long").groupBy("what", "key").agg(F.sum("n").alias("n"))


def _plain_texts(texts: DataFrame) -> DataFrame:
    """The different texts in plain characters: one that is there again and again counts once."""

    def mapped(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"text": pd.Series([plain(t) for t in frame["text"]], dtype=object)})

    return materialize(texts.select("text").where("text is not null").mapInPandas(mapped, "text string").distinct())


def blank_finder(texts: DataFrame, scale: float) -> Finder:
    """A finder, not trained yet, with the shares of all the texts (different ones, in plain characters) that hold a word or pair of words."""
    n = max(1, texts.count())
    least_word, least_pair = max(3, COMMON * n), 6 * scale

    found = _counted(texts, _plain_and_all_words, ["share", "every"]).where(F.col("n") >= min(least_word, least_pair)).toPandas()
    share, every = ({k: c / n for k, c in zip(part["key"], part["n"]) if c >= least_word} for part in (found[found["what"] == what] for what in ("share", "every")))
    # both words of a pair are in at least as many texts as the pair
    frequent = texts.sparkSession.sparkContext.broadcast(frozenset(found.loc[(found["what"] == "every") & (found["n"] >= least_pair), "key"]))

    def together(text: str) -> list:
        ws, known = _words(lower(text)), frequent.value
        return [{f"{a} {b}" for a, b in zip(ws, ws[1:]) if a in known and b in known}]

    pairs = _counted(texts, together, ["pair"]).where(F.col("n") >= least_pair).toPandas()
    return Finder(share, every, {k: c / n for k, c in zip(pairs["key"], pairs["n"])})


def _alone(texts: DataFrame, blank: Finder, scale: float) -> tuple[pd.DataFrame, dict[str, float], list[str]]:
    """What ``Finder.fit`` takes of all sentences of the texts as they stand, and the surroundings of made-up items.

    The names proposed in them are counted by their features, so what reaches the driver doesn't grow with the texts but with the
    kinds of places. The surroundings are drawn, twice as many as there are made-up lines, from all the sentences that hold nothing, by how often each is there.
    """
    sentences = materialize(_sentence_counts(texts))
    share = min(1.0, 2 * MADE_UP / max(1, sentences.agg(F.sum("n")).first()[0] or 0))
    shared = texts.sparkSession.sparkContext.broadcast(blank)

    def look(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        finder = shared.value
        for frame in frames:
            count, drawn = Counter(), []
            for s, n in zip(frame["key"], frame["n"].tolist()):
                names = finder.calm(s)
                if names is None:
                    continue
                hashed = zlib.crc32(s.encode())
                times = int(n * share + hashed / 2**32)
                drawn += [(s, None, False, times)] if times else []
                for start, end, f in names:
                    count[_said(s[start:end]), bytes(int(v) + 1 for v in f), hashed % 5 == 4] += n
            rows = [*drawn, *((*k, n) for k, n in count.items())]
            yield pd.DataFrame({"said": pd.Series([r[0] for r in rows], dtype=object), "features": pd.Series([r[1] for r in rows], dtype=object), "held": np.array([r[2] for r in rows], bool), "n": np.array([r[3] for r in rows], np.int64)})

    found = materialize(sentences.mapInPandas(look, "said string, features binary, held boolean, n long"))
    drawn = found.where("features is null").select("said", "n").orderBy("said").toPandas()
    named = found.where("features is not null").groupBy("said", "features", "held").agg(F.sum("n").alias("n"))
    rare = named.where("said <> ''").withColumn("rare", F.sum("n").over(Window.partitionBy("said")) <= RARE * scale)
    often = found.where("features is not null and said <> ''").groupBy("said").agg(F.sum("n").alias("n")).where(F.col("n") > RARE * scale).toPandas()
    every = rare.unionByName(named.where("said = ''").withColumn("rare", F.lit(False)))
    alone = every.groupBy("features", "held", "rare").agg(F.sum("n").alias("n")).orderBy("features", "held", "rare").toPandas()
    alone["weight"] = alone["n"] / scale
    discard(found)
    discard(sentences)
    return alone, {k: c / scale for k, c in zip(often["said"], often["n"])}, [s for s, n in zip(drawn["said"], drawn["n"]) for _ in range(n)]


def _sentence_counts(texts: DataFrame) -> DataFrame:
    """(key, n): the sentences and how often each is there in the texts."""
    return _counted(texts, lambda text: [_sentences([text])], ["sentence"]).select("key", "n")


def fitted_finder(texts: DataFrame, scale_rows: int = SCALE_ROWS) -> Finder:
    """A finder trained for the texts (column ``text``), all of which are counted and looked at.

    The shares of words and pairs are those of all different texts. The names proposed in all their sentences are taught and calibrate
    the threshold; beyond ``scale_rows`` rows they weigh as much as those of so many, so that the made-up lines keep their part.
    """
    scale = max(1.0, texts.count() / scale_rows)
    different = _plain_texts(texts)
    blank = blank_finder(different, scale)
    alone, often, surroundings = _alone(different, blank, scale)
    discard(different)
    return blank.fit(training_lines(surroundings, None), alone, often)


def redact(text: str, spans: list[tuple[int, int, str]], mapped: str) -> str:
    """``text`` with the spans, given as places in its plain form ``mapped``, replaced by placeholders; all else as it was."""
    if not spans:
        return text
    if mapped == text:
        at = list(range(len(text) + 1))
    else:
        table, at = _table(), []
        for i, c in enumerate(text):
            at += [i] * len(table.get(ord(c), c) or "")
        at.append(len(text))
    out, last = [], 0
    for a, b, kind in sorted(spans):
        start, end = at[a], at[b - 1] + 1
        out += [text[last:start], PLACEHOLDER[kind]]
        last = end
    return "".join([*out, text[last:]])


def personal_data(rows: DataFrame, finder: Finder | None = None) -> DataFrame:
    """(tbl, row_id, field_name, kinds, n_items, redacted) for the texts that hold personal data.

    ``rows`` has tbl, row_id, field_name, text. Generators propose overlapping spans over the whole text, in plain characters (so
    full-width digits, look-alikes and invisible characters hide nothing); boosted trees score them by format and
    context features; spans above the calibrated threshold of their kind, the best first, are replaced by ``[kind]``,
    the rest of the text stays as it was. The trees are trained on made-up items and on all sentences of
    the texts. Null texts give no row, nor do texts without an item; placeholders already set are no items.
    """
    finder = finder or fitted_finder(rows.select("text"))
    shared = rows.sparkSession.sparkContext.broadcast(finder)

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        finder = shared.value
        for frame in frames:
            texts = frame["text"].tolist()
            mapped = [plain(t) for t in texts]
            each = {t: i for i, t in enumerate(dict.fromkeys(mapped))}  # a text that is there again is looked at once
            spans = finder.spans(list(each))
            found = [spans[each[t]] for t in mapped]
            on = [i for i, s in enumerate(found) if s]
            if not on:
                continue
            yield pd.DataFrame(
                {
                    "tbl": frame["tbl"].iloc[on], "row_id": frame["row_id"].iloc[on], "field_name": frame["field_name"].iloc[on],
                    "kinds": pd.Series([sorted({k for _, _, k in found[i]}) for i in on], index=frame.index[on], dtype=object), "n_items": np.array([len(found[i]) for i in on], np.int32), "redacted": pd.Series([redact(texts[i], found[i], mapped[i]) for i in on], index=frame.index[on], dtype=object),
                }
            )

    src = rows.select("tbl", F.col("row_id").cast("long").alias("row_id"), "field_name", "text").where("text is not null")
    return src.mapInPandas(scan, "tbl string, row_id long, field_name string, kinds array<string>, n_items int, redacted string")
