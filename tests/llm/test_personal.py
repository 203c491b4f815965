from __future__ import annotations

import random
import re
from collections import Counter

import pytest

from feedloom.llm import personal

# Sentences that share no wording with the training material, with the kind of item each holds.
HELD_OUT = [
    ("My colleague Priya Raman saw the same crash.", "name"),
    ("Rahul Mehta from billing sorted it out in a minute.", "name"),
    ("You could ask John Carter about the refund.", "name"),
    ("Kudos to Ananya Iyer!", "name"),
    ("Chef Thomas Müller uses it as well.", "name"),
    ("Mrs. Whitfield kept me on hold for an hour.", "name"),
    ("A certain J. Okafor signed the refusal.", "name"),
    ("Written by Claire Dubois in a hurry.", "name"),
    ("Lovely chat with Sofia Lindqvist yesterday evening.", "name"),
    ("the person on the line was Miguel Ortega, very patient", "name"),
    ("Gestern hat Katharina Vogel mich zurückgerufen.", "name"),
    ("Monsieur Lefèvre, Antoine m'a répondu trop tard.", 'name'),
    ("Hoy me atendió Lucía Fernández sin ganas.", "name"),
    ("Quem resolveu foi João Pereira, nota dez.", "name"),
    ("Помогла только Ирина Соколова, спасибо ей.", "name"),
    ("Everything fixed thanks to Deepak Chauhan :)", "name"),
    ("Escalated to Dr. Nakamura without any result.", "name"),
    ("Nobody but Emily Watson bothered to explain it.", "name"),
    ("Best,\nOliver Grant", "name"),
    ("Shame on Peter Novak for that tone.", "name"),
    ("I can be found at lena.hoffmann@posteo.example most days.", "email"),
    ("Forward everything to r_patel77 (at) inbox (dot) example", "email"),
    ("my account mail MARTA.K@WEBPOST.EXAMPLE is not recognised", "email"),
    ("Schreiben Sie einfach an kunde-42@firma.example zurück", "email"),
    ("Wrong recipient: support+old@shop.example got my statement", "email"),
    ("Escriba a ana.gil@correo.example cuando quiera", "email"),
    ("to: ivan dot petrov at pochta dot example", "email"),
    ("Bounce from no.body@nowhere.example again", "email"),
    ("Envoyez la facture sur jeanne@courriel.example", "email"),
    ("e-mail tom @ office.example please", "email"),
    ("Best time to catch me is mornings, 0171 5550143.", "phone"),
    ("Give us a ring: (020) 7946-0321", "phone"),
    ("Hotline never answered my +49 30 901820 calls", "phone"),
    ("you may contact 98450 12345 after lunch", "phone"),
    ("I left +1 415-555-2671 as callback twice", "phone"),
    ("Mein Anschluss lautet 0221 4710 815, bitte melden", "phone"),
    ("Mon numéro est le 06 12 34 56 78", "phone"),
    ("marquen el 612 345 678 cuando puedan", "phone"),
    ("me chamem no (11) 98765-4321", "phone"),
    ("Наберите 8 (912) 345-67-89 вечером", "phone"),
    ("nine eight four five oh one two three four five is my phone", "phone"),
    ("SMS to +44 7700 900123 never arrived", "phone"),
    ("my aadhar no is 1234 5678 9012", "id_number"),
    ("The clerk copied my passport Z4839201 by hand.", "id_number"),
    ("You leaked card 4111 1111 1111 1111 to the whole branch", "id_number"),
    ("SSN 078-05-1120 was visible on screen", "id_number"),
    ("PAN BNZPM2501F does not verify", "id_number"),
    ("Überweisung von DE89 3704 0044 0532 0130 00 fehlt", "id_number"),
    ("GB29 NWBK 6016 1331 9268 19 is the IBAN you asked for", "id_number"),
    ("Meu CPF 529.982.247-25 aparece para todos", "id_number"),
    ("El DNI 12345678Z no coincide", "id_number"),
    ("Bank a/c: account 003412345678 frozen", "id_number"),
    ("National insurance QQ 12 34 56 C rejected, identity not proven", "id_number"),
    ("ИНН 770708389312 указан неверно", "id_number"),
    ("carte 5500-0055-5555-5559 refusée", "id_number"),
    ("driver's license number D1234567 got scanned", 'id_number'),
    ("My place is 221B Oxford Circus, London.", "address"),
    ("Statement went to 14 Rosewood Drive, Leeds instead.", "address"),
    ("Card posted to 7 Elm Court, Springfield 62704", "address"),
    ("They wanted proof for 88 Lakeview Terrace, Austin", "address"),
    ("Unser Büro: Lindenstraße 12, 10969 Berlin", "address"),
    ("Chez nous c'est 25 rue de la Paix, 75002 Paris", 'address'),
    ("La oficina queda en Calle Mayor 15, 28013 Madrid", "address"),
    ("Fica na Rua Augusta, 1200, São Paulo", "address"),
    ("Квартира на ул. Ленина, д. 5, Казань", "address"),
    ("Flat 302, Tower B, Sunrise Residency, Sector 21, Gurgaon is where I stay", "address"),
    ("45/a nehru road pune 411001 is correct", "address"),
    ('Invoice 123-45-6789 remains unpaid.', None),
    ('Outage 2024-05-17 10:30 until 2024-05-18 02:15.', None),
    ('Ticket INC0012345 closed without a word', None),
    ('Balance shows 1,234,567.89 instead of 12,345.67', None),
    ('Use code 884 213 to log in, it said', None),
    ('Version 12.4.1.2201 eats battery', None),
    ('The Morning Star widget is gone', None),
    ('New York trips work, New Delhi trips do not.', None),
    ('Follow @fin_helper_22 for updates', None),
    ('I waited 45 days on a quiet road for nothing', None),
    ('Thanks to everybody at Customer Care', None),
    ('Great App Very Useful', None),
    ('Samsung Galaxy owners beware', None),
    ('Black Friday offer was fake', None),
    ('order #20240517001 lost in transit', None),
    ('Rated five stars by six friends and one critic', None),
    ('Dark Mode and Face Unlock are missing', None),
    ('Die neue Version stürzt beim Start ab.', None),
    ('Fehler 0x80070057 seit gestern', None),
    ('El Fondo Indexado rinde poco', None),
]


@pytest.fixture(scope="module")
def trained(spark, data):
    path = data.replace("sf0.001", "sf0.01")
    raw, clean = (spark.read.parquet(f"{path}/{t}.parquet") for t in ("raw_review", "clean_review"))
    return personal.fitted_finder(raw.select(raw.body.alias("text")).unionByName(raw.select(raw.title.alias("text"))).unionByName(clean.select("text")))


def test_wordings_are_held_out():
    said = {p.strip(" .,:;!\n").lower() for homes in personal.HOMES.values() for h in homes for p in h.split("{}") if len(p.strip(" .,:;!\n").split()) > 2}
    assert not [t for t, _ in HELD_OUT if any(p in t.lower() for p in said)]


def test_items_in_held_out_wordings(trained):
    hit, wrong, missed = Counter(), Counter(), Counter()
    for (text, kind), spans in zip(HELD_OUT, trained.spans([personal.plain(t) for t, _ in HELD_OUT])):
        found = {k for *_, k in spans}
        hit.update(found & {kind})
        wrong.update(found - {kind})
        missed.update({kind} - found - {None})
    figures = {k: (hit[k] / max(1, hit[k] + missed[k]), hit[k] / max(1, hit[k] + wrong[k])) for k in personal.KINDS}
    print(figures)
    for kind in ("email", "phone", "id_number", "address"):
        assert min(figures[kind]) >= 0.9, (kind, figures[kind])
    assert figures["name"][0] >= 0.7 and figures["name"][1] >= 0.8, figures["name"]


@pytest.mark.parametrize("text", ["My colleague Priya Raman", "Rahul Mehta from billing", "ask John Carter", "Kudos to Ananya Iyer!", "221B Oxford Circus, London is my address"])
def test_names_and_places_without_a_listed_cue(trained, text):
    assert trained.spans([text])[0]


def test_numbers_that_are_no_items(trained):
    for text in ("Invoice 123-45-6789 is open", "down since 2024-05-17 10", "paid 1,234,567.89 in total"):
        assert not trained.spans([text])[0], text


def test_all_texts_are_counted_and_looked_at(spark, monkeypatch):
    """Far more texts than weigh as one: shares, pairs and the names proposed are those of all of them, not of a sample."""
    monkeypatch.setattr(personal, "FLUSH", 50, raising=False)
    said = [f"The Quelmar Zostin {w} app is quite good. I like it {i} times. Nothing else to say here." for i in range(150) for w in ("red", "blue", "grey", "pink")]
    said += [f"Number {i} of all is slow." for i in range(60)] * 2 + [None, ""]
    different = {t for t in said if t is not None}
    rows = spark.createDataFrame([(t,) for t in said], "text string").repartition(5)
    n, scale = len(different), len(said) / 60
    finder = personal.fitted_finder(rows, 60)
    lows = [personal._WORD.findall(t.lower()) for t in different]
    counts = [Counter(w for t in different for w in personal.plain_words(t)), Counter(w for ws in lows for w in set(ws)), Counter(p for ws in lows for p in {f"{a} {b}" for a, b in zip(ws, ws[1:])})]
    want = [{k: c / n for k, c in count.items() if c >= least} for count, least in zip(counts, (3, 3, 6 * scale))]
    assert [finder.share, finder.every, finder.pairs] == want and "quelmar zostin" in finder.pairs
    alone, often, surroundings = personal._alone(personal._plain_texts(rows), finder, scale)
    calm = Counter(s for s in personal._sentences(sorted(different)) if finder.calm(s) is not None)
    proposed = [(personal._said(s[a:b]), k) for s, k in calm.items() for a, b, _ in finder.calm(s)]
    assert alone["n"].sum() == sum(k for _, k in proposed) > 0
    assert often == {w: k / scale for w, k in sum((Counter({w: k}) for w, k in proposed if w), Counter()).items() if k > 3 * scale}
    assert Counter(surroundings) == calm  # few enough to take each as often as it is there


ODD = ["O’Neil, Jürgen M. Müller", "App. It Works", "ΣΑΣ ΟΔΟΣ Όδος ΣΑΣ", "4Word 'Word a'Word Foo,\tBar", "iPhone Max Pro Ünal", "QQ 12 34 56 C", "x1234567", "ab12 cdef ghij", "+(1234567", "1.2.3.4.5.6.7", "Ring 12", "a. \n b. c!  d\n\n  some more. ", "one, two three four five six seven", "नमस्ते राहुल।  ठीक है", "BNZPM 2501F", ""]


def odd_texts() -> list[str]:
    rng = random.Random(5)
    pieces = [*"aB1 .,'-_@(/)+\n\t’éÉΣс9।", "at", "dot", " Rd", " 12", "Mr. ", "Flat ", "street", "straße ", "Ab Cd", "12345", "two "]
    return [personal.plain(t) for t in ODD + ["".join(rng.choices(pieces, k=rng.randint(1, 40))) for _ in range(4000)]]


def test_nothing_is_missed_by_looking_first():
    """What is looked for first never hides a span: the proposals are those of all generators on the whole text."""
    finder, g = personal.Finder({}), personal._GENERATORS
    for text in odd_texts():
        low = personal.lower(text)
        words = set(personal._WORD.findall(low))
        want = [(m.start(), m.end(), k) for k in ("digits", "pan", "iban", "letters") for m in g[k].finditer(low)]
        if not words.isdisjoint(personal._SPOKEN):
            want += [(m.start(), m.end(), "spelled") for m in g["spelled"].finditer(low)]
        if personal._DIGIT.search(low) and (not words.isdisjoint(personal._STREET_WORDS) or re.search("straße|strasse|gasse|weg |platz |allee |ring |ufer |damm ", low)):
            want += [(m.start(), personal._TAIL.match(low, m.end()).end(), k) for k in ("number_first", "flat", "street_first", "compound") for m in g[k].finditer(low)]
        assert sorted(s for s in finder._number_spans(low, words) if s[2] != "email") == sorted(want), text


def test_words_and_sentences_as_defined():
    capped = re.compile(r"(?<![\w'’.-])(?=[A-ZÀ-ÖØ-ÞА-ЯЁ](?:\.\s*|[\w'’-]+,?\s+)[A-ZÀ-ÖØ-ÞА-ЯЁ][\w'’-]*[^\W\d_A-ZÀ-ÖØ-ÞА-ЯЁ](?![\w'’-]))")
    for text in odd_texts():
        found = list(personal._WORD.finditer(text))
        beside = [a[0][0].isupper() and b[0][0].isupper() and not text[a.end() : b.start()].strip(" .,") for a, b in zip(found, found[1:])]
        alone = {personal.lower(m[0]) for m, before, after in zip(found, [False, *beside], [*beside, False]) if not before and not after}
        assert personal._plain_and_all_words(text) == [set() if text.isupper() else alone, set(personal._WORD.findall(personal.lower(text)))], text
        assert personal._sentences([text]) == [s.strip() for s in re.split(r"(?<=[.!?।])\s+|\n", text) if 10 <= len(s) <= 160], text
        assert personal.Finder({})._pair_places(text, text, set()) == [m.start() for m in capped.finditer(text)], text


def test_no_work_is_done_twice(trained, monkeypatch):
    """A sentence with a number is set aside without its features, and names of the same features are scored once."""
    features, scored = [], []
    monkeypatch.setattr(personal.Finder, "_features", lambda *a: features.append(a))
    assert trained.calm("Please phone 0171 5550143 tomorrow") is None and not features
    score = personal.Finder._score
    monkeypatch.setattr(personal.Finder, "_score", lambda self, rows, named: scored.extend(rows) or score(self, rows, named))
    trained._scored.clear()
    texts = [f"Kudos to Ananya {x}yer for it" for x in "BCDFGHJK"]
    assert trained.spans(texts + texts[:4]) == trained.spans(texts + texts[:4])
    assert 0 < len(scored) == len(set(scored)) < len(texts)
