from __future__ import annotations

import random
from collections import Counter

import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st

from feedloom.llm import copies, garbled, languages, leaks, lookalikes, mixing, personal
from feedloom.llm.words import words_of

# --- problem 2


@pytest.fixture(scope="module")
def finder():
    calm = ["The app is slow today.", "I waited 5 days for my report.", "Please fix this soon.", "Everything was smooth before the release.", "My parents use it too and they are lost."]
    f = personal.Finder({w: 0.1 for s in calm for w in s.lower().strip(".").split()} | {"people": 0.02, "promised": 0.02, "road": 0.02, "the": 0.5, "who": 0.1, "it": 0.3})
    return f.fit(personal.training_lines(calm, f, 5000))


@pytest.mark.parametrize(
    "text, kinds",
    [
        ("Write to me at some.body+x@mail.example.org please.", {"email"}),
        ("My mail is some_body (at) box (dot) example, nobody answered.", {"email"}),
        ("Call me on +91 98765 43210 after six.", {"phone"}),
        ("Reach me: 4 1 5 5 5 5 0 1 1 9.", {"phone"}),
        ("Call me on ６１７-５５５-０１２８ after six.", {"phone"}),
        ("They stored my Aadhaar wrongly (0406 7313 4129).", {"id_number"}),
        ("My PAN is ABCDE1234F and it was rejected.", {"id_number"}),
        ("IBAN DE00 2680 2600 2217 0442 96 blocked", {"id_number"}),
        ("I live at 49 Old Ferry St, Belapuram and the card never came.", {"address"}),
        ("Ich wohne in der Amselgrundgasse 59, 00728 Falkenrode.", {"address"}),
        ("The agent Marta Harrwick was very rude.", {"name"}),
        ("Regards, VELSHETRI, ANIKA", {"name"}),
        ("Ticket 8YZPNQA is still open.", set()),
        ("The code 446029 came after 37 minutes.", set()),
        ("Filed on 2026-03-14 and again on 02/04/2026.", set()),
        ("Charged 1,299.00 plus 18% tax, total 1,532.82.", set()),
        ("I pinged @pulse_help_27 twice.", set()),
        ("Thanks to the people who built the order screen.", set()),
        ("contact: [email] and my number [phone]", set()),
        ("", set()),
    ],
)
def test_personal_items(finder, text, kinds):
    assert {k for _, _, k in finder.spans([personal.plain(text)])[0]} == kinds


@pytest.mark.parametrize("name", ["Nadia Harrovane", "Frelstrand, Arun", "A. Corvstrand", "PAULA DRAVIVIK"])
def test_names_without_a_cue(finder, name):
    text = f"{name} was rude"
    assert finder.spans([text])[0] == [(0, len(name), "name")]
    assert any(text[a:b] == name for a, b, *_ in finder.candidates(f"{text}\nThe app is slow today."))


def test_redaction_keeps_the_rest(finder):
    text = "Ｐrоs: call me on ６１７-５５５-０１２８ after​ six — ﬁne."
    mapped = personal.plain(text)
    out = personal.redact(text, finder.spans([mapped])[0], mapped)
    assert out == "Ｐrоs: call me on [phone] after​ six — ﬁne."


def test_personal_data_rows(spark):
    rows = [("t", 1, "body", "Call me on 212-555-0164 after six."), ("t", 2, "body", None), ("t", 3, "body", ""), ("t", 4, "body", "nothing " * 20000), ("t", 1, "title", "Call me on 212-555-0164 after six.")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "tbl string, row_id long, field_name string, text string, kinds string")
    got = personal.personal_data(df).collect()
    assert {(r.row_id, r.field_name, tuple(r.kinds)) for r in got} == {(1, "body", ("phone",)), (1, "title", ("phone",))}
    assert personal.personal_data(df.limit(0)).count() == 0


# --- problem 3


def test_look_alikes(spark):
    texts = ["café bar", "café bar", "сafé bar", "ｃafé bar", "ca​fé bar", "café bar", "cafe bar", "Café bar", "café, bar", "café\tbar", "café bar", None, "", "", "ﬁne", "fine", "fine"]
    df = spark.createDataFrame([("t", i, t, i) for i, t in enumerate(texts)] + [("u", 1, "ｆine", 0)], "tbl string, row_id long, text string, mapped int")
    got = {(r.row_a, r.row_b) for r in lookalikes.look_alike_pairs(df).collect()}
    same = [[0, 1, 2, 3, 4, 5, 10], [14, 15, 16]]
    want = {(a, b) for g in same for a in g for b in g if a < b and texts[a] != texts[b]}
    assert got == want
    assert lookalikes.look_alike_pairs(df.limit(0)).count() == 0
    assert {r.canonical for r in lookalikes.look_alike_rows(df).collect()} == {min(texts[i] for i in same[0]), "fine"}


def test_look_alike_classes_in_other_scripts(spark):
    """Texts of one script fall into different coarse groups; repeated rows, nulls, very long and empty texts."""
    texts = ["यह ऐप अच्छा है", "यह\u200b ऐप अच्छा है", "यह ऐप बुरा है", "यह ऐप बुरा है", "\u0958लम", "क\u093cलम", "これは本", "これは\u2060本", "これは木", "😀😀", "😀\ufe0f😀", "😀🎉", None, "", "", "long " * 50_000, "l\u043eng " * 50_000, "가나", "\u1100\u1161\u1102\u1161", "Ⅴ", "V", "Ꭺ", "A"]
    rows = [("t", i, t) for i, t in enumerate(texts)] + [("t", 0, texts[0]), ("u", 0, texts[1])]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "tbl string, row_id long, text string, coarse string, e1 int")
    want = [{0, 1}, {4, 5}, {6, 7}, {9, 10}, {15, 16}, {17, 18}, {19, 20}, {21, 22}]
    got = lookalikes.look_alike_classes(df).collect()
    classes = {}
    for r in got:
        classes.setdefault(r.class_id, set()).add(r.row_id)
    assert sorted(map(sorted, classes.values())) == sorted(map(sorted, want))
    assert {(r.class_id, r.class_rows, r.class_texts) for r in got} == {(min(w), 2 + (0 in w), 2) for w in want}
    assert len(got) == 17  # a repeated row is there twice
    assert {(r.row_a, r.row_b) for r in lookalikes.look_alike_pairs(df).collect()} == {tuple(sorted(w)) for w in want}
    assert lookalikes.look_alike_classes(df.limit(0)).count() == 0
    coarse = df.where("row_id in (0, 2, 6, 8, 9, 11) and text is not null").select(lookalikes._coarse(lookalikes.consistent(df.text)).alias("c")).distinct()
    assert coarse.count() == 6


def test_hot_class_is_salted_without_loss(spark):
    df = spark.createDataFrame([("t", i, "ok" if i % 50 else "оk") for i in range(600)], "tbl string, row_id long, text string")
    got = {(r.row_a, r.row_b) for r in lookalikes.look_alike_pairs(df, salt_rows=40).collect()}
    assert len(got) == 12 * 588


# --- problem 5


def bag(*fields):
    return tuple(frozenset(Counter(words_of(f or "")).items()) for f in fields)


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet="aB é.,😀 न्1\n", max_size=12), max_size=12))
def test_copies_match_brute_force(spark, texts):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "seq long, text string, keep string")
    first, want = {}, set()
    for i, t in enumerate(texts):
        if words_of(t):
            keep = first.setdefault(bag(t), i)
            want |= {(keep, i)} if keep != i else set()
    assert {(r.keep, r.copy) for r in copies.copy_sets(df, "seq", ["text"]).collect()} == want


def test_fingerprints_that_collide_are_told_apart(spark, monkeypatch):
    """With a hash of the number of words only, every group is wrong at first."""
    real = copies.multiset_hash
    monkeypatch.setattr(copies, "multiset_hash", lambda fields, seed=0: [real(fields)[0], *(c.alias(n) for c, n in zip((copies.F.lit(0).cast("long"),) * 2, ("h1", "h2")))] if seed < 2 else real(fields, seed))
    rows = [(1, "a b"), (2, "c d"), (3, "B a!"), (4, "d c"), (5, "d, C"), (6, "a b"), (7, "e f")]
    got = copies.copy_sets(spark.createDataFrame(rows, "seq long, text string"), "seq", ["text"])
    assert {(r.keep, r.copy) for r in got.collect()} == {(1, 3), (1, 6), (2, 4), (2, 5)}


def test_copies_are_found_without_sorting(spark):
    df = spark.createDataFrame([(i, f"w{i // 2} x") for i in range(40)], "seq long, text string")
    plans = []
    real = copies.materialize
    try:
        copies.materialize = lambda d: plans.append(d) or real(d)
        copies.collapsed(df, "seq", ["text"]).collect()
    finally:
        copies.materialize = real
    assert len(plans) >= 5 and not any(w in p._jdf.queryExecution().executedPlan().toString() for p in plans for w in ("SortMergeJoin", "+- Sort ", "SortAggregate"))


def test_copies_of_records_and_counts(spark):
    rows = [(1, "Hello World", "a"), (2, "world, HELLO!", "A."), (3, "hello world", "b"), (4, "hello hello world", "a"), (5, None, None), (6, None, None), (7, "a", "hello world"), (2, "world, HELLO!", "A.")]
    df = spark.createDataFrame(rows, "seq long, text string, other string")
    assert {(r.keep, r.copy) for r in copies.copy_sets(df, "seq", ["text", "other"]).collect()} == {(1, 2)}
    counts = {r.seq: r.n_copies for r in copies.collapsed(df, "seq", ["text", "other"]).collect()}
    assert counts == {1: 2, 3: 1, 4: 1, 5: 1, 6: 1, 7: 1}
    assert copies.copy_sets(df.limit(0), "seq", ["text"]).count() == 0


# --- problem 6


def test_languages(spark, data):
    data = data.replace("sf0.001", "sf0.01")
    raw = spark.read.parquet(f"{data}/raw_review.parquet").select("seq", "body", "locale")
    en, de = "The search bar keeps throwing me back to the sign in page every day.", "Beim Anmelden kommt immer wieder die gleiche Fehlermeldung und dann bleibt alles weiß."
    extra = [(-1, en, None), (-2, en, "en_GB"), (-3, de, "EN"), (-4, f"{en} {de}", "de"), (-5, None, None), (-6, "", "und"), (-7, "ok", "und"), (-8, f"{de} " * 3000, " n/a "), (-9, "12345 67 89 !!! ... ??? @x #y z9", None), (None, en, None)]
    found = {(r.seq, r.lang) for r in languages.wrong_labels(raw.unionByName(spark.createDataFrame(extra, raw.schema))).where("seq < 0 or seq is null").collect()}
    assert found == {(-1, "en"), (-3, "de"), (-4, "en"), (-4, "de"), (-8, "de")}
    assert languages.wrong_labels(raw.limit(0)).count() == 0


def test_the_labelled_sample_is_never_empty_nor_unbounded(spark):
    assert languages._share(1500, 10**13) * 10**13 / 2**63 == pytest.approx(1500, rel=0.01)
    assert languages._share(1500, 10**30) == 1
    same = "The search bar keeps throwing me back to the sign in page every day."
    rows = spark.range(40_000).selectExpr("id as seq", f"if(id % 3 = 0, concat('Noch einmal von vorne angefangen am Tag ', id), '{same}') as body", "if(id % 3 = 0, 'de', 'en-US') as locale")
    texts, labels = languages.labelled_sample(rows, "body", "locale", 200, "seq")
    n = [labels.count(languages.LANGUAGES.index(x)) for x in ("en", "de")]
    assert all(120 <= k <= 280 for k in n), n
    assert len(languages.labelled_sample(rows, "body", "locale", 10)[0]) <= 2 * 10 * len(languages.LANGUAGES)


def test_language_accuracy_on_held_out_rows(spark, data):
    data = data.replace("sf0.001", "sf0.01")
    raw = spark.read.parquet(f"{data}/raw_review.parquet")
    texts, labels = languages.labelled_sample(raw, "body", "locale")
    order = list(range(len(texts)))
    random.Random(2).shuffle(order)
    assert len(order) > 1000
    cut = len(order) * 3 // 4
    model = languages.LanguageModel().fit([texts[i] for i in order[:cut]], [labels[i] for i in order[:cut]])
    seg = languages.Segmenter(model).segments([texts[i] for i in order[cut:]])
    single = [(s[0][2], labels[i]) for s, i in zip(seg, order[cut:]) if len(s) == 1 and s[0][2] >= 0]
    assert sum(a == b for a, b in single) / len(single) > 0.75  # about a tenth of the labels are wrong


# --- problem 7


def test_leaks_match_brute_force(spark):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(8, 40)))) for i in range(30)]
    docs = []
    for d in range(80):
        words = rng.choices(vocabulary, k=rng.randint(0, 120))
        if d % 2:
            _, t = rng.choice(items)
            w = t.split()
            n = rng.choice([9, 10, 11, len(w)])
            at = rng.randint(0, max(0, len(w) - n))
            words[5:5] = w[at : at + n]
        docs.append((d, rng.choice([" ", ", ", "! "]).join(words)))
    docs += [(90, None), (91, ""), (92, docs[1][1]), (93, (docs[1][1] + " ") * 50)]
    want = set()
    for i, t in items:
        w = words_of(t)
        runs = {tuple(w[s : s + 10]) for s in range(len(w) - 9)}
        for d, x in docs:
            v = words_of(x or "")
            if any(tuple(v[s : s + 10]) in runs for s in range(len(v) - 9)):
                want.add((i, d))
    items += [(40, None), (41, "too short")]
    docs_df = spark.createDataFrame([(d, x, 1) for d, x in docs], "doc_id long, text string, item_id int")
    items_df = spark.createDataFrame([(i, x, 1) for i, x in items], "item_id long, text string, doc_id int")
    got = {(r.item_id, r.doc_id) for r in leaks.leaked_items(docs_df, items_df).collect()}
    assert got == want and len(want) > 10
    assert leaks.leaked_items(docs_df, items_df.limit(0)).count() == 0
    assert leaks.leaked_items(docs_df.limit(0), items_df).count() == 0


def test_repeated_item_ids_and_shards(spark):
    words = [f"w{i}" for i in range(40)]
    items = [(1, " ".join(words[:14])), (1, " ".join(words[10:22])), (2, " ".join(words[20:35])), (3, "a b"), (4, " ".join(reversed(words[:12])))]
    docs = [(1, " ".join(words[:22]), "x"), (2, " ".join(words), "x"), (3, " ".join(words[:9]), "x")]
    docs_df = spark.createDataFrame(docs, "doc_id long, text string, runs string")
    items_df = spark.createDataFrame([(*i, "W20" if i[0] == 1 else "w99" if i[0] == 2 else None) for i in items], "item_id long, text string, answer string")
    want = {(1, 1, 8, 8), (1, 2, 8, 8), (2, 2, 6, 6)}
    for most in (100, 2):
        found = leaks.leaked_items(docs_df, items_df, shard_items=most)
        assert {tuple(r) for r in found.collect()} == want
    got = {(r.item_id, r.doc_id): r.answer_found for r in leaks.with_answers(found, docs_df, items_df, "answer").collect()}
    assert got == {(1, 1): True, (1, 2): True, (2, 2): False}


def test_wand_retrieves_all_above_threshold():
    rng = random.Random(6)
    items = [(i, " ".join(rng.choice("abcdefghijklmnop") * 2 for _ in range(25))) for i in range(120)]
    index = leaks.ItemIndex.build(items, 10)
    for _ in range(100):
        terms = {rng.choice("abcdefghijklmnop") * 2 for _ in range(rng.randint(1, 12))}
        score = Counter()
        for t in terms:
            if t in index.postings:
                for at, w in zip(*index.postings[t][:2]):
                    score[at] += w
        assert set(index.retrieve(terms)) == {i for i, s in score.items() if s >= index.need[i]}


# --- problem 8


def test_mix_reaches_shares(spark):
    rng = random.Random(8)
    rows = [(i, "word " * rng.randint(5, 60), "a" if i < 300 else "b" if i < 340 else "c" if i < 350 else None, "x") for i in range(360)]
    docs = spark.createDataFrame(rows + [(999, None, "a", "x"), (998, "", "b", "x")], "doc_id long, text string, source string, n_tokens string")
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 4), ("c", 0.1, 3), ("d", 0.1, 2), (None, 0.5, 2)], "source string, target_share double, max_repeats int")
    report = {r.source: r for r in mixing.share_report(docs, targets).where("source is not null").collect()}
    for s, want in (("a", 5 / 9), ("b", 3 / 9), ("c", 1 / 9), ("d", 0.0)):
        assert abs(report[s].actual_share - want) < 0.02
    used = mixing.mixed(docs, targets).collect()
    assert all(1 <= r.copies <= {"a": 1, "b": 4, "c": 3}[r.source] for r in used)
    assert mixing.mixed(docs.limit(0), targets).count() == 0
    assert mixing.mixed(docs, targets.limit(0)).count() == 0


# --- problem 9


@pytest.fixture(scope="module")
def restorer():
    clean = ["le café très réglé à côté naïve – “smart” ’s €12 ₹499 déjà été où", "der Übersicht über weiß zurück für schön", "Не могу войти потому что код", "यह ऐप आसान है", "pâles NÃO MAÎTRE l’ÂGE ТРЁМ"]
    count = Counter()
    for t in clean * 40:
        count.update(regex.findall(r"[\p{L}\p{M}\p{N}]+|[^\p{L}\p{M}\p{N}\x00-\x7F]", t.lower()))
    return garbled.Restorer(dict(count))


@pytest.fixture(scope="module")
def corpus_restorer(spark, data):
    """A model of the documents; the sentences below are not among them, and six of their languages are not either."""
    docs = spark.read.parquet(f"{data.replace('sf0.001', 'sf0.01')}/documents.parquet")
    return garbled.Restorer(garbled.clean_pieces(docs))


SENTENCES = {
    "en": "The “naïve” café on the corner — it’s £5 cheaper…",
    "de": "Die Überweisung wäre für Österreich später möglich, sagte Jürgen Weiß.",
    "fr": "Où est l’œuvre de l’été ? Ça coûte 12 € à Noël, déjà.",
    "es": "¿Cuándo volverá el señor Núñez? ¡Mañana!",
    "pt": "Não há opções: a aplicação não está à mão.",
    "ru": "Съешь же ещё этих мягких булок, да выпей чаю.",
    "hi": "मुझे यह पुस्तक बहुत अच्छी लगी।",
    "sv": "Får jag åka på sjön i går?",
    "pl": "Zażółć gęślą jaźń, proszę państwa.",
    "tr": "Şu çalışmayı görmeye başlıyoruz, değil mi?",
    "el": "Καλημέρα κόσμε, πώς είστε σήμερα;",
    "ja": "これは日本語の文章です。",
    "zh": "这是一个中文句子。",
}


@pytest.mark.parametrize("language", SENTENCES)
def test_whole_sentences_come_back_from_every_encoding(corpus_restorer, language):
    text = SENTENCES[language]
    assert corpus_restorer.restore_text(text) == (text, 0, 0)
    for codec in garbled.CODECS:
        got, n, lost = corpus_restorer.restore_text(garbled.garble(text, codec))
        assert (got, lost) == (text, 0) and n, (codec, got)


def test_what_stays_garbled_counts_as_lost(corpus_restorer):
    for text in ("Qw��zx", "so �����, it"):
        got, _, lost = corpus_restorer.restore_text(text)
        assert lost > 0 and "�" in got


@pytest.mark.parametrize("codec", ["cp1252", "latin-1", "mac_roman", "cp437", "cp850", "cp1251"])
@pytest.mark.parametrize("word", ["café", "très", "über", "weiß", "zurück"])
def test_round_trip(restorer, codec, word):
    assert restorer.restore_text(f"so {garbled.garble(word, codec)} it is")[:2] == (f"so {word} it is", 1)


@pytest.mark.parametrize("read", ["cp1252", "latin-1", "koi8_r", "mac_roman"])
def test_single_byte_text_in_another_encoding(restorer, read):
    text = "Не могу войти потому что код"
    got = restorer.restore_text(text.encode("cp1251").decode(read))
    assert got[0] == text and got[1] > 10


def test_lost_bytes_double_decoding_and_traps(restorer):
    assert restorer.restore_text("r�gl�")[0] == "réglé"
    assert restorer.restore_text(garbled.garble(garbled.garble("réglé", "cp1252"), "cp1252"))[0] == "réglé"
    assert restorer.restore_text("wei" + regex.sub("[\x80-\x9f]", "", garbled.garble("ß", "latin-1")))[0] == "weiß"
    for trap in ("pâles", "NÃO", "MAÎTRE", "l’ÂGE", "plain text", "ТРЁМ", ""):
        assert restorer.restore_text(trap) == (trap, 0, 0)


def test_garbled_rows(spark):
    good = [(i, "le café très réglé à côté d’un hôtel", 1) for i in range(30)]
    rows = good + [(40, garbled.garble("le café très réglé", "cp1252"), 1), (41, "lost � here", 1), (42, None, 1), (43, "", 1), (44, garbled.garble("café ", "cp437") * 5000, 1), (None, "Ã©", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, restored int")
    got = {r.doc_id: r.restored for r in garbled.garbled_documents(df).collect()}
    assert set(got) == {40, 41, 44} and got[40] == "le café très réglé" and got[44] == "café " * 5000
    assert garbled.garbled_documents(df.limit(0)).count() == 0
