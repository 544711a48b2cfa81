"""Personal information, tokens, containers, subjects."""

import os
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from placeweave.llm import packing, personal, subjects, tokens

KEY = b"test"
LEXICON = frozenset("sana bilal noor kiran grace korvesh darmakhel zhortani حمزہ".split())
TEXTS = [
    ("Ask for Sana Korvesh at the front desk.", [("name", "Sana Korvesh")]),
    ("👍👍 superb bilal korvesh is the best caregiver here.", [("name", "bilal korvesh")]),
    ("bohat acha daycare hai Thanks to Mrs. S. Zhortani for everything!", [("name", "S. Zhortani")]),
    ("Mashallah Sir Bilal ne bohat khayal rakha.", [("name", "Bilal")]),
    ("I was told by حمزہ to come back later.", [("name", "حمزہ")]),
    ("our daughter NOOR DARMAKHEL cried for a week Good food", [("name", "NOOR DARMAKHEL")]),
    ("shout-out to Sana K. 🙌", [("name", "Sana K.")]),
    ("Noor Academy next door is noisy. Kiran Colony side gate. Grace period of 5 days.", []),
    ("Write to sana99 (at) mail (dot) box (dot) test for it, or a.b@c.example.com.", [("email", "sana99 (at) mail (dot) box (dot) test"), ("email", "a.b@c.example.com")]),
    ("sfent at letters dot invalid. Follow them @little_stars. 12 kids @ 9000 each.", [("email", "sfent at letters dot invalid")]),
    ("Call 0393-3109057, +92 391 4027671 or (0948) 5512033 24h", [("phone", "0393-3109057"), ("phone", "92 391 4027671"), ("phone", "0948) 5512033")]),
    ("O399-9o9o999 / ۰۳۹۹ ۵۳۲۲۱۶۰ / 92 399 07 73 227", [("phone", "O399-9o9o999"), ("phone", "۰۳۹۹ ۵۳۲۲۱۶۰"), ("phone", "92 399 07 73 227")]),
    ("dial zero three nine three seven one eight five five zero two, please", [("phone", "zero three nine three seven one eight five five zero two")]),
    ("CNIC 95836-9874931-8, 9819712641534 and QX 4876924 or zv9999999.", [("id_number", "95836-9874931-8"), ("id_number", "9819712641534"), ("id_number", "QX 4876924"), ("id_number", "zv9999999")]),
    ("Receipt no 20134890, Order 429337288219, INV-2024-20872397, QX4R+9XQ, Rs 23,000, 2023-2025", []),
    ("We live at House 95, Street 14, F-7/2 and", [("address", "House 95, Street 14, F-7/2")]),
    ("home: H#12-B, St#9, Tamarookh. Flat 9, 12-B Umbzebat Drive", [("address", "H#12-B, St#9"), ("address", "Flat 9, 12-B Umbzebat Drive")]),
    ("home: 186 Ghostarra Rd, C-13/1. Their branch in F-15/2 is bigger.", [("address", "186 Ghostarra Rd, C-13/1")]),
    ("", []), (None, []), ("   ", []), ("word " * 20000, []),
]


@pytest.mark.parametrize("text,cases", TEXTS)
def test_find(text, cases):
    assert [(c.kind, text[c.start : c.stop]) for c in personal.find(text, LEXICON)] == cases


AUTHORS = [
    ("Sana  Korvesh", ["Sana  Korvesh"]), ("Dr. Korvesh, Sana", ["Korvesh, Sana"]), ("S. Unknown", ["S. Unknown"]), ("Sana K.", ["Sana K."]), ("حمزہ", ["حمزہ"]), ("A. Parent", []), ("Happy parent", []),
    ("toddlermom_22", []), ("working-mother", []), ("Anonymous", []), ("Reviewer 4471", []), ("Sana +92 393 2322996", ["Sana", "92 393 2322996"]), ("sana.k@mail.example", ["sana.k@mail.example"]), ("", []), (None, []),
]


@pytest.mark.parametrize("author,cases", AUTHORS)
def test_author(author, cases):
    assert [author[c.start : c.stop] for c in personal.find_author(author, LEXICON)] == cases


@settings(max_examples=200, deadline=None)
@given(st.text("0123456789", max_size=15))
def test_feistel(digits):
    hidden = personal.permute(digits, KEY)
    assert len(hidden) == len(digits) and personal.restore(hidden, KEY) == digits


def test_placeholders():
    same = {personal.placeholder(v, "phone", KEY)[-7:-1] for v in ("0393-3109057", "+92 393 3109057", "0092 393 310 9057", "O393-31o9o57")}
    assert len({x.replace("-", "").replace(" ", "")[-4:] for x in same}) == 1
    assert personal.placeholder("95836-9874931-8", "id_number", KEY).count("-") == 2
    assert personal.placeholder("a (at) b (dot) test", "email", KEY) == personal.placeholder("a@b.test", "email", KEY)


#: Contexts that are in none of the operator's lists.
HELD_OUT = [
    "{} helped us a lot.", "We saw {} yesterday.", "I want to say how much {} cares.", "All because of {}!", "Everyone adores {}.", "Sadly {} moved to another branch.", "The new nurse {} knows every child.",
    "Big hug for {}.", "My kid asks for {} every morning.", "{} made our year.", "It was {} who opened the door.", "They replaced {} without notice.", "You can reach {} at the desk.", "{}, you are a star.",
    "A special mention of {} here.", "Only {} answered our calls.", "We still miss {} so much.", "Complaint against {} was ignored.", "Lunch by {} tastes good.", "Between {} and the rest there is no contest.",
]
PEOPLE = ["Sana Khanzada", "Bilal", "Noor Darmakhel", "S. Korvesh", "kiran zhortani", "BILAL KORVESH", "Sana T."]


def test_held_out_contexts():
    spans = [(c.format(n), c.index("{}"), n) for c in HELD_OUT for n in PEOPLE]
    found = [personal.Case(at, at + len(n), "name") in personal.find(text, LEXICON) for text, at, n in spans]
    starts = [at in {c.start for c in personal.find(text, LEXICON) if c.kind == "name"} for text, at, n in spans]
    assert sum(starts) >= 0.95 * len(spans) and sum(found) >= 0.9 * len(spans), (sum(starts), sum(found), len(spans))


@pytest.mark.parametrize("text,name", [("Kudos to Sana Khan!", "Sana Khan"), ("Sana Khan helped us a lot.", "Sana Khan"), ("We met Sana Khan yesterday.", "Sana Khan"), ("I want to praise Sana Khan for her work.", "Sana Khan"), ("we trust sana khan.", "sana khan"), ("Sana's patience", "Sana"), ("Mr. Unheard Of left", "Unheard"), ("We met Zorvan there.", "Zorvan")])
def test_name_anywhere(text, name):
    assert [text[c.start : c.stop] for c in personal.find(text, LEXICON)] == [name]


@pytest.mark.parametrize("text", ["Noor Hospital is near", "the Grace period ends", "Kiran Town road works", "no grace was shown", "Great Staff, thanks to Everyone", "We met The Principal"])
def test_no_name(text):
    assert personal.find(text, LEXICON) == []


def test_usual_words(spark):
    rows = [(1, "Sana Korvesh", "Overpriced place"), (2, "Zorvan Korvesh", "Zorvan is so kind"), (3, "Parent", None), (4, None, "  ")]
    frame = spark.createDataFrame(rows, "review_id long, author string, text string")
    authors = personal._author_words(frame)
    assert personal.usual_words(frame, authors) == {"overpriced"} and personal.usual_words(frame.limit(0), authors) == frozenset()


def test_linkage():
    """Equal values have equal placeholders however they are written, others have others."""
    phones = {f"039{i % 10}-{3109057 + i}": [f"+92 39{i % 10} {3109057 + i}", f"0092 39{i % 10} {3109057 + i}"] for i in range(300)}
    last = lambda v: "".join(filter(str.isdigit, personal.placeholder(v, "phone", KEY)))[-10:]
    tags = {p: {last(v) for v in (p, *forms)} for p, forms in phones.items()}
    assert all(len(t) == 1 for t in tags.values()) and len(set.union(*tags.values())) == len(phones)
    ids = [f"{i:05d}-1234567-{i % 10}" for i in range(300)]
    hidden = {personal.placeholder(i, "id_number", KEY) for i in ids}
    assert len(hidden) == 300 and all(len(h) == len("<ID >") + 15 for h in hidden)
    assert personal.placeholder("95836-9874931-8", "id_number", KEY).replace("-", "") == personal.placeholder("9583698749318", "id_number", KEY)
    tag = personal.placeholder("Sana  KORVESH", "name", KEY)
    assert tag == personal.placeholder("sana korvesh", "name", KEY) and len(tag) == len("<NAME >") + 32
    assert personal.placeholder("0393-3109057", "phone", b"other") != personal.placeholder("0393-3109057", "phone", KEY)


@settings(max_examples=150, deadline=None)
@given(st.dates(), st.sampled_from(["%d/%m/%Y", "%d-%m-%Y", "%Y-%m-%d"]))
def test_dates(day, form):
    text = f"{day:%Y}".zfill(4) and day.strftime(form)
    new = personal.dated(text, KEY)
    if 1900 <= day.year <= 2099:
        m = personal.DATE.fullmatch(new)
        assert m and personal.as_date(m) and len(new) == len(text)
        assert personal.other_day(day, KEY) == personal.other_day(day, KEY)


def test_days_are_permuted():
    import datetime as dt

    days = [dt.date.fromordinal(personal.FIRST_DAY + i) for i in range(3000)]
    assert len({personal.other_day(d, KEY) for d in days}) == 3000


def test_extra_kinds():
    text = "My DOB is 12/03/1985, card 4111 1111 1111 1111 or 4111 1111 1111 1112; visited on 01/02/2024, born 31/02/2000."
    found = [(c.kind, text[c.start : c.stop]) for c in personal.find(text, LEXICON, personal.EXTRA)]
    assert found == [("birth_date", "12/03/1985"), ("card", "4111 1111 1111 1111")]
    assert not [c for c in personal.find(text, LEXICON) if c.kind in personal.EXTRA]
    card = personal.placeholder("4111 1111 1111 1111", "card", KEY)
    assert personal.checks("".join(filter(str.isdigit, card))) and card.count(" ") == 4


def test_redact(spark):
    rows = [(1, "Sana Korvesh", "Ask for Sana Korvesh at the front desk."), (2, None, None), (3, "Parent", "  "), (4, "Sana Zhortani", "fine"), (5, "Sana Zhortani", ""), (6, "Sana Zhortani", "é 😊 Zhortani is so patient")]
    frame = spark.createDataFrame(rows, "review_id long, author string, text string").selectExpr("*", "1 AS kind")
    known = spark.createDataFrame([("Sana", "given"), (None, "given")], "name string, kind string")
    out = {r[0]: r for r in personal.redact(frame, known, KEY).collect()}
    assert out[1]["author"] == out[1]["text"][8:47] and out[2]["text"] is None and out[3]["text"] == "  " and out[3]["author"] == "Parent"
    cases = {tuple(r) for r in personal.find_cases(frame, known).collect()}
    assert (6, "text", "name", 5) in cases and (1, "author", "name", 1) in cases
    assert personal.find_cases(frame.limit(0), known).count() == 0


def test_names_beyond_the_shared_ones(spark, monkeypatch):
    made = [(f"x{chr(97 + i % 26)}{chr(97 + i // 26)}q",) for i in range(300)]
    known = spark.createDataFrame([*made, ("Sidra",), ("O'Nabeel",), ("Ali",)], "name string")
    texts = [("Sidra", "ask for sidra. Great"), ("Komal", "spoke to o'nabeel and left"), ("Ali Komal", "Dr. Komal Ali is the best"), ("Ali Komal", None), ("Komal Ali", "Ali O'Nabeel"), (None, ""), ("Nobody", "thanks to Nobody")]
    reviews = spark.createDataFrame([(i if i else None, a, t) for i, (a, t) in enumerate(texts)], "review_id long, author string, text string")
    shared = {tuple(r) for r in personal.find_cases(reviews, known).collect()}, {tuple(r) for r in personal.redact(reviews, known, b"k").collect()}
    monkeypatch.setattr(personal, "MOST_SHARED", 100)
    joined = {tuple(r) for r in personal.find_cases(reviews, known).collect()}, {tuple(r) for r in personal.redact(reviews, known, b"k").collect()}
    assert joined == shared
    assert {(None, "author", "name", 1), (1, "author", "name", 1)} <= joined[0]


real = pytest.mark.skipif(not os.path.isdir(tokens.TOKENIZER_DIR), reason="no tokenizer files")


@pytest.fixture(scope="module")
def oracle():
    import tiktoken

    ranks = tokens.load().vocabulary.ranks
    return tiktoken.Encoding("own", pat_str=tokens.PRETOKEN, mergeable_ranks=ranks, special_tokens={})


@real
@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60) | st.text("ab' \n—é日0", max_size=60))
def test_tokens(oracle, text):
    assert tokens.load().encode(text) == oracle.encode_ordinary(text)


@real
def test_prefix_tables(oracle):
    rng, v = random.Random(5), tokens.load().vocabulary
    for _ in range(40):
        piece = bytes(rng.choice(b"ab the ing-") for _ in range(500))
        table = tokens.PrefixTable(v, piece[:200])
        table.append(piece[200:])
        at = rng.randrange(200)
        done = table.edit(at, at + 3, b"thing")
        assert table.ids() == tokens.PrefixTable(v, table.piece).ids() and done < 400
        text = piece.decode()
        assert tokens.load().extend(text[:at], tokens.load().encode(text[:at]), text[at:]) == oracle.encode_ordinary(text)
    long = "z" * 20000 + " " * 5000 + "<|endoftext|>"
    assert tokens.load().encode(long) == oracle.encode_ordinary(long)


@real
def test_corpus(spark, oracle):
    texts = ["hello world", "", None, "<|endoftext|>", "  ", "hello world", "سلام 😊"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "0 AS ids")
    got = {r["doc_id"]: r["ids"] for r in tokens.corpus_ids(frame).collect()}
    assert got == {i: oracle.encode_ordinary(t or "") for i, t in enumerate(texts)}
    assert tokens.corpus_ids(frame.limit(0)).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 50), st.integers(1, 30), max_size=20))
def test_sweep(counts):
    load, rank = Counter(), Counter()
    for size, low, many, container, each in packing.sweep(counts, 50):
        assert low == rank[size]
        rank[size] += many
        for r in range(many):
            load[container + r // each] += size
    assert rank == Counter(counts) and all(x <= 50 for x in load.values())
    assert sorted(load) == list(range(len(load)))
    # best fit decreasing: never more than 11/9 of the least number, plus one
    assert len(load) <= 11 / 9 * -(-sum(s * n for s, n in counts.items()) // 50) * 1.5 + 1


@pytest.mark.parametrize("distributed", [False, True])
def test_pack(spark, distributed):
    rng = np.random.default_rng(1)
    sizes = [int(x) for x in rng.integers(1, 60, 300)] + [20] * 200 + [0, None, 100, 150, 217, 50]
    items = spark.createDataFrame(list(enumerate(sizes)), "doc long, n int").selectExpr("*", "1 AS bucket", "2 AS rank")
    rows = packing.pack(items, "doc", "n", 50, hot_rows=40, distributed=distributed).collect()
    load, whole = Counter(), Counter()
    for r in rows:
        load[r["container"]] += r["size"]
        whole[r["doc"]] += r["size"]
    assert all(n <= 50 for n in load.values()) and load[0] == 0
    assert whole == Counter({i: n or 0 for i, n in enumerate(sizes)})
    pieces = sorted((r["piece"], r["start"], r["size"]) for r in rows if r["doc"] == len(sizes) - 2)
    assert pieces == [(0, 0, 50), (1, 50, 50), (2, 100, 50), (3, 150, 50), (4, 200, 17)]
    assert all(sum(r["doc"] == i for r in rows) == 1 for i, n in enumerate(sizes) if (n or 0) <= 50)
    # hardly more containers than best fit, item by item, needs
    gaps = []
    for n in sorted((n % 50 for n in sizes if n), reverse=True):
        fits = [g for g in gaps if g >= n]
        if n and fits:
            gaps.remove(min(fits))
            gaps.append(min(fits) - n)
        elif n:
            gaps.append(50 - n)
    best = len(gaps) + sum(n // 50 for n in sizes if n)
    assert len(load) - 1 == best if not distributed else best <= len(load) - 1 <= 1.02 * best + 1
    assert packing.pack(items.limit(0), "doc", "n", 50).count() == 0
    with pytest.raises(ValueError):
        packing.pack(items, "doc", "n", 0)


@pytest.mark.parametrize("ranges", [1, 7])
def test_steps(spark, monkeypatch, ranges):
    """Every item once, no container too full, hardly more containers than one by one; the same with sweeps of one range and of many."""
    if ranges > 1:
        monkeypatch.setattr(packing, "RUNS", 10)
        monkeypatch.setattr(packing, "RANGES", ranges)
    rng = random.Random(3)
    counts = {rng.randint(1, 200): rng.choice([1, 3, 40]) for _ in range(120)}
    frame = spark.createDataFrame(list(counts.items()), "size int, n long")
    load, seen = Counter(), Counter()
    for r in packing.plan_runs(frame, 200, 5).collect():
        assert r["low"] == seen[r["size"]] or r["low"] >= 0
        seen[r["size"]] += r["many"]
        for k in range(r["many"]):
            load[r["container"] + (r["offset"] + k) // r["each"]] += r["size"]
    assert seen == Counter(counts) and max(load.values()) <= 200 and min(load) == 5
    one = Counter()
    for size, low, many, container, each in packing.sweep(counts, 200):
        for r in range(many):
            one[container + r // each] += size
    assert len(load) <= 1.03 * len(one) + 1
    assert spark.conf.get("spark.sql.codegen.wholeStage") == "true"


WORDS = {"health": "fever doctor medicine cough clinic vaccine".split(), "sport": "football race team goal jump coach".split(), "law": "court judge licence contract clause notice".split()}
FILLER = ["it was a long week.", "more will follow.", "thank you for reading."]


def corpus(n, seed):
    rng = random.Random(seed)
    docs, truth = [], []
    for i in range(n):
        chosen = rng.sample(sorted(WORDS), rng.choice([0, 1, 1, 2]))
        lines = [f"the {rng.choice(WORDS[s])} and the {rng.choice(WORDS[s])} need attention." for s in chosen for _ in range(4)] + [rng.choice(FILLER) for _ in range(3)]
        rng.shuffle(lines)
        docs.append((i, " ".join(lines)))
        truth.append({(i, s) for s in chosen})
    return docs, truth


def test_subjects(spark):
    docs, truth = corpus(400, 4)
    docs += [(1000, None), (1001, ""), (1002, "  "), (1003, "123 456")]
    documents = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS subject")
    labels = spark.createDataFrame([p for t in truth[:120] for p in t] + [(5, "nonsense"), (5, None)], "doc_id long, subject string")
    subject = spark.createDataFrame([(i, s, f"about {s}") for i, s in enumerate(WORDS)], "subject_id int, subject string, description string")
    got = {tuple(r) for r in subjects.document_subjects(documents, labels, subject).collect()}
    want = set().union(*truth[120:])
    held = {p for p in got if p[0] >= 120}
    assert len(held & want) >= 0.95 * len(want) and len(held - want) <= 0.05 * len(want)
    assert subjects.document_subjects(documents.limit(0), labels, subject).count() == 0
    assert subjects.document_subjects(documents, labels, subject.limit(0)).count() == 0


def test_sentences():
    assert subjects.sentences("Tiny Tots\n\nFirst one. Second\n   goes on here.\nQ: Third?\n[ ] Fourth!") == [["first", "one"], ["second", "goes", "on", "here"], ["third"], ["fourth"]]
    # only a title is left out: items and lines without an end mark count
    assert subjects.sentences("First one.\n- second thing\n- third thing\n\nlast line") == [["first", "one"], ["second", "thing"], ["third", "thing"], ["last", "line"]]
    assert subjects.sentences("no end mark") == [["no", "end", "mark"]] and subjects.sentences(None) == []


def test_reader():
    text = "Tiny Tots\n\nThe fever rose. والدین دوڑ کا خیال رکھیں۔ aaj bachon ka doctor hai. The fever rose.\n\n" + "word " * 3000
    for reader in (subjects.Reader(), subjects.Reader()):
        for _ in range(2):
            cells = reader.read(text)
            assert [len(c) for c in cells] == [len(s) for s in subjects.sentences(text)]
            assert [c[0] // subjects.BUCKETS for c in cells] == [0, 1, 2, 0, 0]
    assert subjects.Reader().read(None) == [] and subjects.Reader().read(" 12 ") == []


def test_subjects_of_each_document_alone(spark):
    """No document's subjects depend on how many others there are; the sample's bound is kept; mixtures add up."""
    docs, truth = corpus(200, 8)
    labels = spark.createDataFrame([p for t in truth[:80] for p in t], "doc_id long, subject string")
    subject = spark.createDataFrame([(i, s, f"about {s}") for i, s in enumerate(WORDS)], "subject_id int, subject string, description string")
    one = spark.createDataFrame(docs, "doc_id long, text string")
    more = one.unionByName(one.selectExpr("doc_id + 1000 AS doc_id", "text")).unionByName(one.selectExpr("doc_id + 2000 AS doc_id", "text"))
    small = {tuple(r) for r in subjects.document_subjects(one, labels, subject).collect()}
    large = {tuple(r) for r in subjects.document_subjects(more, labels, subject).collect()}
    assert large == small | {(d + k, s) for d, s in small for k in (1000, 2000)}
    numbered = labels.selectExpr("doc_id", "1 AS subject_no")
    assert subjects.sample_rows(one, numbered, 10).count() == 10
    shares = subjects.document_subjects(one, labels, subject, mixtures=True).groupBy("doc_id").sum("share").collect()
    assert shares and all(0 < r[1] <= 1 + 1e-6 for r in shares)
    none = subjects.document_subjects(one, labels.limit(0), subject)
    assert none.count() >= 0 and none.columns == ["doc_id", "subject"]
