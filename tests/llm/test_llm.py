"""Operators for training text: small fixtures, brute force, exact round trips, held-out accuracy."""

from __future__ import annotations

import itertools
import os
import random
import time
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import bpe, encode, formatdup, mixing, packing, pairs, pii, readability, splitoverlap, tokenbudget, tokens
from sparkloom.llm.align import containment, lcs_length
from sparkloom.llm.canonical import canonical_letters, canonical_words, fields, role_of
from sparkloom.llm.lang import language_of
from sparkloom.llm.trees import Boosted

TOKENIZER = Path(tokens.TOKENIZER)
needs_tokenizer = pytest.mark.skipif(not TOKENIZER.exists(), reason="no tokenizer files")
needs_data = pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
LONG = "word " * 40_000

# --- Canonical forms and alignment ----------------------------------------------------


def test_canonical_forms():
    assert canonical_letters("Ab, c!\n​1 É") == ("abc1é",) * 2 == canonical_letters("aB C 1 é.")
    a, b = "Age: 41\nSex: female; x\nSite: toe", "site : TOE\nage: 41\nSEX: female; X"
    assert canonical_letters(a)[1] == canonical_letters(b)[1] and canonical_letters(a)[0] != canonical_letters(b)[0]
    assert canonical_letters("Age: 41 | Sex: f")[1] == canonical_letters("Sex: f; Age: 41")[1]
    assert fields("hello\nage: 4\nsex: f") is None and fields("one: line") is None
    assert canonical_letters(None) == ("", "") and canonical_words(None) == [] and canonical_words("") == []
    assert canonical_words("b: 2\na: 1") == canonical_words("A: 1; B: 2") == ["a", "1", "b", "2"]
    assert canonical_letters("कि")[0] != canonical_letters("का")[0] and canonical_letters("नमस्ते, दुनिया!") == canonical_letters("नमस्ते दुनिया") != canonical_letters("नमसत दनय")
    assert canonical_words("ที่นี่ a❤️b e\u0301té") == ["ที่นี่", "a", "b", "été"] and canonical_letters("قَلَم")[0] != canonical_letters("قلم")[0] and canonical_letters("don´t ¨") == canonical_letters("don't")
    assert role_of(" User\n") == "user" and role_of(None) == ""


def test_lcs_against_the_table_of_all_prefixes():
    rng = random.Random(1)
    for _ in range(300):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 12))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, j in itertools.product(range(len(a)), range(len(b))):
            table[i + 1][j + 1] = table[i][j] + 1 if a[i] == b[j] else max(table[i][j + 1], table[i + 1][j])
        assert lcs_length(a, b) == table[-1][-1]
    assert containment("abc", "xabcx", 3) == 1.0 and containment("", "a", 2) == 0.0


def test_languages():
    assert [language_of(t) for t in ("This is the house.", "El perro y la casa son de mi madre.", "Je ne sais pas où il est.", "Das ist nicht mein Haus.", "Это мой дом", "我的房子", "123", "", None)] == [
        "en", "es", "fr", "de", "ru", "zh", "und", "und", "und"
    ]


# --- p1 -------------------------------------------------------------------------------

PII = [
    ("Write to jane.doe+x@mail.example.org today.", ["email"]), ("It is jane AT mail DOT example DOT org", ["email"]), ("jane (dot) doe [at] mail [dot] example", ["email"]), ("a @ b", []),
    ("Call (217) 555-0108 or +44 7700 900 581.", ["phone", "phone"]), ("three one seven, five five five, zero one eight two", ["phone"]), ("Tel 06 39 98 43 74", ["phone"]), ("(on 217-555-0108)", ["phone"]),
    ("My SSN is 954-46-3497.", ["idnum"]), ("Policy D000968310 covers it", ["idnum"]), ("Patient: Ada Marlow, MRN: 00245317.", ["name", "idnum"]), ("SSN 999 238 5288 was on the form", ["idnum"]),
    ("I live at 205 Monathal Court, Stonely.", ["address"]), ("P.O. Box 413, Ashford", ["address"]), ("82 rue de Corme, 92277 Ville", ["address"]), ("calle Alta 26, 6º B, 14585 Villa", ["address"]), ("Gartenweg 12, 13592 Stadt", ["address"]),
    ("My name is Nils Dalert.", ["name"]), ("Spoke with RUTH GARIN on Monday", ["name"]), ("I saw Dr. Radovik", ["name"]), ("signed by kofi kelin today", ["name"]), ("This is about Wenos, Elena, who lives with us", ["name"]),
    ("page 284-7065, batch 3250-85, lot 20912-B, protocol NX-2612, form 12B-6, code 78.8", []), ("platelets of 436,000-238,500 and a pressure of 447/46, chapter 8.49.8, a 30-60-90 day review", []),
    ("the Norenbury scale, Joravik disease type 2 and a positive Penamoor sign", []), ("take 400 mg for 30 days at age 68", []), ("You Are A Careful Assistant For Health Questions.", []), ("Ask your doctor. They know best at once.\n\nContact us", []),
    ("IP 192.168.1.10, BP 120/80, during 5 days, Monitoring 24 hours", []), ("card 4111 1111 1111 1111, account DE89 3704 0044 0532 0130 00", ["idnum", "idnum"]), ("item 4111 1111 1111 1112 of 3", []), ("call 999-555-1234-22", ["phone"]),
    ("The patient Oluwaseun Adeyemi came", ["name"]), ("Patient: Ива Петрова", ["name"]), ("I saw Dr. Dvořák", ["name"]), ("x" * 70 + ".a@mail.example", ["email"]), ("a@-.example and a@" + "b" * 64 + ".example", []), ("BP 413, 92277 Ville", ["address"]),
    ("", []),
]


@pytest.mark.parametrize(("text", "kinds"), PII)
def test_pii(text, kinds):
    assert sorted(k for _, _, k in pii.find_pii(text)) == sorted(kinds)


def test_redaction_keeps_the_rest():
    assert pii.redact("Mail a.b@c.example, or call 217-555-0108!") == "Mail [EMAIL], or call [PHONE]!"
    text = LONG + "x@y.example " + LONG
    assert pii.redact(text) == text.replace("x@y.example", "[EMAIL]")
    assert pii.redact("İ am Dr Radovik") == "İ am [NAME]"


@pytest.mark.parametrize("unit", ["0f9a", "aB3_-", "@", "a@", "a at b dot c ", "7", "12 ", "Ana Mary ", "AB", "(", "12 Aaaa Bbbb Street ", "A. ", "Ana Marlow\n", "one two ", " st ", "policy 12345678 "])
def test_pii_takes_time_in_proportion(unit):
    took = []
    for n in (100_000, 400_000):
        text = "x@y.example " + unit * (n // len(unit)) + "@mail.example"
        began = time.process_time()
        pii.find_pii(text)
        took.append(time.process_time() - began)
    assert took[1] < 8 * took[0] + 0.5


def test_pii_rows(spark, records):
    df = records([(1, [("user", "a@b.example and c@d.example"), (None, None), ("assistant", "217-555-0108")]), (2, None), (3, []), (1, [("user", "a@b.example")]), (4, [None])], extra="1 as kind;2 as msg_idx")
    assert sorted(map(tuple, pii.pii_kinds(df).collect())) == [(1, 0, "email"), (1, 0, "email"), (1, 2, "phone")]
    assert [r.messages if r.messages is None else [m.content for m in r.messages] for r in pii.redact_messages(df.where("record_id = 1 or record_id = 2")).orderBy("record_id").collect()].count(None) == 1
    assert pii.pii_kinds(df.limit(0)).count() == 0


# --- p2 -------------------------------------------------------------------------------

Q = "My knee hurts in the morning and I do not know what to do about it, please help me."
GOOD = "You should rest the knee for some days and then take a short walk each evening."


def defects(spark, records, *dialogues):
    df = records([(i, d) for i, d in enumerate(dialogues)], extra="'x' as defect;1 as key")
    out: dict[int, set] = {}
    for r in pairs.pair_defects(df).collect():
        out.setdefault(r.record_id, set()).add(r.defect)
    return [out.get(i, set()) for i in range(len(dialogues))]


def test_defects(spark, records):
    u, a = (lambda t: ("user", t)), (lambda t: ("assistant", t))
    got = defects(
        spark, records,
        [u(Q), a(GOOD)], [u(Q)], [u(Q), a(None)], [u(Q), a(" n/a ")], [u(Q), a("I'm sorry, but I can't help with that request. Please consult a qualified professional.")],
        [u(Q), a("I cannot examine you from here, but rest the knee and come back in two weeks.")], [u(Q), a("You asked: " + Q.upper().replace(",", ""))],
        [u(Q), a("Debería descansar la rodilla durante unos días y luego caminar un poco cada tarde.")], [u(Q + " Please answer in Spanish."), a("Debería descansar la rodilla durante unos días y luego caminar.")],
        None, [], [("system", "x")], [u(None), a(GOOD)], [(" User ", Q), ("ASSISTANT", GOOD), u(Q)], [u(Q), a(LONG + "end.")],
    )
    assert got == [set(), {"empty"}, {"empty"}, {"empty"}, {"refusal"}, set(), {"copied"}, {"wrong_language"}, set(), set(), set(), set(), set(), {"empty"}, set()]


def test_truncated(spark, records):
    whole = ["Rest the knee for a week. Then keep a food diary.", "Please keep a food diary. Rest the knee.", "Keep the knee warm and keep a food diary.", "It helps to keep a food diary. Call me.", "Use ice.\n- keep a food diary\n- rest the knee\nCall me."]
    ends = ["Rest now. You should keep a food diary", "Rest now. You should keep a foo", "Rest now. You should keep the", "Rest now. Take care", "Rest now. You should keep the…"]
    got = defects(spark, records, *[[("user", Q), ("assistant", t)] for t in whole * 3 + ends])
    assert got[:15] == [set()] * 15 and got[15:] == [set(), {"truncated"}, {"truncated"}, set(), {"truncated"}]
    assert pairs.pair_defects(records([]).limit(0)).count() == 0


def test_truncated_alike(spark, records):
    whole = ["Rest the knee for a week. Then keep a food diary.", "It helps to keep a food diary. Call me."]
    ends = ["Rest now. You should keep a foo"] * 6 + [f"Do {i} things. 3. Please take the" for i in range(8)]  # one cut answer delivered again, and cuts of a template
    got = defects(spark, records, *[[("user", Q), ("assistant", t)] for t in whole * 5 + ends])
    assert got == [set()] * 10 + [{"truncated"}] * 14


def test_ends_inside_a_sentence(spark, records):
    whole = ["Rest the knee for a week. Then keep a food diary.", "It helps to keep a food diary. Call me."]
    ends = ["Please keep a food diary (for example", "Please keep a food diary,", "Please keep a food diary –", "Take care of it (and keep a food diary)", "Keep a food diary :(", "All is (well. Keep a food diary", "Keep it.\nBest wishes,"]
    got = defects(spark, records, *[[("user", Q), ("assistant", t)] for t in whole * 5 + ends])
    assert got[10:] == [{"truncated"}] * 3 + [set()] * 4


def test_refusals():
    assert pairs.is_refusal("Unfortunately, my guidelines prevent me from replying, and I hope you understand.")
    assert pairs.is_refusal("Lo siento, pero no me es posible opinar sobre la artrosis. Gracias por su comprensión.")
    for x in ("I'm afraid I can't do that.", "Sorry, that is against my policy.", "As an AI, I can't help with this.", "Извините, я не могу ответить на этот вопрос.", "很抱歉，我无法回答这个问题。"):
        assert pairs.is_refusal(x)
    assert not pairs.is_refusal("I am sorry to hear about the pain; it will ease if you rest.")
    assert not pairs.is_refusal("I can't help with that request. But try some rest for the knee, and drink more water.")


def test_long_refusals_and_stand_ins():
    assert pairs.is_refusal("I can't help with that request." + " " * 400 + "Please see a doctor.")
    assert pairs.is_refusal("I am sorry. I can't help with that request. " + "Thank you for your message. Please consult a qualified professional. " * 8)
    assert not pairs.is_refusal("I can't help with that request. " + "But try some rest for the knee. " * 20)
    assert pairs._nothing("\n" * 50 + " N/A " + " " * 50) and pairs._nothing("-" * 80) and not pairs._nothing("rest " * 30)


# --- p3 -------------------------------------------------------------------------------


def test_format_copies(spark, records):
    base = [("user", "Age: 41\nSex: f"), ("assistant", "Rest, please.")]
    rows = [
        (5, base), (9, [("USER ", "sex: F; age: 41"), ("assistant", "rest please")]), (7, [("user", "Age: 41 Sex: f"), ("assistant", "Rest please")]),
        (2, [("user", "Age: 41\nSex: f"), ("user", "Rest, please.")]), (3, [("user", "Age: 4\n1 Sex: f"), ("assistant", None)]), (4, None), (6, []), (1, [("user", None)]), (8, [("user", "...")]), (8, [("user", "...")]),
    ]
    df = records(rows, extra="'k' as key;1 as salt;2 as check")
    hashes = formatdup.canonical_hashes(df)
    assert sorted(map(tuple, formatdup.format_copies(hashes).collect())) == [(1, 8), (5, 7), (5, 9)]
    assert sorted((r.keep_id, r.copies) for r in formatdup.format_groups(hashes).collect()) == [(1, 3), (2, 1), (3, 1), (5, 3)]
    assert formatdup.format_copies(formatdup.canonical_hashes(df.limit(0))).count() == 0


def test_hot_group_of_copies(spark, records, monkeypatch):
    monkeypatch.setattr(formatdup, "PART_ROWS", 50)  # the group is dealt to several tasks
    monkeypatch.setattr(formatdup, "MOST_HOT", 20)
    df = records([(i, [("user", "same!" if i % 3 == 0 else f"text {i}")]) for i in range(900)])
    got = formatdup.format_copies(formatdup.canonical_hashes(df)).collect()
    assert sorted(map(tuple, got)) == [(0, i) for i in range(3, 900, 3)]


# --- p4 -------------------------------------------------------------------------------


def test_packing(spark):
    rng = random.Random(2)
    sizes = [(i, rng.choice([0, 1, 700, None, *(rng.randint(5, 90) for _ in range(12))])) for i in range(2000)] + [(None, 5), (3, 60)]
    lengths = spark.createDataFrame(sizes, "record_id long, n_tokens long")
    limits = spark.createDataFrame([("a", 256), ("b", 100), ("c", None), ("d", 0)], "stage string, max_seq_length int")
    placed = packing.pack_lengths(lengths, limits, shard_rows=700)
    rows = placed.collect()
    assert {r.stage for r in rows} == {"a", "b"}
    for stage, capacity in (("a", 256), ("b", 100)):
        mine = [r for r in rows if r.stage == stage]
        taken: dict[int, list] = {}
        for r in mine:
            taken.setdefault(r.seq_id, []).append((r.seq_offset, r.n_tokens))
        for spans in taken.values():  # no overlap, nothing beyond the capacity
            end = 0
            for at, n in sorted(spans):
                assert at >= end or n == 0
                end = max(end, at + n)
            assert end <= capacity
        whole = Counter()
        parts = Counter()
        for r in mine:
            whole[r.record_id] += r.n_tokens
            parts[r.record_id] += 1
        want = Counter()
        for i, n in sizes:
            want[i] += n or 0
        assert +whole == +want
        assert all(parts[i] == 1 for i, n in sizes if (n or 0) <= capacity and i not in (3, None))
        assert all(r.n_tokens == capacity for r in mine if r.part < (dict(sizes)[r.record_id] or 0) // capacity)
    fill = {r.stage: r.fill for r in packing.packing_report(placed).collect()}
    assert fill["a"] > 0.95
    assert sorted((r.stage, r.overfull, r.overlapping) for r in packing.packing_invariants(placed).collect()) == [("a", 0, 0), ("b", 0, 0)]
    twice = spark.createDataFrame([("a", 256), ("a", 100), (None, 100), ("a", 100)], "stage string, max_seq_length int")
    placed = packing.pack_lengths(lengths, twice)
    assert sorted((str(r.stage), r.capacity, r.tokens) for r in packing.packing_report(placed).collect()) == [(s, c, sum(n or 0 for _, n in sizes)) for s, c in (("None", 100), ("a", 100), ("a", 256))]
    assert placed.select("seq_id").distinct().count() == placed.select("stage", "capacity", "seq_id").distinct().count()
    assert packing.pack_lengths(lengths.limit(0), limits).count() == 0 and packing.pack_lengths(lengths, limits.limit(0)).count() == 0


# --- p5, p7 ---------------------------------------------------------------------------

HARD = [
    "", None, "   ", "don't I'LL we'll", "<|endoftext|> x", "a\x85b᠎ c​ d\x1c e", "　x  y", "a" * 3000, "ab" * 700, "漢" * 300, "\U0001f642" * 200, "é" * 300, "x\n\n\n  y\t\t z  ", "0" * 513, "\x00\x01",
    "".join(random.Random(5).choice("abcdefghij") for _ in range(4000)),
]


@needs_tokenizer
def test_encoding_equals_the_library(spark):
    library = pytest.importorskip("tokenizers").Tokenizer.from_file(str(TOKENIZER))
    library.encode_special_tokens = True
    texts = HARD + [LONG]
    df = spark.createDataFrame(list(enumerate(texts)) + [(0, None)], "doc_id long, text string").withColumn("ids", F.lit(1))
    got = encode.encode_texts(df).collect()
    assert len(got) == len(texts) + 1
    for r in got:
        assert r.ids == library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
    assert encode.encode_texts(df.limit(0)).count() == 0
    back = {r.doc_id: r.text for r in encode.decode_texts(encode.encode_texts(df.where("doc_id > 0"))).collect()}
    assert back == {i: t or "" for i, t in enumerate(texts) if i}


@needs_tokenizer
def test_long_pieces_take_time_in_proportion():
    merges, rng = bpe.Merges(TOKENIZER.read_bytes()), random.Random(6)
    library = pytest.importorskip("tokenizers").Tokenizer.from_file(str(TOKENIZER))
    took = []
    for n in (20_000, 160_000):
        text = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
        began = time.process_time()
        ids = merges.encode([text.encode()])[0]
        took.append(time.process_time() - began)
        assert n > 20_000 or ids.tolist() == library.encode(text, add_special_tokens=False).ids
    assert took[1] < 14 * took[0] + 0.5
    with pytest.raises(ValueError):
        bpe.Merges(TOKENIZER.read_bytes().replace(b'"normalizer":null', b'"normalizer":{"type":"Lowercase"}').replace(b'"normalizer": null', b'"normalizer": {"type": "Lowercase"}'))


@needs_tokenizer
def test_store_starts_anew():
    small, large = bpe.Pieces(TOKENIZER.read_bytes(), limit=20), bpe.Pieces(TOKENIZER.read_bytes())
    for texts in (["some words here"], ["other words there, and many more of them than before"], ["some words here", None]):
        a, b = small.encode(texts), large.encode(texts)
        assert a[0].tolist() == b[0].tolist() and a[1].tolist() == b[1].tolist()


@needs_tokenizer
def test_budget(spark, records):
    df = records(
        [(1, [("user", "This is the house, and it is mine."), ("assistant", None)], "train", "My Source"), (2, [("user", "El perro y la casa de mi madre")], "val", " my-source "), (3, None, "train", None), (4, [("user", "This is the dog.")], "train", "my_source"), (4, [("user", "This is the dog.")], "train", "my_source")],
        extra="'z' as piece;'q' as lang;1 as n",
    )
    got = {(r.source, r.lang): (r.records, r.tokens) for r in tokenbudget.token_budget(df).collect()}
    pieces = bpe.Pieces(TOKENIZER.read_bytes())
    n = lambda *t: int(tokens.counts(pieces, list(t)).sum())
    assert got == {("my_source", "en"): (3, n("This is the house, and it is mine.", "This is the dog.", "This is the dog.")), ("my_source", "es"): (1, n("El perro y la casa de mi madre")), ("unknown", "und"): (1, 0)}
    assert tokenbudget.token_budget(df.limit(0)).count() == 0


# --- p6 -------------------------------------------------------------------------------


def overlap_truth(rows):
    out = set()
    own = [(i, s, [w for r, c in m or [] if role_of(r) != "system" for w in canonical_words(c)]) for i, m, s in rows]
    for (i, s, a), (j, t, b) in itertools.combinations(own, 2):
        if a and b and (s == "train") != (t == "train") and lcs_length(a, b) >= 0.8 * max(len(a), len(b)):
            out.add((min(i, j), max(i, j)))
    return out


def test_overlaps_against_brute_force(spark, records):
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(400)]
    rows, texts = [], []
    for i in range(120):
        texts.append([rng.choice(vocabulary) for _ in range(rng.randint(6, 90))])
    for i in range(360):
        words = list(rng.choice(texts))
        for _ in range(int(rng.choice([0, 0, 0.03, 0.08, 0.12]) * len(words))):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        rows.append((i, [("system", "s"), ("user", " ".join(words))], rng.choice(["train", "train", "val", "Test", "valid"])))
    rows += [(900, None, "train"), (901, [], "val"), (902, [("user", None)], "val"), (903, [("user", "Sex: f\nAge: 4 and some more words for it")], "train"), (904, [("user", "age: 4 and some more words FOR it; sex: f")], "test"), (905, rows[0][1], "other")]
    df = records([(i, m, s) for i, m, s in rows], extra="1 as c;2 as n;'x' as cls")
    got = {tuple(r) for r in splitoverlap.split_overlaps(df).collect()}
    want = overlap_truth([(i, m, s.lower()) for i, m, s in rows if s != "other"])
    assert not got - want and len(want & got) >= 0.98 * len(want) and len(want) > 150
    assert splitoverlap.split_overlaps(df.limit(0)).count() == 0
    report = splitoverlap.overlap_report(splitoverlap.split_overlaps(df), df).collect()
    assert sum(r.pairs for r in report) == len(got)


def test_many_copies_on_both_sides(spark, records):
    rows = [(i, [("user", "the very same words stand here again and again")], "train" if i < 60 else "test") for i in range(120)]
    got = {tuple(r) for r in splitoverlap.split_overlaps(records(rows)).collect()}
    assert {x for p in got for x in p} == set(range(120)) and all(a < 60 <= b for a, b in got) and len(got) <= 8 * 120


def test_hot_group_of_near_copies(spark, records, monkeypatch):
    text = "please write a short letter about the opening hours of our new office in the old town for client number {} and keep it polite and friendly throughout all of it"
    rows = [(i, [("user", text.format(f"x{i}"))], "train" if i % 3 else "val") for i in range(900)]
    got = {tuple(r) for r in splitoverlap.split_overlaps(records(rows)).collect()}
    assert got == {(min(i, j), max(i, j)) for i in range(0, 900, 3) for j in range(900) if j % 3}


def crowd(n):
    """Near copies of one text with several filled slots, a quarter of them for evaluation."""
    rng = random.Random(3)
    text = "dear {} we write to you about the {} opening hours of our new {} office in the old {} town and ask you to {} call us soon"
    return [(i, [("user", text.format(*(rng.choice(["", f"s{rng.randrange(60)}", f"t{i}"]) for _ in range(5))))], "val" if i % 4 == 0 else "train") for i in range(n)]


def test_every_pair_of_a_crowd_is_found(spark, records):
    rows = crowd(400)
    got = {tuple(r) for r in splitoverlap.split_overlaps(records(rows)).collect()}
    assert got == overlap_truth(rows) and len(got) > 10_000


def test_pairs_of_a_crowd_do_not_depend_on_batches(spark, records, monkeypatch):
    rows = crowd(300)
    df = records(rows)
    monkeypatch.setattr(splitoverlap, "SALT_ROWS", 50)  # words of the crowd are dealt to several partitions
    got = [{tuple(r) for r in splitoverlap.split_overlaps(x).collect()} for x in (df.coalesce(1), df.repartition(3, "record_id"), df.orderBy("split").coalesce(2))]
    assert got == [overlap_truth(rows)] * 3


def test_copies_in_other_tasks_meet_once(spark, records, monkeypatch):
    texts = {i: (m, s) for i, m, s in crowd(60)}
    rows = [(1000 * k + i, m, s) for k in range(9) for i, (m, s) in texts.items()] + [(1000 * k + 999, texts[0][0], "train") for k in range(9)]  # one class on both sides
    df = records(rows).repartition(7, "record_id")
    sides = {(tuple(canonical_words(m[0][1])), s == "train") for _, m, s in rows}
    want = overlap_truth([(i, m, s) for i, m, s in rows if i < 1000])
    for listed in (splitoverlap.LISTED, 0):  # by a broadcast and by a shuffle
        monkeypatch.setattr(splitoverlap, "LISTED", listed)
        sequences = splitoverlap.word_sequences(df)
        assert splitoverlap._first_copies(sequences).count() == len(sides) < 70
        got = {tuple(r) for r in splitoverlap.split_overlaps(df).collect()}
        assert {(a, b) for a, b in got if a < 1000 and b < 1000} == want and {x for p in got for x in p} == {i for i, _, _ in rows if i % 1000 in {x % 1000 for p in want for x in p}}


def test_changed_words_are_the_rarest(spark, records):
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(40):  # 12 to 19 of 100 words replaced by words that occur once
        words = [rng.choice(vocabulary) for _ in range(180)]
        places = set(rng.sample(range(180), 22 + i % 13))
        rows += [(2 * i, [("user", " ".join(words))], "train"), (2 * i + 1, [("user", " ".join(f"x{i}y{k}" if k in places else w for k, w in enumerate(words)))], "test")]
    got = {tuple(r) for r in splitoverlap.split_overlaps(records(rows)).collect()}
    assert got == {(2 * i, 2 * i + 1) for i in range(40)}


def test_short_records(spark, records):
    rows = [(i, [("user", " ".join(f"r{i // 2}w{k}" if k != n // 2 or i % 2 else f"new{i}" for k in range(n)))], "val" if i % 2 else "train") for n in (5, 6, 7, 9, 10) for i in (2 * n, 2 * n + 1)]
    got = {tuple(r) for r in splitoverlap.split_overlaps(records(rows)).collect()}
    assert got == overlap_truth(rows) == {(2 * n, 2 * n + 1) for n in (5, 6, 7, 9, 10)}


def test_copies_with_other_word_borders_agree(spark, records):
    text = "the long term follow up of well being in on going care for low in come"
    joined = text.replace(" ", "")
    rows = [(1, [("user", text)], "train"), (2, [("user", joined)], "val"), (3, [("user", "Age: 4\nSex: f\nSite: toe")], "train"), (4, [("user", "Site: toe Age: 4 Sex: f")], "val"), (5, [("user", "Age: 4 Sex: f Site: toe")], "test"), (6, [("assistant", joined)], "test")]
    got = {tuple(r) for r in splitoverlap.split_overlaps(records(rows)).collect()}
    assert got == {(1, 2), (3, 5)}
    members = {r.record_id: r for r in splitoverlap.overlap_members(records(rows)).collect()}
    assert len(members) == 6 and [members[i].links for i in range(1, 7)] == [1, 1, 1, 0, 1, 0] and members[2].class_id == members[6].class_id == 2 and members[2].class_eval == 2


# --- p8 -------------------------------------------------------------------------------


def test_mixture(spark):
    rng = random.Random(4)
    docs = [(i, s, rng.randint(1, 400)) for i, s in enumerate(rng.choices(["a", "b", "c", "x"], [6, 3, 1, 2], k=3000))] + [(None, "a", 7), (1, "a", 5), (9001, "a", 0)]
    sized = spark.createDataFrame(docs, "doc_id long, source string, n_tokens long")
    targets = spark.createDataFrame([("A ", 0.5, 2), ("b", 0.2, 3), ("c", 0.2, 4), ("gone", 0.1, 2), ("b", None, 3)], "source string, target_share double, max_repeat int")
    mixed = mixing.mixture(sized, targets, block_tokens=512)
    rows = mixed.collect()
    total = sum(r.n_tokens for r in rows)
    share = lambda s: sum(r.n_tokens for r in rows if r.source == s) / total
    for s, want in (("a", 0.5 / 0.9), ("b", 0.2 / 0.9), ("c", 0.2 / 0.9)):
        assert abs(share(s) - want) < 0.01
    uses = Counter((r.source, r.doc_id) for r in rows if r.doc_id not in (None, 1))
    assert max(n for (s, _), n in uses.items() if s == "c") <= 4 and max(n for (s, _), n in uses.items() if s == "a") <= 2
    slots = {}
    for r in rows:
        assert slots.setdefault(r.slot, r.source) == r.source
    order = [slots[k] for k in sorted(slots)]
    for cut in (len(order) // 3, len(order) // 2):  # every stretch holds the shares
        assert abs(order[:cut].count("a") / cut - 0.5 / 0.9) < 0.05
    report = {r.source: r for r in mixing.mixture_shares(mixed, sized, targets).collect()}
    assert report["gone"].tokens == 0 and abs(sum(r.actual_share for r in report.values()) - 1) < 1e-9 and set(report) == {"a", "b", "c", "gone"}
    assert mixing.mixture(sized.limit(0), targets).count() == 0 and mixing.mixture(sized, targets.limit(0)).count() == 0


# --- p9 -------------------------------------------------------------------------------


def test_trees_learn():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(1500, 4))
    y = np.where(x[:, 0] > 0.3, 2.0, 0.0) + x[:, 1]
    model = Boosted().fit(x[:1000], y[:1000], np.ones(1000))
    assert np.abs(model.predict(x[1000:]) - y[1000:]).mean() < 0.25
    assert Boosted(rounds=3).fit(x[:2], y[:2], np.ones(2)).predict(x[:2]).shape == (2,)


def test_reading_cases(spark):
    text = "The doctor can help you to rest at home, and you should take it for some days. " * 6
    docs = spark.createDataFrame([(1, "s", text), (2, "s", None), (3, None, ""), (4, "s", "too short"), (5, "s", "El perro y la casa de mi madre son grandes. " * 20), (6, None, text + LONG), (1, "s", text)], "doc_id long, source string, text string")
    docs = docs.withColumns({"band": F.lit(9), "level": F.lit("x")})
    labels = spark.createDataFrame([(1, "r", 2), (1, "r", 2), (6, "q", None), (None, "r", 3), (77, "r", 1)], "doc_id long, rater string, band int")
    got = readability.reading_levels(docs, labels).collect()
    assert sorted(r.doc_id for r in got) == [1, 1, 6] and all(1 <= r.band <= 5 for r in got)
    assert {r.band for r in readability.reading_levels(docs, labels.limit(0)).collect()} == {3}
    assert readability.reading_levels(docs.limit(0), labels).count() == 0


@needs_data
def test_reading_bands_agree_with_raters(spark):
    from sparkloom.sources.tables import table

    docs, labels = (table(spark, "/root/testdata/sf0.1", t) for t in ("documents", "reading_labels"))
    rows = readability.reading_report(docs, labels).collect()
    n = sum(r.documents for r in rows)
    assert sum(r.same_band * r.documents for r in rows) / n > 0.85 and sum(r.within_one * r.documents for r in rows) / n > 0.98


# --- Registered queries ---------------------------------------------------------------


@needs_data
@needs_tokenizer
def test_queries_run(spark):
    from sparkloom.llm import queries

    found = {"p1_found": ["record_id", "msg_idx", "kind"], "p2_found": ["record_id", "defect"], "p3_found": ["keep_id", "copy_id"], "p6_found": ["first_id", "second_id"], "p7_ids": ["doc_id", "ids"], "p9_found": ["doc_id", "band"]}
    for name, f in queries.QUERIES.items():
        df = f(spark, "/root/testdata/sf0.001")
        assert df.columns == found.get(name, df.columns)
        assert df.count() > 0
