"""Text functions against values derived by hand from the rules."""

from __future__ import annotations

import hashlib
import json
import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from sparkloom.functions import messages as M
from sparkloom.functions import text as X


def one(spark, values, make, kind="string"):
    """The results of a column function over values, in order."""
    df = spark.createDataFrame(list(enumerate(values)), f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(make(F.col("x")).alias("y")).collect()]


def test_clean_text(spark):
    given = [None, "", "   ", "ﬁ①", "a ​b", "\x1fx\x1c", "\x0ba\x85", "a\r\n\r\n\r\n\r\nb\rc", "a \t  b", "\n \nx\n"]
    assert one(spark, given, X.clean_text) == ["", "", "", "fi1", "a b", "x", "a", "a\n\nb\nc", "a b", "x"]
    assert one(spark, [7, None], X.clean_text, "int") == ["7", ""]


def test_normalize_for_hash(spark):
    given = ["See HTTPS://x.y/z?a now!", "Привет", "A--b\n C_1", None, "Å é"]
    assert one(spark, given, X.normalize_for_hash) == ["see now", "", "a b c 1", "", ""]


def test_stable_hash(spark):
    want = hashlib.sha256("a\n<SEP>\n\n<SEP>\nb".encode()).hexdigest()
    assert one(spark, ["a"], lambda c: X.stable_hash(c, F.lit(None).cast("string"), F.lit("b"))) == [want]


def test_truncate_at_word(spark):
    given = ["abc def", "abc def ghi", "abcdefghij", "abc defg", "abc def "]
    assert one(spark, given, lambda c: X.truncate_at_word(c, 7)) == ["abc def", "abc", "abcdefg", "abc", "abc"]


def test_choice_index(spark):
    given = ["1", "4", "0", "-1", "10", "5", "a", "(b)", " D", "abcd", None, ""]
    assert one(spark, given, X.choice_index) == [0, 3, None, 0, 0, None, 0, 1, 3, None, None, None]


def test_choice_explanation(spark):
    given = ["Ans: A", "Because x. Answer - B. more\nand more", "Answers differ", None, " a \n b "]
    assert one(spark, given, lambda c: X.choice_explanation(c, 100)) == ["", "Because x.", "Answers differ", "", "a b"]


def test_strip_footer(spark):
    given = ["One [1, 2].\n\nTwo\nUpdated by: X\nThree", "doi: 10.1/x", "a\x0bReview PROVIDED by q", None, "see doi:10.5 b"]
    assert one(spark, given, lambda c: X.strip_footer(c, 100)) == ["One . Two", "", "a", "", ""]


def test_flags(spark):
    assert one(spark, ["Hi,  May I answer your health queries", "So hi may i answer your health queries", "hello, I am Dr X", "hello i am drunk"], X.is_provider_opening) == [True, False, True, False]
    assert one(spark, ["extract it as json", "extract\njson", "a table", "tables"], lambda c: X.is_extraction_task(c, F.lit(None))) == [True, False, True, False]
    assert one(spark, ["use c++ now", "c++x", "```", "drug", "sqlite", "a SQL b"], lambda c: X.is_plain_general(c, F.lit(""))) == [True, False, False, False, True, False]


def test_topic_rule_differs_for_blank_topics(spark):
    df = spark.createDataFrame([("...", "an input"), ("input", "an input"), ("other", "an input"), ("", "an input"), ("t", "")], "a string, b string")
    got = df.select(X.topic_prompt(F.col("a"), F.col("b"), False), X.topic_prompt(F.col("a"), F.col("b"), True)).collect()
    assert [tuple(r) for r in got] == [("Topic: ...\n\nan input", "an input"), ("an input",) * 2, ("Topic: other\n\nan input",) * 2, ("an input",) * 2, ("t",) * 2]


def test_lists_and_labels(spark):
    assert one(spark, ["a, b,, c ", None], X.split_list) == [["a", "b", "c"], []]
    assert one(spark, [0, 3, 4, None], X.option_label, "int") == ["A", "D", None, None]
    assert one(spark, [" Exam-Dialog", "exam dialog ", None, " "], X.normal_name) == ["exam_dialog", "exam_dialog", "unknown", "unknown"]


def py_clean(t):
    t = unicodedata.normalize("NFKC", t).replace("​", " ").replace("\xa0", " ")
    import re

    t = re.sub(r"\r\n?", "\n", t)
    t = re.sub(r"[ \t]+", " ", t)
    return re.sub(r"\n{3,}", "\n\n", t).strip()


def test_clean_text_on_random_strings(spark):
    rng = random.Random(3)
    given = ["".join(rng.choice("aB1 \t\n\r ​\x0b\x1c\x85  ﬁéİ.") for _ in range(rng.randint(0, 14))) for _ in range(400)]
    assert one(spark, given, X.clean_text) == [py_clean(t) for t in given]


def test_ids_equal_those_of_sorted_json(spark):
    given = ['say "x" \\ é\n\t', "ctl \x01\x1b\x1f end", "\U0001f642 </s>", ""]
    rows = [(i, [("user", t), ("assistant", "ok")]) for i, t in enumerate(given)]
    df = spark.createDataFrame(rows, "i int, m array<struct<role:string,content:string>>")
    got = [r[0] for r in df.orderBy("i").select(M.example_id(F.lit("s"), F.lit("t"), F.col("m"))).collect()]
    for (_, m), g in zip(rows, got):
        text = json.dumps([{"role": r, "content": c} for r, c in m], ensure_ascii=False, sort_keys=True)
        assert g == hashlib.sha256("\n<SEP>\n".join(["s", "t", text]).encode()).hexdigest()[:24]


CASES = [
    ([("u", "a"), ("u", "b"), ("a", "c")], [("u", "a\n\nb"), ("a", "c")]),
    ([("u", "a"), ("u", ""), ("u", None), ("a", "c"), ("a", "d")], [("u", "a"), ("a", "c\n\nd")]),
    ([], []),
    (None, None),
]


@pytest.mark.parametrize(("given", "want"), CASES)
def test_merge_turns(spark, given, want):
    df = spark.createDataFrame([(given,)], "m array<struct<role:string,content:string>>")
    got = df.select(M.merge_turns(F.col("m"))).collect()[0][0]
    assert (None if got is None else [tuple(x) for x in got]) == want


def test_messages(spark):
    long = "x" * 25
    dialogues = {
        "uaua": ([("user", long), ("assistant", long)] * 2, True), "aua": ([("assistant", long), ("user", long), ("assistant", long)], False), "uau": ([("user", long), ("assistant", long), ("user", long)], False),
        "short": ([("user", "hi"), ("assistant", long)], False), "none": (None, False), "empty": ([], False),
    }
    df = spark.createDataFrame([(k, v[0]) for k, v in dialogues.items()], "k string, m array<struct<role:string,content:string>>")
    got = {r.k: r for r in df.select("k", M.is_valid_dialogue(F.col("m"), 20, 20).alias("v"), M.last_turns(F.col("m"), 3).alias("t"), M.is_trainable(F.col("m")).alias("fit")).collect()}
    assert {k: r.v for k, r in got.items()} == {k: v[1] for k, v in dialogues.items()}
    assert [m.role for m in got["uaua"].t] == ["user", "assistant"]  # the cut began with the assistant
    assert [m.role for m in got["aua"].t] == ["assistant", "user", "assistant"]
    assert (got["uau"].fit, got["none"].fit, got["empty"].fit) == (True, False, False)
    raw = spark.createDataFrame([([(" User ", " a "), ("SYSTEM", "s"), ("tool", "t"), ("assistant", None), (None, "x"), ("assistant", "ﬁ")],), (None,)], "m array<struct<role:string,content:string>>")
    assert [r[0] if r[0] is None else [tuple(m) for m in r[0]] for r in raw.select(M.normalize_messages(F.col("m"))).collect()] == [[("user", "a"), ("assistant", "fi")], None]
