"""Shorter ways through a text give what the plain patterns give."""

import random

import pytest
from pyspark.sql import functions as F

from quietroom.functions import entities as E
from quietroom.functions import rules as R
from quietroom.functions import text as T
from quietroom.operators import lists as L
from tests.test_text import run

PIECES = ["a", "b", "dot", "DoT", ".", ",", " ", "  ", "\n", "(", ")", "[", "]", "-", "com", "Com", "top", "ſhop", "vıp",
          "x9", "é", "É", "ABC", "İ", "K", "1", "aaa", "...", "𝒜", "́", "_", "ok" * 33, "%"]


def texts(seed, n=4000, size=9):
    rnd = random.Random(seed)
    return sorted({"".join(rnd.choices(PIECES, k=rnd.randint(1, size))) for _ in range(n)})


def test_spelled_out_links(spark):
    got = run(spark, lambda c: F.struct(E.has_obfuscated_url(c), E.has(c, E.SPELLED_OUT_URL)), texts(1))
    assert all(a == b for a, b in got) and 20 < sum(a for a, _ in got) < len(got) - 20


def test_spelled_out_names_by_length(spark):
    cases = {"x" * n + tail: 1 < n <= 62
             for n in (1, 2, 61, 62, 63, 64) for tail in (" dot com", "dotcom", ". top", "(dot) vip")}
    got = run(spark, lambda c: F.struct(E.has_obfuscated_url(c), E.has(c, E.SPELLED_OUT_URL)), list(cases))
    assert all(a == b for a, b in got) and [a for a, _ in got] == list(cases.values())


def test_loud_texts(spark):
    cases = texts(2) + ["A" * 18 + "b" * 7, "A" * 17 + "b" * 8, "É" * 30 + " 1234", "AB é" * 9, "Ab" * 20, "", "ABC " * 9]
    got = run(spark, lambda c: F.struct(R.rule_caps(c).isNotNull(), F.coalesce(E.caps_ratio(c) > R.CAPS_RATIO, F.lit(False))),
              cases)
    assert all(a == b for a, b in got) and any(a for a, _ in got)
    assert run(spark, lambda c: E.few_small_letters(c, 0.31), ["A" * 18 + "b" * 7, "small letters"]) == [True, False]


@pytest.mark.parametrize("kept", ["a-z0-9", r"0-9a-z\x{E0}-\x{1EF9}"])
def test_spaces_and_repeats(spark, kept):
    listed = kept.replace("a-z", "").replace("0-9", "") + T.ALNUM

    def both(c):
        plain = F.regexp_replace(F.regexp_replace(c, f"[^{kept}]+", " "), r"([^\n])\1{2,}", "$1$1")
        return F.struct(T.collapse_repeats(T._spaced(c, listed)), plain)

    got = run(spark, both, [*texts(3), " ", "", ". ", " .", "a  ", "  a", "a b"])
    assert [a for a, _ in got] == [b for _, b in got]


def test_amounts(spark):
    cases = texts(4) + ["$500", "₫ 5000", "٣٤ k", "é$", "12 usd", "x12k", "5 củ", "¹²³ $"]
    got = run(spark, lambda c: F.struct(E.has_money_amount(c), E.has(c, E.MONEY)), cases)
    assert [a for a, _ in got] == [b for _, b in got] and any(a for a, _ in got)


def test_texts_without_any_phrase_are_dismissed(spark, monkeypatch):
    words = spark.createDataFrame([(1, "xin chào"), (0, "b.a+d"), (2, "ộ 1"), (3, "...")], "chat_id bigint, phrase string")
    bundles = L.phrase_bundles(words)
    rows = ["zzxinchaozz", "xinchào", "bad", "badness", "ba", "ội", "", None]
    assert run(spark, lambda c: F.lit(1), rows)
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, s string").withColumn("k", L._holds_any(bundles, "s"))
    assert [r["k"] for r in df.orderBy("i").collect()] == [True, True, True, True, False, True, False, None]
    msgs = spark.createDataFrame([(i, i % 4, f"xin chào {r} ba d" if i % 2 else r) for i, r in enumerate(rows)],
                                 "message_id int, chat_id int, keep_text string").withColumn("chat_id", F.col("chat_id").cast("bigint"))

    def hits():
        return [(r[0], r[1]) for r in L.with_banned_hits(msgs, words).select("message_id", "banned_hits").orderBy("message_id").collect()]

    with_pattern = hits()
    monkeypatch.setattr(L, "MAX_PATTERN_FORMS", 1)
    assert with_pattern == hits() and any(h for _, h in with_pattern)
    monkeypatch.setattr(L, "MAX_PATTERN_FORMS", 1000)
    nothing = words.filter("chat_id = 3")
    assert all(r["banned_hits"] == [] for r in L.with_banned_hits(msgs, nothing).collect())
