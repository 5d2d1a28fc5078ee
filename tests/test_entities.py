import pytest
from pyspark.sql import functions as F

from quietroom.functions import entities as E
from quietroom.functions.dictionaries import MEDIUM, PRESETS, STRONG, TIERS, WEAK, squeezed_phrases
from quietroom.functions.phrases import any_of, keyword_hits
from quietroom.functions.rules import staff_title
from quietroom.functions.text import normalize
from tests.test_text import run


@pytest.mark.parametrize("fn, cases", [
    (E.extract_urls, {
        "go to https://a.com/x?y=1 or b.net.": ["b.net", "https://a.com/x?y=1"],
        "mail me@site.org": ["site.org"], "no link.here": [], "WWW.Shop.VN/ok": ["WWW.Shop.VN/ok"],
        "xa.comx": [], "éa.com": [], "sub.a-b.co.uk": ["sub.a-b.co.uk"], "a.com a.com": ["a.com"],
        "bit.ly/abc": []}),
    (E.extract_mentions, {"@alice_1 and (@Bobby!) x@carol12 /@dave55 @abc @@eve123": [
        "alice_1", "bobby"], "@toolongname_toolongname_toolongname1": []}),
    (E.extract_phones, {"0912345678": ["0912345678"], "091 234.56-78": ["0912345678"], "09 12345678": [],
                        "+84 912 345 678": ["+84912345678"], "00912345678": [],
                        "09123456789": [], "0112345678": [], "x+12345678": ["+12345678"]}),
])
def test_lists(spark, fn, cases):
    assert [sorted(r) for r in run(spark, fn, cases)] == list(cases.values())


@pytest.mark.parametrize("fn, cases", [
    (E.hostname, {"https://WWW.A.com/x": "a.com", "user@b.net:80/x": "b.net", "c.org?q#f": "c.org",
                  " d.io). ": "d.io", "tg://resolve?x": "resolve", "": ""}),
    (lambda c: E.split_url(c)["path"], {"a.com/X/y/?q=1": "x/y", "a.com": "", "a.com?x=/p": "p",
                                        "http://a.com//z//#f": "z"}),
    (E.canonical_domain, {" .HTTPS://www.A.com/b/?q#f": "a.com/b",
                          "https://www.T.me/News/": "t.me/news", "..x.com//": "x.com"}),
    (E.canonical_username, {" @@Bob, ": "bob", "Al@x": "al@x"}),
    (E.canonical_phone, {" (09) 12-34.56 ": "09123456"}),
    (E.has_crypto_address, {"0x" + "a1" * 20: True, "0x" + "a1" * 19: False,
                            "bc1" + "q" * 39: True, "T" + "A" * 33: True, "Ta" + "0" * 32: False,
                            "_0x" + "a1" * 20: False}),
    (E.has_money_amount, {"500k": True, "5k": False, "5 củ": True, "1 triệu": True, "$1000": True,
                          "100$": False, "100$a": True, "₫ 500": True, "x500k": False,
                          "100 USD now": True, "500km": False, "²50k": False}),
    (E.emoji_count, {"🎁🎁 ok ☀": 3, "none": 0, "é": 0, "⬆": 1}),
    (E.has_obfuscated_url, {"abc (dot) com": True, "abc [.] net": True, "word, me": True,
                            "a. com": False, "promo DOT vip": True, "x dotcom": False,
                            "ab , community": False, "dot com": False, "antidot com": True}),
    (E.has_invite_link, {"T.ME/+abc": True, "t.me/joinchat/x": True, "t.me/abc": False}),
    (E.forward_label, {"user": "người dùng", "channel": "kênh khác", "x": "nguồn khác",
                       None: None}),
    (lambda c: F.round(E.caps_ratio(c), 3), {"ABC": None, "A" * 20 + "b" * 5: 0.8,
                                             "É" * 30: 1.0, "đ" * 30: 0.0}),
    (lambda c: E.classify_qr_payload(c, F.array(F.lit("github.com"))), {
        "00020101...5303704": "payment", "000201 58\n02VN": "other", "0002015802VN": "payment",
        "Bitcoin:abc": "wallet", "ton:x": "wallet", "https://t.me/+abc": "invite",
        "tg://x": "invite", "https://shop.top/x": "unknown_link",
        "https://github.com/a": "allowed_link", "http://odd.zz/x": "unknown_link",
        "WIFI:S:x;;": "other"}),
    (lambda c: staff_title(normalize(c)), {"Trợ Lý Nhóm": "tro ly", "Administrator": "",
                                           "A d m": "", "Mr. ADMIN": "admin", "CTV 1": "ctv"}),
])
def test_values(spark, fn, cases):
    assert run(spark, fn, cases) == list(cases.values())


def test_message_texts(spark):
    df = spark.createDataFrame([("a", "b", ["q", "r"], "o"), ("", "b", [], ""), (None, None, None, None)],
                               "t string, c string, q array<string>, o string")
    got = df.select(E.message_text("t", "c").alias("m"),
                    E.scannable_text("t", "q", "o").alias("s")).collect()
    assert [tuple(r) for r in got] == [("a b", "a q r o"), ("b", ""), ("", "")]


def test_dictionary_sizes():
    assert [len(x) for x in (STRONG, MEDIUM, WEAK)] == [69, 48, 21]
    assert [len(p[2]) for p in PRESETS] == [11, 14, 8, 8, 9, 6, 6, 17]


def test_hits_are_substrings(spark):
    norm = lambda c: keyword_hits(normalize(c), "strong")
    assert run(spark, norm, ["hello den", "vay tiền nhanh, bao lãi", "x2 tài khoản", "x3 tài khoản",
                             "lãi suất 0"]) == [
        ["lo de"], ["bao lai", "vay tien nhanh"], ["x2 tai khoan"], [], []]


def test_gate_finds_each_phrase(spark):
    for tier, phrases in TIERS.items():
        texts = [f"abc{p}xyz" for p in phrases] + ["nothing of the kind"]
        got = run(spark, lambda c: c.rlike(any_of(phrases)), texts)  # noqa: B023
        assert got == [True] * len(phrases) + [False], tier


def test_squeezed_phrases_are_folded():
    strong = squeezed_phrases("strong")
    assert "dangkynhaniook" in strong and "vaytiennhanh" in strong and "taixiu" not in strong
