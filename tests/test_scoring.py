import pytest

from quietroom.config import ModerationConfig
from quietroom.operators import lists as L
from quietroom.operators.scoring import score_messages, summary
from quietroom.plans import moderate as M

CFG = ModerationConfig(allowed_domains=("t.me", "youtube.com", "github.com"))
DEFAULTS = dict(text="", is_forward=False, forward_label=None, has_media=False, has_qr=False,
                qr_payloads=[], from_channel=False, is_new_member=False, prior_offences=0,
                has_buttons=False, has_username=True, has_story=False, via_bot=False,
                sender_name="", is_question=False, entity_urls=[], mentions=[], ocr_text="")
DDL = """id int, text string, is_forward boolean, forward_label string, has_media boolean,
has_qr boolean, qr_payloads array<string>, from_channel boolean, is_new_member boolean,
prior_offences int, has_buttons boolean, has_username boolean, has_story boolean, via_bot boolean,
sender_name string, is_question boolean, entity_urls array<string>, mentions array<string>,
ocr_text string"""


def verdicts(spark, cases, cfg=CFG):
    rows = [(i, *{**DEFAULTS, **c}.values()) for i, c in enumerate(cases)]
    out = score_messages(spark.createDataFrame(rows, DDL), cfg).select("id", "verdict").collect()
    return [r["verdict"] for r in sorted(out, key=lambda r: r["id"])]


SPAM = [
    dict(text="Cần tuyển CTV online, nhà cái uy tín, nhanh tay"),
    dict(text="Vay tiền nhanh, hỗ trợ nợ xấu, giải ngân trong ngày, gọi 0987654321"),
    dict(text="visit https://promo.top/win now"),
    dict(text="send 0.1 to 0x" + "ab" * 20),
    dict(text="v a y t i e n n h a n h, passive income"),
    dict(text="join https://t.me/+AbCdEf for guaranteed profit"),
    dict(text="hi", is_forward=True), dict(text="hi", from_channel=True), dict(has_story=True),
    dict(has_qr=True, qr_payloads=["000201010212530370454065802VN"]),
    dict(has_qr=True, qr_payloads=["https://lucky-draw.example.biz/x"]),
    dict(has_qr=True, qr_payloads=["tuyen ctv online, nha cai uy tin"]),
    dict(text="hello", sender_name="Trợ Lý"), dict(text="ask @somebody"),
    dict(text="call +1 202 555 0100"), dict(ocr_text="vay nong, lo de, soi cau"),
]
CLEAN = [
    dict(text="Chào cả nhà 👋"), dict(text="see https://github.com/a/b"), dict(text=""),
    dict(text="giá 300k thôi"), dict(text="https://m.youtube.com/watch?v=1"),
    dict(has_qr=True, qr_payloads=["https://github.com/a"]),
    dict(has_qr=True, qr_payloads=["WIFI:S:x;;"]), dict(has_qr=True, qr_payloads=[]),
    dict(text="nhà cái uy tín không? vay nóng, lô đề", is_question=True),
    dict(text="fine", prior_offences=5), dict(text="pic", is_forward=True, has_media=True),
]


def test_spam_and_clean(spark):
    got = verdicts(spark, SPAM + CLEAN)
    assert [v.is_spam for v in got] == [True] * len(SPAM) + [False] * len(CLEAN)


def test_points_and_reasons(spark):
    got = verdicts(spark, [
        dict(text="uy tin", prior_offences=1),
        dict(text="uy tin", is_new_member=True, prior_offences=3),
        dict(text="see http://x.top/a and http://y.xyz", is_new_member=True, has_username=False),
        dict(is_forward=True, has_media=True, has_qr=True, qr_payloads=["ton:x"], forward_label="kênh khác"),
        dict(text="@alice1 @bobby2 @carol3"),
        dict(entity_urls=["https://bit.ly/x"]),
    ])
    assert [(v.score, v.threshold, v.reasons) for v in got] == [
        (3, 5, ["weak_phrases: uy tin (+1)", "prior_offences: 1 (+2)"]),
        (5, 3, ["weak_phrases: uy tin (+1)", "prior_offences: 3 (+4)"]),
        (7, 3, ["unknown_link: x.top/a, y.xyz (+3)", "risky_tld (+2)", "newcomer_link (+1)",
                "no_username_link (+1)"]),
        (12, 5, ["forward: kênh khác (+5)", "qr_code (+2)", "qr_wallet (+5)"]),
        (5, 5, ["unknown_mention: @alice1, @bobby2, @carol3 (+5)"]),
        (8, 5, ["unknown_link: bit.ly/x (+5)", "shortener (+3)"]),
    ]


def test_switches(spark):
    cfg = ModerationConfig(block_links=False, block_mentions=False, block_phones=False,
                           block_forwards_new_only=True, block_fake_admin=False,
                           block_channel_senders=False)
    got = verdicts(spark, [
        dict(text="http://x.com/a"), dict(text="@alice1 @bobby2 @carol3"), dict(text="0912345678"),
        dict(is_forward=True), dict(is_forward=True, is_new_member=True),
        dict(sender_name="Admin", from_channel=True)], cfg)
    assert [v.score for v in got] == [2, 2, 2, 1, 4, 0]


def test_summary(spark):
    df = spark.createDataFrame([("vay nong, forex",)], "text string")
    out = score_messages(df, CFG).select(summary("verdict").alias("s")).first()["s"]
    assert out == "5/5 · strong_phrases: vay nong (+3); medium_phrases: forex (+2)"


@pytest.fixture(scope="module")
def chat(spark):
    lists = {
        "chat_whitelist": spark.createDataFrame(
            [(0, "ok.com"), (1, "t.me/news"), (2, "only2.net")], "chat_id bigint, domain string"),
        "username_whitelist": spark.createDataFrame(
            [(0, "helper_one"), (2, "second_2")], "chat_id bigint, username string"),
        "phone_whitelist": spark.createDataFrame(
            [(1, "0912345678")], "chat_id bigint, phone string"),
    }
    chats = spark.createDataFrame([(1,), (2,)], "chat_id bigint")
    admins = spark.createDataFrame([(1, 9, "Boss_1")], "chat_id bigint, user_id bigint, username string")
    texts = ["a.ok.com/x and t.me/news/1 t.me/other", "@helper_one @second_2 @boss_1 @guard_1",
             "0912345678 only2.net", "nothing", "ok.com t.me/news xok.com"]
    rows = [(i * 10 + c, c, t) for i, t in enumerate(texts) for c in (1, 2)]
    msgs = spark.createDataFrame(rows, "message_id bigint, chat_id bigint, text string")
    return msgs, lists, chats, admins


def attached(chat, limit, monkeypatch):
    msgs, lists, chats, admins = chat
    monkeypatch.setattr(L, "MAX_BUNDLE_ENTRIES", limit)
    out = score_messages(msgs, ModerationConfig(), lambda f: M.attach_lists(
        f, lists, admins, "Guard_1"))
    return {r.message_id: (r.verdict.score, r.verdict.reasons) for r in out.collect()}


def test_lists_as_bundle_and_as_tables_agree(chat, monkeypatch):
    bundle = attached(chat, 500, monkeypatch)
    assert bundle == attached(chat, 0, monkeypatch)
    assert bundle[1] == (5, ["unknown_link: t.me/other (+5)"])
    assert bundle[2] == (5, ["unknown_link: t.me/news/1, t.me/other (+5)"])
    assert bundle[11] == (5, ["unknown_mention: @second_2 (+5)"])
    assert bundle[12] == (5, ["unknown_mention: @boss_1 (+5)"])
    assert bundle[21] == (5, ["unknown_link: only2.net (+5)"])
    assert bundle[22] == (5, ["unknown_phone: 0912345678 (+5)"])
    assert bundle[31] == (0, [])


def test_banned_phrases(spark, monkeypatch):
    words = spark.createDataFrame(
        [(0, "lừa đảo"), (1, "lua dao"), (0, "ё"), (0, "!!"), (2, "gái gọi")],
        "chat_id bigint, phrase string")
    chats = spark.createDataFrame([(1,), (2,)], "chat_id bigint")
    msgs = spark.createDataFrame([
        (1, 1, "giờ này lựa đào nè"), (2, 1, "L.Ừ.A Đ.Ả.O"), (3, 1, "lu@ d@o"), (4, 2, "lu@ d@o"),
        (5, 2, "l ừ a đ ả o gái gọi"), (6, 2, "xin chào")],
        "message_id bigint, chat_id bigint, text string")
    from quietroom.functions.text import normalize_keep_accents
    msgs = msgs.withColumn("keep_text", normalize_keep_accents("text"))
    want = {1: [], 2: ["lừa đảo"], 3: ["lua dao", "lừa đảo"], 4: ["lừa đảo"],
            5: ["gái gọi", "lừa đảo"], 6: []}
    for limit in (100, 1):
        monkeypatch.setattr(L, "PHRASES_PER_BUNDLE", limit)
        got = L.with_banned_hits(msgs, words).collect()
        assert {r.message_id: r.banned_hits for r in got} == want


def test_equal_numbers_in_two_chats_stay_apart(spark, monkeypatch):
    """Phrases and allowed links of one chat say nothing about a message of the same number in
    another; one phrase may be listed in more chats than a bundle has rows."""
    from quietroom.functions.text import normalize_keep_accents
    words = spark.createDataFrame([(c, "alpha") for c in range(10, 40)] + [(1, "beta"), (1, "gamma"), (2, "delta")],
                                  "chat_id bigint, phrase string")
    msgs = spark.createDataFrame([(7, 1, 5, "alpha beta gamma delta"), (7, 2, 5, "alpha beta gamma delta"),
                                  (7, 2, 6, "beta"), (7, 20, 5, "alpha beta")],
                                 "message_id bigint, chat_id bigint, ts_s bigint, text string")
    msgs = msgs.withColumn("keep_text", normalize_keep_accents("text"))
    want = [(1, 5, ["beta", "gamma"]), (2, 5, ["delta"]), (2, 6, []), (20, 5, ["alpha"])]
    for limit in (100, 1):
        monkeypatch.setattr(L, "PHRASES_PER_BUNDLE", limit)
        got = L.with_banned_hits(msgs, words).select("chat_id", "ts_s", "banned_hits").collect()
        assert sorted(tuple(r) for r in got) == want
    texts = spark.createDataFrame([(7, 1, "see a.com/x and b.com"), (7, 2, "see a.com/x and b.com")],
                                  "message_id bigint, chat_id bigint, text string")
    empty = {n: spark.createDataFrame([], f"chat_id bigint, {v} string") for n, v in (
        ("username_whitelist", "username"), ("phone_whitelist", "phone"))}
    lists = {**empty, "chat_whitelist": spark.createDataFrame([(1, "a.com"), (2, "b.com")],
                                                              "chat_id bigint, domain string")}
    for limit in (500, 0):
        monkeypatch.setattr(L, "MAX_BUNDLE_ENTRIES", limit)
        out = score_messages(texts, ModerationConfig(), lambda f: M.attach_lists(f, lists)).collect()
        assert sorted((r.chat_id, r.verdict.reasons) for r in out) == [
            (1, ["unknown_link: b.com (+5)"]), (2, ["unknown_link: a.com/x (+5)"])]


def test_every_payload_counts(spark):
    df = spark.createDataFrame([(1, "", True, ["000201010212530370454065802VN", "tg://join?invite=x"])],
                               "message_id bigint, text string, has_qr boolean, qr_payloads array<string>")
    v = score_messages(df, ModerationConfig()).first().verdict
    assert [r.split(" (")[0] for r in v.reasons if r.startswith("qr_")] == ["qr_code", "qr_payment", "qr_invite"]
    assert v.score == 2 + 5 + 5
