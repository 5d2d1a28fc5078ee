import duckdb
import pytest
from pyspark.sql import functions as F

from quietroom.checks import ORACLE, QUERIES
from quietroom.config import ModerationConfig
from quietroom.functions.dictionaries import dictionary_table, preset_table
from quietroom.operators import actions as A
from quietroom.operators import images as I
from quietroom.operators import lists as L
from quietroom.plans.moderate import moderate
from quietroom.plans import reports as P
from quietroom.schemas import MESSAGE, RULE_TABLES
from quietroom.sources import tables as S
from quietroom.sources.storage import new_folder

CFG = ModerationConfig()
FOLDER = "/root/testdata/sf0.001"
PICKED = ("strip_diacritics", "extract_urls", "hostname", "url_allowed", "blocked_sender",
          "exclude_exempt", "settings_as_of", "member_activity", "ban_brake", "purge_plan",
          "service_delete_plan", "chat_stats", "recent_bans", "list_counts", "effective_config",
          "pick_rendition", "undo_last_ban", "preset_summary", "stream_offence_sink",
          "banned_phrase_index", "moderate_to_log", "rule_qr_payload")


@pytest.mark.parametrize("name", PICKED)
def test_query_equals_sql(spark, name):
    duck = duckdb.connect()
    for t in ("region nation customer supplier part events documents pages labels "
              "conversations").split():
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    df = QUERIES[name](spark, FOLDER)
    cur = duck.execute(ORACLE[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(repr, (tuple(r) for r in df.select(names).collect()))) == sorted(
        map(repr, cur.fetchall()))


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)


def test_resolve_action(spark):
    df = spark.createDataFrame([
        ("ban", False, 5), ("mute", False, 5), ("mute", True, -7), ("ban", False, None),
        ("report", True, -7), ("delete", False, 5)],
        "mode string, by_channel boolean, offender_id bigint").withColumn("ts_s", F.lit(100))
    got = [tuple(r) for r in A.resolve_action(df, CFG).select("action", "until").collect()]
    assert got == [("ban", None), ("mute", 86500), ("ban", None), ("delete", None),
                   ("report", None), ("delete", None)]


def test_service_settings_precedence(spark):
    chats = spark.createDataFrame([(1,), (2,), (3,)], "chat_id bigint")
    own = [("svc:1", "pin"), ("svc:2", "")]
    both = own + [("svc:0", "title,photo")]

    def kinds(rows):
        s = spark.createDataFrame(rows + [("action", "ban")], "key string, value string")
        return {r.chat_id: r.kinds for r in A.service_kinds(s, chats, CFG).collect()}

    assert kinds(both) == {1: ["pin"], 2: [], 3: ["title", "photo"]}
    assert kinds(own) == {1: ["pin"], 2: [], 3: ["join", "leave", "pin"]}


def test_service_kind_order(spark):
    df = spark.createDataFrame([(["boost_added", "pinned_message"],), (["none"],), ([],)],
                               "f array<string>")
    assert [r[0] for r in df.select(A.classify_service_message("f")).collect()] == [
        "pin", None, None]


def test_presets(spark):
    presets = preset_table(spark)
    words = spark.createDataFrame([(0, "scam"), (1, "ponzi")], "chat_id bigint, phrase string")
    loaded = L.load_preset(presets, ["tocao"], words, 0).collect()
    assert len(loaded) == 16 and [r.phrase for r in loaded if r.already] == ["scam"]
    left = L.unload_preset(words, presets, ["tocao"], 0).collect()
    assert [tuple(r) for r in left] == [(1, "ponzi")]
    with pytest.raises(KeyError):
        L.preset_phrases(presets, ["tocao", "nope"])
    counts = {r.name: r.phrases for r in P.preset_summary(presets).collect()}
    assert counts["cobac"] == 11 and len(counts) == 8
    assert dictionary_table(spark).count() == 138


def test_rendition_choice(spark):
    ddl = (f"id int, photo array<struct<{I.RENDITION}>>, document struct<{I.RENDITION},"
           f"mime_type:string,animated:boolean>, sticker struct<{I.RENDITION},mime_type:string,"
           "animated:boolean>")
    p = lambda n, size, w, h: (n, f"u{n}", size, w, h)
    d = lambda n, size, mime, anim: (n, f"u{n}", size, 1, 1, mime, anim)
    rows = [
        (1, [p("s", 1, 90, 60), p("m", 5, 1280, 720), p("l", 8, 2560, 1440)], None, None),
        (2, [p("s", 1, 90, 60), p("m", 5, 800, 600)], None, None),
        (3, [p("s", 1, 90, 60), p("m", 50, 1280, 720)], None, None),
        (4, [p("m", 50, 1280, 720)], d("doc", 1, "image/png", None), None),
        (5, None, d("doc", 1, "image/png", None), None), (6, None, d("doc", 1, "text/x", None), None),
        (7, [], None, d("st", None, None, False)), (8, [], None, d("st", 1, None, True)),
    ]
    got = I.pick_rendition(spark.createDataFrame(rows, ddl), 10).select("id", "image.file_id")
    assert {r.id: r.file_id for r in got.collect()} == {
        1: "m", 2: "m", 3: "s", 4: None, 5: "doc", 6: None, 7: "st", 8: None}


def test_report_rows(spark):
    df = spark.createDataFrame([
        (1, 1, "ban", "Al", "al_1", None, 5, "x" * 500, None, (7, 5, ["a: b (+5)", "c (+2)"], True)),
        (2, 1, "report", None, None, "News", -5, "", None, (5, 5, ["d (+5)"], True)),
        (3, 1, "mute", "Bo" * 60, None, None, None, None, "cap", (5, 5, ["e (x) (+5)"], True))],
        "message_id bigint, chat_id bigint, action string, sender_name string, username string, "
        "channel_title string, offender_id bigint, text string, caption string, verdict struct<"
        "score:int,threshold:int,reasons:array<string>,is_spam:boolean>").withColumn("ts_s", F.lit(0))
    got = {r.message_id: r for r in P.moderation_report(df).collect()}
    assert (got[1].action, got[1].who, got[1].why, len(got[1].excerpt)) == (
        "BAN", "Al (@al_1)", "a: b; c", 300)
    assert (got[2].who, got[2].excerpt) == ("News", P.NO_TEXT)
    assert (got[3].why, got[3].offender_id, got[3].excerpt) == ("e (x)", 0, "cap")
    rows = {r.message_id: r for r in P.offence_rows(df).collect()}
    assert (len(rows[1].excerpt), rows[1].reasons) == (400, "a: b (+5); c (+2)")
    assert len(rows[3].name) == 80
    path = new_folder(spark, "offences")
    S.write_offences(P.offence_rows(df), path)
    S.write_offences(P.offence_rows(df), path)
    assert S.read_offences(spark, path).count() == 6


def test_a_day_of_offences_is_one_file_unless_it_is_large(spark, monkeypatch):
    monkeypatch.setattr(S, "ROWS_PER_FILE", 100)
    conf = spark.conf
    conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # as with many partitions
    try:
        hours = spark.range(1000).selectExpr("id", "CASE WHEN id >= 600 THEN id * 3600 WHEN id % 2 = 0 THEN 7200 END AS ts_s")
        rows = hours.selectExpr("id AS message_id", "id % 5 AS chat_id", "id % 37 AS user_id", "ts_s", "'x' AS excerpt")
        path = new_folder(spark, "offences")
        S.write_offences(rows, path)
    finally:
        conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    back = S.read_offences(spark, path).withColumn("file", F.input_file_name())
    assert back.drop("date", "file").exceptAll(rows).isEmpty() and back.count() == 1000
    files = {str(r.date): r.n for r in back.groupBy("date").agg(F.countDistinct("file").alias("n")).collect()}
    assert 2 <= files.pop("1970-01-01") <= 4 and 2 <= files.pop("None") <= 4
    assert len(files) == 17 and set(files.values()) == {1}


def test_panel_states(spark):
    off = spark.createDataFrame([(1, "ban")], "ts_s bigint, action string")

    def state(*rows):
        s = spark.createDataFrame(list(rows), "key string, value string")
        r = P.panel_summary(s, off, CFG, 1000).first()
        return r.state, r.minutes_left, r.braked_today

    assert state(("pause_until", "1130"), ("action", "report")) == ("paused", 2, False)
    assert state(("pause_until", "0"), ("action", "REPORT ")) == ("trial", None, False)
    assert state(("action", ""), ("brake_at", "900")) == ("protecting", None, True)


def test_messages_from_json_and_missing_columns(spark):
    path = new_folder(spark, "json")
    spark.createDataFrame([(1, "hi", ["u"])], "message_id bigint, text string, entity_urls array<string>"
                          ).write.json(path)
    m = S.read_messages(spark, path, "json")
    r = m.first()
    assert (r.message_id, r.text, r.entity_urls, r.is_forward) == (1, "hi", ["u"], None)
    assert len(m.columns) == MESSAGE.count(",") + 1


def test_live_explanation_matches_scan(spark):
    ids = "chat_id bigint, "
    msgs = spark.createDataFrame(
        [(1, 1, 5, None, "hi", True), (2, 1, 6, None, "hi", True), (3, 1, 7, None, "hi", False)],
        "message_id bigint, chat_id bigint, user_id bigint, sender_chat_id bigint, text string, "
        "is_forward boolean")
    out = P.explain_messages(
        msgs, spark.createDataFrame([], ids + "phrase string"),
        spark.createDataFrame([(0, 7)], ids + "entity_id bigint"),
        spark.createDataFrame([(1, 5)], ids + "user_id bigint"),
        spark.createDataFrame([(1,)], "chat_id bigint"), CFG, mode="live")
    assert {r.message_id: (r.label, r.note) for r in out.collect()} == {
        1: ("clean", "may forward"), 2: ("spam", ""), 3: ("spam: blocked", "blocked sender")}


def test_moderate_from_files(spark):
    """Messages with most fields absent, no list tables at all."""
    path, lists = new_folder(spark, "json"), new_folder(spark, "lists")
    day = 86400
    rows = [(1, 1, 5, 0, "hello"), (2, 1, 5, 5 * day, "vay nong, lo de"),
            (3, 1, 5, 5 * day + 9, "uy tin"), (4, 1, 5, 5 * day + 10, "uy tin"),
            (5, 1, 5, 5 * day + 20, "lo de co khong?"), (6, 1, 9, 7, "lo de, tai xiu"),
            (7, 2, 5, 8, "lo de")]
    spark.createDataFrame(rows, "message_id bigint, chat_id bigint, user_id bigint, ts_s bigint, "
                          "text string").write.json(path)
    chats = spark.createDataFrame([(1,), (2,)], "chat_id bigint")
    admins = spark.createDataFrame([(1, 9, "boss")], "chat_id bigint, user_id bigint, username string")
    known = spark.createDataFrame([(1, True), (2, False)], "chat_id bigint, known boolean")
    log = spark.createDataFrame([(1, 0, "action", "Ban")],
                                "id bigint, ts_s bigint, key string, value string")
    out = moderate(S.read_messages(spark, path, "json"), S.read_rules(spark, lists, optional=tuple(RULE_TABLES)), chats, admins,
                   known, ModerationConfig(action="report"), settings_log=log)
    got = sorted((r.message_id, r.is_new, r.prior_offences, r.verdict.score, r.mode)
                 for r in out.collect())
    # 2: two strong phrases; 3 and 4: new again after a ban, 1 + 2 and 1 + 4 points
    assert got == [(2, True, 0, 4, "ban"), (3, True, 1, 3, "ban"), (4, True, 2, 5, "ban")]


def test_missing_list_is_an_error(spark):
    folder = new_folder(spark, "lists")
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        S.read_rules(spark, folder)


def test_stored_settings_win(spark):
    s = spark.createDataFrame([("cfg:block_links", "0"), ("cfg:scan_qr", "yes"), ("action", " MUTE ")],
                              "key string, value string")
    cfg = L.resolve_config(s, ModerationConfig(scan_qr=False, mute_seconds=7))
    assert (cfg.block_links, cfg.scan_qr, cfg.action, cfg.mute_seconds) == (False, False, "mute", 7)
