import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quietroom.config import ModerationConfig
from quietroom.operators import lists as L
from quietroom.operators import running as RUN
from quietroom.operators import state as T
from quietroom.sources.storage import new_folder
from quietroom.streaming import live

DAY = 86400
SIG = "array<struct<reason:string,points:int>>"
DDL = f"""message_id bigint, chat_id bigint, user_id bigint, sender_chat_id bigint, ts_s bigint,
signals_new {SIG}, signals_old {SIG}, forced_reason string, action string"""
CFG = ModerationConfig()


def random_log(seed, n, users=6, gap=20000):
    """Messages whose points are often near the thresholds; user 1 sends a third of them."""
    rnd = random.Random(seed)
    rows, joins, ts = [], [], 1_700_000_000
    for i in range(n):
        ts += rnd.choice([0, 0, 60, rnd.randint(0, gap)])
        user = 1 if rnd.random() < 0.34 else rnd.randint(2, users)
        chat = 1 if user == 1 else rnd.randint(1, 2)
        if rnd.random() < 0.08:
            joins.append((10_000 + i, chat, user, ts))
            continue
        old = rnd.choice([0, 0, 0, 1, 1, 2, 3, 4, 5, 6])
        # a hard hit is worth the threshold; newcomer rules add points
        if old >= 5 and rnd.random() < 0.5:
            new = 3 + rnd.randint(0, 2)
        else:
            new = old + rnd.choice([0, 0, 1, 2]) if old < 5 else old
        channel = -50 - user if rnd.random() < 0.05 else None
        forced = "blocked_sender" if rnd.random() < 0.02 else None
        mode = rnd.choice(["ban"] * 4 + ["mute", "delete", "report"])
        sig = lambda p: [("rule", p)] if p else []
        rows.append((i, chat, user, channel, ts, sig(new), sig(old), forced, mode))
    return rows, joins


def by_hand(rows, joins, logged, members, cfg=CFG, carry=None):
    """The same history told one event at a time; ``logged`` holds (chat, user, time).

    ``carry``: (managed chats, admins as (chat, user)); bans then reach the other chats a second later.
    """
    events = [(r[4], 1, r[0], r) for r in rows] + [(j[3], 0, j[0], j) for j in joins]
    events += [(t, 2, i, (None, chat, user)) for i, (chat, user, t) in enumerate(logged)]
    seen, count, record = {}, Counter(), Counter()
    for (chat, user), (first, n) in members.items():
        seen[chat, user], count[chat, user] = first, n
    out, pending = [], []
    for ts, is_msg, _, e in sorted(events, key=lambda e: e[:3]):
        for at, chat, user in [x for x in pending if x[0] < ts]:
            seen.pop((chat, user), None)
            count[chat, user] = 0
        pending = [x for x in pending if x[0] >= ts]
        key = (e[1], e[2])
        if is_msg == 2:
            record[key] += 1
            continue
        if not is_msg:
            seen.setdefault(key, ts)
            continue
        mid, chat, user, channel, _, s_new, s_old, forced, mode = e
        if channel is None:
            seen.setdefault(key, ts)
            count[key] += 1
            new, n = ts - seen[key] < DAY or count[key] <= 3, record[key]
        else:
            new, n = False, 0
        points = sum(p for _, p in (s_new if new else s_old))
        score, limit = points + (min(2 * n, 4) if points else 0), cfg.threshold_for(new)
        if forced:
            score, limit = 9999, 1
        if score < limit:
            continue
        out.append((mid, channel or user, new, n, score))
        if channel is None:
            record[key] += 1
            if mode == "ban":
                del seen[key]
                count[key] = 0
                if carry:
                    pending += [(ts, c, user) for c in carry[0] if c != chat and (c, user) not in carry[1]]
    return sorted(out)


@pytest.mark.parametrize("seed, n, gap", [(1, 700, 20000), (2, 900, 100000), (3, 500, 3000)])
def test_replay_against_hand(spark, seed, n, gap):
    rows, joins = random_log(seed, n, gap=gap)
    logged = [(1, 2, 5), (1, 4, 5), (1, 4, 9)] + [(2, 3, t) for t in range(5)] if seed != 2 else []
    logged += [(r[1], r[2], r[4] + d) for r, d in zip(rows[50::90], (0, 1, 10 ** 9, 50, 5000))]
    members = {(1, 1): (1_600_000_000, 50), (2, 5): (1_699_999_000, 2)} if seed != 3 else {}
    scored = spark.createDataFrame(rows, DDL)
    j = spark.createDataFrame(joins, "id bigint, chat_id bigint, user_id bigint, ts_s bigint")
    m = spark.createDataFrame([(*k, *v, False) for k, v in members.items()],
                              "chat_id bigint, user_id bigint, first_seen bigint, "
                              "msg_count bigint, trusted boolean")
    o = spark.createDataFrame(logged, "chat_id bigint, user_id bigint, ts_s bigint")
    for cfg in (CFG, ModerationConfig(new_member_threshold=7)):  # the second for old members is lower
        got = T.replay_verdicts(scored, j, cfg, m, o).select(
            "message_id", "offender_id", "is_new", "prior_offences", "verdict.score").collect()
        assert sorted(tuple(r) for r in got) == by_hand(rows, joins, logged, members, cfg)


@pytest.mark.parametrize("seed, n, gap", [(11, 500, 9000), (12, 600, 60000), (13, 400, 2000)])
def test_bans_are_carried_to_other_chats(spark, seed, n, gap):
    rows, joins = random_log(seed, n, gap=gap)
    rnd = random.Random(seed)
    chats = {(r[0]): rnd.randint(1, 4) for r in rows}  # every sender in several chats, two of them in the same second
    rows = [(r[0], chats[r[0]], *r[2:]) for r in rows]
    managed, admins = [1, 2, 3], {(2, 1), (3, 2)}
    members = {(1, 1): (1_600_000_000, 50), (2, 5): (1_699_999_000, 2), (3, 1): (1_600_000_000, 9)}
    logged = [(1, 2, 5), (1, 4, 5), (2, 3, 1_700_001_000)]
    tables = (spark.createDataFrame([(c,) for c in managed], "chat_id bigint"),
              spark.createDataFrame(sorted(admins), "chat_id bigint, user_id bigint"),
              spark.createDataFrame([(*k, *v, False) for k, v in members.items()],
                                    "chat_id bigint, user_id bigint, first_seen bigint, msg_count bigint, trusted boolean"),
              spark.createDataFrame(logged, "chat_id bigint, user_id bigint, ts_s bigint"))
    j = spark.createDataFrame(joins, "id bigint, chat_id bigint, user_id bigint, ts_s bigint")
    for cfg in (CFG, ModerationConfig(new_member_threshold=7)):
        got = T.replay_across_chats(spark.createDataFrame(rows, DDL), j, cfg, *tables).select(
            "message_id", "offender_id", "is_new", "prior_offences", "verdict.score").collect()
        want = by_hand(rows, joins, logged, members, cfg, (managed, admins))
        assert sorted(tuple(r) for r in got) == want
        if cfg is CFG:
            assert want != by_hand(rows, joins, logged, members, cfg)


def test_the_switch_keeps_bans_at_home(spark):
    rows, joins = random_log(11, 200, gap=9000)
    rows = [(r[0], r[0] % 3 + 1, *r[2:]) for r in rows]
    scored = spark.createDataFrame(rows, DDL).withColumn("ban_all_groups", F.lit(False))
    none = spark.createDataFrame([], "id bigint, chat_id bigint, user_id bigint, ts_s bigint")
    got = T.replay_across_chats(scored, none, CFG, none, none).select(
        "message_id", "offender_id", "is_new", "prior_offences", "verdict.score").collect()
    assert sorted(tuple(r) for r in got) == by_hand(rows, [], [], {})


def test_edited_messages_are_messages(spark):
    """One message, delivered four times as an offence, is four offences with a growing record."""
    spam = [("rule", 5)]
    rows = [(1, 1, 7, None, t, spam, spam, None, "delete") for t in (100, 200, 300, 400)]
    rows += [(1, 2, 7, None, 250, [], [], None, "delete")]
    got = T.replay_verdicts(spark.createDataFrame(rows, DDL), None, CFG).select(
        "chat_id", "ts_s", "prior_offences").collect()
    assert sorted(tuple(r) for r in got) == [(1, 100, 0), (1, 200, 1), (1, 300, 2), (1, 400, 3)]


def test_later_offences_do_not_count(spark):
    rows = [(1, 1, 7, None, 1000, [("rule", 2)], [("rule", 2)], None, "delete")]
    past = spark.createDataFrame([(1, 7, 2000)], "chat_id bigint, user_id bigint, ts_s bigint")
    assert T.replay_verdicts(spark.createDataFrame(rows, DDL), None, CFG, offences=past).count() == 0


def test_stream_equals_replay(spark):
    rows, joins = random_log(5, 400)
    folder = new_folder(spark, "scored")
    cuts = [0, 130, 260, 10_000]
    for batch, (lo, hi) in enumerate(zip(cuts, cuts[1:])):
        part = spark.createDataFrame([r for r in rows if lo <= r[0] < hi], DDL)
        j = spark.createDataFrame([x for x in joins if lo <= x[0] - 10_000 < hi],
                                  "id bigint, chat_id bigint, user_id bigint, ts_s bigint")
        past = spark.createDataFrame([(1, 1, 3, 1_700_000_500)] if batch == 0 else [],
                                     "id bigint, chat_id bigint, user_id bigint, ts_s bigint")
        for _ in range(2):  # a batch that is run again is not written again
            live.write_batch(live.stream_rows(part, j, past).coalesce(1), folder, batch)
    initial = spark.createDataFrame([(1, 2, None, 0, 1)], "chat_id bigint, user_id bigint, "
                                    "first_seen bigint, msg_count bigint, offences bigint")
    out, sink = new_folder(spark, "out"), new_folder(spark, "cp")
    for _ in range(2):  # the second run finds nothing new
        stream = live.stream_verdicts(live.read_scored(spark, folder, 1), CFG, initial)
        live.start_offence_sink(stream, out, sink, available_now=True).awaitTermination()
        live.write_batch(live.stream_rows(part, j).coalesce(1), folder, 2)
    got = spark.read.parquet(out).select("message_id", "user_id", "is_new", "prior_offences",
                                         "score").collect()
    assert sorted(tuple(r) for r in got) == by_hand(
        rows, joins, [(1, 2, 0), (1, 3, 1_700_000_500)], {})


def test_running_equals_window(spark):
    from pyspark.sql import Window
    rnd = random.Random(3)
    rows = [(1 if rnd.random() < 0.5 else rnd.randint(2, 5), rnd.randint(0, 200_000), i,
             rnd.randint(-5, 9)) for i in range(600)]
    df = spark.createDataFrame(rows, "k bigint, ts_s bigint, id bigint, v bigint")
    order = ["ts_s", "id"]
    w = Window.partitionBy("k").orderBy(*order)
    for inclusive in (True, False):
        frame = w.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
        want = df.select("id", F.coalesce(F.sum("v").over(frame), F.lit(0)).alias("s"),
                         F.min("v").over(frame).alias("lo"), F.max("v").over(frame).alias("hi"),
                         F.lead("v").over(w).alias("nxt"))
        got = RUN.running(df, ["k"], order, {
            "s": ("sum", F.col("v")), "lo": ("min", F.col("v")), "hi": ("max", F.col("v"))},
            inclusive, {"nxt": F.col("v")}, width=10_000).select("id", "s", "lo", "hi", "nxt")
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_hot_sender_is_split(spark):
    """The window over a sender's rows is keyed by time slice as well."""
    df = spark.range(1000).select((F.col("id") % 2).alias("k"), (F.col("id") * 60).alias("ts_s"), "id")
    out = RUN.running(df, ["k"], ["ts_s", "id"], {"n": ("sum", F.lit(1))}, width=3600)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"Window \[", plan)) == 2
    assert len(re.findall(r"windowspecdefinition\(k#\d+L?, _slice#\d+L?, ts_s", plan)) == 1
    assert len(re.findall(r"windowspecdefinition\(k#\d+L?, _slice#\d+L? ASC", plan)) == 1


def test_as_of_small_and_large_log(spark, monkeypatch):
    rnd = random.Random(8)
    rows = [(i, rnd.randint(0, 400_000)) for i in range(300)]
    log = [(i, rnd.randint(50_000, 350_000), f"v{i}") for i in range(25)] + [(99, 100_000, "a"),
                                                                            (98, 100_000, "b")]
    df = spark.createDataFrame(rows, "message_id bigint, ts_s bigint")
    changes = spark.createDataFrame(log, "id bigint, ts_s bigint, value string")
    want = {}
    for mid, ts in rows:
        past = [(t, i, v) for i, t, v in log if t <= ts]
        want[mid] = max(past)[2] if past else None
    small = {r.message_id: r.x for r in T.as_of(df, changes, "value", "x").collect()}
    monkeypatch.setattr(T, "is_small", lambda d: False)
    large = {r.message_id: r.x for r in T.as_of(df, changes, "value", "x").collect()}
    assert small == want and large == want


@pytest.mark.parametrize("seconds,changes", [(86_400, 20_000), (40, 200), (1_000_000_000, 300), (1, 1)])
def test_busy_day_is_cut_finely(spark, seconds, changes):
    """A row meets a few pieces of a log, not all changes of its day; and the pieces are not many more than these."""
    log = spark.range(changes).select(
        F.col("id").alias("_id"), (700_000 + F.pmod(F.xxhash64("id"), F.lit(seconds))).alias("ts_s"),
        F.col("id").cast("string").alias("_value"))
    valid, slot = T._pieces(log)
    sizes = [r["count"] for r in valid.groupBy("_slot").count().collect()]
    assert max(sizes) <= 8 and sum(sizes) <= 10 * changes
    ends = valid.select(F.max("_from").alias("x"), F.max("_slot").alias("s")).first()
    far = spark.createDataFrame([(ends.x,), (ends.x + 10 ** 9,)], "ts_s bigint").select(slot(F.col("ts_s")).alias("s"))
    assert {r.s for r in far.collect()} == {ends.s}


def test_as_of_odd_rows(spark):
    """Rows without a time, before and long after a log; a log with a change without a time; an empty log."""
    df = spark.createDataFrame([(1, None), (2, 5), (3, 10), (4, 19), (5, 20), (6, 10 ** 10), (7, -50)],
                               "id bigint, ts_s bigint")
    log = spark.createDataFrame([(1, 10, "a"), (2, 20, "b"), (3, 20, None), (4, None, "x"), (5, -40, "n")],
                                "id bigint, ts_s bigint, value string")
    got = {r.id: r.v for r in T.as_of(df, log, "value", "v").collect()}
    assert got == {1: None, 2: "n", 3: "a", 4: "a", 5: None, 6: None, 7: None}
    assert {r.v for r in T.as_of(df, log.limit(0), "value", "v").collect()} == {None}


def test_pause(spark):
    log = spark.createDataFrame([(1, 100, "pause_until", "200"), (2, 300, "pause_until", "bad"),
                                 (3, 400, "pause_until", "0")],
                                "id bigint, ts_s bigint, key string, value string")
    df = spark.createDataFrame([(t,) for t in (50, 150, 200, 350, 450)], "ts_s bigint")
    kept = [r.ts_s for r in T.exclude_paused(df, log).collect()]
    assert sorted(kept) == [50, 200, 350, 450]
    until = spark.createDataFrame([(10, 5), (10, 0)], "ts bigint, m int").select(
        T.pause_until("ts", "m").alias("u")).collect()
    assert [r.u for r in until] == [310, 315360010]


def brake_by_hand(rows, resets, limit, window):
    done, out, off = [], {}, False
    resets = sorted(resets)
    for ts, i, action in sorted((t, i, a) for i, t, a in rows):
        while resets and resets[0] <= ts:
            resets.pop(0)
            off = False
        out[i] = "report" if off else action
        if not off and action in ("ban", "mute"):
            done.append(ts)
            if sum(t >= ts - window for t in done) >= limit:
                off = True
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_apply_brake_against_hand(spark, seed):
    rnd = random.Random(seed)
    rows = [(i, rnd.randint(0, 3000), rnd.choice(["ban", "ban", "mute", "delete"]))
            for i in range(400)]
    resets = [rnd.randint(0, 3000) for _ in range(25)]
    df = spark.createDataFrame(rows, "id bigint, ts_s bigint, action string")
    r = spark.createDataFrame([(i, t) for i, t in enumerate(resets)], "id bigint, ts_s bigint")
    cfg = ModerationConfig(brake_limit=4, brake_window=60)
    got = {x.id: x.effective_action for x in T.apply_brake(df, r, cfg).collect()}
    assert got == brake_by_hand(rows, resets, 4, 60)


def test_ban_brake_window_is_inclusive(spark):
    df = spark.createDataFrame([(0, "ban"), (60, "mute"), (61, "ban"), (61, "delete")],
                               "ts_s bigint, action string")
    got = sorted(tuple(r) for r in T.ban_brake(df, 2, 60).collect())
    assert got == [(0, 1, 1, False), (60, 1, 2, True), (61, 1, 2, True)]
    assert not any(r.brake for r in T.ban_brake(df, 0, 60).collect())


def test_list_edits(spark):
    table = spark.createDataFrame([(1, "a", 10), (2, "b", 20), (3, "c", 30)], "k int, v string, t int")
    edits = spark.createDataFrame([
        ("add", 1, 1, "x", 11), ("set", 2, 2, "y", 21), ("delete", 3, 3, None, None),
        ("add", 4, 4, "n", 40), ("set", 5, 4, "m", 41), ("delete", 6, 1, None, None),
        ("set", 7, 1, "z", 12), ("add", 8, 1, "w", 13), ("delete", 9, 9, None, None)],
        "op string, seq bigint, k int, v string, t int")
    got = L.apply_list_changes(table, edits, ["k"], kept=("t",)).collect()
    assert sorted(tuple(r) for r in got) == [(1, "z", 12), (2, "y", 20), (4, "m", 40)]


def test_prior_offences_counts_strictly_earlier(spark):
    msgs = spark.createDataFrame([(1, 1, 7, 100), (2, 1, 7, 200), (3, 2, 7, 300)],
                                 "message_id bigint, chat_id bigint, user_id bigint, ts_s bigint")
    past = spark.createDataFrame([(5, 1, 7, 100), (6, 1, 7, 150), (7, 1, 8, 1)],
                                 "id bigint, chat_id bigint, user_id bigint, ts_s bigint")
    got = {r.message_id: r.prior_offences for r in T.prior_offences(msgs, past).collect()}
    assert got == {1: 0, 2: 2, 3: 0}


