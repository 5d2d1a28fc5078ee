"""Per-sender history: activity, earlier offences, and verdicts that feed back into it."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator
from dataclasses import replace

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import SWITCHES, ModerationConfig
from ..sources.shipping import ship
from ..sources.storage import staged
from .lists import broadcast_if_small, is_small
from .running import running
from .scoring import forced_verdict, total, verdict

KEY = ["chat_id", "user_id"]
DAY = 86400
SLOTS = 500_000  # slots of time, at most, into which a broadcast log is cut
BANNING = ("ban", "mute")


def _as_user(msgs: DataFrame) -> DataFrame:
    return msgs.filter(F.col("sender_chat_id").isNull()) if "sender_chat_id" in msgs.columns else msgs


def _with_life(rows: DataFrame, resets: DataFrame | None) -> DataFrame:
    """Add ``life``: how often the sender was forgotten in the chat before each row, by bans
    carried over from elsewhere (``resets``: chat_id, user_id, ts_s).  One that falls into the
    second of a row comes after it."""
    if resets is None:
        return rows.withColumn("life", F.lit(0).cast("bigint"))
    both = rows.withColumn("_reset", F.lit(0)).unionByName(
        resets.select(*KEY, "ts_s", F.lit(1).alias("_reset")), allowMissingColumns=True)
    lives = running(both, KEY, ["ts_s", "_reset"], {"life": ("sum", F.col("_reset").cast("bigint"))})
    return staged(lives.filter("_reset = 0").drop("_reset"))


def _timeline(msgs: DataFrame, joins: DataFrame | None, members: DataFrame | None,
              payload: tuple[str, ...] = (), resets: DataFrame | None = None) -> DataFrame:
    """User messages with ``first_seen``, ``msg_count`` (this one included), ``next_ts``, ``life``;
    the first three begin anew with each life."""
    rows = _as_user(msgs).select(*KEY, "ts_s", F.lit(1).alias("is_msg"),
                                 F.col("message_id").alias("id"), *payload)
    if joins is not None:
        rows = rows.unionByName(joins.select(
            *KEY, "ts_s", F.lit(0).alias("is_msg"), "id"), allowMissingColumns=True)
    rows = _with_life(rows, resets)
    order = ["ts_s", "is_msg", "id", *[c for c in payload if c == "_row"]]
    out = running(rows, KEY if resets is None else [*KEY, "life"], order, {
        "first_seen": ("min", F.col("ts_s")),
        "msg_count": ("sum", F.col("is_msg").cast("bigint")),
    }, following={"next_ts": F.col("ts_s")}).filter("is_msg = 1")
    if members is not None:
        known = members.select(*KEY, F.col("first_seen").alias("_seen"),
                               F.col("msg_count").alias("_count"), F.lit(0).cast("bigint").alias("life"))
        out = out.join(known, [*KEY, "life"], "left").withColumns({
            "first_seen": F.coalesce("_seen", "first_seen"),
            "msg_count": F.col("msg_count") + F.coalesce("_count", F.lit(0)),
        }).drop("_seen", "_count")
    return out.drop("is_msg").withColumnRenamed("id", "message_id")


def member_activity(msgs: DataFrame, joins: DataFrame | None = None,
                    members: DataFrame | None = None) -> DataFrame:
    """``first_seen`` and running ``msg_count`` of the sender at each message.

    A join counts as first sight but not as a message.  Messages sent as a channel have no
    member behind them and are left out.
    """
    return _timeline(msgs, joins, members).drop("next_ts", "life")


def _newcomer(age: Column, count: Column, cfg: ModerationConfig) -> Column:
    return (age < cfg.new_member_seconds) | (count <= cfg.new_member_messages)


def new_member_flag(activity: DataFrame, cfg: ModerationConfig) -> DataFrame:
    return activity.withColumn("is_new_member", _newcomer(
        F.col("ts_s") - F.col("first_seen"), F.col("msg_count"), cfg))


def prior_offences(msgs: DataFrame, offences: DataFrame) -> DataFrame:
    """How many offences of the sender in that chat came before each message."""
    rows = _as_user(msgs).select(*KEY, "ts_s", F.lit(0).alias("late"),
                                 F.col("message_id").alias("id"), F.lit(0).alias("_n"))
    past = offences.select(*KEY, "ts_s", F.lit(1).alias("late"), "id", F.lit(1).alias("_n"))
    counted = running(rows.unionByName(past), KEY, ["ts_s", "late", "id"],
                      {"prior_offences": ("sum", F.col("_n").cast("bigint"))})
    return counted.filter("late = 0").select(
        F.col("id").alias("message_id"), *KEY, "ts_s", "prior_offences")


# --- values that change over time -------------------------------------------------


def as_of(rows: DataFrame, log: DataFrame, value: str, out: str) -> DataFrame:
    """Add the latest ``log`` value at or before each row's ``ts_s``.

    A log of checked size is turned into pieces of validity, cut at the ends of short slots of time, and
    broadcast: an equi-join on the slot, no shuffle of the rows.  A larger one is merged with the
    rows by time slices.
    """
    changes = log.select("ts_s", F.col("id").alias("_id"), F.col(value).alias("_value"))
    if is_small(changes):
        valid, slot = _pieces(changes)
        inside = ((slot(rows["ts_s"]) == F.col("_slot"))
                  & (rows["ts_s"] >= F.col("_from"))
                  & (F.col("_until").isNull() | (rows["ts_s"] < F.col("_until"))))
        joined = rows.join(F.broadcast(valid), inside, "left")
        return joined.select(*rows.columns, F.col("_value").alias(out))
    # the answer depends on the second alone, so only distinct seconds meet the log; a slice of
    # time then holds no more rows than it has seconds and changes
    seconds = rows.select("ts_s").distinct().withColumn("_kind", F.lit(1))
    both = seconds.unionByName(changes.withColumn("_kind", F.lit(0)), allowMissingColumns=True)
    last = F.when(F.col("_kind") == 0, F.struct("ts_s", "_id", "_value"))
    done = running(both, [], ["ts_s", "_kind", "_id"], {"_last": ("max", last)}).filter("_kind = 1")
    answers = staged(done.select(F.col("ts_s").alias("_at"), F.col("_last._value").alias(out)))
    return rows.join(answers, rows["ts_s"] == F.col("_at"), "left").select(*rows.columns, out)


def _pieces(changes: DataFrame) -> tuple[DataFrame, Callable[[Column], Column]]:
    """``(_from, _until, _value, _slot)``: how long each change holds, once per slot of time it reaches into,
    and the slot of a time.

    There are some slots for each change, but no more than ``SLOTS``: so a slot has few pieces, one a second at
    most, and all of them stay in proportion to the log.  What comes after the last change is in its slot.
    """
    lo, hi, n = changes.agg(F.min("ts_s"), F.max("ts_s"), F.count("ts_s")).first()
    width = 1 if lo is None else max(1, -((lo - hi) // min(8 * n, SLOTS)))
    last = F.lit(0 if lo is None else hi // width).cast("bigint")

    def slot(ts: Column) -> Column:
        return F.least(F.floor(ts / width), last)

    valid = changes.withColumn("_until", F.lead("ts_s").over(Window.orderBy("ts_s", "_id")))
    valid = valid.filter("ts_s IS NOT NULL AND (_until IS NULL OR _until > ts_s)")
    upto = F.coalesce(slot(F.col("_until") - 1), last)
    return valid.select(F.col("ts_s").alias("_from"), "_until", "_value", F.explode(
        F.sequence(slot(F.col("ts_s")), upto)).alias("_slot")), slot


def settings_as_of(msgs: DataFrame, settings_log: DataFrame, key: str, out: str) -> DataFrame:
    return as_of(msgs, settings_log.filter(F.col("key") == key), "value", out)


def exclude_paused(msgs: DataFrame, settings_log: DataFrame) -> DataFrame:
    """Drop messages sent while moderation was paused."""
    now = settings_as_of(msgs, settings_log, "pause_until", "_pause")
    until = F.expr("try_cast(trim(_pause) AS BIGINT)")
    return now.filter(~F.coalesce(until > F.col("ts_s"), F.lit(False))).drop("_pause")


def switches_as_of(msgs: DataFrame, settings_log: DataFrame, cfg: ModerationConfig) -> DataFrame:
    """Add ``sw_<name>``, the state of every switch at each message.

    Each change of a switch begins an epoch, in which all switches have the values last stored, so
    that one look-up by time gives all of them.  Only "1" and "0" are understood; with any
    other value the default holds.
    """
    log = settings_log.filter(F.col("key").isin(*[f"cfg:{s}" for s in SWITCHES]))
    last = running(log, [], ["ts_s", "id"], {s: ("max", F.when(
        F.col("key") == f"cfg:{s}", F.struct("ts_s", "id", "value"))) for s in SWITCHES})
    raw = {s: F.col(s)["value"] for s in SWITCHES}
    epochs = last.select("ts_s", "id", F.struct(*[
        F.when(raw[s].isin("1", "0"), raw[s] == "1").alias(s) for s in SWITCHES]).alias("flags"))
    now = as_of(msgs, staged(epochs), "flags", "_flags")
    return now.withColumns({f"sw_{s}": F.coalesce(F.col(f"_flags.{s}"), F.lit(bool(getattr(cfg, s))))
                            for s in SWITCHES}).drop("_flags")


def at_each_message(cfg: ModerationConfig) -> ModerationConfig:
    """The configuration whose switches are the columns of ``switches_as_of``."""
    return replace(cfg, **{s: F.col(f"sw_{s}") for s in SWITCHES})


FOREVER_SECONDS = 315_360_000  # fixed value: a pause without an end lasts ten years


def pause_until(ts, minutes) -> Column:
    ts, minutes = F.col(ts), F.col(minutes)
    return ts + F.when(minutes <= 0, F.lit(FOREVER_SECONDS)).otherwise(minutes * 60)


# --- verdicts with feedback -------------------------------------------------------

_BEFORE_ALL = -(2 ** 62)
ORDER = ["ts_s", "message_id", "_row"]


def _mark() -> Column:
    """What a later row needs to know about an offence.  A message edited later, or delivered
    again, is a row of its own, told apart by time and row number."""
    return F.struct(F.col("ts_s").alias("ts"), F.col("message_id").alias("id"), F.col("_row").alias("row"),
                    F.col("msg_count").alias("n"), F.col("next_ts").alias("next_ts"),
                    F.col("bans").alias("bans"), F.col("life").alias("life"))


def _place(mark: Column) -> Column:
    return F.struct(mark["ts"].alias("ts"), mark["id"].alias("id"), mark["row"].alias("row"))


def _here() -> Column:
    return F.struct(F.col("ts_s").alias("ts"), F.col("message_id").alias("id"), F.col("_row").alias("row"))


def _new_since(mark: Column, cfg: ModerationConfig) -> Column:
    """Is the sender a newcomer again, having been forgotten at ``mark``?  In a later life than the
    mark's, what counts is when that life began."""
    since = _newcomer(F.col("ts_s") - mark["next_ts"], F.col("msg_count") - mark["n"], cfg)
    return F.when(mark["life"] == F.col("life"), since).otherwise(F.col("new0"))


def _spam_cases(cfg: ModerationConfig) -> dict[str, Column]:
    """Would the message be an offence, as new (c) or old (u) sender with 0, 1, 2+ offences?"""
    cases = {}
    for letter, new in (("c", True), ("u", False)):
        points = F.col("points_new" if new else "points_old")
        for n in (0, 1, 2):
            reach = points + F.when(points > 0, 2 * n).otherwise(0)
            cases[f"{letter}{n}"] = (F.col("forced_reason").isNotNull()
                                     | (reach >= cfg.threshold_for(new)))
    return cases


def _by_record(letter: str, own: int) -> Column:
    """Is it an offence, with ``own`` offences of this run on top of the logged ones before it?"""
    known = F.col("seed") + own
    return (F.when(known >= 2, F.col(f"{letter}2")).when(known == 1, F.col(f"{letter}1"))
            .otherwise(F.col(f"{letter}0")))


def _logged_before(cand: DataFrame, offences: DataFrame | None) -> DataFrame:
    """Add ``seed``: logged offences of the sender before each candidate."""
    if offences is None:
        return cand.withColumn("seed", F.lit(0).cast("bigint"))
    rows = cand.withColumns({"_late": F.lit(0), "_n": F.lit(0).cast("bigint")})
    past = offences.select(*KEY, "ts_s", F.lit(1).alias("_late"), F.lit(1).cast("bigint").alias("_n"),
                           F.monotonically_increasing_id().alias("_row"))
    counted = running(rows.unionByName(past, allowMissingColumns=True), KEY, ["ts_s", "_late", "_row"],
                      {"seed": ("sum", F.col("_n"))})
    return counted.filter("_late = 0").drop("_late", "_n")


def replay_verdicts(scored: DataFrame, joins: DataFrame | None, cfg: ModerationConfig,
                    members: DataFrame | None = None,
                    offences: DataFrame | None = None) -> DataFrame:
    """Offences, with every verdict feeding the sender's next one.

    ``scored`` has ``message_id, chat_id, user_id, sender_chat_id, ts_s, signals_new,
    signals_old, forced_reason, action`` (the action in force); an edited message is one more
    row with its own time.  An offence raises the sender's later scores (until the second one;
    more add nothing), as do logged ``offences`` from earlier times, and a ban makes the chat
    forget the sender, who is then new again.

    No row-by-row fold is needed:

    * a message that is harmless even with a record can never be an offence, so only the
      others (the candidates) take part, next to plain message counts;
    * logged offences before a candidate are counted by time;
    * the first and the second offence of a sender are minima over conditions that depend
      on nothing later;
    * from then on the record is constant.  An old member's offence is a newcomer's offence
      too, so a candidate is banned if it is an offence for old members, or if the sender is
      still new since the last ban.  Being new only wears off, hence along a run of
      candidates the bans go on until the first one that comes too late, and start again
      with the next one that is an offence for everybody: two running maxima.

    Should newcomers have the higher threshold, the last point does not hold, and candidates
    are folded in order, sender by sender, as a stream of sorted rows.
    """
    slim = _slim(scored, cfg)
    hits = staged(_hits(slim, joins, cfg, members, offences))
    return _verdicts(slim, hits, cfg)


def _slim(scored: DataFrame, cfg: ModerationConfig) -> DataFrame:
    """What the history needs of scored messages, with a row number that is fixed by writing it.
    Reasons stay in this table until the end."""
    scored = scored.withColumns({
        "points_new": total(F.col("signals_new")), "points_old": total(F.col("signals_old")),
        "bans": F.col("action") == "ban"})
    everywhere = F.col("ban_all_groups") if "ban_all_groups" in scored.columns else F.lit(cfg.ban_all_groups)
    scored = scored.withColumn("carried", F.col("bans") & everywhere)
    scored = scored.withColumns(_spam_cases(cfg)).withColumn(
        "_kept", F.when(F.col("c2") | F.col("u2"), F.struct("signals_new", "signals_old", "forced_reason",
                                                            "action")))
    return staged(scored.select("message_id", *KEY, "sender_chat_id", "ts_s", "_kept", *_CASES,
                                F.monotonically_increasing_id().alias("_row")))


_CASES = ("bans", "carried", "c0", "c1", "c2", "u0", "u1", "u2")


def _hits(slim: DataFrame, joins: DataFrame | None, cfg: ModerationConfig, members: DataFrame | None,
          offences: DataFrame | None, resets: DataFrame | None = None) -> DataFrame:
    cand = _timeline(slim, joins, members, ("_row", *_CASES), resets).filter("c2 OR u2")
    cand = staged(_logged_before(cand, offences).withColumn("new0", _newcomer(
        F.col("ts_s") - F.col("first_seen"), F.col("msg_count"), cfg)))
    fold = _folded if cfg.threshold_for(True) > cfg.threshold_for(False) else _closed_form
    return fold(cand, cfg)


def _verdicts(slim: DataFrame, hits: DataFrame, cfg: ModerationConfig) -> DataFrame:
    hits = running(hits, KEY, ORDER, {"_before": ("sum", F.lit(1).cast("bigint"))}, inclusive=False)
    hits = hits.withColumn("prior_offences", F.col("_before") + F.col("seed")).select(
        "_row", "is_new", "prior_offences")
    users = slim.join(hits, "_row").select(
        "message_id", "chat_id", F.col("user_id").alias("offender_id"), "ts_s",
        F.lit(False).alias("by_channel"), "is_new", "prior_offences", "_kept")
    channels = slim.filter("sender_chat_id IS NOT NULL AND u0").select(
        "message_id", "chat_id", F.col("sender_chat_id").alias("offender_id"), "ts_s",
        F.lit(True).alias("by_channel"), F.lit(False).alias("is_new"),
        F.lit(0).cast("bigint").alias("prior_offences"), "_kept")
    return with_final_verdict(users.unionByName(channels), cfg)


def replay_across_chats(scored: DataFrame, joins: DataFrame | None, cfg: ModerationConfig, chats: DataFrame,
                        admins: DataFrame, members: DataFrame | None = None,
                        offences: DataFrame | None = None) -> DataFrame:
    """``replay_verdicts`` in which a ban is carried to the sender's other managed chats.

    There the sender is forgotten, and is new again from the next second on, unless an admin of
    that chat.  ``scored`` may say in ``ban_all_groups`` whether the switch was on at each message.

    A fixed point: verdicts give carried bans, which give each sender's lives in the other chats,
    which give verdicts.  A carried ban bears on later messages only, so each pass settles at
    least the next one of every sender, and only senders whose carried bans changed are
    looked at again.  Bans meet the chats in which their sender has messages that could be
    offences, so no sender is unfolded over all chats.
    """
    slim = _slim(scored, cfg)
    hits = staged(_hits(slim, joins, cfg, members, offences))
    homes = slim.filter("sender_chat_id IS NULL AND (c2 OR u2)").select(*KEY).distinct()
    homes = homes.join(broadcast_if_small(chats.select("chat_id").distinct()), "chat_id", "left_semi")
    homes = staged(homes.join(broadcast_if_small(admins.select(*KEY).distinct()), KEY, "left_anti"))
    resets = homes.select(*KEY, F.lit(0).cast("bigint").alias("ts_s")).limit(0)
    while True:
        bans = hits.filter("carried").select("user_id", F.col("chat_id").alias("from_chat"), "ts_s")
        now = staged(bans.join(homes, "user_id").filter("chat_id <> from_chat").select(*KEY, "ts_s").distinct())
        moved = staged(now.exceptAll(resets).unionByName(resets.exceptAll(now)).select("user_id").distinct())
        if moved.isEmpty():
            return _verdicts(slim, hits, cfg)
        resets, moved = now, broadcast_if_small(moved)

        def only(df: DataFrame | None) -> DataFrame | None:
            return None if df is None else df.join(moved, "user_id", "left_semi")

        again = _hits(only(slim), only(joins), cfg, only(members), only(offences), only(resets))
        hits = staged(hits.join(moved, "user_id", "left_anti").unionByName(again))


_HITS = [*KEY, "ts_s", "message_id", "_row", "is_new", "seed", "carried"]


def _closed_form(cand: DataFrame, cfg: ModerationConfig) -> DataFrame:
    hit0 = F.when(F.col("new0"), _by_record("c", 0)).otherwise(_by_record("u", 0))
    first = cand.groupBy(*KEY).agg(F.min(F.when(hit0, _mark())).alias("p1"))
    cand = cand.join(first, KEY)
    new1 = F.when(F.col("p1.bans"), _new_since(F.col("p1"), cfg)).otherwise(F.col("new0"))
    cand = cand.withColumn("new1", new1)
    after1 = F.col("p1").isNotNull() & F.coalesce(_here() > _place(F.col("p1")), F.lit(False))
    hit1 = after1 & F.when(F.col("new1"), _by_record("c", 1)).otherwise(_by_record("u", 1))
    second = cand.groupBy(*KEY).agg(F.min(F.when(hit1, _mark())).alias("p2"))
    cand = staged(cand.join(second, KEY))

    same = [F.coalesce(F.col(f"p{i}.row") == F.col("_row"), F.lit(False)) for i in (1, 2)]
    early = (cand.filter(same[0] | same[1])
             .withColumn("is_new", F.when(same[0], F.col("new0")).otherwise(F.col("new1"))))

    base = F.when(F.col("p2.bans"), F.col("p2")).when(F.col("p1.bans"), F.col("p1"))
    after2 = F.col("p2").isNotNull() & F.coalesce(_here() > _place(F.col("p2")), F.lit(False))
    late = cand.filter(after2).withColumn("base", base)
    since_base = F.when(F.col("base").isNotNull(), _new_since(F.col("base"), cfg)
                        ).otherwise(F.col("new0"))
    late = late.withColumn("new_base", since_base).drop("p1", "p2", "base", "new1")
    # the record no longer grows, so each life stands alone
    lives = [*KEY, "life"]
    late = staged(running(late, lives, ORDER, {
        "last_x": ("max", F.when(F.col("bans"), _mark()))}, inclusive=False))
    since_x = F.when(F.col("last_x").isNotNull(), _new_since(F.col("last_x"), cfg)
                     ).otherwise(F.col("new_base"))
    here = F.struct(*ORDER)
    late = staged(running(late, lives, ORDER, {
        "last_late": ("max", F.when(F.col("bans") & ~F.col("u2") & ~since_x, here)),
        "last_sure": ("max", F.when(F.col("bans") & F.col("u2"), here))}))
    unbroken = F.col("last_late").isNull() | F.coalesce(
        F.col("last_late") < F.col("last_sure"), F.lit(False))
    late = late.withColumn("banned", F.col("bans") & (F.col("u2") | unbroken))
    late = running(late, lives, ORDER, {
        "last_ban": ("max", F.when(F.col("banned"), _mark()))}, inclusive=False)
    since_ban = F.when(F.col("last_ban").isNotNull(), _new_since(F.col("last_ban"), cfg)
                       ).otherwise(F.col("new_base"))
    late = late.withColumn("is_new", since_ban).filter(
        F.when(F.col("is_new"), F.col("c2")).otherwise(F.col("u2")))
    return early.select(_HITS).unionByName(late.select(_HITS))


def _folded(cand: DataFrame, cfg: ModerationConfig) -> DataFrame:
    """The same by going through each sender's candidates in order, holding only a few numbers."""
    window, messages = cfg.new_member_seconds, cfg.new_member_messages
    ship(cand.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, life, base, own = None, 0, None, 0
        for pdf in batches:
            kept, news = [], []
            for i, r in enumerate(pdf.itertuples(index=False)):
                if (r.chat_id, r.user_id) != key:
                    key, life, base, own = (r.chat_id, r.user_id), 0, None, 0
                if r.life != life:
                    life, base = r.life, None
                new = bool(r.new0) if base is None else (
                    r.ts_s - base[0] < window or r.msg_count - base[1] <= messages)
                record = min(int(r.seed) + own, 2)
                if not getattr(r, f"{'c' if new else 'u'}{record}"):
                    continue
                kept.append(i)
                news.append(new)
                own += 1
                if r.bans:
                    base = (r.next_ts, r.msg_count)
            out = pdf.iloc[kept][[c for c in _HITS if c != "is_new"]]
            yield out.assign(is_new=news)[_HITS]

    in_order = cand.repartition(*KEY).sortWithinPartitions(*KEY, *ORDER)
    return in_order.mapInPandas(run, ", ".join(
        f"{n} {'boolean' if n in ('is_new', 'carried') else 'bigint'}" for n in _HITS))


def with_final_verdict(hits: DataFrame, cfg: ModerationConfig) -> DataFrame:
    new = F.col("is_new")
    sig = F.when(new, F.col("_kept.signals_new")).otherwise(F.col("_kept.signals_old"))
    limit = F.when(new, cfg.threshold_for(True)).otherwise(cfg.threshold_for(False))
    forced = F.col("_kept.forced_reason")
    v = F.when(forced.isNotNull(), forced_verdict(forced)).otherwise(
        verdict(sig, limit, F.col("prior_offences")))
    return hits.select("message_id", "chat_id", "offender_id", "ts_s", "by_channel", "is_new",
                       "prior_offences", v.alias("verdict"),
                       F.col("_kept.action").alias("mode"))


# --- the brake on ban bursts ------------------------------------------------------


def bans_per_second(offences: DataFrame) -> DataFrame:
    return (offences.filter(F.col("action").isin(*BANNING)).groupBy("ts_s")
            .agg(F.count("*").alias("bans")))


def _burst(seconds: DataFrame, window: int) -> DataFrame:
    """Bans within the last ``window`` seconds, the current second included.

    The window spans all chats, so it has no key.  Seconds are grouped into blocks as long
    as the window; a block together with the one before holds all a row can look back to.
    """
    block = F.floor(F.col("ts_s") / max(window, 1))
    copies = seconds.withColumn("_own", block).withColumn(
        "_block", F.explode(F.array(F.col("_own"), F.col("_own") + 1)))
    span = Window.partitionBy("_block").orderBy("ts_s").rangeBetween(-window, 0)
    return (copies.withColumn("recent_bans", F.sum("bans").over(span))
            .filter("_block = _own").drop("_own", "_block"))


def ban_brake(offences: DataFrame, limit: int, window: int) -> DataFrame:
    """Seconds with bans: how many bans lately, over all chats, and does the brake fire?"""
    return _burst(bans_per_second(offences), window).withColumn(
        "brake", (F.col("recent_bans") >= limit) & F.lit(limit > 0))


def _own_brakes(seconds: DataFrame, cfg: ModerationConfig) -> DataFrame:
    """Add ``own_brake``, where a stretch's own bans alone reach the limit; null if nowhere.

    ``seconds``: ts_s, bans, stretch.  Blocks as long as the window hold all a second looks back to.
    """
    own = F.floor(F.col("ts_s") / max(cfg.brake_window, 1))
    copies = seconds.withColumn("own", own).withColumn("block", F.explode(F.array(F.col("own"), F.col("own") + 1)))
    span = Window.partitionBy("stretch", "block").orderBy("ts_s").rangeBetween(-cfg.brake_window, 0)
    fired = copies.withColumn("recent", F.sum("bans").over(span)).filter(
        (F.col("block") == F.col("own")) & (F.col("recent") >= cfg.brake_limit))
    first = fired.groupBy("stretch").agg(F.min("ts_s").alias("own_brake"))
    return seconds.join(broadcast_if_small(staged(first)), "stretch", "left")


def _chained(seconds: DataFrame, cfg: ModerationConfig) -> DataFrame:
    """Add ``chain``: stretches of different chains cannot see each other's bans.

    A stretch carries out no ban after its own brake, as bans of earlier stretches only bring the
    brake forward.  So it reaches no further than that, or than its last ban, and one window more.
    """
    stretches = seconds.groupBy("stretch").agg(
        F.min("ts_s").alias("first"), F.coalesce(F.max("own_brake"), F.max("ts_s")).alias("reach"))
    seen = running(staged(stretches), [], ["first"], {"reached": ("max", F.col("reach"))}, inclusive=False)
    alone = F.col("reached").isNull() | (F.col("reached") + cfg.brake_window < F.col("first"))
    chains = running(staged(seen), [], ["first"], {"chain": ("max", F.when(alone, F.col("first")))})
    return seconds.join(broadcast_if_small(staged(chains.select("stretch", "reach", "chain"))), "stretch")


def _brakes(seconds: DataFrame, cfg: ModerationConfig) -> DataFrame:
    """``stretch, brake_s, kept``: the second in which a stretch's brake fires, and how many of its
    bans are still carried out.

    Chains are settled beside each other, each in order.  Of a stretch only the seconds up to one
    window after its start, which earlier stretches bear on, and those of the last window
    before its own brake or end, which bear on later ones, are gone through: at most two windows,
    however long it is.
    """
    every = staged(_chained(staged(_own_brakes(seconds, cfg)), cfg))
    window, limit = cfg.brake_window, cfg.brake_limit
    near = every.filter((F.col("ts_s") <= F.coalesce("own_brake", "ts_s")) & (
        (F.col("ts_s") <= F.col("stretch") + window) | (F.col("ts_s") >= F.col("reach") - window)))
    ship(seconds.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        chain = stretch = None
        recent, total, fired = deque(), 0, False
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                if r.chain != chain:
                    chain, stretch = r.chain, None
                    recent, total = deque(), 0
                if r.stretch != stretch:
                    stretch, fired = r.stretch, False
                if fired:
                    continue
                while recent and recent[0][0] < r.ts_s - window:
                    total -= recent.popleft()[1]
                carried = r.bans
                if total + r.bans >= limit:
                    # the ban that reaches the limit is the last one of its second to be carried out
                    fired, carried = True, max(limit - total, 1)
                    out.append((r.stretch, r.ts_s, carried))
                recent.append((r.ts_s, carried))
                total += carried
            yield pd.DataFrame(out, columns=["stretch", "brake_s", "kept"], dtype="int64")

    in_order = near.select("chain", "ts_s", "stretch", "bans").repartition("chain").sortWithinPartitions("chain", "ts_s")
    return in_order.mapInPandas(run, "stretch bigint, brake_s bigint, kept bigint")


def apply_brake(verdicts: DataFrame, resets: DataFrame, cfg: ModerationConfig) -> DataFrame:
    """``effective_action``: after a brake every action is ``report`` until the next reset.

    ``verdicts`` has ``id, ts_s, action``; ``resets`` has ``id, ts_s`` (moments at which an
    admin switched punishing back on).  Only bans that were carried out count, and a stretch
    that begins shortly after a brake still sees the bans before it.  The brakes are found
    on per-second counts, in a fixed number of jobs however many resets there are.
    """
    if cfg.brake_limit <= 0:
        return verdicts.withColumn("effective_action", F.col("action"))
    starts = resets.select("ts_s", "id", F.col("ts_s").alias("stretch"))
    marked = staged(as_of(verdicts, starts, "stretch", "stretch").withColumn(
        "stretch", F.coalesce("stretch", F.lit(_BEFORE_ALL))))
    bans = marked.filter(F.col("action").isin(*BANNING))
    seconds = staged(bans.groupBy("stretch", "ts_s").agg(F.count("*").alias("bans")))
    brakes = broadcast_if_small(staged(_brakes(seconds, cfg)))
    # only the bans of the second in which a brake fired are put in order
    rank = F.row_number().over(Window.partitionBy("stretch").orderBy("id"))
    second = bans.withColumnRenamed("ts_s", "brake_s").join(
        brakes, ["stretch", "brake_s"])
    at = second.withColumn("rank", rank).filter("rank = kept").select(
        "stretch", F.struct(F.col("brake_s").alias("ts_s"), "id").alias("brake"))
    out = marked.join(broadcast_if_small(staged(at)), "stretch", "left")
    stopped = F.coalesce(F.struct("ts_s", "id") > F.col("brake"), F.lit(False))
    return out.withColumn("effective_action", F.when(stopped, "report").otherwise(
        F.col("action"))).select(*verdicts.columns, "effective_action")


# --- forgiving --------------------------------------------------------------------


def clear_history(offences: DataFrame, changes: DataFrame) -> DataFrame:
    """Offences left after ``trust`` / ``unban`` wiped a sender's record up to then."""
    wiped = changes.filter(F.col("kind").isin("trust", "unban")).groupBy(*KEY).agg(
        F.max("ts_s").alias("_cleared"))
    return offences.join(wiped, KEY, "left").filter(
        F.col("_cleared").isNull() | (F.col("ts_s") > F.col("_cleared"))).select(*offences.columns)


def apply_member_changes(members: DataFrame, changes: DataFrame) -> DataFrame:
    """Members after ``ban`` (forgotten), ``trust`` and ``untrust`` (added when absent)."""
    last = changes.groupBy(*KEY).agg(
        F.max(F.when(F.col("kind") == "ban", F.col("ts_s"))).alias("_banned"))
    both = changes.filter(F.col("kind").isin("trust", "untrust")).join(last, KEY)
    both = both.filter(F.col("_banned").isNull() | (F.col("ts_s") > F.col("_banned")))
    flags = both.groupBy(*KEY).agg(
        F.max_by(F.col("kind") == "trust", "ts_s").alias("_trusted"),
        F.min("ts_s").alias("_added"))
    gone = last.filter("_banned IS NOT NULL").select(*KEY)
    kept = members.join(gone, KEY, "left_anti")
    out = kept.join(flags, KEY, "full_outer")
    return out.select(
        *KEY, F.coalesce("first_seen", "_added").alias("first_seen"),
        F.coalesce("msg_count", F.lit(0)).cast("bigint").alias("msg_count"),
        F.coalesce("_trusted", "trusted").alias("trusted"))
