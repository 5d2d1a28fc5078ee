"""What to do about verdicts, as tables of planned actions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import SERVICE_KINDS, ModerationConfig
from .lists import MAX_BROADCAST_ROWS, broadcast_if_small
from .state import BANNING

# --- fixed values -------------------------------------------------------------
SERVICE_FIELDS = {
    "join": ("new_chat_members",),
    "leave": ("left_chat_member",),
    "pin": ("pinned_message",),
    "title": ("new_chat_title",),
    "photo": ("new_chat_photo", "delete_chat_photo"),
    "videochat": ("video_chat_started", "video_chat_ended", "video_chat_scheduled",
                  "video_chat_participants_invited"),
    "forum": ("forum_topic_created", "forum_topic_edited", "forum_topic_closed",
              "forum_topic_reopened", "general_forum_topic_hidden",
              "general_forum_topic_unhidden"),
    "other": ("message_auto_delete_timer_changed", "proximity_alert_triggered",
              "write_access_allowed", "users_shared", "chat_shared", "giveaway_created",
              "giveaway_completed", "chat_background_set", "boost_added",
              "group_chat_created", "supergroup_chat_created", "channel_chat_created"),
}
SLOW_PER_MINUTE, FAST_PER_MINUTE = 300, 600
# ------------------------------------------------------------------------------


def resolve_action(verdicts: DataFrame, cfg: ModerationConfig) -> DataFrame:
    """Add ``action`` and ``until`` from the mode in force and who sent the message.

    A channel cannot be muted and is banned instead; without a sender only the message goes.
    """
    mode = F.col("mode")
    action = (F.when(mode.isin("report", "delete"), mode)
              .when(F.col("by_channel"), "ban")
              .when(F.col("offender_id").isNull(), "delete").otherwise(mode))
    out = verdicts.withColumn("action", action)
    return out.withColumn("until", F.when(
        F.col("action") == "mute", F.col("ts_s") + cfg.mute_seconds))


def _each_chat(people: DataFrame, chats: DataFrame) -> DataFrame:
    """Every person of ``people`` (user_id, done: chats they need not be dealt with in) in every other
    managed chat.  Chats are broadcast in parts of a checked size, next to which people stand."""
    ids = chats.select("chat_id").distinct()
    parts = max(1, -(-ids.count() // MAX_BROADCAST_ROWS))
    part = F.pmod(F.xxhash64("chat_id"), F.lit(parts))
    pairs = [people.join(F.broadcast(ids.filter(part == i)), ~F.array_contains(F.col("done"), F.col("chat_id")))
             for i in range(parts)]
    return reduce(DataFrame.unionByName, pairs)


def _with_done(people: DataFrame, others: DataFrame) -> DataFrame:
    """Add ``done``: the chats that ``others`` (chat_id, user_id) names for each person.  People are
    joined before they are multiplied by chats; a person's list is no longer than the chats."""
    done = others.select("chat_id", "user_id").groupBy("user_id").agg(F.collect_set("chat_id").alias("done"))
    return people.join(done, "user_id", "left").withColumn(
        "done", F.coalesce("done", F.array().cast("array<bigint>")))


def ban_fanout(bans: DataFrame, chats: DataFrame, admins: DataFrame) -> DataFrame:
    """Bans of users repeated in all other managed chats where they are not an admin."""
    users = bans.filter((F.col("action") == "ban") & ~F.col("by_channel")).select(
        F.col("offender_id").alias("user_id"), F.col("chat_id").alias("from_chat")).distinct()
    known = _with_done(users, admins.join(users.select("user_id").distinct(), "user_id", "left_semi"))
    return _each_chat(known.withColumn("done", F.array_union("done", F.array("from_chat"))), chats).drop("done")


def forget_members(members: DataFrame, plan: DataFrame) -> DataFrame:
    """Members that remain once the planned bans are carried out."""
    gone = plan.select("chat_id", "user_id").distinct()
    return members.join(gone, ["chat_id", "user_id"], "left_anti")


def banned_users(offences: DataFrame) -> DataFrame:
    """People ever banned or muted (channels have negative ids)."""
    return offences.filter(F.col("action").isin(*BANNING) & (F.col("user_id") > 0)).select(
        "user_id").distinct()


def banned_pairs(offences: DataFrame) -> DataFrame:
    return offences.filter(F.col("action").isin(*BANNING)).select("chat_id", "user_id").distinct()


def purge_plan(offences: DataFrame, chats: DataFrame, admins: DataFrame) -> DataFrame:
    """Everybody ever banned anywhere, in every managed chat not yet done and not theirs."""
    users = banned_users(offences)
    theirs = admins.select("chat_id", "user_id").join(users, "user_id", "left_semi")
    others = banned_pairs(offences).unionByName(theirs)
    return _each_chat(_with_done(users, others), chats).select("chat_id", "user_id")


def purge_estimate(offences: DataFrame, chats: DataFrame) -> DataFrame:
    """Size of a purge before it starts: an upper bound, admins not yet taken out."""
    one = banned_users(offences).agg(F.count("*").alias("users"))
    out = one.select(
        "users", chats.select(F.count_distinct("chat_id")).scalar().alias("chats"),
        banned_pairs(offences).select(F.count("*")).scalar().alias("_pairs"))
    todo = F.greatest(F.col("users") * F.col("chats") - F.col("_pairs"), F.lit(0))
    out = out.withColumn("commands", todo)
    return out.select("users", "chats", "commands",
                      (F.col("commands") / FAST_PER_MINUTE).alias("minutes_fast"),
                      (F.col("commands") / SLOW_PER_MINUTE).alias("minutes_slow"))


def classify_service_message(fields) -> Column:
    """Kind of a service message from the array of its filled fields; first kind wins."""
    f = F.col(fields) if isinstance(fields, str) else fields
    kinds = [F.when(F.arrays_overlap(f, F.array(*[F.lit(x) for x in SERVICE_FIELDS[k]])), k)
             for k in SERVICE_KINDS]
    return F.coalesce(*kinds)


def service_kinds(settings: DataFrame, chats: DataFrame, cfg: ModerationConfig) -> DataFrame:
    """``kinds`` to delete per chat: the chat's setting, the global one, or the default.

    An empty setting means "none" and still wins.
    """
    rows = settings.filter(F.startswith("key", F.lit("svc:"))).select(
        F.expr("try_cast(substring(key, 5) AS BIGINT)").alias("chat_id"), "value")
    everywhere = rows.filter("chat_id = 0").select(F.max("value")).scalar()
    default = F.array(*[F.lit(k) for k in cfg.delete_service]).cast("array<string>")
    chosen = F.coalesce("value", everywhere)
    return chats.select("chat_id").distinct().join(rows, "chat_id", "left").select(
        "chat_id", F.when(chosen.isNull(), default).otherwise(
            F.array_remove(F.split(chosen, ","), "")).alias("kinds"))


def service_delete_plan(msgs: DataFrame, settings: DataFrame, chats: DataFrame,
                        cfg: ModerationConfig) -> DataFrame:
    """Service messages to delete: ``fields`` classified, kind wanted in that chat."""
    wanted = service_kinds(settings, chats, cfg).select(
        "chat_id", F.explode("kinds").alias("kind"))
    kinds = msgs.withColumn("kind", classify_service_message("fields"))
    return kinds.join(broadcast_if_small(wanted), ["chat_id", "kind"], "left_semi").select(
        *kinds.columns)
