"""Allow lists, deny lists, presets and settings, and the joins that apply them.

A list row belongs to one chat, or to every chat when its ``chat_id`` is 0.  Instead of
copying global rows to all chats, a message looks into the two scopes it belongs to, which
keeps every look-up an equi-join.
"""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import ACTIONS, GLOBAL, SWITCHES, ModerationConfig
from ..functions import entities as E
from ..functions.phrases import any_of, banned_phrase_hits, phrase_forms
from ..functions.text import squeeze_spaces
from ..sources.storage import staged
from .phrase_index import with_indexed_hits
from .running import running

MAX_BROADCAST_ROWS = 500_000  # of a few short columns each
# Lists of allowed entries travel as one bundle per scope; beyond this many entries in all
# they are joined as tables instead.
MAX_BUNDLE_ENTRIES = 500
PHRASES_PER_BUNDLE = 200
MAX_PATTERN_FORMS = 1_000  # spellings that one pattern may look for


def is_small(df: DataFrame, limit: int = MAX_BROADCAST_ROWS) -> bool:
    """Whether a table has at most ``limit`` rows; reads no more than that."""
    return df.limit(limit + 1).count() <= limit


def broadcast_if_small(df: DataFrame, limit: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """Broadcast after counting; a larger table is shuffled, with AQE splitting hot keys."""
    return F.broadcast(df) if is_small(df, limit) else df


def scopes(chat_id="chat_id") -> Column:
    """The list scopes a chat sees: its own and the global one."""
    return F.array(F.col(chat_id), F.lit(GLOBAL).cast("bigint"))


def effective_list(entries: DataFrame, chats: DataFrame, value: str) -> DataFrame:
    """Chat rows plus global rows for each chat, without duplicates."""
    seen = chats.select("chat_id", F.explode(scopes()).alias("scope"))
    listed = entries.select(F.col("chat_id").alias("scope"), value)
    return seen.join(listed, "scope").select("chat_id", value).distinct()


SINCE_EVER = -(1 << 40)  # before any message


def list_ranges(table: DataFrame, log: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys..., valid_from, valid_until)``: when each entry of a list was on it.

    ``table`` holds the entries before the first edit, ``log`` the edits ``(id, ts_s, keys..., op)``,
    of which ``delete`` takes an entry off and any other puts it on.  An edit holds from its own second
    on, the last of a second wins, and an entry's ranges do not overlap.  Entries with many edits
    are split by time.
    """
    every = table.select(*keys).distinct().withColumns({
        "ts_s": F.lit(SINCE_EVER).cast("bigint"), "id": F.lit(0).cast("bigint"), "op": F.lit("add")})
    edits = log.select(*keys, F.col("ts_s").cast("bigint"), F.col("id").cast("bigint"), "op")
    spans = running(staged(every.unionByName(edits)), keys, ["ts_s", "id"], {}, following={"valid_until": F.col("ts_s")})
    held = (F.col("op") != "delete") & (F.col("valid_until").isNull() | (F.col("valid_until") > F.col("ts_s")))
    return spans.filter(held).select(*keys, F.col("ts_s").alias("valid_from"), "valid_until")


def _in_scope(df: DataFrame, entries: DataFrame, key: Column, value: str, flag: str) -> DataFrame:
    """Add a boolean ``flag``: is ``key`` listed for the row's chat or globally?

    With the ranges of ``list_ranges`` as entries: was it listed at the row's ``ts_s``?
    """
    dated = "valid_from" in entries.columns
    times = ["valid_from", "valid_until"] if dated else []

    def now(side: str) -> Column:
        if not dated:
            return F.lit(True)
        until = F.col(f"{side}_valid_until")
        return (F.col("ts_s") >= F.col(f"{side}_valid_from")) & (until.isNull() | (F.col("ts_s") < until))

    own = entries.select(F.col("chat_id").alias("_c"), F.col(value).alias("_k"), *times).distinct()
    everywhere = own.filter(F.col("_c") == GLOBAL).select(
        F.col("_k").alias("_gk"), F.lit(True).alias("_g"), *[F.col(t).alias(f"_g_{t}") for t in times])
    own = own.filter(F.col("_c") != GLOBAL).select(
        "_c", "_k", F.lit(True).alias("_o"), *[F.col(t).alias(f"_o_{t}") for t in times])
    keyed = df.withColumn("_key", key)
    out = (keyed
           .join(broadcast_if_small(own), (F.col("chat_id") == F.col("_c"))
                 & (F.col("_key") == F.col("_k")) & now("_o"), "left")
           .join(broadcast_if_small(everywhere), (F.col("_key") == F.col("_gk")) & now("_g"), "left"))
    hit = F.coalesce(F.col("_o"), F.lit(False)) | F.coalesce(F.col("_g"), F.lit(False))
    return out.withColumn(flag, hit).select(*df.columns, flag)


def sender_id() -> Column:
    """A channel when the message was sent as one, else the user."""
    return F.coalesce(F.col("sender_chat_id"), F.col("user_id"))


def blocked_sender(msgs: DataFrame, blacklist: DataFrame) -> DataFrame:
    return _in_scope(msgs, blacklist, sender_id(), "entity_id", "is_blocked")


def forward_exempt(msgs: DataFrame, allowed: DataFrame) -> DataFrame:
    """``may_forward``: a listed user (never a channel, never a blocked sender)."""
    user = F.when(F.col("sender_chat_id").isNull() & ~F.col("is_blocked"), F.col("user_id"))
    return _in_scope(msgs, allowed, user, "user_id", "may_forward")


def exclude_exempt(msgs: DataFrame, admins: DataFrame, bot_admins: DataFrame,
                   owners: tuple[int, ...] = ()) -> DataFrame:
    """Drop what is never moderated.

    Automatic forwards, the chat itself and its linked channel are exempt; any other channel
    is not, whoever is behind it; then automated accounts, owners and admins are.
    """
    channel = F.col("sender_chat_id")
    own_voice = (F.coalesce(F.col("is_automatic_forward"), F.lit(False))
                 | F.coalesce(channel == F.col("chat_id"), F.lit(False))
                 | F.coalesce(channel == F.col("linked_chat_id"), F.lit(False)))
    robot = F.coalesce(F.col("user_is_bot"), F.lit(False))
    owner = F.coalesce(F.col("user_id").isin(*owners), F.lit(False)) if owners else F.lit(False)
    kept = msgs.filter(~own_voice & (channel.isNotNull() | ~(robot | owner)))
    kept = kept.withColumn("_person", F.when(channel.isNull(), F.col("user_id")))
    everywhere = bot_admins.select(F.col("user_id").alias("_person")).distinct()
    here = admins.select("chat_id", F.col("user_id").alias("_person")).distinct()
    return (kept.join(broadcast_if_small(everywhere), "_person", "left_anti")
            .join(broadcast_if_small(here), ["chat_id", "_person"], "left_anti")
            .select(*msgs.columns))


def exclude_trusted(msgs: DataFrame, members: DataFrame) -> DataFrame:
    """Drop messages of trusted users unless the sender is blocked."""
    trusted = members.filter("trusted").select(
        "chat_id", F.col("user_id").alias("_person"), F.lit(True).alias("_t")).distinct()
    person = F.when(F.col("sender_chat_id").isNull(), F.col("user_id"))
    return (msgs.withColumn("_person", person)
            .join(broadcast_if_small(trusted), ["chat_id", "_person"], "left")
            .filter(F.col("_t").isNull() | F.col("is_blocked")).select(*msgs.columns))


def require_known_admins(msgs: DataFrame, admin_status: DataFrame) -> DataFrame:
    known = admin_status.filter("known").select("chat_id").distinct()
    return msgs.join(broadcast_if_small(known), "chat_id", "left_semi").select(*msgs.columns)


# --- links, mentions and phones against the lists, as tables ---------------------


def url_allowed(urls: DataFrame, allow: DataFrame) -> DataFrame:
    """Add ``allowed`` to rows of ``(chat_id, url)``.

    "Ends with" would be a nested-loop join.  A host has only a few dotted endings, so each
    is looked up exactly and the path is checked afterwards.
    """
    links = urls.select("chat_id", "url").distinct().withColumn("_p", E.split_url("url"))
    links = links.select("chat_id", "url", F.col("_p.host").alias("host"),
                         F.col("_p.path").alias("path"))
    labels = F.split("host", r"\.")
    endings = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(
        F.slice(labels, i, F.size(labels)), "."))
    looked_up = (links.filter(E.is_real_host(F.col("host")))
                 .withColumn("ending", F.explode(endings))
                 .withColumn("scope", F.explode(scopes())))
    entries = allow.select(
        F.col("chat_id").alias("scope"),
        F.lower(F.substring_index("domain", "/", 1)).alias("ending"),
        F.lower(F.btrim(F.regexp_replace("domain", "^[^/]*/?", ""), F.lit("/"))).alias("entry_path"),
    ).distinct()
    path_ok = ((F.col("entry_path") == "") | (F.col("path") == F.col("entry_path"))
               | F.startswith(F.col("path"), F.concat("entry_path", F.lit("/"))))
    good = (looked_up.join(broadcast_if_small(entries), ["scope", "ending"])
            .filter(path_ok).select("chat_id", "url", F.lit(True).alias("_ok")).distinct())
    no_link = links.filter(~E.is_real_host(F.col("host"))).select(
        "chat_id", "url", F.lit(True).alias("_ok"))
    verdicts = urls.join(good.unionByName(no_link), ["chat_id", "url"], "left")
    return verdicts.withColumn("allowed", F.coalesce("_ok", F.lit(False))).drop("_ok")


def _not_listed(values: DataFrame, entries: DataFrame, value: str) -> DataFrame:
    """Rows of ``(message_id, chat_id, value)`` listed neither for the chat nor globally."""
    own = entries.select("chat_id", value).distinct()
    everywhere = own.filter(F.col("chat_id") == GLOBAL).select(value)
    return (values.join(broadcast_if_small(own), ["chat_id", value], "left_anti")
            .join(broadcast_if_small(everywhere), [value], "left_anti"))


def unknown_mentions(handles: DataFrame, allowed: DataFrame) -> DataFrame:
    return _not_listed(handles, allowed, "username")


def unknown_phones(phones: DataFrame, allowed: DataFrame) -> DataFrame:
    return _not_listed(phones, allowed, "phone")


# --- a chat's rules in one row ----------------------------------------------------

BUNDLE = {  # list name -> (value column, name in the bundle)
    "chat_whitelist": ("domain", "allow_domains"),
    "username_whitelist": ("username", "allow_usernames"),
    "phone_whitelist": ("phone", "allow_phones"),
    "keyword_blacklist": ("phrase", "banned"),
    "forward_whitelist": ("user_id", "exempt_ids"),
    "blacklist": ("entity_id", "blocked_ids"),
}


def scoped_entries(lists: dict[str, DataFrame], admins: DataFrame | None = None,
                   own_username: str = "", names: tuple[str, ...] = tuple(BUNDLE)) -> DataFrame:
    """All list rows as ``(scope, list, value)``, values as text; the scope is a chat or 0.

    Admins of a chat, and the moderator itself everywhere, may always be mentioned.
    """
    parts = []
    for name in names:
        value, bundled = BUNDLE[name]
        parts.append(lists[name].select(F.col("chat_id").alias("scope"), F.lit(bundled).alias("list"),
                                        F.col(value).cast("string").alias("value")))
    if "username_whitelist" in names:
        if admins is not None:
            parts.append(admins.filter("username IS NOT NULL").select(
                F.col("chat_id").alias("scope"), F.lit("allow_usernames").alias("list"),
                F.lower("username").alias("value")))
        if own_username:
            parts.append(parts[0].sparkSession.range(1).select(
                F.lit(GLOBAL).cast("bigint").alias("scope"), F.lit("allow_usernames").alias("list"),
                F.lit(own_username.lower()).alias("value")))
    return reduce(DataFrame.unionByName, parts).distinct()


def effective_entries(lists: dict[str, DataFrame], chats: DataFrame,
                      admins: DataFrame | None = None, own_username: str = "",
                      names: tuple[str, ...] = tuple(BUNDLE)) -> DataFrame:
    """All that holds in each chat as rows ``(chat_id, list, value)``: a listing, in which global
    rows are repeated for every chat.  Look-ups use ``scoped_entries``."""
    rows = scoped_entries(lists, admins, own_username, names)
    seen = chats.select("chat_id", F.explode(scopes()).alias("scope")).distinct()
    return seen.join(rows, "scope").select("chat_id", "list", "value").distinct()


def chat_rules(entries: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """One row per chat with its effective lists as arrays, banned phrases prepared.

    For lists whose size was checked: the arrays travel with each message of the chat.
    """
    if "keyword_blacklist" in names:
        entries = entries.withColumn("_forms", F.when(F.col("list") == "banned",
                                                      phrase_forms("value")))

    def gather(bundled: str) -> Column:
        mine = F.col("list") == bundled
        if bundled == "banned":
            usable = mine & (F.col("_forms.keep") != "")
            return F.sort_array(F.collect_set(F.when(usable, F.col("_forms")))).alias("phrases")
        kind = "bigint" if bundled.endswith("_ids") else "string"
        return F.sort_array(F.collect_set(
            F.when(mine, F.col("value").cast(kind)))).alias(bundled)

    return entries.groupBy("chat_id").agg(*[gather(BUNDLE[n][1]) for n in names])


def phrase_bundles(keywords: DataFrame) -> DataFrame:
    """``(scope, phrases)``: the banned phrases of a scope, prepared, for scopes of checked size."""
    rows = keywords.select(F.col("chat_id").alias("scope"), "phrase").distinct()
    forms = rows.withColumn("_forms", phrase_forms("phrase")).filter("_forms.keep <> ''")
    slim = F.struct(*[F.col(f"_forms.{c}").alias(c) for c in ("phrase", "keep_squeezed", "plain_squeezed")])
    return staged(forms.groupBy("scope").agg(F.sort_array(F.collect_set(slim)).alias("phrases")))


def _holds_any(bundles: DataFrame, text: str) -> Column:
    """May space-free ``text`` hold a phrase of any scope?  One pattern dismisses the texts without; with more
    spellings than one pattern should have, none is dismissed."""
    phrase = bundles.select(F.explode("phrases").alias("p"))
    forms = phrase.select(F.explode(F.array("p.keep_squeezed", "p.plain_squeezed")).alias("f")).filter("f <> ''")
    forms = [r["f"] for r in forms.distinct().limit(MAX_PATTERN_FORMS + 1).collect()]
    if len(forms) > MAX_PATTERN_FORMS:
        return F.lit(True)
    return F.col(text).rlike(any_of(forms)) if forms else F.lit(False)


def with_banned_hits(msgs: DataFrame, keywords: DataFrame, text: str = "keep_text",
                     skip: Column | None = None) -> DataFrame:
    """Add ``banned_hits``: the banned phrases of the chat, and of all chats, inside canonical
    text ``text``.

    A phrase may start anywhere, so phrases travel to the messages: as one bundle per scope where
    all scopes are short, else through an index on their grams.
    """
    skip = F.coalesce(F.lit(False) if skip is None else skip, F.lit(False))
    keywords = staged(keywords.select("chat_id", "phrase").distinct())
    long_scopes = keywords.groupBy("chat_id").agg(F.count("phrase").alias("n"))
    if not long_scopes.filter(F.col("n") > PHRASES_PER_BUNDLE).isEmpty():
        return with_indexed_hits(msgs, keywords, F.when(~skip, squeeze_spaces(text)), "banned_hits", MAX_BROADCAST_ROWS)
    bundles, everywhere = phrase_bundles(keywords), F.col("scope") == GLOBAL
    own = bundles.filter(~everywhere).select(F.col("scope").alias("_scope"), F.col("phrases").alias("_own"))
    shared = bundles.filter(everywhere).select(F.col("phrases").alias("_shared"))  # one row at most
    both = (msgs.join(own, F.col("chat_id") == F.col("_scope"), "left")
            .join(F.broadcast(shared), F.lit(True), "left"))
    none = F.array().cast(bundles.schema["phrases"].dataType)
    both = both.withColumn("_phrases", F.array_union(F.coalesce("_own", none), F.coalesce("_shared", none)))
    hits = F.when(skip | ~_holds_any(bundles, "_squeezed"), E.no_strings()).otherwise(
        banned_phrase_hits("_squeezed", "_phrases"))
    return (both.withColumn("_squeezed", squeeze_spaces(text)).withColumn("banned_hits", hits)
            .select(*msgs.columns, "banned_hits"))


# --- settings -----------------------------------------------------------------------


def effective_config(settings: DataFrame, cfg: ModerationConfig) -> DataFrame:
    """One row: each switch and the action, a stored setting winning over the default.

    ``settings`` holds one row per key; only "1" and "0" are understood for a switch.
    """

    def stored(key: str) -> Column:
        return F.max(F.when(F.col("key") == key, F.col("value")))

    def switch(name: str) -> Column:
        raw = stored(f"cfg:{name}")
        return (F.when(raw.isin("1", "0"), raw == "1")
                .otherwise(F.lit(bool(getattr(cfg, name)))).alias(name))

    action = F.lower(E.strip_spaces(stored("action")))
    return settings.agg(
        F.when(action.isin(*ACTIONS), action).otherwise(F.lit(cfg.action)).alias("action"),
        *[switch(s) for s in SWITCHES])


def resolve_config(settings: DataFrame, cfg: ModerationConfig) -> ModerationConfig:
    """The configuration with the stored switches and action applied (one row is fetched)."""
    return replace(cfg, **effective_config(settings, cfg).first().asDict())


def latest_settings(log: DataFrame) -> DataFrame:
    """Current value per key of a settings change log."""
    last = F.max_by("value", F.struct("ts_s", "id"))
    return log.groupBy("key").agg(last.alias("value"))


# --- presets and list edits ---------------------------------------------------------


def preset_phrases(presets: DataFrame, names) -> DataFrame:
    """``(phrase, pos)`` of the chosen presets, first appearance first."""
    names = list(names)
    known = {r["name"] for r in presets.filter(F.col("name").isin(*names))
             .select("name").distinct().limit(len(names) + 1).collect()}
    missing = [n for n in names if n not in known]
    if missing:
        raise KeyError(f"unknown presets: {missing}")
    order = F.create_map(*[x for i, n in enumerate(names) for x in (F.lit(n), F.lit(i))])
    chosen = presets.filter(F.col("name").isin(*names))
    return chosen.groupBy("phrase").agg(
        F.min(F.struct(order[F.col("name")].alias("preset"), F.col("pos").alias("pos"))
              ).alias("first"))


def load_preset(presets: DataFrame, names, keywords: DataFrame, chat_id: int) -> DataFrame:
    """Phrases of the presets with ``already``: is it banned in this scope before loading?"""
    scope = keywords.filter(F.col("chat_id") == chat_id).select(
        "phrase", F.lit(True).alias("_have")).distinct()
    return (preset_phrases(presets, names).join(scope, "phrase", "left")
            .select(F.lit(chat_id).cast("bigint").alias("chat_id"), "phrase",
                    F.coalesce("_have", F.lit(False)).alias("already")))


def unload_preset(keywords: DataFrame, presets: DataFrame, names, chat_id: int) -> DataFrame:
    """The keyword list after taking a preset's phrases out of one scope."""
    gone = preset_phrases(presets, names).select(
        F.lit(chat_id).cast("bigint").alias("chat_id"), "phrase")
    return keywords.join(gone, ["chat_id", "phrase"], "left_anti")


def apply_list_changes(table: DataFrame, changes: DataFrame, keys: list[str],
                       kept: tuple[str, ...] = ()) -> DataFrame:
    """A list table after ordered edits ``(op, seq, keys..., values...)``.

    ``add`` leaves an existing row alone, ``set`` writes over it except for the ``kept``
    columns, ``delete`` removes it.  Only the edits after a key's last deletion matter.
    """
    values = [c for c in table.columns if c not in keys]
    row = F.struct(*values) if values else F.struct(F.lit(True).alias("_present"))
    edits = changes.select(*keys, "op", "seq", row.alias("_row"))
    old = table.select(*keys, F.lit("add").alias("op"), F.lit(-1).cast("bigint").alias("seq"),
                       row.alias("_row"))
    every = old.unionByName(edits)
    deleted = F.max(F.when(F.col("op") == "delete", F.col("seq")))
    cut = every.groupBy(*keys).agg(deleted.alias("_cut")).filter("_cut IS NOT NULL")
    live = every.join(cut, keys, "left").filter(
        (F.col("op") != "delete") & (F.col("_cut").isNull() | (F.col("seq") > F.col("_cut"))))
    first = F.min_by("_row", "seq")
    last = F.max_by("_row", F.when(F.col("op") == "set", F.col("seq")))
    out = live.groupBy(*keys).agg(first.alias("_first"), last.alias("_last"))
    return out.select(*keys, *[
        (F.col(f"_first.{v}") if v in kept
         else F.coalesce(F.col(f"_last.{v}"), F.col(f"_first.{v}"))).alias(v) for v in values])
