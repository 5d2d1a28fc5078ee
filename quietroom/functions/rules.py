"""The scoring rules.

Each ``rule_*`` gives ``struct<hard:int, soft:int, reason:string>`` or null when it does not
fire.  A hard point is worth the sender's whole threshold, a soft point is worth one, so the
score is ``hard * threshold + soft``.  Switches are plain Python booleans; everything about a
message is a column.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import ModerationConfig
from . import entities as E
from .phrases import keyword_hits, keyword_points, noisy_keyword_points
from .text import col, obfuscation_score

# --- fixed values -------------------------------------------------------------
SHORTENERS = (
    "bit.ly", "tinyurl.com", "cutt.ly", "is.gd", "goo.gl", "ow.ly", "rb.gy",
    "shorturl.at", "rebrand.ly", "t.co", "shorte.st", "adf.ly", "bl.ink",
    "s.id", "linktr.ee", "urlz.fr", "v.gd", "tiny.cc", "1link.vn", "vn.link",
)
RISKY_TLDS = (
    "xyz", "top", "icu", "click", "link", "work", "buzz", "cfd", "rest",
    "monster", "win", "bet", "casino", "loan", "gq", "tk", "ml", "cf", "ga",
    "fun", "space", "host", "surf", "quest", "sbs", "autos", "bond",
)
STAFF_TITLES = (
    "tro ly", "quan ly", "quan tri", "admin", "adm", "qtv", "ql", "tl", "hr", "ho tro",
    "support", "cskh", "cham soc khach", "ke toan", "thu ngan", "nhan vien", "nv", "bot",
    "manager", "staff", "team support", "cong tac vien", "ctv", "mod", "moderator",
    "ban quan tri",
)
CAPS_RATIO = 0.7
# ------------------------------------------------------------------------------


def _int(x) -> Column:
    return (x if isinstance(x, Column) else F.lit(x)).cast("int")


def _fires(when, reason, hard=0, soft=0) -> Column:
    text = reason if isinstance(reason, Column) else F.lit(reason)
    return F.when(when, F.struct(_int(hard).alias("hard"), _int(soft).alias("soft"),
                                 text.alias("reason")))


def _with_list(name: str, items, shown: int, prefix: str = "") -> Column:
    first = F.slice(F.array_sort(col(items)), 1, shown)
    if prefix:
        first = F.transform(first, lambda x: F.concat(F.lit(prefix), x))
    return F.concat(F.lit(f"{name}: "), F.array_join(first, ", "))


def threshold(is_new, cfg: ModerationConfig) -> Column:
    return F.when(col(is_new), cfg.threshold_for(True)).otherwise(cfg.threshold_for(False))


def rule_keywords(hits, tier: str, weight: int) -> Column:
    points = keyword_points(hits, weight)
    return _fires(points > 0, _with_list(f"{tier}_phrases", hits, 3), soft=points)


def rule_noisy_keywords(points) -> Column:
    return _fires(col(points) > 0, "noisy_phrases", soft=col(points))


def rule_forward(is_forward, forward_label, has_media, has_qr, is_new,
                 cfg: ModerationConfig) -> Column:
    blocking = F.lit(cfg.block_forwards)
    if cfg.block_forwards_new_only:
        blocking = blocking & col(is_new)
    weak = ~blocking | (col(has_media) & ~col(has_qr))
    reason = F.concat_ws(": ", F.lit("forward"), col(forward_label))
    return _fires(col(is_forward), reason, hard=F.when(weak, 0).otherwise(1),
                  soft=F.when(weak, 1).otherwise(0))


def rule_channel_sender(from_channel, cfg: ModerationConfig) -> Column:
    return _fires(col(from_channel) & F.lit(cfg.block_channel_senders), "channel_sender", hard=1)


def rule_unknown_link(unknown_urls, is_new, cfg: ModerationConfig) -> Column:
    blocking = F.lit(cfg.block_links)
    if cfg.block_links_new_only:
        blocking = blocking & col(is_new)
    shown = F.array_distinct(F.transform(col(unknown_urls), E.short_url))
    return _fires(F.size(col(unknown_urls)) > 0, _with_list("unknown_link", shown, 3),
                  hard=F.when(blocking, 1).otherwise(0), soft=F.when(blocking, 0).otherwise(2))


def rule_shortener(hosts) -> Column:
    return _fires(F.arrays_overlap(col(hosts), E.word_list(SHORTENERS)), "shortener", soft=3)


def rule_risky_tld(hosts) -> Column:
    endings = F.transform(col(hosts), lambda h: F.substring_index(h, ".", -1))
    return _fires(F.arrays_overlap(endings, E.word_list(RISKY_TLDS)), "risky_tld", soft=2)


def rule_invite(text) -> Column:
    return _fires(E.has_invite_link(text), "invite_link", soft=3)


def rule_obfuscated_url(text, hosts) -> Column:
    return _fires((F.size(col(hosts)) == 0) & E.has_obfuscated_url(text),
                  "spelled_out_link", soft=3)


def rule_qr_present(has_qr, qr_payloads, is_new) -> tuple[Column, Column]:
    """Two signals: a decoded QR code, and one sent by a newcomer."""
    seen = col(has_qr) & (F.size(E._list(qr_payloads)) > 0)
    return (_fires(seen, "qr_code", soft=2), _fires(seen & col(is_new), "qr_newcomer", soft=2))


def rule_qr_payload(qr_payloads, allow) -> Column:
    """An array: one signal (or null) per decoded payload."""

    def one(p):
        kind = E.classify_qr_payload(p, allow)
        hard = F.when(kind.isin("payment", "wallet", "invite", "unknown_link"), 1).otherwise(0)
        names = F.array_distinct(F.transform(E.unknown_urls(E.qr_links(p), allow), E.hostname))
        reason = F.when(kind == "unknown_link", _with_list("qr_unknown_link", names, 2)
                        ).otherwise(F.concat(F.lit("qr_"), kind))
        return _fires(kind != "other", reason, hard=hard, soft=1 - hard)

    return F.transform(E._list(qr_payloads), one)


def rule_mentions(handles, unknown, cfg: ModerationConfig) -> Column:
    n = F.size(col(handles))
    blocked = (F.size(col(unknown)) > 0) & F.lit(cfg.block_mentions)
    reason = F.when(blocked, _with_list("unknown_mention", unknown, 3, "@")).otherwise(
        F.concat(F.lit("mentions: "), n.cast("string")))
    return _fires(blocked | (n >= 3), reason, hard=F.when(blocked, 1).otherwise(0),
                  soft=F.when(blocked, 0).otherwise(2))


def rule_crypto(scannable) -> Column:
    return _fires(E.has_crypto_address(scannable), "crypto_address", hard=1)


def rule_phone(unknown_phones, has_words, urls, cfg: ModerationConfig) -> Column:
    blocking = F.lit(cfg.block_phones)
    some = (F.size(col(unknown_phones)) > 0) & (blocking | col(has_words) | (F.size(col(urls)) > 0))
    reason = F.when(blocking, _with_list("unknown_phone", unknown_phones, 2)).otherwise("phone")
    return _fires(some, reason, hard=F.when(blocking, 1).otherwise(0), soft=F.when(blocking, 0).otherwise(2))


def rule_money(text) -> Column:
    return _fires(E.has_money_amount(text), "money_amount", soft=1)


def staff_title(norm_name) -> Column:
    """The staff title claimed by a canonical name, or an empty string."""
    padded = F.concat(F.lit(" "), col(norm_name), F.lit(" "))
    return F.trim(F.regexp_extract(padded, rf"(?:^|\s)({'|'.join(STAFF_TITLES)})(?:\s|$)", 1))


def rule_fake_admin(norm_name, is_real_admin, cfg: ModerationConfig) -> Column:
    title = staff_title(F.coalesce(col(norm_name), F.lit("")))
    claims = F.lit(cfg.block_fake_admin) & ~col(is_real_admin) & (title != "")
    return _fires(claims, F.concat(F.lit("fake_admin: "), title), hard=1)


def rule_obfuscation(text, rare=None) -> Column:
    points = obfuscation_score(text, rare)
    return _fires(points > 0, "obfuscation", soft=points)


def rule_caps(text) -> Column:
    """Over 70 % capitals leave few small letters; texts with more of them are not counted out."""
    loud = E.few_small_letters(text, 1.01 - CAPS_RATIO) & (E.caps_ratio(text) > CAPS_RATIO)
    return _fires(loud, "capitals", soft=1)


def rule_emoji(text, rare=None) -> Column:
    n = E.emoji_count(text, rare)
    return _fires(n >= 5, F.concat(F.lit("emoji: "), n.cast("string")),
                  soft=F.when(n >= 8, 2).otherwise(1))


def rule_story(has_story) -> Column:
    return _fires(col(has_story), "story", hard=1)


def rule_buttons(has_buttons) -> Column:
    return _fires(col(has_buttons), "buttons", soft=3)


def rule_via_bot(via_bot) -> Column:
    return _fires(col(via_bot), "via_bot", soft=1)


def rule_new_member_link(is_new, unknown_hosts, is_forward) -> Column:
    return _fires(col(is_new) & ((F.size(col(unknown_hosts)) > 0) | col(is_forward)),
                  "newcomer_link", soft=1)


def rule_no_username_link(is_new, has_username, urls) -> Column:
    return _fires(col(is_new) & ~col(has_username) & (F.size(col(urls)) > 0),
                  "no_username_link", soft=1)


def prior_points(partial_score, n) -> Column:
    """History only makes an already suspicious message worse."""
    return F.when(col(partial_score) > 0, F.least(2 * col(n), F.lit(4))).otherwise(0).cast("int")
