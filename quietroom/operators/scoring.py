"""From a message to a verdict, without looking at any other message."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import FORCED_SCORE, ModerationConfig
from ..functions import entities as E
from ..functions import rules as R
from ..functions.dictionaries import WEIGHTS
from ..functions.phrases import has_any_keyword, keyword_hits, noisy_keyword_points
from ..functions.text import beyond_latin1, looks_like_question, normalize, squeeze_spaces

SIGNAL = "struct<reason:string,points:int>"
# What an absent input column means.
_MESSAGE_DEFAULTS = {
    "caption": ("string", None), "entity_urls": ("array<string>", []),
    "mentions": ("array<string>", []), "is_forward": ("boolean", False),
    "forward_label": ("string", None), "via_bot": ("boolean", False),
    "from_channel": ("boolean", False), "has_buttons": ("boolean", False),
    "has_media": ("boolean", False), "has_username": ("boolean", True),
    "has_qr": ("boolean", False), "qr_payloads": ("array<string>", []),
    "ocr_text": ("string", ""),
    "sender_name": ("string", ""), "is_real_admin": ("boolean", False),
    "has_story": ("boolean", False), "has_entities": ("boolean", False),
    "forward_origin": ("string", None),
}


def with_defaults(df: DataFrame) -> DataFrame:
    """Add missing message columns and replace nulls, so rules need no null handling."""
    cols = {}
    for name, (kind, value) in _MESSAGE_DEFAULTS.items():
        default = (E.no_strings() if value == [] else F.lit(value)).cast(kind)
        if name not in df.columns:
            cols[name] = default
        elif value is not None:
            cols[name] = F.coalesce(F.col(name), default)
    return df.withColumns(cols)


def is_plain() -> Column:
    """No pictures, links or buttons: only such messages can pass as questions."""
    return ~(F.col("has_media") | F.col("has_buttons") | F.col("has_qr") | F.col("has_entities"))


def is_benign_question(norm=None) -> Column:
    """Plain text that asks something; ``norm`` may pass in the canonical form of ``text``."""
    return is_plain() & looks_like_question(F.coalesce(F.col("text"), F.lit("")), norm)


HEAVY = ("text", "caption", "ocr_text", "entity_urls", "mentions", "body", "scannable", "norm",
         "norm_name", "squeezed", "keep_text", "any_hit", "rare")


def text_features(df: DataFrame, cfg: ModerationConfig) -> DataFrame:
    """All that is read off the texts themselves, each computed once per message.

    Rules that need nothing else are evaluated here, as ``t_*`` columns, so the texts can be
    left behind before anything is joined or shuffled (``without_texts``).  A message that
    says whether it has entities, but not whether it is a question, is examined for that.
    """
    given = df.columns
    df = with_defaults(df).withColumn("body", E.message_text("text", "caption"))
    df = df.withColumn("scannable", E.scannable_text("body", "qr_payloads", "ocr_text"))
    df = df.withColumns({
        "norm": normalize("scannable"),
        "rare": beyond_latin1("body"),
        "norm_name": normalize("sender_name"),
        "urls": E.extract_urls("body", "entity_urls"),
        "handles": E.extract_mentions("body", "mentions"),
        "phones": E.extract_phones("scannable"),
    })
    if "is_question" not in given:
        # without picture text and caption the canonical form is already there
        only_text = F.when(F.col("scannable") == F.col("text"), F.col("norm")).otherwise(
            normalize("text"))
        asks = is_benign_question(only_text) if "has_entities" in given else F.lit(False)
        df = df.withColumn("is_question", asks)
    scan = (F.col("norm") != "") & ~F.col("is_question")
    df = df.withColumns({
        "squeezed": squeeze_spaces("norm"),
        "hosts": E.real_hosts("urls"),
        "has_words": F.col("norm") != "",
        "any_hit": scan & has_any_keyword("norm"),
    })
    df = df.withColumns({
        f"{t}_hits": F.when(F.col("any_hit"), keyword_hits("norm", t)).otherwise(E.no_strings())
        for t in WEIGHTS})
    noisy = noisy_keyword_points("strong_hits", "medium_hits", "squeezed")
    return df.withColumns({
        "noisy_points": F.when(scan, noisy).otherwise(0),
        "t_invite": R.rule_invite("body"),
        "t_spelled_out": R.rule_obfuscated_url("body", "hosts"),
        "t_crypto": R.rule_crypto("scannable"),
        "t_money": R.rule_money("body"),
        "t_fake_admin": R.rule_fake_admin("norm_name", "is_real_admin", cfg),
        "t_obfuscation": R.rule_obfuscation("body", "rare"),
        "t_caps": R.rule_caps("body"),
        "t_emoji": R.rule_emoji("body", "rare"),
    })


def without_texts(df: DataFrame) -> DataFrame:
    return df.drop(*HEAVY)


def list_features(df: DataFrame, cfg: ModerationConfig) -> DataFrame:
    """What is left of links, mentions and phones after the allow lists."""

    def listed(name, values):
        own = F.coalesce(F.col(name), E.no_strings()) if name in df.columns else E.no_strings()
        return F.array_union(own, E.word_list(values)) if values else own

    domains = listed("allow_domains", cfg.allowed_domains)
    df = df.withColumns({
        "allow_domains": domains,
        "unknown_mentions": F.array_except(
            "handles", listed("allow_usernames", cfg.allowed_usernames)),
        "unknown_phones": F.array_except("phones", listed("allow_phones", cfg.allowed_phones)),
    })
    df = df.withColumn("unknown_urls", E.unknown_urls("urls", "allow_domains"))
    return df.withColumn("unknown_hosts", E.real_hosts("unknown_urls"))


def with_features(df: DataFrame, cfg: ModerationConfig) -> DataFrame:
    return list_features(text_features(df, cfg), cfg)


def signals(is_new: Column, cfg: ModerationConfig, threshold: Column) -> Column:
    """Every rule that fired, in a fixed order, as ``array<struct<reason, points>>``."""
    rules = [R.rule_keywords(f"{t}_hits", t, w) for t, w in WEIGHTS.items()]
    rules += [
        R.rule_noisy_keywords("noisy_points"),
        R.rule_forward("is_forward", "forward_label", "has_media", "has_qr", is_new, cfg),
        R.rule_channel_sender("from_channel", cfg),
        R.rule_unknown_link("unknown_urls", is_new, cfg),
        R.rule_shortener("hosts"),
        R.rule_risky_tld("hosts"),
        F.col("t_invite"),
        F.col("t_spelled_out"),
        *R.rule_qr_present("has_qr", "qr_payloads", is_new),
    ]
    rest = [
        R.rule_mentions("handles", "unknown_mentions", cfg),
        F.col("t_crypto"),
        R.rule_phone("unknown_phones", "has_words", "urls", cfg),
        F.col("t_money"),
        F.col("t_fake_admin"),
        F.col("t_obfuscation"),
        F.col("t_caps"),
        F.col("t_emoji"),
        R.rule_story("has_story"),
        R.rule_buttons("has_buttons"),
        R.rule_via_bot("via_bot"),
        R.rule_new_member_link(is_new, "unknown_hosts", "is_forward"),
        R.rule_no_username_link(is_new, "has_username", "urls"),
    ]
    qr = F.when(F.size("qr_payloads") > 0, R.rule_qr_payload("qr_payloads", "allow_domains")
                ).otherwise(F.array().cast("array<struct<hard:int,soft:int,reason:string>>"))
    fired = F.array_compact(F.concat(F.array(*rules), qr, F.array(*rest)))
    return F.transform(fired, lambda r: F.struct(
        r["reason"].alias("reason"),
        (r["hard"] * threshold + r["soft"]).cast("int").alias("points")))


def total(sig: Column) -> Column:
    return F.aggregate(sig, F.lit(0), lambda acc, s: acc + s["points"])


def verdict(sig: Column, threshold: Column, prior: Column) -> Column:
    """``struct<score, threshold, reasons, is_spam>`` from signals and earlier offences."""
    base = total(sig)
    extra = R.prior_points(base, prior)
    listed = F.transform(sig, lambda s: F.concat(
        s["reason"], F.lit(" (+"), s["points"].cast("string"), F.lit(")")))
    history = F.concat(F.lit("prior_offences: "), prior.cast("string"), F.lit(" (+"),
                       extra.cast("string"), F.lit(")"))
    reasons = F.when(extra > 0, F.concat(listed, F.array(history))).otherwise(listed)
    score = (base + extra).cast("int")
    return F.struct(score.alias("score"), threshold.cast("int").alias("threshold"),
                    reasons.alias("reasons"), (score >= threshold).alias("is_spam"))


def summary(v) -> Column:
    v = F.col(v) if isinstance(v, str) else v
    return F.concat(v["score"].cast("string"), F.lit("/"), v["threshold"].cast("string"),
                    F.lit(" · "), F.array_join(v["reasons"], "; "))


def score_messages(df: DataFrame, cfg: ModerationConfig, attach=None) -> DataFrame:
    """Add ``verdict``.  Needs ``is_new_member`` and ``prior_offences`` (absent: old, none).

    ``attach`` may add the chats' allow lists to the features (see ``attach_lists``).
    """
    cols = df.columns
    new = F.col("is_new_member") if "is_new_member" in cols else F.lit(False)
    prior = F.col("prior_offences") if "prior_offences" in cols else F.lit(0)
    df = df.withColumns({"_new": F.coalesce(new, F.lit(False)),
                         "_prior": F.coalesce(prior, F.lit(0)).cast("int")})
    df = text_features(df, cfg)
    if attach is not None:
        df = attach(without_texts(df))
    df = list_features(df, cfg).withColumn("_threshold", R.threshold("_new", cfg))
    df = df.withColumn("_signals", signals(F.col("_new"), cfg, F.col("_threshold")))
    v = verdict(F.col("_signals"), F.col("_threshold"), F.col("_prior"))
    return df.select(*[c for c in cols if c in df.columns], v.alias("verdict"))


def forced_verdict(reason: Column) -> Column:
    return F.struct(F.lit(FORCED_SCORE).alias("score"), F.lit(1).alias("threshold"),
                    F.array(reason).alias("reasons"), F.lit(True).alias("is_spam"))


def forced_reason(blocked, hits) -> Column:
    """Why a message is punished without scoring; null when it is not."""
    shown = F.concat(F.lit("banned_phrase: "), F.array_join(F.slice(F.col(hits), 1, 3), ", "))
    return F.when(F.col(blocked), F.lit("blocked_sender")).when(F.size(F.col(hits)) > 0, shown)


def score_both(features: DataFrame, cfg: ModerationConfig) -> DataFrame:
    """Signals of each message for a newcomer and for an old member.

    The verdict itself needs the sender's history; scoring both cases here means the texts
    are read once and the history step only handles numbers.
    """
    df = list_features(features, cfg)
    t_new, t_old = F.lit(cfg.threshold_for(True)), F.lit(cfg.threshold_for(False))
    return df.withColumns({
        "signals_new": signals(F.lit(True), cfg, t_new),
        "signals_old": signals(F.lit(False), cfg, t_old)})
