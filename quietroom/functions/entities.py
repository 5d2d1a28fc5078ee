"""Links, mentions, phone numbers and other entities found in message text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import SPACE, SPACES, WORD, beyond_latin1, col

# --- fixed values -------------------------------------------------------------
LINK_TLDS = (
    "com|net|org|io|co|xyz|top|icu|click|link|work|buzz|cfd|rest|monster|"
    "shop|site|online|live|vip|win|bet|casino|app|dev|me|tv|info|biz|ru|cn|"
    "vn|us|uk|asia|pro|store|fun|life|world|space|website|host|art|club"
)
URL = (
    rf"(?iu)(?<![{WORD}])(?=(?:https?://)?[a-z0-9-]++\.)(?:https?://|www\.)?"  # most words end without a dot
    r"(?:[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?\.)+"
    rf"(?:{LINK_TLDS})(?![{WORD}])(?:/[^{SPACE}]*)?"
)
_SPELLED_TLD = (rf"[{SPACE}]*[)\]}}]?[{SPACE}]*"
                rf"(?iu:com|net|org|io|xyz|top|vip|win|club|shop|live|me)(?![{WORD}])")
SPELLED_OUT_URL = (
    rf"(?iu)(?<![{WORD}])[a-z0-9][a-z0-9-]{{1,61}}[{SPACE}]*[(\[{{]?[{SPACE}]*(?:dot|\.|,)"
    + _SPELLED_TLD
)
DOT_TLD = rf"(?iu)\.(?:{LINK_TLDS})"
INVITE = r"(?i)(?:t\.me/\+|t\.me/joinchat/|telegram\.me/\+|telegram\.dog/)"
MENTION = rf"(?<![{WORD}@/])@([A-Za-z][A-Za-z0-9_]{{4,31}})(?![{WORD}])"
CRYPTO = (
    rf"(?=[b130T])(?<![{WORD}])(?:(?:bc1|[13])[a-hj-np-z0-9]{{25,62}}|0x[a-fA-F0-9]{{40}}"
    rf"|T[1-9A-HJ-NP-Za-km-z]{{33}})(?![{WORD}])"
)
PHONE = (
    rf"(?=[0+])(?:(?<![\p{{Nd}}+])0[35789]\p{{Nd}}(?:[{SPACE}.\-]?\p{{Nd}}){{7}}(?!\p{{Nd}})"
    rf"|\+\p{{Nd}}{{1,3}}[{SPACE}.\-]?\p{{Nd}}(?:[{SPACE}.\-]?\p{{Nd}}){{5,13}}(?!\p{{Nd}}))"
)
MONEY = (
    rf"(?iu)(?=\p{{Nd}})(?<![{WORD}])\p{{Nd}}{{2,4}}[{SPACE}]*"
    rf"(?:(?:k|m|usd)(?![{WORD}])|\$(?=[{WORD}]))"
    rf"|(?=\p{{Nd}})(?<![{WORD}])\p{{Nd}}{{1,4}}[{SPACE}]*(?:tr|trieu|triệu|củ|cu)(?![{WORD}])"
    rf"|[$₫][{SPACE}]*\p{{Nd}}{{3,}}"
)
EMOJI = r"[\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}\x{1F1E6}-\x{1F1FF}\x{2B00}-\x{2BFF}]"
EMV_PAYMENT = r"(?s)^000201.*(?:5303\p{Nd}{3}|58\p{Nd}{2}[A-Z]{2})"
WALLET_URI = (
    r"(?i)^(?:bitcoin|ethereum|tron|litecoin|ton|solana|monero|bnb|metamask|trust|wc):"
)
APP_URI = r"(?i)^(?:tg://|telegram://)"
URL_TAIL = ".,;:!?)»\"'"
FORWARD_LABELS = {
    "user": "người dùng",
    "hidden_user": "người dùng ẩn danh",
    "chat": "nhóm khác",
    "channel": "kênh khác",
}
OTHER_FORWARD = "nguồn khác"
# ------------------------------------------------------------------------------

CAPITALS = r"(?:[A-Z]|(?=[^\x00-\x7F])\p{Lu})+"
# The same as patterns above (of the spelled-out link its ending), led by characters that texts seldom have.
INVITE_AT_SLASH = (r"(?i)/(?:(?<=t\.me/|telegram\.me/)\+|(?<=t\.me/)joinchat/|(?<=telegram\.dog/))")
SPELLED_SIGN = r"[.,]" + _SPELLED_TLD
SPELLED_ENDING = r"[.,tT](?<=[.,]|[dD][oO][tT])" + _SPELLED_TLD
AMOUNT = rf"(?=[0123456789$\x{{660}}-\x{{10FFFF}}])(?:{MONEY})"  # digits beyond ASCII begin at U+0660
# The spelled-out link in two: a name up to its last character, which leaves nothing to go back to, or one with
# "dot" inside it, found from there.  ``_NAME`` is [a-z0-9] with all that equals it without regard to case.
_NAME = r"A-Za-z0-9\x{130}\x{131}\x{17F}\x{212A}"
SPELLED_CLOSE = rf"[.,](?={_SPELLED_TLD})(?<=(?<![{WORD}])[{_NAME}][{_NAME}-]{{1,61}}[.,])"  # the usual case
SPELLED_NAME = (
    rf"(?=[{_NAME}])(?<![{WORD}])[{_NAME}][{_NAME}-]{{1,61}}+[{SPACE}]*+[(\[{{]?+[{SPACE}]*+(?:[.,]|[dD][oO][tT])"
    rf"{_SPELLED_TLD}"
    rf"|[dD][oO][tT](?={_SPELLED_TLD})(?<=(?<![{WORD}])[{_NAME}][{_NAME}-]{{1,61}}[dD][oO][tT])"
)
PHONE_START = r"[0+](?:[35789]|(?<=\+)\p{Nd})"
NO_STRINGS = "array<string>"


def no_strings() -> Column:
    return F.array().cast(NO_STRINGS)


def word_list(words) -> Column:
    """A constant array, built by one expression however long it is."""
    return F.split(F.lit("|".join(words)), r"\|")


def _list(c) -> Column:
    return F.coalesce(col(c), no_strings())


def strip_spaces(c) -> Column:
    return F.btrim(col(c), F.lit(SPACES))


def find_all(c, pattern: str, group: int = 0) -> Column:
    return F.coalesce(
        F.regexp_extract_all(col(c), F.lit(pattern), F.lit(group)), no_strings())


def has(c, pattern: str) -> Column:
    return F.coalesce(col(c).rlike(pattern), F.lit(False))


def message_text(text, caption) -> Column:
    return F.concat_ws(" ", F.nullif(col(text), F.lit("")), F.nullif(col(caption), F.lit("")))


def scannable_text(text, qr_payloads, ocr_text) -> Column:
    """Text plus whatever was decoded from the picture; never used to find links."""
    return strip_spaces(F.concat_ws(
        " ", F.coalesce(col(text), F.lit("")), _list(qr_payloads),
        F.coalesce(col(ocr_text), F.lit(""))))


def links_in(c) -> Column:
    """Links written in a text.  Texts without a dotted ending skip the long pattern."""
    t = col(c)
    return F.when(t.rlike(DOT_TLD), find_all(t, URL)).otherwise(no_strings())


def extract_urls(text, entity_urls=None) -> Column:
    urls = links_in(text)
    if entity_urls is not None:
        urls = F.array_union(urls, _list(entity_urls))
    return F.filter(F.array_distinct(urls), lambda u: u != "")


def _bare_url(c) -> Column:
    u = F.rtrim(strip_spaces(c), F.lit(URL_TAIL))
    return F.regexp_replace(u, r"(?i)^[a-z][a-z0-9+.\-]*://", "")


def _host_of(bare: Column) -> Column:
    h = bare
    for mark in "/?#":
        h = F.substring_index(h, mark, 1)
    h = F.substring_index(F.substring_index(h, "@", -1), ":", 1)
    return F.regexp_replace(F.lower(h), r"^www\.", "")


def hostname(c) -> Column:
    return _host_of(_bare_url(c))


def split_url(c) -> Column:
    bare = _bare_url(c)
    path = F.regexp_replace(bare, "^[^/]*/?", "")
    path = F.substring_index(F.substring_index(path, "?", 1), "#", 1)
    return F.struct(_host_of(bare).alias("host"),
                    F.lower(F.btrim(path, F.lit("/"))).alias("path"))


def is_real_host(host: Column) -> Column:
    return (host != "") & host.contains(".")


def real_hosts(urls) -> Column:
    return F.array_distinct(F.filter(F.transform(col(urls), hostname), is_real_host))


def short_url(c) -> Column:
    """``host/path`` or just ``host``, as shown in reasons."""
    parts = split_url(c)
    return F.concat_ws("/", parts["host"], F.nullif(parts["path"], F.lit("")))


def canonical_domain(c) -> Column:
    """Form in which an allow-list entry is stored; a path is kept."""
    d = F.ltrim(F.lower(strip_spaces(c)), F.lit("."))
    d = F.regexp_replace(d, r"^(?:https://)?(?:http://)?(?:www\.)?", "")
    d = F.substring_index(F.substring_index(d, "?", 1), "#", 1)
    return F.rtrim(d, F.lit("/"))


def extract_mentions(text, mentions=None) -> Column:
    t = col(text)
    found = F.when(t.contains("@"), find_all(t, MENTION, 1)).otherwise(no_strings())
    found = F.transform(found, F.lower)
    if mentions is not None:
        tagged = F.transform(
            _list(mentions), lambda m: F.lower(F.ltrim(strip_spaces(m), F.lit("@"))))
        found = F.array_union(tagged, found)
    return F.filter(F.array_distinct(found), lambda h: h != "")


def canonical_username(c) -> Column:
    return F.lower(F.rtrim(F.ltrim(strip_spaces(c), F.lit("@")), F.lit(",")))


def extract_phones(c) -> Column:
    t = col(c)
    found = F.when(t.rlike(PHONE_START), find_all(t, PHONE)).otherwise(no_strings())
    return F.array_distinct(
        F.transform(found, lambda p: F.regexp_replace(p, rf"[{SPACE}.\-]", "")))


def canonical_phone(c) -> Column:
    return F.regexp_replace(col(c), rf"[{SPACE}.\-()]", "")


def has_crypto_address(c) -> Column:
    return has(c, CRYPTO)


def has_money_amount(c) -> Column:
    return has(c, AMOUNT)


def emoji_count(c, rare=None) -> Column:
    """``rare`` may pass in ``beyond_latin1`` of the text."""
    r = beyond_latin1(c) if rare is None else col(rare)
    return F.when(r != "", F.regexp_count(r, F.lit(EMOJI))).otherwise(0)


def caps_ratio(c) -> Column:
    """Share of capitals, or null below 25 letters."""
    letters = F.char_length(F.regexp_replace(col(c), r"[^\p{L}]+", ""))
    capitals = F.char_length(col(c)) - F.char_length(F.regexp_replace(col(c), CAPITALS, ""))
    return F.when(letters >= 25, capitals / letters)


def few_small_letters(c, share: float) -> Column:
    """Whether a-z make up less than ``share`` of the text: where the share of capitals is above ``1 - share``,
    they do."""
    t = col(c)
    n = F.char_length(t)

    def small(part: Column) -> Column:
        return F.char_length(part) - F.char_length(F.regexp_replace(part, "[a-z]+", ""))

    # the first half of most texts already has enough of them
    few = (small(F.substring(t, F.lit(1), F.ceil(n / 2).cast("int"))) < share * n) & (small(t) < share * n)
    return F.coalesce(few, F.lit(False))


def has_obfuscated_url(c) -> Column:
    """``name (dot) com`` and the like; its second half, quick to rule out, is tried first, and without its
    most frequent letter where the text has no "dot" at all."""
    ending = F.when(F.lower(col(c)).contains("dot"), has(c, SPELLED_ENDING)).otherwise(has(c, SPELLED_SIGN))
    return ending & (has(c, SPELLED_CLOSE) | has(c, SPELLED_NAME))


def has_invite_link(c) -> Column:
    return has(c, INVITE_AT_SLASH)


def forward_label(origin_type) -> Column:
    labels = F.create_map(*[F.lit(x) for kv in FORWARD_LABELS.items() for x in kv])
    o = col(origin_type)
    return F.when(o.isNotNull(), F.coalesce(labels[o], F.lit(OTHER_FORWARD)))


def host_matches(host: Column, pattern: Column) -> Column:
    return (host == pattern) | F.endswith(host, F.concat(F.lit("."), pattern))


def unknown_urls(urls, allow) -> Column:
    """Links not covered by an allow-list array of ``host`` or ``host/path`` entries."""
    entries = F.transform(_list(allow), lambda e: F.struct(
        F.lower(F.substring_index(e, "/", 1)).alias("host"),
        F.lower(F.btrim(F.regexp_replace(e, "^[^/]*/?", ""), F.lit("/"))).alias("path")))

    def covered(parts):
        return F.exists(entries, lambda e: host_matches(parts["host"], e["host"]) & (
            (e["path"] == "") | (parts["path"] == e["path"])
            | F.startswith(parts["path"], F.concat(e["path"], F.lit("/")))))

    def unknown(u):
        parts = split_url(u)
        return is_real_host(parts["host"]) & ~covered(parts)

    u = col(urls)
    return F.when(F.size(u) > 0, F.filter(u, unknown)).otherwise(no_strings())


QR_KINDS = ("payment", "wallet", "invite", "unknown_link", "allowed_link", "other")


def qr_links(payload) -> Column:
    p = strip_spaces(payload)
    written = F.filter(F.array_distinct(find_all(p, URL)), lambda u: is_real_host(hostname(u)))
    whole = F.when(p.contains("://") & hostname(p).contains("."), F.array(p)
                   ).otherwise(no_strings())
    return F.when(F.size(written) > 0, written).otherwise(whole)


def classify_qr_payload(payload, allow) -> Column:
    """First matching kind of one decoded payload, in the order of ``QR_KINDS``."""
    p = strip_spaces(payload)
    links = qr_links(payload)
    return (F.when(p.rlike(EMV_PAYMENT), "payment")
            .when(p.rlike(WALLET_URI) | p.rlike(CRYPTO), "wallet")
            .when(p.rlike(INVITE) | p.rlike(APP_URI), "invite")
            .when(F.size(unknown_urls(links, allow)) > 0, "unknown_link")
            .when(F.size(links) > 0, "allowed_link")
            .otherwise("other"))
