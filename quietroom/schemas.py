"""Fixed schemas of the tables."""

MESSAGE = """message_id bigint, chat_id bigint, user_id bigint, sender_chat_id bigint,
linked_chat_id bigint, is_automatic_forward boolean, user_is_bot boolean, ts_s bigint,
text string, caption string, entity_urls array<string>, mentions array<string>,
is_forward boolean, forward_origin string, via_bot boolean, from_channel boolean,
has_buttons boolean, has_media boolean, has_entities boolean, has_username boolean,
has_qr boolean, qr_payloads array<string>, ocr_text string, sender_name string,
username string, has_story boolean"""

RULE_TABLES = {
    "members": "chat_id bigint, user_id bigint, first_seen bigint, msg_count bigint, "
               "trusted boolean",
    "chat_whitelist": "chat_id bigint, domain string",
    "forward_whitelist": "chat_id bigint, user_id bigint",
    "blacklist": "chat_id bigint, entity_id bigint",
    "username_whitelist": "chat_id bigint, username string",
    "phone_whitelist": "chat_id bigint, phone string",
    "keyword_blacklist": "chat_id bigint, phrase string",
    "bot_admins": "user_id bigint",
    "starters": "user_id bigint, name string, username string, ts_s bigint",
}

OFFENCE = """chat_id bigint, user_id bigint, ts_s bigint, score int, action string,
reasons string, excerpt string, name string, message_id bigint"""
