"""Settings that bear on scoring; the defaults are fixed values."""

from __future__ import annotations

from dataclasses import dataclass

ACTIONS = ("ban", "mute", "delete", "report")
SERVICE_KINDS = ("join", "leave", "pin", "title", "photo", "videochat", "forum", "other")
# Switches that a stored setting ``cfg:<name>`` may override.
SWITCHES = ("scan_ocr", "scan_qr", "ban_all_groups", "block_phones", "block_mentions",
            "block_fake_admin", "block_forwards", "block_links")
GLOBAL = 0  # list entries under this chat id hold for every chat
FORCED_SCORE = 9999


@dataclass(frozen=True)
class ModerationConfig:
    action: str = "ban"
    mute_seconds: int = 86400
    spam_threshold: int = 5
    new_member_threshold: int = 3
    new_member_hours: int = 24
    new_member_messages: int = 3
    block_forwards: bool = True
    block_forwards_new_only: bool = False
    block_links: bool = True
    block_links_new_only: bool = False
    block_channel_senders: bool = True
    block_mentions: bool = True
    block_phones: bool = True
    block_fake_admin: bool = True
    ban_all_groups: bool = True
    brake_limit: int = 5
    brake_window: int = 60
    scan_qr: bool = True
    qr_max_bytes: int = 5_000_000
    scan_ocr: bool = True
    ocr_max_bytes: int = 5_000_000
    delete_service: tuple[str, ...] = ("join", "leave", "pin")
    allowed_domains: tuple[str, ...] = ()
    allowed_usernames: tuple[str, ...] = ()
    allowed_phones: tuple[str, ...] = ()

    @property
    def new_member_seconds(self) -> int:
        return self.new_member_hours * 3600

    def threshold_for(self, is_new: bool) -> int:
        return max(1, self.new_member_threshold if is_new else self.spam_threshold)
