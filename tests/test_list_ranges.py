import random

import pytest

from quietroom.config import ModerationConfig
from quietroom.operators import lists as L
from quietroom.plans.moderate import moderate
from quietroom.schemas import RULE_TABLES
from quietroom.sources import tables as S
from quietroom.sources.storage import new_folder

KEYS = ["chat_id", "entity_id"]


def _on(start, edits, chat, who, at):
    """Whether the entry is on the list of a chat or of all at a second, edit by edit."""
    for scope in {chat, 0}:
        on = (scope, who) in start
        for ts, _, c, e, op in sorted(edits):
            if (c, e) == (scope, who) and ts <= at:
                on = op != "delete"
        if on:
            return True
    return False


@pytest.mark.parametrize("limit", [500_000, 0])
def test_blocked_at_each_message(spark, monkeypatch, limit):
    """Against edit by edit, several edits in one second, both with and without broadcasts."""
    monkeypatch.setattr(L, "MAX_BROADCAST_ROWS", limit)
    dice = random.Random(7)
    start = {(dice.randint(0, 3), dice.randint(1, 5)) for _ in range(6)}
    edits = [(1000 + dice.randint(0, 40_000), i, dice.randint(0, 3), dice.randint(1, 6), dice.choice(["add", "delete", "set"]))
             for i in range(120)]
    edits += [(5000, 500 + i, 1, 2, op) for i, op in enumerate(["add", "delete", "add", "delete"])]
    rows = [(i, dice.randint(1, 3), dice.choice([*range(1, 8), None]), None, 1000 + dice.randint(-500, 41_000)) for i in range(400)]
    rows += [(900 + i, 1, 2, None, t) for i, t in enumerate((4999, 5000, 5001))] + [(950, 1, 9, 2, 5000)]
    msgs = spark.createDataFrame(rows, "message_id long, chat_id long, user_id long, sender_chat_id long, ts_s long")
    log = spark.createDataFrame([(i, t, c, e, op) for t, i, c, e, op in edits], "id long, ts_s long, chat_id long, entity_id long, op string")
    held = L.list_ranges(spark.createDataFrame(sorted(start), "chat_id long, entity_id long"), log, KEYS)
    got = L.blocked_sender(msgs, held)
    assert got.columns == [*msgs.columns, "is_blocked"]
    want = {i: _on(start, edits, c, u if s is None else s, t) for i, c, u, s, t in rows}
    found = got.collect()
    assert len(found) == len(rows) and {r.message_id: r.is_blocked for r in found} == want
    assert 0 < sum(want.values()) < len(want)


def test_added_and_withdrawn_between_equal_messages(spark):
    msgs = spark.createDataFrame([(1, 1, 5, None, 100), (2, 1, 5, None, 200), (3, 1, 5, None, 300)],
                                 "message_id long, chat_id long, user_id long, sender_chat_id long, ts_s long")
    empty = spark.createDataFrame([], "chat_id long, entity_id long")
    log = spark.createDataFrame([(1, 150, 1, 5, "add"), (2, 250, 1, 5, "delete")], "id long, ts_s long, chat_id long, entity_id long, op string")
    got = L.blocked_sender(msgs, L.list_ranges(empty, log, KEYS)).collect()
    assert {r.message_id: r.is_blocked for r in got} == {1: False, 2: True, 3: False}
    none = L.blocked_sender(msgs, L.list_ranges(empty, log.limit(0), KEYS)).collect()
    assert not any(r.is_blocked for r in none) and len(none) == 3


def test_replay_with_a_list_that_changes(spark):
    """Of three equal messages, the one sent while its sender was on the deny list is an offence."""
    path, folder = new_folder(spark, "json"), new_folder(spark, "lists")
    rows = [(i, 1, 5, t, "good morning") for i, t in ((1, 100), (2, 200), (3, 300))]
    spark.createDataFrame(rows, "message_id bigint, chat_id bigint, user_id bigint, ts_s bigint, text string").write.json(path)
    log = spark.createDataFrame([(1, 150, 1, 5, "add"), (2, 250, 1, 5, "delete")], "id long, ts_s long, chat_id long, entity_id long, op string")
    lists = S.read_rules(spark, folder, optional=tuple(RULE_TABLES))
    lists["blacklist"] = L.list_ranges(lists["blacklist"], log, KEYS)
    out = moderate(S.read_messages(spark, path, "json"), lists, spark.createDataFrame([(1,)], "chat_id bigint"),
                   spark.createDataFrame([(1, 9, "boss")], "chat_id bigint, user_id bigint, username string"),
                   spark.createDataFrame([(1, True)], "chat_id bigint, known boolean"), ModerationConfig())
    assert [(r.message_id, list(r.verdict.reasons)) for r in out.collect()] == [(2, ["blocked_sender"])]
