"""Chat formatting, checked by a grammar round trip.

A conversation is rendered as

    ### role: text</turn>\n

per turn.  The grammar of the rendered text is deterministic: a backslash makes an escape with
the character behind it, a role ends at the first plain ``:``, a text at the first plain
``</turn>``, and neither may hold a plain ``### ``.  After rendering, the text is parsed again.
Turns that do not come back as they were are rendered once more with every backslash, ``#`` and
``<`` (in roles also ``:``) escaped, until the parsed conversation is identical to its source.
Text without conflicts is left as it is.

The loss mask is a list of (start, end) spans, in code points of the rendered text, that cover
the texts of assistant turns.

Defined cases: a null text or role counts as empty.  Turns are ordered by turn number (null
first), then role and text; repeated rows are turns of their own.  Rows with a null
conversation id form one conversation.  An empty table gives an empty result.  Other columns
take no part.  A conversation is one text, and its digest runs over all its turns in order, so
the rows of a conversation meet in one task: each must fit into a task's memory.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shipping import ship

HEAD, SEP, END = "### ", ": ", "</turn>\n"
ASSISTANT = "assistant"
# every repeat is possessive: what one alternative takes no other could, so a failed match is known after one pass
_TURN = re.compile(r"### ((?:[^\\:#<]++|\\.)*+): ((?:[^\\<#]++|\\.|<(?!/turn>)|#(?!## ))*+)</turn>\n", re.S)
_ESCAPE = re.compile(r"\\([\\#<:])")
_IN_TEXT, _IN_ROLE = re.compile(r"[\\#<]"), re.compile(r"[\\#<:]")

Turn = tuple[str, str]


def _unescaped(text: str) -> str:
    return _ESCAPE.sub(r"\1", text) if "\\" in text else text


def _render_turn(role: str, text: str, escape: bool) -> str:
    if escape:
        role, text = _IN_ROLE.sub(r"\\\g<0>", role), _IN_TEXT.sub(r"\\\g<0>", text)
    return f"{HEAD}{role}{SEP}{text}{END}"


def parse(formatted: str) -> list[tuple[str, str, int, int]] | None:
    """(role, text, start, end of the text) per turn; None if the text does not follow the grammar."""
    turns, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            return None
        turns.append((_unescaped(m[1]), _unescaped(m[2]), m.start(2), m.end(2)))
        at = m.end()
    return turns


def render(turns: list[Turn]) -> str:
    """Rendered conversation that parses to exactly ``turns``."""
    parts = [_render_turn(r, t, False) for r, t in turns]
    for i, (part, turn) in enumerate(zip(parts, turns)):
        back = parse(part)
        if back is None or [x[:2] for x in back] != [turn]:
            parts[i] = _render_turn(*turn, True)
    formatted = "".join(parts)
    back = parse(formatted)
    if back is None or [x[:2] for x in back] != list(turns):
        raise ValueError("a rendered conversation does not parse to its source")
    return formatted


def _format(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        texts, masks = [], []
        for roles, bodies in zip(pdf["roles"], pdf["texts"]):
            formatted = render(list(zip(roles, bodies)))
            texts.append(formatted)
            masks.append([{"start": a, "end": b} for r, _, a, b in parse(formatted) if r == ASSISTANT])
        yield pd.DataFrame({"conv_id": pdf["conv_id"], "formatted": texts, "loss_mask": masks})


def format_chats(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn",
                 role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, formatted, loss_mask: one row per conversation."""
    ship(rows.sparkSession)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    turns = (rows.groupBy(F.col(conv_col).cast("long").alias("conv_id"))
             .agg(F.sort_array(F.collect_list(F.struct(
                 F.col(turn_col).alias("turn"), text(role_col).alias("role"), text(text_col).alias("text"))))
                 .alias("turns"))
             .select("conv_id", F.col("turns.role").alias("roles"), F.col("turns.text").alias("texts")))
    return turns.mapInPandas(_format, "conv_id long, formatted string, loss_mask array<struct<start:int,end:int>>")


def read_back(formatted: str, mask: list) -> tuple:
    """Digests of a rendered conversation, from its text and mask alone."""
    turns = parse(formatted)
    said = "".join(f"{r}\n{t}\n" for r, t, _, _ in turns)
    loss = "".join(_unescaped(formatted[m["start"]:m["end"]]) for m in mask)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return len(turns), sha(said), len(loss), sha(loss), len(formatted)


def _digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = ["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    for pdf in batches:
        out = pd.DataFrame([read_back(*x) for x in zip(pdf["formatted"], pdf["loss_mask"])], columns=names)
        out.insert(0, "conv_id", pdf["conv_id"].to_numpy())
        yield out


def digests(chats: DataFrame) -> DataFrame:
    """What ``format_chats`` wrote, read back: counts and digests per conversation."""
    return chats.mapInPandas(_digest, "conv_id long, n_turns long, turns_sha256 string, "
                                      "loss_chars long, loss_sha256 string, formatted_chars long")
