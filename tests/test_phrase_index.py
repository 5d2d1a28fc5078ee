import random

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quietroom.functions.text import normalize_keep_accents, squeeze_spaces
from quietroom.operators import lists as L
from quietroom.operators import phrase_index as P
from quietroom.sources.storage import staged

letters = st.text("abcđé", min_size=1, max_size=14)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from([0, 1, 2, -7]), letters), max_size=25), st.text("abcđé", max_size=60),
       st.sampled_from([1, 2, -7, None]))
def test_index_finds_what_is_inside(rows, text, chat):
    index = P.PhraseIndex.of([(s, f"p {n}", n) for s, n in rows])
    want = sorted({f"p {n}" for s, n in rows if s in (0, chat) and n in text})
    assert index.hits(text.encode(), chat) == want


def test_needles_around_one_gram_are_not_searched_for():
    """Of many needles that share their rarest gram, only those around its place are compared."""
    compared = []

    class Text(bytes):
        def __contains__(self, needle):
            compared.append(needle)
            return super().__contains__(needle)

        def startswith(self, needle, *at):
            compared.append(needle)
            return super().startswith(needle, *at)

    ends = "abcdeghijklmnopqrstu"
    index = P.PhraseIndex.of([(0, f"p{x}{y}", f"{x}commonwd{y}") for x in ends for y in ends])
    assert index.hits(Text(b"vvbcommonwdkvv"), 1) == ["pbk"]
    assert len(compared) <= 2


@pytest.mark.parametrize("times", [P.OFTEN - 1, P.OFTEN + 1, 5000])
def test_gram_that_a_text_repeats(times):
    index = P.PhraseIndex.of([(0, "a", "vaytien"), (1, "b", "tienvay"), (2, "c", "tien"), (0, "d", "nvaytienx")])
    assert index.hits(b"vaytien" * times, 1) == ["a", "b"]
    assert index.hits(b"vaytien" * times + b"x", 2) == ["a", "c", "d"]


def test_grams_are_all_places():
    assert P.grams(b"abcab", 3).tolist() == [int.from_bytes(b"abcab"[i:i + 3], "little") for i in range(3)]
    assert P.grams(b"ab", 3).tolist() == [] and P.grams(b"", 1).tolist() == []


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from([0, 1, 2]), letters, st.sampled_from(["", "commonword"])), max_size=20),
       st.lists(st.tuples(st.one_of(st.none(), st.text("abcđé", max_size=30)), st.sampled_from([0, 1, 2, None])), max_size=12),
       st.sampled_from([1, 3]), st.sampled_from([5, 1 << 18]))
def test_many_texts_in_parts(rows, msgs, count, places):
    """Texts that lie behind each other, in windows of any length, and an index in parts."""
    rows = [(s, f"p {n[:2]}", more + n) for s, n, more in rows]
    msgs = [(t and t.replace("c", "commonword"), c) for t, c in msgs]
    index = P.PhraseIndex.of_tables([pa.table([list(x) for x in zip(*rows[i::count])] or [[], [], []], P.ROW) for i in range(count)])
    texts, chats = pa.array([t for t, _ in msgs], pa.string()), pa.array([c for _, c in msgs], pa.int64())
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(P, "PLACES", places)
        patch.setattr(P, "PAIRS", places)
        got = [hits for answer in index.answers(texts, chats) for hits in answer.to_pylist()]
    assert got == [sorted({p for s, p, n in rows if s in (0, c) and n in (t or "")}) for t, c in msgs]


def test_needles_filed_under_a_gram_that_a_text_repeats():
    """More needles than are followed place by place, in a text of several windows."""
    ends = "abcdefghij"
    index = P.PhraseIndex.of([(1, f"{x}{y}", f"{x}{y * 9}commonwd{x}") for x in ends for y in "kl"])
    text = b"commonwdxyz" * 40_000
    assert index.hits(text, 1) == []
    assert index.hits(text + b"ckkkkkkkkkcommonwdc" + text + b"llllllllljcommonwdj", 1) == ["ck"]


def test_texts_are_looked_through_once(spark):
    """A filter on the phrases found does not have them looked for again."""
    phrases, msgs = _fixture(spark)
    found = P.with_indexed_hits(msgs, phrases, squeeze_spaces("keep_text"), "h", 1000).filter("size(h) > 0")
    assert found._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1


@pytest.mark.parametrize("limit, passes", [(500_000, 1), (250, 1), (60, 4)])
def test_texts_are_staged_between_rounds_alone(spark, monkeypatch, limit, passes):
    """Several parts of a long list are gone through at once, and there are no more parts than it needs."""
    phrases, msgs = _fixture(spark)
    written = []
    monkeypatch.setattr(P, "staged", lambda df: written.append(df.columns) or staged(df))
    P.with_indexed_hits(msgs, phrases, squeeze_spaces("keep_text"), "h", limit)
    assert sum("_squeezed" in columns for columns in written) == passes - 1


@pytest.mark.parametrize("phrase", ["!!", None])
def test_nothing_to_look_for(spark, phrase):
    phrases = spark.createDataFrame([(0, phrase)], "chat_id bigint, phrase string")
    msgs = spark.createDataFrame([(1, 1, "a b"), (2, None, None)], "message_id bigint, chat_id bigint, t string")
    assert [r.h for r in P.with_indexed_hits(msgs, phrases, squeeze_spaces("t"), "h", 10).collect()] == [[], []]


def test_phrase_without_a_chat_is_banned_nowhere(spark):
    phrases = spark.createDataFrame([(None, "ab"), (0, "b")], "chat_id bigint, phrase string")
    msgs = spark.createDataFrame([(1, 1, "a b"), (2, None, "ab")], "message_id bigint, chat_id bigint, t string")
    got = P.with_indexed_hits(msgs, phrases, squeeze_spaces("t"), "h", 10).collect()
    assert [r.h for r in got] == [["b"], ["b"]]


def _fixture(spark):
    dice = random.Random(3)
    words = ["vay", "tiền", "nhanh", "hộ", "trợ", "nợ", "xấu", "kèo", "thơm", "a", "bb", "ccc"]
    some = lambda n: " ".join(dice.choice(words) for _ in range(n))
    phrases = spark.createDataFrame([(dice.choice([0, 1, 2, 3]), some(dice.randint(1, 4))) for _ in range(400)] + [(1, "!!")],
                                    "chat_id bigint, phrase string")
    msgs = spark.createDataFrame([(i, dice.choice([1, 2, 9]), some(dice.randint(0, 12)), i % 7 == 0) for i in range(300)] + [
        (900, 1, None, False), (901, 2, "vay " * 30000, False), (902, 1, "x", None)],
        "message_id bigint, chat_id bigint, text string, quiet boolean")
    return phrases, msgs.withColumn("keep_text", normalize_keep_accents("text"))


@pytest.mark.parametrize("per_round", [500_000, 120])
def test_both_paths_and_many_rounds_agree(spark, monkeypatch, per_round):
    phrases, msgs = _fixture(spark)

    def hits(limit):
        monkeypatch.setattr(L, "PHRASES_PER_BUNDLE", limit)
        got = L.with_banned_hits(msgs, phrases, skip=msgs["quiet"])
        assert got.columns == [*msgs.columns, "banned_hits"]
        return sorted((r.message_id, r.banned_hits) for r in got.collect())

    monkeypatch.setattr(L, "MAX_BROADCAST_ROWS", per_round)
    bundled = hits(10_000)
    assert hits(1) == bundled and sum(len(h) for _, h in bundled) > 500


def test_twenty_thousand_phrases_stay_beside_the_texts(spark, monkeypatch):
    """No text is shuffled, and what is found does not depend on the number of other phrases."""
    phrases, msgs = _fixture(spark)
    more = spark.range(20_000).selectExpr("id % 4 AS chat_id", "concat('zq', lpad(id, 9, '7')) AS phrase")
    want = {r.message_id: r.banned_hits for r in L.with_banned_hits(msgs, phrases).collect()}
    out = L.with_banned_hits(msgs, phrases.unionByName(more))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    assert {r.message_id: r.banned_hits for r in out.collect()} == want


def test_squeezed_null_is_not_searched(spark):
    phrases = spark.createDataFrame([(0, "ab")], "chat_id bigint, phrase string")
    msgs = spark.createDataFrame([(1, 1, "a b"), (2, 1, None)], "message_id bigint, chat_id bigint, t string")
    got = P.with_indexed_hits(msgs, phrases, squeeze_spaces("t"), "h", 10).collect()
    assert {r.message_id: r.h for r in got} == {1: ["ab"], 2: []}
