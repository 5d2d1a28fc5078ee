import math
import random
from functools import lru_cache

import pytest
from pyspark.sql import functions as F

from quietroom.llm import pieces


@lru_cache(None)
def vocabulary():
    return pieces.read_vocabulary()


def every_path(voc, text):
    """All segmentations of a short text with their scores."""
    @lru_cache(None)
    def rest(i):
        if i == len(text):
            return [(0, ())]
        out = []
        if text[i] not in voc.pieces:
            out += [(s + voc.unknown, tuple(voc.bytes_ids[b] for b in text[i].encode()) + p) for s, p in rest(i + 1)]
        for j in range(i + 1, len(text) + 1):
            if text[i:j] in voc.pieces:
                score, k = voc.pieces[text[i:j]]
                out += [(s + score, (k,) + p) for s, p in rest(j)]
        return out
    return rest(0)


@pytest.mark.parametrize("text", ["the cat", "thereof.", "a  b", "x\ny z", "日本 ▁a", "don't", "***abc"])
def test_n_best_against_all_paths(text):
    voc = vocabulary()
    want = sorted((s for s, _ in every_path(voc, " " + text)), reverse=True)
    all_paths = {(s, p) for s, p in every_path(voc, " " + text)}
    for n in (1, 2, 5, 8):
        got = voc.encode(text, n)
        assert [s for s, _ in got] == want[:n]
        assert len({tuple(p.tolist()) for _, p in got}) == len(got)
        assert all((s, tuple(p.tolist())) in all_paths for s, p in got)


@pytest.mark.parametrize("text", [" the", " ", " \n ", " a b", "a "])
def test_n_best_of_a_text_with_one_blank_in_front(text):
    test_n_best_against_all_paths(text)


def test_n_best_against_the_library():
    sentencepiece = pytest.importorskip("sentencepiece")
    proto = pytest.importorskip("sentencepiece.sentencepiece_model_pb2").ModelProto()
    with open(pieces.MODEL, "rb") as f:
        proto.ParseFromString(f.read())
    proto.trainer_spec.model_type = 1  # read the same pieces as a unigram vocabulary
    rank = 0
    for p in proto.pieces:
        if p.type == 1:
            p.score = -math.log(rank + 2)
            rank += 1
    sp = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
    chance, voc = random.Random(1), vocabulary()
    for _ in range(40):
        text = " ".join("".join(chance.choice("theraonisd.,é") for _ in range(chance.randint(1, 9))) for _ in range(12))
        want = [sum(proto.pieces[i].score for i in ids) for ids in sp.NBestEncodeAsIds(text, 4)]
        assert [s / pieces.UNIT for s, _ in voc.encode(text, 4)] == pytest.approx(want, abs=1e-3)


def test_many_units_at_once_equal_one_by_one():
    chance, voc = random.Random(2), vocabulary()
    units = [" " * chance.randint(0, 2) + "".join(chance.choice("therandoisn.,é日\u2581😀") for _ in range(chance.randint(1, 14)))
             for _ in range(800)] + ["\n", "x" * 200, " "]
    total, second, counts, ids = voc.best_of_all(units)
    at = 0
    for unit, t, s, c in zip(units, total, second, counts):
        want = voc.best(unit)
        assert (t, tuple(ids[at:at + c]), s) == want
        found = voc.search(unit, 2)
        assert found[0][0] == t and (len(found) == 1 or t - found[1][0] == s)
        at += c


def test_round_trip_in_spark(spark, documents, odd):
    df = documents(odd + [(30, "tab\tand\r\nline  ends \n"), (31, "😀 ▁▁ \u0000 ok"), (32, "xx" * 3000)], clash=True)
    got = pieces.decode_best(pieces.encode_documents(df, n=3)).collect()
    assert len(got) == df.count()
    for r in got:
        assert r.decoded == r.text and r.round_trip == (None if r.text is None else True)
        if r.text is None:
            assert r.paths is None
        elif r.text == "":
            assert r.paths == [[]]
        else:
            assert r.scores == sorted(r.scores, reverse=True) and len(r.paths) == len(r.scores)
    others = df.select(F.col("text")).where("text IS NOT NULL").limit(3)
    decode = pieces.decoder(spark)
    second = pieces.encode_documents(documents([(1, "the second best")]), n=3)
    assert second.select(decode(F.get("paths", F.lit(2)))).first()[0] == "the second best"
    assert others.count() == 3


def test_empty(documents):
    assert pieces.encode_documents(documents([])).count() == 0
