import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from quietroom.llm import mixing


def words(t):
    return len(re.findall(r"[^ \t-\r]+", t or ""))


def shares(sizes, weights, repeats=3):
    """Resharing round by round, as the rule says it."""
    target, full = {s: 0.0 for s in sizes}, set()
    left = float(sum(sizes.values()))
    while True:
        open_ = [s for s in sizes if s not in full and weights[s]]
        if left <= 1e-9 or not open_:
            return target
        total = sum(weights[s] for s in open_)
        extra = 0.0
        for s in open_:
            target[s] += left * weights[s] / total
            if target[s] >= repeats * sizes[s]:
                extra += target[s] - repeats * sizes[s]
                target[s] = float(repeats * sizes[s])
                full.add(s)
        left = extra


def test_targets_match_resharing(spark):
    chance = random.Random(3)
    sizes = {f"s{i:03d}": chance.choice([0, 1, 5, 50, 400, 9000]) for i in range(40)}
    table = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(sizes))}
    got = {r.source: r.target for r in mixing.targets(table, mixing.cyclic_weights(table)).collect()}
    want = shares(sizes, weights)
    assert got.keys() == want.keys()
    for s in got:
        assert got[s] == pytest.approx(want[s], abs=1e-6)


def make(documents):
    chance = random.Random(5)
    rows = [(i, " ".join("w" * chance.randint(1, 3) for _ in range(chance.choice([0, 1, 3, 40, 300]))),
             None, chance.choice(["a", "a", "a", "b", "c", None]), 0) for i in range(300)]
    return documents(rows + [(None, "no id", None, "b", 0), (7, None, None, "b", 0)], clash=True), rows


def test_schedule_pieces(documents):
    df, _ = make(documents)
    sized = mixing.sized_documents(df)
    laid, table = mixing.prepare(sized)
    pieces = mixing.mix(laid, table, block_words=16).toPandas()
    target = {r.source_no: r for r in table.collect()}
    for no, part in pieces.groupby("source_no"):
        assert part.n_words.sum() == int(target[no].target)
        assert sorted(part["rank"].unique()) == list(range(part["rank"].max() + 1))
        assert part.groupby("rank").n_words.sum().max() <= 16
    # every stretch of the schedule is mixed like the whole
    slots = pieces.drop_duplicates("slot").sort_values("slot")
    counts = slots.source_no.value_counts()
    for upto in (len(slots) // 4, len(slots) // 2):
        seen = slots.source_no[:upto].value_counts()
        for no in counts.index:
            assert abs(seen.get(no, 0) - upto * counts[no] / len(slots)) <= 12


def test_taken_words(documents):
    df, rows = make(documents)
    got = mixing.mixture(df, block_words=16).collect()
    assert len(got) == df.count()
    by = defaultdict(list)
    for r in got:
        assert 0 <= r.taken <= 3 * r.size
        by[r.source].append(r)
    for part in by.values():
        assert sum(r.size for r in part) == part[0].source_size
        assert sum(r.taken for r in part) == int(part[0].target)
    again = mixing.mixture(df.repartition(7), block_words=64)
    cols = ["doc_id", "source", "size", "taken"]
    assert sorted(map(repr, again.select(cols).collect())) == sorted(repr(r) for r in df.sparkSession.createDataFrame(
        [(r.doc_id, r.source, r.size, r.taken) for r in got], "doc_id long, source string, size long, taken long").collect())


def test_small_chunks_change_nothing(documents):
    df, _ = make(documents)
    sized = mixing.sized_documents(df)
    _, table = mixing.prepare(sized)
    known = mixing.with_source(sized, table, ["source_no", "source_size", "target"])
    one = mixing.lay_out(known, 302, chunk_rows=10_000).groupBy("doc_id", "source_no", "size", "start").count()
    two = mixing.lay_out(known, 302, chunk_rows=4).groupBy("doc_id", "source_no", "size", "start").count()
    assert one.exceptAll(two).count() == 0 and two.exceptAll(one).count() == 0


def test_empty_and_wordless(documents, odd):
    assert mixing.mixture(documents([])).count() == 0
    assert mixing.mixture(documents([(1, None), (2, "")])).agg(F.sum("taken")).first()[0] == 0
    assert mixing.repeated_documents(documents([])).count() == 0
    df = documents(odd, clash=True)
    kept = mixing.repeated_documents(df)
    assert kept.columns == df.columns and kept.where("text IS NULL").count() == 0
