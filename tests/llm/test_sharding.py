import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from quietroom.llm import sharding


def test_law_and_slots(documents, odd):
    rows = [(i, "copy " * 30 if i % 3 == 0 else f"text {i} " * (i % 17 + 1)) for i in range(900)]
    got = sharding.shard(documents(rows, clash=True), 16).collect()
    assert len(got) == 900 and {r.law for r in got} == {"bytes"} and {r.grown_shard for r in got} == {None}
    texts = dict(rows)
    bytes_, slots = Counter(), {}
    for r in got:
        assert r.size == len(texts[r.doc_id].encode()) + 1
        assert r.text_crc32 == zlib.crc32(texts[r.doc_id].encode())
        bytes_[r.shard] += r.size
        slots.setdefault(r.shard, []).append(r.slot)
    assert sorted(bytes_) == list(range(16))
    assert max(bytes_.values()) - min(bytes_.values()) <= 2 * max(r.size for r in got) + sum(bytes_.values()) / 16 / 32
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    shards_of = {}
    for r in got:
        shards_of.setdefault(texts[r.doc_id], set()).add(r.shard)
    assert len(shards_of["copy " * 30]) > 1  # a third of all rows is cut
    assert all(len(s) == 1 for t, s in shards_of.items() if t != "copy " * 30)


def test_odd_rows(documents, odd):
    got = sharding.shard(documents(odd, clash=True), 16).collect()
    assert len(got) == len(odd)
    null = [r for r in got if r.doc_id == 3]
    assert [(r.size, r.text_crc32) for r in null] == [(1, 0)]


def test_empty(documents):
    assert sharding.shard(documents([]), 16).count() == 0


def test_ranges_against_bisect():
    chance = np.random.default_rng(1)
    pairs = sorted({(int(a), int(b)) for a, b in chance.integers(0, 6, (12, 2))})
    k, h = chance.integers(0, 6, 500), chance.integers(0, 6, 500)
    got = sharding.range_of(k, h, np.array(pairs))
    assert list(got) == [sum(p <= (a, b) for p in pairs) for a, b in zip(k.tolist(), h.tolist())]


def test_overfull_ranges_are_cut(documents, monkeypatch):
    monkeypatch.setattr(sharding, "SAMPLE", 2)
    rows = sharding.staged(sharding.records(documents([(i, "same") for i in range(3000)])))
    _, counts = sharding.ranged(rows, 16)
    assert max(c for _, _, c in counts) <= 2 * 3000 / 64 + 1


def test_small_groups_that_splitters_cut_stay_whole(documents, monkeypatch):
    def cut_everywhere(rows, shards):
        by = {}
        for r in rows.select("k", "h").collect():
            by.setdefault(r.k, []).append(r.h)
        placed = sharding.staged(sharding._ranged(rows, sorted((k, sorted(hs)[2]) for k, hs in by.items())))
        return placed, sorted(tuple(r) for r in placed.groupBy("range").agg(F.sum("size"), F.count("k")).collect())

    monkeypatch.setattr(sharding, "ranged", cut_everywhere)
    got = sharding.shard(documents([(i, f"text {i % 302:03d}") for i in range(4 * 302)]), 4).collect()
    shards_of = {}
    for r in got:
        shards_of.setdefault(r.doc_id % 302, set()).add(r.shard)
    assert len(got) == 4 * 302 and len(shards_of) == 302
    assert all(len(s) == 1 for s in shards_of.values())
    slots = {s: sorted(r.slot for r in got if r.shard == s) for s in range(4)}
    assert all(x == list(range(len(x))) and 300 <= len(x) <= 304 for x in slots.values())
