import random

import numpy as np
import pandas as pd
import pytest

from quietroom.llm import cuckoo, linededup


def key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))


def brute(texts, min_docs, min_chars=1, corpus=None):
    seen = {}
    for t in corpus if corpus is not None else texts:
        for k in {key(x) for x in (t or "").split("\n")}:
            seen[k] = seen.get(k, 0) + 1
    out = []
    for t in texts:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < min_chars or seen[key(x)] < min_docs]
        out.append((len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out)


def texts_of(seed, n):
    dice = random.Random(seed)
    lines = ["", " ", "Foo", "foo\t", "É", "é", "b c", "\x0b", "xy", "Ü" * 3] + [f"line {i}" for i in range(300)]
    return [None, ""] + ["\n".join(dice.choice(lines[:dice.choice([6, 10, 310])]) for _ in range(dice.randint(1, 12)))
                         for _ in range(n)]


def rows(df):
    return sorted((r.n_lines, r.n_dropped, r.text) for r in df.collect())


@pytest.mark.parametrize("min_docs,min_chars", [(1, 1), (3, 1), (10, 3)])
def test_against_brute_force(documents, min_docs, min_chars):
    texts = texts_of(1, 200) + ["many\n" * 20000, "same", "same", "same"]
    df = documents([(i % 50 or None, t) for i, t in enumerate(texts)], clash=True)
    assert rows(linededup.find_common(df, min_docs=min_docs, min_chars=min_chars)) == brute(texts, min_docs, min_chars)


def test_rounds_and_splits_give_the_same(documents, monkeypatch):
    monkeypatch.setattr(linededup, "KEYS_PER_SHARD", 20)
    monkeypatch.setattr(linededup, "_HELD", 10)
    texts = texts_of(2, 150)
    df = documents([(i, t) for i, t in enumerate(texts)])
    index = linededup.insert(linededup.empty_index(df.sparkSession, 3), df)
    assert index.bits > 3
    once = rows(linededup.drop_common(df, index).select("lines.*"))
    assert once == brute(texts, 3)
    assert rows(linededup.drop_common(df, index, round_bytes=60).select("lines.*")) == once


def test_insertion_and_deletion_are_reversible(documents, monkeypatch):
    monkeypatch.setattr(linededup, "KEYS_PER_SHARD", 100)
    spark = documents([]).sparkSession
    parts = [texts_of(s, n) for s, n in ((3, 60), (4, 150), (5, 90))]
    a, b, c = (documents([(i, t) for i, t in enumerate(p)]) for p in parts)
    index = linededup.empty_index(spark, 4)
    states = []
    for df in (a, b, c):
        index = linededup.insert(index, df)
        states.append(index)
    back = linededup.remove(linededup.remove(index, a), c)
    assert rows(linededup.drop_common(b, back).select("lines.*")) == brute(parts[1], 4)
    assert rows(linededup.drop_common(b, states[1]).select("lines.*")) == brute(parts[1], 4, corpus=parts[0] + parts[1])
    fresh = linededup.insert(linededup.empty_index(spark, 4), b)
    same = lambda x: sorted(map(tuple, x.counts.collect()))
    assert same(back) == same(fresh)
    none = linededup.remove(back, b)
    assert none.counts.count() == 0
    # nothing is left in the filters either
    assert all(not np.frombuffer(r.entries, "<u2").any() and not r.spared for r in none.filters.collect())
    with pytest.raises(ValueError):
        linededup.remove(back, a)


def test_wrongly_passed_keys_are_spared(monkeypatch):
    # every key passes this filter, so only the list of spared keys tells common ones
    monkeypatch.setattr(cuckoo, "contains", lambda flat, first, mask, h1, h2: np.ones(len(h1), bool))
    h = np.random.default_rng(1).integers(-2 ** 63, 2 ** 63, (2, 100))
    after = np.arange(100) % 8
    keys = pd.DataFrame({"h1": h[0], "h2": h[1], "before": 0 * after, "after": after})
    entries, spared = linededup._shard_filter(keys, None, 5)
    tables = linededup._Tables([{"shard": 0, "entries": entries, "spared": spared}], 0)
    gone = after > 0  # keys no document has are not asked for
    assert tables.common(np.ascontiguousarray(h.T[gone]).tobytes()).tolist() == (after[gone] >= 5).tolist()


def test_all_columns_stay(documents, odd):
    df = documents(odd, clash=True).withColumnRenamed("size", "lines").withColumnRenamed("h", "state").withColumnRenamed("n", "c0")
    got = linededup.deduplicate(df, min_docs=2)
    assert got.columns == df.columns
    want = brute([r[1] for r in odd], 2)
    assert sorted(r.text for r in got.collect()) == sorted(t for _, _, t in want)


def test_empty_table(documents):
    df = documents([])
    assert linededup.find_common(df).count() == 0 and linededup.deduplicate(df).count() == 0


@pytest.mark.parametrize("n", [0, 1, 5, 3000])
def test_cuckoo_filter(n):
    dice = np.random.default_rng(n)
    h1, h2 = (dice.integers(0, 2 ** 64, n, dtype=np.uint64) for _ in range(2))
    table = cuckoo.new_table(n)
    assert cuckoo.insert(table, h1, h2) and (table != 0).sum() == n

    def found(a, b):
        zero = np.zeros(len(a), np.int64)
        return cuckoo.contains(table, zero, zero + len(table) - 1, a, b)

    assert found(h1, h2).all()
    other = [dice.integers(0, 2 ** 64, 20000, dtype=np.uint64) for _ in range(2)]
    assert found(*other).mean() < 0.001
    half = n // 2
    cuckoo.delete(table, h1[:half], h2[:half])
    assert found(h1[half:], h2[half:]).all() and (table != 0).sum() == n - half


def test_a_full_table_says_so():
    h = np.arange(40, dtype=np.uint64) * np.uint64(2 ** 20 + 1)
    assert not cuckoo.insert(cuckoo.new_table(4), h, h)
