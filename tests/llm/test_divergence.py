import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quietroom.llm import divergence


def brute(rows, min_docs, top):
    docs = [(lang or "", source or "", [
        "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
        for t in re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", text or "")]) for _, text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        kept = sorted({t for d in mine for t in d[2] if sum(t in e[2] for e in mine) >= min_docs})
        groups = sorted({d[1] for d in mine})

        def prices(chosen):
            n = [sum(d[2].count(t) for d in chosen) for t in kept]
            return n, [1 + 1_000_000_000 * (c + 5) // (sum(n) + 5 * len(kept)) for c in n]

        own = {g: prices([d for d in mine if d[1] == g]) for g in groups}
        _, all_of = prices(mine)
        for g in groups:
            part = {"pair": [(sum(abs(a - b) for a, b in zip(own[g][1], own[o][1])), o) for o in groups if o != g],
                    "term": [(p - q, t) for t, n, p, q in zip(kept, *own[g], all_of) if n > 0 and p > q]}
            for name, items in part.items():
                items = sorted(items, key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, g, name, i, v, r + 1) for r, (v, i) in enumerate(items) if name == "pair" or r < top]
    return sorted(out)


def rows_of(seed, n):
    dice = random.Random(seed)
    words = ["a", "The", "the", "É", "é", "x1y", "日本", "naïve", "_", "'s", "zz", "\U0001f600"] + [f"w{chr(97 + i)}" for i in range(26)]
    return [(i, dice.choice([None, "", " ".join(dice.choices(words, k=dice.randint(1, 40)))] * 1 + [
        " ".join(dice.choices(words[:dice.choice([5, 12, 38])], k=30))] * 5),
        dice.choice(["en", "de", None, ""]), dice.choice(["s1", "s2", "S3", "", None, "é"])) for i in range(n)]


def found(df, **more):
    return sorted(map(tuple, divergence.audit(df, **more).collect()))


@pytest.mark.parametrize("min_docs,top", [(1, 3), (8, 50), (1000, 50)])
def test_against_brute_force(documents, monkeypatch, min_docs, top):
    rows = rows_of(min_docs, 120) + [(500, "only here", "xx", "alone"), (501, "the " * 30000, "en", "s1"), (501, "the " * 30000, "en", "s1")]
    assert found(documents(rows, clash=True), min_docs=min_docs, top_terms=top) == brute(rows, min_docs, top)


def test_small_blocks_give_the_same(documents):
    rows = rows_of(7, 100)
    df = documents(rows)
    counts = divergence.count_terms(df.fillna("").select("lang", "source", "text")).groupBy("lang", "source", "term").agg(
        {"n": "sum", "n_docs": "sum"}).toDF("lang", "source", "term", "n", "n_docs")
    groups, entries = divergence.group_prices(counts, 2)
    one, many = (sorted(map(tuple, divergence.pair_values(groups, entries, block=b).collect())) for b in (10_000, 3))
    assert one == many and len(one) == len({r[:3] for r in one}) > 0


def test_empty_table(documents):
    assert divergence.audit(documents([])).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.sets(st.integers(0, 3000), max_size=900), st.sets(st.integers(0, 3000), max_size=40), st.integers(1, 9))
def test_galloping_intersection(a, b, times):
    a, b = (np.array(sorted(x), np.int64) for x in (a, {y * times % 3001 for y in b}))
    for x, y in ((a, b), (b, a)):
        i, j = divergence.intersect(x, y)
        assert x[i].tolist() == y[j].tolist() == sorted(set(a.tolist()) & set(b.tolist()))


@settings(max_examples=300, deadline=None)
@given(st.integers(0, 10 ** 14 - 10), st.integers(0, 10 ** 13), st.integers(1, 10 ** 8))
def test_prices_are_exact(count, more, terms):
    total = min(count + more, 10 ** 14 - 5 * terms)
    count = min(count, total)
    assert int(divergence.price(np.array([count]), total, terms)[0]) == 1 + 10 ** 9 * (count + 5) // (total + 5 * terms)


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(0, 30), st.integers(1, 9)), st.dictionaries(st.integers(0, 30), st.integers(1, 9)))
def test_one_block(a, b):
    sides = [(np.array(sorted(x), np.int64), np.array([x[k] for k in sorted(x)], np.int64)) for x in (a, b)]
    n, m = sum(a.values()), sum(b.values())
    p = lambda x, k, total: 1 + 10 ** 9 * (x.get(k, 0) + 5) // (total + 5 * 31)
    keys = set(a) | set(b)
    assert divergence.merge_block(*sides, n, m, 31) == (sum(abs(p(a, k, n) - p(b, k, m)) for k in keys), len(keys))


def test_long_texts_are_cut_between_terms(monkeypatch):
    monkeypatch.setattr(divergence, "_PIECE", 5)
    for text in (b"", b"abc", b"abcdefghij klm", "ééééééé é".encode(), b"......... a"):
        assert b"".join(divergence.pieces(text)) == text
        assert [t for p in divergence.pieces(text) for t in divergence._TERM.findall(p)] == divergence._TERM.findall(text)
