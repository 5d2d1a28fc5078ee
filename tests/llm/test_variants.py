import random
import re
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quietroom.llm import variants


def is_near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute(rows, min_chars, min_count, factor):
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= min_chars and c >= min_count}
    near = {w: [x for x in n if is_near(w, x)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= factor * n[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return sorted((w, form[w] or "", root(w), n[w], len(near[w]), n.get(form[w]) or -1) for w in n)


def found(df, **more):
    return sorted((r.word, r.form or "", r.root, r.n, r.n_near, -1 if r.form_n is None else r.form_n)
                  for r in variants.spelling_groups(df, **more).collect())


def rows_of(seed, docs):
    dice = random.Random(seed)
    base = ["aabbaa", "banana", "aaaaaa", "Éclair", "straße", "mississippi", "x" * 70, "xy" * 40]
    words = list(base)
    for _ in range(3):
        for w in list(dice.sample(words, min(40, len(words)))):
            at, c = dice.randrange(len(w)), dice.choice("abé×x")
            words += [w[:at] + w[at + 1:], w[:at] + c + w[at:], w[:at] + c + w[at + 1:]]
    weights = [1 / (k + 1) ** 1.3 for k in range(len(words))]
    return [(i if i % 9 else None, " ".join(dice.choices(words, weights, k=60)) + dice.choice(["", "1bananas", "日本banana"]))
            for i in range(docs)]


@pytest.mark.parametrize("seed,more", [(1, dict(min_chars=6, min_count=5, factor=5)), (2, dict(min_chars=2, min_count=1, factor=2)),
                                       (3, dict(min_chars=5, min_count=1, factor=1000))])
def test_against_brute_force(documents, seed, more):
    rows = rows_of(seed, 120) + [(500, None), (501, ""), (7, "banana " * 9000), (7, "banana " * 9000)]
    assert found(documents(rows, clash=True), **more) == brute(rows, **more)


def test_chains_of_forms(documents):
    words = ["wordxx" + "abcdefgh"[:k] for k in range(7)]
    rows = [(k, " ".join([w] * 3 ** k)) for k, w in enumerate(words)]
    got = found(documents(rows), min_chars=3, min_count=1, factor=3)
    assert got == brute(rows, 3, 1, 3)
    assert {r[2] for r in got if r[0].startswith("wordxx")} <= {words[-1], *[brute(rows, 3, 1, 3)[0][2]]}


def test_very_long_words(documents):
    long = "".join(random.Random(5).choices("abc", k=3000))
    rows = [(k, w) for k, w in enumerate([long] * 8 + [long[:1500] + long[1501:], long[1:], long + "z", "q" + long[1:]])]
    got = found(documents(rows), min_chars=6, min_count=1, factor=5)
    assert got == brute(rows, 6, 1, 5) and max(r[4] for r in got) == 4


@settings(max_examples=200, deadline=None)
@given(st.text("abé", min_size=1, max_size=9), st.text("abé", min_size=1, max_size=9), st.sampled_from([1, 4, 6, 64]))
def test_near_words_share_exactly_one_group(a, b, text_keys):
    with pytest.MonkeyPatch.context() as m:
        m.setattr(variants, "TEXT_KEYS", text_keys)
        mine, theirs = variants.rotations(a), list(variants.rotations(b))
        kinds = [(x, y) for k, x in mine for o, y in theirs if k == o]
    whole, skips, first = variants._WHOLE, variants._SKIPS, variants._FIRST
    shared = [k for k in kinds if whole not in k or set(k) == {whole, first}]
    assert len([k for k in shared if a != b]) == (is_near(a, b) if a != b else 0)


def test_empty_table(documents):
    assert variants.spelling_groups(documents([])).count() == 0
