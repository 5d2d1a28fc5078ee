import hashlib
import random
from collections import Counter, defaultdict

import pytest

from quietroom.llm import shingle_join
from quietroom.llm.components import components


def shingle_set(text, width):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not w:
        return frozenset()
    return frozenset(zip(*[w[i:] for i in range(width)])) if len(w) >= width else frozenset([tuple(w)])


def brute(rows, width, percent):
    """All pairs of documents."""
    sets = [shingle_set(t, width) for _, t in rows]
    root = list(range(len(rows)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                root[find(a)] = find(b)
    least = defaultdict(list)
    for a, (i, _) in enumerate(rows):
        if i is not None:
            least[find(a)].append(i)
    return Counter((i, len(sets[a]), i if not sets[a] else min(least[find(a)], default=None))
                   for a, (i, _) in enumerate(rows))


def corpus(seed, n=120):
    chance = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    common = " ".join(chance.choice(words) for _ in range(30))
    base = [[chance.choice(words) for _ in range(chance.randint(1, 60))] for _ in range(12)]
    rows = []
    for i in range(n):
        w = list(chance.choice(base))
        for _ in range(chance.choice([0, 0, 1, 1, 2, 6])):
            w[chance.randrange(len(w))] = chance.choice(words)
        rows.append((i + 1, " ".join(w + ([common] if chance.random() < 0.5 else []))))
    return rows


@pytest.mark.parametrize("seed,width,percent,heavy", [(2, 3, 90, 4), (3, 5, 80, 3)])
def test_against_all_pairs(documents, seed, width, percent, heavy):
    rows = corpus(seed)
    got = shingle_join.near_groups(documents(rows, clash=True), width, percent, heavy=heavy)
    assert Counter(tuple(r) for r in got.select("doc_id", "n_shingles", "component_id").collect()) == brute(rows, width, percent)


def test_odd_rows(documents, odd):
    rows = [(i, t) for i, t, *_ in odd] + [(5, "a b c d e f g h"), (50, "word"), (None, "WORD")]
    got = shingle_join.near_groups(documents(rows, clash=True), 3, 90)
    assert Counter(tuple(r) for r in got.select("doc_id", "n_shingles", "component_id").collect()) == brute(rows, 3, 90)


def test_one_of_each(documents, odd):
    df = documents(odd + [(60, "a b c d e f g")], clash=True)
    got = shingle_join.keep_one_each(df, 3, 90)
    assert got.columns == df.columns
    assert sorted(str(r.doc_id) for r in got.collect()) == sorted(
        ["1", "3", "4", "5", "6", "8", "9", "10", "11", "None", "None"])
    assert shingle_join.near_groups(documents([]), 3, 90).count() == 0


def test_one_id_on_different_texts(documents):
    near, clean, other = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(1, near), (9, near + " tail"), (9, clean), (9, ""), (9, clean), (4, other + " tail"), (4, other), (4, other + " end"),
            (20, "a word"), (20, "two more words"), (30, other.upper())]
    df = documents(rows, clash=True).repartition(3)
    got = shingle_join.keep_one_each(df, 3, 90)
    assert got.columns == df.columns
    one_of_4 = min((t for i, t in rows if i == 4), key=lambda t: hashlib.blake2b(
        shingle_join.shingles(t, 3).tobytes(), digest_size=16).digest())
    assert sorted((r.doc_id, r.text) for r in got.collect()) == [
        (1, near), (4, one_of_4), (9, ""), (9, clean), (20, "a word"), (20, "two more words")]


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(1, 20)] + [(7, 7), (300, 299), (299, 300)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{100 + i: 100 for i in range(20)}, 299: 299, 300: 299}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


@pytest.mark.parametrize("width,percent", [(3, 90), (5, 80)])
def test_near_copies_around_the_threshold(documents, width, percent, monkeypatch):
    """A large group whose members link or just miss each other, with sizes apart as well as alike;
    all pairs at once, as merging by pivots would leave few of them."""
    chance = random.Random(percent)
    base = [f"b{i}" for i in range(80)]
    rows = []
    for i in range(90):
        w = list(base)
        for _ in range(chance.choice([1, 2, 3, 4])):
            w[chance.randrange(len(w))] = f"x{chance.randrange(40)}"
        w = w[:len(w) - chance.choice([0, 0, 0, 2, 5, 9, 14])] + [f"t{i}"] * chance.choice([0, 0, 1])
        rows.append((i + 1, " ".join(w)))
    for rounds in (0, 4):
        monkeypatch.setattr(shingle_join, "STAR_ROUNDS", rounds)
        got = shingle_join.near_groups(documents(rows), width, percent, heavy=4)
        assert Counter(tuple(r) for r in got.select("doc_id", "n_shingles", "component_id").collect()) == brute(
            rows, width, percent)
