import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quietroom.llm import tokencount


def owners(starts, ends, bounds, rule):
    """Section of each token, byte by byte."""
    out = []
    for a, b in zip(starts, ends):
        at = [sum(x <= i for x in bounds) for i in range(a, b)]
        out.append(at[0] if rule == "first" else max(sorted(set(at)), key=lambda s: (at.count(s), -s)))
    return out


@pytest.mark.parametrize("rule", ["majority", "first"])
def test_attribution_byte_by_byte(rule):
    chance = random.Random(4)
    for _ in range(200):
        ends = np.cumsum([chance.randint(1, 6) for _ in range(chance.randint(1, 12))])
        size = int(ends[-1])
        bounds = np.unique(sorted(chance.sample(range(1, size + 1), chance.randint(0, min(5, size)))) + [size])
        got, crossing = tokencount.attribute(ends, bounds, rule)
        starts = [0, *ends[:-1]]
        want = owners(starts, ends, bounds, rule)
        assert list(got) == [want.count(s) for s in range(len(bounds))]
        assert crossing == sum(any(a < x < b for x in bounds) for a, b in zip(starts, ends))


def test_documents(documents, odd):
    rows = odd + [(20, "one two\nthree   \n\n four\n" * 30), (21, "é\u2028ü\n日本語\n")]
    got = {r.doc_id: r for r in tokencount.count_tokens(documents(rows, clash=True)).collect()}
    coder, size = tokencount._coder(open(tokencount.RANKS, "rb").read())
    for i, text, *_ in rows:
        ids = coder.encode_ordinary(text or "")
        if i is None:
            continue
        assert got[i].n_tokens == len(ids) == sum(got[i].section_tokens)
        assert got[i].n_sections == len(re.findall(r"[^\n]*\n|[^\n]+", text or ""))


def test_given_sections(documents):
    df = documents([(1, "héllo world, again")])
    got = tokencount.count_tokens(df, ends=F.array(F.lit(5), F.lit(12), F.lit(99))).first()
    assert got.n_sections == 3 and sum(got.section_tokens) == got.n_tokens


def test_empty(documents):
    assert tokencount.count_tokens(documents([])).count() == 0
