import hashlib
import random
from collections import Counter, defaultdict

import corpus_pipeline
from quietroom.llm import mixing, pieces

from .test_mixing import shares, words
from .test_shingles import brute as groups_by_all_pairs


def mixed(rows):
    """(doc_id, text, lang, source) as often as the mix takes them, by its closed form."""
    by = defaultdict(list)
    for r in rows:
        at = int(hashlib.md5(f"{mixing.SEED}:{r[0]}".encode()).hexdigest()[:15], 16)
        by[r[3]].append((at, r))
    sizes = {s: sum(words(r[1]) for _, r in part) for s, part in by.items()}
    order = sorted(by, key=lambda s: (s is None, s or ""))
    target = shares(sizes, {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)})
    out = []
    for s, part in by.items():
        start = 0
        for _, r in sorted(part, key=lambda x: x[0]):
            size = words(r[1])
            if size:
                rounds, rest = divmod(int(target[s] + 1e-9), sizes[s])
                taken = rounds * size + max(0, min(size, rest - start))
                out += [r] * int(taken / size + 0.5)
            start += size
    return out


def test_whole_pipeline_against_brute_force(spark, documents, tmp_path):
    chance = random.Random(9)
    english, french = "the and of thing with ing other".split(), "le est que avec dans une pour".split()
    rows = []
    for i in range(70):
        lang = chance.choice(["en", "fr"])
        text = " ".join(chance.choice(english if lang == "en" else french) + chance.choice(["", "s", "er", "e"])
                        for _ in range(chance.randint(20, 90)))
        rows.append((i, text, lang, chance.choice(["a", "a", "b", None]), 0))
    rows += [(100 + i, r[1].replace(" ", "  ", 3), r[2], r[3], 0) for i, r in enumerate(rows[:12])]
    rows += [(200 + i, r[1] + " tail", r[2], r[3], 0) for i, r in enumerate(rows[20:40])]
    rows += [(300, None, "en", "a", 0), (301, " 12 !! ", "en", "a", 0), (302, "", None, "b", 0)]
    documents(rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()

    kept = [r[:4] for r in rows if r[1] and any(c.isalpha() for c in r[1])]
    first = {}
    for r in sorted(kept):
        first.setdefault(" ".join(r[1].split()), r)
    kept = list(first.values())
    near = groups_by_all_pairs([(r[0], r[1]) for r in kept], 5, 80)
    kept = [r for r in kept if any(i == r[0] == c for i, _, c in near)]
    assert len(kept) < len(first) < len(rows)
    voc = pieces.read_vocabulary()
    want = Counter((r[0], r[3], r[2], tuple(voc.encode(r[1], 1)[0][1].tolist())) for r in mixed(kept))
    assert Counter((r.doc_id, r.source, r.lang, tuple(r.piece_ids)) for r in got) == want
    assert all(r.n_pieces == len(r.piece_ids) for r in got)


def test_last_stage_gives_n_best_scores_and_round_trip(spark, documents):
    texts = ["the cat sat", " thereof", "a  b", ""]
    got = corpus_pipeline.encode(spark, documents(list(enumerate(texts))), "").collect()
    voc = pieces.read_vocabulary()
    for r in got:
        found = voc.encode(texts[r.doc_id], pieces.N_BEST)
        assert r.scores == [s / pieces.UNIT for s, _ in found] and r.score == r.scores[0]
        assert r.piece_ids == found[0][1].tolist() and r.n_pieces == len(r.piece_ids)
        assert r.round_trip and voc.decode(r.piece_ids) == texts[r.doc_id]
    assert max(len(r.scores) for r in got) == pieces.N_BEST


def test_stages_return_documents(spark, documents, odd):
    df = documents(odd)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, df, "").columns == df.columns, name
    assert corpus_pipeline.ORACLE_SQL is None
