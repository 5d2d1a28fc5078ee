import hashlib
import re

import pytest
from pyspark.sql import functions as F

from quietroom.llm import exact_dedup


def brute(rows):
    norm = [re.sub("[ \t-\r]+", " ", t or "") for _, t in rows]
    out = []
    for (i, _), n in zip(rows, norm):
        ids = [j for (j, _), m in zip(rows, norm) if m == n]
        keep = min((j for j in ids if j is not None), default=None)
        out.append((i, keep, len(ids), i == keep, hashlib.sha256(n.encode()).hexdigest()))
    return sorted(map(repr, out))


@pytest.mark.parametrize("bits,capacity", [(64, 50_000), (64, 1), (3, 2), (1, 1)])
def test_all_cases_and_collisions(documents, odd, bits, capacity):
    got = exact_dedup.find_copies(documents(odd, clash=True), hash_bits=bits, capacity=capacity)
    rows = [tuple(r) for r in got.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()]
    assert sorted(map(repr, rows)) == brute([(r[0], r[1]) for r in odd])


def test_rows_that_stay(documents, odd):
    df = documents(odd, clash=True)
    got = exact_dedup.deduplicate(df)
    assert got.columns == df.columns
    assert sorted(str(r.doc_id) for r in got.collect()) == sorted(
        ["1", "3", "5", "6", "7", "8", "9", "10", "11", "None"])


def test_empty_table(documents):
    df = documents([])
    assert exact_dedup.find_copies(df).count() == 0 and exact_dedup.deduplicate(df).count() == 0


def test_directory_splits_until_buckets_fit(spark):
    keys = spark.range(2000).select(F.xxhash64("id").alias("h"))
    directory, depth = exact_dedup.build_directory(keys, 40)
    slots = directory.collect()
    assert sorted(r.slot for r in slots) == list(range(1 << depth))
    filled = (keys.withColumn("slot", F.shiftrightunsigned("h", 64 - depth)).join(directory, "slot")
              .groupBy("bucket").count().agg(F.max("count")).first()[0])
    assert filled <= 40
    for r in slots:  # slots of one bucket are neighbours that share the bucket's own bits
        assert r.slot >> (depth - r.depth) == r.bucket >> (depth - r.depth)


def test_the_directory_decides(documents, odd):
    """Rows are found through the directory alone: without a slot's line they are not found."""
    df = documents(odd)
    index = exact_dedup.build_index(df, capacity=1)
    assert index.directory.count() > 4
    lost = index.directory.orderBy("slot").first().slot
    index.directory = index.directory.where(f"slot <> {lost}")
    hashes = [r.h for r in index.rows.collect()]
    gone = [h for h in hashes if (h % 2 ** 64) >> (64 - index.depth) == lost]
    assert index.located(index.rows).count() == len(hashes) - len(gone)


def test_hot_texts_and_repeated_rows(documents):
    rows = [(7, "hot  text")] * 3000 + [(i, "hot text") for i in range(1500)] + [(i % 900, f"t {i % 900}") for i in range(1800)]
    got = exact_dedup.find_copies(documents(rows))
    assert sorted(map(repr, map(tuple, got.select(
        "doc_id", "keep_id", "group_size", "kept", "text_sha256").distinct().collect()))) == sorted(set(brute_grouped(rows)))
    assert got.count() == len(rows) and exact_dedup.deduplicate(documents(rows)).count() == 901


def brute_grouped(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub("[ \t-\r]+", " ", t), []).append(i)
    return [repr((i, min(ids), len(ids), i == min(ids), hashlib.sha256(n.encode()).hexdigest()))
            for n, ids in groups.items() for i in ids]
