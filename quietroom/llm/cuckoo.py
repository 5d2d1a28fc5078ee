"""Cuckoo filters as arrays: four slots a bucket, 16-bit fingerprints, none of them zero.

A key is a pair of unsigned 64-bit hashes.  The low bits of the first choose its bucket, bits of
the second make its fingerprint, and the fingerprint alone leads from either of its two buckets
to the other, so that entries can be moved, and taken out again, without their keys.
"""

from __future__ import annotations

import numpy as np

SLOTS = 4
LOAD = 0.85
ROUNDS = 500


def fingerprints(h2: np.ndarray) -> np.ndarray:
    return ((h2 >> np.uint64(13)) % np.uint64(65535) + np.uint64(1)).astype(np.uint16)


def _other(bucket: np.ndarray, fp: np.ndarray, mask) -> np.ndarray:
    """The second bucket of an entry, from either one."""
    step = (fp.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20)
    return ((bucket.astype(np.uint64) ^ step) & np.asarray(mask, np.uint64)).astype(np.int64)


def new_table(keys: int) -> np.ndarray:
    """An empty table with room for ``keys`` entries."""
    buckets = 1
    while buckets * SLOTS * LOAD < keys:
        buckets *= 2
    return np.zeros((buckets, SLOTS), np.uint16)


def _home(table: np.ndarray, h1: np.ndarray) -> np.ndarray:
    return (h1 & np.uint64(len(table) - 1)).astype(np.int64)


def _put(table: np.ndarray, bucket: np.ndarray, fp: np.ndarray) -> np.ndarray:
    """Fill free slots; True for the entries that found one."""
    order = np.argsort(bucket, kind="stable")
    b = bucket[order]
    head = np.r_[True, b[1:] != b[:-1]] if len(b) else np.zeros(0, bool)
    rank = np.arange(len(b)) - np.maximum.accumulate(np.where(head, np.arange(len(b)), 0)) if len(b) else b
    free = table[b] == 0
    fits = rank < free.sum(1)
    slot = np.argmax(np.cumsum(free, axis=1) == (rank + 1)[:, None], axis=1)
    table[b[fits], slot[fits]] = fp[order][fits]
    done = np.zeros(len(b), bool)
    done[order[fits]] = True
    return done


def insert(table: np.ndarray, h1: np.ndarray, h2: np.ndarray, seed: int = 0) -> bool:
    """Insert keys, all at a time; False when the table is too full and has to be made anew."""
    dice = np.random.default_rng(seed)
    fp, bucket = fingerprints(h2), _home(table, h1)
    for attempt in range(ROUNDS):
        stay = ~_put(table, bucket, fp)
        if not stay.any():
            return True
        fp, bucket = fp[stay], bucket[stay]
        if attempt:
            # from the second try on, one entry of each full bucket changes places with a newcomer
            _, one = np.unique(bucket, return_index=True)
            slot = dice.integers(0, SLOTS, len(one))
            out = table[bucket[one], slot]
            table[bucket[one], slot] = fp[one]
            fp[one] = out
        bucket = _other(bucket, fp, len(table) - 1)
    return False


def delete(table: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> None:
    """Take out keys that were inserted before, one entry each."""
    for bucket, fp in zip(_home(table, h1), fingerprints(h2)):
        for b in (bucket, int(_other(np.array([bucket]), np.array([fp]), len(table) - 1)[0])):
            at = np.flatnonzero(table[b] == fp)
            if len(at):
                table[b, at[0]] = 0
                break
        else:
            raise ValueError("a key to be deleted is not in the filter")


def contains(flat: np.ndarray, first: np.ndarray, mask: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """Which keys may be inside, each looked up in a table of its own.

    ``flat`` holds the tables one after the other; ``first`` and ``mask`` give, per key, the
    number of its table's first bucket and the table's size less one.
    """
    fp = fingerprints(h2)
    b = (h1 & mask.astype(np.uint64)).astype(np.int64)
    hit = (flat[first + b] == fp[:, None]).any(1)
    miss = np.flatnonzero(~hit)
    hit[miss] = (flat[first[miss] + _other(b[miss], fp[miss], mask[miss])] == fp[miss, None]).any(1)
    return hit
