"""Many banned phrases against many texts, through an inverted index on grams.

A phrase that is inside a text shares all its grams (runs of a fixed number of bytes of its UTF-8
form) with it.  Each phrase is filed under the one of its grams that the fewest phrases of its scope have.
Grams have ``SIZE`` bytes, as longer ones are met by chance less often; a phrase of no more bytes is filed
under itself.  The grams of many texts, worked out for all their places at
once, meet the index by equality, and the phrases found there are compared with the text around the gram,
eight bytes at a time.  So a text costs its length and its candidates, however many phrases there are, and
nothing is done text by text.

The index is broadcast, in parts of a checked number of phrases, a few of which the texts go through at
once: longer lists take several rounds.  Texts stay where they are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import GLOBAL
from ..functions.phrases import phrase_forms
from ..sources.shipping import ship
from ..sources.storage import staged

SIZE = 8
PARTS = 4  # that texts go through at once; a worker holds them, at about 110 bytes a phrase
OFTEN = 64  # a gram that a text has more often than this is not followed place by place
FEW = 4  # unless no more needles than this are filed under it
PLACES = 1 << 18  # looked at together
PAIRS = 1 << 20  # of a place and a needle, compared together
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)  # the first k bytes of a word
_MIX = [np.uint64(x) for x in (0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93, 0x9E3779B97F4A7C15, 0xFF51AFD7ED558CCD)]


def needles(keywords: DataFrame) -> DataFrame:
    """``(scope, phrase, needle)``: each spelling of each phrase, without spaces, once."""
    rows = keywords.select(F.col("chat_id").alias("scope"), "phrase").filter("scope IS NOT NULL").distinct()
    forms = rows.withColumn("_f", phrase_forms("phrase")).filter("_f.keep <> ''")
    return forms.select("scope", "phrase", F.explode(F.array_distinct(F.array(
        "_f.keep_squeezed", "_f.plain_squeezed"))).alias("needle")).filter("needle <> ''")


def _words(raw: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as a number; there are zeros behind the end."""
    padded = np.zeros(len(raw) + 8, np.uint8)
    padded[:-8] = raw
    return np.ndarray(len(raw), "<u8", padded, strides=(1,)).astype(np.uint64)


def grams(text: bytes, size: int) -> np.ndarray:
    """The gram at each place of a text, as a number."""
    return _words(np.frombuffer(text, np.uint8))[:max(len(text) - size + 1, 0)] & _MASKS[size]


def _strings(values) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of an Arrow array of strings, and where each begins and ends; a null is empty."""
    values = pc.fill_null(values.cast(pa.large_binary()), b"")
    _, offsets, letters = values.buffers()
    at = np.frombuffer(offsets, np.int64)[values.offset:values.offset + len(values) + 1] if len(values) else np.zeros(1, np.int64)
    raw = np.frombuffer(letters, np.uint8) if letters is not None else np.zeros(0, np.uint8)
    return raw[at[0]:at[-1]], at[:-1] - at[0], at[1:] - at[0]


def _ranges(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of ``counts``: its number as often, and 0, 1, ... up to it."""
    which = np.repeat(np.arange(len(counts)), counts)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts, counts)


def _mixed(gram: np.ndarray, size) -> np.ndarray:
    """A number for a gram of a size."""
    key = (gram ^ (np.asarray(size).astype(np.uint64).reshape(-1) * _MIX[0])) * _MIX[1]
    return key ^ (key >> np.uint64(32))


def _scoped(key: np.ndarray, scope) -> np.ndarray:
    """A number for a mixed gram in a scope; two may agree by chance, as candidates are checked."""
    return (key ^ (np.asarray(scope, np.int64).astype(np.uint64) * _MIX[2])) * _MIX[3]


def _some_bits(number: np.ndarray, places: int) -> np.ndarray:
    """One of a power of two of places for each number."""
    return (number & np.uint64(places - 1)).view(np.int64)


ROW = pa.schema([("scope", pa.int64()), ("phrase", pa.string()), ("needle", pa.string())])
KEY = np.dtype([("key", "<u8"), ("first", "<i4"), ("many", "<i4")])
ENTRY = np.dtype([("lead", "<i4"), ("length", "<i4"), ("word", "<u8")])


@dataclass
class IndexPart:
    """``table`` holds the keys, each at or behind the place that its leading ``bits`` name, with its
    ``many`` entries from ``first`` on.

    An entry has a scope, a phrase (its place among all ``phrases``, sorted) and a needle: its length, its
    first word, and where in it the gram is (``lead``).  All its words, which are its bytes by eight, the
    last eight overlapping those before, are in ``words``.
    """

    table: np.ndarray
    bits: int
    entries: np.ndarray
    scopes: np.ndarray
    phrase: np.ndarray
    words: np.ndarray
    words_at: np.ndarray

    @classmethod
    def of(cls, table: pa.Table, phrases: pa.Array) -> tuple[IndexPart, np.ndarray, np.ndarray, np.ndarray]:
        """The index of a table ``(scope, phrase, needle)``, whose phrases are all in ``phrases``; the sizes of
        its grams, these mixed, and the keys."""
        phrase = pc.index_in(table["phrase"].combine_chunks(), phrases).to_numpy()
        scopes = table["scope"].combine_chunks().to_numpy()
        letters, begin, end = _strings(table["needle"].combine_chunks())
        length = end - begin

        # the gram of each needle that the fewest of its scope have, the first of these
        size = np.minimum(length, SIZE)
        which, place = _ranges(length - size + 1)
        here = _words(letters)
        gram = _mixed(here[begin[which] + place] & _MASKS[size[which]], size[which])
        _, kind, often = np.unique(_scoped(gram, scopes[which]), return_inverse=True, return_counts=True)
        first = np.cumsum(length - size + 1) - (length - size + 1)
        lead = (np.minimum.reduceat(often[kind] << 32 | place, first) & 0xFFFFFFFF) if len(first) else first
        gram = gram[first + lead]
        key = _scoped(gram, scopes)
        order = np.argsort(key, kind="stable")

        keys, first, many = np.unique(key[order], return_index=True, return_counts=True)
        bits = 1 + len(keys).bit_length()
        at = np.arange(len(keys))
        at += np.maximum.accumulate((keys >> np.uint64(64 - bits)).astype(np.int64) - at)
        filled = np.zeros(max(1 << bits, at[-1] + 1 if len(at) else 0) + 1, KEY)  # the last stays empty
        filled["key"][at], filled["first"][at], filled["many"][at] = keys, first, many

        length, begin = length[order], begin[order]
        blocks = (length + 7) // 8
        which, block = _ranges(blocks)
        at = np.minimum(block * 8, np.maximum(length[which] - 8, 0))
        words = here[begin[which] + at] & _MASKS[np.minimum(length, 8)[which]]
        words_at = np.cumsum(blocks) - blocks
        entries = np.empty(len(order), ENTRY)
        entries["lead"], entries["length"], entries["word"] = lead[order], length, words[words_at]
        return cls(filled, bits, entries, scopes[order], phrase[order], words, words_at), np.unique(size), gram, keys

    def find(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which numbers are keys, and the first and the number of the entries of each."""
        at = (wanted >> np.uint64(64 - self.bits)).view(np.int64)
        todo, which, rows = np.arange(len(wanted)), [np.zeros(0, np.int64)], [np.zeros(0, KEY)]
        while len(todo):
            row = self.table.take(at)
            key = row["key"]
            same = np.flatnonzero(key == wanted)
            which.append(todo.take(same))
            rows.append(row.take(same))
            on = np.flatnonzero((key < wanted) & (row["many"] > 0))
            todo, at, wanted = todo.take(on), at.take(on) + 1, wanted.take(on)
        rows = np.concatenate(rows)
        return np.concatenate(which), rows["first"].astype(np.int64), rows["many"].astype(np.int64)

    def around(self, here: np.ndarray, begin: np.ndarray, end: np.ndarray, place, text, scope, first, many
               ) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The texts, and the phrases in them, of entries that are around the places where their keys were found."""
        if np.count_nonzero(many > FEW) > OFTEN:
            # a gram again and again in one text: each needle is searched for instead, between its first and last place
            long = np.flatnonzero(many > FEW)
            _, kind, times = np.unique(text[long] * len(self.entries) + first[long], return_inverse=True, return_counts=True)
            rest = np.ones(len(first), bool)
            for k in np.flatnonzero(times > OFTEN):
                mine = long[kind == k]
                rest[mine] = False
                t, low, high = text[mine[0]], place[mine].min(), place[mine].max()
                for i in range(first[mine[0]], first[mine[0]] + many[mine[0]]):
                    lead, length, _ = self.entries[i].tolist()
                    part = (here[max(begin[t], low - lead):min(end[t], high - lead + length)] & _MASKS[1]).astype(np.uint8)
                    if self.scopes[i] == scope[mine[0]] and self.needle(i) in part.tobytes():
                        yield text[mine[:1]], self.phrase[i:i + 1]
            place, text, scope, first, many = place[rest], text[rest], scope[rest], first[rest], many[rest]
        upto, at = np.cumsum(many), 0
        while at < len(many):
            to = max(at + 1, int(np.searchsorted(upto, upto[at] - many[at] + PAIRS, "right")))
            which, nth = _ranges(many[at:to])
            which += at
            number = first.take(which) + nth
            entry = self.entries.take(number)
            start, t, length = place.take(which) - entry["lead"], text.take(which), entry["length"].astype(np.int64)
            alike = (start >= begin.take(t)) & (start + length <= end.take(t)) & (self.scopes.take(number) == scope.take(which))
            alike &= here.take(start, mode="clip") & _MASKS.take(length, mode="clip") == entry["word"]
            block = 0
            while True:
                alike = np.flatnonzero(alike)
                number, start, t, length = (x.take(alike) for x in (number, start, t, length))
                block += 1
                done = length <= 8 * block
                yield t[done], self.phrase.take(number[done])
                if done.all():
                    break
                number, start, t, length = (x[~done] for x in (number, start, t, length))
                alike = here[start + np.minimum(8 * block, length - 8)] == self.words[self.words_at[number] + block]
            at = to

    def needle(self, i: int) -> bytes:
        *before, last = self.words[self.words_at[i]:][:(self.entries["length"][i] + 7) // 8].astype("<u8")
        rest = self.entries["length"][i] - 8 * len(before)
        return b"".join(w.tobytes() for w in before) + (last.tobytes()[-rest:] if before else last.tobytes()[:rest])


@dataclass
class PhraseIndex:
    """The sorted ``phrases`` and the parts that they are filed in.  ``low`` tells by some bits of a gram
    whether it can be in any part, ``near`` by some of a key in which ones."""

    phrases: pa.Array
    sizes: list[int]
    low: np.ndarray
    near: np.ndarray
    parts: list

    @classmethod
    def of(cls, rows: list) -> PhraseIndex:
        """The index of rows ``(scope, phrase, needle)``, in one part."""
        return cls.of_tables([pa.table([[r[i] for r in rows] for i in range(3)], ROW)])

    @classmethod
    def of_tables(cls, tables: list[pa.Table], kept: Callable = lambda part: part) -> PhraseIndex:
        """The index of tables ``(scope, phrase, needle)``, in a part each, of which it has what ``kept`` makes."""
        tables = [t.cast(ROW) for t in tables]
        phrases = pc.unique(pa.concat_tables(tables)["phrase"])
        phrases = phrases.take(pc.sort_indices(phrases))
        places = 1 << max(10, (4 * sum(map(len, tables))).bit_length())
        out = cls(phrases, [], np.zeros(places, bool), np.zeros(places, np.uint8), [])
        for k, table in enumerate(tables):
            part, sizes, gram, keys = IndexPart.of(table, phrases)
            out.sizes = sorted({*out.sizes, *sizes.tolist()})
            out.low[_some_bits(gram, places)] = True
            out.near[_some_bits(keys, places)] |= np.uint8(1 << k)
            out.parts.append(kept(part))
        return out

    def hits(self, text: bytes, chat: int | None) -> list[str]:
        """Phrases of the chat, and of all chats, inside a text without spaces."""
        return next(self.answers(pa.array([bytes(text)], pa.binary()), pa.array([chat], pa.int64())))[0].as_py()

    def answers(self, texts: pa.Array, chats: pa.Array) -> Iterator[pa.Array]:
        """For some texts after the others: the sorted phrases of its chat, and of all chats, inside each."""
        letters, begin, end = _strings(texts)
        chats = pc.fill_null(chats.cast(pa.int64()), GLOBAL).to_numpy()
        at = 0
        while at < len(begin):
            to = max(at + 1, int(np.searchsorted(end, begin[at] + PLACES, "right")))
            found = self._inside(letters[begin[at]:end[to - 1]], begin[at:to] - begin[at], end[at:to] - begin[at], chats[at:to])
            text, phrase = np.divmod(found, max(len(self.phrases), 1))
            offsets = np.searchsorted(text, np.arange(to - at + 1)).astype(np.int32)
            yield pa.ListArray.from_arrays(pa.array(offsets), self.phrases.take(pa.array(phrase)))
            at = to

    def _inside(self, letters: np.ndarray, begin: np.ndarray, end: np.ndarray, chats: np.ndarray) -> np.ndarray:
        """What is inside of texts that lie behind each other, as sorted numbers: the text's number
        times the number of phrases, and the phrase's."""
        here, out = _words(letters), [np.zeros(0, np.int64)]
        text_of = np.repeat(np.arange(len(begin)), end - begin)
        for start in range(0, len(letters), PLACES):
            found = [[(np.zeros(0, np.int64),) * 5] for _ in self.parts]
            for size in self.sizes:
                gram = _mixed(here[start:start + PLACES] & _MASKS[size], size)
                place = np.flatnonzero(self.low.take(_some_bits(gram, len(self.low))))
                gram, place = gram.take(place), place + start
                text = text_of.take(place)
                chat = chats.take(text)
                own = np.flatnonzero(chat != GLOBAL)
                for scope, at, t, g in ((chat.take(own), place.take(own), text.take(own), gram.take(own)),
                                        (np.broadcast_to(np.int64(GLOBAL), len(text)), place, text, gram)):
                    key = _scoped(g, scope)
                    near = self.near.take(_some_bits(key, len(self.near)))
                    maybe = np.flatnonzero(near)
                    key, near = key.take(maybe), near.take(maybe)
                    for k, part in enumerate(self.parts):
                        there = np.flatnonzero(near & np.uint8(1 << k))
                        which, first, many = part.find(key.take(there))
                        there = maybe.take(there.take(which))
                        found[k].append((at.take(there), t.take(there), scope.take(there), first, many))
            for part, mine in zip(self.parts, found):
                out += [t * len(self.phrases) + phrase for t, phrase in
                        part.around(here, begin, end, *map(np.concatenate, zip(*mine)))]
        every = np.sort(np.concatenate(out))
        return every[np.flatnonzero(np.diff(every, prepend=-1))]


def _looked_up(index, parts: list):
    @F.arrow_udf("array<string>")
    def hits(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        whole = replace(index.value, parts=[p.value for p in parts])
        for texts, chats in batches:
            yield from whole.answers(texts, chats)

    return hits.asNondeterministic()  # else a filter on what it finds would have it run twice


def with_indexed_hits(msgs: DataFrame, keywords: DataFrame, squeezed: Column, out: str,
                      phrases_per_part: int) -> DataFrame:
    """Add ``out``: the sorted phrases of the message's chat, and of all chats, inside ``squeezed``
    (canonical text without spaces; null where nothing is to be looked for)."""
    spark = msgs.sparkSession
    ship(spark)
    listed = staged(needles(keywords))
    count, parts = listed.count(), 1
    part = lambda: F.pmod(F.xxhash64("scope", "phrase"), F.lit(parts))
    while count > phrases_per_part * parts:
        parts += -(-(count - phrases_per_part * parts) // phrases_per_part)
        count = parts * listed.groupBy(part()).count().agg(F.max("count")).first()[0]  # as if all were as large
    columns = msgs.columns
    done = msgs.withColumn("_squeezed", squeezed)
    for i in range(0, parts, PARTS):
        tables = [listed.filter(part() == k).toArrow() for k in range(i, min(i + PARTS, parts))]
        index = PhraseIndex.of_tables(tables, spark.sparkContext.broadcast)
        index, filed = replace(index, parts=[]), index.parts
        found = _looked_up(spark.sparkContext.broadcast(index), filed)("_squeezed", "chat_id")
        if i:
            done = done.withColumn("_more", found).withColumn(out, F.sort_array(F.array_union(out, "_more"))).drop("_more")
        else:
            done = done.withColumn(out, found)
        if i + PARTS < parts:
            done = staged(done)
    return done.select(*columns, out)
