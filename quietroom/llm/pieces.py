"""SentencePiece encoding and decoding with the N best segmentations.

The pieces of a vocabulary that match inside a text span a lattice.  Forward Viterbi gives
every place of the text the score of its best prefix.  A backward A* search from the end uses
these scores as heuristics; since they are exact, paths leave its queue in order of their total
score, and the first N are the N best.

Where every piece of a vocabulary is blanks, then other signs, then letters (any part may be
missing), no piece reaches from a letter to a sign or blank, or over a line feed.  A text then
falls apart into units of that form, which are segmented alone.  Forward and backward Viterbi scores of a unit tell what its next best
segmentation costs; the N best of a text need only its N - 1 units where that is least, so only
these are searched, and their alternatives are combined by what they cost together.

Scores are whole millionths.  A unigram vocabulary brings log probabilities.  A merge
vocabulary brings only an order of its pieces; a piece of rank r then has the log probability
of Zipf's law, -ln(r + 2).  Where no piece covers a character, it stands as its UTF-8 bytes, at
ten below the worst score.  Equal scores are decided by the order of the search, which is fixed.

Decoding joins pieces and bytes and drops the leading blank that encoding adds; it gives back
exactly the text, also one that holds the vocabulary's blank sign itself.

Defined cases: a null text has no segmentation (null); an empty text has one, without pieces.  A text
with fewer than N segmentations has all of them.  Repeated rows are encoded alike.  An empty
table gives an empty result.  Other columns take no part.  Memory is in proportion to the
longest run without a blank or line feed.
"""

from __future__ import annotations

import heapq
import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from ..sources.shipping import ship

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
N_BEST = 3
UNIT = 1_000_000
_BLANK = "▁"
_SIGNS, _LETTERS = r"(?:[^\w \n]|[\d_²³¹¼½¾])", r"[^\W\d_²³¹¼½¾]"
#: Ways to cut a text, finest first: blanks, then signs, then letters, and a line feed alone;
#: blanks and the word behind them.
_CUTS = (
    re.compile(rf" +{_SIGNS}*{_LETTERS}*|{_SIGNS}+{_LETTERS}*|{_LETTERS}+|\n"),
    re.compile(r" +[^ \n]*|[^ \n]+|\n"),
)
_WORDS = re.compile(r" +[^ ]*")
#: Bytes of words and of units kept per worker (about), words whose alternatives are kept, texts and units
#: worked on together, and length of units up to which they are.
_CACHED_BYTES, _SEARCHED, _TEXTS, _TOGETHER, _SHORT = 60 << 20, 20_000, 500, 20_000, 48
#: What a cached stretch takes besides its characters and ids: string, list and dictionary entry, numbers.
_EACH = 220
#: Rows and bytes that go to a worker at a time: what comes back is several times the text.
_BATCH_ROWS, _BATCH_BYTES = 500, 8 << 20
#: Cost of the next best segmentation where there is none.
_NONE = 1 << 62


class _Tree:
    """The characters of all pieces as a tree of numbered nodes, for whole arrays of units.

    A step from node to node is a search for (node, character) in one sorted array.
    """

    def __init__(self, pieces: dict[str, tuple[int, int]]):
        steps: dict[tuple[int, str], int] = {}
        ends = {}
        for text, piece in pieces.items():
            node = 0
            for ch in text:
                node = steps.setdefault((node, ch), len(steps) + 1)
            ends[node] = piece
        order = sorted((n << 21 | ord(ch), child) for (n, ch), child in steps.items())
        self.keys = np.array([k for k, _ in order], np.int64)
        self.child = np.array([c for _, c in order], np.int64)
        self.score, self.piece = np.zeros(len(steps) + 1, np.int64), np.full(len(steps) + 1, -1, np.int32)
        for node, (score, k) in ends.items():
            self.score[node], self.piece[node] = score, k

    def step(self, nodes: np.ndarray, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which nodes have a child for their character, and these children."""
        key = nodes << 21 | chars
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        found = self.keys[at] == key
        return found, self.child[at[found]]


class _Known(dict):
    """Numbers of the stretches of text a worker has met, and per number: the best score, the
    cost of the next best segmentation, and the ids of the best one.  ``find`` gives these, and
    the numbers of ids, for a list of stretches."""

    def __init__(self, find):
        self.find, self.names, self.done, self.bytes = find, [], 0, 0
        self.total, self.second = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.start, self.ids = np.zeros(1, np.int64), np.zeros(0, np.int32)

    def __missing__(self, unit: str) -> int:
        number = self[unit] = len(self.names)
        self.names.append(unit)
        return number

    def numbers(self, units: list[str]) -> np.ndarray:
        if self.bytes > _CACHED_BYTES:
            self.__init__(self.find)
            self.clear()
        out = np.fromiter(map(self.__getitem__, units), np.int64, len(units))
        new = self.names[self.done:]
        if new:
            total, second, counts, ids = self.find(new)
            self.total = np.concatenate([self.total, total])
            self.second = np.concatenate([self.second, second])
            self.start = np.concatenate([self.start, self.start[-1] + np.cumsum(counts)])
            self.ids = np.concatenate([self.ids, ids])
            self.done = len(self.names)
            self.bytes += sum(map(len, new)) + _EACH * len(new) + ids.nbytes
        return out

    def paths(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the best segmentations, one after the other, and the number of each unit's."""
        counts = self.start[numbers + 1] - self.start[numbers]
        ends = np.cumsum(counts)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.start[numbers] - (ends - counts), counts)
        return self.ids[at], counts


@dataclass
class Vocabulary:
    """``pieces``: piece text to (score, id); ``surface``: bytes that each id stands for."""

    pieces: dict[str, tuple[int, int]]
    bytes_ids: list[int]
    surface: list[bytes]
    unknown: int
    unknown_id: int
    cut: re.Pattern | None

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("tree", "nodes", "units", "words", "searched")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.__post_init__()

    def __post_init__(self):
        self.tree, self.nodes, self.searched = {}, None, {}
        self.units, self.words = _Known(self.best_of_all), _Known(self.best_of_words)

    # --- encoding ----------------------------------------------------------------------

    def _grow(self) -> None:
        """A tree of characters; 0 leads to the piece that ends here."""
        for text, piece in self.pieces.items():
            node = self.tree
            for ch in text:
                node = node.setdefault(ch, {})
            node[0] = piece

    def _lattice(self, text: str) -> tuple[list, list, list]:
        """Forward Viterbi: edges (from, to, (score, id)) by start, best score per place, and
        the best edge into each place."""
        if not self.tree:
            self._grow()
        size = len(text)
        edges, best, back = [], [0] + [None] * size, [0] * (size + 1)
        for i in range(size):
            base, node, j, covered = best[i], self.tree, i, False
            while j < size:
                node = node.get(text[j])
                if node is None:
                    break
                j += 1
                piece = node.get(0)
                if piece is not None:
                    if j == i + 1:
                        covered = True
                    s = base + piece[0]
                    if best[j] is None or s > best[j]:
                        best[j], back[j] = s, len(edges)
                    edges.append((i, j, piece))
            if not covered:
                s = base + self.unknown
                if best[i + 1] is None or s > best[i + 1]:
                    best[i + 1], back[i + 1] = s, len(edges)
                edges.append((i, i + 1, (self.unknown, -1)))
        return edges, best, back

    def _ids(self, text: str, path) -> list[int]:
        ids = []
        for i, k in path:
            if k >= 0:
                ids.append(k)
            elif self.bytes_ids:
                ids += [self.bytes_ids[b] for b in text[i].encode()]
            else:
                ids.append(self.unknown_id)
        return ids

    def best(self, text: str) -> tuple[int, tuple[int, ...], int]:
        """Best score of a unit, its ids, and what the next best segmentation costs in addition."""
        edges, best, back = self._lattice(text)
        size = len(text)
        path, used, at = [], set(), size
        while at:
            used.add(back[at])
            i, _, piece = edges[back[at]]
            path.append((i, piece[1]))
            at = i
        # the best path through an edge: before it, itself, and the best way on
        total, second, onward = best[size], None, [None] * size + [0]
        for e in range(len(edges) - 1, -1, -1):
            i, j, piece = edges[e]
            if onward[j] is None:
                continue
            way = piece[0] + onward[j]
            if onward[i] is None or way > onward[i]:
                onward[i] = way
            if e not in used and (second is None or best[i] + way > second):
                second = best[i] + way
        return total, tuple(self._ids(text, reversed(path))), _NONE if second is None else total - second

    def best_of_all(self, units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """``best`` for many units: scores, costs of the next best, numbers of ids, all ids."""
        if self.nodes is None:
            self.nodes = _Tree(self.pieces)
        size = np.fromiter(map(len, units), np.int64, len(units))
        total, second = np.zeros(len(units), np.int64), np.zeros(len(units), np.int64)
        found: list = [None] * len(units)
        order = np.argsort(size, kind="stable")
        for a in range(0, len(order), _TOGETHER):
            part = order[a:a + _TOGETHER]
            short = part[size[part] <= _SHORT]
            if len(short):
                names = [units[i] for i in short]
                total[short], second[short], paths, odd = self._best_of_short(names, size[short])
                for i, path in zip(short, paths):
                    found[i] = path
            else:
                odd = np.zeros(0, np.int64)
            for i in [*short[odd], *part[size[part] > _SHORT]]:
                total[i], path, second[i] = self.best(units[i])
                found[i] = np.array(path, np.int32)
        counts = np.fromiter(map(len, found), np.int64, len(found))
        return total, second, counts, np.concatenate(found) if found else np.zeros(0, np.int32)

    def best_of_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The same for words, each behind a blank, from their units."""
        parts = [self.cut.findall(" " + w) if self.cut else [" " + w] for w in words]
        first = np.cumsum([0] + [len(p) for p in parts])
        numbers = self.units.numbers([u for p in parts for u in p])
        ids, counts = self.units.paths(numbers)
        total = np.add.reduceat(self.units.total[numbers], first[:-1])
        second = np.minimum.reduceat(self.units.second[numbers], first[:-1])
        return total, second, np.add.reduceat(counts, first[:-1]), ids

    def _best_of_short(self, names: list[str], size: np.ndarray):
        """The two passes of ``best`` over all units at once, place by place.  Units with a
        character that no piece covers are left to ``best``; their numbers come last."""
        n, width, tree = len(names), int(size.max()), self.nodes
        chars = np.array(names, f"U{width}").view(np.uint32).reshape(n, width).astype(np.int64)
        best = np.full((n, width + 1), -_NONE, np.int64)
        best[:, 0] = 0
        back, into = np.zeros((n, width + 1), np.int16), np.zeros((n, width + 1), np.int32)
        edges, odd = [], np.zeros(n, bool)
        for i in range(width):
            rows = np.flatnonzero(size > i)
            single = np.zeros(n, bool)
            nodes, here = np.zeros(len(rows), np.int64), rows
            for step in range(1, width - i + 1):
                inside = size[here] >= i + step
                here, nodes = here[inside], nodes[inside]
                known, nodes = tree.step(nodes, chars[here, i + step - 1])
                here = here[known]
                if not len(here):
                    break
                ends = tree.piece[nodes] >= 0
                r, k = here[ends], nodes[ends]
                if step == 1:
                    single[r] = True
                if len(r):
                    score = best[r, i] + tree.score[k]
                    more = score > best[r, i + step]
                    b = r[more]
                    best[b, i + step], back[b, i + step], into[b, i + step] = score[more], step, tree.piece[k[more]]
                    edges.append((i, step, r, tree.score[k]))
            lacking = rows[~single[rows]]
            odd[lacking] = True
            best[lacking, i + 1] = np.maximum(best[lacking, i + 1], best[lacking, i] + self.unknown)
        # back along the best path
        path, at, steps = np.zeros((n, width), np.int32), size.copy(), np.zeros(n, np.int64)
        used = np.zeros((n, width + 1), bool)
        live = np.flatnonzero(~odd)
        while len(live):
            p = at[live]
            used[live, p] = True
            path[live, steps[live]] = into[live, p]
            steps[live] += 1
            at[live] = p - back[live, p]
            live = live[at[live] > 0]
        onward = np.full((n, width + 1), -_NONE, np.int64)
        onward[np.arange(n), size] = 0
        second = np.full(n, -_NONE, np.int64)
        for i, step, r, score in reversed(edges):
            way = score + onward[r, i + step]
            onward[r, i] = np.maximum(onward[r, i], way)
            off = ~(used[r, i + step] & (back[r, i + step] == step))
            second[r[off]] = np.maximum(second[r[off]], best[r[off], i] + way[off])
        total = best[np.arange(n), size]
        cost = np.where(second <= -_NONE // 2, _NONE, total - second)
        paths = [row[:c][::-1] for row, c in zip(path, steps)]
        return total, cost, paths, np.flatnonzero(odd)

    def search(self, text: str, n: int) -> list[tuple[int, list[int]]]:
        """The n best segmentations of a unit, by A* from its end: (score, ids), best first."""
        edges, best, _ = self._lattice(text)
        into: list[list] = [[] for _ in range(len(text) + 1)]
        for edge in edges:
            into[edge[1]].append(edge)
        out, queue, pushed = [], [(-best[len(text)], 0, len(text), 0, None)], 0
        while queue and len(out) < n:
            cost, _, at, after, path = heapq.heappop(queue)
            if at == 0:
                steps = []
                while path is not None:
                    i, k, path = path
                    steps.append((i, k))
                out.append((-cost, self._ids(text, steps)))
                continue
            for i, _, (s, k) in into[at]:
                pushed -= 1  # among equals the latest first, which goes straight to the start
                heapq.heappush(queue, (-(best[i] + s + after), pushed, i, after + s, (i, k, path)))
        return out

    def alternatives(self, text: str, n: int, best: np.ndarray) -> list[tuple[int, list[int]]]:
        """The n best segmentations of a word besides ``best``, its best one: (cost, ids)."""
        found = self.searched.get((n, text))
        if found is None:
            if len(self.searched) >= _SEARCHED:
                self.searched.clear()
            ids, every = best.tolist(), self.search(" " + text, n + 1)
            others = [(every[0][0] - s, x) for s, x in every if x != ids]
            found = self.searched[n, text] = others[:n]
        return found

    def encode(self, text: str, n: int) -> list[tuple[int, np.ndarray]]:
        """The n best segmentations of a text: (score, ids), best first."""
        return self.encode_all([text], n)[0]

    def encode_all(self, texts: list[str], n: int) -> list[list[tuple[int, np.ndarray]]]:
        names, upto = [], [0]
        for text in texts:
            if text and self.cut and "  " in " " + text:
                names += [w[1:] for w in _WORDS.findall(" " + text)]
            elif text:
                names += text.split(" ") if self.cut else [text]
            upto.append(len(names))
        numbers = self.words.numbers(names)
        ids, counts = self.words.paths(numbers)
        totals = np.concatenate([[0], np.cumsum(self.words.total[numbers])])
        at = np.concatenate([[0], np.cumsum(counts)])
        return [self._n_best(names, numbers, at, ids, int(totals[b] - totals[a]), a, b, n)
                for a, b in zip(upto, upto[1:])]

    def _n_best(self, names, numbers, at, ids, total: int, a: int, b: int, n: int):
        """The n best of the text that is words a to b, whose best ids lie at at[a]..at[b]."""
        mine = ids[at[a]:at[b]]
        out = [(total, mine)]
        if n == 1 or a == b:
            return out
        # words by their cheapest alternative; no solution needs more than n - 1 of them
        costs = self.words.second[numbers[a:b]]
        places = np.lexsort((np.arange(b - a), costs))[:n - 1] if b - a < 4 * n else self._cheapest(costs, n - 1)
        places = [int(p) for p in places if costs[p] < _NONE]
        other = [self.alternatives(names[a + p], n - 1, ids[at[a + p]:at[a + p + 1]]) for p in places]
        queue: list[tuple] = []
        if places:
            heapq.heappush(queue, (other[0][0][0], 0, 0, ((0, 0),)))
        while queue and len(out) < n:
            cost, i, c, chosen = heapq.heappop(queue)
            swap = sorted((places[j], other[j][d][1]) for j, d in chosen)
            parts, last = [], at[a]
            for p, new in swap:
                parts += [ids[last:at[a + p]], np.array(new, np.int32)]
                last = at[a + p + 1]
            out.append((total - cost, np.concatenate([*parts, ids[last:at[b]]])))
            if c + 1 < len(other[i]):
                heapq.heappush(queue, (cost - other[i][c][0] + other[i][c + 1][0], i, c + 1, (*chosen[:-1], (i, c + 1))))
            if i + 1 < len(places):
                more = other[i + 1][0][0]
                heapq.heappush(queue, (cost + more, i + 1, 0, (*chosen, (i + 1, 0))))
                if c == 0:
                    heapq.heappush(queue, (cost - other[i][0][0] + more, i + 1, 0, (*chosen[:-1], (i + 1, 0))))
        return out

    @staticmethod
    def _cheapest(costs: np.ndarray, n: int) -> list[int]:
        """Places of the n smallest costs, the earlier first among equals."""
        limit = np.partition(costs, n - 1)[n - 1]
        near = np.flatnonzero(costs <= limit)
        return near[np.lexsort((near, costs[near]))][:n].tolist()

    # --- decoding ----------------------------------------------------------------------

    def decode(self, ids) -> str:
        data = b"".join(map(self.surface.__getitem__, ids))
        return data[1:].decode("utf-8", "replace") if data else ""


def read_vocabulary(path: str = MODEL) -> Vocabulary:
    """Pieces and scores of a model file; read on the driver and broadcast (a few MB)."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    ordinary, bytes_ids, surface = [], {}, []
    for i in range(sp.get_piece_size()):
        piece = sp.id_to_piece(i)
        if sp.is_byte(i):
            bytes_ids[int(piece[1:-1], 16)] = i
            surface.append(bytes([int(piece[1:-1], 16)]))
        elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
            surface.append(b"" if sp.is_control(i) else " ⁇ ".encode())
        else:
            text = piece.replace(_BLANK, " ")
            ordinary.append((text, sp.get_score(i), i))
            surface.append(text.encode())
    # a merge vocabulary's scores are its ranks, whole numbers from 0 down
    merges = all(s <= 0 and s == int(s) for _, s, _ in ordinary)
    pieces = {text: (round(UNIT * (-math.log(rank + 2) if merges else score)), i)
              for rank, (text, score, i) in enumerate(ordinary)}
    worst = min(s for s, _ in pieces.values())
    cut = next((c for c in _CUTS if all(c.fullmatch(x) and x != "\n" for x, _, _ in ordinary)), None)
    return Vocabulary(pieces, [bytes_ids[b] for b in range(256)] if len(bytes_ids) == 256 else [], surface,
                      worst - 10 * UNIT, sp.unk_id(), cut)


def _nested(found: list) -> pa.Array:
    """array<array<int>> of the paths, without Python numbers in between."""
    flat = [ids for paths in found for _, ids in paths]
    inner = np.cumsum([0] + [len(x) for x in flat], dtype=np.int32)
    outer = np.cumsum([0] + [len(x) for x in found], dtype=np.int32)
    values = np.concatenate(flat).astype(np.int32, copy=False) if flat else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(outer), pa.ListArray.from_arrays(pa.array(inner), pa.array(values)))


def encoder(spark, path: str = MODEL, n: int = N_BEST):
    """A column function: text to struct<scores array<double>, paths array<array<int>>, round_trip
    boolean>, best first.  ``round_trip`` says whether the best path, decoded, is the text.

    Lowers the session's Arrow batches to ``_BATCH_ROWS`` rows and ``_BATCH_BYTES`` bytes where they are
    larger, as the ids of a batch are held at once by the worker and by the executor.
    """
    ship(spark)
    for setting, most in (("maxRecordsPerBatch", _BATCH_ROWS), ("maxBytesPerBatch", _BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{setting}"
        now = spark.conf.get(key, None)
        if now is None or not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, most)
    vocabulary = spark.sparkContext.broadcast(read_vocabulary(path))

    @arrow_udf("struct<scores:array<double>,paths:array<array<int>>,round_trip:boolean>")
    def encode(texts: pa.Array) -> pa.Array:
        voc, out = vocabulary.value, []
        for a in range(0, len(texts), _TEXTS):
            part = texts.slice(a, _TEXTS).to_pylist()
            found = [x if t is not None else [] for t, x in zip(part, voc.encode_all(part, n))]
            back = [None if t is None else voc.decode(x[0][1].tolist()) == t for t, x in zip(part, found)]
            scores = pa.array([[s / UNIT for s, _ in x] for x in found], pa.list_(pa.float64()))
            out.append(pa.StructArray.from_arrays([scores, _nested(found), pa.array(back, pa.bool_())],
                                                  names=["scores", "paths", "round_trip"]))
        return pa.concat_arrays(out) if out else pa.array([], out_type)

    out_type = pa.struct([("scores", pa.list_(pa.float64())), ("paths", pa.list_(pa.list_(pa.int32()))),
                          ("round_trip", pa.bool_())])
    return lambda text: F.when(text.isNotNull(), encode(text))


def decoder(spark, path: str = MODEL):
    """A column function: array of ids to text."""
    ship(spark)
    vocabulary = spark.sparkContext.broadcast(read_vocabulary(path))

    @arrow_udf("string")
    def decode(ids: pa.Array) -> pa.Array:
        return pa.array([None if x is None else vocabulary.value.decode(x) for x in ids.to_pylist()], pa.string())

    return decode


def encode_documents(docs: DataFrame, path: str = MODEL, n: int = N_BEST, id_col: str = "doc_id",
                     text_col: str = "text") -> DataFrame:
    """doc_id, text, scores, paths, round_trip: the n best segmentations of every text."""
    encode = encoder(docs.sparkSession, path, n)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.withColumn("_found", encode(F.col("text"))).select(
        "doc_id", "text", *[F.col(f"_found.{c}").alias(c) for c in ("scores", "paths", "round_trip")])


def decode_best(encoded: DataFrame, path: str = MODEL) -> DataFrame:
    """Add ``decoded``: the text that the best segmentation spells."""
    decode = decoder(encoded.sparkSession, path)
    return encoded.withColumn("decoded", decode(F.get("paths", F.lit(0))))
