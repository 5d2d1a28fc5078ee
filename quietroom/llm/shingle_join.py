"""N-gram Jaccard join with adaptive multi-match prefixes.

Documents link when the sets of their word shingles overlap in at least ``percent`` of the
union.  Texts are lower-cased in A-Z and cut into words at blanks, tabs, line feeds, VT, FF and
carriage returns; a text with fewer words than a shingle is one shingle.

**Prefixes.**  Let all shingles have one order.  If two sets link, and each takes its first
``n - ceil(t·n) + l`` shingles, they share at least ``l`` of them; of prefixes of given lengths,
two sets of known sizes must share the more, the closer their sizes.  The order here is by hash,
but *heavy* shingles, which more than ``HEAVY`` prefixes hold, come last.  They are found in
rounds: a document whose prefix holds heavy shingles is lengthened by as many others, so its
``l`` shared shingles must include light ones.  Where light lists still cost many
candidates, ``l`` grows to 2 or 3: the prefix is longer, and a pair needs that many shared
shingles before it is verified.  Only documents made mostly of heavy shingles (large groups of
near copies) have heavy ones left in their prefix, and only these documents are listed there.

**Candidates without all pairs.**  What is wanted are the components, so pairs inside a known
component are never made.  First, each list links its members to one pivot, which costs as many
pairs as members; the verified links are gathered into components.  When the pairs across
components that are left are few, all of them are made, counted and verified.  Until then, more
rounds with other pivots merge what is left.  A pair that must share more shingles than either
prefix has heavy ones also shares a light one, and is met there: heavy lists are joined only
between documents whose sizes and numbers of heavy shingles let heavy ones alone be enough.  In
large groups of documents made mostly of heavy shingles, these are still many pairs.  The shingles
kept from the first scan rule out most pairs; the others are verified on whole texts.

**Copies.**  Equal sets are one class with one node; rows get their class's answer at the end.

Shingles are 64-bit hashes; sets are verified from whole texts.

Defined cases: a text that is null or has no word has an empty set, links with nothing and is
its own component (its id).  A null id is never the smallest of a component that holds others;
rows of a component without any id have a null component.  Repeated rows are copies.  An empty
table gives an empty result.  Other columns take no part.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shipping import ship
from .common import discard, staged
from .components import components

WIDTH, PERCENT = 5, 80
#: A shingle in more prefixes than this is heavy.
HEAVY = 16
#: Mean number of other documents per light prefix shingle from which l is 2, and 3.
COSTLY = (4, 12)
MOST_MATCHES = 3
#: Star rounds at most, and pairs left (per list entry) from which all are made at once.
STAR_ROUNDS, PAIRS_PER_ENTRY = 4, 8
#: Bands that the sizes a document of some size can link with are cut into.
SIZE_BANDS = 16
#: Parts by shingle that are worked on one after the other, so that only one is in flight.
SLICES = 4
#: Nodes whose list is broadcast to fetch their texts; more are joined by a shuffle.
FEW_NODES = 200_000

_MIX = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xFF51AFD7ED558CCD))


class _WordHashes(dict):
    """Hashes of words seen by this worker; emptied when large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


_HASHES = _WordHashes()


def shingles(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a text."""
    words = (text or "").encode().lower().split()
    n = len(words)
    if not n:
        return np.zeros(0, np.int64)
    h = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, n)
    used = min(width, n)
    s = np.full(n - used + 1, used, np.uint64)
    for i in range(used):
        s = (s ^ (s >> np.uint64(29))) * _MIX[0] + h[i:n - used + 1 + i] * _MIX[1]
    s ^= s >> np.uint64(32)
    s *= _MIX[2]
    s ^= s >> np.uint64(29)
    return np.unique(s.view(np.int64))


def base_prefix(n: int, percent: int) -> int:
    return n - -(-n * percent // 100) + 1


def _kept(n: int, percent: int) -> int:
    """Shingles kept from the first scan: half as many again as the base prefix, and some."""
    p = base_prefix(n, percent)
    return min(n, p + p // 2 + 8)


def read_sets(docs: DataFrame, width: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, n, digest of the whole set, and its first shingles by hash."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for text in pdf["text"]:
                s = shingles(text, width)
                out.append((len(s), hashlib.blake2b(s.tobytes(), digest_size=16).digest(), s[:_kept(len(s), percent)]))
            done = pd.DataFrame(out, columns=["n", "digest", "tokens"])
            done.insert(0, "doc_id", pdf["doc_id"])
            yield done

    kind = docs.select(id_col).schema[0].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(
        run, f"doc_id {kind}, n int, digest binary, tokens array<long>")


def _whole_sets(texts: DataFrame, width: int) -> DataFrame:
    """(node, token) for all shingles of the texts given."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for node, text in zip(pdf["node"], pdf["text"]):
                s = shingles(text, width)
                yield pd.DataFrame({"node": np.full(len(s), node), "token": s})

    return texts.select("node", "text").mapInPandas(run, "node long, token long")


def verified(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar enough."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, np.ndarray] = {}

        def of(node: int, text: str) -> np.ndarray:
            if node not in held:
                if len(held) >= 16:
                    held.pop(next(iter(held)))
                held[node] = shingles(text, width)
            return held[node]

        for pdf in batches:
            good = []
            for a, b, ta, tb in zip(pdf["a"], pdf["b"], pdf["text_a"], pdf["text_b"]):
                x, y = of(a, ta), of(b, tb)
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pdf.loc[np.array(good, bool), ["a", "b"]]

    one = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    two = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    return pairs.select("a", "b").join(two, "b").join(one, "a").mapInPandas(run, "a long, b long")


class _Join:
    """The steps of one join; tables between steps are staged."""

    def __init__(self, docs: DataFrame, width: int, percent: int, id_col: str, text_col: str, heavy: int):
        ship(docs.sparkSession)
        self.docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
        self.width, self.percent, self.heavy_from = width, percent, heavy
        sets = staged(read_sets(docs, width, percent, id_col, text_col))
        self.members = staged(sets.select("doc_id", "n", "digest"))
        # node numbers are fixed by writing them
        self.classes = staged(
            sets.where("n > 0").groupBy("digest")
            .agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.count(F.lit(1)).alias("size"),
                 F.first("tokens").alias("tokens"))
            .withColumn("node", F.monotonically_increasing_id()))
        discard(sets)
        self.p = F.col("n") - F.expr(f"(n * {percent} + 99) div 100") + 1

    # --- texts -----------------------------------------------------------------------

    def texts_of(self, nodes: DataFrame) -> DataFrame:
        """(node, text) of the nodes given, from one row of each class."""
        wanted = staged(nodes.join(self.classes.select("node", "digest", "rep"), "node").select("node", "rep", "digest"))
        if wanted.count() <= FEW_NODES:
            wanted = F.broadcast(wanted)  # some 50 bytes a row
        plain = self.docs.join(wanted.where("rep IS NOT NULL"), F.col("doc_id") == F.col("rep"))
        found = plain.select("node", "digest", "text")
        nameless = wanted.where("rep IS NULL")
        if not nameless.isEmpty():  # classes without an id: found among the rows without one
            rows = read_digests(self.docs.where("doc_id IS NULL"), self.width)
            return (found.unionByName(rows.join(nameless.select("node", "digest"), "digest")
                                      .select("node", "digest", "text"))
                    .transform(lambda d: keep_own(d, self.width)).dropDuplicates(["node"]))
        if self.repeated_ids:
            return found.transform(lambda d: keep_own(d, self.width)).dropDuplicates(["node"])
        return found.select("node", "text")

    @property
    def repeated_ids(self) -> bool:
        """Whether some id stands on more than one row: then a class's text is told by its digest."""
        if not hasattr(self, "_repeated"):
            self._repeated = not (self.members.where("doc_id IS NOT NULL").groupBy("doc_id")
                                  .count().where("count > 1").isEmpty())
        return self._repeated

    def possible(self, pairs: DataFrame) -> DataFrame:
        """Pairs whose kept shingles leave room for the similarity.

        Up to the smaller of both last kept hashes, both sets are known; what one has there and
        the other lacks is missing from the overlap for certain.
        """
        def side(name: str) -> DataFrame:
            whole = F.size("tokens") == F.col("n")
            return self.classes.select(
                F.col("node").alias(name), F.col("n").alias(f"n_{name}"), F.col("tokens").alias(f"t_{name}"),
                F.when(whole, F.lit((1 << 63) - 1)).otherwise(F.element_at("tokens", -1)).alias(f"to_{name}"))

        met = pairs.join(side("b"), "b").join(side("a"), "a")
        upto = F.least("to_a", "to_b")
        missing = [F.size(F.array_except(F.filter(x, lambda t: t <= upto), F.col(y)))
                   for x, y in (("t_a", "t_b"), ("t_b", "t_a"))]
        most = F.least(F.col("n_a") - missing[0], F.col("n_b") - missing[1])
        return met.where(most * (100 + self.percent) >= (F.col("n_a") + F.col("n_b")) * self.percent).select("a", "b")

    # --- prefixes ----------------------------------------------------------------------

    def prefixes(self) -> DataFrame:
        """Entries of all prefixes in lists of two or more: token, whether it is heavy, node, n, the length
        of the node's prefix and the heavy shingles in it."""
        base = self.classes.select("node", "n", self.p.alias("p"), F.explode(F.slice("tokens", 1, self.p)).alias("token"))
        first = staged(base.groupBy("token").agg(F.count(F.lit(1)).alias("m")).where("m > 1"))
        met = base.join(first, "token")
        costs = met.groupBy("node", "n", "p").agg(
            F.sum(F.when(F.col("m") <= self.heavy_from, F.col("m") - 1).otherwise(0)).alias("cost"),
            F.count_if(F.col("m") > self.heavy_from).alias("stopped"))
        mean = F.col("cost") / F.greatest(F.col("p") - F.col("stopped"), F.lit(1))
        level = F.lit(1) + sum((mean > c).cast("int") for c in COSTLY)
        # a node's prefix needs p + l - 1 light shingles; l is at most n - p + 1
        lengthened = staged(costs.select(
            "node", "n", "p", F.least(level, F.lit(MOST_MATCHES), F.col("n") - F.col("p") + 1).alias("l"), "stopped")
            .where("l > 1 OR stopped > 0"))
        heavy = staged(first.where(F.col("m") > self.heavy_from).select("token"))
        need = F.col("p") + F.col("l") - 1
        own = self.classes.select("node", "tokens")
        columns = ["node", "n", "p", "l", "token"]

        def kept(nodes: DataFrame) -> DataFrame:
            return nodes.join(own, "node").select("node", "n", "p", "l", F.explode("tokens").alias("token"))

        def newly_heavy(added: DataFrame) -> DataFrame:
            counts = added.groupBy("token").agg(F.count(F.lit(1)).alias("more"))
            known = counts.join(first.select("token", "m"), "token", "left")
            return staged(known.where(F.col("more") + F.coalesce("m", F.lit(0)) > self.heavy_from)
                          .select("token").join(heavy, "token", "left_anti"))

        # from the kept shingles first; nodes that still lack light ones are read whole.  A shingle
        # that becomes heavy on the way concerns the nodes that hold it, and only these.
        parts = [staged(kept(lengthened))]
        kept_parts = list(parts)  # without the nodes that were read whole later
        late = newly_heavy(parts[0])
        heavy = staged(heavy.union(late))
        concerned = None
        while True:
            more = reduce(DataFrame.unionByName, kept_parts)
            seen = more if concerned is None else more.join(concerned, "node", "left_semi")
            state = seen.join(heavy.withColumn("_h", F.lit(True)), "token", "left").groupBy("node", "n", "p", "l").agg(
                F.count(F.lit(1)).alias("read"), F.count_if(F.col("_h").isNull()).alias("light"))
            lacking = staged(state.where((F.col("light") < need) & (F.col("read") < F.col("n")))
                             .select("node", "n", "p", "l"))
            touched = staged(base.join(late, "token").select("node", "n", "p").distinct()
                             .join(more.select("node").distinct(), "node", "left_anti")
                             .select("node", "n", "p", F.lit(1).alias("l")))
            if lacking.isEmpty() and touched.isEmpty():
                break
            added = kept(touched)
            if not lacking.isEmpty():
                sets = _whole_sets(self.texts_of(lacking.select("node")), self.width)
                added = added.unionByName(lacking.join(sets, "node").select(columns))
                kept_parts = [part.join(lacking.select("node"), "node", "left_anti") for part in kept_parts]
            added = staged(added)
            parts.append(added)
            kept_parts.append(added)
            late = newly_heavy(added)
            heavy = staged(heavy.union(late))
            holders = reduce(DataFrame.unionByName, kept_parts).join(late, "token", "left_semi").select("node")
            concerned = staged(holders.union(added.select("node")).distinct())
        plain = base.join(more.select("node").distinct(), "node", "left_anti").select(
            "token", "node", F.col("p").cast("int").alias("length"), F.lit(False).alias("heavy"),
            F.lit(0).cast("long").alias("n_heavy"))
        marked = more.join(heavy.withColumn("_h", F.lit(True)), "token", "left").select(
            "token", "node", "n", need.alias("need"), F.coalesce("_h", F.lit(False)).alias("heavy"))
        order = Window.partitionBy("node").orderBy("heavy", "token")
        ordered = marked.withColumn("_at", F.row_number().over(order)).where("_at <= need").select(
            "token", "node", F.col("need").cast("int").alias("length"), "heavy",
            F.count_if("heavy").over(Window.partitionBy("node")).alias("n_heavy"))
        entries = staged(plain.unionByName(ordered))
        for t in (first, lengthened, heavy, *parts):
            discard(t)
        # slice by slice, as most shingles stand in one prefix only and go again
        found = []
        for i in range(SLICES):
            part = entries.where(F.pmod("token", F.lit(SLICES)) == i)
            lists = part.groupBy("token").agg(F.count(F.lit(1)).alias("_m")).where("_m > 1")
            found.append(staged(part.join(lists.select("token"), "token")))
        sizes = self.classes.select("node", "n")
        out = staged(reduce(DataFrame.unionByName, found).join(sizes, "node"))
        discard(entries)
        return out

    # --- candidates --------------------------------------------------------------------

    def _close(self, a: str, b: str) -> Column:
        """Sets whose sizes allow the similarity."""
        return F.least(a, b) * 100 >= F.greatest(a, b) * self.percent

    def _must_share(self, a: str = "a", b: str = "b") -> Column:
        """How many shingles of both prefixes two sets share if they link.

        With an overlap of at least o, the l-th shared shingle stands among the first n - o + l of
        either set; so prefixes of these lengths hold l shared ones.
        """
        n_a, n_b = F.col(f"n_{a}"), F.col(f"n_{b}")
        o = F.ceil((n_a + n_b) * self.percent / F.lit(100 + self.percent) - 1e-9)
        return F.greatest(F.least(F.col(f"length_{a}") - n_a, F.col(f"length_{b}") - n_b) + o, F.lit(1))

    def star_pairs(self, entries: DataFrame, turn: int) -> DataFrame:
        """Members of lists with the pivot of each, where both are in different components.

        A pair counts here only in the lists where the one is the other's pivot; half of what it
        must share is asked for, as what is passed over now is found at the end.
        """
        key = F.struct(F.xxhash64(F.lit(turn), "node").alias("x"), "node", "n", "length", "root")
        pivots = entries.groupBy("token").agg(F.min(key).alias("v"))
        met = entries.join(pivots, "token").where((F.col("root") != F.col("v.root")) & self._close("n", "v.n"))
        sides = met.select(F.col("node").alias("m"), F.col("v.node").alias("v"),
                           *[x for c in ("n", "length") for x in (F.col(c).alias(f"{c}_m"), F.col(f"v.{c}").alias(f"{c}_v"))])
        counted = sides.groupBy(*sides.columns).agg(F.count(F.lit(1)).alias("shared"))
        return counted.where(F.col("shared") * 2 >= self._must_share("m", "v")).select(
            F.least("m", "v").alias("a"), F.greatest("m", "v").alias("b")).distinct()

    def all_pairs(self, entries: DataFrame) -> DataFrame:
        """All pairs across components that can share enough of their prefixes.

        Light lists are short and joined as they are.  Two prefixes share no more heavy shingles than
        either has; only where these alone could be enough must the pair be met in heavy lists.
        That takes a size of the larger set near the upper end of what the smaller one allows,
        so heavy lists are joined by bands of that size.
        """
        columns = ("node", "n", "length", "root", "n_heavy")

        def side(rows: DataFrame, x: str, *keys: str) -> DataFrame:
            return rows.select(*keys, *[F.col(c).alias(f"{c}_{x}") for c in columns])

        percent = self.percent
        step = max(math.log(100 / percent), 1e-6) / SIZE_BANDS
        band = lambda n: F.floor(F.ln(n) / F.lit(step))
        light, heavy = entries.where("NOT heavy"), entries.where("heavy")
        # of the larger set: n_b >= (n_a - n_heavy·(1 + t) / t) / t, or more heavy ones would be needed
        low = F.greatest(F.floor((F.col("n") - F.col("n_heavy") * (100 + percent) / percent) * 100 / percent) - 1, F.col("n"))
        high = F.floor(F.col("n") * 100 / percent)
        smaller = (heavy.withColumns({"_low": low, "_high": high}).where("_low <= _high")
                   .withColumn("band", F.explode(F.sequence(band(F.col("_low")), band(F.col("_high"))))))
        larger = heavy.withColumn("band", band(F.col("n")))
        ordered = ((F.col("n_a") < F.col("n_b")) | ((F.col("n_a") == F.col("n_b")) & (F.col("node_a") < F.col("node_b"))))
        wanted = ordered & (F.col("root_a") != F.col("root_b")) & self._close("n_a", "n_b")
        asked, most = self._must_share(), F.least("n_heavy_a", "n_heavy_b")
        in_light = side(light, "a", "token").join(side(light, "b", "token"), "token").where(wanted)
        in_heavy = (side(smaller, "a", "token", "band").join(side(larger, "b", "token", "band"), ["token", "band"])
                    .where(wanted & (asked <= most)).drop("band"))
        met = in_light.withColumn("heavy", F.lit(False)).unionByName(in_heavy.withColumn("heavy", F.lit(True)))
        keys = [f"{c}_{x}" for x in "ab" for c in columns if c != "root"]
        counted = met.groupBy(*keys).agg(F.count_if(~F.col("heavy")).alias("light"), F.count_if("heavy").alias("heavy"))
        return counted.where(F.col("light") + F.when(asked <= most, F.col("heavy")).otherwise(most) >= asked).select(
            F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b"))

    def links(self) -> tuple[DataFrame | None, DataFrame | None]:
        """Verified links that connect every component, and the components."""
        open_lists = self.prefixes()
        tried, links, roots, fruitless = None, None, None, False
        for turn in range(STAR_ROUNDS + 1):
            now = open_lists.drop("root")
            now = now.withColumn("root", F.col("node")) if roots is None else now.join(
                roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
            per = now.groupBy("token", "root").agg(F.count(F.lit(1)).alias("c"))
            mixed = staged(per.groupBy("token").agg(F.count(F.lit(1)).alias("roots"), F.sum("c").alias("m"),
                                                    F.sum(F.col("c") * F.col("c")).alias("inner")).where("roots > 1"))
            open_pairs, open_entries = mixed.agg(F.sum(F.expr("(m * m - inner) div 2")), F.sum("m")).first()
            if not open_pairs:
                break
            open_lists = staged(now.join(mixed.select("token"), "token"))  # a closed list stays closed
            last = fruitless or turn == STAR_ROUNDS or (turn > 0 and open_pairs <= PAIRS_PER_ENTRY * open_entries)
            pairs = self.all_pairs(open_lists) if last else self.star_pairs(open_lists, turn)
            if tried is not None:
                pairs = pairs.join(tried, ["a", "b"], "left_anti")
            pairs = staged(pairs)
            tried = pairs if tried is None else tried.union(pairs)
            left = staged(self.possible(pairs))
            fruitless = left.isEmpty()
            if not fruitless:
                nodes = left.select(F.col("a").alias("node")).union(left.select("b")).distinct()
                texts = staged(self.texts_of(nodes))
                good = staged(verified(left, texts, self.width, self.percent))
                discard(texts)
                fruitless = good.isEmpty()
                if not fruitless:
                    links = good if links is None else links.union(good)
                    roots = staged(components(links, "a", "b"))
            if last:
                break
        return links, roots


def digest_of(width: int):
    """A column function: text to the digest of its set of shingles."""
    @F.pandas_udf("binary")
    def digest(text: pd.Series) -> pd.Series:
        return pd.Series([hashlib.blake2b(shingles(t, width).tobytes(), digest_size=16).digest() for t in text])

    return digest


def read_digests(rows: DataFrame, width: int) -> DataFrame:
    """(digest, text) of rows."""
    return rows.select(digest_of(width)("text").alias("digest"), "text")


def keep_own(found: DataFrame, width: int) -> DataFrame:
    """Of (node, digest, text), the rows whose text has the digest of the node's class."""
    @F.pandas_udf("boolean")
    def own(digest: pd.Series, text: pd.Series) -> pd.Series:
        return pd.Series([d == hashlib.blake2b(shingles(t, width).tobytes(), digest_size=16).digest()
                          for d, t in zip(digest, text)], dtype=bool)

    return found.where(own("digest", "text")).select("node", "text")


def _rooted(join: _Join) -> DataFrame:
    """digest, rep, size, root, component_id for every class of equal sets."""
    _, roots = join.links()
    named = join.classes.select("node", "digest", "rep", "size")
    if roots is None:
        named = named.withColumn("root", F.col("node"))
    else:
        named = named.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    return named.join(least, "root")


def near_groups(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, id_col: str = "doc_id",
                text_col: str = "text", heavy: int = HEAVY) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of ``docs``."""
    join = _Join(docs, width, percent, id_col, text_col, heavy)
    answers = staged(_rooted(join).select("digest", "size", "component_id"))
    total = join.members.count()
    large = F.col("size") > max(1_000, total // 1_000)
    few = F.broadcast(answers.where(large).select("digest", "component_id"))  # under 1,000 rows
    some = join.members.where("n > 0")
    found = some.join(few, "digest").unionByName(
        some.join(few.select("digest"), "digest", "left_anti")
        .join(answers.where(~large).select("digest", "component_id"), "digest"))
    none = join.members.where("n = 0").withColumn("component_id", F.col("doc_id"))
    return found.select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id").unionByName(
        none.select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id"))


def keep_one_each(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """One row of ``docs``, all columns, per group: the one whose id names the group.
    Rows without an id stay.

    Where an id stands on rows with different texts, each text is a document of its own group;
    if several of a group carry the id that names it, the one with the least digest stays.
    """
    join = _Join(docs, width, percent, id_col, text_col, HEAVY)
    first = (_rooted(join).where("rep = component_id").groupBy("root", "component_id")
             .agg(F.min("digest").alias("_set")).select(F.col("component_id").alias("_kept"), "_set"))
    empty = join.members.where("n = 0 AND doc_id IS NOT NULL").select("doc_id", "digest").distinct()
    kept = staged(first.union(empty))
    names = [f"c{i}" for i in range(len(docs.columns))]
    at = dict(zip(docs.columns, names))
    every = docs.toDF(*names)
    nameless = every.where(F.col(at[id_col]).isNull())
    if not join.repeated_ids:
        return every.join(kept, F.col(at[id_col]) == F.col("_kept"), "left_semi").union(nameless).toDF(*docs.columns)
    row = F.struct(*names)
    rows = every.where(F.col(at[id_col]).isNotNull()).withColumn("_digest", digest_of(width)(at[text_col]))
    # grouped first, as copies under one id are combined inside each map task
    one = rows.groupBy(at[id_col], "_digest").agg(F.min_by(row, F.to_json(row)).alias("_row"))
    same = (F.col(at[id_col]) == F.col("_kept")) & (F.col("_digest") == F.col("_set"))
    return one.join(kept, same, "left_semi").select("_row.*").union(nameless).toDF(*docs.columns)
