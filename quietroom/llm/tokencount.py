"""Token counts per section by offset-mapped attribution.

A document is encoded once, as a whole.  The byte lengths of its tokens give each token a span;
spans are joined with the sections of the document, which are neighbouring spans that cover
it.  A token inside a section counts for it.  A token that crosses a boundary counts for the
section that holds most of its bytes, the earlier one among equals (``rule="majority"``), or
for the section of its first byte (``rule="first"``).  Each token counts once, so the counts
of a document's sections add up to its tokens.

The vocabulary is a file of merge ranks; the driver reads it and broadcasts it (under 1 MB).

Defined cases: a null or empty text has no tokens and no sections.  A boundary outside the text
is ignored.  Repeated rows are documents of their own.  An empty table gives an empty result.
Other columns take no part.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shipping import ship

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the public pattern that splits text before the merges of this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_CODERS: dict[int, tuple] = {}


def _coder(ranks: bytes) -> tuple:
    """Encoder and byte length of each token id; built once per worker."""
    import tiktoken

    key = hash(ranks)
    if key not in _CODERS:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        size = np.zeros(max(table.values()) + 1, np.int64)
        for token, i in table.items():
            size[i] = len(token)
        _CODERS[key] = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=table, special_tokens={}), size
    return _CODERS[key]


def attribute(ends: np.ndarray, bounds: np.ndarray, rule: str = "majority") -> tuple[np.ndarray, int]:
    """Tokens per section and number of crossing tokens.

    ``ends``: end of each token; ``bounds``: end of each section, the last at the end of the text.
    """
    starts = np.concatenate([[0], ends[:-1]])
    first = np.searchsorted(bounds, starts, "right")
    last = np.searchsorted(bounds, ends - 1, "right")
    owner, crossing = first.copy(), np.flatnonzero(first != last)
    if rule == "majority":
        for t in crossing:
            cuts = np.concatenate([[starts[t]], bounds[first[t]:last[t]], [ends[t]]])
            owner[t] = first[t] + int(np.argmax(np.diff(cuts)))
    return np.bincount(owner, minlength=len(bounds)), len(crossing)


def count_tokens(docs: DataFrame, ranks_path: str = RANKS, rule: str = "majority",
                 id_col: str = "doc_id", text_col: str = "text", ends: Column | None = None) -> DataFrame:
    """doc_id, n_tokens, n_sections, n_crossing, section_tokens, tokens_crc32.

    ``ends``: column with the ends of sections, in code points, as a sorted array; by default
    each line, with its line feed, is a section.
    """
    spark = docs.sparkSession
    ship(spark)
    with open(ranks_path, "rb") as f:
        ranks = spark.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zlib

        coder, size = _coder(ranks.value)
        for pdf in batches:
            out = []
            for text, given in zip(pdf["text"], pdf["ends"]):
                if not text:
                    out.append((0, 0, 0, [], 0))
                    continue
                ids = np.array(coder.encode_ordinary(text), np.int64)
                data = np.frombuffer(text.encode(), np.uint8)
                if given is None:
                    bounds = np.flatnonzero(data == 10) + 1
                else:
                    at = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
                    given = np.asarray(given, np.int64)
                    bounds = at[given[(given > 0) & (given < len(at))]]
                bounds = np.unique(np.append(bounds, len(data)))
                per, crossing = attribute(np.cumsum(size[ids]), bounds, rule)
                out.append((len(ids), len(bounds), crossing, per, zlib.crc32(ids.astype("<u4").tobytes())))
            done = pd.DataFrame(out, columns=["n_tokens", "n_sections", "n_crossing", "section_tokens", "tokens_crc32"])
            done.insert(0, "doc_id", pdf["doc_id"].to_numpy())
            yield done

    given = F.lit(None).cast("array<long>") if ends is None else ends.cast("array<long>")
    doc_id = F.col(id_col)
    kind = docs.select(doc_id).schema[0].dataType.simpleString()
    return docs.select(doc_id.alias("doc_id"), F.col(text_col).alias("text"), given.alias("ends")).mapInPandas(
        run, f"doc_id {kind}, n_tokens long, n_sections int, n_crossing int, section_tokens array<int>, tokens_crc32 long")
