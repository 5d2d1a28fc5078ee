"""Ordered running aggregates that do not send a whole key to one task.

A plain window puts every row of a key into one partition, and one sender may hold a third
of an archive.  Here time is cut into slices: the window runs inside ``(key, slice)``, each
slice is also summed up on its own (with map-side partial aggregation), and a second, tiny
window over the slice totals gives every slice what came before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLICE_SECONDS = 6 * 3600
_SLICE = "_slice"

_AGGREGATE = {"sum": F.sum, "min": F.min, "max": F.max}


def _merge(kind: str, here: Column, before: Column) -> Column:
    if kind == "sum":
        return F.coalesce(here, F.lit(0)) + F.coalesce(before, F.lit(0))
    return (F.least if kind == "min" else F.greatest)(here, before)


def running(df: DataFrame, keys: list[str], order: list[str],
            measures: dict[str, tuple[str, Column]], inclusive: bool = True,
            following: dict[str, Column] | None = None,
            width: int = SLICE_SECONDS) -> DataFrame:
    """Add running ``sum`` / ``min`` / ``max`` columns per key.

    ``order`` starts with the epoch-second column that is sliced.  ``inclusive`` counts the
    current row in.  ``max`` over ``when(condition, struct(order..., payload))`` gives "the
    last row for which".  ``following`` takes a value from the next row of the key.

    ``df`` is read twice; keep it narrow, or checkpoint it first.
    """
    following = following or {}
    sliced = df.withColumn(_SLICE, F.floor(F.col(order[0]) / width))
    at = F.struct(*order)
    totals = [_AGGREGATE[kind](value).alias(name) for name, (kind, value) in measures.items()]
    heads = [F.min_by(value, at).alias(name) for name, value in following.items()]
    per_slice = sliced.groupBy(*keys, _SLICE).agg(*totals, *heads)

    slices = Window.partitionBy(*keys).orderBy(_SLICE)
    before = slices.rowsBetween(Window.unboundedPreceding, -1)
    carried = per_slice.select(
        *keys, _SLICE,
        *[_AGGREGATE[kind](name).over(before).alias(f"_before_{name}")
          for name, (kind, _) in measures.items()],
        *[F.lead(name).over(slices).alias(f"_after_{name}") for name in following])

    inside = Window.partitionBy(*keys, _SLICE).orderBy(*order)
    frame = inside.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    rows = sliced.withColumns({
        **{f"_here_{name}": _AGGREGATE[kind](value).over(frame)
           for name, (kind, value) in measures.items()},
        **{f"_next_{name}": F.lead(value).over(inside) for name, value in following.items()},
    }).join(carried, [*keys, _SLICE], "left")
    return rows.select(
        *df.columns,
        *[_merge(kind, F.col(f"_here_{name}"), F.col(f"_before_{name}")).alias(name)
          for name, (kind, _) in measures.items()],
        *[F.coalesce(f"_next_{name}", f"_after_{name}").alias(name) for name in following])
