"""Registry of checked queries: a Spark callable and, where SQL can say it, the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import spread
from .views import load, view_sql

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return register


def with_views(body: str, *views: str, more: str = "", recursive: bool = False) -> str:
    """SQL text reading derived views: ``more`` may hold further WITH clauses."""
    parts = [f"{v} AS ({view_sql(v, 'duckdb')})" for v in views]
    if more:
        parts.append(more)
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(parts) + "\n" + body


def messages(spark: SparkSession, sf_dir: str, each: int = 1) -> DataFrame:
    """The message view in the shape operators expect (payload as a list)."""
    m = spread(load(spark, sf_dir, "messages"), each)
    payloads = F.when(F.col("qr_payload").isNotNull(), F.array("qr_payload")).otherwise(
        F.array().cast("array<string>"))
    return m.withColumn("qr_payloads", payloads).drop("qr_payload")


def joined(c, sep: str = "|"):
    """A string column out of a list, in a fixed order."""
    return F.array_join(F.sort_array(c), sep)


# --- canonical text in SQL ----------------------------------------------------------

_W = r"\p{L}\p{N}_"
BEFORE, AFTER = rf"(?:^|[^{_W}])", rf"(?:$|[^{_W}])"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sql_collapse(x: str, chars: str) -> str:
    for c in chars:
        x = f"regexp_replace({x}, '{c}{{3,}}', '{c}{c}', 'g')"
    return x


_HIDDEN = (r"[\x{AD}\x{34F}\x{61C}\x{180E}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{2064}"
           r"\x{2066}-\x{206F}\x{FE00}-\x{FE0F}\x{FEFF}]")
_LIKE = "авсеѕһіјкмнортухԁɡναβεικορτυχϲ"
_LIKE_TO = "abceshijkmhoptyxdgvabeikoptuxc"


def sql_hidden(x: str) -> str:
    return f"regexp_replace({x}, '{_HIDDEN}', '', 'g')"


def sql_looks(x: str) -> str:
    return f"translate({x}, '{_LIKE}', '{_LIKE_TO}')"


def sql_leet(x: str) -> str:
    return f"translate({x}, '013457@$', 'oieastas')"


def sql_plain(x: str) -> str:
    inner = f"strip_accents(replace(replace({x}, 'đ', 'd'), 'Đ', 'D'))"
    return f"regexp_replace({inner}, '\\p{{Mn}}+', '', 'g')"


def sql_norm(x: str) -> str:
    inner = sql_leet(sql_plain(sql_looks(f"lower({sql_hidden(x)})")))
    inner = f"regexp_replace({inner}, '[^a-z0-9]+', ' ', 'g')"
    return f"trim({sql_collapse(inner, 'abcdefghijklmnopqrstuvwxyz2689')})"


def sql_keep(x: str) -> str:
    inner = sql_leet(sql_looks(f"lower({sql_hidden(x)})"))
    inner = f"regexp_replace({inner}, '[^0-9a-z\\x{{E0}}-\\x{{1EF9}}]+', ' ', 'g')"
    chars = "abcdefghijklmnopqrstuvwxyz2689" + "óñíéèêçöäü" + "ềỗợấ"
    return f"trim({sql_collapse(inner, chars)})"
