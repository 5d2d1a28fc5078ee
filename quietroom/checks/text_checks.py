"""Canonical text."""

from pyspark.sql import functions as F

from ..functions import text as T
from .base import (ORACLE, QUERIES, messages, query, sql_hidden, sql_keep, sql_leet, sql_looks,
                   sql_norm, sql_plain, with_views)

_W = r"\p{L}\p{N}_"
def _collapse_sql():
    x = "text"
    printable = [chr(c) for c in range(0x20, 0x7F)] + list("óñíéèêçöäüÓÑÍÊÈÉÇÖÜÄß🎁")
    for c in printable:
        x = f"regexp_replace({x}, '\\x{{{ord(c):X}}}{{3,}}', chr({ord(c)}) || chr({ord(c)}), 'g')"
    return x.replace("chr(92) || chr(92)", "repeat(chr(92), 4)")


def _text_query(name, fn, sql, out="result"):
    def run(spark, sf_dir):
        return messages(spark, sf_dir).select("message_id", fn(F.col("text")).alias(out))
    QUERIES[name] = run
    ORACLE[name] = with_views(f"SELECT message_id, {sql} AS {out} FROM messages", "messages")


_text_query("strip_diacritics", T.strip_diacritics, sql_plain("text"))
_text_query("remove_invisible", T.remove_invisible, sql_hidden("text"))
_text_query("fold_homoglyphs", T.fold_homoglyphs, sql_looks("text"))
_text_query("fold_leet", T.fold_leet, sql_leet("text"))
_text_query("collapse_repeats", T.collapse_repeats, _collapse_sql())
_text_query("normalize", T.normalize, sql_norm("text"))
_text_query("squeeze", T.squeeze, f"replace({sql_norm('text')}, ' ', '')")
_text_query("normalize_keep_accents", T.normalize_keep_accents, sql_keep("text"))
_text_query("squeeze_keep_accents", T.squeeze_keep_accents,
            f"replace({sql_keep('text')}, ' ', '')")

OBFUSCATION = rf"""
  CASE WHEN regexp_matches(text, '[\x{{200B}}-\x{{200F}}\x{{AD}}\x{{FEFF}}]') THEN 3 ELSE 0 END
  + CASE WHEN fakes > 0 AND fakes >= greatest(2, latin // 10) THEN 3 ELSE 0 END
  + CASE WHEN regexp_matches(text, '([{_W}][-._*|]){{4}}[{_W}]') THEN 2 ELSE 0 END"""
COUNTED = """(SELECT *, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS latin,
  length(regexp_replace(lower(text), '[^авсеѕһіјкмнортухԁɡναβεικορτυχϲ]', '', 'g')) AS fakes
  FROM messages)"""


@query("obfuscation_score", with_views(
    f"SELECT message_id, CAST({OBFUSCATION} AS INTEGER) AS points FROM {COUNTED}", "messages"))
def _obfuscation(spark, sf_dir):
    return messages(spark, sf_dir).select(
        "message_id", T.obfuscation_score("text").alias("points"))


QUESTION_SQL = r"""
  regexp_matches(n, '\bco\b.{0,40}\b(khong|ko|k|hong|hem)\b')
  OR regexp_matches(n, '\b(phai|dung|that|hay) khong\b|\bco that\b|\bthuc hu\b')
  OR regexp_matches(n, '\b(cho (minh |em )?hoi|xin hoi|hoi chut|ai biet|ai tung)\b')
  OR regexp_matches(n, '\b(ad|admin|anh chi|moi nguoi) oi\b')
  OR regexp_matches(n, '\b(the nao|nhu nao|sao vay|tai sao|vi sao|co nen|nen khong)\b')
  OR regexp_matches(n, '\b(vay a|vay ta|ha ban|nhi|the a)$')"""


@query("looks_like_question", with_views(
    f"SELECT message_id, contains(text, '?') OR {QUESTION_SQL} AS asks "
    f"FROM (SELECT message_id, text, {sql_norm('text')} AS n FROM messages)", "messages"))
def _question(spark, sf_dir):
    return messages(spark, sf_dir).select(
        "message_id", T.looks_like_question("text").alias("asks"))
