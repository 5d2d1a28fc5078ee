"""Rules that look entities up compute the features they need, and no others."""

import pytest

from quietroom.checks.base import QUERIES
from quietroom.plans import moderate


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Enough customers that the allow lists are looked up as tables."""
    folder = str(tmp_path_factory.mktemp("tables"))
    docs = [(i, f"plain words of text number {i}", "en", "web", 30) for i in range(80)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(
        f"{folder}/documents.parquet")
    customers = [(i, f"Customer#{i:09d}", i % 25) for i in range(1, 601)]
    spark.createDataFrame(customers, "c_custkey long, c_name string, c_nationkey long").write.parquet(
        f"{folder}/customer.parquet")
    spark.createDataFrame([(1, "https://docs.example.org/en", "<p>")], "page_id long, url string, html string").write.parquet(
        f"{folder}/pages.parquet")
    return folder


@pytest.mark.parametrize("name, reasons", [
    ("rule_unknown_link", {3: "unknown_link: promo-site.xyz/win", 4: "unknown_link: tinyurl.com/abc123"}),
    ("rule_mentions", {48: "unknown_mention: @customer_000000048, @helper_two"}),
    ("rule_phone", {7: "unknown_phone: +84912345678, 0900000007", 67: "unknown_phone: +84912345678, 0900000067"}),
    ("rule_new_member_link", {3: "newcomer_link", 33: "newcomer_link"}),
    ("rule_qr_payload", None),
])
def test_only_what_a_rule_needs_is_staged(spark, tables, monkeypatch, name, reasons):
    seen = []

    def recorded(df):
        seen.append(set(df.columns))
        return staged(df)

    staged = moderate.staged
    monkeypatch.setattr(moderate, "staged", recorded)
    found = {r["message_id"]: r["reason"] for r in QUERIES[name](spark, tables).collect()}
    features = [s for s in seen if "_row" in s and "urls" in s]
    assert features, "the lists were short enough for a bundle"
    for columns in features:
        assert not {c for c in columns if c.startswith("t_") or c.endswith("_hits")}
        assert ("has_words" in columns) == (name == "rule_phone")
    for message, reason in (reasons or {}).items():
        assert found[message] == reason
