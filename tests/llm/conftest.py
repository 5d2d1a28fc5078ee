import pytest
@pytest.fixture(scope="session")
def documents(spark):
    """Build a document table; every row may leave columns out, and clashing columns are added."""
    def make(rows, clash=False):
        schema = "doc_id long, text string, lang string, source string, n_chars long"
        full = [tuple(list(r) + [None] * (5 - len(r))) for r in rows]
        df = spark.createDataFrame(full, schema)
        if clash:
            from pyspark.sql import functions as F
            for name in ("size", "h", "kept", "start", "node", "score", "range", "token", "n", "id", "rank", "_key"):
                df = df.withColumn(name, F.lit("x"))
        return df
    return make


ODD = [
    (1, "a b c d e f g"), (2, "a  b\tc\nd e f g"), (3, None), (4, ""), (5, " \n "), (6, "word"),
    (7, "A b C d e f g"), (8, "x" * 20000), (9, "long text " * 5000), (9, "long text " * 5000),
    (None, "no id here"), (None, "a b c d e f g"), (10, "é ü ñ ça"), (11, "▁ odd ▁"),
]


@pytest.fixture(scope="session")
def odd():
    return [(i, t, "en" if t and len(t) % 2 else None, f"s{len(t or '') % 3}" if t else None, 0) for i, t in ODD]


@pytest.fixture(scope="session")
def sf(spark):
    return "/root/testdata/sf0.001"
