import pytest

# Awkward rows: nulls, empty and blank texts, repeated rows, ties, an id without text, and columns whose names operators use inside.
LONG = " ".join(f"w{n}" for n in range(30_000))
PASSAGE = " ".join(f"passage{n % 37}x{n}" for n in range(60))
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog again and again", 9),
    (2, "The quick brown fox jumps over the lazy dog again and again", 9),
    (2, "The quick brown fox jumps over the lazy dog again and again", 9),
    (3, None, 1), (4, "", 2), (5, " \t\n", 3), (None, None, None), (None, "a text without an id", 4),
    (6, LONG, 5), (7, LONG + " tail", 6),
    (8, "before " + PASSAGE + " after it", 7), (9, "other words here " + PASSAGE + " and more after", 8),
    (10, "under the MIT License or CC-BY, not the GNU General Public License", 1), (11, "one", 1), (12, "one", 1), (13, "  one ", 1),
    (14, "ÀÉ ▁ 日本語 \x00 🎉 " + "a" * 3000, 2),
]


def with_clashes(df):
    """Extra columns under names that operators use for their own."""
    names = ["content", "digest", "kept", "node", "n", "words", "token", "label", "score", "spans", "row", "component", "key", "id"]
    return df.selectExpr("doc_id", "text", *(f"n AS {name}" for name in names))


@pytest.fixture(scope="session")
def docs(spark):
    return with_clashes(spark.createDataFrame(ROWS, "doc_id bigint, text string, n int"))


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.limit(0)


@pytest.fixture(scope="session")
def benchmark(spark):
    items = [(1, PASSAGE), (1, PASSAGE), (2, "lazy dog"), (3, None), (4, ""), (None, "one"), (5, " ".join(f"w{n}" for n in range(100, 140)))]
    return spark.createDataFrame(items, "item_id bigint, text string")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(n, n % 2, n % 2) for n in range(1, 15)] + [(None, 1, 1), (3, None, None)], "doc_id bigint, quality int, toxic int")
