import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(*ids, tag="w"):
    return " ".join(f"{tag}{i}" for i in ids)


@pytest.fixture(scope="session")
def docs(spark):
    """Nulls, empty and very long texts, repeated rows, ties and copies."""
    long = words(*range(30_000), tag="x")
    base = words(*range(60))
    edited = words(*[i if i != 59 else 999 for i in range(60)])
    other = words(*range(100, 160))
    passage = words(*range(500, 560), tag="p")
    rows = [
        (1, base, "en", "a", 1), (2, base, "en", "a", 1), (2, base, "en", "a", 1), (3, edited, "en", "b", 1), (4, None, "en", None, None),
        (5, "", None, "a", 0), (6, long, "de", "b", 1), (None, other, "en", "a", 1), (7, "one two", "en", "b", 1), (8, "ONE  two\n", "en", None, 1),
        (9, f"{other}\n{passage}\nTail", "en", "c", 1), (10, f"head\n{passage}", "en", "c", 1), (11, "###$$$ a|b <x>", "en", "c", 1),
        (12, "same line here\nsame line here\n\nsame line here", "en", "d", 1),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
