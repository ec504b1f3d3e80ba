import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty, blank and very long texts, equal texts, repeated rows, a repeated doc_id, clashing names."""
    text = "der hund und die katze sitzen auf der matte vor dem haus und warten lange auf den regen der heute nicht kommt. "
    rows = [
        (1, text * 3, "de", "a", 5),
        (2, text * 3, "de", "a", 5),
        (3, None, None, None, None),
        (4, "", "en", "b", 0),
        (5, " \n\t ", "en", None, 4),
        (6, "the cat " * 30_000, "en", "b", 1),
        (7, text.upper(), None, "c", 2),
        (8, "kurz", "de", "a", 4),
        (None, text + "ende", "de", "a", 1),
        (9, text * 2 + "neun", "de", "a", 3),
        (9, text * 2 + "anders", "de", "b", 3),
        (10, "日本語 \U0001f600 é", "ja", "a", 5),
        (10, "日本語 \U0001f600 é", "ja", "a", 5),
    ]
    names = ["row", "ord", "hash", "marks", "votes", "node", "copies", "rank", "size", "key", "a", "_h", "n_words", "position", "slot"]
    schema = DOCS + ", " + ", ".join(f"`{n}` string" for n in names)
    return spark.createDataFrame([(*r, *["x"] * len(names)) for r in rows], schema)


@pytest.fixture(scope="session")
def none(spark, odd):
    return odd.limit(0)
