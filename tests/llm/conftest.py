import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, rule string, n_words int, epoch string, shard string"
SF = "/root/testdata/sf0.001"


def row(doc_id, text, lang="en", source="a"):
    return (doc_id, text, lang, source, None if text is None else len(text), None, "x", 7, "e", "s")


PROSE = "the quick brown fox jumps over the lazy dog and then some more words follow here so that this text is long enough to count as one document "


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, columns named as results are."""
    long = " ".join(f"word{i % 5000} and{i}" for i in range(60_000))
    rows = [
        row(1, PROSE * 3),
        row(1, PROSE * 3),
        row(2, PROSE * 3),
        row(3, None),
        row(4, ""),
        row(5, " \t\n\x0b\x0c\r "),
        row(6, "one"),
        row(7, "one two three four"),
        row(8, long),
        row(9, None, None, None),
        row(None, PROSE * 3),
        row(None, None, None, None),
        (10, PROSE * 3 + "extra tail", None, None, None, None, None, None, None, None),
        row(11, "ünïcödé ßtraße 東京都 " * 20, "de", "b"),
        row(12, "x" * 100_000, "xx", "b"),
        row(13, "!!! ??? 123 456", "en", "b"),
    ]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
