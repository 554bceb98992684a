"""A small table with everything that may go wrong in it."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, spans string, ids string, keys string, n_words int"

LONG = "the boats came back from the strait before dawn and nobody had counted them " * 4000


def documents(spark, texts=()):
    """Nulls in every column, empty, blank and very long texts, repeated rows, clashing extra columns, and ``texts``."""
    rows = [
        (1, None, None, None, None, None, None, None, None),
        (2, "", "en", "a", 0, "x", "x", "x", 1),
        (3, " \t\n ", "en", "a", 4, "x", "x", "x", 1),
        (4, LONG, "en", "a", len(LONG), "x", "x", "x", 1),
        (5, LONG, "en", "b", len(LONG), "x", "x", "x", 1),
        (5, LONG, "en", "b", len(LONG), "x", "x", "x", 1),
        (None, "a text without an id, but with some words in it", "en", "b", 46, "x", "x", "x", 1),
        (7, "été \U0001f600 ß 漢字 \u0000 end", "fr", "b", 16, "x", "x", "x", 1),
    ]
    rows += [(100 + i, t, "en", "t", len(t), "x", "x", "x", 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
