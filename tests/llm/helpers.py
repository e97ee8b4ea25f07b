"""Odd rows that every operator has to take."""

LONG = "x" * 30_000
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score string, n_words string, row string, _h string, d string, host string, html string, hits int, gone string"


def odd_rows():
    """Null ids, texts and sources, empty and blank texts, one very long word and one very long text, repeated rows."""
    body = "the quick brown fox jumps over the lazy dog and runs far away from all of it " * 3
    rows = [
        (None, body, None, None), (None, None, None, None), (1, None, "en", "a"), (2, "", "en", "a"), (3, " \n\t\n ", "en", "b"), (4, LONG, "en", "b"),
        (5, body, "en", None), (5, body, "en", None), (6, body + "end", "de", "a"), (6, "another text for the same id", "de", "a"), (7, "\n".join([body.strip()] * 400), "fr", "c"),
        (8, "short", "fr", "c"), (9, "İstanbul ß ﬁ 日本語 👋 ́ <|endoftext|> \x00 &amp;", "fr", "c"),
    ]
    return [(i, t, lang, s, None if t is None else len(t), "own", "own", "own", "own", "own", "own", "<p>own</p>", 1, "own") for i, t, lang, s in rows]


def odd_docs(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
