"""Small document tables with the cases that every operator must handle."""

LONG = "word and more words, " * 20_000


def edge_docs(spark):
    """Nulls, empty and very long texts, repeated rows, extra columns whose names are those of results."""
    rows = [
        (1, "The cat sat on the mat and the dog ran away from the house today.", "en", "a", 1), (2, "", "en", "a", 0), (3, None, None, None, None), (4, LONG, "en", None, 9),
        (5, "The cat sat on the mat and the dog ran away from the house today.", "fr", "b", 1), (5, "The cat sat on the mat and the dog ran away from the house today.", "fr", "b", 1),
        (None, "no key here", "en", "c", 3), (None, None, None, None, None), (6, "12 345 ... !!", "de", "c", 2), (7, "日本語 text — mixed 😀 <|endoftext|> end", "ja", "c", 4),
    ]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    extra = {c: df.n_chars for c in ("score", "key", "n_tokens", "fp", "component_id", "media", "n", "label", "fold", "features", "hash", "pos", "item", "ids", "part", "length", "row", "weight", "a.b", "found_name", "copy", "stay_who", "who", "root")}
    return df.withColumns(extra)


def empty_docs(spark):
    return spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint")
