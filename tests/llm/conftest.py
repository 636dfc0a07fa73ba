import pytest


@pytest.fixture
def docs(spark):
    """Rows that an operator must survive: nulls in every column, empty and long texts, ties, repeated rows, columns named like inner ones."""
    long = " ".join(f"w{i % 997}" for i in range(60_000))
    rows = [
        (0, "The cat sat on the mat and looked at the moon for a while tonight", "en", "a", 1),
        (1, " The cat sat on the mat  and looked at the moon for a while tonight", "en", "a", 2),
        (2, None, "en", "b", None),
        (3, "", None, None, 0),
        (4, " \t\n\x0b\x0c\r", "fr", "b", 3),
        (5, long, "en", "a", 4),
        (6, long + " end", "en", "c", 4),
        (7, "été <|endoftext|> L'ÉTÉ İstanbul ΣΑΣ 日本 😀 don't", None, "b", 5),
        (7, "été <|endoftext|> L'ÉTÉ İstanbul ΣΑΣ 日本 😀 don't", None, "b", 5),
        (8, "one", "de", "c", 6),
        (9, "x " * 40 + "mail a.b@c.de call +1 (555) 555-0199 from 10.0.0.1 card 4111 1111 1111 1111", "en", "a", 7),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for extra in ("fp", "node", "key", "d", "th", "size", "rate", "seed", "copies", "mix_rate", "mix_copy", "hit_id", "near_id", "lang_pred", "score", "component", "kept"):
        df = df.withColumn(extra, df.n_chars)
    return df


@pytest.fixture
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
