"""Small documents with every odd case."""

ODD = [
    (1, "The quick brown fox jumps over the lazy dog.", "en"),
    (2, None, "en"),
    (3, "", None),
    (4, "it's we'll 'sand !'s  two  blanks\n\n\tand ünïcödé ΣΑΣ 日本語 ½ 👍🏽 <|endoftext|> x", "de"),
    (4, "it's we'll 'sand !'s  two  blanks\n\n\tand ünïcödé ΣΑΣ 日本語 ½ 👍🏽 <|endoftext|> x", "de"),
    (None, "a row without id", "fr"),
    (7, "long words " * 3000, "en"),
    (8, "x" * 5000, "es"),
    (9, "12345 %%% ***", "en"),
]


def odd(spark, rows=None):
    return spark.createDataFrame(ODD if rows is None else rows, "doc_id long, text string, lang string").selectExpr("*", "'c' AS node", "1 AS id", "2 AS score", "3 AS label", "4 AS key")


def none(spark):
    return odd(spark, [])
