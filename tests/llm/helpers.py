"""Small documents tables with the awkward cases that every operator must take."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "".join(f"word{i * i % 977} " for i in range(20_000))
AWKWARD = [
    (1, "Hello world, it's 3 o'clock.", "en", "a", 28),
    (2, None, None, None, None),
    (3, "", "en", "b", 0),
    (4, "   \t\n ", "en", "b", 6),
    (5, "été naïve ßtraße 中文字 日本語 😀 ͸ x\x1cy\x85z", "fr", "a", 40),
    (6, "a <|endoftext|> b<|endoftext|>", "en", "a", 30),
    (6, "a <|endoftext|> b<|endoftext|>", "en", "a", 30),
    (None, "null key", "en", "c", 8),
    (7, LONG, "en", "a", len(LONG)),
    (8, "x" * 30_000, "en", "a", 30_000),
]


def awkward(spark):
    return spark.createDataFrame(AWKWARD, DOCS)


def clashing(df):
    """Extra columns with names that operators use themselves."""
    from pyspark.sql import functions as F

    for name in ("key", "ids", "n", "hash", "size", "token", "score", "bucket", "position", "kept", "component_id", "n_tokens", "_key", "_k", "_all", "_rows", "_n", "_source", "_size", "_row", "_cls", "_at", "_sha", "_kept"):
        df = df.withColumn(name, F.lit("clash"))
    return df
