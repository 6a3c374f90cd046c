"""Rows that every operator on documents must bear: nulls, empty and long texts, ties, repeated rows, clashing names."""

LONG = " ".join(f"word{i % 977} of the length {i}" for i in range(12_000))
ROWS = [
    (0, None, None, None, None, "a"),
    (1, "", "en", "s", 0, "b"),
    (2, " \t\n\r ", "en", "s", 5, "c"),
    (3, LONG, "en", "s", 1, None),
    (4, "the cat sat on the mat and it was as it is in the house", "en", "s", 1, "d"),
    (5, "the cat sat on the mat and it was as it is in the house", "en", "s", 1, "d"),
    (5, "the cat sat on the mat and it was as it is in the house", "en", "s", 1, "d"),
    (6, "日本語 テキスト 😀 ½ ² İstanbul ΑΣ e\u0301", "fr", None, 1, "e"),
    (7, "!!! *** 123 456 ###", None, "s", 1, "f"),
    (None, "le chat est dans la maison et il est sur la table de la cuisine", "fr", "s", 1, "g"),
    (8, "x" * 5000, "de", "s", 1, "h"),
]
#: Names that operators use inside, as extra columns.
EXTRA = ["key", "fp", "words", "kept", "score", "lang_pred", "rank", "length", "component_id"]


def frame(spark, extra=True):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string, n_chars long, key string")
    if extra:
        from pyspark.sql import functions as F

        df = df.withColumns({c: F.lit("clash") for c in EXTRA if c != "key"})
    return df


def empty(spark):
    return frame(spark).limit(0)
