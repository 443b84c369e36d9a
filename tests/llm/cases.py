"""Rows that every text operator has to take."""

from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"

TEXTS = [
    (1, "The quick brown fox jumps over the lazy dog again and again."),
    (2, "The quick brown fox jumps over the lazy dog again and again."),
    (2, "The quick brown fox jumps over the lazy dog again and again."),
    (3, ""),
    (4, None),
    (5, " \t\n \r\n"),
    (6, "word " * 3000),
    (7, "x" * 5000),
    (8, "çé 日本語 👍🏽 \x00 end"),
    (9, "one"),
]


def documents(spark, texts=TEXTS):
    rows = [(i, t, None, None, None if t is None else len(t)) for i, t in texts]
    return spark.createDataFrame(rows, SCHEMA)


def clashing(df):
    """More columns, with names that operators might use themselves."""
    names = ["id", "t", "fp", "component_id", "key", "block", "score", "features", "leaks", "ids",
             "n", "n_lines", "_row", "probability", "doc", "dh", "runs", "blocked", "p",
             "_doc", "_dh", "_gone", "_kept", "kept", "gone", "y", "_id", "_t", "_url", "_day",
             "capture_url", "node", "root", "v"]
    for name in names:
        df = df.withColumn(name, F.lit(7))
    return df
