"""Rows that every operator must handle: nulls, empty and long texts, ties, repeats, extra columns."""

from __future__ import annotations

LONG = "alpha beta gamma delta " * 20000
EDGE = [
    (1, "The quick brown fox jumps over the lazy dog and runs far away from here today.\nA shared line of text.", "en", "src0", 10),
    (2, "a shared LINE of text.  \nsomething else entirely\n\n", "en", None, None),
    (3, None, None, "src1", None),
    (4, "", "de", "src1", 0),
    (5, LONG, "en", "src0", len(LONG)),
    (6, LONG, "en", "src2", len(LONG)),
    (7, "\n\n \t\n", None, "src3", 5),
    (8, "é🤗ß 漢字 \u0000 ﬁ", "fr", "elsewhere", 9),
    (8, "é🤗ß 漢字 \u0000 ﬁ", "fr", "elsewhere", 9),
    (None, "A shared line of text.", "en", "src0", 1),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def edge(spark, extra: bool = True):
    """EDGE with columns whose names operators also use."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(EDGE, SCHEMA)
    for name in ("copy", "kept", "fp", "doc", "shard", "n", "w", "mean", "piece_ids", "n_pii", "label") if extra else ():
        df = df.withColumn(name, F.lit("x"))
    return df


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
