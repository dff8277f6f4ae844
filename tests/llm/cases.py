"""Documents that every corpus operator has to take."""

from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("score", T.StringType()), T.StructField("_words", T.StringType())])
LONG = "the quick brown fox jumps over the lazy dog und der hund schläft " * 3000


def rows():
    texts = [None, "", "   ", "...", "One.", "Licensed under CC BY-NC 4.0. All rights reserved.", "Licensed under CC BY-NC 4.0. All rights reserved.", LONG, LONG + " tail", "Über \U0001f600 漢字 <|endoftext|> it's 12½\x00\xa0x", "a\nb\n\nc the general\npublic -- LICENSE\n" * 4]
    found = [(i, t, ("en", "de", None)[i % 3], ("s1", "s2", None)[i % 3], None if t is None else len(t), "x", "y") for i, t in enumerate(texts)]
    return [*found, (None, "no id here", None, None, None, None, None), found[5]]


def frame(spark, some=None):
    return spark.createDataFrame(rows() if some is None else some, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
