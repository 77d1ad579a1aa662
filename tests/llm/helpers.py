"""Fixtures with nulls, empties, ties, repeated rows and clashing column names."""

from pyspark.sql import types as T

DOCS = T.StructType(
    [T.StructField(c, t) for c, t in (("doc_id", T.LongType()), ("text", T.StringType()), ("lang", T.StringType()), ("source", T.StringType()), ("n_chars", T.LongType()))]
    # names that operators might use themselves
    + [T.StructField(c, T.StringType()) for c in ("id", "row", "rn", "run", "digest", "norm", "fp", "size", "keep", "component", "piece")]
)
EXTRA = ("x",) * 11


def docs(spark, rows):
    """rows: (doc_id, text[, lang[, source]])."""
    full = [(*r, *(None,) * (4 - len(r)), None, *EXTRA) for r in rows]
    return spark.createDataFrame(full, DOCS).repartition(3)


ODD = [
    (1, "alpha beta gamma delta epsilon", "en", "a"),
    (2, "alpha  beta\tgamma\ndelta epsilon", "en", "a"),
    (3, None, None, None),
    (4, "", "en", "b"),
    (5, " \n ", None, "b"),
    (6, "word " * 30_000, "en", "a"),
    (7, "Zoë café naïve façade 日本", "fr", "c"),
    (7, "Zoë café naïve façade 日本", "fr", "c"),
    (None, "alpha beta gamma delta epsilon", "en", "a"),
    (None, None, None, None),
]
