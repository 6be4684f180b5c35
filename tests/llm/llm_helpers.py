"""Small tables for the tests of the training-data operators."""

from pyspark.sql import types as T

DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("id", T.StringType()),  # names that operators use inside
        T.StructField("k", T.StringType()),
        T.StructField("_row", T.StringType()),
    ]
)


def documents(spark, rows):
    """Rows of (doc_id, text[, lang, source]) with clashing extra columns."""
    full = [(*r, *[None] * (4 - len(r)), "x", None, "y") for r in rows]
    return spark.createDataFrame(full, DOCS)


def vectors(spark, rows):
    kind = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("id", T.IntegerType())])
    return spark.createDataFrame([(*r, 1) for r in rows], kind)
