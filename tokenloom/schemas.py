"""Declared schemas.  Readers never infer: inference costs a scan and can drift."""

from pyspark.sql import types as T

QA_RECORD = T.StructType([T.StructField("问", T.StringType()), T.StructField("答", T.StringType())])

#: QA_RECORD plus the raw line of anything that does not parse.
QA_RECORD_CHECKED = T.StructType([*QA_RECORD.fields, T.StructField("_corrupt_record", T.StringType())])

FORUM_BLOCK = T.StructType([T.StructField("文本", T.StringType()), T.StructField("块类型", T.StringType())])

TEXT_ONLY = T.StructType([T.StructField("text", T.StringType())])

NEWS_ARTICLE = T.StructType([T.StructField("title", T.StringType()), T.StructField("text", T.StringType())])

#: One cleaned document; (source_no, doc_ord) is its place in the corpus.
DOCS = T.StructType(
    [
        T.StructField("source_no", T.IntegerType(), False),
        T.StructField("doc_ord", T.LongType(), False),
        T.StructField("text", T.StringType()),
    ]
)

#: One tokenized document.
TOKEN_CACHE = T.StructType(
    [
        T.StructField("source_no", T.IntegerType(), False),
        T.StructField("doc_ord", T.LongType(), False),
        T.StructField("n", T.LongType(), False),
        T.StructField("tokens", T.ArrayType(T.IntegerType(), False), False),
    ]
)

SHARDS = T.StructType(
    [
        T.StructField("split", T.StringType(), False),
        T.StructField("shard", T.LongType(), False),
        T.StructField("n_tokens", T.LongType(), False),
        T.StructField("tokens", T.ArrayType(T.IntegerType(), False), False),
    ]
)

CURSOR = T.StructType(
    [
        T.StructField("step", T.LongType()),
        T.StructField("data_shard", T.LongType()),
        T.StructField("data_position", T.LongType()),
    ]
)
