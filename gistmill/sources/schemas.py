"""Schemas of the tables this package reads and writes."""

from pyspark.sql.types import IntegerType, StringType, StructField, StructType

UTTERANCES = StructType(
    [
        StructField("corpus_name", StringType()),
        StructField("conv_id", StringType()),
        StructField("res_id", IntegerType()),
        StructField("question_text", StringType()),
        StructField("answer_text", StringType()),
    ]
)
RESPONSES = StructType(UTTERANCES.fields[1:])
REVIEWS = StructType([StructField("asin", StringType()), StructField("content", StringType())])
