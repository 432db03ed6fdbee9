"""Canonical columns and nested types shared by all operators."""

from pyspark.sql import types as T

PAIR_TEXTS = ("input_text", "target_text", "original", "corrected")
PAIR_COLUMNS = ("sent_id", "source", *PAIR_TEXTS)

PAIRS = T.StructType(
    [T.StructField("sent_id", T.LongType()), T.StructField("source", T.StringType())]
    + [T.StructField(c, T.StringType()) for c in PAIR_TEXTS]
)

#: One edit as produced by alignment; offsets are token positions.
SPAN = T.StructType(
    [
        T.StructField("o_start", T.IntegerType()),
        T.StructField("o_end", T.IntegerType()),
        T.StructField("c_start", T.IntegerType()),
        T.StructField("c_end", T.IntegerType()),
        T.StructField("o_str", T.StringType()),
        T.StructField("c_str", T.StringType()),
    ]
)

#: One edit as stored in an M2 file.
M2_EDIT = T.StructType(
    [
        T.StructField("o_start", T.IntegerType()),
        T.StructField("o_end", T.IntegerType()),
        T.StructField("type", T.StringType()),
        T.StructField("c_str", T.StringType()),
    ]
)

#: Character edits: parallel arrays of start, end and replacement.
CHAR_EDITS = T.StructType(
    [
        T.StructField("start", T.ArrayType(T.IntegerType())),
        T.StructField("end", T.ArrayType(T.IntegerType())),
        T.StructField("text", T.ArrayType(T.StringType())),
    ]
)
