"""Short forms of data types. Types of module-level UDFs are objects: text forms need a session to be parsed."""

from __future__ import annotations

from pyspark.sql import types as T

TEXT, NUMBER, WHOLE = T.StringType(), T.DoubleType(), T.IntegerType()
TEXTS = T.ArrayType(TEXT)


def struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, t) for k, t in fields.items()])
