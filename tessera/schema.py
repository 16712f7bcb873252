"""Schemas of the index tables."""

from pyspark.sql.types import ArrayType, BinaryType, BooleanType, IntegerType, LongType, StringType, StructField, StructType

_TYPES = {"s": StringType(), "b": BinaryType(), "l": LongType(), "i": IntegerType(), "t": BooleanType()}


def _struct(fields: str) -> StructType:
    return StructType([StructField(n, _TYPES[t]) for n, t in (f.split(":") for f in fields.split())])


FILES = _struct("path:s hash:s content:b")
SYMBOLS = _struct("id:s path:s name:s kind:s byte_offset:l byte_length:l ord:i body_start:l body_end:l")
SYMBOL_ARRAY = ArrayType(_struct("name:s qualified_name:s kind:s start:l end:l body_start:l body_end:l ord:i last:t"))
