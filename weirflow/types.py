"""Arrow types <-> Spark types, and the casts that make a batch readable for Spark.

Spark has no unsigned integers, second- or millisecond times, or nanosecond durations, and takes no
dictionaries; each widens to the smallest Spark type that holds all its values.  Categorical columns
are strings with ``categorical`` in their metadata; unsigned and wide types keep their name in ``arrow``.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import types as T

from .errors import FormatError

_PLAIN = {
    pa.int8(): T.ByteType(), pa.int16(): T.ShortType(), pa.int32(): T.IntegerType(), pa.int64(): T.LongType(), pa.float32(): T.FloatType(), pa.float64(): T.DoubleType(),
    pa.bool_(): T.BooleanType(), pa.string(): T.StringType(), pa.large_string(): T.StringType(), pa.binary(): T.BinaryType(), pa.large_binary(): T.BinaryType(), pa.date32(): T.DateType(),
}
_WIDER = {pa.uint8(): pa.int16(), pa.uint16(): pa.int32(), pa.uint32(): pa.int64(), pa.uint64(): pa.decimal128(20, 0), pa.date64(): pa.timestamp("us"), pa.time32("s"): pa.time64("us"), pa.time32("ms"): pa.time64("us"), pa.time64("ns"): pa.time64("us")}


def readable(t: pa.DataType) -> pa.DataType:
    """The Arrow type that Spark is given for ``t``."""
    if t in _WIDER:
        return _WIDER[t]
    if pa.types.is_dictionary(t):
        if not (pa.types.is_string(t.value_type) or pa.types.is_large_string(t.value_type)):
            raise FormatError(f"unsupported dictionary of {t.value_type}")
        return pa.string()
    if pa.types.is_timestamp(t):
        return pa.timestamp("us", tz=t.tz)
    if pa.types.is_duration(t):
        return pa.duration("us")
    if pa.types.is_float16(t) or pa.types.is_null(t) or pa.types.is_union(t):
        raise FormatError(f"unsupported type {t}")
    return t


def spark_type(t: pa.DataType) -> T.DataType:
    r = readable(t)
    if r in _PLAIN:
        return _PLAIN[r]
    if pa.types.is_timestamp(r):
        return T.TimestampType() if r.tz else T.TimestampNTZType()
    if pa.types.is_duration(r):
        return T.DayTimeIntervalType()
    if pa.types.is_time(r):
        return T.TimeType(6)
    if pa.types.is_decimal(r):
        return T.DecimalType(r.precision, r.scale)
    if pa.types.is_list(r) or pa.types.is_large_list(r):
        return T.ArrayType(spark_type(r.value_type))
    if pa.types.is_struct(r):
        return T.StructType([T.StructField(f.name, spark_type(f.type), f.nullable) for f in r])
    if pa.types.is_map(r):
        return T.MapType(spark_type(r.key_type), spark_type(r.item_type))
    raise FormatError(f"unsupported type {t}")


def spark_schema(schema: pa.Schema) -> T.StructType:
    """Fields with their nullability and metadata."""
    out = []
    for f in schema:
        meta = {k.decode(): v.decode() for k, v in (f.metadata or {}).items()}
        if pa.types.is_dictionary(f.type):
            meta |= {"categorical": "true", "index": str(f.type.index_type)}
        elif f.type in _WIDER or pa.types.is_duration(f.type):
            meta["arrow"] = str(f.type)
        out.append(T.StructField(f.name, spark_type(f.type), f.nullable, meta))
    return T.StructType(out)


def _cast(column: pa.Array, to: pa.DataType) -> pa.Array:
    if column.type == to:
        return column
    if pa.types.is_dictionary(column.type):
        return column.dictionary_decode().cast(to)
    if column.type == pa.uint64():
        return column.cast(pa.decimal128(20, 0))
    return column.cast(to)  # a value that does not fit, such as a duration below a microsecond, is an error


def readable_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The batch with every column cast to its readable type; nulls stay nulls."""
    kinds = [readable(f.type) for f in batch.schema]
    columns = [_cast(c, k) for c, k in zip(batch.columns, kinds, strict=True)]
    return pa.RecordBatch.from_arrays(columns, schema=pa.schema([pa.field(f.name, k, f.nullable) for f, k in zip(batch.schema, kinds, strict=True)]))


def arrow_schema(schema: T.StructType) -> pa.Schema:
    """The Arrow schema in which a DataFrame is written; fields marked categorical become dictionaries."""
    from pyspark.sql.pandas.types import to_arrow_type

    out = []
    for f in schema:
        kind = to_arrow_type(f.dataType)
        meta = {k: str(v) for k, v in (f.metadata or {}).items() if k not in ("categorical", "index", "arrow")}
        if (f.metadata or {}).get("categorical"):
            kind = pa.dictionary(pa.int32(), pa.string())
        out.append(pa.field(f.name, kind, f.nullable, meta or None))
    return pa.schema(out)
