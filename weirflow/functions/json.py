"""JSON text <-> typed columns, and the mapping of envelopes to records, as column expressions.

Decoding goes through variants: ``parse_json`` keeps each value's own kind and rejects objects that
repeat a key.  A value whose kind does not fit its column follows a policy: ``error``, ``coerce``
(convert if the text allows it, else null) or ``null``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import FormatError
from .csv import FALSE_TOKENS, TRUE_TOKENS, float_text, is_integer

POLICIES = ("error", "coerce", "null")
_LIMITS = {"tinyint": (-128, 127), "smallint": (-32768, 32767), "int": (-(1 << 31), (1 << 31) - 1), "bigint": (-(1 << 63), (1 << 63) - 1), "decimal(20,0)": (0, (1 << 64) - 1)}
_UNSIGNED = {"uint8": ("smallint", 255), "uint16": ("int", 65535), "uint32": ("bigint", (1 << 32) - 1), "uint64": ("decimal(20,0)", (1 << 64) - 1)}


def dotted(path: str) -> str:
    """``a.0.b`` -> ``$.a[0].b``: digits are array places, empty parts are dropped."""
    out = "$"
    for part in path.split("."):
        if part:
            out += f"[{part}]" if part.isdigit() else "." + part if part.isidentifier() else f"['{part}']"
    return out


def kind_of(v: Column) -> Column:
    """BIGINT, DECIMAL, DOUBLE, BOOLEAN, STRING, VOID, OBJECT or ARRAY; null if there is no value."""
    return F.regexp_extract(F.schema_of_variant(v), r"^([A-Z]+)", 1)


def typed(v: Column, t: T.DataType, policy: str = "error", where: str = "", unsigned: str | None = None) -> Column:
    """A variant value as type ``t``.

    Integers take booleans (0, 1) and whole floats in every policy, floats take integers and booleans,
    booleans take any number (not 0); strings become numbers or booleans, and scalars strings, only
    under ``coerce``.  Dates take integers (days).  Objects and arrays never fit.
    """
    if policy not in POLICIES:
        raise ValueError(f"unknown policy '{policy}'")
    kind = kind_of(v)
    string = F.when(kind == "STRING", F.try_variant_get(v, "$", "string"))
    flag = F.when(kind == "BOOLEAN", F.try_variant_get(v, "$", "boolean"))
    number = F.when(kind.isin("BIGINT", "DECIMAL", "DOUBLE"), F.try_variant_get(v, "$", "double"))
    name = t.simpleString()
    if isinstance(t, T.DateType):
        whole = F.when(kind == "BIGINT", F.try_variant_get(v, "$", "int"))
        value = F.date_from_unix_date(whole)
    elif isinstance(t, (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.DecimalType)):
        low, high = (0, _UNSIGNED[unsigned][1]) if unsigned else _LIMITS.get(name, (None, None))
        wide = T.DecimalType(38, 0)
        exact = F.when(kind == "BIGINT", F.try_variant_get(v, "$", "bigint").cast(wide))
        from_float = F.when(kind.isin("DECIMAL", "DOUBLE") & (number == F.floor(number)), F.try_variant_get(v, "$", "decimal(38,0)"))
        value = F.coalesce(exact, from_float, flag.cast("int").cast(wide))
        if policy == "coerce":
            value = F.coalesce(value, F.when(is_integer(string), string.try_cast(wide)))
        if low is not None:
            value = F.when((value >= F.lit(low).cast(wide)) & (value <= F.lit(high).cast(wide)), value)
        value = value.cast(t)
    elif isinstance(t, (T.FloatType, T.DoubleType)):
        value = F.coalesce(number, flag.cast("int").cast("double"))
        if policy == "coerce":
            value = F.coalesce(value, string.try_cast("double"))
        value = value.cast(t)
    elif isinstance(t, T.BooleanType):
        value = F.coalesce(flag, number != 0)
        if policy == "coerce":
            value = F.coalesce(value, F.when(string.isin(*[x for x in TRUE_TOKENS if x in ("true", "1", "t", "T")]), True).when(string.isin(*[x for x in FALSE_TOKENS if x in ("false", "0", "f", "F")]), False))
    elif isinstance(t, T.StringType):
        value = string
        if policy == "coerce":
            value = F.coalesce(value, F.when(~kind.isin("OBJECT", "ARRAY", "VOID"), F.to_json(v)))
    else:
        raise FormatError(f"unsupported type {name}")
    if policy == "error":
        value = F.coalesce(value, F.when(kind.isNotNull() & (kind != "VOID"), F.raise_error(F.concat(F.lit(f"{where}: expected {name}, found "), F.to_json(v))).cast(t)))
    return value


def decode_rows(df: DataFrame, column: str, schema: T.StructType, policy: str = "error", keep: Sequence[str] = ()) -> DataFrame:
    """Columns of the JSON objects in ``column``.

    Unknown keys are dropped, missing keys are null; text that is no JSON object, or repeats a key, is an error.
    """
    v = df.withColumn("_v", F.parse_json(column))
    kind = F.coalesce(kind_of(F.col("_v")), F.lit("VOID"))
    checked = F.when(kind == "OBJECT", F.col("_v")).otherwise(F.raise_error(F.lit("expected a JSON object")).cast("variant"))
    v = v.withColumn("_v", checked)
    out = []
    for f in schema:
        value = F.try_variant_get("_v", f"$['{f.name}']" if not f.name.isidentifier() else f"$.{f.name}", "variant")
        out.append(typed(value, f.dataType, policy, f"column {f.name}", (f.metadata or {}).get("arrow")).alias(f.name, metadata=f.metadata or {}))
    return v.select(*keep, *out)


def read_ndjson(spark: SparkSession, path, schema: T.StructType | None, policy: str = "error") -> DataFrame:
    """Newline-delimited objects; blank lines are skipped.  Files are split at line breaks."""
    if schema is None:
        raise FormatError("reading JSON needs a schema")
    lines = spark.read.text(path).filter(F.regexp_like("value", F.lit(r"\S")))
    return decode_rows(lines, "value", schema, policy)


def read_json_array(spark: SparkSession, path, schema: T.StructType | None, policy: str = "error") -> DataFrame:
    """Files that are one array of objects each; a file is one split."""
    if schema is None:
        raise FormatError("reading JSON needs a schema")
    docs = spark.read.text(path, wholetext=True)
    return decode_rows(elements(docs, "value"), "value", schema, policy)


def elements(df: DataFrame, column: str, keep: Sequence[str] = ()) -> DataFrame:
    """One row with ``value`` (JSON text) for each element of the arrays in ``column``."""
    arrays = df.select(*keep, F.variant_get(F.parse_json(column), "$", "array<variant>").alias("_a"))
    return arrays.select(*keep, F.explode("_a").alias("_e")).select(*keep, F.to_json("_e").alias("value"))


# -- encoding


def json_string(c: Column) -> Column:
    """A string literal: quotes, backslashes and control characters escaped, the latter as lower-case ``\\u00xx``."""
    s = F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    plain = s
    for ch, to in (("\b", "\\b"), ("\t", "\\t"), ("\n", "\\n"), ("\f", "\\f"), ("\r", "\\r")):
        s = F.replace(s, F.lit(ch), F.lit(to))
    for k in range(32):
        if chr(k) not in "\b\t\n\f\r":
            s = F.replace(s, F.lit(chr(k)), F.lit(f"\\u{k:04x}"))
    return F.concat(F.lit('"'), F.when(F.regexp_like(c, F.lit(r"[\x00-\x1f]")), s).otherwise(plain), F.lit('"'))


def json_value(c: Column, t: T.DataType, exact_floats: bool = True) -> Column:
    """JSON text of a scalar; null where the value is null, not a number or infinite."""
    if isinstance(t, T.StringType):
        return json_string(c)
    if isinstance(t, (T.FloatType, T.DoubleType)):
        finite = c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
        return F.when(finite, float_text(c) if exact_floats else c.cast("string"))
    if isinstance(t, T.DateType):
        return F.unix_date(c).cast("string")
    if isinstance(t, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(c.cast("timestamp")).cast("string")
    return c.cast("string")


def encode_objects(df: DataFrame, include_nulls: bool = True, name: str = "line", exact_floats: bool = True, keep: Sequence[str] = ()) -> DataFrame:
    """Each row as one JSON object; without ``include_nulls`` keys of nulls are left out."""
    parts = []
    for f in df.schema:
        if f.name in keep:
            continue
        text = json_value(F.col(f"`{f.name}`"), f.dataType, exact_floats)
        key = F.concat(json_string(F.lit(f.name)), F.lit(":"))
        parts.append(F.concat(key, F.coalesce(text, F.lit("null"))) if include_nulls else F.when(text.isNotNull() & F.col(f"`{f.name}`").isNotNull(), F.concat(key, text)))
    return df.select(F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}")).alias(name), *keep)


def write_ndjson(df: DataFrame, path: str, include_nulls: bool = True, mode: str = "overwrite") -> None:
    encode_objects(df, include_nulls, "value").write.mode(mode).text(path)


def write_json_array(df: DataFrame, path: str, include_nulls: bool = True, pretty: bool = False, mode: str = "overwrite") -> None:
    """A folder of files that are one array each."""
    left, between = ("  ", ",\n") if pretty else ("", ",")

    def run(batches):
        import pyarrow as pa

        held, opened = None, False
        for b in batches:
            out = []
            for line in b.column("value").to_pylist():
                if held is not None:
                    out.append(held + between)
                elif not opened:
                    out.append("[\n" if pretty else "[")
                    opened = True
                held = left + line
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(["".join(out)])], ["value"])
        yield pa.RecordBatch.from_arrays([pa.array([(held or "[") + ("\n]" if pretty and held else "]")])], ["value"])

    lines = encode_objects(df, include_nulls, "value").mapInArrow(run, "value string")
    lines.write.mode(mode).text(path)


# -- mapping of envelopes


def records(df: DataFrame, column: str, path: str | None = None) -> DataFrame:
    """Adds ``_record``: one row for each record under ``path`` of the envelope in ``column``.

    No such path: no rows (a heartbeat); an array: a row for each element; an object: one row; a scalar
    is an error.  Without a path the envelope itself is the record.
    """
    v = df.withColumn("_frame", F.parse_json(column))
    if not path:
        return v.withColumn("_record", F.col("_frame"))
    at = F.try_variant_get("_frame", dotted(path), "variant")
    kind = kind_of(at)
    found = (
        F.when(kind == "ARRAY", F.try_variant_get("_frame", dotted(path), "array<variant>"))
        .when(kind == "OBJECT", F.array(at))
        .when(kind.isNull() | (kind == "VOID"), F.array().cast("array<variant>"))
        .otherwise(F.raise_error(F.lit(f"{path}: expected an array or an object")).cast("array<variant>"))
    )
    return v.select("*", F.explode(found).alias("_record"))


def field(source: str, at: str, t: T.DataType, read_as: str | None = None, optional: bool = False, dictionary: Sequence[str] = ()) -> Column:
    """A mapped value: ``source`` is record_key, json_path (in the record) or frame_path (in the envelope, the
    same for all its records).  A missing or nested value is an error unless ``optional``.

    ``read_as``: number (quoted or not), bool (words too), datetime (ISO-8601, UTC) or dictionary (the place of
    the text in a fixed list); else verbatim.
    """
    holder = "_frame" if source == "frame_path" else "_record"
    path = f"$['{at}']" if source == "record_key" else dotted(at)
    v = F.try_variant_get(holder, path, "variant")
    kind = kind_of(v)
    text = F.try_variant_get(v, "$", "string")
    if read_as == "number":
        value = text.try_cast("double").cast(t) if not isinstance(t, (T.IntegerType, T.LongType)) else text.try_cast("decimal(38,0)").cast(t)
    elif read_as == "bool":
        value = F.when(text.isin(*TRUE_TOKENS), True).when(text.isin(*FALSE_TOKENS), False)
    elif read_as == "datetime":
        value = F.try_to_timestamp(text)
    elif read_as == "dictionary":
        place = F.array_position(F.array(*map(F.lit, dictionary)), text)
        value = F.when(place > 0, place - 1).cast(t)
    else:
        value = typed(v, t, "error", at)
    if optional:
        return F.when(~kind.isin("OBJECT", "ARRAY"), value)
    bad = F.raise_error(F.lit(f"{at}: missing or nested value")).cast(value_type(t, read_as))
    return F.when(kind.isNull() | kind.isin("OBJECT", "ARRAY"), bad).otherwise(value)


def value_type(t: T.DataType, read_as: str | None) -> T.DataType:
    return {"bool": T.BooleanType(), "datetime": T.TimestampType()}.get(read_as or "", t)


def clock_ticks(nanoseconds: Column, ns_per_tick: int) -> Column:
    """A receive clock in nanoseconds scaled to ticks, rounded down."""
    return F.call_function("div", nanoseconds - F.pmod(nanoseconds, F.lit(ns_per_tick)), F.lit(ns_per_tick))
