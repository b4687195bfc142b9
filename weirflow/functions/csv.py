"""CSV text <-> typed columns, as column expressions.

Reading splits with Spark's quote-aware reader into strings, then infers and converts with
built-in functions.  Null tokens are the empty cell, NA and null in any case, trimmed (a quoted
empty cell is null too).  Strings keep their white space, other types are trimmed.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import FormatError

# Tokens of nulls and booleans.
NULL_TOKENS = ("", "na", "null")
TRUE_TOKENS, FALSE_TOKENS = ("1", "t", "T", "true", "True", "TRUE"), ("0", "f", "F", "false", "False", "FALSE")
INFER_ROWS = 1024
_BLANK = r"[\x20\x09-\x0D]"


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, rf"^{_BLANK}+|{_BLANK}+$", "")


def is_null_token(c: Column, tokens: Iterable[str] = NULL_TOKENS) -> Column:
    return c.isNull() | F.lower(trimmed(c)).isin(*[t.lower() for t in tokens])


def is_integer(c: Column) -> Column:
    return F.regexp_like(c, F.lit(r"^[+-]?[0-9]+$"))


def to_integer(c: Column, kind: str = "bigint") -> Column:
    """Optional sign and ASCII digits; what overflows the type is no integer (null)."""
    return F.when(is_integer(c), c.try_cast(kind))


def to_boolean(c: Column) -> Column:
    return F.when(c.isin(*TRUE_TOKENS), True).when(c.isin(*FALSE_TOKENS), False)


def to_float(c: Column) -> Column:
    """Decimal or scientific numbers, inf and nan in any case."""
    low = F.lower(c)
    special = F.when(F.regexp_like(low, F.lit(r"^[+-]?(inf|infinity|nan)$")), F.when(low.contains("nan"), F.lit(float("nan"))).when(low.startswith("-"), F.lit(float("-inf"))).otherwise(F.lit(float("inf"))))
    return F.coalesce(special, F.when(F.regexp_like(c, F.lit(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$")), c.try_cast("double")))


def read_text_columns(spark: SparkSession, paths: Sequence[str] | str, delimiter: str = ",", quote: str = '"', header: bool = True, multi_line: bool = True, with_file: bool = False) -> DataFrame:
    """All cells as strings; a row with another number of cells is an error.

    ``multi_line`` keeps line breaks inside quotes, for which a file is one split; without it large files
    are split at line breaks.
    """
    if len(delimiter) != 1 or ord(delimiter) > 127:
        raise ValueError("delimiter must be a single ASCII character")
    paths = [paths] if isinstance(paths, str) else list(paths)
    # nulls stay empty strings here; a quoted empty cell too
    reader = spark.read.option("sep", delimiter).option("quote", quote).option("escape", quote).option("multiLine", multi_line).option("nullValue", "\x00").option("emptyValue", "").option("maxCharsPerColumn", -1)
    head = reader.option("header", header).csv(paths[0])
    names = head.columns if header else [f"col{k + 1}" for k in range(len(head.columns))]
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    df = reader.option("header", header).option("enforceSchema", True).option("mode", "FAILFAST").schema(schema).csv(paths)
    return df.withColumn("_file", F.col("_metadata.file_name")) if with_file else df


def infer_schema(text: DataFrame, rows: int = INFER_ROWS, categorical: Sequence[str] = (), all_text: bool = False, tokens: Iterable[str] = NULL_TOKENS) -> T.StructType:
    """Types from the first ``rows`` rows, tried in this order: boolean, int, bigint, decimal(20,0) for
    unsigned 64 bits, double, named categorical, string.  A sample of nulls only is boolean."""
    if all_text or not text.columns:
        return T.StructType([T.StructField(c, T.StringType(), True, {"categorical": True} if c in categorical else {}) for c in text.columns])
    sample = text.limit(rows)
    tests = []
    for k, c in enumerate(text.columns):
        cell = trimmed(F.col(f"`{c}`"))
        valid = ~is_null_token(F.col(f"`{c}`"), tokens)
        wide = F.when(F.regexp_like(cell, F.lit(r"^\+?[0-9]{1,20}$")), cell.try_cast("decimal(20,0)"))
        fits = {
            "boolean": to_boolean(cell).isNotNull(), "int": to_integer(cell, "int").isNotNull(), "bigint": to_integer(cell, "bigint").isNotNull(),
            "unsigned": F.coalesce(wide <= F.lit("18446744073709551615").cast("decimal(20,0)"), F.lit(False)), "double": to_float(cell).isNotNull(),
        }
        tests += [F.coalesce(F.bool_and(F.when(valid, ok)), F.lit(True)).alias(f"{kind}{k}") for kind, ok in fits.items()]
    got = sample.agg(*tests).first()
    kinds = {"boolean": T.BooleanType(), "int": T.IntegerType(), "bigint": T.LongType(), "unsigned": T.DecimalType(20, 0), "double": T.DoubleType()}
    fields = []
    for k, c in enumerate(text.columns):
        kind = next((t for name, t in kinds.items() if got[f"{name}{k}"]), T.StringType())
        meta = {"categorical": True} if isinstance(kind, T.StringType) and c in categorical else {}
        fields.append(T.StructField(c, kind, True, meta))
    return T.StructType(fields)


def decode_columns(text: DataFrame, schema: T.StructType, strict: bool = True, tokens: Iterable[str] = NULL_TOKENS, keep: Sequence[str] = ()) -> DataFrame:
    """String columns converted by the schema; a cell that does not fit is an error, or null if not ``strict``."""
    out = []
    for f in schema:
        raw = F.col(f"`{f.name}`")
        cell = trimmed(raw)
        t = f.dataType
        if isinstance(t, T.StringType):
            value = raw
        elif isinstance(t, T.BooleanType):
            value = to_boolean(cell)
        elif isinstance(t, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
            value = to_integer(cell, t.simpleString())
        elif isinstance(t, T.DecimalType):
            value = F.when(is_integer(cell), cell.try_cast(t))
        elif isinstance(t, (T.FloatType, T.DoubleType)):
            value = to_float(cell).cast(t)
        else:
            value = cell.try_cast(t)
        if strict and not isinstance(t, T.StringType):
            value = F.coalesce(value, F.raise_error(F.concat(F.lit(f"column {f.name}: not a {t.simpleString()}: "), raw)).cast(t))
        out.append(F.when(~is_null_token(raw, tokens), value).alias(f.name, metadata=f.metadata or {}))
    return text.select(*out, *keep)


def read_csv(spark: SparkSession, paths: Sequence[str] | str, schema: T.StructType | None = None, delimiter: str = ",", quote: str = '"', header: bool = True, strict: bool = True, all_text: bool = False, categorical: Sequence[str] = (), multi_line: bool = True, tokens: Iterable[str] = NULL_TOKENS) -> DataFrame:
    """Typed columns of CSV files; the schema is given, or inferred from the first file's first rows."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    text = read_text_columns(spark, paths, delimiter, quote, header, multi_line)
    if schema is None:
        first = read_text_columns(spark, paths[:1], delimiter, quote, header, multi_line)
        schema = infer_schema(first, categorical=categorical, all_text=all_text, tokens=tokens)
    elif len(schema) != len(text.columns):
        raise FormatError(f"inconsistent row length: the schema has {len(schema)} columns, the file {len(text.columns)}")
    else:
        text = text.toDF(*schema.names)
    return decode_columns(text, schema, strict, tokens)


def float_text(c: Column) -> Column:
    """Shortest text that reads back as the same number: plain between 1e-5 and 1e16, else as ``1.5e20``."""

    @F.pandas_udf("string")
    def far(x: pd.Series) -> pd.Series:
        def one(v: float) -> str | None:
            if v is None or v != v or v in (float("inf"), float("-inf")):
                return {"nan": "NaN", "inf": "inf", "-inf": "-inf"}[str(v)] if v is not None else None
            s = repr(float(v))
            if "e" not in s:
                return s
            body, exponent = s.split("e")
            if -5 <= int(exponent) < 0:
                from decimal import Decimal

                return format(Decimal(s), "f")
            return f"{body}e{int(exponent)}"

        return x.map(one, na_action=None)

    d = c.cast("double")
    plain = (d == 0) | (F.abs(d) >= 1e-3) & (F.abs(d) < 1e7)
    # Python only sees the numbers that Spark would print with an exponent
    return F.when(plain & ~F.isnan(d), d.cast("string")).when(d.isNotNull(), far(F.when(~plain | F.isnan(d), d)))


def quoted(c: Column, delimiter: str = ",", quote: str = '"') -> Column:
    """Quoted if it starts or ends with a blank or holds the delimiter, the quote or a line break."""
    need = c.startswith(" ") | c.endswith(" ") | c.contains(delimiter) | c.contains(quote) | c.contains("\n") | c.contains("\r")
    return F.when(need, F.concat(F.lit(quote), F.replace(c, F.lit(quote), F.lit(quote * 2)), F.lit(quote))).otherwise(c)


def unquoted(c: Column, quote: str = '"') -> Column:
    inside = F.substring(c, F.lit(2), F.length(c) - 2)
    return F.when((F.length(c) >= 2) & c.startswith(quote) & c.endswith(quote), F.replace(inside, F.lit(quote * 2), F.lit(quote))).otherwise(c)


def cell(c: Column, kind: T.DataType, delimiter: str = ",", quote: str = '"', null: str = "", exact_floats: bool = True) -> Column:
    if isinstance(kind, T.StringType):
        text = quoted(c, delimiter, quote)
    elif isinstance(kind, (T.FloatType, T.DoubleType)):
        text = float_text(c) if exact_floats else c.cast("string")
    elif isinstance(kind, T.DateType):
        text = F.unix_date(c).cast("string")
    elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        text = F.unix_micros(c.cast("timestamp")).cast("string")
    else:
        text = c.cast("string")
    return F.when(c.isNull(), F.lit(null)).otherwise(text)


def encode_rows(df: DataFrame, delimiter: str = ",", quote: str = '"', null: str = "", name: str = "line", exact_floats: bool = True, keep: Sequence[str] = ()) -> DataFrame:
    """Each row as one CSV line (no line break)."""
    columns = [f for f in df.schema if f.name not in keep]
    return df.select(F.concat_ws(delimiter, *(cell(F.col(f"`{f.name}`"), f.dataType, delimiter, quote, null, exact_floats) for f in columns)).alias(name), *keep)


def header_line(df: DataFrame, delimiter: str = ",", quote: str = '"') -> str:
    def one(n: str) -> str:
        if n[:1] == " " or n[-1:] == " " or any(x in n for x in (delimiter, quote, "\n", "\r")):
            return quote + n.replace(quote, quote * 2) + quote
        return n

    return delimiter.join(one(c) for c in df.columns)


def write_csv(df: DataFrame, path: str, delimiter: str = ",", quote: str = '"', null: str = "", header: bool = True, mode: str = "overwrite") -> None:
    """A folder of CSV files, each with the header; written by tasks in parallel."""
    line = header_line(df, delimiter, quote)
    lines = encode_rows(df, delimiter, quote, null, name="value")
    if header:

        def headed(batches):
            import pyarrow as pa

            first = True
            for b in batches:
                if first:
                    yield pa.RecordBatch.from_arrays([pa.array([line])], ["value"])
                    first = False
                yield pa.RecordBatch.from_arrays([b.column(0)], ["value"])

        lines = lines.mapInArrow(headed, "value string")
    lines.write.mode(mode).text(path)
