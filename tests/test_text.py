import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weirflow.errors import FormatError
from weirflow.functions import csv as C
from weirflow.functions import json as J


def put(tmp_path, text, name="x.csv"):
    (tmp_path / name).write_bytes(text.encode())
    return str(tmp_path / name)


@pytest.mark.parametrize("text,types,rows", [
    ("a,b\n1,x\n0,y", ["boolean", "string"], [(True, "x"), (False, "y")]),
    ("a\n1\n2", ["int"], [(1,), (2,)]),
    ("a\n1\n3000000000", ["bigint"], [(1,), (3000000000,)]),
    ("a\n1\n1.5", ["double"], [(1.0,), (1.5,)]),
    ("a\nnan\ninf", ["double"], None),
    ("a,b\r\n1,2\r\n3,4\r\n", ["int", "int"], [(1, 2), (3, 4)]),
    ("a,b\n,NA\n null ,", ["boolean", "boolean"], [(None, None), (None, None)]),
    ('a,b\n3,"She said ""hi"""\n4,"l1\nl2"', ["int", "string"], [(3, 'She said "hi"'), (4, "l1\nl2")]),
    ("a,b\n 7 , pad \n8,q", ["int", "string"], [(7, " pad "), (8, "q")]),
])
def test_inference(spark, tmp_path, text, types, rows):
    df = C.read_csv(spark, put(tmp_path, text))
    assert [t for _, t in df.dtypes] == types
    if rows is not None:
        assert [tuple(r) for r in df.collect()] == rows


def test_unsigned_only_above_signed(spark, tmp_path):
    df = C.read_csv(spark, put(tmp_path, "a,b\n18446744073709551615,18446744073709551615\n1,-1"))
    assert dict(df.dtypes) == {"a": "decimal(20,0)", "b": "double"}


def test_headerless_names(spark, tmp_path):
    assert C.read_csv(spark, put(tmp_path, "10,20\n30,40"), header=False).columns == ["col1", "col2"]


def test_ragged_rows_are_errors(spark, tmp_path):
    with pytest.raises(Exception, match="MALFORMED|[Mm]alformed"):
        C.read_csv(spark, put(tmp_path, "a,b\n1,2\n3,4,5"), T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.IntegerType())])).collect()
    with pytest.raises(FormatError, match="inconsistent row length"):
        C.read_csv(spark, put(tmp_path, "a,b\n1,2"), T.StructType([T.StructField("a", T.IntegerType())]))


def test_strict_and_lenient_cells(spark, tmp_path):
    schema = T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.StringType())])
    path = put(tmp_path, "a,b\n001,001\nx,y")
    with pytest.raises(Exception, match="not a int"):
        C.read_csv(spark, path, schema).collect()
    assert [tuple(r) for r in C.read_csv(spark, path, schema, strict=False).collect()] == [(1, "001"), (None, "y")]


def test_categorical_is_marked(spark, tmp_path):
    df = C.read_csv(spark, put(tmp_path, "a,b\nx,y"), categorical=["b"])
    assert df.schema["b"].metadata == {"categorical": True} and df.schema["a"].metadata == {}


@pytest.mark.parametrize("value,text", [(1.0, "1.0"), (0.1, "0.1"), (1e7, "10000000.0"), (123456789.25, "123456789.25"), (1e16, "1e16"), (1.5e20, "1.5e20"), (1e-5, "0.00001"), (1.25e-7, "1.25e-7"), (-0.0, "-0.0"), (None, None)])
def test_float_text(spark, value, text):
    assert spark.createDataFrame([(value,)], "v double").select(C.float_text(F.col("v"))).first()[0] == text


def test_csv_cells(spark):
    df = spark.createDataFrame([(1, "a,b", None, True), (2, ' x"', 0.5, False), (3, "", 1.0, None)], "i int, s string, f double, b boolean")
    assert [r.line for r in C.encode_rows(df, null="-").collect()] == ['1,"a,b",-,true', '2," x""",0.5,false', "3,,1.0,-"]
    assert C.header_line(df.withColumnRenamed("s", "s,t")) == 'i,"s,t",f,b'
    q = spark.createDataFrame([('"a""b"',), ("plain",)], "s string").select(C.unquoted(F.col("s"))).collect()
    assert [r[0] for r in q] == ['a"b', "plain"]


KINDS = {"int": "1", "whole": "2.0", "part": "1.5", "true": "true", "text": '"5"', "word": '"x"', "null": "null", "object": '{"a":1}'}
WANT = {  # policy-free result, result under coerce (differs only where given); E = mismatch
    ("int", "int"): 1, ("int", "whole"): 2, ("int", "part"): "E", ("int", "true"): 1, ("int", "text"): ("E", 5), ("int", "word"): "E", ("int", "null"): None, ("int", "object"): "E",
    ("double", "int"): 1.0, ("double", "part"): 1.5, ("double", "true"): 1.0, ("double", "text"): ("E", 5.0), ("double", "word"): "E", ("double", "object"): "E",
    ("boolean", "int"): True, ("boolean", "part"): True, ("boolean", "true"): True, ("boolean", "word"): "E", ("boolean", "null"): None,
    ("string", "text"): "5", ("string", "int"): ("E", "1"), ("string", "true"): ("E", "true"), ("string", "object"): "E", ("string", "null"): None,
    ("date", "text"): "E", ("date", "word"): "E", ("date", "null"): None,
}


@pytest.mark.parametrize("policy", ["error", "coerce", "null"])
def test_policies(spark, policy):
    for (kind, source), want in WANT.items():
        plain, coerced = want if isinstance(want, tuple) else (want, want)
        expected = coerced if policy == "coerce" else plain
        schema = T.StructType([T.StructField("v", getattr(T, {"int": "IntegerType", "double": "DoubleType", "boolean": "BooleanType", "string": "StringType", "date": "DateType"}[kind])())])
        df = J.decode_rows(spark.createDataFrame([(f'{{"v":{KINDS[source]}}}',)], "j string"), "j", schema, policy)
        if expected == "E" and policy == "error":
            with pytest.raises(Exception, match="column v: expected"):
                df.collect()
        else:
            got = df.first()[0]
            assert got == (None if expected == "E" else expected), (policy, kind, source, got)


def test_json_shape_errors(spark):
    schema = T.StructType([T.StructField("a", T.IntegerType())])
    for bad in ('{"a":1,"a":2}', "[1]", "{"):
        with pytest.raises(Exception):
            J.decode_rows(spark.createDataFrame([(bad,)], "j string"), "j", schema, "null").collect()
    with pytest.raises(FormatError, match="schema"):
        J.read_ndjson(spark, "/nowhere", None)


def test_unsigned_range(spark):
    schema = T.StructType([T.StructField("a", T.LongType(), True, {"arrow": "uint32"})])
    df = spark.createDataFrame([('{"a":4294967295}',), ('{"a":4294967296}',), ('{"a":-1}',)], "j string")
    assert [r.a for r in J.decode_rows(df, "j", schema, "null").collect()] == [4294967295, None, None]


def test_json_files(spark, tmp_path):
    schema = T.StructType([T.StructField("x", T.StringType()), T.StructField("y", T.DoubleType())])
    a = put(tmp_path, '[{"x":"001","y":1},\n {"x":"{\\"}[","y":null}]', "a.json")
    assert [tuple(r) for r in J.read_json_array(spark, a, schema).collect()] == [("001", 1.0), ('{"}[', None)]
    b = put(tmp_path, '{"x":"1"}\n\n  \n{"y":2.5}\n', "b.jsonl")
    assert [tuple(r) for r in J.read_ndjson(spark, b, schema).collect()] == [("1", None), (None, 2.5)]


def test_json_text(spark):
    df = spark.createDataFrame([(1, 'q"\\\n\x01', float("nan")), (2, None, 1e20)], "i int, s string, f double")
    assert [r.line for r in J.encode_objects(df).collect()] == ['{"i":1,"s":"q\\"\\\\\\n\\u0001","f":null}', '{"i":2,"s":null,"f":1e20}']
    assert [r.line for r in J.encode_objects(df, include_nulls=False).collect()] == ['{"i":1,"s":"q\\"\\\\\\n\\u0001"}', '{"i":2,"f":1e20}']


def test_dotted():
    assert J.dotted("a.0.b") == "$.a[0].b" and J.dotted("..x.") == "$.x" and J.dotted("a-b") == "$['a-b']"


def test_records(spark):
    book = '{"channel":"book","data":[{"bids":[{"price":1.5,"qty":2},{"price":"2.5","qty":3}],"checksum":77}]}'
    df = spark.createDataFrame([(book,), ('{"channel":"heartbeat"}',)], "f string")
    got = J.records(df, "f", "data.0.bids").select(J.field("record_key", "price", T.DoubleType(), "number").alias("p"), J.field("frame_path", "data.0.checksum", T.LongType()).alias("c")).collect()
    assert [tuple(r) for r in got] == [(1.5, 77), (2.5, 77)]
    with pytest.raises(Exception, match="expected an array or an object"):
        J.records(spark.createDataFrame([('{"data":42}',)], "f string"), "f", "data").collect()
    one = J.records(spark.createDataFrame([('{"data":{"a":1}}',)], "f string"), "f", "data").select(J.field("record_key", "a", T.IntegerType()).alias("a"))
    assert one.first()[0] == 1
    with pytest.raises(Exception, match="missing or nested"):
        J.records(spark.createDataFrame([('{"a":{}}',)], "f string"), "f").select(J.field("record_key", "a", T.IntegerType())).collect()


def test_read_as(spark):
    df = J.records(spark.createDataFrame([('{"b":"TRUE","t":"2024-01-02T03:04:05Z","d":"sell"}',)], "f string"), "f")
    r = df.select(J.field("record_key", "b", T.BooleanType(), "bool"), F.unix_seconds(J.field("record_key", "t", T.TimestampType(), "datetime")), J.field("record_key", "d", T.IntegerType(), "dictionary", dictionary=["buy", "sell"])).first()
    assert tuple(r) == (True, 1704164645, 1)
