"""Queries over the reference's own operators, and their DuckDB equivalents."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shared import shared_top

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL if it has any."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder that driver and executors share: below ``spark.checkpoint.dir`` if that is set."""
    return f"{shared_top(spark)}/{name}-{uuid.uuid4().hex}"


# -- feeds (borrowed relational surface)

FEED = "SELECT event_id, event_type, user_id, value, ts, event_id // 100 AS batch FROM events"


def feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "event_type", "user_id", "value", "ts", F.expr("event_id div 100").alias("batch"))


@query(
    f"""
    WITH b AS ({FEED}), r AS (SELECT DISTINCT batch AS report FROM b WHERE batch % 5 = 4)
    SELECT report, event_type, count(*) AS ticks, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) / count(value) AS avg_value, max(value) AS max_value
    FROM b JOIN r ON batch <= report AND batch > report - 20 GROUP BY report, event_type
    """
)
def rolling_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.rolling import rolling_report

    # cents add up exactly, whatever the order
    return rolling_report(feed(spark, sf_dir).select("event_type", F.col("value").cast("decimal(18,2)").alias("value"), "batch"), "batch", "event_type", "value", every=5, window=20)


@query("SELECT CAST(sum(user_id) AS BIGINT) AS total FROM events")
def sum_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").agg(F.sum("user_id").alias("total"))


@query(f"SELECT batch, count(*) AS n_rows, CAST(sum(CASE WHEN event_type = 'error' OR value < 1 THEN 1 ELSE 0 END) AS BIGINT) AS n_suspicious, bool_or(event_type = 'error' OR value < 1) AS suspicious FROM ({FEED}) GROUP BY batch")
def quality_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.quality import quality_gate as gate

    return gate(feed(spark, sf_dir), "batch", (F.col("event_type") == "error") | (F.col("value") < 1))


@query(
    """
    WITH g AS (SELECT event_type, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS g FROM events)
    SELECT event_type, quantile_disc(g, 0.5) AS p50, quantile_disc(g, 0.95) AS p95, quantile_disc(g, 0.99) AS p99, max(g) AS longest FROM g WHERE g IS NOT NULL GROUP BY event_type
    """
)
def arrival_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.quality import arrival_gaps as gaps

    return gaps(table(spark, sf_dir, "events"), "event_type", "ts", "event_id")


@query("SELECT event_type, min(value) AS low, median(value) AS mid, max(value) AS high FROM events GROUP BY event_type")
def run_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.quality import run_spread as spread

    return spread(table(spark, sf_dir, "events"), "event_type", "value")


# -- scans, projections, batches


@query("SELECT * FROM region")
def scan_all_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "region")


@query("SELECT * FROM events")
def scan_all_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


@query("SELECT event_id, user_id, value FROM events")
def scan_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.batches import select_columns

    return select_columns(table(spark, sf_dir, "events"), ["value", "user_id", "event_id"])


BATCHED = "SELECT event_id, event_type, value, event_id // 1000 AS batch_id, event_id % 1000 AS row_id FROM events"


def batched(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    """Events written as IPC files of batches of 1,000 rows, read back with the options.

    Ranges of whole batches go to tasks, so files in name order hold the batches in order.
    """
    from ..sources.arrow_ipc import read_ipc, write_ipc

    folder = scratch(spark, "batches")
    e = table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    write_ipc(e.repartitionByRange(F.expr("event_id div 1000")).sortWithinPartitions("event_id"), folder, batch_rows=1000)
    return read_ipc(spark, folder, ids="true", **options)


@query(f"SELECT * FROM ({BATCHED}) WHERE batch_id < 7")
def take_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batched(spark, sf_dir, first=7)


@query(f"SELECT * FROM ({BATCHED}) WHERE batch_id = 3")
def one_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    there = table(spark, sf_dir, "events").count() > 3000  # the source has an error for a batch that is not there, the query no rows
    return batched(spark, sf_dir, **({"batch": 3} if there else {"first": 0}))


@query(f"SELECT * FROM ({BATCHED}) WHERE row_id >= 512 AND row_id < 768")
def row_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batched(spark, sf_dir, window_offset=512, window_rows=256)


@query(f"SELECT batch_id, row_id // 512 AS window_id, count(*) AS n_rows, min(event_id) AS first_id, max(event_id) AS last_id FROM ({BATCHED}) GROUP BY batch_id, row_id // 512")
def batch_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a row of the two columns has 16 bytes and its validity bits, so a window of 10,240 bytes has 512 rows
    rows = batched(spark, sf_dir, columns=["event_id", "value"], window_bytes=10_240)
    return rows.groupBy("batch_id", "window_id").agg(F.count("*").alias("n_rows"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"))


@query("SELECT event_id, value FROM events WHERE event_id % 2 = 0 UNION ALL SELECT user_id, value FROM events WHERE event_id % 2 = 1")
def concat_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.batches import concat_batches as concat

    e = table(spark, sf_dir, "events")
    return concat([e.filter("event_id % 2 = 0").select("event_id", "value"), e.filter("event_id % 2 = 1").select("user_id", "value")])


@query("SELECT event_id, event_type, row_number() OVER (ORDER BY event_type, event_id) - 1 AS row_no FROM events")
def global_row_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.batches import numbered

    return numbered(table(spark, sf_dir, "events").select("event_id", "event_type"), "event_type", ["event_id"])


@query(
    """
    WITH f AS (SELECT event_type, row_number() OVER (ORDER BY min(event_id)) - 1 AS code FROM events GROUP BY event_type)
    SELECT event_id, event_type, code FROM events JOIN f USING (event_type)
    """
)
def categorical_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.batches import categorical_codes as codes

    return codes(table(spark, sf_dir, "events").select("event_id", "event_type"), "event_type", "event_id")


# -- Arrow IPC files, chunked directories


@query("SELECT * FROM events")
def ipc_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.arrow_ipc import read_ipc, write_ipc

    folder = scratch(spark, "ipc")
    write_ipc(table(spark, sf_dir, "events"), folder)
    return read_ipc(spark, folder)


@query("SELECT * FROM customer")
def ipc_zstd_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.arrow_ipc import read_ipc, write_ipc

    folder = scratch(spark, "ipc")
    write_ipc(table(spark, sf_dir, "customer"), folder, compression="zstd")
    return read_ipc(spark, folder)


@query("SELECT * FROM supplier")
def ipc_stream_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.arrow_ipc import read_ipc, write_ipc

    folder = scratch(spark, "ipc")
    write_ipc(table(spark, sf_dir, "supplier"), folder, layout="stream", compression="zstd")
    return read_ipc(spark, folder, mmap="false")


@query("SELECT o_orderkey, o_totalprice, o_orderdate FROM orders")
def ipc_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.arrow_ipc import read_ipc, write_ipc

    folder = scratch(spark, "ipc")
    write_ipc(table(spark, sf_dir, "orders"), folder)
    return read_ipc(spark, folder, columns=["o_orderdate", "o_totalprice", "o_orderkey"])


@query("SELECT * FROM part")
def serialise_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.arrow_ipc import from_payloads, to_payloads

    p = table(spark, sf_dir, "part")
    return from_payloads(to_payloads(p), p.schema)


def _chunked(spark: SparkSession, sf_dir: str, fmt: str) -> tuple[str, DataFrame]:
    from ..sources.chunks import write_chunks

    df = table(spark, sf_dir, "nation").withColumn("part", F.pmod("n_nationkey", F.lit(12)).cast("bigint"))
    folder = scratch(spark, "chunks").removeprefix("file://")
    write_chunks(df, folder, "nation", fmt, chunk="part")
    return folder, df


NATION = "SELECT *, CAST(n_nationkey % 12 AS BIGINT) AS part, CAST(n_nationkey % 12 AS BIGINT) AS chunk_id FROM nation"


@query(NATION)
def chunk_roundtrip_ipc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.chunks import read_chunks

    return read_chunks(spark, _chunked(spark, sf_dir, "ipc")[0])


@query(NATION)
def chunk_roundtrip_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.chunks import read_chunks

    return read_chunks(spark, _chunked(spark, sf_dir, "parquet")[0], "nation", "parquet")


@query("SELECT n_nationkey, n_name, CAST(n_nationkey % 12 AS BIGINT) AS chunk_id FROM nation")
def chunk_roundtrip_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.chunks import read_chunks

    return read_chunks(spark, _chunked(spark, sf_dir, "csv")[0], columns=["n_name", "n_nationkey"])


@query("SELECT CAST(n_nationkey % 12 AS BIGINT) AS chunk_id, min(n_nationkey) AS first_key, count(*) AS n_rows FROM nation GROUP BY 1")
def chunk_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.chunks import read_chunks

    got = read_chunks(spark, _chunked(spark, sf_dir, "parquet")[0])
    return got.groupBy("chunk_id").agg(F.min("n_nationkey").alias("first_key"), F.count("*").alias("n_rows"))


# -- CSV


def _csv_sql(delimiter: str) -> str:
    d = delimiter.replace("\t", "' || chr(9) || '")
    need = f"text LIKE ' %' OR text LIKE '% ' OR contains(text, '{d}') OR contains(text, '\"') OR contains(text, chr(10)) OR contains(text, chr(13))"
    return f"""SELECT doc_id, doc_id || '{d}' || CASE WHEN {need} THEN '"' || replace(text, '"', '""') || '"' ELSE text END || '{d}' || lang || '{d}' || n_chars AS line FROM documents"""


@query(_csv_sql(","))
def csv_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.csv import encode_rows

    d = table(spark, sf_dir, "documents")
    return encode_rows(d.select(F.col("doc_id").alias("key"), "doc_id", "text", "lang", "n_chars"), keep=["key"]).withColumnRenamed("key", "doc_id")


@query(_csv_sql("\t"))
def csv_encode_tab(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.csv import encode_rows

    d = table(spark, sf_dir, "documents")
    return encode_rows(d.select(F.col("doc_id").alias("key"), "doc_id", "text", "lang", "n_chars"), delimiter="\t", keep=["key"]).withColumnRenamed("key", "doc_id")


@query("SELECT doc_id, text, lang, CAST(n_chars AS INTEGER) AS n_chars FROM documents")
def csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.csv import read_csv, write_csv

    d = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "n_chars")
    folder = scratch(spark, "csv")
    write_csv(d, folder)
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("n_chars", T.IntegerType())])
    return read_csv(spark, folder, schema)


def _lines(spark: SparkSession, name: str, text: str) -> str:
    """A one-file folder with exactly this text."""
    folder = scratch(spark, name)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.option("lineSep", "\n").text(folder)
    return folder


@query(
    """
    SELECT * FROM (VALUES
      (CAST(true AS BOOLEAN), CAST(1 AS INTEGER), CAST(3000000000 AS BIGINT), '18446744073709551615', CAST(1.5 AS DOUBLE), '001x', CAST(NULL AS BOOLEAN)),
      (false, -2, -4000000000, '9223372036854775808', -2000.0, ' b ', NULL), (true, NULL, 5, '7', NULL, 'NA?', NULL)) t(flag, small, wide, huge, real, words, nothing)
    """
)
def csv_infer_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.csv import read_csv

    return read_csv(spark, _lines(spark, "csv", "flag,small,wide,huge,real,words,nothing\n1,1,3000000000,18446744073709551615,1.5,001x,\n0,-2,-4000000000,9223372036854775808,-2e3, b ,NA\nt,,5,7,null,NA?,NULL")).withColumn("huge", F.col("huge").cast("decimal(20,0)").cast("string"))


@query("SELECT * FROM (VALUES (CAST(1 AS INTEGER), CAST(NULL AS VARCHAR)), (2, NULL), (3, NULL), (4, NULL), (5, 'n/a'), (NULL, 'x')) t(k, v)")
def csv_null_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.csv import read_csv

    return read_csv(spark, _lines(spark, "csv", 'k,v\n1,NA\n2, null \n3,""\n4,\n5,n/a\n Null ,x'))


@query("""SELECT * FROM (VALUES (CAST(10 AS INTEGER), 'She said "hi" yesterday'), (20, 'line1' || chr(10) || 'line2'), (30, 'plain')) t(col1, col2)""")
def csv_quoted_newlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.csv import read_csv

    return read_csv(spark, _lines(spark, "csv", '10,"She said ""hi"" yesterday"\n20,"line1\nline2"\n30,plain'), header=False)


# -- JSON


@query("""SELECT n_nationkey, '{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '","up":' || CASE WHEN n_regionkey = 2 THEN 'null' ELSE CAST(n_regionkey AS VARCHAR) END || '}' AS line FROM nation""")
def ndjson_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.json import encode_objects

    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("key"), "n_nationkey", "n_name", F.expr("nullif(n_regionkey, 2)").alias("up"))
    return encode_objects(n, keep=["key"]).withColumnRenamed("key", "n_nationkey")


@query("""SELECT n_nationkey, '{"n_nationkey":' || n_nationkey || CASE WHEN n_regionkey = 2 THEN '' ELSE ',"up":' || n_regionkey END || '}' AS line FROM nation""")
def ndjson_encode_omit_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.json import encode_objects

    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("key"), "n_nationkey", F.expr("nullif(n_regionkey, 2)").alias("up"))
    return encode_objects(n, include_nulls=False, keep=["key"]).withColumnRenamed("key", "n_nationkey")


@query("SELECT doc_id, CAST(to_json(text) AS VARCHAR) AS line FROM documents")
def json_string_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.json import json_string

    return table(spark, sf_dir, "documents").select("doc_id", json_string(F.col("text")).alias("line"))


@query("SELECT r_regionkey, r_name FROM region")
def json_array_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.json import read_json_array, write_json_array

    r = table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    folder = scratch(spark, "json")
    write_json_array(r, folder, pretty=True)
    return read_json_array(spark, folder, r.schema)


@query("SELECT conv_id, turn, role, text FROM conversations")
def ndjson_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.json import read_ndjson, write_ndjson

    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    folder = scratch(spark, "json")
    write_ndjson(c, folder)
    return read_ndjson(spark, folder, c.schema)


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def ndjson_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.json import decode_rows

    return decode_rows(table(spark, sf_dir, "events"), "props", T.StructType([T.StructField("k", T.LongType())]), keep=["event_id"])


MIXED = (
    '{"k":1,"i":1.0,"f":2,"b":true,"s":"x","extra":[1]}',
    '{"k":2,"i":"5","f":"2.5","b":"t","s":7}',
    '{"k":3,"i":1.5,"f":true,"b":0,"s":{"a":1}}',
    '{"k":4,"i":true,"f":null,"b":"maybe","s":true}',
    '{"k":5}',
)
MIXED_SCHEMA = "k int, i int, f double, b boolean, s string"


def _mixed(spark: SparkSession, policy: str) -> DataFrame:
    from ..functions.json import decode_rows

    schema = spark.createDataFrame([], MIXED_SCHEMA).schema
    return decode_rows(spark.createDataFrame([(x,) for x in MIXED], "value string"), "value", schema, policy)


@query("SELECT * FROM (VALUES (1, CAST(1 AS INTEGER), CAST(2.0 AS DOUBLE), true, 'x'), (2, NULL, NULL, NULL, NULL), (3, NULL, 1.0, false, NULL), (4, 1, NULL, NULL, NULL), (5, NULL, NULL, NULL, NULL)) t(k, i, f, b, s)")
def json_policy_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixed(spark, "null")


@query("SELECT * FROM (VALUES (1, CAST(1 AS INTEGER), CAST(2.0 AS DOUBLE), true, 'x'), (2, 5, 2.5, true, '7'), (3, NULL, 1.0, false, NULL), (4, 1, NULL, NULL, 'true'), (5, NULL, NULL, NULL, NULL)) t(k, i, f, b, s)")
def json_policy_coerce(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixed(spark, "coerce")


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, CAST(NULL AS VARCHAR) AS absent FROM events")
def json_missing_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.json import decode_rows

    return decode_rows(table(spark, sf_dir, "events"), "props", T.StructType([T.StructField("k", T.LongType()), T.StructField("absent", T.StringType())]), keep=["event_id"])


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def json_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.json import dotted

    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", dotted(".k.")).alias("k"))


def _envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One envelope per conversation: {"id", "data": {"turns": [{"turn", "role"}]}}; every tenth has no data."""
    c = table(spark, sf_dir, "conversations")
    turns = c.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role"))).alias("turns"))
    return turns.select(F.when(F.col("conv_id") % 10 == 0, F.to_json(F.struct(F.col("conv_id").alias("id")))).otherwise(F.to_json(F.struct(F.col("conv_id").alias("id"), F.struct("turns").alias("data")))).alias("frame"))


@query("SELECT turn, role FROM conversations WHERE conv_id % 10 <> 0")
def record_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.json import field, records

    return records(_envelopes(spark, sf_dir), "frame", "data.turns").select(field("record_key", "turn", T.LongType()).alias("turn"), field("json_path", "role", T.StringType()).alias("role"))


@query("SELECT conv_id, turn FROM conversations WHERE conv_id % 10 <> 0")
def frame_path_broadcast(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.json import field, records

    return records(_envelopes(spark, sf_dir), "frame", "data.turns").select(field("frame_path", "id", T.LongType()).alias("conv_id"), field("record_key", "turn", T.LongType()).alias("turn"))


@query("SELECT count(*) AS n_records, CAST(count(DISTINCT conv_id) AS BIGINT) AS n_frames FROM conversations WHERE conv_id % 10 <> 0")
def heartbeat_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.json import field, records

    r = records(_envelopes(spark, sf_dir), "frame", "data.turns").select(field("frame_path", "id", T.LongType()).alias("id"))
    return r.agg(F.count("*").alias("n_records"), F.countDistinct("id").alias("n_frames"))


@query("SELECT event_id, epoch_us(ts) AS us FROM events")
def iso_datetime(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.json import field, records

    e = table(spark, sf_dir, "events").select("event_id", F.to_json(F.struct(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("at"))).alias("frame"))
    return records(e, "frame").select("event_id", F.unix_micros(field("record_key", "at", T.TimestampType(), "datetime")).alias("us"))


@query("SELECT event_id, epoch_ns(ts) // 1000000 AS ticks FROM events")
def clock_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.json import clock_ticks

    return table(spark, sf_dir, "events").select("event_id", clock_ticks(F.unix_micros(F.col("ts").cast("timestamp")) * 1000, 1_000_000).alias("ticks"))


@query("SELECT event_id, CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'purchase' THEN 2 END AS place FROM events")
def dictionary_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.json import field, records

    e = table(spark, sf_dir, "events").select("event_id", F.to_json(F.struct("event_type")).alias("frame"))
    return records(e, "frame").select("event_id", field("record_key", "event_type", T.IntegerType(), "dictionary", dictionary=["view", "click", "purchase"]).alias("place"))


# -- fan-out and fan-in


def streams(spark: SparkSession, sf_dir: str, n: int = 4) -> DataFrame:
    from ..operators.fanout import fan_out

    return fan_out(feed(spark, sf_dir).select("event_id", "value", F.col("batch").alias("seq")), n, "seq", ["event_id"])


@query(f"SELECT event_id, value, batch AS seq, CAST(batch % 4 AS INTEGER) AS stream_id FROM ({FEED})")
def round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams(spark, sf_dir)


@query(f"SELECT CAST(batch % 4 AS INTEGER) AS stream_id, count(DISTINCT batch) AS batches, min(batch) AS first_seq, max(batch) AS last_seq, true AS complete FROM ({FEED}) GROUP BY 1")
def stream_order_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.fanout import stream_order

    return stream_order(streams(spark, sf_dir), 4)


@query(f"SELECT event_id, batch AS seq FROM ({FEED}) WHERE batch < 42")
def ordered_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.fanout import merge_ordered

    s = streams(spark, sf_dir).select("event_id", "seq", "stream_id")
    # batch 42 is lost: its stream ends there, and the merge with it
    parts = [s.filter((F.col("stream_id") == k) & (F.col("seq") != 42)).drop("stream_id") for k in range(4)]
    return merge_ordered(parts, rows=["event_id"])


@query("SELECT event_id, value FROM events")
def unordered_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.fanout import merge

    s = streams(spark, sf_dir)
    return merge([s.filter(F.col("stream_id") == k).drop("stream_id") for k in range(4)])


@query(f"WITH b AS (SELECT DISTINCT CAST(batch % 4 AS INTEGER) AS stream_id, batch AS seq FROM ({FEED}) WHERE batch NOT IN (13, 22)), l AS (SELECT *, lag(seq) OVER (PARTITION BY stream_id ORDER BY seq) + 4 AS expected FROM b) SELECT * FROM l WHERE expected <> seq")
def seq_gap_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.fanout import sequence_gaps

    return sequence_gaps(streams(spark, sf_dir).filter("seq not in (13, 22)"), step=4)


@query(f"SELECT batch AS seq, min(event_id) // 100 AS first_value, true AS in_order FROM ({FEED}) GROUP BY batch")
def sequence_verified(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.fanout import reads_in_order

    return reads_in_order(feed(spark, sf_dir).select(F.col("batch").alias("seq"), F.expr("event_id div 100").alias("v")), "v")


# -- frames


@query("SELECT doc_id, octet_length(encode(text)) + 5 AS frame_bytes FROM documents")
def tlv_frame_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.frames import frame_column

    return table(spark, sf_dir, "documents").select("doc_id", F.octet_length(frame_column(F.lit(7), F.encode("text", "UTF-8"))).cast("bigint").alias("frame_bytes"))


@query("SELECT doc_id, 7 AS tag, text FROM documents")
def tlv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.frames import frame_column, parse_column

    d = table(spark, sf_dir, "documents").select("doc_id", parse_column(frame_column(F.lit(7), F.encode("text", "UTF-8"))).alias("f"))
    return d.select("doc_id", "f.tag", F.decode("f.payload", "UTF-8").alias("text"))


def _capture(spark: SparkSession) -> DataFrame:
    """A capture of two batches of quotes with a message between them."""
    from ..sources.frames import Registry, read_capture, write_capture

    r = Registry()
    r.register_table("quotes")
    r.register_message("health")
    quotes = lambda k: pa.record_batch({"sym": ["A", "B", "C"], "px": [1.5 + k, 2.5 + k, 3.5 + k], "qty": [10, 20, 30]})
    path = scratch(spark, "capture").removeprefix("file://")
    os.makedirs(os.path.dirname(path), exist_ok=True)
    write_capture(path, r, [("quotes", quotes(0)), ("health", b"\x01\x02\x03"), ("quotes", quotes(100))])
    return read_capture(spark, path, r)


@query("SELECT * FROM (VALUES ('A', CAST(1.5 AS DOUBLE), CAST(10 AS BIGINT)), ('B', 2.5, 20), ('C', 3.5, 30), ('A', 101.5, 10), ('B', 102.5, 20), ('C', 103.5, 30)) t(sym, px, qty)")
def mux_demux_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.frames import tables_of

    return tables_of(_capture(spark), "quotes", "sym string, px double, qty bigint")


@query("SELECT CAST(1 AS BIGINT) AS seq, 1 AS tag, 'health' AS name, '010203' AS payload")
def mux_demux_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.frames import messages_of

    return messages_of(_capture(spark), "health").select("seq", "tag", "name", F.hex("payload").alias("payload"))


@query("SELECT * FROM customer")
def mux_table_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.frames import Registry, read_capture, tables_of, write_captures

    r = Registry()
    r.register_message("note")
    r.register_table("customer")
    c = table(spark, sf_dir, "customer")
    folder = scratch(spark, "captures").removeprefix("file://")
    write_captures(c, folder, r, "customer")
    return tables_of(read_capture(spark, folder, r), "customer", c.schema)


@query("SELECT 'rows' AS cap, true AS refused")
def limits_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.arrow_ipc import read_ipc, write_ipc

    folder = scratch(spark, "ipc")
    write_ipc(table(spark, sf_dir, "region").coalesce(1), folder)
    read_ipc(spark, folder, limit_rows=5).count()
    try:
        read_ipc(spark, folder, limit_rows=4).count()
        refused = False
    except Exception as x:  # the source's own error comes wrapped by Spark
        refused = "resource limit exceeded" in str(x)
    return spark.createDataFrame([("rows", refused)], "cap string, refused boolean")


# -- streams


@query("SELECT event_id, value FROM events")
def wire_tcp_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events, after they went over two TCP connections."""
    return events_over_tcp(spark, sf_dir)


def events_over_tcp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events in batches of 100 over two TCP connections, read by Spark and put in sequence."""
    import socket
    import threading

    from pyspark.sql.pandas.types import to_arrow_schema

    from ..streaming.wires import WireWriter, local_batches, read_wires

    e = table(spark, sf_dir, "events").select("event_id", "value").orderBy("event_id")
    # spooled first: the readers may hold every slot that fetching needs
    spool = tempfile.TemporaryFile()
    with pa.ipc.new_stream(spool, to_arrow_schema(e.schema)) as w:
        for b in local_batches(e, rows=100):
            w.write_batch(b)
    spool.seek(0)
    s = socket.create_server(("127.0.0.1", 0), backlog=8)
    address = f"127.0.0.1:{s.getsockname()[1]}"

    def serve() -> None:
        peers = [WireWriter(s.accept()[0]) for _ in range(2)]
        with spool:
            for k, b in enumerate(pa.ipc.open_stream(spool)):
                peers[k % 2].write(b, k)
        for p in peers:
            p.close()
        s.close()

    threading.Thread(target=serve, daemon=True).start()
    got = read_wires(spark, "tcp", address, T.StructType([T.StructField("event_id", T.LongType()), T.StructField("value", T.DoubleType())]), parallel=2)
    folder = scratch(spark, "wire")
    got.write.parquet(folder)  # a wire can be read once
    return spark.read.parquet(folder).orderBy("seq_id", "row_id").select("event_id", "value")


def _file_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/events*.parquet")


@query(
    f"""
    WITH b AS ({FEED}), r AS (SELECT DISTINCT batch AS report FROM b WHERE batch % 5 = 4)
    SELECT report, event_type, count(*) AS ticks, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) / count(value) AS avg_value, max(value) AS max_value
    FROM b JOIN r ON batch <= report AND batch > report - 20 GROUP BY report, event_type
    """
)
def stream_rolling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..streaming.ordering import rolling_stream

    s = _file_stream(spark, sf_dir).select("event_type", F.col("value").cast("decimal(18,2)").alias("value"), F.expr("event_id div 100").alias("batch"))
    name = f"rolling_{uuid.uuid4().hex}"
    q = rolling_stream(s, "batch", "event_type", "value", 5, 20).writeStream.format("memory").queryName(name).outputMode("complete").option("checkpointLocation", scratch(spark, "stream")).trigger(availableNow=True).start()
    q.awaitTermination()
    last = feed(spark, sf_dir).agg(F.max("batch").alias("last"))
    return spark.table(name).join(F.broadcast(last), F.col("report") <= F.col("last")).drop("last")


@query("SELECT CAST(event_id % 8 AS BIGINT) AS lane, event_id // 8 AS seq, value FROM events")
def stream_reorder(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..streaming.ordering import reorder

    s = _file_stream(spark, sf_dir).select(F.expr("event_id % 8").alias("lane"), F.expr("event_id div 8").alias("seq"), "value")
    name, folder = f"reorder_{uuid.uuid4().hex}", scratch(spark, "reordered")
    q = reorder(s, "lane", "seq", "value").writeStream.format("parquet").queryName(name).option("path", folder).outputMode("append").option("checkpointLocation", scratch(spark, "stream")).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(folder)
