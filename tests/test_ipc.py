import datetime as dt
import decimal

import pyarrow as pa
import pytest

from weirflow.errors import FormatError
from weirflow.limits import DecodeLimits
from weirflow.sources import arrow_ipc as A
from weirflow.types import arrow_schema, readable_batch, spark_schema


def all_types(n, nulls=False):
    odd = lambda values: [None if nulls and i % 2 else v for i, v in enumerate(values)]
    return pa.table({
        "i8": pa.array(odd(range(n)), pa.int8()), "i32": pa.array(odd(range(1, n + 1)), pa.int32()), "i64": pa.array(odd(range(100, 100 + n)), pa.int64()), "u8": pa.array(odd(range(n)), pa.uint8()), "u32": pa.array(odd(range(n)), pa.uint32()),
        "u64": pa.array(odd([(1 << 64) - 1 - i for i in range(n)]), pa.uint64()), "f32": pa.array(odd([1.25 * i for i in range(n)]), pa.float32()), "f64": pa.array(odd([3.5 * i - 1 for i in range(n)])), "b": pa.array(odd([i % 2 == 0 for i in range(n)])),
        "s": pa.array(odd([f"str{i}" for i in range(n)])), "ls": pa.array(odd([f"l{i}" for i in range(n)]), pa.large_string()), "cat": pa.array(odd(["abc"[i % 3] for i in range(n)])).dictionary_encode(),
        "d32": pa.array(odd([dt.date(2024, 1, 1 + i) for i in range(n)])), "ts": pa.array(odd([dt.datetime(2024, 1, 1, i) for i in range(n)]), pa.timestamp("ms")), "tz": pa.array(odd([dt.datetime(2024, 1, 1, i) for i in range(n)]), pa.timestamp("ns", "UTC")),
        "dur": pa.array(odd([dt.timedelta(seconds=i) for i in range(n)]), pa.duration("ns")),
    })


def write_raw(path, table, layout="file", batches=1):
    make = pa.ipc.new_file if layout == "file" else pa.ipc.new_stream
    with make(str(path), table.schema) as w:
        step = max(1, table.num_rows // batches)
        for i in range(0, table.num_rows, step):
            for b in table.slice(i, step).combine_chunks().to_batches():
                w.write_batch(b)


@pytest.mark.parametrize("layout", ["file", "stream"])
@pytest.mark.parametrize("n,nulls", [(1, False), (6, False), (6, True)])
def test_all_types(spark, tmp_path, layout, n, nulls):
    t = all_types(n, nulls)
    write_raw(tmp_path / "t.arrow", t, layout)
    df = A.read_ipc(spark, str(tmp_path / "t.arrow"))
    assert dict(df.dtypes)["u64"] == "decimal(20,0)" and dict(df.dtypes)["u32"] == "bigint" and dict(df.dtypes)["cat"] == "string"
    assert df.schema["cat"].metadata["categorical"] == "true"
    rows = [r.asDict() for r in df.orderBy("i64").collect()] if not nulls else [r.asDict() for r in df.collect()]
    for i, r in enumerate(rows):
        if nulls and i % 2:
            assert all(v is None for v in r.values())
        else:
            assert r["u64"] == decimal.Decimal((1 << 64) - 1 - i) and r["s"] == f"str{i}" and r["cat"] == "abc"[i % 3]
            assert r["d32"] == dt.date(2024, 1, 1 + i) and r["ts"] == dt.datetime(2024, 1, 1, i) and r["dur"] == dt.timedelta(seconds=i)


def test_projection_keeps_schema_order(spark, tmp_path):
    t = pa.table({"id": pa.array([10, 20, 30], pa.int32()), "score": [1.5, 2.5, 3.5], "name": ["alice", "bob", "charlie"], "active": [True, False, True]})
    write_raw(tmp_path / "t.arrow", t)
    df = A.read_ipc(spark, str(tmp_path / "t.arrow"), columns=["active", "id"])
    assert df.columns == ["id", "active"]
    assert sorted(map(tuple, df.collect())) == [(10, True), (20, False), (30, True)]
    with pytest.raises(Exception, match="unknown column 'nope'"):
        A.read_ipc(spark, str(tmp_path / "t.arrow"), columns=["nope"]).collect()


def test_batches_and_windows(spark, tmp_path):
    t = pa.table({"k": range(4096)})
    write_raw(tmp_path / "t.arrow", t, batches=2)
    path = str(tmp_path / "t.arrow")
    df = A.read_ipc(spark, path, ids="true")
    assert df.groupBy("batch_id").count().orderBy("batch_id").collect() == [(0, 2048), (1, 2048)]
    # one task packs what is small; shares of a file's batches go to tasks by pack_bytes
    assert df.rdd.getNumPartitions() == 1
    shares = A.read_ipc(spark, path, ids="true", pack_bytes=1)
    assert shares.rdd.getNumPartitions() == 2
    assert sorted(shares.collect()) == sorted(df.collect())
    assert [r.k for r in A.read_ipc(spark, path, batch=1, window_offset=512, window_rows=2).collect()] == [2560, 2561]
    for bad in ({"batch": 2}, {"batch": 0, "window_offset": 100, "window_rows": 5}, {"batch": 0, "window_offset": 1536, "window_rows": 600}):
        with pytest.raises(Exception, match="out of range|multiple of|reaches past"):
            A.read_ipc(spark, path, **bad).collect()
    windows = A.read_ipc(spark, path, ids="true", window_bytes=8 * 512).groupBy("batch_id", "window_id").count().collect()
    assert sorted(map(tuple, windows)) == [(b, w, 512) for b in range(2) for w in range(4)]
    assert A.window_stride(2048, 2048 * 8, 8 * 1000) == 512
    assert A.window_stride(100, 800, 1) == 100
    assert A.window_stride(10_000, 80_000, 80 * 1024) == 10_000 // 512 * 512 or A.window_stride(10_000, 80_000, 80 * 1024) == 10_000


@pytest.mark.parametrize("mmap", ["true", "false"])
@pytest.mark.parametrize("compression", [None, "zstd"])
def test_write_read(spark, tmp_path, mmap, compression):
    df = spark.range(1000).selectExpr("id", "id * 0.5 as v", "cast(id % 3 as string) as t")
    A.write_ipc(df, str(tmp_path / "out"), compression=compression)
    assert A.read_ipc(spark, str(tmp_path / "out"), mmap=mmap).orderBy("id").collect() == df.collect()
    A.write_ipc(df.limit(5), str(tmp_path / "out"))
    assert A.read_ipc(spark, str(tmp_path / "out")).count() == 5


def test_pyarrow_reads_what_is_written(spark, tmp_path):
    A.write_ipc(spark.range(10).coalesce(1), str(tmp_path / "out"))
    f = next((tmp_path / "out").glob("*.arrow"))
    assert pa.ipc.open_file(str(f)).read_all()["id"].to_pylist() == list(range(10))


def test_snappy_is_refused(spark, tmp_path):
    with pytest.raises(FormatError, match="snappy"):
        A.ipc_options("snappy")
    with pytest.raises(ValueError, match="unknown compression"):
        A.ipc_options("lz5")


def test_serialise():
    t = pa.table({"a": [1, 2]})
    data = A.serialise(t.to_batches(), t.schema)
    assert A.deserialise(data) == t
    with pytest.raises(FormatError, match="trailing"):
        A.deserialise(data + b"xx")


def test_limits():
    limits = DecodeLimits(rows=5)
    limits.check("rows", 5)
    with pytest.raises(FormatError, match="resource limit exceeded"):
        limits.check("rows", 6)
    DecodeLimits.unlimited().check("frame_bytes", 1 << 62)


def test_schema_metadata_round_trip():
    s = spark_schema(pa.schema([pa.field("a", pa.uint32(), False, {"unit": "kg"}), pa.field("c", pa.dictionary(pa.uint8(), pa.string()))]))
    assert not s["a"].nullable and s["a"].metadata == {"unit": "kg", "arrow": "uint32"}
    back = arrow_schema(s)
    assert back.field("a").metadata == {b"unit": b"kg"} and pa.types.is_dictionary(back.field("c").type)


@pytest.mark.parametrize("t", [pa.float16(), pa.null(), pa.dictionary(pa.int8(), pa.int64())])
def test_unsupported_types(t):
    with pytest.raises(FormatError, match="unsupported"):
        spark_schema(pa.schema([("x", t)]))


def test_duration_below_a_microsecond_is_an_error():
    with pytest.raises(pa.ArrowInvalid):
        readable_batch(pa.record_batch({"d": pa.array([1], pa.duration("ns"))}))


def test_malformed_file(spark, tmp_path):
    (tmp_path / "bad.arrow").write_bytes(b"ARROW1\0\0garbage")
    with pytest.raises(Exception, match="Arrow|arrow|footer|Invalid"):
        A.read_ipc(spark, str(tmp_path / "bad.arrow")).collect()


@pytest.mark.parametrize("pack", [1, 6000, 128 << 20])
def test_packs_of_many_files(spark, tmp_path, pack):
    """Whatever the packing, batches keep their numbers, and ``first`` and ``batch`` count over all files."""
    sizes = [3, 0, 1, 5, 2]
    k = 0
    for i, n in enumerate(sizes):
        with pa.ipc.new_file(str(tmp_path / f"f{i}.arrow"), pa.schema([("k", pa.int64())])) as w:
            for _ in range(n):
                w.write_batch(pa.record_batch({"k": pa.array(range(k * 10, k * 10 + 10), pa.int64())}))
                k += 1
    rows = A.read_ipc(spark, str(tmp_path), ids="true", pack_bytes=pack).collect()
    assert sorted((r.k, r.batch_id, r.row_id) for r in rows) == [(x, x // 10, x % 10) for x in range(110)]
    assert sorted(r.k for r in A.read_ipc(spark, str(tmp_path), pack_bytes=pack).collect()) == list(range(110))
    for n in (0, 1, 4, 11, 50):
        assert sorted(r.k for r in A.read_ipc(spark, str(tmp_path), first=n, pack_bytes=pack).collect()) == list(range(min(110, n * 10)))
    for n in (0, 3, 10):
        assert sorted(r.k for r in A.read_ipc(spark, str(tmp_path), batch=n, pack_bytes=pack).collect()) == list(range(n * 10, n * 10 + 10))
    with pytest.raises(Exception, match="out of range"):
        A.read_ipc(spark, str(tmp_path), batch=11).collect()


def test_first_batches_of_a_stream(spark, tmp_path):
    path = str(tmp_path / "s.arrow")
    with pa.ipc.new_stream(path, pa.schema([("k", pa.int64())])) as w:
        for i in range(4):
            w.write_batch(pa.record_batch({"k": pa.array([i], pa.int64())}))
    assert sorted(r.k for r in A.read_ipc(spark, path, first=2).collect()) == [0, 1]
    assert [r.k for r in A.read_ipc(spark, path, batch=2).collect()] == [2]


def test_resized():
    batches = [pa.record_batch({"k": list(range(a, b))}) for a, b in ((0, 3), (3, 3), (3, 11), (11, 12))]
    out = list(A.resized(iter(batches), 4))
    assert [b.num_rows for b in out] == [4, 4, 4] and pa.Table.from_batches(out).column("k").to_pylist() == list(range(12))
    assert [b.num_rows for b in A.resized(iter(batches), 5)] == [5, 5, 2] and not list(A.resized(iter([]), 5))


def test_numbered_splits_one_hot_part(spark):
    from weirflow.operators.batches import numbered

    d = spark.range(1000, numPartitions=4).selectExpr("if(id < 990, 'hot', 'rare') part", "id * 7 % 1000 v")
    got = sorted((r.row_no, r.part, r.v) for r in numbered(d, "part", ["v"]).collect())
    assert [x[0] for x in got] == list(range(1000)) and [x[1:] for x in got] == sorted(x[1:] for x in got)
    assert numbered(d.limit(0), "part", ["v"]).count() == 0


def test_batch_size_of_text(spark, tmp_path):
    from weirflow import api

    (tmp_path / "t.csv").write_text("k\n" + "".join(f"{i}\n" for i in range(10)))
    with api.read(spark, str(tmp_path / "t.csv"), batch_size=4) as r:
        assert [b.num_rows for b in r] == [4, 4, 2]
