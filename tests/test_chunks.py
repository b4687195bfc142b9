import pytest

from weirflow.errors import FormatError
from weirflow.sources import chunks


@pytest.mark.parametrize("fmt", ["ipc", "parquet", "csv"])
def test_round_trip_in_number_order(spark, tmp_path, fmt):
    df = spark.range(120).selectExpr("id", "id div 10 as part", "concat('v', id) as t")
    paths = chunks.write_chunks(df, str(tmp_path), "base", fmt, chunk="part")
    assert len(paths) == 12 and paths[10].endswith(f"base-0000000010.{chunks.EXTENSION[fmt]}")
    got = chunks.read_chunks(spark, str(tmp_path))
    assert got.groupBy("chunk_id").min("id").orderBy("chunk_id").collect() == [(k, 10 * k) for k in range(12)]
    assert chunks.read_chunks(spark, str(tmp_path), chunk=3).count() == 10
    assert chunks.read_chunks(spark, str(tmp_path), columns=["t", "id"]).columns == ["id", "t", "chunk_id"]
    with pytest.raises(FormatError, match="out of range"):
        chunks.read_chunks(spark, str(tmp_path), chunk=12)


def test_numbers_not_names_order_files(tmp_path):
    for n in ("b-10.csv", "b-9.csv", "b-x.csv", "c-1.csv", "b-2.parquet"):
        (tmp_path / n).write_text("a\n1\n")
    assert [p[-8:] for p in chunks.list_chunks(str(tmp_path), "b", "csv")] == ["/b-9.csv", "b-10.csv"]
    with pytest.raises(FormatError, match="multiple chunk sets"):
        chunks.infer_base(str(tmp_path))
    assert chunks.infer_base(str(tmp_path), "parquet") == ("b", "parquet")
    with pytest.raises(FormatError, match="no chunked"):
        chunks.infer_base(str(tmp_path), base="zzz")


def test_appends_behind_given_number(spark, tmp_path):
    chunks.write_chunks(spark.range(4), str(tmp_path), "b", "parquet", n=2)
    chunks.write_chunks(spark.range(4, 6), str(tmp_path), "b", "parquet", n=1, start=2)
    assert chunks.read_chunks(spark, str(tmp_path)).groupBy("chunk_id").count().count() == 3
