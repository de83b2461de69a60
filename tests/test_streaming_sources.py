"""Streaming cleaning + cube on a file stream; raw CSV source contract; fingerprints."""

import pytest

from tallyspark.operators import cleaning as C
from tallyspark.operators import dashboard as D
from tallyspark.sources import files as FS
from tallyspark.streaming.clean_stream import clean_stream, cube_stream, read_raw_stream


def _rows():
    out = []
    for i in range(40):
        item = "" if i % 5 == 0 else f"I{i % 3}"
        price = "" if i % 7 == 0 else f"{1 + i % 3}.5"
        out.append((f"t{i}", f"CUST_{i % 4}", f"C{i % 3}", item, price, "2", f"{2 * (1 + i % 3) + 1}.0",
                    "Cash", "Online" if i % 2 else "In-store", f"2024-0{1 + i % 3}-1{i % 9}", "True"))
    return out


def test_raw_csv_roundtrip_and_contract(spark, raw_df, tmp_path):
    df = raw_df(_rows())
    path = str(tmp_path / "raw_csv")
    FS.write_raw_csv(df, path)
    back = FS.read_raw_csv(spark, path)
    assert back.count() == 40
    assert FS.content_fingerprint(C.clean(back)).first() == FS.content_fingerprint(C.clean(df)).first()
    with pytest.raises(ValueError):
        FS.check_source_schema(["Transaction ID", "Customer"])


def test_stream_matches_batch(spark, raw_df, tmp_path):
    df = raw_df(_rows())
    path = str(tmp_path / "stream_in")
    FS.write_raw_csv(df.repartition(3), path)
    spark.read.option("header", True).csv(path)  # materialise listing
    history = C.clean(df)
    stream = clean_stream(read_raw_stream(spark, path), history)
    q = (cube_stream(stream).writeStream.outputMode("update").format("memory").queryName("cube_out")
         .option("checkpointLocation", str(tmp_path / "ck")).start())
    q.processAllAvailable()
    q.stop()
    got = spark.sql("SELECT * FROM cube_out")
    # last update per key is the final value
    final = {(r["month"], r["location"], r["category"]): (r["rows"], r["valid"], r["sales"]) for r in got.collect()}
    batch = {(r["month"], r["location"], r["category"]): (r["rows"], r["valid"], r["sales"])
             for r in D.build_cube(history).collect()}
    assert final == batch
