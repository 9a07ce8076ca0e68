import hashlib

from pyspark.sql import functions as F

from plurality.functions.hashing import bucket_index, md5_lo64_decimal, unit_uniform


def lo64(text: str) -> int:
    return int.from_bytes(hashlib.md5(text.encode()).digest()[8:16], "little")


def test_lo64_matches_digest_bytes(spark):
    keys = ["", "a", "demo-0", "demo-12345", "ünïcode", "x" * 300]
    df = spark.createDataFrame([(k,) for k in keys], "k string")
    got = {r.k: int(r.h) for r in df.select("k", md5_lo64_decimal(F.col("k")).alias("h")).collect()}
    assert got == {k: lo64(k) for k in keys}


def test_uniform_and_bucket(spark):
    df = spark.createDataFrame([("1",), ("2",), (None,)], "k string")
    rows = df.select("k", unit_uniform("s", F.col("k"), "alpha").alias("u"), bucket_index(F.col("k"), "color", 5).alias("b")).collect()
    for r in rows:
        if r.k is None:
            assert r.u is None
        else:
            assert r.u == lo64(f"s:{r.k}:alpha") / 2**64
            assert r.b == lo64(f"{r.k}:color") % 5
