"""Divisor counts against trial division; the idempotent stream sink."""

import random

import numpy as np
import pytest
from pyspark.sql import types as T

from kinframe.operators import numbers as N
from kinframe.streaming import ingest


def divisors(n):
    count, p = 1, 2
    while p * p <= n:
        times = 1
        while n % p == 0:
            n, times = n // p, times + 1
        count, p = count * times, p + 1
    return count * (2 if n > 1 else 1)


def test_small_numbers():
    v = np.arange(-3, 5000)
    assert N.count_divisors(v).tolist() == [divisors(int(n)) if n > 0 else 0 for n in v]


def test_large_numbers(spark):
    big = [99999999999973, 10 ** 14, 9999991 ** 2, 9999973 * 9999991, 2 ** 46, 46411 ** 3, 46411 ** 2 * 46399, 963761198400, 2 ** 62, 2 ** 63 - 1,
           3037000493 ** 2, 999999937 * 1000003]
    want = {99999999999973: 2, 10 ** 14: 225, 9999991 ** 2: 3, 9999973 * 9999991: 4, 2 ** 46: 47, 46411 ** 3: 4, 46411 ** 2 * 46399: 6,
            963761198400: 6720, 2 ** 62: 63, 2 ** 63 - 1: 2 * 2 * 2 * 2 * 2 * 3, 3037000493 ** 2: 3, 999999937 * 1000003: 4}
    rng = random.Random(2)
    some = [rng.randrange(1, 10 ** 9) for _ in range(40)]
    frame = spark.createDataFrame([(n,) for n in big + some] + [(None,), (0,), (-5,), (1,)], "n long")
    got = {r.n: r.divisors for r in N.with_divisors(frame, "n").collect()}
    assert got == {**want, **{n: divisors(n) for n in some}, None: None, 0: 0, -5: 0, 1: 1}


SCHEMA = T.StructType([T.StructField("id", T.LongType())])


def ids(spark, out):
    return sorted(r.id for r in ingest.stored_keys(spark, out, SCHEMA).collect())


def test_replayed_batches_add_nothing(spark, tmp_path):
    out = str(tmp_path / "out")
    frame = lambda r: spark.createDataFrame([(i,) for i in r], SCHEMA)
    ingest.append_new(frame([1, 2, 2, 3]), 0, out, "s", "id")
    ingest.append_new(frame([3, 4, 5]), 1, out, "s", "id")
    assert ids(spark, out) == [1, 2, 3, 4, 5]
    ingest.append_new(frame([3, 4, 5]), 1, out, "s", "id")  # the commit of batch 1 was lost
    ingest.append_new(frame([1, 2, 2, 3]), 0, out, "s", "id")
    assert ids(spark, out) == [1, 2, 3, 4, 5]
    ingest.append_new(frame([1, 9]), 0, out, "other", "id")  # another stream into the same output
    assert ids(spark, out) == [1, 2, 3, 4, 5, 9]
    ingest.append_new(frame([]), 2, out, "s", "id")
    assert ids(spark, out) == [1, 2, 3, 4, 5, 9]


def test_crash_between_write_and_commit(spark, tmp_path, monkeypatch):
    src, out, ckpt = (str(tmp_path / d) for d in ("src", "out", "ckpt"))
    spark.range(50).write.mode("append").parquet(src)
    real = ingest.append_new

    def crash(*args):
        real(*args)
        raise RuntimeError("lost after the write")

    monkeypatch.setattr(ingest, "append_new", crash)
    with pytest.raises(Exception, match="lost after the write"):
        ingest.run_available(ingest.stream_ids(spark, src, SCHEMA, "id"), out, ckpt, "id")
    monkeypatch.setattr(ingest, "append_new", real)
    spark.range(40, 70).write.mode("append").parquet(src)
    ingest.run_available(ingest.stream_ids(spark, src, SCHEMA, "id"), out, ckpt, "id")
    assert ids(spark, out) == list(range(70))
    ingest.run_available(ingest.stream_ids(spark, src, SCHEMA, "id"), out, ckpt, "id")
    assert ids(spark, out) == list(range(70))


def test_a_batch_reads_only_its_buckets(spark, tmp_path):
    out = str(tmp_path / "out")
    ingest.append_new(spark.range(1000), 0, out, "s", "id")
    stored = spark.read.schema(T.StructType(SCHEMA.fields + [T.StructField("bucket", T.IntegerType()), T.StructField("batch", T.StringType())]))
    plan = stored.parquet(out).where("bucket IN (3, 4)")._jdf.queryExecution().toString()
    assert "PartitionFilters: [bucket" in plan.replace("isnotnull(bucket", "bucket")


def test_a_table_of_one_file_or_of_many_is_streamed_whole(spark, tmp_path):
    ids_of = lambda d: ingest.stream_ids(spark, str(tmp_path / d), SCHEMA, "id", glob="t.parquet")
    spark.range(30).repartition(3).write.parquet(str(tmp_path / "many/t.parquet"))
    spark.range(5).write.parquet(str(tmp_path / "many/other.parquet"))
    (tmp_path / "one").mkdir()
    part = next(p for p in (tmp_path / "many/t.parquet").iterdir() if p.name.startswith("part-"))
    (tmp_path / "one/t.parquet").write_bytes(part.read_bytes())
    n = spark.read.schema(SCHEMA).parquet(str(tmp_path / "one/t.parquet")).count()
    for d, want in (("many", 30), ("one", n)):
        ingest.run_available(ids_of(d), str(tmp_path / f"out-{d}"), str(tmp_path / f"ckpt-{d}"), "id")
        assert len(ids(spark, str(tmp_path / f"out-{d}"))) == want
