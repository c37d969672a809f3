import zlib

import pytest
from helpers import lcg, mixed
from pyspark.sql import functions as F

from blocklens.functions import checksum
from blocklens.operators import blocks as B


def payloads(spark, *data):
    return spark.createDataFrame([(i, bytearray(d) if d is not None else None) for i, d in enumerate(data)], "entry_idx long, payload binary")


def entropies(spark, data, block):
    rows = B.block_entropy(B.split_blocks(payloads(spark, data), block, ["entry_idx"]), ["entry_idx", "block_idx"]).orderBy("block_idx").collect()
    return [(r["byte_count"], r["entropy"]) for r in rows]


@pytest.mark.parametrize("data, expected", [(bytes(range(256)), 8.0), (b"\x42" * 4096, 0.0), (b"\x01\x00" * 2048, 1.0)])
def test_known_entropies(spark, data, expected):
    assert entropies(spark, data, 1 << 20)[0][1] == pytest.approx(expected, abs=1e-9)


def test_constant_blocks(spark):
    assert entropies(spark, b"\xaa" * 1024 + b"\xbb" * 1024 + b"\xcc" * 1024, 1024) == [(1024, 0.0)] * 3


def test_ragged_tail(spark):
    found = entropies(spark, bytes(i & 0xFF for i in range(2148)), 1024)
    assert [n for n, _ in found] == [1024, 1024, 100]
    assert [round(e, 4) for _, e in found] == [8.0, 8.0, 6.6439]


def test_noise_is_incompressible(spark):
    data = lcg(65536, 0xDEADBEEFCAFEBABE)
    assert round(entropies(spark, data, 1 << 20)[0][1], 4) == 7.9972
    assert zlib.crc32(data) == 0x04B83365


def test_mixed_blocks(spark):
    data = mixed(3 * (1 << 20) + 12345, 0xAA555AA5C0DEC0DE)
    found = entropies(spark, data, 65536)
    assert len(found) == 49 and sum(e >= 7.5 for _, e in found) == 24
    assert zlib.crc32(data) == 0xED3061EE


def test_empty_and_null_have_no_blocks(spark):
    assert B.split_blocks(payloads(spark, b"", None), 1024, ["entry_idx"]).count() == 0


def test_plans_agree(spark):
    rows = B.split_blocks(payloads(spark, lcg(5000, 7), b"hello world" * 99, b"\x00" * 3000), 1024, ["entry_idx"])
    keys = ["entry_idx", "block_idx"]
    arrow, plain = B.byte_histogram(rows, keys), B.byte_histogram_plan(rows, keys)
    assert sorted(arrow.collect()) == sorted(plain.select(*arrow.columns).collect())
    a = {(r[0], r[1]): r["entropy"] for r in B.block_entropy(rows, keys).collect()}
    b = {(r[0], r[1]): r["entropy"] for r in B.entropy_plan(plain, keys).collect()}
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k], abs=1e-9) for k in a)


def test_min_probe_bytes(spark):
    rows = B.split_blocks(payloads(spark, lcg(2000, 1)), 1024, ["entry_idx"])
    assert [r["entropy"] > 0 for r in B.block_entropy(rows, ["block_idx"], min_probe_bytes=1024).orderBy("block_idx").collect()] == [True, False]


@pytest.mark.parametrize("a, b", [(b"", b""), (b"abc", b""), (b"", b"abc"), (b"hello", b"world"), (lcg(2000, 5), lcg(3001, 6))])
def test_combine(a, b):
    assert checksum.combine(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


def test_combine_over_a_long_run():
    assert checksum.combine(zlib.crc32(b"x"), zlib.crc32(bytes(10_000_000)), 10_000_000) == zlib.crc32(b"x" + bytes(10_000_000))


@pytest.mark.parametrize("block", [1, 7, 1024, 4096])
def test_fold_equals_whole(spark, block):
    data = [lcg(3001, 3), b"123456789", b"x"]
    rows = B.split_blocks(payloads(spark, *data), block, ["entry_idx"]).withColumn("crc32", F.crc32("data"))
    found = {r["entry_idx"]: (r["crc32"], r["size"]) for r in checksum.fold_crc32(rows, ["entry_idx"]).collect()}
    assert found == {i: (zlib.crc32(d), len(d)) for i, d in enumerate(data)}
    assert found[1][0] == 0xCBF43926


def test_offsets(spark):
    entries = spark.createDataFrame([(0, 100, 1024, 2500, [10, 20, 30]), (1, 500, 1024, 0, [])], "entry_idx long, data_offset long, block_size long, uncompressed_size long, block_lengths array<long>")
    rows = B.block_offsets(entries, ["entry_idx"]).orderBy("block_idx").collect()
    assert [(r["comp_off"], r["comp_len"], r["raw_off"], r["raw_len"]) for r in rows] == [(100, 10, 0, 1024), (110, 20, 1024, 1024), (130, 30, 2048, 452)]


def test_runs(spark):
    rows = spark.createDataFrame([(i, s, 0) for i, s in enumerate([1, 2, 50, 60, 3, 4])], "entry_idx long, size long, g long")
    assert [r["run"] for r in B.runs(rows, 50, ["g"]).orderBy("entry_idx").collect()] == [0, 0, 1, 2, 3, 3]
