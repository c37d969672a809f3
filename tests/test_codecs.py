import zlib

import pytest
from helpers import lcg, mixed
from pyspark.sql import functions as F

from blocklens.errors import CodecError
from blocklens.operators import blocks as B
from blocklens.operators import codecs as C
from blocklens.operators import frames as Z
from blocklens.schemas import BUCKETS

TEXT = b"The quick brown fox jumps over the lazy dog, again and again. " * 400


@pytest.mark.parametrize("size", [1, 7, 1024, (1 << 20) - 13])
def test_raw_path_agrees_with_the_decoder(size):
    data = lcg(min(size, 40_000), size) * (size // 40_000 + 1)
    data = data[:size]
    frame = C.zstd_encode(data, 3)
    state, out = Z.decode_raw(frame, size)
    assert state in ("decoded", "needsFullDecoder")
    if state == "decoded":
        assert out == data
    assert C.zstd_decode(frame, size) == data


@pytest.mark.parametrize("byte", [0x00, 0x42, 0xFF])
@pytest.mark.parametrize("size", [1, 100, 65536])
def test_constant_frames(byte, size):
    data = bytes([byte]) * size
    frame = C.zstd_encode(data, 3)
    state, out = Z.decode_raw(frame, size)
    assert state != "parseError" and (state != "decoded" or out == data)
    assert C.raw_or_zstd(frame, size) == data


def test_text_needs_the_full_decoder():
    assert Z.decode_raw(C.zstd_encode(TEXT, 3), len(TEXT))[0] == "needsFullDecoder"


@pytest.mark.parametrize("frame", [b"\x28\xb5", Z.MAGIC + b"\x00", b"\xab" * 64, b""])
def test_bad_frames(frame):
    assert Z.decode_raw(frame, 1024) == ("parseError", None)


def test_rle_and_raw_blocks_by_hand():
    head = Z.MAGIC + bytes([0x20, 7])  # single segment, content size 7
    raw = (0 << 1 | 3 << 3).to_bytes(3, "little") + b"abc"
    rle = (1 | 1 << 1 | 4 << 3).to_bytes(3, "little") + b"z"
    assert Z.decode_raw(head + raw + rle, 7) == ("decoded", b"abczzzz")
    assert Z.classify_frame(head + raw + rle) == ([("noLiterals", 3), ("noLiterals", 4)], True)
    assert Z.decode_raw(head + raw + rle, 6) == ("parseError", None)
    assert Z.decode_raw(head + raw + rle[:-1], 7)[0] == "parseError"


def test_classifier():
    found, whole = Z.classify_frame(C.zstd_encode(TEXT, 3))
    assert whole and found and sum(n for _, n in found) <= len(TEXT)
    found, whole = Z.classify_frame(C.zstd_encode(lcg(8192, 1), 3))
    assert whole and not any(b == "treeless" for b, _ in found)
    assert Z.classify_frame(C.zstd_encode(TEXT, 3)[:15])[1] is False
    assert Z.classify_frame(bytes(16)) == ([], False)


def test_many_inner_blocks():
    words, seed = bytearray(), 0xCAFEBABE
    while len(words) < 512 << 10:
        seed = (seed * 6364136223846793005 + 1442695040888963407) % (1 << 64)
        words += seed.to_bytes(8, "little")
    found, whole = Z.classify_frame(C.zstd_encode(bytes(words), 3))
    assert whole and len(found) >= 4


def test_malformed_literals_in_the_last_block_are_not_fully_parsed():
    head = Z.MAGIC + bytes([0x20, 1])
    block = (1 | 2 << 1 | 1 << 3).to_bytes(3, "little") + b"\x0c"  # wants three header bytes, has one
    assert Z.classify_frame(head + block) == ([("rawLiterals", 0)], False)


def test_dominant_breaks_ties_by_order():
    assert Z.dominant([("treeless", 5), ("rleLiterals", 5)]) == "rleLiterals"
    assert Z.dominant([]) == "noLiterals"


def test_bucket_table_has_all_six(spark):
    rows = spark.createDataFrame([("treeless", 5)], "bucket string, regenerated_bytes long")
    found = Z.bucket_counts(rows).orderBy("ordinal").collect()
    assert [r["bucket"] for r in found] == BUCKETS and [r["n"] for r in found] == [0, 0, 0, 0, 0, 1]


def test_gate(spark):
    rows = lambda *x: spark.createDataFrame(list(x), "bucket string, regenerated_bytes long")
    assert Z.gate(rows(("compressed4Stream", 70), ("rawLiterals", 30), ("noLiterals", 900))).first().asDict() == {"literal_share": 70.0, "total_share": pytest.approx(7.0), "gate": "PASS"}
    assert Z.gate(rows(("noLiterals", 3))).first()["literal_share"] == 0.0


def test_deflate_failures():
    packed = C.deflate_encode(TEXT, 6)
    assert C.deflate_decode(packed, len(TEXT)) == TEXT
    for bad, size in ((packed[:-4], len(TEXT)), (packed, len(TEXT) - 1), (packed, len(TEXT) + 1), (b"\xff" * 20, 10)):
        with pytest.raises(CodecError):
            C.deflate_decode(bad, size)


def test_chunks_are_one_stream():
    parts = [TEXT[i : i + 1000] for i in range(0, len(TEXT), 1000)]
    joined = b"".join(C.deflate_chunk(p, 6, k == len(parts) - 1) for k, p in enumerate(parts))
    assert zlib.decompress(joined, -15) == TEXT


def test_zstd_caps():
    frame = C.zstd_encode(TEXT, 3)
    for capacity in (len(TEXT) - 1, C.BLOCK_CAP + 1):
        with pytest.raises(CodecError):
            C.zstd_decode(frame, capacity)
    with pytest.raises(CodecError):
        C.zstd_decode(frame[:4] + b"\xff" + frame[5:], len(TEXT))
    assert C.zstd_encode(b"", 3) == b"" and C.zstd_decode(b"", 10) == b""


def _blocks(spark, data, size=65536):
    rows = spark.createDataFrame([(0, bytearray(data))], "entry_idx long, payload binary")
    blocks = B.split_blocks(rows, size, ["entry_idx"]).withColumn("_d", F.col("data"))
    return B.block_entropy(blocks, ["entry_idx", "block_idx", "raw_off", "raw_len", "_d"]).withColumnRenamed("_d", "data")


def test_compress_blocks_has_both_dispositions(spark):
    data = mixed(1 << 20, 0xCAFEBABEDEADBEEF)
    packed = C.compress_blocks(_blocks(spark, data), level=6)
    assert {r[0] for r in packed.select("disposition").distinct().collect()} == {"stored", "compressed"}
    raw = C.decode_blocks(packed.select("entry_idx", "block_idx", "raw_off", "raw_len", F.col("frame").alias("data")), ["entry_idx", "block_idx", "raw_off"])
    recorded = spark.createDataFrame([(0, len(data), zlib.crc32(data))], "entry_idx long, uncompressed_size long, crc32 long")
    assert C.verify(raw, recorded, ["entry_idx"]).first()["ok"]
    assert {r[0] for r in C.compress_blocks(_blocks(spark, data), level=1).select("disposition").distinct().collect()} == {"compressed"}


def test_fallback_decoder_and_integrity(spark):
    data = TEXT[:20000]
    frames = C.compress_blocks(_blocks(spark, data, 4096)).select("entry_idx", "block_idx", "raw_off", "raw_len", F.col("frame").alias("data"))

    def broken(frame, capacity):
        raise CodecError("always")

    def flipped(frame, capacity):
        out = bytearray(C.zstd_decode(frame, capacity))
        out[0] ^= 1
        return bytes(out)

    recorded = spark.createDataFrame([(0, len(data), zlib.crc32(data))], "entry_idx long, uncompressed_size long, crc32 long")
    raw = C.decode_blocks(frames, ["entry_idx", "block_idx", "raw_off"], decoders=(broken, C.zstd_decode))
    assert {r[0] for r in raw.select("decoder").collect()} == {1}
    assert C.verify(raw, recorded, ["entry_idx"]).first()["ok"]
    raw = C.decode_blocks(frames, ["entry_idx", "block_idx", "raw_off"], decoders=(flipped,))
    assert not C.verify(raw, recorded, ["entry_idx"], strict=False).first()["ok"]
    with pytest.raises(Exception, match="integrity"):
        C.verify(raw, recorded, ["entry_idx"]).collect()


def test_entries_are_stored_or_deflated(spark):
    rows = spark.createDataFrame([(0, bytearray(TEXT), 4.0), (1, bytearray(lcg(5000, 2)), 7.9), (2, bytearray(b""), 0.0), (3, bytearray(b"ab"), 1.0)], "entry_idx long, payload binary, mean_entropy double")
    found = {r["entry_idx"]: r for r in C.compress_entries(rows).collect()}
    assert [found[i]["method"] for i in range(4)] == ["deflate", "stored", "stored", "stored"]
    assert C.deflate_decode(bytes(found[0]["body"]), len(TEXT)) == TEXT
    assert {r["method"] for r in C.compress_entries(rows, level=0).collect()} == {"stored"}
