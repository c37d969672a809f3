import io
import os
import stat
import subprocess
import sys
import zipfile
import zlib

import pytest
from helpers import lcg, mixed
from pyspark.sql import functions as F

from blocklens import cli
from blocklens.errors import FormatError, MissingEntriesError, UnsupportedError
from blocklens.operators import entries as E
from blocklens.operators import metrics as M
from blocklens.plans import archive
from blocklens.sources import formats as f
from blocklens.sources import tree

TEXT = "A sentence that shrinks well when it is told again. " * 3000


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    top = tmp_path_factory.mktemp("data") / "tree"
    (top / "nested").mkdir(parents=True)
    (top / "empty").mkdir()
    (top / "a.txt").write_text("alpha")
    (top / "zero.bin").write_bytes(b"")
    (top / "moderate.txt").write_text(TEXT)
    (top / "noise.bin").write_bytes(lcg(70_000, 9))
    (top / "nested/mixed.bin").write_bytes(mixed(300_000, 5, run=20_000, noise=20_000))
    (top / "nested/üñí.txt").write_text("names in UTF-8")
    os.chmod(top / "a.txt", 0o640)
    return top


def snapshot(top):
    out = {}
    for d, names, files in os.walk(top):
        out[os.path.relpath(d, top)] = None
        for n in files:
            out[os.path.relpath(os.path.join(d, n), top)] = open(os.path.join(d, n), "rb").read()
    return out


def test_walk(spark, root):
    entries, skips = tree.walk(spark, str(root))
    rows = entries.orderBy("entry_idx").collect()
    assert rows[0]["name"] == "tree/" and {r["name"] for r in rows} >= {"tree/empty/", "tree/nested/", "tree/a.txt", "tree/nested/üñí.txt"}
    assert [r["entry_idx"] for r in rows] == list(range(len(rows)))
    assert [r["name"].encode() for r in rows] == sorted(r["name"].encode() for r in rows)
    assert {r["unix_mode"] for r in rows if r["name"] == "tree/a.txt"} == {0o640}
    assert tree.total_bytes(entries).first()[0] == sum(len(v) for v in snapshot(root).values() if v)
    assert skips.count() == 0
    with pytest.raises(Exception, match="FileNotFound|no-such"):
        tree.walk(spark, str(root / "no-such"))[0].collect()


def test_hidden_and_links(spark, tmp_path):
    (tmp_path / ".hidden_dir").mkdir()
    (tmp_path / "visible.txt").write_text("v")
    (tmp_path / ".hidden_file.txt").write_text("hh")
    (tmp_path / ".hidden_dir/inner.txt").write_text("iii")
    (tmp_path / "link.txt").symlink_to("visible.txt")
    every, skips = tree.walk(spark, str(tmp_path))
    assert every.count() == 5 and {(r["rel"], r["reason"], r["items"]) for r in skips.collect()} == {("link.txt", "symlink", 1)}
    seen, skips = tree.walk(spark, str(tmp_path), exclude_hidden=True)
    assert {r["name"].split("/")[-1] for r in seen.collect()} == {"", "visible.txt"}
    assert {(r["rel"], r["bytes"], r["items"]) for r in skips.filter("reason = 'hidden'").collect()} == {(".hidden_dir", 3, 2), (".hidden_file.txt", 2, 1)}
    assert M.skip_totals(skips).filter("reason = 'hidden'").first().asDict() == {"reason": "hidden", "entries": 2, "bytes": 5, "items": 3}


def test_single_file(spark, root):
    rows = tree.walk(spark, str(root / "a.txt"))[0].collect()
    assert [(r["name"], r["size"]) for r in rows] == [("a.txt", 5)]


def test_pack_and_unpack(spark, root, tmp_path):
    target = str(tmp_path / "out.blka")
    stats = archive.pack(spark, str(root), target, level=6, block_size=16384)
    assert stats["bytes_in"] == sum(len(v) for v in snapshot(root).values() if v) and stats["bytes_out"] < stats["bytes_in"]
    entries = spark.read.format("blockarchive").load(target)
    sizes = {r["name"]: r for r in entries.collect()}
    assert sizes["tree/zero.bin"]["block_lengths"] == [] and sizes["tree/zero.bin"]["crc32"] == 0
    assert sizes["tree/empty/"]["is_directory"] and len(sizes["tree/noise.bin"]["block_lengths"]) == 5
    assert sizes["tree/noise.bin"]["crc32"] == zlib.crc32((root / "noise.bin").read_bytes())
    done = archive.unpack(spark, target, str(tmp_path / "back"))
    assert done["entries"] == entries.count()
    assert snapshot(tmp_path / "back/tree") == snapshot(root)
    assert stat.S_IMODE(os.stat(tmp_path / "back/tree/a.txt").st_mode) == 0o640
    inner, frames, gate = archive.literal_report(spark, target)
    assert inner.count() == 6 and frames.agg(F.sum("n")).first()[0] == sum(len(r["block_lengths"]) for r in sizes.values())
    assert gate.first()["gate"] in ("PASS", "FAIL")
    with pytest.raises(Exception, match="FileExists|exists"):
        archive.pack(spark, str(root), target)


def test_filters_reach_the_reader(spark, root, tmp_path):
    target = str(tmp_path / "out.blka")
    archive.pack(spark, str(root), target)
    rows = archive.unpacked(spark, target, ["tree/a.txt"]).collect()
    assert [(r["name"], bytes(r["content"])) for r in rows] == [("tree/a.txt", b"alpha")]
    with pytest.raises(MissingEntriesError, match="nope.bin"):
        archive.unpacked(spark, target, ["tree/a.txt", "nope.bin"])
    with pytest.raises(MissingEntriesError):
        archive.unpacked(spark, target, [])


def test_flipped_byte_is_an_error(spark, root, tmp_path):
    target = tmp_path / "out.blka"
    archive.pack(spark, str(root), str(target))
    data = bytearray(target.read_bytes())
    at = data.index(b"\x28\xb5\x2f\xfd") + 12
    data[at] ^= 0xFF
    target.write_bytes(bytes(data))
    with pytest.raises(Exception):
        archive.unpacked(spark, str(target)).collect()


def test_zip_and_unzip(spark, root, tmp_path):
    target = str(tmp_path / "out.zip")
    stats = archive.zip_tree(spark, str(root), target)
    assert stats["bytes_out"] < stats["bytes_in"]
    with zipfile.ZipFile(target) as z:
        assert z.testzip() is None
        found = {i.filename: i for i in z.infolist()}
        assert z.read("tree/moderate.txt").decode() == TEXT
        assert found["tree/noise.bin"].compress_type == zipfile.ZIP_STORED and found["tree/moderate.txt"].compress_type == zipfile.ZIP_DEFLATED
        assert found["tree/a.txt"].external_attr >> 16 & 0o777 == 0o640 and found["tree/empty/"].is_dir()
    assert b"PK\x06\x06" in open(target, "rb").read()
    archive.unzip(spark, target, str(tmp_path / "back"))
    assert snapshot(tmp_path / "back/tree") == snapshot(root)
    rows = archive.unzipped(spark, target, ["tree/a.txt"]).collect()
    assert [bytes(r["content"]) for r in rows] == [b"alpha"]


def test_foreign_zip(spark, tmp_path):
    path = tmp_path / "x.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.comment = b"a comment PK\x05\x06 with a false mark"
        z.writestr("abc", "abc")
        z.writestr("dir/", "")
        z.writestr("big.txt", TEXT)
    rows = {r["name"]: r for r in spark.read.format("ziparchive").load(str(path)).collect()}
    assert rows["abc"]["uncompressed_size"] == 3 and rows["dir/"]["is_directory"] and rows["big.txt"]["method"] == "deflate"
    assert {r["name"]: bytes(r["content"]) for r in archive.unzipped(spark, str(path)).collect() if not r["is_directory"]} == {"abc": b"abc", "big.txt": TEXT.encode()}
    data = bytearray(path.read_bytes())
    data[30 + 3] ^= 1
    path.write_bytes(bytes(data))
    with pytest.raises(Exception):
        archive.unzipped(spark, str(path)).collect()


def test_hostile_block_archives():
    good = f.block_header() + f.block_entry_head(f.Entry("x", block_size=1024, uncompressed_size=3, compressed_size=4, block_lengths=[4])) + b"abcd" + f.block_footer(1)
    read = lambda data: list(f.read_block_archive(io.BytesIO(data)))
    assert read(good)[0].data_offset == len(good) - 16 - 4
    for bad in (b"", good[:10], good[:-3], b"XXXX" + good[4:], good[:-20], good[:16] + b"\0\0\0\0" + good[20:]):
        with pytest.raises(FormatError):
            read(bad)
    at = 16 + 4 + 2 + 1 + 2 + 8 + 1
    for place, size, value in ((at, 4, f.MAX_BLOCK + 1), (at + 12, 8, (1 << 64) - 1), (at + 24, 4, f.MAX_BLOCKS + 1)):
        with pytest.raises(FormatError):
            read(good[:place] + value.to_bytes(size, "little") + good[place + size :])
    with pytest.raises(UnsupportedError):
        read(good[:4] + b"\x02\x00" + good[6:])


def test_hostile_zips(tmp_path):
    with zipfile.ZipFile(tmp_path / "x.zip", "w") as z:
        z.writestr("a", "abc")
    data = (tmp_path / "x.zip").read_bytes()
    read = lambda d: list(f.read_zip(io.BytesIO(d)))
    assert read(data)[0].name == "a"
    for bad in (b"", data[:-1], data[:20]):
        with pytest.raises(FormatError):
            read(bad)
    central = data.index(b"PK\x01\x02")
    with pytest.raises(UnsupportedError):
        read(data[: central + 10] + b"\x63\x00" + data[central + 12 :])
    broken = f.Entry("a", compressed_size=1 << 40, data_offset=0)
    with pytest.raises(FormatError):
        f.zip_payload(io.BytesIO(data), broken)


def test_wide_zip_entries():
    e = f.Entry("huge", uncompressed_size=5 << 32, compressed_size=5 << 32, data_offset=6 << 32, method="stored")
    record = f.zip_central(e)
    names, extras = record[28] | record[29] << 8, record[30] | record[31] << 8
    assert f._zip64(record[46 + names : 46 + names + extras], f.FULL, f.FULL, f.FULL) == (5 << 32, 5 << 32, 6 << 32)


@pytest.mark.parametrize("name, safe", [("/etc/passwd", False), ("../escape", False), ("a/../../escape", False), ("", False), ("ok\0name", False), ("sub/dir/file.txt", True), ("..a/b", True)])
def test_safe_names(spark, name, safe):
    rows = spark.createDataFrame([(name,)], "name string")
    assert E.safe_entries(rows, strict=False).count() == int(safe)
    if not safe:
        with pytest.raises(Exception, match="unsafe"):
            E.safe_entries(rows).collect()


def test_preflight(tmp_path):
    from blocklens.errors import DiskSpaceError

    E.preflight(str(tmp_path), 10, reserve=0)
    with pytest.raises(DiskSpaceError):
        E.preflight(str(tmp_path / "deep/er"), 1 << 60)


def test_command_line(spark, root, tmp_path, capsys):
    target = str(tmp_path / "c.blka")
    assert cli.main(["pack", str(root), target, "--heatmap", "--ppm", str(tmp_path / "m.ppm"), "--analyze", "--block-kb", "16"]) == 0
    assert "Compressibility Map" in capsys.readouterr().out and (tmp_path / "m.ppm").read_bytes().startswith(b"P6")
    assert cli.main(["unpack", target, "--list"]) == 0
    listed = capsys.readouterr().out
    assert "tree/nested/" in listed and "entries" in listed
    assert cli.main(["unpack", target, str(tmp_path / "o"), "--entry", "tree/a.txt", "--analyze"]) == 0
    assert (tmp_path / "o/tree/a.txt").read_text() == "alpha" and not (tmp_path / "o/tree/moderate.txt").exists()
    assert cli.main(["unpack", target, str(tmp_path / "o"), "--entry", "nope"]) == 1
    assert cli.main(["zip", str(root), str(tmp_path / "c.zip")]) == 0 and cli.main(["unzip", str(tmp_path / "c.zip"), str(tmp_path / "z")]) == 0
    assert cli.main(["info"]) == 0
    assert subprocess.run([sys.executable, "-c", "import blocklens.cli"], cwd=os.path.dirname(os.path.dirname(__file__))).returncode == 0


def test_one_entry_over_many_partitions(spark, tmp_path):
    """A large entry is read, decoded and written by many tasks, in both formats."""
    (tmp_path / "in").mkdir()
    data = mixed(900_000, 3, run=40_000, noise=10_000)
    (tmp_path / "in/large.bin").write_bytes(data)
    (tmp_path / "in/small.txt").write_text("small " * 4000)
    target = str(tmp_path / "x.blka")
    archive.pack(spark, str(tmp_path / "in"), target, block_size=8192)
    frames = spark.read.format("blockarchive").option("payload", True).option("splitBytes", 50_000).load(target)
    spread = frames.select("name", "block_idx", F.spark_partition_id().alias("p"))
    assert spread.filter("name = 'in/large.bin'").agg(F.countDistinct("p"), F.countDistinct("block_idx"), F.count("*")).first()[0:3][1:] == (110, 110)
    assert spread.filter("name = 'in/large.bin'").agg(F.countDistinct("p")).first()[0] > 2
    whole = spark.read.format("blockarchive").option("payload", True).load(target)
    assert frames.exceptAll(whole).count() == 0 and frames.count() == whole.count()
    archive.unpack(spark, target, str(tmp_path / "back"))
    assert snapshot(tmp_path / "back/in") == snapshot(tmp_path / "in")
    zipped = str(tmp_path / "x.zip")
    archive.zip_tree(spark, str(tmp_path / "in"), zipped, chunk=65536, probe_block=16384)
    with zipfile.ZipFile(zipped) as z:
        assert z.testzip() is None and z.read("in/large.bin") == data and z.getinfo("in/large.bin").compress_type == zipfile.ZIP_DEFLATED
    archive.unzip(spark, zipped, str(tmp_path / "zback"))
    assert snapshot(tmp_path / "zback/in") == snapshot(tmp_path / "in")
    bodies = spark.read.format("ziparchive").option("payload", True)
    assert bodies.option("splitBytes", 1000).load(zipped).exceptAll(bodies.option("splitBytes", 1 << 30).load(zipped)).count() == 0
    assert not [n for n in os.listdir(tmp_path) if "work" in n or "whole" in n] and not [n for n in os.listdir(tmp_path / "back") if n != "in"]


def test_damaged_archives_leave_nothing(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("something to shrink " * 5000)
    target, zipped = tmp_path / "x.blka", tmp_path / "x.zip"
    archive.pack(spark, str(tmp_path / "in"), str(target))
    data = bytearray(target.read_bytes())
    at = data.index(b"in/a.txt") + 8 + 2 + 8 + 1 + 4 + 8 + 8  # the entry's checksum
    data[at] ^= 1
    target.write_bytes(bytes(data))
    with pytest.raises(Exception, match="integrity"):
        archive.unpack(spark, str(target), str(tmp_path / "o"))
    assert not [n for _, _, names in os.walk(tmp_path / "o") for n in names]
    archive.unpack(spark, str(target), str(tmp_path / "o"), check=False)
    assert (tmp_path / "o/in/a.txt").read_bytes() == (tmp_path / "in/a.txt").read_bytes()
    archive.zip_tree(spark, str(tmp_path / "in"), str(zipped))
    data = bytearray(zipped.read_bytes())
    data[60] ^= 0x55
    zipped.write_bytes(bytes(data))
    with pytest.raises(Exception):
        archive.unzip(spark, str(zipped), str(tmp_path / "z"))
    assert not [n for _, _, names in os.walk(tmp_path / "z") for n in names]
