"""The archive sources in a session that keeps Spark's own setting: no filters for Python sources."""

import pytest

from blocklens.plans import archive
from blocklens.sources import register


@pytest.fixture()
def plain(spark):
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "false")
    register(spark)
    yield spark
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    register(spark)


@pytest.mark.parametrize("kind", ["blockarchive", "ziparchive"])
def test_without_filter_pushdown(plain, tmp_path, kind):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("alpha")
    (tmp_path / "in/b.txt").write_text("beta " * 3000)
    target = str(tmp_path / "x")
    (archive.pack if kind == "blockarchive" else archive.zip_tree)(plain, str(tmp_path / "in"), target)
    listed = plain.read.format(kind).load(target)
    assert {r["name"] for r in listed.collect()} == {"in/", "in/a.txt", "in/b.txt"}
    assert [r["name"] for r in listed.filter("name = 'in/a.txt'").collect()] == ["in/a.txt"]
    contents = archive.unpacked if kind == "blockarchive" else archive.unzipped
    assert {r["name"]: r["content"] and len(r["content"]) for r in contents(plain, target).collect()} == {"in/": None, "in/a.txt": 5, "in/b.txt": 15000}
    assert [(r["name"], bytes(r["content"])) for r in contents(plain, target, ["in/a.txt"]).collect()] == [("in/a.txt", b"alpha")]
    assert {r["name"] for r in plain.read.format(kind).option("payload", True).option("names", '["in/b.txt"]').load(target).collect()} == {"in/b.txt"}
    done = (archive.unpack if kind == "blockarchive" else archive.unzip)(plain, target, str(tmp_path / "back"), ["in/a.txt"])
    assert done["entries"] == 1 and (tmp_path / "back/in/a.txt").read_text() == "alpha"
