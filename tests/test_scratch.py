"""Scratch trees are packed in waves that free their files."""

import os

import pytest

from blocklens.plans import archive
from blocklens.sources import tree


@pytest.mark.parametrize("kind", ["blka", "zip"])
def test_scratch_trees(spark, tmp_path, kind):
    (tmp_path / "in/sub").mkdir(parents=True)
    for i in range(9):
        (tmp_path / f"in/sub/{i}.txt").write_text(f"text {i} " * 400 * (i % 3))
    (tmp_path / "in/noise.bin").write_bytes(os.urandom(9000))
    run, size = (archive.pack, {"block_size": 1024}) if kind == "blka" else (archive.zip_tree, {"chunk": 1024, "probe_block": 1024})
    kept = run(spark, str(tmp_path / "in"), str(tmp_path / "kept"), **size)
    assert len([n for _, _, names in os.walk(tmp_path / "in") for n in names]) == 10
    spent = run(spark, str(tmp_path / "in"), str(tmp_path / "spent"), scratch=True, **size)
    assert {k: kept[k] for k in ("entries", "bytes_in", "bytes_out")} == {k: spent[k] for k in ("entries", "bytes_in", "bytes_out")}
    assert (tmp_path / "kept").read_bytes() == (tmp_path / "spent").read_bytes()
    assert not [n for _, _, names in os.walk(tmp_path / "in") for n in names]


def test_blocks_are_read_by_many_tasks(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(bytes(64 << 10))
    found = tree.contents(tree.walk(spark, str(tmp_path))[0], 1024)
    assert found.rdd.getNumPartitions() == 2 * spark.sparkContext.defaultParallelism and found.count() == 64
