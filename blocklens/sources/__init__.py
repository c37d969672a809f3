"""Sources and sinks: archives and directory trees as Spark data sources, tables as payloads."""

from __future__ import annotations


def register(spark) -> None:
    """Makes ``blockarchive``, ``ziparchive`` and ``filetree`` known to ``spark.read`` and ``df.write``."""
    from .archives import BlockArchive, PushedBlockArchive, PushedZipArchive, ZipArchive
    from .tree import FileTree

    # Spark fails on a reader that takes filters while this is off, as it is by default
    pushed = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false").lower() == "true"
    for source in ((PushedBlockArchive, PushedZipArchive) if pushed else (BlockArchive, ZipArchive)) + (FileTree,):
        spark.dataSource.register(source)
