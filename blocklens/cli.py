"""Command line: info, zip, unzip, pack, unpack."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import functions as F

from . import errors


def _parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="blocklens", description=__doc__)
    sub = top.add_subparsers(dest="command", required=True)
    sub.add_parser("info")
    for name, level in (("pack", 3), ("zip", 6)):
        p = sub.add_parser(name)
        p.add_argument("input")
        p.add_argument("output")
        p.add_argument("--level", type=int, default=level)
        p.add_argument("--block-kb", type=int, default=1024)
        if name == "zip":
            p.add_argument("--chunk-kb", type=int, default=8 << 10, help="larger entries are deflated in chunks, by many tasks")
        p.add_argument("--exclude-hidden", action="store_true")
        p.add_argument("--no-entropy-probe", action="store_true")
        p.add_argument("--heatmap", action="store_true")
        p.add_argument("--ppm")
        p.add_argument("--overwrite", action="store_true")
        p.add_argument("--analyze", action="store_true")
    for name in ("unpack", "unzip"):
        p = sub.add_parser(name)
        p.add_argument("archive")
        p.add_argument("output", nargs="?")
        p.add_argument("--list", action="store_true")
        p.add_argument("--entry", action="append")
        p.add_argument("--no-post-verify", action="store_true")
        p.add_argument("--analyze", action="store_true")
    return top


def main(argv: list[str] | None = None) -> int:
    args = _parser().parse_args(argv)
    from .operators import entries, metrics, render
    from .plans import archive
    from .session import session
    from .sources import tree

    try:
        spark = session()
        if args.command == "info":
            import os
            import zlib

            print(f"spark {spark.version}, zlib {zlib.ZLIB_RUNTIME_VERSION}, cores {os.cpu_count()}")
        elif args.command in ("pack", "zip"):
            block = args.block_kb << 10
            if args.command == "pack":
                stats = archive.pack(spark, args.input, args.output, args.level, block, args.exclude_hidden, not args.no_entropy_probe, args.overwrite)
            else:
                stats = archive.zip_tree(spark, args.input, args.output, args.level, args.exclude_hidden, not args.no_entropy_probe, args.overwrite, chunk=args.chunk_kb << 10)
            print(f"{stats['entries']} entries, {stats['bytes_in']} bytes in, {stats['bytes_out']} bytes out, {stats['elapsed']:.2f} s")
            if args.heatmap or args.ppm:
                _, blocks, _ = archive.packed_blocks(spark, args.input, args.level, block, args.exclude_hidden)
                samples = blocks.select("entry_idx", "block_idx", "entropy", F.col("raw_len").alias("original_bytes"), F.col("comp_len").alias("stored_bytes"), "disposition")
                if args.heatmap:
                    for text in render.ansi_lines(samples, metrics.heatmap_summary(samples).first().asDict(), order=["entry_idx", "block_idx"], elapsed=stats["elapsed"]):
                        print(text, end="")
                if args.ppm:
                    with open(args.ppm, "wb") as file:
                        file.writelines(render.ppm_rows(samples, order=["entry_idx", "block_idx"]))
            if args.analyze:
                print(render.skips_text(tree.walk(spark, args.input, args.exclude_hidden)[1]))
        else:
            kind = "blockarchive" if args.command == "unpack" else "ziparchive"
            if args.list:
                rows = spark.read.format(kind).load(args.archive)
                rows = entries.filter_entries(rows, args.entry) if args.entry else rows
                print(render.listing_text(args.archive, entries.listing(rows)), end="")
                return 0
            run = archive.unpack if args.command == "unpack" else archive.unzip
            stats = run(spark, args.archive, args.output or ".", args.entry, not args.no_post_verify)
            print(f"{stats['entries']} entries, {stats['bytes_out']} bytes out, {stats['elapsed']:.2f} s")
            if args.analyze and args.command == "unpack":
                inner, frames, gate = archive.literal_report(spark, args.archive)
                seen = frames.agg(F.sum("n")).first()[0] or 0
                print(render.literal_text(inner, frames, gate, seen, 0))
    except (errors.BlocklensError, FileNotFoundError, FileExistsError) as error:
        print(f"blocklens: {error}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
