"""Texts and images of small, collected results (driver side)."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import islice

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..schemas import BUCKETS

RESET = "\x1b[0m"


def _cells(samples: DataFrame, order: list[str], depth: float) -> tuple[int, Iterator]:
    """The number of samples and their cells, fetched part by part."""
    ratio = S.sample_ratio(F.col("stored_bytes"), F.col("original_bytes"))
    bright = S.cell_brightness(ratio, depth)
    rows = samples.orderBy(*order).select(S.colour(F.col("entropy"), bright).alias("front"), S.colour(F.col("entropy"), bright * 0.25).alias("back"), S.bar_glyph(ratio).alias("bar"))
    return samples.count(), rows.toLocalIterator()


def _boxed(text: str, width: int, visible: int | None = None) -> str:
    return "│" + text + " " * max(0, width - (len(text) if visible is None else visible)) + "│\n"


def ansi_map(samples: DataFrame, summary: dict, order: list[str] = ("entropy",), **how) -> str:
    """``ansi_lines`` as one text."""
    return "".join(ansi_lines(samples, summary, order, **how))


def ansi_lines(samples: DataFrame, summary: dict, order: list[str] = ("entropy",), width: int = 64, title: str = "Compressibility Map", lines: list[str] = (), legend: bool = True, totals: bool = True, elapsed: float | None = None) -> Iterator[str]:
    """Header, grid, legend and summary, line by line; ``summary`` is a row of ``metrics.heatmap_summary`` as a dict."""
    size, cells = _cells(samples, list(order), 0.45)
    if not size:
        yield "  (no compressible blocks recorded)\n"
        return
    inner = width - 2
    paint = lambda kind, c: f"\x1b[{kind};2;{c['r']};{c['g']};{c['b']}m"
    yield "╭" + "─" * inner + "╮\n" + _boxed(f"  {title}", inner) + "".join(_boxed("  " + x, inner) for x in lines) + "├" + "─" * inner + "┤\n" + _boxed("", inner)
    columns = min(max(8, inner - 4), max(8, size))
    while row := list(islice(cells, columns)):
        yield _boxed("  " + "".join(paint(38, c["front"]) + paint(48, c["back"]) + c["bar"] + RESET for c in row), inner, 2 + len(row))
    out = _boxed("", inner)
    if legend:
        steps = max(16, min(inner - 6, 48))
        spark = samples.sparkSession
        ramp = spark.range(steps).select(S.colour(F.col("id") / (steps - 1) * 8, F.lit(1.0)).alias("c"), "id").orderBy("id").collect()
        out += "├" + "─" * inner + "┤\n" + _boxed("  Entropy ramp:", inner) + _boxed("    " + "".join(paint(38, r["c"]) + "█" + RESET for r in ramp), inner, 4 + steps)
        out += _boxed("    0 bit/byte ◀── compressible ──▶ 8 bit/byte (random)", inner) + _boxed("    Bar height: stored/original ratio", inner)
    if totals:
        out += "├" + "─" * inner + "┤\n"
        count = summary["compressed_blocks"] + summary["stored_blocks"]
        out += _boxed(f"  Blocks:      {count:8d}  total", inner)
        for label, n in (("Compressed:", summary["compressed_blocks"]), ("Stored:    ", summary["stored_blocks"])):
            part = n / count if count else 0
            filled = math.floor(part * 24 + 0.5)
            out += _boxed(f"  {label} {n:7d}  ({part * 100:5.1f}%)  " + "█" * filled + "·" * (24 - filled), inner)
        mb = lambda n: n / 1e6
        out += _boxed(f"  Mean entropy: {summary['mean_entropy']:.2f} bits/byte", inner)
        out += _boxed(f"  Bytes in/out: {mb(summary['total_original']):.2f} MB → {mb(summary['total_stored']):.2f} MB  ({summary['overall_ratio'] * 100:.2f}%)", inner)
        if elapsed:
            out += _boxed(f"  Throughput:   {elapsed:.2f} s wall, {mb(summary['total_original']) / elapsed:.0f} MB/s", inner)
    yield out + "╰" + "─" * inner + "╯\n"


def ppm_map(samples: DataFrame, order: list[str] = ("entropy",), **how) -> bytes:
    """``ppm_rows`` as one image."""
    return b"".join(ppm_rows(samples, order, **how))


def ppm_rows(samples: DataFrame, order: list[str] = ("entropy",), cell: int = 16, columns: int = 64) -> Iterator[bytes]:
    """Binary PPM image, a square of ``cell`` pixels per sample: its header, then a strip per row of samples."""
    size, cells = _cells(samples, list(order), 0.55)
    across = max(1, min(columns, size))
    yield f"P6\n{across * cell} {-(-size // across) * cell}\n255\n".encode()
    while row := list(islice(cells, across)):
        line = b"".join(bytes((c["front"]["r"], c["front"]["g"], c["front"]["b"])) * cell for c in row)
        yield line.ljust(across * cell * 3, b"\0") * cell


def listing_text(archive: str, rows: DataFrame) -> str:
    """A table of ``entries.listing`` rows with its total, in archive order."""
    out, total, count = [f"Archive: {archive}", "       Size  Modified (UTC)         Name", "  ---------  -------------------    ----"], 0, 0
    for r in rows.orderBy("entry_idx").toLocalIterator():
        out.append(f"  {r['size']:>9}  {r['modified']}    {r['name']}")
        total, count = total + r["size"], count + 1
    return "\n".join([*out, "  ---------", f"  {total:>9}                        {count} entries"]) + "\n"


def _size(n: float) -> str:
    for factor, unit in S.UNITS[1:]:
        if n >= factor:
            return f"{n / factor:.2f} {unit}"
    return f"{n:.0f} B"


def stage_text(rows: DataFrame) -> str:
    """Lines of a ``metrics.stage_table``, wall stages first."""
    out = ""
    for r in sorted(rows.collect(), key=lambda r: (r["kind"] != "wall", r["stage"] == "(unaccounted)", r["stage"])):
        per = f" ({r['ms_per_batch']:.2f} ms/batch)" if r["ms_per_batch"] is not None else ""
        out += f"    {r['stage']:<20.20}  {r['seconds']:8.3f} s  {r['percent']:5.1f} %{per}\n"
    return out


def analyze_text(kind: str, stats: dict, stages: DataFrame, batches: int = 0, batch_bytes: int = 0, fallback_blocks: int = 0, wall: float = 0.0) -> str:
    """Report of a pack or unpack run."""
    seconds = stats["elapsed"]
    rate = lambda n: "?" if not seconds else (f"{n / 1e9 / seconds:.2f} GB/s" if n / 1e6 / seconds >= 1000 else f"{n / 1e6 / seconds:.0f} MB/s")
    lines = [f"=== analyze: {kind} ===", f"total wall:      {seconds:8.3f} s", f"codec wall:      {wall:8.3f} s", f"entries:         {stats['entries']}"]
    if "bytes_in" in stats:
        share = stats["bytes_out"] / stats["bytes_in"] * 100 if stats["bytes_in"] else 0.0
        lines += [f"bytes in:        {_size(stats['bytes_in'])} ({rate(stats['bytes_in'])})", f"bytes out:       {_size(stats['bytes_out'])} (ratio {share:5.1f} %)"]
    else:
        lines += [f"bytes out:       {_size(stats['bytes_out'])} ({rate(stats['bytes_out'])})"]
    lines.append(f"batches:         {batches}")
    if batches:
        lines.append(f"avg batch size:  {batch_bytes / batches / (1 << 20):8.2f} MiB")
    if kind == "unpack":
        lines.append(f"fallback blocks: {fallback_blocks}")
    return "\n  ".join(lines) + "\n\n  stages:\n" + stage_text(stages)


def skips_text(skips: DataFrame) -> str:
    """What a walk left out: totals, the eight largest hidden items, the first five links."""
    from .metrics import skip_totals, top_skips

    sums = {r["reason"]: r for r in skip_totals(skips).collect()}
    if not sums:
        return "  walk skip summary: nothing skipped\n"
    out = "  walk skip summary:\n"
    if hidden := sums.get("hidden"):
        out += f"    hidden:    {hidden['entries']} top-level entries, {hidden['items']} items total ({_size(hidden['bytes'])})\n"
        top = top_skips(skips).collect()
        for r in top:
            out += f"      {r['rel']:<36.36}  {_size(r['bytes'])}" + (f"  ({r['items']} items)" if r["items"] > 1 else "") + "\n"
        if hidden["entries"] > len(top):
            out += f"      ... and {hidden['entries'] - len(top)} more hidden entries\n"
    if links := sums.get("symlink"):
        out += f"    symlinks:  {links['entries']} entries (always skipped)\n"
        first = skips.filter("reason = 'symlink'").orderBy("rel").limit(5).collect()
        out += "".join(f"      {r['rel']}\n" for r in first)
        if links["entries"] > len(first):
            out += f"      ... and {links['entries'] - len(first)} more symlinks\n"
    return out


#: Labels of the literal buckets.
_LABELS = dict(zip(BUCKETS, ["Raw/RLE (no literals)", "Raw_Literals_Block", "RLE_Literals_Block", "Compressed_1Stream", "Compressed_4Stream", "Treeless_Literals_Block"], strict=True))


def literal_text(inner: DataFrame, frames: DataFrame, gate: DataFrame, seen: int, unparsed: int) -> str:
    """Both literal distributions and the gate."""
    out = f"=== analyze: literal sections ===\n  frames classified: {seen}\n  unparseable frames: {unparsed}" + (f"  ({unparsed / seen * 100:.2f} %)" if seen else "") + "\n"
    for title, table in (("inner blocks", inner), ("frames by dominant bucket", frames)):
        rows = table.orderBy("ordinal").collect()
        n, size = max(1, sum(r["n"] for r in rows)), max(1, sum(r["regenerated_bytes"] for r in rows))
        out += f"\n  {title}:\n" + "".join(f"    {_LABELS[r['bucket']]:<26}{r['n']:9d}  ({r['n'] / n * 100:5.1f} %)  {_size(r['regenerated_bytes']):<9}  ({r['regenerated_bytes'] / size * 100:5.1f} %)\n" for r in rows)
    g = gate.first()
    return out + f"\n  four-stream share of literal-bearing bytes: {g['literal_share']:.2f} %  [{g['gate']} ≥ 70 %]\n  four-stream share of all bytes: {g['total_share']:.2f} %\n"


def progress_bar(phase: str, processed: int, total: int, rate: float, eta: float | None, width: int = 80) -> str:
    """One line that drops its right columns, then narrows its bar (24 to 8 cells), to fit ``width``."""
    part = min(1.0, processed / total) if total else None
    share = f"{part * 100:5.1f}%" if part is not None else "  --  "
    seconds = None if eta is None or math.isinf(eta) or math.isnan(eta) else math.floor(eta + 0.5)
    if seconds is None:
        left = "  ?  "
    elif seconds < 60:
        left = f"{seconds:2d}s"
    elif seconds < 3600:
        left = f"{seconds // 60}:{seconds % 60:02d}"
    else:
        left = f"{seconds // 3600}:{seconds % 3600 // 60:02d}:{seconds % 60:02d}"
    columns = [f"{_size(processed)} / {_size(total)}", f"{_size(rate)}/s", f"ETA {left}"]
    for kept in range(len(columns), -1, -1):
        for cells in (24, 16, 8):
            filled = math.floor((part or 0) * cells)
            bar = "[" + ("·" * cells if part is None else "█" * filled + "░" * (cells - filled)) + "]"
            line = "  ".join([phase, bar, share, *columns[:kept]])
            if len(line) <= width:
                return line
    return line[:width]
