"""Scalar functions as Spark expressions; all of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INCOMPRESSIBLE = 7.5  # bits per byte

#: The colour ramp's stops, bits per byte and RGB.
RAMP = [
    (0.0, (24, 35, 110)),
    (3.0, (35, 130, 165)),
    (5.5, (70, 180, 110)),
    (6.8, (235, 200, 90)),
    (7.5, (235, 130, 85)),
    (8.0, (210, 60, 70)),
]
#: Bars by rising ratio.
BARS = ["▁", "▂", "▃", "▄", "▅", "▆", "▇", "█"]
#: Decimal units.
UNITS = [(1_000_000_000_000, "TB"), (1_000_000_000, "GB"), (1_000_000, "MB"), (1_000, "KB")]


def clamp(x: Column, low, high) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def incompressible(entropy: Column, threshold: float = INCOMPRESSIBLE) -> Column:
    return entropy >= F.lit(threshold)


def clamp_deflate_level(level: Column) -> Column:
    return clamp(level, 0, 12)


def clamp_zlib_level(level: Column) -> Column:
    return clamp(level, 0, 9)


def clamp_zstd_level(level: Column) -> Column:
    return clamp(level, 1, 22)


def crc32(data: Column) -> Column:
    """CRC32 (IEEE) of a binary column; a null has none."""
    return F.crc32(data)


# Decisions -----------------------------------------------------------------


def zip_method(level: Column, size: Column, entropy: Column, compressed: Column | None = None, threshold: float = INCOMPRESSIBLE) -> Column:
    """``stored`` or ``deflate`` for a ZIP entry.

    Level 0, empty and incompressible entries are stored without a codec run;
    with ``compressed`` (null where no codec ran) so are those that do not shrink.
    """
    stored = (level == 0) | (size == 0) | incompressible(F.coalesce(entropy, F.lit(0.0)), threshold)
    if compressed is not None:
        stored = stored | F.coalesce(compressed >= size, F.lit(False))
    return F.when(stored, "stored").otherwise("deflate")


def block_level(base: Column, entropy: Column, enabled: Column | bool = True, threshold: float = INCOMPRESSIBLE) -> Column:
    """Level of a block of a block archive: incompressible ones fall to 1."""
    enabled = enabled if isinstance(enabled, Column) else F.lit(enabled)
    return F.when(enabled & incompressible(entropy, threshold) & (base > 1), F.lit(1)).otherwise(base)


def disposition_zip(method: Column, entropy: Column, threshold: float = INCOMPRESSIBLE) -> Column:
    """In ZIP samples a block counts as stored if its entry is, or if it is incompressible itself."""
    return F.when((method == "stored") | incompressible(entropy, threshold), "stored").otherwise("compressed")


def disposition_blocks(base: Column, used: Column) -> Column:
    """In block archives ``stored`` means lowered to level 1 (still a frame); at base level 1 nothing is."""
    return F.when((base > 1) & (used == 1), "stored").otherwise("compressed")


def attributed_bytes(block_bytes: Column, stored: Column, original: Column) -> Column:
    """An entry's stored bytes shared out over its blocks by their size."""
    return F.when(original > 0, F.round(block_bytes * stored / original)).otherwise(0).cast("long")


def sample_ratio(stored: Column, original: Column) -> Column:
    return F.when(original > 0, stored / original).otherwise(F.lit(1.0))


# Names ---------------------------------------------------------------------


def safe_path(name: Column) -> Column:
    """True unless the name is empty, holds NUL, is absolute or has a ``..`` segment; null is unsafe."""
    return F.coalesce((name != "") & ~F.contains(name, F.lit("\0")) & ~F.startswith(name, F.lit("/")) & ~F.array_contains(F.split(name, "/"), ".."), F.lit(False))


def join_path(folder: Column, name: Column) -> Column:
    """``folder/name``; a slash at the folder's end counts once."""
    return F.concat(F.regexp_replace(folder, "/$", ""), F.lit("/"), name)


def entry_name(name: Column, is_directory: Column) -> Column:
    """Directory names end in ``/``."""
    return F.when(is_directory & ~F.endswith(name, F.lit("/")), F.concat(name, F.lit("/"))).otherwise(name)


def parent_dir(name: Column) -> Column:
    """Directory that must exist before the entry can be written; a directory names itself. Root: empty."""
    return F.when(F.endswith(name, F.lit("/")), F.regexp_replace(name, "/+$", "")).otherwise(F.regexp_replace(name, "/?[^/]*$", ""))


def hidden(rel: Column) -> Column:
    return rel.rlike(r"(^|/)\.[^/]")


# Dates ---------------------------------------------------------------------


def dos_date(ts: Column) -> Column:
    """MS-DOS date word; years before 1980 count as 1980."""
    year = F.greatest(F.year(ts), F.lit(1980)) - 1980
    return F.shiftleft(year, 9).bitwiseOR(F.shiftleft(F.month(ts), 5)).bitwiseOR(F.dayofmonth(ts))


def dos_time(ts: Column) -> Column:
    """MS-DOS time word, in steps of two seconds."""
    return F.shiftleft(F.hour(ts), 11).bitwiseOR(F.shiftleft(F.minute(ts), 5)).bitwiseOR(F.floor(F.second(ts) / 2).cast("int"))


def from_dos(date: Column, time: Column) -> Column:
    """Timestamp (UTC session) of a date and a time word; impossible ones are the epoch."""
    bits = lambda x, shift, mask: F.shiftright(x, shift).bitwiseAND(F.lit(mask))
    made = F.try_make_timestamp(
        bits(date, 9, 0x7F) + 1980, F.greatest(bits(date, 5, 0x0F), F.lit(1)), F.greatest(bits(date, 0, 0x1F), F.lit(1)),
        bits(time, 11, 0x1F), bits(time, 5, 0x3F), (bits(time, 0, 0x1F) * 2).cast("decimal(8,6)"),
    )
    return F.coalesce(made, F.timestamp_seconds(F.lit(0)))


# Formats: ties go to the even digit, as in C's printf ---------------------------


def _fixed(form: str, x: Column, digits: int) -> Column:
    return F.format_string(form, F.bround(x, digits))


def human_bytes(n: Column) -> Column:
    """Padded decimal size, as progress lines show it."""
    out = _fixed("%6.0f B ", n.cast("double"), 0)
    for factor, unit in reversed(UNITS):
        out = F.when(n >= factor, _fixed(f"%6.2f {unit}", n / F.lit(float(factor)), 2)).otherwise(out)
    return out


def report_bytes(n: Column) -> Column:
    """Decimal size up to GB, as reports show it."""
    out = F.format_string("%.0f B", n.cast("double"))
    for factor, unit in reversed(UNITS[1:]):
        out = F.when(n >= factor, _fixed(f"%.2f {unit}", n / F.lit(float(factor)), 2)).otherwise(out)
    return out


def preflight_bytes(n: Column) -> Column:
    gb = n / F.lit(1e9)
    return F.when(gb >= 10, _fixed("%.1f GB", gb, 1)).when(gb >= 0.1, _fixed("%.2f GB", gb, 2)).otherwise(_fixed("%.1f MB", n / F.lit(1e6), 1))


def throughput(n: Column, seconds: Column) -> Column:
    rate = n / F.lit(1e6) / F.when(seconds > 0, seconds)
    return F.when(rate.isNull(), "?").when(rate >= 1000, _fixed("%.2f GB/s", rate / 1000, 2)).otherwise(_fixed("%.0f MB/s", rate, 0))


def eta_text(seconds: Column) -> Column:
    s = F.round(seconds).cast("long")
    minutes, rest, hours = F.floor(s / 60).cast("long"), F.pmod(s, F.lit(60)), F.floor(s / 3600).cast("long")
    return (
        F.when(seconds.isNull() | (seconds == float("inf")) | F.isnan(seconds), "  ?  ").when(s < 60, F.format_string("%2ds", s)).when(s < 3600, F.format_string("%d:%02d", minutes, rest))
        .otherwise(F.format_string("%d:%02d:%02d", hours, F.pmod(minutes, F.lit(60)), rest))
    )


def bar_glyph(ratio: Column) -> Column:
    step = F.round(clamp(ratio.cast("double"), 0.0, 1.0) * (len(BARS) - 1)).cast("int")
    return F.element_at(F.array(*[F.lit(b) for b in BARS]), step + 1)


def colour(entropy: Column, brightness: Column) -> Column:
    """Struct ``r, g, b`` of an entropy on the ramp, dimmed; components are cut to whole numbers."""
    e, dim = clamp(entropy.cast("double"), 0.0, 8.0), clamp(brightness.cast("double"), 0.0, 1.0)

    def channel(k: int) -> Column:
        out = F.lit(float(RAMP[-1][1][k]))
        for (low, a), (high, b) in reversed(list(zip(RAMP, RAMP[1:], strict=False))):
            out = F.when(e <= high, F.lit(float(a[k])) + F.lit(float(b[k] - a[k])) * ((e - low) / (high - low))).otherwise(out)
        return F.floor(clamp(out * dim, 0.0, 255.0)).cast("int")

    return F.struct(*[channel(k).alias(name) for k, name in enumerate("rgb")])


def cell_brightness(ratio: Column, depth: float = 0.45) -> Column:
    """Brightness of a map cell (0.45) or an image square (0.55) by its ratio."""
    return F.lit(1.0) - F.lit(depth) * (F.lit(1.0) - ratio)


# Progress ------------------------------------------------------------------


def progress_fraction(processed: Column, total: Column) -> Column:
    return F.when(total > 0, F.least(F.lit(1.0), processed / total))


def progress_eta(processed: Column, total: Column, elapsed: Column, overdue: bool = False) -> Column:
    """Seconds left; infinite until more than half a percent is done.  Past the total 0, or with ``overdue`` below 0."""
    part = F.when(total > 0, processed / total) if overdue else progress_fraction(processed, total)
    left = elapsed / part - elapsed
    return F.when(part > 0.005, left if overdue else F.greatest(F.lit(0.0), left)).otherwise(F.lit(float("inf")))


def progress_rate(processed: Column, elapsed: Column) -> Column:
    return F.when(elapsed > 0, processed / elapsed).otherwise(F.lit(0.0))
