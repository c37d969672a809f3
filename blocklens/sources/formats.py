"""The two archive formats, read and written by plain file handles."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

from ..errors import FormatError, UnsupportedError
from ..functions.little_endian import Cursor, put

# Block archive, version 1 (fixed values of the format) ----------------------
HEADER_MAGIC, ENTRY_MARK, FOOTER_MARK = 0x54494E4B, 0x4B4E0001, 0x4B4EFFFF
VERSION = 1
MAX_BLOCK, MAX_BLOCKS, DEFAULT_BLOCK = 256 << 20, 1 << 22, 1 << 20
LONG = (1 << 63) - 1

# ZIP (fixed values of the format) -------------------------------------------
LOCAL, CENTRAL, END, END64, LOCATOR64 = 0x04034B50, 0x02014B50, 0x06054B50, 0x06064B50, 0x07064B50
METHODS = {0: "stored", 8: "deflate"}
FULL = 0xFFFFFFFF


@dataclass
class Entry:
    """A row of archive metadata."""

    name: str
    is_directory: bool = False
    unix_mode: int = 0o644
    mtime: int = 0  # seconds since 1970
    method: str | None = None
    block_size: int = 0
    uncompressed_size: int = 0
    compressed_size: int = 0
    crc32: int = 0
    block_lengths: list[int] = field(default_factory=list)
    data_offset: int = 0
    name_is_utf8: bool = True


# Block archive ---------------------------------------------------------------


def read_block_archive(file) -> Iterator[Entry]:
    """Entries of a block archive, without their payloads."""
    size = file.seek(0, 2)
    file.seek(0)
    at = Cursor(file, size)
    if at.read("u32") != HEADER_MAGIC:
        raise FormatError("not a block archive")
    if (version := at.read("u16")) != VERSION:
        raise UnsupportedError(f"block archive version {version}")
    at.read("u16")
    at.read("u64")
    while True:
        mark = at.read("u32")
        if mark == FOOTER_MARK:
            at.read("u64")  # the number of entries, which is not enforced
            if (version := at.read("u32")) != VERSION:
                raise UnsupportedError(f"block archive version {version}")
            return
        if mark != ENTRY_MARK:
            raise FormatError(f"no entry mark at byte {at.at - 4}")
        name = at.take(at.read("u16"))
        entry = Entry(name.decode("utf-8", "surrogateescape"), unix_mode=at.read("u16"), mtime=at.read("u64"), is_directory=bool(at.read("u8")), block_size=at.read("u32"))
        entry.method = "directory" if entry.is_directory else "zstd"
        entry.uncompressed_size, entry.compressed_size, entry.crc32 = at.read("u64"), at.read("u64"), at.read("u32")
        count = at.read("u32")
        if entry.block_size > MAX_BLOCK or count > MAX_BLOCKS or max(entry.compressed_size, entry.uncompressed_size, entry.mtime) > LONG:
            raise FormatError(f"entry {entry.name!r} is beyond the format's limits")
        if entry.uncompressed_size and not entry.block_size:
            raise FormatError(f"entry {entry.name!r} has bytes but no block size")
        entry.block_lengths = list(struct.unpack(f"<{count}I", at.take(4 * count)))
        if sum(entry.block_lengths) != entry.compressed_size:
            raise FormatError(f"block lengths of {entry.name!r} do not add up to its compressed size")
        if entry.block_size and -(-entry.uncompressed_size // entry.block_size) != count:
            raise FormatError(f"entry {entry.name!r} has {count} blocks for {entry.uncompressed_size} bytes")
        entry.data_offset = at.at
        at.skip(entry.compressed_size)
        yield entry


def block_header() -> bytes:
    return put("u32", HEADER_MAGIC) + put("u16", VERSION) + put("u16", 0) + put("u64", 0)


def block_entry_head(e: Entry) -> bytes:
    """What stands before an entry's frames; all lengths are known by then."""
    name = e.name.encode("utf-8", "surrogateescape")
    parts = [put("u32", ENTRY_MARK), put("u16", len(name)), name, put("u16", e.unix_mode & 0xFFFF), put("u64", max(0, e.mtime)), put("u8", int(e.is_directory)), put("u32", e.block_size)]
    parts += [put("u64", e.uncompressed_size), put("u64", e.compressed_size), put("u32", e.crc32), put("u32", len(e.block_lengths))]
    return b"".join(parts) + struct.pack(f"<{len(e.block_lengths)}I", *e.block_lengths)


def block_footer(entries: int) -> bytes:
    return put("u32", FOOTER_MARK) + put("u64", entries) + put("u32", VERSION)


# ZIP -------------------------------------------------------------------------


def _dos(seconds: int) -> tuple[int, int]:
    import datetime

    t = datetime.datetime.fromtimestamp(seconds, datetime.timezone.utc)
    year = min(127, max(0, t.year - 1980))
    return year << 9 | t.month << 5 | t.day, t.hour << 11 | t.minute << 5 | t.second // 2


def _from_dos(date: int, time: int) -> int:
    import datetime

    try:
        t = datetime.datetime((date >> 9) + 1980, max(1, date >> 5 & 15), max(1, date & 31), time >> 11, time >> 5 & 63, (time & 31) * 2, tzinfo=datetime.timezone.utc)
    except ValueError:
        return 0
    return int(t.timestamp())


def _end_record(file, size: int) -> int:
    """Place of the end record: the last one whose comment reaches the end of the file."""
    tail = min(size, 22 + 65535)
    file.seek(size - tail)
    data = file.read(tail)
    at = data.rfind(put("u32", END))
    while at >= 0:
        if at + 22 <= len(data) and at + 22 + int.from_bytes(data[at + 20 : at + 22], "little") == len(data):
            return size - tail + at
        at = data.rfind(put("u32", END), 0, at + 3) if at else -1
    raise FormatError("no ZIP end record")


def read_zip(file) -> Iterator[Entry]:
    """Entries of a ZIP file from its central directory, without their payloads."""
    size = file.seek(0, 2)
    end = _end_record(file, size)
    file.seek(end)
    at = Cursor(file, size)
    _, _, _, _, _, length, start, _ = struct.unpack("<IHHHHIIH", at.take(22))
    if end >= 20:
        file.seek(end - 20)
        mark, _, where, _ = struct.unpack("<IIQI", at.take(20))
        if mark == LOCATOR64:
            if where + 56 > size:
                raise FormatError("the ZIP64 end record lies outside of the file")
            file.seek(where)
            record = at.take(56)
            if int.from_bytes(record[:4], "little") != END64:
                raise FormatError("no ZIP64 end record where the locator points")
            length, start = struct.unpack("<QQ", record[40:56])
    if start + length > end:
        raise FormatError("the central directory lies outside of the file")
    file.seek(start)
    while at.at < start + length:
        head = at.take(46)
        mark, made, _, flags, method, time, date, crc, packed, plain, names, extras, comments, _, _, attributes, offset = struct.unpack("<IHHHHHHIIIHHHHHII", head)
        if mark != CENTRAL:
            raise FormatError(f"no central directory record at byte {at.at - 46}")
        name, extra = at.take(names), at.take(extras)
        at.skip(comments)
        packed, plain, offset = _zip64(extra, packed, plain, offset)
        if flags & 1:
            raise UnsupportedError("encrypted ZIP entry")
        if method not in METHODS:
            raise UnsupportedError(f"ZIP method {method}")
        if max(packed, plain, offset) > LONG:
            raise FormatError("a ZIP size is beyond 63 bits")
        utf8 = bool(flags & 0x800)
        text = name.decode("utf-8", "surrogateescape") if utf8 else name.decode("cp437")
        unix = attributes >> 16 if made >> 8 == 3 else 0
        folder = text.endswith("/") or unix & 0o170000 == 0o040000 or bool(attributes & 0x10 and made >> 8 == 0)
        yield Entry(text, folder, unix & 0o7777 or (0o755 if folder else 0o644), _from_dos(date, time), METHODS[method], 0, plain, packed, crc, [], offset, utf8)


def _zip64(extra: bytes, packed: int, plain: int, offset: int) -> tuple[int, int, int]:
    if FULL not in (packed, plain, offset):
        return packed, plain, offset
    while len(extra) >= 4:
        kind, size = struct.unpack("<HH", extra[:4])
        body, extra = extra[4 : 4 + size], extra[4 + size :]
        if kind == 1:
            out = []
            for value in (plain, packed, offset):
                if value == FULL:
                    if len(body) < 8:
                        raise FormatError("a ZIP64 field is missing")
                    value, body = int.from_bytes(body[:8], "little"), body[8:]
                out.append(value)
            return out[1], out[0], out[2]
    raise FormatError("a ZIP64 field is missing")


def zip_payload(file, entry: Entry) -> tuple[int, int]:
    """Place and length of an entry's payload; its local header gives the names' lengths, the directory the sizes."""
    size = file.seek(0, 2)
    file.seek(entry.data_offset)
    head = Cursor(file, size).take(30)
    if int.from_bytes(head[:4], "little") != LOCAL:
        raise FormatError(f"no local header for {entry.name!r}")
    names, extras = struct.unpack("<HH", head[26:30])
    at = entry.data_offset + 30 + names + extras
    if at + entry.compressed_size > size:
        raise FormatError(f"the payload of {entry.name!r} is cut off")
    return at, entry.compressed_size


def zip_local(e: Entry) -> bytes:
    date, time = _dos(e.mtime)
    name = e.name.encode("utf-8", "surrogateescape")
    wide = max(e.uncompressed_size, e.compressed_size) >= FULL
    extra = struct.pack("<HHQQ", 1, 16, e.uncompressed_size, e.compressed_size) if wide else b""
    sizes = (FULL, FULL) if wide else (e.compressed_size, e.uncompressed_size)
    return struct.pack("<IHHHHHIIIHH", LOCAL, 45 if wide else 20, 0x800, 8 if e.method == "deflate" else 0, time, date, e.crc32, *sizes, len(name), len(extra)) + name + extra


def zip_central(e: Entry) -> bytes:
    """Directory record; ``data_offset`` is the place of the local header."""
    date, time = _dos(e.mtime)
    name = e.name.encode("utf-8", "surrogateescape")
    wide = [v for v in (e.uncompressed_size, e.compressed_size, e.data_offset) if v >= FULL]
    extra = struct.pack(f"<HH{len(wide)}Q", 1, 8 * len(wide), *wide) if wide else b""
    short = lambda v: min(v, FULL)
    attributes = ((0o040000 if e.is_directory else 0o100000) | e.unix_mode & 0o7777) << 16 | (0x10 if e.is_directory else 0)
    version = 45 if wide else 20
    return struct.pack("<IHHHHHHIIIHHHHHII", CENTRAL, 3 << 8 | version, version, 0x800, 8 if e.method == "deflate" else 0, time, date, e.crc32, short(e.compressed_size), short(e.uncompressed_size), len(name), len(extra), 0, 0, 0, attributes, short(e.data_offset)) + name + extra


def zip_end(entries: int, start: int, length: int) -> bytes:
    """ZIP64 end record and locator, always, and the end record."""
    record = struct.pack("<IQHHIIQQQQ", END64, 44, 3 << 8 | 45, 45, 0, 0, entries, entries, length, start)
    locator = struct.pack("<IIQI", LOCATOR64, 0, start + length, 1)
    few = min(entries, 0xFFFF)
    return record + locator + struct.pack("<IHHHHIIH", END, 0, 0, few, few, min(length, FULL), min(start, FULL), 0)


def crc32(data: bytes) -> int:
    return zlib.crc32(data)
