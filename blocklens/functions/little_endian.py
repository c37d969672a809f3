"""Little-endian integers in byte strings."""

from __future__ import annotations

from ..errors import FormatError

SIZES = {"u8": 1, "u16": 2, "u32": 4, "u64": 8}


def put(kind: str, value: int) -> bytes:
    size = SIZES[kind]
    if not 0 <= value < 1 << (8 * size):
        raise FormatError(f"{value} does not fit in {kind}")
    return value.to_bytes(size, "little")


class Cursor:
    """Reads a file from front to back and fails on truncation."""

    def __init__(self, file, size: int):
        self.file, self.size = file, size

    @property
    def at(self) -> int:
        return self.file.tell()

    def take(self, count: int) -> bytes:
        found = self.file.read(count)
        if len(found) != count:
            raise FormatError(f"truncated at byte {self.at}: {count} bytes expected, {len(found)} there")
        return found

    def read(self, kind: str) -> int:
        return int.from_bytes(self.take(SIZES[kind]), "little")

    def skip(self, count: int) -> None:
        if self.at + count > self.size:
            raise FormatError(f"truncated: {count} bytes to skip at byte {self.at} of {self.size}")
        self.file.seek(count, 1)
