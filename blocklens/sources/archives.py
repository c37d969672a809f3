"""Data sources ``blockarchive`` and ``ziparchive``.

Reading gives a row per entry and touches no payload, unless ``payload`` is
true, when block archives give a row per frame (so a cell stays within a block)
and ZIP files a row per entry with its packed ``body``.  ``path`` is a file, a
folder or a pattern (``suffix`` names other suffixes for folders).  There is a
partition per archive; payloads of archives above ``splitBytes`` are dealt out
as runs of frames or entries, planned from the metadata.  ``names`` (a JSON
list) keeps entries of these names only.  Equality and ``IN`` filters on
``name`` are applied inside the reader as well, in the ``Pushed`` sources:
Spark refuses readers that take filters where its setting for that is off, so
``sources.register`` chooses by the session.

Writing takes rows that are packed already.  Each task writes its frames to a
part file next to the target; the commit puts the parts together in the order
of ``entry_idx`` and ``block_idx`` by copying file ranges on the driver, and
the target appears under its name only when it is whole.  That is for small
archives; ``placed.write_archive``, which ``pack`` and ``zip_tree`` use, has
all tasks write in place.
"""

from __future__ import annotations

import datetime
import glob
import json
import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, In, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from ..errors import FormatError
from ..schemas import ENTRIES
from . import formats as f

_UTC = datetime.timezone.utc
#: Bytes of payloads in a partition.
_SPLIT = 128 << 20


@dataclass
class _Archive(InputPartition):
    path: str
    #: frames as (entry_idx, name, block size, size, first block, place, lengths), or ZIP entries; None: all of the archive
    runs: list | None = None


def _row(path: str, idx: int, e: f.Entry) -> tuple:
    when = datetime.datetime.fromtimestamp(min(e.mtime, 253402300799), _UTC)
    return path, idx, e.name, e.is_directory, e.unix_mode, when, e.method, e.block_size, e.uncompressed_size, e.compressed_size, e.crc32, e.block_lengths, e.data_offset, e.name_is_utf8


class _Reader(DataSourceReader):
    def __init__(self, options: dict, suffix: str):
        self.path, self.payload, self.suffix = options["path"], str(options.get("payload", "false")).lower() == "true", suffix
        self.suffix = str(options.get("suffix", self.suffix))
        self.split = int(options.get("splitBytes", _SPLIT))
        self.names: set[str] | None = set(json.loads(options["names"])) if "names" in options else None

    def partitions(self):
        if os.path.isdir(self.path):
            found = [os.path.join(d, n) for d, _, names in os.walk(self.path) for n in names if n.endswith(self.suffix)]
        else:
            found = glob.glob(self.path)
        if not found:
            raise FileNotFoundError(self.path)
        whole = [_Archive(p) for p in sorted(found)]
        if not self.payload:
            return whole
        return [q for p in whole for q in ([p] if os.path.getsize(p.path) <= self.split else self.dealt(p.path))]

    def dealt(self, path: str) -> Iterator[_Archive]:
        """Runs of one archive, each of about ``splitBytes``."""
        runs, held = [], 0
        with open(path, "rb") as file:
            for run, size in self.pieces(file):
                runs.append(run)
                held += size
                if held >= self.split:
                    yield _Archive(path, runs)
                    runs, held = [], 0
        if runs:
            yield _Archive(path, runs)

    def chosen(self, entries: Iterator[f.Entry]) -> Iterator[tuple[int, f.Entry]]:
        return ((i, e) for i, e in enumerate(entries) if self.names is None or e.name in self.names)


class _BlockReader(_Reader):
    def pieces(self, file):
        """An entry's frames, as runs of up to ``splitBytes``."""
        for idx, e in self.chosen(f.read_block_archive(file)):
            at, first, lengths, held = e.data_offset, 0, [], 0
            for k, length in enumerate(e.block_lengths):
                lengths.append(length)
                held += length
                if held >= self.split or k + 1 == len(e.block_lengths):
                    yield (idx, e.name, e.block_size, e.uncompressed_size, first, at, lengths), held
                    at, first, lengths, held = at + held, k + 1, [], 0

    def read(self, partition):
        with open(partition.path, "rb") as file:
            if not self.payload:
                for idx, e in self.chosen(f.read_block_archive(file)):
                    yield _row(partition.path, idx, e)
                return
            runs = partition.runs if partition.runs is not None else [run for run, _ in self.pieces(file)]
            for idx, name, block_size, size, first, at, lengths in runs:
                for k, length in enumerate(lengths, first):
                    file.seek(at)
                    yield partition.path, idx, name, k, k * block_size, min(block_size, size - k * block_size), at, length, file.read(length)
                    at += length


class _ZipReader(_Reader):
    def pieces(self, file):
        for idx, e in self.chosen(f.read_zip(file)):
            yield (idx, e), e.compressed_size

    def read(self, partition):
        with open(partition.path, "rb") as file:
            for idx, e in partition.runs if partition.runs is not None else [run for run, _ in self.pieces(file)]:
                if not self.payload:
                    yield _row(partition.path, idx, e)
                    continue
                at, length = f.zip_payload(file, e)
                file.seek(at)
                yield partition.path, idx, e.name, e.method, e.uncompressed_size, e.crc32, file.read(length)


class _Pushed:
    def pushFilters(self, filters):
        for one in filters:
            if isinstance(one, (EqualTo, In)) and tuple(one.attribute) == ("name",):
                names = {one.value} if isinstance(one, EqualTo) else set(one.value)
                self.names = names if self.names is None else self.names & names
            else:
                yield one


class _PushedBlockReader(_Pushed, _BlockReader):
    pass


class _PushedZipReader(_Pushed, _ZipReader):
    pass


@dataclass
class _Part(WriterCommitMessage):
    path: str
    #: (entry_idx, block_idx, place in the part, length, entry fields)
    pieces: str


class _Writer(DataSourceWriter):
    """Rows: ``entry_idx, block_idx, name, is_directory, unix_mode, mtime, method, block_size, uncompressed_size, crc32, body``.

    ``crc32`` and sizes are the whole entry's; an entry without body has one
    row with a null ``body``.
    """

    def __init__(self, options: dict, schema: StructType, overwrite: bool, zipped: bool):
        self.path, self.overwrite, self.zipped = options["path"], overwrite, zipped
        self.run = f"{self.path}.parts-{uuid.uuid4().hex}"
        self.names = schema.names

    def write(self, iterator):
        os.makedirs(self.run, exist_ok=True)
        stem = os.path.join(self.run, uuid.uuid4().hex)
        pieces = []
        with open(stem, "wb") as part:
            for row in iterator:
                r = row.asDict()
                body = r["body"]
                stamp = r["mtime"]
                seconds = 0 if stamp is None else int(stamp.replace(tzinfo=stamp.tzinfo or _UTC).timestamp())
                head = (r["name"], bool(r["is_directory"]), r["unix_mode"] or 0, max(0, seconds), r["method"], r["block_size"] or 0, r["uncompressed_size"] or 0, r["crc32"] or 0)
                pieces.append((r["entry_idx"], r["block_idx"] or 0, part.tell(), None if body is None else len(body), head))
                if body is not None:
                    part.write(body)
        with open(f"{stem}.index", "w", encoding="ascii") as index:
            json.dump(pieces, index)
        return _Part(stem, f"{stem}.index")

    def abort(self, messages):
        shutil.rmtree(self.run, ignore_errors=True)

    def commit(self, messages):
        if os.path.exists(self.path) and not self.overwrite:
            self.abort(messages)
            raise FileExistsError(self.path)
        pieces = []
        for m in messages:
            if m is not None:
                with open(m.pieces, encoding="ascii") as index:
                    pieces += [(*p, m.path) for p in json.load(index)]
        pieces.sort(key=lambda p: p[:2])
        whole = f"{self.path}.whole-{uuid.uuid4().hex}"
        with open(whole, "wb") as out:
            (self._zip if self.zipped else self._blocks)(out, pieces)
        os.replace(whole, self.path)
        shutil.rmtree(self.run, ignore_errors=True)

    @staticmethod
    def _grouped(pieces):
        start = 0
        while start < len(pieces):
            end = start
            while end < len(pieces) and pieces[end][0] == pieces[start][0]:
                end += 1
            group = pieces[start:end]
            lengths = [p[3] for p in group if p[3] is not None]
            e = f.Entry(*group[0][4][:5], block_size=group[0][4][5], uncompressed_size=group[0][4][6], crc32=group[0][4][7], compressed_size=sum(lengths), block_lengths=lengths)
            if len({p[4][0] for p in group}) > 1:
                raise FormatError(f"rows of different names share entry_idx {group[0][0]}")
            yield e, group
            start = end

    @staticmethod
    def _copy(out, group):
        for _, _, at, length, _, path in group:
            if length:
                with open(path, "rb") as part:
                    part.seek(at)
                    left = length
                    while left:
                        data = part.read(min(left, 8 << 20))
                        if not data:
                            raise FormatError(f"part file {path} is cut off")
                        out.write(data)
                        left -= len(data)

    def _blocks(self, out, pieces):
        out.write(f.block_header())
        count = 0
        for e, group in self._grouped(pieces):
            if e.is_directory or not e.uncompressed_size:
                e.block_lengths, e.compressed_size, e.crc32 = [], 0, 0
                e.block_size = 0 if e.is_directory else e.block_size
            elif -(-e.uncompressed_size // e.block_size) != len(e.block_lengths):
                raise FormatError(f"{e.name!r}: {len(e.block_lengths)} blocks for {e.uncompressed_size} bytes")
            out.write(f.block_entry_head(e))
            if e.block_lengths:
                self._copy(out, group)
            count += 1
        out.write(f.block_footer(count))

    def _zip(self, out, pieces):
        records = []
        for e, group in self._grouped(pieces):
            e.method = e.method or "stored"
            e.data_offset = out.tell()
            out.write(f.zip_local(e))
            self._copy(out, group)
            records.append(f.zip_central(e))
        start = out.tell()
        for record in records:
            out.write(record)
        out.write(f.zip_end(len(records), start, out.tell() - start))


class BlockArchive(DataSource):
    @classmethod
    def name(cls):
        return "blockarchive"

    def schema(self):
        if str(self.options.get("payload", "false")).lower() == "true":
            return "archive string, entry_idx long, name string, block_idx int, raw_off long, raw_len long, comp_off long, comp_len long, data binary"
        return ENTRIES

    def reader(self, schema):
        return _BlockReader(self.options, ".blka")

    def writer(self, schema, overwrite):
        return _Writer(self.options, schema, overwrite, zipped=False)


class ZipArchive(DataSource):
    @classmethod
    def name(cls):
        return "ziparchive"

    def schema(self):
        if str(self.options.get("payload", "false")).lower() == "true":
            return "archive string, entry_idx long, name string, method string, uncompressed_size long, crc32 long, body binary"
        return ENTRIES

    def reader(self, schema):
        return _ZipReader(self.options, ".zip")

    def writer(self, schema, overwrite):
        return _Writer(self.options, schema, overwrite, zipped=True)


class PushedBlockArchive(BlockArchive):
    def reader(self, schema):
        return _PushedBlockReader(self.options, ".blka")


class PushedZipArchive(ZipArchive):
    def reader(self, schema):
        return _PushedZipReader(self.options, ".zip")
