"""SentencePiece encoding and decoding of merge-type (BPE) vocabularies.

Encoding works on an agenda: every adjacent pair of symbols whose join is a
piece goes on a heap, ordered by the piece's score and then by position; the
best pair is joined, and the pairs with its new neighbours are put on the heap,
until the heap is empty.  Symbols that are no piece fall back to their bytes.

No piece of such a vocabulary holds a space mark after another character, so
no join crosses the border before a run of space marks.  Texts are cut there
(and between letters and other characters, if the vocabulary has no piece with
both), a worker encodes each different chunk once while it remembers it, and in
each Arrow batch the sentencepiece library encodes the texts too: any
difference is an error.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import sys
from array import array
from collections.abc import Iterator
from math import inf

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import Memory, small_batches, tidy

SPACE = "▁"
#: Chunks a worker remembers, and UTF-8 bytes of text handled at a time.
_MEMORY, _SLICE_BYTES = 1 << 17, 1 << 20
#: Up to so many characters a scan of the agenda is faster than a heap; the result is the same.
_SHORT = 32


#: Texts that normalisers change: compatibility and combining characters, control characters, runs of spaces.
_PROBES = ["", " ", "  a  b ", "\u00a0\u3000\u2003x", "\ufb01\uff21\u2460\u00bd", "e\u0301\u0041\u030a", "\t\n\r\x00\x1c\x7f\u0085\u200b\ufeff", "\u2581a", "\u0130\u1e9e\U0001f600"]


def _marked(text: str) -> str:
    return SPACE + text.replace(" ", SPACE) if text else ""


def _packed(ids: list[int]) -> bytes:
    """Ids as little-endian 32-bit integers."""
    words = array("I", ids)
    if sys.byteorder == "big":
        words.byteswap()
    return words.tobytes()


class PieceBpe:
    """A merge-type vocabulary read from a sentencepiece model."""

    def __init__(self, content: bytes):
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_proto=content)
        size = sp.vocab_size()
        # pieces that joins may form; control, unknown and byte pieces are never matched in a text
        plain = [i for i in range(size) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.piece = {sp.id_to_piece(i): i for i in plain}
        self.cost = {p: -sp.get_score(i) for p, i in self.piece.items()}  # the highest score joins first
        self.text = [sp.id_to_piece(i) for i in range(size)]
        self.byte = {int(sp.id_to_piece(i)[3:5], 16): i for i in range(size) if sp.is_byte(i)}
        self.value = {i: b for b, i in self.byte.items()}
        self.unknown, self.begin, self.end = sp.unk_id(), sp.bos_id(), sp.eos_id()
        if any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.piece):
            raise ValueError("a piece holds a space mark after another character; chunks would not be independent")
        self.chunks = re.compile(self._borders())
        # a normaliser that only marks spaces, on texts that others would change, needs no call
        self.marks_only = all(sp.normalize(p) == _marked(p) for p in _PROBES)
        self.known = Memory(lambda chunk: _packed(self.encode_chunk(chunk)), _MEMORY, "pieces")
        self.ends = _packed([self.begin]), _packed([self.end])

    def _borders(self) -> str:
        """The pattern of a chunk: no piece crosses from one chunk to the next.

        Letters that do share a piece with other characters count as no letters.
        """
        odd = ""
        while True:
            letter, other = rf"[^\W\d_{odd}]", rf"(?:[^\w{SPACE}]|[\d_{odd}])"
            mixed = re.compile(f"{letter}(?!{letter}).|{other}{letter}", re.DOTALL)
            found = {c for p in self.piece if mixed.search(p) for c in p if re.match(letter, c)}
            if not found:
                return f"{SPACE}*{letter}+|{SPACE}*{other}+|{SPACE}+"
            if len(odd) + len(found) > 64:  # letters and other characters mix freely
                return f"{SPACE}*[^{SPACE}]+|{SPACE}+"
            odd += "".join(map(re.escape, sorted(found)))

    def encode_chunk(self, chunk: str) -> list[int]:
        """Ids of one chunk: the agenda, which is a plain list of costs where the chunk is short."""
        joined = self._join_short(chunk) if len(chunk) <= _SHORT else self._join_long(chunk)
        ids: list[int] = []
        for symbol in joined:
            found = self.piece.get(symbol)
            if found is not None:
                ids.append(found)
            elif self.byte:
                ids += [self.byte[b] for b in symbol.encode()]
            elif not ids or ids[-1] != self.unknown:
                ids.append(self.unknown)
        return ids

    def _join_short(self, chunk: str) -> list[str]:
        """Joined symbols; the next pair is the first of the lowest costs, found by a scan."""
        symbols, cost = list(chunk), self.cost.get
        agenda = [cost(a + b, inf) for a, b in zip(symbols, symbols[1:])]
        while agenda and (best := min(agenda)) < inf:
            at = agenda.index(best)
            symbols[at] = joined = symbols[at] + symbols.pop(at + 1)
            del agenda[at]
            if at < len(agenda):
                agenda[at] = cost(joined + symbols[at + 1], inf)
            if at:
                agenda[at - 1] = cost(symbols[at - 1] + joined, inf)
        return symbols

    def _join_long(self, chunk: str) -> list[str]:
        """The same by a heap of pairs, in time that hardly grows faster than the chunk."""
        symbols, cost = list(chunk), self.cost.get
        n = len(symbols)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        agenda = [(c, i, i + 1, j) for i in range(n - 1) if (c := cost(j := symbols[i] + symbols[i + 1])) is not None]
        heapq.heapify(agenda)
        while agenda:
            _, left, right, joined = heapq.heappop(agenda)
            if after[left] != right or not symbols[left] or symbols[left] + symbols[right] != joined:
                continue  # one of the two has been joined meanwhile
            symbols[left], symbols[right] = joined, ""
            after[left] = far = after[right]
            if far >= 0:
                before[far] = left
                if (c := cost(j := joined + symbols[far])) is not None:
                    heapq.heappush(agenda, (c, left, far, j))
            near = before[left]
            if near >= 0 and (c := cost(j := symbols[near] + joined)) is not None:
                heapq.heappush(agenda, (c, near, left, j))
        return [symbol for symbol in symbols if symbol]

    def encode(self, text: str) -> bytes:
        """Ids of a text between the begin and end ids, as little-endian 32-bit integers."""
        chunks = self.chunks.findall(_marked(text) if self.marks_only else self.library.normalize(text))
        return b"".join((self.ends[0], *map(self.known.__getitem__, chunks), self.ends[1]))

    def settle(self) -> None:
        self.known.settle()

    def decode(self, ids: list[int]) -> str:
        """The text of ids: byte runs become characters, one leading space mark goes."""
        out, run, first = [], bytearray(), True
        for i in ids:
            if i in (self.begin, self.end):
                continue
            if i in self.value:
                run.append(self.value[i])
                first = False
                continue
            if run:
                out.append(run.decode("utf-8", "replace"))
                run.clear()
            piece = self.text[i]
            if first and piece.startswith(SPACE):
                piece = piece[1:]
            first = False
            out.append(piece.replace(SPACE, " "))
        if run:
            out.append(run.decode("utf-8", "replace"))
        return "".join(out)


_MODELS: dict[bytes, PieceBpe] = {}


def shared(content: bytes) -> PieceBpe:
    """The vocabulary of a worker, which keeps its chunks from task to task."""
    key = hashlib.sha256(content).digest()
    if key not in _MODELS:
        _MODELS[key] = PieceBpe(content)
    return _MODELS[key]


def encode_decode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False, remembered: int = _MEMORY) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``, a row per input row.

    Null text counts as empty and has the begin and end ids alone; texts of any
    length are encoded whole; repeated rows and rows with one id are rows each
    (null ids stay null), so ties cannot matter; an empty table gives an empty
    result, and other columns of any name play no part.  With
    ``keep_ids`` the ids and the decoded text follow as ``ids, decoded``.  A
    worker remembers up to twice ``remembered`` chunks, of about 200 bytes each.
    """
    small_batches(docs.sparkSession)
    with open(vocabulary, "rb") as file:
        content = file.read()
    extra = ", ids array<int>, decoded string" if keep_ids else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from blocklens.llm._common import Memory, text_parts
        from blocklens.llm.piece_bpe import shared

        Memory.claim("pieces")
        own = shared(content)
        own.known.limit = remembered
        for batch in batches:
            for at, count, texts in text_parts(batch, 1, _SLICE_BYTES):
                own.settle()
                lengths, shas, back, kept = [], [], [], []
                library = own.library.encode(texts, add_bos=True, add_eos=True, num_threads=1)
                decoded = own.library.decode(library, num_threads=1)
                for text, checked, plain in zip(texts, library, decoded, strict=True):
                    ids = own.encode(text)
                    if ids != _packed(checked):
                        raise ValueError(f"encoding differs from the library's in a text of {len(text)} characters")
                    lengths.append(len(checked))
                    shas.append(hashlib.sha256(ids).hexdigest())
                    back.append(hashlib.sha256(plain.encode()).hexdigest())
                    if keep_ids:
                        kept.append((checked, plain))
                columns = [batch.column(0).slice(at, count), pa.array(lengths, pa.int64()), pa.array(shas, pa.string()), pa.array(back, pa.string())]
                if keep_ids:
                    columns += [pa.array([k[0] for k in kept], pa.list_(pa.int32())), pa.array([k[1] for k in kept], pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256", *(["ids", "decoded"] if keep_ids else [])])

    rows = docs.select(F.col(f"`{id_col}`").alias("_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("_t"))
    id_type = rows.schema["_id"].dataType.simpleString()
    return rows.mapInArrow(tidy(run), f"`{id_col}` {id_type}, n_tokens long, ids_sha256 string, decoded_sha256 string{extra}")
