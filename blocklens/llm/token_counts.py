"""Token counts by batch encoding in Arrow functions that return lengths only.

Inside a record batch the texts are cut at ASCII spaces and line feeds.  These
are safe boundaries for a vocabulary whose normaliser and pre-tokeniser drop
white space and never look across it: the count of a text is the sum of the
counts of its pieces (special strings hold no space, so they stay whole).  Each
different piece of a slice is encoded once, in calls balanced by bytes, which
also bounds the memory of a call however long a text is.  For a vocabulary
that is not known to be safe (``split=False``) whole texts are encoded.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import Memory, small_batches, tidy

#: UTF-8 bytes of text handled at a time, and of pieces in one encoding call.
SLICE_BYTES, CALL_BYTES = 4 << 20, 256 << 10
#: Pieces whose counts a worker remembers from slice to slice.
_MEMORY = 1 << 17


def load(path: str) -> tuple[str, bytes]:
    """A vocabulary file's kind and content, to be sent to the workers."""
    with open(path, "rb") as file:
        return path.rsplit(".", 1)[-1], file.read()


def counter(kind: str, content: bytes):
    """A function from a list of texts to the list of their token counts."""
    if kind == "json":
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_str(content.decode())
        tokenizer.no_truncation()
        tokenizer.no_padding()
        return lambda texts: [len(e) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    if kind == "model":
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_proto=content)
        return lambda texts: [len(ids) for ids in model.encode(texts, num_threads=1)]
    raise ValueError(f"no library for a .{kind} vocabulary")


_COUNTERS: dict[bytes, tuple] = {}


def shared(kind: str, content: bytes) -> tuple:
    """A worker's counting function and the counts it remembers from task to task."""
    key = hashlib.sha256(content).digest()
    if key not in _COUNTERS:
        _COUNTERS[key] = (counter(kind, content), Memory(None, _MEMORY, "counts"))
    return _COUNTERS[key]


def by_bytes(items: list[str], limit: int) -> Iterator[list[str]]:
    """Consecutive runs of at most ``limit`` UTF-8 bytes (one longer item stands alone)."""
    run, held = [], 0
    for x in items:
        n = len(x) if x.isascii() else len(x.encode())
        if run and held + n > limit:
            yield run
            run, held = [], 0
        run.append(x)
        held += n
    if run:
        yield run


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text", split: bool = True) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit``, a row per input row.

    Null text counts as empty; texts of any length are counted whole; repeated
    rows and rows with one id are rows each (null ids stay null), so ties cannot
    matter; an empty table gives an empty result, and other columns of any name
    play no part.
    """
    small_batches(docs.sparkSession)
    kind, content = load(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from blocklens.llm._common import Memory, text_parts
        from blocklens.llm.token_counts import shared

        Memory.claim("counts")
        count, known = shared(kind, content)

        def learn(pieces) -> None:
            for call in by_bytes(known.unknown(pieces), CALL_BYTES):
                known.update(zip(call, count(call), strict=True))

        for batch in batches:
            sums = []
            for _, _, part in text_parts(batch, 1, SLICE_BYTES):
                if not split:
                    for call in by_bytes(part, CALL_BYTES):
                        sums += count(call)
                    continue
                known.settle()
                cut = [x.replace("\n", " ").split(" ") for x in part]
                learn(set().union(*cut))
                get = known.__getitem__
                sums += [sum(map(get, pieces)) for pieces in cut]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(sums, pa.int64()), pa.array([n > limit for n in sums], pa.bool_())], names=[id_col, "n_bytes", "n_tokens", "over_limit"])

    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").alias("_id"), text.alias("_t"), F.octet_length(text).cast("long").alias("_b"))
    id_type = rows.schema["_id"].dataType.simpleString()
    return rows.mapInArrow(tidy(run), f"`{id_col}` {id_type}, n_bytes long, n_tokens long, over_limit boolean")
