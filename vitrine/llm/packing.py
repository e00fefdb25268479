"""Packing of documents into training sequences by vector bin packing.

Every piece is a vector: tokens, one segment, loss-bearing tokens. A sequence has a capacity in each dimension. The open
sequence takes the piece with the largest dot product of the piece's and the sequence's remaining vectors (both as shares
of the capacities) among those that fit; where none fits, the best piece is cut to what is left. Texts longer than a
sequence fill whole sequences first. What is left at a task's end goes to sequences whose lengths are powers of two,
which need no padding.

Each task packs the documents of its own input split, so nothing is shuffled and a lost task is simply run again: ids,
cuts and sequence numbers depend on the split alone. A task holds POOL open pieces and one batch of texts.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import ship
from .tokens import encoder

#: Pieces that wait for a sequence in a task.
POOL = 192
#: A piece is not cut into parts shorter than this, except in the sequences at a task's end.
LEAST_CUT = 16
#: Sequence numbers are the split's number, shifted by this, plus a counter.
SPLIT_BITS = 36
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long"
_TYPES = pa.schema([(name.split()[0], pa.int64()) for name in SCHEMA.split(", ")])


class Packer:
    """Packs (doc, ids, number of leading ids without loss); rows() are the finished pieces."""

    def __init__(self, first_sequence: int, capacity: int, max_segments: int, max_loss: int):
        self.limits = np.array([capacity, max_segments, max_loss], dtype=np.float64)
        self.capacity, self.max_segments, self.max_loss = capacity, max_segments, max_loss
        self.sequence, self.alone, self.out = first_sequence, first_sequence + 1, []  # even: filled from the pool; odd: one piece
        self.docs: list = [None] * (POOL + 1)  # of each slot: doc, ids, prompt, start, tokens of the whole document
        self.items = np.full((POOL + 1, 3), np.inf)
        self.free = list(range(POOL, -1, -1))
        self.left, self.offset = self.limits.copy(), 0  # what the open sequence can still take, and its length

    def add(self, doc, ids: bytes, prompt: int) -> None:
        total, start = len(ids) // 4, 0
        while (length := self._most(start, total, prompt)) == self.capacity or length < total - start:
            self._emit(doc, ids, prompt, start, length, None)
            start += length
            if start == total:
                return
        self._hold((doc, ids, prompt, start))
        while len(self.free) <= 1:
            self._fill()

    def _most(self, start: int, total: int, prompt: int) -> int:
        """The longest piece from start that an empty sequence can take."""
        return min(self.capacity, total - start, max(0, prompt - start) + self.max_loss)

    def _hold(self, piece: tuple) -> None:
        slot = self.free.pop()
        doc, ids, prompt, start = piece
        length = len(ids) // 4 - start
        self.docs[slot] = piece
        self.items[slot] = (length, 1, self._loss(prompt, start, length))

    @staticmethod
    def _loss(prompt: int, start: int, length: int) -> int:
        return length - min(length, max(0, prompt - start))

    def _emit(self, doc, ids: bytes, prompt: int, start: int, length: int, offset: int | None) -> None:
        """Place a piece in the open sequence at offset; without one, in a sequence of its own."""
        part, sequence = memoryview(ids)[start * 4 : (start + length) * 4], self.sequence
        if offset is None:
            sequence, offset, self.alone = self.alone, 0, self.alone + 2
        self.out.append((doc, start, length, zlib.crc32(part), len(ids) // 4, sequence, offset, self._loss(prompt, start, length)))

    def _fill(self, least: int = LEAST_CUT) -> None:
        """Put pieces into the open sequence until it is full or none wait; a full one is closed."""
        left = self.left
        while left.min() >= 1:
            if len(self.free) > POOL:
                return
            fits = (self.items <= left).all(axis=1)
            if fits.any():
                slot = int(np.where(fits, self.items @ (left / self.limits**2), -1.0).argmax())
                length = int(self.items[slot, 0])
            else:
                slot = int(np.where(np.isfinite(self.items[:, 0]), self.items[:, 0], -1.0).argmax())
                doc, ids, prompt, start = self.docs[slot]
                length = int(min(left[0], self.items[slot, 0], max(0, prompt - start) + left[2]))
                if length < least:
                    break
            doc, ids, prompt, start = self.docs[slot]
            self._emit(doc, ids, prompt, start, length, self.offset)
            left -= (length, 1, self._loss(prompt, start, length))
            self.offset += length
            self.items[slot] = np.inf
            self.free.append(slot)
            if start + length < len(ids) // 4:
                self._hold((doc, ids, prompt, start + length))
        self._close()

    def _close(self) -> None:
        self.sequence += 2 * (self.offset > 0)
        self.left, self.offset = self.limits.copy(), 0

    def finish(self) -> None:
        """Place what waits; the last sequences are cut to powers of two where pieces allow it."""
        while len(self.free) <= POOL:
            rest = int(self.items[np.isfinite(self.items[:, 0]), 0].sum()) + self.offset
            if rest < self.capacity:
                size = 1 << (rest.bit_length() - 1)
                self.left[0] = max(size - self.offset, 0) or self.left[0]
                self._fill(1)
            else:
                self._fill()
        self._close()

    def rows(self) -> pa.RecordBatch:
        columns = list(zip(*self.out, strict=True)) or [()] * len(_TYPES)
        self.out = []
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=_TYPES)


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    end_id: int,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    prompt_col: str | None = None,
    capacity: int = 2048,
    max_segments: int = 256,
    max_loss: int = 2048,
) -> DataFrame:
    """Pieces of all documents with their places in sequences: SCHEMA.

    A document's ids are those of its prompt (if prompt_col is given; they bear no loss), its text and end_id. Null texts
    count as empty, so that every row has at least the end id; null ids of documents stay null; repeated rows are packed
    once each. A very long text's ids, 4 bytes each, are held whole, its pieces one at a time. An empty table gives no
    rows. Other columns of docs are ignored, whatever their names.
    """
    ship(docs.sparkSession)
    prompt = F.coalesce(F.col(prompt_col).cast("string"), F.lit("")) if prompt_col else F.lit("")
    source = docs.select(F.col(id_col).cast("long").alias("doc"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), prompt.alias("prompt"))
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = encoder(tokenizer_path)
        packer = Packer(TaskContext.get().partitionId() << SPLIT_BITS, capacity, max_segments, max_loss)
        for batch in batches:
            for k in range(batch.num_rows):
                lead = ids(p) if (p := batch["prompt"][k].as_py()) else b""
                packer.add(batch["doc"][k].as_py(), lead + ids(batch["text"][k].as_py()) + end, len(lead) // 4)
                if len(packer.out) >= 20_000:
                    yield packer.rows()
        packer.finish()
        yield packer.rows()

    return source.mapInArrow(run, SCHEMA)
