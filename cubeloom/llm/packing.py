"""Best-fit packing of token sequences by bounded-space online best fit.

A packer holds a fixed number of open bins in a bitset keyed by free space: bit f is set while an
open bin has f tokens free. A piece goes to the open bin it leaves the least space in (the lowest
set bit at or above its length). Where none fits and all places are taken, the fullest open bin is
closed first.

Every task packs the pieces of its own rows in one pass over the texts and without a shuffle, a window
of pieces at a time, the longest of it first, so short ones fill what long ones leave. The bins still
open at a task's end are then packed as pieces themselves, the fullest first, within groups of
neighbouring tasks, so small tasks do not leave half-empty sequences.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cubeloom.llm.common import lean, stage
from cubeloom.llm.encoding import encoder

WORD_VOCABULARY = "word_bpe_49k.json"
CAPACITY = 2048
OPEN_BINS = 2048
#: So many pieces are taken at a time, the longest first.
WINDOW = 2000
#: So many tasks' open bins are merged together.
TASKS_PER_GROUP = 16
END_ID = b"\0\0\0\0"


class BestFitPacker:
    """Online best fit with at most ``open_bins`` bins open (None: no limit)."""

    def __init__(self, capacity: int, open_bins: int | None):
        self.capacity, self.open_bins = capacity, open_bins
        self.bits = 0
        self.by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.n_open = self.n_bins = 0

    def _lowest(self, least: int) -> int | None:
        """The least free space of at least ``least`` that an open bin has."""
        bits = self.bits >> least
        return least + (bits & -bits).bit_length() - 1 if bits else None

    def _take(self, free: int) -> int:
        bins = self.by_free[free]
        found = bins.pop()
        if not bins:
            self.bits &= ~(1 << free)
        self.n_open -= 1
        return found

    def add(self, length: int) -> tuple[int, int]:
        """The bin and the offset of a piece of 1 to ``capacity`` tokens."""
        free = self._lowest(length)
        if free is None:
            if self.n_open == self.open_bins:
                self._take(self._lowest(0))  # the fullest closes
            place, free = self.n_bins, self.capacity
            self.n_bins += 1
        else:
            place = self._take(free)
        left = free - length
        if left and self.open_bins != 0:
            self.by_free[left].append(place)
            self.bits |= 1 << left
            self.n_open += 1
        return place, self.capacity - free

    def open(self) -> Iterator[tuple[int, int]]:
        """The open bins with the tokens they hold, the fullest first."""
        for free, bins in enumerate(self.by_free):
            for place in bins:
                yield place, self.capacity - free


_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, bin long, offset long, held long"


@lean
def _pack(batches: Iterable[pa.RecordBatch], vocabulary: str, capacity: int, open_bins: int) -> Iterator[pa.RecordBatch]:
    enc, packer, part = encoder(vocabulary), BestFitPacker(capacity, open_bins), TaskContext.get().partitionId()
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
    names = [c.split()[0] for c in _PIECES.split(", ")]

    def out(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    def placed(window: list[tuple]) -> pa.RecordBatch:
        window.sort(key=lambda piece: -piece[3])
        return out([(*piece, part, *packer.add(piece[3]), None) for piece in window])

    window: list[tuple] = []
    for batch in batches:
        for doc_id, ids in zip(batch.column(0).to_pylist(), enc.encode_array(batch.column(1)), strict=True):
            ids += END_ID
            n = len(ids) // 4
            for k, at in enumerate(range(0, n, capacity)):
                length = min(capacity, n - at)
                window.append((doc_id, k, at, length, zlib.crc32(ids[4 * at : 4 * (at + length)])))
                if len(window) == WINDOW:
                    yield placed(window)
                    window = []
    if window:
        yield placed(window)
    if left := [(None, None, None, None, None, part, place, None, held) for place, held in packer.open()]:
        yield out(left)


def _merge(bins: pd.DataFrame, capacity: int) -> pd.DataFrame:
    """Best fit over open bins as pieces, the largest first; there are at most TASKS_PER_GROUP * OPEN_BINS."""
    bins = bins.sort_values(["held", "part", "bin"], ascending=[False, True, True])
    packer = BestFitPacker(capacity, None)
    placed = [packer.add(int(n)) for n in bins.held]
    group = int(bins.part.iloc[0]) // TASKS_PER_GROUP
    first = (1 << 62) + (group << 24)
    return pd.DataFrame({"part": bins.part, "bin": bins.bin, "sequence": [first + p for p, _ in placed], "base": [o for _, o in placed]})


def pack_documents(docs: DataFrame, vocabulary: str = WORD_VOCABULARY, capacity: int = CAPACITY, open_bins: int = OPEN_BINS) -> DataFrame:
    """Pack the token ids of all documents into sequences of at most ``capacity`` tokens.

    ``docs`` needs ``doc_id`` and ``text``; other columns are not read. A document's ids end with id
    0; a null or empty text is that id alone. Only documents longer than ``capacity`` are cut, into
    pieces of ``capacity`` tokens and a rest. Null doc_ids are kept, and repeated rows are packed as
    often as they occur. Pieces of equal length go in the order of their rows. A very long text is
    encoded in parts; only its ids are held at once. No documents: no rows.

    Returns one row per piece: doc_id, piece, start (ids of its document before it), length,
    ids_crc32, sequence_id and offset (its place there; a sequence has no gaps).
    """

    def pack(batches):
        return _pack(batches, vocabulary, capacity, open_bins)

    def merge(bins):
        return _merge(bins, capacity)

    rows = stage(docs.select("doc_id", "text").mapInArrow(pack, _PIECES), "pieces")
    bins = rows.filter("held is not null").select("part", "bin", "held")
    merged = bins.groupBy(F.expr(f"part div {TASKS_PER_GROUP}").alias("g")).applyInPandas(merge, "part int, bin long, sequence long, base long")
    return (
        rows.filter("held is null")
        .drop("held")
        .join(merged, ["part", "bin"], "left")
        .select(
            "doc_id",
            "piece",
            "start",
            "length",
            "ids_crc32",
            F.coalesce("sequence", F.expr("shiftleft(cast(part as bigint), 32) + bin")).alias("sequence_id"),
            (F.col("offset") + F.coalesce("base", F.lit(0))).alias("offset"),
        )
    )
