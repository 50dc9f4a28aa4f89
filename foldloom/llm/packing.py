"""Packing token ids into rows of fixed length by best-fit decreasing, and writing them in binary form.

Documents longer than a row are split without loss: full rows first, the rest is a piece like any other. Pieces of a block of documents are
placed from the longest to the shortest, each into the row with the least room that still holds it; a segment tree over room
sizes finds that row. A block is a bounded part of a task's input, so nothing is shuffled, memory is bounded, and a lost task is redone alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

# Tokens of a block, about; one document more may stand in it.
BLOCK_TOKENS = 2_000_000
WIDTHS = {"uint16": ("<u2", 65_535), "uint32": ("<u4", 4_294_967_295)}


class Rooms:
    """Rows by the room they have left. A segment tree of counts over room sizes finds the smallest that is large enough."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(capacity + 1)]

    def put(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        node = self.leaves + room
        while node:
            self.count[node] += 1
            node >>= 1

    def take(self, size: int) -> tuple[int, int] | None:
        """The room and number of the row that fits best, taken out; None if no row has ``size`` left."""
        node = self.leaves + size
        if node >= 2 * self.leaves:
            return None
        if not self.count[node]:
            while node > 1 and (node & 1 or not self.count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if self.count[2 * node] else 2 * node + 1
        room = node - self.leaves
        while node:
            self.count[node] -= 1
            node >>= 1
        return room, self.rows[room].pop()


def best_fit_decreasing(sizes: list[int], capacity: int) -> list[list[int]]:
    """Rows as lists of piece numbers. Equal sizes keep their order; of equally full rows the one filled last is taken."""
    rooms, rows = Rooms(capacity), []
    for piece in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        found = rooms.take(sizes[piece])
        room, row = found if found else (capacity, len(rows))
        if not found:
            rows.append([])
        rows[row].append(piece)
        if room > sizes[piece]:
            rooms.put(room - sizes[piece], row)
    return rows


def pack(df: DataFrame, capacity: int = 2048, key: str = "doc_id", ids: str = "token_ids", pad: int = 0, width: str = "uint16",
         block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Packed rows: (partition, block, row, n_tokens, ids, cu_seqlens, positions, docs, starts).

    ``ids`` holds ``capacity`` numbers of ``width``, padded with ``pad``; ``positions`` the place of each token in its segment, starting anew with every
    segment and at the padding; ``cu_seqlens`` the segments' cumulative lengths from 0; ``docs`` and ``starts`` the document and first token of each segment. Input ids are
    packed little-endian unsigned 32-bit integers. Documents with null or no ids have no segment; null keys are kept as null; repeated rows are
    packed each. Ids that do not fit ``width`` raise, and so does a ``capacity`` whose positions do not. Keys are of any type that Arrow knows.
    """
    kind, largest = WIDTHS[width]
    if not 0 < capacity <= largest + 1 or pad > largest:
        raise ValueError(f"rows of {capacity} ids padded with {pad} have positions or ids that do not fit {width}")
    schema = T.StructType([T.StructField("partition", T.IntegerType()), T.StructField("block", T.LongType()), T.StructField("row", T.LongType()),
                           T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType()), T.StructField("cu_seqlens", T.ArrayType(T.IntegerType())),
                           T.StructField("positions", T.BinaryType()), T.StructField("docs", T.ArrayType(df.schema[key].dataType)),
                           T.StructField("starts", T.ArrayType(T.LongType()))])
    arrow_key = to_arrow_type(df.schema[key].dataType)

    def rows_of(number: int, partition: int, docs: list, arrays: list[np.ndarray]) -> pa.RecordBatch:
        pieces = [(d, at, min(capacity, len(a) - at)) for d, a in enumerate(arrays) for at in range(0, len(a), capacity)]
        rows = best_fit_decreasing([size for *_, size in pieces], capacity)
        out: list[list] = [[] for _ in schema]
        for row, members in enumerate(rows):
            line, position, ends = np.full(capacity, pad, kind), np.zeros(capacity, kind), [0]
            for member in members:
                d, at, size = pieces[member]
                line[ends[-1]:ends[-1] + size] = arrays[d][at:at + size]
                position[ends[-1]:ends[-1] + size] = np.arange(size)
                ends.append(ends[-1] + size)
            position[ends[-1]:] = np.arange(capacity - ends[-1])
            own = [pieces[m] for m in members]
            for column, value in zip(out, (partition, number, row, ends[-1], line.tobytes(), ends, position.tobytes(), [docs[d] for d, *_ in own], [at for _, at, _ in own])):
                column.append(value)
        types = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int32()), pa.binary(), pa.list_(arrow_key), pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=schema.names)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        partition, number, held, docs, arrays = TaskContext.get().partitionId(), 0, 0, [], []
        for batch in batches:
            for doc, raw in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary()).to_pylist()):
                own = np.frombuffer(raw or b"", "<u4")
                if len(own) and own.max() > largest:
                    raise ValueError(f"id {own.max()} does not fit {width}")
                docs.append(doc)
                arrays.append(own.astype(kind))
                held += len(own)
                if held >= block_tokens:
                    yield rows_of(number, partition, docs, arrays)
                    number, held, docs, arrays = number + 1, 0, [], []
        if held:
            yield rows_of(number, partition, docs, arrays)

    return df.select(key, ids).mapInArrow(step, schema)


def write_packed(packed: DataFrame, path: str) -> None:
    """Packed rows as Parquet: ids and positions are fixed-length binary cells, so a column chunk is the id matrix itself."""
    packed.write.mode("errorifexists").parquet(path)
