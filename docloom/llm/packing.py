"""Packing of tokenised documents into windows by Karmarkar-Karp multiway differencing."""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from docloom.llm.common import documents, slices
from docloom.llm.tokens import MEMO_ENTRIES, encoder

#: Windows that are balanced together, and the items from which a group is closed early.
GROUP_WINDOWS, GROUP_ITEMS = 64, 4096
#: One part in so many of a group, a window at least, is set aside to fill what the balanced windows leave free.
ASIDE = 16
#: A last window that lacks at most this share of its capacity is padded rather than cut further.
LAST_SHARE = 1 / 16


def difference(lengths: list[int], windows: int) -> list[list[int]]:
    """Multiway differencing: indices of ``lengths`` for each window, with near-equal sums.

    Every length begins as a partial partition of its own. The two with the largest spread are merged,
    the fullest window of one with the emptiest of the other, until one partition is left. Empty
    windows of a partial partition are not stored.
    """
    if windows == 1:
        return [list(range(len(lengths)))]
    heap = [(-n, i, [(n, [i])]) for i, n in enumerate(lengths)]
    heapq.heapify(heap)
    serial = len(heap)
    while len(heap) > 1:
        _, _, one = heapq.heappop(heap)
        _, _, two = heapq.heappop(heap)
        if len(one) < len(two):
            one, two = two, one
        free = windows - len(one)
        merged = one + two if len(two) <= free else one[: windows - len(two)] + two[:free]
        if len(two) > free:
            merged += [(a + c, b + d) for (a, b), (c, d) in zip(one[windows - len(two) :], reversed(two[free:]), strict=True)]
        merged.sort(key=lambda w: -w[0])
        least = merged[-1][0] if len(merged) == windows else 0
        heapq.heappush(heap, (least - merged[0][0], serial, merged))
        serial += 1
    out = [items for _, items in heap[0][2]] if heap else []
    return out + [[] for _ in range(windows - len(out))]


def balance(lengths: list[int], capacity: int) -> list[list[int]]:
    """Near-equal windows of indices, none over ``capacity`` (no length may be); no window is empty.

    The window count begins at the least that could hold the total. Whenever a window exceeds the
    capacity the count rises, by as many windows as the excess would fill and one at least, and the
    lengths are differenced again.
    """
    windows = max(1, -(-sum(lengths) // capacity))
    while True:
        found = difference(lengths, windows)
        over = sum(max(0, sum(lengths[i] for i in w) - capacity) for w in found)
        if not over:
            return [w for w in found if w]
        windows += max(1, over // capacity)


class Packer:
    """Packs a stream of documents with bounded memory; each call returns the windows that are full.

    A piece is (document, start, length). Documents of a window's length or more fill windows of their
    own, all rests are balanced in groups. A few documents of a group stand aside; they are cut to fill
    exactly what the balanced windows have free, and what is left of them goes on to the next group.
    Only the end of the stream can leave a window that is not full: it is cut into windows whose
    lengths are powers of two, or padded if little is missing.
    """

    def __init__(self, capacity: int) -> None:
        self.capacity = capacity
        self.items: list[tuple[object, int, int]] = []
        self.total = 0

    def add(self, document: object, length: int) -> list[list[tuple[object, int, int]]]:
        whole = length // self.capacity
        out = [[(document, k * self.capacity, self.capacity)] for k in range(whole)]
        if rest := length - whole * self.capacity:
            self.items.append((document, whole * self.capacity, rest))
            self.total += rest
        if self.total >= GROUP_WINDOWS * self.capacity or len(self.items) >= GROUP_ITEMS and self.total >= self.capacity:
            out += self._close()
        return out

    def _close(self) -> list[list[tuple[object, int, int]]]:
        """Full windows, one at least: balanced documents and what they leave free, from those set aside."""
        whole, aside, spare = self.items, [], 0
        move = max(self.capacity, self.total // ASIDE)
        while True:
            while move > 0 and whole:
                aside.append(whole.pop())
                spare += aside[-1][2]
                move -= aside[-1][2]
            windows = balance([n for _, _, n in whole], self.capacity) if whole else [[]]
            free = len(windows) * self.capacity - (self.total - spare)
            if free <= spare:
                break
            move = (free - spare + 1) // 2
        out = []
        for w in windows:
            pieces = [whole[i] for i in w]
            left = self.capacity - sum(n for _, _, n in pieces)
            while left:
                document, start, n = aside.pop()
                put = min(n, left)
                pieces.append((document, start, put))
                if put < n:
                    aside.append((document, start + put, n - put))
                left -= put
            out.append(pieces)
        self.items, self.total = aside[::-1], spare - free
        return out

    def end(self) -> list[list[tuple[object, int, int]]]:
        out: list[list[tuple[object, int, int]]] = []
        while self.total >= self.capacity:
            out += self._close()
        while self.total:
            size = self.total if self.capacity - self.total <= self.capacity * LAST_SHARE else 1 << (self.total.bit_length() - 1)
            window, left = [], size
            while left:
                document, start, n = self.items.pop()
                put = min(n, left)
                window.append((document, start, put))
                if put < n:
                    self.items.append((document, start + put, n - put))
                left -= put
            self.total -= size
            out.append(window)
        return out


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, item long"


def pack_documents(docs: DataFrame, path: str, capacity: int = 4096, end_id: int = 2, with_ids: bool = False, memo: int = MEMO_ENTRIES) -> DataFrame:
    """Pieces of documents in windows of at most ``capacity`` ids; ``end_id`` ends each document.

    Returns per piece doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and item, and
    with ``with_ids`` the ids themselves. ``item`` tells rows of ``docs`` apart that repeat an id. Null
    and empty texts are their end id alone; a text of any length is cut into whole windows; repeated
    rows are packed as often as they come; an empty table gives no piece; a null doc_id stays null;
    other columns are not read.

    ``memo`` bounds the words that a worker remembers (about 340 bytes each); it changes nothing but the
    time. Each partition packs its own stream and holds one group of windows at a time, so nothing is
    shuffled or collected. Windows and items are numbered within the partition, from its number.
    """
    schema = SCHEMA + (", ids array<int>" if with_ids else "")
    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(path, memo).encode, end_id.to_bytes(4, "little")
        number = item = TaskContext.get().partitionId() << 36
        packer = Packer(capacity)
        rows: list[list[int]] = [[] for _ in names]
        parts: list[bytes] = []

        def put(windows: list) -> None:
            nonlocal number
            for window in windows:
                offset = 0
                for (doc_id, ids, place), start, n in window:
                    part = ids[4 * start : 4 * (start + n)]
                    for column, value in zip(rows, (doc_id, start, n, zlib.crc32(part), len(ids) // 4, number, offset, place), strict=True):
                        column.append(value)
                    if with_ids:
                        parts.append(part)
                    offset += n
                number += 1

        def take() -> pa.RecordBatch:
            columns = [pa.array(c, pa.int64()) for c in rows]
            if with_ids:
                ends = np.cumsum([0, *(len(p) // 4 for p in parts)], dtype=np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(parts), np.int32))))
            for c in (*rows, parts):
                c.clear()
            return pa.RecordBatch.from_arrays(columns, [*names, "ids"][: len(columns)])

        for batch in slices(batches):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = encode(text) + end
                put(packer.add((doc_id, ids, item), len(ids) // 4))
                item += 1
                if len(rows[0]) >= 2048:
                    yield take()
        put(packer.end())
        yield take()

    return documents(docs).mapInArrow(run, schema)
