"""Token files: ids packed in the fewest bits the vocabulary needs, in blocks with random access.

A file is: the header; the blocks, each with ``BLOCK_IDS`` ids (the last with the rest) packed least
significant bit first and ended at a whole byte; the footer with the offset of each block, then the
doc_id and the number of ids of each document; the tail with the sizes that locate the footer. All
numbers are little-endian. A null doc_id is stored as ``NULL_ID``.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.common import documents, materialise, new_path, parallelism
from docloom.llm.tokens import encoder

MAGIC = b"DLTOKEN1"
#: magic, bits of an id, ids in a block; number of blocks, of documents and of ids, offset of the footer, magic.
HEADER, TAIL = struct.Struct("<8sII"), struct.Struct("<QQQQ8s")
BLOCK_IDS = 65_536
NULL_ID = -(2**63)


def bits_needed(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids to a bit string, least significant bit first."""
    if bits == 16:
        return ids.astype("<u2").tobytes()
    planes = (ids[:, None].astype(np.uint32) >> np.arange(bits, dtype=np.uint32)) & 1
    return np.packbits(planes.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(data: bytes, bits: int, count: int) -> np.ndarray:
    """The inverse of :func:`pack`: ``count`` ids as 32-bit integers."""
    if bits == 16:
        return np.frombuffer(data, "<u2", count).astype("<u4")
    planes = np.unpackbits(np.frombuffer(data, np.uint8), count=count * bits, bitorder="little").reshape(count, bits)
    return (planes.astype(np.uint32) << np.arange(bits, dtype=np.uint32)).sum(axis=1, dtype=np.uint32).astype("<u4")


class Writer:
    """Writes documents one after another to an open binary stream."""

    def __init__(self, out, bits: int, block_ids: int = BLOCK_IDS) -> None:
        self.out, self.bits, self.block_ids = out, bits, block_ids
        self.parts: list[bytes] = []
        self.pending = self.total = 0
        self.offsets: list[int] = []
        self.documents: list[int] = []
        self.lengths: list[int] = []
        self.at = HEADER.size
        out.write(HEADER.pack(MAGIC, bits, block_ids))

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.documents.append(NULL_ID if doc_id is None else doc_id)
        self.lengths.append(len(ids) // 4)
        self.parts.append(ids)
        self.pending += len(ids) // 4
        self.total += len(ids) // 4
        if self.pending >= self.block_ids:
            self._blocks(False)

    def _blocks(self, all_ids: bool) -> None:
        data = b"".join(self.parts)
        step, end = 4 * self.block_ids, 0
        while len(data) - end >= step or all_ids and end < len(data):
            block = pack(np.frombuffer(data[end : end + step], "<u4"), self.bits)
            self.out.write(block)
            self.offsets.append(self.at)
            self.at += len(block)
            end += step
        self.parts, self.pending = [data[end:]], max(0, len(data) - end) // 4

    def close(self) -> None:
        self._blocks(True)
        for values in ([*self.offsets, self.at], self.documents, self.lengths):
            self.out.write(np.asarray(values, "<i8").tobytes())
        self.out.write(TAIL.pack(len(self.offsets), len(self.documents), self.total, self.at, MAGIC))


class Reader:
    """Random access to a file: any block, any run of ids, any document."""

    def __init__(self, source) -> None:
        """source: an open seekable binary file of known size (``size()``)."""
        self.source = source
        magic, self.bits, self.block_ids = HEADER.unpack(self._at(0, HEADER.size))
        blocks, docs, self.total, footer, again = TAIL.unpack(self._at(source.size() - TAIL.size, TAIL.size))
        if magic != MAGIC or again != MAGIC:
            raise ValueError("not a token file")
        values = np.frombuffer(self._at(footer, 8 * (blocks + 1 + 2 * docs)), "<i8")
        self.offsets, self.documents, self.lengths = values[: blocks + 1], values[blocks + 1 : blocks + 1 + docs], values[blocks + 1 + docs :]
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)]).astype(np.int64)

    def _at(self, offset: int, size: int) -> bytes:
        self.source.seek(offset)
        return self.source.read(size)

    def block(self, k: int) -> np.ndarray:
        count = min(self.block_ids, self.total - k * self.block_ids)
        return unpack(self._at(int(self.offsets[k]), int(self.offsets[k + 1] - self.offsets[k])), self.bits, count)

    def ids(self, start: int, length: int) -> np.ndarray:
        if not length:
            return np.zeros(0, "<u4")
        first, last = start // self.block_ids, (start + length - 1) // self.block_ids
        joined = np.concatenate([self.block(k) for k in range(first, last + 1)])
        return joined[start - first * self.block_ids :][:length]

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.starts[k]), int(self.lengths[k]))

    def checksums(self) -> Iterator[tuple[int, int, int, int]]:
        """(doc_id, start, length, crc32 of its 32-bit ids) in file order, one block in memory at a time."""
        data, have = memoryview(b""), -1
        for k in range(len(self.documents)):
            at, end, crc = int(self.starts[k]), int(self.starts[k + 1]), 0
            start = at
            while at < end:
                if (b := at // self.block_ids) != have:
                    data, have = memoryview(self.block(b).tobytes()), b
                stop = min(end, (b + 1) * self.block_ids)
                crc = zlib.crc32(data[4 * (at - b * self.block_ids) : 4 * (stop - b * self.block_ids)], crc)
                at = stop
            yield int(self.documents[k]), start, end - start, crc


def _location(uri: str):
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def write_token_files(docs: DataFrame, vocabulary: str, folder: str, end_id: int = 2) -> DataFrame:
    """Write all documents in ascending doc_id order; returns the manifest (part, path, n_docs, n_ids).

    Each task of a range partitioning by doc_id writes one file under a name of its own attempt and
    then renames it, so that a task that runs again replaces what it wrote. Equal ids are ordered by
    text; a null id comes first. Part numbers follow the order of ids.
    """
    parts = parallelism(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, end, task = encoder(vocabulary), end_id.to_bytes(4, "little"), TaskContext.get()
        store, base = _location(folder)
        store.create_dir(base, recursive=True)
        name = f"{base}/part-{task.partitionId():06d}"
        with store.open_output_stream(f"{name}.{task.taskAttemptId()}") as out:
            writer = Writer(out, bits_needed(e.vocabulary_size()))
            for batch in batches:
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    writer.add(doc_id, e.encode(text) + end)
            writer.close()
        store.move(f"{name}.{task.taskAttemptId()}", f"{name}.tok")
        row = [[task.partitionId()], [f"{folder}/part-{task.partitionId():06d}.tok"], [len(writer.documents)], [writer.total]]
        yield pa.RecordBatch.from_arrays([pa.array(v) for v in row], ["part", "path", "n_docs", "n_ids"])

    dealt = documents(docs).repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
    return dealt.mapInArrow(run, "part long, path string, n_docs long, n_ids long")


def read_token_files(manifest: DataFrame) -> DataFrame:
    """Per document from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    parts = parallelism(manifest.sparkSession)
    before = F.sum("n_ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    files = manifest.select("part", "path", F.coalesce(before, F.lit(0)).alias("base"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                store, name = _location(path)
                with store.open_input_file(name) as source:
                    found = list(zip(*Reader(source).checksums(), strict=True)) or [[], [], [], []]
                ids = pa.array([None if d == NULL_ID else d for d in found[0]], pa.int64())
                starts = pa.array([base + s for s in found[1]], pa.int64())
                yield pa.RecordBatch.from_arrays([ids, starts, pa.array(found[2], pa.int64()), pa.array(found[3], pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return files.repartitionById(parts, F.col("part").cast("int")).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, vocabulary: str, end_id: int = 2) -> DataFrame:
    """Write the files to the shared folder, then read them back: see the two functions above.

    Null and empty texts are their end id alone; texts of any length span blocks; repeated rows are
    written as often as they come; an empty table gives empty files and no row; other columns are
    not read. The manifest is a written table, so the files are made once.
    """
    folder = new_path(docs.sparkSession, "tokens")
    return read_token_files(materialise(write_token_files(docs, vocabulary, folder, end_id), "manifest"))
