"""Token-ID / binary output: independent zstandard frames, a trailing seek table, per-frame checksums.

One file per range of document ids::

    frame 0 .. frame n-1          zstandard frames of at most FRAME_IDS ids (unsigned 32-bit, little endian)
    skippable frame (0x184D2A50)  the document index, itself compressed: ids, null flags, id counts
    skippable frame (0x184D2A5E)  seek table: (compressed size, size, checksum) of each frame and of the
                                  index, then the number of entries, a descriptor byte and a magic number

The checksum is the low half of XXH64 over a frame's uncompressed bytes. A reader takes the seek table
from the end of the file, then the index, then only the frames that hold the wanted documents.

Null text: no ids but the end id. Null document ids sort first and stay null. Equal ids: ordered by text,
each row written. Empty table: no files, no rows. Columns other than the id and the text are not read.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import tokens

FRAME_IDS = 1 << 16
INDEX_MAGIC, TABLE_MAGIC, END_MAGIC = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
ENTRY, FOOTER = struct.Struct("<III"), struct.Struct("<IBI")


def _checksum(data: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(data) & 0xFFFFFFFF


class Writer:
    """Writes one file; the file appears under its name only when it is whole."""

    def __init__(self, folder: str, name: str, level: int = 3) -> None:
        import zstandard

        self.fs, root = pafs.FileSystem.from_uri(folder)
        self.fs.create_dir(root, recursive=True)
        self.path, self.own = f"{root}/{name}", f"{root}/.{name}.{uuid.uuid4().hex}"
        self.out = self.fs.open_output_stream(self.own)
        self.zstd = zstandard.ZstdCompressor(level=level)
        self.entries: list[tuple[int, int, int]] = []
        self.waiting, self.size = [], 0
        self.ids: list[int | None] = []
        self.counts: list[int] = []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.ids.append(doc_id)
        self.counts.append(len(ids) // 4)
        for at in range(0, len(ids), 4 * FRAME_IDS):
            part = ids[at : at + 4 * FRAME_IDS]
            if self.size + len(part) > 4 * FRAME_IDS:
                self._flush()
            self.waiting.append(part)
            self.size += len(part)

    def _flush(self) -> None:
        if self.size:
            self._frame(b"".join(self.waiting))
            self.waiting, self.size = [], 0

    def _frame(self, data: bytes, skippable: bool = False) -> None:
        packed = self.zstd.compress(data)
        if skippable:
            self.out.write(struct.pack("<II", INDEX_MAGIC, len(packed)))
        self.out.write(packed)
        self.entries.append((len(packed) + 8 * skippable, len(data), _checksum(data)))

    def close(self) -> None:
        self._flush()
        ids = np.array([x if x is not None else 0 for x in self.ids], "<i8")
        null = np.array([x is None for x in self.ids], np.uint8)
        self._frame(struct.pack("<q", len(ids)) + ids.tobytes() + null.tobytes() + np.array(self.counts, "<i8").tobytes(), True)
        body = b"".join(ENTRY.pack(*e) for e in self.entries) + FOOTER.pack(len(self.entries), 0x80, END_MAGIC)
        self.out.write(struct.pack("<II", TABLE_MAGIC, len(body)) + body)
        self.out.close()
        self.fs.move(self.own, self.path)


class Reader:
    """Reads single documents of a file without decompressing the other frames."""

    def __init__(self, path: str) -> None:
        fs, path = pafs.FileSystem.from_uri(path)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        n, _, magic = FOOTER.unpack(self._bytes(size - FOOTER.size, FOOTER.size))
        if magic != END_MAGIC:
            raise ValueError(f"{path}: no seek table at its end")
        table = self._bytes(size - FOOTER.size - n * ENTRY.size, n * ENTRY.size)
        self.entries = list(ENTRY.iter_unpack(table))
        self.places = np.concatenate(([0], np.cumsum([e[0] for e in self.entries]))).astype(np.int64)
        self.frame_starts = np.concatenate(([0], np.cumsum([e[1] // 4 for e in self.entries[:-1]]))).astype(np.int64)
        index = self._frame(n - 1, 8)
        docs = struct.unpack_from("<q", index)[0]
        self.doc_ids = np.frombuffer(index, "<i8", docs, 8)
        self.null = np.frombuffer(index, np.uint8, docs, 8 + 8 * docs).astype(bool)
        self.counts = np.frombuffer(index, "<i8", docs, 8 + 9 * docs)
        self.starts = np.concatenate(([0], np.cumsum(self.counts))).astype(np.int64)
        self._last: tuple[int, bytes] = (-1, b"")

    def _bytes(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def _frame(self, k: int, skip: int = 0) -> bytes:
        import zstandard

        packed, size, check = self.entries[k]
        data = zstandard.ZstdDecompressor().decompress(self._bytes(int(self.places[k]) + skip, packed - skip), max_output_size=size)
        if len(data) != size or _checksum(data) != check:
            raise ValueError(f"frame {k} is damaged")
        return data

    def ids(self, k: int) -> bytes:
        """Ids of the file's k-th document, as bytes."""
        first, last = int(self.starts[k]), int(self.starts[k + 1])
        out = []
        frame = int(np.searchsorted(self.frame_starts, first, "right")) - 1
        while first < last:
            if self._last[0] != frame:
                self._last = (frame, self._frame(frame))
            begin = int(self.frame_starts[frame])
            end = min(last, int(self.frame_starts[frame + 1]))
            out.append(self._last[1][4 * (first - begin) : 4 * (end - begin)])
            first, frame = end, frame + 1
        return b"".join(out)


def write_files(docs: DataFrame, folder: str, tokenizer: str, kind: str = "word", end_id: int = 1,
                id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every text, append ``end_id`` and write the ids in ascending id order below ``folder``.

    Returns a row per file, in order: file, n_docs, n_tokens. Range partitioning on the id gives each
    task a run of documents; a task that runs again writes the same file anew.
    """
    end = np.array([end_id], "<u4").tobytes()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode = tokens.encoder(tokenizer, kind).encode
        writer = None
        name = f"part-{TaskContext.get().partitionId():06d}.tzst"
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in tokens.text_groups(texts):
                writer = writer or Writer(folder, name)
                for doc_id, found in zip(ids[a:b], encode(texts[a:b]), strict=True):
                    writer.add(doc_id, found + end)
        if writer:
            writer.close()
            yield pa.RecordBatch.from_pydict({"file": [f"{folder}/{name}"], "n_docs": [len(writer.ids)], "n_tokens": [sum(writer.counts)]})

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return rows.mapInArrow(write, "file string, n_docs long, n_tokens long")


def read_files(files: DataFrame) -> DataFrame:
    """A row per document of the files (columns file, start; start: ids before the file): doc_id, start,
    n_tokens, ids_crc32. Each file is read by one task, a frame at a time."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                r = Reader(path)
                for a in range(0, len(r.counts), 10_000):
                    part = range(a, min(a + 10_000, len(r.counts)))
                    yield pa.RecordBatch.from_pydict({
                        "doc_id": pa.array(r.doc_ids[a : part.stop], mask=r.null[a : part.stop]),
                        "start": pa.array(r.starts[a : part.stop] + start), "n_tokens": pa.array(r.counts[a : part.stop]),
                        "ids_crc32": pa.array([zlib.crc32(r.ids(k)) for k in part], pa.int64())})

    return files.select("file", "start").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def with_starts(files: DataFrame) -> DataFrame:
    """The ids before each file. One row per file, so the running sum is over a small table."""
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    return files.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).cast("long"))
