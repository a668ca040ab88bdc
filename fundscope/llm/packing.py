"""Best-fit packing: pieces of at most ``capacity`` tokens into as few sequences as possible.

Every text is encoded and ended with ``end_id``; texts longer than the capacity are cut into pieces of
exactly the capacity, but for the first, which takes what is left over. Pieces are dealt at random over
groups of about ``GROUP_PIECES``, and each group is packed on its own: best fit in order of falling length,
then a local search over the bins with room. The search takes the emptiest bin and moves a piece of it, or
exchanges one or two pieces of it for a smaller one of a fuller bin; each step raises the sum of squared
fills, and a bin whose last piece has gone is saved. Every open bin is tried, and all again once one is saved. Groups are so large that the one bin or so which each
leaves half empty does not count.

Null text: empty, one piece with the end id. Repeated or null ids: each row is packed by itself. Empty table:
no rows. Columns other than the id and the text are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .common import written

GROUP_PIECES = 20_000


def pieces(docs: DataFrame, tokenizer: str, kind: str = "byte", end_id: int = 2, capacity: int = 1024,
           id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids, little-endian unsigned 32-bit) of every piece."""
    end = np.array([end_id], "<u4").tobytes()
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokens.encoder(tokenizer, kind).encode
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in tokens.text_groups(texts):
                doc, piece, start, length, crc, data = [], [], [], [], [], []
                for doc_id, found in zip(ids[a:b], encode(texts[a:b]), strict=True):
                    found += end
                    n = len(found) // 4
                    at = 0
                    for k in range(-(-n // capacity)):
                        size = (n - 1) % capacity + 1 if k == 0 else capacity
                        part = found[4 * at : 4 * (at + size)]
                        doc.append(doc_id), piece.append(k), start.append(at), length.append(size)
                        crc.append(zlib.crc32(part))
                        if with_ids:
                            data.append(part)
                        at += size
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc)),
                     *([pa.array(data, pa.binary())] if with_ids else [])],
                    names=["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(cut, schema)


def pack_lengths(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins as lists of indexes into ``lengths``."""
    bins: list[list[int]] = []
    room: list[int] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0  # bit r is set if some bin has room r
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        fits = mask >> n
        if fits:
            r = n + (fits & -fits).bit_length() - 1
            b = by_room[r].pop()
            if not by_room[r]:
                mask &= ~(1 << r)
            bins[b].append(i)
        else:
            r, b = capacity, len(bins)
            bins.append([i])
            room.append(0)
        room[b] = r - n
        if r > n:
            by_room[r - n].append(b)
            mask |= 1 << (r - n)
    return local_search(lengths, bins, np.array(room, np.int64), capacity)


def local_search(lengths: np.ndarray, bins: list[list[int]], room: np.ndarray, capacity: int) -> list[list[int]]:
    """Empty the emptiest bins by moves and exchanges that raise the sum of squared fills."""
    least = -(-int(lengths.sum()) // capacity)
    full = [b for b, r in zip(bins, room, strict=True) if r == 0]
    items = [list(b) for b, r in zip(bins, room, strict=True) if r > 0]
    room = room[room > 0].copy()
    if len(full) + len(items) <= least:
        return full + items
    index = np.array([i for b in items for i in b], np.int64)
    where = np.repeat(np.arange(len(items)), [len(b) for b in items])
    size = lengths[index].astype(np.int64)
    slot = {int(i): k for k, i in enumerate(index)}
    alive = np.ones(len(items), bool)
    tried = np.zeros(len(items), bool)

    def put(k: int, b: int) -> None:
        a = int(where[k])
        items[a].remove(int(index[k]))
        items[b].append(int(index[k]))
        room[a] += size[k]
        room[b] -= size[k]
        where[k] = b

    while len(full) + int(alive.sum()) > least:
        open_bins = np.flatnonzero(alive & ~tried)
        if not len(open_bins):
            break
        donor = int(open_bins[np.argmax(room[open_bins])])
        tried[donor] = True
        progress = True
        while progress and items[donor]:
            progress = False
            own = sorted((slot[i] for i in items[donor]), key=lambda k: -size[k])
            fuller = alive & (room <= room[donor])
            fuller[donor] = False
            best = int(np.where(fuller, room, -1).max(initial=-1))
            for k in own:  # a move
                if size[k] <= best:
                    ok = np.flatnonzero(fuller & (room >= size[k]))
                    put(k, int(ok[np.argmin(room[ok])]))
                    progress = True
                    break
            if progress:
                continue
            candidates = fuller[where]
            furthest = np.zeros(capacity + 1, np.int64)  # of each size, what its bin can hold in its place
            np.maximum.at(furthest, size[candidates], (size + room[where])[candidates])
            taken = np.full(capacity + 1, -1, np.int64)  # for each total, the least size that it can replace
            for n in np.flatnonzero(furthest)[::-1]:
                taken[n + 1 : furthest[n] + 1] = n
            held = size[own]
            one, two = np.triu_indices(len(own), 1)
            total = np.concatenate([held, held[one] + held[two]])  # one or two pieces for a smaller one
            can = np.flatnonzero((total <= capacity) & (taken[np.minimum(total, capacity)] >= 0))
            if len(can):
                x = int(can[0])
                give = (own[x],) if x < len(own) else (own[one[x - len(own)]], own[two[x - len(own)]])
                take = int(np.flatnonzero(candidates & (size == taken[total[x]]) & (size + room[where] >= total[x]))[0])
                other = int(where[take])
                put(take, donor)
                for k in give:
                    put(k, other)
                progress = True
        if not items[donor]:
            alive[donor] = False
            tried[:] = False
    return full + [b for b, live in zip(items, alive, strict=True) if live]


def pack(cut: DataFrame, capacity: int = 1024, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Adds sequence_id and offset to a table of pieces (columns as of ``pieces``)."""
    groups = max(1, -(-cut.count() // group_pieces))
    # a number of the row, as rows may be equal in all columns; ``cut`` is a written table, so it stays the same
    dealt = cut.withColumn("pack_group", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.monotonically_increasing_id()), F.lit(groups)))
    columns = cut.columns

    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "piece", "ids_crc32", "length"], ignore_index=True)
        lengths = pdf["length"].to_numpy()
        sequence, offset = np.zeros(len(pdf), np.int64), np.zeros(len(pdf), np.int64)
        base = int(pdf["pack_group"].iloc[0]) << 32
        for b, members in enumerate(pack_lengths(lengths, capacity)):
            at = 0
            for i in members:
                sequence[i], offset[i] = base + b, at
                at += int(lengths[i])
        return pdf[columns].assign(sequence_id=sequence, offset=offset)

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cut.schema) + ", sequence_id long, offset long"
    return dealt.groupBy("pack_group").applyInPandas(place, schema)


def pack_documents(docs: DataFrame, tokenizer: str, kind: str = "byte", end_id: int = 2, capacity: int = 1024,
                   id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Pieces with their places: doc_id, piece, start, length, ids_crc32[, ids], sequence_id, offset."""
    cut = written(pieces(docs, tokenizer, kind, end_id, capacity, id_col, text_col, with_ids), "pieces")
    return pack(cut, capacity)
