"""Repeated byte strings by a logarithmic family of sampled suffix arrays.

Every byte that lies in a LENGTH-byte string which also starts earlier (in a smaller document id, or further
left) is removed; strings are judged on the input.

Sampling: of the suffixes that start inside a LENGTH-byte window, the one whose first GRAM bytes hash least is
the window's anchor. Equal windows have the same anchor at the same place, so it is enough to index the
anchored suffixes, a few in a hundred. Runs of windows with one anchor are a segment. A batch's suffix
array is its anchored suffixes sorted by (hash of the first GRAM bytes, hash of the segment). It is merge-scanned
against the levels: equal segments after the first are repeats throughout; where one anchor string has different
segments, matches end inside a segment, and its windows are compared one by one. Levels hold the first
suffix of each segment; two levels of the same number of batches merge into one of twice the size.

Batches are ranges of ascending document ids, so whatever is in a level starts earlier than a new batch.
Null text: empty. Null ids come first, as the least id. Rows of equal id are ordered by a hash of their text and are
documents of their own, unless their texts are equal too. Texts below LENGTH bytes are kept whole. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import bitmap
from . import textarrays as ta
from .common import text_of, written

LENGTH, GRAM = 100, 24
#: Batches of a run: from three on, levels merge. Each is matched against all levels, so their cost grows with the number.
BATCHES = 4
#: Suffixes of a partition in which partial matches are resolved, and different segments of one anchor string
#: from which they are dealt by longer common parts.
RESOLVE_ROWS, MANY_SEGMENTS, BLOCK = 8_000, 400, 16
#: Bytes of text whose suffixes are sampled at a time.
SAMPLED = 1 << 18
LEAST_ID = -(1 << 63)


def rows_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc, t (hash of the text), text: doc and t name a document."""
    text = text_of(text_col).cast("string")
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LEAST_ID)).alias("doc"), F.xxhash64(text).alias("t"), text.alias("text"))


def _anchors(s: ta.Slice) -> tuple[np.ndarray, ...]:
    """Of each segment: anchor hash, segment hash, row, first window's start (in the row), and span: the
    anchor's place behind that start, times 256, plus the number of windows."""
    grams = len(s.data) - GRAM + 1
    if len(s.data) < LENGTH:
        return tuple(np.zeros(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64, np.int64))
    bits = np.uint64(max(int(grams).bit_length(), 1))
    at = np.arange(grams)
    value = (s.hashes(at, at + GRAM) >> bits << bits) | at.astype(np.uint64)
    wide = LENGTH - GRAM + 1
    pad = np.full(-grams % wide, np.iinfo(np.uint64).max, np.uint64)
    blocks = np.concatenate((value, pad)).reshape(-1, wide)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    start = np.arange(len(s.data) - LENGTH + 1)
    least = np.minimum(behind[start], ahead[start + wide - 1]) & ((np.uint64(1) << bits) - np.uint64(1))
    row = np.repeat(np.arange(s.rows), np.diff(s.bounds))[start]
    inside = start + LENGTH <= s.bounds[row + 1]
    start, anchor, row = start[inside], least[inside].astype(np.int64), row[inside]
    first = np.flatnonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1]))) if len(start) else np.zeros(0, bool))
    n = np.diff(np.append(first, len(start)))
    begin, anchor, row = start[first], anchor[first], row[first]
    span = (anchor - begin) * 256 + n
    return s.hashes(anchor, anchor + GRAM), s.hashes(begin, begin + n - 1 + LENGTH), row, begin - s.bounds[row], span


def suffixes(rows: DataFrame) -> DataFrame:
    """h, seg, doc, t, start, span: the anchored suffixes of a batch."""

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in ta.slices(batch.column(2), SAMPLED):
                h, seg, row, start, span = _anchors(s)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(seg.view(np.int64)), batch.column(0).take(pa.array(row + s.first)),
                                                  batch.column(1).take(pa.array(row + s.first)), pa.array(start), pa.array(span.astype(np.int32))], names=["h", "seg", "doc", "t", "start", "span"])

    return rows.mapInArrow(sample, "h long, seg long, doc long, t long, start long, span int")


class SuffixLevels:
    """The family: ``add`` matches a batch against itself and all levels, and makes it a new one."""

    def __init__(self) -> None:
        self.levels: list[tuple[int, DataFrame]] = []  # batches in it, suffixes

    def add(self, batch: DataFrame, last: bool = False) -> tuple[DataFrame, DataFrame]:
        """(repeats, partial): doc, t, start, n of repeated segments of the batch; h, doc, t, start, span, many of the
        suffixes whose anchor string has different segments. A ``last`` batch is not kept as a level."""
        new = batch.withColumn("old", F.lit(False))
        for _, level in self.levels:
            new = new.unionByName(level.withColumn("old", F.lit(True)))
        place, same = F.struct("doc", "t", "start"), Window.partitionBy("h", "seg")
        whole = Window.partitionBy("h")
        scanned = new.withColumns({"again": F.min(place).over(same) != place, "low": F.min("seg").over(whole), "high": F.max("seg").over(whole), "all": F.count("*").over(whole)})
        flagged = scanned.select("h", "seg", "doc", "t", "start", "span", "old", "again", (F.col("low") != F.col("high")).alias("mixed"), (F.col("all") > MANY_SEGMENTS).alias("many"))
        useful = flagged.where("(not old and again) or (not again and mixed)" if last else "not old or (not again and mixed)")
        marked = written(useful, "suffix-scan")
        if not last:
            self._push(1, marked.where("not old and not again").select("h", "seg", "doc", "t", "start", "span"))
        return marked.where("not old and again").select("doc", "t", "start", (F.col("span") % 256).alias("n")), marked.where("mixed and not again").select("h", "doc", "t", "start", "span", "many")

    def _push(self, batches: int, level: DataFrame) -> None:
        while self.levels and self.levels[-1][0] == batches:
            batches, level = 2 * batches, self.levels.pop()[1].unionByName(level)
        self.levels.append((batches, written(level.repartition("h").sortWithinPartitions("h", "seg"), "suffix-level") if batches > 1 else level))


def _sieve(rows: DataFrame, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(some, rest) of the rows: all rows whose document is in ``docs`` are in ``some``, and a few more."""
    sent = rows.sparkSession.sparkContext.broadcast(bitmap.build(docs.select(F.xxhash64("doc", "t").alias("k")), "k"))

    def part(wanted: bool):
        def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                hit = bitmap.holds(sent.value, batch.column(3).to_numpy().view(np.uint64)) == wanted
                yield batch.filter(pa.array(hit)).select([0, 1, 2])

        return rows.withColumn("k", F.xxhash64("doc", "t")).mapInArrow(keep, "doc long, t long, text string")

    return part(True), part(False)


def contexts(rows: DataFrame, partial: DataFrame) -> DataFrame:
    """part, doc, t, start, n, bytes: windows of the partial suffixes; equal windows have an equal ``part``.

    A segment's windows go by their anchor string; where that has many segments, they go in blocks of BLOCK
    places before the anchor, by the bytes that all places of a block share."""
    per_doc = partial.groupBy("doc", "t").agg(F.collect_list(F.struct("h", "start", "span", "many")).alias("wanted"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, t, text, wanted in zip(*(batch.column(k) for k in range(4)), strict=True):
                data, doc, t = text.as_buffer().to_pybytes(), doc.as_py(), t.as_py()
                out = []
                for w in wanted.as_py():
                    a, m, at = w["start"], w["span"] % 256, w["span"] // 256
                    if not w["many"]:
                        out.append((w["h"], a, m, data[a : a + m - 1 + LENGTH]))
                        continue
                    for block in range((at - m + 1) // BLOCK, at // BLOCK + 1):
                        one, last = max(at - BLOCK * block - BLOCK + 1, 0), min(at - BLOCK * block, m - 1)
                        core = data[a + at - BLOCK * block : a + at - BLOCK * block - BLOCK + 1 + LENGTH]
                        key = hashlib.blake2b(core, digest_size=8, salt=block.to_bytes(2, "little")).digest()
                        out.append((int.from_bytes(key, "little", signed=True), a + one, last - one + 1, data[a + one : a + last + LENGTH]))
                if out:
                    part, start, n, body = zip(*out, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([doc] * len(part), pa.int64()), pa.array([t] * len(part), pa.int64()), pa.array(start, pa.int64()), pa.array(n, pa.int32()),
                                                      pa.array(body, pa.binary())], names=["part", "doc", "t", "start", "n", "bytes"])

    near, _ = _sieve(rows, partial.select("doc", "t").distinct())
    return near.join(per_doc, ["doc", "t"]).select("doc", "t", "text", "wanted").mapInArrow(cut, "part long, doc long, t long, start long, n int, bytes binary")


def resolve(found: DataFrame, buckets: int) -> DataFrame:
    """doc, t, start, n: runs of windows that also start earlier, window by window."""

    def compare(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        n, doc, t, start = (rows[c].to_numpy() for c in ("n", "doc", "t", "start"))
        hashes = []
        bodies = rows["bytes"].chunk(0) if rows["bytes"].num_chunks else pa.array([], pa.binary())
        for s in ta.slices_of_bytes(bodies):
            count = n[s.first : s.first + s.rows]
            place = np.repeat(s.bounds[:-1] - np.cumsum(count) + count, count) + np.arange(count.sum())
            hashes.append(s.hashes(place, place + LENGTH))
        window = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        row = np.repeat(np.arange(len(n)), n)
        pos = start[row] + np.arange(len(row)) - (np.cumsum(n) - n)[row]
        order = np.lexsort((pos, t[row], doc[row], window))
        again = np.zeros(len(row), bool)
        if len(row):
            new = np.concatenate(([True], window[order][1:] != window[order][:-1]))
            least = order[np.flatnonzero(new)[np.cumsum(new) - 1]]  # the first place of each window
            again[order] = (doc[row[order]] != doc[row[least]]) | (t[row[order]] != t[row[least]]) | (pos[order] != pos[least])
        first = again & np.concatenate(([True], ~again[:-1] | (row[1:] != row[:-1])))[: len(again)]
        at = np.flatnonzero(first)
        length = np.bincount(np.cumsum(first)[again] - 1, minlength=len(at))
        return pa.table({"doc": doc[row[at]], "t": t[row[at]], "start": pos[at], "n": pa.array(length, pa.int32())})

    dealt = found.withColumn("bucket", F.pmod(F.xxhash64("part"), F.lit(buckets)))
    return dealt.groupBy("bucket").applyInArrow(lambda t: compare(t.select(["doc", "t", "start", "n", "bytes"])), "doc long, t long, start long, n int")


def without(rows: DataFrame, spans: DataFrame) -> DataFrame:
    """doc, n_bytes, n_removed, n_spans, kept (bytes) of every row."""
    per_doc = spans.groupBy("doc", "t").agg(F.collect_list(F.struct("start", "n")).alias("spans"))
    some, rest = _sieve(rows, per_doc.select("doc", "t"))
    whole = rest.select("doc", F.octet_length("text").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.col("text").cast("binary").alias("kept"))

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part, out = batch.slice(a, 500), []
                for text, spans in zip(part.column(1), part.column(2), strict=True):
                    data = np.frombuffer(text.as_buffer(), np.uint8)
                    gone = np.zeros(len(data) + 1, np.int64)
                    for w in spans.as_py() or ():
                        if w["start"] < len(data):
                            gone[w["start"]] += 1
                            gone[min(w["start"] + w["n"] - 1 + LENGTH, len(data))] -= 1
                    mask = np.cumsum(gone)[:-1] > 0
                    runs = int(mask[:1].sum() + (mask[1:] & ~mask[:-1]).sum())
                    out.append((len(data), int(mask.sum()), runs, data[~mask].tobytes()))
                size, removed, runs, kept = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(x, pa.int64()) for x in (size, removed, runs)), pa.array(kept, pa.binary())],
                                                 names=["doc", "n_bytes", "n_removed", "n_spans", "kept"])

    cut = some.join(per_doc, ["doc", "t"], "left").select("doc", "text", "spans")
    return cut.mapInArrow(remove, "doc long, n_bytes long, n_removed long, n_spans long, kept binary").unionByName(whole)


def repeats(rows: DataFrame, batches: int = BATCHES) -> DataFrame:
    """doc, t, start, n: runs of n window starts whose LENGTH-byte strings also start earlier."""
    bounds = rows.select(F.percentile_approx("doc", [k / batches for k in range(1, batches)], 10_000).alias("b")).first()["b"] if batches > 1 else []
    index = SuffixLevels()
    out, partial = [], []
    edges = [None, *(bounds or []), None]
    for k in range(len(edges) - 1):
        batch = rows
        if edges[k] is not None:
            batch = batch.where(F.col("doc") > edges[k])
        if edges[k + 1] is not None:
            batch = batch.where(F.col("doc") <= edges[k + 1])
        again, some = index.add(suffixes(batch), last=k == len(edges) - 2)
        out.append(again)
        partial.append(some)
    every = partial[0]
    for p in partial[1:]:
        every = every.unionByName(p)
    every = written(every.groupBy("h", "doc", "t", "start").agg(F.max("span").alias("span"), F.max("many").alias("many")), "suffix-partial")
    buckets = max(1, -(-every.count() // RESOLVE_ROWS))
    spans = resolve(contexts(rows, every), buckets)
    for o in out:
        spans = spans.unionByName(o)
    return written(spans, "repeats")


def deduplicate(docs: DataFrame, batches: int = BATCHES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (bytes) of every document."""
    rows = rows_of(docs, id_col, text_col)
    return without(rows, repeats(rows, batches)).select(F.when(F.col("doc") != LEAST_ID, F.col("doc")).alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept")
