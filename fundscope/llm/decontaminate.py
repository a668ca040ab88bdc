"""Benchmark decontamination: size-partitioned MinHash containment search, verified on exact shingles.

Documents are cut into windows of at most 256 five-word shingles, and each window goes to the size class of
the next power of two. A class has half as many bins as its largest size; the least shingle hash of each bin
(one-permutation MinHash) is a key, so short items and windows are compared at a similar size however long
the document is. An item is hashed once for each class. A document that shares a key with an item is a
candidate; it is dropped unless at least ``least`` of the item's distinct shingles occur in the whole document.

An item shingle is a window's key with a chance of about 0.4, so a document with 9 shingles of an item in one
window misses with 1 %, and one with 26 with less than one in a million. Items of less than FEW shingles are
therefore searched without sampling: each of their shingles is looked for in every document, through a bitmap.

The whole text of an item of less than five words is its one shingle; documents are searched for runs of so many
words, if there are such items. Items without words are not searched.
Null text: empty. Rows of equal id and text are one document (or item); rows of equal id, or without one, and other
texts are documents of their own. Empty tables give no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bitmap
from . import textarrays as ta
from .common import written

SHINGLE, WINDOW, CLASSES = 5, 256, (5, 6, 7, 8)
LEAST = 0.8
#: Items of less shingles than this are not sampled (0.8 of 32 are 26).
FEW = 32


def _minima(shingles: np.ndarray, block: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Key and block of the least hash of each bin; blocks are numbered in order."""
    order = np.lexsort((shingles, block))
    s, b = shingles[order], block[order]
    bins = s >> np.uint64(64 - (level - 1))
    first = np.ones(len(s), bool)
    first[1:] = (bins[1:] != bins[:-1]) | (b[1:] != b[:-1])
    return ta.mix(s[first] + np.uint64(level)), b[first]


def _rows(ids: pa.Array, at: np.ndarray, values: np.ndarray, name: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([ids.take(pa.array(at)), pa.array(values.view(np.int64))], names=["id", name])


def key_of(id_col: str = "doc_id", text_col: str = "text"):
    """Key of a row: rows of equal id (null or not) and text are one."""
    return F.xxhash64(F.col(id_col).cast("long"), F.coalesce(F.col(text_col).cast("string"), F.lit("")))


def _texts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(key_of(id_col, text_col).alias("id"), F.col(text_col).cast("string").alias("text"))


def item_keys(items: DataFrame) -> DataFrame:
    """id, key: the minima of each item in every class."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in ta.slices(batch.column(1)):
                words, row = s.words()
                shingles, at = ta.windows(words, row, SHINGLE)
                for level in CLASSES:
                    key, block = _minima(shingles, row[at], level)
                    yield _rows(batch.column(0), block + s.first, key, "key")

    return items.mapInArrow(keys, "id long, key long")


def document_keys(docs: DataFrame, words_of: np.ndarray) -> DataFrame:
    """id, key: the windows' minima that the bitmap of the items' keys lets through."""
    sent = docs.sparkSession.sparkContext.broadcast(words_of)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in ta.slices(batch.column(1)):
                words, row = s.words()
                shingles, at = ta.windows(words, row, SHINGLE)
                doc = row[at]
                n = np.bincount(doc, minlength=s.rows)
                place = np.arange(len(doc)) - (np.cumsum(n) - n)[doc]
                windows = -(-n // WINDOW)
                block = (np.cumsum(windows) - windows)[doc] + place // WINDOW
                size = np.bincount(block, minlength=int(windows.sum()))
                level = np.clip(np.ceil(np.log2(np.maximum(size, 1))).astype(int), CLASSES[0], CLASSES[-1])
                owner = np.repeat(np.arange(s.rows), windows)
                for c in CLASSES:
                    mine = level[block] == c
                    if mine.any():
                        key, b = _minima(shingles[mine], block[mine], c)
                        hit = bitmap.holds(sent.value, key)
                        yield _rows(batch.column(0), owner[b[hit]] + s.first, key[hit], "key")

    return docs.mapInArrow(keys, "id long, key long")


def shingle_rows(texts: DataFrame, sizes: list[int], words_of: np.ndarray | None = None) -> DataFrame:
    """id, shingle: the distinct shingles of each text, and its runs of ``sizes`` words, if given only those that a
    bitmap lets through. Without a bitmap (items), runs are whole texts."""
    sent = texts.sparkSession.sparkContext.broadcast(words_of)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in ta.slices(batch.column(1)):
                words, row = s.words()
                n = np.bincount(row, minlength=s.rows)
                found = []
                for size in (*sizes, SHINGLE):
                    shingles, at = ta.windows(words, row, size)
                    doc = row[at]
                    hit = (n[doc] == size) | (size == SHINGLE) if sent.value is None else bitmap.holds(sent.value, shingles)
                    found.append((shingles[hit], doc[hit]))
                shingles, doc = (np.concatenate(c) for c in zip(*found, strict=True))
                order = np.lexsort((shingles, doc))
                shingles, doc = shingles[order], doc[order]
                new = np.ones(len(doc), bool)
                new[1:] = (shingles[1:] != shingles[:-1]) | (doc[1:] != doc[:-1])
                yield _rows(batch.column(0), doc[new] + s.first, shingles[new], "shingle")

    return texts.mapInArrow(rows, "id long, shingle long")


def run_sizes(items: DataFrame) -> list[int]:
    """The numbers of words that items of less than SHINGLE words have."""

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in ta.slices(batch.column(1)):
                n = np.unique(np.bincount(s.words()[1], minlength=s.rows))
                yield pa.RecordBatch.from_arrays([pa.array(n[(n > 0) & (n < SHINGLE)], pa.int64())], names=["n"])

    return sorted(r["n"] for r in items.mapInArrow(sizes, "n long").distinct().collect())


def search(docs: DataFrame, items: DataFrame, least: float = LEAST, id_col: str = "doc_id", text_col: str = "text",
           item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, item_id, n_shared, n_item, containment, doc_key (``key_of``) of every document that holds an item."""
    texts, wanted = _texts(docs, id_col, text_col), _texts(items, item_id, item_text)
    runs = run_sizes(wanted)
    # each step is written: as one query the driver would hold dozens of stages, scans and broadcasts at a time
    item_shingles = written(shingle_rows(wanted, list(range(1, SHINGLE))).withColumnRenamed("id", "item").distinct(), "item-shingles")
    sizes = item_shingles.groupBy("item").agg(F.count("*").alias("n_item"))
    sized = written(item_shingles.join(sizes, "item"), "item-sizes")
    few, many = sized.where(F.col("n_item") < FEW), sized.where(F.col("n_item") >= FEW)

    by_key = written(item_keys(wanted).withColumnRenamed("id", "item").distinct().join(many, "item", "left_semi"), "item-keys")
    keys = document_keys(texts, bitmap.build(by_key, "key"))
    candidates = written(keys.distinct().join(by_key, "key").select("id", "item").distinct(), "item-candidates")
    own = shingle_rows(texts.join(candidates, "id", "left_semi"), runs, bitmap.build(many, "shingle"))
    shared = own.distinct().join(many, "shingle").groupBy("id", "item", "n_item").agg(F.count("*").alias("n_shared"))
    shared = written(shared.join(candidates, ["id", "item"], "left_semi"), "item-shared")
    whole = shingle_rows(texts, runs, bitmap.build(few, "shingle")).distinct()
    exact = written(whole.join(few, "shingle").groupBy("id", "item", "n_item").agg(F.count("*").alias("n_shared")), "item-shared")
    found = shared.union(exact).withColumn("containment", F.round(F.col("n_shared") / F.col("n_item"), 6)).where(F.col("n_shared") >= least * F.col("n_item"))
    names = docs.select(key_of(id_col, text_col).alias("id"), F.col(id_col).cast("long").alias("doc_id")).join(found.select("id").distinct(), "id", "left_semi").distinct()
    items_ = items.select(key_of(item_id, item_text).alias("item"), F.col(item_id).cast("long").alias("item_id")).distinct()
    return found.join(names, "id").join(items_, "item").select("doc_id", "item_id", "n_shared", "n_item", "containment", F.col("id").alias("doc_key"))
