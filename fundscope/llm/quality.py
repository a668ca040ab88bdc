"""Quality rules: fixed base rules, and a logistic regression over hashed word and character n-grams.

The model is fitted on at most ``MAX_LABELLED`` labelled rows (those of the smallest hashed id): features
are the shares of hashed words, word pairs and runs of CHAR_GRAM bytes among a text's n-grams. Part of the
sample is held back to calibrate the margins into probabilities (a logistic fit of one variable). Texts
are scored in Arrow batches, every n-gram of the whole text, against the fixed threshold ``KEEP_FROM``.

Base rules over the words (runs of characters that are not white space): fewer than MIN_WORDS words, or
more than REPEAT_PERCENT of the words inside five-word windows that the text holds twice or more.

Null text: no words, fails the base rules. Labels: null ones and those without a document are left out;
repeated ones count again. With labels of one kind only, or none, the base rules decide alone. Repeated rows
are judged one by one; an empty table gives no rows; other columns pass through ``with_quality`` untouched
(columns of the same names as its own are replaced).
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch_path
from . import textarrays as ta
from .common import written

WORD_BITS, CHAR_BITS, CHAR_GRAM = 15, 15, 4
FEATURES = (1 << WORD_BITS) + (1 << CHAR_BITS)
#: Feature values are shares times this, to suit the regularisation.
SCALE = 20.0
MAX_LABELLED = 6_000
#: Of ten labelled rows, so many calibrate.
CALIBRATE_TENTHS = 3
REG, ITERATIONS = 1e-4, 30
KEEP_FROM = 0.5
MIN_WORDS, REPEAT_PERCENT, WINDOW = 10, 20, 5
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True

STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def grams(s: ta.Slice, words: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Feature and row of each word n-gram, and of each character n-gram."""
    pairs, at = ta.windows(words, row, 2)
    word = np.concatenate((words, pairs)) >> np.uint64(64 - WORD_BITS)
    word_row = np.concatenate((row, row[at]))
    n = len(s.data) - CHAR_GRAM + 1
    if n <= 0:
        return word.astype(np.int64), word_row, np.zeros(0, np.int64), np.zeros(0, np.int64)
    code = np.zeros(n, np.uint32)
    for k in range(CHAR_GRAM):
        code = (code << np.uint32(8)) | s.data[k : k + n]
    char = ((code * np.uint32(0x9E3779B1)) >> np.uint32(32 - CHAR_BITS)).astype(np.int64) + (1 << WORD_BITS)
    char_row = np.repeat(np.arange(s.rows), np.diff(s.bounds))[:n]
    inside = np.arange(n) + CHAR_GRAM <= s.bounds[char_row + 1]
    return word.astype(np.int64), word_row, char[inside], char_row[inside]


def statistics(s: ta.Slice, words: np.ndarray, begin: np.ndarray, row: np.ndarray) -> np.ndarray:
    """The columns of STATS for each row."""
    out = np.zeros((s.rows, len(STATS)), np.int64)
    out[:, 0] = np.bincount(row, minlength=s.rows)
    in_text = np.concatenate(([0], np.cumsum(((s.data & 0xC0) != 0x80) & ~ta.SPACE[s.data])))
    out[:, 1] = in_text[s.bounds[1:]] - in_text[s.bounds[:-1]]
    symbols = np.concatenate(([0], np.cumsum(SYMBOLS[s.data])))
    out[:, 2] = symbols[s.bounds[1:]] - symbols[s.bounds[:-1]]
    line_begin, line_end, line_row = s.runs(ta.NEWLINE)
    with_word = np.searchsorted(begin, line_begin) < np.searchsorted(begin, line_end)
    line_begin, line_end, line_row = line_begin[with_word], line_end[with_word], line_row[with_word]
    again = _repeats(s.hashes(line_begin, line_end), line_row)[0]
    out[:, 3] = np.bincount(line_row[again], minlength=s.rows)
    window, at = ta.windows(words, row, WINDOW)
    found = at[_repeats(window, row[at])[1]]
    cover = np.zeros(len(words) + 1, np.int64)
    np.add.at(cover, found, 1)
    np.add.at(cover, found + WINDOW, -1)
    out[:, 4] = np.bincount(row[np.cumsum(cover)[:-1] > 0], minlength=s.rows)
    return out


def _repeats(hashes: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of values in row order: those equal to an earlier one of their row, and those equal to any other."""
    key = ta.mix(hashes ^ (row.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    later, any_ = np.zeros(len(key), bool), np.zeros(len(key), bool)
    later[order[1:][same]] = True
    any_[order[1:][same]] = True
    any_[order[:-1][same]] = True
    return later, any_


@dataclass(frozen=True)
class Model:
    """Weights of the features, and the line that turns margins into log odds."""

    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def margins(self, s: ta.Slice, words: np.ndarray, row: np.ndarray) -> np.ndarray:
        out = np.full(s.rows, self.bias)
        word, word_row, char, char_row = grams(s, words, row)
        for feature, at in ((word, word_row), (char, char_row)):
            n = np.bincount(at, minlength=s.rows)
            out += SCALE * np.bincount(at, self.weights[feature], s.rows) / np.maximum(n, 1)
        return out

    def probabilities(self, margins: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margins + self.shift, -60, 60)))


def _vectors(rows: DataFrame) -> DataFrame:
    """Sparse features (f, v) of the texts; the other column (good) stays."""

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in ta.slices(batch.column(0)):
                words, row = s.words()
                feature, value, offsets = [], [], [0]
                word, word_row, char, char_row = grams(s, words, row)
                key = np.concatenate((word_row, char_row)) * FEATURES + np.concatenate((word, char))
                key, count = np.unique(key, return_counts=True)
                doc, f = key // FEATURES, key % FEATURES
                n = np.stack((np.bincount(word_row, minlength=s.rows), np.bincount(char_row, minlength=s.rows)))
                v = SCALE * count / n[(f >= 1 << WORD_BITS).astype(int), doc]
                offsets = np.searchsorted(doc, np.arange(s.rows + 1))
                yield pa.RecordBatch.from_arrays(
                    [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(f, pa.int32())),
                     pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(v, pa.float64())),
                     batch.column(1).slice(s.first, s.rows).cast(pa.float64())], names=["f", "v", "good"])

    return rows.select("text", "good").mapInArrow(features, "f array<int>, v array<double>, good double")


def _as_vectors(rows: DataFrame, name: str) -> DataFrame:
    """label, features of rows (f, v, good), by a LibSVM file: Spark's own reader makes the sparse vectors, so no
    Python worker stands beside the one that made the features."""
    spark = rows.sparkSession
    path = scratch_path(spark, f"{name}-{uuid.uuid4().hex}")
    pairs = F.transform(F.arrays_zip("f", "v"), lambda x: F.concat((x["f"] + 1).cast("string"), F.lit(":"), x["v"].cast("float").cast("string")))
    lines = rows.repartition(8).select(F.concat_ws(" ", F.col("good").cast("string"), pairs).alias("value"))
    lines.write.option("compression", "gzip").text(path)
    return spark.read.format("libsvm").option("numFeatures", FEATURES).load(path)


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, id_col: str = "doc_id", text_col: str = "text") -> Model | None:
    """The model from labels (id, good 0/1) of the documents; None without both kinds of labels."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    order = F.xxhash64(id_col, F.lit("labelled"))
    known = labels.where(F.col("good").isNotNull() & F.col(id_col).isNotNull()).select(id_col, F.col("good").cast("int").alias("good"))
    chosen = known.join(docs.select(id_col), id_col, "left_semi").orderBy(order, "good").limit(max_labelled)
    # at most max_labelled rows, so its size is bounded
    sample = docs.select(id_col, F.col(text_col).cast("string").alias("text")).join(F.broadcast(chosen), id_col)
    calibrate = F.pmod(F.xxhash64("f", F.lit("calibrate")), F.lit(10)) < CALIBRATE_TENTHS
    rows = written(_vectors(sample), "quality-features").withColumn("calibrate", calibrate)
    kinds = {(r["calibrate"], r["good"]) for r in rows.select("calibrate", "good").distinct().collect()}
    if not {(False, 0.0), (False, 1.0)} <= kinds:
        return None
    model = LogisticRegression(regParam=REG, maxIter=ITERATIONS, standardization=False).fit(_as_vectors(rows.where("not calibrate"), "quality-fit"))
    slope, shift = 1.0, 0.0
    if {(True, 0.0), (True, 1.0)} <= kinds:
        held = model.transform(_as_vectors(rows.where("calibrate"), "quality-held"))
        held = held.select("label", vector_to_array("rawPrediction")[1].alias("margin"))
        held = VectorAssembler(inputCols=["margin"], outputCol="features").transform(held)
        line = LogisticRegression(regParam=1e-3, maxIter=50, standardization=False).fit(held)
        slope, shift = float(line.coefficients[0]), float(line.intercept)
    return Model(np.asarray(model.coefficients.toArray()), float(model.intercept), slope, shift)


RESULT = [T.StructField(n, T.LongType()) for n in STATS] + [
    T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType()), T.StructField("p_quality", T.DoubleType())]


def with_quality(docs: DataFrame, model: Model | None, keep_from: float = KEEP_FROM, text_col: str = "text",
                 columns: list[str] | None = None) -> DataFrame:
    """Adds the columns of STATS, base_failed, kept and p_quality (null without a model); ``columns``: those kept."""
    names = [f.name for f in RESULT]
    passed = [c for c in (docs.columns if columns is None else columns) if c not in names]
    rows = docs.select(F.col(text_col).cast("string").alias("__text"), *passed)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # FEATURES weights, whatever the data

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            for s in ta.slices(batch.column(0)):
                begin, end, row = s.runs(ta.SPACE)
                words = s.hashes(begin, end)
                stats = statistics(s, words, begin, row)
                failed = (stats[:, 0] < MIN_WORDS) | (100 * stats[:, 4] > REPEAT_PERCENT * stats[:, 0])
                p = own.probabilities(own.margins(s, words, row)) if own else None
                kept = ~failed & (p >= keep_from) if own else ~failed
                part = batch.slice(s.first, s.rows)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[1:], *(pa.array(stats[:, k]) for k in range(len(STATS))), pa.array(failed), pa.array(kept),
                     pa.array(np.round(p, 6)) if own else pa.nulls(s.rows, pa.float64())], names=[*passed, *names])

    return rows.mapInArrow(score, T.StructType([rows.schema[c] for c in passed] + RESULT))
