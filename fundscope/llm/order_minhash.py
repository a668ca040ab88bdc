"""Near-duplicates by Order MinHash, verified by banded alignment.

The k-mers are five-word shingles, each labelled with its occurrence in the text, so repeats count; texts of less than
SHORT words have three-word shingles, as an edit breaks a larger part of them (texts about that long have both). A
sketch takes the two k-mers of least hash and keeps them in text order; there are SKETCHES of them, under different
hashes. Texts that share EQUAL sketches are candidates. The verdict is an alignment of their words: they are linked if
their edit distance is at most ``1 - least`` of the longer one. At an edit similarity of 0.9 with the edits all over the
text, a sketch is shared with a chance of about 0.17, so a pair misses with about 0.02.

Equal texts are one unit from the start, and of sketches with the same members one counts. The texts of a sketch meet
one pivot, that which shares its sketches with most others (of a family of copies, the text they come from): its star.
Those linked to it are one component and need not meet each other. One that is not linked meets all others of the star:
in a small star pair by pair, if they share EQUAL sketches; in a large one in tiles of TILE by TILE texts, where the words
that each lost and gained against the pivot bound every distance from below by two matrix products (edit distance is at
least the number of words of one text that the other lacks). A tile aligns the pairs that the bound leaves, nearest
first, but for those that its links already connect, and returns the links that connected something: fewer than it has
texts. So no class is parted, and no more rows are made than texts times tiles; the products grow with the square of a
family's texts that are unequal and not linked to its pivot.

Texts of one to four words have one shingle, the whole text; texts without words are equal to each other.
Null text: empty. A class's id is its least document id (null only if all are); repeated rows have the same
class. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bitmap
from . import textarrays as ta
from .common import text_of, written
from .components import components

SHINGLE, SHORT_SHINGLE, SHORT = 5, 3, 64
SKETCHES, EQUAL, LEAST = 32, 2, 0.9
#: Texts of a star that meet pair by pair, texts of a tile's side, and buckets of the words that a text gained.
SMALL_GROUP, TILE, GAINED = 16, 512, 4096
_ODD = np.random.Generator(np.random.PCG64(77)).integers(1, 2**63, SKETCHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_TOP = np.uint64(0xFFFFFFFFFFFFFFFF)


def _shingles(words: np.ndarray, row: np.ndarray, rows: int, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Shingles in text order and their rows; a text of fewer words than a shingle has one."""
    shingles, at = ta.windows(words, row, size)
    doc = row[at]
    n = np.bincount(row, minlength=rows)
    short = np.flatnonzero((n > 0) & (n < size))
    if len(short):
        first = np.searchsorted(row, short)
        whole = np.zeros(len(short), np.uint64)
        for k in range(size - 1):
            here = n[short] > k
            whole[here] = ta.mix(whole[here] * np.uint64(31) + words[first[here] + k] + np.uint64(k))
        shingles, doc = np.concatenate((shingles, whole)), np.concatenate((doc, short))
        order = np.argsort(doc, kind="stable")
        shingles, doc = shingles[order], doc[order]
    return shingles, doc


def _labelled(shingles: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Hash of each shingle with its occurrence number in the text."""
    order = np.lexsort((shingles, doc))
    s, d = shingles[order], doc[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (d[1:] != d[:-1])
    start = np.maximum.accumulate(np.where(new, np.arange(len(s)), 0))
    out = np.empty_like(shingles)
    out[order] = ta.mix(s + (np.arange(len(s)) - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return out


def _sketched(words: np.ndarray, row: np.ndarray, rows: int, size: int, wanted: np.ndarray) -> np.ndarray:
    """SKETCHES columns for each wanted row (a mask); rows in order."""
    keep = wanted[row]
    shingles, doc = _shingles(words[keep], row[keep], rows, size)
    labelled = _labelled(shingles, doc)
    n = np.bincount(doc, minlength=rows)
    full = np.flatnonzero(n)
    out = np.zeros((len(full), SKETCHES), np.uint64)
    if not len(full):
        return out
    starts = (np.cumsum(n) - n)[full]
    index = np.repeat(np.arange(len(full)), n[full])
    for j in range(SKETCHES):
        g = labelled * _ODD[j]
        g ^= g >> np.uint64(32)
        pair = []
        for _ in range(2):
            low = np.minimum.reduceat(g, starts)
            at = np.flatnonzero(g == low[index])
            place = np.zeros(len(full), np.int64)
            place[index[at[::-1]]] = at[::-1]
            g[place] = _TOP
            pair.append(place)
        one, two = np.minimum(*pair), np.maximum(*pair)
        out[:, j] = ta.mix(labelled[one] * np.uint64(3) + ta.mix(labelled[two]) + np.uint64(j + size * SKETCHES))
    return out


def sketches(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """unit, n_words, sketch from unit, text: SKETCHES longs of five-word shingles, then as many of three-word ones, null
    where the text's length has none; texts without words have an empty sketch."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in ta.slices(batch.column(1)):
                words, row = s.words()
                n = np.bincount(row, minlength=s.rows)
                # a linked pair has lengths within ``least`` of each other, so both have the one kind or the other
                kinds = ((SHINGLE, n >= least * SHORT), (SHORT_SHINGLE, (n > 0) & (n < SHORT / least)))
                values = np.zeros((s.rows, 2 * SKETCHES), np.uint64)
                none = np.ones((s.rows, 2 * SKETCHES), bool)
                for k, (size, wanted) in enumerate(kinds):
                    at = slice(k * SKETCHES, (k + 1) * SKETCHES)
                    values[wanted, at] = _sketched(words, row, s.rows, size, wanted)
                    none[wanted, at] = False
                some = n > 0
                ends = np.concatenate(([0], np.cumsum(some) * 2 * SKETCHES)).astype(np.int32)
                flat = pa.array(values[some].ravel().view(np.int64), mask=none[some].ravel())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(s.first, s.rows), pa.array(n), pa.ListArray.from_arrays(pa.array(ends), flat)], names=["unit", "n_words", "sketch"])

    return docs.mapInArrow(sketch, "unit long, n_words long, sketch array<long>")


def word_bank(docs: DataFrame, wanted: np.ndarray) -> DataFrame:
    """unit, words (32-bit hashes, as bytes) of the units that a bitmap lets through."""
    sent = docs.sparkSession.sparkContext.broadcast(wanted)

    def bank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = bitmap.holds(sent.value, batch.column(0).to_numpy().view(np.uint64))
            batch = batch.filter(pa.array(keep))
            for s in ta.slices(batch.column(1)):
                words, row = s.words()
                data = (words >> np.uint64(32)).astype("<u4")
                cut = np.searchsorted(row, np.arange(s.rows + 1))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(s.first, s.rows),
                                                  pa.array([data[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary())], names=["unit", "words"])

    return docs.mapInArrow(bank, "unit long, words binary")


def apart(x: np.ndarray, y: np.ndarray) -> int:
    """A lower bound of the edit distance: words of the longer text that the other does not have as often."""
    value, count = np.unique(x, return_counts=True)
    y = np.sort(y)
    there = np.searchsorted(y, value, "right") - np.searchsorted(y, value, "left")
    return max(len(x), len(y)) - int(np.minimum(count, there).sum())


def edits(x: np.ndarray, y: np.ndarray, band: int) -> int | None:
    """Word edit distance if at most ``band``: bit-parallel alignment inside the band, a column a word.

    Bit k of a column's words stands for row ``column + k - band``; the band moves down a row with each column. The
    score follows the band's lowest row, then the last row of the table."""
    if abs(len(x) - len(y)) > band:
        return None
    n = min(len(x), len(y))
    same = np.flatnonzero(x[:n] != y[:n])
    head = int(same[0]) if len(same) else n
    x, y = x[head:], y[head:]
    n = min(len(x), len(y))
    same = np.flatnonzero(x[len(x) - n :][::-1] != y[len(y) - n :][::-1])
    tail = int(same[0]) if len(same) else n
    x, y = x[: len(x) - tail], y[: len(y) - tail]
    if not len(x) or not len(y):
        return max(len(x), len(y))
    if band == 0 or apart(x, y) > band:
        return None
    if len(x) < len(y):
        x, y = y, x
    band = min(band, len(x))
    at: dict[int, int] = {}
    for i, w in enumerate(x.tolist()):
        at[w] = at.get(w, 0) | 1 << i + band
    width = 2 * band + 1
    mask, low = (1 << width) - 1, 1 << width - 1
    vp, vn, d = (mask << band) & mask, 0, band
    rows = len(x)
    for i, w in enumerate(y.tolist()):
        equal = (at.get(w, 0) >> i) & mask
        d0 = ((((equal & vp) + vp) & mask) ^ vp) | equal | vn
        hp = vn | (mask & ~(d0 | vp))
        hn = d0 & vp
        over = i - (rows - band)
        if over < 0:
            d += 0 if d0 & low else 1
        else:
            bit = low >> over + 1
            d += (1 if hp & bit else 0) - (1 if hn & bit else 0)
        if d > 3 * band:
            return None
        down = d0 >> 1
        vp, vn = hn | (mask & ~(down | hp)), down & hp
    return d if d <= band else None


def allowed(longer: int, least: float) -> int:
    """Edits of a linked pair whose longer text has so many words."""
    return int((1 - least) * longer + 1e-9)


def compared(pairs: DataFrame, bank: DataFrame, least: float) -> DataFrame:
    """a, b and linked of each pair."""
    one = bank.select(F.col("unit").alias("a"), F.col("words").alias("words_a"))
    two = bank.select(F.col("unit").alias("b"), F.col("words").alias("words_b"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), "<u4"), np.frombuffer(y.as_buffer(), "<u4")
                linked.append(edits(x, y, allowed(max(len(x), len(y)), least)) is not None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(linked, pa.bool_())], names=["a", "b", "linked"])

    return pairs.join(one, "a").join(two, "b").select("a", "b", "words_a", "words_b").mapInArrow(check, "a long, b long, linked boolean")


def _upto(n: np.ndarray) -> np.ndarray:
    """0, 1, .. n - 1 for each n, one after the other."""
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def _against(pivot: np.ndarray, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """What each text lost of the pivot's words (a column an occurrence), and what it gained (occurrences of words, by
    bucket)."""
    own, times = np.unique(pivot, return_counts=True)
    start = np.cumsum(times) - times
    lost = np.zeros((len(texts), len(pivot)), np.float32)
    gained = np.zeros((len(texts), GAINED), np.float32)
    for i, x in enumerate(texts):
        word, count = np.unique(x, return_counts=True)
        at = np.searchsorted(own, word)
        there = at < len(own)
        there[there] = own[at[there]] == word[there]
        kept = np.zeros(len(own), np.int64)
        kept[at[there]] = np.minimum(count[there], times[at[there]])
        lost[i, np.repeat(start + kept, times - kept) + _upto(times - kept)] = 1
        more = count.copy()
        more[there] -= kept[at[there]]
        bucket = ta.mix(np.repeat(word, more).astype(np.uint64) * np.uint64(31) + _upto(more).astype(np.uint64)) % np.uint64(GAINED)
        np.add.at(gained[i], bucket.astype(np.int64), 1)
    return lost, gained


def bound(lost_x: np.ndarray, gained_x: np.ndarray, lost_y: np.ndarray, gained_y: np.ndarray) -> np.ndarray:
    """Least possible edit distances of texts x (rows) and y (columns), by what they lost and gained against one pivot."""
    both_lost, both_gained = lost_x @ lost_y.T, gained_x @ gained_y.T  # at least what they have in common
    lx, gx, ly, gy = (v.sum(axis=1) for v in (lost_x, gained_x, lost_y, gained_y))
    only_y = np.maximum(gy - both_gained, 0) + np.maximum(lx[:, None] - both_lost, 0)
    only_x = np.maximum(gx[:, None] - both_gained, 0) + np.maximum(ly - both_lost, 0)
    return np.maximum(only_x, only_y)


def tiled(star: DataFrame, bank: DataFrame, least: float) -> DataFrame:
    """a, b: verified links inside the stars (pivot, unit, linked, n: its size) that connect, with those to the pivots, all
    that any two of a star's texts link."""
    parts = F.ceil(F.col("n") / TILE)
    rows = star.withColumn("own", F.pmod(F.xxhash64("unit"), parts)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), parts - 1)))
    rows = rows.select("pivot", "unit", "linked", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    texts = bank.select("unit", "words")
    rows = rows.join(texts, "unit").join(texts.select(F.col("unit").alias("pivot"), F.col("words").alias("pivot_words")), "pivot")

    def tile(key: tuple, table: pa.Table) -> pa.Table:
        _, i, j = (k.as_py() for k in key)
        pivot = np.frombuffer(table["pivot_words"][0].as_buffer(), "<u4")
        texts = [np.frombuffer(x.as_buffer(), "<u4") for x in table["words"]]
        unit, linked, own = (table[c].to_numpy(zero_copy_only=False) for c in ("unit", "linked", "own"))
        size = np.array([len(x) for x in texts])
        lost, gained = _against(pivot, texts)
        x, y = np.flatnonzero(own == i), np.flatnonzero(own == j)
        low = bound(lost[x], gained[x], lost[y], gained[y])
        most = ((1 - least) * np.maximum(size[x][:, None], size[y]) + 1e-9).astype(np.int64)
        left = (low <= most) & ~(linked[x][:, None] & linked[y]) & (np.abs(size[x][:, None] - size[y]) <= most)
        if i == j:
            left = np.triu(left, 1)
        r, c = np.nonzero(left)
        order = np.argsort(low[r, c], kind="stable")
        root = np.where(linked, int(np.argmax(linked)), np.arange(len(unit))).tolist()

        def find(k: int) -> int:
            while root[k] != k:
                root[k] = k = root[root[k]]
            return k

        found = []
        for k, m in zip(x[r[order]].tolist(), y[c[order]].tolist(), strict=True):
            if (p := find(k)) != (q := find(m)) and edits(texts[k], texts[m], allowed(max(size[k], size[m]), least)) is not None:
                root[p] = q
                found.append((k, m))
        a, b = (unit[[pair[side] for pair in found]] if found else unit[:0] for side in (0, 1))
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    return rows.groupBy("pivot", "i", "j").applyInArrow(tile, "a long, b long")


def _apart_keys(group: DataFrame) -> DataFrame:
    """Keys of two members or more, one of those with the same members (that of the first sketch): key, j."""
    per = group.groupBy("key").agg(F.min("j").alias("j"), F.count("*").alias("n"), F.min("unit").alias("low"), F.max("unit").alias("high"),
                                   F.bit_xor(F.xxhash64("unit")).alias("x"), F.bit_xor(F.xxhash64("unit", F.lit(1))).alias("y")).where("n > 1")
    return per.groupBy("n", "low", "high", "x", "y").agg(F.min(F.struct("j", "key")).alias("k")).select("k.key", "n")


def links(units: DataFrame, texts: DataFrame, least: float = LEAST) -> DataFrame:
    """a, b: enough verified links to connect every class. ``units``: unit, n_words, sketch; ``texts``: unit, text."""
    keys = units.select("unit", F.posexplode("sketch").alias("j", "key")).where("key IS NOT NULL")
    group = written(keys.join(_apart_keys(keys), "key"), "sketch-groups")
    # the text that others were made from shares more of its sketches than they do with each other
    shared = written(group.groupBy("unit").agg(F.sum("n").alias("score")), "sketch-scores")
    bank = written(word_bank(texts, bitmap.build(shared, "unit")).dropDuplicates(["unit"]), "word-bank")
    own = written(units.join(shared.select("unit"), "unit", "left_semi").select("unit", "sketch"), "sketches-met")
    pivots = group.join(shared, "unit").groupBy("key").agg(F.max(F.struct("score", "unit"))["unit"].alias("pivot"))
    star = written(group.join(pivots, "key").where("unit <> pivot").select("pivot", "unit").distinct(), "sketch-stars")
    first = star.select(F.least("unit", "pivot").alias("a"), F.greatest("unit", "pivot").alias("b")).distinct()
    first = written(compared(first, bank, least), "compared")
    linked = first.where("linked").select("a", "b")
    both = linked.select(F.col("a").alias("pivot"), F.col("b").alias("unit")).union(linked.select("b", "a")).withColumn("linked", F.lit(True))
    marked = written(star.join(both, ["pivot", "unit"], "left").withColumn("linked", F.coalesce("linked", F.lit(False))), "marked")
    # stars that the pivot's links cover are done; written, so that the join can split a star of many texts
    open_ = marked.groupBy("pivot").agg(F.count("*").alias("n"), F.bool_and("linked").alias("all")).where("n > 1 and not all").drop("all")
    marked = written(marked.join(written(open_, "open-stars"), "pivot"), "marked")
    small = marked.where(F.col("n") <= SMALL_GROUP)
    pairs = small.where("not linked").select("pivot", F.col("unit").alias("x")).join(small.select("pivot", F.col("unit").alias("y")), "pivot").where("x <> y")
    pairs = pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    one = own.select(F.col("unit").alias("a"), F.col("sketch").alias("sketch_a"))
    two = own.select(F.col("unit").alias("b"), F.col("sketch").alias("sketch_b"))
    equal = F.size(F.filter(F.zip_with("sketch_a", "sketch_b", lambda x, y: x == y), lambda e: F.coalesce(e, F.lit(False))))
    pairs = pairs.join(one, "a").join(two, "b").where(equal >= EQUAL).select("a", "b")
    pairs = pairs.join(first, ["a", "b"], "left_anti")
    rest = written(compared(written(pairs, "pairs-left"), bank, least), "compared")
    return linked.union(rest.where("linked").select("a", "b")).union(written(tiled(marked.where(F.col("n") > SMALL_GROUP), bank, least), "tile-links"))


def unit_of(text_col: str = "text"):
    return F.xxhash64(text_of(text_col).cast("string"))


def classes(docs: DataFrame, least: float = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, class_id, unit (hash of the text) of every row."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), unit_of(text_col).alias("unit"), text_of(text_col).cast("string").alias("text"))
    texts = rows.select("unit", "text")
    units = written(sketches(texts, least).dropDuplicates(["unit"]), "sketches")
    empty = units.where("size(sketch) = 0").agg(F.min("unit").alias("a"))
    blank = units.where("size(sketch) = 0").select(F.col("unit").alias("b")).join(F.broadcast(empty), F.lit(True)).select("a", "b")
    roots = components(links(units, texts, least).union(blank))
    member = rows.select("doc_id", "unit").join(roots.withColumnRenamed("node", "unit"), "unit", "left").withColumn("root", F.coalesce("root", "unit"))
    first = member.groupBy("root").agg(F.min("doc_id").alias("class_id"))
    return member.join(first, "root").select("doc_id", "class_id", "unit", "root")
