"""Line dedup by a segment-partition edit join, in SQL functions only.

Distinct lines that are not blank are the units. Two are linked if their edit distance is at most one edit for
each PER_EDIT characters of the shorter, and at most TAU; shorter lines have exact copies only. For e edits each
is cut into e + 1 segments, one of which an edited copy must
hold unchanged, at a place that the lengths and the edits left over narrow down. Segments are the index
(keys of length, number, content); substrings at the possible places are the probes. Pairs with a common key
are verified by banded bit-parallel edit distance (a word of 2 * TAU + 1 bits, a column a character).

A key with more than HOT index lines (its square at the next level) does not make all its pairs. Its lines meet one of them, the pivot; those
within TAU of it are one component with it. The others are indexed anew by how they differ from the pivot: lines
are cut into pieces behind every character whose code CUT divides (a blank is one), an edit changes at most
three pieces (one becomes two), so the differences of two lines within TAU
differ in at most SPREAD pieces, and the first pieces of both differences must meet (prefix filtering of sets;
those that are the pivot's own difference from the others come last). Of such pairs those are left whose differences in
character GRAM-grams are near enough, too, as an edit changes at most 2 * GRAM of them. This is repeated for keys that are hot again. So a common phrase does not make pairs with the square of
its size. Near copies do where they are linked to each other, as every link counts for n_links; those of two lines
linked to one pivot are spare, and the components are made without them.

A line's class is the first of its class by (doc_id, text hash, line_no); the first line stays. Null text: empty. Blank
lines (nothing but ASCII white space) are not judged. Null ids sort first; rows of equal id and text are one document,
rows of equal id and other text are others. Units are known by a 64-bit hash. An empty table gives no rows. Other columns are not read (``without_repeats`` passes them through).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_of, written
from .components import components

#: Lines of LEAST_NEAR characters may have TAU edits, shorter ones one for each PER_EDIT characters.
TAU, LEAST_EXACT, PER_EDIT = 2, 1, 10
LEAST_NEAR = TAU * PER_EDIT
HOT, LEVELS = 8, 3
GRAM, CUT = 3, 4
#: Pieces by which the differences of two lines within TAU may differ.
SPREAD = 3 * TAU
#: Grams by which they may differ.
GRAM_SPREAD = 2 * GRAM * TAU
#: Bits of the bitmap of lines looked for, of 64 a row.
BITS = 23
#: Common characters that are left before and behind the part to verify.
MARGIN = 4 * TAU


def _places(edits: int) -> list[tuple[int, int, int]]:
    """(length difference, segment, shift) of every substring to probe: places that both the edits before
    and the edits behind the segment allow."""
    out = []
    for more in range(edits + 1):
        for part in range(edits + 1):
            low = max(-part, more - (edits - part))
            high = min(part, more + (edits - part))
            out += [(more, part, shift) for shift in range(low, high + 1)]
    return out


def _codes(side: int) -> str:
    """SQL array of the codes of the index (side 0) or the probes (1), for every number of edits, with the lengths of
    the lines that have them: the shorter line of a pair sets its edits, and the longer may be over the next step.

    Index keys have no length difference and no shift; such probes are the index keys themselves."""
    out = []
    for edits in range(1, TAU + 1):
        index = [(0, part, 0) for part in range(edits + 1)]
        codes = index if side == 0 else [place for place in _places(edits) if place not in index]
        most = (edits + 1) * PER_EDIT - 1 + edits if edits < TAU else (1 << 31) - 1
        out += [f"struct({edits * PER_EDIT} as least, {most} as most, {edits + 1} as parts, {more} as more, {part} as part, {shift} as shift)" for more, part, shift in codes]
    return f"array({', '.join(out)})"


def keyed(rows: DataFrame, side: int) -> DataFrame:
    """u, line, n (its length) -> key, u, size (0) of the index (side 0) or the probes (1).

    The last segments take what does not divide. One row a code first: an expression for each code would make
    a method too long to be compiled."""
    each = rows.select("u", "line", "n", F.explode(F.expr(f"filter({_codes(side)}, c -> n between c.least and c.most)")).alias("c"))
    length, start = "(n - c.more)", "(n - c.more) % c.parts - (c.parts - c.part)"
    place = f"cast({length} div c.parts as int) * c.part + greatest({start}, 0) + c.shift + 1"
    size = f"cast({length} div c.parts as int) + if({start} >= 0, 1, 0)"
    return each.select(F.expr(f"xxhash64(c.parts, c.part, {length}, substring(line, {place}, {size}))").alias("key"), "u", F.lit(0).alias("size"))


def _let(value: Column, body) -> Column:
    """The body of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _common(x: Column, y: Column, most: Column) -> Column:
    """Length of a common prefix of two strings, at most ``most``: the longest, if it is under 2**20."""
    step = lambda k, s: F.when((k + s <= most) & (x.substr(k + 1, s) == y.substr(k + 1, s)), k + s).otherwise(k)
    return F.aggregate(F.array(*[F.lit(1 << e) for e in range(19, -1, -1)]), F.lit(0), step)


def _differing(a: Column, b: Column) -> Column:
    """Struct (x, y) of the strings without their common ends, but for MARGIN characters of each."""
    least = lambda p: F.least(F.length(p["x"]), F.length(p["y"]))
    far = F.lit(1 << 30)

    def behind(p: Column, k: Column) -> Column:
        k = F.greatest(k - MARGIN, F.lit(0))
        return F.struct(F.reverse(p["x"].substr(k + 1, far)).alias("x"), F.reverse(p["y"].substr(k + 1, far)).alias("y"))

    cut = lambda p: _let(_common(p["x"], p["y"], least(p)), lambda k: behind(p, k))
    # the second pass keeps MARGIN characters of the common prefix that the first one left
    cut_back = lambda p: _let(_common(p["x"], p["y"], least(p) - 2 * MARGIN), lambda k: behind(p, k))
    return _let(_let(F.struct(a.alias("x"), b.alias("y")), cut), cut_back)


def distance(a: Column, b: Column, tau: int = TAU) -> Column:
    """Edit distance of two strings whose lengths differ by at most tau (both longer than that), or tau + 1.

    Common ends are cut off first, and columns are passed over once the score cannot come back to tau.
    Bit k of a column's words stands for row ``column + k - tau`` of the first string; the band moves down a
    row with each column. The score follows the lowest row of the band, then the last row."""
    width = 2 * tau + 1
    mask, low = (1 << width) - 1, 1 << (width - 1)
    chars = lambda x: F.regexp_extract_all(x, F.lit("(?s)."), F.lit(0))
    longer, shorter = F.when(F.length(a) >= F.length(b), a).otherwise(b), F.when(F.length(a) >= F.length(b), b).otherwise(a)
    both = _let(_differing(longer, shorter), lambda p: F.struct(chars(p["x"]).alias("x"), chars(p["y"]).alias("y")))

    def score(t: Column) -> Column:
        x, y = t["x"], t["y"]
        zero = F.struct(F.lit(0).alias("i"), F.lit((mask << tau) & mask).alias("vp"), F.lit(0).alias("vn"), F.lit(tau).alias("d"))

        def column(acc: Column, ch: Column) -> Column:
            i, vp, vn = acc["i"], acc["vp"], acc["vn"]
            equal = F.lit(0)
            for k in range(width):
                at = F.get(x, i + (k - tau))
                equal = equal.bitwiseOR(F.when(at == ch, 1 << k).otherwise(0))
            d0 = (equal.bitwiseAND(vp) + vp).bitwiseAND(F.lit(mask)).bitwiseXOR(vp).bitwiseOR(equal).bitwiseOR(vn)
            step = F.struct(acc.alias("acc"), d0.alias("d0"))
            return F.when(acc["d"] > 3 * tau, acc).otherwise(_let(step, follow))

        def follow(w: Column) -> Column:
            acc, d0 = w["acc"], w["d0"]
            i, vp, vn = acc["i"], acc["vp"], acc["vn"]
            hp = vn.bitwiseOR(F.lit(mask).bitwiseXOR(d0.bitwiseOR(vp)))
            hn = d0.bitwiseAND(vp)
            down = F.shiftright(d0, 1)
            over = i - (F.size(x) - tau)  # columns since the band met the last row
            bit = F.when(over >= 0, F.call_function("shiftright", F.lit(low >> 1), over.cast("int"))).otherwise(low)
            on = lambda v: F.when(v.bitwiseAND(bit) != 0, 1).otherwise(0)
            d = acc["d"] + F.when(over < 0, 1 - on(d0)).otherwise(on(hp) - on(hn))
            return F.struct((i + 1).alias("i"), hn.bitwiseOR(F.lit(mask).bitwiseXOR(down.bitwiseOR(hp).bitwiseAND(F.lit(mask)))).alias("vp"),
                            down.bitwiseAND(hp).alias("vn"), d.alias("d"))

        return F.least(F.aggregate(y, zero, column)["d"], F.lit(tau + 1))

    return _let(both, score)


def lines_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_hash, line_no (from 0), line of the lines that are judged."""
    text = text_of(text_col).cast("string")
    lines = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.posexplode(F.split(text, "\n", -1)).alias("line_no", "line"))
    return lines.where((F.length("line") >= LEAST_EXACT) & F.col("line").rlike(r"[^ \t-\r]"))


def edits_of(x: Column, y: Column) -> Column:
    """Edits by which two linked lines may differ."""
    return F.least(F.lit(TAU), (F.least(F.length(x), F.length(y)) / PER_EDIT).cast("int"))


def _verified(pairs: DataFrame, units: DataFrame) -> DataFrame:
    """Those of the pairs (a, b, spare) within their edits. The lines are looked up once, then meet their pairs."""
    pairs = written(pairs, "line-pairs")
    ids = pairs.select(F.col("a").alias("u")).union(pairs.select("b")).distinct()
    some = written(units.select("u", "line").join(ids, "u", "left_semi"), "line-texts")
    one, two = some.select(F.col("u").alias("a"), F.col("line").alias("x")), some.select(F.col("u").alias("b"), F.col("line").alias("y"))
    x, y = F.col("x"), F.col("y")
    met = pairs.join(one, "a").join(two, "b").where(F.abs(F.length(x) - F.length(y)) <= edits_of(x, y))
    return met.where(distance(x, y) <= edits_of(x, y)).select("a", "b", "spare")


def _pairs(index: DataFrame, probe: DataFrame) -> DataFrame:
    """a < b of an index line and a probe line of one key whose differences from the pivot allow it; spare if, wherever
    they meet, both are linked to the pivot (``d``, ``w`` and ``m``; there are none at first). By differences, a pair meets at the
    first key that it has in common, once for a pivot."""
    again = "d" in index.columns
    mark = F.col("m") if again else F.lit(False)
    own = [F.col(c) if again else F.lit(0) for c in ("d", "w", "keys")]
    index = index.select("key", F.col("u").alias("i"), mark.alias("mi"), F.col("size").alias("si"), own[0].alias("di"), own[1].alias("wi"), own[2].alias("ki"))
    probe = probe.select("key", F.col("u").alias("p"), mark.alias("mp"), F.col("size").alias("sp"), own[0].alias("dp"), own[1].alias("wp"), own[2].alias("kp"))
    met = index.join(probe, "key").where(f"i <> p and si <= sp and sp - si <= {SPREAD}")
    if again:
        met = met.where(f"array_intersect(ki, kp)[0] = key and si + sp - 2 * size(array_intersect(di, dp)) <= {SPREAD}")
        met = met.where(f"size(wi) + size(wp) - 2 * size(array_intersect(wi, wp)) <= {GRAM_SPREAD}")
    return _once(met.select(F.least("i", "p").alias("a"), F.greatest("i", "p").alias("b"), F.expr("mi and mp").alias("spare")))


def _once(pairs: DataFrame) -> DataFrame:
    """Each pair once, spare if it is so everywhere."""
    return pairs.groupBy("a", "b").agg(F.bool_and("spare").alias("spare"))


def _chars(line: Column) -> Column:
    return F.regexp_extract_all(line, F.lit("(?s)."), F.lit(0))


def _numbered(hashes: Column) -> Column:
    """Distinct hashes of an array; the second, third and further occurrences of one are their own."""
    # sorted, so equal ones stand together
    before = lambda g, i, k: F.get(g, i - k)
    number = lambda g, x, i: F.when(before(g, i, 3).eqNullSafe(x), 3).when(before(g, i, 2).eqNullSafe(x), 2).when(before(g, i, 1).eqNullSafe(x), 1).otherwise(0)
    return _let(F.array_sort(hashes), lambda g: F.array_distinct(F.transform(g, lambda x, i: F.xxhash64(x, number(g, x, i)))))


def grams(line: Column) -> Column:
    """Array of the line's grams, as numbered hashes."""
    return _numbered(_let(_chars(line), lambda c: F.transform(F.slice(c, 1, F.size(c) - (GRAM - 1)), lambda _, i: F.xxhash64(*[F.get(c, i + k) for k in range(GRAM)]))))


def pieces(line: Column) -> Column:
    """Array of the line's pieces, as numbered hashes."""
    cut = F.transform(_chars(line), lambda c: F.when(F.ascii(c) % CUT == 0, F.concat(c, F.lit("\n"))).otherwise(c))
    return _numbered(F.transform(F.split(F.array_join(cut, ""), "\n", -1), lambda x: F.xxhash64(x)))


def _differences(members: DataFrame, units: DataFrame) -> DataFrame:
    """pivot, u, m -> pivot, u, m, d, w, size, first: the pieces (d; the first of them, the pivot's own last) and the
    grams (w) in which the line and the pivot differ."""
    some = members.select("u").union(members.select("pivot")).distinct()
    bags = written(units.join(some, "u", "left_semi").select("u", pieces(F.col("line")).alias("g"), grams(F.col("line")).alias("s")), "line-pieces")
    pivots = bags.select(F.col("u").alias("pivot"), F.col("g").alias("h"), F.col("s").alias("t"))
    rows = members.join(bags, "u").join(pivots, "pivot")
    differing = lambda x, y: F.concat(F.array_except(x, y), F.array_except(y, x))
    rows = rows.select("pivot", "u", "m", differing("g", "h").alias("d"), differing("s", "t").alias("w"))
    rows = written(rows, "line-differences")
    # what two of the nearest lines (unlinked, if there are any) have in common is the pivot's own difference from its family
    near = lambda odd: F.min(F.when(F.pmod("u", F.lit(2)) == odd, F.struct("m", F.size("d").alias("size"), "u", "d")))["d"]
    # written, so that the join can split a pivot of many lines
    often = written(rows.groupBy("pivot").agg(F.array_intersect(near(0), near(1)).alias("often")), "pivot-own")
    d, often_ = F.col("d"), F.coalesce("often", F.expr("cast(array() as array<bigint>)"))
    ordered = F.concat(F.array_sort(F.array_except(d, often_)), F.array_sort(F.array_intersect(d, often_)))
    return rows.join(often, "pivot", "left").select("pivot", "u", "m", "d", "w", F.size("d").alias("size"), F.slice(ordered, 1, SPREAD + 1).alias("first"))


def _rekeyed(rows: DataFrame, side: int) -> DataFrame:
    """key, u, m, size, d, w, keys (all of the line's) of the index or the probes by differences. Lines within TAU, the index
    line's difference the smaller one, share a piece of these, or their differences have SPREAD pieces or less together."""
    key = lambda e: F.xxhash64("pivot", F.lit(0), e)
    small = lambda t: F.xxhash64("pivot", F.lit(1), t.cast("int"))
    none = F.expr("cast(array() as array<bigint>)")
    if side == 0:
        keys = F.concat(F.transform(F.slice("first", 1, SPREAD // 2 + 1), key), F.when(F.col("size") <= SPREAD // 2, F.array(small(F.col("size")))).otherwise(none))
    else:
        sizes = F.when(F.col("size") <= SPREAD, F.transform(F.sequence(F.lit(0), F.least(F.col("size"), SPREAD - F.col("size"))), small))
        keys = F.concat(F.transform("first", key), F.coalesce(sizes, none))
    return rows.select("u", "m", "size", "d", "w", keys.alias("keys")).select(F.explode("keys").alias("key"), "u", "m", "size", "d", "w", "keys")


def _met(index: DataFrame, probe: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Index and probe lines of the keys that two lines or more have, one of them in the index."""
    both = index.select("key", "u").union(probe.select("key", "u")).groupBy("key").agg(F.min("u").alias("a"), F.max("u").alias("b"))
    met = both.where("a <> b").select("key")
    index = written(index.join(met, "key", "left_semi"), "line-index")
    return index, written(probe.join(index.select("key"), "key", "left_semi"), "line-probes")


def _sieved(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows whose u a bitmap of the ids lets through: all of theirs, and a few others. It has 2**(BITS - 6) rows at
    most, so the rows need not be shuffled."""
    word, bit = f"shiftrightunsigned(u, {64 - BITS + 6})", f"cast(shiftrightunsigned(u, {64 - BITS}) & 63 as int)"
    words = ids.select(F.expr(word).alias("word"), F.expr(f"shiftleft(1L, {bit})").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    return rows.join(F.broadcast(words), F.expr(f"word = {word} and getbit(bits, {bit}) = 1"), "left_semi")


def links(units: DataFrame) -> DataFrame:
    """a, b, spare: every pair of linked lines; those that are not spare connect every class. ``units``: u, line, n
    (its length)."""
    near = units.where(F.col("n") >= PER_EDIT)
    index = written(keyed(near, 0), "line-index")
    index, probe = _met(index, written(keyed(near, 1).join(index.select("key"), "key", "left_semi"), "line-probes"))
    # most lines have no key in common with another: their texts are left behind here, not at every look-up
    some = written(index.select("u").union(probe.select("u")).distinct(), "lines-met")
    near = written(_sieved(near, some).join(some, "u", "left_semi"), "line-near")
    probe = probe.union(index)
    out = None
    for level in range(LEVELS):
        hot = None
        if level < LEVELS - 1:
            hot = written(index.groupBy("key").agg(F.count("*").alias("c")).where(F.col("c") > HOT ** (level + 1)), "hot-keys")
            hot = hot if hot.limit(1).count() else None
        if hot is None:
            found = written(_verified(_pairs(index, probe), near), "line-links")
            return found if out is None else out.union(found)
        cold = hot.select("key")
        found = _verified(_pairs(index.join(cold, "key", "left_anti"), probe.join(cold, "key", "left_anti")), near)
        found = written(found, "line-links")
        out = found if out is None else out.union(found)
        # of a hot key's lines, that in the most and largest of them is the pivot, and all meet it
        owned = index.select("key", "u").union(probe.select("key", "u")).join(hot, "key").distinct()
        owned = written(owned, "hot-lines")
        score = owned.groupBy("u").agg(F.sum("c").alias("score"))
        pivots = owned.join(score, "u").groupBy("key").agg(F.max(F.struct("score", "u"))["u"].alias("pivot"))
        members = written(owned.join(pivots, "key").where("u <> pivot").select("pivot", "u").distinct(), "hot-members")
        star = members.select(F.least("u", "pivot").alias("a"), F.greatest("u", "pivot").alias("b"), F.lit(False).alias("spare")).distinct()
        close = written(_verified(star, near), "hot-links")
        out = out.union(close)
        linked = close.select("a", "b").union(close.select("b", "a")).select(F.col("a").alias("pivot"), F.col("b").alias("u"), F.lit(True).alias("linked"))
        marked = members.join(linked, ["pivot", "u"], "left").select("pivot", "u", F.coalesce("linked", F.lit(False)).alias("m"))
        rows = written(_differences(marked, near), "line-order")
        index, probe = written(_rekeyed(rows, 0), "line-index"), written(_rekeyed(rows, 1), "line-probes")
    raise AssertionError("the last level has no hot keys")


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_hash, line_no, class_doc, class_text, class_line, n_links, kept of every judged line; n_links counts
    the verified links of the line's text to other texts."""
    lines = lines_of(docs, id_col, text_col)
    place = F.struct("doc_id", "text_hash", "line_no")
    units = written(lines.groupBy(F.xxhash64("line").alias("u")).agg(F.min(place).alias("first"), F.first("line").alias("line"))
                    .withColumn("n", F.length("line")), "lines")
    found = written(_once(links(units.select("u", "line", "n"))), "line-links")
    roots = components(found.where("not spare"))
    degree = found.select(F.col("a").alias("u")).union(found.select("b")).groupBy("u").agg(F.count("*").alias("n_links"))
    linked = written(units.select("u", "first").join(roots.withColumnRenamed("node", "u"), "u").join(degree, "u"), "line-roots")
    best = linked.groupBy("root").agg(F.min("first").alias("best"))
    moved = linked.join(best, "root").select("u", "best", "n_links")
    chosen = (units.select("u", "first").join(moved, "u", "left")
              .select("u", F.coalesce("best", "first").alias("c"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links")))
    rows = lines.select("doc_id", "text_hash", "line_no", F.xxhash64("line").alias("u"))
    out = rows.join(chosen, "u").select("doc_id", "text_hash", "line_no", F.col("c.doc_id").alias("class_doc"), F.col("c.text_hash").alias("class_text"), F.col("c.line_no").alias("class_line"), "n_links")
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("class_doc")) & (F.col("text_hash") == F.col("class_text")) & (F.col("line_no") == F.col("class_line")))


def without_repeats(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without the lines that are not kept; every document stays, if need be with an empty text."""
    gone = found.where("not kept").groupBy("doc_id", "text_hash").agg(F.collect_set("line_no").alias("__gone"))
    gone = gone.select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), "__gone")
    text = text_of(text_col).cast("string")
    lines = F.split(text, "\n", -1)
    left = _let(lines, lambda own: F.transform(F.array_except(F.sequence(F.lit(0), F.size(own) - 1), F.col("__gone")), lambda k: F.get(own, k)))
    both = docs.join(gone, docs[id_col].cast("long").eqNullSafe(F.col("__id")) & (F.xxhash64(text) == F.col("__hash")), "left")
    return both.withColumn(text_col, F.when(F.col("__gone").isNull(), F.col(text_col)).otherwise(F.array_join(left, "\n"))).drop("__gone", "__id", "__hash")
