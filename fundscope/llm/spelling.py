"""Spelling variants: words one edit apart, by PartEnum signatures of their letter multisets.

A word's letters with their occurrence numbers are the ones of a binary vector. One replaced letter moves the vector
by a Hamming distance of two, one inserted or deleted letter by one. Letters are dealt to PARTS partitions; vectors at
a distance of two agree outside some two partitions, those at one outside some one. So a vector's signatures are its
projections on all but two partitions, with its size (replacements), and on all but one, with the larger of the two
sizes (insertions). Vectors, not words, are joined by equal signatures: words of equal letters share one. Members of a
signature with more than HOT vectors are enumerated anew at the finest partition, a letter each: then a signature is
the vector less one letter, and no more vectors share it than there are letters. So no group is compared pair by pair
beyond HOT, and no pair is lost. A pair of vectors that passes names the letters exchanged; exchanging them at each
place in the words of one side gives the only words that can match, which are looked up among the words.

Words are maximal runs of RUN, A-Z lower-cased, of at least LEAST_LENGTH code points, with LEAST_COUNT occurrences.
A word's form is its near word of most occurrences (ties: least in code-point order) if it has FACTOR times the word's
at least. Null texts have no words, a null id counts as empty in the rule that drops letters. Empty tables give no
rows, repeated rows count as often as they occur, other columns are not read.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_of, written

RUN = "[A-Za-z\\u00C0-\\u00FF]+"
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAST_LENGTH, LEAST_COUNT, FACTOR = 5, 3, 2
PARTS, HOT = 8, 256
#: Each step from word to form at least doubles a 64-bit count, so this many doublings of the path reach its end.
JUMPS = 6


def runs(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """A row per run of LEAST_LENGTH code points or more, A-Z lower-cased, with the row's other columns."""
    found = docs.withColumn("__run", F.explode(F.regexp_extract_all(text_of(text_col), F.lit(RUN), F.lit(0)))).drop(text_col)
    return found.where(F.length("__run") >= LEAST_LENGTH).withColumn("__run", F.translate("__run", CAPITALS, SMALL))


def with_slips(found: DataFrame, id_col: str = "doc_id", every: int = 97) -> DataFrame:
    """Drops a letter from the runs whose hash, with the document's id, ``every`` divides."""
    h = F.crc32(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), F.col("__run")).cast("binary"))
    at = (F.col("__h") % F.length("__run")).cast("int")
    cut = F.concat(F.substring("__run", F.lit(1), at), F.substring("__run", at + 2, F.length("__run")))
    return found.withColumn("__h", h).withColumn("__run", F.when(F.col("__h") % every == 0, cut).otherwise(F.col("__run"))).drop("__h")


def vocabulary(found: DataFrame) -> DataFrame:
    """word, n of the runs that are long and frequent enough."""
    words = found.select(F.col("__run").alias("word")).where(F.length("word") >= LEAST_LENGTH)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_COUNT)


def letters(word: Column) -> Column:
    return F.filter(F.split(word, ""), lambda c: c != "")


def _part(letter: Column) -> Column:
    return F.ascii(letter) % PARTS


def _labelled(text: Column) -> Column:
    """The ones of a binary vector: letters with their occurrence numbers."""
    own = letters(text)
    return F.transform(own, lambda c, i: F.concat(c, (i - F.array_position(own, c)).cast("string")))


def _signatures(vectors: DataFrame) -> DataFrame:
    """key (kind, partitions left out, size, projection), larger (is it the larger side of an insertion), vector, and
    rest (its letters in the partitions left out)."""
    parts = F.transform(F.sequence(F.lit(0), F.lit(PARTS - 1)), lambda p: F.array_join(F.filter("__letters", lambda c: _part(c) == p), ""))
    base = vectors.withColumn("__letters", letters(F.col("vector"))).withColumn("__parts", parts).withColumn("__size", F.length("vector"))

    def row(kind: str, size: Column, out: tuple, larger: bool) -> Column:
        kept = F.concat_ws("|", *[F.col("__parts")[p] for p in range(PARTS) if p not in out])
        key = F.concat_ws(" ", F.lit(kind + "".join(map(str, out))), size.cast("string"), kept)
        return F.struct(key.alias("key"), F.lit(larger).alias("larger"), F.concat(*[F.col("__parts")[p] for p in out]).alias("rest"))

    size = F.col("__size")
    made = [row("r", size, out, False) for out in combinations(range(PARTS), 2)]
    made += [row("i", size, (p,), True) for p in range(PARTS)] + [row("i", size + 1, (p,), False) for p in range(PARTS)]
    return base.select("vector", F.explode(F.array(*made)).alias("s")).select("s.key", "s.larger", "vector", "s.rest")


def _finest(members: DataFrame) -> DataFrame:
    """Members of hot signatures by the finest partition: the vector less each of its letters; and, for insertions,
    the shorter vector itself."""
    own = members.select("vector", F.substring("key", 1, 1).alias("kind"), "larger").distinct().withColumn("__letters", letters(F.col("vector")))
    less = F.transform(F.array_distinct("__letters"), lambda c: F.struct(F.concat(
        F.substring("vector", F.lit(1), F.array_position("__letters", c) - 1), F.substring("vector", F.array_position("__letters", c) + 1, F.length("vector"))).alias("key"), c.alias("rest")))
    whole = F.array(F.struct(F.col("vector").alias("key"), F.lit("").alias("rest")))
    made = own.select("kind", "larger", "vector", F.explode(F.when((F.col("kind") == "i") & ~F.col("larger"), whole).otherwise(less)).alias("s"))
    return made.select(F.concat_ws(" ", F.concat("kind", F.lit("f")), "s.key").alias("key"), "larger", "vector", "s.rest")


def vector_pairs(vectors: DataFrame, hot: int = HOT) -> DataFrame:
    """long, short (vectors), gone, come (letters): long with one ``gone`` replaced by ``come`` ('' for a deletion) is
    short. Every pair of vectors one exchange or one insertion apart, once.

    Two vectors of one signature differ in the letters left out alone, so these few decide the distance.
    """
    signatures = written(_signatures(vectors), "spelling-signatures")
    many = written(signatures.groupBy("key").agg(F.count("*").alias("__n")).where(F.col("__n") > hot).select("key"), "spelling-hot")
    finest = _finest(signatures.join(many, "key", "left_semi"))
    coarse = signatures.join(many, "key", "left_anti")
    pairs = []
    for rows in (coarse, finest):
        a = rows.select("key", F.col("larger").alias("la"), F.col("vector").alias("long"), F.col("rest").alias("rest_a"))
        b = rows.select("key", F.col("larger").alias("lb"), F.col("vector").alias("short"), F.col("rest").alias("rest_b"))
        replaced = F.col("key").startswith("r")
        met = a.join(b, "key").where((replaced & (F.col("long") < F.col("short"))) | (~replaced & F.col("la") & ~F.col("lb")))
        # one letter each, or one and none, needs no labels
        plain = (F.length("rest_a") == 1) & (F.length("rest_b") <= 1)
        met = met.withColumns({"__a": F.when(~plain, _labelled(F.col("rest_a"))), "__b": F.when(~plain, _labelled(F.col("rest_b")))})
        met = met.withColumns({"__a": F.when(plain, F.array("rest_a")).otherwise(F.array_except("__a", "__b")),
                               "__b": F.when(plain, F.filter(F.array("rest_b"), lambda c: c != "")).otherwise(F.array_except("__b", "__a"))})
        met = met.where((F.size("__a") == 1) & (F.size("__b") == F.when(replaced, 1).otherwise(0)))
        gone, come = F.substring(F.col("__a")[0], 1, 1), F.coalesce(F.substring(F.get("__b", F.lit(0)), 1, 1), F.lit(""))
        pairs.append(met.select("long", "short", gone.alias("gone"), come.alias("come")))
    return pairs[0].union(pairs[1]).distinct()


def links(words: DataFrame, hot: int = HOT) -> DataFrame:
    """a, b, na, nb: every two words one edit apart, once; words (word, n)."""
    own = written(words.withColumn("vector", F.array_join(F.array_sort(letters(F.col("word"))), "")), "spelling-words")
    pairs = vector_pairs(own.select("vector").distinct(), hot)
    sides = own.select("word", "n", F.col("vector").alias("long")).join(pairs, "long")
    # in a run of equal letters all deletions give one word: the first stands for them
    places = F.filter(F.sequence(F.lit(1), F.length("word")), lambda i: (F.substring("word", i, F.lit(1)) == F.col("gone")) & ((F.col("come") != "") | (i == 1) | (F.substring("word", F.greatest(i - 1, F.lit(1)), F.lit(1)) != F.col("gone"))))
    made = sides.select(F.col("word").alias("a"), F.col("n").alias("na"), "come", F.explode(places).alias("at"))
    made = made.select("a", "na", F.concat(F.substring("a", F.lit(1), F.col("at") - 1), F.col("come"), F.substring("a", F.col("at") + 1, F.length("a"))).alias("b"))
    return made.join(own.select(F.col("word").alias("b"), F.col("n").alias("nb")), "b").select("a", "b", "na", "nb")


def roots(forms: DataFrame) -> DataFrame:
    """word, root: forms (word, form) followed to the last, by doubling the path JUMPS times at most."""
    at = forms.select("word", F.coalesce("form", "word").alias("root"))
    for _ in range(JUMPS):
        at = written(at, "spelling-roots")
        above = at.select(F.col("word").alias("root"), F.col("root").alias("__next"))
        new = at.join(above, "root").select("word", F.col("__next").alias("root"), (F.col("__next") != F.col("root")).alias("__moved"))
        new = written(new, "spelling-roots")
        at = new.select("word", "root")
        if not new.where("__moved").limit(1).count():
            break
    return at


def group(words: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n of words (word, n)."""
    words = written(words, "spelling-vocabulary")
    found = written(links(words), "spelling-links")
    both = found.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("nb").alias("near_n")).union(found.select("b", "a", "na"))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    judged = words.join(best, "word", "left").withColumn("form_n", F.when(-F.col("best.less") >= FACTOR * F.col("n"), -F.col("best.less")))
    judged = judged.select("word", F.when(F.col("form_n").isNotNull(), F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")
    judged = written(judged, "spelling-forms")
    return judged.join(roots(judged.select("word", "form")), "word").select("word", "form", "root", "n", "n_near", "form_n")


_CRC_TABLE = "list_transform(range(256), lambda b: list_reduce([b::bigint, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END))"
#: Runs of under LEAST_LENGTH code points are left out before the hash: a deletion only shortens them.
ORACLE_SQL = f"""
WITH RECURSIVE crc AS (SELECT {_CRC_TABLE} AS t),
tok AS (SELECT doc_id, translate(w, '{CAPITALS}', '{SMALL}') AS w FROM (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]+')) AS w FROM documents) WHERE length(w) >= {LEAST_LENGTH}),
per AS (SELECT doc_id, w, count(*) AS k FROM tok GROUP BY doc_id, w),
enc AS (SELECT doc_id, w, k, encode(coalesce(doc_id::varchar, '') || ':' || w) AS b FROM per),
hx AS (SELECT w, k, list_transform(range(octet_length(b)), lambda i: (('0x' || substr(hex(b), (2 * i + 1)::int, 2))::int)::bigint) AS bytes FROM enc),
hs AS (SELECT w, k, xor(4294967295, list_reduce(list_concat([4294967295], bytes), lambda c, x: xor(c // 256, t[xor(c % 256, x) + 1]))) AS h FROM hx, crc),
v AS (SELECT CASE WHEN h % 97 = 0 THEN substr(w, 1, (h % length(w))::int) || substr(w, (h % length(w))::int + 2) ELSE w END AS word, k FROM hs),
words AS (SELECT word, sum(k)::bigint AS n FROM v WHERE length(word) >= {LEAST_LENGTH} GROUP BY word HAVING sum(k) >= {LEAST_COUNT}),
cut AS (SELECT word, n, i, substr(word, 1, i - 1) AS l, substr(word, i + 1) AS r FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS (
  SELECT DISTINCT word, other, other_n FROM (
    SELECT x.word, y.word AS other, y.n AS other_n FROM cut AS x JOIN cut AS y ON x.i = y.i AND x.l = y.l AND x.r = y.r AND x.word <> y.word
    UNION ALL SELECT x.word, y.word, y.n FROM cut AS x JOIN words AS y ON y.word = x.l || x.r
    UNION ALL SELECT y.word, x.word, x.n FROM cut AS x JOIN words AS y ON y.word = x.l || x.r)),
best AS (SELECT word, count(*) AS n_near, max(other_n) AS most FROM near GROUP BY word),
pick AS (SELECT near.word, min(other) AS other FROM near JOIN best ON best.word = near.word AND other_n = most GROUP BY near.word),
forms AS (SELECT words.word, words.n, coalesce(n_near, 0) AS n_near, CASE WHEN most >= {FACTOR} * n THEN other END AS form, CASE WHEN most >= {FACTOR} * n THEN most END AS form_n
  FROM words LEFT JOIN best USING (word) LEFT JOIN pick USING (word)),
walk AS (
  SELECT word, word AS at, form AS above FROM forms
  UNION ALL SELECT walk.word, forms.word, forms.form FROM walk JOIN forms ON forms.word = walk.above)
SELECT forms.word, forms.form, walk.at AS root, forms.n, forms.n_near, forms.form_n FROM forms JOIN walk ON walk.word = forms.word AND walk.above IS NULL
"""
