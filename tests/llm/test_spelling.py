"""Spelling variants against a plain comparison of all words."""

import random
import zlib

from pyspark.sql import functions as F

from fundscope.llm import spelling


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(words):
    """word, form, root, n, n_near, form_n of each word."""
    links = {w: [x for x in words if near(w, x)] for w in words}
    best = {w: min(((-words[x], x) for x in found), default=None) for w, found in links.items()}
    form = {w: b[1] if b and -b[0] >= 2 * words[w] else None for w, b in best.items()}

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {(w, form[w], root(w), n, len(links[w]), words[form[w]] if form[w] else None) for w, n in words.items()}


def sample(rng, n):
    words = {}
    for _ in range(n):
        w = "".join(rng.choice("abcdeéßaab") for _ in range(rng.randrange(5, 9)))
        words[w] = rng.choice([3, 3, 4, 6, 7, 12, 13, 24, 100])
        for _ in range(rng.randrange(3)):
            i = rng.randrange(len(w))
            w2 = rng.choice([w[:i] + w[i + 1 :], w[:i] + rng.choice("abxÿ÷") + w[i:], w[:i] + rng.choice("abxÿ÷") + w[i + 1 :]])
            words[w2] = rng.choice([3, 5, 6, 50])
    return words


def test_equals_all_pairs(spark):
    rng = random.Random(4)
    for hot in (256, 4, 0):
        words = sample(rng, 150) | {"aaaaa": 9, "aaaaaa": 20, "aaaaab": 9, "baaaaa": 40, "abcde": 5, "abced": 9, "abcdd": 10}
        rows = spark.createDataFrame(list(words.items()), "word string, n long")
        links = {(min(r["a"], r["b"]), max(r["a"], r["b"])) for r in spelling.links(rows, hot).collect()}
        assert links == {(a, b) for a in words for b in words if a < b and near(a, b)}
        if hot == 256:
            assert {tuple(r) for r in spelling.group(rows).collect()} == plain(words)


def test_long_chains_reach_their_end(spark):
    words = {"a" * (5 + i): 3 * 2**i for i in range(40)}
    found = {r["word"]: r["root"] for r in spelling.group(spark.createDataFrame(list(words.items()), "word string, n long")).collect()}
    assert set(found.values()) == {"a" * 44}


def test_words_slips_and_edges(spark):
    texts = [(1, "Straße ÉCOLE école d'accord accord-ACCORD"), (2, None), (3, ""), (None, "accord naïve×x"), (1, "accord"), (1, "accord"), (5, "x" * 50_000 + " Über")]
    docs = spark.createDataFrame(texts, "doc_id long, text string").withColumn("__run", F.lit(0)).withColumn("word", F.lit("w")).repartition(3)
    import re

    counts = {}
    for doc_id, text in texts:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 2 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] = counts.get(run, 0) + 1
    got = spelling.vocabulary(spelling.with_slips(spelling.runs(docs), every=2)).collect()
    assert {tuple(r) for r in got} == {(w, n) for w, n in counts.items() if len(w) >= 5 and n >= 3} and got
    assert spelling.group(spelling.vocabulary(spelling.runs(docs.limit(0)))).count() == 0
