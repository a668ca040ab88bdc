"""Order MinHash near-duplicates against brute-force alignment: verdicts, classes, and recall at the stated similarity."""

import random
from collections import Counter

import numpy as np
import pytest

from fundscope.llm import order_minhash as om


def plain(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def text(rng, n):
    return [f"w{rng.randrange(5000)}" for _ in range(n)]


def changed(rng, words, n):
    """The words with n of them replaced, deleted or doubled at n different places."""
    out = list(words)
    for i in rng.sample(range(len(words)), n):
        out[i] = rng.choice([f"c{rng.randrange(10**6)}", "", f"{words[i]} i{rng.randrange(10**6)}"])
    return " ".join(x for x in out if x).split()


def classes(spark, docs):
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    return Counter((r["doc_id"], r["class_id"]) for r in om.classes(df).collect())


def test_edits():
    rng = random.Random(7)
    for _ in range(3000):
        k = rng.choice([2, 3, 20])
        a, b = ([rng.randrange(k) for _ in range(rng.randrange(14))] for _ in range(2))
        if rng.random() < 0.5:
            b = a[: rng.randrange(len(a) + 1)] + b[:2] + a[rng.randrange(len(a) + 1) :]
        d, band = plain(a, b), rng.randrange(9)
        x, y = np.array(a, "<u4"), np.array(b, "<u4")
        assert om.edits(x, y, band) == (d if d <= band else None), (a, b, band)
        assert om.apart(x, y) <= d


@pytest.mark.parametrize("small", [40, 2])
def test_classes_are_those_of_alignment(spark, monkeypatch, small):
    monkeypatch.setattr(om, "SMALL_GROUP", small)
    monkeypatch.setattr(om, "TILE", 8)
    rng = random.Random(6)
    docs = []
    passage = " ".join(text(rng, 60))
    for f in range(6):
        base = text(rng, rng.choice([30, 120, 200]))
        docs += [" ".join(changed(rng, base, rng.randrange(max(2, len(base) // 18)))) for _ in range(12)]
    docs += [" ".join(text(rng, 70)) + " " + passage + " " + " ".join(text(rng, 70)) for _ in range(30)]  # one passage, else unlike
    blocks = [text(rng, 50) for _ in range(4)]
    docs += [" ".join(sum(blocks, [])), " ".join(sum(blocks[::-1], []))]  # moved blocks: the same words, far in edits
    docs += [docs[0], "a b", "a b", "a  b", None, "", " \n", "a c"]
    rows = [(i * 7 % 311 if i != 5 else None, t) for i, t in enumerate(docs)]
    words = [(t or "").split() for t in docs]
    parent = list(range(len(docs)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            longer = max(len(words[i]), len(words[j]))
            band = int((1 - om.LEAST) * longer + 1e-9)
            if find(i) != find(j) and len(Counter(words[i]) & Counter(words[j])) * 2 >= min(1, longer) and plain(words[i], words[j]) <= band:
                parent[find(i)] = find(j)
    groups = {}
    for k, (d, _) in enumerate(rows):
        groups.setdefault(find(k), []).append(d)
    assert classes(spark, rows) == Counter((d, min(x for x in g if x is not None)) for g in groups.values() for d in g)
    assert classes(spark, []) == Counter()


@pytest.mark.parametrize("n,edits", [(100, 6), (200, 20), (20, 2), (60, 6), (1000, 100)])
def test_recall_at_the_stated_similarity(spark, n, edits):
    rng = random.Random(n)
    docs, want = [], 0
    for i in range(100):
        base = text(rng, n)
        other = changed(rng, base, edits)
        docs += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(other))]
        want += plain(base, other) <= int((1 - om.LEAST) * max(n, len(other)) + 1e-9) if n < 1000 else 1
    linked = sum(v for (d, c), v in classes(spark, docs).items() if d != c)
    assert want >= 50 and 0.9 * want <= linked <= 100, (want, linked)


def test_a_large_family(spark):
    """Near copies of one text, many more than SMALL_GROUP, of which some are beyond the threshold from each other."""
    rng = random.Random(1)
    base = text(rng, 150)
    docs = [(0, " ".join(base))] + [(i, " ".join(changed(rng, base, rng.randrange(1, 14)))) for i in range(1, 300)]
    assert classes(spark, docs) == Counter((i, 0) for i in range(300))


def test_bounds_are_below_the_distances():
    rng = random.Random(3)
    for _ in range(20):
        words = [rng.randrange(12) for _ in range(15)]
        texts = [np.array([rng.choice([w, w, w, rng.randrange(4000)]) for w in rng.sample(words, rng.randrange(8, 16))], "<u4") for _ in range(12)]
        lost, gained = om._against(np.array(words, "<u4"), texts)
        low = om.bound(lost, gained, lost, gained)
        for i, a in enumerate(texts):
            for j, b in enumerate(texts):
                assert low[i, j] <= om.apart(a, b) <= plain(a.tolist(), b.tolist())


def test_a_tile_returns_the_links_that_connect(spark):
    """Forty copies of one text, none linked to their star's pivot: every pair is nearly a link, 39 connect them."""
    rng = random.Random(9)
    base = text(rng, 100)
    words = {k: np.array([hash(w) & 0xFFFFFFFF for w in changed(rng, base, 2)], "<u4") for k in range(1, 41)}
    words[0] = np.arange(100, dtype="<u4")
    bank = spark.createDataFrame([(k, bytearray(w.tobytes())) for k, w in words.items()], "unit long, words binary")
    star = spark.createDataFrame([(0, k, False, 40) for k in range(1, 41)], "pivot long, unit long, linked boolean, n long")
    found = [(r["a"], r["b"]) for r in om.tiled(star, bank, om.LEAST).select("a", "b").collect()]
    assert len(found) == 39
    reached = {1}
    for _ in found:
        reached |= {x for pair in found if reached & set(pair) for x in pair}
    assert reached == set(range(1, 41))
