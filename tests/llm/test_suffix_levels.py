"""Repeated byte strings against brute force over small tables, for several numbers of batches."""

import random

import pytest

from fundscope.llm import suffix_levels as sl


def brute(rows):
    seen, out = set(), {}
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        data = (text or "").encode()
        gone = [False] * len(data)
        for p in range(len(data) - sl.LENGTH + 1):
            w = data[p : p + sl.LENGTH]
            if w in seen:
                gone[p : p + sl.LENGTH] = [True] * sl.LENGTH
            seen.add(w)
        runs = sum(g and (not k or not gone[k - 1]) for k, g in enumerate(gone))
        out[doc] = (len(data), sum(gone), runs, bytes(b for b, g in zip(data, gone) if not g))
    return out


@pytest.mark.parametrize("batches,many", [(1, 400), (2, 400), (4, 2)])
def test_against_brute_force(spark, monkeypatch, batches, many):
    monkeypatch.setattr(sl, "MANY_SEGMENTS", many)
    rng = random.Random(9)
    noise = lambda n: "".join(rng.choice("abcdefgh é") for _ in range(n))
    shared = [noise(n) for n in (60, 99, 100, 101, 130, 180, 400)]
    rows = []
    for i in range(60):
        parts = [rng.choice(shared) if rng.random() < 0.6 else noise(rng.randrange(200)) for _ in range(rng.randrange(6))]
        rows.append((i * 7 % 61, "".join(parts), "x"))
    rows += [(100, "z" * 700, "y"), (101, "ab" * 200, "y"), (102, None, "n"), (103, "", "n"), (None, shared[-1], "n"), (104, rows[3][1], "c"), (105, "short", "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, doc string").repartition(4)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in sl.deduplicate(df, batches).collect()}
    assert got == brute([r[:2] for r in rows])


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert sl.deduplicate(df).count() == 0


def test_rows_of_one_id_keep_their_own_bytes(spark):
    rng = random.Random(2)
    u1, u2, u3, x = ("".join(rng.choice("abcdefgh ") for _ in range(500)) for _ in range(4))
    for doc in (None, 7):
        rows = [(doc, u1), (doc, x + u2), (doc, u3 + x), (doc, u1)]
        kept = [bytes(r["kept"]).decode() for r in sl.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
        assert kept.count(u1) == 2  # equal rows are one document
        assert sorted(kept) in (sorted([u1, u1, x + u2, u3]), sorted([u1, u1, u2, u3 + x]))


def test_levels_merge_by_default(spark, monkeypatch):
    rng = random.Random(4)
    shared = "".join(rng.choice("abcdefgh ") for _ in range(150))
    rows = [(i, "".join(rng.choice("abcdefgh ") for _ in range(150)) + (shared if i % 3 == 0 else "")) for i in range(40)]
    held, push = [], sl.SuffixLevels._push

    def pushed(self, batches, level):
        push(self, batches, level)
        held.append([n for n, _ in self.levels])

    monkeypatch.setattr(sl.SuffixLevels, "_push", pushed)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in sl.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)
    assert held == [[1], [2], [2, 1]]
