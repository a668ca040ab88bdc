"""The edit join against brute force over small tables, with hot keys forced."""

import random

import pytest

from fundscope.llm import line_join as lj


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_distance(spark):
    rng = random.Random(1)
    rows = []
    for _ in range(300):
        a = "".join(rng.choice("abé😀") for _ in range(rng.randrange(6, 14)))
        b = list(a)
        for _ in range(rng.randrange(5)):
            k = rng.randrange(len(b))
            b[k : k + rng.randrange(2)] = rng.choice(["", "a", "b", "x"])
        b = "".join(b)
        if abs(len(a) - len(b)) <= 2 < min(len(a), len(b)):
            rows.append((a, b))
    df = spark.createDataFrame(rows, "a string, b string")
    for r in df.select("a", "b", lj.distance(df["a"], df["b"]).alias("d")).collect():
        assert r["d"] == min(edit(r["a"], r["b"]), 3), r


@pytest.mark.parametrize("hot", [8, 2])
def test_classes(spark, monkeypatch, hot):
    monkeypatch.setattr(lj, "HOT", hot)
    rng = random.Random(2)
    base = ["".join(rng.choice("abcde ") for _ in range(n)) for n in (40, 41, 45, 60, 60, 80, 22)]
    base += [base[3][:20] + "".join(rng.choice("vwxyz") for _ in range(40)) for _ in range(12)]
    lines = []
    for b in base:
        for _ in range(6):
            c = list(b)
            for _ in range(rng.randrange(4)):
                k = rng.randrange(len(c))
                c[k : k + rng.randrange(2)] = rng.choice(["", "q", "r"])
            lines.append("".join(c))
    rng.shuffle(lines)
    docs = [(i, "\n".join(lines[3 * i : 3 * i + 3] + ["short"]), "x") for i in range(len(lines) // 3)] + [(900, None, "n"), (901, "", "e"), (None, lines[0], "i")]
    df = spark.createDataFrame(docs, "doc_id long, text string, line string").repartition(3)
    got = {(r["doc_id"], r["line_no"]): ((r["class_doc"], r["class_line"]), r["kept"]) for r in lj.classes(df).collect()}
    places = [((d is not None, d or 0, k), (d, k), line) for d, t, _ in docs for k, line in enumerate((t or "").split("\n")) if len(line) >= lj.LEAST_EXACT]
    places.sort(key=lambda p: p[0])
    parent = list(range(len(places)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (_, _, a) in enumerate(places):
        for j in range(i):
            b = places[j][2]
            if a == b or min(len(a), len(b)) >= lj.LEAST_NEAR and abs(len(a) - len(b)) <= 2 and edit(a, b) <= lj.TAU:
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    expected = {p: (places[find(i)][1], find(i) == i) for i, (_, p, _) in enumerate(places)}
    assert got == expected
    out = {r["doc_id"]: r for r in lj.without_repeats(df, lj.classes(df)).collect()}
    assert len(out) == len(docs) and out[900]["text"] is None and out[901]["text"] == ""
    for d, t, x in docs:
        keep = [line for k, line in enumerate((t or "").split("\n")) if (d, k) not in expected or expected[(d, k)][1]]
        assert (out[d]["text"] or "") == "\n".join(keep) and out[d]["line"] == x
    assert lj.classes(df.limit(0)).count() == 0


def test_short_lines(spark):
    far = "".join("abcdefghijklmnopqrstuvwxyz"[k * 7 % 26] for k in range(45))
    texts = ["Les.", "Wh the.", "x", " \t", "", "Wh thx.", "ten chars!", "ten chXrs!", "ten cXXrs!", "nineteen characters", "nineteen character", "nineteen chAractersX",
             "a line of thirty characters ok", "a line Xf thirty characterY ok", "A lineXYf thirty characterY ok!", far, far[:-2], "Les.", "Wh the.", "x", " \t", ""]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: (r["class_doc"], r["n_links"]) for r in lj.classes(df).collect()}
    places = [k for k, t in enumerate(texts) if t.strip()]

    def near(a, b):
        return a != b and edit(a, b) <= min(2, min(len(a), len(b)) // 10)

    links = {k: len({texts[j] for j in places if near(texts[k], texts[j])}) for k in places}
    root = {k: k for k in places}
    for _ in places:
        root = {k: min(root[j] for j in places if texts[k] == texts[j] or near(texts[k], texts[j])) for k in places}
    assert got == {k: (root[k], links[k]) for k in places}
    assert got[17][0] == 0 and got[18][0] == 1 and got[7] == (6, 2) and got[13][0] == 12


def test_links_of_a_family(spark):
    rng = random.Random(4)
    base = "".join(rng.choice("abcdefghij ") for _ in range(60))
    one = [base[:k] + "Z" + base[k + 1 :] for k in range(2, 58, 4)]
    two = [a[:30] + "Y" + a[31:] for a in one[::2]] + [base[:k] + "XW" + base[k + 2 :] for k in (1, 25, 50)]
    apart = [base[:20] + "".join(rng.choice("klmnopqr") for _ in range(40)) for _ in range(20)]
    texts = [base, *one, *two, *apart]
    rng.shuffle(texts)
    got = {r["doc_id"]: r["n_links"] for r in lj.classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {k: sum(a != b and edit(a, b) <= 2 for b in set(texts)) for k, a in enumerate(texts)}
    assert max(got.values()) > 15


@pytest.mark.parametrize("doc", [None, 7])
def test_rows_of_one_id_lose_no_line_of_their_own(spark, doc):
    docs = spark.createDataFrame([(doc, "A line\nB line"), (doc, "C line\nA line"), (doc, "C line\nA line\n\nD line")], "doc_id long, text string")
    left = lj.without_repeats(docs, lj.classes(docs)).collect()
    lines = sorted(x for r in left for x in r["text"].split("\n") if x)
    assert lines == ["A line", "B line", "C line", "D line"]


def test_keys_by_differences(spark, monkeypatch):
    """Edits change three pieces each at most, a line has few keys, and a pair meets once for a pivot."""
    rng = random.Random(5)
    base = "".join(rng.choice("abcdefgh é\U0001f600") for _ in range(60))
    lines = [base]
    for n in [1, 2] * 15 + [9] * 30:
        c = list(base)
        for _ in range(n):
            k = rng.randrange(len(c))
            c[k : k + rng.randrange(2)] = rng.choice(["", "d", "h", " ", "z"])
        lines.append("".join(c))
    units = spark.createDataFrame(list(enumerate(dict.fromkeys(lines))), "u long, line string")
    bags = {r["u"]: (r["line"], set(r["p"])) for r in units.select("u", "line", lj.pieces(units["line"]).alias("p")).collect()}
    for u, (line, bag) in bags.items():
        assert len(bag ^ bags[0][1]) <= 3 * edit(line, base), (line, base)
    members = units.where("u > 0").selectExpr("0L as pivot", "u", "false as m")
    rows = lj._differences(members, units)
    index, probe = lj._rekeyed(rows, 0), lj._rekeyed(rows, 1)
    most = lambda side: max(r["count"] for r in side.groupBy("u").count().collect())
    assert most(index) <= lj.SPREAD // 2 + 2 <= 5 and most(probe) <= 2 * lj.SPREAD + 2 <= 14
    monkeypatch.setattr(lj, "_once", lambda pairs: pairs)
    met = [(r["a"], r["b"]) for r in lj._pairs(index, probe).where("a < b").collect()]
    found = set(met)
    near = {(a, b) for a in bags for b in bags if 0 < a < b and edit(bags[a][0], bags[b][0]) <= lj.TAU}
    assert near <= found and len(near) > 20
    # lines of equal sizes meet from both sides
    sizes = {r["u"]: r["size"] for r in rows.select("u", "size").collect()}
    assert all(met.count(p) == 1 + (sizes[p[0]] == sizes[p[1]]) for p in found)


def test_the_bitmap_lets_every_line_looked_for_through(spark):
    rows = spark.range(20000).selectExpr("xxhash64(id) as u", "id")
    got = [r["id"] for r in lj._sieved(rows, rows.where("id % 100 = 0").select("u")).collect()]
    assert set(range(0, 20000, 100)) <= set(got) and len(got) < 400
