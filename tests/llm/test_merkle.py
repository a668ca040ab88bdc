"""Manifest by butterfly exchange against a plain tree, proofs and tampering included."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from fundscope.llm import merkle


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(*values):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def grow(nodes, fanout):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i : i + fanout]) for i in range(0, len(levels[-1]), fanout)])
    return levels


def path(levels, i, fanout):
    out = []
    for nodes in levels[:-1]:
        start = i // fanout * fanout
        out.append((i - start, nodes[start:i] + nodes[i + 1 : start + fanout]))
        i //= fanout
    return out


def plain(rows, fanout):
    """rows of (lang, doc_id, leaf): (lang, doc_id, leaf, subroot, root, proof) of each."""
    trees = {}
    for lang, doc_id, leaf in rows:
        trees.setdefault(lang, []).append((doc_id is not None, doc_id or 0, leaf))
    names = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    own = {x: grow([leaf for _, _, leaf in sorted(trees[x])], fanout) for x in names}
    top = grow([own[x][-1][0] for x in names], fanout)
    out = []
    for k, x in enumerate(names):
        for i, (known, doc_id, leaf) in enumerate(sorted(trees[x])):
            out.append((x, doc_id if known else None, leaf, own[x][-1][0], top[-1][0], path(own[x], i, fanout) + path(top, k, fanout)))
    return out


@pytest.mark.parametrize("fanout,most", [(2, 2), (2, 4), (3, 3), (4, 16)])
def test_equals_a_plain_tree(spark, fanout, most):
    rows = []
    for lang, n in (("en", 45), ("de", 17), (None, 5), ("fr", 1), ("éa", 8), ("", 2), ("es", 33)):
        rows += [(lang, i * 7 % 101 if i % 9 else None, leaf_of(lang, i, "t" * i)) for i in range(n)]
    rows += [("en", 3, leaf_of("same"))] * 3
    docs = spark.createDataFrame(rows, "lang string, doc_id long, leaf string").withColumn("root", F.lit("mine")).repartition(5)
    found = merkle.manifest(docs.select("lang", "doc_id", "leaf"), "lang", ["doc_id"], "leaf", fanout, most).withColumn("folded", merkle.fold(F.col("leaf"), F.col("proof")))
    got = [(r["lang"], r["doc_id"], r["leaf"], r["subroot"], r["root"], [(s["place"], s["siblings"]) for s in r["proof"]]) for r in found.collect()]
    key = lambda r: str(r)
    assert sorted(got, key=key) == sorted(plain(rows, fanout), key=key)
    assert found.where("folded != root").count() == 0
    bad = found.select(merkle.fold(F.sha2(F.concat("leaf", F.lit("x")), 256), F.col("proof")).alias("f"), "root")
    assert bad.where("f = root").count() == 0


def test_fields_proof_digest_and_clashing_names(spark):
    docs = spark.createDataFrame([(1, "s", "en", 5, "hé"), (None, None, None, None, None), (14, "", "en", 0, "")], "doc_id long, source string, lang string, n_chars long, text string")
    rows = docs.withColumns({"leaf": merkle.leaf(*[F.col(c) for c in docs.columns]), "__block": F.lit("kept"), "__pos": F.lit(1.5)})
    found = merkle.manifest(rows, "lang", ["doc_id"], "leaf").withColumn("digest", merkle.proof_digest(F.col("proof"))).collect()
    leaves = {r["doc_id"]: r["leaf"] for r in found}
    assert leaves == {1: leaf_of(1, "s", "en", 5, "hé"), None: leaf_of(None, None, None, None, None), 14: leaf_of(14, "", "en", 0, "")}
    en = h(leaves[1], leaves[14])
    assert {r["doc_id"]: r["digest"] for r in found} == {1: h(leaves[14], leaves[None]), 14: h(leaves[1], leaves[None]), None: h(en)}
    assert all(r["root"] == h(leaves[None], en) and r["__block"] == "kept" and r["__pos"] == 1.5 for r in found)


def test_one_row_and_none(spark):
    docs = spark.createDataFrame([("x", 1, "ab")], "lang string, doc_id long, leaf string")
    one = merkle.manifest(docs, "lang", ["doc_id"], "leaf").withColumn("d", merkle.proof_digest(F.col("proof"))).first()
    assert (one["subroot"], one["root"], one["proof"], one["d"]) == ("ab", "ab", [], h(""))
    assert merkle.manifest(docs.limit(0), "lang", ["doc_id"], "leaf").count() == 0


def test_query_sees_tampering(spark):
    from fundscope.llm import queries

    for r in queries.QUERIES["op11_merkle_butterfly"](spark, "/root/testdata/sf0.001").collect():
        assert r["verified"] == (zlib.crc32(str(r["doc_id"]).encode()) % 7 != 0)
