"""Merkle manifest of a table, by butterfly exchange between partitions of leaves.

The rows of one tree (say, of one language) are leaves in order. BLOCK consecutive leaves are a partition: it hashes
its own subtree. Then, round by round, aligned groups of ``fanout`` partitions swap their subtree roots: partition p
meets those that differ from it in one digit of p alone, and each hashes the parent itself. So after
log(partitions) rounds of small messages, every partition holds the root and all upper siblings of its leaves;
nothing is sent down the tree. In the last, incomplete subtree of a round the partitions answer for the missing ones
in turn. The roots of the trees are the leaves of one more tree, made the same way.

H is lowercase hex SHA-256 of the inputs, concatenated. A lone node at the end of a level is hashed alone, while the
level has more than one node. A proof lists, from the leaf up, the node's place in its run and its siblings.

Nulls: a null field has a leaf encoding of its own; null trees and null order values come first. Rows that tie in the
order columns are ordered by leaf; equal rows are leaves of their own. An empty table gives no rows. Other columns
pass through, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import written

#: Leaves of a partition are at most this many (the largest power of the fanout below it).
BLOCK = 4096
#: Rounds of the exchange between writes of its state.
ROUNDS = 8
PROOF = T.ArrayType(T.StructType([T.StructField("place", T.IntegerType()), T.StructField("siblings", T.ArrayType(T.StringType()))]))


def field(value: Column) -> Column:
    """A value's part of its row's leaf: ``-`` for null, else UTF-8 byte count, ``:``, value."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(*values: Column) -> Column:
    return F.sha2(F.concat(*map(field, values)), 256)


def fold(node: Column, proof: Column) -> Column:
    """The root that a leaf and a proof lead to."""
    def up(acc, step):
        left = F.array_join(F.slice(step["siblings"], F.lit(1), step["place"]), "")
        right = F.array_join(F.slice(step["siblings"], step["place"] + 1, F.size(step["siblings"])), "")
        return F.sha2(F.concat(left, acc, right), 256)

    return F.aggregate(proof, node, up)


def proof_digest(proof: Column) -> Column:
    """H of a proof's siblings, from the leaf's run to the root's, each left to right."""
    return F.sha2(F.array_join(F.flatten(F.transform(proof, lambda s: s["siblings"])), ""), 256)


def height(leaves: int, fanout: int) -> int:
    n = 0
    while leaves > 1:
        leaves, n = -(-leaves // fanout), n + 1
    return n


def levels(nodes: list[str], fanout: int, rise: int) -> list[list[str]]:
    out = [nodes]
    for _ in range(rise):
        below = out[-1]
        out.append([hashlib.sha256("".join(below[i : i + fanout]).encode()).hexdigest() for i in range(0, len(below), fanout)])
    return out


def _subtree(table: pa.Table, fanout: int, block: int) -> tuple[np.ndarray, list[list[str]]]:
    """The order of a partition's leaves and the levels of its subtree."""
    order = np.argsort(table["__pos"].to_numpy())
    total = table["__total"][0].as_py()
    return order, levels(table["__leaf"].take(pa.array(order)).to_pylist(), fanout, min(height(total, fanout), height(block, fanout)))


def _placed(leaves: DataFrame, order: list[str]) -> DataFrame:
    """Adds __pos, the place among the leaves of __tree, and __total. Rows are dealt by range of tree, order and leaf,
    so a tree of any size spreads; the places come from counts by range."""
    keys = [F.col("__tree"), *[F.col(c).asc_nulls_first() for c in order], F.col("__leaf"), F.col("__row")]
    parts = int(leaves.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = leaves.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).drop("__row")
    rows = written(rows.withColumns({"__part": F.spark_partition_id(), "__at": F.monotonically_increasing_id()}), "merkle-order")
    runs = rows.groupBy("__tree", "__part").agg(F.min("__at").alias("__first"), F.count("*").alias("__n"))
    tree = Window.partitionBy("__tree")
    before = F.sum("__n").over(tree.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.select("__tree", "__part", "__first", F.coalesce(before, F.lit(0)).alias("__before"), F.sum("__n").over(tree).alias("__total"))
    return rows.join(runs, ["__tree", "__part"]).withColumn("__pos", F.col("__before") + F.col("__at") - F.col("__first")).drop("__part", "__at", "__first", "__before")


def _round(state: DataFrame, width: int, fanout: int) -> DataFrame:
    """One exchange: partitions of ``width`` leaves-partitions a subtree meet in groups of ``fanout`` subtrees."""
    p, m = F.col("__block"), F.col("__blocks")
    q, low = F.floor(p / width), p % width
    active = m > width
    own = F.when(active, F.least(F.lit(width), m - q * width)).otherwise(F.lit(1))
    first = F.floor(q / fanout) * fanout
    last = F.least(first + fanout - 1, F.floor((m - 1) / width))
    peers = F.when(active, F.sequence(first, last)).otherwise(F.array(q))
    sent = state.withColumns({"__q": q, "__low": low, "__own": own, "__place": F.when(active, q - first).otherwise(0).cast("int")})
    sent = sent.withColumn("__peer", F.explode(peers))
    size = F.least(F.lit(width), m - F.col("__peer") * width)
    # the partitions of the peer subtree that this one answers; of its own subtree, itself
    lows = F.when(~active | (F.col("__peer") == F.col("__q")), F.array("__low")).when(F.col("__low") < size, F.sequence("__low", size - 1, F.col("__own"))).otherwise(F.array().cast("array<bigint>"))
    sent = sent.withColumn("__to", F.explode(lows)).withColumn("__to", F.col("__to") + F.col("__peer") * width)
    mine = F.when(F.col("__peer") == F.col("__q"), F.struct("__place", "__blocks", "__proof"))
    met = sent.groupBy("__tree", F.col("__to").alias("__block")).agg(
        F.sort_array(F.collect_list(F.struct("__place", "__node"))).alias("__run"), F.first(mine, ignorenulls=True).alias("__me"))
    others = F.transform(F.filter("__run", lambda x: x["__place"] != F.col("__me.__place")), lambda x: x["__node"])
    moved = F.col("__me.__blocks") > width
    step = F.array(F.struct(F.col("__me.__place").alias("place"), others.alias("siblings")))
    return met.select(
        "__tree", "__block", F.col("__me.__blocks").alias("__blocks"),
        F.when(moved, F.sha2(F.array_join(F.transform("__run", lambda x: x["__node"]), ""), 256)).otherwise(F.col("__run")[0]["__node"]).alias("__node"),
        F.when(moved, F.concat("__me.__proof", step)).otherwise(F.col("__me.__proof")).alias("__proof"))


def _climb(placed: DataFrame, fanout: int, block: int) -> DataFrame:
    """For each partition of leaves: its tree's root (__node), and the proof of its subtree (__proof)."""
    def own_root(table: pa.Table) -> pa.Table:
        _, made = _subtree(table, fanout, block)
        total = table["__total"][0].as_py()
        return pa.table({"__tree": table["__tree"][:1], "__block": pa.array([table["__block"][0].as_py()], pa.int64()), "__blocks": pa.array([-(-total // block)], pa.int64()), "__node": [made[-1][0]]})

    leaves = placed.select("__tree", "__block", "__pos", "__total", "__leaf")
    state = leaves.groupBy("__tree", "__block").applyInArrow(own_root, "__tree string, __block long, __blocks long, __node string")
    state = written(state.withColumn("__proof", F.array().cast(PROOF)), "merkle-state")
    most = state.agg(F.max("__blocks")).first()[0] or 0
    width = rounds = 1
    while width < most:
        state = _round(state, width, fanout)
        if rounds % ROUNDS == 0 or width * fanout >= most:
            state = written(state, "merkle-state")
        width, rounds = width * fanout, rounds + 1
    return state


def _unfold(placed: DataFrame, state: DataFrame, fanout: int, block: int) -> DataFrame:
    """The leaves' rows with __proof: the path inside the partition, then the partition's. Each partition hashes its
    subtree anew; its upper proof is one row."""
    kept = [f for f in placed.schema.fields if f.name not in ("__pos", "__total", "__block")]
    more = [f for f in state.schema.fields if f.name not in ("__tree", "__block", "__blocks", "__proof")]
    schema = T.StructType([*kept, *more, T.StructField("__proof", PROOF)])

    def prove(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        order, made = _subtree(left, fanout, block)
        upper = right["__proof"][0].as_py()
        places, ends, siblings, runs = [], [0], [], [0]
        for i in range(left.num_rows):
            for nodes in made[:-1]:
                start = i // fanout * fanout
                places.append(i - start)
                siblings += nodes[start:i]
                siblings += nodes[i + 1 : start + fanout]
                ends.append(len(siblings))
                i //= fanout
            for step in upper:
                places.append(step["place"])
                siblings += step["siblings"]
                ends.append(len(siblings))
            runs.append(len(places))
        steps = pa.StructArray.from_arrays([pa.array(places, pa.int32()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(siblings, pa.string()))], ["place", "siblings"])
        out = {f.name: left[f.name].take(pa.array(order)) for f in kept}
        out |= {f.name: pa.array([right[f.name][0].as_py()] * left.num_rows, right.schema.field(f.name).type) for f in more}
        return pa.table(out | {"__proof": pa.ListArray.from_arrays(pa.array(runs, pa.int32()), steps)})

    state = state.drop("__blocks")
    return placed.groupBy("__tree", "__block").cogroup(state.groupBy("__tree", "__block")).applyInArrow(prove, schema)


def manifest(rows: DataFrame, tree: str, order: list[str], leaf_col: str, fanout: int = 2, most: int = BLOCK) -> DataFrame:
    """Every row with subroot (of its tree), root (of all trees) and proof: array<struct<place, siblings>>, from the
    leaf up to the root. ``leaf_col`` holds the rows' leaves."""
    block = fanout
    while block * fanout <= most:
        block *= fanout
    name = F.col(tree).cast("string")
    own = [c for c in rows.columns]
    # own columns are renamed meanwhile, so that no name clashes
    alias = {c: f"c{i}" for i, c in enumerate(own)}
    leaves = rows.select(*[F.col(f"`{c}`").alias(alias[c]) for c in own], F.when(name.isNull(), F.lit("-")).otherwise(F.concat(F.lit("="), name)).alias("__tree"), F.col(leaf_col).alias("__leaf"), F.monotonically_increasing_id().alias("__row"))
    cut = F.floor(F.col("__pos") / block).alias("__block")
    placed = _placed(written(leaves, "merkle-leaves"), [alias[c] for c in order]).select("*", cut)
    state = _climb(placed, fanout, block)
    trees = state.where("__block = 0").select(F.col("__tree").alias("name"), F.col("__node").alias("__leaf"), F.lit("").alias("__tree"), F.lit(0).alias("__row"))
    above = _placed(trees, ["name"]).select("*", cut)
    roots = _climb(above, fanout, block).withColumnRenamed("__node", "__root")
    tops = _unfold(above, roots, fanout, block).select(F.col("name").alias("__tree"), "__root", F.col("__proof").alias("__above"))
    state = state.join(tops, "__tree").withColumn("__proof", F.concat("__proof", "__above")).drop("__above")
    found = _unfold(placed, state, fanout, block)
    return found.select(*[F.col(alias[c]).alias(c) for c in own], F.col("__node").alias("subroot"), F.col("__root").alias("root"), F.col("__proof").alias("proof"))


#: unsigned crc32 of an ASCII string, in DuckDB (the polynomial is the standard's)
CRC32_SQL = """xor(4294967295, list_reduce(list_concat([4294967295], flatten(list_transform(list_transform(range(1, length({s}) + 1), lambda i: ascii(substr({s}, i::int, 1))), lambda b: [b::bigint, -1, -1, -1, -1, -1, -1, -1, -1]))), lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c // 2, 3988292384 * (c % 2)) END))"""

ORACLE_SQL = f"""
WITH RECURSIVE f AS (
  SELECT doc_id, lang, {{field}} FROM documents),
d AS (SELECT doc_id, CASE WHEN lang IS NULL THEN '-' ELSE '=' || lang END AS tree, sha256(a || n || t) AS leaf,
    CASE WHEN doc_id IS NOT NULL AND {CRC32_SQL.format(s="doc_id::varchar")} % 7 = 0 THEN sha256(a || n1 || t) ELSE sha256(a || n || t) END AS other FROM f),
p AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS total FROM d),
lv AS (
  SELECT tree, 0 AS l, pos AS i, leaf AS h, total AS n FROM p
  UNION ALL
  SELECT tree, l + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), (n + 1) // 2 FROM lv WHERE n > 1 GROUP BY tree, l, i // 2, n),
subs AS (SELECT tree, h AS subroot, max(l) OVER () AS top, l AS high, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS total FROM lv WHERE n = 1),
up AS (
  SELECT 0 AS l, pos AS i, subroot AS h, total AS n FROM subs
  UNION ALL
  SELECT l + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), (n + 1) // 2 FROM up WHERE n > 1 GROUP BY l, i // 2, n),
path AS (
  SELECT p.tree, p.pos, l, (p.pos >> l) % 2 AS side, (SELECT h FROM lv AS x WHERE x.tree = p.tree AND x.l = lv.l AND x.i = xor(p.pos >> lv.l, 1)) AS sibling
  FROM p JOIN lv ON lv.tree = p.tree AND lv.n > 1 AND lv.i = p.pos >> lv.l
  UNION ALL
  SELECT p.tree, p.pos, 1000 + up.l, (subs.pos >> up.l) % 2, (SELECT h FROM up AS x WHERE x.l = up.l AND x.i = xor(subs.pos >> up.l, 1))
  FROM p JOIN subs USING (tree) JOIN up ON up.n > 1 AND up.i = subs.pos >> up.l),
proofs AS (SELECT tree, pos, list({{{{'side': side, 'sibling': coalesce(sibling, '')}}}} ORDER BY l) AS steps FROM path GROUP BY tree, pos),
folded AS (
  SELECT tree, pos, steps, 1 AS k, other AS h FROM p LEFT JOIN proofs USING (tree, pos)
  UNION ALL
  SELECT tree, pos, steps, k + 1, sha256(CASE WHEN steps[k].side = 1 THEN steps[k].sibling || h ELSE h || steps[k].sibling END) FROM folded WHERE k <= coalesce(len(steps), 0))
SELECT p.doc_id, p.leaf, subs.subroot, up.h AS root, sha256(coalesce(array_to_string(list_transform(folded.steps, lambda s: s.sibling), ''), '')) AS proof_sha256,
  folded.h AS folded_root, folded.h = up.h AS verified
FROM p JOIN subs USING (tree) JOIN folded ON folded.tree = p.tree AND folded.pos = p.pos AND folded.k = coalesce(len(folded.steps), 0) + 1 JOIN up ON up.n = 1
""".format(field=", ".join([
    "coalesce(strlen(doc_id::varchar) || ':' || doc_id::varchar, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS a",
    "coalesce(strlen(n_chars::varchar) || ':' || n_chars::varchar, '-') AS n",
    "coalesce(strlen((n_chars + 1)::varchar) || ':' || (n_chars + 1)::varchar, '-') AS n1",
    "coalesce(strlen(text) || ':' || text, '-') AS t"]))
