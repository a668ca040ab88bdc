"""Exact nearest neighbours by a block matrix join of int8 tiles.

Equal vectors are one point, with the least ids that any answer can need. Points are packed into blocks: int8 codes
with a scale a vector, the length of what the codes miss, and the original components. Query blocks and candidate
blocks meet in a grid of cells, by an equi-join on the cell, and each pair of blocks is a tile: the integer product of
the codes gives every distance of the tile to within the two missed lengths (triangle inequality). Pairs whose lower
bound is beyond the k-th best upper bound, or the k-th best distance so far, are out; the rest are recomputed in
double precision from the original components, and go into a heap of k a query. So a cell returns k rows a query,
whatever the data, and the cells' heaps are merged by query. Nothing is approximate: recall is one.

Vectors null, empty, zero or holding null or non-finite components take no part. Vectors of another length than the
query's are no candidates of it. Rows equal in id and vector count once; a query's own row is that of its id and
vector. A query id with several vectors gets a list for each. Null ids are no queries; as candidates they come after
all ids. An empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import written

QUERY_BLOCK, BLOCK = 1024, 4096
#: Integer products of this many dimensions at most are exact in float32 (127 * 127 * 1024 < 2**24).
EXACT_DIMS = 1024
#: Pairs recomputed at a time.
PAIRS = 1 << 16
NO_ID = (1 << 63) - 1
CODED = "block long, dim int, n int, refs binary, firsts binary, scale binary, missed binary, codes binary, original binary"


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def points(rows: DataFrame, k: int) -> DataFrame:
    """ref, ids (the k + 1 least, with null last, as structs none, id), first, vector of each distinct vector of
    rows (id, vector). A vector shared by many rows is cut to the least ids before the shuffle."""
    own = rows.where(usable(F.col("vector"))).select(F.struct(F.col("id").isNull().alias("none"), "id").alias("id"), "vector", F.xxhash64("vector").alias("h"))
    least = own.withColumn("__rank", F.dense_rank().over(Window.partitionBy("h", "vector").orderBy("id"))).where(F.col("__rank") <= k + 1)
    kept = least.groupBy("h", "vector").agg(F.sort_array(F.collect_set("id")).alias("ids"))
    return written(kept.select(F.monotonically_increasing_id().alias("ref"), "ids", F.coalesce(F.col("ids")[0]["id"], F.lit(NO_ID)).alias("first"), "vector"), "vector-points")


def _pack(refs: np.ndarray, firsts: np.ndarray, x: np.ndarray, block: int) -> dict:
    wide = x.astype(np.float64)
    scale = np.abs(wide).max(axis=1) / 127
    codes = np.rint(wide / scale[:, None]).clip(-127, 127).astype(np.int8)
    missed = np.sqrt(((wide - scale[:, None] * codes) ** 2).sum(axis=1)) * (1 + 1e-9)
    out = {"block": block, "dim": x.shape[1], "n": len(x)}
    return out | {k: v.tobytes() for k, v in (("refs", refs), ("firsts", firsts), ("scale", scale), ("missed", missed), ("codes", codes), ("original", x))}


def blocks(found: DataFrame, size: int) -> DataFrame:
    """The points in blocks of ``size`` vectors of equal length."""
    kind = "<f4" if "float" in found.schema["vector"].dataType.simpleString() else "<f8"

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        waiting: dict[int, list] = {}
        schema = pa.schema([(c, pa.int64() if c == "block" else pa.int32() if c in ("dim", "n") else pa.binary()) for c in (x.split()[0] for x in CODED.split(", "))])

        def flush(dim: int) -> pa.RecordBatch:
            nonlocal number
            refs, firsts, values = zip(*waiting.pop(dim), strict=True)
            number += 1
            return pa.RecordBatch.from_pylist([_pack(np.concatenate(refs), np.concatenate(firsts), np.concatenate(values), number - 1)], schema)

        for batch in batches:
            lengths = batch.column(2).value_lengths().to_numpy(zero_copy_only=False)
            flat, ends = batch.column(2).flatten().to_numpy(zero_copy_only=False).astype(kind), np.cumsum(lengths)
            refs, firsts = (batch.column(i).to_numpy(zero_copy_only=False).astype("<i8") for i in (0, 1))
            for dim in np.unique(lengths).tolist():
                at = np.flatnonzero(lengths == dim)
                x = flat[(ends[at] - dim)[:, None] + np.arange(dim)]
                i = 0
                while i < len(at):
                    held = waiting.setdefault(dim, [])
                    step = size - sum(len(r) for r, _, _ in held)
                    held.append((refs[at[i : i + step]], firsts[at[i : i + step]], x[i : i + step]))
                    i += step
                    if sum(len(r) for r, _, _ in held) == size:
                        yield flush(dim)
        for dim in list(waiting):
            yield flush(dim)

    return found.select("ref", "first", "vector").mapInArrow(pack, CODED)


class Block:
    """A block as arrays."""

    def __init__(self, row: dict, kind: str):
        self.name, self.dim, n = row["block"], row["dim"], row["n"]
        self.refs, self.firsts = np.frombuffer(row["refs"], "<i8"), np.frombuffer(row["firsts"], "<i8")
        self.scale, self.missed = np.frombuffer(row["scale"], "<f8"), np.frombuffer(row["missed"], "<f8")
        self.codes = np.frombuffer(row["codes"], np.int8).reshape(n, self.dim).astype(np.float32)
        self.original = np.frombuffer(row["original"], kind).reshape(n, self.dim)
        self.square = self.scale**2 * (self.codes.astype(np.float64) ** 2).sum(axis=1)


def bounds(q: Block, c: Block) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the tile's distances."""
    dots = np.zeros((len(q.refs), len(c.refs)))
    for a in range(0, q.dim, EXACT_DIMS):
        dots += q.codes[:, a : a + EXACT_DIMS] @ c.codes[:, a : a + EXACT_DIMS].T
    total = q.square[:, None] + c.square
    about = total - 2 * (q.scale[:, None] * c.scale) * dots
    slack, reach = 1e-12 * total, q.missed[:, None] + c.missed
    return np.sqrt(np.maximum(about - slack, 0)) * (1 - 1e-12) - reach, np.sqrt(np.maximum(about, 0) + slack) * (1 + 1e-12) + reach


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of rows, summed from the first component to the last in double precision."""
    apart = a.astype(np.float64) - b
    return np.sqrt(np.cumsum(apart * apart, axis=1)[:, -1])


class Nearest:
    """The k nearest of each vector of a query block, over the tiles seen so far."""

    def __init__(self, q: Block, k: int):
        self.q, self.k = q, k
        self.best: list[list[tuple]] = [[] for _ in q.refs]
        self.limit = np.full(len(q.refs), np.inf)

    def add(self, c: Block) -> None:
        low, high = bounds(self.q, c)
        limit = self.limit
        if len(c.refs) >= self.k and np.isinf(limit).any():
            limit = np.fmin(limit, np.partition(high, self.k - 1, axis=1)[:, self.k - 1])
        rows, columns = np.nonzero(~(low > limit[:, None]))
        for a in range(0, len(rows), PAIRS):
            qi, ci = rows[a : a + PAIRS], columns[a : a + PAIRS]
            score = distances(self.q.original[qi], c.original[ci])
            near = score <= self.limit[qi]
            qi, ci, score = qi[near], ci[near], score[near]
            for part in np.split(np.arange(len(qi)), np.flatnonzero(np.diff(qi)) + 1) if len(qi) else ():
                self._merge(qi[part[0]], score[part], c.firsts[ci[part]], c.refs[ci[part]])

    def _merge(self, i: int, score: np.ndarray, firsts: np.ndarray, refs: np.ndarray) -> None:
        if len(score) > self.k:
            at = np.flatnonzero(score <= np.partition(score, self.k - 1)[self.k - 1])
            score, firsts, refs = score[at], firsts[at], refs[at]
        found = heapq.nsmallest(self.k, chain(self.best[i], zip(score.tolist(), firsts.tolist(), refs.tolist(), strict=True)))
        self.best[i] = found
        if len(found) == self.k:
            self.limit[i] = found[-1][0]

    def rows(self) -> pa.RecordBatch:
        n = [len(x) for x in self.best]
        flat = list(chain.from_iterable(self.best))
        return pa.RecordBatch.from_pydict({"query": pa.array(np.repeat(self.q.refs, n), pa.int64()), "score": pa.array([x[0] for x in flat], pa.float64()),
                                           "first": pa.array([x[1] for x in flat], pa.int64()), "ref": pa.array([x[2] for x in flat], pa.int64())})


def _grid(n_query: int, n_blocks: int, tasks: int) -> tuple[int, int]:
    """Rows and columns of the grid of cells: about ``tasks`` cells, with each side sent about as many times as its
    number of blocks calls for."""
    down = min(n_query, max(1, round((tasks * n_query / n_blocks) ** 0.5)))
    return down, min(n_blocks, max(1, -(-tasks // down)))


def nearest_points(queries: DataFrame, base: DataFrame, k: int) -> DataFrame:
    """query, ref, score, first: the k nearest points of ``base`` of each point of ``queries`` (by score, then first)."""
    kind = "<f4" if "float" in base.schema["vector"].dataType.simpleString() else "<f8"
    spark = base.sparkSession
    left, right = written(blocks(queries, QUERY_BLOCK), "vector-queries"), written(blocks(base, BLOCK), "vector-blocks")
    n_query, n_blocks = max(1, left.count()), max(1, right.count())
    down, across = _grid(n_query, n_blocks, 4 * spark.sparkContext.defaultParallelism)
    spread = F.shiftright("block", 32) + F.col("block").bitwiseAND(0xFFFFFFFF)
    left = left.select(*[F.col(c).alias(f"q_{c}") for c in left.columns], (spread % down).alias("row"), F.explode(F.sequence(F.lit(0), F.lit(across - 1))).alias("column"), "dim")
    right = right.select(*right.columns, (spread % across).alias("column"), F.explode(F.sequence(F.lit(0), F.lit(down - 1))).alias("row"))
    cells = left.join(right.hint("merge"), ["row", "column", "dim"])
    names = [x.split()[0] for x in CODED.split(", ")]

    def tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, where = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                at = tuple(batch.column(c)[i].as_py() for c in ("row", "column", "q_block", "dim"))
                if at != where:
                    if now:
                        yield now.rows()
                    row = {c: batch.column(f"q_{c}")[i] for c in names}
                    now, where = Nearest(Block({c: v.as_buffer() if hasattr(v, "as_buffer") else v.as_py() for c, v in row.items()}, kind), k), at
                row = {c: batch.column(c)[i] for c in names}
                now.add(Block({c: v.as_buffer() if hasattr(v, "as_buffer") else v.as_py() for c, v in row.items()}, kind))
        if now:
            yield now.rows()

    found = cells.select("row", "column", *[f"q_{c}" for c in names], *names).mapInArrow(tiles, "query long, score double, first long, ref long")
    order = Window.partitionBy("query").orderBy("score", "first", "ref")
    return found.withColumn("__rank", F.row_number().over(order)).where(F.col("__rank") <= k).drop("__rank")


def search(queries: DataFrame, base: DataFrame, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows of ``base`` (id, vector) of each row of ``queries`` (id,
    vector), but for its own row; nearest first, ties to the smaller id."""
    known = points(base, k)
    asked = queries.where(F.col("id").isNotNull() & usable(F.col("vector"))).select("id", "vector").distinct()
    asked = written(asked, "vector-asked")
    shapes = written(asked.groupBy("vector").agg(F.min("id").alias("first")).select(F.monotonically_increasing_id().alias("ref"), "first", "vector"), "vector-shapes")
    # k + 1 points hold the k + 1 nearest rows, and so the k nearest others
    near = written(nearest_points(shapes, known, k + 1), "vector-near")
    rows = near.join(known.select("ref", "ids"), "ref").select("query", "score", F.explode("ids").alias("id"))
    lists = rows.groupBy("query").agg(F.slice(F.sort_array(F.collect_list(F.struct("score", "id"))), 1, k + 1).alias("near"))
    own = asked.select(F.col("id").alias("query_id"), "vector").join(shapes.select(F.col("ref").alias("query"), "vector"), "vector").join(lists, "query")
    others = F.filter("near", lambda x: ~((x["score"] == 0) & F.coalesce(x["id"]["id"] == F.col("query_id"), F.lit(False))))
    found = own.select("query_id", F.posexplode(F.slice(others, 1, k)).alias("at", "found"))
    return found.select("query_id", (F.col("at") + 1).alias("rank"), F.col("found.id.id").alias("vec_id"), F.col("found.score").alias("score"))


ORACLE_SQL = """
WITH v AS (SELECT DISTINCT vec_id, embedding::double[] AS e FROM embeddings WHERE embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))) AND list_bool_or(list_transform(embedding, lambda x: x <> 0))),
s AS (SELECT q.vec_id AS query_id, c.vec_id, sqrt(list_reduce(list_concat([0::double], list_transform(range(1, len(q.e) + 1), lambda i: (q.e[i] - c.e[i]) * (q.e[i] - c.e[i]))), lambda a, x: a + x)) AS score
  FROM v AS q JOIN v AS c ON len(q.e) = len(c.e) AND (q.vec_id <> c.vec_id OR c.vec_id IS NULL OR q.e <> c.e) WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id NULLS LAST) AS rank FROM s)
SELECT query_id, rank::int AS rank, vec_id, score FROM r WHERE rank <= 10
"""
