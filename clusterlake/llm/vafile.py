"""Exact top-k search by inner product over a vector-approximation file.

The file has two tables in the shared folder. One holds the exact vectors, a row each. The other holds their approximations in blocks:
for each component, CELLS cells that about as many of the block's values lie in each, with the least and greatest value of each, and FINE
equal parts of each cell; and of each vector its cell and part numbers, a byte a component. A search scans the cells alone, twice: once
for lower bounds of scores, of which the kth best of each query is a score that its results must reach, and once for the vectors whose
upper bound does. Either scan bounds scores by cells, and those that this leaves open by parts: the k best of a block by their upper
bound in the first scan, those that reach the score in the second. Exact vectors are then read in the order of their
upper bounds: the first k of each query, and of the others those whose bound reaches the kth score found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from clusterlake.llm.common import partitions, released, small_batches, table, written

CELLS, FINE, BLOCK, QUERY_BLOCK = 16, 16, 1024, 256
#: Vectors whose cells one task holds at a time.
GROUP = 1 << 18
NEVER = -(2.0**62)
BLOCKS = "block long, n int, dim int, rows binary, ids binary, vectors binary, low binary, high binary, cells binary, least binary, bytes int"


class Approximation:
    """The cells of a block, their parts, and bounds of scores by either. low and high: (components, cells), the values that a cell's vectors have; cell: (vectors, components), cell * FINE + part."""

    def __init__(self, low: np.ndarray, high: np.ndarray, cell: np.ndarray):
        self.low, self.high, self.cell = low, high, cell

    @classmethod
    def of(cls, v: np.ndarray, cells: int = CELLS) -> Approximation:
        """Cells end at quantiles; of a value that several of them end at, all copies are in one cell."""
        n, d = v.shape
        ends = np.sort(v, axis=0)[np.minimum(n - 1, np.arange(1, cells + 1) * n // cells - (n >= cells))].T  # (components, cells), the greatest value of each
        ends[:, -1] = v.max(0)
        at = np.stack([np.searchsorted(ends[j], v[:, j], "left") for j in range(d)], axis=1) if d else np.zeros((n, 0), np.int64)
        low, high = np.full((d, cells), np.iinfo(np.int64).max), np.full((d, cells), np.iinfo(np.int64).min)
        column = np.broadcast_to(np.arange(d), v.shape)
        np.minimum.at(low, (column, at), v)
        np.maximum.at(high, (column, at), v)
        empty = low > high
        low[empty] = high[empty] = 0
        width = part_width(low, high)
        part = (v - low[column, at]) // width[column, at]
        return cls(low, high, (at * FINE + part).astype(np.uint8))

    def range_of(self, vectors: np.ndarray | slice, d: int, fine: bool) -> tuple[np.ndarray, np.ndarray]:
        """The least and greatest values that vectors can have."""
        code = self.cell[vectors, :d]
        at, column = code // FINE, np.arange(d)
        low, high = self.low[column, at], self.high[column, at]
        if fine:
            width = part_width(self.low, self.high)[column, at]
            low = low + (code % FINE) * width
            high = np.minimum(high, low + width - 1)
        return low, high

    def bounds(self, q: np.ndarray, upper: bool, fine: bool = True, vectors: np.ndarray | slice = slice(None)) -> np.ndarray:
        """Lower or upper bounds of the scores of queries (rows of q) with vectors, by cells or, with fine, by their parts; components that one side lacks are zero."""
        d = min(q.shape[1], self.cell.shape[1])
        q = q[:, :d]
        kind = np.float64 if exact_in_float(q, np.maximum(np.abs(self.low[:d]), np.abs(self.high[:d]))) else np.int64
        low, high = (x.astype(kind) for x in self.range_of(vectors, d, fine))
        plus, minus = np.maximum(q, 0).astype(kind), np.minimum(q, 0).astype(kind)
        return plus @ high.T + minus @ low.T if upper else plus @ low.T + minus @ high.T


def part_width(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    return np.maximum(1, -(-(high - low + 1) // FINE))


def number_type(x: np.ndarray) -> str:
    """Two bytes where all numbers fit, else eight."""
    return "<i2" if len(x) == 0 or -(1 << 15) <= int(x.min(initial=0)) and int(x.max(initial=0)) < 1 << 15 else "<i8"


def exact_in_float(q: np.ndarray, most: np.ndarray) -> bool:
    """Whether sums of products stay below 2**52, so that a float product is exact."""
    return float(np.abs(q).max(initial=0)) * float(most.max(initial=0)) * max(1, q.shape[-1]) < 2**52


def blocks(df: DataFrame, rows: int, approximate: bool) -> DataFrame:
    """BLOCKS of rows of (row long, id long, v array<long>), packed by the tasks that read them: with approximate their grids and cells, else their vectors. Shorter vectors are filled up with zeros."""
    small_batches(df.sparkSession, rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for nth, b in enumerate(batches):
            if not b.num_rows:
                continue
            size = np.diff(b.column(2).offsets.to_numpy())
            v = np.zeros((b.num_rows, max(1, size.max())), np.int64)
            v[np.arange(v.shape[1]) < size[:, None]] = b.column(2).flatten().to_numpy()
            a = Approximation.of(v) if approximate else None
            kind = number_type(v)
            blobs = [b.column(0).to_numpy(), b.column(1).to_numpy(), None if a else v.astype(kind), *((a.low.astype(kind), a.high.astype(kind), a.cell) if a else (None,) * 3), None]
            cols = [pa.array([(part << 32) + nth], pa.int64()), pa.array([b.num_rows], pa.int32()), pa.array([v.shape[1]], pa.int32()), *(pa.array([None if x is None else x.tobytes()], pa.binary()) for x in blobs), pa.array([int(kind[2:])], pa.int32())]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    names = [x.split()[0] for x in BLOCKS.split(", ")]
    return df.select("row", "id", "v").mapInArrow(run, BLOCKS)


def meeting(cells: DataFrame, asked: DataFrame, groups: int) -> DataFrame:
    """All blocks of cells, dealt to groups, each followed by all blocks of queries: cells move once, and a task holds those of one group."""
    left = cells.withColumns({"deal": F.pmod(F.xxhash64("block"), F.lit(groups)).cast("int"), "asks": F.lit(False)})
    right = asked.withColumns({"deal": F.explode(F.sequence(F.lit(0), F.lit(groups - 1))), "asks": F.lit(True)})
    both = left.unionByName(right.select(left.columns))
    return both.repartition(max(groups, 1), "deal").sortWithinPartitions("deal", "asks", "block")


def pairs_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, np.ndarray, np.ndarray, list]]:
    """(row of a query block, its ids, its vectors, [(rows, ids, Approximation)] of its group) in the order of meeting()."""
    now, held = None, []
    for b in batches:
        for r in b.to_pylist():
            if now != r["deal"]:
                now, held = r["deal"], []
            ids = np.frombuffer(r["ids"], np.int64)
            numbers = lambda x, *shape: np.frombuffer(r[x], f"<i{r['bytes']}").astype(np.int64).reshape(shape)  # noqa: E731, B023
            if r["asks"]:
                yield r, ids, numbers("vectors", r["n"], r["dim"]), held
            else:
                a = Approximation(numbers("low", r["dim"], CELLS), numbers("high", r["dim"], CELLS), np.frombuffer(r["cells"], np.uint8).reshape(r["n"], r["dim"]))
                held.append((np.frombuffer(r["rows"], np.int64), ids, a))


def best_of(x: np.ndarray, k: int) -> np.ndarray:
    """The k greatest of each row, or all, in any order."""
    return np.partition(x, x.shape[1] - k, axis=1)[:, x.shape[1] - k :] if x.shape[1] > k else x


def refined(a: Approximation, q: np.ndarray, high: np.ndarray, own: np.ndarray, least: np.ndarray, k: int) -> np.ndarray:
    """The k best lower bounds by parts for each query, of the vectors that for any query are among the k of greatest upper bounds by cells and can raise its least score; NEVER where there are fewer."""
    chosen = np.zeros(high.shape, bool)
    some = np.argpartition(-high, min(k, high.shape[1]) - 1, axis=1)[:, :k]
    np.put_along_axis(chosen, some, True, axis=1)
    chosen &= (high > least[:, None]) & ~own
    columns = np.flatnonzero(chosen.any(0))
    out = np.full((len(q), k), NEVER)
    if len(columns):
        low = best_of(np.where(own[:, columns], NEVER, a.bounds(q, False, True, columns)), k)
        out[:, : low.shape[1]] = low
    return out


def least_scores(cells: DataFrame, asked: DataFrame, groups: int, k: int) -> DataFrame:
    """asked with `least`: for each query, the kth best lower bound, which is NEVER if there are fewer vectors."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r, qids, q, held in pairs_of(batches):
            best = np.full((len(q), k), NEVER)
            for _, ids, a in held:
                own = qids[:, None] == ids[None, :]
                high = a.bounds(q, True, fine=False).astype(float)
                high[own] = NEVER
                best = best_of(np.concatenate((best, refined(a, q, high, own, best.min(1), k)), axis=1), k)
            yield pa.RecordBatch.from_arrays([pa.array([r["block"]], pa.int64()), pa.array([r["n"]], pa.int32()), pa.array([best.tobytes()], pa.binary())], names=["block", "n", "best"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, best = None, None
        out = lambda: pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([best.min(1).tobytes()], pa.binary())], names=["block", "least"])
        for b in batches:
            for r in b.to_pylist():
                x = np.frombuffer(r["best"]).reshape(r["n"], k)
                if now == r["block"]:
                    best = best_of(np.concatenate((best, x), axis=1), k)
                    continue
                if now is not None:
                    yield out()
                now, best = r["block"], x
        if now is not None:
            yield out()

    found = meeting(cells, asked, groups).mapInArrow(scan, "block long, n int, best binary")
    least = found.repartition("block").sortWithinPartitions("block").mapInArrow(merge, "block long, least binary")
    return asked.drop("least").join(least, "block")


def candidates(cells: DataFrame, asked: DataFrame, groups: int) -> DataFrame:
    """(q_row, row, upper): of each query the vectors whose upper bound reaches its least score."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r, qids, q, held in pairs_of(batches):
            least, q_rows = np.frombuffer(r["least"])[:, None], np.frombuffer(r["rows"], np.int64)
            for rows, ids, a in held:
                open_ = (a.bounds(q, True, fine=False) >= least) & (qids[:, None] != ids[None, :])
                columns = np.flatnonzero(open_.any(0))
                if not len(columns):
                    continue
                high = a.bounds(q, True, True, columns).astype(float)
                i, j = np.nonzero((high >= least) & open_[:, columns])
                if len(i):
                    yield pa.RecordBatch.from_arrays([pa.array(q_rows[i]), pa.array(rows[columns[j]]), pa.array(high[i, j])], names=["q_row", "row", "upper"])

    return meeting(cells, asked, groups).mapInArrow(scan, "q_row long, row long, upper double")


def product(x: str, y: str) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda a, b: F.coalesce(a * b, F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda s, z: s + z)


def approximation_file(vectors: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """(exact, cells) of (id, v): exact is (row, id, copies, v), cells are BLOCKS.

    Of equal vectors only those with the k + 1 least ids can be a result, whatever the query; a common vector is cut down to them by the
    tasks that read it, before it is shuffled. Repeated rows count as copies.
    """
    few = vectors.withColumn("r", F.dense_rank().over(W.partitionBy("v").orderBy("id"))).where(F.col("r") <= k + 1)
    exact = few.groupBy("v", "id").agg(F.count(F.lit(1)).alias("copies")).select(F.monotonically_increasing_id().alias("row"), "id", "copies", "v")
    exact = written(exact, "vectors")
    return exact, written(blocks(exact, BLOCK, True), "cells")


def top_k(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score) of (id long, v array<long>) rows; equal scores by the smaller id; rows with the query's own id take no part.

    Every query is held against the cells of every vector, as asked for. Each of repeated query rows is a query with ranks of its own;
    each of repeated vector rows is a result of its own. Vectors of different lengths end in zeros; an empty side gives an empty result.
    """
    exact, cells = approximation_file(vectors, k)
    asks = written(queries.select(F.monotonically_increasing_id().alias("row"), "id", "v"), "asks")
    asked = written(blocks(asks, QUERY_BLOCK, False), "queries")
    small_batches(vectors.sparkSession)
    count = cells.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    groups = max(1, min(cells.count(), max(partitions(vectors.sparkSession), -(-count // GROUP))))
    bounded = written(least_scores(cells, asked, groups, k), "bounded")
    found = written(candidates(cells, bounded, groups), "candidates")
    released(asked, bounded, cells)

    q = asks.select(F.col("row").alias("q_row"), F.col("id").alias("query_id"), F.col("v").alias("q"))
    read = lambda some: some.join(exact, "row").join(q, "q_row").select("q_row", "query_id", "row", F.col("id").alias("vec_id"), "copies", product("v", "q").alias("score"))
    nth = F.row_number().over(W.partitionBy("q_row").orderBy(F.desc("upper"), "row"))
    first = written(read(found.withColumn("nth", nth).where(F.col("nth") <= k)), "first")
    sure = first.groupBy("q_row").agg(F.min("score").alias("least"))
    rest = found.join(first.select("q_row", "row"), ["q_row", "row"], "left_anti").join(sure, "q_row").where("upper >= least")
    each = first.unionByName(read(rest)).withColumn("copy", F.explode(F.sequence(F.lit(1), F.least("copies", F.lit(k)))))
    rank = F.row_number().over(W.partitionBy("q_row").orderBy(F.desc("score"), "vec_id"))
    return each.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of vectors become floor(64 x); vectors that are null or hold a null or a number that isn't finite take no part, nor do rows without an id; an empty vector has score 0 with all. Of equal scores the smaller ids come first; each of repeated rows is a query with ranks of its own, and a result of its own; vectors of any length are read whole; an empty table gives an empty result; other columns are not read."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").alias("e"))
    fine = F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    v = e.where(F.col("id").isNotNull() & F.col("e").isNotNull() & fine).select("id", F.transform("e", lambda x: F.floor(x.cast("double") * 64).cast("long")).alias("v"))
    return top_k(v.where("id % 20 = 0"), v, 20)


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
q AS (SELECT row_number() OVER () AS q_row, * FROM v WHERE vec_id % 20 = 0),
s AS (
  SELECT q.q_row, q.vec_id AS query_id, c.vec_id, CAST(coalesce(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])), 0) AS BIGINT) AS score
  FROM q JOIN v c ON q.vec_id <> c.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY q_row ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
