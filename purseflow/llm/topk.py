"""Exact top-k by inner product, by branch and bound over columns.

Candidate vectors are packed to blocks in vertical layout: a block is a matrix with a
row for each dimension. A query's scores are accumulated STEP dimensions at a time.
After each step, the score so far plus the product of the remaining norms (of query
and candidate) bounds a candidate's score; candidates whose bound is under the
query's k-th best score so far are dropped, and the survivors are compacted.

The queries are cut to groups, and every group meets every candidate block: the work
is the product of both by its nature, done block by block, without a row for a pair.
A task keeps the k best of each query in its group over the blocks it gets, and a
window over those short lists gives the result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from purseflow.storage import materialize

CANDIDATES = 2048
QUERIES = 256
STEP = 8
_EXACT = float(1 << 52)


def quantised(vectors: DataFrame, scale: float = 256.0) -> DataFrame:
    """(vec_id, v array<long>): floor(scale * x) of each component. Null ids, null vectors
    and vectors with null or non-finite components are left out; rows that repeat both
    id and vector count once."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.where("vec_id is not null and embedding is not null").where(~bad)
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("v")).dropDuplicates(["vec_id", "v"])


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of vectors; shorter ones are filled up with zeros."""
    sizes = np.diff(column.offsets.to_numpy())
    width = int(sizes.max()) if len(sizes) else 0
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width)[None, :] < sizes[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def _pack(limit: int):
    def run(batches):
        from pyspark import TaskContext

        part, seq = TaskContext.get().partitionId(), 0
        for b in batches:
            for at in range(0, b.num_rows, limit):
                rows = b.slice(at, limit)
                ids = rows.column("vec_id").to_numpy(zero_copy_only=False).astype("<i8").tobytes()
                columns = np.ascontiguousarray(_matrix(rows.column("v")).T).astype("<i8").tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([seq], pa.int64()), pa.array([ids], pa.binary()), pa.array([columns], pa.binary())], names=["part", "seq", "ids", "columns"])
                seq += 1

    return run


_PACKED = "part long, seq long, ids binary, columns binary"


def _unpack(ids: bytes, columns: bytes) -> tuple[np.ndarray, np.ndarray]:
    keys = np.frombuffer(ids, "<i8")
    return keys, np.frombuffer(columns, "<i8").reshape(-1, len(keys))


def _wide(columns: np.ndarray, width: int) -> np.ndarray:
    return np.pad(columns, ((0, width - len(columns)), (0, 0))) if len(columns) < width else columns


def _norms(columns: np.ndarray) -> np.ndarray:
    """Of each vector, the norm of what is left from each step on; never too small."""
    squares = np.add.reduceat(columns.astype(float) ** 2, np.arange(0, len(columns), STEP), axis=0)
    left = np.cumsum(squares[::-1], axis=0)[::-1]
    return np.vstack([np.sqrt(left) * (1 + 1e-9), np.zeros((1, columns.shape[1]))])


class Best:
    """The k best candidates of each query of a group."""

    def __init__(self, ids: np.ndarray, columns: np.ndarray, k: int):
        self.ids, self.columns, self.k = ids, columns, k
        self.found: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0), np.zeros(0, np.int64))] * len(ids)
        self.floor = np.full(len(ids), -np.inf)

    def add(self, keys: np.ndarray, columns: np.ndarray) -> None:
        width = max(len(self.columns), len(columns))
        mine, theirs = _wide(self.columns, width), _wide(columns, width)
        if not width or float(np.abs(mine).max(initial=0)) * float(np.abs(theirs).max(initial=0)) * width >= _EXACT:
            scores = mine.T.astype(object) @ theirs.astype(object) if width else np.zeros((len(self.ids), len(keys)), object)
            for q in range(len(self.ids)):
                self._merge(q, scores[q], keys)
            return
        mine, theirs = mine.astype(float), theirs.astype(float)
        left_q, left_c = _norms(mine), _norms(theirs)
        start = mine[:STEP].T @ theirs[:STEP]
        bound = start + left_q[1][:, None] * left_c[1][None, :]
        for q in range(len(self.ids)):
            alive = np.flatnonzero(bound[q] >= self.floor[q])
            total = start[q, alive]
            for step, at in enumerate(range(STEP, width, STEP), 2):
                if not len(alive):
                    break
                total = total + mine[at : at + STEP, q] @ theirs[at : at + STEP, alive]
                if self.floor[q] > -np.inf:
                    keep = total + left_q[step, q] * left_c[step, alive] >= self.floor[q]
                    alive, total = alive[keep], total[keep]
            self._merge(q, total, keys[alive])

    def _merge(self, q: int, scores, keys: np.ndarray) -> None:
        other = keys != self.ids[q]
        scores, keys = np.concatenate([self.found[q][0], scores[other]]), np.concatenate([self.found[q][1], keys[other]])
        if len(scores) > 4 * self.k and scores.dtype != object:
            least = np.partition(scores, len(scores) - self.k)[len(scores) - self.k]
            scores, keys = scores[scores >= least], keys[scores >= least]
        order = np.lexsort((keys, -scores))[: self.k] if scores.dtype != object else np.array(sorted(range(len(scores)), key=lambda i: (-scores[i], keys[i]))[: self.k], np.int64)
        self.found[q] = scores[order], keys[order]
        if len(order) == self.k:
            self.floor[q] = float(scores[order[-1]]) - (0 if scores.dtype != object else 1)

    def table(self, group: tuple[int, int]) -> pa.RecordBatch:
        low, high = -(1 << 63), (1 << 63) - 1
        rows = [(*group, q, int(self.ids[q]), int(key), max(low, min(high, int(s)))) for q, (scores, keys) in enumerate(self.found) for s, key in zip(scores, keys)]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(6)], names=["part", "seq", "place", "query_id", "vec_id", "score"])


def _search(k: int):
    def run(batches):
        now, best = None, None
        for b in batches:
            for i in range(b.num_rows):
                row = {n: b.column(n)[i].as_py() for n in b.schema.names}
                if (row["part"], row["seq"]) != now:
                    if best is not None:
                        yield best.table(now)
                    now, best = (row["part"], row["seq"]), Best(*_unpack(row["q_ids"], row["q_columns"]), k)
                best.add(*_unpack(row["ids"], row["columns"]))
        if best is not None:
            yield best.table(now)

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, slices: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest inner products of each query with all
    vectors of another id, ties to the smaller vec_id. Both tables are (vec_id, v
    array<long>), as ``quantised`` makes them. Vectors of different lengths are taken as
    filled up with zeros. Two query rows of one id with different vectors have their own
    ranks each. Scores beyond 64 bits are cut to the range. Empty tables give no row."""
    spark = vectors.sparkSession
    groups = materialize(queries.repartition(max(1, -(-queries.count() // QUERIES))).mapInArrow(_pack(QUERIES), _PACKED), "query_blocks")
    last = groups.agg(F.max("part")).first()[0]
    if last is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    last, slices = F.lit(last).cast("long"), slices or 2 * spark.sparkContext.defaultParallelism
    blocks = vectors.mapInArrow(_pack(CANDIDATES), _PACKED).select("ids", "columns", F.pmod(F.xxhash64("ids"), F.lit(slices)).alias("slice"), F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("part"))
    wide = groups.select("part", "seq", F.col("ids").alias("q_ids"), F.col("columns").alias("q_columns"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slices - 1).cast("long"))).alias("slice"))
    pairs = blocks.join(wide, ["part", "slice"]).sortWithinPartitions("part", "seq")
    short = pairs.select("part", "seq", "q_ids", "q_columns", "ids", "columns").mapInArrow(_search(k), "part long, seq long, place long, query_id long, vec_id long, score long")
    order = Window.partitionBy("part", "seq", "place").orderBy(F.desc("score"), "vec_id")
    ranked = short.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
