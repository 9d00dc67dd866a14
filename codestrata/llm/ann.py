"""Approximate nearest neighbours with a forest of hash prefixes.

Each tree gives every vector a hash string of 64 bits, the signs of random projections (less their value for the centre of
the first vectors of the block).  Rows are dealt into blocks of at most ``BLOCK_ROWS``; a block keeps, for each tree, its
sorted strings and the rows they belong to.  A query finds in each tree the strings with the longest common prefix and then
ascends in all trees at once, a bit at a time, until the rows below the prefixes number ``wanted_rows`` of the block, a share
that falls with its rows; all of these rows are candidates, ranked by their exact Euclidean distance in double precision.

The index is written once, all rows are in it.  The query set is taken in batches of ``QUERY_ROWS`` rows and ``QUERY_BYTES``
bytes at most that are sent to the blocks, each task keeping its best ``k`` per query over all its blocks; a last ranking merges the tasks.

Vectors that are null, zero, of another length than most, or hold null or non-finite components take no part; a null id
neither.  A query is not its own neighbour; with fewer than ``k`` candidates all are returned.  Ties go to the smaller id.
Rows that repeat an id are told apart only by their vectors; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import documents, staged

TREES = 64
BITS = 64
# Rows below the prefixes, summed over the trees: this share of a block of so many rows, less of a larger one by the power.
SHARE, SHARE_ROWS, FALL = 0.6, 2000, 0.2
MOST_SHARE = 0.8
BLOCK_ROWS = 16_384
QUERY_ROWS = 50_000
QUERY_BYTES = 64 << 20
SEED = 20_240_101
INDEX = "block_rows int, ids binary, vectors binary, centre binary, labels binary, places binary"


def vectors(items: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """``id long, vec array<double>`` of the rows that take part."""
    rows = documents(items, id_column, vector_column).toDF("id", "vec")
    rows = rows.select(F.col("id").cast("long").alias("id"), F.col("vec").cast("array<double>").alias("vec")).where("id is not null and size(vec) > 0")
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return rows.where(finite & F.exists("vec", lambda x: x != 0))


def width_of(rows: DataFrame) -> int:
    """The most frequent length of the vectors (the smaller on a tie; 1 if there are none)."""
    found = rows.groupBy(F.size("vec").alias("width")).count().orderBy(F.desc("count"), "width").first()
    return found["width"] if found else 1


def wanted_rows(rows: int, k: int) -> int:
    """Rows that the trees together are to hold below a query's prefixes before the ascent ends."""
    return max(4 * k, int(min(MOST_SHARE, SHARE * (SHARE_ROWS / max(rows, 1)) ** FALL) * rows))


def planes(width: int, trees: int = TREES) -> np.ndarray:
    return np.random.default_rng(SEED).standard_normal((width, trees * BITS))


def labels_of(x: np.ndarray, centre: np.ndarray, normals: np.ndarray, trees: int) -> np.ndarray:
    """Hash strings ``(trees, rows)`` as unsigned 64-bit numbers, the first bit on top."""
    out = np.empty((trees, len(x)), np.uint64)
    for low in range(0, len(x), 2048):
        bits = ((x[low : low + 2048] - centre) @ normals > 0).reshape(-1, trees, BITS)
        out[:, low : low + 2048] = np.packbits(bits, axis=2).view(">u8")[:, :, 0].astype(np.uint64).T
    return out


def build(rows: DataFrame, width: int, trees: int = TREES, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The index: one row for each block, staged."""

    def run(batches):
        import pyarrow as pa

        normals = planes(width, trees)
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def block():
            ids, x = (np.concatenate(c) for c in zip(*held, strict=True))
            held.clear()
            centre = x[:4096].mean(axis=0)
            labels = labels_of(x, centre, normals, trees)
            places = np.argsort(labels, axis=1, kind="stable")
            labels = np.take_along_axis(labels, places, axis=1)
            parts = (ids.astype("<i8"), x.astype("<f8"), centre, labels, places.astype("<i4"))
            return pa.RecordBatch.from_arrays([pa.array([len(ids)], pa.int32()), *(pa.array([p.tobytes()], pa.binary()) for p in parts)], names=[c.split()[0] for c in INDEX.split(", ")])

        n = 0
        for batch in batches:
            ids = batch.column(0).to_numpy()
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            for low in range(0, len(ids), block_rows):
                part = ids[low : low + block_rows], x[low : low + block_rows]
                if n + len(part[0]) > block_rows:
                    yield block()
                    n = 0
                held.append(part)
                n += len(part[0])
        if held:
            yield block()

    return staged(rows.where(F.size("vec") == width).mapInArrow(run, INDEX), "forest")


class Block:
    """One block of the index in memory."""

    def __init__(self, row: dict, width: int, trees: int):
        n = row["block_rows"]
        self.ids = np.frombuffer(row["ids"], "<i8")
        self.x = np.frombuffer(row["vectors"], "<f8").reshape(n, width)
        self.centre = np.frombuffer(row["centre"], "<f8")
        self.labels = np.frombuffer(row["labels"], np.uint64).reshape(trees, n)
        self.places = np.frombuffer(row["places"], "<i4").reshape(trees, n)
        self.trees = trees

    def ranges(self, labels: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """In each tree, the range of strings that share the query's first ``depth`` bits: ``(trees, queries)``."""
        low = np.empty(labels.shape, np.int64)
        high = np.empty(labels.shape, np.int64)
        shift = (BITS - depth).astype(np.uint64)
        deep = depth > 0
        for t in range(self.trees):
            prefix = np.where(deep, labels[t] >> np.where(deep, shift, 0) << np.where(deep, shift, 0), np.uint64(0))
            last = np.where(deep, prefix + ((np.uint64(1) << np.where(deep, shift, 0)) - np.uint64(1)), np.uint64((1 << 64) - 1))
            low[t] = np.searchsorted(self.labels[t], prefix)
            high[t] = np.searchsorted(self.labels[t], last, side="right")
        return low, high

    def ascend(self, labels: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
        """The deepest common depth at which the trees together hold ``wanted`` rows (0 if none does), as ranges."""
        floor, top = np.zeros(labels.shape[1], np.int64), np.full(labels.shape[1], BITS, np.int64)
        while (floor < top).any():  # the rows below the prefixes only grow on the way up, so the depth can be bisected
            middle = (floor + top + 1) // 2
            low, high = self.ranges(labels, middle)
            enough = (high - low).sum(axis=0) >= wanted
            floor, top = np.where(enough, middle, floor), np.where(enough, top, middle - 1)
        return self.ranges(labels, floor)

    def nearest(self, ids: np.ndarray, x: np.ndarray, normals: np.ndarray, k: int):
        """For each query: ids and distances of its best ``k`` among its candidates."""
        labels = labels_of(x, self.centre, normals, self.trees)
        low, high = self.ascend(labels, wanted_rows(len(self.ids), k))
        seen = np.zeros(len(self.ids), bool)
        for q in range(len(ids)):
            seen[:] = False
            for t in range(self.trees):
                seen[self.places[t, low[t, q] : high[t, q]]] = True
            rows = np.flatnonzero(seen & (self.ids != ids[q]))
            gap = self.x[rows] - x[q]
            d = np.sqrt(np.einsum("ij,ij->i", gap, gap))
            if len(d) > k:
                keep = np.flatnonzero(d <= np.partition(d, k - 1)[k - 1])  # with all ties of the last
                rows, d = rows[keep], d[keep]
            order = np.lexsort((self.ids[rows], d))[:k]
            yield self.ids[rows][order], d[order]


def search(index: DataFrame, queries: DataFrame, width: int, k: int = 10, trees: int = TREES, query_rows: int = QUERY_ROWS) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest found of each query."""
    spark = index.sparkSession
    queries = queries.where(F.size("vec") == width)
    n, query_rows = queries.count(), max(1, min(query_rows, QUERY_BYTES // (8 * (width + 1))))
    batches_of = max(1, -(-n // query_rows))
    found = None
    for number in range(batches_of):
        # A batch of the query set, in size bounded by ``query_rows`` and their bytes (up to the evenness of a hash).
        part = queries if batches_of == 1 else queries.where(F.pmod(F.xxhash64("id"), F.lit(batches_of)) == number)
        rows = part.toArrow()
        ids = rows.column("id").to_numpy()
        x = rows.column("vec").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
        shared = spark.sparkContext.broadcast((ids, x))

        def run(blocks, shared=shared):
            import pyarrow as pa

            ids, x = shared.value
            normals = planes(width, trees)
            best_ids = np.full((len(ids), k), np.iinfo(np.int64).max)
            best = np.full((len(ids), k), np.inf)
            for batch in blocks:
                for row in batch.to_pylist():
                    block = Block(row, width, trees)
                    for q, (near, d) in enumerate(block.nearest(ids, x, normals, k)):
                        near, d = np.append(best_ids[q], near), np.append(best[q], d)
                        order = np.lexsort((near, d))[:k]
                        best_ids[q], best[q] = near[order], d[order]
            has = np.isfinite(best)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, has.sum(axis=1))), pa.array(best_ids[has]), pa.array(best[has])], names=["query_id", "vec_id", "score"])

        one = index.mapInArrow(run, "query_id long, vec_id long, score double")
        found = one if found is None else found.union(one)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def neighbours(items: DataFrame, is_query, id_column: str = "vec_id", vector_column: str = "embedding", k: int = 10) -> DataFrame:
    """Index all rows and search for those that ``is_query`` (a condition on ``id``) picks."""
    rows = vectors(items, id_column, vector_column)
    width = width_of(rows)
    return search(build(rows, width), rows.where(is_query), width, k)
