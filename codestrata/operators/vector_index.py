"""Approximate nearest neighbours over large vector tables: coarse cells, one partition of the stored table each.

``build`` learns cell centres from a bounded sample, gives every vector to its nearest centre and writes the vectors partitioned by
cell.  ``search`` ranks the cells per question, reads only the partitions that some question of the batch asks for, and
measures exact distances there.  Questions travel to the vectors in batches of near ones, within a byte budget; vectors
are never shuffled.  With all cells probed the answer is exact.  A cell may hold any share of the vectors: its rows are
spread over files when written and over tasks when read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import stage
from .knn import BROADCAST_BYTES, _best, _matrix, _scan

# Bounds of what the driver holds: vectors to learn from, their bytes, and centres.
SAMPLE_ROWS, SAMPLE_BYTES, MOST_CELLS = 50_000, 64 << 20, 4096
ROWS_A_FILE = 500_000


def _nearest(vectors: np.ndarray, centres: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` nearest centres of each vector, nearest first; ties go to the smaller number."""
    out = []
    for at in range(0, len(vectors), 4096):
        part = vectors[at : at + 4096]
        dist = ((centres**2).sum(1)[None, :] - 2.0 * (part @ centres.T)) + (part**2).sum(1)[:, None]
        out.append(np.argsort(np.round(dist, 9), axis=1, kind="stable")[:, :n])
    return np.concatenate(out) if out else np.zeros((0, n), np.int64)


def _learn(sample: np.ndarray, cells: int, rounds: int) -> np.ndarray:
    """Centres: the first ``cells`` vectors of the sample, moved to the means of their vectors ``rounds`` times."""
    centres = sample[:cells].copy()
    for _ in range(rounds):
        own = _nearest(sample, centres, 1)[:, 0]
        sums = np.zeros_like(centres)
        np.add.at(sums, own, sample)
        size = np.bincount(own, minlength=len(centres))
        centres[size > 0] = sums[size > 0] / size[size > 0][:, None]
    return centres


@dataclass
class VectorIndex:
    """A stored index: ``items`` (item_id, embedding, cell) partitioned by cell, and the cells' centres."""

    spark: SparkSession
    path: str
    centres: np.ndarray
    id_type: str

    @property
    def items(self) -> DataFrame:
        # The schema is told, as an index of no vectors has no file to take it from.
        return self.spark.read.schema(f"item_id {self.id_type}, embedding array<double>, cell int").parquet(f"{self.path}/items")

    def cell_sizes(self) -> DataFrame:
        return self.items.groupBy("cell").agg(F.count(F.lit(1)).alias("rows"))


def build(items: DataFrame, path: str, cells: int | None = None, rounds: int = 10, sample_rows: int = SAMPLE_ROWS) -> VectorIndex:
    """Write an index of ``items(item_id, embedding)`` under ``path``; rows without a vector are left out.

    Centres are learnt from the ``sample_rows`` vectors of smallest hash of their id, fewer if they pass ``SAMPLE_BYTES``; every
    vector is stored.  ``cells`` is twice the root of the number of vectors unless given, at most ``MOST_CELLS``.
    """
    spark = items.sparkSession
    items = items.select("item_id", F.col("embedding").cast("array<double>").alias("embedding")).where("embedding is not null")
    told = items.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("embedding")).alias("dims"), F.min(F.size("embedding")).alias("least")).first()
    if told["n"] and told["dims"] != told["least"]:
        raise ValueError(f"vectors of different lengths: {told['least']} to {told['dims']}")
    dims = max(1, told["dims"] or 1)
    rows = max(1, min(sample_rows, SAMPLE_BYTES // (8 * dims)))
    cells = max(1, min(cells or 2 * math.isqrt(told["n"]), rows, told["n"] or 1, MOST_CELLS))
    drawn = items.orderBy(F.md5(F.col("item_id").cast("string")), "item_id").limit(rows if rounds else cells)
    sample = drawn.select("embedding").toPandas()["embedding"]
    centres = _learn(_matrix(sample), cells, rounds) if len(sample) else np.zeros((0, dims))
    shared = spark.sparkContext.broadcast(centres)

    def to_cells(batches):
        for pdf in batches:
            if len(pdf):
                yield pdf.assign(cell=_nearest(_matrix(pdf["embedding"]), shared.value, 1)[:, 0].astype(np.int32))

    id_type = dict(items.dtypes)["item_id"]
    placed = stage(items.mapInPandas(to_cells, f"item_id {id_type}, embedding array<double>, cell int"))
    # One file a cell, more for large cells; one row a cell here, so the table is small by construction.
    files = placed.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / F.lit(ROWS_A_FILE)).cast("int").alias("files"))
    dealt = placed.join(F.broadcast(files), "cell").withColumn("file", F.pmod(F.xxhash64("item_id"), F.col("files")))
    dealt.repartition("cell", "file").select("item_id", "embedding", "cell").write.mode("overwrite").partitionBy("cell").parquet(f"{path}/items")
    # A row beside the centres tells the type of the ids, also where there is no vector.
    centre_rows = [(-1, [], id_type), *((i, [float(x) for x in c], id_type) for i, c in enumerate(centres))]
    spark.createDataFrame(centre_rows, "cell int, centre array<double>, id_type string").write.mode("overwrite").parquet(f"{path}/centres")
    return VectorIndex(spark, path, centres, id_type)


def open_index(spark: SparkSession, path: str) -> VectorIndex:
    """An index written before."""
    rows = spark.read.parquet(f"{path}/centres").orderBy("cell").toPandas()
    centres = rows["centre"][1:]
    return VectorIndex(spark, path, _matrix(centres) if len(centres) else np.zeros((0, 1)), rows["id_type"].iloc[0])


def with_cells(index: VectorIndex, queries: DataFrame, probes: int) -> DataFrame:
    """Questions with the ``probes`` cells nearest to each, nearest first."""
    shared = index.spark.sparkContext.broadcast(index.centres)
    queries = queries.select("qid", F.col("embedding").cast("array<double>").alias("embedding")).where("embedding is not null")

    def ranked(batches):
        for pdf in batches:
            if len(pdf):
                near = _nearest(_matrix(pdf["embedding"]), shared.value, probes)
                yield pdf.assign(cells=list(near.astype(np.int32)))

    q_type = dict(queries.dtypes)["qid"]
    return queries.mapInPandas(ranked, f"qid {q_type}, embedding array<double>, cells array<int>")


def _batches(counts: list[tuple[int, int]], most: int) -> list:
    """Conditions that cut questions into batches of about ``most``: neighbouring first cells together, a large one in parts."""
    out, held, rows = [], [], 0
    for cell, n in counts:
        if held and rows + n > most:
            out.append(F.col("cells")[0].isin(held))
            held, rows = [], 0
        parts = -(-n // most)
        if parts > 1:
            out += [(F.col("cells")[0] == cell) & (F.pmod(F.xxhash64("qid"), F.lit(parts)) == p) for p in range(parts)]
        else:
            held.append(cell)
            rows += n
    return out + ([F.col("cells")[0].isin(held)] if held else [])


def search(index: VectorIndex, queries: DataFrame, k: int, probes: int, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``(qid, item_id, dist, rank)``: the ``k`` nearest items found per question in its ``probes`` nearest cells.

    ``dist`` is the exact squared distance; ties go to the smaller item id.  Questions without a vector take no part.
    """
    spark, items = index.spark, index.items
    if not len(index.centres):  # no vectors
        none = spark.createDataFrame([], f"qid {dict(queries.dtypes)['qid']}, item_id {index.id_type}, dist double")
        return none.withColumn("rank", F.lit(0))
    probes = max(1, min(probes, len(index.centres)))
    asked = stage(with_cells(index, queries, probes))
    schema = f"qid {dict(asked.dtypes)['qid']}, item_id {dict(items.dtypes)['item_id']}, dist double"
    counts = asked.groupBy(F.col("cells")[0].alias("cell")).agg(F.count(F.lit(1)).alias("n")).orderBy("cell").collect()  # a row a cell
    size = 8 * index.centres.shape[1] + 4 * probes + 64
    local = None
    for condition in _batches([(r["cell"], r["n"]) for r in counts], max(1, broadcast_bytes // size)):
        near = stage(_search_batch(spark, items, asked.where(condition), k, schema))
        local = near if local is None else local.unionByName(near)
    if local is None:
        local = spark.createDataFrame([], schema)
    order = Window.partitionBy("qid").orderBy("dist", "item_id")
    return local.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def cells_read(asked: DataFrame) -> list[int]:
    """Cells that a batch of questions asks for; at most ``MOST_CELLS``."""
    return sorted(r[0] for r in asked.select(F.explode("cells")).distinct().collect())


def _search_batch(spark: SparkSession, items: DataFrame, asked: DataFrame, k: int, schema: str) -> DataFrame:
    rows = asked.toPandas()
    wanted = np.vstack(rows["cells"].to_numpy())
    by_cell = {int(c): np.flatnonzero((wanted == c).any(axis=1)) for c in np.unique(wanted)}
    shared = spark.sparkContext.broadcast((rows["qid"].to_numpy(), _matrix(rows["embedding"]), by_cell))

    def scan(batches):
        qids, matrix, cells = shared.value
        best = None
        for pdf in batches:
            found = []
            for cell, part in pdf.groupby("cell"):
                asking = cells[int(cell)]
                near = _scan(matrix[asking], part["item_id"].to_numpy(), _matrix(part["embedding"]), k)
                found.append(near.assign(row=asking[near["row"]]))
            if found:
                best = _best(pd.concat(found if best is None else [best, *found], ignore_index=True), k)
        if best is not None:
            yield pd.DataFrame({"qid": qids[best["row"]], "item_id": best["item_id"].to_numpy(), "dist": best["dist"].to_numpy()})

    return items.where(F.col("cell").isin(sorted(by_cell))).select("item_id", "embedding", "cell").mapInPandas(scan, schema)


def share_read(index: VectorIndex, queries: DataFrame, probes: int) -> float:
    """Distances measured per question, as a share of all vectors."""
    sizes = {r["cell"]: r["rows"] for r in index.cell_sizes().collect()}
    probed = with_cells(index, queries, probes).select(F.explode("cells").alias("cell")).groupBy("cell").count().collect()
    asked, total = queries.where("embedding is not null").count(), sum(sizes.values())
    return sum(sizes.get(r["cell"], 0) * r["count"] for r in probed) / max(1, asked * total)
