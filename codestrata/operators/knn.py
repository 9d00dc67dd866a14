"""Exact nearest neighbours for batches of questions.

The few questions travel to the many vectors: each task keeps a running top-k per question over its own
vectors with block matrix products and sends only those rows on.  Questions are broadcast in batches that fit a
checked budget, one scan of the vectors for each.  Equal question vectors are one question of the scan; where most rows
share their vectors with others, equal vectors are one row of it, with the first ``k`` ids.  Only for that vectors are shuffled.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import counted_join, stage

# Bytes of questions, ids and vectors, that one batch may broadcast.
BROADCAST_BYTES = 32 * 1024 * 1024
# Questions and vectors of one product.
_ROWS, _COLUMNS = 1024, 4096


def _best(frame: pd.DataFrame, k: int) -> pd.DataFrame:
    return frame.sort_values(["row", "dist", "item_id"], kind="stable").groupby("row", sort=False).head(k)


# Squared lengths beyond which single precision isn't used.
_LONGEST = 1e24


def _single(vectors: np.ndarray, last: np.ndarray | float, norm: np.ndarray) -> np.ndarray | None:
    """The vectors with one more element in single precision, or None if a squared length is too large for it or no number."""
    if len(norm) and not norm.max() < _LONGEST:
        return None
    out = np.empty((len(vectors), vectors.shape[1] + 1), dtype=np.float32)
    out[:, :-1], out[:, -1] = vectors, last
    return out


class _Best:
    """Running top-k of a task: a table for each slice of questions.  Products pick candidates; their distances are then summed exactly.

    A product in single precision with the items' half squared lengths in it tells all distances but for the question's own length, so each
    of its values is compared once.  The slack is a bound of its rounding, so no candidate is lost.
    """

    def __init__(self, queries: np.ndarray, k: int):
        self.queries, self.k = queries, k
        self.norm = (queries**2).sum(1)
        self.single = _single(queries, 1.0, self.norm)
        self.kth = np.full(len(queries), np.inf)
        self.tables = [None] * -(-len(queries) // _ROWS)

    def add(self, names: np.ndarray, at: np.ndarray, vectors: np.ndarray) -> None:
        """More vectors with their ids and places; ids settle ties."""
        for low in range(0, len(vectors), _COLUMNS):
            block = vectors[low : low + _COLUMNS]
            norm = (block**2).sum(1)
            single = None if self.single is None else _single(block, norm / -2.0, norm)
            for number in range(len(self.tables)):
                pick = self._pick(number, block, norm) if single is None else self._pick_single(number, single, norm)
                self._keep(number, names[low : low + _COLUMNS], at[low : low + _COLUMNS], block, *pick)

    def _pick(self, number: int, block: np.ndarray, norm: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows and columns of the candidates of a slice, in double precision."""
        first = number * _ROWS
        own = self.norm[first : first + _ROWS]
        approx = self.queries[first : first + _ROWS] @ block.T
        approx *= -2.0
        approx += norm
        approx += own[:, None]
        cut = self.kth[first : first + _ROWS].copy()
        few = ~np.isfinite(cut)
        if len(block) > self.k and few.any():
            cut[few] = np.partition(approx[few], self.k - 1, axis=1)[:, self.k - 1]
        slack = 1e-9 * (1.0 + own + np.abs(np.where(np.isfinite(cut), cut, 0.0)))
        return np.nonzero(approx <= (cut + slack)[:, None])

    def _pick_single(self, number: int, single: np.ndarray, norm: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same by a product in single precision: ``q x - x x / 2``, larger for nearer vectors."""
        first = number * _ROWS
        own = self.norm[first : first + _ROWS]
        nearness = self.single[first : first + _ROWS] @ single.T
        # Rounding of the factors, the products and their sum, twice the bound; the last term is for values too small to be told apart.
        longest = norm.max()
        width = single.shape[1]
        error = np.finfo(np.float32).eps * (width + 8) * (np.sqrt(own * longest) + longest) + 1e-36 * width
        kth = self.kth[first : first + _ROWS]
        least = (own - kth) / 2.0 - error
        few = ~np.isfinite(kth)
        if len(single) > self.k and few.any():
            least[few] = -np.partition(-nearness[few], self.k - 1, axis=1)[:, self.k - 1] - 2.0 * error[few]
        # Rounded down, as the comparison is in single precision.
        least = np.nextafter(least.astype(np.float32), np.float32(-np.inf))
        found = np.flatnonzero(nearness >= least[:, None])
        return found // len(single), found % len(single)

    def _keep(self, number: int, names: np.ndarray, at: np.ndarray, block: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> None:
        first = number * _ROWS
        queries = self.queries[first : first + _ROWS]
        parts = [] if self.tables[number] is None else [self.tables[number]]
        for a in range(0, len(rows), 200_000):
            r, c = rows[a : a + 200_000], cols[a : a + 200_000]
            parts.append(pd.DataFrame({"row": first + r, "item_id": names[c], "at": at[c], "dist": ((queries[r] - block[c]) ** 2).sum(1)}))
        if len(rows):
            best = _best(pd.concat(parts, ignore_index=True), self.k)
            worst = best.groupby("row")["dist"].agg(["max", "size"])
            full = worst.index[worst["size"] == self.k]
            self.kth[full] = worst.loc[full, "max"].to_numpy()
            self.tables[number] = best

    def table(self) -> pd.DataFrame | None:
        found = [t for t in self.tables if t is not None]
        return pd.concat(found, ignore_index=True) if found else None


def _scan(queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int) -> pd.DataFrame:
    """Top-k of one block of vectors: ``row, item_id, dist``."""
    best = _Best(queries, k)
    best.add(ids, np.arange(len(ids)), vectors)
    found = best.table()
    return pd.DataFrame({"row": [], "item_id": [], "dist": []}).astype({"row": int}) if found is None else found.drop(columns="at")


def _matrix(column: pd.Series) -> np.ndarray:
    return np.vstack(column.to_numpy()).astype(np.float64)


def nearest(queries: DataFrame, items: DataFrame, k: int, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``(qid, item_id, dist, rank)``: the ``k`` nearest items per question by squared Euclidean distance.

    Rows without a vector take no part.  ``queries(qid, embedding)``, ``items(item_id, embedding)``; ties go to the smaller item id.
    """
    queries, items = (df.where(F.col("embedding").isNotNull()) for df in (queries, items))
    i_type = dict(items.dtypes)["item_id"]
    order = Window.partitionBy("qid").orderBy("dist", "item_id")
    same = ["hash", "embedding"]
    queries = stage(queries.select("qid", "embedding", F.xxhash64("embedding").alias("hash")))
    asked = stage(queries.select(*same).distinct().withColumn("no", F.monotonically_increasing_id()))
    near = _numbered(asked, _shared_vectors(items, k), k, f"no long, item_ids array<{i_type}>, dist double", broadcast_bytes)
    near = near.select("no", F.explode("item_ids").alias("item_id"), "dist")
    best = F.row_number().over(Window.partitionBy("no").orderBy("dist", "item_id"))
    near = stage(near.withColumn("rank", best).where(F.col("rank") <= k).drop("rank"))
    # A vector that many questions share is dealt over as many tasks as they ask for.
    told = stage(counted_join(queries, asked, same, "qid").select("qid", "no"))
    local = counted_join(told, near, ["no"], "qid").select("qid", "item_id", "dist")
    return local.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _shared_vectors(items: DataFrame, k: int) -> DataFrame:
    """``item_ids, embedding``: one row an item, or a vector with its first ``k`` ids where most items share theirs.

    More ids of one vector can't be among the ``k`` nearest; a vector with one that is, is among the ``k`` nearest vectors by
    distance and first id.  The estimate only chooses between two exact ways.
    """
    items = items.select("item_id", "embedding")
    count = items.agg(F.count(F.lit(1)).alias("rows"), F.approx_count_distinct(F.xxhash64("embedding")).alias("vectors")).first()
    if count["rows"] < 2 * count["vectors"]:
        return items.select(F.array("item_id").alias("item_ids"), "embedding")
    key = ["hash", "embedding"]
    number = F.row_number().over(Window.partitionBy(*key).orderBy("item_id"))
    first = items.withColumn("hash", F.xxhash64("embedding")).withColumn("rn", number).where(F.col("rn") <= k)
    ids = F.transform(F.array_sort(F.collect_list(F.struct("rn", "item_id"))), lambda x: x["item_id"])
    return stage(first.groupBy(*key).agg(ids.alias("item_ids")).select("item_ids", "embedding"))


def _numbered(asked: DataFrame, items: DataFrame, k: int, schema: str, broadcast_bytes: int) -> DataFrame:
    """Candidates ``no, item_ids, dist`` of all tasks for the numbered question vectors, in batches within the budget."""
    size = asked.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.size("embedding").cast("long") * 8 + 8), F.lit(0)).alias("bytes")).first()
    batches = max(1, min(size["n"], -(-size["bytes"] // max(1, broadcast_bytes))))
    if batches == 1:
        return _near_broadcast(asked, items, k, schema)[0]
    # Each batch becomes a table, so the driver holds the questions of one batch only.
    local = None
    for number in range(batches):
        batch = asked.where(F.pmod(F.xxhash64("no"), F.lit(batches)) == number)
        near, shared = _near_broadcast(batch, items, k, schema)
        near = stage(near)
        if shared is not None:
            shared.destroy()
        local = near if local is None else local.unionByName(near)
    return local


def _near_broadcast(asked: DataFrame, items: DataFrame, k: int, schema: str):
    """Candidates of all tasks for one batch of questions, and the broadcast they read (None without questions)."""
    rows = asked.select("no", "embedding").toPandas()
    if rows.empty:
        return asked.sparkSession.createDataFrame([], schema), None
    shared = asked.sparkSession.sparkContext.broadcast((rows["no"].to_numpy(), _matrix(rows["embedding"])))

    def scan(batches):
        numbers, matrix = shared.value
        best, lists = _Best(matrix, k), []
        for pdf in batches:
            if len(pdf):
                ids = pdf["item_ids"].to_list()
                best.add(np.array([x[0] for x in ids], dtype=object if isinstance(ids[0][0], str) else None), np.arange(len(lists), len(lists) + len(ids)), _matrix(pdf["embedding"]))
                lists += ids
        found = best.table()
        if found is not None:
            yield pd.DataFrame({"no": numbers[found["row"]], "item_ids": [lists[i] for i in found["at"]], "dist": found["dist"].to_numpy()})

    return items.select("item_ids", "embedding").mapInPandas(scan, schema), shared
