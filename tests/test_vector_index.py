"""The stored cells against the exact search."""

import numpy as np
import pytest

from codestrata.operators import knn, vector_index
from codestrata.session import stage_path


def vectors(n, dims, seed, groups=40):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, dims))
    return centres[rng.integers(groups, size=n)] + 0.35 * rng.normal(size=(n, dims))


def table(spark, x, name):
    return spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], f"{name} long, embedding array<float>")


@pytest.fixture(scope="module")
def data(spark):
    x = vectors(4000, 16, 1)
    x[100:400] = x[7]  # many equal vectors, which lie in one cell
    items = table(spark, x, "item_id").cache()
    return items, table(spark, vectors(60, 16, 1)[:60] + 0.01, "qid").cache()


def rows(df):
    return sorted((r["qid"], r["rank"], r["item_id"], round(r["dist"], 9)) for r in df.collect())


def test_all_cells_give_the_exact_answer(spark, data):
    items, queries = data
    index = vector_index.build(items, stage_path(spark), cells=20, rounds=3)
    assert rows(vector_index.search(index, queries, 5, 20)) == rows(knn.nearest(queries, items, 5))


def test_few_cells_find_nearly_all_and_read_little(spark, data):
    items, queries = data
    index = vector_index.build(items, stage_path(spark), cells=64)
    probes = 6
    found = rows(vector_index.search(index, queries, 10, probes))
    exact = rows(knn.nearest(queries, items, 10))
    recall = len({(q, i) for q, _, i, _ in found} & {(q, i) for q, _, i, _ in exact}) / len(exact)
    share = vector_index.share_read(index, queries, probes)
    assert recall >= 0.9 and share <= 0.3, (recall, share)


def test_only_probed_partitions_are_read(spark, data):
    items, queries = data
    index = vector_index.open_index(spark, vector_index.build(items, stage_path(spark), cells=64, rounds=2).path)
    one = queries.where("qid = 3")
    cells = vector_index.cells_read(vector_index.with_cells(index, one, 3))
    assert len(cells) == 3
    plan = vector_index._search_batch(spark, index.items, vector_index.with_cells(index, one, 3), 4, "qid long, item_id long, dist double")
    text = plan._jdf.queryExecution().toString()
    filters = text[text.index("PartitionFilters: [") :].split("]")[0]
    assert all(str(c) in filters for c in cells)
    sizes = {r["cell"]: r["rows"] for r in index.cell_sizes().collect()}
    assert 0 < sum(sizes[c] for c in cells) < 0.3 * items.count()


def test_batches_of_questions(spark, data):
    items, queries = data
    index = vector_index.build(items, stage_path(spark), cells=16, rounds=2)
    whole = rows(vector_index.search(index, queries, 5, 4))
    assert rows(vector_index.search(index, queries, 5, 4, broadcast_bytes=900)) == whole


def test_odd_rows(spark):
    items = spark.createDataFrame([(1, [0.0, 0.0]), (2, None), (3, [1.0, 0.0]), (4, [1.0, 0.0])], "item_id long, embedding array<double>")
    queries = spark.createDataFrame([(1, [1.0, 0.0]), (2, None)], "qid long, embedding array<double>")
    index = vector_index.build(items, stage_path(spark), cells=9)
    assert rows(vector_index.search(index, queries, 2, 9)) == [(1, 1, 3, 0.0), (1, 2, 4, 0.0)]
    none = vector_index.build(items.where("false"), stage_path(spark))
    assert rows(vector_index.search(none, queries, 2, 1)) == []
    assert rows(vector_index.search(vector_index.open_index(spark, none.path), queries, 2, 1)) == []
    assert rows(vector_index.search(index, queries.where("false"), 2, 1)) == []
    with pytest.raises(ValueError, match="different lengths"):
        vector_index.build(spark.createDataFrame([(1, [0.0]), (2, [0.0, 1.0])], "item_id long, embedding array<double>"), stage_path(spark))
