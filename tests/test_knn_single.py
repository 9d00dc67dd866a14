"""Candidates picked in single precision lose no neighbour; the texts of an index are cut once."""

import numpy as np
import pandas as pd
import pytest

from codestrata.operators import knn
from codestrata.plans import index


def brute(queries, items, k):
    out = set()
    for i, q in enumerate(queries):
        dist = ((q - items) ** 2).sum(1)
        out |= {(i, j) for j in sorted(range(len(items)), key=lambda j: (dist[j], j))[:k]}
    return out


@pytest.mark.parametrize("scale", [1.0, 1e-25, 1e6, 1e13])
@pytest.mark.parametrize("offset", [0.0, 1000.0])
def test_close_vectors(scale, offset, monkeypatch):
    """Vectors that differ by less than single precision tells, far from the origin and near it, in several slices and blocks."""
    monkeypatch.setattr(knn, "_ROWS", 7)
    monkeypatch.setattr(knn, "_COLUMNS", 16)
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(6, 9)) + offset
    items = np.repeat(centres, 20, axis=0) + rng.normal(size=(120, 9)) * 1e-8
    queries = np.vstack([centres, centres + 0.1, items[:8]]) + 1e-9
    items, queries = items * scale, queries * scale
    best = knn._Best(queries, 4)
    for low, high in ((0, 50), (50, 120)):
        best.add(np.arange(low, high), np.arange(low, high), items[low:high])
    assert (best.single is None) == (scale == 1e13)
    table = best.table()
    assert set(zip(table["row"], table["item_id"])) == brute(queries, items, 4)


def test_fewer_items_than_asked_for():
    found = knn._scan(np.eye(3), np.array([4, 9]), np.eye(3)[:2], 5)
    assert sorted(zip(found["row"], found["item_id"])) == [(r, i) for r in range(3) for i in (4, 9)]


def test_numbers_that_single_precision_cannot_hold():
    items = np.array([[1e200, 0.0], [0.0, 1.0], [2.0, 0.0], [np.nan, 0.0], [3.0, 1.0]])
    found = knn._scan(np.array([[0.0, 0.0]]), np.arange(5), items, 2)
    assert found["item_id"].to_list() == [1, 2]


def test_texts_of_an_index_are_cut_once(make_files, monkeypatch):
    """The embedder is fitted on staged chunks, whose plan has no splitter."""
    fitted = []
    fit = index.fit_term_embedder
    monkeypatch.setattr(index, "fit_term_embedder", lambda df, column: fitted.append(df._jdf.queryExecution().optimizedPlan().toString()) or fit(df, column))
    built = index.build_index(make_files({"a/x.py": "def f():\n    return 1\n", "a/y.js": "function g() {}\n"}))
    assert len(fitted) == 1 and "ArrowEvalPython" not in fitted[0]
    assert isinstance(built.chunks.select("embedding").toPandas(), pd.DataFrame)
