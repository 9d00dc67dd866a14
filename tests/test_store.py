"""The stored index: read back, brought up to date by changed files alone."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from codestrata.operators import entities
from codestrata.plans import index, store

FILES = {
    "a/one.py": "import os\ndef run(x):\n    return os.path.join(x)\n",
    "a/two.py": "class Two:\n    def go(self):\n        return 1\n",
    "b/three.js": "function load(a) {\n  return a\n}\n",
    "b/bad.py": "def (:\n",
}


def rows(df, *columns):
    return sorted((tuple(str(v) for v in r) for r in df.select(*columns).collect()))


def same(spark, path, corpus, files):
    """The stored tables equal those built anew."""
    got, want = store.read_index(spark, path, corpus), index.build_index(files, index.hashed_embedder(32))
    assert rows(got.entities, "file_path", "pos", "name", "type", "content") == rows(want.entities, "file_path", "pos", "name", "type", "content")
    assert rows(got.edges, "source", "target", "file_path") == rows(want.edges, "source", "target", "file_path")
    assert rows(got.documents, "doc_id", "content") == rows(want.documents, "doc_id", "content")
    assert rows(got.chunks, "chunk_id", "text", "embedding") == rows(want.chunks, "chunk_id", "text", "embedding")
    return got


def test_only_changed_files_are_parsed(spark, make_files, tmp_path, monkeypatch):
    path, embed = str(tmp_path / "index"), index.hashed_embedder(32)
    parsed = []
    real = entities.entity_files
    monkeypatch.setattr(entities, "entity_files", lambda files: parsed.append(sorted(r["path"] for r in files.select("path").collect())) or real(files))

    def update(files, corpus="one"):
        parsed.clear()
        told = store.update_index(files, path, corpus, embed, buckets=4)
        return told, list(parsed)

    first = make_files(FILES)
    assert update(first) == ({"new": 4, "changed": 0, "gone": 0, "unchanged": 0}, [sorted(FILES)])
    same(spark, path, "one", first)
    assert update(first) == ({"new": 0, "changed": 0, "gone": 0, "unchanged": 4}, [])

    other = make_files({"a/one.py": "x = 1\n"})
    assert update(other, "two")[0]["new"] == 1  # another corpus in the same tables
    untouched = {r["f"] for r in spark.read.parquet(f"{path}/chunks").where("corpus_id = 'two'").select(F.input_file_name().alias("f")).collect()}

    changed = make_files({k: v for k, v in FILES.items() if k != "b/three.js"} | {"a/two.py": "def two():\n    return 2\n", "c/new.py": "import sys\n"})
    told, touched = update(changed)
    assert told == {"new": 1, "changed": 1, "gone": 1, "unchanged": 2} and touched == [["a/two.py", "c/new.py"]]
    got = same(spark, path, "one", changed)
    assert "b/three.js" not in {r["source"] for r in got.documents.collect()}
    assert rows(store.read_index(spark, path, "two").entities, "name") == []
    assert untouched == {r["f"] for r in spark.read.parquet(f"{path}/chunks").where("corpus_id = 'two'").select(F.input_file_name().alias("f")).collect()}

    assert update(make_files({}))[0] == {"new": 0, "changed": 0, "gone": 4, "unchanged": 0}
    assert store.read_index(spark, path, "one").chunks.count() == 0
    assert update(first)[0]["new"] == 4
    same(spark, path, "one", first)


def test_update_that_broke_off_is_repeated(spark, make_files, tmp_path, monkeypatch):
    path, embed = str(tmp_path / "index"), index.hashed_embedder(32)
    store.update_index(make_files(FILES), path, "one", embed, buckets=2)
    real, done = store._write, []

    def failing(rows, path, name, corpus):
        if name == "chunks":
            raise RuntimeError("lost")
        done.append(name)
        real(rows, path, name, corpus)

    files = make_files(FILES | {"a/one.py": "import re\n"})
    monkeypatch.setattr(store, "_write", failing)
    with pytest.raises(RuntimeError):
        store.update_index(files, path, "one", embed, buckets=2)
    monkeypatch.setattr(store, "_write", real)
    assert done == ["parsed", "edges"]
    assert store.update_index(files, path, "one", embed, buckets=2)["changed"] == 1
    same(spark, path, "one", files)


def test_no_index(spark, tmp_path):
    with pytest.raises(ValueError, match="no index"):
        store.read_index(spark, str(tmp_path / "none"), "one")


def test_model_of_the_caller(spark):
    """Vectors of a model that the caller brings equal those of a plain loop."""

    def make():
        weights = np.arange(1, 4, dtype=np.float32)

        def predict(texts):
            return np.array([[len(t) * weights[0], t.count("a") * weights[1], weights[2]] for t in texts], dtype=np.float32)

        return predict

    texts = ["", "a", "banana", "é" * 300] * 40
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, body string").repartition(3)
    found = {r["i"]: list(r["embedding"]) for r in index.model_embedder(make, batch_size=7)(df, "body").collect()}
    assert found == {i: [float(len(t)), 2.0 * t.count("a"), 3.0] for i, t in enumerate(texts)}
