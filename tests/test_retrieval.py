import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from codestrata.operators import entities, knn, retrieval


def _vectors(rng, n, d=8, copies=0):
    rows = [(i, [float(np.float32(rng.gauss(0, 1))) for _ in range(d)]) for i in range(n)]
    return rows + [(n + j, rows[0][1]) for j in range(copies)]


@pytest.mark.parametrize("budget", [knn.BROADCAST_BYTES, 200, 0])
def test_nearest_is_exact(spark, budget):
    rng = random.Random(11)
    items, queries = _vectors(rng, 120, copies=40), _vectors(rng, 7) + [(99, None)]
    queries[-1] = (99, items[0][1])  # a question that equals a vector held by a quarter of the rows
    q = spark.createDataFrame(queries, "qid bigint, embedding array<float>")
    i = spark.createDataFrame(items, "item_id bigint, embedding array<float>").repartition(5)
    got = sorted((r["qid"], r["rank"], r["item_id"]) for r in knn.nearest(q, i, 5, budget).collect())
    want = []
    for qid, v in queries:
        d = sorted((float(((np.array(v) - np.array(x)) ** 2).sum()), n) for n, x in items)[:5]
        want += [(qid, r + 1, n) for r, (_, n) in enumerate(d)]
    assert got == sorted(want)


def test_equal_vectors_are_one_row_of_the_scan(spark):
    """Many items and questions on few vectors: the scan sees each vector once, the result has every question with its first ids."""
    items = [(f"i{n:04d}", [float(n % 4), 1.0]) for n in range(400)] + [(None, [9.0, 9.0]), ("i9", None)]
    i = spark.createDataFrame(items, "item_id string, embedding array<float>").repartition(5)
    shared = knn._shared_vectors(i.where("embedding is not null"), 3)
    assert shared.count() == 5 and shared.agg(F.max(F.size("item_ids"))).first()[0] == 3
    q = spark.createDataFrame([(n, [float(n % 2), 1.0]) for n in range(50)], "qid bigint, embedding array<float>")
    got = sorted((r["qid"], r["rank"], r["item_id"]) for r in knn.nearest(q, i, 3).collect())
    assert got == sorted((n, r + 1, f"i{n % 2 + 4 * r:04d}") for n in range(50) for r in range(3))


def test_many_questions_meet_many_vectors_in_slices(spark, monkeypatch):
    monkeypatch.setattr(knn, "_ROWS", 7)
    monkeypatch.setattr(knn, "_COLUMNS", 11)
    rng = np.random.default_rng(5)
    x = rng.integers(0, 4, (90, 3)).astype(float)  # many ties
    best = knn._Best(x[:40], 6)
    best.add(np.arange(90), np.arange(90), x)
    found = best.table()
    for row in range(40):
        d = ((x - x[row]) ** 2).sum(1)
        assert found[found["row"] == row]["item_id"].tolist() == np.lexsort((np.arange(90), d))[:6].tolist()


def test_long_ids_count_in_the_budget(spark):
    q = spark.createDataFrame([("q" * 500 + str(i), [float(i)]) for i in range(4)], "qid string, embedding array<double>")
    i = spark.createDataFrame([(n, [float(n)]) for n in range(9)], "item_id bigint, embedding array<double>")
    found = knn.nearest(q, i, 1, 1100)
    assert len(found.inputFiles()) > 0  # written batch by batch
    assert sorted((r["qid"][500:], r["item_id"]) for r in found.collect()) == [(str(n), n) for n in range(4)]


def test_nearest_without_questions_or_with_few_items(spark):
    q = spark.createDataFrame([(1, [0.0, 1.0])], "qid bigint, embedding array<float>")
    i = spark.createDataFrame([("a", [0.0, 1.0])], "item_id string, embedding array<float>")
    assert knn.nearest(q, i, 3).collect()[0]["item_id"] == "a"
    assert knn.nearest(q.where("false"), i, 3).count() == 0


def test_filename_in(spark):
    cases = {"what is in app.jsx?": "app.js", "see file notes.md now": "notes.md", "IN Data.csv": "Data.csv", "from x.rs": "x.rs", "file a.b c.PY": "c.PY", "none": None}
    df = spark.createDataFrame([(q,) for q in cases], "question string")
    got = {r["question"]: r["f"] for r in df.select("question", retrieval.filename_in(F.col("question")).alias("f")).collect()}
    assert got == cases


def test_canned_question(spark):
    df = spark.createDataFrame([("security",), ("nonsense",), (None,)], "t string")
    got = [r[0] for r in df.select(retrieval.canned_question(F.col("t"))).collect()]
    assert got[0].startswith("What security") and got[1] == got[2] == retrieval.CANNED_QUESTIONS["all"]


@pytest.mark.parametrize(
    "lengths, budget, want",
    [
        ([1500, 600], 2000, [1500, 503]),
        ([1500, 450, 300], 2000, [1500, 450]),
        ([1500, 450, 300, 10], 2000, [1500, 450]),
        ([2000, 5], 2000, [2000]),
        ([2500], 2000, [2003]),
        ([1899, 500, 20], 2000, [1899, 104]),
        ([1900, 500], 2000, [1900]),
    ],
)
def test_budget(spark, lengths, budget, want):
    df = spark.createDataFrame([(1, i, "x" * n) for i, n in enumerate(lengths)], "g int, i int, t string")
    got = retrieval.within_budget(df, "g", ["i"], "t", budget).orderBy("part_no").collect()
    assert [len(r["t"]) for r in got] == want


def _chunks(spark, rows):
    """(source, filename, type, doc_no, chunk_no)"""
    return spark.createDataFrame(rows, "source string, filename string, type string, doc_no int, chunk_no int").withColumn("text", F.lit("t"))


def test_filename_hits(spark):
    rows = [("p/a.py", "a.py", "code_file", 0, c) for c in range(5)] + [("p/a.py", "a.py", "entity", d, 0) for d in range(1, 8)]
    rows += [("p/b.py", "b.py", "entity" if d % 2 else "code_file", d, 0) for d in range(10)]
    rows += [(f"q{i:04d}/__init__.py", "__init__.py", "code_file", 0, 0) for i in range(500)]
    hits = retrieval.by_filename(_chunks(spark, rows), spark.createDataFrame([("a.py",), ("b.py",), ("__init__.py",)], "filename string"))
    got = {}
    for r in hits.orderBy("filename", "hit_no").collect():
        got.setdefault(r["filename"], []).append((r["type"], r["doc_no"], r["chunk_no"]))
    assert got["a.py"] == [("entity", d, 0) for d in range(1, 8)] + [("code_file", 0, 0), ("code_file", 0, 1)]
    assert [d for _, d, _ in got["b.py"]] == list(range(10))
    assert len(got["__init__.py"]) == 2
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def _naive_related(question, ents):
    """(name, type, file, pos) rows in file order."""
    q = question.lower()
    found = [e for e in ents if q in e[0].lower() or e[0].lower() in q]
    if "function" in q:
        found += [e for e in ents if e[1] == "function"]
    elif "class" in q:
        found += [e for e in ents if e[1] == "class"]
    seen, out = set(), []
    for e in found:
        if e[0] not in seen:
            seen.add(e[0])
            out.append(e)
    return out[:3]


def test_related_entities(spark):
    rng = random.Random(3)
    names = ["load", "Load", "go", "view", "x", "loader", "classify", "função", "a_b", "function_map"]
    ents = [(rng.choice(names), rng.choice(["function", "class", "import"]), f"f{i // 4:02d}.py", i % 4) for i in range(40)]
    df = spark.createDataFrame(ents, "name string, type string, file_path string, pos int").select(
        "file_path", "pos", "name", "type", F.lit(1).alias("line_number"), F.lit("c").alias("content"), F.lit(None).cast("string").alias("docstring"),
        F.array().cast("array<string>").alias("parameters"), F.array().cast("array<string>").alias("dependencies"),
    )
    texts = ["", "go", "Where is LOADER used?", "longest function please", "a class of função", "view", "zzz", "oa", "x" * 50, "function and class load"]
    q = spark.createDataFrame(list(enumerate(texts)), "qid int, question string")
    got = {}
    for r in retrieval.related_entities(q, df).orderBy("qid", "related_no").collect():
        got.setdefault(r["qid"], []).append((r["name"], r["type"], r["file_path"], r["pos"]))
    for i, t in enumerate(texts):
        assert got.get(i, []) == _naive_related(t, ents), t


def test_contexts_sources_and_prompts(spark):
    rows = [
        (1, "similar", 1, "p/long.py", "long.py", "code_file", None, None, "L" * 1500),
        (1, "similar", 2, "p/e.py", "e.py", "entity", "run", 4, "E" * 300),
        (1, "similar", 3, "p/s.py", "s.py", "code_file", None, None, "S" * 100),
    ]
    hits = spark.createDataFrame(rows, "qid int, hit_kind string, hit_no int, source string, filename string, type string, entity_name string, line_number int, text string")
    q = spark.createDataFrame([(1, "what?"), (2, "nothing in a.py?")], "qid int, question string")
    views = spark.createDataFrame([("a.py", "V" * 1600)], "filename string, file_content string")
    summary = spark.createDataFrame([("Sum " + "m" * 2000,)], "summary string")
    out = {r["qid"]: r for r in retrieval.prompts(q, hits, summary, views).collect()}
    assert out[1]["context"] == "E" * 300 + "\n\n" + "S" * 100 + "\n\n" + "L" * 1500
    assert out[1]["sources"] == ["- long.py", "- e.py:4 (run)", "- s.py"]
    assert out[2]["context"] == f"Specific file content for a.py:\n\n{'V' * 1500}...\n\nNo context available."
    assert "Sum " + "m" * 996 + "..." in out[2]["prompt"] and "Question: nothing in a.py?" in out[2]["prompt"]
    assert retrieval.simple_prompts(q, hits).count() == 2


def test_index_and_answers(spark, make_files):
    from codestrata.plans import index

    files = make_files({
        "p/pay.py": 'def pay(amount):\n    """Charge a card."""\n    return charge(amount)\n\ndef charge(amount):\n    return amount\n',
        "p/view.js": "function draw(x) {\n  return x;\n}\n",
    })
    built = index.build_index(files)
    report = built.report().first()
    assert (report["documents_indexed"], report["entities_found"], report["relationships_found"]) == (5, 3, 2)
    assert report["chunks_created"] >= 5
    embed = index.fit_term_embedder(built.chunks, "text")
    q = embed(spark.createDataFrame([(1, "who calls charge amount"), (2, "explain view.js"), (3, "explain gone.py")], "qid int, question string"), "question")
    hits = retrieval.retrieve(q, built.chunks, built.entities, (built.parsed, built.edges), 3)
    kinds = {}
    for r in hits.collect():
        kinds.setdefault(r["qid"], set()).add(r["hit_kind"])
    assert kinds == {1: {"similar"}, 2: {"file"}, 3: {"similar"}}
    wide = retrieval.retrieve(q.where("qid = 1"), built.chunks, built.entities, (built.parsed, built.edges), 20).orderBy("hit_no").collect()
    assert [r["entity_name"] for r in wide if r["hit_kind"] == "related"] == ["charge"]
    assert any("**Code Relationships:**" in r["text"] and "- pay uses charge (line 1)" in r["text"] for r in wide if r["hit_kind"] == "similar")
    prompts = index.answer_prompts(built, q)
    assert {r["qid"] for r in prompts.collect()} == {1, 2, 3}


def test_history(spark):
    from codestrata.operators import history

    rows = [(1, t, "user" if t % 2 == 0 else "assistant", f"m{t}" * 40) for t in range(14)] + [(2, 0, "system", "s"), (2, 1, "user", "u")]
    turns = history.question_answers(spark.createDataFrame(rows, "conv_id int, turn int, role string, text string"))
    got = history.last_turns(turns).orderBy("conv_id", "no").collect()
    assert [(r["conv_id"], r["turn"], r["no"]) for r in got] == [(1, 4, 1), (1, 6, 2), (1, 8, 3), (1, 10, 4), (1, 12, 5), (2, 1, 1)]
    assert got[0]["question_preview"] == ("m4" * 40)[:60] + "..." and got[5]["answer_preview"] == "..."
