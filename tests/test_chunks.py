import random

from pyspark.sql import functions as F

from codestrata.functions import chunking
from codestrata.functions.splitter import chunk_fixed, split_text
from codestrata.operators import documents


def test_fixed(spark):
    texts = ["", "a" * 200, "b" * 1000, "c" * 1001, "".join(chr(97 + i % 26) for i in range(5000))]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chunk_fixed(F.col("t")).alias("c"))
    for r in df.collect():
        starts = range(0, max(len(r["t"]) - 200, 1), 800)
        assert r["c"] == [r["t"][s : s + 1000] for s in starts]


def test_recursive_small_cases():
    assert split_text("") == []
    assert split_text("short") == ["short"]
    assert split_text("aa bb cc dd", 5, 2) == ["aa bb", "cc", "dd"]
    assert split_text("aa bb cc dd", 6, 3) == ["aa bb", "bb cc", "cc dd"]
    assert split_text("abcdefghij", 4, 1) == ["abcd", "defg", "ghij"]
    assert split_text("one\n\ntwo two two\n\nthree", 8, 0) == ["one", "two two", "two", "three"]


def test_recursive_properties():
    rng = random.Random(5)
    for _ in range(200):
        text = "".join(rng.choice(["ab", "c", " ", "\n", "\n\n", "defg"]) for _ in range(rng.randint(0, 60)))
        size, overlap = rng.choice([(10, 0), (10, 3), (25, 8)])
        chunks = split_text(text, size, overlap)
        assert all(0 < len(c) <= size and c == c.strip() and c in text for c in chunks)
        if overlap == 0:  # nothing but white space is lost, and chunks come in order
            assert "".join("".join(chunks).split()) == "".join(text.split())


def test_chunk_table_and_stats(spark, make_files):
    docs = documents.text_documents(make_files({"a.py": "x" * 1500, "b.md": "y", "c.zzz": ""}))
    got = documents.chunks(docs, "recursive")
    assert {(r["filename"], r["chunk_no"]) for r in got.collect()} == {("a.py", 0), ("a.py", 1), ("b.md", 0)}
    stats = {(r["breakdown"], r["value"]): r["chunks"] for r in documents.chunk_stats(got.withColumn("language", F.lit(None).cast("string"))).collect()}
    assert stats[("total", "")] == 3 and stats[("files", "a.py")] == 2 and stats[("languages", "unknown")] == 3
    assert documents.chunk_summary_text(got).first()[0].startswith("Codebase Summary:\n- Total indexed chunks: 3\n- File types found: .md, .py")


def test_native_splitter_equals_the_plain_one(spark):
    """The column expression against the plain function, at sizes that reach every separator."""
    rng = random.Random(8)
    texts = ["", " ", "\n\n", "a" * 3000, "word " * 900, "line\n" * 700, ("p" * 30 + "\n\n") * 90, None]
    for _ in range(60):
        texts.append("".join(rng.choice(["ab", "c", " ", "\n", "\n\n", "defg", "é", "日本", "x" * 30, "𝒳", "\t", " "]) for _ in range(rng.randint(0, 120))))
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for size, overlap in ((10, 3), (40, 12), (1000, 200), (25, 0)):
        found = {r["i"]: r["c"] for r in df.select("i", chunking.chunk_recursive(F.col("t"), size, overlap).alias("c")).collect()}
        assert found == {i: None if t is None else split_text(t, size, overlap) for i, t in enumerate(texts)}
    plan = df.select(chunking.chunk_recursive(F.col("t")).alias("c"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
