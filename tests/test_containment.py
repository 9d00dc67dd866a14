"""Containment over an index of character runs against the nested loop."""

import random

from codestrata.operators import containment
from codestrata.operators.ranking import ranked
from pyspark.sql import functions as F


def found(spark, longs, shorts):
    a = spark.createDataFrame(longs, "id long, body string")
    b = spark.createDataFrame(shorts, "name string, extra int")
    rows = containment.contained(a, ["id"], "body", b, "name").collect()
    return sorted((r["id"], r["name"], r["extra"]) for r in rows)


def naive(longs, shorts):
    return sorted({(i, n, e) for i, t in longs for n, e in shorts if t is not None and n and n in t})


def test_equals_the_nested_loop(spark, monkeypatch):
    monkeypatch.setattr(containment, "SEGMENT_CHARS", 17)
    for seed, letters in ((1, "ab"), (2, "abcé日𝒳"), (3, "abcdefghij .")):
        rng = random.Random(seed)
        text = lambda n: "".join(rng.choice(letters) for _ in range(n))
        longs = [(i, text(rng.randrange(0, 90))) for i in range(60)] + [(100, None), (101, ""), (102, "a")]
        shorts = [(text(rng.choice([1, 2, 3, 4, 5, 9, 25])), i) for i in range(60)] + [("", 1), (None, 2)]
        shorts = list({n: (n, e) for n, e in shorts}.values())
        want = naive(longs, shorts)
        assert found(spark, longs, shorts) == want and want


def test_no_rows(spark):
    assert found(spark, [(1, "abc")], []) == [] == found(spark, [], [("a", 1)])


def test_rows_grow_with_the_text_and_not_with_its_square(spark):
    """A very long text: as many segments and runs as its length asks for, and the right answer."""
    rng = random.Random(7)
    body = "".join(rng.choice("abcdefgh") for _ in range(100_000)) + "needle"
    a = spark.createDataFrame([(1, body)], "id long, body string")
    pieces = containment.segments(a, "body", 19)
    assert pieces.count() == -(-len(body) // containment.SEGMENT_CHARS)
    assert pieces.agg(F.sum(F.size(containment.runs(F.col("_text"))))).first()[0] < 1.2 * len(body)
    assert found(spark, [(1, body)], [("needle", 1), ("needles", 2), ("zz", 3), (body[1015:1034], 4)]) == [(1, body[1015:1034], 4), (1, "needle", 1)]


def test_numbered_names_are_told_apart_by_their_runs(spark):
    """Names that differ in their numbers alone: each is filed under a run that hardly any other is filed under."""
    names = spark.createDataFrame([(f"load_{i}",) for i in range(10_000, 12_000)], "name string")
    most = containment.filed(names, "name").groupBy("_run").count().agg(F.max("count")).first()[0]
    assert most <= 2
    assert found(spark, [(1, "see load_11999, load_1"), (2, "load_10000")], [(f"load_{i}", i) for i in range(9_990, 12_000)]) == [(1, "load_11999", 11999), (2, "load_10000", 10000)]


def test_global_ranks(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(50), rng.choice(["x", "y", None])) for _ in range(5000)] + [(7, "x")] * 3000
    df = spark.createDataFrame(rows, "a int, b string")
    got = ranked(df, [F.desc("a"), F.asc_nulls_first("b")]).collect()
    assert sorted(r["rank"] for r in got) == list(range(1, len(rows) + 1))
    in_order = [(r["a"], r["b"]) for r in sorted(got, key=lambda r: r["rank"])]
    assert in_order == sorted(rows, key=lambda r: (-r[0], r[1] is not None, r[1] or ""))
    assert ranked(df.where("false"), [F.desc("a")]).collect() == []
