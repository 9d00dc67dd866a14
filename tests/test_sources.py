import json
import os

import pytest
from pyspark.sql import functions as F

from codestrata.operators import rollups, severity
from codestrata.plans import analysis
from codestrata.sources import repos, sinks, tables
from codestrata.sources.tree import _Share, _TreeReader, scan_source_tree


def _tree(root, files: dict):
    for name, data in files.items():
        path = os.path.join(root, name)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "wb") as f:
            f.write(data)


def test_scan_keeps_hidden_names(spark, tmp_path):
    root = str(tmp_path)
    _tree(root, {"__init__.py": b"", ".x.py": b"1", "_d/a.py": b"2", ".g/b.js": b"3", "c.tsx": b"a\r\nb\rc", "d.txt": b"no", "X.PY": b"no", "bad.py": b"\xff\xfe"})
    for splits in (1, 3, 64):
        rows = {os.path.relpath(r["path"], root): r for r in scan_source_tree(spark, root, splits=splits).collect()}
        assert set(rows) == {"__init__.py", ".x.py", "_d/a.py", ".g/b.js", "c.tsx", "bad.py"}
    assert rows["c.tsx"]["content"] == "a\nb\nc" and rows["c.tsx"]["size"] == 6
    assert rows["bad.py"]["content"] is None and rows["bad.py"]["read_error"]
    assert rows[".x.py"]["stem"] == ".x" and rows["__init__.py"]["language"] == "python"
    files = scan_source_tree(spark, root)
    assert rollups.run_summary(files, analysis.issues(files)).first()["files_analyzed"] == 5


def test_scan_single_file_and_missing(spark, tmp_path):
    _tree(str(tmp_path), {"X.PY": b"eval(x)", "n.md": b"# t"})
    one = scan_source_tree(spark, str(tmp_path / "X.PY"))
    assert [r["rule_id"] for r in analysis.issues(one).collect()] == ["PY-08"]
    assert scan_source_tree(spark, str(tmp_path), exts=[".md"]).count() == 1
    with pytest.raises(Exception, match="does not exist"):
        scan_source_tree(spark, str(tmp_path / "none")).count()


def test_wide_trees_get_few_shares(tmp_path):
    for i in range(300):
        (tmp_path / f"d{i}").mkdir()
        (tmp_path / f"d{i}" / "a.py").write_text("1")
    reader = _TreeReader(str(tmp_path), (".py",), 8)
    shares = reader.partitions()
    assert len(shares) == 8 and max(len(s.deep) for s in shares) - min(len(s.deep) for s in shares) <= 1
    found = [p for s in shares for p, *_ in reader.read(s)]
    assert sorted(found) == sorted(str(tmp_path / f"d{i}" / "a.py") for i in range(300))


def test_directory_that_cannot_be_listed_is_a_row(tmp_path):
    gone = str(tmp_path / "gone")
    assert list(_TreeReader(str(tmp_path), (".py",), 8).read(_Share((), (gone,)))) == [(gone, "", 0)]


FILES = {"a/x.py": b"1" * 10, "a/y.js": b"2" * 2000, "a/deep/z.py": b"3" * 30, "b/x.py": b"4" * 40, "b/_w.ts": b"5", "top.py": b"6"}


def test_filters_reach_the_listing(spark, tmp_path):
    """Only directories that can hold a match are listed, and only matching files come out of the source."""
    from pyspark.sql.datasource import EqualTo, In, LessThanOrEqual, StringStartsWith

    from codestrata.sources import tree

    root = str(tmp_path)
    _tree(root, FILES)

    def found(*filters):
        reader = _TreeReader(root, (".py", ".js", ".ts"), 2)
        listed = []
        store = tree._LocalStore()
        real = store.entries
        store.entries = lambda p: listed.append(os.path.relpath(p, root)) or real(p)
        tree_store = tree._store
        tree._store = lambda p: store
        try:
            list(reader.pushFilters(list(filters)))
            rows = [os.path.relpath(p, root) for share in reader.partitions() for p, *_ in reader.read(share)]
        finally:
            tree._store = tree_store
        return sorted(rows), set(listed)

    everything = set(FILES)
    assert found()[0] == sorted(everything)
    rows, listed = found(StringStartsWith(("path",), f"{root}/a/"))
    assert rows == ["a/deep/z.py", "a/x.py", "a/y.js"] and "b" not in listed
    rows, listed = found(EqualTo(("path",), f"{root}/b/x.py"), LessThanOrEqual(("size",), 100))
    assert rows == ["b/x.py"] and not listed & {"a", "a/deep"}
    assert found(In(("ext",), (".py",)), LessThanOrEqual(("size",), 30))[0] == ["a/deep/z.py", "a/x.py", "top.py"]
    assert found(StringStartsWith(("path",), f"{root}/a"), StringStartsWith(("path",), f"{root}/b"))[0] == []

    listing = tree.list_source_tree(spark, root).where(F.col("path").startswith(f"{root}/a/") & (F.col("size") < 100) & (F.col("ext") == ".py"))
    assert sorted(os.path.relpath(r["path"], root) for r in listing.collect()) == ["a/deep/z.py", "a/x.py"]


def test_excluded_files_are_not_opened(spark, tmp_path):
    """Excluded by size, language or prefix, before anything is read."""
    root = str(tmp_path)
    _tree(root, FILES | {"a/y.js": b"2" * 3_000_000})
    opened = scan_source_tree(spark, root, max_file_size_mb=1, languages=["python", "javascript"], prefix=f"{root}/a/")
    assert sorted(os.path.relpath(r["path"], root) for r in opened.collect()) == ["a/deep/z.py", "a/x.py"]
    assert tables.limit_size(tables.limit_languages(scan_source_tree(spark, root), ["python", "javascript"]), 1).where(F.col("path").startswith(f"{root}/a/")).count() == 2


def test_same_rows_through_a_uri(spark, tmp_path):
    root = str(tmp_path)
    _tree(root, FILES | {"__init__.py": b"", ".hidden/q.py": b"\xff", "é ü/p q.py": "é".encode()})
    plain = {r["path"]: tuple(r)[1:] for r in scan_source_tree(spark, root).drop("parent").collect()}
    by_uri = {r["path"].removeprefix("file://"): tuple(r)[1:] for r in scan_source_tree(spark, f"file://{root}").drop("parent").collect()}
    assert by_uri == plain and len(plain) == len(FILES) + 3
    one = scan_source_tree(spark, f"file://{root}/top.py").collect()
    assert [(r["name"], r["content"]) for r in one] == [("top.py", "6")]
    with pytest.raises(Exception, match="does not exist"):
        scan_source_tree(spark, f"file://{root}/none").count()


def test_written_tree_is_scanned_again(spark, tmp_path):
    from codestrata.sources.tree import write_source_tree

    rows = [("a/é.py", "x\n".encode()), ("a/b/c.js", b"\xff"), ("top.ts", b""), ("none.py", None)]
    files = spark.createDataFrame(rows, "path string, content binary")
    for root in (str(tmp_path / "one"), f"file://{tmp_path}/two"):
        assert write_source_tree(files, root) == 3 and write_source_tree(files, root) == 3  # again: the same files
        found = {r["path"].removeprefix(root + "/"): (r["content"], r["size"]) for r in scan_source_tree(spark, root).collect()}
        assert found == {"a/é.py": ("x\n", 2), "a/b/c.js": (None, 1), "top.ts": ("", 0)}
    with pytest.raises(Exception, match="out of the tree"):
        write_source_tree(spark.createDataFrame([("../x.py", b"1")], "path string, content binary"), str(tmp_path))


def test_selection_and_optional_filters(spark, make_files):
    files = make_files({"a.py": "eval(x)", "b.py": "eval(x)", "c.js": "eval(x)"})
    chosen = spark.createDataFrame([("a.py",), ("c.js",), ("zzz",)], "path string")
    found = analysis.analyse_selection(files, chosen)
    assert {r["file_path"] for r in found.collect()} == {"a.py", "c.js"}
    counters = {(r["counter"], r["value"]): int(r["issues"]) for r in rollups.selection_rollup(found).collect()}
    assert counters == {("category", "security"): 2, ("severity", "critical"): 2}
    assert tables.limit_languages(files, ["python"]).count() == 2
    assert tables.limit_size(files, 0).count() == 0 and tables.limit_size(files).count() == 3


def test_small_input_is_spread_and_large_is_not(spark):
    cores = spark.sparkContext.defaultParallelism
    assert tables.spread(spark.range(10).coalesce(1), "id").rdd.getNumPartitions() == cores
    assert tables.spread(spark.range(0, 100, 1, cores + 1), "id").rdd.getNumPartitions() == cores + 1


def test_sinks(spark, make_files, tmp_path):
    files = make_files({"a.py": "eval(x); y", "b.js": "var x"})
    scored = severity.score_issues(analysis.issues(files))
    sinks.write_issues_json(scored, str(tmp_path / "issues"))
    assert spark.read.json(str(tmp_path / "issues")).count() == scored.count()
    summary = rollups.run_summary(files, scored)
    result = json.loads(sinks.result_json(summary, rollups.category_counts(scored)).first()["value"])
    assert result["summary"]["files_analyzed"] == 2 and result["categories"]["security"]["name"] == "Security"
    sinks.write_report(rollups.summary_report(summary, scored, "now"), str(tmp_path / "report"))
    lines = [r["value"] for r in spark.read.text(str(tmp_path / "report")).collect()]
    assert lines[:3] == ["# Code Quality Analysis Report", "Generated on: now", ""] and "- **Critical**: 1" in lines
    chunks = spark.createDataFrame([("c1", "t")], "chunk_id string, text string")
    sinks.write_chunks(chunks, str(tmp_path / "chunks"), "one")
    sinks.write_chunks(chunks, str(tmp_path / "chunks"), "two")
    sinks.write_chunks(chunks, str(tmp_path / "chunks"), "one")
    assert spark.read.parquet(str(tmp_path / "chunks")).count() == 2
    meta = analysis.with_run_metadata(scored, "u", "o", "n").first()
    assert meta["analyzed_branch"] == "main" and meta["analysis_timestamp"]
    assert set(analysis.dashboard(files, scored)) == {"issues_by_category", "severity_distribution", "files_complexity", "priority_matrix", "summary_report"}


def test_repositories(spark, tmp_path):
    (tmp_path / "r.json").write_text('{"name":"a","full_name":"o/a","language":"Python","stargazers_count":5,"license":{"name":"MIT"},"topics":["x"],"created_at":"2024-01-01T00:00:00Z"}\n{"name":"b","license":null}\n')
    rows = {r["name"]: r for r in repos.read_repositories(spark, str(tmp_path)).collect()}
    assert rows["a"]["license"] == "MIT" and rows["a"]["stars"] == 5 and rows["a"]["default_branch"] == "main" and rows["a"]["created_at"]
    assert rows["b"]["topics"] == [] and rows["b"]["forks"] == 0 and rows["b"]["license"] is None
    listing = spark.createDataFrame([("r", "file", f"p/{i:03d}.py", f"{i:03d}.py", 1, "u") for i in range(120)] + [("r", "file", "x.bin", "x.bin", 1, "u"), ("r", "dir", "d.py", "d.py", 0, None)], repos.LISTING_SCHEMA)
    assert repos.list_files(listing).count() == 100
    assert repos.supported_counts(listing).first().asDict() == {"repo": "r", "supported_files": 120, "large": True}
    urls = ["https://github.com/o/n.git", "github.com/o/n", "https://github.com/o", "https://x.org/o/n", "https://github.com/o/n/tree/main?x=1#f", "https://x.github.com/a/b"]
    got = [r[0] and tuple(r[0]) for r in spark.createDataFrame([(u,) for u in urls], "u string").select(repos.parse_url(F.col("u"))).collect()]
    assert got == [("o", "n", "https://github.com/o/n"), ("github.com", "o", "github.com/o/n"), None, None, ("o", "n", urls[4]), ("a", "b", "https://xhub.com/a/b")]
    got = [tuple(r[0]) for r in spark.createDataFrame([("a@b",), ("a",)], "u string").select(repos.split_branch(F.col("u"))).collect()]
    assert got == [("a", "b"), ("a", "main")]


def test_rules_run_on_a_stream(spark, tmp_path):
    """Rules and scores keep no state, so the same functions serve a streaming files table."""
    from codestrata.operators.rules import rule_issues

    (tmp_path / "in").mkdir()
    spark.createDataFrame([("a.js", "var x\neval(x)")], "path string, content string").write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("path string, content string").parquet(str(tmp_path / "in"))
    scored = severity.score_issues(rule_issues(tables.files_from_table(stream), gate_on_parse=False))
    q = scored.writeStream.format("memory").queryName("found").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r["rule_id"] for r in spark.sql("SELECT rule_id FROM found").collect()} == {"JS-01", "JS-06"}
