from codestrata.functions.jsparse import script_entities
from codestrata.operators import documents, entities

PY = '''import os
from json import dumps as d

class A(Base):
    """Doc of A."""

    def run(self, x, *, y):
        """Run."""
        return os.path.join(helper(x), y)


def helper(z):
    return z


async def skipped():
    pass
'''

JS = """import { a } from './lib/a';
import b from "../b.ts";
function load(x) {
  if (x) { return go(x); }
}
const go = (y) => {
  return load(y, 1);
};
class View extends Base {
  draw() { return go(2); }
}
"""


def test_python_entities(make_files):
    got = [(r["name"], r["type"], r["line_number"], r["parameters"], r["dependencies"], r["docstring"]) for r in
           entities.entities(make_files({"p/a.py": PY, "p/bad.py": "def f(:"})).orderBy("pos").collect()]
    assert got == [
        ("os", "import", 1, None, ["os"], None),
        ("dumps", "import", 2, None, ["json.dumps"], None),
        ("A", "class", 4, None, ["Base", "helper", "os", "x", "y"], "Doc of A."),
        ("helper", "function", 12, ["z"], ["z"], None),
        ("run", "function", 7, ["self", "x"], ["helper", "join", "os", "x", "y"], "Run."),
    ]


def test_python_content_is_the_source_segment(make_files):
    import ast

    text = 'é = 1\ndef f(a):\n    s = "é"; return s\n\n\nclass B: x = "ü"\n'
    rows = {r["name"]: r["content"] for r in entities.entities(make_files({"a.py": text})).collect()}
    nodes = {n.name: ast.get_source_segment(text, n) for n in ast.walk(ast.parse(text)) if hasattr(n, "name")}
    assert rows == nodes


def test_script_entities():
    got = [(e["name"], e["type"], e["line_number"], e["dependencies"]) for e in script_entities(JS)]
    assert got == [
        ("load", "function", 3, ["go", "if", "load", "x"]),
        ("go", "function", 6, ["1", "go", "load", "y"]),
        ("View", "class", 9, ["2", "Base", "View", "class", "draw", "extends", "go"]),
        ("./lib/a", "import", 1, ["./lib/a"]),
        ("../b.ts", "import", 2, ["../b.ts"]),
    ]


def test_block_end_matches_a_character_scan():
    import random

    from codestrata.functions.jsparse import _Braces

    def scan(text, start):
        depth, seen = 0, False
        for i in range(start, len(text)):
            if text[i] == "{":
                depth, seen = depth + 1, True
            elif text[i] == "}":
                depth -= 1
                if depth == 0 and seen:
                    return i
        return len(text)

    rng = random.Random(7)
    for _ in range(300):
        text = "".join(rng.choice("{}a ") for _ in range(rng.randint(0, 25)))
        b = _Braces(text)
        assert all(b.block_end(s) == scan(text, s) for s in range(len(text) + 1)), text


def test_edges_and_lookups(make_files):
    files = make_files({"p/a.py": PY, "q/b.py": "import os\n"})
    found = entities.entities(files)
    used = entities.edges(found)
    got = {(r["source"], r["target"], r["file_path"]) for r in used.collect()}
    assert got == {("os", "os", "p/a.py"), ("A", "helper", "p/a.py"), ("A", "os", "p/a.py"), ("run", "helper", "p/a.py"),
                   ("run", "os", "p/a.py"), ("os", "os", "q/b.py")}
    assert entities.edges_of(used, "helper").count() == 2
    assert {r["name"] for r in entities.find_entities(found, "HELP").collect()} == {"helper"}
    total = entities.structure_totals(files, found, used).first()
    assert (total["files"], total["entities"], total["edges"]) == (2, 6, 6)
    lines = [r["line"] for r in entities.codebase_summary("c", entities.structure_totals(files, found, used), found).orderBy("ord", "line").collect()]
    assert lines[:5] == ["Codebase Summary for c", "", "**Files Analyzed:** 2", "**Code Entities:** 6", "**Relationships:** 6"]
    assert "- A: 5 dependencies" in lines and "- function: 2" in lines


def test_last_entity_with_a_name_decides(make_files):
    files = make_files({"a.py": "def f(x):\n  return x, y, z\n", "b.py": "def f(x):\n  return x\n"})
    got = {r["name"]: r["dependencies"] for r in entities.dependency_counts(entities.entities(files)).collect()}
    assert got == {"f": 1}


def test_import_graph(make_files):
    files = make_files({
        "p/a.py": "import b\nfrom c.d import x\nimport os", "p/b.py": "", "p/c/d.py": "", "q/b.py": "",
        "w/s/m.js": "import x from './lib/u';\nimport y from '../v.js';\nimport z from 'react';", "w/s/lib/u.ts": "", "w/v.js": "",
    })
    edges = entities.import_edges(files, entities.entities(files))
    assert {(r["source"], r["target"]) for r in edges.collect()} == {
        ("p/a.py", "p/b.py"), ("p/a.py", "p/c/d.py"), ("w/s/m.js", "w/s/lib/u.ts"), ("w/s/m.js", "w/v.js")
    }
    degrees = {r["path"]: (r["out_degree"], r["in_degree"]) for r in entities.import_degrees(edges).collect()}
    assert degrees["p/a.py"] == (2, 0) and degrees["w/v.js"] == (0, 1)


def test_documents(make_files):
    src = 'def f(a, b):\n    """Do."""\n    return g(a)\n'
    rows = {r["doc_no"]: r for r in documents.code_documents(entities.entity_files(make_files({"d/x.py": src, "d/e.js": ""}))).where("filename = 'x.py'").collect()}
    assert rows[0]["content"] == (
        f"File: x.py\nLanguage: Python\nExtension: .py\nTotal Entities: 1\nEntity Types: function\n\nCode Content:\n{src}\n\n"
        "AST Parsed Entities:\n- f (function) at line 1\n  Docstring: Do....\n  Parameters: a, b"
    )
    assert rows[1]["content"] == (
        "Entity: f\nType: function\nFile: x.py\nLine: 1\nLanguage: Python\nAST Parsed: True\n\nCode Content:\n"
        + src.strip()
        + "\n\nDocstring: Do.\nParameters: ['a', 'b']\nDependencies: ['a', 'g']\n\nContext: This function is defined in x.py at line 1."
    )
    assert (rows[1]["has_docstring"], rows[1]["has_parameters"], rows[1]["has_dependencies"]) == (True, True, True)


def test_metadata_is_cut(make_files):
    long = "x = '" + "a" * 2000 + "'"
    r = documents.safe_metadata(documents.code_documents(entities.entity_files(make_files({"d" * 600 + "/x.py": long})))).first()
    assert len(r["source"]) == 500 and len(r["code_content"]) == 1000 and r["entity_name"] is None and r["ast_parsed"] == "True"


def test_one_parse_for_rules_and_entities(spark, make_files, monkeypatch):
    """The parsed table gives the same findings and entities, and no plan over it holds Python."""
    from codestrata.functions import pyparse, structure
    from codestrata.operators import entities, rules

    files = make_files({
        "a.py": "import os\n\ndef f(a):\n    eval(a)\n", "b.py": "def (:\n", "X.PY": "def g():\n    global x\n", "c.js": "function load(a) {\n  return eval(a)\n}\n",
        "d.md": "text", "e.py": "", "f.tsx": "class View {\n}\n",
    })
    parsed = entities.parsed_files(files)
    for make in (lambda t: rules.rule_issues(t), entities.entities, lambda t: rules.rule_issues(t, mode="enhanced")):
        plan = make(parsed)._jdf.queryExecution().toString()
        assert "EvalPython" not in plan and "MapIn" not in plan
        assert sorted(map(str, make(parsed).collect())) == sorted(map(str, make(files).collect()))
    asked = []
    monkeypatch.setattr(pyparse, "_parse", lambda source, real=pyparse._parse: asked.append(source) or real(source))
    import pandas as pd

    run = structure.parse_code
    monkeypatch.setattr(structure.F, "pandas_udf", lambda kind: lambda fn: lambda *columns: fn(*columns))
    found = run(pd.Series([".py", ".py", ".PY", ".js"]), pd.Series(["python", "python", "python", "javascript"]), pd.Series(["x = 1", "def (:", "y", "class A {}"]))
    assert asked == ["x = 1", "def (:", "y"] and found["entities"][2] is None and found["facts"][3] is None


def test_edges_never_broadcast_a_side(spark, make_files, tmp_path):
    """Compressed files say little about the rows in them, so neither side of the edge join is broadcast, however small its files."""
    from codestrata.session import stage

    found = stage(entities.entities(make_files({"p/a.py": "def f(x):\n    return g(x)\n\ndef g(x):\n    return x\n"})))
    used = entities.edges(found)
    assert {(r["source"], r["target"]) for r in used.collect()} >= {("f", "g")}
    assert "BroadcastExchange" not in used._jdf.queryExecution().toString()
