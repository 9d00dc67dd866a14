"""Golden cases of the line, file and neighbourhood rules."""

import pytest

from codestrata.operators import context, rules
from codestrata.plans import analysis

SAMPLE = '''def area(width, height):
    """Area of a rectangle."""
    total = width * height
    return total

class Shape:
    """Named shape."""

    def __init__(self, label):
        self.label = label

    def title(self):
        """Label for a caption."""
        return self.label
'''

Q3 = '"""'

# name -> (mode, files, rule ids of interest, expected set of (file, rule, line))
CASES = {
    "sample": ("basic", {"s/test.py": SAMPLE}, None, {("s/test.py", "PY-11", 9)}),
    "syntax_gates": ("basic", {"a.py": "def f(:\n eval(x)"}, None, {("a.py", "PY-01", 1)}),
    "unparsable": ("basic", {"a.py": "x = " + "a." * 100_000 + "b"}, ["PY-01", "PY-02"], {("a.py", "PY-02", None)}),
    "length": ("basic", {"a.py": "#" + "x" * 119, "b.py": "#" + "x" * 120}, None, {("b.py", "PY-09", 1)}),
    "comment_semicolon": ("basic", {"a.py": "# a; b\nx = 1; y = 2"}, None, {("a.py", "PY-10", 2)}),
    "loose_equality": ("basic", {"a.js": "a == b\na === b\na == b != c"}, None, {("a.js", "JS-07", 1)}),
    "indent": ("basic", {"a.ts": " " * 20 + "x\n" + " " * 21 + "x"}, None, {("a.ts", "JS-05", 2)}),
    "def_last": ("basic", {"a.py": "def f(): pass"}, None, {("a.py", "PY-11", 1)}),
    "multi_line_signature": ("basic", {"a.py": f"def f(\n a):\n {Q3}x{Q3}"}, None, {("a.py", "PY-11", 1)}),
    "comment_then_doc": ("basic", {"a.py": f"def f():\n  # c\n\n  {Q3}x{Q3}"}, None, set()),
    "password": ("basic", {"a.py": "PassWord = 'x'\npassword = ''\npassword = 1"}, ["PY-06"], {("a.py", "PY-06", 1)}),
    "sql": ("basic", {"a.py": "c.execute( 'select %s' % a)\nc.execute(q)"}, ["PY-07"], {("a.py", "PY-07", 1)}),
    "var_unicode": ("basic", {"a.js": "évar x\nvar é\nvarx y"}, ["JS-06"], {("a.js", "JS-06", 2)}),
    "double_report": ("enhanced", {"a.py": "def f():\n  pass\ndef _g():\n  pass", "test_a.py": f"{Q3}d{Q3}"}, ["PY-11", "DP-02"],
                      {("a.py", "PY-11", 1), ("a.py", "DP-02", 1), ("a.py", "PY-11", 3)}),
    "siblings": ("enhanced", {"d/a.py": "def f(): pass", "d/test_a.py": "", "e/b.py": "def f(): pass", "d/test_b.py": "", "d/c.js": "function f() {}",
                                  "d/c.spec.js": "", "d/e.ts": "class X {}"}, ["TP-01", "TJ-01"],
                     {("e/b.py", "TP-01", None), ("d/e.ts", "TJ-01", None)}),
    "private_only": ("enhanced", {"a.py": "def _f(): pass\n_x = 1"}, ["TP-01"], set()),
    "jsdoc_distance": ("enhanced", {"a.js": "/**\n1\n2\n3\nfunction f() {}", "b.js": "/**\n1\n2\n3\n4\nfunction f() {}"}, ["DJ-01"], {("b.js", "DJ-01", 6)}),
    "module_doc": ("enhanced", {"a.py": f"# c\n\n{Q3}x{Q3}", "b.py": f"x = 1\n{Q3}x{Q3}", "c.py": ""}, ["DP-01"], {("b.py", "DP-01", 1), ("c.py", "DP-01", 1)}),
    "global": ("enhanced", {"a.py": "def f():\n    global x\n    x = 1", "b.py": "def f():\n    x = 1"}, ["PP-04"], {("a.py", "PP-04", 1)}),
    "listener": ("enhanced", {"a.js": "e.addEventListener(f)", "b.js": "e.addEventListener(f)\ne.removeEventListener(f)"}, ["JP-04"], {("a.js", "JP-04", 1)}),
    "params_and_length": ("basic", {"a.py": "def f(a,b,c,d,e,f,g,h):\n    '''d'''\n" + "    x = 1\n" * 50}, None, {("a.py", "PY-03", 1), ("a.py", "PY-04", 1)}),
    "complex": ("enhanced", {"a.py": "def f():\n" + "  if x: y\n" * 6 + "def g():\n" + "  if x: y\n" * 5}, ["TP-02"], {("a.py", "TP-02", 1)}),
    "hidden_upper": ("basic", {"X.PY": "eval(x)", "d/.x.py": "eval(x)", "n.txt": "eval(x)"}, None, {("X.PY", "PY-08", 1), ("d/.x.py", "PY-08", 1)}),
}


@pytest.fixture(scope="module")
def found(make_files):
    """All cases in two jobs: every case lives in its own directory tree."""
    out = {}
    for mode in ("basic", "enhanced"):
        files = {f"{name}/{p}": c for name, (m, fs, _, _) in CASES.items() if m == mode for p, c in fs.items()}
        for r in analysis.issues(make_files(files), mode, duplication=False).collect():
            case, _, path = r["file"].partition("/")
            out.setdefault(case, []).append((path, r["rule_id"], r["line"], r["message"]))
    return out


@pytest.mark.parametrize("name", CASES)
def test_case(found, name):
    _, _, ids, want = CASES[name]
    got = {(p, r, n) for p, r, n, _ in found.get(name, []) if ids is None or r in ids}
    if name == "siblings":
        got = {g for g in got if g[0] in {w[0] for w in want} | {"d/a.py", "d/c.js"}}
    assert got == want


def test_messages(found):
    assert ("a.py", "PY-03", 1, "Function 'f' is too long (51 lines)") in found["params_and_length"]
    assert ("a.py", "PY-04", 1, "Function 'f' has too many parameters (8)") in found["params_and_length"]
    assert ("b.py", "PY-09", 1, "Line too long (121 characters)") in found["length"]
    assert found["syntax_gates"][0][3] == "Syntax error: invalid syntax"


def test_summary_counts_lines(make_files):
    from codestrata.operators import rollups

    files = make_files({"a.py": "a\nb\n", "b.py": "a\r\nb", "c.py": "", "d.md": "x"})
    got = rollups.run_summary(files, analysis.issues(files)).first()
    assert (got["files_analyzed"], got["lines_of_code"], got["total_issues"]) == (3, 6, 0)


def test_opt_in_loop_rule(make_files):
    deep = "for a in x:\n for b in x:\n  for c in x:\n   for d in x:\n    pass\n"
    files = make_files({"a.py": deep})
    assert analysis.issues(files).count() == 0
    every = [r for r in rules.RULES if "basic" in r.modes]
    assert [r["line"] for r in analysis.issues(files, rule_set=every).collect()] == [4]


def test_family_switch(make_files):
    files = make_files({"a.py": "x = 1; eval(x)"})
    only = rules.family_rules("basic", style=False)
    assert {r["rule_id"] for r in analysis.issues(files, rule_set=only).collect()} == {"PY-08"}


def test_custom_rule(make_files):
    from pyspark.sql import functions as F

    mine = rules.Rule("MY-01", ("python",), "style", "low", "Tab used", condition=lambda: F.contains("text", F.lit("\t")))
    got = analysis.issues(make_files({"a.py": "\tx"}), rule_set=[mine], gate_on_parse=False).collect()
    assert [(r["rule_id"], r["message"], r["line"]) for r in got] == [("MY-01", "Tab used", 1)]


def test_function_sizes(make_files):
    body = "def f():\n  # c\n\n  if a:\n    b\ndef g():\n  x\n"
    got = {r["name"]: (r["function_lines"], r["branches"]) for r in context.function_sizes(make_files({"a.py": body})).collect()}
    assert got == {"f": (2, 1), "g": (1, 0)}


def test_unknown_mode(make_files):
    with pytest.raises(ValueError):
        analysis.issues(make_files({"a.py": ""}), "fast")


def test_plan_has_no_shuffle_and_one_parse(make_files):
    plan = rules.rule_issues(make_files({"a.py": "x"}), mode="enhanced")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    assert plan.count("ArrowEvalPython") == 1
    free = rules.rule_issues(make_files({"a.py": "x"}), gate_on_parse=False)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in free


def test_generated_methods_are_short_enough_to_be_compiled(spark, make_files):
    from codestrata.operators import severity

    debug = getattr(getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$")
    for mode in ("basic", "enhanced"):
        found = rules.rule_issues(make_files({"a.py": "x"}), mode=mode)
        for df in (found, severity.score_issues(found)):
            parts = debug.codegenStringSeq(df._jdf.queryExecution().executedPlan())
            assert max(parts.apply(i)._3().maxMethodCodeSize() for i in range(parts.size())) < 8000


def test_lines_of_other_languages_and_empty_rule_sets(make_files):
    files = make_files({"a.py": "eval(x); y", "a.js": "eval(x)\n" + "\u2003" * 21 + "x", "a.java": "eval(x)"})
    got = {(r["file"], r["rule_id"], r["line"]) for r in analysis.issues(files).collect()}
    assert got == {("a.py", "PY-08", 1), ("a.py", "PY-10", 1), ("a.js", "JS-01", 1), ("a.js", "JS-05", 2)}
    assert analysis.issues(files, rule_set=[]).count() == 0


def test_def_without_a_name_ends_no_function(make_files):
    body = "def f():\n  if a: b\n  def \t\n  c\n  def g():\n    d\n"
    got = {r["name"]: (r["function_lines"], r["branches"]) for r in context.function_sizes(make_files({"a.py": body})).collect()}
    assert got == {"f": (3, 1), "g": (1, 0)}
