"""Arrow helpers around the standard library parser.

The parser is the one step Spark has no expression for.  Each helper takes a text column and returns
a struct or an array, so only the text crosses into Python and all other columns stay in the JVM.
"""

from __future__ import annotations

import ast
import warnings

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

FACTS_TYPE = (
    "struct<error_kind:string,error_message:string,error_line:int,"
    "functions:array<struct<name:string,line:int,body:int,args:int>>,"
    "loops:array<struct<line:int,depth:int>>>"
)
ENTITY_TYPE = (
    "array<struct<name:string,type:string,line_number:int,content:string,docstring:string,"
    "parameters:array<string>,dependencies:array<string>>>"
)


def _parse(source: str) -> ast.AST:
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        return ast.parse(source)


def parsed(source: str) -> tuple[ast.AST | None, dict]:
    """The syntax tree, or None, and the facts about the file as far as parsing tells them."""
    facts = {"error_kind": None, "error_message": None, "error_line": None, "functions": [], "loops": []}
    try:
        return _parse(source), facts
    except SyntaxError as e:
        return None, facts | {"error_kind": "syntax", "error_message": e.msg, "error_line": e.lineno}
    except Exception as e:  # too deeply nested, undecodable
        return None, facts | {"error_kind": "analysis", "error_message": str(e)}


def file_facts(source: str | None) -> dict | None:
    """Function sizes and loop depths of one file, or why it does not parse."""
    if source is None:
        return None
    tree, facts = parsed(source)
    return facts if tree is None else with_sizes(tree, facts)


def with_sizes(tree: ast.AST, facts: dict) -> dict:
    """The facts with function sizes and loop depths of the tree."""
    level = [(tree, 0)]
    while level:
        below = []
        for node, depth in level:
            if isinstance(node, ast.FunctionDef):
                facts["functions"].append(
                    {"name": node.name, "line": node.lineno, "body": len(node.body), "args": len(node.args.args)}
                )
            elif isinstance(node, ast.For):
                depth += 1
                facts["loops"].append({"line": node.lineno, "depth": depth})
            below.extend((child, depth) for child in ast.iter_child_nodes(node))
        level = below
    return facts


def _segment(lines: list[bytes], node: ast.AST) -> str:
    """Source text of a node; parser offsets count UTF-8 bytes."""
    part = lines[node.lineno - 1 : node.end_lineno]
    part[-1] = part[-1][: node.end_col_offset]
    part[0] = part[0][node.col_offset :]
    return b"\n".join(part).decode("utf-8")


def _names_used(node: ast.AST, calls: bool) -> list[str]:
    names = set()
    for child in ast.walk(node):
        if isinstance(child, ast.Name) and isinstance(child.ctx, ast.Load):
            names.add(child.id)
        elif calls and isinstance(child, ast.Call) and isinstance(child.func, ast.Attribute):
            names.add(child.func.attr)
    return sorted(names)


def python_entities(source: str) -> list[dict]:
    """Functions, classes and imports in breadth-first order; none when the file does not parse."""
    tree, _ = parsed(source)
    return [] if tree is None else tree_entities(tree, source)


def tree_entities(tree: ast.AST, source: str) -> list[dict]:
    """Functions, classes and imports of a tree."""
    lines = [line.encode("utf-8") for line in source.split("\n")]
    found = []

    def add(node, name, kind, content, deps, docstring=None, params=None):
        found.append(
            {
                "name": name,
                "type": kind,
                "line_number": node.lineno,
                "content": content,
                "docstring": docstring,
                "parameters": params,
                "dependencies": deps,
            }
        )

    for node in ast.walk(tree):
        if isinstance(node, ast.FunctionDef):
            params = [a.arg for a in node.args.args]
            add(node, node.name, "function", _segment(lines, node), _names_used(node, True), ast.get_docstring(node), params)
        elif isinstance(node, ast.ClassDef):
            add(node, node.name, "class", _segment(lines, node), _names_used(node, False), ast.get_docstring(node))
        elif isinstance(node, ast.Import):
            for alias in node.names:
                add(node, alias.name, "import", f"import {alias.name}", [alias.name])
        elif isinstance(node, ast.ImportFrom):
            for alias in node.names:
                text = f"from {node.module} import {alias.name}"
                add(node, alias.name, "import", text, [f"{node.module}.{alias.name}"])
    return found


def parse_facts(content: Column) -> Column:
    """Struct of parse facts; null content gives a null struct."""

    @F.pandas_udf(FACTS_TYPE)
    def facts(source: pd.Series) -> pd.DataFrame:
        blank = {"error_kind": None, "error_message": None, "error_line": None, "functions": None, "loops": None}
        return pd.DataFrame([file_facts(s) or blank for s in source], columns=list(blank)).astype({"error_line": "Int32"})

    return facts(content)
