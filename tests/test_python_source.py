import ast

from corpus_catalog.functions.python_source import parse_source

SAMPLE = '''"""Doc."""
import os, sys.path
from pathlib import Path
from . import sibling
from .pkg import thing

def outer():
    import inner.deep
    def nested(): pass
    class _Hidden:
        def method(self): pass

async def later(): pass

class Public:
    def method(self): pass
    try:
        def in_try(): pass
    except E:
        def in_handler(): pass

match x:
    case 1:
        def in_case(): pass

if __name__ == "__main__":
    if __name__ != "y": pass
'''


def breadth_first_names(text):
    kinds = (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)
    return [n.name for n in ast.walk(ast.parse(text)) if isinstance(n, kinds) and n.name[0] != "_"]


def test_sample():
    found = parse_source(SAMPLE)
    assert found["docstring"] == "Doc."
    assert found["imports"] == ["inner", "os", "pathlib", "pkg", "sys"]
    assert found["symbols"] == breadth_first_names(SAMPLE)
    assert found["guard_lines"] == [26, 27]
    assert found["error"] is None


def test_broken_files_give_no_symbols():
    for text in ["def f(:", "a\0b", "\ufeffx = 1", "(" * 500 + ")" * 500, "x" + "+x" * 100_000]:
        found = parse_source(text)
        assert found["symbols"] == [] and found["imports"] == []
    assert parse_source(None) is None
    assert parse_source("")["error"] is None


def test_long_docstring_is_cut():
    assert parse_source('"""' + "d" * 300 + '"""')["docstring"] == "d" * 200
