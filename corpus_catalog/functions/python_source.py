"""Symbols of Python files, read by an Arrow-batched function.

This is the only place where rows pass through Python; rows of other file
types carry a null text and cost nothing.
"""

from __future__ import annotations

import ast
import sys
from collections import deque

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql.functions import arrow_udf
from pyspark.sql.pandas.types import to_arrow_type

from corpus_catalog.config import DOCSTRING_CHARS
from corpus_catalog.schemas import PARSED

# Executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_DEFINITIONS = (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)
# Fields that hold nested statements; expressions never do, so they are not visited.
_BLOCKS = ("body", "handlers", "orelse", "finalbody", "cases")


def _compares_name(test: ast.expr) -> bool:
    match test:
        case ast.Compare(left=ast.Name(id="__name__")):
            return True
    return False


def parse_source(text: str | None) -> dict | None:
    """Names, imports, docstring and main guards of one file, breadth first."""
    if text is None:
        return None
    found = {"symbols": [], "imports": [], "docstring": None, "guard_lines": [], "error": None}
    try:
        module = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError) as error:
        # One file must never fail the job.
        found["error"] = type(error).__name__
        return found

    match module.body:
        case [ast.Expr(value=ast.Constant(value=str(doc))), *_]:
            found["docstring"] = doc[: DOCSTRING_CHARS].encode("utf-8", "replace").decode()

    imports = set()
    level = deque([module])
    while level:
        node = level.popleft()
        for block in _BLOCKS:
            level.extend(getattr(node, block, ()))
        match node:
            case ast.Import(names=names):
                imports.update(alias.name.partition(".")[0] for alias in names)
            case ast.ImportFrom(module=str(origin)):
                imports.add(origin.partition(".")[0])
            case ast.If(test=test, lineno=lineno) if _compares_name(test):
                found["guard_lines"].append(lineno)
            case _ if isinstance(node, _DEFINITIONS) and not node.name.startswith("_"):
                found["symbols"].append(node.name)
    found["imports"] = sorted(imports)
    return found


_PARSED_ARROW = to_arrow_type(PARSED)


def _parse_batch(text: pa.Array) -> pa.Array:
    texts = text.to_pylist()
    # Copies of one file in a batch are parsed once.
    parsed = {t: parse_source(t) for t in set(texts)}
    return pa.array([parsed[t] for t in texts], type=_PARSED_ARROW)


def parsed_python(text: Column) -> Column:
    """``PARSED`` struct per row; null for a null text."""
    return arrow_udf(_parse_batch, PARSED)(text)
