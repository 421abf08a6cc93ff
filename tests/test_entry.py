"""The driver's contract without the optional parts."""

import subprocess
import sys
import textwrap

ROOT = __file__.rsplit("/tests/", 1)[0]


def test_queries_without_a_library_of_the_optional_part():
    """A missing tokenizer library leaves the optional queries out, and nothing else."""
    code = """
        import sys
        sys.modules["public_tokenizers"] = sys.modules["sentencepiece"] = None
        import __spark_entry__ as entry
        found, sql = entry.queries(), entry.oracle_sql()
        assert "context_doc" in found and "context_doc" in sql
        assert not [n for n in found if n.startswith("op") or n == "pipeline"], found
    """
    done = subprocess.run([sys.executable, "-c", textwrap.dedent(code)], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    assert "left out" in done.stderr
