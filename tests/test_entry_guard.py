"""The entry without the training-data subpackage, and without a library that it needs."""

import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
BLOCKED = """
import sys
class Block:
    def find_spec(self, name, path=None, target=None):
        if name.split(".")[0] in {names!r} or name in {names!r}:
            raise ImportError(name)
sys.meta_path.insert(0, Block())
import __spark_entry__ as e
found = e.queries()
print(len(found), len(e.oracle_sql()), sum(n.startswith("op") and n[2].isdigit() for n in found), "pipeline" in found)
"""


@pytest.mark.parametrize("names", [("tiktoken",), ("xxhash",), ("irspan.llm",), ("corpus_pipeline",), ("regex", "pandas.core.nothing")])
def test_the_other_queries_stay(names):
    out = subprocess.run([sys.executable, "-c", BLOCKED.format(names=names)], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
    queries, sql, extra, pipeline = out.stdout.split()
    from irspan import queries as retrieval

    own = len(retrieval.queries())
    assert int(queries) >= own == 103 and int(sql) >= 100
    if names == ("corpus_pipeline",):
        assert int(queries) == own + int(extra) and pipeline == "False"
    else:
        assert (int(extra), int(queries), pipeline) == (0, own, "False")
    assert "is left out" in out.stderr
