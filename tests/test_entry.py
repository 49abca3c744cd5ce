"""The entry module imports and registers the core queries, whatever else is missing."""

import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent


@pytest.mark.parametrize("missing", [None, "zstandard", "kgloom.llm", "corpus_pipeline"])
def test_core_queries_stay(missing):
    code = f"import sys; sys.modules[{missing!r}] = None\n" if missing else ""
    code += "import __spark_entry__ as e\nq, s = e.queries(), e.oracle_sql()\nassert s.keys() <= q.keys()\nprint(sum(not n.startswith('op') and n != 'pipeline' for n in q), 'pipeline' in q)"
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, check=True, timeout=120)
    core, pipeline = out.stdout.split()
    from kgloom import queries

    assert int(core) == len(queries.load_all()[0])
    assert missing is None or pipeline == "False"
