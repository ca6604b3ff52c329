"""The entry module without the optional part."""

import subprocess
import sys
import textwrap

import pytest


@pytest.mark.parametrize("blocked", ["bayline.llm", "ahocorasick", "public_tokenizers"])
def test_core_queries_stay_when_a_package_is_missing(blocked):
    code = f"""
        import sys
        sys.modules[{blocked!r}] = None  # importing it raises ImportError
        import __spark_entry__ as entry
        names = set(entry.queries())
        assert "run_breakdown" in names and not any(n.startswith("op") for n in names if n[2:3].isdigit()), names
        assert "pipeline" not in names and set(entry.oracle_sql()) <= names
    """
    subprocess.run([sys.executable, "-c", textwrap.dedent(code)], check=True, timeout=120)
