"""Every query of the registry: its SQL on the smallest tables, and the registry without the optional subpackage."""

from __future__ import annotations

import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from compare import TABLES, canonical
from yieldgate.plans import queries as own
from yieldgate.plans import reports, round_trips  # noqa: F401  register their queries

SF = "/root/testdata/sf0.001"
ROOT = Path(__file__).parent.parent


@pytest.mark.skipif(not Path(SF).exists(), reason="the given tables are not here")
@pytest.mark.parametrize("name", sorted(own.oracle_sql()))
def test_sql(spark, name):
    import __spark_entry__ as entry

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    assert canonical(entry.queries()[name](spark, SF).toPandas()) == canonical(con.execute(entry.oracle_sql()[name]).df())


def _run(code: str) -> subprocess.CompletedProcess:
    return subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, capture_output=True, text=True)


NO_OPERATORS = "import __spark_entry__ as e; q = e.queries(); assert 'backtest_grid' in q and not [n for n in q if n.startswith('op') and n[2].isdigit() or n == 'pipeline']; assert set(e.oracle_sql()) <= set(q)"


def test_without_the_subpackage():
    assert "left out" not in _run(f"import sys; sys.modules['yieldgate.llm'] = None; {NO_OPERATORS}").stderr


@pytest.mark.parametrize("package", ["tiktoken", "xxhash", "regex"])
def test_a_missing_package_is_told_and_costs_only_the_subpackage(package):
    if not (ROOT / "yieldgate/llm/entry.py").exists() or not [p for p in (ROOT / "yieldgate/llm").glob("*.py") if f"import {package}" in p.read_text()]:
        pytest.skip("nothing here needs it")
    assert "yieldgate.llm.entry is left out" in _run(f"import sys; sys.modules['{package}'] = None; {NO_OPERATORS}").stderr


def test_all_that_is_there_is_registered():
    code = "import warnings; warnings.simplefilter('error', RuntimeWarning); import __spark_entry__ as e; print(len(e.queries()))"
    assert int(_run(code).stdout.split()[-1]) >= 50


def test_nothing_else_imports_it():
    own = [p for p in (ROOT / "yieldgate").rglob("*.py") if "llm" not in p.relative_to(ROOT / "yieldgate").parts]
    assert own and not [p for p in own if "llm" in p.read_text()]
