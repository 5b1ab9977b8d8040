import pytest

from factmill.plans import catalogue as queries
from tests.oracle import alike, rows, sql_rows


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query_equals_sql(spark, sf, name):
    names, got = rows(queries.QUERIES[name](spark, sf))
    expected_names, expected = sql_rows(queries.ORACLE_SQL[name], sf)
    assert names == expected_names
    assert alike(got, expected)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_without_the_training_data_operators(tmp_path):
    """The driver deletes the subpackage, its tests and the pipeline; the rest must still work."""
    import shutil
    import subprocess
    import sys

    from tests.conftest import REPO

    shutil.copytree(f"{REPO}/factmill", tmp_path / "factmill", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{REPO}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    said = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}, check=True).stdout
    assert said.split() == [str(len(queries.QUERIES))] * 2
