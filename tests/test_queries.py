"""Each registered query against its SQL in DuckDB, and the driver's entry points."""

import os
import shutil
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__
from folio.plans import registry

SF = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    return con


def rows(df):
    names = sorted(df.columns)
    return sorted(map(tuple, df[names].astype(str).values.tolist()))


@pytest.mark.parametrize("name", sorted(__spark_entry__.queries()))
def test_query(spark, duck, name):
    got = __spark_entry__.queries()[name](spark, SF)
    assert got.columns
    if name in __spark_entry__.oracle_sql():
        want = duck.sql(__spark_entry__.oracle_sql()[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got.toPandas()) == rows(want)
    else:
        assert got.count() > 0


BLANK = [None, "", " \n\n ", "\u00a0\n\u2003\u3000", "a\n\u00a0\n\u3000 \nb", "\t\n\x0b\n\u200b", "\u00a0a \n \n<b>"]


@pytest.mark.parametrize("name", ["docx_blocks", "odf_blocks", "rtf_text"])
def test_texts_and_lines_of_spaces_make_nothing(spark, tmp_path, name):
    """A text without a line makes no row, and a line of spaces of any kind is none."""
    texts = duckdb.sql("SELECT generate_subscripts(ts, 1) - 1 AS doc_id, unnest(ts) AS text FROM (SELECT $ts::VARCHAR[] AS ts)", params={"ts": BLANK})
    texts.write_parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet'")
    want = con.sql(registry.ORACLE_SQL[name]).df()
    assert len(want) == 3
    assert rows(registry.QUERIES[name](spark, str(tmp_path)).toPandas()) == rows(want)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_works_without_the_training_data_part(tmp_path):
    """The library, its queries and its tests work when that part has been taken away."""
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", ".pytest_cache"))
    env = os.environ | {"PYTHONPATH": os.pathsep.join([str(copy), *filter(None, [os.environ.get("PYTHONPATH")])])}
    code = "import __spark_entry__ as e; q = e.queries(); print(len(q), len(e.oracle_sql()), any(n.startswith('op') for n in q))"
    said = subprocess.run([sys.executable, "-c", code], cwd=copy, env=env, capture_output=True, text=True, check=True).stdout
    assert said.split()[-3:] == [str(len(registry.QUERIES)), str(len(registry.ORACLE_SQL)), "False"]
    rest = ["tests/test_functions.py", "tests/test_queries.py::test_entry", "tests/test_queries.py::test_query[docx_rich]"]
    for args in (rest, ["--collect-only"]):
        ran = subprocess.run([sys.executable, "-m", "pytest", "-q", "-p", "no:cacheprovider", *args], cwd=copy, env=env, capture_output=True, text=True)
        assert ran.returncode == 0, ran.stdout[-3000:] + ran.stderr[-3000:]
