"""The driver's contract, with and without the training-data subpackage."""

import subprocess
import sys
from pathlib import Path

import __spark_entry__ as contract

REPO = Path(contract.__file__).resolve().parent


def test_names_match():
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert {"pipeline_full", "dedup_first"} <= set(contract.queries())


def test_imports_without_the_subpackage(tmp_path):
    hidden = "import sys; sys.modules['glyphmill.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; q = e.queries(); assert 'pipeline_full' in q and not any(n.startswith('op') for n in q); e.oracle_sql()"
    assert subprocess.run([sys.executable, "-c", hidden], cwd=REPO, capture_output=True, timeout=120).returncode == 0


def test_nothing_else_imports_the_subpackage():
    for path in (REPO / "glyphmill").rglob("*.py"):
        if "llm" not in path.parts:
            assert "llm" not in path.read_text(), path


def test_a_query_with_its_sql(spark):
    duckdb = __import__("duckdb").connect()
    folder = "/root/testdata/sf0.001"
    for name in ("documents", "pages"):
        duckdb.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    for name in ("compress_punct", "drop_reasons", "dedup_first", "strip_html_tags"):
        got = contract.queries()[name](spark, folder)
        want = duckdb.execute(f"SELECT {', '.join(got.columns)} FROM ({contract.oracle_sql()[name]})").fetchall()
        assert sorted(map(tuple, got.collect())) == sorted(want)
