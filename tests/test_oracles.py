import pytest

from skylattice.plans import catalog
from tests.oracle import SF_DIR, compare


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_its_oracle(spark, name):
    assert compare(spark, catalog.QUERIES[name], catalog.ORACLE_SQL[name]) > 0


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_query_without_oracle_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF_DIR).count() > 0


def test_entry_contract(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_without_the_optional_folders(tmp_path):
    """The rest imports and answers without the training-data operators."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    repo = Path(__file__).parent.parent
    shutil.copytree(repo, tmp_path / "r", ignore=shutil.ignore_patterns("llm", ".git", "corpus_pipeline.py", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'tile_index' in q and 'pipeline' not in q and not any(k.startswith('op') for k in q)"
    for left in (False, True):  # the pipeline's file may stay behind
        if left:
            (tmp_path / "r" / "corpus_pipeline.py").write_text("from skylattice.llm import mixing")
        subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path / "r", env={"PATH": "/usr/bin:/bin", "PYTHONPATH": ""}, check=True)
