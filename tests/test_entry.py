import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__ as driver

ROOT = Path(driver.__file__).resolve().parent


def test_oracles_belong_to_queries():
    assert set(driver.oracle_sql()) <= set(driver.queries())


def test_entry(spark):
    rows = driver.entry(spark).collect()
    assert rows and {"lang", "sentences", "words"} == set(rows[0].asDict())


def test_imports_without_the_optional_parts(tmp_path):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    code = "import __spark_entry__ as d; q = d.queries(); assert q and not any(k.startswith('op') or k == 'pipeline' for k in q); assert d.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=copy, check=True, env={"PATH": "/usr/bin:/bin", "HOME": str(tmp_path)})
