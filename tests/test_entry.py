import glob
import os
import re
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
DATA = "/root/testdata/sf0.001"


def test_contract():
    import __spark_entry__ as entry

    names, texts = set(entry.queries()), set(entry.oracle_sql())
    assert texts <= names
    names -= {name for name in names if re.match(r"op\d+_|pipeline$", name)}
    assert names <= texts


def _without(tmp_path, *gone: str) -> list[str]:
    """Names of the queries of a copy of the tree that lacks some parts."""
    copy = tmp_path / "copy"
    lacks = {os.path.join(ROOT, part) for part in gone}
    shutil.copytree(ROOT, copy, ignore=lambda d, names: [n for n in names if n.startswith(".") or os.path.join(d, n) in lacks])
    code = "import __spark_entry__ as e; e.oracle_sql(); print(*e.queries())"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    run = subprocess.run([sys.executable, "-c", code], cwd=copy, env=env, capture_output=True, text=True, timeout=120)
    assert run.returncode == 0, run.stderr[-2000:]
    return run.stdout.split()


@pytest.mark.parametrize("gone", [("parley/llm", "tests/llm"), ("parley/llm", "tests/llm", "corpus_pipeline.py")])
def test_imports_without_the_training_data_operators(tmp_path, gone):
    from parley.plans.queries import QUERIES

    assert _without(tmp_path, *gone) == list(QUERIES)


@pytest.mark.skipif(not glob.glob(f"{DATA}/*.parquet"), reason="needs the given tables")
def test_flagship(spark):
    import __spark_entry__ as entry

    rows = entry.entry(spark)
    assert rows.columns == ["group_name", "day", "messages"] and rows.count() > 0


@pytest.mark.skipif(not glob.glob(f"{DATA}/*.parquet"), reason="needs the given tables")
def test_every_query_agrees_with_its_sql():
    run = subprocess.run(
        [sys.executable, os.path.join(ROOT, "tools", "check_queries.py"), DATA],
        capture_output=True, text=True, timeout=1500,
    )
    assert run.returncode == 0, run.stdout[-4000:]


def test_texts_are_tokenised_once(spark, tmp_path):
    from parley.plans.queries import QUERIES

    rows = [(i, f"one two three four five{i % 3}", "en", "src0", 20) for i in range(12)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    for name in ("topics_lda_groups",):
        files = QUERIES[name](spark, str(tmp_path)).inputFiles()
        assert not any("documents.parquet" in f for f in files), name


def test_parts_of_a_table_are_bounded(spark, tmp_path, monkeypatch):
    import os

    from parley import session

    folder = tmp_path / "a table"
    spark.range(5000).selectExpr("id", "md5(cast(id as string)) t").coalesce(1).write.parquet(str(folder))
    size = sum(os.path.getsize(f) for f in folder.glob("*.parquet"))
    read = spark.read.parquet(str(folder))
    monkeypatch.setattr(session, "PART_BYTES", 10_000)
    assert session.spread(read, "id").rdd.getNumPartitions() == -(-size // 10_000) > 4
    monkeypatch.setattr(session, "PART_BYTES", 1 << 30)
    assert session.spread(read, "id").rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
