import glob

import pytest

DATA = "/root/testdata/sf0.001"


def test_registered():
    import __spark_entry__ as entry

    names = list(entry.queries())
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 14)] == [1] * 13
    assert "pipeline" in names
    assert [len(s) for s in __import__("corpus_pipeline").STAGES] == [2] * 5


@pytest.mark.skipif(not glob.glob(f"{DATA}/*.parquet"), reason="needs the given tables")
def test_stages_keep_columns_and_take_effect(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{DATA}/documents.parquet").cache()
    kept = docs
    for name, stage in p.STAGES[:-1]:
        out = stage(spark, kept, DATA).cache()
        assert out.columns == docs.columns, name
        assert out.count() <= (3 if name == "source mixing" else 1) * kept.count()
        kept = out
    last = p.STAGES[-1][1](spark, kept, DATA)
    assert last.columns == [*docs.columns, "slot", "shard"]
    assert last.count() == kept.count() > 50
    assert p.run(spark, DATA).count() == last.count()
