import csv
import os

import pytest
from pyspark.sql import functions as F

from parley.sources import sinks
from tests.conftest import ts

SCHEMA = "group_name string, timestamp timestamp_ntz, seq int, message string, tokens array<string>"


def read(path):
    with open(path, encoding="utf-8", newline="") as f:
        return list(csv.reader(f, strict=True))


def test_one_named_file_per_group_in_order(spark, tmp_path):
    odd = 'a "quoted", line\nwith a break; é 😀'
    rows = [("Famille", ts("2024-01-01 10:00"), i, f"{i} {odd}", ["x", "y"]) for i in range(200)]
    rows += [("Club", ts(f"2024-01-{d:02d} 10:00"), 0, str(d), None) for d in range(1, 20)]
    rows += [("", ts("2024-01-01 10:00"), 0, "m", []), (None, None, 1, None, None), ("a/b", None, 0, "slash", None)]
    rows += [("a:b", None, 0, "colon", None), ("..", None, 0, "dots", None), ("x" * 300, None, 0, "long", None)]
    messages = spark.createDataFrame(rows[::-1], SCHEMA).repartition(8)
    out = tmp_path / "csv"
    out.mkdir()
    (out / "Club.csv").write_text("old")
    (out / "other.csv").write_text("stays")
    written = sinks.write_group_csv(messages, str(out)).collect()
    names = {r["name"] for r in written}
    assert len(written) == len(names) == 7 and {"Famille", "Club", "export"} <= names
    assert {f"{n}.csv" for n in names} | {"other.csv"} == {f for f in os.listdir(out) if not f.startswith(".")}
    assert (out / "other.csv").read_text() == "stays"
    family = read(out / "Famille.csv")
    assert family[0] == ["group_name", "timestamp", "seq", "message", "tokens"]
    assert [r[3] for r in family[1:]] == [f"{i} {odd}" for i in range(200)] and family[1][4] == "x y"
    assert [r[3] for r in read(out / "Club.csv")[1:]] == [str(d) for d in range(1, 20)]
    assert len(read(out / "export.csv")) == 3
    assert sorted(read(r["path"])[1][3] for r in written if "~" in r["name"]) == ["colon", "dots", "long", "slash"]


def test_a_large_group_is_written_by_many_tasks(spark, tmp_path):
    n = 40_000
    rows = spark.range(n).select(
        F.lit("big").alias("group_name"), F.lit(ts("2024-01-01 10:00")).alias("timestamp"), F.col("id").alias("seq"),
        F.repeat(F.lit("text "), 20).alias("message"),
    )
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sinks.write_group_csv(rows, str(tmp_path), columns=["seq"])
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert read(tmp_path / "big.csv") == [["seq"], *([str(i)] for i in range(n))]


def test_a_failure_leaves_nothing(spark, tmp_path):
    fails = F.when(F.col("seq") == 7, F.raise_error(F.lit("lost"))).otherwise("text")
    rows = spark.range(20).select(F.lit("g").alias("group_name"), F.col("id").alias("seq")).withColumn("message", fails)
    with pytest.raises(Exception, match="lost"):
        sinks.write_group_csv(rows, str(tmp_path / "out"))
    assert not (tmp_path / "out").exists() or not os.listdir(tmp_path / "out")


def test_no_message_no_file(spark, tmp_path):
    assert sinks.write_group_csv(spark.createDataFrame([], SCHEMA), str(tmp_path)).count() == 0
    assert not [f for f in os.listdir(tmp_path) if not f.startswith(".")]
