import random

import pytest
from pyspark.sql import functions as F

from parley.operators.clean import clean_messages
from parley.streaming import tables
from tests.conftest import ts

SCHEMA = "group_name string, timestamp timestamp_ntz, author string, message string, msg_type string, path string, block bigint, seq int"
FR = "le chat est dans la maison avec les enfants"
EN = "the cat is in the house with all of them"


def rows():
    """Groups of both languages; in 'mixed' the oldest messages are English, the newest French."""
    out = []
    for group, text in [("fr", FR), ("en", EN), (None, EN)]:
        out += [(group, ts(f"2024-01-{d:02d} 10:00"), "A", f"{text} {d}", "text", f"/{group}.txt", 0, d) for d in range(1, 16)]
    for d in range(1, 29):
        text = EN if d < 11 else FR
        out.append(("mixed", ts(f"2024-02-{d:02d} 10:00"), "B", f"{text} {d}", "text", f"/m{d // 5}.txt", 0, d))
    out.append(("quiet", ts("2024-01-01 10:00"), "C", "<Media omitted>", "media", "/q.txt", 0, 0))
    out.append(("fr", None, "C", "no time at all here", "text", "/fr.txt", 0, 99))
    return out


def run_batches(spark, tmp_path, writer, batches):
    """Each batch lands and is taken by a new run of the stream."""
    source = str(tmp_path / "rows")
    for batch in batches:
        spark.createDataFrame(batch, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(SCHEMA).parquet(source)
        writer(stream).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(SCHEMA).parquet(source)


def sliced(values, n):
    return [values[i::n] for i in range(n)]


@pytest.mark.parametrize("merge_every", [1, 100])
def test_timeline_equals_the_batch(spark, tmp_path, merge_every):
    shuffled = random.Random(merge_every).sample(rows(), len(rows()))
    target = str(tmp_path / "days")
    assert tables.read_timeline(spark, target) is None
    everything = run_batches(
        spark, tmp_path, lambda s: tables.write_timeline(s, target, merge_every=merge_every), sliced(shuffled, 3)
    )
    got = {(r["group_name"], str(r["day"])): r["messages"] for r in tables.read_timeline(spark, target).collect()}
    timed = everything.filter("timestamp is not null").groupBy("group_name", F.to_date("timestamp").alias("day")).count()
    assert got == {(r["group_name"], str(r["day"])): r["count"] for r in timed.collect()}


def test_a_batch_writes_its_own_days_only(spark, tmp_path):
    target = str(tmp_path / "days")
    late = [("old", ts("2011-05-05 08:00"), "A", "x", "text", "/o", 0, 0), rows()[0]]
    run_batches(spark, tmp_path, lambda s: tables.write_timeline(s, target), [rows(), late])
    log = tables.sums_log(target, ["group_name", "day"])
    written = log.read_batch(spark, 1).collect()
    assert sorted((r["group_name"], r["messages"]) for r in written) == [("fr", 1), ("old", 1)]
    # run again, as after a crash between writing and committing: nothing counts twice
    log.write(spark.createDataFrame(written), 1)
    total = tables.read_timeline(spark, target).agg(F.sum("messages")).first()[0]
    assert total == sum(r[1] is not None for r in rows()) + 2


def test_old_folders_go(spark, tmp_path):
    log = tables.sums_log(str(tmp_path), ["k"], merge_every=2)
    for n in range(7):
        log.write(spark.createDataFrame([("a", 1), ("b", n)], "k string, v bigint"), n)
    there = log._complete(spark)
    assert there == {"batch": [4, 5, 6], "merged": [3, 5]}
    assert {r["k"]: r["v"] for r in log.read(spark).collect()} == {"a": 7, "b": 21}
    assert {r["k"]: r["v"] for r in log.read(spark, 5).collect()} == {"a": 5, "b": 10}
    with pytest.raises(ValueError):
        tables.BatchLog("/x", merge_every=0)


COLUMNS = ["group_name", "language", "cleaned_message", "path", "seq"]


def shown(df):
    return sorted(map(tuple, df.select(COLUMNS).collect()), key=str)


@pytest.mark.parametrize("order", ["newest first", "shuffled"])
def test_language_of_a_stream_equals_the_batch(spark, tmp_path, order):
    given = rows()
    if order == "newest first":
        given = given[::-1]
    elif order == "shuffled":
        random.Random(5).shuffle(given)
    size = -(-len(given) // 4)
    parts = [given[i : i + size] for i in range(0, len(given), size)]
    target = str(tmp_path / "cleaned")
    assert tables.read_cleaned(spark, target) is None
    everything = run_batches(spark, tmp_path, lambda s: tables.write_cleaned(s, target), parts)
    batch = clean_messages(everything, order=tables.ORDER)
    # one null group: a batch joins languages by name, where null is no name
    expected = [r for r in shown(batch) if r[0] is not None]
    got = shown(tables.read_cleaned(spark, target))
    assert [r for r in got if r[0] is not None] == expected
    assert {r[1] for r in got if r[0] is None} == {"en"}
    assert {r[1] for r in got if r[0] == "mixed"} == {"en"}


def test_an_empty_batch(spark, tmp_path):
    target = str(tmp_path / "cleaned")
    run_batches(spark, tmp_path, lambda s: tables.write_cleaned(s, target), [[], rows()[:3], []])
    assert tables.read_cleaned(spark, target).count() == 3


def test_a_batch_of_one_file_is_work_for_all_cores(spark, tmp_path):
    import datetime as dt

    rows = [(dt.datetime(2024, 1, 1, 0, i), "g", "text", f"some words of message number {i}", i) for i in range(50)]
    given = spark.createDataFrame(rows, "timestamp timestamp, group_name string, msg_type string, message string, seq long")
    given.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(given.schema).parquet(str(tmp_path / "in"))
    tables.write_cleaned(stream, str(tmp_path / "out"), order=("timestamp", "seq")).trigger(availableNow=True).start().awaitTermination()
    assert len(list((tmp_path / "out/raw/batch=000000000000").glob("*.parquet"))) > 1
    assert tables.read_cleaned(spark, str(tmp_path / "out")).count() == 50
