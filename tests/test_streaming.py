
import os
import zipfile

from parley.operators.clean import clean_messages
from parley.operators.parse import parse_exports
from parley.sources.exports import read_exports
from parley.streaming import aggregates
from parley.streaming.ingest import stream_messages
from tests.conftest import ANDROID, IOS, ts


def run(stream, target, state):
    q = (
        stream.writeStream.format("parquet")
        .option("checkpointLocation", state)
        .trigger(availableNow=True)
        .start(target)
    )
    q.awaitTermination()


def test_new_files_are_taken_once(spark, tmp_path):
    landing = tmp_path / "in"
    landing.mkdir()
    (landing / "_chat.txt").write_text(ANDROID, encoding="utf-8")
    target, state = str(tmp_path / "out"), str(tmp_path / "state")
    make = lambda: stream_messages(spark, [str(landing)], lang="fr", min_words=1)
    run(make(), target, state)
    first = spark.read.parquet(target).count()
    with zipfile.ZipFile(landing / "Famille.zip", "w") as z:
        z.writestr("_chat.txt", IOS)
    os.utime(landing / "Famille.zip", (1_000_000_000, 1_000_000_000))  # older than what was taken before
    (landing / "broken.zip").write_bytes(b"no archive")
    run(make(), target, state)
    run(make(), target, state)
    got = spark.read.parquet(target)
    assert first == 4 and got.count() == 7
    (landing / "broken.zip").unlink()
    batch = clean_messages(parse_exports(read_exports(spark, landing=[str(landing)])), lang="fr", min_words=1)
    columns = ["group_name", "author", "cleaned_message"]
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(map(tuple, batch.select(columns).collect()))


def stream_of(spark, tmp_path, rows, schema):
    path = str(tmp_path / "rows")
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).parquet(path)


def test_days_and_duplicates_over_two_batches(spark, tmp_path):
    schema = "group_name string, timestamp timestamp_ntz, author string, message string"
    rows = [
        ("g", ts("2024-01-01 10:00"), "A", "x"), ("g", ts("2024-01-01 10:00"), "A", "x"),
        ("g", ts("2024-01-01 11:00"), "B", "x"), ("g", ts("2024-01-03 11:00"), "B", "y"),
    ]
    stream = stream_of(spark, tmp_path, rows, schema)
    complete = lambda batch, _: batch.write.mode("overwrite").parquet(str(tmp_path / "t"))
    for late in (False, True):
        if late:  # an older export of another group, and one seen before
            older = [("h", ts("2021-06-01 10:00"), "C", "z"), ("h", None, "C", "no time"), rows[0]]
            spark.createDataFrame(older, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "rows"))
        counts = aggregates.stream_timeline(stream).writeStream.outputMode("complete").foreachBatch(complete)
        counts.option("checkpointLocation", str(tmp_path / "ts")).trigger(availableNow=True).start().awaitTermination()
        run(aggregates.stream_dedup(stream), str(tmp_path / "d"), str(tmp_path / "ds"))
    got = spark.read.parquet(str(tmp_path / "t")).collect()
    assert sorted((r["group_name"], str(r["day"]), r["messages"]) for r in got) == [
        ("g", "2024-01-01", 4), ("g", "2024-01-03", 1), ("h", "2021-06-01", 1),
    ]
    assert spark.read.parquet(str(tmp_path / "d")).count() == 5


def test_running_counts(spark, tmp_path):
    schema = "group_name string, author string, sentiment_score double"
    stream = stream_of(spark, tmp_path, [("g", "A", 0.5), ("g", "A", 0.0), ("g", "B", 1.0)], schema)
    q = (
        aggregates.stream_user_counts(stream)
        .writeStream.format("memory")
        .queryName("running")
        .outputMode("complete")
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()
    got = {r["author"]: (r["message_count"], r["mean_score"]) for r in spark.table("running").collect()}
    assert got == {"A": (2, 0.25), "B": (1, 1.0)}
