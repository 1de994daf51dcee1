import pytest

from parley.operators import temporal, users
from tests.conftest import ts

# author, time, topic, topic score, sentiment
MESSAGES = [
    ("Greta", "2023-05-01 18:05", 2, 0.9, 0.6),
    ("Pavel", "2023-05-02 07:30", 0, 0.5, -0.4),
    ("Greta", "2023-05-01 18:40", 2, 0.7, 0.0),
    ("Greta", "2023-05-03 12:00", 1, 0.55, -0.3),
    ("Pavel", "2023-05-02 07:45", 0, 0.7, 0.2),
    ("Pavel", "2023-05-05 22:10", 2, 0.8, 0.8),
    ("Greta", "2023-05-01 19:15", 1, 0.65, 0.1),
    ("Pavel", "2023-05-02 23:59", 1, 0.4, 0.0),
    ("Pavel", "2023-05-09 07:05", 0, 0.6, -0.1),
]


@pytest.fixture()
def rows(spark):
    data = [
        ("g", ts(t), i, a, ["pain", "beurre", "miel"], k, s, m, "neutral")
        for i, (a, t, k, s, m) in enumerate(MESSAGES)
    ]
    return spark.createDataFrame(
        data,
        "group_name string, timestamp timestamp_ntz, seq int, author string, tokens array<string>, topic_id int, "
        "topic_score double, sentiment_score double, sentiment_label string",
    )


@pytest.fixture()
def topics(spark):
    data = [("g", 0, "trains / gares", 0.3), ("g", 1, "jardin / pluie", 0.3), ("g", 2, "cinéma / films", 0.4)]
    return spark.createDataFrame(data, "group_name string, topic_id int, topic_label string, weight double")


def test_profiles(rows, topics):
    got = {r["author"]: r for r in users.user_profiles(rows, topics).collect()}
    g, p = got["Greta"], got["Pavel"]
    assert (g["message_count"], p["message_count"]) == (4, 5)
    assert (g["most_active_day"], p["most_active_day"]) == ("Monday", "Tuesday")
    assert g["avg_message_length"] == p["avg_message_length"] == 3.0
    assert g["sentiment_mean"] == pytest.approx(0.1) and p["sentiment_mean"] == pytest.approx(0.1)
    assert g["activity_hours"] == {12: 1, 18: 2, 19: 1} and sorted(p["activity_hours"]) == [7, 22, 23]
    top = lambda row: {t["label"]: pytest.approx(t["score"]) for t in row["top_topics"]}
    assert top(g) == {"cinéma / films": 0.8, "jardin / pluie": 0.6}
    assert top(p) == {"trains / gares": 0.6, "cinéma / films": 0.8, "jardin / pluie": 0.4}
    assert p["top_topics"][0]["label"] == "trains / gares"


def test_profile_agrees_with_single_operators(rows, topics):
    profile = {r["author"]: r for r in users.user_profiles(rows, topics).collect()}
    for op, field in [
        (users.author_message_count, "message_count"),
        (users.avg_message_length, "avg_message_length"),
        (users.activity_hours, "activity_hours"),
        (users.most_active_day, "most_active_day"),
    ]:
        for r in op(rows).collect():
            assert profile[r["author"]][field] == r[field]
    for r in users.user_sentiment_mean(rows).collect():
        assert profile[r["author"]]["sentiment_mean"] == pytest.approx(r["sentiment_mean"])


def test_profiles_without_topics_and_sentiment(rows):
    plain = rows.drop("topic_id", "topic_score", "sentiment_score", "sentiment_label")
    row = users.user_profiles(plain).first()
    assert row["top_topics"] == [] and row["sentiment_mean"] is None


def test_unknown_author(rows, topics):
    assert users.profile_for(rows, "nobody", topics).count() == 0
    assert users.user_topics(rows, topics, "nobody").count() == 0
    assert sum(r["messages"] for r in temporal.user_heatmap(rows, "nobody").collect()) == 0


def test_user_topics(rows, topics):
    got = users.user_topics(rows, topics, "Greta").collect()
    assert sorted((r["topic_id"], r["topic_label"]) for r in got) == [(1, "jardin / pluie")] * 2 + [(2, "cinéma / films")] * 2


def test_sentiment_series_is_in_message_order(rows):
    got = users.author_sentiment_series(rows, "Pavel").collect()
    assert [r["sentiment_score"] for r in got] == [-0.4, 0.2, 0.0, 0.8, -0.1]


def test_missing_tokens_count_as_zero(spark, rows):
    assert users.avg_message_length(rows.selectExpr("group_name", "author", "cast(null as array<string>) tokens")).first()["avg_message_length"] == 0
    text = rows.selectExpr("group_name", "author", "'a b  c' as cleaned_message")
    assert users.avg_message_length(text).first()["avg_message_length"] == 3


def test_top_n(spark):
    data = [("g", f"a{i:02d}") for i in range(20) for _ in range(i + 1)]
    rows = spark.createDataFrame(data, "group_name string, author string")
    got = users.user_activity_topn(rows, 15).collect()
    assert len(got) == 15 and got[0]["author"] == "a05" and got[-1]["author"] == "a19"
    assert got[0]["truncated"] and got[0]["total_participants"] == 20


def test_media_and_days(spark):
    data = [("g", "A", ts("2024-01-01 08:00"), "media"), ("g", "A", ts("2024-01-01 09:00"), "text"), ("g", "A", ts("2024-01-03 09:00"), "media")]
    rows = spark.createDataFrame(data, "group_name string, author string, timestamp timestamp_ntz, msg_type string")
    row = users.media_and_days(rows).first()
    assert (row["media_count"], row["active_days"]) == (2, 2)


def test_a_hot_group_and_author(spark):
    """A third of all rows in one group and with one author: same results, and
    only counts per author, weekday and hour meet in one task."""
    from pyspark.sql import functions as F

    from parley.operators import compare

    hot = F.col("id") % 3 == 0
    rows = spark.range(30_000).select(
        F.when(hot, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 50)).alias("group_name"),
        F.when(hot & (F.col("id") % 2 == 0), "busy").otherwise(F.concat(F.lit("a"), F.col("id") % 997)).alias("author"),
        (F.expr("timestamp_ntz'2024-01-01'") + F.make_dt_interval(F.lit(0), F.lit(0), (F.col("id") % 40_000).cast("int"))).alias(
            "timestamp"
        ),
        F.array(F.lit("x")).alias("tokens"),
    )
    profiles = {(r["group_name"], r["author"]): r["message_count"] for r in users.user_profiles(rows).collect()}
    assert profiles["hot", "busy"] == 5000 and sum(profiles.values()) == 30_000
    top = users.user_activity_topn(rows, 3).filter("group_name = 'hot'").collect()
    assert top[-1]["author"] == "busy" and len(top) == 3
    activity = {r["group_name"]: r["nb_messages"] for r in compare.compare_activity(rows).collect()}
    assert activity["hot"] == 10_000
    plan = users.user_profiles(rows)._jdf.queryExecution().executedPlan().toString()
    assert "partial_count" in plan and "Cartesian" not in plan


def test_messages_without_a_time(spark):
    from parley.operators import sentiment

    data = [("g", "A", None, 0.5), ("g", "A", ts("2024-01-01 08:00"), 0.1), ("g", "B", None, None)]
    rows = spark.createDataFrame(data, "group_name string, author string, timestamp timestamp_ntz, sentiment_score double")
    rows = rows.selectExpr("*", "array('x') as tokens")
    got = {r["author"]: r for r in users.user_profiles(rows).collect()}
    assert got["A"]["message_count"] == 2 and got["A"]["activity_hours"] == {8: 1} and got["A"]["most_active_day"] == "Monday"
    assert got["B"]["message_count"] == 1 and got["B"]["activity_hours"] == {} and got["B"]["most_active_day"] is None
    assert [r["activity_hours"] for r in users.activity_hours(rows).collect()] == [{8: 1}]
    assert users.most_active_day(rows).count() == sentiment.sentiment_daily(rows).count() == 1
    for op in (temporal.timeline_daily, temporal.monthly_activity, temporal.peak_hour, temporal.peak_day):
        assert op(rows).count() == 1, op
    for op in (temporal.hourly_heatmap, temporal.weekly_activity):
        assert sum(r["messages"] for r in op(rows).collect()) == 1
