import pytest
from pyspark.sql import functions as F

from parley.operators import cards, compare
from tests.conftest import ts

DATA = {
    "Etudes": (["01-10 09:00", "01-10 10:00", "01-11 08:00", "01-12 11:00"], ["Aminata", "Moussa", "Aminata", "Fatou"]),
    "Famille": (["01-15 07:00", "01-16 08:00", "01-16 09:00"], ["Aminata", "Mamadou", "Mamadou"]),
    "Travail": (["02-01 10:00"], ["Kader"]),
    "Amis": (["02-02 10:00"], ["Sonia"]),
}


@pytest.fixture()
def rows(spark):
    data = [(g, a, ts(f"2024-{t}")) for g, (times, authors) in DATA.items() for t, a in zip(times, authors)]
    return spark.createDataFrame(data, "group_name string, author string, timestamp timestamp_ntz")


@pytest.fixture()
def topics(spark):
    data = [
        ("Etudes", 0, "sport", 0.6), ("Etudes", 1, "cours", 0.4),
        ("Famille", 0, "sport", 0.1), ("Famille", 1, "famille", 0.7), ("Famille", 2, "sport", 0.2),
    ]
    return spark.createDataFrame(data, "group_name string, topic_id int, topic_label string, weight double")


def test_activity(rows):
    got = {r["group_name"]: r for r in compare.compare_activity(rows).collect()}
    assert (got["Etudes"]["nb_messages"], got["Etudes"]["nb_participants"]) == (4, 3)
    assert got["Etudes"]["msgs_per_day"] == 2.0 and got["Famille"]["msgs_per_day"] == 3.0
    assert got["Amis"]["msgs_per_day"] == 1.0 and got["Amis"]["period_start"] == ts("2024-02-02 10:00")


def test_topics_pivot(topics):
    got = {r["group_name"]: r.asDict() for r in compare.compare_topics(topics).collect()}
    assert got["Etudes"]["famille"] == 0.0 and got["Etudes"]["sport"] == 0.6
    assert got["Famille"]["sport"] == 0.2  # the label's last topic counts
    assert set(got) == {"Etudes", "Famille"}


def test_chosen_columns_and_long_form(topics):
    some = compare.compare_topics(topics, labels=["sport"])
    assert some.columns == ["group_name", "sport"] and some.count() == 2
    assert compare.compare_topics_long(topics).count() == 4


def test_common_users(rows):
    got = compare.common_users(rows).collect()
    assert [(r["author"], r["groups"]) for r in got] == [("Aminata", ["Etudes", "Famille"])]
    assert [r["author"] for r in compare.intersect_authors(rows, "Etudes", "Famille").collect()] == ["Aminata"]
    none = compare.common_users(rows.filter("group_name = 'Amis'"))
    assert none.columns == ["author", "groups"] and none.count() == 0
    ranked = compare.common_users_ranked(rows).first()
    assert (ranked["groups"], ranked["n_groups"]) == ("Etudes, Famille", 2)


def test_timelines(rows):
    got = {str(r["day"]): r.asDict() for r in compare.compare_timelines(rows).collect()}
    assert got["2024-01-10"]["Etudes"] == 2 and got["2024-01-10"]["Famille"] == 0 and len(got) == 7


def test_cards(rows):
    whole = cards.stat_cards(rows).first()
    assert tuple(whole) == ("9", "6", "10 Jan 2024", "23")
    activity = compare.compare_activity(rows)
    table = {r["group_name"]: r for r in cards.activity_table(activity).collect()}
    assert table["Etudes"]["duration_days"] == "2" and table["Etudes"]["msgs_per_day"] == "2.0"
    assert tuple(cards.comparison_cards(activity).first()) == ("4", "9", "7", "10 Jan 2024")
    detail = {r["group_name"]: r["period"] for r in cards.group_detail_cards(rows).collect()}
    assert detail["Etudes"] == "10 Jan 2024 → 12 Jan 2024"
    overview = {r["group_name"]: r for r in cards.overview_cards(rows).collect()}
    assert overview["Famille"]["peak_hour"] == "07:00" and overview["Famille"]["peak_day"] == "Tuesday"


def test_top_authors_percentages_refer_to_shown_rows(spark):
    data = [("g", n) for n, c in [("A", 5), ("B", 3), ("C 🎉", 2)] for _ in range(c)]
    rows = spark.createDataFrame(data, "group_name string, author string")
    got = cards.top_authors(rows, 2).orderBy("rank").collect()
    assert [(r["author"], r["count"], r["pct"]) for r in got] == [("A", "5", "62.5"), ("B", "3", "37.5")]
    assert cards.top_authors(rows, 10).orderBy("rank").collect()[2]["author"] == "C"


def test_sentiment_tables(spark):
    data = [("g", 0.8, "positive"), ("g", -0.5, "negative"), ("g", 0.0, "neutral"), ("g", 0.3, "positive")]
    rows = spark.createDataFrame(data, "group_name string, sentiment_score double, sentiment_label string")
    table = compare.compare_sentiment(rows)
    assert table.first()["pos_pct"] == 0.5
    split = cards.sentiment_split(table).first()
    assert (split["positive"], split["neutral"], split["negative"]) == (50.0, 25.0, 25.0)


def test_union_and_types(spark, rows):
    both = compare.union_groups(rows.filter("group_name = 'Amis'"), rows.filter("group_name = 'Etudes'"))
    assert both.count() == 5
    typed = rows.withColumn("msg_type", F.when(F.col("author") == "Fatou", "media").otherwise("text"))
    shares = {(r["group_name"], r["msg_type"]): r["share"] for r in cards.msg_type_distribution(typed).collect()}
    assert shares["Etudes", "media"] == 0.25 and shares["Amis", "text"] == 1.0
