import pytest

from parley.operators import temporal
from tests.conftest import ts

TIMES = [
    "2024-01-12 08:00", "2024-01-12 08:30", "2024-01-12 08:45", "2024-01-12 10:00",
    "2024-01-13 14:00", "2024-01-13 15:00",
]


@pytest.fixture()
def rows(spark):
    return spark.createDataFrame(
        [("g", "A", ts(t)) for t in TIMES], "group_name string, author string, timestamp timestamp_ntz"
    )


def test_heatmap(rows):
    cells = {(r["weekday"], r["hour"]): r["messages"] for r in temporal.hourly_heatmap(rows).collect()}
    assert len(cells) == 168 and sum(cells.values()) == 6
    assert cells["Friday", 8] == 3 and cells["Saturday", 14] == 1 and cells["Monday", 0] == 0


def test_wide_heatmap(rows):
    wide = temporal.hourly_heatmap_wide(rows).orderBy("weekday_no").collect()
    assert [r["weekday"] for r in wide][0] == "Monday" and len(wide) == 7
    assert wide[4]["h08"] == 3 and wide[4]["h09"] == 0


def test_weekly(rows):
    got = {r["weekday"]: r["messages"] for r in temporal.weekly_activity(rows).collect()}
    assert got == {"Monday": 0, "Tuesday": 0, "Wednesday": 0, "Thursday": 0, "Friday": 4, "Saturday": 2, "Sunday": 0}


def test_timeline_and_months(spark, rows):
    assert {str(r["day"]): r["messages"] for r in temporal.timeline_daily(rows).collect()} == {
        "2024-01-12": 4,
        "2024-01-13": 2,
    }
    more = rows.union(spark.createDataFrame([("g", "A", ts("2024-02-05 09:00"))], rows.schema))
    months = temporal.monthly_activity(more).orderBy("month").collect()
    assert [(r["month"], r["messages"]) for r in months] == [("2024-01", 6), ("2024-02", 1)]


def test_peaks(rows):
    assert temporal.peak_hour(rows).first()["peak_hour"] == 8
    assert temporal.peak_day(rows).first()["peak_day"] == "Friday"


def test_peak_ties_go_to_the_earliest(spark):
    rows = spark.createDataFrame(
        [("g", ts("2024-01-13 15:00")), ("g", ts("2024-01-12 09:00"))], "group_name string, timestamp timestamp_ntz"
    )
    assert temporal.peak_hour(rows).first()["peak_hour"] == 9
    assert temporal.peak_day(rows).first()["peak_day"] == "Friday"


def test_unknown_author_has_an_empty_heatmap(rows):
    cells = temporal.user_heatmap(rows, "nobody").collect()
    assert len(cells) == 168 and sum(r["messages"] for r in cells) == 0
    assert sum(r["messages"] for r in temporal.user_heatmap(rows, "A").collect()) == 6


def test_groups_do_not_mix(spark, rows):
    other = spark.createDataFrame([("h", "B", ts("2024-01-14 01:00"))], rows.schema)
    peaks = {r["group_name"]: r["peak_day"] for r in temporal.peak_day(rows.union(other)).collect()}
    assert peaks == {"g": "Friday", "h": "Sunday"}
