import datetime as dt

import pytest

from parley import ChatAnalysis
from parley.operators.parse import date_orders, parse_exports

SCHEMA = "path string, group_name string, block bigint, text string"


def line(day, month, order, year="2024", form="android"):
    first, second = (day, month) if order == "DMY" else (month, day)
    if form == "ios":
        return f"‎[{first:02d}/{second:02d}/{year} à 10:00:00] Awa : hello"
    return f"{first:02d}/{second:02d}/{year}, 10:00 - Awa: hello"


def blocks(spark, texts):
    rows = [(path, path, n, text) for path, parts in texts.items() for n, text in enumerate(parts)]
    return spark.createDataFrame(rows, SCHEMA)


def test_orders_by_days_by_steps_and_undecided(spark):
    texts = {
        "above12": [line(13, 1, "MDY"), line(2, 3, "MDY")],
        "dmy": ["\n".join(line(d, 1, "DMY") for d in range(1, 20))],
        # all days up to 12: only one order goes forward in time
        "steps": ["\n".join(line(d, m, "MDY", "24", "ios") for m in (2, 3) for d in (1, 5, 9))],
        "open": [line(3, 4, "MDY")],
        # one pasted date of the other order does not turn an export
        "pasted": ["\n".join([line(d, 1, "DMY") for d in range(10, 25)] + ["12/31/2023, it says"])],
        "none": ["no date here"],
        "gone": [None],
        "empty": [""],
    }
    got = {r["path"]: r for r in date_orders(blocks(spark, texts)).collect()}
    assert {k: (r["date_order"], r["undecided"]) for k, r in got.items()} == {
        "above12": ("MDY", False), "dmy": ("DMY", False), "steps": ("MDY", False), "open": ("DMY", True),
        "pasted": ("DMY", False), "none": ("DMY", True), "empty": ("DMY", True),
    }
    assert (got["above12"]["dates"], got["above12"]["dmy_dates"], got["above12"]["mdy_dates"]) == (2, 1, 2)
    assert (got["steps"]["dmy_steps_back"], got["steps"]["mdy_steps_back"]) == (1, 0)


def test_mixed_exports_in_one_run(spark):
    days = [dt.date(2024, 1, 1) + dt.timedelta(days=k) for k in range(0, 60, 3)]
    texts = {o: ["\n".join(line(d.day, d.month, o) for d in half) for half in (days[:9], days[9:])] for o in ("DMY", "MDY")}
    parsed = parse_exports(blocks(spark, texts), date_order="auto").collect()
    for order in texts:
        assert sorted(r["timestamp"].date() for r in parsed if r["path"] == order) == days
    given = spark.createDataFrame([("MDY", "MDY")], "path string, date_order string")
    assert len(parse_exports(blocks(spark, texts), date_order="auto", orders=given).collect()) == 2 * len(days)


def test_facade_and_streams(spark, tmp_path):
    text = "\n".join(line(d, 5, "MDY") for d in range(1, 29))
    (tmp_path / "us.txt").write_text(text, encoding="utf-8")
    run = ChatAnalysis(spark, str(tmp_path / "us.txt"), date_order="auto").parse()
    assert {r["timestamp"].month for r in run.results.raw.collect()} == {5}
    assert run.results.date_orders.first()["date_order"] == "MDY"
    source = blocks(spark, {"a": ["x"]})
    source.write.parquet(str(tmp_path / "t"))
    with pytest.raises(ValueError, match="stream"):
        parse_exports(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "t")), date_order="auto")
