import zipfile

import pytest

from parley import ChatAnalysis

WORDS = ["match stade ballon score joueur", "cours examen prof salle note", "famille fête repas cousin tante"]


def export(people, n):
    lines = []
    for i in range(n):
        text = WORDS[i % 3] + (" good" if i % 4 else " bad")
        lines.append(f"{i % 28 + 1:02d}/01/2024, {i % 24:02d}:15 - {people[i % len(people)]}: {text}")
    lines.append("05/01/2024, 10:00 - Awa: <Media omitted>")
    return "\n".join(lines)


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("exports")
    (root / "Etudes.txt").write_text(export(["Awa", "Moussa"], 30), encoding="utf-8")
    with zipfile.ZipFile(root / "Famille.zip", "w") as z:
        z.writestr("_chat.txt", export(["Awa", "Fatou", "Ali"], 21))
        z.writestr("IMG.jpg", b"0" * 1024)
    return root


@pytest.fixture(scope="module")
def lexicon(spark):
    return spark.createDataFrame([("good", 1.9), ("bad", -2.5)], "word string, value double")


@pytest.fixture(scope="module")
def done(spark, folder, lexicon):
    a = ChatAnalysis(spark, [str(folder / "Etudes.txt"), str(folder / "Famille.zip")], n_topics=3, lang="fr", lexicon=lexicon)
    return a.parse().clean().analyze(media=True)


def test_all_steps(done):
    assert done.results.errors == {}
    assert done.results.raw.count() == 53 and done.results.clean.count() == 51
    assert {"topic_id", "topic_score", "sentiment_score", "sentiment_label"} <= set(done.results.scored.columns)
    assert done.results.group_topics.count() == 6
    profiles = {(r["group_name"], r["author"]): r for r in done.results.users.collect()}
    assert len(profiles) == 5 and profiles["Etudes", "Awa"]["message_count"] == 15
    assert done.results.media["stats"].first()["count"] == 1


def test_views(done):
    awa = done.user("Awa")
    assert awa.summary().count() == 2
    assert awa.topics().count() == 22
    assert awa.sentiment_over_time().count() == 22
    assert sum(r["messages"] for r in awa.activity_heatmap().collect()) == 22
    assert done.user("nobody").summary().count() == 0


def test_comparison(done):
    tables = done.compare()
    assert {r["group_name"]: r["nb_messages"] for r in tables["activity"].collect()} == {"Etudes": 30, "Famille": 21}
    assert [r["author"] for r in tables["common_users"].collect()] == ["Awa"]
    assert tables["sentiment"].count() == 2 and tables["topics"].count() > 0


def test_reports_and_csv(spark, done, tmp_path):
    written = done.write_reports(str(tmp_path / "reports"))
    assert all(written.values()) and {"stat_cards", "user_profiles", "sentiment_daily"} <= set(written)
    assert spark.read.parquet(written["activity_table"]).count() == 2
    path = done.write_csv(str(tmp_path / "csv"))
    back = spark.read.option("header", True).csv(path)
    assert back.count() == 51 and "tokens" in back.columns


def test_failed_step_leaves_none(spark, folder):
    a = ChatAnalysis(spark, str(folder / "Etudes.txt"), n_topics=2).parse().clean().analyze()
    assert a.results.sentiment is None and "sentiment" in a.results.errors
    assert a.results.temporal is not None and a.results.users is not None
    assert a.user("Awa").sentiment_over_time().count() == 0
    assert "sentiment" not in a.compare()


def test_order_of_steps(spark, folder):
    a = ChatAnalysis(spark, str(folder / "Etudes.txt"))
    with pytest.raises(RuntimeError, match="parse"):
        a.clean()
    with pytest.raises(RuntimeError, match="clean"):
        a.analyze()
    with pytest.raises(RuntimeError, match="clean"):
        a.write_csv()
    with pytest.raises(ValueError):
        ChatAnalysis(spark, "x", topic_method="magic")
    with pytest.raises(TypeError, match="colour"):
        ChatAnalysis(spark, "x", colour="red")


def test_nothing_to_parse(spark, tmp_path):
    (tmp_path / "x.txt").write_text("hello")
    with pytest.raises(ValueError, match="hold no message"):
        ChatAnalysis(spark, str(tmp_path / "x.txt")).parse()
    with pytest.raises(RuntimeError, match="None of the"):
        ChatAnalysis(spark, str(tmp_path / "missing.txt")).parse()


def test_one_model_per_group(spark, folder):
    paths = [str(folder / "Etudes.txt"), str(folder / "Famille.zip")]
    a = ChatAnalysis(spark, paths, n_topics=2, lang="fr", topics_per_group=True, anonymize=True)
    a.parse().clean(min_words=1).analyze(sentiment=False, temporal=False)
    assert a.results.group_topics.count() == 4
    assert a.results.scored.count() == 51
    assert all(r["author"].startswith("USER_") for r in a.results.users.collect())
    assert a.results.temporal is None
