import pytest

from parley.operators import parse
from tests.conftest import ANDROID, IOS, ts


def parsed(spark, text, **options):
    blocks = spark.createDataFrame(
        [("/x/My Group.txt", "My Group", 0, text)], "path string, group_name string, block bigint, text string"
    )
    return parse.parse_exports(blocks, **options).orderBy("seq").collect()


def test_android(spark):
    rows = parsed(spark, ANDROID)
    assert [r["author"] for r in rows] == ["Odile", "Bruno", "Odile", "Katell", "Katell"]
    assert [r["msg_type"] for r in rows] == ["text", "text", "media", "text", "text"]
    assert rows[0]["timestamp"] == ts("2023-02-03 19:40")
    assert rows[0]["message"] == "Qui apporte le gâteau samedi ?"


def test_ios(spark):
    rows = parsed(spark, IOS)
    assert [(r["author"], r["message"]) for r in rows] == [
        ("Odile", "La clé est sous le pot"),
        ("Bruno", "Merci, bonne soirée"),
        ("Katell", "Réunion reportée jeudi"),
    ]


def test_continuation_lines_are_joined_by_one_space(spark):
    text = "lost\n12/01/2024, 08:15 - A: First line  \n\n \t continuation here\r\n  and more \n12/01/2024, 08:16 - B: x"
    assert [r["message"] for r in parsed(spark, text)] == ["First line continuation here and more", "x"]


def test_empty_first_line(spark):
    rows = parsed(spark, "12/01/2024, 08:15 - Eve:\nlater\n")
    assert (rows[0]["author"], rows[0]["message"]) == ("Eve", "later")


def test_colon_in_notice_is_kept(spark):
    rows = parsed(spark, "12/01/2024, 08:15 - Alice changed the subject to: Plage")
    assert rows[0]["author"] == "Alice changed the subject to"


def test_am_pm_and_narrow_space(spark):
    rows = parsed(spark, "12/01/2024, 8:15 PM - A: x\n12/01/24, 8:17pm - A: y")
    assert [r["timestamp"] for r in rows] == [ts("2024-01-12 20:15"), ts("2024-01-12 20:17")]


def test_garbage_gives_nothing(spark):
    assert parsed(spark, "hello\nworld") == []
    assert parsed(spark, "") == []


def test_anonymised(spark):
    assert all(r["author"].startswith("USER_") for r in parsed(spark, ANDROID, anonymize=True))


def test_group_name(spark):
    assert parsed(spark, IOS)[0]["group_name"] == "My Group"
    assert parsed(spark, IOS, group_name="Autre")[0]["group_name"] == "Autre"
    files = spark.createDataFrame([("/x/Les amis.txt",)], "path string")
    assert parse.assign_group_name(files).first()["group_name"] == "Les amis"
    assert parse.assign_group_name(files, "Z").first()["group_name"] == "Z"


def test_month_first(spark):
    rows = parsed(spark, "01/13/2024, 08:15 - A: x", date_order="MDY")
    assert rows[0]["timestamp"] == ts("2024-01-13 08:15")
    assert parsed(spark, "01/13/2024, 08:15 - A: x") == []


def test_extended_marks(spark):
    text = "‎[12/01/2024, 08:15:00] A : ‎<attached: 1.jpg>"
    assert parsed(spark, text) == []
    assert [r["msg_type"] for r in parsed(spark, text, extended=True)] == ["media"]


def test_the_line_regex_runs_once_per_line(spark):
    blocks = spark.createDataFrame([("p", "g", 0, ANDROID)], "path string, group_name string, block bigint, text string")
    plan = parse.parse_exports(blocks)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("[AP]M") == 1
    assert plan.count("RLIKE(message") == 0 or plan.count("end-to-end encrypted") == 1
    assert "Exchange" not in plan


@pytest.mark.parametrize("line", ["12/01/2024, 08:15 - Alice a rejoint", "12/01/2024 nothing", "[12/01/2024 broken"])
def test_lines_without_author_are_dropped(spark, line):
    rows = parsed(spark, f"12/01/2024, 08:14 - A: x\n{line}\n12/01/2024, 08:16 - B: y")
    assert [r["message"] for r in rows] == ["x", "y"]


SAMPLES = {
    "media": [
        "<Media omitted>", "Média omis", "image omitted", "VIDEO OMITTED", "audio omitted", "sticker omitted",
        "document omitted", "GIF omitted",
    ],
    "system": [
        "Messages and calls are end-to-end encrypted", "Les messages et les appels sont chiffrés de bout en bout",
        "Tap to learn more", "Appuyez pour en savoir plus", "This message was deleted", "Ce message a été supprimé",
        "message deleted", "Message supprimé", "A a ajouté B", "A a quitté", "B a été supprimé", "B a été supprimée",
        "A a supprimé B", "B a rejoint", "A a créé groupe", "A a créé le groupe x", "B ont été ajoutés",
        "vous avez été ajouté", "vous avez rejoint", "A a changé le nom du groupe", "A a changé l'intitulé du groupe",
        "A a changé l'icône du groupe", "A a modifié la description du groupe", "A a épinglé un message", "B was added",
        "B were added", "B joined using this group's link", "B joined the group", "A created group x",
        "A created the group", "A changed the subject", "A changed the group's icon", "A changed this group",
        "A pinned a message", "B was removed from the group", "A removed B from the group", "Missed voice call",
        "missed video call", "Appel vocal manqué", "APPEL VIDÉO MANQUÉ", "Your security code with B changed",
        "Votre code de sécurité avec B a changé", "me\u017f\u017fage deleted", "MI\u017f\u017fED VOICE CALL", "p\u0131nned a message",
    ],
    "text": ["bonjour", "group", "added", "omis", "j'ai rejoint le groupe", "the subject changed"],
}


def test_no_notice_is_lost_to_the_quick_test(spark):
    data = [(kind, text) for kind, texts in SAMPLES.items() for text in texts]
    rows = parse.classify_messages(spark.createDataFrame(data, "want string, message string")).collect()
    assert [(r["message"], r["msg_type"]) for r in rows if r["msg_type"] != r["want"]] == []
