import hashlib
import re

import pytest
from pyspark.sql import functions as F

from parley.functions import patterns as P
from parley.functions import text as T
from parley.functions.dates import message_timestamp, whole_days
from parley.functions.lookup import word_lookup
from parley.operators.clean import words_of
from tests.conftest import ts


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


def test_control_characters_go_newlines_stay(spark):
    assert one(spark, T.normalize_encoding(F.col("t")), t="Hello\x00World\x08!\n\tok") == "HelloWorld!\n\tok"


def test_phone_numbers_are_hashed(spark):
    text = "Call +221 77 123 45 67 or 77-123-45-67, again +221 77 123 45 67."
    pattern = re.compile(r"\+?\d[\d\s\-().]{7,}\d")
    want = pattern.sub(lambda m: f"[USER_{hashlib.md5(m.group().encode()).hexdigest()[:6]}]", text)
    assert one(spark, T.anonymize_phone(F.col("t")), t=text) == want
    assert one(spark, T.anonymize_phone(F.col("t")), t="no number") == "no number"


def test_author_hash(spark):
    digest = hashlib.md5("Aminata Diallo".encode()).hexdigest()
    assert one(spark, T.anonymize_author(F.col("a")), a="  Aminata Diallo ") == f"USER_{digest[:6]}"
    assert one(spark, T.anonymize_author(F.col("a"), 12), a="Aminata Diallo") == f"USER_{digest[:12]}"


@pytest.mark.parametrize(
    "message,kind",
    [
        ("<Media omitted>", "media"),
        ("voici MÉDIA OMIS", "media"),
        ("sticker omitted", "media"),
        ("message deleted", "system"),
        ("Moussa a ajouté Fatou", "system"),
        ("Fatou a été supprimée", "system"),
        ("Alice changed the subject", "system"),
        ("Bob removed Carl from the group", "system"),
        ("Appel vidéo manqué", "system"),
        ("Your security code with Bob changed.", "system"),
        ("I left the meeting and added sugar", "text"),
        ("il y en a ajoutés", "text"),
        ("Bonjour tout le monde", "text"),
    ],
)
def test_classification(spark, message, kind):
    assert one(spark, T.classify_message(F.col("m")), m=message) == kind


def test_extended_classification(spark):
    assert one(spark, T.classify_message(F.col("m"), True), m="<attached: 1.jpg>") == "media"
    assert one(spark, T.classify_message(F.col("m")), m="<attached: 1.jpg>") == "text"


def test_emoji(spark):
    assert one(spark, T.strip_emoji(F.col("t")), t="a😀b 👨‍👩‍👧c ❤️d 1️⃣e 🇫🇷f 3 * #") == "ab c d e f 3 * #"
    assert one(spark, T.clean_label(F.col("t")), t="Awa 🎉") == "Awa"
    assert one(spark, T.clean_label(F.col("t")), t="🎉🎉") == "🎉🎉"


@pytest.mark.parametrize(
    "label,n,want",
    [("a / b / c / d", 3, "a / b / c…"), ("a / b", 3, "a / b"), ("a/b/c", 1, "a…")],
)
def test_truncate_label(spark, label, n, want):
    assert one(spark, T.truncate_label(F.col("x"), n), x=label) == want


@pytest.mark.parametrize("seconds,want", [(45, "45s"), (154, "2m 34s"), (3723, "1h 2m 3s"), (0, "0s"), (59.9, "59s")])
def test_format_duration(spark, seconds, want):
    assert one(spark, T.format_duration(F.col("s")), s=float(seconds)) == want


@pytest.mark.parametrize(
    "parts,want",
    [
        (("12", "1", "2024", "8", "15", "", ""), "2024-01-12 08:15:00"),
        (("12", "1", "24", "8", "15", "09", ""), "2024-01-12 08:15:09"),
        (("12", "1", "99", "8", "15", "", ""), "1999-01-12 08:15:00"),
        (("12", "1", "2024", "12", "15", "", "am"), "2024-01-12 00:15:00"),
        (("12", "1", "2024", "12", "15", "", "PM"), "2024-01-12 12:15:00"),
        (("12", "1", "2024", "9", "05", "", "pm"), "2024-01-12 21:05:00"),
        (("31", "2", "2024", "9", "05", "", ""), None),
        (("1", "13", "2024", "9", "05", "", ""), None),
        (("1", "1", "2024", "13", "05", "", "PM"), None),
        (("1", "1", "2024", "24", "05", "", ""), None),
        (("1", "1", "202", "2", "05", "", ""), None),
    ],
)
def test_timestamps(spark, parts, want):
    names = ["d", "mo", "y", "h", "mi", "s", "half"]
    column = message_timestamp(*map(F.col, names))
    got = one(spark, column, **dict(zip(names, parts)))
    assert got == (ts(want) if want else None)


def test_month_first(spark):
    names = ["d", "mo", "y", "h", "mi", "s", "half"]
    column = message_timestamp(*map(F.col, names), date_order="MDY")
    assert one(spark, column, **dict(zip(names, ("1", "13", "2024", "1", "00", "", "")))) == ts("2024-01-13 01:00")
    with pytest.raises(ValueError):
        message_timestamp(*map(F.col, names), date_order="YMD")


def test_whole_days_are_24_hour_periods(spark):
    days = whole_days(F.col("a"), F.col("b"))
    assert one(spark, days, a=ts("2024-01-10 23:00"), b=ts("2024-01-12 01:00")) == 1
    assert one(spark, days, a=ts("2024-01-10 09:00"), b=ts("2024-01-12 11:00")) == 2
    assert one(spark, days, a=ts("2024-01-10 09:00"), b=ts("2024-01-10 09:00")) == 1


def test_word_lookup_finds_every_word_and_nothing_else(spark):
    words = {f"mot{i}": i for i in range(500)} | {"été": -1}
    find = word_lookup(words, "bigint")
    rows = spark.createDataFrame([(w,) for w in [*words, "absent", ""]], "w string")
    got = {r["w"]: r["v"] for r in rows.select("w", find(F.col("w")).alias("v")).collect()}
    assert got == {**words, "absent": None, "": None}


def test_file_names(spark):
    rows = spark.createDataFrame(
        [("/a/b/_chat.txt",), ("/a/Famille.v2.ZIP",), ("/a/b",), ("/a/.hidden",), ("/a/b.d/",)], "p string"
    )
    got = rows.select(T.file_stem(F.col("p")).alias("s"), T.file_suffix(F.col("p")).alias("x")).collect()
    assert [r["s"] for r in got] == ["_chat", "Famille.v2", "b", ".hidden", "b"]
    assert [r["x"] for r in got] == [".txt", ".zip", "", "", ""]


ODD = ["plain text, 5 words", "a\x00b\x08 c", "l\u2019été à la mer", "no\u2003break\u00a0space\ttab\nline", "ab😀cd 1\ufe0f\u20e3 5#", "©opy ®ight", "mé\x01dia omis", "<Media omitted>x", "", "  ", "\x85a\u2028b", "Straße ΑΣ x_1 ½", None]


def test_shortcuts_give_the_same_words(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(ODD)], "i int, t string")
    whole = T.split_words(T.strip_emoji(T.strip_artefacts(T.normalize_encoding(F.col("t")))))
    separators = F.filter(F.split(F.lower("t"), P.NON_WORD), lambda w: w != "")
    spaces = F.filter(F.split("t", f"[{P.SPACE}]+"), lambda w: w != "")
    got = rows.select("t", T.is_plain(F.col("t")).alias("plain"), words_of(F.col("t")).alias("a"), whole.alias("b"),
                      T.split_words(F.col("t")).alias("c"), separators.alias("d"), T.split_on_space(F.col("t")).alias("e"), spaces.alias("f")).collect()
    for r in got:
        assert (r.a, r.c, r.e) == (r.b, r.d, r.f), r
    assert {r.t for r in got if r.plain} == {ODD[0], ODD[2], ODD[3], ODD[7], "", "  ", ODD[10], ODD[11]}
