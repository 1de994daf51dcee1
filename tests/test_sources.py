import io
import random
import zipfile

import pytest

from parley.operators.parse import parse_exports
from parley.sources import exports, listing
from parley.sources.blocks import message_blocks
from tests.conftest import ANDROID, IOS


@pytest.fixture()
def tree(tmp_path):
    (tmp_path / "_chat.txt").write_text(ANDROID, encoding="utf-8")
    group = tmp_path / "Etudes"
    (group / "media").mkdir(parents=True)
    (group / "a-notes.txt").write_text("x")
    (group / "my chat.txt").write_text("y")
    (group / "Export_Chat.txt").write_text(IOS, encoding="utf-8")
    (group / "media" / "photo.JPG").write_bytes(b"0" * 2048)
    (group / "media" / "voice.opus").write_bytes(b"1" * 10)
    (group / "media" / "file.xyz").write_bytes(b"1")
    with zipfile.ZipFile(tmp_path / "Famille.zip", "w") as z:
        z.writestr("_chat.txt", IOS)
        z.writestr("IMG-1.jpg", b"0" * 100)
        z.writestr("deep/_chat.txt", "not this one")
    (tmp_path / "bad.zip").write_bytes(b"not a zip")
    (tmp_path / "empty").mkdir()
    (tmp_path / "doc.pdf").write_bytes(b"")
    return tmp_path


def chosen(spark, *paths):
    rows = exports.choose_chat_files(exports.list_exports(spark, [str(p) for p in paths])).collect()
    return {r["root"].rsplit("/", 1)[-1]: r for r in rows}


def test_each_input_kind(spark, tree):
    names = ["_chat.txt", "Etudes", "Famille.zip", "bad.zip", "empty", "doc.pdf", "missing.txt"]
    got = chosen(spark, *(tree / n for n in names))
    assert got["_chat.txt"]["kind"] == "txt" and got["_chat.txt"]["group_name"] == "_chat"
    assert got["Etudes"]["path"].endswith("Export_Chat.txt") and got["Etudes"]["group_name"] == "Etudes"
    assert got["Famille.zip"]["member"] == "_chat.txt" and got["Famille.zip"]["group_name"] == "Famille"
    assert "not a readable archive" in got["bad.zip"]["error"]
    assert "holds no chat text" in got["empty"]["error"]
    assert "no text file" in got["doc.pdf"]["error"]
    assert "does not exist" in got["missing.txt"]["error"]


def test_uris_keep_their_scheme(spark, tree):
    got = chosen(spark, f"file://{tree}/Etudes", f"file://{tree}/Famille.zip")
    assert got["Etudes"]["path"] == f"file://{tree}/Etudes/Export_Chat.txt"
    blocks = exports.read_exports(spark, landing=[f"file://{tree}/"])
    assert {r["group_name"] for r in parse_exports(blocks).collect()} == {"_chat", "Etudes", "Famille"}


def test_bad_inputs_are_skipped_unless_all_are_bad(spark, tree):
    good = exports.choose_chat_files(
        exports.list_exports(spark, [str(tree / "bad.zip"), str(tree / "_chat.txt")])
    )
    assert exports.require_any(good) is good
    bad = exports.choose_chat_files(exports.list_exports(spark, [str(tree / "bad.zip")]))
    with pytest.raises(RuntimeError, match="None of the 1 exports"):
        exports.require_any(bad)


def test_a_damaged_member_gives_no_half_chat(spark, tmp_path):
    lines = "".join(f"0{i % 9 + 1}/02/2023, 19:40 - Odile: message {random.Random(i).random()}\n" for i in range(60_000))
    for name in ("broken", "whole"):
        with zipfile.ZipFile(tmp_path / f"{name}.zip", "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("_chat.txt", lines)
    data = bytearray((tmp_path / "broken.zip").read_bytes())
    data[len(data) // 2] ^= 0xFF
    (tmp_path / "broken.zip").write_bytes(data)
    paths = [str(tmp_path / n) for n in ("broken.zip", "whole.zip", "missing.txt", "x.doc")]
    (tmp_path / "x.doc").write_text("x")
    good = exports.choose_chat_files(exports.list_exports(spark, paths))
    errors = {r["path"].rsplit("/", 1)[-1]: r["error"] for r in exports.input_errors(good).collect()}
    assert set(errors) == {"broken.zip", "missing.txt", "x.doc"} and "damaged" in errors["broken.zip"]
    rows = parse_exports(exports.read_chat_files(exports.require_any(good)))
    assert {r["group_name"]: r["count"] for r in rows.groupBy("group_name").count().collect()} == {"whole": 60_000}
    assert exports.tasks_for(good) >= 1


def test_a_file_that_vanishes_fails_the_read(spark, tree):
    rows = exports.choose_chat_files(exports.list_exports(spark, [str(tree / "_chat.txt")]))
    good = spark.createDataFrame(rows.collect(), rows.schema)
    (tree / "_chat.txt").unlink()
    with pytest.raises(Exception, match="_chat.txt"):
        exports.read_chat_files(good).collect()


def test_exports_of_the_same_name_stay_apart(spark, tmp_path):
    for name in ("x", "y"):
        (tmp_path / name).mkdir()
        (tmp_path / name / "_chat.txt").write_text(ANDROID, encoding="utf-8")
    rows = parse_exports(exports.read_exports(spark, [str(tmp_path / n / "_chat.txt") for n in "xy"]))
    assert {r["group_name"]: r["count"] for r in rows.groupBy("group_name").count().collect()} == {
        str(tmp_path / n / "_chat.txt"): 5 for n in "xy"
    }


def test_messages_of_all_kinds(spark, tree):
    paths = [str(tree / n) for n in ("_chat.txt", "Etudes", "Famille.zip", "bad.zip")]
    rows = parse_exports(exports.read_exports(spark, paths)).collect()
    counts = {}
    for r in rows:
        counts[r["group_name"]] = counts.get(r["group_name"], 0) + 1
    assert counts == {"_chat": 5, "Etudes": 3, "Famille": 3}


def test_landing_folder_lists_every_export(spark, tree):
    rows = exports.choose_chat_files(exports.list_exports(spark, landing=[str(tree)])).collect()
    assert {r["group_name"] for r in rows} == {"_chat", "Etudes", "Famille", "bad", "empty"}


@pytest.mark.parametrize("size", [16, 40, 100, 10_000])
def test_byte_ranges_give_the_same_messages(spark, tree, size):
    path = str(tree / "_chat.txt")
    whole = parse_exports(exports.read_exports(spark, [path]))
    cut = parse_exports(exports.read_exports(spark, [path], block_bytes=size))
    columns = ["timestamp", "author", "message", "msg_type"]
    key = lambda r: tuple(r)
    assert sorted(map(key, cut.select(columns).collect())) == sorted(map(key, whole.select(columns).collect()))


def test_undecodable_bytes_are_dropped(spark, tmp_path):
    path = tmp_path / "x.txt"
    path.write_bytes(b"12/01/2024, 08:15 - Awa: bon\xffjour \xc3\xa9t\xc3\xa9\n")
    row = parse_exports(exports.read_exports(spark, [str(path)])).first()
    assert row["message"] == "bonjour été"


def test_blocks_cover_every_byte_once():
    rng = random.Random(5)
    for _ in range(200):
        lines = []
        for _ in range(rng.randint(0, 30)):
            kind = rng.random()
            start = b"12/01/2024, 08:15 - A: " if kind < 0.4 else b"[1/1/24, 9:00] B: " if kind < 0.6 else b""
            end = rng.choice([b"\n", b"\r\n", b"\n\n", b"\r"])
            lines.append(start + b"x" * rng.randint(0, 60) + end)
        data = b"".join(lines)
        span, size = rng.randint(1, 200), rng.randint(1, 80)
        pieces = []
        for first in range(0, max(len(data), 1), span):
            origin = max(first - 1, 0)
            stream = io.BytesIO(data)
            stream.seek(origin)
            pieces += list(message_blocks(stream, origin, first, first + span, size))
        pieces.sort()
        assert b"".join(p for _, p in pieces) == data
        at = 0
        for offset, piece in pieces:
            assert offset == at
            at += len(piece)
        assert b"".join(p for _, p in message_blocks(io.BytesIO(data), 0, 0, None, size)) == data


def test_media_listing(spark, tree):
    files = exports.list_media(spark, [str(tree / "Etudes" / "media"), str(tree / "nowhere")]).collect()
    assert {r["path"].rsplit("/", 1)[-1]: r["length"] for r in files} == {"photo.JPG": 2048, "voice.opus": 10}


def test_media_of_folders_and_archives(spark, tree):
    listing = exports.list_exports(spark, [str(tree / "Etudes"), str(tree / "Famille.zip")])
    paths = {r["path"].split("/")[-1]: r["length"] for r in exports.media_files(listing).collect()}
    assert paths == {"photo.JPG": 2048, "voice.opus": 10, "IMG-1.jpg": 100}
    member = [r["path"] for r in exports.media_files(listing).collect() if "!/" in r["path"]][0]
    with exports.open_media(member) as stream:
        assert stream.read() == b"0" * 100


def test_a_local_folder_is_read_entry_by_entry(tmp_path, monkeypatch):
    from pyarrow import fs

    (tmp_path / "in").mkdir()
    for name in ("a.mp3", "_chat.txt", "in/b.jpg"):
        (tmp_path / name).write_bytes(b"x" * len(name))
    (tmp_path / "link.mp4").symlink_to(tmp_path / "a.mp3")
    (tmp_path / "nothing.mp4").symlink_to(tmp_path / "gone")
    folder = str(tmp_path)

    def listed():
        return sorted(listing._list_export(folder), key=str), sorted(listing._list_landing(folder))

    with monkeypatch.context() as patched:  # as any other filesystem is listed
        patched.setattr(listing, "open_filesystem", lambda path: (fs.SubTreeFileSystem("/", fs.LocalFileSystem()), path[1:]))
        patched.setattr(listing, "_scheme", lambda path, local: "/")
        rows, inputs = listed()
    monkeypatch.setattr(fs, "FileSelector", None)  # a list of all entries
    got_rows, got_inputs = listed()
    as_listed = [r[:2] + (r[2].lstrip("/"), r[3].lstrip("/")) + r[4:] for r in rows]
    assert [r[:2] + (r[2].lstrip("/"), r[3].lstrip("/")) + r[4:] for r in got_rows] == as_listed
    assert len(got_rows) == 5 and [i.lstrip("/") for i in got_inputs] == [i.lstrip("/") for i in inputs]
