from parley.operators import media


def files(spark, *rows):
    return spark.createDataFrame(list(rows), "path string, length bigint")


def test_stats(spark):
    got = media.media_stats(files(spark, ("/m/a.jpg", 100), ("/m/b.JPG", 200), ("/m/v.opus", 2097152), ("/m/x.xyz", 5)))
    assert {r["file_type"]: (r["count"], r["total_size_mb"]) for r in got.collect()} == {
        ".jpg": (2, 0.000286),
        ".opus": (1, 2.0),
    }
    assert media.media_stats(files(spark)).count() == 0


def test_media_folder_prefers_sub_folders(spark):
    rows = spark.createDataFrame(
        [
            ("/e", "/e", "/e/a.jpg", 1), ("/e", "/e/z", "/e/z/b.pdf", 2), ("/e", "/e/y", "/e/y/c.mp3", 2),
            ("/f", "/f", "/f/a.gif", 1), ("/h", "/h", "/h/a.txt", 1),
        ],
        "root string, parent string, path string, depth int",
    )
    assert {r["root"]: r["media_dir"] for r in media.find_media_dir(rows).collect()} == {"/e": "/e/y", "/f": "/f"}


def load_transcriber():
    def transcribe(path):
        if "bad" in path:
            raise OSError("unreadable")
        return None if "silent" in path else "  hello world "

    return transcribe


def test_transcription(spark):
    rows = files(spark, ("/m/a.opus", 1), ("/m/b.mp4", 1), ("/m/bad.mp3", 1), ("/m/silent.ogg", 1), ("/m/p.jpg", 1))
    got = media.transcribe_media(rows, load_transcriber).collect()
    assert {(r["file_path"], r["text"]) for r in got} == {("/m/a.opus", "hello world"), ("/m/b.mp4", "hello world")}
    none = media.transcribe_media(rows)
    assert none.columns == ["file_path", "text"] and none.count() == 0
