"""``chat_files``: a Python data source that lists export files.

Spark's own file sources skip names that begin with ``_`` or ``.``, and
``_chat.txt`` is the usual name of an export.  This source lists such files too,
as a batch or as a stream of newly landed exports.  It only lists: contents are
read by ``parley.sources.exports`` in ordinary tasks.

Options
    paths     JSON list of exports (text file, archive or folder each)
    landing   JSON list of folders whose entries are exports
    settle    stream only: seconds a file must be unchanged before it is taken
    ledger    stream only: shared folder that records which files were taken
"""

from __future__ import annotations

import json
import os
import stat
import time
from collections.abc import Iterator
from typing import NamedTuple

from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    DataSourceStreamReader,
    InputPartition,
)

SCHEMA = (
    "root string, kind string, path string, parent string, depth int, "
    "length bigint, modified bigint, error string"
)
LISTING_TASKS = 256


def open_filesystem(path: str):
    """(filesystem, path in it) for a local path or any URI Arrow knows."""
    from pyarrow import fs

    if "://" in path:
        return fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))
    if path.startswith("file:"):
        path = path[len("file:") :]
    return fs.LocalFileSystem(), os.path.abspath(os.path.expanduser(path))


def _scheme(path: str, local: str) -> str:
    """What to put before paths of the same filesystem, e.g. 'hdfs://host:8020'."""
    whole = path.rstrip("/").replace("s3a://", "s3://", 1)
    return whole[: len(whole) - len(local.rstrip("/"))] if "://" in path else ""


def _kind(path: str) -> str | None:
    suffix = os.path.splitext(path)[1].lower()
    return {".zip": "zip", ".txt": "txt"}.get(suffix)


def _row(root, kind, path, depth, info=None, error=None):
    parent = path.rsplit("/", 1)[0]
    length = int(info.size) if info is not None and info.size is not None else None
    modified = int(info.mtime_ns) if info is not None and info.mtime_ns is not None else None
    return (root, kind, path, parent, depth, length, modified, error)


def _entries(filesystem, folder: str) -> Iterator[tuple]:
    """(path, is a folder, entry with size and mtime_ns) of the files and folders in a folder.

    A local folder is read entry by entry, so that a task holds one of them and
    not as many as the folder has; Arrow gives a list.
    """
    from pyarrow import fs

    if filesystem.type_name != "local":
        for entry in filesystem.get_file_info(fs.FileSelector(folder)):
            if entry.type in (fs.FileType.File, fs.FileType.Directory):
                yield entry.path, entry.type == fs.FileType.Directory, entry
        return
    with os.scandir(folder) as entries:
        for entry in entries:
            try:
                status = entry.stat()
            except FileNotFoundError:  # gone by now, or a link to nothing
                continue
            if stat.S_ISREG(status.st_mode) or stat.S_ISDIR(status.st_mode):
                yield f"{folder.rstrip('/')}/{entry.name}", stat.S_ISDIR(status.st_mode), _Status(status.st_size, status.st_mtime_ns)


class _Status(NamedTuple):
    size: int
    mtime_ns: int


def _list_export(path: str) -> Iterator[tuple]:
    """Rows of one export: itself, or the files of a folder to two levels."""
    from pyarrow import fs

    filesystem, local = open_filesystem(path)
    scheme = _scheme(path, local)
    info = filesystem.get_file_info(local)
    if info.type == fs.FileType.NotFound:
        yield _row(path, None, path, 0, error=f"{path} does not exist")
    elif info.type == fs.FileType.Directory:
        for at, is_folder, entry in _entries(filesystem, local):
            if not is_folder:
                yield _row(path, "dir", scheme + at, 1, entry)
                continue
            for inner_at, deeper, inner in _entries(filesystem, at):
                if not deeper:
                    yield _row(path, "dir", scheme + inner_at, 2, inner)
        # keeps an empty folder visible, so that it can be reported
        yield _row(path, "dir", scheme + local + "/", 0)
    elif _kind(local) is None:
        suffix = os.path.splitext(local)[1]
        yield _row(path, None, scheme + local, 0, info, f"{local} is no text file, archive or folder ({suffix!r})")
    else:
        yield _row(path, _kind(local), scheme + local, 0, info)


def _list_landing(folder: str) -> Iterator[str]:
    filesystem, local = open_filesystem(folder)
    for at, is_folder, _ in _entries(filesystem, local):
        if is_folder or _kind(at):
            yield _scheme(folder, local) + at


class _Paths(InputPartition):
    def __init__(self, exports: list[str], landing: list[str]):
        self.exports, self.landing = exports, landing


class _BatchReader(DataSourceReader):
    def __init__(self, options):
        self.paths = json.loads(options.get("paths", "[]"))
        self.landing = json.loads(options.get("landing", "[]"))

    def partitions(self):
        n = max(1, min(len(self.paths), LISTING_TASKS))
        parts = [_Paths(self.paths[i::n], []) for i in range(n) if self.paths]
        return parts + [_Paths([], [folder]) for folder in self.landing] or [_Paths([], [])]

    def read(self, partition):
        for path in partition.exports:
            yield from _list_export(path)
        for folder in partition.landing:
            for path in _list_landing(folder):
                yield from _list_export(path)


class _Files(InputPartition):
    def __init__(self, rows: list[tuple]):
        self.rows = rows


class _StreamReader(DataSourceStreamReader):
    """Offsets count the batches in the ledger.

    The ledger is a folder with one JSON file per batch: the rows of the files
    that were new then.  What is new is decided by path, size and time together,
    not by a highest time, so a file that lands late with an old time is taken,
    and a file that was replaced is taken again.
    """

    def __init__(self, options):
        self.landing = json.loads(options.get("landing", "[]"))
        self.settle = float(options.get("settle", "0"))
        if not options.get("ledger"):
            raise ValueError("a stream of chat_files needs the option ledger: a folder that outlives it")
        self.filesystem, self.ledger = open_filesystem(options["ledger"])
        self.filesystem.create_dir(self.ledger, recursive=True)
        self.known: set[tuple] = set()
        self.read_to = 0

    def initialOffset(self):
        return {"batch": 0}

    def _entry(self, batch: int) -> list[tuple]:
        with self.filesystem.open_input_stream(f"{self.ledger}/{batch:012d}.json") as data:
            return [tuple(row) for row in json.loads(data.read())]

    def _last(self) -> int:
        from pyarrow import fs

        names = [e.base_name for e in self.filesystem.get_file_info(fs.FileSelector(self.ledger))]
        return max((int(n[:-5]) for n in names if n.endswith(".json")), default=0)

    @staticmethod
    def _key(row) -> tuple:
        return row[2], row[5], row[6]

    def latestOffset(self):
        last = self._last()
        for batch in range(self.read_to + 1, last + 1):
            self.known.update(map(self._key, self._entry(batch)))
        self.read_to = last
        newest = time.time_ns() - int(self.settle * 1e9)
        files = [path for folder in self.landing for path in _list_landing(folder) if _kind(path)]
        rows = [row for path in files for row in _list_export(path)]
        fresh = sorted(r for r in rows if self._key(r) not in self.known and (r[6] or 0) <= newest)
        if fresh:
            last += 1
            # written beside its place first, so that no half entry is ever read
            made = f"{self.ledger}/{last:012d}.new"
            with self.filesystem.open_output_stream(made) as out:
                out.write(json.dumps(fresh).encode("utf-8"))
            self.filesystem.move(made, made[:-4] + ".json")
        return {"batch": last}

    def partitions(self, start, end):
        files = [row for batch in range(start["batch"] + 1, end["batch"] + 1) for row in self._entry(batch)]
        n = max(1, min(len(files), LISTING_TASKS))
        return [_Files(files[i::n]) for i in range(n)]

    def read(self, partition):
        yield from partition.rows


class ChatFiles(DataSource):
    @classmethod
    def name(cls):
        return "chat_files"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _BatchReader(self.options)

    def streamReader(self, schema):
        return _StreamReader(self.options)
