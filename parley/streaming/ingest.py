"""Streams of newly landed exports."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from parley.operators.clean import clean_messages
from parley.operators.parse import parse_exports
from parley.session import shared_folder
from parley.sources.exports import (
    BLOCK_BYTES,
    chat_of_archives,
    chat_of_texts,
    read_chat_files,
    register,
)


def stream_exports(
    spark: SparkSession,
    landing: Sequence[str],
    settle: float = 0.0,
    block_bytes: int = BLOCK_BYTES,
    ledger: str | None = None,
) -> DataFrame:
    """Text blocks of every text file and archive that appears in the landing folders.

    Each file is one export named by its stem.  All steps are per row, so no
    state is kept; a file is read whole, by byte ranges spread over tasks.  A file
    that cannot be used is a row with ``error`` and no text.  The files taken are
    recorded in ``ledger``, by default a folder in the shared folder that belongs
    to these landing folders.
    """
    register(spark)
    folders = [str(p) for p in landing]
    if ledger is None:
        mark = hashlib.md5(json.dumps(sorted(folders)).encode("utf-8")).hexdigest()
        ledger = f"{shared_folder(spark).rstrip('/')}/parley/ledger-{mark}"
    listing = (
        spark.readStream.format("chat_files")
        .option("landing", json.dumps(folders))
        .option("settle", str(settle))
        .option("ledger", ledger)
        .load()
    )
    chosen = chat_of_texts(listing).unionByName(chat_of_archives(listing))
    return read_chat_files(chosen, block_bytes)


def stream_messages(
    spark: SparkSession,
    landing: Sequence[str],
    lang: str | None = None,
    min_words: int = 3,
    settle: float = 0.0,
    **parse_options,
) -> DataFrame:
    """Parsed and cleaned messages of newly landed exports.

    A stream cannot look at a whole group first, so the language is forced or
    found per message.
    """
    messages = parse_exports(stream_exports(spark, landing, settle), **parse_options)
    return clean_messages(
        messages, lang=lang, min_words=min_words, per_message_language=lang is None
    )
