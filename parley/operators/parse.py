"""Raw export text -> one typed row per message."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.functions import patterns as P
from parley.functions import text as T
from parley.functions.dates import message_timestamp
from parley.functions.once import computed_once
from parley.session import attach

# Stands between captured fields; it cannot occur in normalised text.
_SEP = "\x01"

_LINE = f"(?iu)^(?:{P.ANDROID_LINE}|{P.IOS_LINE})$"
# nine fields: the capture of whichever form matched, the other one is empty
_FIELDS = _SEP.join(
    ["$1$10", "$2$11", "$3$12", "$4$13", "$5$14", "$6$15", "$7", "$8$16", "$9$17"]
)

# the three numbers of a message's date, at the start of its line
_DATE = rf"(?m)^[\p{{Cf}}{P.SPACE}]*+\[?([0-9]{{1,2}}/[0-9]{{1,2}}/[0-9]{{2,4}})(?=[,{P.SPACE}à])"

MESSAGE_COLUMNS = ["timestamp", "author", "message", "msg_type", "group_name"]


def split_messages(blocks: DataFrame, text: str = "text", extended: bool = False) -> DataFrame:
    """Explode text blocks into ``line`` rows, one per message, with ``seq``.

    A line that opens with a time stamp starts a message; any other line is
    appended to the one before with a single space.  Blank lines and text before
    the first message vanish.  No shuffle, so it also runs on a stream.
    """
    clean = T.normalize_encoding(F.col(text))
    if extended:
        clean = F.regexp_replace(clean, P.INVISIBLE_MARKS, "")
    clean = F.regexp_replace(clean, P.OTHER_LINE_ENDS, "\n")
    # strip every line and drop blank ones: a newline with all space around it
    edge = rf"(?<![{P.SPACE}])[{P.SPACE}&&[^\n]]*+\n[{P.SPACE}]*+"
    clean = T.strip_space(F.regexp_replace(clean, edge, "\n"))
    pieces = F.split(clean, rf"\n(?={P.MESSAGE_PREFIX})")
    kept = [c for c in blocks.columns if c != text]
    return (
        blocks.select(*kept, F.posexplode_outer(pieces).alias("seq", "line"))
        .filter(F.col("line").rlike("^" + P.MESSAGE_PREFIX))
        .withColumn("line", F.regexp_replace("line", "\n", " "))
    )


def parse_lines(
    lines: DataFrame,
    line: str = "line",
    date_order: str | Column = "DMY",
    anonymize: bool = False,
    hash_digits: int = 6,
    extended: bool = False,
) -> DataFrame:
    """Read the fields of each line; rows without author or valid time go away.

    One regex pass covers both export forms and yields all fields at once.
    """
    fields = F.split(F.regexp_replace(F.col(line), _LINE, _FIELDS), _SEP)
    kept = [c for c in lines.columns if c != line]
    parsed = computed_once(lines, "_f", fields).filter(F.size("_f") == 9)
    f = lambda i: F.col("_f")[i]
    author = T.strip_space(f(7))
    if anonymize:
        author = T.anonymize_author(author, hash_digits)
    message = T.strip_space(f(8))
    rows = parsed.select(
        *kept,
        message_timestamp(*(f(i) for i in range(7)), date_order=date_order).alias("timestamp"),
        author.alias("author"),
        message.alias("message"),
    ).filter(F.col("timestamp").isNotNull())
    return classify_messages(rows, extended)


def classify_messages(messages: DataFrame, extended: bool = False) -> DataFrame:
    """Add ``msg_type``.  Two dozen substring tests spare most messages the
    forty case-insensitive patterns."""
    folded = computed_once(messages, "_folded", T.fold_case(F.col("message")))
    kind = F.when(
        T.may_be_notice(F.col("_folded")), T.classify_message(F.col("message"), extended)
    ).otherwise("text")
    return computed_once(folded, "msg_type", kind).drop("_folded")


def date_orders(blocks: DataFrame, key: str = "path", text: str = "text") -> DataFrame:
    """(key, date_order, dates, dmy_dates, mdy_dates, dmy_steps_back, mdy_steps_back,
    undecided): how each export writes its dates, found from all its messages.

    The order under which more dates exist wins, so one day above 12 decides an
    export, and a pasted date does not.  Where all dates exist either way, the
    order wins that steps back in time less often from one message to the next
    of a block, since a chat is written in the order of time.  What is still
    open is ``undecided`` and day first.  An export without dates is undecided,
    one whose text is null has no row.  Each block gives one row before anything
    is shuffled, so an export of any size is one small sum.
    """
    found = F.regexp_extract_all(T.normalize_encoding(F.col(text)), F.lit(_DATE), F.lit(1))
    numbers = F.transform(found, lambda d: F.split(d, "/").cast("array<int>"))
    dates = computed_once(blocks.filter(F.col(text).isNotNull()).select(key, text), "_dates", numbers)

    def days(day: int, month: int) -> Column:
        fits = lambda d: d[day].between(1, 31) & d[month].between(1, 12)
        return F.transform(F.filter("_dates", fits), lambda d: (d[2] % 100) * 372 + d[month] * 31 + d[day])

    def steps_back(days: str) -> Column:
        n = F.greatest(F.size(days) - 1, F.lit(0))
        later = F.zip_with(F.slice(days, 1, n), F.slice(days, 2, n), lambda a, b: b < a)
        return F.size(F.filter(later, lambda back: back))

    read = dates.select(key, F.size("_dates").alias("_n"), days(0, 1).alias("_dmy"), days(1, 0).alias("_mdy"))
    total = lambda c: F.sum(c).cast("bigint")
    evidence = read.groupBy(key).agg(
        total("_n").alias("dates"),
        total(F.size("_dmy")).alias("dmy_dates"),
        total(F.size("_mdy")).alias("mdy_dates"),
        total(steps_back("_dmy")).alias("dmy_steps_back"),
        total(steps_back("_mdy")).alias("mdy_steps_back"),
    )
    dmy = F.struct(F.col("dmy_dates"), -F.col("dmy_steps_back"))
    mdy = F.struct(F.col("mdy_dates"), -F.col("mdy_steps_back"))
    return evidence.select(
        key, F.when(mdy > dmy, "MDY").otherwise("DMY").alias("date_order"), *evidence.columns[1:],
        (mdy == dmy).alias("undecided"),
    )


def parse_exports(
    exports: DataFrame,
    group_name: str | None = None,
    date_order: str = "DMY",
    anonymize: bool = False,
    hash_digits: int = 6,
    extended: bool = False,
    orders: DataFrame | None = None,
) -> DataFrame:
    """exports(path, group_name, block, text) -> message table with lineage.

    With ``date_order="auto"`` the order is found for each path by ``date_orders``,
    or taken from ``orders``, a table (path, date_order).  That reads the exports
    once more and needs a batch; paths that are missing there are day first.
    """
    texts = exports.filter(F.col("text").isNotNull()).select("path", "group_name", "block", "text")
    if group_name is not None:
        texts = texts.withColumn("group_name", F.lit(group_name))
    order: str | Column = date_order
    if date_order == "auto":
        if exports.isStreaming and orders is None:
            raise ValueError("date_order 'auto' needs whole exports: give a stream its date order, or a table of orders")
        found = date_orders(texts) if orders is None else orders
        texts = attach(texts, found.select("path", F.col("date_order").alias("_order")), ["path"])
        order = F.col("_order")
    parsed = parse_lines(
        split_messages(texts, extended=extended),
        date_order=order,
        anonymize=anonymize,
        hash_digits=hash_digits,
        extended=extended,
    )
    return parsed.select(*MESSAGE_COLUMNS, "path", "block", "seq")


def anonymize_authors(messages: DataFrame, digits: int = 6) -> DataFrame:
    return messages.withColumn("author", T.anonymize_author(F.col("author"), digits))


def assign_group_name(messages: DataFrame, name: str | None = None, path: str = "path") -> DataFrame:
    """The given name, else the stem of the file the row came from."""
    value = F.lit(name) if name else T.file_stem(F.col(path))
    return messages.withColumn("group_name", value)
