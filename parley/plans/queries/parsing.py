"""Parsing, on export texts that Spark derives from the conversations table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.functions import patterns as P
from parley.functions import text as T
from parley.functions.dates import message_timestamp
from parley.operators import parse
from parley.plans.queries.registry import query, sql_string
from parley.plans.queries.views import (
    CHAT,
    CHAT_TYPED,
    chat_messages,
    load,
    msg_type_sql,
    one_line_sql,
    time_text,
)

W = "WITH " + CHAT
TURNS_PER_BLOCK = 8


def export_lines(messages: DataFrame, form: str | None = None) -> DataFrame:
    """Each message as it stands in an export of the given form ('android' or
    'ios'); without one, even chats are Android and odd ones iOS."""
    android = F.concat(
        F.date_format("timestamp", "dd/MM/yyyy, HH:mm"), F.lit(" - "), "author", F.lit(": "), "message"
    )
    ios = F.concat(
        F.lit("["), F.date_format("timestamp", "dd/MM/yyyy"), F.lit(" à "),
        F.date_format("timestamp", "HH:mm:ss"), F.lit("] "), "author", F.lit(" : "), "message",
    )
    if form is not None:
        return messages.withColumn("line", {"android": android, "ios": ios}[form])
    return messages.withColumn("line", F.when(F.col("conv_id") % 2 == 0, android).otherwise(ios))


def export_blocks(spark: SparkSession, d: str, lines: DataFrame | None = None) -> DataFrame:
    """Text blocks of a few messages each: (path, group_name, block, text)."""
    rows = export_lines(chat_messages(spark, d)) if lines is None else lines
    keyed = rows.withColumn("part", F.floor(F.col("turn") / TURNS_PER_BLOCK).cast("bigint"))
    ordered = F.array_sort(F.collect_list(F.struct("turn", "line")))
    return keyed.groupBy("group_name", "conv_id", "part").agg(
        F.concat(F.lit("left over\n"), F.array_join(F.transform(ordered, lambda x: x["line"]), "\n")).alias("text")
    ).select(
        F.concat(F.lit("/exports/"), "group_name", F.lit("/chat-"), "conv_id", F.lit(".txt")).alias("path"),
        "group_name",
        (F.col("conv_id") * 1000 + F.col("part")).alias("block"),
        "text",
    )


_PARSED = f""", one AS (SELECT *, {one_line_sql('message')} AS msg FROM cm0),
parsed AS (SELECT "timestamp", author, group_name, conv_id, msg AS message, {msg_type_sql('msg')} AS msg_type FROM one WHERE msg <> '')"""

_PREFIX_SQL = """CASE WHEN conv_id % 2 = 0
  THEN strftime("timestamp", '%d/%m/%Y, %H:%M') || ' - ' || author || ': '
  ELSE '[' || strftime("timestamp", '%d/%m/%Y') || ' à ' || strftime("timestamp", '%H:%M:%S') || '] ' || author || ' : ' END"""


@query(
    "split_messages",
    W + _PARSED + f"SELECT group_name, {_PREFIX_SQL} || message AS line FROM parsed",
)
def split_messages(spark, d):
    return parse.split_messages(export_blocks(spark, d)).select("group_name", "line")


_SELECT = """SELECT strftime("timestamp", '%Y-%m-%d %H:%M:%S') AS "timestamp", author, message, msg_type, group_name FROM parsed"""


def _shown(messages: DataFrame) -> DataFrame:
    return messages.select(time_text("timestamp"), "author", "message", "msg_type", "group_name")


@query("parse_exports", W + _PARSED + _SELECT)
def parse_exports(spark, d):
    return _shown(parse.parse_exports(export_blocks(spark, d)))


def _one_form(spark, d, form: str) -> DataFrame:
    lines = export_lines(chat_messages(spark, d), form)
    return _shown(parse.parse_exports(export_blocks(spark, d, lines)))


@query("parse_android", W + _PARSED + _SELECT)
def parse_android(spark, d):
    return _one_form(spark, d, "android")


@query("parse_ios", W + _PARSED + _SELECT)
def parse_ios(spark, d):
    return _one_form(spark, d, "ios")


@query("drop_unparsed", W + _PARSED + _SELECT + " WHERE NOT author LIKE 'assistant%'")
def drop_unparsed(spark, d):
    # assistant turns are written as notices without "author:", which are dropped
    rows = export_lines(chat_messages(spark, d))
    notice = F.concat(F.date_format("timestamp", "dd/MM/yyyy, HH:mm"), F.lit(" - Alice a rejoint"))
    lines = rows.withColumn(
        "line", F.when(F.col("author").startswith("assistant"), notice).otherwise(F.col("line"))
    )
    return _shown(parse.parse_exports(export_blocks(spark, d, lines)))


@query(
    "parse_timestamp",
    """WITH t AS (SELECT event_id, ts, event_id % 7 AS f FROM events)
SELECT event_id, CASE WHEN f IN (5, 6) THEN NULL
  WHEN f IN (0, 1) THEN strftime(ts, '%Y-%m-%d %H:%M') || ':00'
  ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS parsed FROM t""",
)
def parse_timestamp(spark, d):
    e = load(spark, d, "events").withColumn("f", F.col("event_id") % 7)
    fmt = lambda pattern: F.date_format("ts", pattern)
    twelve = F.col("f").isin(1, 3)
    # 0: H:mm, 1: h:mm am, 2: HH:mm:ss, 3: h:mm:ss PM, 4: two-digit year, 5: 31/02, 6: 13 PM
    day = F.when(F.col("f") == 5, "31").otherwise(fmt("d"))
    month = F.when(F.col("f") == 5, "02").otherwise(fmt("M"))
    year = F.when(F.col("f") == 4, fmt("yy")).otherwise(fmt("yyyy"))
    hour = F.when(F.col("f") == 6, "13").when(twelve, fmt("h")).otherwise(fmt("H"))
    second = F.when(F.col("f").isin(0, 1), F.lit("")).otherwise(fmt("ss"))
    half = F.when(F.col("f") == 6, "PM").when(F.col("f") == 1, F.lower(fmt("a"))).when(F.col("f") == 3, fmt("a"))
    ts = message_timestamp(day, month, year, hour, fmt("mm"), second, half)
    return e.select("event_id", F.date_format(ts, "yyyy-MM-dd HH:mm:ss").alias("parsed"))


@query("classify_msg_type", "WITH " + CHAT_TYPED + "SELECT seq, msg_type FROM cm")
def classify_msg_type(spark, d):
    return parse.classify_messages(chat_messages(spark, d)).select("seq", "msg_type")


@query(
    "assign_group_name",
    """SELECT page_id, regexp_replace(regexp_extract(url, '([^/]*)/*$', 1), '^(.+)\\.[^.]+$', '\\1') AS group_name FROM pages""",
)
def assign_group_name(spark, d):
    pages = load(spark, d, "pages").select("page_id", F.col("url").alias("path"))
    return parse.assign_group_name(pages).select("page_id", "group_name")


@query(
    "anonymize_author",
    W + "SELECT seq, 'USER_' || substr(md5(trim(author)), 1, 6) AS author FROM cm0",
)
def anonymize_author(spark, d):
    messages = chat_messages(spark, d).withColumn(
        "author", F.concat(F.lit(" "), "author", F.lit("\t "))
    )
    return parse.anonymize_authors(messages).select("seq", "author")


@query(
    "anonymize_phone",
    f"""WITH p AS (SELECT doc_id, string_split_regex(text, {sql_string(P.PHONE)}) AS kept,
  regexp_extract_all(text, {sql_string(P.PHONE)}) AS found FROM documents),
z AS (SELECT doc_id, list_transform(list_zip(kept, found), lambda x: x[1] || CASE WHEN x[2] IS NULL THEN ''
  ELSE '[USER_' || substr(md5(x[2]), 1, 6) || ']' END) AS parts FROM p)
SELECT doc_id, md5(array_to_string(parts, '')) AS text_md5 FROM z""",
)
def anonymize_phone(spark, d):
    hidden = T.anonymize_phone(F.col("text"))
    return load(spark, d, "documents").select("doc_id", F.md5(F.encode(hidden, "UTF-8")).alias("text_md5"))


@query(
    "normalize_encoding",
    "SELECT conv_id, turn, text || ' ' || role AS text FROM conversations",
)
def normalize_encoding(spark, d):
    noisy = F.concat(F.lit("\x00\x07"), "text", F.lit(" \x1f\x7f"), "role", F.lit("\x0b"))
    return load(spark, d, "conversations").select(
        "conv_id", "turn", T.normalize_encoding(noisy).alias("text")
    )


@query(
    "detect_input_type",
    """SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'zip' WHEN 1 THEN 'txt' WHEN 2 THEN 'dir' WHEN 3 THEN NULL ELSE 'txt' END AS kind
FROM documents""",
)
def detect_input_type(spark, d):
    from parley.sources.exports import input_type

    suffix = F.element_at(F.array(*map(F.lit, [".ZIP", ".txt", ".d", ".pdf", "_chat.Txt"])), F.col("doc_id").cast("int") % 5 + 1)
    path = F.concat(F.lit("/exports/"), "source", F.lit("/"), "doc_id", suffix)
    return load(spark, d, "documents").select(
        "doc_id", input_type(path, F.col("doc_id") % 5 == 2).alias("kind")
    )


# Exports of both date orders: a group's conversations of one order are one export.
_MONTH_FIRST = "conv_id % 3 = 0"
_PER_BLOCK = 500

_DATE_ORDERS = f"""WITH {CHAT}, spaced AS (
  SELECT * REPLACE ("timestamp" + to_days(CAST(conv_id % 360 AS INTEGER)) AS "timestamp") FROM cm0),
w AS (
  SELECT group_name, {_MONTH_FIRST} AS month_first, conv_id // {_PER_BLOCK} AS block, conv_id, turn, day("timestamp") AS d, month("timestamp") AS m, year("timestamp") AS y
  FROM spaced),
dates AS (SELECT '/exports/' || group_name || CASE WHEN month_first THEN '/us' ELSE '/eu' END AS path, block, conv_id, turn,
  y * 372 + CASE WHEN month_first THEN m ELSE d END * 31 + CASE WHEN month_first THEN d ELSE m END AS as_mdy,
  y * 372 + CASE WHEN month_first THEN d ELSE m END * 31 + CASE WHEN month_first THEN m ELSE d END AS as_dmy,
  month_first OR d <= 12 AS fits_mdy, NOT month_first OR d <= 12 AS fits_dmy FROM w),
back_dmy AS (SELECT path, sum(CASE WHEN as_dmy < before THEN 1 ELSE 0 END) AS steps FROM
  (SELECT path, as_dmy, lag(as_dmy) OVER (PARTITION BY path, block ORDER BY conv_id, turn) AS before FROM dates WHERE fits_dmy) GROUP BY 1),
back_mdy AS (SELECT path, sum(CASE WHEN as_mdy < before THEN 1 ELSE 0 END) AS steps FROM
  (SELECT path, as_mdy, lag(as_mdy) OVER (PARTITION BY path, block ORDER BY conv_id, turn) AS before FROM dates WHERE fits_mdy) GROUP BY 1),
n AS (SELECT path, count(*) AS dates, count(*) FILTER (fits_dmy) AS dmy_dates, count(*) FILTER (fits_mdy) AS mdy_dates FROM dates GROUP BY 1),
e AS (SELECT n.*, CAST(coalesce(back_dmy.steps, 0) AS BIGINT) AS dmy_steps_back, CAST(coalesce(back_mdy.steps, 0) AS BIGINT) AS mdy_steps_back
  FROM n LEFT JOIN back_dmy USING (path) LEFT JOIN back_mdy USING (path)),
o AS (SELECT path, CASE WHEN mdy_dates > dmy_dates OR (mdy_dates = dmy_dates AND mdy_steps_back < dmy_steps_back) THEN 'MDY' ELSE 'DMY' END AS date_order,
  dates, dmy_dates, mdy_dates, dmy_steps_back, mdy_steps_back, mdy_dates = dmy_dates AND mdy_steps_back = dmy_steps_back AS undecided FROM e)"""


def mixed_order_blocks(spark: SparkSession, d: str) -> DataFrame:
    """One export per group and date order, in blocks of bounded size; messages by conversation."""
    later = F.make_dt_interval(F.col("conv_id").cast("int") % 360)
    rows = chat_messages(spark, d).withColumns({"_us": F.expr(_MONTH_FIRST), "timestamp": F.col("timestamp") + later})
    date = F.when(F.col("_us"), F.date_format("timestamp", "MM/dd/yyyy")).otherwise(F.date_format("timestamp", "dd/MM/yyyy"))
    line = F.concat(date, F.lit(", "), F.date_format("timestamp", "HH:mm"), F.lit(" - "), "author", F.lit(": "), "message")
    ordered = F.array_sort(F.collect_list(F.struct("conv_id", "turn", line.alias("line"))))
    path = F.concat(F.lit("/exports/"), "group_name", F.when(F.col("_us"), "/us").otherwise("/eu"))
    block = F.floor(F.col("conv_id") / _PER_BLOCK).cast("bigint")
    return rows.groupBy(path.alias("path"), "group_name", block.alias("block")).agg(
        F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("text"),
    )


@query("date_orders", _DATE_ORDERS + " SELECT * FROM o")
def date_orders(spark, d):
    return parse.date_orders(mixed_order_blocks(spark, d))


# an export taken for the other order has day and month exchanged, and loses days above 12
_READ_DATES = """, r AS (SELECT parsed.*, "timestamp" AS t,
    date_order = CASE WHEN conv_id % 3 = 0 THEN 'MDY' ELSE 'DMY' END AS good
  FROM parsed JOIN o ON path = '/exports/' || group_name || CASE WHEN conv_id % 3 = 0 THEN '/us' ELSE '/eu' END)
SELECT strftime(CASE WHEN good THEN t ELSE make_timestamp(year(t), day(t), month(t), hour(t), minute(t), 0) END, '%Y-%m-%d %H:%M:%S') AS "timestamp",
  author, message, msg_type, group_name FROM r WHERE good OR day(t) <= 12"""


@query("parse_mixed_date_orders", _DATE_ORDERS + _PARSED.replace("cm0", "spaced") + _READ_DATES)
def parse_mixed_date_orders(spark, d):
    return _shown(parse.parse_exports(mixed_order_blocks(spark, d), date_order="auto"))
