"""The message views the queries run on, in Spark and in SQL.

events         -> a message stream with real time stamps, three groups
conversations  -> multi-line chat texts, ten groups, some notices mixed in
documents      -> long texts in four languages, one group per source
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.functions import patterns as P
from parley.operators.language import vocabularies
from parley.operators.sentiment import sentiment_label
from parley.operators.topics import topic_weights
from parley.session import spread
from parley.plans.queries.registry import bundled_list, sql_list, sql_string

LANGUAGES = {"de": "german", "en": "english", "es": "spanish", "fr": "french"}


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def day_text(column: str = "day"):
    return F.col(column).cast("string").alias(column)


def time_text(column: str):
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss").alias(column)


# -- events ------------------------------------------------------------------


def event_columns(events: DataFrame) -> DataFrame:
    """Works on a batch and on a stream of the events table."""
    score = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (F.col("value") - 20) / 37))
    kind = F.when(F.col("event_type") == "view", "media").when(F.col("event_type") == "error", "system")
    return events.select(
        F.col("ts").alias("timestamp"),
        F.concat(F.lit("user_"), F.col("user_id")).alias("author"),
        F.concat_ws(" ", "event_type", "event_id").alias("message"),
        kind.otherwise("text").alias("msg_type"),
        F.concat(F.lit("g"), F.col("event_id") % 3).alias("group_name"),
        F.col("event_id").alias("seq"),
        score.alias("sentiment_score"),
        sentiment_label(score).alias("sentiment_label"),
        (F.col("event_id") % 5).cast("int").alias("topic_id"),
        (0.5 + (F.col("event_id") % 47) / 97).alias("topic_score"),
    )


def event_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_columns(load(spark, sf_dir, "events"))


EVENTS = """
em0 AS (
  SELECT ts AS "timestamp", 'user_' || user_id AS author,
         event_type || ' ' || event_id AS message,
         CASE event_type WHEN 'view' THEN 'media' WHEN 'error' THEN 'system' ELSE 'text' END AS msg_type,
         'g' || (event_id % 3) AS group_name, event_id AS seq,
         greatest(CAST(-1 AS DOUBLE), least(CAST(1 AS DOUBLE), (value - 20) / 37)) AS sentiment_score,
         CAST(event_id % 5 AS INTEGER) AS topic_id,
         CAST(0.5 AS DOUBLE) + (event_id % 47) / CAST(97 AS DOUBLE) AS topic_score
  FROM events),
em AS (
  SELECT *, CASE WHEN sentiment_score > 0.05 THEN 'positive'
                 WHEN sentiment_score < -0.05 THEN 'negative' ELSE 'neutral' END AS sentiment_label,
         (dayofweek("timestamp") + 6) % 7 AS weekday_no, dayname("timestamp") AS weekday,
         hour("timestamp") AS hh
  FROM em0)
"""


def _topic_label():
    t = F.col("topic_id")
    return (
        F.when(t == 0, "cours / examen / prof / salle / note")
        .when(t.isin(1, 2), "sport / match / score / but / stade")
        .when(t == 3, F.concat("group_name", F.lit(" / local / rue / ville / gare")))
        .otherwise("famille / fête")
    )


def event_topics(messages: DataFrame) -> DataFrame:
    """The topic table of the events view: labels by topic, weights from the data."""
    weights = topic_weights(messages, 5)
    return weights.select("group_name", "topic_id", _topic_label().alias("topic_label"), "weight")


EVENT_TOPICS = (
    EVENTS
    + """, gt AS (
  SELECT group_name, topic_id,
         CASE WHEN topic_id = 0 THEN 'cours / examen / prof / salle / note'
              WHEN topic_id IN (1, 2) THEN 'sport / match / score / but / stade'
              WHEN topic_id = 3 THEN group_name || ' / local / rue / ville / gare'
              ELSE 'famille / fête' END AS topic_label,
         count(*) / CAST(sum(count(*)) OVER (PARTITION BY group_name) AS DOUBLE) AS weight
  FROM em GROUP BY group_name, topic_id)
"""
)

# -- conversations -------------------------------------------------------------

# half of the messages end with one of these (slots 0..5 of 12), slot 6 adds emoji
NOTICES = {
    0: "<Media omitted>",
    1: "Inès a ajouté Bruno",
    2: "This message was deleted",
    3: "Média omis",
    4: "Greta changed the group name now",
    5: "J'ai ajoutée la note, was readded later",
}


def chat_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations as messages; the text is kept as it is, line breaks too."""
    slot = (F.col("conv_id") * 7 + F.col("turn")) % 12
    text = F.when(slot == 6, F.concat("text", F.lit(" 😀👨‍👩‍👧 ok‍é média OMIS fin")))
    for number, notice in NOTICES.items():
        text = text.when(slot == number, F.concat("text", F.lit(" " + notice)))
    minutes = ((F.col("conv_id") * 37 + F.col("turn")) % 1_000_000).cast("int")
    start = F.expr("timestamp_ntz'2024-01-01 00:00:00'")
    return spread(load(spark, sf_dir, "conversations"), "conv_id", "turn").select(
        (start + F.make_dt_interval(F.lit(0), F.lit(0), minutes)).alias("timestamp"),
        F.concat_ws("_", "role", F.col("conv_id") % 7).alias("author"),
        text.otherwise(F.col("text")).alias("message"),
        F.concat(F.lit("c"), F.col("conv_id") % 10).alias("group_name"),
        (F.col("conv_id") * 100 + F.col("turn")).alias("seq"),
        "conv_id",
        "turn",
    )


def _notice_sql() -> str:
    cases = " ".join(f"WHEN {n} THEN text || {sql_string(' ' + t)}" for n, t in NOTICES.items())
    extra = sql_string(" 😀👨‍👩‍👧 ok‍é média OMIS fin")
    return f"CASE (conv_id * 7 + turn) % 12 WHEN 6 THEN text || {extra} {cases} ELSE text END"


CHAT = f"""
cm0 AS (
  SELECT TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST((conv_id * 37 + turn) % 1000000 AS BIGINT)) AS "timestamp",
         role || '_' || (conv_id % 7) AS author, {_notice_sql()} AS message,
         'c' || (conv_id % 10) AS group_name, conv_id * 100 + turn AS seq, conv_id, turn
  FROM conversations)
"""


def one_line_sql(text: str) -> str:
    """Lines stripped, blank ones dropped, joined by one space."""
    lines = f"string_split_regex(regexp_replace({text}, {sql_string(P.CONTROL_CHARS)}, '', 'g'), '\\n')"
    return (
        f"array_to_string(list_filter(list_transform({lines}, lambda l: trim(l, ' ' || chr(9))), "
        "lambda l: l <> ''), ' ')"
    )


def _re2_notices(patterns: list[str]) -> str:
    edge = r"(?:^|$|[^\p{L}\p{N}_])"
    return "(?i)" + P.any_of([p.replace(r"\b", edge) for p in patterns])


def msg_type_sql(message: str) -> str:
    media = sql_string("(?i)" + P.any_of(P.MEDIA_NOTICES))
    system = sql_string(_re2_notices(P.SYSTEM_NOTICES))
    return (
        f"CASE WHEN regexp_matches({message}, {media}) THEN 'media' "
        f"WHEN regexp_matches({message}, {system}) THEN 'system' ELSE 'text' END"
    )


CHAT_TYPED = CHAT + f", cm AS (SELECT *, {msg_type_sql('message')} AS msg_type FROM cm0)"


# -- documents -----------------------------------------------------------------


def document_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    minutes = (F.col("doc_id") % 1_000_000).cast("int")
    start = F.expr("timestamp_ntz'2024-01-01 00:00:00'")
    return spread(load(spark, sf_dir, "documents"), "doc_id").select(
        (start + F.make_dt_interval(F.lit(0), F.lit(0), minutes)).alias("timestamp"),
        F.concat(F.lit("a"), F.col("doc_id") % 20).alias("author"),
        F.col("text").alias("message"),
        F.lit("text").alias("msg_type"),
        F.col("source").alias("group_name"),
        F.col("doc_id").alias("seq"),
        F.col("lang").alias("true_lang"),
    )


DOCS = """
dm AS (
  SELECT TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST(doc_id % 1000000 AS BIGINT)) AS "timestamp",
         'a' || (doc_id % 20) AS author, text AS message, 'text' AS msg_type,
         source AS group_name, doc_id AS seq, lang AS true_lang
  FROM documents)
"""


def words_sql(text: str, emoji: bool = True) -> str:
    clean = f"regexp_replace({text}, {sql_string(P.CONTROL_CHARS)}, '', 'g')"
    clean = f"regexp_replace({clean}, {sql_string('(?i)' + P.ARTEFACTS)}, '', 'g')"
    if emoji:
        clean = f"regexp_replace({clean}, {sql_string(P.EMOJI)}, '', 'g')"
    parts = f"string_split_regex(lower({clean}), {sql_string(P.NON_WORD)})"
    return f"list_filter({parts}, lambda w: w <> '')"


def stop_sql(words: str, lang: str | None = None) -> str:
    """Words without stop words; ``lang`` is an SQL expression or None for none."""

    def kept(name: str) -> str:
        listed = sql_list(bundled_list(name))
        return f"list_filter({words}, lambda w: length(w) > 1 AND NOT list_contains({listed}, w))"

    if lang is None:
        return f"list_filter({words}, lambda w: length(w) > 1)"
    return f"CASE WHEN {lang} = 'fr' THEN {kept('french')} ELSE {kept('english')} END"


def vote_sql(words: str) -> dict[str, str]:
    return {
        lang: f"len(list_filter({words}, lambda w: list_contains({sql_list(bundled_list(name))}, w)))"
        for lang, name in sorted(LANGUAGES.items())
    }


def winner_sql(prefix: str = "v_") -> str:
    """Most votes, ties to the smaller code, null without votes."""
    names = sorted(LANGUAGES)
    best = f"greatest({', '.join(prefix + n for n in names)})"
    cases = " ".join(f"WHEN {prefix}{n} = {best} THEN '{n}'" for n in names)
    return f"CASE WHEN {best} = 0 THEN NULL {cases} END"


def query_languages() -> dict[str, tuple[str, ...]]:
    return vocabularies(tuple(LANGUAGES))
