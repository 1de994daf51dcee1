"""Author profiles and topic joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from parley.operators import users
from parley.plans.queries.registry import query
from parley.plans.queries.views import EVENT_TOPICS, event_messages, event_topics

WT = "WITH " + EVENT_TOPICS

_AGG = """, ag AS (SELECT em.group_name, em.author, em.topic_id, any_value(gt.topic_label) AS topic_label,
  avg(topic_score) AS score, count(topic_score) AS n FROM em JOIN gt USING (group_name, topic_id)
  GROUP BY em.group_name, em.author, em.topic_id),
tt AS (SELECT group_name, author,
  string_agg(topic_label || '=' || format('{:.6f}', score), '|' ORDER BY n DESC, topic_id) AS top_topics
  FROM ag GROUP BY group_name, author)"""


def _flat_topics(column: str = "top_topics"):
    shown = F.transform(
        column,
        lambda t: F.concat(
            t["label"], F.lit("="), F.call_function("format_number", t["score"], F.lit("0.000000"))
        ),
    )
    return F.array_join(shown, "|").alias("top_topics")


@query(
    "user_topics",
    WT
    + """SELECT em.group_name, em.author, em.topic_id, topic_label, round(topic_score, 6) AS topic_score
FROM em LEFT JOIN gt USING (group_name, topic_id)""",
)
def user_topics(spark, d):
    messages = event_messages(spark, d)
    table = event_topics(messages)
    return users.user_topics(messages, table).withColumn("topic_score", F.round("topic_score", 6))


@query("top_topics", WT + _AGG + "SELECT * FROM tt")
def top_topics(spark, d):
    messages = event_messages(spark, d)
    out = users.top_topics(messages, event_topics(messages))
    return out.select("group_name", "author", _flat_topics())


@query(
    "top_topics_join",
    WT
    + _AGG
    + "SELECT group_name, author, topic_id, topic_label, round(score, 6) AS score, n AS messages FROM ag",
)
def top_topics_join(spark, d):
    from parley.session import attach

    messages = event_messages(spark, d)
    labels = event_topics(messages).select("group_name", "topic_id", "topic_label")
    joined = attach(users.topic_totals(messages), labels, ["group_name", "topic_id"])
    return joined.select(
        "group_name", "author", "topic_id", "topic_label", F.round("score", 6).alias("score"), "messages"
    )


_PROFILE = (
    WT
    + _AGG
    + """, base AS (SELECT group_name, author, count(*) AS message_count,
  round(avg(len(list_filter(string_split(message, ' '), lambda x: x <> ''))), 6) AS avg_message_length,
  round(avg(sentiment_score), 6) AS sentiment_mean FROM em GROUP BY ALL),
hr AS (SELECT group_name, author, string_agg(hh || ':' || n, ',' ORDER BY hh) AS activity_hours
  FROM (SELECT group_name, author, hh, count(*) AS n FROM em GROUP BY ALL) GROUP BY ALL),
dy AS (SELECT group_name, author, weekday AS most_active_day FROM (
  SELECT group_name, author, weekday, row_number() OVER (PARTITION BY group_name, author ORDER BY count(*) DESC, weekday_no) AS rn
  FROM em GROUP BY group_name, author, weekday, weekday_no) WHERE rn = 1)
SELECT * FROM base JOIN hr USING (group_name, author) JOIN dy USING (group_name, author) JOIN tt USING (group_name, author)"""
)


def _flat_profiles(profiles):
    hours = F.transform(
        F.map_entries("activity_hours"), lambda e: F.concat_ws(":", e["key"], e["value"])
    )
    return profiles.select(
        "group_name",
        "author",
        "message_count",
        F.round("avg_message_length", 6).alias("avg_message_length"),
        F.round("sentiment_mean", 6).alias("sentiment_mean"),
        F.array_join(hours, ",").alias("activity_hours"),
        "most_active_day",
        _flat_topics(),
    )


@query("user_profiles", _PROFILE)
def user_profiles(spark, d):
    messages = event_messages(spark, d).withColumn("tokens", F.split("message", " "))
    return _flat_profiles(users.user_profiles(messages, event_topics(messages)))


@query("profile_for", _PROFILE + " WHERE author = 'user_7'")
def profile_for(spark, d):
    messages = event_messages(spark, d).withColumn("tokens", F.split("message", " "))
    return _flat_profiles(users.profile_for(messages, "user_7", event_topics(messages)))
