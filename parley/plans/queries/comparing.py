"""Groups side by side, set operations and label helpers."""

from __future__ import annotations

from pyspark.sql import functions as F

from parley.functions import text as T
from parley.operators import cards, compare, topics
from parley.plans.queries.registry import query, sql_string
from parley.plans.queries.views import (
    CHAT,
    EVENT_TOPICS,
    EVENTS,
    chat_messages,
    day_text,
    event_messages,
    event_topics,
    load,
    time_text,
)

W = "WITH " + EVENTS
WT = "WITH " + EVENT_TOPICS

_DAYS = 'greatest(1, floor((epoch_us(max("timestamp")) - epoch_us(min("timestamp"))) / 86400000000))'
_ACTIVITY = f""", act AS (SELECT group_name, count(*) AS nb_messages, count(DISTINCT author) AS nb_participants,
  round_even(count(*) / {_DAYS}, 2) AS msgs_per_day, min("timestamp") AS s, max("timestamp") AS e, {_DAYS} AS days
  FROM em GROUP BY group_name)"""


@query(
    "compare_activity",
    W
    + _ACTIVITY
    + """SELECT group_name, nb_messages, nb_participants, msgs_per_day,
strftime(s, '%Y-%m-%d %H:%M:%S') AS period_start, strftime(e, '%Y-%m-%d %H:%M:%S') AS period_end FROM act""",
)
def compare_activity(spark, d):
    out = compare.compare_activity(event_messages(spark, d))
    return out.withColumns({c: time_text(c) for c in ("period_start", "period_end")})


@query(
    "activity_table",
    W
    + _ACTIVITY
    + """SELECT group_name, format('{:,}', nb_messages) AS nb_messages, CAST(nb_participants AS VARCHAR) AS nb_participants,
format('{:.1f}', msgs_per_day) AS msgs_per_day, strftime(s, '%d %b %Y') AS period_start, strftime(e, '%d %b %Y') AS period_end,
format('{:,}', CAST(days AS BIGINT)) AS duration_days FROM act""",
)
def activity_table(spark, d):
    return cards.activity_table(compare.compare_activity(event_messages(spark, d)))


@query(
    "comparison_cards",
    W
    + _ACTIVITY
    + """SELECT CAST(count(*) AS VARCHAR) AS groups_compared, format('{:,}', CAST(sum(nb_messages) AS BIGINT)) AS total_messages,
format('{:,}', CAST(sum(nb_participants) AS BIGINT)) AS participants, strftime(min(s), '%d %b %Y') AS earliest_message FROM act""",
)
def comparison_cards(spark, d):
    return cards.comparison_cards(compare.compare_activity(event_messages(spark, d)))


@query(
    "group_detail_cards",
    W
    + _ACTIVITY
    + """SELECT group_name, format('{:,}', nb_messages) AS nb_messages, CAST(nb_participants AS VARCHAR) AS nb_participants,
strftime(s, '%d %b %Y') || ' → ' || strftime(e, '%d %b %Y') AS period FROM act""",
)
def group_detail_cards(spark, d):
    return cards.group_detail_cards(event_messages(spark, d))


_SENTIMENT = """, s AS (SELECT group_name, avg(sentiment_score) AS m,
  count(*) FILTER (WHERE sentiment_label = 'positive') / CAST(count(*) AS DOUBLE) AS p,
  count(*) FILTER (WHERE sentiment_label = 'negative') / CAST(count(*) AS DOUBLE) AS n FROM em GROUP BY group_name)"""


@query(
    "compare_sentiment",
    W
    + _SENTIMENT
    + "SELECT group_name, round(m, 6) AS sentiment_mean, round(p, 6) AS pos_pct, round(n, 6) AS neg_pct FROM s",
)
def compare_sentiment(spark, d):
    out = compare.compare_sentiment(event_messages(spark, d))
    return out.select(
        "group_name", *(F.round(c, 6).alias(c) for c in ("sentiment_mean", "pos_pct", "neg_pct"))
    )


@query(
    "sentiment_split",
    W
    + _SENTIMENT
    + """SELECT group_name, round(p * 100, 6) AS positive, round(100 - p * 100 - n * 100, 6) AS neutral,
round(n * 100, 6) AS negative FROM s""",
)
def sentiment_split(spark, d):
    out = cards.sentiment_split(compare.compare_sentiment(event_messages(spark, d)))
    return out.select("group_name", *(F.round(c, 6).alias(c) for c in ("positive", "neutral", "negative")))


@query(
    "compare_topics_long",
    WT
    + """SELECT group_name, topic_label, round(arg_max(weight, topic_id), 6) AS weight FROM gt GROUP BY group_name, topic_label""",
)
def compare_topics_long(spark, d):
    out = compare.compare_topics_long(event_topics(event_messages(spark, d)))
    return out.withColumn("weight", F.round("weight", 6))


_LABELS = [
    "cours / examen / prof / salle / note",
    "sport / match / score / but / stade",
    "g0 / local / rue / ville / gare",
    "g1 / local / rue / ville / gare",
    "g2 / local / rue / ville / gare",
    "famille / fête",
]


@query(
    "compare_topics",
    WT
    + ", l AS (SELECT group_name, topic_label, arg_max(weight, topic_id) AS w FROM gt GROUP BY ALL) SELECT group_name, "
    + ", ".join(
        f'round(coalesce(max(w) FILTER (WHERE topic_label = {sql_string(x)}), 0), 6) AS "{x}"' for x in _LABELS
    )
    + " FROM l GROUP BY group_name",
)
def compare_topics(spark, d):
    out = compare.compare_topics(event_topics(event_messages(spark, d)))
    return out.select("group_name", *(F.round(f"`{c}`", 6).alias(c) for c in out.columns[1:]))


@query(
    "compare_timelines",
    W
    + """SELECT strftime("timestamp", '%Y-%m-%d') AS day, count(*) FILTER (WHERE group_name = 'g0') AS g0,
count(*) FILTER (WHERE group_name = 'g1') AS g1, count(*) FILTER (WHERE group_name = 'g2') AS g2 FROM em GROUP BY 1""",
)
def compare_timelines(spark, d):
    out = compare.compare_timelines(event_messages(spark, d))
    return out.withColumn("day", day_text())


_SHARED = """, pr AS (SELECT DISTINCT CASE WHEN author LIKE '%5' THEN author || '@' || group_name ELSE author END AS author, group_name FROM em),
sh AS (SELECT author, count(*) AS n FROM pr GROUP BY author HAVING count(*) > 1)"""


def _partly_shared(spark, d):
    # authors ending in 5 have another name in each group
    own = F.when(F.col("author").endswith("5"), F.concat("author", F.lit("@"), "group_name"))
    return event_messages(spark, d).withColumn("author", own.otherwise(F.col("author")))


@query(
    "common_users",
    W
    + _SHARED
    + """SELECT author, string_agg(group_name, '|' ORDER BY group_name) AS groups FROM pr JOIN sh USING (author) GROUP BY author""",
)
def common_users(spark, d):
    out = compare.common_users(_partly_shared(spark, d))
    return out.select("author", F.array_join("groups", "|").alias("groups"))


@query(
    "common_users_long",
    W + _SHARED + "SELECT author, group_name, n AS n_groups FROM pr JOIN sh USING (author)",
)
def common_users_long(spark, d):
    return compare.common_users_long(_partly_shared(spark, d))


@query(
    "common_users_ranked",
    W
    + _SHARED
    + """SELECT author, string_agg(group_name, ', ' ORDER BY group_name) AS groups, CAST(any_value(n) AS INTEGER) AS n_groups
FROM pr JOIN sh USING (author) GROUP BY author""",
)
def common_users_ranked(spark, d):
    return compare.common_users_ranked(_partly_shared(spark, d))


@query(
    "intersect_authors",
    W
    + _SHARED
    + "SELECT author FROM pr WHERE group_name = 'g0' INTERSECT SELECT author FROM pr WHERE group_name = 'g1'",
)
def intersect_authors(spark, d):
    return compare.intersect_authors(_partly_shared(spark, d), "g0", "g1")


@query(
    "union_groups",
    "WITH "
    + EVENTS
    + ","
    + CHAT
    + """SELECT group_name, author, count(*) AS messages FROM (
  SELECT group_name, author FROM em UNION ALL SELECT group_name, author FROM cm0) GROUP BY ALL""",
)
def union_groups(spark, d):
    both = compare.union_groups(event_messages(spark, d), chat_messages(spark, d))
    return both.groupBy("group_name", "author").agg(F.count(F.lit(1)).alias("messages"))


@query(
    "run_summary",
    W
    + """, raw AS (SELECT group_name, count(*) AS raw_messages FROM em GROUP BY ALL),
cl AS (SELECT group_name, count(*) AS clean_messages, count(DISTINCT author) AS authors,
  count(*) FILTER (WHERE sentiment_score > 0) AS positive_scores, count(DISTINCT topic_id) AS topics
  FROM em WHERE msg_type = 'text' GROUP BY ALL)
SELECT * FROM raw JOIN cl USING (group_name)""",
)
def run_summary(spark, d):
    raw = event_messages(spark, d)
    return cards.run_summary(raw, raw.filter(F.col("msg_type") == "text"))


# -- topic tables and labels -----------------------------------------------------


@query("group_topic_weight", WT + "SELECT group_name, topic_id, round(weight, 6) AS weight FROM gt")
def group_topic_weight(spark, d):
    return topics.topic_weights(event_messages(spark, d), 5).withColumn("weight", F.round("weight", 6))


@query(
    "topic_message_count",
    WT
    + """SELECT em.group_name, topic_label, count(*) AS messages FROM em JOIN gt USING (group_name, topic_id)
GROUP BY em.group_name, topic_label""",
)
def topic_message_count(spark, d):
    from parley.operators.users import user_topics

    messages = event_messages(spark, d)
    return topics.topic_message_count(user_topics(messages, event_topics(messages)))


@query(
    "top_topic_labels",
    WT
    + """SELECT group_name, topic_id, topic_label, round(weight, 6) AS weight, CAST(rn AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY group_name ORDER BY weight DESC, topic_id) AS rn FROM gt) WHERE rn <= 3""",
)
def top_topic_labels(spark, d):
    out = topics.top_topic_labels(event_topics(event_messages(spark, d)))
    return out.withColumn("weight", F.round("weight", 6))


@query(
    "topic_word_weights",
    WT
    + """, w AS (SELECT group_name, topic_id, string_split(topic_label, ' / ') AS ws FROM gt)
SELECT group_name, topic_id, trim(ws[i]) AS word, CAST(greatest(1, len(ws) - i + 1) AS INTEGER) AS weight
FROM (SELECT *, unnest(range(1, len(ws) + 1)) AS i FROM w)""",
)
def topic_word_weights(spark, d):
    return topics.topic_word_weights(event_topics(event_messages(spark, d)))


@query(
    "truncate_label",
    WT
    + """, w AS (SELECT group_name, topic_id, list_transform(string_split(topic_label, '/'), lambda x: trim(x)) AS ws FROM gt)
SELECT group_name, topic_id, array_to_string(ws[1:3], ' / ') || CASE WHEN len(ws) > 3 THEN '…' ELSE '' END AS short_label FROM w""",
)
def truncate_label(spark, d):
    out = event_topics(event_messages(spark, d))
    return out.select("group_name", "topic_id", T.truncate_label(F.col("topic_label")).alias("short_label"))


@query(
    "clean_label",
    """SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN '🎉🎉' WHEN 1 THEN trim(c_name) ELSE c_name END AS label FROM customer""",
)
def clean_label(spark, d):
    name = (
        F.when(F.col("c_custkey") % 3 == 0, F.lit("🎉🎉"))
        .when(F.col("c_custkey") % 3 == 1, F.concat(F.lit("👍🏽 "), "c_name", F.lit(" ❤️")))
        .otherwise(F.col("c_name"))
    )
    return load(spark, d, "customer").select("c_custkey", T.clean_label(name).alias("label"))


@query(
    "format_duration",
    """SELECT event_id, CASE WHEN s >= 3600 THEN (s // 3600) || 'h ' || (s // 60 % 60) || 'm ' || (s % 60) || 's'
WHEN s >= 60 THEN (s // 60) || 'm ' || (s % 60) || 's' ELSE s || 's' END AS duration
FROM (SELECT event_id, CAST(floor(value * 100) AS BIGINT) AS s FROM events)""",
)
def format_duration(spark, d):
    return load(spark, d, "events").select("event_id", T.format_duration(F.col("value") * 100).alias("duration"))
