"""Activity over time and by author, on the events view."""

from __future__ import annotations

from pyspark.sql import functions as F

from parley.operators import cards, sentiment, temporal, users
from parley.plans.queries.registry import query
from parley.plans.queries.views import EVENTS, day_text, event_messages, time_text

W = "WITH " + EVENTS

_DAYS = """, days AS (SELECT unnest(range(7)) AS weekday_no),
names AS (SELECT weekday_no, ['Monday','Tuesday','Wednesday','Thursday','Friday','Saturday','Sunday'][weekday_no + 1] AS weekday FROM days)"""


@query(
    "timeline_daily",
    W + "SELECT group_name, strftime(\"timestamp\", '%Y-%m-%d') AS day, count(*) AS messages FROM em GROUP BY ALL",
)
def timeline_daily(spark, d):
    return temporal.timeline_daily(event_messages(spark, d)).select("group_name", day_text(), "messages")


_HEATMAP = (
    W
    + _DAYS
    + """, grid AS (SELECT group_name, n.weekday_no, n.weekday, h.hour
      FROM (SELECT DISTINCT group_name FROM em), names n, (SELECT unnest(range(24)) AS hour) h)
SELECT g.group_name, CAST(g.weekday_no AS INTEGER) AS weekday_no, g.weekday, CAST(g.hour AS INTEGER) AS hour,
       count(em.seq) AS messages
FROM grid g LEFT JOIN em ON em.group_name = g.group_name AND em.weekday_no = g.weekday_no AND em.hh = g.hour
GROUP BY ALL"""
)


@query("hourly_heatmap", _HEATMAP)
def hourly_heatmap(spark, d):
    return temporal.hourly_heatmap(event_messages(spark, d))


@query(
    "hourly_heatmap_wide",
    W
    + _DAYS
    + ", gw AS (SELECT group_name, n.* FROM (SELECT DISTINCT group_name FROM em), names n) "
    + "SELECT gw.group_name, CAST(gw.weekday_no AS INTEGER) AS weekday_no, gw.weekday, "
    + ", ".join(f"count(*) FILTER (WHERE em.hh = {h}) AS h{h:02d}" for h in range(24))
    + " FROM gw LEFT JOIN em ON em.group_name = gw.group_name AND em.weekday_no = gw.weekday_no GROUP BY ALL",
)
def hourly_heatmap_wide(spark, d):
    return temporal.hourly_heatmap_wide(event_messages(spark, d))


@query(
    "weekly_activity",
    W
    + _DAYS
    + """SELECT g.group_name, CAST(n.weekday_no AS INTEGER) AS weekday_no, n.weekday, count(em.seq) AS messages
FROM (SELECT DISTINCT group_name FROM em) g CROSS JOIN names n
LEFT JOIN em ON em.group_name = g.group_name AND em.weekday_no = n.weekday_no GROUP BY ALL""",
)
def weekly_activity(spark, d):
    return temporal.weekly_activity(event_messages(spark, d))


@query(
    "calendar_complete",
    W
    + """, hrs AS (SELECT unnest(range(24)) AS hour), a AS (SELECT DISTINCT group_name, author FROM em)
SELECT a.group_name, a.author, CAST(hrs.hour AS INTEGER) AS hour, count(em.seq) AS messages
FROM a CROSS JOIN hrs LEFT JOIN em ON em.group_name = a.group_name AND em.author = a.author AND em.hh = hrs.hour
GROUP BY ALL""",
)
def calendar_complete(spark, d):
    keys = ["group_name", "author"]
    counts = event_messages(spark, d).groupBy(*keys, F.hour("timestamp").alias("hour")).agg(
        F.count(F.lit(1)).alias("messages")
    )
    return temporal.fill_slots(counts, keys, "hour", 24)


@query(
    "monthly_activity",
    W + "SELECT group_name, strftime(\"timestamp\", '%Y-%m') AS month, count(*) AS messages FROM em GROUP BY ALL",
)
def monthly_activity(spark, d):
    return temporal.monthly_activity(event_messages(spark, d))


@query(
    "peak_hour",
    W
    + """SELECT group_name, CAST(hh AS INTEGER) AS peak_hour FROM (
  SELECT group_name, hh, row_number() OVER (PARTITION BY group_name ORDER BY count(*) DESC, hh) AS rn
  FROM em GROUP BY group_name, hh) WHERE rn = 1""",
)
def peak_hour(spark, d):
    return temporal.peak_hour(event_messages(spark, d))


@query(
    "peak_day",
    W
    + """SELECT group_name, weekday AS peak_day FROM (
  SELECT group_name, weekday, row_number() OVER (PARTITION BY group_name ORDER BY count(*) DESC, weekday_no) AS rn
  FROM em GROUP BY group_name, weekday, weekday_no) WHERE rn = 1""",
)
def peak_day(spark, d):
    return temporal.peak_day(event_messages(spark, d))


@query(
    "user_heatmap",
    W
    + _DAYS
    + """, grid AS (SELECT n.weekday_no, n.weekday, h.hour FROM names n, (SELECT unnest(range(24)) AS hour) h),
one AS (SELECT * FROM em WHERE author = 'user_7')
SELECT CAST(g.weekday_no AS INTEGER) AS weekday_no, g.weekday, CAST(g.hour AS INTEGER) AS hour, count(one.seq) AS messages
FROM grid g LEFT JOIN one ON one.weekday_no = g.weekday_no AND one.hh = g.hour GROUP BY ALL""",
)
def user_heatmap(spark, d):
    return temporal.user_heatmap(event_messages(spark, d), "user_7")


@query("filter_author", W + "SELECT author, message, msg_type FROM em WHERE author = 'user_7'")
def filter_author(spark, d):
    from parley.operators.clean import filter_author as only

    return only(event_messages(spark, d), "user_7").select("author", "message", "msg_type")


@query("filter_text", W + "SELECT group_name, author, message FROM em WHERE msg_type = 'text'")
def filter_text(spark, d):
    from parley.operators.clean import filter_text as only

    return only(event_messages(spark, d)).select("group_name", "author", "message")


@query(
    "author_message_count",
    W + "SELECT group_name, author, count(*) AS message_count FROM em GROUP BY ALL",
)
def author_message_count(spark, d):
    return users.author_message_count(event_messages(spark, d))


@query(
    "activity_hours",
    W + "SELECT group_name, author, CAST(hh AS INTEGER) AS hour, count(*) AS messages FROM em GROUP BY ALL",
)
def activity_hours(spark, d):
    hours = users.activity_hours(event_messages(spark, d))
    return hours.select("group_name", "author", F.explode("activity_hours").alias("hour", "messages"))


@query(
    "most_active_day",
    W
    + """SELECT group_name, author, weekday AS most_active_day FROM (
  SELECT group_name, author, weekday,
         row_number() OVER (PARTITION BY group_name, author ORDER BY count(*) DESC, weekday_no) AS rn
  FROM em GROUP BY group_name, author, weekday, weekday_no) WHERE rn = 1""",
)
def most_active_day(spark, d):
    return users.most_active_day(event_messages(spark, d))


@query(
    "user_media_and_days",
    W
    + """SELECT group_name, author, count(*) FILTER (WHERE msg_type = 'media') AS media_count,
count(DISTINCT CAST("timestamp" AS DATE)) AS active_days FROM em GROUP BY ALL""",
)
def user_media_and_days(spark, d):
    return users.media_and_days(event_messages(spark, d))


@query("distinct_authors", W + "SELECT DISTINCT group_name, author FROM em")
def distinct_authors(spark, d):
    return users.distinct_authors(event_messages(spark, d))


@query(
    "msg_type_distribution",
    W
    + """SELECT group_name, msg_type, count(*) AS messages,
round(count(*) / CAST(sum(count(*)) OVER (PARTITION BY group_name) AS DOUBLE), 6) AS share
FROM em GROUP BY group_name, msg_type""",
)
def msg_type_distribution(spark, d):
    return cards.msg_type_distribution(event_messages(spark, d)).withColumn("share", F.round("share", 6))


@query(
    "corpus_stats",
    W
    + """SELECT group_name, count(*) AS messages, count(DISTINCT author) AS participants,
strftime(min("timestamp"), '%Y-%m-%d %H:%M:%S') AS first_ts,
strftime(max("timestamp"), '%Y-%m-%d %H:%M:%S') AS last_ts FROM em GROUP BY ALL""",
)
def corpus_stats(spark, d):
    stats = cards.corpus_stats(event_messages(spark, d))
    return stats.select("group_name", "messages", "participants", time_text("first_ts"), time_text("last_ts"))


# -- sentiment summaries -------------------------------------------------------


@query(
    "sentiment_label",
    W + "SELECT seq, round(sentiment_score, 6) AS sentiment_score, sentiment_label FROM em",
)
def sentiment_label(spark, d):
    rows = event_messages(spark, d)
    return rows.select(
        "seq",
        F.round("sentiment_score", 6).alias("sentiment_score"),
        sentiment.sentiment_label(F.col("sentiment_score")).alias("sentiment_label"),
    )


@query(
    "sentiment_by_user",
    W + "SELECT group_name, author, round(avg(sentiment_score), 6) AS mean_score FROM em GROUP BY ALL",
)
def sentiment_by_user(spark, d):
    return sentiment.sentiment_by_user(event_messages(spark, d)).withColumn(
        "mean_score", F.round("mean_score", 6)
    )


@query(
    "user_sentiment_mean",
    W + "SELECT group_name, author, round(avg(sentiment_score), 6) AS sentiment_mean FROM em GROUP BY ALL",
)
def user_sentiment_mean(spark, d):
    return users.user_sentiment_mean(event_messages(spark, d)).withColumn(
        "sentiment_mean", F.round("sentiment_mean", 6)
    )


@query(
    "sentiment_global",
    W
    + """SELECT group_name, round(avg(sentiment_score), 6) AS mean,
round(count(*) FILTER (WHERE sentiment_label = 'positive') / CAST(count(*) AS DOUBLE), 6) AS pos_pct,
round(count(*) FILTER (WHERE sentiment_label = 'negative') / CAST(count(*) AS DOUBLE), 6) AS neg_pct
FROM em GROUP BY ALL""",
)
def sentiment_global(spark, d):
    out = sentiment.sentiment_global(event_messages(spark, d))
    return out.select("group_name", *(F.round(c, 6).alias(c) for c in ("mean", "pos_pct", "neg_pct")))


@query(
    "sentiment_daily",
    W
    + """SELECT group_name, strftime("timestamp", '%Y-%m-%d') AS day, round(avg(sentiment_score), 6) AS mean_score
FROM em GROUP BY ALL""",
)
def sentiment_daily(spark, d):
    out = sentiment.sentiment_daily(event_messages(spark, d))
    return out.select("group_name", day_text(), F.round("mean_score", 6).alias("mean_score"))


@query(
    "user_sentiment_daily",
    W
    + """, span AS (SELECT group_name, author, min(CAST("timestamp" AS DATE)) AS a, max(CAST("timestamp" AS DATE)) AS b FROM em GROUP BY ALL),
cal AS (SELECT group_name, author, CAST(unnest(generate_series(CAST(a AS TIMESTAMP), CAST(b AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS day FROM span)
SELECT c.group_name, c.author, strftime(c.day, '%Y-%m-%d') AS day, round(avg(em.sentiment_score), 6) AS mean_score
FROM cal c LEFT JOIN em ON em.group_name = c.group_name AND em.author = c.author AND CAST(em."timestamp" AS DATE) = c.day
GROUP BY ALL""",
)
def user_sentiment_daily(spark, d):
    out = sentiment.user_sentiment_daily(event_messages(spark, d))
    return out.select("group_name", "author", day_text(), F.round("mean_score", 6).alias("mean_score"))


@query(
    "sentiment_histogram",
    W
    + """, r AS (SELECT group_name, min(sentiment_score) AS lo, max(sentiment_score) AS hi FROM em GROUP BY ALL)
SELECT group_name, bin, count(*) AS messages, round(min(lo + (bin - 1) * (hi - lo) / 20), 6) AS bin_start
FROM (SELECT em.group_name, lo, hi,
  CAST(least(floor((sentiment_score - lo) / (hi - lo) * 20) + 1, 20) AS INTEGER) AS bin
  FROM em JOIN r USING (group_name)) GROUP BY group_name, bin""",
)
def sentiment_histogram(spark, d):
    out = sentiment.sentiment_histogram(event_messages(spark, d))
    return out.withColumn("bin_start", F.round("bin_start", 6))


@query(
    "sentiment_rank",
    W
    + """SELECT group_name, author, round(avg(sentiment_score), 6) AS mean_score,
avg(sentiment_score) < 0 AS negative FROM em GROUP BY group_name, author""",
)
def sentiment_rank(spark, d):
    return sentiment.sentiment_rank(event_messages(spark, d)).withColumn("mean_score", F.round("mean_score", 6))


@query(
    "author_sentiment_series",
    W
    + """SELECT strftime("timestamp", '%Y-%m-%d %H:%M:%S') AS "timestamp", round(sentiment_score, 6) AS sentiment_score,
sentiment_label FROM em WHERE author = 'user_7' ORDER BY em."timestamp", seq""",
)
def author_sentiment_series(spark, d):
    out = users.author_sentiment_series(event_messages(spark, d), "user_7")
    return out.select(time_text("timestamp"), F.round("sentiment_score", 6).alias("sentiment_score"), "sentiment_label")


# -- cards and top lists ---------------------------------------------------------


@query(
    "stat_cards",
    W
    + """SELECT format('{:,}', count(*)) AS total_messages, CAST(count(DISTINCT author) AS VARCHAR) AS participants,
strftime(min("timestamp"), '%d %b %Y') AS first_message,
format('{:,}', CAST(greatest(1, floor((epoch_us(max("timestamp")) - epoch_us(min("timestamp"))) / 86400000000)) AS BIGINT)) AS days_of_history
FROM em""",
)
def stat_cards(spark, d):
    return cards.stat_cards(event_messages(spark, d))


_DAYS_SQL = (
    'greatest(1, floor((epoch_us(max("timestamp")) - epoch_us(min("timestamp"))) / 86400000000))'
)


@query(
    "overview_cards",
    W
    + f""", kept AS (SELECT * FROM em WHERE msg_type = 'text'),
base AS (SELECT group_name, format('{{:,}}', count(*)) AS messages, format('{{:.1f}}', count(*) / {_DAYS_SQL}) AS avg_per_day,
  CAST(count(DISTINCT author) AS VARCHAR) AS participants, strftime(min("timestamp"), '%d %b %Y') AS period_start,
  strftime(max("timestamp"), '%d %b %Y') AS period_end FROM kept GROUP BY group_name),
ph AS (SELECT group_name, hh FROM (SELECT group_name, hh, row_number() OVER (PARTITION BY group_name ORDER BY count(*) DESC, hh) AS rn FROM kept GROUP BY group_name, hh) WHERE rn = 1),
pd AS (SELECT group_name, weekday FROM (SELECT group_name, weekday, row_number() OVER (PARTITION BY group_name ORDER BY count(*) DESC, weekday_no) AS rn FROM kept GROUP BY group_name, weekday, weekday_no) WHERE rn = 1)
SELECT base.*, lpad(CAST(hh AS VARCHAR), 2, '0') || ':00' AS peak_hour, weekday AS peak_day
FROM base JOIN ph USING (group_name) JOIN pd USING (group_name)""",
)
def overview_cards(spark, d):
    messages = event_messages(spark, d)
    return cards.overview_cards(messages.filter(F.col("msg_type") == "text"))


@query(
    "top_authors",
    W
    + """, c AS (SELECT group_name, author, count(*) AS n, row_number() OVER (PARTITION BY group_name ORDER BY count(*) DESC, author) AS rank
  FROM em GROUP BY group_name, author), t AS (SELECT * FROM c WHERE rank <= 10)
SELECT group_name, CAST(rank AS INTEGER) AS rank, author, format('{:,}', n) AS count,
format('{:.1f}', 100 * n / CAST(sum(n) OVER (PARTITION BY group_name) AS DOUBLE)) AS pct FROM t""",
)
def top_authors(spark, d):
    return cards.top_authors(event_messages(spark, d))


@query(
    "user_activity_topn",
    W
    + """, c AS (SELECT group_name, author, count(*) AS message_count,
  row_number() OVER (PARTITION BY group_name ORDER BY count(*) DESC, author) AS rank,
  count(*) OVER (PARTITION BY group_name) AS total_participants
  FROM em WHERE msg_type = 'text' GROUP BY group_name, author)
SELECT group_name, author, message_count, CAST(rank AS INTEGER) AS rank, total_participants, total_participants > 50 AS truncated
FROM c WHERE rank <= 50""",
)
def user_activity_topn(spark, d):
    messages = event_messages(spark, d).filter(F.col("msg_type") == "text")
    return users.user_activity_topn(messages, 50)
