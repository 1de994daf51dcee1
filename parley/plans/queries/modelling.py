"""Topic models and sentiment on texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from parley.functions.once import computed_once
from parley.operators import clean, density, group_topics, sentiment, topics
from parley.plans.queries.registry import query, sql_list
from parley.plans.queries.views import DOCS, document_messages, load, stop_sql, words_sql
from parley.session import saved

WD = "WITH " + DOCS


def plain_tokens(spark, d):
    """documents with the words of two or more letters, stop words kept."""
    words = clean.drop_stopwords(clean.words_of(F.col("message")), ())
    rows = computed_once(document_messages(spark, d), "tokens", words)
    return rows.withColumn("cleaned_message", F.array_join("tokens", " "))


def content_tokens(spark, d):
    """documents without the stop words of their language."""
    words = clean.remove_stopwords(clean.words_of(F.col("message")), F.col("true_lang"))
    rows = computed_once(document_messages(spark, d), "tokens", words)
    return rows.withColumn("cleaned_message", F.array_join("tokens", " "))


_PLAIN = lambda: WD + f", t AS (SELECT seq, group_name, {stop_sql(words_sql('message'))} AS ws FROM dm)"
_CONTENT = lambda: (
    WD + f", t AS (SELECT seq, group_name, {stop_sql(words_sql('message'), 'true_lang')} AS ws FROM dm)"
)


@query(
    "tfidf_features",
    lambda: _CONTENT()
    + """, u AS (SELECT seq, unnest(ws) AS term FROM t),
voc AS (SELECT term, count(*) AS n FROM u GROUP BY term ORDER BY n DESC, term LIMIT 1000),
tf AS (SELECT seq, term, count(*) AS tf FROM u SEMI JOIN voc USING (term) GROUP BY ALL),
df AS (SELECT term, ln((1 + (SELECT count(*) FROM t)) / CAST(1 + count(*) AS DOUBLE)) + 1 AS idf FROM tf GROUP BY term),
w AS (SELECT seq, term, tf * idf AS w FROM tf JOIN df USING (term))
SELECT seq, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY seq)), 6) AS weight FROM w""",
)
def tfidf_features(spark, d):
    out = topics.tfidf_features(content_tokens(spark, d), ["seq"])
    return out.withColumn("weight", F.round("weight", 6))


def _placement(placed, table, n_topics: int):
    """Per group what holds whatever the numbering of the topics is: messages
    placed, scores that are probabilities of a best topic, topics listed, the sum
    of the weights and how far they are from a recount."""
    score = F.round("topic_score", 9).between(1 / n_topics - 1e-9, 1.0)
    recount = placed.groupBy("group_name", "topic_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(score).alias("scored"))
    per_group = recount.groupBy("group_name").agg(F.sum("n").alias("messages"), F.sum("scored").alias("scored"))
    joined = table.join(recount.drop("scored"), ["group_name", "topic_id"], "left").join(per_group, "group_name")
    off = F.abs(F.col("weight") - F.coalesce("n", F.lit(0)) / F.col("messages"))
    return joined.groupBy("group_name", "messages", "scored").agg(
        F.count(F.lit(1)).alias("topics"), F.round(F.sum("weight"), 6).alias("weights"), F.round(F.max(off), 6).alias("off")
    )


@query(
    "topics_lda",
    """SELECT source AS group_name, count(*) AS messages, count(*) AS scored, CAST(5 AS BIGINT) AS topics,
CAST(1 AS DOUBLE) AS weights, CAST(0 AS DOUBLE) AS off FROM documents GROUP BY source""",
)
def topics_lda(spark, d):
    placed, table = topics.topics_lda(content_tokens(spark, d), n_topics=5)
    return _placement(placed, table, 5)


@query(
    "topics_lda_groups",
    """WITH g AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang)
SELECT count(*) AS groups, CAST(sum(n) AS BIGINT) AS messages, 6 * count(*) AS topics, count(*) AS whole, count(*) AS rising, true AS pure FROM g""",
)
def topics_lda_groups(spark, d):
    """A model for each language, on texts of three planted topics that share no
    word: groups, their messages and topics, groups whose weights sum to one and
    whose bound rises, and whether nine of ten texts lie in a topic of their own kind."""
    planted = F.col("seq") % 3
    coded = F.transform("tokens", lambda w: F.concat(planted.cast("string"), F.substring(F.md5(F.encode(w, "UTF-8")), 1, 1)))
    rows = plain_tokens(spark, d).withColumns({"cleaned_message": F.array_join(coded, " "), "group_name": F.col("true_lang")})
    rows = saved(rows.select("seq", "group_name", "cleaned_message", F.size("tokens").alias("n_tokens")), "tokens")
    placed, table, bounds = group_topics.topics_lda_per_group(rows, ["seq"], 6)
    mixed = placed.filter("n_tokens > 0").groupBy("group_name", "topic_id", planted.alias("planted")).agg(F.count(F.lit(1)).alias("n"))
    pure = mixed.groupBy("group_name", "topic_id").agg(F.max("n").alias("most"), F.sum("n").alias("n")).groupBy("group_name").agg(F.sum("most").alias("most"), F.sum("n").alias("n"))
    steps = bounds.groupBy("group_name").agg((F.max_by("bound", "round") > F.min_by("bound", "round")).alias("rising"))
    counts = placed.groupBy("group_name").agg(F.count(F.lit(1)).alias("messages"))
    listed = table.groupBy("group_name").agg(F.count(F.lit(1)).alias("topics"), (F.abs(F.sum("weight") - 1) < 1e-6).alias("whole"))
    groups = counts.join(listed, "group_name").join(steps, "group_name").join(pure, "group_name")
    return groups.agg(
        F.count(F.lit(1)).alias("groups"),
        F.sum("messages").alias("messages"),
        F.sum("topics").alias("topics"),
        F.count_if("whole").alias("whole"),
        F.count_if("rising").alias("rising"),
        (F.sum("most") >= 0.9 * F.sum("n")).alias("pure"),
    )


@query(
    "topic_top_words",
    lambda: _CONTENT()
    + """, voc AS (SELECT term FROM (SELECT unnest(ws) AS term FROM t) GROUP BY term ORDER BY count(*) DESC, term LIMIT 1000)
SELECT CAST(k AS INTEGER) AS topic_id, CAST(5 AS BIGINT) AS words, least(5, (SELECT count(*) FROM voc)) AS known FROM (SELECT unnest(range(3)) AS k)""",
)
def topic_top_words(spark, d):
    rows = content_tokens(spark, d)
    _, table = topics.topics_lda(rows, n_topics=3, keys=["group_name"])
    labels = table.select("topic_id", F.explode(F.split("topic_label", " / ")).alias("word")).distinct()
    vocabulary = topics.word_frequency(rows, topics.MAX_FEATURES).select("word", F.lit(True).alias("known"))
    # at most 15 words and as many as the vocabulary has
    return labels.join(vocabulary, "word", "left").groupBy("topic_id").agg(
        F.count(F.lit(1)).alias("words"), F.count("known").alias("known")
    )


@query(
    "topics_embedding",
    """SELECT 'all' AS group_name, count(*) AS messages, count(*) AS scored, CAST(10 AS BIGINT) AS topics,
CAST(1 AS DOUBLE) AS weights, CAST(0 AS DOUBLE) AS off, CAST(10 AS BIGINT) AS labelled FROM embeddings""",
)
def topics_embedding(spark, d):
    rows = load(spark, d, "embeddings").select(
        F.lit("all").alias("group_name"),
        F.col("vec_id").alias("seq"),
        "embedding",
        F.array(F.concat(F.lit("label"), "label")).alias("tokens"),
    )
    placed, table = topics.topics_embedding(rows, n_topics=10, embedding="embedding")
    labelled = table.groupBy("group_name").agg(F.count_if(F.col("topic_label").startswith("label")).alias("labelled"))
    return _placement(placed, table, 10).join(labelled, "group_name")


@query(
    "density_clusters",
    """WITH RECURSIVE e AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
d AS (SELECT a.id, b.id AS other, round(list_distance(a.v, b.v), 6) AS distance FROM e a JOIN e b ON a.id <> b.id),
near AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY id ORDER BY distance, other) <= 5),
core AS (SELECT id, max(distance) AS core FROM near GROUP BY id HAVING count(*) = 5),
dense AS (SELECT * FROM core WHERE core <= (SELECT quantile_disc(core, 0.9) FROM core)),
edge AS (SELECT near.id AS a, other AS b FROM near JOIN dense x ON x.id = near.id JOIN dense y ON y.id = other),
link AS (SELECT a, b FROM edge UNION SELECT b, a FROM edge),
reach(a, b) AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
root AS (SELECT a AS id, least(a, min(b)) AS cluster FROM reach GROUP BY a),
big AS (SELECT cluster, min(core) AS densest FROM root JOIN dense USING (id) GROUP BY cluster HAVING count(*) >= 5)
SELECT e.id AS vec_id, big.cluster, round(CASE WHEN big.cluster IS NULL THEN CAST(0 AS DOUBLE) WHEN core > 0 THEN densest / core ELSE CAST(1 AS DOUBLE) END, 5) AS strength
FROM e LEFT JOIN core USING (id) LEFT JOIN root USING (id) LEFT JOIN big USING (cluster)""",
)
def density_clusters(spark, d):
    """Clusters by density of all embeddings, outliers without one."""
    points = load(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    out = density.density_clusters(points)
    return out.select(F.col("id").alias("vec_id"), "cluster", F.round("strength", 5).alias("strength"))


@query(
    "topic_scores_rule",
    """WITH p AS (SELECT vec_id, label, label * 8 AS topic, CASE WHEN vec_id % 10 = 0 THEN NULL ELSE embedding END AS probs FROM embeddings)
SELECT vec_id, round(CASE WHEN probs IS NULL THEN CAST(1 AS DOUBLE) ELSE CAST(probs[least(topic, len(probs) - 1) + 1] AS DOUBLE) END, 5) AS topic_score FROM p""",
)
def topic_scores_rule(spark, d):
    rows = load(spark, d, "embeddings").select(
        "vec_id",
        (F.col("label") * 8).alias("topic"),
        F.when(F.col("vec_id") % 10 != 0, F.col("embedding").cast("array<double>")).alias("probs"),
    )
    score = topics.topic_scores_rule(F.col("probs"), F.col("topic"))
    return rows.select("vec_id", F.round(score, 5).alias("topic_score"))


@query(
    "class_tfidf",
    lambda: _CONTENT()
    + """, c AS (SELECT group_name, term, count(*) AS n FROM (SELECT group_name, unnest(ws) AS term FROM t) GROUP BY ALL),
s AS (SELECT group_name, sum(n) AS cn FROM c GROUP BY group_name), a AS (SELECT avg(cn) AS av FROM s),
f AS (SELECT term, sum(n) AS fn FROM c GROUP BY term)
SELECT c.group_name, c.term, c.n, round(c.n / CAST(cn AS DOUBLE) * ln(1 + (SELECT av FROM a) / CAST(fn AS DOUBLE)), 9) AS weight
FROM c JOIN s USING (group_name) JOIN f USING (term)""",
)
def class_tfidf(spark, d):
    out = topics.class_tfidf(content_tokens(spark, d), ["group_name"])
    return out.withColumn("weight", F.round("weight", 9))


@query(
    "topic_labels",
    lambda: _CONTENT()
    + """, c AS (SELECT group_name, term, count(*) AS n FROM (SELECT group_name, unnest(ws) AS term FROM t) GROUP BY ALL),
s AS (SELECT group_name, sum(n) AS cn FROM c GROUP BY group_name), a AS (SELECT avg(cn) AS av FROM s),
f AS (SELECT term, sum(n) AS fn FROM c GROUP BY term),
w AS (SELECT c.group_name, c.term, round(c.n / CAST(cn AS DOUBLE) * ln(1 + (SELECT av FROM a) / CAST(fn AS DOUBLE)), 9) AS weight
  FROM c JOIN s USING (group_name) JOIN f USING (term)),
r AS (SELECT *, row_number() OVER (PARTITION BY group_name ORDER BY weight DESC, term) AS rn FROM w)
SELECT group_name, string_agg(term, ' / ' ORDER BY rn) AS topic_label FROM r WHERE rn <= 5 GROUP BY group_name""",
)
def topic_labels(spark, d):
    weights = topics.class_tfidf(content_tokens(spark, d), ["group_name"])
    return topics.topic_labels(weights.withColumn("weight", F.round("weight", 9)), ["group_name"])


# The lexicon of these queries: the 300 most frequent words, with a valence
# from -4 to 4 computed from the word.
_LEXICON = """, lx AS (SELECT word, CAST((length(word) * 5 + ascii(word)) % 9 - 4 AS DOUBLE) AS value FROM (
  SELECT word, count(*) AS n FROM (SELECT unnest(ws) AS word FROM t) GROUP BY word ORDER BY n DESC, word LIMIT 300))"""


def lexicon(messages):
    top = topics.word_frequency(messages, 300)
    value = (F.length("word") * 5 + F.ascii("word")) % 9 - 4
    return top.select("word", value.cast("double").alias("value"))


@query(
    "lexicon_join",
    lambda: _PLAIN()
    + _LEXICON
    + """, u AS (SELECT seq, unnest(ws) AS word FROM t)
SELECT t.seq, count(value) AS hits, round(sum(value), 6) AS total FROM t LEFT JOIN u USING (seq) LEFT JOIN lx USING (word) GROUP BY t.seq""",
)
def lexicon_join(spark, d):
    rows = plain_tokens(spark, d)
    valued = clean.values_for_tokens(rows, lexicon(rows), ["seq"], "values", "double")
    hits = F.filter("values", lambda v: v.isNotNull())
    total = F.aggregate(hits, F.lit(0.0), lambda acc, v: acc + v)
    return valued.select(
        "seq",
        F.size(hits).cast("bigint").alias("hits"),
        F.when(F.size(hits) > 0, F.round(total, 6)).alias("total"),
    )


def _sentiment_sql(phrases: bool = False) -> str:
    """With phrases the table ``held`` says which words phrases hold."""
    s = sentiment
    scale = f"CASE WHEN list_contains({sql_list(s.INTENSIFIERS)}, {{w}}) THEN {s.BOOST} WHEN list_contains({sql_list(s.DAMPENERS)}, {{w}}) THEN -{s.BOOST} ELSE 0 END"
    negated = f"coalesce(list_contains({sql_list(s.NEGATIONS)}, {{w}}), false)"

    def step(n: int, previous: str) -> str:
        w = f"b{n}"
        push = f"({scale.format(w=w)}) * {s.DISTANCE_DAMPING[n - 1]}"
        boosted = f"({previous} + CASE WHEN {previous} < 0 THEN -({push}) ELSE {push} END)"
        neg = negated.format(w=w)
        if n == 1:
            turned = f"CASE WHEN {neg} THEN {boosted} * {s.NEGATE} ELSE {boosted} END"
        else:
            near = "coalesce(b1 IN ('so','this'), false)"
            sure = "coalesce(b1 = 'doubt', false)"
            if n == 3:
                near = f"({near} OR coalesce(b2 IN ('so','this'), false))"
                sure = f"({sure} OR coalesce(b2 = 'doubt', false))"
            turned = (
                f"CASE WHEN {w} = 'never' AND {near} THEN {boosted} * {s.NEVER_SO} "
                f"WHEN {w} = 'without' AND {sure} THEN {boosted} "
                f"WHEN {neg} THEN {boosted} * {s.NEGATE} ELSE {boosted} END"
            )
        return f"CASE WHEN {w} IS NOT NULL AND l{n} IS NULL THEN {turned} ELSE {previous} END"

    boosters = sql_list(s.INTENSIFIERS + s.DAMPENERS)
    values = "x AS (SELECT u.*, value, CAST(NULL AS DOUBLE) AS fixed FROM u LEFT JOIN lx USING (word)),"
    if phrases:
        values = """x AS (SELECT u.*, CASE WHEN h.seq IS NULL THEN lx.value WHEN h.last THEN h.value ELSE 0 END AS value,
  CASE WHEN h.last THEN h.value WHEN h.seq IS NOT NULL THEN 0 END AS fixed FROM u LEFT JOIN lx USING (word) LEFT JOIN held h ON h.seq = u.seq AND h.i = u.i),"""
    return f""", u AS (SELECT seq, i, ws[i] AS word FROM (SELECT seq, ws, unnest(range(1, len(ws) + 1)) AS i FROM t)),
{values}
y AS (SELECT *, lag(word, 1) OVER o AS b1, lag(word, 2) OVER o AS b2, lag(word, 3) OVER o AS b3,
  lag(value, 1) OVER o AS l1, lag(value, 2) OVER o AS l2, lag(value, 3) OVER o AS l3, lead(value, 1) OVER o AS nx,
  min(CASE WHEN word = 'but' THEN i END) OVER (PARTITION BY seq) AS but_at FROM x WINDOW o AS (PARTITION BY seq ORDER BY i)),
h AS (SELECT *, CASE WHEN coalesce(b1 = 'no', false) OR coalesce(b2 = 'no', false)
    OR (coalesce(b3 = 'no', false) AND coalesce(b1 IN ('or','nor'), false)) THEN value * {s.NEGATE}
    WHEN word = 'no' AND nx IS NOT NULL THEN 0 ELSE value END AS v0
  FROM y WHERE fixed IS NOT NULL OR (value IS NOT NULL AND NOT list_contains({boosters}, word))),
h1 AS (SELECT *, {step(1, 'v0')} AS v1 FROM h),
h2 AS (SELECT *, {step(2, 'v1')} AS v2 FROM h1),
h3 AS (SELECT *, {step(3, 'v2')} AS v3 FROM h2),
h4 AS (SELECT *, CASE WHEN fixed IS NOT NULL THEN fixed WHEN b1 = 'least' AND l1 IS NULL AND NOT coalesce(b2 IN ('at','very'), false) THEN v3 * {s.NEGATE} ELSE v3 END
  * CASE WHEN i < but_at THEN {s.BEFORE_BUT} WHEN i > but_at THEN {s.AFTER_BUT} ELSE 1 END AS v FROM h3),
tot AS (SELECT t.seq, coalesce(sum(h4.v), 0) AS total FROM t LEFT JOIN h4 ON h4.seq = t.seq GROUP BY t.seq),
sc AS (SELECT seq, round(total / sqrt(total * total + {s.ALPHA}), 4) AS sentiment_score FROM tot)
SELECT seq, sentiment_score, CASE WHEN sentiment_score > 0.05 THEN 'positive' WHEN sentiment_score < -0.05 THEN 'negative'
ELSE 'neutral' END AS sentiment_label FROM sc"""


@query("sentiment_lexicon", lambda: _PLAIN() + _LEXICON + _sentiment_sql())
def sentiment_lexicon(spark, d):
    rows = plain_tokens(spark, d)
    scored = sentiment.sentiment_lexicon(rows, lexicon(rows), ["seq"])
    return scored.select("seq", "sentiment_score", "sentiment_label")


# The phrases of that query: the commonest two to four words in a row, so that
# they overlap and nest, with a value computed from the phrase.
PHRASES = {2: 60, 3: 40, 4: 20}
_PHRASES = "".join(
    f""", g{n} AS (SELECT seq, i, array_to_string(ws[i:i + {n - 1}], ' ') AS phrase FROM (SELECT seq, ws, unnest(range(1, len(ws) - {n - 2})) AS i FROM t)),
p{n} AS (SELECT phrase, CAST((length(phrase) * 7 + ascii(phrase)) % 9 - 4 AS DOUBLE) AS value FROM g{n} GROUP BY phrase ORDER BY count(*) DESC, phrase LIMIT {top})"""
    for n, top in PHRASES.items()
) + """, hit AS ({}),
held AS (SELECT seq, i + d AS i, value, d = n - 1 AS last FROM (SELECT *, unnest(range(n)) AS d FROM hit)
  QUALIFY row_number() OVER (PARTITION BY seq, i + d ORDER BY n DESC, i) = 1)""".format(
    " UNION ALL ".join(f"SELECT seq, i, {n} AS n, value FROM g{n} JOIN p{n} USING (phrase)" for n in PHRASES)
)


def phrase_table(rows):
    value = (F.length("phrase") * 7 + F.ascii("phrase")) % 9 - 4
    return sentiment.frequent_phrases(rows, PHRASES).select("phrase", value.cast("double").alias("value"))


@query("sentiment_phrases", lambda: _PLAIN() + _LEXICON + _PHRASES + _sentiment_sql(phrases=True))
def sentiment_phrases(spark, d):
    """Idioms override the values of their words."""
    # read several times: cleaning costs far more than reading the words again
    texts = saved(plain_tokens(spark, d).select("seq", "cleaned_message"), "words", "zstd")
    words = F.when(F.col("cleaned_message") != "", F.split("cleaned_message", " ")).otherwise(F.array().cast("array<string>"))
    rows = computed_once(texts, "tokens", words)
    scored = sentiment.sentiment_lexicon(texts, lexicon(rows), ["seq"], phrase_table(rows))
    return scored.select("seq", "sentiment_score", "sentiment_label")


def stub_model():
    """Stands in for a classifier: label and probability from the text length."""

    def classify(texts: list[str]) -> list[tuple[str, float]]:
        if any(len(text) % 11 == 0 for text in texts):
            raise ValueError("cannot read one of the texts")
        return [(f"LABEL_{len(text) % 2}", (len(text) % 100) / 100) for text in texts]

    return classify


@query(
    "sentiment_model",
    """WITH s AS (SELECT doc_id AS seq, length(text) AS n FROM documents),
c AS (SELECT seq, round(CASE WHEN n % 11 = 0 THEN 0 WHEN n % 2 = 1 THEN (n % 100) / CAST(100 AS DOUBLE) ELSE -(n % 100) / CAST(100 AS DOUBLE) END, 4) + 0.0 AS sentiment_score FROM s)
SELECT seq, sentiment_score, CASE WHEN sentiment_score > 0.05 THEN 'positive' WHEN sentiment_score < -0.05 THEN 'negative'
ELSE 'neutral' END AS sentiment_label FROM c""",
)
def sentiment_model(spark, d):
    from parley.session import ship_package

    ship_package(spark)
    scored = sentiment.sentiment_model(document_messages(spark, d), stub_model, text="message")
    return scored.select("seq", (F.round("sentiment_score", 4) + 0.0).alias("sentiment_score"), "sentiment_label")
