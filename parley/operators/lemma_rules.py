"""Lemmas of words that a word table does not have, by the endings it teaches.

From pairs such as (mangeons, manger) and (parlons, parler) follows that a word
in -ons loses three letters and gains "er".  Each ending of up to ``longest``
letters votes over all words of the table that have it; a word takes the rule of
its longest ending that has one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.functions.once import unnest
from parley.session import attach, checkpointed

LONGEST = 6
STEM = 2


def _endings(words: DataFrame, longest: int) -> DataFrame:
    """One row per word and ending, in front of which at least STEM letters stay."""
    most = F.least(F.length("word") - STEM, F.lit(longest))
    sizes = F.when(most > 0, F.sequence(F.lit(1), most))
    rows = unnest(words, ["*"], sizes, "size")
    return rows.withColumn("ending", F.expr("right(word, size)"))


def lemma_rules(lemmas: DataFrame, longest: int = LONGEST, least_words: int = 3, least_share: float = 0.7) -> DataFrame:
    """(ending, cut, added, words, of): take ``cut`` letters away, put ``added`` there.

    ``lemmas`` has columns ``word`` and ``value``; words that are their own lemma
    teach that an ending stays.  An ending has a rule when its commonest change
    was seen in ``least_words`` words and in ``least_share`` of all words with
    this ending; ties go to the smaller cut, then to the added letters that come
    first.  Of several values of a word the least counts; null words or values
    and words whose lemma keeps less than two letters in front teach nothing.
    """
    known = lemmas.filter("word is not null and value is not null").groupBy("word").agg(F.min("value").alias("value"))
    shorter = F.least(F.length("word"), F.length("value"))
    prefixes = F.when(shorter > 0, F.sequence(F.lit(1), shorter))
    # prefixes are equal up to some length and never again
    same = F.size(F.filter(prefixes, lambda n: F.col("value").substr(F.lit(1), n) == F.col("word").substr(F.lit(1), n)))
    changes = known.withColumn("same", same).filter(F.col("same") >= STEM)
    changes = changes.select(
        "word", (F.length("word") - F.col("same")).alias("cut"), F.expr("substring(value, same + 1)").alias("added")
    )
    votes = _endings(changes, longest).groupBy("ending", "cut", "added").agg(F.count(F.lit(1)).alias("words"))
    fits = F.col("cut") <= F.length("ending")
    best = F.min(F.when(fits, F.struct((-F.col("words")).alias("least"), "cut", "added"))).alias("best")
    rules = votes.groupBy("ending").agg(best, F.sum("words").alias("of"))
    return rules.select(
        "ending", "best.cut", "best.added", (-F.col("best.least")).alias("words"), "of"
    ).filter((F.col("words") >= least_words) & (F.col("words") >= least_share * F.col("of")))


def ruled_lemmas(words: DataFrame, rules: DataFrame, longest: int = LONGEST) -> DataFrame:
    """(word, value) of the words (column ``word``) whose lemma a rule changes."""
    endings = _endings(words.select("word").filter(F.col("word").rlike(r"^\p{L}+$")).distinct(), longest)
    found = attach(endings, rules.select("ending", "cut", "added"), ["ending"], "inner")
    value = F.expr("concat(left(word, length(word) - cut), added)")
    ruled = found.groupBy("word").agg(F.max_by(value, "size").alias("value"))
    return ruled.filter(F.col("value") != F.col("word"))


def extended_lemmas(messages: DataFrame, lemmas: DataFrame, tokens: str = "tokens", **rule_options: float) -> DataFrame:
    """The word table, with the lemmas of all other words that occur in the messages.

    Endings are looked up once for each different word, not for each token.
    """
    longest = int(rule_options.get("longest", LONGEST))
    lemmas = checkpointed(lemmas.select("word", "value"))  # read three times
    known = lemmas.filter("word is not null").select("word").distinct()
    occurring = unnest(messages, [], tokens, "word").distinct()
    others = occurring.join(known, "word", "left_anti")
    ruled = ruled_lemmas(others, lemma_rules(lemmas, **rule_options), longest)
    return lemmas.unionByName(ruled)
