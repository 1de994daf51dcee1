"""Text expressions, all JVM-side built-ins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from parley.functions import patterns as P


def strip_space(text: Column) -> Column:
    """Trim every kind of Unicode whitespace, not only U+0020."""
    return F.trim(text, F.lit(P.WHITESPACE))


def normalize_encoding(text: Column) -> Column:
    return F.regexp_replace(text, P.CONTROL_CHARS, "")


def is_plain(text: Column) -> Column:
    """Whether a text has no control characters, and nothing an emoji could begin or
    end with but digits, # and *: every emoji has a character of the span."""
    return text.rlike(rf"\A[[ -~]\t\n[^{P.CONTROL_CHARS[1:-1]}{P.EMOJI_SPAN[1:-1]}]]*\z")


def strip_artefacts(text: Column) -> Column:
    # the look-ahead rejects most positions with one comparison
    return F.regexp_replace(text, f"(?iu)(?=[<m])(?:{P.ARTEFACTS})", "")


def strip_emoji(text: Column) -> Column:
    # testing the long class at every character costs 20 times as much
    return F.regexp_replace(text, f"(?=[0-9#*]|{P.EMOJI_SPAN})(?:{P.EMOJI})", "")


def split_words(text: Column) -> Column:
    """Lower-cased words; punctuation, symbols and whitespace all separate."""
    # most characters are small letters: one comparison
    apart = f"[[^a-z]&&{P.NON_WORD[:-1]}]+"
    return F.filter(F.split(F.lower(text), apart), lambda word: word != "")


def split_on_space(text: Column) -> Column:
    # a regex costs five times as much as the one character that most texts have
    others = P.SPACE.replace(r"\x1c-\x20", r"\x1c-\x1f")
    parts = F.when(text.rlike(rf"\A[[ -~][^{others}]]*\z"), F.split(text, " ")).otherwise(F.split(text, f"[{P.SPACE}]+"))
    return F.filter(parts, lambda word: word != "")


def short_hash(text: Column, digits: int = 6) -> Column:
    return F.substring(F.md5(F.encode(text, "UTF-8")), 1, digits)


def anonymize_author(author: Column, digits: int = 6) -> Column:
    return F.concat(F.lit("USER_"), short_hash(strip_space(author), digits))


def anonymize_phone(text: Column, digits: int = 6) -> Column:
    """Replace each phone number by a tag of its hash.

    The text is cut at the matches and put together again with the hashed
    matches in between, so one pass serves any number of matches.
    """
    kept = F.split(text, P.PHONE, -1)
    found = F.regexp_extract_all(text, F.lit(P.PHONE), F.lit(0))
    tags = F.transform(
        found, lambda m: F.concat(F.lit("[USER_"), short_hash(m, digits), F.lit("]"))
    )
    joined = F.zip_with(kept, tags, lambda k, t: F.concat(k, F.coalesce(t, F.lit(""))))
    return F.array_join(joined, "")


def fold_case(text: Column) -> Column:
    return F.lower(F.translate(text, *P.CASE_VARIANTS))


def may_be_notice(folded: Column) -> Column:
    """False for most messages, at a fraction of the cost of the notice patterns."""
    return F.exists(F.array(*map(F.lit, P.NOTICE_WORDS)), lambda word: F.contains(folded, word))


def classify_message(message: Column, extended: bool = False) -> Column:
    """'media' before 'system' before 'text'."""
    media, system = list(P.MEDIA_NOTICES), list(P.SYSTEM_NOTICES)
    if extended:
        media += P.EXTENDED_MEDIA_NOTICES
        system += P.EXTENDED_SYSTEM_NOTICES
    return (
        F.when(message.rlike("(?iU)" + P.any_of(media)), "media")
        .when(message.rlike("(?iU)" + P.any_of(system)), "system")
        .otherwise("text")
    )


def clean_label(name: Column) -> Column:
    """A display name without emoji, unless nothing would be left."""
    bare = strip_space(strip_emoji(name))
    return F.when(bare != "", bare).otherwise(name)


def truncate_label(label: Column, n_words: int = 3) -> Column:
    parts = F.transform(F.split(label, "/"), strip_space)
    tail = F.when(F.size(parts) > n_words, "…").otherwise("")
    return F.concat(F.array_join(F.slice(parts, 1, n_words), " / "), tail)


def format_duration(seconds: Column) -> Column:
    """Whole seconds as '1h 2m 3s', '2m 34s' or '45s'."""
    whole = F.floor(seconds).cast("bigint")
    h, m, s = F.floor(whole / 3600), F.floor(whole / 60) % 60, whole % 60
    h, m = h.cast("bigint"), m.cast("bigint")
    return (
        F.when(h > 0, F.concat(h, F.lit("h "), m, F.lit("m "), s, F.lit("s")))
        .when(m > 0, F.concat(m, F.lit("m "), s, F.lit("s")))
        .otherwise(F.concat(s, F.lit("s")))
    )


def file_suffix(name: Column) -> Column:
    """Lower-case suffix with its dot; '' for none (a leading dot is no suffix)."""
    return F.lower(F.regexp_extract(name, r"[^/.][^/]*?(\.[^./]+)$", 1))


def file_stem(path: Column) -> Column:
    name = F.regexp_extract(path, r"([^/]*)/*$", 1)
    return F.regexp_replace(name, r"(?<=.)\.[^.]+$", "")
