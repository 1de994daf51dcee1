"""Personal data replaced by keyed surrogates of the same type and format.

Every entity is mapped by a keyed permutation of all strings of its format:
digits stay digits, vowels vowels, consonants consonants, in the same script and
case; separators, country codes, key prefixes and top-level domains stay.  Card and
bank account numbers keep their check-sum state, addresses stay valid, first names move within the list of
their gender and script.  A permutation never maps two entities to one; what it
can do is to hit an entity that the corpus holds, or leave one as it is.  Such
hits are found by a join over the distinct entities and tried again with another
tweak, until none is left; where ``TRIES`` tweaks find no free string, the format is
widened.  The same entity gets the same surrogate everywhere,
and parts of a name that stand alone later in the text follow the full name.
"""

from __future__ import annotations

import hashlib
import hmac
import re
from bisect import bisect_right
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.common import column, saved, workers_ready
from parley.llm.words import parts
from parley.session import attach

# --- fixed values: common first names by script and gender, and titles ------
FIRST_NAMES = {
    "latin female": "Alice Amelia Anna Camille Carla Carmen Charlotte Claire Clara Elena Elizabeth Emily Emma Hannah Ingrid Isabel Jane Jennifer Jessica Julia Karen Katharina Laura Linda Lucia Maria Marie Mary Nancy Olivia Patricia Rachel Sandra Sarah Sophie Susan",
    "latin male": "Alexander Andrew Anthony Antonio Benjamin Carlos Charles Christopher Daniel David Diego Edward Eric Francisco George Hans James Jean Johannes John Joseph Juan Lukas Matthew Michael Miguel Nicolas Oliver Paul Peter Pierre Richard Robert Stefan Steven Thomas William",
    "cyrillic female": "Анна Елена Ирина Мария Наталья Ольга Светлана Татьяна",
    "cyrillic male": "Александр Алексей Андрей Дмитрий Иван Михаил Николай Сергей",
}
TITLES = "Mr Mrs Ms Miss Dr Prof Herr Frau Madame Monsieur Señor Señora Don Doña"
KEY_PREFIXES = "AKIA ASIA sk- ghp_ gho_ ghs_ glpat- xoxb- xoxp-"
# --- end of fixed values ----------------------------------------------------

_NAME_LIST = {name: kind for kind, names in FIRST_NAMES.items() for name in names.split()}
_LETTERS = ["aeiou", "bcdfghjklmnpqrstvwxyz", "аеиоуыэюя", "бвгджзйклмнпрстфхцчшщ"]
_ALPHABETS = ["0123456789", *_LETTERS, *(a.upper() for a in _LETTERS)]
_CLASS = {c: a for a in _ALPHABETS for c in a}
_HEX = {c: a for a in ("0123456789abcdef", "ABCDEF") for c in a}

_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_ENTITY = re.compile(
    r"(?P<email>[\w.%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,})"
    r"|(?:(?i:token|secret|password|passwd|api[_-]?key)(?:[_-]\w+|[0-9]+)?(?!\w)[\"']?\s*[=:]\s*[\"']?)(?P<secret>[^\s\"'<>,;]{8,})"
    rf"|(?P<key>(?<!\w)(?:{'|'.join(KEY_PREFIXES.split())})[A-Za-z0-9_-]{{16,}}(?!\w))"
    r"|(?P<hex>(?<![\w])(?:[0-9a-f]{32,128}|[0-9A-F]{32,128})(?![\w]))"
    r"|(?P<iban>(?<![\w])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![\w]))"
    rf"|(?P<ip>(?<![\w.]){_OCTET}(?:\.{_OCTET}){{3}}(?![\w]|\.[0-9]))"
    r"|(?P<phone>(?<![\w])\+[0-9]{1,3}[ .-]?\(?[0-9]{1,4}\)?(?:[ .-]?[0-9]{2,4}){2,4}(?![\w])"
    r"|(?<![\w])\(?[0-9]{3}\)?[ .-][0-9]{3}[.-][0-9]{4}(?![\w]))"
    r"|(?P<ssn>(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-]))"
    r"|(?P<card>(?<![\w])(?:[0-9]{13,19}|[0-9]{4}(?P<sep>[ -])(?:[0-9]{4}(?P=sep)[0-9]{4}(?P=sep)[0-9]{4}(?:(?P=sep)[0-9]{3})?|[0-9]{6}(?P=sep)[0-9]{4,5}))(?![\w]))",
)
TRIES = 20  # tweaks of one width
KINDS = ("email", "secret", "key", "hex", "iban", "ip", "phone", "ssn", "card")
_COUNTRY = re.compile(r"\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{1,3})")
_TRIGGER = re.compile(r"[0-9@=:]")
_UPPER = r"[A-ZÀ-ÖØ-ÞА-Я]"
_FIRST = "(?:" + "|".join(_NAME_LIST) + ")"
_PERSON = re.compile(rf"(?<!\w)(?P<first>{_FIRST}(?:[ -]{_FIRST})*)(?P<middle>(?: {_UPPER}\.)*) (?P<last>{_UPPER}[^\W\d_]+(?:-{_UPPER}[^\W\d_]+)?)")
_TITLED = re.compile(rf"(?<!\w)(?:{'|'.join(TITLES.split())})\.? (?:{_FIRST} )*(?:{_UPPER}\. )*(?P<last>{_UPPER}[^\W\d_]{{2,}})")


def luhn(digits: str) -> int:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10


def card_length(text: str, start: int, stop: int) -> int:
    """Letters of the card number that a match of the card pattern begins with, or 0.

    A run of 16 digits or a usual grouping counts as it is; a run of another length,
    a fifth group and a piece of a longer row of groups only with a right check-sum.
    """
    card = text[start:stop]
    digits = re.sub(r"[ -]", "", card)
    if luhn(digits) == 0:
        return len(card)
    if len(digits) == len(card):
        return len(card) if len(card) == 16 else 0
    if len(digits) == 19:
        return 19
    sep = card[4]
    row = re.compile(rf"{sep}[0-9]{{4}}(?![\w])").match(text, stop) or re.search(rf"(?<!\w)[0-9]{{4}}{sep}$", text[max(0, start - 6) : start])
    return 0 if row else len(card)


def mod97(iban: str) -> int:
    """Remainder of a bank account number; 1 if its check digits are right."""
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


def normal(kind: str, text: str) -> str:
    """The form that two mentions of one entity share."""
    if kind in ("card", "iban"):
        return re.sub(r"[ -]", "", text)
    if kind == "phone":
        return re.sub(r"[^0-9+]", "", text)
    return text.lower() if kind == "email" else text


class Surrogates:
    """Keyed replacements; ``tweak`` gives another permutation of the same format."""

    def __init__(self, key: bytes):
        self.key = key
        self.next_name: dict[str, str] = {}
        for kind, names in FIRST_NAMES.items():
            ring = sorted(names.split(), key=lambda n: self._number(f"ring|{kind}|{n}"))
            self.next_name |= dict(zip(ring, ring[1:] + ring[:1], strict=True))

    def _number(self, text: str) -> int:
        return int.from_bytes(hmac.new(self.key, text.encode("utf-8"), hashlib.sha256).digest(), "big")

    def _permute(self, value: int, size: int, label: str) -> int:
        """A keyed permutation of 0 .. size - 1: a Feistel network, walked until it lands inside."""
        if size < 2:
            return value
        half = max(1, ((size - 1).bit_length() + 1) // 2)
        mask = (1 << half) - 1
        while True:
            left, right = value >> half, value & mask
            for r in range(8):
                left, right = right, left ^ (self._number(f"{label}|{r}|{right}") & mask)
            value = left << half | right
            if value < size:
                return value

    def _letters(self, text: str, label: str, classes: dict[str, str] = _CLASS) -> str:
        alphabets = [classes.get(c) for c in text]
        value, size = 0, 1
        for c, a in zip(text, alphabets, strict=True):
            if a:
                value, size = value * len(a) + a.index(c), size * len(a)
        shape = "".join(a[0] if a else c for c, a in zip(text, alphabets, strict=True))
        value = self._permute(value, size, f"{label}|{shape}")
        out = []
        for c, a in zip(reversed(text), reversed(alphabets), strict=True):
            if a:
                value, at = divmod(value, len(a))
                c = a[at]
            out.append(c)
        return "".join(reversed(out))

    def _octets(self, text: str, label: str, any_width: bool) -> str:
        if any_width:
            value = 0
            for o in text.split("."):
                value = value << 8 | int(o)
            value = self._permute(value, 1 << 32, f"{label}|any")
            return ".".join(str(value >> s & 255) for s in (24, 16, 8, 0))
        ranges = {1: (0, 10), 2: (10, 90), 3: (100, 156)}
        octets = text.split(".")
        value, size = 0, 1
        for o in octets:
            low, n = ranges[len(o)]
            value, size = value * n + int(o) - low, size * n
        value = self._permute(value, size, f"{label}|{[len(o) for o in octets]}")
        out = []
        for o in reversed(octets):
            low, n = ranges[len(o)]
            value, at = divmod(value, n)
            out.append(str(low + at))
        return ".".join(reversed(out))

    def of(self, kind: str, text: str, tweak: int = 0) -> str:
        """The surrogate of a normal form."""
        label = f"{kind}|{tweak}"
        if kind == "first":
            return self.next_name[text]
        wider = tweak // TRIES
        if kind == "ip":
            return self._octets(text, label, wider > 0)
        more = next((_CLASS[c] for c in reversed(text) if c in _CLASS), _LETTERS[1])[0] * wider
        if kind == "email":
            local, _, domain = text.partition("@")
            host, _, top = domain.rpartition(".")
            return f"{self._letters(f'{local}{more}@{host}', label)}.{top}"
        if kind == "card":
            head = self._letters(text[:-1] + "0" * wider, label)
            return next(head + str(d) for d in range(10) if luhn(head + str(d)) == luhn(text))
        if kind == "iban":
            if mod97(text) != 1:
                return text[:2] + self._letters(text[2:] + "0" * wider, label)
            account = self._letters(text[4:] + "0" * wider, label)
            return f"{text[:2]}{98 - mod97(f'{text[:2]}00{account}'):02d}{account}"
        if kind == "phone":
            code = _COUNTRY.match(text)
            at = code.end() if code else 0
            return text[:at] + self._letters(text[at:] + "0" * wider, label)
        if kind == "key":
            prefix = next(p for p in KEY_PREFIXES.split() if text.startswith(p))
            return prefix + self._letters(text[len(prefix) :] + more, label)
        if kind in ("hex",) or kind == "secret" and set(text) <= set(_HEX):
            return self._letters(text + "0" * wider, label, _HEX)
        return self._letters(text + more, label)


def _spelled(kind: str, mention: str, surrogate: str) -> str:
    """A surrogate in the spelling of the mention: its separators and case."""
    if kind in ("card", "iban", "phone"):
        new = (c for c in surrogate if c.isalnum())
        return "".join([next(new) if c.isalnum() else c for c in mention]) + "".join(new)
    if kind == "email" and len(mention) == len(surrogate):
        return "".join(s.upper() if m.isupper() else s for m, s in zip(mention, surrogate, strict=True))
    return surrogate


def mentions(text: str) -> list[tuple[int, int, str]]:
    """(start, stop, kind) of each entity in a text, in order, without overlaps."""
    found = []
    if _TRIGGER.search(text):
        at = 0
        while m := _ENTITY.search(text, at):
            kind = next(k for k in KINDS if m[k] is not None)
            i, at = m.span(kind)
            if kind == "card":
                size = card_length(text, i, at)
                at = i + size if size else i + len(re.match("[0-9]+", m[kind])[0])
                if not size:
                    continue
            found.append((i, at, kind))
    names: list[tuple[int, int, str]] = []
    kept: list[tuple[int, int, str]] = []
    for m in _PERSON.finditer(text):
        at = m.start("first")
        for name in re.split("[ -]", m["first"]):
            names.append((at, at + len(name), "first"))
            at += len(name) + 1
        names.append((*m.span("last"), "last"))
    names += [(*m.span("last"), "last") for m in _TITLED.finditer(text) if m["last"] not in _NAME_LIST]
    if names:
        known = {text[i:j]: kind for i, j, kind in names}
        alone = re.compile(r"(?<!\w)(?:" + "|".join(map(re.escape, sorted(known, key=len, reverse=True))) + r")(?!\w)")
        # a name inside an address stays part of the address
        begins = [i for i, _, _ in found]
        for m in alone.finditer(text):
            k = bisect_right(begins, m.start())
            if (k and found[k - 1][1] > m.start()) or (k < len(begins) and begins[k] < m.end()):
                continue
            kept.append((*m.span(), known[m.group()]))
    return sorted(found + kept)


def _detect(batches):
    for batch in batches:
        for part in parts(batch, "text"):
            rows = set()
            for key, text in zip(column(part, "doc_id").to_pylist(), column(part, "text").to_pylist(), strict=True):
                rows |= {(key, kind, normal(kind, text[i:j])) for i, j, kind in mentions(text or "") if kind != "first"}
            rows = sorted(rows, key=str)
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int64()), *(pa.array([r[i] for r in rows], pa.string()) for i in (1, 2))],
                names=["doc_id", "kind", "value"],
            )


def _surrogate_rows(key: bytes):
    def run(batches):
        make = Surrogates(key)
        for batch in batches:
            lists = [column(batch, c).to_pylist() for c in ("kind", "value", "tweak")]
            new = [make.of(*row) for row in zip(*lists, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("kind", "value", "tweak")), pa.array(new, pa.string())], names=["kind", "value", "tweak", "surrogate"])

    return run


def exceptions(entities: DataFrame, key: bytes) -> DataFrame:
    """(kind, value, tweak) of the entities that need another tweak than 0.

    A surrogate is refused if the corpus holds it as an entity or if an entity
    settled before, or a smaller one of this round, has it.  From tweak ``TRIES`` on
    the format grows by a letter or digit for every ``TRIES`` tweaks (the octets of
    an address by any value), so that a free string is found for every entity.
    """
    make = lambda df: df.mapInArrow(_surrogate_rows(key), "kind string, value string, tweak int, surrogate string")
    settled = saved(make(entities.withColumn("tweak", F.lit(0))), "surrogates")
    for tweak in count(1):
        taken = entities.select("kind", F.col("value").alias("surrogate"))
        first = settled.groupBy("kind", "surrogate").agg(F.min(F.struct("tweak", "value")).alias("first"))
        twice = settled.join(first, ["kind", "surrogate"]).filter(F.struct("tweak", "value") != F.col("first")).select("kind", "value")
        hit = settled.join(taken, ["kind", "surrogate"], "left_semi").select("kind", "value")
        refused = saved(hit.union(twice).distinct(), "refused")
        if refused.isEmpty():
            break
        again = make(refused.withColumn("tweak", F.lit(tweak)))
        settled = saved(settled.join(refused, ["kind", "value"], "left_anti").unionByName(again), "surrogates")
    return settled.filter("tweak > 0").select("kind", "value", "tweak")


def _replace(key: bytes):
    def run(batches):
        make = Surrogates(key)
        memo: dict[tuple[str, str, int], str] = {}
        for batch in batches:
            for part in parts(batch, "text"):
                out, counts = [], []
                for text, tweaks in zip(column(part, "text").to_pylist(), column(part, "tweaks").to_pylist(), strict=True):
                    spans = mentions(text) if text else []
                    other = {(t["kind"], t["value"]): t["tweak"] for t in tweaks or ()}
                    pieces, at = [], 0
                    for i, j, kind in spans:
                        value = normal(kind, text[i:j])
                        entity = (kind, value, other.get((kind, value), 0))
                        if entity not in memo:
                            if len(memo) > 100_000:
                                memo.clear()
                            memo[entity] = make.of(*entity)
                        pieces += [text[at:i], _spelled(kind, text[i:j], memo[entity])]
                        at = j
                    out.append("".join([*pieces, text[at:]]) if spans else text)
                    counts.append(len(spans))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(out, pa.string()), pa.array(np.array(counts, dtype=np.int64))],
                    names=["doc_id", "text", "n_replaced"],
                )

    return run


def with_surrogates(docs: DataFrame, key: str) -> DataFrame:
    """(doc_id, text, n_replaced): the texts with every detected entity replaced.

    Detected: e-mail and IPv4 addresses, phone, card (see ``card_length``), social
    security and bank account numbers, secrets after a name like ``token =``, keys with
    a known prefix, long hexadecimal strings, and persons (a listed first name and a surname, or a title
    and a surname) with later mentions of their parts.  Everything else stays as it
    is, byte for byte.  A null text stays null; rows without a doc_id are replaced
    like the others.  The key decides the surrogates;
    the same key gives the same ones on every run.  Repeated rows are replaced
    alike; other columns are ignored.
    """
    secret = key.encode("utf-8")
    # a row without a key goes by its text; rows that meet by chance only share what they look up
    docs = workers_ready(docs).select("doc_id", "text", F.coalesce("doc_id", F.xxhash64("text")).alias("row"))
    found = saved(docs.select(F.col("row").alias("doc_id"), "text").mapInArrow(_detect, "doc_id bigint, kind string, value string"), "entities")
    other = exceptions(found.select("kind", "value").distinct(), secret)
    tweaks = (
        found.join(other, ["kind", "value"])
        .groupBy(F.col("doc_id").alias("row"))
        .agg(F.collect_set(F.struct("kind", "value", "tweak")).alias("tweaks"))
    )
    rows = attach(docs, tweaks, ["row"])
    return rows.mapInArrow(_replace(secret), "doc_id bigint, text string, n_replaced bigint")
