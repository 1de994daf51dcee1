"""Exact repeats, periodic runs and spelling variants, each against a plain version."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from cases import SCHEMA, corpus, crc, frame, words
from pyspark.sql import functions as F

from parley.llm import exact, periods, spelling

# ---- exact repeats


def test_perfect_hash_is_a_bijection():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 5000):
        digests = rng.integers(0, 1 << 63, (n, 4), dtype=np.uint64)
        sizes, bits = exact.build(digests)
        assert sorted(exact.slots(digests, sizes, bits)) == list(range(n))
    others = rng.integers(0, 1 << 63, (3000, 4), dtype=np.uint64)
    found = exact.slots(others, sizes, bits)
    assert found.min() >= -1 and found.max() < n
    with pytest.raises(RuntimeError, match="distinct"):
        exact.build(np.ones((2, 4), dtype=np.uint64))


def kept_by_brute_force(rows):
    groups = {}
    for i, text, *_ in rows:
        text = text or ""
        digest = hashlib.sha256(re.sub(r"[\x20\x09-\x0D]", "", text).encode()).hexdigest()
        group = groups.setdefault(digest, {})
        group[i] = max(group.get(i, 0), len(text))
    out = []
    for digest, group in groups.items():
        keep = min(group, key=lambda i: (-group[i], i is None, i or 0))
        out += [(i, keep, len(group), i == keep, digest) for i in group]
    return Counter(out)


def exact_rows():
    rows = corpus(n=120)
    rows += [(900, "é à b", "a"), (901, "éà   b", "a"), (902, "éà b", "a"), (-3, "one ", "b"), (903, "o n\x0be", "c")]
    rows += [(i, "copy of a copy", "hot") for i in range(1000, 1400)] + [(1500, "copy  of a copy", "hot")]
    rows += [(None, "copy of a copy", "a"), (None, None, "a"), (None, "only here", "a")]
    return rows + [rows[3], rows[-6], (1000, "another text", "a"), (1000, "copy of a  copy ", "a")]


@pytest.mark.parametrize("historical", [None, "true", "false", "source = 'hot'"])
def test_exact_repeats(spark, historical):
    rows = exact_rows()
    mark = None if historical is None else F.expr(historical)
    got = exact.deduplicated(frame(spark, rows), mark, per_shard=40)
    assert Counter(map(tuple, got.collect())) == kept_by_brute_force(rows)


def test_exact_repeats_of_nothing(spark):
    assert exact.deduplicated(spark.createDataFrame([], SCHEMA)).collect() == []
    kept = exact.without_repeats(frame(spark, exact_rows()[:120]))
    want = {i for i, keep, *_ in kept_by_brute_force(exact_rows()[:120]) if i == keep}
    assert {r.doc_id for r in kept.collect()} == want and len(kept.columns) == 13


# ---- periodic runs


def runs_by_brute_force(ws, least=24, exponent=3):
    n, out = len(ws), []
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and ws[j] == ws[j + q]:
                j += 1
            if j + q - i >= max(least, exponent * q):
                primitive = all(any(ws[x] != ws[x + p] for x in range(i, j + q - p)) for p in range(1, q) if q % p == 0)
                out += [(i, j + q - i, q)] if primitive else []
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def periodic_texts(rng):
    a = rng.choice([1, 2, 2, 3, 5, 30])
    n = rng.randrange(150)
    word = lambda: f"w{rng.randrange(a)}"
    kind = rng.randrange(6)
    if kind == 0:
        return [word() for _ in range(n)]
    if kind == 1:
        out = []
        while len(out) < n:
            period = [word() for _ in range(rng.randrange(1, 25))]
            out += period * rng.randrange(1, 12) + period[: rng.randrange(len(period) + 1)]
        return out
    if kind == 2:
        x, y = ["a"], ["a", "b"]
        for _ in range(9):
            x, y = y, y + x
        return y
    if kind == 3:
        return ["a"] * n + ["b"] * rng.randrange(30) + ["a"] * n
    if kind == 4:
        inner = [word() for _ in range(rng.randrange(1, 8))] * rng.randrange(1, 6) + [word()]
        return (inner * rng.randrange(1, 7) + ["z"]) * rng.randrange(1, 5)
    return [word() for _ in range(n)] * 4


@pytest.mark.parametrize("least,exponent", [(24, 3), (6, 2), (6, 3), (9, 3), (4, 2)])
def test_runs(least, exponent):
    rng = random.Random(least)
    for _ in range(60):
        texts = [periodic_texts(rng) for _ in range(rng.randrange(1, 8))]
        got = periods.text_runs(pa.array([" ".join(t) for t in texts]), least, exponent)
        assert got == [runs_by_brute_force(t, least, exponent) for t in texts]


def test_runs_looked_at_in_small_parts(monkeypatch):
    monkeypatch.setattr(periods, "TOGETHER", 10)
    text = [f"w{i}" for i in range(9)] * 7 + ["x"] + ["la"] * 40
    assert periods.text_runs(pa.array([" ".join(text)])) == [runs_by_brute_force(text)]


def digest_by_brute_force(i, text, overlay=True):
    ws = words(text)
    n, h = len(ws), zlib.crc32(str(i).encode())
    if overlay and i is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        ws = [w if x < a else ws[a + (x - a) % p] for x, w in enumerate(ws)]
    runs = runs_by_brute_force(ws)
    top = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
    gone = {x for s, n, q in runs for x in range(s + q, s + n)}
    kept = b" ".join(w for x, w in enumerate(ws) if x not in gone)
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    best = (*top, 1000 * top[1] // top[2]) if top else (None,) * 4
    return (i, len(runs), *best, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def test_runs_of_documents(spark):
    rng = random.Random(5)
    rows = [r for r in corpus() if len(r[1] or "") < 10_000]
    rows += [(200 + i, " \t".join(periodic_texts(rng)), "a") for i in range(60)]
    rows += [(400, "é   " * 30, "a"), (401, "a b " * 12 + "c d " * 12, "a"), rows[-1]]
    got = periods.run_digest(periods.collapsed(periods.overlaid(frame(spark, rows)))).collect()
    assert Counter(map(tuple, got)) == Counter(digest_by_brute_force(i, t) for i, t, _ in rows)
    assert sum(crc(i, 10) == 0 for i, *_ in rows) > 5


def test_runs_of_odd_rows(spark):
    rows = [(None, "la " * 30, "a"), (None, None, "a"), (7, "long " * 40_000, "a"), (8, "x" * 100_000, "a")]
    got = {r.doc_id: r for r in periods.collapsed(frame(spark, rows[:1] + rows[2:])).collect()}
    assert [tuple(r) for r in got[None].runs] == [(0, 30, 1)] and got[None].collapsed == "la"
    assert [tuple(r) for r in got[7].runs] == [(0, 40_000, 1)] and got[8].runs == []
    assert tuple(periods.collapsed(frame(spark, rows[1:2])).first()) == (None, 0, [], "")
    assert periods.run_digest(periods.collapsed(periods.overlaid(spark.createDataFrame([], SCHEMA)))).collect() == []
    with pytest.raises(ValueError, match="exponent"):
        periods.collapsed(frame(spark, rows), exponent=1)


# ---- spelling variants


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def variants_by_brute_force(counts):
    out, forms = {}, {}
    for w, n in counts.items():
        near = [v for v in counts if one_edit(w, v)]
        best = min(near, key=lambda v: (-counts[v], v), default=None)
        forms[w] = best if best and counts[best] >= 2 * n else None
        out[w] = [forms[w], w, n, len(near), counts[forms[w]] if forms[w] else None]
    for row in out.values():
        while forms[row[1]]:
            row[1] = forms[row[1]]
    return {w: tuple(row) for w, row in out.items()}


def counts_by_brute_force(rows, slip):
    upper = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
    total = Counter()
    for i, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(upper)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if slip and h % slip == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            total[run] += 1
    return {w: n for w, n in total.items() if len(w) >= 5 and n >= 3}


def table(rows):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows.collect()}


@pytest.mark.parametrize("pairs", [10_000, 1])
def test_variants(spark, pairs):
    rng = random.Random(3)
    counts = {}
    for _ in range(40):
        base = "".join(rng.choice("abé") for _ in range(rng.randrange(2, 12)))
        counts[base] = rng.randrange(1, 200)
        for _ in range(12):
            at = rng.randrange(len(base) + 1)
            new = base[:at] + rng.choice(["", "a", "ü"]) + base[at + rng.randrange(2) :]
            counts[new or "a"] = rng.choice([1, 3, 6, 12, 24, 200])
    counts |= {f"prefix{x}{y}": 5 for x in "abcde" for y in "abcde"} | {"x" * 5000: 9, "x" * 4999 + "y": 3, "a": 4, "b": 400}
    counts |= {"aaaaaaaa": 1, "aaaaaaa": 2, "aaaaaa": 4, "aaaaa": 8, "aaaa": 16}  # a chain of forms
    given = spark.createDataFrame([(w, n, "clash", "clash") for w, n in counts.items()], "word string, n bigint, path string, rest string")
    assert table(spelling.variants(given, pairs=pairs)) == variants_by_brute_force(counts)


def test_variants_of_documents(spark):
    rng = random.Random(4)
    vocabulary = ["".join(rng.choice("abcdeé") for _ in range(rng.randrange(4, 9))) for _ in range(40)]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(60)) for _ in range(80)]
    rows = [(i, t, "a") for i, t in enumerate(texts)]
    rows += [(500, None, "a"), (501, "", "a"), (502, "LETTERS Letters letters ÉTÉÉÉ étééé " * 3, "a"), (None, texts[0], "a"), rows[0], (503, "z" * 30_000, "a")]
    counts = counts_by_brute_force(rows, 97)
    assert {r.word: r.n for r in spelling.counted(frame(spark, rows), slip=97).collect()} == counts
    assert counts != counts_by_brute_force(rows, None)
    assert table(spelling.variants(spelling.counted(frame(spark, rows), slip=97))) == variants_by_brute_force(counts)
    assert {"ÉtÉÉÉ", "étééé", "letters"} <= set(counts_by_brute_force(rows[82:83], None))


def test_variants_of_nothing(spark):
    assert spelling.variants(spelling.counted(spark.createDataFrame([], SCHEMA))).collect() == []
    odd = spark.createDataFrame([(None, 3), ("word", None), ("words", 0), ("word", 2), ("word", 1), ("", 5)], "word string, n bigint")
    assert sorted(map(tuple, spelling.variants(odd).collect())) == [("", None, "", 5, 0, None), ("word", None, "word", 3, 0, None)]
    with pytest.raises(ValueError, match="ratio"):
        spelling.variants(odd, ratio=1)
