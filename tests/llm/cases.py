"""Small tables with every awkward case, and plain reference versions."""

import hashlib
import random
import zlib
from collections import Counter

SCHEMA = (
    "doc_id bigint, text string, lang string, source string, n_chars bigint, "
    "words string, rep string, size string, slot string, shard string, score string, copies string, mix_size string"
)


def sentence(rng, n, words=400):
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


def corpus(seed=1, n=60):
    """(doc_id, text, source): copies, near copies, shared passages, blanks, a long text."""
    rng = random.Random(seed)
    passage = sentence(rng, 80)
    base = sentence(rng, 120)
    texts = [None, "", "  \t\n ", "one", "one", "one two three four", base, base, base.replace(" ", "\n", 3)]
    for _ in range(6):
        words = base.split()
        words[rng.randrange(len(words))] = "changed"
        texts.append(" ".join(words))
    texts += [f"{sentence(rng, 20)} {passage} {sentence(rng, 15)}" for _ in range(6)]
    texts += ["la " * 300, "la " * 180, sentence(rng, 30_000, 50_000), "x" * 50_000]
    while len(texts) < n:
        texts.append(sentence(rng, rng.randrange(1, 90)))
    rng.shuffle(texts)
    sources = ["b", "a", None, "ä", "c"]
    return [(i, t, "a" if i % 3 == 0 else sources[i % 5]) for i, t in enumerate(texts)]


def frame(spark, rows):
    full = [(i, t, "en", s, len(t or ""), *["clash"] * 8) for i, t, s in rows]
    return spark.createDataFrame(full, SCHEMA)


def words(text):
    return (text or "").encode("utf-8").split()


def crc(key, n):
    return zlib.crc32(str(key).encode()) % n


def removed_by_brute_force(rows, size):
    first, out = {}, {}
    for i, text, _ in sorted(rows):
        w = words(text)
        for k in range(len(w) - size + 1):
            first.setdefault(tuple(w[k : k + size]), i)
    for i, text, _ in rows:
        w = words(text)
        gone = [False] * len(w)
        for k in range(len(w) - size + 1):
            if first[tuple(w[k : k + size])] < i:
                gone[k : k + size] = [True] * size
        kept = [x for x, g in zip(w, gone, strict=True) if not g]
        out[i] = (len(w), len(w) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest())
    return out


def shingles(text, size=5):
    w = words(text)
    if not w:
        return set()
    return {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)}


def links_by_brute_force(rows, tenths=8):
    sets = {i: shingles(t) for i, t, _ in rows}
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    links = Counter()
    keys = sorted(sets)
    for a in keys:
        for b in keys:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 10 * both >= tenths * (len(sets[a]) + len(sets[b]) - both):
                    links[a] += 1
                    links[b] += 1
                    x, y = root(a), root(b)
                    up[max(x, y)] = min(x, y)
    return {i: (root(i), links[i]) for i in keys}
