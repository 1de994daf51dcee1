import random
from collections import Counter, defaultdict

import pytest
from cases import corpus, frame, sentence, words

from parley.llm import chats, decontaminate, mixing, sharding


def passages_by_brute_force(rows, items, threshold=0.8):
    out = {}
    lower = lambda t: [w.lower() for w in words(t)]
    grams = lambda w: [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
    for i, text, _ in rows:
        w = lower(text)
        all_ = grams(w)
        for j, item in items:
            q = lower(item)
            want = Counter(grams(q))
            if not want or not set(want) & set(all_):
                continue
            best = None
            for start in range(5 - len(q), len(w) - 4):
                a, b = max(start, 0), min(start + len(q), len(w))
                have = Counter(all_[a : b - 4])
                both = sum((have & want).values())
                alike = both / (sum(have.values()) + sum(want.values()) - both) if have else 0
                if alike >= threshold and (best is None or alike > best[2]):
                    best = (a, b - a, alike)
            if best:
                out[i, j] = best
    return out


def test_benchmark_passages(spark):
    rng = random.Random(11)
    items = [(k, sentence(rng, n)) for k, n in enumerate([8, 12, 25, 40, 60, 5])] + [(6, None), (7, ""), (8, "too short"), (9, "la " * 30)]
    plain = [t for _, t in items[:6]]
    longer = plain[4].split()
    texts = [
        f"{sentence(rng, 30)} {plain[2]} {sentence(rng, 10)}", plain[3].upper(), plain[0], plain[5], " ".join(longer[:-3]), " ".join(longer[4:]),
        " ".join([*longer[:30], "new", *longer[30:]]), " ".join([*longer[:30], *longer[31:]]), " ".join(["x" if k % 9 == 0 else w for k, w in enumerate(longer)]),
        f"{plain[1]} {plain[2]} {plain[1]}", "la " * 400, "la " * 27,
    ]
    rows = corpus(6) + [(1000 + k, t, "a") for k, t in enumerate(texts)]
    bench = spark.createDataFrame([(*r, "clash") for r in items], "item_id bigint, text string, words string")
    docs = frame(spark, rows)
    got = {(r.doc_id, r.item_id): (r.start, r.n_words, pytest.approx(r.similarity)) for r in decontaminate.find_passages(docs, bench).collect()}
    want = passages_by_brute_force(rows, items)
    assert got == want and len(want) > 10
    clean = decontaminate.decontaminated(docs, bench)
    assert clean.columns == docs.columns
    assert {r.doc_id for r in clean.collect()} == {i for i, _, _ in rows} - {i for i, _ in want}
    assert decontaminate.find_passages(docs, bench.limit(0)).collect() == []
    assert decontaminate.find_passages(docs.limit(0), bench).collect() == []


def test_passages_with_their_parts_in_another_order(spark):
    rng = random.Random(12)
    items = [(k, sentence(rng, n)) for k, n in enumerate([60, 90, 200])]
    rows = []
    for k, text in items:
        w = text.split()
        for part in (0.25, 0.33, 0.5, 0.75):
            cut = int(len(w) * part)
            swapped = " ".join(w[cut:] + w[:cut])
            rows += [f"{sentence(rng, 40)} {swapped} {sentence(rng, 25)}", swapped, f"{sentence(rng, 9)} {' '.join((w[cut:] + w[:cut])[:-2])}"]
        rows.append(" ".join(w[: len(w) // 2] + w))
    rows = [(k, t, "a") for k, t in enumerate(rows)]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = {(r.doc_id, r.item_id): (r.start, r.n_words, pytest.approx(r.similarity)) for r in decontaminate.find_passages(frame(spark, rows), bench).collect()}
    want = passages_by_brute_force(rows, items)
    assert got == want and len(want) > 30


def test_repeated_rows_count_once(spark):
    rows = [(1, "a b c d e f g h", "a")] * 2
    bench = spark.createDataFrame([(5, "a b c d e f g h")] * 3, "item_id bigint, text string")
    got = decontaminate.find_passages(frame(spark, rows), bench).collect()
    assert [tuple(r) for r in got] == [(1, 5, 0, 8, 1.0)]
    assert decontaminate.decontaminated(frame(spark, rows), bench).collect() == []


def mix_targets(sizes):
    """Targets by sharing out again and again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    left, target, free = float(sum(sizes.values())), dict.fromkeys(names, 0.0), set(names)
    while left > 1e-9 and free:
        share = left / sum(weight[s] for s in free)
        left = 0.0
        for s in list(free):
            target[s] += share * weight[s]
            if target[s] >= 3 * sizes[s]:
                left += target[s] - 3 * sizes[s]
                target[s] = 3.0 * sizes[s]
                free.discard(s)
    return target


def test_mix_reaches_its_targets(spark):
    rng = random.Random(4)
    rows = [(i, sentence(rng, rng.randrange(1, 60)), rng.choice(["a", "b", "b", "b", "ü", None, "tiny"])) for i in range(900)]
    rows = [(i, t, "a" if s == "tiny" and i > 40 else s) for i, t, s in rows] + [(901, None, "empty"), (902, "", "b")]
    docs = frame(spark, rows)
    got = mixing.mixed(docs).collect()
    sizes = defaultdict(int)
    for _, text, source in rows:
        sizes[source] += len(words(text))
    target = mix_targets(sizes)
    took = defaultdict(int)
    for r in got:
        assert r.mix_size == len(words(r.text)) and r.mix_source_size == sizes[r.source]
        assert r.mix_target == pytest.approx(target[r.source])
        assert 0 <= r.mix_copies <= 3 and r.words == "clash"
        took[r.source] += r.mix_size * r.mix_copies
    for source, want in target.items():
        assert abs(took[source] - want) <= max(3, 0.01 * want)
    again = mixing.mixed(docs.repartition(7)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    copies = mixing.copies(docs)
    assert copies.columns == docs.columns
    assert Counter(r.doc_id for r in copies.collect()) == Counter({r.doc_id: r.mix_copies for r in got if r.mix_copies})


def test_mix_prefers_documents(spark):
    rng = random.Random(9)
    docs = spark.createDataFrame([(i, "w " * 10, "abc"[i % 3], 1.0 + 3 * (i % 2)) for i in range(3000)], "doc_id bigint, text string, source string, liked double")
    got = mixing.mixed(docs, prefer="liked").filter("source = 'c'").collect()
    share = [sum(r.mix_copies for r in got if r.liked == x) for x in (1.0, 4.0)]
    assert share[1] > 2.5 * share[0]
    assert rng


def test_mix_of_nothing_and_of_repeated_rows(spark):
    assert mixing.mixed(frame(spark, [])).collect() == []
    blank = mixing.mixed(frame(spark, [(1, None, None), (2, " ", "a")])).collect()
    assert {r.mix_copies for r in blank} == {0} and {r.mix_target for r in blank} == {0.0}
    same = mixing.mixed(frame(spark, [(1, "a b", "a")] * 4 + [(2, "c", "b")])).collect()
    assert len({r.mix_copies for r in same if r.doc_id == 1}) == 1


def test_shard_table():
    table = sharding.fill_table([f"s{i}" for i in range(7)], 101)
    counts = Counter(table)
    assert len(counts) == 7 and max(counts.values()) - min(counts.values()) <= 1
    fewer = sharding.fill_table([f"s{i}" for i in range(6)], 101)
    moved = sum(a != b for a, b in zip(table, fewer, strict=True) if a != 6)
    assert moved < 40
    for bad in ([], ["a", "a"]):
        with pytest.raises(ValueError):
            sharding.fill_table(bad, 101)
    with pytest.raises(ValueError):
        sharding.fill_table(["a"], 100)
    assert sharding.fill_table(["a"], 2) == [0, 0]


def test_placement(spark):
    rows = [*corpus(), (None, "no key", None), (3, "again", "a")]
    docs = frame(spark, rows)
    got = sharding.placed(docs, [f"s{i}" for i in range(5)], 101).collect()
    table = sharding.fill_table([f"s{i}" for i in range(5)], 101)
    import hashlib

    assert len(got) == len(rows)
    for r in got:
        key = "" if r.doc_id is None else str(r.doc_id)
        slot = int(hashlib.md5(key.encode()).hexdigest()[:15], 16) % 101
        assert (r.slot, r.shard) == (slot, f"s{table[slot]}") and r.words == "clash"
    assert sharding.placed(docs.limit(0)).collect() == []


def test_chat_snapshots(spark):
    chat = [(role, f"turn {k}") for k, role in enumerate(["user", "assistant"] * 6)]
    talks = {k: chat[:k] for k in range(1, 13)}
    talks |= {20: chat, 21: [*chat[:4], ("user", "other")], 22: [("user", None)], 23: [("user", "")], 24: [(None, "x"), ("user", None)], 25: chat[2:6]}
    rows = [(c, t, role, text, "clash") for c, turns in talks.items() for t, (role, text) in enumerate(turns)]
    rows += [(30, 0, "user", "same", "clash")] * 3 + [(31, 0, "user", "same", "clash")] * 2 + [(None, 0, "user", "lost", "clash"), (32, None, "user", "z", "clash")]
    frame_ = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, piece string")
    for piece in (1024, 2):
        got = chats.rendered(frame_, piece).collect()
        assert {r.conv_id for r in got} == {12, 21, 22, 23, 24, 25, 30, 32}
        whole = "".join(r.text for r in sorted(got, key=lambda r: r.part) if r.conv_id == 12)
        assert whole == "".join(f"<|im_start|>{role}\n{text}<|im_end|>\n" for role, text in chat)
        assert sum(r.n_turns for r in got if r.conv_id == 30) == 3
        assert next(r.text for r in got if r.conv_id == 24).startswith("<|im_start|>unknown\nx<|im_end|>")
    assert chats.rendered(frame_.limit(0)).collect() == []
