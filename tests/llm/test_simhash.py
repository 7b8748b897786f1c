import random

import numpy as np
from xxhash import xxh64_intdigest

from factloom.llm import simhash


def brute_print(text, n=4):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\v\f\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] or [" ".join(words)]
    h = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints, radius=4):
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def noisy(rng, n):
    out = {rng.getrandbits(64)}
    while len(out) < n:
        base = rng.choice(list(out))
        if rng.random() < 0.5:
            for b in rng.sample(range(64), rng.randrange(1, 7)):
                base ^= 1 << b
            out.add(base)
        else:
            out.add(rng.getrandbits(64))
    return sorted(out)


def test_tree_equals_all_pairs():
    rng = random.Random(1)
    for n in (1, 2, 300, 900):
        prints = noisy(rng, n)
        assert simhash.tree_components(np.array(prints, np.uint64)).tolist() == brute_components(prints)


def test_link_with_cuts_equals_all_pairs(spark):
    prints = noisy(random.Random(2), 500)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    got = {r["print"]: r["root"] for r in simhash.link(spark.createDataFrame([(s,) for s in signed], "print long"), shard=3).collect()}
    by_root = {}
    for s, r in zip(signed, brute_components(prints)):
        by_root.setdefault(r, []).append(s)
    want = {s: min(group) for group in by_root.values() if len(group) > 1 for s in group}
    assert got == want


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(4)
    vocabulary = [f"w{k}é" for k in range(300)]
    texts = [None, "", " \t\n", "one", "One", " x y", "A\x1cb c"]
    texts += [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 200))) for _ in range(40)]
    for t in list(texts[7:27]):
        words = t.split()
        words[rng.randrange(len(words))] = "changed"
        texts += [" ".join(words).upper(), t]
    texts.append("long " * 30_000)
    rows = [(k, t, "x") for k, t in enumerate(texts)] + [(9, texts[9], "x")]
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, fingerprint string")).collect()
    assert len(got) == len(rows)
    prints = [brute_print(t) for t in texts]
    roots = brute_components(prints)
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {k: (f"{prints[k]:016x}", roots[k]) for k in range(len(texts))}


def test_keep_one(spark):
    rows = [(3, "a b c d e", 1), (5, "a b c d e", 2), (5, "a b c d e", 2), (None, "a b c d e", 3), (7, None, 4), (8, "", 5)]
    got = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string, print int"))
    assert got.columns == ["doc_id", "text", "print"]
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got.collect()) == [(False, 3), (False, 7), (True, 0)]
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_tree_prunes_by_triangle_bounds():
    rng = random.Random(7)
    low = (1 << 54) - 1  # as in a shard: ten bits are shared
    prints = sorted({p & low for p in noisy(rng, 3000)})
    tally = {}
    assert simhash.tree_components(np.array(prints, np.uint64), tally=tally).tolist() == brute_components(prints)
    assert tally["cuts"] > 100 and tally["pairs"] < 0.5 * len(prints) * (len(prints) - 1) / 2
    dense = np.array(sorted({rng.getrandbits(12) for _ in range(4000)}), np.uint64)  # one group: what belongs together isn't compared again
    assert not simhash.tree_components(dense, tally=tally).any() and tally["pairs"] < 0.1 * len(dense) ** 2 / 2


def test_shards_hold_enough_for_the_tree():
    for n, agree in ((10, 1), (10_000, 1), (1_000_000, 1), (100_000_000, 2), (10_000_000_000, 3)):
        masks = simhash._masks(n, 4, simhash.SHARD)
        bits = {m.bit_count() for m in masks}
        assert len(bits) == 1 and n / 2 ** bits.pop() <= simhash.SHARD
        rng = random.Random(n)
        for _ in range(200):  # a pair within the radius agrees on one mask at least
            differ = sum(1 << b for b in rng.sample(range(64), 4))
            assert any(not differ & m for m in masks)
        assert len(masks) <= {1: 5, 2: 15, 3: 35}[agree]


def test_keep_one_judges_rows_not_ids(spark):
    a, b = "alpha beta gamma delta epsilon", "one two three four five six"
    rows = [(5, a, 1, "x"), (5, b, 2, "x"), (4, a, 3, "x"), (9, b, 4, "x"), (5, b, 5, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _first int, text_key string")
    got = simhash.keep_one(docs)
    assert got.columns == docs.columns
    kept = sorted((r.doc_id, r.text) for r in got.collect())
    assert kept == [(4, a), (5, b)]
