import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from factloom.llm import decontamination, linededup, lmscore
from factloom.llm.components import components


def test_components(spark):
    rng = random.Random(6)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(160)] + [(1000 + k, 1001 + k) for k in range(70)] + [(5, 5), (None, 3)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for x in root}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_line_dedup(spark):
    rows = [(k, "A", f"menu\nunique {k}\nmenu\nfoot {k % 5}") for k in range(40)] + [(100 + k, "B", "menu\nb") for k in range(3)] + [(200, "A", None), (201, "A", ""), (202, None, "menu\nx"), (0, "A", "menu\nunique 0\nmenu\nfoot 0")]
    docs = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, source string, text string, bad string").repartition(3)
    got = linededup.drop_boilerplate(docs, F.col("source"), linededup.text_lines("text")).collect()
    pages, lines = Counter(), Counter()
    for _, s, t in rows:
        pages[s] += 1
        for line in set((t or "").split("\n") if t is not None else []):
            lines[s, line] += 1
    want = []
    for k, s, t in rows:
        if t is None:
            want.append((k, 0, 0, ""))
            continue
        kept = [x for x in t.split("\n") if not (lines[s, x] >= 4 and lines[s, x] > 0.1 * pages[s])]
        want.append((k, len(t.split("\n")), len(t.split("\n")) - len(kept), "\n".join(kept)))
    assert sorted((r.doc_id, r.n_lines, r.n_dropped, r.clean_text or "") for r in got) == sorted(want)
    assert [r.clean_text for r in got if r.doc_id == 200] == [None] and got[0].bad == "c"
    assert linededup.drop_boilerplate(docs.limit(0), F.col("source"), linededup.text_lines("text")).count() == 0
    html = spark.createDataFrame([("<p>a<script>var x='</p>';</script> b</p><!-- c --><LI>d&amp;e</LI><b>f</b> g", "HTTPS://u@Ex.com:80/x"), (None, None)], "html string, url string")
    one = html.select(linededup.html_lines("html").alias("l"), linededup.host("url").alias("h")).collect()
    assert one[0].l == ["a b", "d&amp;e", "f g"] and one[0].h == "ex.com" and one[1].l is None and one[1].h == ""


def split(text):
    return [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").lower()) if w]


def test_decontamination_equals_brute_force(spark):
    rng = random.Random(8)
    vocabulary = [f"w{k}" for k in range(400)] + ["é"]
    items = [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(6, 50)))) for k in range(25)] + [(90, "two words"), (91, ""), (92, None), (0, "another text of item zero here"), (93, "x x x x x x x x x x")]
    docs = []
    for k in range(60):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(0, 150))]
        if k % 3 == 0:
            own = split(rng.choice(items[:25])[1])
            for _ in range(rng.randrange(0, 3)):
                own[rng.randrange(len(own))] = "changed"
            at = rng.randrange(len(words) + 1)
            words[at:at] = own
        docs.append((k, ", ".join(words).title()))
    docs += [(100, None), (101, ""), (102, "two  words"), (103, "X " * 3000), (104, items[3][1].rsplit(" ", 1)[0]), (0, docs[0][1]), (None, items[1][1])]

    def multiset(words, width):
        return Counter(tuple(words[i : i + width]) for i in range(len(words) - width + 1))

    want = {}
    for doc, text in docs:
        words = split(text)
        for item, it in items:
            own = split(it)
            width = min(5, len(own))
            if not own or len(words) < width:
                continue
            target, n = multiset(own, width), min(len(own), len(words))
            for s in range(len(words) - n + 1):
                have = multiset(words[s : s + n], width)
                shared = sum((have & target).values())
                sim = shared / (have.total() + target.total() - shared)
                if sim >= 0.8:
                    best = want.get((doc, item), (0, 0))
                    want[doc, item] = max(best, (round(sim, 6), -s))
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, item_id int").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.similarity, -r.start_word) for r in decontamination.leaks(df, bench).collect()}
    assert set(got) == set(want)
    assert all(got[k][0] <= want[k][0] for k in got) and sum(got[k] == want[k] for k in got) >= 0.9 * len(got)
    kept = decontamination.drop_leaks(df, bench)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {d for d, _ in docs} - {d for d, _ in want}
    assert decontamination.leaks(df, bench.limit(0)).count() == 0 and decontamination.leaks(df.limit(0), bench).count() == 0


def test_simhash_is_the_majority_of_bits(spark):
    h = [5, 7, 1, -1, -(1 << 63), 5]
    got = spark.range(1).select(F.array(*[F.lit(x).cast("long") for x in h]).alias("h")).select(decontamination.simhash("h").alias("s")).first().s
    want = sum(1 << b for b in range(64) if 2 * sum((x >> b) & 1 for x in h) > len(h))
    assert got & ((1 << 64) - 1) == want


@pytest.mark.parametrize("hot_share", [lmscore.HOT_SHARE, 0.05, 2.0])  # all pairs are hot, some, none
def test_lm_scores_equal_plain_counts(spark, hot_share):
    rng = random.Random(4)
    make = lambda words: " ".join(rng.choice(words) for _ in range(rng.randrange(0, 40)))
    target = [make(["alpha", "beta", "Gamma"]) for _ in range(20)] + [None]
    docs = [(k, make(["alpha", "beta", "delta", "é"])) for k in range(40)] + [(50, None), (51, ""), (52, "one"), (53, "a b " * 5000), (1, None)]
    docs[-1] = (0, docs[0][1])
    df = spark.createDataFrame([(*d, 0) for d in docs], "doc_id long, text string, key int").repartition(3)
    got = sorted((r.doc_id, r.n_tokens, r.target_loss, r.background_loss, r.score) for r in lmscore.score(df, spark.createDataFrame([(t,) for t in target], "text string"), hot_share=hot_share).collect())

    def model(texts):
        uni, pairs, context = Counter(), Counter(), Counter()
        for t in texts:
            ids = lmscore.word_ids(split(t)).tolist()
            uni.update(ids)
            pairs.update(zip(ids, ids[1:]))
            context.update(ids[:-1])
        n = uni.total()
        p = lambda w: (uni[w] + lmscore.ALPHA) / (n + lmscore.ALPHA * lmscore.VOCABULARY)
        return lambda ids: (-math.log(p(ids[0])) - sum(math.log((pairs[a, b] + lmscore.KAPPA * p(b)) / (context[a] + lmscore.KAPPA)) for a, b in zip(ids, ids[1:]))) / len(ids)

    t, b = model(target), model([d[1] for d in docs])
    assert len(got) == len(docs)
    for (doc, text), r in zip(sorted(docs, key=lambda d: d[0]), got):
        ids = lmscore.word_ids(split(text)).tolist()
        assert r[:2] == (doc, len(ids))
        if not ids:
            assert r[2:] == (None, None, None)
        else:
            assert abs(r[2] - t(ids)) < 1e-9 and abs(r[3] - b(ids)) < 1e-9 and abs(r[4] - (t(ids) - b(ids))) < 1e-9
    assert lmscore.score(df.limit(0), df.limit(0)).count() == 0


def test_slices_hold_their_own_bytes_only():
    """Parts of a batch, itself cut from a longer column, are compact copies that begin at offset 0; nulls are empty texts."""
    import pyarrow as pa
    from factloom.llm.common import slices

    texts = [None if k % 7 == 0 else chr(97 + k % 26) * (k * 13 % 400) for k in range(300)]
    parts = list(slices(pa.array(texts).slice(50, 200), 5000))
    assert [t for _, p in parts for t in p.to_pylist()] == [t or "" for t in texts[50:250]] and len(parts) > 5
    for _, p in parts:
        p.validate(full=True)
        assert p.offset == 0 and p.buffers()[2].size <= 5000
