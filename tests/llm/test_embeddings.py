import math

import numpy as np

from factloom.llm import embeddings


def brute(rows, cosine=0.93):
    good = {}
    for k, (i, v, label) in enumerate(rows):
        if i is not None and label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            good[k] = np.array(v) / np.linalg.norm(v)
    links = {k: set() for k in good}
    for a in good:
        for b in good:
            if a != b and rows[a][2] == rows[b][2] and len(good[a]) == len(good[b]) and good[a] @ good[b] >= cosine:
                links[a].add(b)
    out = []
    for k, (i, _, _) in enumerate(rows):
        seen, todo = {k}, [k]
        while todo:
            for b in links.get(todo.pop(), ()):
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        least = min((rows[x][0] for x in seen if rows[x][0] is not None), default=None)
        out.append((i, len(links.get(k, ())), least, i is not None and i == least))
    return out


def make(n, seed):
    rng = np.random.default_rng(seed)
    rows, base = [], rng.normal(size=(n, 16))
    for k in range(n):
        v = base[k] if k % 3 else base[k // 10] + rng.normal(size=16) * 0.1
        rows.append((k, [float(x) for x in v], int(k % 4 == 0)))
    hub = rng.normal(size=16)
    rows += [(n + k, [float(x) for x in hub + rng.normal(size=16) * 0.05], 0) for k in range(60)]
    rows += [(n + 100 + k, rows[1][1], rows[1][2]) for k in range(30)]
    rows += [(9001, None, 0), (9002, [0.0] * 16, 0), (9003, [1.0, None] + [0.0] * 14, 0), (9004, [math.inf] + [1.0] * 15, 0), (9005, [math.nan] * 16, 0), (9006, rows[0][1], None), (9007, [], 0), (9008, [1.0, 2.0], 0), (5, rows[5][1], rows[5][2]), (None, rows[2][1], rows[2][2])]
    return rows


def test_whole_graph_equals_brute_force(spark):
    rows = make(200, 1)
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, label int, n_links int").repartition(3)
    got = embeddings.near_duplicates(df)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(brute(rows), key=str)
    assert embeddings.near_duplicates(df.limit(0)).count() == 0


def test_shards_and_parts_keep_recall(spark):
    rows = make(400, 2)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)
    got = embeddings.near_duplicates(df, shard=40)
    want = {r[:2] + r[2:] for r in brute(rows)}
    found = {tuple(r) for r in got.collect()}
    assert len(found & want) >= 0.9 * len(want)
    n = {r[0]: r[1] for r in want}
    assert all(r[1] <= n[r[0]] for r in found)  # no false links
    assert embeddings.audit(df.filter("vec_id < 9000"), got, 200) >= 0.9


def test_dense_groups_are_solved_by_pairs_of_blocks(spark):
    rng = np.random.default_rng(3)
    hub = rng.normal(size=24)
    rows = [(k, [float(x) for x in hub + rng.normal(size=24) * 0.06], 0) for k in range(400)] + [(500 + k, [float(x) for x in rng.normal(size=24)], 0) for k in range(200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)
    got = {r.vec_id: r for r in embeddings.near_duplicates(df, shard=20).collect()}
    want = {r[0]: r for r in brute(rows)}
    assert sum(got[k].n_links for k in got) >= 0.98 * sum(r[1] for r in want.values())
    assert all(got[k].n_links <= want[k][1] for k in got) and {k: r.component_id for k, r in got.items()} == {k: r[2] for k, r in want.items()}


def test_ties_long_vectors_and_text_ids(spark):
    rows = [(f"v{k:02}", [1.0] * 3000 if k < 4 else [float((j * (k + 1)) % 7 - 3) for j in range(3000)], 1) for k in range(12)]
    df = spark.createDataFrame(rows, "vec_id string, embedding array<double>, label int")
    got = embeddings.near_duplicates(df)
    assert [(r.n_links, r.component_id) for r in got.orderBy("vec_id").collect()][:4] == [(3, "v00")] * 4
    assert embeddings.audit(df, got, 12) == 1.0


def test_prune_keeps_the_nearest_and_spares_the_occluded():
    rng = np.random.default_rng(8)
    v = rng.normal(size=(60, 6))
    v /= np.linalg.norm(v, axis=1)[:, None]
    for p, chosen in enumerate(embeddings.prune(v, degree=8)):
        far = 1 - v @ v[p]
        left = sorted((x for x in range(60) if x != p), key=lambda x: far[x])
        want = []
        while left and len(want) < 8:
            best = left.pop(0)
            want.append(best)
            left = [x for x in left if embeddings.ALPHA * (1 - v[x] @ v[best]) > far[x]]
        assert chosen.tolist() == want
