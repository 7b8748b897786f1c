import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))
from test_simhash import brute_components, brute_print  # noqa: E402

import corpus_pipeline  # noqa: E402
from factloom.llm import toxicity  # noqa: E402
from factloom.llm.common import fold_of  # noqa: E402


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(12)
    words = [f"w{k}" for k in range(500)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    item = text(30)
    rows = []
    for k in range(240):
        t = text(rng.randrange(30, 80))
        if k % 5 == 0:
            t += " scum idiot"
        if k % 7 == 0:
            t += " " + item
        rows.append((k, f"boiler plate line\n{t}\n{text(8)}", "en", f"src{k % 3}", len(t)))
    rows += [(300 + k, rows[k][1], "en", rows[k][3], 1) for k in range(1, 20, 3)]
    rows += [(400, None, "en", "src0", None), (401, "", None, None, 0)]
    path = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(2).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(k, 1, int(k % 5 == 0)) for k in range(240)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path), rows, item


def test_pipeline_equals_plain_stages(spark, folder):
    path, rows, item = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    labels = spark.read.parquet(f"{path}/labels.parquet").filter(fold_of("doc_id", 3) != 1)
    toxic = {r.doc_id for r in toxicity.score(docs, toxicity.fit(docs, labels)).collect() if r.predicted}
    left = [r for r in rows if r[0] not in toxic]
    assert len(toxic & {k for k in range(0, 240, 5)}) > 35 and len(toxic - {r[0] for r in rows if r[1] and "scum" in r[1]}) < 5
    pages, lines = {}, {}
    for _, t, _, s, _ in left:
        pages[s] = pages.get(s, 0) + 1
        for line in set(t.split("\n")) if t is not None else ():
            lines[s, line] = lines.get((s, line), 0) + 1
    clean = [(k, None if t is None else "\n".join(x for x in t.split("\n") if not (lines[s, x] >= 4 and lines[s, x] > 0.1 * pages[s]))) for k, t, _, s, _ in left]
    roots = brute_components([brute_print(t) for _, t in clean])
    first = {}
    for (k, _), root in zip(clean, roots):
        first[root] = min(first.get(root, k), k)
    kept = {k for k in first.values()}
    want = {k for k, t in clean if k in kept and item not in (t or "")}
    got = corpus_pipeline.run(spark, path).collect()
    assert {r.doc_id for r in got} == want
    ends = {}
    for r in got:
        ends.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in ends.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048


def test_stages_return_the_columns_of_documents(spark, folder):
    docs = spark.read.parquet(f"{folder[0]}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder[0])
        assert out.dtypes == docs.dtypes
    assert corpus_pipeline.ORACLE_SQL is None and [name for name, _ in corpus_pipeline.STAGES][0] == "toxicity"


def test_checkpoints_give_the_drivers_native_memory_back(spark, monkeypatch):
    """Native memory that the driver's JVM took in small pieces and freed goes back to the system, also where a piece in use stands behind it."""
    from factloom import lineage

    java = spark._jvm.java
    if java.lang.Runtime.version().compareTo(java.lang.Runtime.Version.parse("17.0.9")) < 0:
        pytest.skip("this Java has no release of native memory")
    status = Path(f"/proc/{java.lang.ProcessHandle.current().pid()}/status")
    held = lambda: int(status.read_text().split("RssAnon:")[1].split()[0]) / 1024
    monkeypatch.setattr(lineage, "RELEASE_S", 0, raising=False)
    lineage.checkpoint(spark.range(1))
    pieces = [java.util.zip.Deflater() for _ in range(1500)]
    full = held()
    for piece in pieces[:-1]:
        piece.end()
    lineage.checkpoint(spark.range(1))
    assert held() < full - 60
    pieces[-1].end()
