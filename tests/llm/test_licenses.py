import re

from factloom.llm import licenses

MIT = licenses.TEMPLATES["mit-grant"]


def brute(text):
    """Base places word by word."""
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
    hits = [(k, label) for phrase, label in licenses.BASE.items() for k in range(len(words)) if words[k : k + len(phrase.split())] == phrase.split()]
    starts = [k for k, _ in hits]
    return len(words), len(hits), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in hits}))


def test_automaton_regions():
    a = licenses.Automaton("one [two [three]] {1,2} four")
    ok = lambda s: a.match(s.encode().split(), 0)
    assert ok("one x four") == 3 and ok("one two three x y four") == 6 and ok("one two x four") == 4
    assert ok("one four") == -1 and ok("one x y z four") == -1 and ok("one x y") == -1
    assert ok("one two three four") == 4  # two and three may also be the replaceable words


def test_scan_equals_brute_force(spark):
    grant = re.sub(r"[\[\]]", "", MIT)
    texts = [None, "", "MIT-License mit license", "cc  BY cc-by, Apache\nLicense", "gnu general public license" * 2, "GNU General Public License é mit licenseé"]
    texts += ["x " * 50_000 + "Licensed under the Apache License, Version 2.0.", "Licensed under CC BY-NC 4.0.", "under the MIT License.", grant, grant.replace("charge", "fee"), grant.split("subject to")[0] + " end"]
    docs = spark.createDataFrame([(k, t, "clash") for k, t in enumerate(texts)], "doc_id long, text string, labels string").repartition(2)
    got = {r.doc_id: r for r in licenses.scan(docs).collect()}
    assert len(got) == len(texts)
    for k, t in enumerate(texts):
        r = got[k]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(t), t
        assert 0 <= r.score <= 1 and set(r.base_labels.split(",")) <= set(r.labels.split(",")) | {""}
    assert got[6].labels == "apache,apache-2.0" and got[7].labels == "cc-by,cc-by-nc" and "mit-line" in got[8].labels
    assert "mit-grant" in got[9].labels and "mit-grant" not in got[10].labels and "mit-grant" in got[11].labels
    assert got[9].score == 1.0
    assert licenses.scan(docs.limit(0)).count() == 0
