import random
import zlib

import numpy as np
import pytest

from factloom.llm import packing

P = pytest.importorskip("public_tokenizers")
PATH = P.path("word_bpe_49k.json")


def test_plan_uses_every_piece_once_and_nothing_overflows():
    rng = random.Random(3)
    for size in (1, 7, 50, 512):
        counts = {n: rng.randrange(0, 40) for n in range(1, size + 1)}
        made = packing.plan(counts, size)
        used = {}
        for times, lengths in made:
            assert sum(lengths) <= size and times > 0
            for n in lengths:
                used[n] = used.get(n, 0) + times
        assert used == {n: c for n, c in counts.items() if c}
        gaps = []  # first fit of the longest first, piece by piece
        for n in sorted((n for n, c in counts.items() for _ in range(c)), reverse=True):
            at = next((i for i, gap in enumerate(gaps) if gap >= n), None)
            if at is None:
                gaps.append(size - n)
            else:
                gaps[at] -= n
        assert sum(t for t, _ in made) <= len(gaps) * 1.01 + 1
    assert packing.plan({}) == []


def test_pack_is_an_exact_round_trip(spark):
    from tokenizers import Tokenizer

    rng = random.Random(5)
    texts = [None, "", "a", "<|endoftext|> A. b,", "x " * 5000, "É́À　x..\tdon't  stop", "same text", "same text"]
    texts += [" ".join(rng.choice(["the", "Ouwhea", "erst.", "12,", "naïve"]) for _ in range(rng.randrange(1, 400))) for _ in range(60)]
    rows = [(k, t, "clash") for k, t in enumerate(texts)] + [(6, "same text", "clash")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, sequence_id string").repartition(3)
    got = packing.pack_documents(docs, PATH, 64, with_ids=True).collect()
    plain = Tokenizer.from_file(PATH)
    want = {k: [*plain.encode(t or "", add_special_tokens=False).ids, 0] for k, t in enumerate(texts)}
    for k, ids in want.items():
        parts = sorted((r for r in got if r.doc_id == k), key=lambda r: r.piece)
        if k == 6:
            assert len(parts) == 2 and parts[0].ids == parts[1].ids == ids
            continue
        assert [i for r in parts for i in r.ids] == ids
        assert [r.start for r in parts] == list(range(0, len(ids), 64))
        for r in parts:
            assert r.length == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 64
    assert len(by) <= -(-sum(r.length for r in got) // 64) + 2


def test_empty_table(spark):
    assert packing.pack_documents(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def test_plain_chunks_meet_the_model_only():
    import pyarrow as pa
    from tokenizers import Tokenizer

    plain, tokens, met = Tokenizer.from_file(PATH), packing.ChunkTokens(PATH), []

    class Counted:
        def encode_batch_fast(self, texts, **how):
            met.extend(texts)
            return plain.encode_batch_fast(texts, **how)

    tokens.tokenizer = Counted()
    rng = random.Random(7)
    western = [chr(c) for c in (*range(33, 127), *range(0xC0, 0x100)) if c not in (0xD7, 0xF7)]
    texts = [" ".join("".join(rng.choices(western, k=rng.randrange(1, 12))) for _ in range(50)).replace("<|", "<") for _ in range(40)]
    texts += ["", " \n", *western, "don't x='s' ('s I'LL 'twas o'clock. ('tis) a''s 'Él'd's", "stop.\nGo,the (word) half-way: 3.14 naïve... [É]ÿß!"]
    odd = ["naïve ée. ≠ x\tb.,c", "İKſ 中文,字 ²a ×÷ \U0001f600.a", "'́s a'́s’s \x00a.b\x1cc"]
    special = ["Ab.<|endoftext|>C,d <|x|> <|EndOfText|> a<|startoftext|>", "SAME Chunks, é.A don't"]
    for some in (texts, odd, special):
        flat, ends = tokens.encode(pa.array(some, pa.large_string()))
        for k, text in enumerate(some):
            assert flat[ends[k] : ends[k + 1]].tolist() == plain.encode(text, add_special_tokens=False).ids, text
        if some is texts:
            assert not met  # the tokenizer's own rules took most of the time
    assert met and not {"same", "SAME", "chunks,", "naïve"} & set(met)


def test_a_tokenizer_with_other_rules_is_not_parted(tmp_path):
    import json

    import pyarrow as pa
    from tokenizers import Tokenizer

    rules = json.loads(Tokenizer.from_file(PATH).to_str())
    rules["normalizer"] = None
    rules["pre_tokenizer"] = {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, packing.BYTE_LEVEL]}
    path = str(tmp_path / "other.json")
    Tokenizer.from_str(json.dumps(rules)).save(path)
    texts = ["Stop. it's (half-way), O'Neil", "A\nb é. É"]
    flat, ends = packing.ChunkTokens(path).encode(pa.array(texts, pa.large_string()))
    for k, text in enumerate(texts):
        assert flat[ends[k] : ends[k + 1]].tolist() == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids
