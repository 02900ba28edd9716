import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from govflow.llm import packing


def test_packs_real_documents(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD", 60)
    rng = random.Random(9)
    words = ["hello", "World!", "don't", "<|endoftext|>", "é", "naïve", "x.y", "42", "\n\n", "中文"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([3, 40, 200, 700])))) for i in range(250)]
    rows += [(None, "null id"), (900, None), (901, ""), (902, ""), (902, ""), (903, "token " * 9000)]
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, piece int").repartition(5)
    got = packing.pack_documents(docs).collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    want = []
    for i, t in rows:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [0]
        for p in range(-(-len(ids) // 2048)):
            part = ids[p * 2048 : (p + 1) * 2048]
            want.append((i, p, p * 2048, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    assert sorted((tuple(r)[:5] for r in got), key=repr) == sorted(want, key=repr)
    held = {}
    for r in got:
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in held.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 2048
    plain: list = []
    packing.best_fit(list(range(len(got))), sorted((r.length for r in got), reverse=True), 2048, plain, [])
    assert len(held) <= len(plain) * 1.02 + 1


def test_words_encode_as_whole_texts():
    tokenizer = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    model = packing.load(public_tokenizers.path(packing.TOKENIZER))
    rng = random.Random(12)
    simple = "aAbzZ09 .,'\n\t\r-!sStT" + "éÉßÄöŒœŸÿřſŉıĿ" + "\x0b\x1c_|<>"
    wide = simple + "\u0130\u03a3\u03c2e\u0301\u00d7\u00f7\u2014\u201c\u4e2d\u0660\u00b2\u2167\ufb01\u00a0\u2028\U0001f600"
    texts = ["".join(rng.choice(a) for _ in range(rng.randrange(1, 60))) for a in (simple, wide) for _ in range(1500)]
    texts += ["don't", "'s 't 're'll", "x..'s", "a'b'c", "'", "it''s", "O'Neil's", "ΑΣ ΑΣ", "<|endoftext|>"]
    texts += ["a <|endoftext|> b", "a<|endoftext|>b", "'<|ENDOFTEXT|>", "<|endoftext|><|startoftext|>x", "É<|startoftext|>\u0301", "<|endoftext|", "<|<|endoftext|>|>", "x" * 300 + " <|endoftext|>"]
    for text, ids in zip(texts, model.encode_batch(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text


def test_empty_table(spark):
    assert packing.pack_documents(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_genetic_steps_keep_every_piece_once():
    rng = random.Random(2)
    for _ in range(40):
        sizes = [rng.randrange(1, 100) for _ in range(rng.randrange(1, 80))]
        one, two = (packing.fresh(sizes, 100, rng, j) for j in (0.0, 0.5))
        for bins in (one, two, packing.crossover(one, two, sizes, 100, rng), *packing.evolve(sizes, [one, two], 100, rng)):
            assert sorted(i for b in bins for i in b) == list(range(len(sizes)))
            assert all(sum(sizes[i] for i in b) <= 100 for b in bins)
            assert sorted(map(sorted, packing._bins(packing._labels(bins, len(sizes))))) == sorted(map(sorted, bins))


def test_evolution_beats_a_poor_start():
    rng = random.Random(7)
    sizes = [60] * 30 + [40] * 30
    poor = [[i] for i in range(60)]
    best = packing.evolve(sizes, [poor, packing.fresh(sizes, 100, rng, 0.0)], 100, rng)[0]
    assert len(best) == 30


def test_evolution_beats_best_fit():
    rng = random.Random(5)
    saved = 0
    for _ in range(10):
        sizes = [rng.randrange(400, 1000) for _ in range(200)]
        plain = packing.fresh(sizes, 2048, rng, 0.0)
        population = [plain, *(packing.fresh(sizes, 2048, rng, 0.05) for _ in range(3))]
        for _ in range(5):
            population = packing.evolve(sizes, population, 2048, rng)
        assert len(population[0]) <= len(plain)
        saved += len(plain) - len(population[0])
    assert saved >= 10


@pytest.mark.parametrize("lengths", [[600], [1100], [2000, 2047], [1, 2047, 1024, 30]])
def test_rounds_that_finish_little(spark, monkeypatch, lengths):
    monkeypatch.setattr(packing, "SHARD", 20)
    rows = [(i, 0, 0, lengths[i % len(lengths)], i) for i in range(140)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long").repartition(3)).collect()
    assert sorted(r.doc_id for r in got) == list(range(140))
    held = {}
    for r in got:
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in held.values():
        spans.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:], strict=False)) and spans[0][0] == 0 and sum(spans[-1]) <= 2048
    plain: list = []
    packing.best_fit(list(range(140)), sorted((r[3] for r in rows), reverse=True), 2048, plain, [])
    assert len(held) <= len(plain) + 1
