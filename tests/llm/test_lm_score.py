import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from govflow.llm import lm_score

PATH = public_tokenizers.path(lm_score.VOCABULARY)


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def all_segmentations(word, pieces, spelled):
    """Sum over all segmentations by plain recursion."""
    if not word:
        return 1.0
    total = 0.0
    for k in range(1, len(word) + 1):
        p = pieces.get(word[:k], spelled(word[0]) if k == 1 and word[0] not in pieces else None)
        if p is not None:
            total += p * all_segmentations(word[k:], pieces, spelled)
    return total


def test_lattice_sums_all_segmentations():
    model = lm_score.processor(PATH)
    rng = np.random.default_rng(3)
    log_probs = np.log(rng.random(model.get_piece_size()) * 0.1)
    pieces = {model.id_to_piece(i): math.exp(log_probs[i]) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))}
    byte = {int(model.id_to_piece(i)[3:5], 16): math.exp(log_probs[i]) for i in range(model.get_piece_size()) if model.is_byte(i)}
    spelled = lambda c: math.prod(byte[b] for b in c.encode())
    words = ["a", "the", "station", "étage", "zz🙂q", "ßx", "", "ሀb"]
    got = lm_score.Lattice(PATH, log_probs).log_probs(words)
    for w, lp in zip(words, got, strict=True):
        assert lp == pytest.approx(math.log(all_segmentations(lm_score.START + w, pieces, spelled)), rel=1e-9), w
    assert np.isfinite(lm_score.Lattice(PATH, log_probs).log_probs(["word" * 3000])).all()


@pytest.mark.parametrize("head", [0, 3, 200_000])
def test_scores_against_plain_counting(spark, monkeypatch, head):
    monkeypatch.setattr(lm_score, "HEAD", head)
    monkeypatch.setattr(lm_score, "TASK_WORDS", 20)
    rng = random.Random(5)
    words = ["the", "The", "of", "é", "x,y", "rare1", "rare2", "longerword"]
    rows = [(i, rng.choice([" ", "\n"]).join(rng.choices(words, [9, 3, 7, 2, 2, 1, 1, 2], k=rng.randrange(0, 20)))) for i in range(120)]
    rows += [(None, "the of nullid"), (500, None), (501, ""), (502, "onlyhere"), (502, "onlyhere")]
    docs = spark.createDataFrame([(i, t, 1.0) for i, t in rows], "doc_id long, text string, score double").repartition(4)
    got = lm_score.lm_scores(docs).collect()
    bucket = lambda i: zlib.crc32(str(i).encode()) % 7
    train = [t for i, t in rows if i is not None and bucket(i) != 2]
    counts, ends = Counter(w for t in train for w in words_of(t)), len(train)
    total, kinds = sum(counts.values()) + ends, len(counts) + 1
    want = []
    for i, t in rows:
        n = [counts[w] for w in words_of(t)] + [ends]
        base = sum(math.log10((c + 1) / (total + kinds + 1)) for c in n)
        want.append((i, i is not None and bucket(i) == 2, len(n), sum(c > 0 for c in n), total, round(base, 6)))
    assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got), key=repr) == sorted(want, key=repr)
    assert all(r.score < 0 for r in got)
    same = {round(r.score, 9) for r in got if r.doc_id == 502}
    assert len(same) == 1
    # The score of a text is that of its words and one end.
    table = lm_score.word_counts(docs.select("doc_id", "text", lm_score.F.coalesce(lm_score.id_bucket("doc_id", 7) != 2, lm_score.F.lit(False)).alias("learn")))
    log_probs, end = lm_score.piece_log_probs(table, ends, PATH)
    lattice = lm_score.Lattice(PATH, log_probs)
    for r in got[:40]:
        text = next(t for i, t in rows if i == r.doc_id)
        assert r.score == pytest.approx((lattice.log_probs(words_of(text)).sum() + end) / math.log(10), rel=1e-9)


def test_nothing_learned_and_empty_table(spark):
    docs = spark.createDataFrame([(None, "a b")], "doc_id long, text string")
    row = lm_score.lm_scores(docs).collect()[0]
    assert (row.n_tokens, row.n_known, row.train_tokens, row.base_score) == (3, 0, 0, 0.0)
    assert lm_score.lm_scores(docs.limit(0)).collect() == []


def test_words_that_share_a_hash_stay_apart(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"word{i % 7} other{i % 5} same same") for i in range(40)], "doc_id long, text string").repartition(3)
    plain = sorted(map(tuple, lm_score.lm_scores(docs).collect()))
    monkeypatch.setattr(lm_score, "HEAD", 0)
    monkeypatch.setattr(lm_score, "word_hash", lambda word: 7)
    for a, b in zip(sorted(map(tuple, lm_score.lm_scores(docs).collect())), plain, strict=True):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], rel=1e-9)


def test_long_words_are_scored_alone(monkeypatch):
    rng = random.Random(8)
    model = lm_score.processor(PATH)
    lattice = lm_score.Lattice(PATH, np.array([-5.0 - (i % 11) for i in range(model.get_piece_size())]))
    words = ["".join(rng.choice("abcdeéß中🙂") for _ in range(n)) for n in (1, 2, 5, 40, 40, 300, 1000)] + ["the" * 400, "=" * 700, "𝔘" * 300]
    monkeypatch.setattr(lm_score, "LONG_WORD", 10_000)
    rows = lattice.log_probs(words)
    monkeypatch.setattr(lm_score, "LONG_WORD", 0)
    for window in (1, 7, 64, 1 << 15):
        monkeypatch.setattr(lm_score, "WINDOW", window)
        assert lattice.log_probs(words) == pytest.approx(rows, rel=1e-11)


def test_a_word_of_many_characters_takes_seconds():
    rng = np.random.default_rng(9)
    model = lm_score.processor(PATH)
    lattice = lm_score.Lattice(PATH, np.array([-5.0 - (i % 11) for i in range(model.get_piece_size())]))
    word = "".join(map(chr, rng.integers(97, 123, 600_000)))
    began = time.process_time()
    found = lattice.log_probs([word])[0]
    assert time.process_time() - began < 15
    assert np.isfinite(found) and found < -600_000
