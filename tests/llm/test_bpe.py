import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import tiktoken

from govflow.llm import bpe

PATH = public_tokenizers.path(bpe.DEFAULT_RANKS)


def reference():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def cases():
    rng = random.Random(5)
    alphabet = "abcdeé ñ\n\t  'sßЖ中文1234.,!?-_<|>🙂  "
    texts = ["", " ", "\n\n", "a", "  a  b ", "don't we'll", "<|endoftext|>", "x" * 700, "abc" * 400, "é" * 300, " \n \n x", "\x1c\x1d a"]
    texts += ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 200))) for _ in range(300)]
    texts += ["".join(chr(rng.randrange(1, 0xD7FF)) for _ in range(60)) for _ in range(200)]
    texts += ["".join(rng.choice("abcde") for _ in range(rng.randrange(500, 900))) for _ in range(5)]
    return texts


def test_matches_the_library_and_round_trips():
    model, expected = bpe.load(PATH), reference()
    texts = cases()
    for text, ids in zip(texts, model.encode_batch(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == expected.encode_ordinary(text), text
        assert model.decode(ids) == text.encode()


def test_matrix_and_heap_agree():
    model = bpe.load(PATH)
    rng = random.Random(2)
    for _ in range(50):
        piece = "".join(rng.choice("aeinst") for _ in range(rng.randrange(2, 300))).encode()
        assert model._merge_matrix([piece])[0].tolist() == model._merge_long(piece).tolist()


def test_frames_with_nulls_repeats_and_clashing_columns(spark):
    rows = [(1, None, "x"), (None, "a b", "y"), (2, "", "z"), (2, "", "z"), (3, "word " * 50_000, "w")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = bpe.bpe_decode(bpe.bpe_encode(docs)).collect()
    assert sorted(len(r.ids) // 4 for r in out)[:3] == [0, 0, 0]
    assert {hashlib.sha256(r.decoded).hexdigest() for r in out} == {hashlib.sha256((t or "").encode()).hexdigest() for _, t, _ in rows}
    assert bpe.bpe_decode(bpe.bpe_encode(docs.limit(0))).collect() == []
