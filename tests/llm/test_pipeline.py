import random

import corpus_pipeline
from tests.llm.test_near_dedup import brute

from govflow.llm import packing
from govflow.llm.packing import public_tokenizers


def expected(rows):
    """The stages by plain Python: ids and texts that reach the last one."""
    kept = [(i, t) for i, t in rows if t and any(c.isalpha() for c in t)]
    last = {}
    for i, t in kept:
        last[t] = max(i, last.get(t, i))
    kept = [(i, t) for i, t in kept if last[t] == i]
    component = {i: c for i, _, c in brute(kept, 5, 80)}
    return [(i, t) for i, t in kept if component[i] == i]


def test_stages_against_plain_python(spark, tmp_path):
    rng = random.Random(21)
    words = ["alpha", "beta", "gamma", "delta", "Épsilon", "zeta", "eta", "theta", "iota", "kappa"]
    rows = []
    for _ in range(25):
        base = [rng.choice(words) + str(rng.randrange(50)) for _ in range(rng.choice([4, 40, 120]))]
        for _ in range(rng.choice([1, 1, 2, 4])):
            text = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 8])):
                text[rng.randrange(len(text))] = rng.choice(words)
            rows.append((len(rows) * 2, " ".join(text)))
    rows += [(900, None), (901, ""), (902, "123 456 !!"), (903, "single"), (904, "single")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    model = packing.load(public_tokenizers.path(packing.TOKENIZER))
    want = []
    for i, t in expected(rows):
        n = len(model.encode_batch([t])[0]) // 4 + 1
        want += [(i, p, min(2048, n - p * 2048)) for p in range(-(-n // 2048))]
    assert sorted((r.doc_id, r.piece, r.length) for r in got) == sorted(want)
    stages = [name for name, _ in corpus_pipeline.STAGES]
    assert stages == ["language_id", "exact_dedup", "near_dedup", "packing"] and corpus_pipeline.ORACLE_SQL is None


def test_all_but_the_last_stage_keep_the_columns(spark):
    docs = spark.createDataFrame([(1, "a b", "en", "s", 3), (2, "a b", "en", "s", 3), (3, None, None, None, None), (None, "c d", "en", "s", 3)], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, "").columns == docs.columns
        assert stage(spark, docs.limit(0), "").count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), "").count() == 0
