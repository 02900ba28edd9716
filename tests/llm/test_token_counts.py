import random

import numpy as np
import pytest

from govflow.llm import packing, token_counts
from govflow.llm.packing import public_tokenizers


def plain(streams, end):
    out = []
    for name, shards in streams.items():
        ids = [x for _, shard in sorted(shards.items()) for x in shard]
        start = ordinal = 0
        for i, x in enumerate(ids):
            if x == end:
                out.append((name, ordinal, start, i - start, True))
                ordinal, start = ordinal + 1, i + 1
        if start < len(ids):
            out.append((name, ordinal, start, len(ids) - start, False))
    return sorted(out)


@pytest.mark.parametrize("block", [1, 3, 7, 64])
def test_blocks_and_shards_are_stitched(spark, block):
    rng = random.Random(block)
    streams = {}
    for s in range(5):
        streams[f"s{s}"] = {f"{k:03d}": [rng.choice([1, 2, 3, 4, 9]) if s else rng.choice([1, 2]) for _ in range(rng.choice([1, 5, 30]))] for k in range(rng.choice([1, 4]))}
    streams["only-ends"] = {"0": [9, 9, 9]}
    rows = [(s, k, np.array(ids, ">u2").tobytes()) for s, shards in streams.items() for k, ids in shards.items()]
    files = spark.createDataFrame(rows, "stream string, shard string, content binary").repartition(4)
    found = token_counts.documents(token_counts.scan_blocks(files, end_id=9, head=2, block=block)).collect()
    assert sorted((r.stream, r.ordinal, r.start, r.n_tokens, r.ended) for r in found) == plain(streams, 9)
    for r in found:
        ids = [x for _, shard in sorted(streams[r.stream].items()) for x in shard]
        assert r.head == ids[r.start : r.start + len(r.head)]
        assert len(r.head) == 2 or r.n_tokens < 2 or len(streams[r.stream]) > 1 or len(r.head) == len(ids[r.start :])


@pytest.mark.parametrize("run_bytes", [1, 500, 1 << 22])
def test_written_documents_come_back(spark, tmp_path, monkeypatch, run_bytes):
    monkeypatch.setattr(token_counts, "RUN_BYTES", run_bytes)
    rows = [(i, ["some words", "", None, "x " * 3000, "Đ é 中文", "END"][i % 6]) for i in range(60)]
    rows += [(None, "null id"), (-5, "negative"), (2**63 - 1, "largest"), (-(2**63), "smallest"), (7, "again"), (7, "again")]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, value int").repartition(3)
    path = token_counts.write_flat(docs, path=f"{tmp_path}/flat")
    got = token_counts.document_counts(token_counts.read_flat(spark, path)).collect()
    model = packing.load(public_tokenizers.path(packing.TOKENIZER))
    want = [(i, len(model.encode_batch([t or ""])[0]) // 4) for i, t in rows]
    assert sorted(((r.doc_id, r.n_tokens) for r in got), key=repr) == sorted(want, key=repr)


def test_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string")
    path = token_counts.write_flat(docs, path=f"{tmp_path}/flat")
    assert token_counts.document_counts(token_counts.read_flat(spark, path)).collect() == []
