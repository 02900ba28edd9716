"""Retrieval queries over the driver's tables, and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from govflow.operators import bm25, cells, retrieval

QUERIES, ORACLE = {}, {}


def query(sql: str = ""):
    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def asked(t):
    """The stated query set: every item whose id is divisible by 20, with its whole text."""
    return t("benchmark").where("item_id % 20 = 0").select(F.col("item_id").cast("long").alias("query_id"), "text")


def texts(t):
    """Whole documents as chunks."""
    return t("documents").select(F.col("doc_id").cast("string").alias("chunk_key"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))


KEYWORD = r"""
    asked AS (SELECT item_id::BIGINT AS query_id, lower(regexp_replace(text, '^\s+|\s+$', '', 'g')) AS raw FROM benchmark WHERE item_id % 20 = 0),
    terms AS (SELECT DISTINCT query_id, unnest(regexp_extract_all(raw, '[a-z0-9][a-z0-9\-.]*')) AS term FROM asked),
    docs AS (SELECT doc_id, lower(coalesce(text, '')) AS low FROM documents),
    counts AS (SELECT doc_id, term, (length(low) - length(replace(low, term, ''))) // length(term) AS n FROM docs, (SELECT DISTINCT term FROM terms)),
    df AS (SELECT term, count(*) FILTER (n > 0) AS df FROM counts GROUP BY 1),
    part AS (SELECT query_id, doc_id, sum(ln(1 + (SELECT count(*) FROM docs) / (1 + df)) * (1 + least(n, 5) * 0.25)) AS s FROM terms JOIN counts USING (term) JOIN df USING (term) WHERE n > 0 GROUP BY 1, 2),
    kw AS (SELECT a.query_id, d.doc_id::VARCHAR AS chunk_key, round(coalesce(s, 0) + CASE WHEN contains(low, raw) THEN 12 ELSE 0 END, 9) AS kw_score FROM asked a CROSS JOIN docs d LEFT JOIN part p ON p.query_id = a.query_id AND p.doc_id = d.doc_id)"""


@query(f"WITH {KEYWORD} SELECT query_id, chunk_key, round(kw_score, 4) AS kw_score FROM kw WHERE kw_score > 0")
def keyword_scores(t):
    scores = retrieval.keyword_scores(texts(t), asked(t))
    return scores.withColumn("kw_score", F.round("kw_score", 4))


BM25 = r"""
    words AS (SELECT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[一-鿿]|[^\x00-\x2F\x3A-\x60\x7B-\x7F一-鿿]+')) AS term FROM documents),
    tf AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY 1, 2),
    len AS (SELECT d.doc_id, coalesce(n, 0) AS n FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS n FROM words GROUP BY 1) USING (doc_id)),
    df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
    asked AS (SELECT query_id, term, count(*) AS times FROM (SELECT item_id::BIGINT AS query_id, unnest(regexp_extract_all(lower(text), '[一-鿿]|[^\x00-\x2F\x3A-\x60\x7B-\x7F一-鿿]+')) AS term FROM benchmark WHERE item_id % 20 = 0) GROUP BY 1, 2),
    score AS (SELECT query_id, doc_id, round(sum(times * ln(1 + ((SELECT count(*) FROM documents) - df + 0.5) / (df + 0.5)) * tf / (tf + 1.2 * (0.25 + 0.75 * n / (SELECT avg(n) FROM len)))), 9) AS score FROM asked JOIN tf USING (term) JOIN df USING (term) JOIN len USING (doc_id) GROUP BY 1, 2)"""


@query(f"WITH {BM25} SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id::VARCHAR) AS rank, doc_id::VARCHAR AS chunk_key, round(score, 6) AS score FROM score QUALIFY rank <= 10")
def bm25_topk(t):
    return bm25.search(bm25.build(texts(t)), asked(t), 10).withColumn("score", F.round("score", 6))


@query(f"WITH {BM25} SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id::VARCHAR) AS rank, doc_id::VARCHAR AS chunk_key, round(score, 6) AS score FROM score JOIN documents USING (doc_id) WHERE lang IN ('de', 'fr') QUALIFY rank <= 10")
def bm25_in_scope(t):
    """Only documents of two languages are found; the scores are those of the whole index."""
    rows = t("documents").select(F.col("doc_id").cast("string").alias("chunk_key"), F.struct("doc_id", "lang").alias("doc_id"), "text")
    return bm25.search(bm25.build(rows), asked(t), 10, F.col("doc_id.lang").isin("de", "fr")).withColumn("score", F.round("score", 6))


VECTOR = """
    vec AS (SELECT q.vec_id AS query_id, e.vec_id::VARCHAR AS chunk_key, round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 12) AS vec_score FROM embeddings e, (SELECT * FROM embeddings WHERE vec_id % 20 = 0) q),
    top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY vec_score DESC, chunk_key) AS rank FROM vec) WHERE rank <= 10)"""


def vectors(t):
    return t("embeddings").select(F.col("vec_id").cast("string").alias("chunk_key"), F.col("embedding").alias("vector"), "label")


def vector_queries(t):
    return t("embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))


@query(f"WITH {VECTOR} SELECT query_id, chunk_key, rank, round(vec_score, 4) AS vec_score FROM top")
def vector_topk(t):
    best = retrieval.vector_top_k(vectors(t), vector_queries(t), 10)
    return best.select("query_id", "chunk_key", F.col("rank").cast("long").alias("rank"), F.round("vec_score", 4).alias("vec_score"))


@query(
    """WITH live AS (SELECT vec_id, embedding FROM embeddings WHERE label IN (1, 3, 4)),
    vec AS (SELECT q.vec_id AS query_id, e.vec_id::VARCHAR AS chunk_key, round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 12) AS s FROM live e, (SELECT * FROM embeddings WHERE vec_id % 20 = 0) q)
    SELECT query_id, chunk_key, rank, round(s, 4) AS vec_score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, chunk_key) AS rank FROM vec) WHERE rank <= 5"""
)
def scope_filtered_search(t):
    """Only vectors whose metadata is in scope are scored; the filter comes before the scores."""
    rows = vectors(t).withColumn("doc_id", F.col("chunk_key"))
    meta = rows.select("doc_id", F.col("label").alias("project_id"))
    live = retrieval.in_scope(rows, meta, {"project_id": {1, 3, 4}})
    best = retrieval.vector_top_k(live, vector_queries(t), 5)
    return best.select("query_id", "chunk_key", F.col("rank").cast("long").alias("rank"), F.round("vec_score", 4).alias("vec_score"))


@query()
def cell_search(t):
    """Approximate: labels in scope, queries by id, cells as fitted."""
    found = cells.search(cells.build(vectors(t)), vector_queries(t), 10, F.col("label").isin(1, 3, 4))
    return found.select("query_id", F.col("rank").cast("long").alias("rank"), "chunk_key", F.round("vec_score", 4).alias("vec_score"))


@query(f"WITH {VECTOR} SELECT count(DISTINCT query_id) AS queries, count(*) AS neighbours, true AS reached FROM top")
def cell_recall(t):
    """Whether nine of ten neighbours of the queries, found exactly over all rows, are found through the cells."""
    exact = retrieval.vector_top_k(vectors(t), vector_queries(t), 10)
    found = cells.search(cells.build(vectors(t)), vector_queries(t), 10).select("query_id", "chunk_key", F.lit(1).alias("hit"))
    both = exact.join(found, ["query_id", "chunk_key"], "left")
    return both.agg(F.countDistinct("query_id").alias("queries"), F.count(F.lit(1)).alias("neighbours"), (F.count("hit") >= 0.9 * F.count(F.lit(1))).alias("reached"))


FUSED = f"""{KEYWORD}, near AS (SELECT q.vec_id AS query_id, e.vec_id::VARCHAR AS chunk_key, round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 12) AS vec_score FROM embeddings e, embeddings q WHERE q.vec_id IN (SELECT query_id FROM asked)),
    v AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY vec_score DESC, chunk_key) AS r FROM near),
    k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY kw_score DESC, chunk_key) AS r FROM kw WHERE kw_score > 0),
    cand AS (SELECT query_id, chunk_key, min(pos) AS position FROM (SELECT query_id, chunk_key, r AS pos FROM v WHERE r <= 50 UNION ALL SELECT query_id, chunk_key, r + 50 FROM k WHERE r <= 25) GROUP BY 1, 2),
    fused AS (SELECT c.query_id, c.chunk_key, position, coalesce(near.vec_score, 0) AS vec_score, coalesce(kw.kw_score, 0) AS kw_score FROM cand c LEFT JOIN near USING (query_id, chunk_key) LEFT JOIN kw USING (query_id, chunk_key))"""


def hybrid(t):
    """Documents by their words and by the vectors of the same ids; a query's vector is that of its own id."""
    asked_vectors = t("embeddings").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector")).join(asked(t).select("query_id"), "query_id", "left_semi")
    return retrieval.hybrid(texts(t), vectors(t), asked(t), asked_vectors)


@query(f"WITH {FUSED} SELECT query_id, chunk_key, position, round(vec_score, 4) AS vec_score, round(kw_score, 4) AS kw_score FROM fused")
def fused_candidates(t):
    return hybrid(t).withColumns({"vec_score": F.round("vec_score", 4), "kw_score": F.round("kw_score", 4)})


@query(f"WITH {FUSED} SELECT query_id, rank, chunk_key, floor(vec_score * 10000 + 0.5) / 10000 AS score, floor(kw_score * 100 + 0.5) / 100 AS kw_score, false AS reranked FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(vec_score * 2 + kw_score, 9) DESC, position) AS rank FROM fused) WHERE rank <= 5")
def fallback_rank(t):
    return retrieval.ranked(hybrid(t))


@query(
    """WITH hits AS (SELECT conv_id, turn AS position, (conv_id + turn) % 3 AS doc_id, turn % 2 + 1 AS page_no, (turn * 7) % 5 AS score, text AS snippet FROM conversations),
    pages AS (SELECT conv_id, doc_id, page_no, min(position) AS first, arg_max(snippet, score * 1000 - position) AS snippet FROM hits GROUP BY 1, 2, 3)
    SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY first) AS number, doc_id, page_no, CASE WHEN length(s) > 200 THEN left(s, 199) || '…' ELSE s END AS snippet
    FROM (SELECT *, trim(regexp_replace(snippet, '\\s+', ' ', 'g')) AS s FROM pages)"""
)
def citations(t):
    turn = F.col("turn")
    hits = t("conversations").select("conv_id", turn.alias("position"), ((F.col("conv_id") + turn) % 3).alias("doc_id"), (turn % 2 + 1).alias("page_no"), ((turn * 7) % 5).alias("score"), F.col("text").alias("snippet"))
    return retrieval.citations(hits)


JUDGED = """cases AS (SELECT item_id AS case_id, CASE WHEN item_id % 5 = 0 THEN [] ELSE [1, 2, 3] END AS pages FROM benchmark),
    hits AS (SELECT item_id AS case_id, r AS rank, (item_id + r) % 2 AS doc_id, (item_id * r) % 6 AS page_no FROM benchmark, (SELECT unnest(range(1, 6)) AS r)),
    found AS (SELECT c.case_id, len(pages) AS wanted, count(DISTINCT page_no) FILTER (doc_id = 1 AND list_contains(pages, page_no)) AS n, min(rank) FILTER (doc_id = 1 AND list_contains(pages, page_no)) AS first FROM cases c LEFT JOIN hits h ON h.case_id = c.case_id GROUP BY ALL),
    judged AS (SELECT case_id, CASE WHEN wanted > 0 THEN floor(n / wanted * 10000 + 0.5) / 10000 END AS recall, CASE WHEN wanted > 0 THEN floor(coalesce(1 / first, 0) * 10000 + 0.5) / 10000 END AS rr, CASE WHEN wanted = 0 THEN 'SKIPPED_UNLABELED' WHEN n > 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM found)"""


def made_up_cases(t):
    k = F.col("item_id")
    none = F.array().cast("array<bigint>")
    cases = t("benchmark").select(k.alias("case_id"), F.lit(1).cast("long").alias("doc_id"), F.when(k % 5 == 0, none).otherwise(F.lit([1, 2, 3]).cast("array<bigint>")).alias("pages"), F.lit(None).cast("array<string>").alias("keys"))
    rows = t("benchmark").select(k.alias("case_id"), F.explode(F.lit([1, 2, 3, 4, 5])).alias("rank"))
    hits = rows.select("case_id", "rank", ((F.col("case_id") + F.col("rank")) % 2).alias("doc_id"), (F.col("case_id") * F.col("rank") % 6).alias("page_no"), F.lit("").alias("chunk_key"))
    return retrieval.judged(cases, hits)


@query(f"WITH {JUDGED} SELECT * FROM judged")
def retrieval_eval(t):
    return made_up_cases(t)


@query(f"WITH {JUDGED} SELECT count(*) AS cases, floor(sum(round(recall * 10000)::BIGINT) / count(*) + 0.5) / 10000 AS recall, floor(sum(round(rr * 10000)::BIGINT) / count(*) + 0.5) / 10000 AS mrr, floor(count(*) FILTER (status = 'PASS') / count(*) * 10000 + 0.5) / 10000 AS hit_rate FROM judged WHERE status <> 'SKIPPED_UNLABELED'")
def retrieval_overall(t):
    return retrieval.overall(made_up_cases(t))


@query(f"""WITH {VECTOR}, other AS (SELECT query_id, chunk_key, row_number() OVER (PARTITION BY query_id ORDER BY rank % 3, rank) AS rank FROM top)
    SELECT query_id, (SELECT count(*) FROM top a JOIN other b ON a.chunk_key = b.chunk_key AND a.query_id = b.query_id WHERE a.query_id = q.query_id AND a.rank <= 5 AND b.rank <= 5) / 5 AS overlap,
        (SELECT chunk_key FROM top a WHERE a.query_id = q.query_id AND rank = 1) = (SELECT chunk_key FROM other b WHERE b.query_id = q.query_id AND rank = 1) AS top1 FROM (SELECT DISTINCT query_id FROM top) q""")
def topk_overlap(t):
    """A ranking against a permutation of itself."""
    best = retrieval.vector_top_k(vectors(t), vector_queries(t), 10)
    other = best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("rank") % 3, "rank")))
    return retrieval.agreement(best, other, 5)
