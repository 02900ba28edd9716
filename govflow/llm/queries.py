"""The thin queries opN_<name> over the driver's tables, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, centroids, exact_dedup, fingerprint, html_extract, language_id, license_scan, lm_score, merkle, near_dedup, nearest, packing, token_counts
from .common import table


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.license_scan(table(spark, sf_dir, "documents"))
    base = F.filter("detections", lambda d: d["base"])
    labels = lambda of: F.array_join(F.array_sort(F.array_distinct(F.transform(of, lambda d: d["label"]))), ",")
    # Each detection is a piece of evidence of strength priority / 100; the score is the chance that one of them holds.
    doubt = F.aggregate(F.filter("detections", lambda d: d["resolved"]), F.lit(1.0), lambda x, d: x * (1 - d["priority"] / 100.0))
    return found.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(F.transform(base, lambda d: d["start_word"])).alias("first_word"),
        F.array_max(F.transform(base, lambda d: d["start_word"])).alias("last_word"),
        labels(base).alias("base_labels"),
        labels(F.col("detections")).alias("labels"),
        F.round(1 - doubt, 6).alias("score"),
    )


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    decoded = bpe.bpe_decode(bpe.bpe_encode(table(spark, sf_dir, "documents")))
    return decoded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), k=3, percent=85)


def op4_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_pages(table(spark, sf_dir, "pages"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op7_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edit_study(table(spark, sf_dir, "documents"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write every document's tokens to flat files without an index, then find the documents in them again."""
    files = token_counts.write_flat(table(spark, sf_dir, "documents"))
    return token_counts.document_counts(token_counts.read_flat(spark, files))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.lm_scores(table(spark, sf_dir, "documents"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.checked_proofs(table(spark, sf_dir, "documents"))


def op12_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.neighbours(table(spark, sf_dir, "embeddings"))


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_scan": op1_license_scan,
    "op2_bpe": op2_bpe,
    "op3_near_dedup": op3_near_dedup,
    "op4_html_extract": op4_html_extract,
    "op5_packing": op5_packing,
    "op6_language_id": op6_language_id,
    "op7_fingerprint": op7_fingerprint,
    "op8_token_counts": op8_token_counts,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_lm_score": op10_lm_score,
    "op11_merkle": op11_merkle,
    "op12_nearest": op12_nearest,
    "op13_centroids": op13_centroids,
}

def manifest_sql(levels: int = 20, group_levels: int = 8) -> str:
    """The tree a level at a time, for groups of at most 2 ** levels documents and 2 ** group_levels groups."""
    # crc32 a bit at a time.
    crc = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda ch: unicode(ch)::BIGINT)), lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"
    field = lambda x: f"coalesce(strlen({x}::VARCHAR) || ':' || {x}::VARCHAR, '-')"
    leaf = lambda n: "sha256(" + " || ".join(field(x) for x in ("doc_id", "source", "lang", n, "text")) + ")"
    steps = [
        f"""doc AS MATERIALIZED (SELECT row_number() OVER () AS k, doc_id, lang, {leaf("n_chars")} AS leaf,
            CASE WHEN {crc} % 7 = 0 THEN {leaf("(n_chars::HUGEINT + 1)")} ELSE {leaf("n_chars")} END AS claim FROM documents)""",
        "p0 AS MATERIALIZED (SELECT k, doc_id, leaf, claim AS h, '' AS proof, coalesce('v' || lang, 'n') AS g, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS r FROM doc)",
        "n0 AS MATERIALIZED (SELECT g, r, leaf AS h, count(*) OVER (PARTITION BY g) AS n FROM p0)",
    ]

    def raised(i: int) -> None:
        """Level i + 1 of the nodes, and of the path of each document; a group of one node is left as it is."""
        steps.append(f"p{i + 1} AS MATERIALIZED (SELECT p.* REPLACE (CASE WHEN m.n = 1 THEN p.h WHEN p.r % 2 = 0 THEN sha256(p.h || coalesce(s.h, '')) ELSE sha256(s.h || p.h) END AS h, p.proof || coalesce(s.h, '') AS proof, p.r // 2 AS r) FROM p{i} p JOIN n{i} m ON m.g = p.g AND m.r = p.r LEFT JOIN n{i} s ON s.g = p.g AND s.r = xor(p.r, 1))")
        steps.append(f"n{i + 1} AS MATERIALIZED (SELECT g, r, h, count(*) OVER (PARTITION BY g) AS n FROM (SELECT g, r // 2 AS r, CASE WHEN any_value(n) = 1 THEN any_value(h) ELSE sha256(string_agg(h, '' ORDER BY r)) END AS h FROM n{i} GROUP BY g, r // 2))")

    for i in range(levels):
        raised(i)
    steps.append(f"subroots AS MATERIALIZED (SELECT g, h AS subroot, row_number() OVER (ORDER BY encode(g)) - 1 AS r FROM n{levels})")
    steps.append(f"p{levels + 1} AS MATERIALIZED (SELECT p.k, p.doc_id, p.leaf, p.h, p.proof, '' AS g, s.r, s.subroot FROM p{levels} p JOIN subroots s USING (g))")
    steps.append(f"n{levels + 1} AS MATERIALIZED (SELECT '' AS g, r, subroot AS h, count(*) OVER () AS n FROM subroots)")
    for i in range(levels + 1, levels + 1 + group_levels):
        raised(i)
    last = levels + 1 + group_levels
    return f"""WITH {", ".join(steps)}
        SELECT doc_id, leaf, subroot, n.h AS root, sha256(proof) AS proof_sha256, p.h AS folded_root, p.h = n.h AS verified FROM p{last} p, n{last} n"""


def clustering_sql(k: int = 8, rounds: int = 10) -> str:
    """Plain k-means: every vector against every centroid in each round."""
    steps = [
        """kept AS MATERIALIZED (
            SELECT row_number() OVER () AS r, vec_id, embedding::DOUBLE[] AS x, list_transform(embedding::DOUBLE[], lambda e: floor(1024 * e)::BIGINT) AS v
            FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = 64)""",
        f"""c0 AS MATERIALIZED (
            SELECT (row_number() OVER (ORDER BY sha256('3:' || vec_id), x) - 1)::INTEGER AS c, v AS w FROM kept
            QUALIFY row_number() OVER (ORDER BY sha256('3:' || vec_id), x) <= {k})""",
    ]
    for i in range(rounds + 1):
        steps.append(f"""a{i} AS MATERIALIZED (
            SELECT r, min((d, c)) AS best FROM (
                SELECT r, c, list_sum(list_transform(list_zip(v, w), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM kept, c{i}) GROUP BY r)""")
        if i < rounds:
            steps.append(f"""c{i + 1} AS MATERIALIZED (
                SELECT c, coalesce(w2, w) AS w FROM c{i} LEFT JOIN (
                    SELECT c, list(m ORDER BY pos) AS w2 FROM (
                        SELECT best[2] AS c, pos, (sum(e) - ((sum(e) % count(*)) + count(*)) % count(*))::BIGINT // count(*) AS m
                        FROM (SELECT best, unnest(v) AS e, unnest(range(64)) AS pos FROM kept JOIN a{i} USING (r)) GROUP BY 1, 2) GROUP BY c) USING (c))""")
    return f"""WITH {", ".join(steps)}
        SELECT vec_id, best[2]::INTEGER AS "cluster", best[1]::BIGINT AS distance, (sum(best[1]) OVER (PARTITION BY best[2]))::BIGINT AS cluster_inertia,
               (sum(best[1]) OVER ())::BIGINT AS inertia, sha256(array_to_string(w, ',')) AS centroid_sha256
        FROM kept JOIN a{rounds} USING (r) JOIN c{rounds} ON c = best[2]"""


ORACLE_SQL: dict[str, str] = {
    "op9_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))""",
    "op11_merkle": manifest_sql(),
    "op13_centroids": clustering_sql(),
}
