"""The registered queries of this subpackage and their DuckDB counterparts.

Each query applies one operator, with production parameters, to the whole
table.  Queries without SQL are tested against brute force in ``tests/llm``.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.llm import bpe, chat, clustering, ctph, exact_dedup, line_dedup, near_dedup, packing, suffix_dedup, token_store, toxicity, url_filter, whitening
from attesta.llm.common import shared_dir

#: Folder of the vocabulary files.
TOKENIZERS = os.environ.get("ATTESTA_TOKENIZERS", "/opt/tokenizers")


def vocabulary(name: str) -> str:
    return os.path.join(TOKENIZERS, name)


def pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(documents(spark, sf_dir), digest_all=True)


OP1_SQL = """
WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS n_chars, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') AS norm FROM documents),
h AS (SELECT doc_id, n_chars, sha256(norm) AS text_sha256 FROM t)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept,
       text_sha256
FROM h WINDOW w AS (PARTITION BY text_sha256 ORDER BY n_chars DESC, doc_id)
"""


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = vocabulary("byte_bpe_50k.tiktoken")
    return bpe.decode(bpe.encode(documents(spark, sf_dir), path, pattern()), path).select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_dedup(documents(spark, sf_dir), width=3, share=(85, 100))


#: Tokens of a packed sequence.
SEQUENCE = 2048


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = packing.pieces(documents(spark, sf_dir), vocabulary("word_bpe_49k.json"), SEQUENCE)
    return packing.pack(parts, SEQUENCE).withColumnRenamed("id", "doc_id")


def op9_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/tokens"
    token_store.write(documents(spark, sf_dir), path, vocabulary("byte_bpe_50k.json"))
    return token_store.read(spark, path).select(F.col("key").alias("doc_id"), "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))



def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    same = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", same), (-1, 1, "assistant", same)], "conv_id bigint, turn bigint, role string, text string")
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return chat.digests(chat.format_chats(turns.unionByName(more)))


def learnable(labels: DataFrame) -> DataFrame:
    """Labels of which a model may learn: crc32 of the id as text is not divisible by 5."""
    return labels.select("doc_id", F.col("toxic").alias("label")).filter(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = toxicity.fit(docs, learnable(spark.read.parquet(f"{sf_dir}/labels.parquet")))
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    return toxicity.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("offending").alias("n_offending"))


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctph.with_edits(documents(spark, sf_dir))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.suffix_dedup(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", F.coalesce(F.size("spans"), F.lit(0)).cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.line_dedup(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.length("text").cast("bigint").alias("n_chars"), F.sha2("text", 256).alias("kept_sha256"))


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return out.withColumn("deviation", F.col("deviation").cast("bigint")).withColumnRenamed("id", "vec_id")


#: Fixed rules of the contract: (verdict, host and path).
URL_RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


def op12_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return url_filter.judge(pages, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = clustering.cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    totals = {c: F.col(c).cast("bigint") for c in ("cluster_inertia", "inertia")}
    return out.withColumns(totals).withColumnRenamed("id", "vec_id")


def _lloyd_sql(rounds: int = 10, k: int = 8, dims: int = 64) -> str:
    """The rounds written out one after the other, every vector against every centroid."""
    parts = [
        f"""v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS x FROM embeddings
    WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dims})""",
        "x AS MATERIALIZED (SELECT vec_id, unnest(x) AS x, generate_subscripts(x, 1) AS d FROM v)",
        f"s AS MATERIALIZED (SELECT vec_id, row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS c FROM v QUALIFY c < {k})",
        "c0 AS MATERIALIZED (SELECT c, d, x FROM s JOIN x USING (vec_id))",
    ]
    for r in range(rounds + 1):
        parts.append(f"""a{r} AS MATERIALIZED (SELECT vec_id, arg_min(c, q * {k} + c) AS c, min(q) AS q
    FROM (SELECT x.vec_id, c.c, sum((x.x - c.x) * (x.x - c.x))::BIGINT AS q FROM x JOIN c{r} c USING (d) GROUP BY 1, 2) GROUP BY 1)""")
        if r < rounds:
            parts.append(f"""c{r + 1} AS MATERIALIZED (SELECT o.c, o.d, coalesce(floor_div, o.x) AS x FROM c{r} o
    LEFT JOIN (SELECT c, d, ((s - (s % n + n) % n) // n)::BIGINT AS floor_div FROM (SELECT c, d, sum(x)::BIGINT AS s, count(*) AS n FROM a{r} JOIN x USING (vec_id) GROUP BY 1, 2)) USING (c, d))""")
    return f"""WITH {", ".join(parts)},
h AS (SELECT c, sha256(string_agg(x::VARCHAR, ',' ORDER BY d)) AS centroid_sha256 FROM c{rounds} GROUP BY 1)
SELECT vec_id, c::INTEGER AS cluster, q AS distance, (sum(q) OVER (PARTITION BY c))::BIGINT AS cluster_inertia, (sum(q) OVER ())::BIGINT AS inertia, centroid_sha256
FROM a{rounds} JOIN h USING (c)"""


QUERIES = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_bpe": op2_bpe,
    "op3_chat_format": op3_chat_format,
    "op4_minhash_near_dedup": op4_minhash_near_dedup,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_toxicity": op6_toxicity,
    "op7_fingerprints": op7_fingerprints,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_token_store": op9_token_store,
    "op10_line_dedup": op10_line_dedup,
    "op11_embedding_whitening": op11_embedding_whitening,
    "op12_url_filters": op12_url_filters,
    "op13_centroid_clustering": op13_centroid_clustering,
}
ORACLES = {"op1_exact_dedup": OP1_SQL, "op13_centroid_clustering": _lloyd_sql()}
