"""One query for each operator, over whole tables, and SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def tokenizer(name: str) -> str:
    """The place of a public tokenizer's file on this machine; its path is a parameter of every operator."""
    import public_tokenizers

    return public_tokenizers.path(name)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quayside.llm.exact_dedup import exact_dedup

    return exact_dedup(documents(spark, sf_dir)).drop("_row")


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quayside.llm.token_files import round_trip

    out = round_trip(spark, documents(spark, sf_dir), tokenizer("byte_bpe_50k.json"), end_id=2)
    return out.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quayside.llm.packing import pack_sequences

    out = pack_sequences(documents(spark, sf_dir), tokenizer("byte_bpe_50k.json"), capacity=2048, end_id=1)
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quayside.llm.token_counts import count_tokens

    return count_tokens(documents(spark, sf_dir), tokenizer("piece_bpe_32k.model"), limit=4096)


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quayside.llm.near_dedup import near_dedup

    return near_dedup(documents(spark, sf_dir), threshold=0.8, shingle=5).drop("_row")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quayside.llm import labelled, toxicity

    docs = documents(spark, sf_dir)
    lexicon = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), labelled.crc_remainder("id", 5) != 0)
    return toxicity.score_toxicity(docs, lexicon).select(
        "doc_id", (labelled.crc_remainder("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_hits", "n_words"
    )


def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quayside.llm.ann import nearest

    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("id") % 100 == 0, k=10)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quayside.llm import labelled, quality

    docs = documents(spark, sf_dir)
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), labelled.crc_remainder("id", 3) != 1)
    return quality.score_quality(docs, model).select("doc_id", (labelled.crc_remainder("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quayside.llm.sentencepiece_codec import round_trip_pieces

    out = round_trip_pieces(documents(spark, sf_dir), tokenizer("piece_bpe_32k.model"))
    return out.select("doc_id", "n_tokens", F.crc32("ids").alias("ids_crc32"), "n_repaired", (F.col("decoded") == F.col("text")).alias("round_trip"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quayside.llm.licenses import scan_licenses

    return scan_licenses(documents(spark, sf_dir))


def op11_repeat_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quayside.llm.repeats import remove_repeats

    out = remove_repeats(documents(spark, sf_dir), width=50)
    removed = F.col("n_bytes") - F.octet_length("kept")
    return out.select("doc_id", "n_bytes", removed.cast("long").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quayside.llm.alignment import align

    return align(documents(spark, sf_dir), tokenizer("byte_bpe_50k.json"), tokenizer("piece_bpe_32k.model"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quayside.llm.spelling import spelling_variants

    return spelling_variants(documents(spark, sf_dir), min_length=6, min_count=5, ratio=5)


QUERIES = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_token_files": op2_token_files,
    "op3_sentencepiece": op3_sentencepiece,
    "op4_packing": op4_packing,
    "op5_token_counts": op5_token_counts,
    "op6_minhash_near_dedup": op6_minhash_near_dedup,
    "op7_license_scan": op7_license_scan,
    "op8_toxicity": op8_toxicity,
    "op9_nearest_neighbours": op9_nearest_neighbours,
    "op10_quality": op10_quality,
    "op11_repeat_removal": op11_repeat_removal,
    "op12_alignment": op12_alignment,
    "op13_spelling_variants": op13_spelling_variants,
}

ORACLE_SQL = {
    "op1_exact_dedup": """
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, t, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size
      FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents))
""",
    "op11_repeat_removal": """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
     w AS (SELECT r, doc_id, p, substr(h, 2 * p + 1, 100) AS s FROM (SELECT r, doc_id, h, unnest(range(len(h) // 2 - 49)) AS p FROM d)),
     gone AS (SELECT r, p, p - coalesce(lag(p) OVER (PARTITION BY r ORDER BY p), -51) > 50 AS fresh
              FROM (SELECT r, p, doc_id, min(doc_id) OVER (PARTITION BY s) AS least FROM w) WHERE least < doc_id),
     runs AS (SELECT r, min(p) AS a, max(p) + 50 AS z FROM (SELECT r, p, sum(fresh::INT) OVER (PARTITION BY r ORDER BY p) AS k FROM gone) GROUP BY r, k),
     ends AS (SELECT r, a, z, lead(a) OVER (PARTITION BY r ORDER BY a) AS following FROM runs),
     cuts AS (SELECT r, count(*) AS n_spans, sum(z - a) AS n_removed, min(a) AS head,
                     string_agg(substr(h, 2 * z + 1, 2 * (coalesce(following, len(h) // 2) - z)), '' ORDER BY a) AS tail
              FROM ends JOIN d USING (r) GROUP BY r)
SELECT doc_id, len(h) // 2 AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(CASE WHEN head IS NULL THEN h ELSE substr(h, 1, 2 * head) || tail END)) AS kept_sha256
FROM d LEFT JOIN cuts USING (r)
""",
}
