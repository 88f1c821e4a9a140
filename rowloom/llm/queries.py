"""The registered queries of the operators in this folder, and their SQL where SQL can say them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowloom.llm import conversation_repair, embedding_dedup, hard_negatives, html_extract, language_id, line_dedup, mixing, packing, simhash_dedup, substring_dedup, syncmers, token_counts, toxicity
from rowloom.llm.common import held_out, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_simhash_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return simhash_dedup.near_duplicates(table(spark, folder, "documents"), shingle=3, budget=2)


@query
def op2_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = language_id.learn(docs.where(~held_out(F.col("doc_id"))))
    found = language_id.predict(docs, model)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


@query
def op3_document_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return syncmers.document_fingerprints(table(spark, folder, "documents"))


@query
def op4_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    counts = token_counts.count_tokens(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return counts.withColumn("over_limit", F.col("n_tokens") > 1024)


@query
def op5_source_mixing(spark: SparkSession, folder: str) -> DataFrame:
    found = mixing.mixture(table(spark, folder, "documents"))
    return found.select("row.doc_id", "source", "lang", "topic", "tokens", F.round("probability", 6).alias("probability"), "kept")


ORACLES["op5_source_mixing"] = mixing.mixture_sql()


@query
def op6_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = line_dedup.drop_repeated_lines(table(spark, folder, "documents"))
    return found.select("doc_id", "text", "n_lines", "n_removed")


@query
def op7_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query
def op8_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = toxicity.learn(docs, table(spark, folder, "labels"))
    found = toxicity.score(docs, model)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


@query
def op9_embedding_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return embedding_dedup.near_vectors(table(spark, folder, "embeddings"), threshold=0.98)


@query
def op10_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    return html_extract.main_texts(table(spark, folder, "pages"))


@query
def op11_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    """Damage the conversations by a checksum of (conversation, turn), then repair them."""
    rows = table(spark, folder, "conversations")
    said = [F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")]
    place = F.concat(*[F.coalesce(F.col(c).cast("string"), F.lit(" ")) if c else F.lit(":") for c in ("conv_id", "", "turn")])
    rows = rows.select("conv_id", "turn", *said, (F.crc32(place.cast("binary")) % 20).alias("damage"))
    text = F.when(F.col("damage") == 1, "").when(F.col("damage") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    damaged = rows.where("damage <> 0").withColumn("text", text).withColumn("role", F.when(F.col("damage") == 4, "user").otherwise(F.col("role")))
    damaged = damaged.withColumn("copy", F.explode(F.when(F.col("damage") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    found = conversation_repair.repair_conversations(damaged.select("conv_id", "turn", "role", "text")).alias("f")
    ids = rows.select("conv_id").distinct().alias("i")
    joined = ids.join(found, F.col("i.conv_id").eqNullSafe(F.col("f.conv_id")), "left")
    zeros = [F.coalesce(F.col(f"f.{c}"), F.lit(0)).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return joined.select(
        "i.conv_id", *zeros, F.coalesce("f.audit", F.lit("")).alias("audit"),
        F.coalesce("f.repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"),
    )


@query
def op12_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = substring_dedup.drop_repeats(table(spark, folder, "documents"), size=35)
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256")


ORACLES["op12_substring_dedup"] = r"""
WITH d AS (
    SELECT row_number() OVER () AS row, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words
    FROM documents
), windows AS (
    SELECT row, start, array_to_string(words[start:start + 34], ' ') AS said
    FROM (SELECT row, words, unnest(generate_series(1, len(words) - 34)) AS start FROM d WHERE len(words) >= 35)
), repeated AS (
    SELECT row, start FROM windows QUALIFY count(*) OVER (PARTITION BY said) > 1
), gone AS (
    SELECT row, list(DISTINCT start + step) AS places FROM repeated, (SELECT unnest(generate_series(0, 34)) AS step) GROUP BY row
), kept AS (
    SELECT doc_id, len(words) AS n_words, coalesce(len(places), 0) AS n_removed,
        CASE WHEN places IS NULL THEN words ELSE list_transform(list_filter(list_zip(words, generate_series(1, len(words))),
            lambda x: NOT list_contains(places, x[2])), lambda x: x[1]) END AS words
    FROM d LEFT JOIN gone USING (row)
)
SELECT doc_id, n_words::BIGINT AS n_words, n_removed::BIGINT AS n_removed, sha256(array_to_string(words, ' ')) AS kept_sha256 FROM kept
"""


@query
def op13_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(rows.withColumn("label", label), "vec_id % 100 = 0")


ORACLES["op13_hard_negatives"] = """
WITH v AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
    FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) = len(list_filter(embedding, lambda x: isfinite(x)))
), scored AS (
    SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_inner_product(a.e, b.e)::BIGINT AS score
    FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0
), positives AS (
    SELECT anchor_id, id AS positive_id, score AS positive_score FROM scored WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
), ranked AS (
    SELECT anchor_id, positive_id, positive_score, id AS negative_id, score AS negative_score,
        row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id)::INTEGER AS rank
    FROM positives JOIN scored USING (anchor_id)
    WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM ranked WHERE rank <= 5
"""
