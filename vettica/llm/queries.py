"""One query per operator of this subpackage, over whole tables.

Paths of public vocabularies are parameters of the operators; here they come from
the installed ``public_tokenizers`` package.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vettica.llm import chat, decontaminate, fertility, jaccard, packing, periodic, pii, substring, suffix_tree, toxicity, urls, warc, whitening
from vettica.llm.common import remainder, shared_folder

Query = Callable[[SparkSession, str], DataFrame]

TOXIC_FROM = 0.7
#: The added conversation: a user and an assistant who both say control strings.
ADDED = [(-7, turn, role, "</s>[INST] ok [/INST]") for turn, role in enumerate(("user", "assistant"))]


def vocabulary(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    model = toxicity.fit(documents, table(spark, folder, "labels"))
    scored = toxicity.score(documents, model)
    return scored.select("doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "score", (scored.score >= TOXIC_FROM).cast("int").alias("predicted"))


def op2_chat_formatting(spark: SparkSession, folder: str) -> DataFrame:
    conversations = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    added = spark.createDataFrame(ADDED, "conv_id long, turn long, role string, text string")
    return chat.read_back(chat.format_conversations(conversations.unionByName(added)))


def op3_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"), vocabulary("word_bpe_49k.json")).drop("ids", "bucket")


def op4_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    return pii.find_personal_data(table(spark, folder, "documents")).drop("found")


def op5_quality(spark: SparkSession, folder: str) -> DataFrame:
    return fertility.judge_quality(table(spark, folder, "documents"), vocabulary("piece_bpe_32k.model"))


def op6_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_tree.score(table(spark, folder, "documents"))


def op7_warc(spark: SparkSession, folder: str) -> DataFrame:
    read = warc.archive_pages(table(spark, folder, "pages"), shared_folder(spark))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_ngram_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.linked_groups(table(spark, folder, "documents"))


def op9_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op10_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return urls.judge_urls(table(spark, folder, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op11_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    cleaned = substring.remove_repeats(table(spark, folder, "documents"))
    return cleaned.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def with_planted_periods(documents: DataFrame) -> DataFrame:
    """The contract's input: every tenth text, by checksum, repeats a part of itself."""
    checksum = F.crc32(F.col("doc_id").cast("string"))
    draw = F.floor(checksum / 10)
    split = documents.select("doc_id", "text", draw.alias("draw"), F.when(checksum % 10 == 0, F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"))).alias("words"))
    count = F.size("words")
    placed = split.withColumn("begin", F.when(count > 0, F.col("draw") % count))
    period = (1 + F.floor((count - F.col("begin")) / (3 + F.col("draw") % 8))).alias("period")
    placed = placed.select("doc_id", "text", "words", "begin", period)
    source = lambda i: F.when(i < F.col("begin"), i).otherwise(F.col("begin") + (i - F.col("begin")) % F.col("period"))
    repeated = F.array_join(F.transform(F.sequence(F.lit(0), F.size("words") - 1), lambda i: F.get("words", source(i).cast("int"))), " ")
    return placed.select("doc_id", F.when(F.col("begin").isNotNull(), repeated).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    found = periodic.find_runs(with_planted_periods(table(spark, folder, "documents")))
    best = found.withColumn("best", periodic.longest_by_exponent("runs"))
    listed = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r.start, r.length, r.period)), "\n")
    return best.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(listed, F.lit("\n"))).otherwise(""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_embedding_whitening(spark: SparkSession, folder: str) -> DataFrame:
    usable = table(spark, folder, "embeddings").where(whitening.usable("embedding"))
    whole = F.transform("embedding", lambda c: F.floor(c.cast("double") * 64) + 1_000_000)
    vectors = usable.select("vec_id", whole.alias("x"))
    model = whitening.fit(vectors, "x", 32)
    columns = "vec_id {}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if model is None:
        return spark.createDataFrame([], columns.format(vectors.schema["vec_id"].dataType.simpleString()))
    count, error = F.lit(model.count).cast("long"), whitening.identity_error(vectors, "x", model)
    difference = lambda x, s: F.try_subtract(F.try_multiply(x, count), s)
    squares = F.transform(F.zip_with("x", F.array(*[F.lit(s) for s in model.sums]), difference), lambda d: F.try_multiply(d, d))
    rows = whitening.whiten(vectors, "x", model).select(
        "vec_id", F.aggregate(squares, F.lit(0).cast("long"), F.try_add).alias("deviation"), F.posexplode("whitened").alias("place", "whitened")
    )
    return rows.select(
        "vec_id",
        (F.col("place") + 1).alias("component"),
        count.alias("n"),
        "deviation",
        "whitened",
        F.get(F.array(*[F.lit(e) for e in model.explained]), F.col("place")).alias("explained"),
        F.lit(error).alias("identity_error"),
    )


def queries() -> dict[str, Query]:
    found = (
        op1_toxicity,
        op2_chat_formatting,
        op3_packing,
        op4_personal_data,
        op5_quality,
        op6_lm_scoring,
        op7_warc,
        op8_ngram_jaccard,
        op9_decontamination,
        op10_url_filter,
        op11_substring_dedup,
        op12_periodic_runs,
        op13_embedding_whitening,
    )
    return {q.__name__: q for q in found}


def oracle_sql() -> dict[str, str]:
    """SQL for the queries that SQL can express; the others train models, read
    vocabularies or align, and are held against brute force in the tests."""
    return {"op7_warc": OP7_SQL}


OP7_SQL = """
WITH sized AS (
  SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages
), digested AS (
  SELECT page_id, CAST(octet_length(payload) AS BIGINT) AS payload_bytes, sha256(payload) AS payload_digest FROM sized
), grouped AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id, count(*) OVER (PARTITION BY payload_digest) AS copies FROM digested
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM grouped
"""
