"""The queries of this subpackage, each over its whole table, and their SQL."""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import bpe, language_id, pii, sql, warc
from millrace.llm.embedding_dedup import near_vectors
from millrace.llm.exact_dedup import exact_dedup
from millrace.llm.line_dedup import drop_repeated_lines
from millrace.llm.manifest import manifest, proof_hash
from millrace.llm.minhash_dedup import near_dedup
from millrace.llm.mixing import mix
from millrace.llm.packing import packed, pieces_of
from millrace.llm.spelling import misspelt, spelling_variants
from millrace.llm.token_counts import count_tokens


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    docs = docs.withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False)))
    filters = language_id.learn(docs.filter("not held_out"))
    return language_id.identify(docs.select("doc_id", "held_out", "text"), filters).drop("text")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    ids = bpe.encode(_table(spark, sf_dir, "documents").select("doc_id", "text"), path).drop("text")
    texts = bpe.decode(ids, path)
    return texts.select(
        "doc_id",
        F.size("token_ids").cast("bigint").alias("n_tokens"),
        bpe.ids_sha256(F.col("token_ids")).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), carry=["doc_id"])


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = warc.archive(_table(spark, sf_dir, "pages"))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(_table(spark, sf_dir, "documents"), carry=["doc_id"])


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = ("email", "ip", "card", "phone")
    docs = pii.find_spans(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    kinds = F.col("pii.kind")
    counts = {f"n_{k}": (F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("bigint") for k in base}
    digest = F.sha2(pii.written(F.filter("pii", lambda s: s["kind"].isin(*base))), 256)
    scores = F.array_join(F.transform("pii", lambda s: F.round(s["score"] * 100).cast("int").cast("string")), ",")
    return docs.select("doc_id", *[c.alias(n) for n, c in counts.items()], digest.alias("base_sha256"), pii.written(F.col("pii")).alias("spans"), scores.alias("scores"))


def op7_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(_table(spark, sf_dir, "embeddings"), carry=["vec_id"])


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(_table(spark, sf_dir, "documents"), carry=["doc_id"], width=2)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(_table(spark, sf_dir, "documents"), carry=["doc_id"])
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = drop_repeated_lines(_table(spark, sf_dir, "documents"), carry=["doc_id"])
    return lines.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op11_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pieces_of(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), carry=["doc_id"])
    packing = packed(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"))
    return packing.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    rows = manifest(docs, carry=["doc_id"], tampered=F.crc32(F.col("doc_id").cast("string")) % 3 == 0)
    return rows.select("doc_id", "leaf", "subroot", "root", proof_hash(F.col("proof")).alias("proof_sha256"), "folded_root", "verified")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(_table(spark, sf_dir, "documents"), changes=misspelt)


def queries() -> dict:
    return {f.__name__: f for f in (op1_language_id, op2_bpe, op3_token_counts, op4_warc, op5_exact_dedup, op6_pii, op7_embedding_near_dedup, op8_minhash_near_dedup, op9_mixing, op10_line_dedup, op11_best_fit_packing, op12_merkle_manifest, op13_spelling_variants)}


def oracle_sql() -> dict[str, str]:
    return {"op4_warc": sql.WARC, "op5_exact_dedup": sql.EXACT_DEDUP, "op6_pii": sql.PII, "op7_embedding_near_dedup": sql.EMBEDDING, "op9_mixing": sql.MIXING, "op10_line_dedup": sql.LINE_DEDUP, "op12_merkle_manifest": sql.MERKLE, "op13_spelling_variants": sql.SPELLING}
