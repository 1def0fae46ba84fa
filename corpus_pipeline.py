"""From raw documents to token ids: five stages, each on all that the one before kept."""

import threading
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import bpe, language_id
from millrace.llm.exact_dedup import exact_dedup
from millrace.llm.minhash_dedup import near_dedup
from millrace.llm.mixing import mix
from millrace.functions.staging import delete_staged, quoted, scratch, staged

#: Share of a text's n-grams that its language must hold at least.
LEAST_SCORE = 0.4
#: The setting for the rows of a batch that goes to a Python worker.
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: SQL can express neither the language model nor the shingle join nor BPE; tests hold each stage against brute force.
ORACLE_SQL = None


#: Tables that this thread's last stage wrote for itself and its result still reads.
_LEFT = threading.local()


def stage(function: Callable) -> Callable:
    """A stage that first removes what the thread's stage before wrote on its way, so that disk does not add up: a
    stage's result must be written before the next one is called, as `run` does."""

    @wraps(function)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        delete_staged(spark, getattr(_LEFT, "paths", []))
        with scratch(spark) as own:
            out = function(spark, docs, sf_dir)
            _LEFT.paths = own.release()
        return out

    return run_stage


#: The columns of documents that stages read or replace nothing of.
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _apart(docs: DataFrame) -> DataFrame:
    """docs with all columns but those of documents in one struct, so that none has the name of a stage's result."""
    more = [c for c in docs.columns if c not in COLUMNS]
    own = [c for c in docs.columns if c in COLUMNS]
    return docs.select(*own, F.struct(*map(quoted, more)).alias("_more")) if more else docs


def _as_before(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs, in their order, of rows made from `_apart`."""
    return rows.select(*[quoted(c) if c in COLUMNS else F.col("_more").getField(c).alias(c) for c in docs.columns])


@stage
def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, null and empty ones among them, or whose n-grams no language holds well enough, go."""
    named = language_id.identify(_apart(docs), language_id.learn(docs))
    return _as_before(named.filter((F.col("lang_pred") != language_id.UNDETERMINED) & (F.col("score") >= LEAST_SCORE)), docs)


@stage
def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the smallest id stays, one row where it is repeated."""
    return _as_before(exact_dedup(_apart(docs)).filter("kept"), docs)


@stage
def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by 0.8 of their five-word shingles one stays, one row where it is repeated; those without words stay."""
    return _as_before(near_dedup(_apart(docs)).filter("kept"), docs)


@stage
def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it; one without words is taken as often as its place says."""
    return _as_before(mix(_apart(docs)).withColumn("_copy", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int")))), docs)


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Python workers get so many rows at a time: whole texts and their ids are wide, and both sides hold a batch."""
    before = spark.conf.get(BATCH)
    spark.conf.set(BATCH, rows)
    try:
        yield
    finally:
        spark.conf.set(BATCH, before)


@stage
def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source and token_ids of every document, and whether decoding gives its text back.

    The ids are written before they are decoded, so that no task needs two Python workers at once; of the texts only
    digests are."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    digest = F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest")
    with batches_of(spark, 1024), scratch(spark) as own:
        ids = staged(bpe.encode(docs.select("doc_id", "source", "text", digest), path).drop("text"), "token-ids")
        same = F.sha2("decoded", 256) == F.col("digest")
        columns = ("doc_id", "source", F.size("token_ids").cast("bigint").alias("n_tokens"), "token_ids", same.alias("round_trip"))
        return own.keep(staged(bpe.decode(ids, path).select(*columns), "decoded"))


STAGES = [
    ("language_id", known_language),
    ("exact_dedup", without_copies),
    ("minhash_near_dedup", without_near_copies),
    ("mixing", mixed),
    ("bpe", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each result written and read again; only the last one stays. Null and empty texts go
    at the first stage; an empty table gives an empty result."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with scratch(spark) as own:
        for name, apply in STAGES:
            before, docs = docs, staged(apply(spark, docs, sf_dir), f"pipeline-{name}")
            own.drop(before)
        own.keep(docs)
    delete_staged(spark, _LEFT.paths)
    _LEFT.paths = []
    return docs


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
