"""The corpus pipeline: quality, near duplicates, decontamination, mixing, token ids.

Each stage takes (spark, docs, sf_dir), works on every row it gets and returns a DataFrame;
all but the last return the columns of documents. run() writes each stage's result as
Parquet in the shared folder and reads it again for the next.
"""

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from furlong.llm import decontamination, jaccard_join, mixing, quality, token_store
from furlong.llm.common import read, shared_folder, written
from furlong.llm.queries import tokenizer_file

#: Bytes of an Arrow batch; Spark's 64 MB hold a whole split of texts, in the JVM and in each Python worker.
BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "4m"


def in_small_batches(stage: Callable) -> Callable:
    """The stage with small Arrow batches in all that it runs; stages share executors, whose memory adds up."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        before = spark.conf.get(BATCH)
        spark.conf.set(BATCH, BATCH_BYTES)
        try:
            return stage(spark, docs, sf_dir)
        finally:
            spark.conf.set(BATCH, before)

    return run


@in_small_batches
def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier (op 9) rejects go; a row with a null doc_id stays."""
    scored = quality.classify(docs, read(spark, sf_dir, "labels"))
    rejected = written(scored.where("rejected").select("doc_id").distinct(), "rejected")
    return docs.join(rejected, "doc_id", "left_anti").select(docs.columns)


@in_small_batches
def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of the n-gram Jaccard join (op 5), the document of smallest id stays."""
    components = jaccard_join.jaccard_join(docs)
    dropped = written(components.where("component_id != doc_id").select("doc_id").distinct(), "dropped")
    return docs.join(dropped, "doc_id", "left_anti").select(docs.columns)


@in_small_batches
def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of benchmark words (op 1) go."""
    found = decontamination.contamination(docs, read(spark, sf_dir, "benchmark"))
    leaks = written(found.where(F.size("word_spans") > 0).select("doc_id").distinct(), "leaks")
    return docs.join(leaks, "doc_id", "left_anti").select(docs.columns)


@in_small_batches
def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as mixing (op 10) says: none, once or more.

    The domain KEEP stays whole: its total is its target, and a document that is more likely
    of that domain than of all others has a rate of 1 at least, which the fit takes into account. A null id stays once.
    """
    mixed = mixing.mix(docs, read(spark, sf_dir, "labels"), keep=mixing.KEEP)
    copies = written(mixed.where("copies != 1").groupBy("doc_id").agg(F.max("copies").alias("copies")), "copies")
    times = F.sequence(F.lit(1), F.coalesce("copies", F.lit(1)))
    return docs.join(copies, "doc_id", "left").where("coalesce(copies, 1) > 0").withColumn("time", F.explode(times)).select(docs.columns)


@in_small_batches
def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All texts as token ids in Simple-8b words (op 4), and the documents read back from them."""
    path = shared_folder(spark) + "-tokens"
    token_store.write_tokens(docs, path, tokenizer_file("word_bpe_49k.json"))
    return token_store.read_tokens(spark, path)


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("token_ids", token_stage),
]

#: Classifiers and tokenizers are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
