"""Exact dedup: 128-bit content hash, byte comparison inside groups, one row stays."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, id_and_text


def content_hash(normalised: Column) -> Column:
    """128 bits of the normalised text."""
    return F.unhex(F.md5(normalised))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hash_of=content_hash) -> DataFrame:
    """Group texts that are identical but for ASCII white space.

    Returns one row per input row: doc_id, keep_id, group_size, kept, text_sha256 (of the
    normalised text). Of a group, the longest original text (code points), then the smallest
    doc_id stays.

    The grouping key is the hash followed by the bytes of the normalised text, so two texts
    that share a hash never share a group; the hash comes first so that comparisons nearly
    always end there. Map-side combining leaves a group of any size at one row per input
    partition before the shuffle. Rows then meet their group by hash and SHA-256, a join
    that adaptive execution may split at a hot key.

    Defined cases: null text counts as empty, and all empty texts form one group. Rows that
    repeat a doc_id count one by one; of rows that repeat both doc_id and text, one is kept.
    A null doc_id sorts before other ids. An empty table gives
    an empty result. Other columns are ignored.
    """
    text = F.col("text")
    norm = F.regexp_replace(text, SPACE, "")
    keyed = id_and_text(docs, id_col, text_col).select("doc_id", F.length(text).alias("n"), norm.alias("norm")).select("doc_id", "n", "norm", hash_of(F.col("norm")).alias("h"))
    groups = (
        keyed.groupBy("h", "norm")
        .agg(F.min(F.struct((-F.col("n")).alias("neg"), "doc_id")).alias("best"), F.count(F.lit(1)).alias("group_size"))
        .select("h", F.sha2("norm", 256).alias("text_sha256"), F.col("best.doc_id").alias("keep_id"), (-F.col("best.neg")).alias("keep_n"), "group_size")
    )
    rows = keyed.select("doc_id", "n", "h", F.sha2("norm", 256).alias("text_sha256"))
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("n") == F.col("keep_n"))
    out = rows.join(groups, ["h", "text_sha256"]).select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256")
    # equal rows are as one another, so one of them is the one that stays
    copies = out.groupBy(*out.columns).agg(F.count(F.lit(1)).alias("copies")).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return copies.withColumn("kept", F.col("kept") & (F.col("copy") == 1)).select(*out.columns)
