"""Permanent ids: clusters of matched rows, kept up as batches of rows and matches arrive."""

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import written
from .graph import connected_components

#: The confidence of a cluster's first row and of its others.
PRIMARY, MEMBER = 1.0, 0.95


@dataclass
class Identity:
    """links: id, horse_id; merges: old horse_id, merged_into. Both are written tables."""

    links: DataFrame
    merges: DataFrame

    def resolve(self, ids: DataFrame, column: str = "horse_id") -> DataFrame:
        """Permanent ids with those that they were merged into, if they were; merges lead to a living id in one step."""
        merged = self.merges.select(F.col("old").alias(column), "merged_into")
        return ids.join(merged, column, "left").withColumn(column, F.coalesce("merged_into", column)).drop("merged_into")


def extend(known: Identity | None, rows: DataFrame, matches: DataFrame) -> Identity:
    """Permanent ids of all rows after a batch: rows (id), matches (a, b) between new or known rows.

    Matches are contracted to the clusters that are known, so that components are sought among
    the batch's own edges only, however many rows there are; rows of other clusters are not
    touched but for one join. A cluster keeps its permanent id; of several that a match
    unites, the smallest lives and the others point to it; a cluster of new rows alone takes
    its smallest row id, which no cluster can have, since ids of clusters are ids of their rows.
    Rows that are known already and matches of unknown rows change nothing.
    """
    spark = rows.sparkSession
    if known is None:
        none = spark.createDataFrame([], "id long, horse_id long")
        known = Identity(none, spark.createDataFrame([], "old long, merged_into long"))
    fresh = rows.select(F.col("id").cast("long").alias("id")).where("id is not null").distinct().join(known.links.select("id"), "id", "left_anti")
    every = written(known.links.select("id", "horse_id", F.lit(True).alias("old")).unionByName(fresh.select("id", F.col("id").alias("horse_id"), F.lit(False).alias("old"))), "rows")
    end = lambda k: every.select(F.col("id").alias(k), F.col("horse_id").alias(f"{k}_cluster"))
    edges = matches.select("a", "b").join(end("a"), "a").join(end("b"), "b")
    united = connected_components(edges, src="a_cluster", dst="b_cluster")
    # a cluster lives on if it is a known one
    old = known.links.select(F.col("horse_id").alias("id"), F.lit(True).alias("old")).distinct()
    c = united.join(old, "id", "left").groupBy("component").agg(F.min(F.when(F.col("old"), F.col("id"))).alias("known"), F.min("id").alias("least"))
    to = written(united.join(c, "component").select(F.col("id").alias("horse_id"), F.coalesce("known", "least").alias("to"), (F.col("known").isNotNull()).alias("any")), "united")
    links = every.join(to.select("horse_id", "to"), "horse_id", "left").select("id", F.coalesce("to", "horse_id").alias("horse_id"))
    ends = to.join(old.withColumnRenamed("id", "horse_id"), "horse_id").where("horse_id != to").select(F.col("horse_id").alias("old"), F.col("to").alias("merged_into"))
    earlier = known.merges.join(to.select(F.col("horse_id").alias("merged_into"), "to"), "merged_into", "left").select("old", F.coalesce("to", "merged_into").alias("merged_into"))
    return Identity(written(links, "links"), written(earlier.unionByName(ends), "merges"))


def horses(identity: Identity, profiles: DataFrame) -> DataFrame:
    """One row per permanent id: horse_id, primary_id, name, key, sex, year, members, auto_merged.

    profiles: id, name, key, sex, year, starts. The primary row has the most starts, then the
    longest name, then the smallest id; the year is the primary's, or the first that is known
    in that order.
    """
    p = identity.links.join(profiles, "id")
    order = F.struct((-F.col("starts")).alias("s"), (-F.length(F.trim("name"))).alias("l"), F.col("id").alias("i"))
    first = lambda c: F.min_by(c, order)
    dated = F.when(F.col("year").isNotNull(), order)
    g = p.groupBy("horse_id").agg(
        first("id").alias("primary_id"), first(F.trim("name")).alias("name"), first("key").alias("key"), first("sex").alias("sex"),
        F.min_by("year", dated).alias("year"), F.count(F.lit(1)).alias("members"),
    )
    return g.withColumn("auto_merged", F.col("members") > 1)


def links(identity: Identity, entities: DataFrame) -> DataFrame:
    """Every row with its permanent id, confidence and method."""
    e = entities.select("horse_id", "primary_id", "auto_merged")
    confidence = F.when(F.col("id") == F.col("primary_id"), PRIMARY).otherwise(MEMBER)
    method = F.when(F.col("auto_merged"), "auto_merge").otherwise("singleton")
    return identity.links.join(e, "horse_id").select("id", "horse_id", confidence.alias("confidence"), method.alias("method"))


def aliases(identity: Identity, profiles: DataFrame) -> DataFrame:
    """The distinct normalised names of each permanent id, each as its best row writes it: horse_id, key, alias."""
    order = F.struct((-F.col("starts")).alias("s"), (-F.length(F.trim("name"))).alias("l"), F.col("id").alias("i"))
    p = identity.links.join(profiles, "id").where("key != ''")
    return p.groupBy("horse_id", "key").agg(F.min_by(F.trim("name"), order).alias("alias"))


def open_candidates(identity: Identity, pairs: DataFrame) -> DataFrame:
    """Matches for review, one for each unordered pair of permanent ids, the best first: left_id, right_id, a, b, score."""
    end = lambda k: identity.links.select(F.col("id").alias(k), F.col("horse_id").alias(f"h{k}"))
    j = pairs.select("a", "b", "score").join(end("a"), "a").join(end("b"), "b").where("ha != hb")
    j = j.select(F.least("ha", "hb").alias("left_id"), F.greatest("ha", "hb").alias("right_id"), "a", "b", "score")
    best = Window.partitionBy("left_id", "right_id").orderBy(F.desc("score"), "a", "b")
    return j.withColumn("rn", F.row_number().over(best)).where("rn = 1").drop("rn")
