"""Scopes, unions, audits and reports over the built layers."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def scope(starts: DataFrame, season: DataFrame | None = None, breed: str | None = None) -> DataFrame:
    """Starts of a season (its dates, and its course if it has one) and breed."""
    out = starts if breed is None else starts.where(F.col("breed") == breed)
    if season is None:
        return out
    s = season.select(F.col("course").alias("s_course"), "first_day", "last_day")
    return out.join(s, (F.col("course") == F.col("s_course")) & F.col("race_date").between(F.col("first_day"), F.col("last_day"))).drop("s_course", "first_day", "last_day")


def all_finishes(entries: DataFrame, history: DataFrame) -> DataFrame:
    """Card entries and history starts, multiplicity kept."""
    return entries.select("horse_id", "race_date", "finish").withColumn("origin", F.lit("entry")).unionByName(history.select("horse_id", "race_date", "finish").withColumn("origin", F.lit("history")))


def preferred_source(a: Column, b: Column, priority: dict[str, int]) -> Column:
    """The source of better (smaller) priority; null if tied or unknown."""
    m = F.create_map(*[F.lit(x) for pair in priority.items() for x in pair])
    pa, pb = F.try_element_at(m, a), F.try_element_at(m, b)
    return F.when(pa < pb, a).when(pb < pa, b)


def with_rating(obs: DataFrame, results: DataFrame) -> DataFrame:
    """Ratings joined onto observations by result."""
    return obs.drop("rating").join(results.select("result_id", "rating"), "result_id", "left")


def integrity_audit(races: DataFrame, results: DataFrame) -> DataFrame:
    """Findings by kind: races sharing a day and course with other breeds, results without race, races without results, results repeating a horse."""
    count = lambda df, kind: df.agg(F.lit(kind).alias("kind"), F.count("*").alias("findings"))
    mixed = races.groupBy("race_date", "course").agg(F.countDistinct("breed").alias("b")).where("b > 1")
    twice = results.groupBy("race_id", "horse_id").count().where("count > 1")
    return count(mixed, "conflicting_breed").unionByName(count(results.join(races, "race_id", "left_anti"), "orphan_results")).unionByName(count(races.join(results, "race_id", "left_anti"), "empty_races")).unionByName(count(twice, "repeated_horse"))


def gaps(races: DataFrame) -> DataFrame:
    """City-months without a race inside months in which another city raced."""
    months = races.select(F.year("race_date").alias("year"), F.month("race_date").alias("month"), F.col("course").alias("city")).distinct()
    cities = months.select("city").distinct()
    return months.select("year", "month").distinct().crossJoin(cities).join(months, ["year", "month", "city"], "left_anti")


def career_audit(starts: DataFrame, n: int, seed: int) -> DataFrame:
    """Completeness of the careers of n horses, chosen by a seeded hash."""
    chosen = starts.select("horse_id").distinct().orderBy(F.xxhash64("horse_id", F.lit(seed)), "horse_id").limit(n)
    return starts.join(F.broadcast(chosen), "horse_id").groupBy("horse_id").agg(F.count("*").alias("starts"), F.countDistinct("race_date").alias("days"), F.countDistinct("course").alias("courses"), F.count_if(F.col("finish").isNull()).alias("unfinished"))


def readiness_layers(layers: dict[str, DataFrame], least: int = 1) -> DataFrame:
    """Rows of each layer, and whether it has enough."""
    out = None
    for name, df in layers.items():
        r = df.agg(F.lit(name).alias("layer"), F.count("*").alias("rows"))
        out = r if out is None else out.unionByName(r)
    return out.withColumn("ready", F.col("rows") >= least)


def merge_report(members: DataFrame, n: int) -> DataFrame:
    """Keys held by several rows, the largest first."""
    return members.groupBy("key").agg(F.count("*").alias("rows"), F.min("id").alias("first_id")).where("rows > 1").orderBy(F.desc("rows"), "key").limit(n)


def canonical_tracks(races: DataFrame, code: Column) -> DataFrame:
    """Each code with the raw names that lead to it."""
    return races.groupBy(code.alias("code")).agg(F.array_join(F.sort_array(F.collect_set("course")), ",").alias("variants"), F.count("*").alias("races"))
