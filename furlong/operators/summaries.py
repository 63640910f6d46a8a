"""Short summaries of starts: by distance, person, offspring, breed; clocks and records; race classification."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as x
from .boards import board, orders
from .metrics import plausible

c = F.col


def _within(place: int) -> Column:
    return c("finish").between(1, place)


def horse_distance(starts: DataFrame) -> DataFrame:
    """Starts, wins and average finish of each horse at each distance; equal rows all count."""
    return starts.groupBy("horse_id", "distance").agg(F.count("*").alias("starts"), F.count_if(_within(1)).alias("wins"), F.avg("finish").alias("avg_finish"))


def people_stats(starts: DataFrame, names: DataFrame, role: str) -> DataFrame:
    """Starts, wins and win rate of each trimmed name in a role; ids are summed before they meet their names. Blank names are left out."""
    s = starts.groupBy(role).agg(F.count("*").alias("n"), F.count_if(_within(1)).alias("w"))
    named = names.select(role, F.trim("name").alias("name")).where("name != ''")
    g = s.join(named, role).groupBy("name").agg(F.sum("n").alias("starts"), F.sum("w").alias("wins"))
    return g.select(F.lit(role).alias("role"), "name", "starts", "wins", (c("wins") / c("starts")).alias("win_rate"))


def offspring_stats(relations: DataFrame, starts: DataFrame) -> DataFrame:
    """Of each parent (parent_id, role, horse_id): distinct offspring, their starts, wins, top three and rates."""
    per = starts.groupBy("horse_id").agg(F.count("*").alias("n"), F.count_if(_within(1)).alias("w"), F.count_if(_within(3)).alias("t"))
    g = relations.select("parent_id", "role", "horse_id").distinct().join(per, "horse_id").groupBy("role", "parent_id").agg(F.count("*").alias("offspring"), F.sum("n").alias("starts"), F.sum("w").alias("wins"), F.sum("t").alias("top3"))
    return g.withColumns({"win_rate": c("wins") / c("starts"), "top3_rate": c("top3") / c("starts")})


def totals(starts: DataFrame) -> DataFrame:
    """One row: distinct race days, horses, courses and trainers."""
    return starts.agg(*(F.countDistinct(k).alias(v) for k, v in (("race_date", "race_days"), ("horse_id", "horses"), ("course", "courses"), ("trainer_id", "trainers"))))


def primary_breed(starts: DataFrame) -> DataFrame:
    """The breed that each horse started in most, the first by name on ties, and its starts."""
    p = starts.groupBy("horse_id", "breed").agg(F.count("*").alias("n"))
    return p.groupBy("horse_id").agg(F.min_by("breed", F.struct(-c("n"), "breed")).alias("breed"), F.max("n").alias("starts"))


def offspring_targets(starts: DataFrame, least: int = 3) -> DataFrame:
    """Of each horse that raced `least` times in a known breed, the row with most starts (the later name on ties)."""
    p = starts.where("breed is not null").groupBy("horse_id", "breed").agg(F.count("*").alias("starts")).where(c("starts") >= least)
    return p.groupBy("horse_id").agg(F.max_by("breed", F.struct("starts", "breed")).alias("breed"), F.max("starts").alias("starts"))


def parent_targets(relations: DataFrame) -> DataFrame:
    """Parents with the number of their relationships and the roles they have, in order."""
    return relations.where("parent_id is not null").groupBy("parent_id").agg(F.count("*").alias("relations"), F.array_join(F.array_sort(F.collect_set("role")), ",").alias("roles"))


def fastest(starts: DataFrame, n: int = 10, clocks: int = 3) -> DataFrame:
    """Fastest horses of each breed with `clocks` plausible times: peak, mean of the best three and average speed."""
    s = plausible(starts).select("breed", "horse_id", (c("distance") / c("time_s")).alias("v"), "result_id")
    s = s.withColumn("rn", F.row_number().over(Window.partitionBy("breed", "horse_id").orderBy(F.desc("v"), "result_id")))
    p = s.groupBy("breed", "horse_id").agg(F.count("*").alias("starts"), F.round(F.max("v"), 6).alias("peak"), F.round(F.avg(F.when(c("rn") <= 3, c("v"))), 6).alias("top3"), F.round(F.avg("v"), 6).alias("avg_speed"))
    return board(p, ["breed"], clocks, orders(["-peak", "-top3", "horse_id"]), n, "fastest")


#: Distances in metres that records are kept for.
CLASSIC = (1000, 1200, 1400, 1600, 1800, 2000, 2400)


def distance_records(starts: DataFrame, n: int = 10) -> DataFrame:
    """Winning clocks at the classic distances: the best of each horse, the first n of each breed and distance."""
    w = starts.where(c("distance").isin(*CLASSIC) & _within(1)).groupBy("breed", "distance", "horse_id").agg(F.min(F.round("time_s", 6)).alias("best"), F.count("*").alias("starts"))
    return board(w, ["breed", "distance"], 1, orders(["best", "horse_id"]), n, "records")


def classify_races(races: DataFrame, fields: dict[str, Column]) -> DataFrame:
    """How many of the required fields each race has, and the missing ones by name."""
    missing = F.array_sort(F.array_compact(F.array(*(F.when(v.isNull(), F.lit(k)) for k, v in fields.items()))))
    return races.select("race_id", (F.lit(len(fields)) - F.size(missing)).alias("have"), F.array_join(missing, ",").alias("missing"))


def race_fields(weather: Column, condition: Column, value: Column, difficulty: Column) -> dict[str, Column]:
    """The ten required fields of a race with distance, breed and name."""
    return {
        "distance": c("distance"), "surface": c("breed"), "class_code": x.race_class(c("name")), "age_restriction": x.age_restriction(c("name")), "breed": c("breed"), "sex_restriction": x.sex_restriction(c("name")),
        "track_condition": condition, "weather": weather, "race_value": value, "difficulty": difficulty,
    }
