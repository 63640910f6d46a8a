"""Racecourses: labels to registry codes, straight lengths, match coverage, weather of a race."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as x
from .quality import hour_snapshot, trailing_weather

c = F.col


def track_key(label: Column) -> Column:
    """A label without case, marks and blanks, for comparison."""
    return F.replace(x.normalize_name(label), F.lit(" "), F.lit(""))


def resolve_course(rows: DataFrame, registry: DataFrame, label: str = "course") -> DataFrame:
    """Code of each row's track: of the registry entry whose normalised alias is equal, else a synthetic one; `known` tells which.

    The registry (code, alias) is a list of racecourses; of several codes for one alias the
    smallest counts. It is joined as it is: Spark broadcasts it while it is small.
    """
    aliases = registry.select(track_key(c("alias")).alias("_key"), "code").where("_key != ''").groupBy("_key").agg(F.min("code").alias("_code"))
    out = rows.withColumn("_key", track_key(c(label))).join(aliases, "_key", "left")
    return out.withColumn("code", F.coalesce("_code", x.synthetic_course(c(label)))).withColumn("known", c("_code").isNotNull()).drop("_key", "_code")


def straight_category(meters: Column) -> Column:
    return F.when(meters < 200, "Short").when(meters <= 275, "Medium").when(meters.isNotNull(), "Long")


def track_config(rows: DataFrame, config: DataFrame) -> DataFrame:
    """Straight length and category of rows with a code in the configuration (code, straight_m), null without a confident match."""
    own = config.select("code", c("straight_m").alias("straight_length_m"))
    return rows.join(own, "code", "left").withColumn("straight_category", straight_category(c("straight_length_m"))).withColumn("config_applied", c("straight_length_m").isNotNull())


def comparable(a: Column, b: Column) -> Column:
    """Whether two straight lengths are of one category; false if either is unknown."""
    return F.coalesce(straight_category(a) == straight_category(b), F.lit(False))


def propose_config(config: DataFrame, proposals: DataFrame) -> DataFrame:
    """What proposed straight lengths (code, proposed_m) would change; a conflict is reported, nothing is applied."""
    j = proposals.join(config.select("code", c("straight_m").alias("current_m")), "code", "left")
    status = F.when(c("current_m").isNull(), "unknown_track").when(c("current_m") == c("proposed_m"), "unchanged").otherwise("conflict_reported")
    return j.select("code", "current_m", "proposed_m", status.alias("status"), F.lit(False).alias("applied"))


def track_match(races: DataFrame, results: DataFrame, config: DataFrame) -> DataFrame:
    """Per configured track: days, heats, results and the variants of its raw names with their heats.

    `races` has code and course; a row without a configuration counts under a null track with
    its raw names, the list of what is unmatched; `share` is each row's share of all heats.
    """
    n = results.groupBy("race_id").agg(F.count("*").alias("n"))
    r = races.select("race_id", "race_date", "course", "code").join(config.select("code", "straight_m"), "code", "left").join(n, "race_id", "left").withColumn("track", F.when(c("straight_m").isNotNull(), c("code")))
    by_name = r.groupBy("track", "course").agg(F.count("*").alias("heats"), F.coalesce(F.sum("n"), F.lit(0)).alias("results"))
    names = by_name.groupBy("track").agg(F.sum("heats").alias("heats"), F.sum("results").alias("results"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("course", "heats")))).alias("variants"))
    days = r.groupBy("track").agg(F.countDistinct("race_date", "course").alias("days"))
    total = by_name.agg(F.sum("heats").alias("total"))  # one row
    return names.join(days, names["track"].eqNullSafe(days["track"])).drop(days["track"]).crossJoin(F.broadcast(total)).withColumn("share", c("heats") / c("total")).drop("total")


def attach_weather(races: DataFrame, observed: DataFrame, hour: int = 14) -> DataFrame:
    """Races with the observation of their course and day: values at the hour, trailing rain, track condition.

    `observed` has course, day, precip, temp and parallel arrays hours and temps. Races without
    an observation fall away.
    """
    j = races.select("race_id", "course", "race_date").join(observed.withColumnRenamed("day", "race_date"), ["course", "race_date"])
    rain = trailing_weather(races, observed.select("course", "day", "precip", "temp"))
    out = j.withColumn("temp_at", hour_snapshot(j, "hours", "temps", hour)).join(rain, "race_id")
    return out.select("race_id", "course", "race_date", "temp_at", "precip", "rain_3", "rain_7", "temp_3", x.track_condition(c("precip"), c("rain_3"), c("rain_7")).alias("track_condition"))
