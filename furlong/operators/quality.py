"""Joins on calendars, set operations, data quality and coverage."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import written


def trailing_weather(races: DataFrame, weather: DataFrame) -> DataFrame:
    """Rain over the 3 and 7 days before each race, absent days dry, and mean temperature of 3 days.

    A race meets at most seven observations: days are exploded into an equi-join, not compared.
    """
    days = races.select("race_id", "course", "race_date", F.explode(F.sequence(F.lit(1), F.lit(7))).alias("back")).withColumn("day", F.date_sub("race_date", F.col("back")))
    j = days.join(weather, ["course", "day"], "left")
    three = F.col("back") <= 3
    return j.groupBy("race_id").agg(F.sum(F.when(three, F.coalesce("precip", F.lit(0.0))).otherwise(0.0)).alias("rain_3"), F.sum(F.coalesce("precip", F.lit(0.0))).alias("rain_7"), F.avg(F.when(three, F.col("temp"))).alias("temp_3"))


def hour_snapshot(df: DataFrame, hours: str, values: str, hour: int) -> Column:
    """Of parallel hourly arrays, the value nearest the hour, the first on ties."""
    z = F.transform(F.arrays_zip(hours, values), lambda e, i: F.struct(F.abs(e[hours] - hour).alias("away"), i.alias("i"), e[values].alias("value")))
    return F.element_at(F.array_sort(z), 1)["value"]


def calendar_grid(years: DataFrame, cities: DataFrame) -> DataFrame:
    """Year x month x city; Spark broadcasts the smaller side while it is small."""
    return years.select("year", F.explode(F.sequence(F.lit(1), F.lit(12))).alias("month")).crossJoin(cities)


def missing_ranges(races: DataFrame, observed: DataFrame, lookback: int) -> DataFrame:
    """Contiguous days per course that races need, `lookback` days included, and no one observed."""
    need = races.select("course", F.explode(F.sequence(F.date_sub("race_date", lookback), F.col("race_date"))).alias("day")).distinct()
    gone = need.join(observed.select("course", "day"), ["course", "day"], "left_anti")
    island = F.date_sub("day", F.row_number().over(Window.partitionBy("course").orderBy("day")))
    return gone.withColumn("island", island).groupBy("course", "island").agg(F.min("day").alias("first"), F.max("day").alias("last"), F.count("*").alias("days")).drop("island")


def orphans(fact: DataFrame, dim: DataFrame, key: str) -> DataFrame:
    """Rows of the fact whose key isn't in the dimension."""
    return fact.join(dim.select(key), key, "left_anti")


def link_events(events: DataFrame, races: DataFrame) -> DataFrame:
    """Market events to races: by external id, else by date, number and course prefix; the first hit wins."""
    one = events.join(races.select(F.col("race_id").alias("by_id"), F.col("race_id").alias("external_id")), "external_id", "left")
    two = races.groupBy(F.col("race_date").alias("event_date"), F.substring("course", 1, 8).alias("prefix")).agg(F.min("race_id").alias("by_day"))
    out = one.join(two, ["event_date", "prefix"], "left")
    return out.select("event_id", F.coalesce("by_id", "by_day").alias("race_id"), F.when(F.col("by_id").isNotNull(), 1).when(F.col("by_day").isNotNull(), 2).alias("tier"))


def overlay(proofs: DataFrame, cell: list[str]) -> DataFrame:
    """One proof per cell: the least priority number wins, then the source name."""
    return proofs.groupBy(*cell).agg(F.min(F.struct("priority", "source", "status")).alias("p")).select(*cell, "p.*")


def source_diff(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of one side only."""
    x, y = a.select(*keys).distinct(), b.select(*keys).distinct()
    return x.join(y, keys, "left_anti").withColumn("missing_in", F.lit("b")).unionByName(y.join(x, keys, "left_anti").withColumn("missing_in", F.lit("a")))


def overlap(groups: DataFrame, n: Column) -> DataFrame:
    """Horses that are in every race of a group."""
    return groups.groupBy("group_id", "horse_id").agg(F.countDistinct("race_id").alias("races"), F.max("group_size").alias("group_size")).where(F.col("races") == n)


def in_every_race(starts: DataFrame, group: list[str]) -> DataFrame:
    """`overlap` of groups of two races or more: group_id (a struct of the group's columns), horse_id, races, group_size.

    A horse that is in every race is in the first and the last one by id. Horses of these two
    are looked at for all groups; races are only counted for those that are in both, and in
    their groups. Reads `starts` several times.
    """
    ends = starts.groupBy(*group).agg(F.min("race_id").alias("_first"), F.max("race_id").alias("_last")).where("_first < _last")
    at_ends = starts.join(ends, group).where("race_id = _first or race_id = _last").groupBy(*group, "horse_id")
    both = written(at_ends.agg(F.min("race_id").alias("_a"), F.max("race_id").alias("_b")).where("_a < _b").select(*group, "horse_id"), "both-ends")
    size = starts.join(both.select(*group).distinct(), group, "left_semi").groupBy(*group).agg(F.countDistinct("race_id").alias("group_size"))
    same = F.col("horse_id").eqNullSafe(F.col("_horse_id"))
    for k in group:
        same = same & (F.col(k) == F.col(f"_{k}"))
    rows = starts.join(both.withColumnsRenamed({k: f"_{k}" for k in both.columns}), same, "left_semi").join(size, group)
    return overlap(rows.select(F.struct(*group).alias("group_id"), "race_id", "horse_id", "group_size"), F.col("group_size"))


def row_checks(df: DataFrame, entity: str, id_col: str, rules: dict[str, tuple[str, Column]]) -> DataFrame:
    """Issues in long form: check, severity, entity, id. One pass, whatever the number of rules."""
    issues = F.array_compact(F.array(*(F.when(bad, F.struct(F.lit(name).alias("check"), F.lit(severity).alias("severity"))) for name, (severity, bad) in rules.items())))
    return df.select(F.lit(entity).alias("entity"), F.col(id_col).alias("id"), F.explode(issues).alias("i")).select("i.check", "i.severity", "entity", "id")


def dq_summary(issues: DataFrame) -> DataFrame:
    """Issues per check, and the worst severity as the status."""
    status = F.when(F.count_if(F.col("severity") == "error") > 0, "error").when(F.count_if(F.col("severity") == "warning") > 0, "warning").otherwise("ok")
    return issues.groupBy("check").agg(F.count("*").alias("issues"), status.alias("status"))


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("copies")).where("copies > 1")


def dedupe_plan(races: DataFrame, keys: list[str], results: DataFrame) -> DataFrame:
    """Of races with one natural key, the one with most results, then least id, is kept."""
    n = results.groupBy("race_id").agg(F.count("*").alias("results"))
    r = races.join(n, "race_id", "left").withColumn("results", F.coalesce("results", F.lit(0)))
    w = Window.partitionBy(*keys)
    ranked = r.withColumn("rank", F.row_number().over(w.orderBy(F.desc("results"), "race_id"))).withColumn("keeper", F.first("race_id").over(w.orderBy(F.desc("results"), "race_id"))).withColumn("copies", F.count("*").over(w))
    return ranked.where("copies > 1").select(*keys, "race_id", "results", "keeper", (F.col("rank") == 1).alias("kept"))


def conflicts(a: DataFrame, b: DataFrame, key: str, value: str, priority: DataFrame) -> DataFrame:
    """Values on which two sources differ, with the one of better priority; null if tied or unknown."""
    p = F.broadcast(priority)  # a list of sources
    j = a.select(key, F.col(value).alias("value_a"), F.col("source").alias("source_a")).join(b.select(key, F.col(value).alias("value_b"), F.col("source").alias("source_b")), key).where("value_a != value_b")
    j = j.join(p.select(F.col("source").alias("source_a"), F.col("priority").alias("pa")), "source_a", "left").join(p.select(F.col("source").alias("source_b"), F.col("priority").alias("pb")), "source_b", "left")
    return j.select(key, "value_a", "value_b", F.when(F.col("pa") < F.col("pb"), F.col("source_a")).when(F.col("pb") < F.col("pa"), F.col("source_b")).alias("preferred"))


def fill_audit(df: DataFrame, columns: list[str]) -> DataFrame:
    """Filled share of each column in one pass; blank is missing."""
    filled = lambda c: F.avg(F.when(F.col(c).isNotNull() & (F.trim(F.col(c).cast("string")) != ""), 1.0).otherwise(0.0))
    return df.agg(*(filled(c).alias(c) for c in columns)).unpivot([], columns, "column", "filled")


def coverage_matrix(grid: DataFrame, races: DataFrame, today: Column) -> DataFrame:
    """Status of each city-month: a confirmed race, confirmed none (future), missing in an active month, unresolved."""
    have = races.groupBy("year", "month", F.col("course").alias("city")).agg(F.countDistinct("race_date").alias("days"), F.count("*").alias("heats"))
    active = races.groupBy("year", "month").agg(F.countDistinct("course").alias("cities"))
    g = grid.join(have, ["year", "month", "city"], "left").join(active, ["year", "month"], "left")
    first = F.make_date("year", "month", F.lit(1))
    status = F.when(F.col("days") > 0, "CONFIRMED_RACE").when(first > today, "CONFIRMED_NO_RACE").when(F.col("cities") > 0, "MISSING_DATA").otherwise("UNRESOLVED")
    return g.select("year", "month", "city", F.coalesce("days", F.lit(0)).alias("days"), F.coalesce("heats", F.lit(0)).alias("heats"), status.alias("status"))


def coverage_metrics(cells: DataFrame) -> DataFrame:
    """Proven and filled shares and counts by status, per year and in all (null)."""
    n = lambda s: F.count_if(F.col("status") == s)
    race, missing = n("CONFIRMED_RACE"), n("MISSING_DATA")
    return cells.rollup("year").agg(F.count("*").alias("cells"), race.alias("race"), missing.alias("missing"), n("UNRESOLVED").alias("unresolved"), F.when(race + missing > 0, race / (race + missing)).alias("proven"), F.sum("days").alias("days"), F.sum("heats").alias("heats"), F.countDistinct(F.when(F.col("heats") > 0, F.col("city"))).alias("cities"))


def prioritise(cells: DataFrame) -> DataFrame:
    """Open cells by how likely they hide a race: missing in an active month, a month that raced in other years, the rest."""
    w = Window.partitionBy("city", "month")
    seasonal = F.max((F.col("status") == "CONFIRMED_RACE").cast("int")).over(w)
    p = F.when((F.col("status") == "MISSING_DATA") & (F.col("seasonal") == 1), "P0").when(F.col("seasonal") == 1, "P1").when(F.col("status") == "MISSING_DATA", "P2").otherwise("P3")
    return cells.withColumn("seasonal", seasonal).where(F.col("status").isin("MISSING_DATA", "UNRESOLVED")).withColumn("priority", p)


def classify_cells(cells: DataFrame, evidence: DataFrame, today: Column) -> DataFrame:
    """Empty cells by evidence: rows of history make missing data; future cells have no race."""
    e = evidence.dropDuplicates(["url", "horse_id", "day", "round"]).groupBy("year", "month", "city").agg(F.countDistinct("day").alias("e_days"), F.count("*").alias("e_rows"), F.sort_array(F.collect_set("url")).alias("urls"))
    j = cells.where("days = 0").drop("status").join(e, ["year", "month", "city"], "left")
    status = F.when(F.make_date("year", "month", F.lit(1)) > today, "CONFIRMED_NO_RACE").when(F.col("e_rows") > 0, "MISSING_DATA").otherwise("UNRESOLVED")
    return j.select("year", "month", "city", status.alias("status"), F.coalesce("e_days", F.lit(0)).alias("evidence_days"), F.when(F.size("urls") > 1, 0.92).when(F.col("e_rows") > 0, 0.78).alias("confidence"))
