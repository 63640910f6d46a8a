"""Quality suites: what is checked of the warehouse, and of computed metrics and boards."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as x
from ..sources.store import written
from .quality import row_checks

c = F.col


def _groups(df: DataFrame, keys: list, id_col: str, check: str, severity: str, entity: str) -> DataFrame:
    """One issue per repeated key: its least id and how many more there are."""
    g = df.groupBy(*keys).agg(F.min(id_col).alias("id"), F.count("*").alias("n")).where("n > 1")
    return g.select(F.lit(check).alias("check"), F.lit(severity).alias("severity"), F.lit(entity).alias("entity"), c("id").cast("long").alias("id"), (c("n") - 1).alias("details"))


def warehouse_checks(races: DataFrame, results: DataFrame, horses: DataFrame, people: dict[str, DataFrame] | None = None, slowest: float = 600.0) -> DataFrame:
    """Issues of the star schema in long form: check, severity, entity, id, details (a count or a value).

    Races by natural key, horses by normalised name, results by race and horse; results without
    a finish, winners of a race without a prize, clocks outside 0 to `slowest` seconds; places
    below 1, shared by three or more, or beyond the field by more than two; blank names, and
    names with stray blanks, of horses and people (name -> rows of id, name).

    Results are read once, by race; what could be amiss, a result or its race, is written, and
    only that is grouped by horse and place.
    """
    issue = lambda df, check, severity, entity, key, details: df.select(F.lit(check).alias("check"), F.lit(severity).alias("severity"), F.lit(entity).alias("entity"), c(key).cast("long").alias("id"), details.cast("long").alias("details"))
    one = F.lit(1)
    race, placed = Window.partitionBy("race_id"), F.when(c("finish") > 0, c("finish"))
    again = lambda v: F.count(v).over(race) - F.size(F.collect_set(v).over(race))
    results = results.withColumns({"_n": F.count("finish").over(race), "_most": F.max("finish").over(race), "_least": F.min("finish").over(race), "_horses": again(c("horse_id")), "_places": again(placed)})
    results = results.where(f"finish is null or time_s <= 0 or time_s > {slowest} or _horses > 0 or _places > 1 or _least < 1 or _most > _n + 2")
    results = written(results.select("result_id", "race_id", "horse_id", "finish", "time_s", c("_n").alias("n"), c("_most").alias("most"), c("_least").alias("least")), "odd-results")
    same_place = results.where("finish > 0").groupBy("race_id", "finish").agg(F.count("*").alias("n")).where("n >= 3")
    field = results.where("least < 1 or most > n + 2").select("race_id", "n", "most", "least").distinct()
    prizeless = races.where("prize is null or prize <= 0")
    parts = [
        _groups(races, ["course", "race_date", "number", x.normalize_name(c("name")).alias("_n")], "race_id", "duplicate_races", "warning", "race"),
        _groups(horses.select("horse_id", x.normalize_name(c("name")).alias("_n")).where("_n != ''"), ["_n"], "horse_id", "duplicate_horses", "warning", "horse"),
        _groups(results.where("horse_id is not null"), ["race_id", "horse_id"], "result_id", "duplicate_results", "error", "result"),
        issue(results.where("finish is null"), "missing_finish_position", "warning", "result", "result_id", one), issue(prizeless, "missing_prize", "info", "race", "race_id", one),
        issue(results.where(f"time_s <= 0 or time_s > {slowest}"), "impossible_race_time", "error", "result", "result_id", c("time_s")),
        issue(same_place, "impossible_finish_order", "warning", "race", "race_id", c("n")), issue(field.where("least < 1"), "impossible_finish_order", "error", "race", "race_id", c("least")), issue(field.where("most > n + 2"), "impossible_finish_order", "warning", "race", "race_id", c("most")),
    ]
    for kind, df in {"horse": horses.select(c("horse_id").alias("id"), "name"), **(people or {})}.items():
        blank, stray = F.coalesce(F.trim("name"), F.lit("")) == "", (c("name") != F.trim("name")) | c("name").contains("  ")
        rules: dict[str, tuple[str, Column]] = {f"inconsistent_{kind}_names": ("error", blank), f"irregular_{kind}_names": ("info", ~blank & stray)}
        parts.append(row_checks(df, kind, "id", rules).select("check", "severity", "entity", c("id").cast("long").alias("id"), F.lit(1).cast("long").alias("details")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def validate_metrics(metrics: DataFrame, boards: DataFrame | None = None, least: int = 5, fields: tuple[str, ...] = ("rating", "form_5", "consistency")) -> DataFrame:
    """Warnings on metric rows (horse_id, starts, wins, avg_finish, earnings): single and perfect single starts, earnings of one start, impossible wins, rates and averages, missing values, abnormal earnings, horses on a board below the minimum.

    Earnings are abnormal beyond the mean of earners by four deviations, at two starts or fewer.
    """
    earners = metrics.where("earnings > 0").agg((F.avg("earnings") + 4 * F.stddev_pop("earnings")).alias("_cap"), F.count("*").alias("_earners"))  # one row
    one, rate = c("starts") == 1, c("wins") / c("starts")
    missing = F.lit(False)
    for f in fields:
        missing = missing | c(f).isNull()
    rules = {
        "single_start": ("warning", one), "perfect_single_start": ("warning", one & (c("wins") == 1)), "earnings_single_start": ("info", one & (c("earnings") > 0)), "impossible_wins": ("error", c("wins") > c("starts")), "impossible_win_rate": ("error", (rate < 0) | (rate > 1)),
        "impossible_avg_finish": ("error", c("avg_finish") < 1), "missing_data": ("warning", missing & (c("starts") >= least)), "abnormal_earnings": ("warning", (c("_earners") >= 5) & (c("earnings") > c("_cap")) & (c("starts") <= 2)),
    }
    out = row_checks(metrics.crossJoin(F.broadcast(earners)), "horse", "horse_id", rules)
    if boards is None:
        return out
    low = boards.where("board != 'highest_earnings'").select("horse_id").distinct().join(metrics.where(c("starts") < least).select("horse_id").distinct(), "horse_id")
    return out.unionByName(low.select(F.lit("underqualified_on_board").alias("check"), F.lit("warning").alias("severity"), F.lit("horse").alias("entity"), c("horse_id").alias("id")))
