"""Leaderboards: qualify, order, rank, keep the first N."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as x
from ..sources import store


def board(metrics: DataFrame, keys: list[str], least_starts: int, order: list[Column], n: int, name: str) -> DataFrame:
    """Rank within keys those with enough starts; a limit of ranks per key lets Spark prune before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(keys).orderBy(*order))
    return metrics.where(F.col("starts") >= least_starts).withColumn("rank", rank).where(F.col("rank") <= n).withColumn("board", F.lit(name))


def scope_ranks(metrics: DataFrame, keys: list[str]) -> DataFrame:
    """Position by rating, then wins, win rate, starts, earnings, last date and id."""
    order = [F.desc_nulls_last("rating"), F.desc("wins"), F.desc(F.col("wins") / F.col("starts")), F.desc("starts"), F.desc("earnings"), F.desc("last_date"), F.asc("horse_id")]
    return ranked(metrics, keys, -F.col("rating"), order, "position")


def ranked(rows: DataFrame, keys: list[str], first: Column, order: list[Column], name: str, buckets: int = 256) -> DataFrame:
    """Ranks within keys of any size: a scope is cut into ranges of `first`, a number that rises along the order, and they are ranked alone.

    The cuts are approximate quantiles of each scope, a fixed number of them; equal values share
    a range, so each range holds all rows between its neighbours. The rows before a range come
    from counts of (scope, range), which are few. Quantiles depend on the order in which partial
    ones are merged, and sums on that of rows, so rows and cuts are written once: counts and
    ranks are of the same ranges.
    """
    rows = store.written(rows.withColumn("_first", F.coalesce(first, F.lit(float("inf")))), "ranked")
    cuts = store.written(rows.groupBy(*keys).agg(F.percentile_approx("_first", [i / buckets for i in range(1, buckets)], 1000).alias("_cuts")), "cuts")
    r = rows.join(cuts, keys).withColumn("_range", F.size(F.filter("_cuts", lambda v: v < F.col("_first")))).drop("_cuts")
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = r.groupBy(*keys, "_range").agg(F.count("*").alias("_n")).select(*keys, "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy(*keys, "_range").orderBy(*order))
    return r.withColumn("_own", own).join(sizes, [*keys, "_range"]).withColumn(name, (F.col("_own") + F.col("_before")).cast("int")).drop("_own", "_before", "_range", "_first")


def season_gate(metrics: DataFrame, least: int) -> DataFrame:
    """One row: whether a season has data for a board."""
    return metrics.agg(F.when((F.count("*") == 0) | (F.coalesce(F.max("starts"), F.lit(0)) <= 1) | (F.count_if(F.col("starts") >= least) == 0), "INSUFFICIENT_DATA").otherwise("OK").alias("status"), F.count_if(F.col("starts") >= least).alias("qualified"), F.count_if(F.col("starts") < least).alias("excluded"))


#: Boards: name -> (least starts, order).
GENERAL = {
    "best_career": (3, ["-rating", "-wins", "horse_id"]),
    "highest_win_rate": (5, ["-win_rate", "-starts", "horse_id"]),
    "most_successful": (1, ["-wins", "-starts", "horse_id"]),
    "highest_earnings": (1, ["-earnings", "horse_id"]),
    "best_form": (3, ["-form_5", "-wins", "horse_id"]),
    "most_consistent": (3, ["-consistency", "-starts", "horse_id"]),
    "improving": (3, ["-slope", "horse_id"]),
    "declining": (3, ["slope", "horse_id"]),
}


def orders(names: list[str]) -> list[Column]:
    return [F.desc_nulls_last(n[1:]) if n[0] == "-" else F.asc_nulls_last(n) for n in names]


def best_of(rows: DataFrame, keys: list[str], boards: dict[str, tuple[Column, list[Column]]], tie: str, n: int) -> DataFrame:
    """Several boards at once: board -> (who qualifies, numbers in rising order); one window ranks them all, n of each key.

    A null number excludes a row from its board; `value` is the first number, its sign turned.
    """
    entry = lambda name, ok, order: F.when(ok & order[0].isNotNull(), F.struct(F.lit(name).alias("board"), *((order + [F.lit(0.0)] * 3)[k].cast("double").alias(f"k{k}") for k in range(3))))
    e = rows.select("*", F.explode(F.array_compact(F.array(*(entry(b, ok, order) for b, (ok, order) in boards.items())))).alias("e"))
    w = Window.partitionBy("e.board", *keys).orderBy("e.k0", "e.k1", "e.k2", tie)
    return e.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).withColumns({"board": F.col("e.board"), "value": -F.col("e.k0")}).drop("e")


def general_boards(metrics: DataFrame, n: int = 10) -> DataFrame:
    """The boards of GENERAL for each breed, ranked in one pass."""
    number = lambda o: -F.coalesce(F.col(o[1:]), F.lit(float("-inf"))) if o[0] == "-" else F.col(o)
    only = {"improving": F.col("slope") > 2, "declining": F.col("slope") < -2}
    specs = {b: ((F.col("starts") >= least) & only.get(b, F.lit(True)), [number(o) for o in order if o != "horse_id"]) for b, (least, order) in GENERAL.items()}
    return best_of(metrics, ["breed"], specs, "horse_id", n)


def sex_boards(adjusted: DataFrame, n: int = 10, least: int = 5) -> DataFrame:
    """Best mare, stallion, performer in mixed races, female against males and male against females, by the sex-adjusted metrics."""
    c, ok = F.col, F.col("starts") >= least
    female, male, starts = x.is_female(c("bio")), x.is_male(c("bio")), -c("starts")
    specs = {
        "best_mare": (ok & female, [-c("adjusted"), starts]), "best_stallion": (ok & male, [-c("adjusted"), starts]), "best_mixed_race_performer": (ok, [-c("mixed"), starts]),
        "best_female_against_males": (ok & female, [-c("vs_males"), starts]), "most_dominant_male": (ok & male, [-c("vs_females"), starts]),
    }
    return best_of(adjusted, [], specs, "horse_id", n).select("board", "rank", "horse_id", "value")


def segment_boards(starts: DataFrame, labels: dict[str, Column], least: int = 3, n: int = 10) -> DataFrame:
    """Best horses of each segment value, by a rating computed within it; labels are exploded into one pass of metrics.

    Starts that are partitioned by horse are exploded and ranked there, without a shuffle of all labels.
    """
    from .metrics import career_metrics, indexed

    each = F.explode(F.array_compact(F.array(*(F.when(v.isNotNull(), F.struct(F.lit(i).alias("i"), v.cast("string").alias("value"))) for i, v in enumerate(labels.values())))))
    s = indexed(starts).select("horse_id", "race_id", "result_id", "race_date", "finish", "speed_index", "difficulty", "earnings", each.alias("_s"))
    m = career_metrics(s.withColumns({"_i": F.col("_s.i"), "value": F.col("_s.value")}).drop("_s"), ["_i", "value", "horse_id"]).withColumn("rating", F.round("rating", 6))
    best = board(m, ["_i", "value"], least, orders(["-rating", "-wins", "-starts", "horse_id"]), n, "segment")
    return best.withColumn("segment", F.element_at(F.array(*map(F.lit, labels)), F.col("_i") + 1)).drop("_i")


def breeding_boards(values: DataFrame, n: int = 10) -> DataFrame:
    """Parents of each breed by offspring value (three raced, ten starts) and by win rate (twenty starts)."""
    c = F.col
    return best_of(values.withColumnRenamed("value", "_value"), ["breed"], {"value": ((c("raced") >= 3) & (c("starts") >= 10), [-c("_value"), -c("starts")]), "win_rate": (c("starts") >= 20, [-F.round("win_rate", 9), -c("starts")])}, "parent_id", n)


def people_boards(totals: DataFrame, n: int = 10) -> DataFrame:
    """People of each role by wins, win rate, earnings and starts."""
    return board(totals, ["role"], 1, orders(["-wins", "-win_rate", "-earnings", "-starts", "entity_id"]), n, "people")


def register_views(spark, starts: DataFrame, metrics: DataFrame, intelligence: DataFrame) -> list[str]:
    """Temporary views of the boards' sources; consumers filter, order and limit them."""
    views = {"v_starts": starts, "v_metrics": metrics, "v_race_intelligence": intelligence, "v_high_shock": intelligence.where("shock >= 70"), "v_improving": metrics.where("trend = 'improving'"), "v_declining": metrics.where("trend = 'declining'"), "v_winners": starts.where("finish = 1")}
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    return list(views)


#: Question names and the boards that answer them.
QUESTIONS = {"best horse": "best_career", "most wins": "most_successful", "richest": "highest_earnings", "best form": "best_form", "most consistent": "most_consistent", "most improved": "improving", "declining": "declining", "win rate": "highest_win_rate"}


def leaderboard(boards: DataFrame, question: str, n: int, breed: str = "*") -> DataFrame:
    """The board that a question names: an exact alias, else one that contains or is contained."""
    q = question.strip().lower()
    name = QUESTIONS.get(q) or next((b for a, b in QUESTIONS.items() if a in q or q in a), None)
    return boards.where((F.col("board") == name) & (F.col("breed") == breed)).orderBy("rank").limit(n)
