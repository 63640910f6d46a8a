"""Canonical tables (races, results, horses, weather, snapshots, entries) over the given tables."""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

NAMES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table; columns and filters reach the scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_tables(spark: SparkSession, sf_dir: str, names=NAMES) -> dict[str, DataFrame]:
    """Tables by name; each is lazy, so unused ones cost nothing."""
    return {n: read(spark, sf_dir, n) for n in names}


def races(spark: SparkSession, d: str) -> DataFrame:
    """An order is a race; its customer's nation is the course and segment the breed."""
    c = read(spark, d, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    n = F.broadcast(read(spark, d, "nation").select("n_nationkey", "n_name"))  # a dimension of fixed size
    return (
        read(spark, d, "orders").join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
        .select(F.col("o_orderkey").alias("race_id"), F.to_date("o_orderdate").alias("race_date"), F.col("n_name").alias("course"), F.col("c_mktsegment").alias("breed"), F.col("o_orderpriority").alias("name"),
                (1000 + 100 * (F.col("o_orderkey") % 15)).alias("distance"), F.col("o_custkey").alias("owner_id"), F.col("o_totalprice").alias("prize"))
    )


def results(spark: SparkSession, d: str, only: DataFrame | None = None) -> DataFrame:
    """A line is a result; finish is the order of extended price within the race.

    The race's id is named before the windows, so that joins and windows by race share their shuffle.
    `only` (race_id), a list that is small, keeps some races, whole.
    """
    race = Window.partitionBy("race_id")
    finish = F.row_number().over(race.orderBy(F.desc("l_extendedprice"), "l_linenumber", "l_partkey", "l_suppkey"))
    number = F.row_number().over(race.orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    line = read(spark, d, "lineitem").withColumnRenamed("l_orderkey", "race_id")
    line = line if only is None else line.join(F.broadcast(only), "race_id", "left_semi")
    return line.select(
        (F.col("race_id") * 100 + number).alias("result_id"), "race_id", F.col("l_partkey").alias("horse_id"), F.col("l_suppkey").alias("trainer_id"), (F.col("l_suppkey") % 37).alias("jockey_id"),
        number.alias("cloth"), finish.alias("finish"), F.when(F.col("l_discount") != 0, F.col("l_quantity") * 2).alias("rating"), (50 + F.col("l_tax") * 100).alias("weight"), (14 + F.col("l_discount") * 20).alias("speed"),
        F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("earnings"),
    )


def starts(spark: SparkSession, d: str, only: DataFrame | None = None) -> DataFrame:
    """Results with their race; time_s follows from distance and speed. `only` is that of results."""
    return results(spark, d, only).join(races(spark, d), "race_id").withColumn("time_s", F.col("distance") / F.col("speed"))


def horses(spark: SparkSession, d: str) -> DataFrame:
    """A part is a horse; sex and birth date follow from type and size."""
    male = F.col("p_type").isin("ECONOMY", "PROMO", "STANDARD") | (F.length("p_type") % 2 == 0)
    return read(spark, d, "part").select(F.col("p_partkey").alias("horse_id"), F.concat_ws(" ", "p_name", "p_brand").alias("name"), F.when(male, "male").otherwise("female").alias("sex"), F.date_sub(F.lit("1999-12-31").cast("date"), F.col("p_size") * 60).alias("birthdate"), (F.col("p_partkey") % 97).alias("sire_id"), (F.col("p_partkey") % 389).alias("dam_id"))


def weather_daily(spark: SparkSession, d: str) -> DataFrame:
    """One observation per course and ship date."""
    line = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("race_id"), F.to_date("l_shipdate").alias("day"), "l_tax", "l_quantity", "l_discount")
    return line.join(races(spark, d).select("race_id", "course"), "race_id").groupBy("course", "day").agg(F.round(10 * F.sum("l_tax"), 6).alias("precip"), F.round(F.avg("l_quantity") - 5, 6).alias("temp"), F.round(100 * (1 - F.avg("l_discount")), 6).alias("humidity"))


def snapshots(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").select(F.col("event_type").alias("kind"), F.col("user_id").alias("source_key"), F.col("ts").alias("captured_at"), F.col("props").alias("payload"), "event_id", "value")


#: The same tables as DuckDB common table expressions, for the oracle.
BASE = """
races as (select o_orderkey race_id, cast(o_orderdate as date) race_date, n_name course, c_mktsegment breed, o_orderpriority as name, 1000 + 100 * (o_orderkey % 15) distance, o_custkey owner_id, o_totalprice prize
          from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey),
results as (select l_orderkey * 100 + row_number() over n result_id, l_orderkey race_id, l_partkey horse_id, l_suppkey trainer_id, l_suppkey % 37 jockey_id, row_number() over n cloth,
            row_number() over (partition by l_orderkey order by l_extendedprice desc, l_linenumber, l_partkey, l_suppkey) finish, case when l_discount <> 0 then l_quantity * 2 end rating,
            50 + l_tax * 100 weight, 14 + l_discount * 20 speed, l_quantity quantity, l_extendedprice earnings
            from lineitem window n as (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice)),
starts as (select results.*, races.* exclude (race_id), distance / speed time_s from results join races using (race_id)),
horses as (select p_partkey horse_id, p_name || ' ' || p_brand as name, case when p_type in ('ECONOMY', 'PROMO', 'STANDARD') or length(p_type) % 2 = 0 then 'male' else 'female' end sex,
           cast(date '1999-12-31' - cast(p_size * 60 as int) as date) birthdate, p_partkey % 97 sire_id, p_partkey % 389 dam_id from part),
weather_daily as (select course, cast(l_shipdate as date) as day, round(10 * sum(l_tax), 6) precip, round(avg(l_quantity) - 5, 6) temp, round(100 * (1 - avg(l_discount)), 6) humidity from lineitem join races on l_orderkey = race_id group by 1, 2)
"""
