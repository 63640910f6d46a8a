"""Queries over scopes, audits and reports."""

from pyspark.sql import functions as F

from ..functions import scalars as x
from ..operators import audit as a
from ..sources import tables as t
from .common import Catalogue
from .ingest import names

c = Catalogue()
QUERIES, SQL = c.queries, c.sql


@c.query("with s as (select course, min(race_date) first_day, min(race_date) + 90 last_day from races group by 1) select result_id, starts.course from starts join s on starts.course = s.course and race_date between first_day and last_day where breed = 'BUILDING'")
def c01_scope(spark, d):
    s = t.races(spark, d).groupBy("course").agg(F.min("race_date").alias("first_day"), F.date_add(F.min("race_date"), 90).alias("last_day"))
    return a.scope(t.starts(spark, d), s, "BUILDING").select("result_id", "course")


@c.query("select horse_id, o origin, count(*) n from starts, (select unnest(['entry', 'history']) o) group by 1, 2")
def h01_all_finishes(spark, d):
    s = t.starts(spark, d)
    return a.all_finishes(s, s).groupBy("horse_id", "origin").agg(F.count("*").alias("n"))


@c.query("select race_id, case when race_id % 3 = 0 then 'club' when race_id % 3 = 1 then 'site' end preferred from races")
def b17_preferred_source(spark, d):
    r = t.races(spark, d).withColumn("s", F.when(F.col("race_id") % 3 == 0, "club").when(F.col("race_id") % 3 == 1, "site").otherwise("blog"))
    other = F.when(F.col("race_id") % 3 == 0, "site").otherwise("wire")
    return r.select("race_id", a.preferred_source(F.col("s"), other, {"club": 1, "site": 2, "wire": 3}).alias("preferred"))


@c.query("select race_id, max(rating) best from results group by 1")
def d12_with_rating(spark, d):
    r = t.results(spark, d)
    return a.with_rating(t.starts(spark, d), r).groupBy("race_id").agg(F.max("rating").alias("best"))


@c.query("""
select 'conflicting_breed' kind, count(*) findings from (select 1 from races group by race_date, course having count(distinct breed) > 1) union all select 'orphan_results', count(*) from results where race_id not in (select race_id from races)
union all select 'empty_races', count(*) from races where race_id not in (select race_id from results) union all select 'repeated_horse', count(*) from (select 1 from results group by race_id, horse_id having count(*) > 1)
""")
def q04_integrity_audit(spark, d):
    return a.integrity_audit(t.races(spark, d), t.results(spark, d))


@c.query("with m as (select distinct cast(year(race_date) as int) as year, cast(month(race_date) as int) as month, course city from races), g as (select * from (select distinct year, month from m), (select distinct city from m)) select * from g anti join m using (year, month, city)")
def q08_gaps(spark, d):
    return a.gaps(t.races(spark, d))


@c.query()
def q13_career_audit(spark, d):
    return a.career_audit(t.starts(spark, d), 100, 7)


@c.query("select 'races' layer, count(*) as rows, true ready from races union all select 'results', count(*), true from results union all select 'horses', count(*), true from horses")
def q14_readiness_layers(spark, d):
    return a.readiness_layers({"races": t.races(spark, d), "results": t.results(spark, d), "horses": t.horses(spark, d)})


@c.query("with nm as (select trim(regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g')) k, horse_id from horses) select k as key, count(*) as rows, min(horse_id) first_id from nm group by 1 having count(*) > 1 order by count(*) desc, k limit 50")
def i13_merge_report(spark, d):
    return a.merge_report(names(spark, d), 50)


@c.query("select replace(lower(course), '_', '-') code, course variants, count(*) races from races group by 1, 2")
def i15_canonical_tracks(spark, d):
    return a.canonical_tracks(t.races(spark, d), x.synthetic_course(F.col("course")))
