"""Queries over starts: joins, aggregations, windows, boards."""

from pyspark.sql import functions as F

from ..functions import scalars as x
from ..operators import boards as b
from ..operators import metrics as m
from ..operators import summaries as u
from ..sources import tables as t
from ..sources.store import partitions, written
from .common import Catalogue

c = Catalogue()
QUERIES, SQL = c.queries, c.sql

FIELD = """
field as (select *, count(*) over w field_size, avg(case when rating > 0 then rating end) over w mean_rating, avg(speed) over w mean_speed from starts window w as (partition by race_id)),
scored as (select *, least(150, greatest(50, 100 * speed / mean_speed)) si,
  round(least(100, greatest(0, 0.55 * least(100, greatest(0, (coalesce(mean_rating, 40) - 30) * 1.1)) + 0.25 * least(100, field_size * 6))), 3) di, least(100, greatest(0, 120 - 20.0 * finish)) q from field),
keyed as (select * exclude (breed), unnest([breed, '*']) breed from scored),
ranked as (select *, row_number() over w rn, lead(race_date) over w previous, max(race_date) over (partition by breed, horse_id) as last from keyed window w as (partition by breed, horse_id order by race_date desc, race_id desc, result_id desc)),
agg as (select breed, horse_id, count(*) starts, count(*) filter (finish = 1) wins, count(*) filter (finish = 2) as seconds, count(*) filter (finish = 3) thirds, avg(finish) avg_finish, stddev_pop(finish) sd,
  sum(q * pow(0.75, rn - 1)) filter (rn <= 3) / sum(pow(0.75, rn - 1)) filter (rn <= 3) form_3, sum(q * pow(0.75, rn - 1)) filter (rn <= 5) / sum(pow(0.75, rn - 1)) filter (rn <= 5) form_5, sum(q * pow(0.75, rn - 1)) filter (rn <= 10) / sum(pow(0.75, rn - 1)) filter (rn <= 10) form_10,
  case when count(*) >= 3 then regr_slope(q, -rn) filter (rn <= 5) end slope, avg(si) speed_index, avg(di) difficulty, sum(earnings) earnings, max(race_date) last_date, min(race_date - previous) filter (rn = 1) gap, count(*) filter (last - race_date <= 30) starts_30 from ranked group by all),
more as (select *, case when starts = 1 then 100 else least(100, 100 * exp(-sd / 2.5)) end consistency,
  round(least(100, 0.6 * case when gap is null then 0 when gap <= 3 then 90 when gap <= 7 then 70 when gap <= 14 then 40 when gap <= 28 then 20 else 5 end + 0.4 * least(100, starts_30 * 18)), 3) fatigue from agg),
metrics as (select *, (18 * 100.0 * wins / starts + 8 * 100.0 * seconds / starts + 5 * 100.0 * thirds / starts + 15 * 100.0 * (wins + seconds + thirds) / starts + 15 * least(100, greatest(0, 120 - 12.5 * avg_finish))
  + case when starts >= 3 then 12 * consistency when starts = 2 then 6 * consistency else 0 end + 12 * difficulty + 10 * form_5 + 5 * least(100, speed_index)) / (18 + 8 + 5 + 15 + 15 + 12 + 10 + 5 + case when starts >= 3 then 12 when starts = 2 then 6 else 0 end) rating from more)
"""


def metrics(spark, d):
    return m.horse_metrics(m.with_field(t.starts(spark, d)))


def r4(*names):
    return [F.round(n, 4).alias(n) for n in names]


@c.query("with " + FIELD + """
select breed, horse_id, starts, wins, seconds, thirds, round(avg_finish, 4) avg_finish, round(form_3, 4) form_3, round(form_5, 4) form_5, round(form_10, 4) form_10, round(slope, 4) slope, round(speed_index, 4) speed_index,
 round(difficulty + 1e-8, 6) difficulty, round(consistency, 4) consistency, fatigue, round(rating, 4) rating, last_date from metrics
""")
def e05_horse_metrics(spark, d):
    """Also E7-E10 and F2-F4."""
    return metrics(spark, d).select("breed", "horse_id", "starts", "wins", "seconds", "thirds", *r4("avg_finish", "form_3", "form_5", "form_10", "slope", "speed_index", "consistency"), F.round(F.col("difficulty") + 1e-8, 6).alias("difficulty"), "fatigue", *r4("rating"), "last_date")


@c.query("with " + FIELD + """, p as (select *, row_number() over (partition by breed order by round(rating, 6) desc, wins desc, wins / starts desc, starts desc, round(earnings, 2) desc, last_date desc, horse_id) as position from metrics)
select breed, horse_id, cast(position as int) as position from p
""")
def f06_scope_ranks(spark, d):
    mm = metrics(spark, d).select("breed", "horse_id", "starts", "wins", "last_date", F.round("rating", 6).alias("rating"), F.round("earnings", 2).alias("earnings"))
    return b.scope_ranks(mm, ["breed"]).select("breed", "horse_id", "position")


@c.query("with " + FIELD + """,
boards as (
 select 'most_successful' board, breed, row_number() over (partition by breed order by wins desc, starts desc, horse_id) as rank, horse_id from metrics where starts >= 1 union all
 select 'highest_earnings', breed, row_number() over (partition by breed order by round(earnings, 2) desc, horse_id), horse_id from metrics where starts >= 1 union all
 select 'best_career', breed, row_number() over (partition by breed order by round(rating, 6) desc, wins desc, horse_id), horse_id from metrics where starts >= 3 union all
 select 'best_form', breed, row_number() over (partition by breed order by round(form_5, 6) desc, wins desc, horse_id), horse_id from metrics where starts >= 3 union all
 select 'most_consistent', breed, row_number() over (partition by breed order by round(consistency, 6) desc, starts desc, horse_id), horse_id from metrics where starts >= 3 union all
 select 'highest_win_rate', breed, row_number() over (partition by breed order by round(wins / starts, 6) desc, starts desc, horse_id), horse_id from metrics where starts >= 5 union all
 select 'improving', breed, row_number() over (partition by breed order by round(slope, 6) desc, horse_id), horse_id from metrics where starts >= 3 and slope > 2 union all
 select 'declining', breed, row_number() over (partition by breed order by round(slope, 6), horse_id), horse_id from metrics where starts >= 3 and slope < -2)
select board, breed, cast(rank as int) as rank, horse_id from boards where rank <= 10
""")
def g03_general_boards(spark, d):
    mm = metrics(spark, d).withColumns({k: F.round(k, 6) for k in ("rating", "form_5", "consistency", "slope")} | {"earnings": F.round("earnings", 2), "win_rate": F.round(F.col("wins") / F.col("starts"), 6)})
    return b.general_boards(mm).select("board", "breed", "rank", "horse_id")


@c.query("with " + FIELD + """
select case when count(*) = 0 or max(starts) <= 1 or count(*) filter (starts >= 20) = 0 then 'INSUFFICIENT_DATA' else 'OK' end status, count(*) filter (starts >= 20) qualified, count(*) filter (starts < 20) excluded from metrics where breed = '*'
""")
def g02_season_gate(spark, d):
    return b.season_gate(metrics(spark, d).where("breed = '*'"), 20)


TOTALS = """
long as (select 'trainer_id' role, trainer_id entity_id, finish, earnings from starts union all select 'jockey_id', jockey_id, finish, earnings from starts union all select 'owner_id', owner_id, finish, earnings from starts
  union all select 'sire_id', sire_id, finish, earnings from starts join horses using (horse_id)),
totals as (select role, entity_id, count(*) starts, count(*) filter (finish = 1) wins, count(*) filter (finish <= 3) places, round(sum(earnings), 2) earnings from long group by 1, 2)
"""


def totals(spark, d):
    s = t.starts(spark, d).join(t.horses(spark, d).select("horse_id", "sire_id"), "horse_id")
    return m.entity_totals(s, ["trainer_id", "jockey_id", "owner_id", "sire_id"]).withColumn("earnings", F.round("earnings", 2))


@c.query("with " + TOTALS + "select role, entity_id, starts, wins, places, earnings, round(wins / starts, 6) win_rate, round(places / starts, 6) place_rate from totals")
def e13_entity_totals(spark, d):
    return totals(spark, d).withColumns({k: F.round(k, 6) for k in ("win_rate", "place_rate")})


@c.query("with " + TOTALS + """, r as (select *, row_number() over (partition by role order by wins desc, wins / starts desc, earnings desc, starts desc, entity_id) as rank from totals)
select role, cast(rank as int) as rank, entity_id, starts, wins, earnings from r where rank <= 10""")
def people_boards(spark, d):
    """G5, and the flagship query."""
    return b.people_boards(totals(spark, d)).select("role", "rank", "entity_id", "starts", "wins", "earnings")


@c.query("select race_id, count(*) field_size, count(*) filter (rating > 0) rated, round(avg(rating) filter (rating > 0), 6) mean_rating, round(min(time_s), 6) best_time from starts group by 1")
def e01_field_aggs(spark, d):
    return m.field_aggs(t.starts(spark, d)).withColumns({k: F.round(k, 6) for k in ("mean_rating", "best_time")})


@c.query("""
with g as (select horse_id, course, count(*) n, count(*) filter (finish = 1) w, max(race_date) as last from starts group by 1, 2)
select horse_id, first(course order by round(w / n * (1 - 0.5 / (n + 0.5)), 9) desc, last desc, course desc) best, round(max(w / n * (1 - 0.5 / (n + 0.5))), 6) score from g group by 1
""")
def e06_best_bucket(spark, d):
    return m.best_bucket(t.starts(spark, d), "horse_id", "course").withColumn("score", F.round("score", 6))


@c.query("""
with dd as (select distinct horse_id, race_date, finish, round(weight, 1) margin from starts)
select horse_id, count(*) starts, count(*) filter (finish = 1) wins, count(*) filter (finish <= 3) places, round(count(*) filter (finish = 1) / count(*), 6) win_rate, round(count(*) filter (finish <= 3) / count(*), 6) place_rate,
 round(avg(finish), 6) avg_finish, round(avg(margin), 6) avg_margin, max(race_date) last_date, cast(date '2000-01-01' - max(race_date) as int) days_since from dd group by 1
""")
def e02_horse_career(spark, d):
    """The union with history (H1) is of the same starts, which the distinct then removes."""
    s = t.starts(spark, d).select("horse_id", "race_date", "finish", F.round("weight", 1).alias("margin"))
    return m.career(s.unionByName(s), F.lit("2000-01-01").cast("date")).withColumns({k: F.round(k, 6) for k in ("win_rate", "place_rate", "avg_finish", "avg_margin")})


@c.query("select horse_id, distance, count(*) starts, count(*) filter (finish = 1) wins, round(avg(finish), 6) avg_finish from starts group by 1, 2")
def e03_horse_distance(spark, d):
    return u.horse_distance(t.starts(spark, d)).withColumn("avg_finish", F.round("avg_finish", 6))


@c.query("with r as (select 'trainer_id' role, trim(s_name) as name, finish from starts join supplier on trainer_id = s_suppkey union all select 'jockey_id', 'rider ' || (jockey_id % 20), finish from starts) select role, name, count(*) starts, count(*) filter (finish = 1) wins, round(count(*) filter (finish = 1) / count(*), 6) win_rate from r group by 1, 2")
def e04_people_stats(spark, d):
    """Trainers and jockeys by trimmed name."""
    s, names = t.starts(spark, d), t.read(spark, d, "supplier").select(F.col("s_suppkey").alias("trainer_id"), F.col("s_name").alias("name"))
    riders = s.select("jockey_id", F.concat(F.lit(" rider "), (F.col("jockey_id") % 20).cast("string")).alias("name")).distinct()
    both = u.people_stats(s, names, "trainer_id").unionByName(u.people_stats(s, riders, "jockey_id"))
    return both.withColumn("win_rate", F.round("win_rate", 6))


def weather_starts(spark, d):
    w = t.weather_daily(spark, d).select("course", F.col("day").alias("race_date"), x.temp_range(F.col("temp")).alias("temp_range"), F.when(F.col("precip") > 3, "wet").otherwise("dry").alias("rain"))
    return t.starts(spark, d).join(w, ["course", "race_date"])


WEATHER = """
w as (select course, day as race_date, case when temp < 10 then 'cold' when temp < 18 then 'cool' when temp < 25 then 'mild' when temp < 32 then 'warm' else 'hot' end temp_range, case when precip > 3 then 'wet' else 'dry' end rain from weather_daily),
ws as (select starts.*, temp_range, rain from starts join w using (course, race_date)), long as (select horse_id, finish, time_s, 'temp_range' dimension, temp_range bucket from ws union all select horse_id, finish, time_s, 'rain', rain from ws),
buckets as (select horse_id, dimension, bucket, count(*) starts, count(*) filter (finish = 1) wins, count(*) filter (finish = 1) / count(*) win_rate, avg(finish) avg_finish, avg(time_s) avg_time from long group by 1, 2, 3)
"""


@c.query("with " + WEATHER + "select horse_id, dimension, bucket, starts, wins, round(win_rate, 6) win_rate, round(avg_finish, 6) avg_finish, round(avg_time, 4) avg_time from buckets")
def e11_weather_buckets(spark, d):
    return m.weather_buckets(weather_starts(spark, d), ["temp_range", "rain"]).withColumns({"win_rate": F.round("win_rate", 6), "avg_finish": F.round("avg_finish", 6), "avg_time": F.round("avg_time", 4)})


@c.query("with " + WEATHER + """
select horse_id, dimension, first(bucket order by round(win_rate * (1 - 0.5 / (starts + 0.5)), 9) desc, starts desc, bucket desc) best, round(max(win_rate * (1 - 0.5 / (starts + 0.5))), 6) score, round(stddev_pop(win_rate), 6) sensitivity from buckets group by 1, 2""")
def e12_weather_preference(spark, d):
    return m.weather_preference(m.weather_buckets(weather_starts(spark, d), ["temp_range", "rain"])).withColumns({k: F.round(k, 6) for k in ("score", "sensitivity")})


SEX = """
bs as (select starts.*, case when sex = 'male' then 'Stallion' else 'Mare' end bio, least(100, greatest(0, 120 - 20.0 * finish)) q from starts join horses using (horse_id)),
comp as (select race_id, count(*) filter (bio = 'Stallion') males, count(*) filter (bio = 'Mare') females, cast(0 as bigint) as unknown, count(*) as size, count(distinct bio) = 2 mixed from bs group by 1),
fac as (select avg(q) filter (bio = 'Stallion') - avg(q) filter (bio = 'Mare') factor from bs join comp using (race_id) where mixed)
"""


def bio_starts(spark, d):
    h = t.horses(spark, d).select("horse_id", F.when(F.col("sex") == "male", "Stallion").otherwise("Mare").alias("bio"))
    return t.starts(spark, d).join(h, "horse_id")


@c.query("with " + SEX + "select * from comp")
def e14_sex_composition(spark, d):
    return m.sex_composition(bio_starts(spark, d))


@c.query("with " + SEX + """
, s as (select bs.*, males, females, size, mixed, factor, males - case when bio = 'Stallion' then 1 else 0 end om, females - case when bio = 'Mare' then 1 else 0 end fm, case when bio = 'Mare' then greatest(factor, 0) * males / size else 0 end credit from bs join comp using (race_id) cross join fac)
select horse_id, round(avg(q), 4) base, round(avg(q) + avg(credit), 4) adjusted, round(avg(q) filter (females = 0), 4) male_only, round(avg(q) filter (males = 0), 4) female_only, round(avg(q) filter (mixed), 4) mixed, round(avg(q) filter (om > 0), 4) vs_males, round(avg(q) filter (fm > 0), 4) vs_females,
 round(avg(finish) filter (om > 0), 4) vs_males_finish, round(avg(case when finish = 1 then 1 else 0 end) filter (om > 0), 4) vs_males_win, round(avg(case when finish <= 3 then 1 else 0 end) filter (om > 0), 4) vs_males_podium, round(avg(finish) filter (fm > 0), 4) vs_females_finish, round(avg(case when finish = 1 then 1 else 0 end) filter (fm > 0), 4) vs_females_win, round(avg(case when finish <= 3 then 1 else 0 end) filter (fm > 0), 4) vs_females_podium from s group by 1""")
def e16_sex_metrics(spark, d):
    """With E15, the strength factor over mixed races."""
    s = bio_starts(spark, d)
    comp = m.sex_composition(s)
    out = m.sex_metrics(s, comp, m.sex_strength(s, comp))
    return out.select("horse_id", *r4(*[k for k in out.columns if k not in ("horse_id", "starts")]))


@c.query("with " + SEX + """
, s as (select bs.*, males, females, size, mixed, factor, males - case when bio = 'Stallion' then 1 else 0 end om, females - case when bio = 'Mare' then 1 else 0 end fm, case when bio = 'Mare' then greatest(factor, 0) * males / size else 0 end credit from bs join comp using (race_id) cross join fac),
g as (select horse_id, bio, count(*) n, round(avg(q) + avg(credit), 6) adjusted, round(avg(q) filter (mixed), 6) mx, round(avg(q) filter (om > 0), 6) vm, round(avg(q) filter (fm > 0), 6) vf from s group by 1, 2),
b as (select unnest([struct_pack(b := 'best_mare', v := case when bio = 'Mare' then adjusted end), struct_pack(b := 'best_stallion', v := case when bio = 'Stallion' then adjusted end), struct_pack(b := 'best_mixed_race_performer', v := mx), struct_pack(b := 'best_female_against_males', v := case when bio = 'Mare' then vm end), struct_pack(b := 'most_dominant_male', v := case when bio = 'Stallion' then vf end)]) x, horse_id, n from g where n >= 5)
select x.b board, cast(row_number() over (partition by x.b order by x.v desc, n desc, horse_id) as int) as rank, horse_id, x.v as value from b where x.v is not null qualify rank <= 10""")
def g04_sex_boards(spark, d):
    """Five boards from the sex-adjusted metrics, ranked in one pass."""
    s = bio_starts(spark, d)
    comp = m.sex_composition(s)
    adjusted = m.sex_metrics(s, comp, m.sex_strength(s, comp)).join(s.select("horse_id", "bio").distinct(), "horse_id")
    return b.sex_boards(adjusted.withColumns({k: F.round(k, 6) for k in ("adjusted", "mixed", "vs_males", "vs_females")}))


INTEL = """
x as (select *, row_number() over (partition by race_id order by rating desc nulls last, result_id) expected, row_number() over (partition by race_id order by finish, result_id) actual from starts),
i as (select race_id, count(*) field_size, case when count(*) > 1 then least(100, greatest(0, (2 - 6 * sum((expected - actual) * (expected - actual)) / (count(*) * (count(*) * count(*) - 1))) * 50)) else 100 end accuracy,
 arg_min(horse_id, expected) favourite, arg_min(horse_id, actual) winner, arg_min(expected, actual) winner_expected, arg_min(actual, expected) favourite_actual, first(horse_id order by expected - actual desc, result_id) surprise, first(horse_id order by expected - actual, result_id) overrated, max(expected - actual) largest_gain from x group by 1),
intel as (select *, least(100, greatest(0, case when field_size > 1 then 100.0 * (winner_expected - 1) / (field_size - 1) else 0 end * 0.6 + (100 - accuracy) * 0.4)) shock from i)
"""


def intel(spark, d):
    return m.race_intelligence(t.starts(spark, d))


@c.query("with " + INTEL + "select race_id, field_size, round(accuracy, 4) accuracy, favourite, winner, cast(winner_expected as int) winner_expected, cast(favourite_actual as int) favourite_actual, surprise, overrated, cast(largest_gain as int) largest_gain, round(shock, 4) shock, cast(ceil(greatest(round(shock, 6), 1) / 20) as int) stars from intel")
def e17_race_intelligence(spark, d):
    """Also F7, the expected rank."""
    return intel(spark, d).withColumn("stars", F.ceil(F.greatest(F.round("shock", 6), F.lit(1.0)) / 20).cast("int")).withColumns({k: F.round(k, 4) for k in ("accuracy", "shock")})


@c.query("with " + INTEL + "select race_id, round(shock, 4) shock, winner, favourite from intel order by round(shock, 4) desc, race_id limit 20")
def g12_shockiest(spark, d):
    return intel(spark, d).select("race_id", F.round("shock", 4).alias("shock"), "winner", "favourite").orderBy(F.desc("shock"), "race_id").limit(20)


@c.query("with " + INTEL + "select race_id, favourite, winner from intel where shock >= 70")
def g07_views(spark, d):
    b.register_views(spark, t.starts(spark, d), metrics(spark, d), intel(spark, d))
    return spark.sql("select race_id, favourite, winner from v_high_shock")


@c.query("""
with dd as (select distinct owner_id, race_date from races), g as (select *, race_date - lag(race_date) over (partition by owner_id order by race_date) gap from dd), h as (select *, median(gap) over (partition by owner_id) med from g),
s as (select *, sum(case when gap > greatest(45, floor(coalesce(med, 0) / 2)) then 1 else 0 end) over (partition by owner_id order by race_date) season from h),
z as (select owner_id, season, min(race_date) first_day, max(race_date) last_day, count(*) as days from s group by 1, 2)
select owner_id, cast(season as bigint) season, first_day, last_day, days, season < max(season) over (partition by owner_id) complete, season = max(season) over (partition by owner_id) - 1 latest_complete from z
""")
def f08_seasons(spark, d):
    return m.seasons(t.races(spark, d), "owner_id").drop("season_id")


@c.query("""
with dd as (select distinct horse_id, race_date, finish from starts), r as (select *, row_number() over (partition by horse_id order by race_date desc, finish) rn from dd)
select horse_id, count(*) starts, count(*) filter (finish = 1) wins, round(avg(finish), 6) avg_finish, string_agg(cast(finish as varchar), '-' order by rn) form from r where rn <= 5 group by 1
""")
def f05_recent_form(spark, d):
    return m.recent_form(t.starts(spark, d)).withColumn("avg_finish", F.round("avg_finish", 6))


@c.query("""
select horse_id, round(avg(case when finish = 1 then 1 else 0 end), 6) win, round(avg(case when finish = 2 then 1 else 0 end), 6) as second, round(avg(case when finish = 3 then 1 else 0 end), 6) third, round(avg(case when finish <= 2 then 1 else 0 end), 6) top2,
 round(avg(case when finish <= 3 then 1 else 0 end), 6) top3, round(avg(distance / time_s), 6) avg_speed, round(max(distance / time_s), 6) best_speed from starts group by 1
""")
def e21_basic_rates(spark, d):
    out = m.basic_rates(t.starts(spark, d))
    return out.withColumns({k: F.round(k, 6) for k in out.columns if k != "horse_id"})


def offspring(spark, d):
    per = t.starts(spark, d).groupBy("horse_id", "breed").agg(F.count("*").alias("starts"), *(F.count_if(F.col("finish") == i).alias(k) for i, k in ((1, "wins"), (2, "seconds"), (3, "thirds"))))
    return per.join(t.horses(spark, d).select("horse_id", F.col("sire_id").alias("parent_id")), "horse_id")


OFFSPRING = """off as (select sire_id parent_id, breed, horse_id, count(*) starts, count(*) filter (finish = 1) wins, count(*) filter (finish = 2) as seconds, count(*) filter (finish = 3) thirds from starts join horses using (horse_id) group by all),
bv as (select parent_id, breed, count(*) offspring, count(*) filter (starts > 0) raced, count(*) filter (wins > 0) winning, cast(sum(starts) as bigint) starts, cast(sum(wins) as bigint) wins, cast(5 * sum(wins) + 2 * sum(seconds) + sum(thirds) as bigint) as value, sum(wins) / sum(starts) win_rate from off group by rollup (parent_id, breed) having parent_id is not null)
"""


@c.query("with " + OFFSPRING + "select * exclude (win_rate), round(win_rate, 6) win_rate from bv")
def e22_breeding_value(spark, d):
    return m.breeding_value(offspring(spark, d)).withColumn("win_rate", F.round("win_rate", 6))


@c.query("with " + OFFSPRING + """, k as (select *, unnest([struct_pack(b := 'value', v := case when raced >= 3 and starts >= 10 then cast(value as double) end), struct_pack(b := 'win_rate', v := case when starts >= 20 then round(win_rate, 9) end)]) x from bv where breed is not null)
select x.b board, breed, parent_id, round(x.v, 6) as value, cast(row_number() over (partition by x.b, breed order by x.v desc, starts desc, parent_id) as int) as rank from k where x.v is not null qualify rank <= 10""")
def g09_breeding_boards(spark, d):
    """By value and by win rate of the offspring, for each breed."""
    return b.breeding_boards(m.breeding_value(offspring(spark, d)).where("breed is not null")).select("board", "breed", "parent_id", F.round("value", 6).alias("value"), "rank")


@c.query("with r as (select 'sire_id' role, sire_id parent_id, horse_id from horses union all select 'dam_id', dam_id, horse_id from horses) select role, parent_id, count(distinct horse_id) offspring, count(*) starts, count(*) filter (finish = 1) wins, count(*) filter (finish <= 3) top3, round(count(*) filter (finish = 1) / count(*), 6) win_rate, round(count(*) filter (finish <= 3) / count(*), 6) top3_rate from starts join r using (horse_id) group by 1, 2")
def e23_offspring_stats(spark, d):
    """Sires and dams."""
    h = t.horses(spark, d)
    relations = h.unpivot(["horse_id"], ["sire_id", "dam_id"], "role", "parent_id")
    return u.offspring_stats(relations, t.starts(spark, d)).withColumns({k: F.round(k, 6) for k in ("win_rate", "top3_rate")})


@c.query("""
with k as (select breed, horse_id, list(distance / time_s order by distance / time_s desc)[1:3] top, count(*) n, avg(distance / time_s) avg_speed from starts where time_s between 50 and 360 and distance between 800 and 3200 and distance / time_s between 11 and 18 group by 1, 2),
p as (select breed, horse_id, n, round(top[1], 6) peak, round(list_avg(top), 6) top3, round(avg_speed, 6) avg_speed from k where n >= 3)
select *, cast(row_number() over (partition by breed order by peak desc, top3 desc, horse_id) as int) as rank from p qualify rank <= 10
""")
def g10_fastest(spark, d):
    """With C3, plausible clocks."""
    return u.fastest(t.starts(spark, d)).select("breed", "horse_id", F.col("starts").alias("n"), "peak", "top3", "avg_speed", "rank")


@c.query("""
with w as (select breed, distance, horse_id, min(round(time_s, 6)) best from starts where finish = 1 and distance in (1000, 1200, 1400, 1600, 1800, 2000, 2400) group by all)
select *, cast(row_number() over (partition by breed, distance order by best, horse_id) as int) as rank from w qualify rank <= 10
""")
def g11_distance_records(spark, d):
    return u.distance_records(t.starts(spark, d)).select("breed", "distance", "horse_id", "best", "rank")


@c.query("""
with a as (select horse_id, distance, course, date '2000-01-01' - race_date as age, greatest(0, 100.0 - 12 * (finish - 1)) p, row_number() over (partition by horse_id order by race_date desc, race_id desc, result_id desc) rn from starts where race_date < date '2000-01-01'),
s as (select horse_id, sum(p * pow(0.5, age / 365.0)) / sum(pow(0.5, age / 365.0)) career, sum(p * (6 - rn) / 5.0 * pow(0.5, age / 180.0)) filter (rn <= 5) / sum((6 - rn) / 5.0 * pow(0.5, age / 180.0)) filter (rn <= 5) recent, count(*) n from a group by 1)
select horse_id, round(career, 4) career, round(recent, 4) recent, n, round((career + recent) / 2, 4) score, case when n < 3 then 'LOW' when n < 5 then 'MEDIUM-LOW' when n < 10 then 'MEDIUM' else 'HIGH' end label from s
""")
def f11_contextual_score(spark, d):
    return m.contextual_score(t.starts(spark, d), F.lit("2000-01-01").cast("date")).withColumns({k: F.round(k, 4) for k in ("career", "recent", "score")})


@c.query("""
with l as (select horse_id, finish, race_date, 'course' dimension, course bucket from starts union all select horse_id, finish, race_date, 'distance', cast(distance as varchar) from starts)
select horse_id, dimension, bucket, count(*) starts, count(*) filter (finish = 1) wins, count(*) filter (finish = 2) as seconds, count(*) filter (finish = 3) thirds, round(avg(finish), 6) avg_finish, cast(min(finish) as int) best_finish, cast(count(distinct race_date) as int) as days from l group by 1, 2, 3
""")
def e31_record_buckets(spark, d):
    s = t.starts(spark, d).withColumn("distance", F.col("distance").cast("string"))
    return m.record_buckets(s, ["course", "distance"]).withColumn("avg_finish", F.round("avg_finish", 6))


@c.query("""
with p as (select distinct race_date from races), k as (select race_date, row_number() over (order by race_date) i, count(*) over () n, ntile(3) over (order by race_date) third from p)
select split, third, count(*) n from (select race_id, third, case when i <= floor(n * 0.7) then 'TRAIN' when i <= floor(n * 0.85) then 'VALID' else 'TEST' end split from races join k using (race_date)) group by 1, 2
""")
def f09_f12_time_split(spark, d):
    r = t.races(spark, d).select("race_id", "race_date")
    return m.time_split(r).join(m.time_thirds(r), "race_date").groupBy("split", "third").agg(F.count("*").alias("n"))


@c.query("with " + FIELD + """, mm as (select *, cast(year(last_date) as int) season from metrics where breed <> '*'), pg as (select horse_id, course, count(*) n, count(*) filter (finish = 1) w, max(race_date) as last from starts group by 1, 2),
pt as (select horse_id, first(course order by round(w / n * (1 - 0.5 / (n + 0.5)), 9) desc, last desc, course desc) track from pg group by 1), l as (select mm.horse_id, season, breed, track, unnest(['rating', 'form_5']) metric, unnest([rating, form_5]) as value from mm join pt using (horse_id)),
ca as (select horse_id, unnest(['rating', 'form_5']) metric, unnest([rating, form_5]) career from metrics where breed = '*')
select horse_id, breed, metric, round(value, 4) as value, round(avg(value) over (partition by metric, season), 4) season_avg, round(avg(value) over (partition by metric, breed), 4) breed_avg, round(avg(value) over (partition by metric, track), 4) track_avg, round(career, 4) career, round(value - avg(value) over (partition by metric, season), 4) delta from l join ca using (horse_id, metric)""")
def e19_benchmarks(spark, d):
    """Against season (of the last start), breed, preferred track and the own career."""
    mm = written(metrics(spark, d).select("horse_id", "breed", "last_date", "rating", "form_5"), "metrics")  # values and careers read it
    track = m.best_bucket(t.starts(spark, d), "horse_id", "course").select("horse_id", F.col("best").alias("track"))
    own = written(mm.where("breed != '*'").withColumn("season", F.year("last_date")).join(track, "horse_id"), "benchmarked")
    out = m.benchmarks(own, ["season", "breed", "track"], ["rating", "form_5"], mm.where("breed = '*'").select("horse_id", "rating", "form_5"))
    return out.select("horse_id", "breed", "metric", *r4("value", "season_avg", "breed_avg", "track_avg", "career", "delta"))


@c.query("with " + FIELD + """select horse_id, 'starts' feature, cast(starts as double) as value, 'v2' as version from metrics where breed = '*' union all select horse_id, 'wins', cast(wins as double), 'v2' from metrics where breed = '*'""")
def e20_feature_store(spark, d):
    mm = metrics(spark, d).where("breed = '*'").select("horse_id", F.col("starts").cast("double"), F.col("wins").cast("double"))
    old = mm.where("horse_id % 2 = 0").select("horse_id", F.lit("starts").alias("feature"), F.col("starts").alias("value"), F.lit("v2").alias("version"))
    return m.feature_store(mm, old, "v2", ["starts", "wins"])


@c.query("select count(distinct race_date) race_days, count(distinct horse_id) horses, count(distinct course) courses, count(distinct trainer_id) trainers from starts")
def e28_totals(spark, d):
    return u.totals(t.starts(spark, d))


@c.query("""
with p as (select horse_id, breed, count(*) n from starts group by 1, 2), q as (select horse_id, first(breed order by n desc, breed) breed from p group by 1) select breed, count(*) horses from q group by 1
""")
def e28_primary_breed(spark, d):
    return u.primary_breed(t.starts(spark, d)).groupBy("breed").agg(F.count("*").alias("horses"))


@c.query("with " + FIELD + """, r as (select horse_id, cast(row_number() over (order by wins desc, starts desc, horse_id) as int) as rank from metrics where breed = '*') select rank, horse_id from r where rank <= 5""")
def c04_leaderboard(spark, d):
    return b.leaderboard(b.general_boards(metrics(spark, d).withColumn("win_rate", F.col("wins") / F.col("starts"))), "Most wins", 5).select("rank", "horse_id")


@c.query("with " + FIELD + """, wx as (select course, day, precip from weather_daily), sg as (select k.*, h.birthdate, w.precip from scored k join horses h using (horse_id) left join wx w on w.course = k.course and w.day = k.race_date),
sa as (select *, case when race_date >= birthdate then round((race_date - birthdate) / 365.25, 2) end age from sg),
sl as (select *, unnest([struct_pack(s := 'breed', v := breed), struct_pack(s := 'age', v := case when age < 3 then '2yo' when age < 4 then '3yo' when age < 5 then '4yo' when age < 7 then '5-6yo' when age is not null then '7yo+' end), struct_pack(s := 'class', v := name[1]), struct_pack(s := 'distance', v := case when distance < 1200 then 'sprint' when distance < 1600 then 'mile' when distance < 2000 then 'mid' else 'staying' end),
 struct_pack(s := 'track', v := case when precip > 3 then 'wet' when precip is not null then 'dry' end), struct_pack(s := 'weather', v := case when precip > 10 then 'rain' when precip is not null then 'fair' end), struct_pack(s := 'young', v := case when age >= 2 and age < 4 then '2-3yo' end)]) x from sa),
sk as (select x.s segment, x.v as value, horse_id, race_date, finish, q, si, di, row_number() over (partition by x.s, x.v, horse_id order by race_date desc, race_id desc, result_id desc) rn from sl where x.v is not null),
sm as (select segment, value, horse_id, count(*) starts, count(*) filter (finish = 1) wins, count(*) filter (finish = 2) as seconds, count(*) filter (finish = 3) thirds, avg(finish) af, stddev_pop(finish) sd, avg(si) si, avg(di) di, sum(q * pow(0.75, rn - 1)) filter (rn <= 5) / sum(pow(0.75, rn - 1)) filter (rn <= 5) f5 from sk group by all having count(*) >= 3),
sr as (select *, (18 * 100.0 * wins / starts + 8 * 100.0 * seconds / starts + 5 * 100.0 * thirds / starts + 15 * 100.0 * (wins + seconds + thirds) / starts + 15 * least(100, greatest(0, 120 - 12.5 * af)) + 12 * least(100, 100 * exp(-sd / 2.5)) + 12 * di + 10 * f5 + 5 * least(100, si)) / 100 rating from sm)
select segment, value, horse_id, cast(row_number() over (partition by segment, value order by round(rating, 6) desc, wins desc, starts desc, horse_id) as int) as rank from sr qualify rank <= 10
""")
def g06_segment_boards(spark, d):
    """Seven segments; metrics are computed within each, from exploded labels and not in a loop."""
    sky = t.weather_daily(spark, d).select("course", F.col("day").alias("race_date"), "precip")
    # a row for each course and day: the calendar bounds it
    s = m.with_field(t.starts(spark, d)).join(F.broadcast(sky), ["course", "race_date"], "left")
    s = s.select("horse_id", "race_id", "result_id", "race_date", "finish", "earnings", "time_s", "distance", "mean_speed", "mean_rating", "field_size", "breed", "name", "precip").repartition(partitions(spark), "horse_id")
    s = s.join(t.horses(spark, d).select("horse_id", "birthdate"), "horse_id")
    age, rain = x.age_years(F.col("birthdate"), F.col("race_date")), F.col("precip")
    labels = {
        "breed": F.col("breed"), "age": F.when(age.isNotNull(), x.age_band(age)), "class": F.substring("name", 1, 1), "distance": x.distance_bucket(F.col("distance")), "track": F.when(rain > 3, "wet").when(rain.isNotNull(), "dry"),
        "weather": F.when(rain > 10, "rain").when(rain.isNotNull(), "fair"), "young": F.when((age >= 2) & (age < 4), "2-3yo"),
    }
    return b.segment_boards(s, labels).select("segment", "value", "horse_id", "rank")
