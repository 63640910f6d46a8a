"""Queries over the column functions."""

from pyspark.sql import functions as F

from ..functions import scalars as x
from ..sources import tables as t
from .common import Catalogue

c = Catalogue()
QUERIES, SQL = c.queries, c.sql


@c.query("""
select race_id, distance_bucket, age_years, age_band, finish_quality, finish_points, result_id from (
select result_id, starts.race_id, case when distance < 1200 then 'sprint' when distance < 1600 then 'mile' when distance < 2000 then 'mid' else 'staying' end distance_bucket,
 case when race_date >= birthdate then round((race_date - birthdate) / 365.25, 2) end age_years, least(100.0, greatest(0.0, 120.0 - 20.0 * finish)) finish_quality, greatest(0.0, 100.0 - 12.0 * (finish - 1)) finish_points,
 case when race_date < birthdate then 'unknown' when round((race_date - birthdate) / 365.25, 2) < 3 then '2yo' when round((race_date - birthdate) / 365.25, 2) < 4 then '3yo' when round((race_date - birthdate) / 365.25, 2) < 5 then '4yo' when round((race_date - birthdate) / 365.25, 2) < 7 then '5-6yo' else '7yo+' end age_band
from starts join horses using (horse_id))
""")
def b04_b06_distance_age_finish(spark, d):
    s = t.starts(spark, d).join(t.horses(spark, d).select("horse_id", "birthdate"), "horse_id").withColumn("age_years", x.age_years(F.col("birthdate"), F.col("race_date")))
    return s.select("result_id", "race_id", x.distance_bucket(F.col("distance")).alias("distance_bucket"), "age_years", x.age_band(F.col("age_years")).alias("age_band"), x.finish_quality(F.col("finish")).alias("finish_quality"), x.finish_points(F.col("finish")).alias("finish_points"))


@c.query("""
with k as (select event_id, user_id % 4 kind, value from events), r as (select event_id, case kind when 0 then cast(value as varchar) when 1 then (event_id % 5) || ':' || value when 2 then '1:' || (event_id % 5) || ':' || value else 'x' || value end raw, kind, value from k)
select event_id, round(case kind when 0 then value when 1 then (event_id % 5) * 60 + value when 2 then 3600 + (event_id % 5) * 60 + value end, 4) as seconds from r
""", base=True)
def b01_time_seconds(spark, d):
    e = t.read(spark, d, "events")
    kind, five, v = F.col("user_id") % 4, (F.col("event_id") % 5).cast("string"), F.col("value").cast("string")
    raw = F.when(kind == 0, v).when(kind == 1, F.concat_ws(":", five, v)).when(kind == 2, F.concat_ws(":", F.lit("1"), five, v)).otherwise(F.concat(F.lit("x"), v))
    return e.select("event_id", F.round(x.time_seconds(raw), 4).alias("seconds"))


@c.query("""
select result_id, case finish when 1 then prize when 2 then prize / 2 else 0 end prize from results join (select race_id, round(prize, 2) prize from races) using (race_id)
""")
def b02_prize_for(spark, d):
    races = t.races(spark, d).select("race_id", F.round("prize", 2).alias("prize"))
    item = lambda rank, amount: F.struct(F.lit(rank).alias("rank"), amount.alias("prize"))
    text = F.to_json(F.struct(F.array(item(1, F.col("prize")), item(2, F.col("prize") / 2)).alias("prizes")))
    return t.results(spark, d).select("result_id", "race_id", "finish").join(races.select("race_id", x.prize_map(text).alias("prizes")), "race_id").select("result_id", x.prize_for(F.col("prizes"), F.col("finish")).alias("prize"))


@c.query(r"""
with k(i, label, klass) as (values (0, 'کلاس4(85-71)', 'class4'), (1, 'گروه 1', 'group1'), (2, 'گروه 1و2', 'group1_2'), (3, 'مبتدی/نبرده', 'maiden'), (4, 'Cup (G2)', 'g2'), (5, 'از 40 تا 60', 'handicap_band'), (6, '3 year filly stakes', 'other'))
select race_id, klass race_class, case when i = 6 then '3yo' end age_restriction, case when i = 6 then 'filly' end sex_restriction, case when klass = 'class4' then 0 when klass = 'group1' then 25 when klass = 'group1_2' then 18 when klass = 'g2' then 15 else 0 end points
from races join k on race_id % 7 = i
""")
def b03_b21_race_class(spark, d):
    labels = F.array(*map(F.lit, ("کلاس4(85-71)", "گروه 1", "گروه 1و2", "مبتدی/نبرده", "Cup (G2)", "از 40 تا 60", "3 year filly stakes")))
    r = t.races(spark, d).select("race_id", F.element_at(labels, (F.col("race_id") % 7 + 1).cast("int")).alias("label")).withColumn("race_class", x.race_class(F.col("label")))
    return r.select("race_id", "race_class", x.age_restriction(F.col("label")).alias("age_restriction"), x.sex_restriction(F.col("label")).alias("sex_restriction"), x.class_points(F.col("race_class")).alias("points"))


@c.query("""
with w as (select *, cast(floor(humidity * 37) as int) % 100 code from weather_daily),
f as (select *, temp * 9.0 / 5.0 + 32.0 f, least(100.0, greatest(0.0, humidity)) rh from w),
k as (select *, case when code = 0 then 'clear' when code = 1 then 'mainly_clear' when code = 2 then 'partly_cloudy' when code = 3 then 'overcast' when code in (45, 48) then 'fog' when code in (51, 53, 55) then 'drizzle'
  when code in (56, 57) then 'freezing_drizzle' when code in (61, 63, 65) then 'rain' when code in (66, 67) then 'freezing_rain' when code in (71, 73, 75, 77) then 'snow' when code in (80, 81, 82) then 'rain_showers'
  when code in (85, 86) then 'snow_showers' when code in (95, 96, 99) then 'thunderstorm' else 'code_' || code end cond from f)
select course, day, cond condition, case when cond in ('clear', 'mainly_clear') then 'clear' when cond in ('partly_cloudy', 'overcast') then 'cloudy' when cond = 'thunderstorm' then 'storm' when cond = 'fog' then 'fog' when cond like '%snow%' then 'snow'
   when regexp_matches(cond, 'rain|drizzle|shower') or precip > 0.2 then 'precip' else 'unknown' end category,
 round(case when f < 80.0 then temp else ((-42.379 + 2.04901523 * f + 10.14333127 * rh - 0.22475541 * f * rh - 6.83783e-3 * f * f - 5.481717e-2 * rh * rh + 1.22874e-3 * f * f * rh + 8.5282e-4 * f * rh * rh - 1.99e-6 * f * f * rh * rh) - 32.0) * 5.0 / 9.0 end, 3) heat_index,
 case when temp < 10 then 'cold' when temp < 18 then 'cool' when temp < 25 then 'mild' when temp < 32 then 'warm' else 'hot' end temp_range,
 ['N','NNE','NE','ENE','E','ESE','SE','SSE','S','SSW','SW','WSW','W','WNW','NW','NNW'][cast(floor(((humidity * 7) % 360 + 11.25) / 22.5) as int) % 16 + 1] compass from k
""")
def b07_b11_weather(spark, d):
    w = t.weather_daily(spark, d).withColumn("code", F.floor(F.col("humidity") * 37).cast("int") % 100).withColumn("condition", x.wmo_condition(F.col("code")))
    return w.select("course", "day", "condition", x.weather_category(F.col("condition"), F.col("precip")).alias("category"), x.heat_index_c(F.col("temp"), F.col("humidity")).alias("heat_index"), x.temp_range(F.col("temp")).alias("temp_range"), x.wind_compass(F.col("humidity") * 7).alias("compass"))


@c.query("""
with w as (select *, precip / 2 as p1, precip * 1.5 as d3, precip * 3 as d7 from weather_daily)
select course, day, case when p1 >= 5 or d3 >= 25 then 'muddy' when p1 >= 2 or d3 >= 12 then 'wet' when d3 >= 4 or d7 >= 15 then 'soft' when d3 >= 1 or p1 >= 0.2 then 'firm' else 'dry' end track_condition,
 round(0.45 * (1 - exp(-p1 / 4.0)) + 0.35 * (1 - exp(-d3 / 12.0)) + 0.20 * (1 - exp(-d7 / 25.0)), 4) moisture from w
""")
def b09_b10_track_condition(spark, d):
    p = F.col("precip")
    return t.weather_daily(spark, d).select("course", "day", x.track_condition(p / 2, p * 1.5, p * 3).alias("track_condition"), x.surface_moisture(p / 2, p * 1.5, p * 3).alias("moisture"))


@c.query("""
select horse_id, trim(regexp_replace(regexp_replace(lower(name || ' #' || (horse_id % 9) || ' كy'), '[^a-z0-9ک]+', ' ', 'g'), ' +', ' ', 'g')) plain from (select horse_id, name from horses) where false
union all select horse_id, trim(regexp_replace(lower(replace(name, '#', ' ')), '[^a-z0-9]+', ' ', 'g')) || ' کی' || (horse_id % 9) from horses
""")
def b12_normalize_name(spark, d):
    h = t.horses(spark, d)
    nine = F.translate((F.col("horse_id") % 9).cast("string"), "0123456789", "۰۱۲۳۴۵۶۷۸۹")
    return h.select("horse_id", x.normalize_name(F.concat(F.upper("name"), F.lit(" (كي"), nine, F.lit(")"))).alias("plain"))


@c.query("""
with h as (select horse_id, sex, round((date '1999-12-31' - birthdate) / 365.25, 2) age from horses)
select horse_id, sex normal, case when sex = 'male' then case when age < 4.999 then 'Colt' else 'Stallion' end else case when age < 4.999 then 'Filly' else 'Mare' end end bio from h
""")
def b13_sex(spark, d):
    h = t.horses(spark, d).withColumn("age", x.age_years(F.col("birthdate"), F.lit("1999-12-31").cast("date")))
    return h.select("horse_id", x.normalize_sex(F.initcap("sex")).alias("normal"), x.bio_sex(F.col("sex"), F.col("age")).alias("bio"))


@c.query("""
with j as (select race_date, race_date - date '1600-03-20' n from (select distinct race_date from races)),
k as (select race_date, cast(floor(n / 12053) as int) cy, n % 12053 r from j), l as (select *, r // 1461 q, r % 1461 f from k),
m as (select *, 979 + 33 * cy + 4 * q + case when f >= 366 then (f - 1) // 365 else 0 end y, case when f >= 366 then (f - 1) % 365 else f end dd from l),
n as (select race_date, y, case when dd < 186 then dd // 31 + 1 else (dd - 186) // 30 + 7 end m, case when dd < 186 then dd % 31 + 1 else (dd - 186) % 30 + 1 end d from m)
select race_date, cast(y as int) y, cast(m as int) m, cast(d as int) d, printf('%04d/%02d/%02d', y, m, d) jalali, race_date back, cast(race_date - cast(d - 1 as int) as date) as first from n
""")
def b14_jalali(spark, d):
    p = t.races(spark, d).select("race_date").distinct().withColumn("p", x.jalali_ymd(F.col("race_date")))
    y, m, day = F.col("p.y"), F.col("p.m"), F.col("p.d")
    return p.select("race_date", y.alias("y"), m.alias("m"), day.alias("d"), x.jalali_text(F.col("race_date")).alias("jalali"), x.from_jalali(y, m, day).alias("back"), x.jalali_bounds(y, m)["first"].alias("first"))


@c.query("""
with s as (select horse_id, count(*) n, count(*) filter (finish = 1) w from starts group by 1), p as (select sum(w) / sum(n) prior from s)
select horse_id, case when n < 3 then 'LOW' when n < 5 then 'MEDIUM-LOW' when n < 10 then 'MEDIUM' else 'HIGH' end reliability, round((w + 5 * prior) / (n + 5), 6) smoothed,
 round(least(0.5 * case when n = 1 then 20 when n = 2 then 40 when n <= 4 then 60 when n <= 9 then 85 else 95 end + 0.25 * 0.9 * 100 + 25, case when n = 1 then 35 when n = 2 then 55 when n <= 4 then 75 else 100 end), 4) confidence,
 case when n < 5 then 'limited_sample' else 'good' end quality, round((w * 2 + 3.0 * n) / 5, 6) mean_present from s cross join p
""")
def b18_b20_reliability(spark, d):
    s = t.starts(spark, d).groupBy("horse_id").agg(F.count("*").alias("n"), F.count_if(F.col("finish") == 1).alias("w"))
    prior = s.agg((F.sum("w") / F.sum("n")).alias("prior"))  # one row
    n, w = F.col("n"), F.col("w")
    return s.crossJoin(F.broadcast(prior)).select("horse_id", x.reliability(n).alias("reliability"), F.round(x.eb_rate(w, n, F.col("prior")), 6).alias("smoothed"), F.round(x.confidence(n, F.lit(0.1), F.lit(1.0)), 4).alias("confidence"), x.dq_label(F.lit(0.1), n).alias("quality"),
                                                   F.round(x.weighted_present([(2.0, w), (3.0, n), (9.0, F.lit(None).cast("double"))]), 6).alias("mean_present"))


@c.query("""
select page_id, regexp_matches(url, '^https?://[^/\\s?#]+') ok_url, regexp_matches((page_id % 3) || ':' || page_id || '.5', '^(\\d+:)?\\d{1,3}(\\.\\d+)?$') ok_clock from pages
""", base=False)
def b22_validity(spark, d):
    p = t.read(spark, d, "pages")
    return p.select("page_id", x.is_valid_url(F.col("url")).alias("ok_url"), x.is_valid_clock(F.concat((F.col("page_id") % 3).cast("string"), F.lit(":"), F.col("page_id").cast("string"), F.lit(".5"))).alias("ok_clock"))
