"""Queries over ingest, calendars, sets, quality and identity."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars as x
from ..operators import identity as ids
from ..operators import permanent as pm
from ..operators import ingest as i
from ..operators import quality as q
from ..operators import summaries as u
from ..operators import tracks as tr
from ..operators.graph import connected_components
from ..sources import tables as t
from ..sources.store import written as keep
from .common import Catalogue

c = Catalogue()
QUERIES, SQL = c.queries, c.sql


@c.query("""
with o as (select user_id k, value, ts, event_id, lag(value) over w pv, row_number() over w r from events window w as (partition by user_id order by ts, event_id)),
v as (select *, row_number() over (partition by k order by ts, event_id) version from o where r = 1 or value <> pv)
select k, value, cast(version as int) version, version = max(version) over (partition by k) is_current from v
""", base=False)
def a04_scd2_append(spark, d):
    """With A5; two batches give the same table as one."""
    e = t.read(spark, d, "events").select(F.col("user_id").alias("k"), "value", F.struct("ts", "event_id").alias("at"))
    first = i.scd2_append(None, e.where("at.ts < timestamp'2024-01-10'"), ["k"], ["value"], "at")
    return i.scd2_append(first, e.where("at.ts >= timestamp'2024-01-10'"), ["k"], ["value"], "at").select("k", "value", "version", "is_current")


@c.query("select event_type kind, user_id source_key, event_id, value from events qualify row_number() over (partition by event_type, user_id order by ts desc, event_id desc) = 1", base=False)
def a06_latest_by(spark, d):
    return i.latest_by(t.snapshots(spark, d), ["kind", "source_key"], "captured_at", "event_id").select("kind", "source_key", "event_id", "value")


@c.query("select trim(s_name) as name, count(*) n from lineitem join supplier on l_suppkey = s_suppkey group by 1", base=False)
def a07_build_warehouse(spark, d):
    s = t.read(spark, d, "supplier").select("s_suppkey", F.concat(F.lit(" "), "s_name").alias("trainer"))
    w = i.build_warehouse(t.read(spark, d, "lineitem").select("l_suppkey").join(s, F.col("l_suppkey") == F.col("s_suppkey")), {"trainer": "trainer"})
    return w["results"].groupBy("trainer_id").agg(F.count("*").alias("n")).join(w["trainer"], "trainer_id").select("name", "n")


@c.query("select o_orderkey race_id, 'u' || (o_orderkey % 50) url, 'photo' kind from orders union all select o_orderkey, 'v' || (o_orderkey % 9), 'video' from orders", base=False)
def a08_explode_media(spark, d):
    item = lambda u, k: F.struct(u.alias("url"), F.lit(k).alias("kind"))
    u, v = F.concat(F.lit("u"), (F.col("o_orderkey") % 50).cast("string")), F.concat(F.lit("v"), (F.col("o_orderkey") % 9).cast("string"))
    r = t.read(spark, d, "orders").select(F.col("o_orderkey").alias("race_id"), F.to_json(F.array(item(u, "photo"), item(v, "video"), item(u, "video"), item(F.lit(None).cast("string"), "x"))).alias("media"))
    return i.explode_media(r)


@c.query("""
with h as (select page_id, regexp_extract(url, '^(https?://[^/?#]+)', 1) host, unnest(regexp_extract_all(html, 'href="([^"#]*)(?:#[^"]*)?"', 1)) href from pages)
select distinct page_id, case when regexp_matches(href, '^https?://') then href when href like '/%' then host || href else host || '/' || href end link from h where href <> ''
""", base=False)
def a09_page_links(spark, d):
    return i.page_links(t.read(spark, d, "pages"))


@c.query("select page_id, page_id % 7 as a, 'x\"{' || page_id as b from pages", base=False)
def a10_page_json(spark, d):
    data = F.to_json(F.struct((F.col("page_id") % 7).alias("a"), F.concat(F.lit('x"{'), F.col("page_id").cast("string")).alias("b")))
    p = t.read(spark, d, "pages").select("page_id", F.concat("html", F.lit("<script>window.__STATE__ = "), data, F.lit("; f({});</script>")).alias("html"))
    return i.page_json(p, "window.__STATE__", "struct<a:long,b:string>").select("page_id", "data.a", "data.b")


@c.query("""
with e as (select l_orderkey, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) cloth, l_partkey, 1 + l_quantity / 20 odds from lineitem)
select l_orderkey race_id, cast(cloth as int) cloth, l_partkey horse_id, round(odds, 6) odds from e
""", base=False)
def a11_market_entries(spark, d):
    r = t.results(spark, d).withColumn("odds", 1 + F.col("quantity") / 20)
    runners = r.groupBy("race_id").agg(F.collect_list(F.struct("cloth", "horse_id", "odds")).alias("h"))
    cards = runners.select(F.col("race_id").alias("source_key"), F.to_json(F.struct(F.array(F.struct(F.col("race_id").alias("id"), F.lit(1).alias("number"), F.col("h").alias("race_horses"))).alias("races"))).alias("payload"))
    both = cards.withColumn("captured_at", F.lit(2)).unionByName(cards.select("source_key", F.lit('{"races":[]}').alias("payload"), F.lit(1).alias("captured_at"))).withColumn("event_id", F.col("source_key"))
    return i.market_entries(both)["entries"].select("race_id", "cloth", "horse_id", F.round("odds", 6).alias("odds"))


@c.query("select event_id, 'pishbar' market, 1 cloth, value odds from events where value > 0 union all select event_id, 'pishbar', 2, value + 1 from events where value > 0", base=False)
def a12_pick_odds(spark, d):
    odd = lambda n, v: F.struct(F.lit(n).alias("runnerId"), v.alias("odd"))
    v = F.col("value")
    market = lambda *o: F.create_map(*[y for k, s in enumerate(o, 1) for y in (F.lit(str(k)), s)])
    payload = F.to_json(F.create_map(F.lit("miyanbar"), market(odd(1, v), odd(2, v), odd(3, v)), F.lit("pishbar"), market(odd(1, v), odd(2, v + 1))))
    return i.pick_odds(t.read(spark, d, "events").where("value > 0").select("event_id", payload.alias("p")), "p", "event_id")


@c.query("select event_id, 1 cloth, value votes from events union all select event_id, 2, value * 2 from events", base=False)
def a13_pick_survey(spark, d):
    v = F.col("value")
    payload = F.concat(F.lit('[{"horse_num":1,"count":'), v.cast("string"), F.lit('},{"runnerId":2,"votes":'), (v * 2).cast("string"), F.lit("}]"))
    return i.pick_survey(t.read(spark, d, "events").select("event_id", payload.alias("p")), "p", "event_id")


@c.query("select count(*) as rows, count(distinct race_id) races, min(race_date) as first, max(race_date) as last from starts")
def a14_freeze(spark, d):
    s = t.starts(spark, d)
    f = i.fingerprint(s.select("result_id", "finish"))
    return f.crossJoin(s.agg(F.countDistinct("race_id").alias("races"), F.min("race_date").alias("first"), F.max("race_date").alias("last"))).select("rows", "races", "first", "last")


@c.query("""
select race_id, round(coalesce(sum(precip) filter (race_date - day <= 3), 0), 6) rain_3, round(coalesce(sum(precip), 0), 6) rain_7, round(avg(temp) filter (race_date - day <= 3), 3) temp_3
from races left join weather_daily w on races.course = w.course and w.day between race_date - 7 and race_date - 1 group by 1
""")
def d04_trailing_weather(spark, d):
    return q.trailing_weather(t.races(spark, d), t.weather_daily(spark, d)).withColumns({"rain_3": F.round("rain_3", 6), "rain_7": F.round("rain_7", 6), "temp_3": F.round("temp_3", 3)})


@c.query("select event_id, case when event_id % 24 % 3 = 0 then value when event_id % 24 % 3 = 1 then value + 1 else value + 2 end picked from events where false union all select event_id, value + 14 from events", base=False)
def d05_hour_snapshot(spark, d):
    hours = F.sequence(F.lit(0), F.lit(23))
    e = t.read(spark, d, "events").select("event_id", hours.alias("hours"), F.transform(hours, lambda h: F.col("value") + h).alias("temps"))
    return e.select("event_id", q.hour_snapshot(e, "hours", "temps", 14).alias("picked"))


@c.query("""
with need as (select distinct course, cast(u.d as date) as day from races, unnest(generate_series(cast(race_date as timestamp) - interval 2 day, cast(race_date as timestamp), interval 1 day)) as u(d)),
g as (select need.* from need anti join weather_daily w on need.course = w.course and need.day = w.day), k as (select *, day - cast(row_number() over (partition by course order by day) as int) island from g)
select course, min(day) as first, max(day) as last, count(*) as days from k group by course, island
""")
def d14_missing_ranges(spark, d):
    return q.missing_ranges(t.races(spark, d), t.weather_daily(spark, d), 2)


@c.query("select horse_id, cast(1 as bigint) n from horses where horse_id not in (select horse_id from results) union all select -1, count(*) from races where race_id not in (select race_id from results)")
def d09_orphans(spark, d):
    r = t.results(spark, d)
    return q.orphans(t.horses(spark, d), r, "horse_id").select("horse_id", F.lit(1).cast("long").alias("n")).unionByName(q.orphans(t.races(spark, d), r, "race_id").agg(F.lit(-1).cast("long").alias("horse_id"), F.count("*").alias("n")))


@c.query("""
with e as (select race_id event_id, case when race_id % 2 = 0 then race_id end external_id, race_date, course[1:8] prefix from races), d as (select race_date, course[1:8] prefix, min(race_id) m from races group by 1, 2)
select event_id, coalesce(external_id, m) race_id, case when external_id is not null then 1 else 2 end tier from e left join d using (race_date, prefix)
""")
def d11_link_events(spark, d):
    r = t.races(spark, d)
    e = r.select(F.col("race_id").alias("event_id"), F.when(F.col("race_id") % 2 == 0, F.col("race_id")).alias("external_id"), F.col("race_date").alias("event_date"), F.substring("course", 1, 8).alias("prefix"))
    return q.link_events(e, r)


@c.query("""
with f as (select race_id, result_id, horse_id, race_date, lag(race_date) over (partition by horse_id order by race_date, race_id, result_id) p from starts),
g as (select distinct horse_id, race_date from starts), h as (select *, lag(race_date) over (partition by horse_id order by race_date) b from g)
select f.result_id, cast(f.race_date - h.b as int) rest_days from f join h using (horse_id, race_date)
""")
def d08_rest_days(spark, d):
    """As-of, strictly before: distinct dates of a horse, one window, joined back on the same key."""
    s = t.starts(spark, d).select("result_id", "horse_id", "race_date")
    days = s.select("horse_id", "race_date").distinct().withColumn("before", F.lag("race_date").over(Window.partitionBy("horse_id").orderBy("race_date")))
    return s.join(days, ["horse_id", "race_date"]).select("result_id", F.datediff("race_date", "before").alias("rest_days"))


def months(spark, d):
    r = t.races(spark, d).select("race_id", "race_date", "course", "distance")
    return r.withColumn("year", F.year("race_date")).withColumn("month", F.month("race_date"))


COVER = """
mm as (select *, cast(year(race_date) as int) y, cast(month(race_date) as int) m from races),
grid as (select y.y, u.m, c.city from (select distinct y from mm) y, unnest(range(1, 13)) u(m), (select distinct course city from races) c),
have as (select y, m, course city, count(distinct race_date) as days, count(*) heats from mm group by 1, 2, 3), act as (select y, m, count(distinct course) cities from mm group by 1, 2),
cells as (select y as year, cast(m as int) as month, city, coalesce(days, 0) as days, coalesce(heats, 0) heats, case when days > 0 then 'CONFIRMED_RACE' when make_date(y, m, 1) > date '2001-01-01' then 'CONFIRMED_NO_RACE' when cities > 0 then 'MISSING_DATA' else 'UNRESOLVED' end status
  from grid left join have using (y, m, city) left join act using (y, m))
"""


def cells(spark, d):
    r = months(spark, d)
    grid = q.calendar_grid(r.select("year").distinct(), t.races(spark, d).select(F.col("course").alias("city")).distinct())
    return q.coverage_matrix(grid, r, F.lit("2001-01-01").cast("date"))


@c.query("with " + COVER + "select * from cells")
def q09_coverage_matrix(spark, d):
    """With D13, over all races; cells without one are made in a test."""
    return cells(spark, d)


@c.query("with " + COVER + """select year, count(*) cells, count(*) filter (status = 'CONFIRMED_RACE') race, count(*) filter (status = 'MISSING_DATA') missing, count(*) filter (status = 'UNRESOLVED') unresolved,
 round(count(*) filter (status = 'CONFIRMED_RACE') / nullif(count(*) filter (status in ('CONFIRMED_RACE', 'MISSING_DATA')), 0), 6) proven, cast(sum(days) as bigint) as days, cast(sum(heats) as bigint) heats, count(distinct city) filter (heats > 0) cities from cells group by rollup (year)""")
def q10_q11_coverage_metrics(spark, d):
    return q.coverage_metrics(cells(spark, d)).withColumn("proven", F.round("proven", 6))


@c.query("with " + COVER + """, s as (select *, max(case when status = 'CONFIRMED_RACE' then 1 else 0 end) over (partition by city, month) seasonal from cells)
select year, month, city, case when status = 'MISSING_DATA' and seasonal = 1 then 'P0' when seasonal = 1 then 'P1' when status = 'MISSING_DATA' then 'P2' else 'P3' end priority from s where status in ('MISSING_DATA', 'UNRESOLVED')""")
def q12_prioritise(spark, d):
    return q.prioritise(cells(spark, d)).select("year", "month", "city", "priority")


@c.query("with " + COVER + """, e as (select y as year, m as month, course city, count(distinct race_date) ed, count(*) en from (select *, cast(year(race_date) as int) y, cast(month(race_date) as int) m from races) group by 1, 2, 3)
select year, month, city, case when make_date(year, month, 1) > date '2001-01-01' then 'CONFIRMED_NO_RACE' when en > 0 then 'MISSING_DATA' else 'UNRESOLVED' end status, coalesce(ed, 0) evidence_days, case when ed > 1 then 0.92 when en > 0 then 0.78 end confidence
from cells left join e using (year, month, city) where cells.days = 0""")
def q15_classify_cells(spark, d):
    e = months(spark, d).select("year", "month", F.col("course").alias("city"), F.col("race_date").alias("day"), F.col("race_date").cast("string").alias("url"), F.col("race_id").alias("horse_id"), F.lit(1).alias("round"))
    return q.classify_cells(cells(spark, d), e, F.lit("2001-01-01").cast("date"))


@c.query("""
with i as (select 'no_rating' as "check", 'warning' severity, result_id id from results where rating is null union all select 'light', 'error', result_id from results where weight < 51 union all select 'late', 'warning', result_id from results where finish > 8)
select "check", case when count(*) filter (severity = 'error') > 0 then 'error' else 'warning' end status, count(*) issues from i group by 1
""")
def q01_q03_row_checks(spark, d):
    rules = {"no_rating": ("warning", F.col("rating").isNull()), "light": ("error", F.col("weight") < 51), "late": ("warning", F.col("finish") > 8)}
    return q.dq_summary(q.row_checks(t.results(spark, d), "result", "result_id", rules))


@c.query("select race_date, course, count(*) copies from races group by 1, 2 having count(*) > 1")
def q02_duplicates(spark, d):
    return q.duplicates(t.races(spark, d), ["race_date", "course"])


@c.query("""
with n as (select race_id, count(*) k from results group by 1), r as (select races.race_date, races.course, race_id, coalesce(k, 0) results, row_number() over w rn, first(race_id) over w keeper, count(*) over (partition by race_date, course) copies from races left join n using (race_id) window w as (partition by race_date, course order by coalesce(k, 0) desc, race_id))
select race_date, course, race_id, results, keeper, rn = 1 kept from r where copies > 1
""")
def q05_dedupe_plan(spark, d):
    """With Q4's duplicate keys."""
    return q.dedupe_plan(t.races(spark, d), ["race_date", "course"], t.results(spark, d))


@c.query("select race_id, breed value_a, breed || 'x' value_b, 'site' preferred from races where race_id % 5 = 0")
def q06_conflicts(spark, d):
    r = t.races(spark, d)
    a = r.select("race_id", "breed", F.lit("site").alias("source"))
    other = r.select("race_id", F.when(F.col("race_id") % 5 == 0, F.concat("breed", F.lit("x"))).otherwise(F.col("breed")).alias("breed"), F.lit("club").alias("source"))
    return q.conflicts(a, other, "race_id", "breed", spark.createDataFrame([("site", 1), ("club", 2)], "source string, priority int"))


@c.query("select 'rating' as \"column\", round(avg(case when rating is not null then 1 else 0 end), 6) filled from results union all select 'weight', 1.0 union all select 'finish', 1.0")
def q16_fill_audit(spark, d):
    return q.fill_audit(t.results(spark, d), ["rating", "weight", "finish"]).withColumn("filled", F.round("filled", 6))


def registry(spark, d):
    """Courses with a 1 in their number are registered under their upper-case name and one more alias; straights follow from the number."""
    own = t.races(spark, d).select("course").distinct().where(F.col("course").contains("1"))
    number = F.regexp_extract("course", "[0-9]+", 0).cast("int")
    both = own.select(F.concat(F.lit("reg-"), number.cast("string")).alias("code"), F.explode(F.array(F.upper(F.replace("course", F.lit("_"), F.lit(" "))), F.concat(F.lit("venue "), number.cast("string")))).alias("alias"), (150 + number * 15).alias("straight_m"))
    return both.select("code", "alias"), both.where("code != 'reg-1'").select("code", "straight_m").distinct()


def coded(spark, d):
    label = F.when(F.col("race_id") % 7 == 0, F.concat(F.lit("Venue-"), F.regexp_extract("course", "[0-9]+", 0))).otherwise(F.col("course"))
    return tr.resolve_course(t.races(spark, d).withColumn("course", label), registry(spark, d)[0])


COURSES = """
lb as (select race_id, race_date, course raw, cast(regexp_extract(course, '[0-9]+') as int) num, case when race_id % 7 = 0 then 'Venue-' || regexp_extract(course, '[0-9]+') else course end label from races),
co as (select *, case when raw like '%1%' then 'reg-' || num else lower(replace(label, '_', '-')) end code, raw like '%1%' known, case when raw like '%1%' and num <> 1 then 150 + num * 15 end straight_m from lb)
"""


@c.query("with " + COURSES + "select race_id, code, known, straight_m straight_length_m, case when straight_m < 200 then 'Short' when straight_m <= 275 then 'Medium' when straight_m is not null then 'Long' end straight_category, straight_m is not null config_applied from co")
def b15_b16_resolve_course(spark, d):
    """Tracks by normalised alias of a registry, else a synthetic code; straight lengths only where configured."""
    return tr.track_config(coded(spark, d), registry(spark, d)[1]).select("race_id", "code", "known", "straight_length_m", "straight_category", "config_applied")


@c.query("with k as (select distinct cast(regexp_extract(course, '[0-9]+') as int) num from races where course like '%1%') select 'reg-' || num code, case when num <> 1 then 150 + num * 15 end current_m, 150 + num * 15 + case when num % 2 = 0 then 5 else 0 end proposed_m, case when num = 1 then 'unknown_track' when num % 2 = 0 then 'conflict_reported' else 'unchanged' end status, false applied from k")
def b16_propose_config(spark, d):
    aliases, config = registry(spark, d)
    number = F.substring_index("code", "-", -1).cast("int")
    return tr.propose_config(config, aliases.select("code").distinct().select("code", (150 + number * 15 + F.when(number % 2 == 0, 5).otherwise(0)).alias("proposed_m")))


@c.query("with " + COURSES + """, n as (select race_id, count(*) n from results group by 1), r as (select co.*, coalesce(n, 0) n, case when straight_m is not null then code end track from co left join n using (race_id)), v as (select track, label, count(*) heats, sum(n) rs from r group by 1, 2),
g as (select track, cast(sum(heats) as bigint) heats, cast(sum(rs) as bigint) results, string_agg(label || ':' || heats, ',' order by label) variants from v group by 1), y as (select track, count(*) as days from (select distinct track, race_date, label from r) group by 1)
select g.track, heats, results, variants, y.days, round(heats / (select count(*) from races), 6) share from g join y on g.track is not distinct from y.track""")
def q17_track_match(spark, d):
    """Days, heats, results and name variants of each configured track; what is unmatched stands under a null track."""
    r = coded(spark, d)
    out = tr.track_match(r, t.results(spark, d), registry(spark, d)[1])
    text = F.array_join(F.transform(F.map_entries("variants"), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string"))), ",")
    return out.select("track", "heats", "results", text.alias("variants"), "days", F.round("share", 6).alias("share"))


@c.query("""
with o as (select *, [temp - 3, temp, temp + 2, temp - 1] temps from weather_daily), b as (select race_id, races.course, race_date, unnest(range(1, 8)) as back from races),
tr as (select race_id, sum(case when back <= 3 then coalesce(precip, 0) else 0 end) rain_3, sum(coalesce(precip, 0)) rain_7 from b left join weather_daily w on w.course = b.course and w.day = b.race_date - cast(back as int) group by 1)
select race_id, round(temps[3], 6) temp_at, round(rain_3, 6) rain_3, round(rain_7, 6) rain_7 from races join o on o.course = races.course and o.day = race_date join tr using (race_id)
""")
def d03_attach_weather(spark, d):
    """The observation at 14 h (the nearest hour is 15), trailing rain, and the track condition of b09's rule."""
    w = t.weather_daily(spark, d)
    o = w.withColumns({"hours": F.array(*map(F.lit, (6, 12, 15, 20))), "temps": F.array(*(F.col("temp") + k for k in (-3, 0, 2, -1)))})
    return tr.attach_weather(t.races(spark, d), o).select("race_id", *(F.round(k, 6).alias(k) for k in ("temp_at", "rain_3", "rain_7")))


@c.query("""
select race_date, course, 'history' source, 'race' status from (select distinct race_date, course from races where race_id % 3 = 0) union all
(select race_date, course, 'ledger', 'open' from (select distinct race_date, course from races) anti join (select distinct race_date, course from races where race_id % 3 = 0) using (race_date, course))
""")
def h02_overlay(spark, d):
    r = t.races(spark, d)
    proof = lambda df, p, s, st: df.select("race_date", "course", F.lit(p).alias("priority"), F.lit(s).alias("source"), F.lit(st).alias("status"))
    return q.overlay(proof(r.where("race_id % 3 = 0"), 1, "history", "race").unionByName(proof(r, 2, "ledger", "open")), ["race_date", "course"]).drop("priority")


@c.query("select p_partkey as horse_id, 'b' missing_in from part where p_partkey % 10 = 0 and p_partkey % 15 <> 0 union all select p_partkey, 'a' from part where p_partkey % 15 = 0 and p_partkey % 10 <> 0", base=False)
def h03_source_diff(spark, d):
    h = t.horses(spark, d).select("horse_id")
    return q.source_diff(h.where("horse_id % 10 = 0"), h.where("horse_id % 15 = 0"), ["horse_id"])


@c.query("""
with g as (select cast(race_date as varchar) || course group_id, race_id, horse_id from starts),
s as (select group_id, count(distinct race_id) z from g group by 1 having count(distinct race_id) > 1)
select group_id, horse_id, count(distinct race_id) races, max(s.z) group_size from g join s using (group_id) group by 1, 2 having count(distinct race_id) = max(s.z)
""")
def h04_overlap(spark, d):
    s = keep(t.starts(spark, d).select("race_date", "course", "race_id", "horse_id"), "fields")
    name = F.concat(F.col("group_id.race_date").cast("string"), "group_id.course").alias("group_id")
    return q.in_every_race(s, ["race_date", "course"]).select(name, "horse_id", "races", "group_size")


def names(spark, d):
    return t.horses(spark, d).select(F.col("horse_id").alias("id"), x.normalize_name(F.col("name")).alias("key"), "name", "sex", F.year("birthdate").alias("year"))


NAMES = "nm as (select horse_id id, trim(regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g')) k, name, sex, year(birthdate) y from horses)"


SIMILARITY = """
case when {a} = {b} then 0.99 when replace({a}, ' ', '') = replace({b}, ' ', '') then 0.99
     when contains(replace({a}, ' ', ''), replace({b}, ' ', '')) or contains(replace({b}, ' ', ''), replace({a}, ' ', ''))
     then greatest(0.9, 1 - levenshtein({a}, {b}) / greatest(length({a}), length({b}))) else 1 - levenshtein({a}, {b}) / greatest(length({a}), length({b})) end"""


@c.query("with " + NAMES + ", f as (select k, min(id) a from nm group by 1) select a, id as b from nm join f using (k) where id <> a")
def i01_exact_pairs(spark, d):
    return ids.exact_pairs(names(spark, d))


@c.query("with " + NAMES + """, n as (select k, min(id) id, k[1:2] blk from nm group by k), p as (select a.k ka, b.k kb, a.id ia, b.id ib from n a join n b on a.blk = b.blk and a.k < b.k),
s as (select least(ia, ib) a, greatest(ia, ib) b, case when replace(ka, ' ', '') = replace(kb, ' ', '') then 0.99 when contains(replace(ka, ' ', ''), replace(kb, ' ', '')) or contains(replace(kb, ' ', ''), replace(ka, ' ', '')) then greatest(0.9, 1 - levenshtein(ka, kb) / greatest(length(ka), length(kb))) else 1 - levenshtein(ka, kb) / greatest(length(ka), length(kb)) end sim from p)
select a, b, round(sim, 6) similarity from s where sim >= 0.92""")
def i02_i03_fuzzy_pairs(spark, d):
    """Blocks of two characters; the ratio is Levenshtein's, which SQL has too."""
    return ids.fuzzy_pairs(names(spark, d), 0.92, F.substring("key", 1, 2)).withColumn("similarity", F.round("similarity", 6))


@c.query()
def i04_i14_match_clusters(spark, d):
    """Candidates, their components (I9) and the canonical row of each (I10, I14); a row without a match is its own.

    Fuzzy candidates from .88 to below .98 are merged; how many others wait for review stands
    in a column.
    """
    n = names(spark, d)
    pairs = keep(ids.match_candidates(n.where("key != ''"), 0.88, F.substring("key", 1, 2)))
    comp = connected_components(pairs.where("not review"), keep, "a", "b")
    starts = t.results(spark, d).groupBy(F.col("horse_id").alias("id")).agg(F.count("*").alias("starts"))
    members = n.select("id", "name", "key").join(comp, "id", "left").join(starts, "id", "left").select("id", "name", "key", F.coalesce("component", "id").alias("component"), F.coalesce("starts", F.lit(0)).alias("starts"))
    label = members.groupBy("component").agg(F.when(F.countDistinct("key") > 1, "HIGH").otherwise("EXACT").alias("confidence"))
    open_ = pairs.where("review").select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("review"))
    out = ids.canonical(members).join(members.select("id", "component"), "id").join(label, "component").join(open_, "id", "left")
    return out.select("id", "canonical_id", "members", "confidence", F.coalesce("review", F.lit(0)).alias("review"))


#: Matches by Levenshtein's ratio, which SQL has too. Equal names unite, of names from .92 on those that a reviewer took (one pair in seven); others from .85 on are open.
_TAKEN = "(score >= 0.99 or score >= 0.92 and (a + b) % 7 = 0)"
_PAIRS = """, n1 as (select k, min(id) id, k[1:2] blk from nm where k <> '' group by k),
sm as (select least(p.id, q.id) a, greatest(p.id, q.id) b, """ + SIMILARITY.format(a="p.k", b="q.k") + """ score from n1 p join n1 q on p.blk = q.blk and p.k < q.k),
mt as (select a, b, score from sm where score >= 0.85 union all select f.id, nm.id, 1.0 from nm join n1 f using (k) where nm.id <> f.id),
am as (select a, b from mt where """ + _TAKEN + """ and a % 3 <> 0 and b % 3 <> 0)"""
_CLOSED = """, {e}2 as (select a, b from {e} union select b, a from {e}),
{r} as (select id v, id m from nm where {rows} union select {e}2.b, {r}.m from {r} join {e}2 on {r}.v = {e}2.a where {r}.m < {e}2.b),
{c} as (select v id, min(m) c from {r} group by 1)"""
IDENTITY = "with " + NAMES + _PAIRS + _CLOSED.format(e="am", r="r1", c="c1", rows="id % 3 <> 0") + ", al as (select a, b from mt where " + _TAKEN + ")" + _CLOSED.format(e="al", r="r2", c="c2", rows="true") + """,
lk as (select c2.id, coalesce(min(c1.c) over (partition by c2.c), min(c2.id) over (partition by c2.c)) horse_id from c2 left join c1 on c1.id = c2.id),
st as (select nm.*, coalesce(starts, 0) starts from nm left join (select horse_id id, count(*) starts from results group by 1) using (id)),
rk as (select st.*, lk.horse_id, row_number() over (partition by lk.horse_id order by starts desc, length(trim(name)) desc, id) rn, count(*) over (partition by lk.horse_id) members from st join lk using (id))"""


def identity(spark, d):
    """Two batches: first the horses whose id 3 does not divide, then the others with all matches. Also profiles and matches."""
    n = names(spark, d)
    m = ids.match_candidates(n.where("key != ''"), 0.85, F.substring("key", 1, 2), ids.levenshtein_ratio).select("a", "b", "score")
    m = keep(m)
    auto = m.where(_TAKEN)
    first = pm.extend(None, n.where("id % 3 != 0"), auto.where("a % 3 != 0 and b % 3 != 0"))
    starts = t.results(spark, d).groupBy(F.col("horse_id").alias("id")).agg(F.count("*").alias("starts"))
    profiles = n.join(starts, "id", "left").withColumn("starts", F.coalesce("starts", F.lit(0)))
    return first, pm.extend(first, n, auto), profiles, m


@c.query(IDENTITY + " select id, horse_id, cast(case when rn = 1 then 1.0 else 0.95 end as double) confidence, case when members > 1 then 'auto_merge' else 'singleton' end method from rk")
def i10_identity(spark, d):
    """Permanent ids after a second batch: those of the first survive."""
    _, now, profiles, _ = identity(spark, d)
    return pm.links(now, pm.horses(now, profiles))


@c.query(IDENTITY + " select horse_id, id primary_id, trim(name) as name, k as key, sex, y as year, members, members > 1 auto_merged from rk where rn = 1")
def i10_permanent_horses(spark, d):
    _, now, profiles, _ = identity(spark, d)
    return pm.horses(now, profiles)


@c.query(IDENTITY + " select horse_id, k as key, arg_min(trim(name), rn) alias from rk where k <> '' group by 1, 2")
def i10_aliases(spark, d):
    _, now, profiles, _ = identity(spark, d)
    return pm.aliases(now, profiles)


@c.query(IDENTITY + """, oc as (select least(x.horse_id, z.horse_id) left_id, greatest(x.horse_id, z.horse_id) right_id, a, b, score from mt join lk x on x.id = a join lk z on z.id = b where not """ + _TAKEN + """ and x.horse_id <> z.horse_id)
select left_id, right_id, arg_min(a, (-score, a, b)) a, arg_min(b, (-score, a, b)) b, round(max(score), 6) score from oc group by 1, 2""")
def i10_open_candidates(spark, d):
    _, now, _, m = identity(spark, d)
    return pm.open_candidates(now, m.where(f"not {_TAKEN}")).withColumn("score", F.round("score", 6))


@c.query(IDENTITY + " select distinct c1.c as old, lk.horse_id merged_into from c1 join lk using (id) where c1.c <> lk.horse_id")
def i10_merges(spark, d):
    """Ids of the first batch that the second one united with an older id."""
    return identity(spark, d)[1].merges


@c.query("""
with o as (select horse_id, owner_id, count(*) n from starts group by 1, 2), r as (select *, row_number() over (partition by horse_id order by n desc, owner_id) rn from o)
select s.horse_id, count(*) starts, min(race_date) first_day, max(race_date) last_day, any_value(w.ow) owners from starts s join (select horse_id, string_agg(cast(owner_id as varchar), ',' order by owner_id) ow from r where rn <= 5 group by 1) w using (horse_id) group by 1
""")
def i05_profiles(spark, d):
    p = ids.profiles(t.starts(spark, d))
    return p.select("horse_id", "starts", "first_day", "last_day", F.array_join(F.transform("owner_ids", lambda v: v.cast("string")), ",").alias("owners"))


@c.query()
def i06_i07_i08_score_pairs(spark, d):
    """Candidates (I6) scored on all signals (I7), with the continuity of their careers (I8); the tables hold no source ids."""
    s = t.starts(spark, d)
    n = names(spark, d).join(t.horses(spark, d).select(F.col("horse_id").alias("id"), F.col("sire_id").alias("sire"), F.col("dam_id").alias("dam")), "id")
    days = s.groupBy(F.col("horse_id").alias("id")).agg(F.sort_array(F.collect_set("race_date")).alias("days"))
    p = n.join(ids.profiles(s).withColumnRenamed("horse_id", "id"), "id", "left").join(days, "id", "left")
    columns = {"key": "key", "sex": "sex", "year": "year", "sire": "sire", "dam": "dam", "first_owner_id": "owner", "first_trainer_id": "trainer", "owner_ids": "owners", "trainer_ids": "trainers", "courses": "courses", "days": "days"}
    p = keep(p.select("id", *(F.col(v).alias(w) for v, w in columns.items())))
    return ids.score_pairs(ids.paired(p), *ids.continuity_columns()).withColumn("score", F.round("score", 6))


@c.query("select horse_id as id, case when horse_id % 50 = 0 then 1980 when horse_id % 7 = 0 then 1990 else year(birthdate) end as year, year(birthdate) old_year from horses")
def i11_apply_corrections(spark, d):
    h = t.horses(spark, d).select(F.col("horse_id").alias("id"), F.concat(F.lit("s"), F.col("horse_id").cast("string")).alias("source_id"), F.year("birthdate").cast("long").alias("year"))
    by_source = h.where("id % 50 = 0").select(F.col("source_id").alias("key"), F.lit(1980).cast("long").alias("new_value"), F.lit("vet").alias("source_note"))
    by_id = h.where("id % 7 = 0").select(F.col("id").cast("string").alias("key"), F.lit(1990).cast("long").alias("new_value"), F.lit("stud").alias("source_note"))
    out = ids.apply_corrections(h.withColumn("id", F.col("id").cast("string")), by_source.unionByName(by_id), "year")
    return out.select(F.col("id").cast("long").alias("id"), "year", F.col("old_year"))


ASKED = ", asked as (select id query_id, replace(k, 'a', '') q from nm where id % 20 = 0)"


@c.query("with " + NAMES + ASKED + ", s as (select query_id, id, max(" + SIMILARITY.format(a="q", b="k") + """) score from asked join nm on q <> '' and k <> '' group by 1, 2),
r as (select *, row_number() over (partition by query_id order by score desc, id) as rank from s where score >= 0.7 - 1e-9)
select query_id, id, round(score, 6) score, rank from r where rank <= 3""")
def i12_resolve(spark, d):
    """Names without their letter a against all names, by Levenshtein's ratio."""
    n = names(spark, d)
    queries = n.where("id % 20 = 0").select(F.col("id").alias("query_id"), F.regexp_replace("key", "a", "").alias("key"))
    return ids.resolve(queries, n.select("id", "key"), 3).select("query_id", "id", F.round("score", 6).alias("score"), "rank")


@c.query()
def i12_resolve_by_blocks(spark, d):
    """By the ratio of matching blocks; some queries have a source id, which comes first."""
    n = names(spark, d)
    source = F.concat(F.lit("s"), F.col("id").cast("string"))
    queries = n.where("id % 20 = 0").select(F.col("id").alias("query_id"), F.regexp_replace("key", "a", "").alias("key"), F.when(F.col("id") % 60 == 0, source).alias("source_id"))
    return ids.resolve(queries, n.select("id", "key", source.alias("source_id")), 3, edits=False).withColumn("score", F.round("score", 6))


@c.query("with " + NAMES + "select k as key, count(*) as rows, cast(count(distinct sex) as int) sex, cast(count(distinct y) as int) as year from nm group by 1 having count(distinct sex) > 1 or count(distinct y) > 1")
def i16_collisions(spark, d):
    """Also the multi-link report of I13."""
    return ids.collisions(names(spark, d), ["sex", "year"])


@c.query("with " + NAMES + "select id, k as key from nm where contains(k, 'brand') order by case when k = 'brand' then 1 else 0 end desc, length(k), id limit 20")
def i18_search_names(spark, d):
    return ids.search_names(names(spark, d).select("id", "key"), "brand", 20)


@c.query("select horse_id, 'sire' field, 'src:' || sire_id parent, cast(2 as bigint) sources from horses where horse_id % 4 <> 0 union all select horse_id, 'dam', 'name:mare ' || dam_id, 1 from horses")
def i19_resolve_pedigree(spark, d):
    h = t.horses(spark, d)
    none = F.lit(None)
    a = h.select("horse_id", F.lit("sire").alias("field"), F.col("sire_id").alias("parent_source_id"), none.cast("string").alias("parent_name"))
    second = h.select("horse_id", F.lit("sire").alias("field"), (F.col("sire_id") + F.when(F.col("horse_id") % 4 == 0, 1).otherwise(0)).alias("parent_source_id"), none.cast("string").alias("parent_name"))
    dam = h.select("horse_id", F.lit("dam").alias("field"), none.cast("long").alias("parent_source_id"), F.concat(F.lit("Mare "), F.col("dam_id").cast("string")).alias("parent_name"))
    return ids.resolve_pedigree(a.unionByName(second).unionByName(dam))[0]


@c.query("select case when horse_id % 3 = 0 then 'A' else 'B' end breed, count(*) horses, count(*) filter (horse_id % 5 <> 0) sire, count(*) dam, count(*) filter (horse_id % 5 <> 0) as both, cast(0 as bigint) neither from horses group by rollup (1)")
def e24_pedigree_coverage(spark, d):
    h = t.horses(spark, d).select(F.when(F.col("horse_id") % 3 == 0, "A").otherwise("B").alias("breed"), F.when(F.col("horse_id") % 5 != 0, F.col("sire_id")).alias("sire_id"), "dam_id")
    return ids.pedigree_coverage(h)


@c.query("""
with p as (select horse_id, breed, count(*) n from starts group by 1, 2) select horse_id, arg_max(breed, (n, breed)) breed, max(n) starts from p where n >= 3 group by 1
""")
def e32_best_per_horse(spark, d):
    return u.offspring_targets(t.starts(spark, d))


@c.query("with r as (select 'SIRE' role, sire_id parent_id from horses union all select 'DAM', dam_id from horses) select parent_id, count(*) relations, string_agg(distinct role, ',' order by role) roles from r group by 1")
def e32_parent_targets(spark, d):
    h = t.horses(spark, d)
    role = lambda k, n: h.select(F.col(k).alias("parent_id"), F.lit(n).alias("role"))
    return u.parent_targets(role("sire_id", "SIRE").unionByName(role("dam_id", "DAM")))


@c.query("""
select race_id, 10 - (case when distance is null then 1 else 0 end) - 3 - (case when prize > 150000 then 1 else 0 end) have, case when prize > 150000 then 'age_restriction,race_value,sex_restriction,weather' else 'age_restriction,sex_restriction,weather' end missing from races
""")
def e18_classify_races(spark, d):
    fields = u.race_fields(F.lit(None).cast("string"), F.lit("dry"), F.when(F.col("prize") <= 150000, F.col("prize")), F.lit(1))
    return u.classify_races(t.races(spark, d), fields)