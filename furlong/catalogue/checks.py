"""Queries over the quality suites, comparisons, listings and registries."""

from pyspark.sql import functions as F

from ..functions import scalars as x
from ..operators import boards as b
from ..operators import checks as k
from ..operators import identity as ids
from ..operators import ingest as i
from ..operators import markets as mk
from ..operators import prerace as pre
from ..operators import priors as p
from ..sources import tables as t
from .common import Catalogue
from .ingest import NAMES
from .scoring import SCORES, observations
from .starts import FIELD, metrics, r4

c = Catalogue()
QUERIES, SQL = c.queries, c.sql


def spoilt(spark, d):
    """The tables with faults that follow from ids: races without a prize, results without a finish or with an odd clock."""
    races = t.races(spark, d).withColumns({"number": F.lit(None).cast("int"), "prize": F.when(F.col("race_id") % 50 != 0, F.col("prize"))})
    s = t.starts(spark, d).select("result_id", "race_id", "horse_id", F.when(F.col("result_id") % 97 != 0, F.col("finish") + F.when(F.col("race_id") % 211 == 0, 4).otherwise(0)).alias("finish"), F.when(F.col("result_id") % 89 == 0, 700.0).otherwise(F.col("time_s")).alias("time_s"))
    horses = t.horses(spark, d).withColumn("name", F.when(F.col("horse_id") % 100 == 0, " ").when(F.col("horse_id") % 100 == 1, F.concat("name", F.lit(" "))).otherwise(F.col("name")))
    return races, s, horses


@c.query("with " + NAMES + """, h as (select horse_id, case when horse_id % 100 = 0 then ' ' when horse_id % 100 = 1 then horses.name || ' ' else horses.name end as name, case when horse_id % 100 = 0 then '' else k end k from horses join nm on nm.id = horse_id),
r as (select result_id, race_id, horse_id, case when result_id % 97 <> 0 then finish + case when race_id % 211 = 0 then 4 else 0 end end finish, case when result_id % 89 = 0 then 700.0 else time_s end time_s from starts),
f as (select race_id, count(finish) n, max(finish) most, min(finish) least from r group by 1)
select 'duplicate_races' "check", 'warning' severity, 'race' entity, min(race_id) id, count(*) - 1 details from races group by course, race_date, trim(regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g')) having count(*) > 1
union all select 'duplicate_horses', 'warning', 'horse', min(horse_id), count(*) - 1 from h where k <> '' group by k having count(*) > 1 union all select 'duplicate_results', 'error', 'result', min(result_id), count(*) - 1 from r group by race_id, horse_id having count(*) > 1
union all select 'missing_finish_position', 'warning', 'result', result_id, 1 from r where finish is null union all select 'missing_prize', 'info', 'race', race_id, 1 from races where race_id % 50 = 0 union all select 'impossible_race_time', 'error', 'result', result_id, cast(floor(time_s) as bigint) from r where time_s <= 0 or time_s > 600
union all select 'impossible_finish_order', 'warning', 'race', race_id, count(*) from r where finish > 0 group by race_id, finish having count(*) >= 3 union all select 'impossible_finish_order', 'error', 'race', race_id, least from f where least < 1 union all select 'impossible_finish_order', 'warning', 'race', race_id, most from f where most > n + 2
union all select 'inconsistent_horse_names', 'error', 'horse', horse_id, 1 from h where trim(name) = '' union all select 'irregular_horse_names', 'info', 'horse', horse_id, 1 from h where trim(name) <> '' and (name <> trim(name) or contains(name, '  '))
""")
def q02_warehouse_checks(spark, d):
    return k.warehouse_checks(*spoilt(spark, d))


@c.query("with " + FIELD + """, m0 as (select * replace (case when horse_id % 11 = 0 then 1 when horse_id % 29 = 0 then 2 else starts end as starts,
  case when horse_id % 22 = 0 then 1 when horse_id % 13 = 0 then starts + 1 else wins end as wins, case when horse_id % 17 = 0 then 0.5 else avg_finish end as avg_finish,
  case when horse_id % 19 = 0 then null else form_5 end as form_5, case when horse_id % 29 = 0 then 10000 * earnings else earnings end as earnings) from metrics where breed = '*'), cap as (select avg(earnings) + 4 * stddev_pop(earnings) cap, count(*) n from m0 where earnings > 0)
select 'single_start' "check", horse_id as id from m0 where starts = 1 union all select 'perfect_single_start', horse_id from m0 where starts = 1 and wins = 1 union all select 'earnings_single_start', horse_id from m0 where starts = 1 and earnings > 0
union all select 'abnormal_earnings', horse_id from m0, cap where n >= 5 and earnings > cap and starts <= 2 union all select 'missing_data', horse_id from m0 where starts >= 5 and (rating is null or form_5 is null or consistency is null)
union all select 'impossible_wins', horse_id from m0 where wins > starts union all select 'impossible_win_rate', horse_id from m0 where wins > starts or wins < 0
union all select 'impossible_avg_finish', horse_id from m0 where avg_finish < 1
union all select 'underqualified_on_board', horse_id from (select horse_id, starts, row_number() over (order by wins desc, starts desc, horse_id) k from m0) where k <= 10 and starts < 5
""")
def q07_validate_metrics(spark, d):
    """All nine rules, the last against a board, over metrics with planted faults."""
    of = lambda n: F.col("horse_id") % n == 0
    m = metrics(spark, d).where("breed = '*'")
    m = m.withColumns({
        "starts": F.when(of(11), 1).when(of(29), 2).otherwise(F.col("starts")), "wins": F.when(of(22), 1).when(of(13), F.col("starts") + 1).otherwise(F.col("wins")),
        "avg_finish": F.when(of(17), 0.5).otherwise(F.col("avg_finish")), "form_5": F.when(~of(19), F.col("form_5")),
        "earnings": F.when(of(29), 10000 * F.col("earnings")).otherwise(F.col("earnings")),
    })
    top = b.board(m, ["breed"], 1, b.orders(["-wins", "-starts", "horse_id"]), 10, "most_successful")
    return k.validate_metrics(m, top).select("check", "id")


@c.query("with " + FIELD + """, pl as (select horse_id, finish, race_date, unnest([struct_pack(d := 'distance', b := cast(distance as varchar)), struct_pack(d := 'course', b := course), struct_pack(d := 'jockey', b := cast(jockey_id as varchar)), struct_pack(d := 'trainer', b := cast(trainer_id as varchar))]) l from starts),
pg as (select horse_id, l.d d, l.b b, count(*) n, count(*) filter (finish = 1) w, max(race_date) as last from pl group by all), ps as (select *, round(w / n * (1 - 0.5 / (n + 0.5)), 9) score, row_number() over (partition by horse_id, d order by round(w / n * (1 - 0.5 / (n + 0.5)), 9) desc, last desc, b desc) k from pg),
pb as (select horse_id, max(b) filter (d = 'distance') distance_pref, max(b) filter (d = 'course') course_pref, max(b) filter (d = 'jockey') jockey_pref, max(b) filter (d = 'trainer') trainer_pref, round(max(score) filter (d = 'trainer'), 6) trainer_score from ps where k = 1 group by 1)
select horse_id, distance_pref, course_pref, jockey_pref, trainer_pref, trainer_score, round(earnings, 2) earnings, round(100 * earnings / max(earnings) over (), 4) earnings_index from metrics join pb using (horse_id) where breed = '*'""")
def e05_preferences(spark, d):
    """Preferred distance and course, combinations with jockey and trainer, and earnings against the best of the scope."""
    pref = pre.preferences(t.starts(spark, d), {"distance": "distance", "course": "course", "jockey": "jockey_id", "trainer": "trainer_id"})
    m = metrics(spark, d).where("breed = '*'")
    best = m.agg(F.max("earnings").alias("best"))  # one row
    out = m.join(pref, "horse_id").crossJoin(F.broadcast(best))
    return out.select("horse_id", *(f"{n}_pref" for n in ("distance", "course", "jockey", "trainer")), F.round("trainer_pref_score", 6).alias("trainer_score"), F.round("earnings", 2).alias("earnings"), F.round(100 * F.col("earnings") / F.col("best"), 4).alias("earnings_index"))


@c.query("with " + SCORES + ", q as (select race_id, horse_id, round(max(D), 6) s from sc group by 1, 2) select a.race_id, a.horse_id a, b.horse_id b, a.s score_a, b.s score_b, case when a.s > b.s then a.horse_id when b.s > a.s then b.horse_id end preferred, a.s = b.s tie from q a join q b on a.race_id = b.race_id and a.horse_id < b.horse_id")
def l11_compare_pairs(spark, d):
    """Two horses of a race by the contextual score; a tie or an unscored horse has no preference."""
    return p.compare_pairs(p.baseline_scores(observations(spark, d)), "D")


@c.query("with r as (select race_id, course, race_date, count(*) runners from starts group by 1, 2, 3) select race_id, course, race_date, runners, (select count(*) from r) total from r order by race_id limit 50 offset 100")
def l13_list_races(spark, d):
    """A page of races with the total, the limit that the feature is about."""
    return p.list_races(t.starts(spark, d), 50, 100)


@c.query("select meeting_id, count(*) legs, min(ts) first_start from (select user_id * 100 + day(ts) meeting_id, ts from events where ts > timestamp '2024-01-05') group by 1 having count(*) = 5", base=False)
def c05_future_five(spark, d):
    """Meetings (a user's events of a day) with exactly five future legs, by their first start."""
    meeting = (F.col("user_id") * 100 + F.dayofmonth("ts")).alias("meeting_id")
    program = t.read(spark, d, "events").select(meeting, F.col("ts").alias("starts_at"))
    return mk.future_five(program, F.lit("2024-01-05").cast("timestamp")).select("meeting_id", "legs", "first_start")


_KEY = "trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'))"


@c.query("with o as (select o_custkey id, c_name nm from orders join customer on o_custkey = c_custkey), al as (select 'horse' kind, horse_id id, name nm from horses union all select 'trainer', s_suppkey, s_name from supplier union all select 'owner', id, nm from o union all select 'jockey', jockey_id, 'jockey ' || jockey_id from results union all select 'sire', sire_id, 'sire ' || sire_id from horses union all select 'track', null, course from races),"
         f" ky as (select *, {_KEY.format('nm')} k from al) select kind, k as key, min(id) id, count(distinct nm) aliases from ky where k <> '' group by 1, 2")  # fmt: skip
def i17_entity_registry(spark, d):
    """All six kinds; aliases are the distinct spellings."""
    numbered = lambda df, key, word: df.select(F.col(key).cast("long").alias("id"), F.concat(F.lit(f"{word} "), F.col(key).cast("string")).alias("name")).distinct()
    owners = t.read(spark, d, "orders").select(F.col("o_custkey").alias("id")).distinct().join(t.read(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")), "id")
    parts = {
        "horse": t.horses(spark, d).select(F.col("horse_id").alias("id"), "name"), "trainer": t.read(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")), "owner": owners,
        "jockey": numbered(t.results(spark, d), "jockey_id", "jockey"), "sire": numbered(t.horses(spark, d), "sire_id", "sire"), "track": t.races(spark, d).select(F.lit(None).cast("long").alias("id"), F.col("course").alias("name")).distinct(),
    }
    return ids.entity_registry(parts)


@c.query("with " + FIELD + "select horse_id, round(confidence, 4) confidence, case when confidence >= 92 then 'very_high' when confidence >= 80 then 'high' when confidence >= 60 then 'medium' when confidence >= 40 then 'low' else 'very_low' end band, case when rating >= 85 then 'Very High' when rating >= 70 then 'High' when rating >= 50 then 'Medium' when rating >= 30 then 'Low' else 'Very Low' end market_band from (select horse_id, rating, least(0.5 * case when starts = 1 then 20 when starts = 2 then 40 when starts <= 4 then 60 when starts <= 9 then 85 else 95 end + 0.25 * case when slope is null then 50 else 100 end + 25, case when starts = 1 then 35 when starts = 2 then 55 when starts <= 4 then 75 else 100 end) confidence from metrics where breed = '*')")
def b19_bands(spark, d):
    m = metrics(spark, d).where("breed = '*'").withColumn("confidence", x.confidence(F.col("starts"), F.when(F.col("slope").isNull(), 0.5).otherwise(0.0), F.lit(1.0)))
    return m.select("horse_id", *r4("confidence"), x.confidence_band(F.col("confidence")).alias("band"), x.market_band(F.col("rating")).alias("market_band"))


@c.query("""
with o as (select user_id k, value, ts, event_id, lag(value) over w pv, row_number() over w r from events window w as (partition by user_id order by ts, event_id)),
v as (select *, row_number() over (partition by k order by ts, event_id) version from o where r = 1 or value <> pv)
select k, value, cast(version as int) version from v qualify version = max(version) over (partition by k)
""", base=False)
def a05_current_rows(spark, d):
    """The current version of each key, from one append of the whole feed."""
    e = t.read(spark, d, "events").select(F.col("user_id").alias("k"), "value", F.struct("ts", "event_id").alias("at"))
    return i.current_rows(i.scd2_append(None, e, ["k"], ["value"], "at")).select("k", "value", "version")


STAR = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


@c.query(" union all ".join(f"select '{n}' as name, count(*) as rows from {n}" for n in STAR), base=False)
def a01_tables(spark, d):
    """Rows of every table of the star schema; only counts leave the scans."""
    counts = [df.agg(F.lit(n).alias("name"), F.count("*").alias("rows")) for n, df in t.read_tables(spark, d, STAR).items()]
    out = counts[0]
    for df in counts[1:]:
        out = out.unionByName(df)
    return out
