"""Queries over as-of features, evaluation, markets, crowds, streams."""

import tempfile
import uuid

from pyspark.sql import functions as F

from ..operators import markets as mk
from ..operators import metrics as m
from ..operators import priors as p
from ..plans import registry
from ..sources import tables as t
from ..sources.store import partitions, written
from ..streaming import ingest as st
from .common import Catalogue
from .starts import FIELD, TOTALS

c = Catalogue()
QUERIES, SQL = c.queries, c.sql


def observations(spark, d):
    s = t.starts(spark, d)
    overall = s.agg(F.avg((F.col("finish") == 1).cast("int")).alias("prior_win"))
    return p.prior_features(p.with_people_priors(s, "trainer_id"), overall, {"distance": "distance", "track": "course", "breed": "breed"})


OBS = """
ov as (select avg(case when finish = 1 then 1 else 0 end) prior_win from starts),
pf as (select starts.*, count(*) over b career_starts, coalesce(sum(case when finish = 1 then 1 else 0 end) over b, 0) career_wins, avg(case when finish <= 3 then 1 else 0 end) over b career_top3_rate, avg(finish) over b career_avg_finish, quantile_cont(finish, 0.5) over b career_median_finish,
  min(finish) over b career_best_finish, lag(finish) over w last_finish, avg(finish) over l3 avg_finish_last3, avg(finish) over l5 avg_finish_last5, avg(case when finish = 1 then 1 else 0 end) over l5 win_rate_last5, list(finish) over l5 l5, cast(race_date - lag(race_date) over w as int) days_since,
  count(*) over dd distance_starts, sum(case when finish = 1 then 1 else 0 end) over dd / nullif(count(*) over dd, 0) distance_win_rate, sum(case when finish = 1 then 1 else 0 end) over dt / nullif(count(*) over dt, 0) track_win_rate
  from starts window w as (partition by horse_id order by race_date, race_id, result_id), b as (partition by horse_id order by race_date, race_id, result_id rows between unbounded preceding and 1 preceding),
  l3 as (partition by horse_id order by race_date, race_id, result_id rows between 3 preceding and 1 preceding), l5 as (partition by horse_id order by race_date, race_id, result_id rows between 5 preceding and 1 preceding),
  dd as (partition by horse_id, distance order by race_date, race_id, result_id rows between unbounded preceding and 1 preceding), dt as (partition by horse_id, course order by race_date, race_id, result_id rows between unbounded preceding and 1 preceding)),
tp as (select trainer_id, race_id, race_date, count(*) n, count(*) filter (finish = 1) w from starts group by all), tq as (select trainer_id, race_id, coalesce(sum(n) over b, 0) trainer_starts, coalesce(sum(w) over b, 0) tw from tp window b as (partition by trainer_id order by race_date, race_id rows between unbounded preceding and 1 preceding)),
obs as (select pf.*, career_wins / nullif(career_starts, 0) career_win_rate, case when career_starts > 0 then (career_wins + 5 * prior_win) / (career_starts + 5) end career_win_rate_eb, trainer_starts, case when trainer_starts >= 5 then tw / trainer_starts end trainer_win_rate,
  case when len(l5) >= 2 then list_avg(l5[1:len(l5) // 2]) - list_avg(l5[len(l5) // 2 + 1:]) end form_trend from pf join tq using (trainer_id, race_id) cross join ov)
"""
SCORES = OBS + """
, wp as (select *, case when career_avg_finish is not null then greatest(0, 100.0 - 12 * (career_avg_finish - 1)) end pa, case when avg_finish_last5 is not null then greatest(0, 100.0 - 12 * (avg_finish_last5 - 1)) end p5, case when form_trend is not null then least(100, greatest(0, 50 + form_trend * 10)) end pt, least(100, greatest(0, 100 - abs(weight - 56) * 3)) pw from obs),
sc as (select *, case when career_starts > 0 then 0.45 * pa + 30 * career_win_rate + 25 * career_top3_rate end A, case when rating > 0 then rating end B,
  case when career_starts > 0 then (0.45 * p5 + 30 * win_rate_last5 + coalesce(0.25 * pt, 0)) / (0.75 + case when pt is null then 0 else 0.25 end) end C,
  (coalesce(0.18 * pa, 0) + coalesce(0.22 * p5, 0) + coalesce(12 * track_win_rate, 0) + coalesce(12 * distance_win_rate, 0) + coalesce(10 * trainer_win_rate, 0) + coalesce(10 * career_win_rate, 0) + 0.05 * pw)
   / (case when pa is null then 0 else 0.18 end + case when p5 is null then 0 else 0.22 end + case when track_win_rate is null then 0 else 0.12 end + case when distance_win_rate is null then 0 else 0.12 end + case when trainer_win_rate is null then 0 else 0.10 end + case when career_win_rate is null then 0 else 0.10 end + 0.05) D from wp)
"""


@c.query("with " + SCORES + "select result_id, round(A, 5) A, B, round(C, 5) C, round(D, 5) D from sc")
def l04_baseline_scores(spark, d):
    return p.baseline_scores(observations(spark, d)).select("result_id", *(F.round(k, 5).alias(k) if k != "B" else F.col("B") for k in "ABCD"))


EVAL = SCORES + """
, lg as (select race_id, race_date, horse_id, result_id, finish, unnest(['A', 'B', 'C', 'D']) model, unnest([round(A, 9), round(B, 9), round(C, 9), round(D, 9)]) score from sc),
rk as (select *, row_number() over (partition by model, race_id order by score desc, result_id) as rank, max(finish) over (partition by model, race_id) n from lg where score is not null),
rr as (select *, greatest(0, n - finish + 1) rel from rk), ri as (select *, row_number() over (partition by model, race_id order by rel desc, result_id) ideal, row_number() over (partition by model, race_id order by finish, result_id) actual from rr),
ev as (select model, race_id, race_date, count(*) field, arg_min(rank, actual) winner_rank, sum(rel / log2(rank + 1.0)) filter (rank <= 3) / sum(rel / log2(ideal + 1.0)) filter (ideal <= 3) ndcg3, 1 - 6 * sum(pow(rank - actual, 2)) / (count(*) * (count(*) * count(*) - 1)) spearman from ri group by all having count(*) >= 2)
"""


def evals(spark, d):
    return p.evaluate(p.rank_races(p.baseline_scores(observations(spark, d)), ["A", "B", "C", "D"]))


@c.query("with " + EVAL + """select model, case when field <= 3 then '2-3' when field <= 6 then '4-6' when field <= 9 then '7-9' else '10+' end as size, count(*) races, round(avg(case when winner_rank = 1 then 1 else 0 end), 4) hit, round(avg(case when winner_rank <= 3 then 1 else 0 end), 4) top3,
 round(avg(winner_rank), 4) mean_rank, round(avg(1 / winner_rank), 4) mrr, round(avg(ndcg3), 4) ndcg3, round(avg(spearman), 4) spearman from ev group by grouping sets ((1), (1, 2))""")
def l07_l08_summary(spark, d):
    """Also L5 and L6: ranks by race, then rates by model and field size."""
    s = p.summarise(evals(spark, d))
    return s.select("model", "size", "races", *(F.round(k, 4).alias(k) for k in ("hit", "top3", "mean_rank", "mrr", "ndcg3", "spearman")))


@c.query("with " + EVAL + "select model, race_id, cast(winner_rank as int) winner_rank, field from ev where winner_rank >= greatest(3, field // 2) order by winner_rank desc, model, race_id limit 20")
def l09_failures(spark, d):
    return p.failures(evals(spark, d)).select("model", "race_id", "winner_rank", "field")


@c.query()
def l10_compare(spark, d):
    return p.compare(p.summarise(evals(spark, d))).select("place", "model", F.round("hit", 4).alias("hit"), "gate")


@c.query("with " + EVAL + "select race_id, horse_id winner from rk where model = 'D' and rank = 1")
def l11_predict_races(spark, d):
    return p.rank_races(p.baseline_scores(observations(spark, d)), ["D"]).where("rank = 1").select("race_id", F.col("horse_id").alias("winner"))


@c.query("with " + OBS + "select horse_id, count(*) appearances, max(race_date) last_day, arg_max(career_starts, (race_date, race_id, result_id)) career_starts from obs group by 1")
def l12_horse_analysis(spark, d):
    o = observations(spark, d)
    return o.groupBy("horse_id").agg(F.count("*").alias("appearances"), F.max("race_date").alias("last_day"), F.max_by("career_starts", F.struct("race_date", "race_id", "result_id")).alias("career_starts"))


@c.query("""
with k as (select race_date, row_number() over (order by race_date) i, count(*) over () n from (select distinct race_date from races)), s as (select starts.*, case when i <= floor(n * 0.7) then 'TRAIN' when i <= floor(n * 0.85) then 'VALID' else 'TEST' end split from starts join k using (race_date))
select count(*) as rows, count(distinct horse_id) horses, count(distinct race_id) races, count(distinct course) tracks, count(distinct trainer_id) trainers, count(distinct owner_id) owners, count(*) filter (split = 'TRAIN') train, count(*) filter (split = 'VALID') valid, count(*) filter (split = 'TEST') test from s
""")
def e29_observation_counts(spark, d):
    return p.observation_counts(m.time_split(t.starts(spark, d)))


MARKET = FIELD + """
, fm as (select s.race_id, s.horse_id, s.result_id, s.distance, s.rating, s.finish, 1 + s.quantity / 20 odds, mt.starts, mt.rating pr, mt.wins / mt.starts win_rate, (mt.wins + mt.seconds + mt.thirds) / mt.starts place_rate, mt.form_5, mt.speed_index, mt.consistency, mt.avg_finish, mt.fatigue, mt.slope
  from starts s join (select * from metrics where breed = '*') mt using (horse_id) qualify row_number() over (partition by s.race_id, s.horse_id order by s.result_id) = 1),
ws as (select *, (0.28 * pr + 32 * win_rate + 0.22 * form_5 + 0.10 * greatest(0, speed_index - 50) + case when rating > 0 then 0.08 * least(100, (rating - 20) * 0.9) else 0 end) / (0.92 + case when rating > 0 then 0.08 else 0 end) win_strength,
  30 * place_rate + 0.20 * consistency + 0.18 * greatest(0, 100 - 12 * (avg_finish - 1)) + 0.17 * form_5 + 0.10 * pr + 5 * win_rate place_strength,
  least(100, greatest(0, (0.35 * pr + 0.25 * form_5 + 0.15 * (least(150, greatest(50, speed_index)) - 50) + 15 * win_rate + case when rating > 0 then 0.10 * least(100, greatest(0, (rating - 30) * 1.1)) else 0 end) / (0.90 + case when rating > 0 then 0.10 else 0 end))) strength from fm),
sm as (select *, exp((win_strength - max(win_strength) over r) / 10) ew, exp((place_strength - max(place_strength) over r) / 11) ep, 1 / odds inv from ws window r as (partition by race_id)),
mkt as (select *, ew / sum(ew) over r win_prob, ep / sum(ep) over r place_prob, count(*) over r n, least(100, 100 * inv / sum(inv) over r * count(*) over r) perception from sm window r as (partition by race_id))
"""


def field(spark, d):
    """One row per race and horse (a horse entered twice counts by its first result), with career metrics."""
    return entered(m.with_career(m.with_field(t.starts(spark, d))))


def entered(s, *more):
    """The first results only, with the metrics' names in the markets and any further columns."""
    c = F.col
    rates = ((c("wins") / c("starts")).alias("win_rate"), ((c("wins") + c("seconds") + c("thirds")) / c("starts")).alias("place_rate"))
    return s.where("first").select("race_id", "horse_id", "result_id", "distance", c("own_rating").alias("rating"), "finish", "race_date", "course", "weight", "trainer_id", "jockey_id", (1 + c("quantity") / 20).alias("odds"),
                                   "starts", c("rating").alias("pr"), *rates, "form_5", "speed_index", "consistency", "avg_finish", "fatigue", "slope", *more)


def markets(spark, d):
    return mk.field_markets(field(spark, d))


@c.query("with " + MARKET + """select race_id, horse_id, round(win_strength, 4) win_strength, round(win_prob, 6) win_prob, round(place_prob, 6) place_prob, round(least(1, greatest(0, 1 - pow(1 - place_prob, 3) * (n / (n + 1.5)))), 6) top3, round(perception + 1e-7, 4) perception, round(win_strength - perception, 4) as value, round(strength, 4) strength from mkt""")
def j01_j04_field_markets(spark, d):
    """Strengths, softmax, win and place markets, perception and value; with D10, the field's context."""
    r = lambda k, n: F.round(k, n).alias(k)
    return markets(spark, d).select("race_id", "horse_id", r("win_strength", 4), r("win_prob", 6), r("place_prob", 6), r("top3", 6), F.round(F.col("perception") + 1e-7, 4).alias("perception"), r("value", 4), r("strength", 4))


@c.query("with " + MARKET + """, w as (select *, row_number() over (partition by race_id order by round(win_prob, 9) desc, horse_id) rn from mkt) select race_id, max(horse_id) filter (rn = 1) winner, string_agg(cast(horse_id as varchar), ',' order by rn) top3, round(max(win_prob), 6) win_prob from w where rn <= 3 group by 1""")
def j03_win_market(spark, d):
    return mk.win_market(markets(spark, d)).select("race_id", "winner", "top3", F.round("win_prob", 6).alias("win_prob"))


@c.query("with " + MARKET + """, f as (select *, arg_min(horse_id, (odds, -coalesce(rating, 0), -strength, horse_id)) over (partition by race_id) favourite from mkt), r as (select *, ew / sum(ew) over (partition by race_id) p from f where horse_id <> favourite)
select race_id, horse_id, favourite, round(p, 6) prob, cast(row_number() over (partition by race_id order by round(p, 9) desc, horse_id) as int) as rank from r""")
def j05_without_favourite(spark, d):
    return mk.without_favourite(markets(spark, d)).select("race_id", "horse_id", "favourite", F.round("prob", 6).alias("prob"), "rank")


@c.query("""
with l as (select o_orderkey ticket_id, (l_linenumber - 1) % 5 + 1 leg, l_partkey horse from orders join lineitem on o_orderkey = l_orderkey), g as (select ticket_id, leg, count(*) n, count(distinct horse) k from l group by 1, 2)
select ticket_id, cast(round(product(n)) as bigint) combinations, round(product(n)) * 2.5 as cost from g group by 1 having count(*) = 5 and bool_and(n = k)
""", base=False)
def k07_tickets(spark, d):
    return mk.tickets(selections(spark, d), 2.5)


def selections(spark, d):
    return t.read(spark, d, "lineitem").select(F.col("l_orderkey").alias("ticket_id"), ((F.col("l_linenumber") - 1) % 5 + 1).alias("leg"), F.col("l_partkey").alias("horse"))


@c.query("""
with l as (select l_orderkey ticket_id, (l_linenumber - 1) % 5 + 1 leg, l_partkey horse from lineitem) select a.ticket_id, a.horse h1, b.horse h2, c.horse h3, d.horse h4, e.horse h5
from l a join l b on a.ticket_id = b.ticket_id and b.leg = 2 join l c on a.ticket_id = c.ticket_id and c.leg = 3 join l d on a.ticket_id = d.ticket_id and d.leg = 4 join l e on a.ticket_id = e.ticket_id and e.leg = 5 where a.leg = 1
""", base=False)
def k07_enumerate_tickets(spark, d):
    return mk.enumerate_tickets(selections(spark, d))


CROWD = """
cr as (select *, 1 + coalesce(rating, 0) / 20 odds, case when result_id % 3 <> 0 then quantity end votes from starts),
ci as (select *, 1 / odds inv from cr), cs as (select *, coalesce(votes / sum(votes) over r, inv / sum(inv) over r) share from ci window r as (partition by race_id)), ck as (select *, row_number() over (partition by race_id order by round(share, 9) desc, cloth) crowd_rank from cs)
"""


def crowd(spark, d):
    s = t.starts(spark, d).withColumn("odds", 1 + F.coalesce("rating", F.lit(0.0)) / 20).withColumn("votes", F.when(F.col("result_id") % 3 != 0, F.col("quantity")))
    return mk.crowd_distribution(s)


@c.query("with " + CROWD + "select result_id, round(share, 6) share, cast(crowd_rank as int) crowd_rank from ck")
def e25_crowd_distribution(spark, d):
    return crowd(spark, d).select("result_id", F.round("share", 6).alias("share"), "crowd_rank")


CROWD_RACES = CROWD + """, g as (select race_id, count(*) n, -sum(share * log2(share)) filter (share > 0) h, stddev_pop(share) spread, arg_min(crowd_rank, finish) w, arg_min(finish, crowd_rank) f, avg(share - case when finish = 1 then 1 else 0 end) bias, avg(abs(crowd_rank - finish)) away, sum(pow(crowd_rank - finish, 2)) d2 from ck group by 1),
cm as (select race_id, n, h entropy, spread, bias, case when n > 1 then least(100, greatest(0, (2 - 6 * d2 / (n * (n * n - 1))) * 50)) else 0 end accuracy, case when n > 1 then (w - 1) / (n - 1) * 100 else 0 end upset, case when n > 1 then (f - 1) / (n - 1) * 100 else 0 end favourite_failure, case when n > 1 then away / (n - 1) * 100 else 0 end surprise, case when n > 1 then least(100, greatest(0, h / log2(n) * 100)) else 0 end difficulty from g),
cr2 as (select *, 1 - difficulty / 100 confidence, round((favourite_failure + upset + 100 - accuracy) / 3, 3) shock from cm)"""
CROWD_ENTITIES = CROWD + """, ch0 as (select ck.*, sire_id from ck join horses using (horse_id)), l as (unpivot (select share, crowd_rank, finish, horse_id, trainer_id, jockey_id, owner_id, sire_id from ch0) on horse_id, trainer_id, jockey_id, owner_id, sire_id into name role value entity_id),
en as (select role, entity_id, count(*) n, avg(share) * 100 popularity, count(*) filter (crowd_rank = 1 and finish = 1) / nullif(count(*) filter (crowd_rank = 1), 0) * 100 trust, coalesce(-avg(crowd_rank - finish) filter (crowd_rank < finish), 0) overrated, coalesce(avg(crowd_rank - finish) filter (crowd_rank > finish), 0) underrated, case when count(*) > 1 then stddev_pop(abs(crowd_rank - finish)) else 0 end unpredictability,
  count(*) filter (abs(crowd_rank - finish) >= 2) / count(*) * 100 surprise_frequency, count(*) filter (crowd_rank = 1 and finish > 1) / nullif(count(*) filter (crowd_rank = 1), 0) * 100 favourite_failure, coalesce(count(*) filter (finish = 1 and crowd_rank >= 3) / nullif(count(*) filter (finish = 1), 0) * 100, 0) upset_wins, avg(crowd_rank) avg_crowd_rank, avg(finish) avg_finish, avg(crowd_rank - finish) gap from l group by 1, 2)"""
_ROLES = ["horse_id", "trainer_id", "jockey_id", "owner_id", "sire_id"]
_SCORES = ["popularity", "trust", "overrated", "underrated", "unpredictability", "surprise_frequency", "favourite_failure", "upset_wins", "avg_crowd_rank", "avg_finish", "gap"]


def crowd_races(spark, d, rows=None):
    """`rows` is a crowd that is written; its rows are shuffled by race before they are grouped."""
    prizes = t.races(spark, d).select("race_id", "prize", (F.col("prize") * 0.6).alias("winners_share"))
    rows = crowd(spark, d) if rows is None else rows.select("race_id", "share", "crowd_rank", "finish").repartition(partitions(spark), "race_id")
    return mk.crowd_race_metrics(rows, prizes)


def crowd_entities(spark, d, rows=None):
    rows = (crowd(spark, d) if rows is None else rows).join(t.horses(spark, d).select("horse_id", "sire_id"), "horse_id").select(*_ROLES, "share", "crowd_rank", "finish")
    return mk.crowd_entity_metrics(written(rows, "crowd"), _ROLES, many=("horse_id", "owner_id"))


@c.query("with " + CROWD_RACES + "select race_id, n, round(entropy, 5) entropy, round(spread, 6) spread, round(bias, 6) bias, round(accuracy, 4) accuracy, round(upset, 4) upset, round(favourite_failure, 4) favourite_failure, round(surprise, 4) surprise, round(confidence, 6) confidence, shock, round(prize, 2) prize_total, round(prize * 0.6, 2) winners_share from cr2 join races using (race_id)")
def e26_crowd_race_metrics(spark, d):
    g = crowd_races(spark, d)
    return g.select("race_id", "n", *(F.round(k, n).alias(k) for k, n in (("entropy", 5), ("spread", 6), ("bias", 6), ("accuracy", 4), ("upset", 4), ("favourite_failure", 4), ("surprise", 4), ("confidence", 6), ("shock", 3), ("prize_total", 2), ("winners_share", 2))))


@c.query("with " + CROWD_ENTITIES + f"select role, entity_id, n, {', '.join(f'round({k}, 5) {k}' for k in _SCORES)} from en")
def e27_crowd_entity_metrics(spark, d):
    """All five roles and all scores."""
    return crowd_entities(spark, d).select("role", "entity_id", "n", *(F.round(k, 5).alias(k) for k in _SCORES))


def _questions() -> str:
    one = lambda o: f"coalesce(round({'-' if o[0] == '-' else ''}{o.lstrip('-')}, 9), 1e18)"
    part = lambda q, r, order: f"select '{q}' question, cast(row_number() over (order by {', '.join(map(one, order))}, {'race_id' if r == 'race' else 'entity_id'}) as int) as rank, {'race_id' if r == 'race' else 'entity_id'} id from {'cr2' if r == 'race' else f'en where role = ' + repr(r) + ' and n >= 5'} qualify rank <= 10"
    return " union all ".join(f"({part(q, r, order)})" for q, (r, order) in mk.MARKET_QUESTIONS.items())


@c.query("with " + CROWD_RACES + CROWD_ENTITIES[len(CROWD) :] + " select * from (" + _questions() + ")")
def g08_market_question(spark, d):
    """All questions at once, each with its first ten answers."""
    rows = written(crowd(spark, d).select("race_id", *(k for k in _ROLES if k != "sire_id"), "share", "crowd_rank", "finish"), "crowd")
    return mk.market_questions(crowd_entities(spark, d, rows), crowd_races(spark, d, rows))


@c.query("select user_id % 20 meeting_id, min(ts) first_start, count(*) events from events where ts > timestamp '2024-01-05' and ts <= timestamp '2024-01-12' group by 1", base=False)
def c05_upcoming(spark, d):
    program = t.read(spark, d, "events").select((F.col("user_id") % 20).alias("meeting_id"), F.col("ts").alias("starts_at"))
    return mk.upcoming(program, F.lit("2024-01-05").cast("timestamp"), 7)


@c.query("select s.result_id, s.race_id, course, race_date, n_name people, field_size from (select *, count(*) over (partition by race_id) field_size from starts) s join supplier on trainer_id = s_suppkey join nation on s_nationkey = n_nationkey join horses using (horse_id)")
def d01_d03_assemble_starts(spark, d):
    """Result, race, horse, people and weather on one row; with A1, C2, D2, D12 and H1's shapes."""
    nation = F.broadcast(t.read(spark, d, "nation").select("n_nationkey", F.col("n_name").alias("people")))
    trainers = t.read(spark, d, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("trainer_id"), "people")
    races = t.races(spark, d)
    r = t.results(spark, d)
    s = m.assemble_starts(r.withColumn("time_s", 1000 / F.col("speed")), races, t.horses(spark, d).select("horse_id", "sex", "birthdate"), {"trainer_id": trainers}, t.weather_daily(spark, d))
    return s.select("result_id", "race_id", races["course"], "race_date", "people", "field_size")


def folder(spark) -> str:
    """A new folder below the one that the session names, which all executors share; else a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    return f"{base.rstrip('/')}/furlong-stream-{uuid.uuid4().hex}" if base else tempfile.mkdtemp(prefix="furlong-stream-")


def stream_of(spark, d, name):
    base = t.read(spark, d, name)
    return spark.readStream.schema(base.schema).option("pathGlobFilter", f"{name}*").parquet(d).withColumn("ts", F.col("ts").cast("timestamp"))


@c.query("select event_type, cast(ts as date) as day, count(*) n from events group by 1, 2", base=False)
def s03_stream_daily_counts(spark, d):
    """The stream run over all that is there, complete mode; equal to the batch count."""
    out = st.stream_daily_counts(stream_of(spark, d, "events"), "ts", "event_type", "3650 days")
    return st.stream_table(out, folder(spark))


@c.query("select user_id, event_id, value from events qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1", base=False)
def s02_stream_latest(spark, d):
    out = st.stream_latest(stream_of(spark, d, "events").select("event_id", "user_id", "ts", "value"), ["user_id"], "ts", "3650 days")
    return st.stream_table(out, folder(spark)).select("user_id", "event_id", "value")


@registry.register("people totals")
def _people_totals(tables, least: int = 1):
    return m.entity_totals(tables["starts"], ["trainer_id", "jockey_id"]).where(F.col("starts") >= least)


@c.query("with " + TOTALS + "select role, entity_id, starts, wins from totals where role in ('trainer_id', 'jockey_id') and starts >= 20")
def u01_registry(spark, d):
    return registry.run("people totals", {"starts": t.starts(spark, d)}, least=20)[0].select("role", "entity_id", "starts", "wins")
