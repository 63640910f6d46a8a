import datetime as dt
import difflib
import random

from pyspark.sql import functions as F

from furlong.operators import identity, markets, metrics, prerace

DAY = lambda n: dt.date(2024, 1, 1) + dt.timedelta(n)


def test_a_mean_difficulty_is_summed_from_the_newest_start(spark):
    own = {1: (0.3, 0.2, 0.1), 2: (0.1, 0.2, 0.3)}  # newest first: equal as numbers, not as sums of doubles
    rows = [(10 * h + i, h, DAY(9 - i), 30 + v / 0.605, 1) for h, vs in own.items() for i, v in enumerate(vs)]
    s = spark.createDataFrame(rows, "race_id long, horse_id long, race_date date, mean_rating double, finish int").repartition(3)
    s = s.withColumns({"result_id": F.col("race_id"), "rating": F.lit(50.0), "field_size": F.lit(0), "mean_speed": F.lit(15.0), "distance": F.lit(1200), "time_s": F.lit(80.0), "earnings": F.lit(1.0)})
    got = {r["horse_id"]: r["difficulty"] for r in metrics.with_career(s).collect()}
    assert got == {h: (a + b + c) / 3 for h, (a, b, c) in own.items()} and got[1] != got[2]


def test_large_blocks_lose_no_pair(spark):
    rows = [(i, ("red rod", "red rods", "red rod b", "red plate", "")[i % 5], ("male", "female")[i % 3 == 0]) for i in range(700)]
    df = spark.createDataFrame(rows, "id long, key string, sex string")
    got = {(r["a"], r["b"]): r["name_score"] for r in identity.paired(df).select("a", "b", "name_score").collect()}
    want = {(p, q) for p, k, s in rows for q, m, t in rows if p < q and (k == m != "" or (s, k[:3]) == (t, m[:3]))}
    assert got.keys() == want and identity.paired(df).count() == len(want) > 100_000
    assert sorted(map(tuple, identity.candidate_pairs(df).collect())) == sorted(want)
    ratio = difflib.SequenceMatcher(None, "red rod", "red plate").ratio()
    assert got[0, 3] == got[5, 8] == ratio and got[0, 5] == 1.0 and got[4, 19] == 0.0


def test_careers_meet_in_batches_as_by_hand(spark):
    rng = random.Random(4)
    rows = [tuple(rng.choice([None, sorted({DAY(rng.randrange(60)) for _ in range(rng.randrange(5))})]) for _ in "ab") + tuple(rng.choice([None, rng.sample("xyz", rng.randrange(3))]) for _ in "ab") for _ in range(200)]
    df = spark.createDataFrame(rows, "a array<date>, b array<date>, p array<string>, q array<string>")
    for r in df.select("a", "b", "p", "q", identity.careers_met("a", "b", "p", "q").alias("m")).collect():
        both = [None if r[x] is None or r[y] is None else (set(r[x]), set(r[y])) for x, y in ("ab", "pq")]
        days = (None, None) if both[0] is None else (min((abs((v - w).days) for v in r["a"] for w in r["b"]), default=None), len(both[0][0] & both[0][1]))
        courses = (None,) * 3 if both[1] is None else (len(both[1][0] & both[1][1]), len(both[1][0] - both[1][1]), len(both[1][1] - both[1][0]))
        assert tuple(r["m"]) == days + courses


def test_scores_are_compiled_in_small_methods(spark):
    kind = "id long, key string, sex string, year int, sire long, dam long, owner long, trainer long, owners array<long>, trainers array<long>, days array<date>, courses array<string>"
    out = identity.score_pairs(identity.paired(spark.createDataFrame([], kind)))
    plan = out._jdf.queryExecution().optimizedPlan().toString().split("\n")
    scored = [line for line in plan if "Project" in line and ("_s#" in line or "_flow#" in line)]
    assert scored and all("lambdafunction" in line for line in scored)  # such a projection is not fused


def test_ratings_and_chances_are_compiled_in_small_methods(spark):
    names = ["pr", "win_rate", "form_5", "speed_index", "rating", "place_rate", "consistency", "avg_finish", "distance_pref_score", "track_pref_score", "jockey_pref_score", "trainer_pref_score", "weather_pref_score", "fatigue", "adjusted_pr"]
    f = spark.createDataFrame([], ", ".join(f"{n} double" for n in names) + ", starts long, rest_days int, rain double")
    career = spark.createDataFrame([], ", ".join(f"{n} double" for n in ("sd", "avg_finish", "form_5", "speed_index", "difficulty", "slope")) + ", starts long, wins long, seconds long, thirds long, gap int, starts_30 long")
    spark.conf.set("spark.sql.debug.maxToStringFields", "200")
    for out, name in ((markets.strengths(f), "win_strength"), (prerace.chance(markets.strengths(f), F.lit(True)), "chance"), (metrics.rated(career), "rating")):
        plan = out._jdf.queryExecution().analyzed().toString().split("\n")
        assert any(f" AS {name}#" in line and "lambdafunction" in line for line in plan), name
    spark.conf.unset("spark.sql.debug.maxToStringFields")
