import datetime as dt
import difflib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from furlong.catalogue.ingest import keep
from furlong.operators import graph, identity, ingest, markets, metrics, priors, quality
from furlong.plans import registry
from furlong.sources import store
from furlong.streaming import ingest as streaming

STARTS = "horse_id long, race_id long, result_id long, race_date date, finish int, breed string, course string, distance long, trainer_id long, rating double, weight double"


def starts(spark):
    day = lambda n: dt.date(2024, 1, 1) + dt.timedelta(n)
    rows = [(1, 10, 100, day(0), 1, "a", "x", 1000, 7, 50.0, 55.0), (2, 10, 101, day(0), 2, "a", "x", 1000, 7, 60.0, 56.0), (1, 11, 110, day(9), 3, "a", "y", 1000, 8, 55.0, 55.0), (2, 11, 111, day(9), 1, "a", "y", 1000, 7, None, 57.0), (1, 12, 120, day(20), 2, "a", "x", 1600, 7, 58.0, 54.0)]
    return spark.createDataFrame(rows, STARTS)


def test_priors_never_see_their_own_race(spark):
    s = starts(spark)
    o = priors.prior_features(s, s.agg(F.avg((F.col("finish") == 1).cast("int")).alias("prior_win")), {"distance": "distance"})
    got = {r["result_id"]: r for r in o.collect()}
    assert got[100]["career_starts"] == 0 and got[100]["career_win_rate"] is None
    assert (got[120]["career_starts"], got[120]["career_wins"], got[120]["career_win_rate"]) == (2, 1, 0.5)
    assert got[120]["distance_starts"] == 0 and got[110]["days_since"] == 9
    assert priors.leaks(o).first()[0] == 0
    people = {(r["trainer_id"], r["race_id"]): r["trainer_starts"] for r in priors.people_priors(s, "trainer_id").collect()}
    assert people[(7, 10)] == 0 and people[(7, 11)] == 2


def test_no_order_is_invented_without_scores(spark):
    s = starts(spark).withColumn("B", F.lit(None).cast("double"))
    assert priors.rank_races(s, ["B"]).where("rank is not null").count() == 0


def test_probabilities_sum_to_one(spark):
    s = starts(spark).withColumn("p", markets.softmax(F.col("weight"), 10.0))
    assert all(abs(r["t"] - 1) < 1e-9 for r in s.groupBy("race_id").agg(F.sum("p").alias("t")).collect())


def test_scd2_is_idempotent_and_keeps_versions(spark):
    df = spark.createDataFrame([(1, "a", 1), (1, "a", 2), (1, "b", 3), (2, None, 1)], "k long, v string, at int")
    first = ingest.scd2_append(None, df, ["k"], ["v"], "at")
    again = ingest.scd2_append(first, df.where("at = 3 or k = 2"), ["k"], ["v"], "at")
    rows = lambda t: sorted((r["k"], r["v"] or "", r["version"], r["is_current"]) for r in t.collect())
    assert rows(first) == rows(again) == [(1, "a", 1, False), (1, "b", 2, True), (2, "", 1, True)]


def test_stream_of_versions_equals_batch(spark, tmp_path):
    source = tmp_path / "in"
    df = spark.createDataFrame([(i % 5, f"v{i // 7}", i) for i in range(60)], "k long, v string, at int")
    df.where("at < 30").coalesce(1).write.parquet(str(source))
    df.where("at >= 30").coalesce(1).write.mode("append").parquet(str(source))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(source))
    streaming.stream_scd2(stream, str(tmp_path / "out"), str(tmp_path / "cp"), ["k"], ["v"], "at").awaitTermination()
    last = max(int(p.name[2:]) for p in (tmp_path / "out").glob("v=*"))
    got = spark.read.parquet(str(tmp_path / f"out/v={last}"))
    want = ingest.scd2_append(None, df, ["k"], ["v"], "at")
    assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))


def test_observations_round_trip_and_freeze(spark, tmp_path):
    s = starts(spark)
    ingest.write_observations(s, str(tmp_path / "o"))
    back = ingest.read_observations(spark, str(tmp_path / "o"), s.schema)
    manifest = ingest.freeze(s, "v1")
    ingest.assert_frozen(back, manifest)
    with pytest.raises(ValueError):
        ingest.assert_frozen(s.where("race_id > 10"), manifest)
    ingest.write_sample(s, str(tmp_path / "c"), 2, "race_id", "result_id")
    assert spark.read.csv(str(tmp_path / "c"), header=True).count() == 2


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (7, 7)], "src long, dst long")
    got = dict(map(tuple, graph.connected_components(edges, keep).collect()))
    assert {got[i] for i in range(41)} == {0} and got[102] == got[101] == 100
    assert graph.connected_components(edges.where("src < 0"), keep).count() == 0


def test_components_of_a_long_path(spark):
    ends = spark.range(10_000).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    assert graph.connected_components(ends).agg(F.count("*"), F.max("component")).first() == (10_001, 0)


@pytest.mark.parametrize("place", [lambda c: 9_999 - c, lambda c: F.pmod(c * 7_919, F.lit(10_007))])
def test_rounds_of_a_long_path_whatever_the_order(spark, place):
    rounds = []

    def keep(df):
        if df.columns == ["a", "b"]:
            rounds.append(1)
        return store.written(df)

    ends = spark.range(9_999).select(place(F.col("id")).alias("src"), place(F.col("id") + 1).alias("dst"))
    assert graph.connected_components(ends, keep).agg(F.count("*"), F.max("component")).first() == (10_000, 0)
    assert len(rounds) <= 20


def test_a_star_takes_one_round(spark):
    rounds = []
    ends = spark.range(1, 3_000).select(F.lit(5_000).alias("src"), F.col("id").alias("dst"))
    keep = lambda df: rounds.append(df.columns) or store.written(df)
    assert {r["component"] for r in graph.connected_components(ends, keep).collect()} == {1}
    assert rounds.count(["a", "b"]) == 2  # as given, and contracted to nothing


def test_seasons_and_ranges(spark):
    day = lambda n: dt.date(2024, 1, 1) + dt.timedelta(n)
    days = spark.createDataFrame([("x", day(n)) for n in (0, 7, 14, 90, 97)], "course string, race_date date")
    s = sorted((r["season"], r["days"], r["complete"]) for r in metrics.seasons(days, "course").collect())
    assert s == [(0, 3, True), (1, 2, False)]
    gaps = quality.missing_ranges(days.where("race_date < '2024-01-10'"), days.select("course", F.col("race_date").alias("day")), 1)
    assert sorted(r["days"] for r in gaps.collect()) == [1, 1]


def test_registry_counts_rows(spark):
    registry.register("odd rows")(lambda tables, step=2: tables["t"].where(F.col("id") % step == 1))
    df, seen = registry.run("odd rows", {"t": spark.range(10)})
    df.collect()
    assert seen.get == {"rows": 5}
    with pytest.raises(KeyError):
        registry.run("none", {})


def test_embedded_json_scanner():
    assert ingest.balanced('x{"a":"}\\"{","b":[1,{}]} y', 1) == '{"a":"}\\"{","b":[1,{}]}'
    assert ingest.balanced("{open", 0) is None


def similarity(a, b, ratio):
    ca, cb = a.replace(" ", ""), b.replace(" ", "")
    if not a or not b:
        return 0.0
    return 1.0 if a == b else 0.99 if ca == cb else max(ratio(a, b), 0.9) if ca in cb or cb in ca else ratio(a, b)


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return 1 - row[-1] / max(len(a), len(b))


def test_resolve_meets_all_names(spark):
    names = ["small ring", "smll ring", "large ring", "x", "a small ring of gold", "smallring", "red rod", "rad rod", "ed rod", "small ring", ""]
    asked = ["smll ring", "lrge ring", "small ring", "ring", "x", "d rod", "zzzz", ""]
    got = identity.resolve(spark.createDataFrame(list(enumerate(asked)), "query_id long, key string"), spark.createDataFrame(list(enumerate(names)), "id long, key string"), 3)
    want = set()
    for q, a in enumerate(asked):
        hits = [(-round(0.99 if a == n else similarity(a, n, edits), 6), i) for i, n in enumerate(names) if a and n and similarity(a, n, edits) >= 0.7 - 1e-9]
        want |= {(q, i, -s, r) for r, (s, i) in enumerate(sorted(hits)[:3], 1)}
    assert {(r["query_id"], r["id"], round(r["score"], 6), r["rank"]) for r in got.collect()} == want and len(want) > 12


def score(p, q):
    ratio = lambda a, b: difflib.SequenceMatcher(None, a, b).ratio()
    ns, kinds = similarity(p["key"], q["key"], ratio), ("male", "female", "gelding")
    equal = lambda a, b: None if a is None or b is None else float(a == b)
    among = lambda a, b: None if a is None or not b else float(a in b)
    sex = None if p["sex"] not in kinds or q["sex"] not in kinds else 1.0 if p["sex"] == q["sex"] else 0.4 if "female" not in (p["sex"], q["sex"]) else 0.0
    year = None if p["year"] is None or q["year"] is None else {0: 1.0, 1: 0.7, 2: 0.3}.get(abs(p["year"] - q["year"]), 0.0)
    flow, clash, (da, db), (ca, cb) = None, False, (p["days"], q["days"]), (set(p["courses"]), set(q["courses"]))
    if da and db:
        gap = min(abs((a - b).days) for a in da for b in db)
        clash = bool(set(da) & set(db) and ca - cb and cb - ca and not ca & cb)
        mixed = (min(da) < max(db) and min(db) < max(da)) or gap <= 120
        flow = 0.0 if clash else 0.55 if len({*da, *db}) < 2 else 0.95 if mixed and ca != cb and gap <= 60 else 0.85 if mixed and gap <= 120 else 0.75 if ca & cb and gap <= 180 else 0.6 if gap <= 365 else 0.25 if gap > 900 else 0.45
    signals = [(0.3, ns), (0.12, equal(p["sire"], q["sire"])), (0.12, equal(p["dam"], q["dam"])), (0.1, year), (0.08, sex), (0.08, among(p["owner"], q["owners"])), (0.07, among(p["trainer"], q["trainers"])), (0.13, flow)]
    total = sum(w * s for w, s in signals if s is not None) / sum(w for w, s in signals if s is not None)
    total *= (0.35 if sex == 0 else 1) * (0.5 if ns < 0.55 else 1) * (0.25 if clash else 1) * (0.55 if year == 0 else 1)
    if p["source"] and p["source_id"] and (p["source"], p["source_id"]) == (q["source"], q["source_id"]):
        total = max(total, 0.99)
    verdict = "auto" if total >= 0.88 and ns >= 0.8 else "candidate" if total >= 0.72 and ns >= 0.65 else "distinct"
    if verdict != "auto" and not clash and ns >= 0.98 and sex == 1 and year is not None and year >= 0.7 and flow is not None and flow >= 0.75:
        total, verdict = max(total, 0.88), "auto"
    return round(total, 6), verdict


def test_pairs_are_found_and_scored_on_all_signals(spark):
    rng, day = random.Random(5), lambda n: dt.date(2020, 1, 1) + dt.timedelta(n)
    some = lambda *v: rng.choice([None, *v, *v])
    rows = []
    for i in range(70):
        at, o, tr = rng.choice((0, 0, 30, 400, 2000)), some(1, 2), some(3, 4)
        days = sorted({day(at + rng.choice((0, 5, 90, 150))) for _ in range(rng.choice((0, 1, 2, 3)))})
        rows.append({"id": i, "key": rng.choice(("red rod", "red rods", "redrod", "red plate", "blue gear", "blue gears b", "blu", "")), "sex": some("male", "female", "gelding"), "year": some(2001, 2002, 2004, 2009), "sire": some(1, 2), "dam": some(5), "owner": o, "trainer": tr, "owners": [o] if o else [], "trainers": [tr] if tr else [], "days": days, "courses": sorted(rng.sample("xyz", rng.choice((1, 2)))) if days else [], "source": "s", "source_id": some("1", "2", *"abcdefghij")})
    kind = "id long, key string, sex string, year int, sire long, dam long, owner long, trainer long, owners array<long>, trainers array<long>, days array<date>, courses array<string>, source string, source_id string"
    df = spark.createDataFrame([tuple(r.values()) for r in rows], kind)
    side = lambda k: df.select(*(F.col(c).alias(k if c == "id" else f"{c}_{k}") for c in df.columns))
    pairs = identity.candidate_pairs(df, large=8)
    got = {(r["a"], r["b"]): (round(r["score"], 6), r["verdict"]) for r in identity.score_pairs(identity.name_scores(pairs.join(side("a"), "a").join(side("b"), "b"))).collect()}
    block = lambda r: (r["sex"], r["key"].split(" ")[0], r["key"].replace(" ", "")[:3])
    sizes = Counter(map(block, rows))
    met = lambda p, q: (p["key"] and p["key"] == q["key"]) or (p["source_id"] and p["source_id"] == q["source_id"]) or (block(p) == block(q) and sizes[block(p)] <= 8)
    want = {(p["id"], q["id"]): score(p, q) for p in rows for q in rows if p["id"] < q["id"] and met(p, q)}
    assert got.keys() == want.keys() and len(want) > 100 and max(sizes.values()) > 8
    assert all(got[k][1] == want[k][1] and abs(got[k][0] - want[k][0]) < 2e-6 for k in want) and {v for _, v in want.values()} == {"auto", "candidate", "distinct"}


def test_fuzzy_pairs_lose_none_above_the_threshold(spark):
    names = ["small ring", "smoll ring", "smal ring", "sm", "small", "smallring", "small ring of the old gold mine", "large ring", "smXX ring", "small rings", "small ring"]
    df = spark.createDataFrame(list(enumerate(names)), "id long, key string")
    first = {n: names.index(n) for n in names}
    for ratio, plain in ((identity.levenshtein_ratio, edits), (identity.matching_ratio, lambda a, b: difflib.SequenceMatcher(None, a, b).ratio())):
        want = {tuple(sorted((first[a], first[b]))) for a in first for b in first if a < b and a[:2] == b[:2] and similarity(a, b, plain) >= 0.88}
        got = identity.match_candidates(df, 0.88, F.substring("key", 1, 2), ratio).collect()
        assert {(r["a"], r["b"]) for r in got if r["method"] == "fuzzy"} == want and (3, 6) in want
        assert {(r["a"], r["b"]) for r in got if r["review"]} == {(0, 5)}


def test_streams_end_as_a_table_on_disk(spark, tmp_path):
    spark.createDataFrame([(1, 1), (1, 2), (2, 5)], "k long, v long").write.parquet(str(tmp_path / "in"))
    source = lambda: spark.readStream.schema("k long, v long").parquet(str(tmp_path / "in"))
    out = streaming.stream_table(source().groupBy("k").agg(F.max("v").alias("v")), str(tmp_path / "out"))
    assert sorted(map(tuple, out.collect())) == [(1, 2), (2, 5)]
    assert all(str(tmp_path / "out") in f for f in out.inputFiles()) and out.inputFiles()


def test_pairs_meet_with_their_sides_as_often_as_candidates(spark):
    rows = [(i, ("red rod", "red rods", "blue gear", "")[i % 4], ("male", "female")[i % 3 == 0], "s", str(i % 9) if i % 5 else "") for i in range(60)]
    df = spark.createDataFrame(rows, "id long, key string, sex string, source string, source_id string")
    got, want = identity.paired(df, large=8), identity.candidate_pairs(df, large=8)
    assert sorted(map(tuple, got.select("a", "b").collect())) == sorted(map(tuple, want.collect()))
    side = lambda k: df.select(F.col("id").alias(k), F.col("key").alias(f"key_{k}"))
    scores = identity.name_scores(want.join(side("a"), "a").join(side("b"), "b")).select("a", "b", "name_score")
    assert sorted(map(tuple, got.select("a", "b", "name_score").collect())) == sorted(map(tuple, scores.collect()))


def test_days_apart_is_the_least_of_all_pairs(spark):
    rng, day = random.Random(3), lambda: dt.date(2020, 1, 1) + dt.timedelta(rng.randrange(400))
    rows = [([day() for _ in range(rng.randrange(6))], [day() for _ in range(rng.randrange(6))]) for _ in range(80)]
    got = spark.createDataFrame(rows, "a array<date>, b array<date>").select("a", "b", identity.days_apart(F.col("a"), F.col("b")).alias("gap")).collect()
    assert all(r["gap"] == min((abs((p - q).days) for p in r["a"] for q in r["b"]), default=None) for r in got)
