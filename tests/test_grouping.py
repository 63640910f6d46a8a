"""Where rows are grouped: after the shuffle that holds them, and only what may count."""

import datetime as dt
import random
import re
from collections import defaultdict

from pyspark.sql import functions as F

from furlong.catalogue import checks as cases
from furlong.catalogue import ingest, scoring, starts
from furlong.operators import checks, markets, prerace, quality

SF = "/root/testdata/sf0.001"
DAY = lambda n: dt.date(2024, 1, 1) + dt.timedelta(n)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_horses_of_every_race(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["x", "y", None]), DAY(rng.randrange(8)), r, rng.choice([None, 1, 2, 3, 4])) for r in range(60) for _ in range(4)]
    field, size = defaultdict(set), defaultdict(set)
    where = {r: (course, day) for course, day, r, _ in rows}
    rows = [(*where[r], r, h) for _, _, r, h in rows]
    for course, day, r, h in rows:
        if course:
            field[course, day, h].add(r)
            size[course, day].add(r)
    want = {(*k, len(v), len(v)) for k, v in field.items() if len(v) > 1 and len(v) == len(size[k[:2]])}
    s = spark.createDataFrame(rows, "course string, race_date date, race_id long, horse_id long")
    got = quality.in_every_race(s, ["course", "race_date"]).select("group_id.*", "horse_id", "races", "group_size").collect()
    assert set(map(tuple, got)) == want and len(got) == len(want) and want


def test_overlap_counts_only_what_may_be_in_every_race(spark):
    assert "l_orderkey" not in plan(ingest.h04_overlap(spark, SF))  # starts are written once, and read with few horses


def test_preferences_are_grouped_by_dimension_after_the_shuffle(spark):
    rng = random.Random(2)
    rows = [(rng.randrange(5), rng.randrange(1, 4), DAY(rng.randrange(9)), rng.choice([None, 1000, 1200, 900]), rng.choice("ab")) for _ in range(200)]
    s = spark.createDataFrame(rows, "horse_id long, finish int, race_date date, distance int, course string")
    out = prerace.preferences(s, {"distance": "distance", "course": "course"})
    assert "Generate" not in plan(out)
    for r in out.collect():
        for name, at in (("distance", 3), ("course", 4)):
            held = defaultdict(list)
            for x in rows:
                if x[0] == r["horse_id"] and x[at] is not None:
                    held[str(x[at])].append(x)
            best = max((round(sum(x[1] == 1 for x in v) / len(v) * (1 - 0.5 / (len(v) + 0.5)), 9), max(x[2] for x in v), k) for k, v in held.items())
            assert (r[f"{name}_pref"], r[f"{name}_pref_score"]) == (best[2], best[0])


def test_segments_are_exploded_after_the_shuffle_by_horse(spark):
    text = plan(starts.g06_segment_boards(spark, SF))
    assert not re.search(r"hashpartitioning\(segment#\d+, value#\d+, [^)]*horse_id", text) and "hashpartitioning(horse_id" in text


def test_roles_of_many_entities_are_shuffled_before_they_are_grouped(spark):
    rows = [(i % 3, i % 2, 0.25, i % 4 + 1, i % 5 + 1) for i in range(40)] + [(None, 1, 0.5, 1, 1)]
    crowd = spark.createDataFrame(rows, "horse_id long, jockey_id long, share double, crowd_rank int, finish int")
    plain, many = (markets.crowd_entity_metrics(crowd, ["horse_id", "jockey_id"], many=k) for k in ((), ("horse_id",)))
    rounded = lambda df: sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect())
    assert rounded(plain) == rounded(many) and len(rounded(many)) == 5
    assert "REPARTITION_BY_NUM" in plan(many)
    assert "l_orderkey" not in plan(scoring.crowd_entities(spark, SF))  # the crowd is written once for all roles


def test_only_odd_results_are_grouped(spark):
    assert "l_orderkey" not in plan(cases.q02_warehouse_checks(spark, SF))
    rows = [(10, 1, 1, 1, 60.0), (11, 1, 1, 2, 60.0), (12, 1, 2, None, 60.0), (20, 2, 1, 3, 60.0), (21, 2, 2, 3, 60.0), (22, 2, 3, 3, 700.0), (30, 3, 1, 1, 60.0), (31, 3, None, 2, 60.0), (32, 3, None, 2, 60.0), (40, 4, 1, 0, 60.0), (41, 4, 2, 9, None)]
    results = spark.createDataFrame(rows, "result_id long, race_id long, horse_id long, finish int, time_s double")
    races = spark.createDataFrame([], "race_id long, course string, race_date date, number int, name string, prize double")
    horses = spark.createDataFrame([], "horse_id long, name string")
    got = {tuple(r) for r in checks.warehouse_checks(races, results, horses).select("check", "severity", "id", "details").collect()}
    assert got == {
        ("duplicate_results", "error", 10, 1), ("missing_finish_position", "warning", 12, 1), ("impossible_race_time", "error", 22, 700),
        ("impossible_finish_order", "warning", 2, 3), ("impossible_finish_order", "error", 4, 0), ("impossible_finish_order", "warning", 4, 9),
    }


def test_benchmark_of_metrics_by_name_only(spark):
    """Metrics keep the order of their keys, though windows sort by horse first."""
    assert starts.metrics(spark, SF).columns[:2] == ["breed", "horse_id"] and starts.metrics(spark, SF).select(F.count("*")).first()[0] > 0
