import difflib
import random

import pytest
from pyspark.sql import functions as F

from furlong.operators import identity, similarity
from names_in_python import edits, plain


def words(rng, letters, n, most):
    return sorted({" ".join("".join(rng.choice(letters) for _ in range(rng.randrange(0, most))) for _ in range(2)).strip() for _ in range(n)})


@pytest.mark.parametrize("by_edits", [True, False])
def test_the_index_loses_no_pair(spark, by_edits):
    ratio = edits if by_edits else lambda a, b: difflib.SequenceMatcher(None, a, b).ratio()
    rng = random.Random(3)
    left, right = words(rng, "ab", 40, 7) + words(rng, "abcdefgh", 30, 14), words(rng, "ab", 40, 7) + words(rng, "abcdefgh", 30, 14)
    right += [w[:i] + rng.choice("xyz ") + w[i + 1 :] for w in left for i in [rng.randrange(len(w) + 1)]] + [left[3] + " of the " + left[9], "é", "éa", "a"]
    frame = lambda v: spark.createDataFrame([(x,) for x in v], "key string")
    scores = {(a, b): plain(a, b, ratio) for a in left for b in right if a and b and a != b}
    for t in (0.55, 0.7, 0.88, 0.92):
        got = {(r["key"], r["other"]) for r in similarity.similar(frame(left), frame(right), t, by_edits).collect()}
        assert got == {k for k, v in scores.items() if v >= t - 1e-9} and len(got) > 20


def test_the_plan_has_no_nested_loop(spark):
    df = spark.range(50).select(F.concat(F.lit("name "), F.col("id").cast("string")).alias("key"), "id")
    queries = df.select(F.col("id").alias("query_id"), "key")
    plan = identity.resolve(queries, df, 3)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_a_source_id_comes_first(spark):
    directory = spark.createDataFrame([(1, "red rod", "s1"), (2, "blue gear", "s2"), (3, "red rods", None), (2, "old blue gear", "")], "id long, key string, source_id string")
    queries = spark.createDataFrame([(1, "red rod", "s2"), (2, "red rod", "none"), (3, "blu gear", None), (4, "", None)], "query_id long, key string, source_id string")
    got = [tuple(r) for r in identity.resolve(queries, directory, 2, edits=False).orderBy("query_id", "rank").select("query_id", "id", "decision", "rank").collect()]
    assert got == [(1, 2, "source_id", 1), (2, 1, "exact", 1), (2, 3, "name", 2), (3, 2, "name", 1)]


def test_no_names(spark):
    none, one = spark.createDataFrame([], "key string"), spark.createDataFrame([("a",), (None,), ("",)], "key string")
    assert similarity.similar(none, one, 0.7).count() == similarity.similar(one, none, 0.7).count() == similarity.similar(one, one, 0.7).count() == 0


def test_ratios_from_a_threshold_are_difflib_s_where_they_reach_it(spark):
    rng = random.Random(4)
    w = words(rng, "abcdef", 40, 8)
    df = spark.createDataFrame([(p, q) for p in w for q in w], "a string, b string")
    for r in df.select("a", "b", similarity.matching_ratio_from(0.7)("a", "b").alias("s")).collect():
        want = difflib.SequenceMatcher(None, r["a"], r["b"]).ratio()
        assert r["s"] == want or want <= r["s"] < 0.7
