import hashlib
import random

import pytest
from pyspark.sql import functions as F

from furlong.llm import merkle

DOCS = "doc_id long, source string, lang string, n_chars long, text string"
COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def got(df, levels=merkle.LEVELS):
    made = merkle.manifest(df, {"tampered": merkle.tampered_leaf(df)}, levels)
    return sorted(map(tuple, merkle.digest(made.proofs()).select(COLUMNS).collect()), key=str)


def documents(seed=3):
    rng = random.Random(seed)
    sizes = {"hot": 90, "b": 27, "a": 28, "é": 1, "": 2, None: 10, "zz": 3, "z": 4, "y": 9}
    rows = []
    for source, n in sizes.items():
        for _ in range(n):
            text = rng.choice([None, "", "one line", "two\nlines", "é\n\nü " * rng.randrange(5)])
            rows.append((len(rows), source, rng.choice([None, "en", "de"]), rng.choice([None, 5, 12]), text))
    rows += [(None, "hot", None, None, None), (None, None, None, None, "x\n"), (7, "hot", "en", 1, "again\n"), (7, "hot", "en", 1, "again\n"), (7, "a", "en", 1, "x")]
    rng.shuffle(rows)
    return [*rows, (9_000, "a", "en", 400_000, "a long line\n" * 40_000)]


@pytest.mark.parametrize("levels", [1, 2, 6])
def test_manifest_equals_brute_force_in_one_and_in_many_tiers(spark, levels):
    rows = documents()
    want = sorted(merkle.brute(rows), key=str)
    assert got(spark.createDataFrame(rows, DOCS), levels) == want
    assert {v[-1] for v in want} == {True, False}


def test_positions_are_the_order_of_completion():
    for n in range(1, 90):
        h = merkle.height(n)
        leaves = [hashlib.sha256(str(i).encode()).hexdigest() for i in range(n)]
        log, level, below = merkle.append(leaves, h), leaves, None
        for k in range(h + 1):
            assert [log[merkle.position(n, k, i)] for i in range(len(level))] == level
            below = level
            level = [merkle.node_hash(below[i : i + merkle.FAN]) for i in range(0, len(below), merkle.FAN)]
        assert log[-1] == below[0] and len(log) == sum(-(-n // merkle.FAN**k) for k in range(h + 1))


def test_places_in_the_log_are_distinct_and_ascend(spark):
    df = spark.createDataFrame([(i, "s", None, None, str(i)) for i in range(50)], DOCS)
    rows = merkle.manifest(df, levels=2).proofs().orderBy("doc_id").collect()
    assert [r["position"] for r in rows] == [merkle.position(50, 0, i) for i in range(50)]
    assert {len(r["path"]) for r in rows} == {merkle.height(50)}


def test_any_change_of_a_row_is_found(spark):
    df = spark.createDataFrame([(i, f"s{i % 2}", "en", 3, f"text {i}") for i in range(40)], DOCS)
    changed = df.withColumn("lang", F.when(F.col("doc_id") == 17, "de").otherwise(F.col("lang")))
    proofs = merkle.manifest(df).proofs().select("doc_id", "root", "path")
    at = changed.select("doc_id", merkle.leaf_hash(changed).alias("leaf")).join(proofs, "doc_id")
    bad = at.where(merkle.fold(F.col("leaf"), F.col("path")) != F.col("root")).collect()
    assert [r["doc_id"] for r in bad] == [17]


def test_one_row_and_none_and_odd_columns(spark):
    one = [(5, None, None, None, "x\n")]
    assert got(spark.createDataFrame(one, DOCS)) == merkle.brute(one)
    empty = merkle.manifest(spark.createDataFrame([], DOCS))
    assert empty.proofs().count() == 0 and empty.root().count() == 0 and empty.subroots().count() == 0
    odd = spark.createDataFrame(one, DOCS).withColumns({c: F.lit(c) for c in ("tree", "leaf", "i", "n", "block", "own", "path", "root", "carried", "at", "part")})
    assert got(odd) == merkle.brute(one)
    made = merkle.manifest(spark.createDataFrame([(1, "x"), (2, "y")], "doc_id long, text string"))
    assert made.root().first()[0] == merkle.brute([(1, None, None, None, "x"), (2, None, None, None, "y")])[0][3]
