import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from furlong.llm import substring_dedup as sd

SCHEMA = "doc_id long, text string"


def corpus(seed=2):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(300)}"
    passages = [[word() for _ in range(rng.randrange(18, 90))] for _ in range(12)]
    rows = [(1000, None), (1001, ""), (1002, "one two"), (1003, "Shti " * 90), (1004, " ".join(["a", "b"] * 60)), (1005, "Alone " * 25)]
    for i in range(150):
        w = [word() for _ in range(rng.randrange(60))]
        for _ in range(rng.randrange(4)):
            w += passages[rng.randrange(len(passages))][rng.randrange(5) :] + [word() for _ in range(rng.randrange(30))]
        rows.append((i, rng.choice([" ", "\n", "  "]).join(w)))
    rows += [(200 + i, rows[60][1]) for i in range(20)] + [(300, " ".join(passages[0] + passages[0])), (301, " ".join(passages[1] * 3))]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("hot", [2000, 3])
def test_same_as_dictionary_of_windows(spark, monkeypatch, hot):
    monkeypatch.setattr(sd, "HOT", hot)
    rows = corpus()
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = {r[0]: tuple(r[1:]) for r in sd.digest(df, sd.repeated_passages(df)).collect()}
    want = sd.brute(rows)
    assert {k: (got.get(k), v) for k, v in want.items() if got.get(k) != v} == {}
    assert sum(v[1] for v in want.values()) > 3000


def test_backward_search_counts():
    rng = np.random.default_rng(1)
    text = np.append(rng.integers(1, 9, 3000), 0)
    index = sd.FMIndex(text, 9, 20)
    s = "".join(map(str, text))
    starts = np.arange(0, 2000)
    live, low, high, alone = index.repeated(text, starts, 4)
    assert (alone[live] == -1).all() and (np.delete(alone, live) >= 0).all()
    want = {i: sum(s.startswith(s[i : i + 4], j) for j in range(len(s))) for i in range(0, 2000, 37)}
    got = dict(zip(live.tolist(), (high - low).tolist()))
    assert all(got.get(i, 1) == n for i, n in want.items())


def test_empty_and_extra_columns(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert sd.digest(empty, sd.repeated_passages(empty)).collect() == []
    text = " ".join(f"w{i}" for i in range(25))
    df = spark.createDataFrame([(1, text, 1, b"x"), (2, text, 2, b"y"), (None, text, 3, b"z")], "doc_id long, text string, start long, words binary")
    assert sorted((r[0] or 0, r[2]) for r in sd.digest(df, sd.repeated_passages(df)).collect()) == [(0, 0), (1, 0), (2, 25)]


def test_repeated_ids_keep_their_rows_and_texts(spark):
    words = lambda p, n: " ".join(f"{p}{i}" for i in range(n))
    shared, own = words("s", 300), words("u", 300)
    rows = [(1, shared), (2, shared), (2, shared), (2, "short text of the same id"), (3, own), (3, own + " " + shared), (4, None), (4, ""), (None, shared)]
    rows += [(5, words("v", 40) + " " + words("w", 20_000)), (5, words("w", 20_000))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    hashes = {r["text"]: r["h"] for r in df.select("text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()}
    order = sorted({(i, t) for i, t in rows if i is not None}, key=lambda r: (r[0], hashes[r[1]]))
    want = sd.brute([((i, hashes[t]), t) for i, t in order])
    want = sorted(str((i, *want[i, hashes[t]])) if i is not None else str((None, 300, 0)) for i, t in rows)
    got = sd.digest(df, sd.repeated_passages(df)).collect()
    assert sorted(str((None, *r[1:3])) if r[0] is None else str(tuple(r)) for r in got) == want


@pytest.mark.parametrize("window", [1, 65])
def test_windows_beyond_the_masks_are_refused(spark, window):
    with pytest.raises(ValueError):
        sd.repeated_passages(spark.createDataFrame([(1, "a")], SCHEMA), window)
