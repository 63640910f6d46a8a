import random

from furlong.llm import jaccard_join as jj

SCHEMA = "doc_id long, text string"


def near_copies(rng, n, size, edits):
    base = [f"w{rng.randrange(4000)}" for _ in range(size)]
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randrange(edits + 1)):
            w[rng.randrange(size)] = f"e{rng.randrange(9999)}"
        yield " ".join(w)


def corpus(seed=1):
    rng = random.Random(seed)
    texts = [None, "", " \t\n", "one two", "One  two", "a b c d e", "A b C d e f"]
    for size, edits in ((12, 2), (40, 3), (120, 4), (400, 12)):
        for _ in range(6):
            texts += near_copies(rng, rng.randrange(2, 9), size, edits)
    texts += [" ".join(f"w{rng.randrange(4000)}" for _ in range(rng.randrange(1, 90))) for _ in range(60)]
    texts += [texts[40]] * 30
    rng.shuffle(texts)
    return list(enumerate(texts))


def test_same_as_all_pairs(spark):
    rows = corpus()
    got = {r[0]: (r[1], r[2]) for r in jj.jaccard_join(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()}
    assert got == jj.brute(rows)


def test_blocks_of_heavy_shingles(spark, monkeypatch):
    monkeypatch.setattr(jj, "BLOCK_DOCS", 16)
    rng = random.Random(3)
    rows = list(enumerate([*near_copies(rng, 90, 60, 5), *near_copies(rng, 70, 300, 30)]))
    got = {r[0]: (r[1], r[2]) for r in jj.jaccard_join(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()}
    assert got == jj.brute(rows)


def test_empty_and_extra_columns(spark):
    assert jj.jaccard_join(spark.createDataFrame([], SCHEMA)).collect() == []
    df = spark.createDataFrame([(1, "a b", 9, "x"), (1, "a b", 8, "y"), (2, "c", 7, "z")], "doc_id long, text string, sid long, bucket string")
    assert sorted(map(tuple, jj.jaccard_join(df).collect())) == [(1, 1, 1), (1, 1, 1), (2, 1, 2)]


def test_tree_keeps_every_linked_pair():
    import numpy as np

    rng = np.random.default_rng(5)
    base = [rng.integers(0, 1 << 62, int(rng.integers(5, 200)), dtype=np.uint64) for _ in range(40)]
    sets = [np.unique(np.where(rng.random(len(b)) < 0.06, rng.integers(0, 1 << 62, len(b), dtype=np.uint64), b)) for b in base for _ in range(5)]
    n = np.array([len(s) for s in sets])
    order = np.argsort(n, kind="stable")
    bits = np.stack([jj.folded(jj.bitmap(s), jj.BITS) for s in sets])
    found = {tuple(sorted((order[a], order[b]))) for i, j in jj.SignatureTree(n[order], bits[order]).pairs(np.arange(len(sets))) for a, b in zip(i, j)}
    want = {(a, b) for a in range(len(sets)) for b in range(a + 1, len(sets)) if jj.linked(sets[a], sets[b])}
    assert want and want <= found and len(found) < len(sets) ** 2 / 8


def test_one_id_under_two_texts(spark):
    rng = random.Random(8)
    x, y = list(near_copies(rng, 2, 120, 1)), list(near_copies(rng, 2, 120, 1))
    rows = [(1, x[0]), (1, y[0]), (2, x[1]), (3, y[1]), (4, "else")]
    got = {r[0]: r[2] for r in jj.jaccard_join(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4}


def test_clusters_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(jj, "BLOCK_DOCS", 16)
    monkeypatch.setattr(jj, "BLOCK_TOKENS", 500)
    rng = random.Random(9)
    rows = list(enumerate([*near_copies(rng, 80, 60, 9), *near_copies(rng, 60, 200, 30), *near_copies(rng, 40, 12, 2)]))
    got = {r[0]: (r[1], r[2]) for r in jj.jaccard_join(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()}
    want = jj.brute(rows)
    assert got == want and 3 < len({c for _, c in want.values()}) < len(rows)


def test_folded_bitmaps_only_bound(monkeypatch):
    import numpy as np

    rng = random.Random(10)
    sets = jj.shingle_sets([*near_copies(rng, 60, 80, 12), *near_copies(rng, 60, 150, 20)])
    found = []
    for bits in (64, 1 << 14):
        monkeypatch.setattr(jj, "BLOCK_BITS", bits)
        label = np.arange(len(sets))
        jj.join_sets(sets, label, np.zeros(len(sets)))
        found.append(label.tolist())
    assert found[0] == found[1] and len(set(found[0])) < len(sets)


def test_null_ids_and_a_long_text(spark):
    long = " ".join(f"x{i}" for i in range(30_000))
    rows = [(None, "a b c"), (None, long), (1, long), (2, long + " y"), (3, long), (3, long)]
    got = sorted(map(tuple, jj.jaccard_join(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    assert got == [(1, 29_996, 1), (2, 29_997, 1), (3, 29_996, 1), (3, 29_996, 1), (None, 1, None), (None, 29_996, None)]
