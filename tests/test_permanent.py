import random

from furlong.operators import permanent


def components(ids, edges):
    of = {i: i for i in ids}
    for _ in ids:
        for a, b in edges:
            of[a] = of[b] = min(of[a], of[b])
    return of


def test_permanent_ids_survive_batches(spark):
    rng = random.Random(6)
    ids, edges, known, merges = [], [], {}, {}
    identity = None
    for batch in range(3):
        new = [i for i in range(60) if i % 3 == (2, 0, 1)[batch]]
        ids += new
        edges += [(rng.choice(ids), rng.choice(ids)) for _ in range(9)]
        rows = spark.createDataFrame([(i,) for i in [*new, new[0]]], "id long")
        found = spark.createDataFrame([*edges[-9:], (1, 999)], "a long, b long")
        identity = permanent.extend(identity, rows, found)
        comp = components(ids, edges)
        want = {}
        for c in set(comp.values()):
            members = [i for i in ids if comp[i] == c]
            old = sorted({known[i] for i in members if i in known})
            alive = old[0] if old else min(members)
            want |= dict.fromkeys(members, alive)
            merges |= {o: alive for o in old[1:]}
        merges = {o: next((want[i] for i in known if known[i] == m), m) for o, m in merges.items()}
        assert {r["id"]: r["horse_id"] for r in identity.links.collect()} == want
        assert {r["old"]: r["merged_into"] for r in identity.merges.collect()} == merges
        known = want
    assert merges
    old = spark.createDataFrame([(k,) for k in merges], "horse_id long")
    assert {r[0] for r in identity.resolve(old).collect()} == set(merges.values())


def test_no_rows_and_no_matches(spark):
    none, pairs = spark.createDataFrame([], "id long"), spark.createDataFrame([], "a long, b long")
    first = permanent.extend(None, none, pairs)
    assert first.links.count() == first.merges.count() == 0
    one = permanent.extend(first, spark.createDataFrame([(5,), (None,)], "id long"), pairs)
    assert [tuple(r) for r in one.links.collect()] == [(5, 5)]


def test_tables_of_an_identity(spark):
    profiles = spark.createDataFrame(
        [(1, "Red Rod", "red rod", "male", None, 3), (2, "Red  Rod", "red rod", "male", 2001, 3), (3, "Red Rods ", "red rods", "male", 2002, 1), (4, "Blue", "blue", None, None, 0)],
        "id long, name string, key string, sex string, year int, starts long",
    )
    one = permanent.extend(None, profiles, spark.createDataFrame([(1, 2), (3, 2)], "a long, b long"))
    entities = permanent.horses(one, profiles)
    assert sorted(tuple(r) for r in entities.collect()) == [
        (1, 2, "Red  Rod", "red rod", "male", 2001, 3, True), (4, 4, "Blue", "blue", None, None, 1, False),
    ]
    assert sorted(tuple(r) for r in permanent.links(one, entities).collect()) == [
        (1, 1, 0.95, "auto_merge"), (2, 1, 1.0, "auto_merge"), (3, 1, 0.95, "auto_merge"), (4, 4, 1.0, "singleton"),
    ]
    assert sorted(tuple(r) for r in permanent.aliases(one, profiles).collect()) == [(1, "red rod", "Red  Rod"), (1, "red rods", "Red Rods"), (4, "blue", "Blue")]
    pairs = spark.createDataFrame([(1, 4, 0.8), (4, 3, 0.85), (1, 3, 0.9)], "a long, b long, score double")
    assert [tuple(r) for r in permanent.open_candidates(one, pairs).collect()] == [(1, 4, 4, 3, 0.85)]
