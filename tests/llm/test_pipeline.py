import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from furlong.llm import decontamination, jaccard_join, quality, token_store
from furlong.llm.queries import tokenizer_file

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, sid string"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """A small corpus: clean, bad and toxic texts, near copies, passages of the benchmark, nulls, a repeated and a null id."""
    rng, out = random.Random(21), tmp_path_factory.mktemp("corpus")
    word = lambda: f"w{rng.randrange(2000)}"
    items = [(i, " ".join(word() for _ in range(25))) for i in range(12)]
    docs, labels = [], []
    for i in range(700):
        bad, toxic = rng.random() < 0.2, rng.random() < 0.1
        w = [word() for _ in range(rng.randrange(20, 70))]
        if i % 9 == 0:
            w[3:3] = items[i % 12][1].split()[2:16]
        if toxic:
            w[rng.randrange(len(w))] = "idiot"
        docs.append((i, " ".join(x + ("%%%" if bad else "") for x in w)))
        if i % 2:
            labels.append((i, int(not bad), int(toxic)))
    base = [word() for _ in range(150)]
    docs += [(1000 + i, " ".join(base[:k] + ["edit"] + base[k:])) for i, k in enumerate((3, 40, 90, 140))]
    docs += [(2000, None), (2001, ""), (None, "a b c"), (5, docs[5][1]), (5, "another text of this id " * 3)]
    rows = [(d, t, "en", f"s{(d or 0) % 3}", len(t or ""), "x") for d, t in docs]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    return str(out), rows, items


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_quality_stage_drops_what_is_rejected(spark, folder):
    path, rows, _ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    rejected = {r[0] for r in quality.classify(docs, spark.read.parquet(f"{path}/labels.parquet")).where("rejected").select("doc_id").collect()}
    got = rows_of(cp.quality_stage(spark, docs, path))
    assert got == sorted((r for r in rows if r[0] is None or r[0] not in rejected), key=str) and rejected
    texts = {r[0]: r[1] for r in rows if r[0] != 5}
    rejected -= {5}
    assert sum("%%%" in (texts[i] or "") or "idiot" in (texts[i] or "") for i in rejected) / len(rejected) > 0.9


def test_near_duplicate_stage_keeps_the_smallest_of_each_group(spark, folder):
    path, rows, _ = folder
    own = [r for r in rows if r[0] is not None and r[0] != 5]
    want = {i for i, (_, c) in jaccard_join.brute([r[:2] for r in own]).items() if c == i}
    got = cp.near_duplicate_stage(spark, spark.createDataFrame(own, SCHEMA), path)
    assert got.columns == [c.split()[0] for c in SCHEMA.split(", ")] and {r["doc_id"] for r in got.collect()} == want and 1000 in want and 1002 not in want


def test_decontamination_stage_drops_hit_documents(spark, folder):
    path, rows, items = folder
    own = [r for r in rows if r[0] != 5]
    found = decontamination.brute([r[:2] for r in own], items)
    got = rows_of(cp.decontamination_stage(spark, spark.createDataFrame(own, SCHEMA), path))
    assert got == sorted((r for r in own if r[0] is None or not found[r[0]][4]), key=str) and any(v[4] for v in found.values())


def test_mixing_stage_keeps_clean_documents(spark, folder):
    path, rows, _ = folder
    got = cp.mixing_stage(spark, spark.createDataFrame(rows, SCHEMA), path)
    kept = {r["doc_id"] for r in got.select("doc_id").collect()}
    clean = [r[0] for r in rows if r[0] is not None and r[0] < 700 and r[0] % 2 and r[1] and "%%%" not in r[1] and "idiot" not in r[1]]
    assert sum(i in kept for i in clean) / len(clean) > 0.97 and len(kept) < len({r[0] for r in rows}) and got.columns == [c.split()[0] for c in SCHEMA.split(", ")]


def test_token_stage_is_the_library_s_own(spark, folder):
    from tokenizers import Tokenizer

    path, rows, _ = folder
    own = sorted((r for r in rows if r[0] is not None and r[0] != 5), key=lambda r: r[0])[:200]
    plain, start = Tokenizer.from_file(tokenizer_file("word_bpe_49k.json")), 0
    got = {r["doc_id"]: r for r in cp.token_stage(spark, spark.createDataFrame(own, SCHEMA), path).collect()}
    for doc_id, text, *_ in own:
        ids = plain.encode(text or "", add_special_tokens=False).ids + [1]
        assert (got[doc_id]["start"], got[doc_id]["n_tokens"], got[doc_id]["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_every_stage_on_an_empty_table(spark, folder):
    path, rows, _ = folder
    none = spark.createDataFrame([], SCHEMA)
    assert all(stage(spark, none, path).count() == 0 for _, stage in cp.STAGES)


def test_token_rows_are_split(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_store, "ROW_IDS", 50)
    path = tokenizer_file("word_bpe_49k.json")
    texts = [" ".join(f"w{i}" for i in range(n)) for n in (3, 200, 0, 40, 41, 1)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(None, "z"), (3, texts[3]), (3, "other")], "doc_id long, text string")
    file_rows = token_store._file_rows(path, 1)
    batches = docs.where("doc_id is not null").orderBy("doc_id", "text").toArrow().to_batches()
    import unittest.mock as mock

    with mock.patch.object(token_store.TaskContext, "get", return_value=mock.Mock(partitionId=lambda: 0)):
        rows = [r for b in file_rows(iter(batches)) for r in b.to_pylist()]
    assert len(rows) > 2 and all(len(r["doc_ids"]) >= 1 for r in rows) and sum(r["n_ids"] for r in rows) == sum(sum(r["doc_lens"]) for r in rows)
    token_store.write_tokens(docs, str(tmp_path / "t"), path)
    read = token_store.read_tokens(spark, str(tmp_path / "t"))
    assert read.count() == 9 and read.where(F.col("doc_id").isNull()).first()["start"] == 0 and read.agg(F.countDistinct("start")).first()[0] == 9
    none = docs.where("doc_id = 99")
    token_store.write_tokens(none, str(tmp_path / "e"), path)
    assert token_store.read_tokens(spark, str(tmp_path / "e")).count() == 0
