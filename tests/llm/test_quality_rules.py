import random
import re

import numpy as np
from pyspark.sql import functions as F

from furlong.llm import quality_rules as rules

TEXTS = "doc_id long, text string"
LABELS = "doc_id long, quality int, toxic int"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    hit = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    dup = sum(x in lines[:i] for i, x in enumerate(lines))
    symbols = sum(c in "#*$%&|<>" for c in text)
    return len(words), sum(map(len, words)), symbols, dup, len(hit), len(words) < 50 or 100 * len(hit) > 50 * len(words)


def corpus(seed=7, n=400):
    """Prose of two kinds: plain words (good), words full of marks (bad), and odd texts."""
    rng, rows, labels = random.Random(seed), [], []
    for i in range(n):
        bad = i % 4 == 0
        words = ["".join(rng.choices("abcdefgh", k=rng.randrange(2, 8))) for _ in range(rng.randrange(60, 150))]
        rows.append((i, " ".join(w + rng.choice(["***", "###"]) if bad else w for w in words) + "."))
        labels.append((i, 0 if bad else 1, 0))
    odd = [None, "", " \t\n", "a b", "a b c a b c", "x x x x x", "é ü ñ\n\n\né ü ñ\n é\n", "l 1\nl 1\nl 1 \nl 1", "one two three " * 30, "\x0b\x0c\r#|<> a" * 20]
    rows += [(n + k, t) for k, t in enumerate(odd)]
    return rows, labels


def test_counts_equal_brute_force(spark):
    rows, labels = corpus()
    rng = random.Random(1)
    rows += [(900 + k, rng.choice([" ", "\n"]).join(rng.choice("ab cd") + rng.choice("xyz") for _ in range(rng.randrange(120)))) for k in range(60)]
    out = rules.quality_rules(spark.createDataFrame(rows, TEXTS), spark.createDataFrame(labels, LABELS)).collect()
    assert {r["doc_id"]: tuple(r[c] for c in COUNTS) for r in out} == {i: brute(t) for i, t in rows}
    assert all(r["kept"] == (not r["base_failed"] and r["p_bad"] < rules.MOST_BAD) for r in out)


def test_many_distinct_words_are_counted_exactly():
    words = [f"{k}" for k in range(1 << 20)] + ["5", "6", "7", "8"]
    assert rules.repeated_words(words) == 8


def test_held_out_accuracy_and_calibration(spark):
    rows, labels = corpus(n=1_200)
    known = spark.createDataFrame([x for x in labels if x[0] % 2], LABELS).union(spark.createDataFrame([x for x in labels if x[0] % 8 == 0], LABELS))
    out = rules.quality_rules(spark.createDataFrame(rows, TEXTS), known)
    quality = dict(x[:2] for x in labels)
    seen = {r[0] for r in known.collect()}
    rest = [(quality[r["doc_id"]], r["kept"], r["p_bad"]) for r in out.collect() if r["doc_id"] in quality and r["doc_id"] not in seen]
    assert len(rest) > 400 and np.mean([q == k for q, k, _ in rest]) > 0.98
    assert abs(np.mean([p for _, _, p in rest]) - np.mean([1 - q for q, _, _ in rest])) < 0.05


def test_a_rare_class_is_weighted_back(spark):
    """Equal numbers of both classes are fitted on, yet the probability is near the share in the corpus."""
    rows, labels = corpus(n=1_600)
    flipped = [(i, 0 if i % 20 == 1 else q, t) for i, q, t in labels]  # of the good ones, one in fifteen is called bad
    out = rules.quality_rules(spark.createDataFrame(rows, TEXTS), spark.createDataFrame(flipped, LABELS), fit_rows=200)
    plain = [r["p_bad"] for r in out.collect() if r["doc_id"] < 1_600 and r["doc_id"] % 4]
    assert np.mean(plain) < 0.3


def test_labels_that_are_few_odd_or_repeated(spark):
    rows, labels = corpus(n=60)
    docs = spark.createDataFrame(rows, TEXTS)
    few = rules.quality_rules(docs, spark.createDataFrame(labels[:8], LABELS)).collect()
    assert {r["p_bad"] for r in few} == {0.0} and any(r["kept"] for r in few)
    none = rules.quality_rules(docs, spark.createDataFrame([], LABELS))
    assert none.count() == len(rows)
    rows, labels = corpus()
    docs = spark.createDataFrame(rows, TEXTS)
    odd = labels + [(i, None, 1) for i in range(50)] + [(i, 7, 0) for i in range(50)] + [(None, 0, 0)] + labels[:30]
    same = lambda x: {r["doc_id"]: r["p_bad"] for r in rules.quality_rules(docs, spark.createDataFrame(x, LABELS)).collect()}
    assert same(odd) == same(labels)


def test_repeated_ids_null_ids_long_texts_and_clashing_columns(spark):
    rows, labels = corpus()
    long = "word other third " * 100_000
    extra = [(None, rows[0][1]), (3, rows[3][1]), (3, "short"), (5, long)]
    df = spark.createDataFrame(rows + extra, TEXTS).withColumns({c: F.lit(1) for c in ("quality", "index", "value", "p_bad", "n_words", "kept")})
    out = rules.quality_rules(df, spark.createDataFrame(labels, LABELS)).collect()
    assert len(out) == len(rows) + 4
    assert sorted(r["n_words"] for r in out if r["doc_id"] == 5) == [brute(rows[5][1])[0], 300_000]
    assert len({r["p_bad"] for r in out if r["doc_id"] == 3}) == 2
    assert rules.quality_rules(df.limit(0), spark.createDataFrame(labels, LABELS)).count() == 0


def test_a_long_text_scores_as_its_parts(spark):
    rng = np.random.default_rng(0)
    model = rules.Model(rng.normal(size=2 * rules.BUCKETS + 1))
    texts = ["", "a", "ab", "abc", "one two", "é ü ñ"]
    together = model.logits(texts)
    assert np.allclose(together, [model.logits([t])[0] for t in texts])
