"""Quality rules: fixed base rules, then a calibrated logistic regression on hashed word and character n-grams."""

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, released
from .quality import minimise, prob
from .shingles import SAME, Words, mix

#: Bound of the labelled rows of a class that the model is fitted on, those of least hash; a quarter of them calibrates it.
FIT_ROWS = 2_000
#: Characters of texts that are measured at once, and gram shares that are summed at once: they bound memory, not results.
AT_ONCE, SHARES = 200_000, 1_000_000
#: A class needs so many labelled rows in either part; else the model rejects nothing.
LEAST_LABELS = 10
#: Hashed features of either kind. Grams of CHARS characters, and of one and of two words.
BUCKETS, CHARS = 1 << 17, 3
#: Shares of a text's grams are scaled by this, so that one ridge suits both kinds.
SCALE, RIDGE, STEPS = 30.0, 1e-4, 60

#: Fixed thresholds of the base rules and of the calibrated probability of low quality.
LEAST_WORDS, MOST_REPEATED, MOST_BAD = 50, 50, 0.5
SYMBOLS, SPACES = "#*$%&|<>", " \t\n\v\f\r"

SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, p_bad double"


def repeated_words(words: list) -> int:
    """Words inside any 3-word window whose sequence occurs twice or more."""
    n = len(words)
    if n < 4:
        return 0
    index: dict = {}
    codes = np.array([index.setdefault(w, len(index)) for w in words], np.int64)
    m = len(index)
    pairs = codes[:-2] * m + codes[1:-1]
    if m >= 1 << 20:  # three numbers would not fit into 63 bits
        pairs = np.unique(pairs, return_inverse=True)[1]
    _, inverse, counts = np.unique(pairs * m + codes[2:], return_inverse=True, return_counts=True)
    again = (counts > 1)[inverse]
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[k : n - 2 + k] |= again
    return int(covered.sum())


def measures(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text."""
    words = text.encode().translate(SAME).split()
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    chars = len(text) - sum(text.count(c) for c in SPACES)
    return len(words), chars, sum(text.count(c) for c in SYMBOLS), len(lines) - len(set(lines)), repeated_words(words)


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all grams of some texts, text by text, and where each text's ones end: of characters, then of words."""
    points = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
    wide = np.maximum([len(p) - CHARS + 1 for p in points], 0)
    every = np.concatenate([*points, np.zeros(0, np.uint32)]).astype(np.uint64)
    starts = np.cumsum([len(p) for p in points]) - [len(p) for p in points]
    at = np.repeat(starts - (np.cumsum(wide) - wide), wide).astype(np.int64) + np.arange(wide.sum())
    key = every[at]
    for k in range(1, CHARS):
        key = key << np.uint64(21) | every[at + k]
    chars = (mix(key) % np.uint64(BUCKETS)).astype(np.int64)
    w = Words(texts, SAME)
    total = np.arange(w.counts.sum())
    twice = np.delete(total, w.firsts[w.counts > 0] + w.counts[w.counts > 0] - 1)  # words that another one follows
    one, two = w.hashes(total, total), w.hashes(twice, twice + 1)
    owner = np.repeat(np.arange(len(texts)), w.counts)
    order = np.argsort(np.concatenate([owner, owner[twice]]), kind="stable")
    words = (np.concatenate([one, two])[order] % np.uint64(BUCKETS)).astype(np.int64)
    return chars, np.cumsum(wide), words, np.cumsum(w.counts + np.maximum(w.counts - 1, 0))


def _means(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Mean of each run, summed in its own order, so that equal texts get equal means; 0 for an empty run."""
    sizes = np.diff(ends, prepend=0)
    return np.bincount(np.repeat(np.arange(len(ends)), sizes), values, len(ends)) / np.maximum(sizes, 1)


class Model:
    """Weights of both kinds of grams with a constant, and the calibration of the logit."""

    def __init__(self, weights: np.ndarray):
        self.weights, self.scale = weights, (1.0, 0.0)

    def logits(self, texts: list[str]) -> np.ndarray:
        chars, char_ends, words, word_ends = grams(texts)
        w = self.weights
        return SCALE * (_means(w[:BUCKETS][chars], char_ends) + _means(w[BUCKETS:-1][words], word_ends)) + w[-1]

    def p_bad(self, texts: list[str]) -> np.ndarray:
        return prob(self.scale[0] * self.logits(texts) + self.scale[1])


def _features(batches):
    """doc_id, quality -> the buckets of a text's grams and their scaled shares."""
    for batch in batches:
        index, values = [], []
        for text in batch.column("text").to_pylist():
            chars, _, words, _ = grams([text])
            own, n = np.unique(np.concatenate([chars, words + BUCKETS]), return_counts=True)
            index.append(own.astype(np.int32))
            values.append((SCALE * n / np.where(own < BUCKETS, max(len(chars), 1), max(len(words), 1))).astype(np.float32))
        kinds = [("index", pa.list_(pa.int32())), ("value", pa.list_(pa.float32()))]
        columns = [batch.column("doc_id"), batch.column("quality"), *(pa.array(x, k) for x, (_, k) in zip((index, values), kinds))]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "quality", "index", "value"])


def _fitted(index, value, sizes, y, weight) -> np.ndarray:
    """Weights of a logistic regression by L-BFGS; the last is the constant. Rows go through in runs of about SHARES shares."""
    ends = np.cumsum(sizes)
    cuts = np.unique(np.concatenate([[0], np.searchsorted(ends, np.arange(SHARES, ends[-1], SHARES), side="right"), [len(y)]]))
    runs = [(a, b, slice(ends[a] - sizes[a], ends[b - 1])) for a, b in zip(cuts[:-1], cuts[1:])]

    def f(w):
        total, grad = RIDGE / 2 * (w[:-1] ** 2).sum(), np.append(RIDGE * w[:-1], 0.0)
        for a, b, own in runs:
            owner = np.repeat(np.arange(b - a), sizes[a:b])
            z = np.bincount(owner, w[index[own]] * value[own], b - a) + w[-1]
            r = weight[a:b] * (prob(z) - y[a:b])
            grad[:-1] += np.bincount(index[own], r[owner] * value[own], len(w) - 1)
            grad[-1] += r.sum()
            total += (weight[a:b] * (np.logaddexp(0, z) - y[a:b] * z)).sum()
        return float(total), grad

    return minimise(f, np.zeros(2 * BUCKETS + 1), STEPS)


def _calibrated(z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and constant that make the logit a calibrated one, by weighted logistic regression on the standardised logit."""
    centre, spread = z.mean(), z.std() or 1.0
    x = np.column_stack([(z - centre) / spread, np.ones(len(z))])

    def f(w):
        at = x @ w
        value = (weight * (np.logaddexp(0, at) - y * at)).sum() + 1e-3 / 2 * (w @ w)
        return float(value), x.T @ (weight * (prob(at) - y)) + 1e-3 * w

    slope, constant = minimise(f, np.zeros(2), STEPS)
    slope = max(slope, 0.0) / spread
    return float(slope), float(constant - slope * centre)


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Model | None:
    """The model of labels.quality from at most fit_rows rows of each class; None if a class is too small.

    Rows are weighted by their class's share of all labelled rows over that of the sample, so
    that the probability holds for the corpus; one in four, by a hash of the id, is held out of
    the fit and calibrates it.
    """
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    own = own.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    texts = id_and_text(docs)
    all_of = {r["quality"]: r["n"] for r in own.groupBy("quality").agg(F.count(F.lit(1)).alias("n")).collect()}  # two rows
    pick = [own.where(F.col("quality") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows) for c in (0, 1)]
    # the sample has a fixed bound, so it may be broadcast; only its features reach the driver
    found = texts.join(F.broadcast(pick[0].union(pick[1])), "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text"))
    got = found.mapInArrow(_features, "doc_id long, quality int, index array<int>, value array<float>").toArrow().sort_by("doc_id")
    ids, good = got.column("doc_id").to_pylist(), got.column("quality").to_numpy()
    if not ids:
        return None
    held = np.array([zlib.crc32(str(i).encode()) % 4 == 0 for i in ids], bool)
    if min(((good == c) & part).sum() for c in (0, 1) for part in (held, ~held)) < LEAST_LABELS:
        return None
    weight = np.array([all_of[c] / (good == c).sum() for c in (0, 1)])[good]
    y = 1.0 - good
    scaled = weight[~held] / weight[~held].sum()
    flat = lambda t, c: t.column(c).combine_chunks().flatten().to_numpy()
    sizes = lambda t: t.column("index").combine_chunks().value_lengths().to_numpy()
    fitted, tested = got.filter(pa.array(~held)), got.filter(pa.array(held))
    del got
    model = Model(_fitted(flat(fitted, "index"), flat(fitted, "value"), sizes(fitted), y[~held], scaled))
    owner = np.repeat(np.arange(held.sum()), sizes(tested))
    z = np.bincount(owner, model.weights[flat(tested, "index")] * flat(tested, "value"), held.sum()) + model.weights[-1]
    model.scale = _calibrated(z, y[held], weight[held] / weight[held].mean())
    return model


def _score(shared):
    def run(batches):
        model = shared.value
        for batch in batches:
            sizes = np.cumsum(pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False))
            cuts = np.unique(np.append(np.searchsorted(sizes, np.arange(0, sizes[-1] if len(sizes) else 0, AT_ONCE)), len(sizes)))
            for a, b in zip(cuts[:-1], cuts[1:]):
                own = batch.column("text").slice(a, b - a).to_pylist()
                columns = list(zip(*map(measures, own)))
                p = model.p_bad(own) if model else np.zeros(b - a)
                arrays = [batch.column("doc_id").slice(a, b - a), *(pa.array(c, pa.int64()) for c in columns), pa.array(p, pa.float64())]
                yield pa.RecordBatch.from_arrays(arrays, names=[c.split()[0] for c in SCHEMA.split(", ")])

    return released(run)


def quality_rules(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, most_bad: float = MOST_BAD) -> DataFrame:
    """Each document against the base rules and the model: doc_id, n_words and four counts, p_bad, base_failed, kept.

    Words are runs without ASCII white space. word_chars are the code points in words,
    n_symbols the characters of SYMBOLS, n_dup_lines the lines with a word that equal an earlier
    line, n_repeat_words the words in 3-word windows that occur twice or more. base_failed:
    fewer than LEAST_WORDS words, or more than MOST_REPEATED % of them repeated. kept: not
    base_failed, and p_bad below most_bad.

    The model is fitted on a bounded sample of labelled rows (fit). All documents are scored in
    one scan, in Arrow batches, without a shuffle; a text's logit is the mean weight of its
    grams, so a long text costs in proportion to its length.

    Defined cases: null text is empty; null, repeated or other labels: null and other values
    count as none, of repeated ones the smaller stands; of documents of one id the smallest text
    is fitted on; without enough labels of both classes p_bad is 0 and only the base rules
    decide; repeated rows are scored alike; an empty table gives an empty result. Other columns
    are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, fit_rows))
    scored = id_and_text(docs).mapInArrow(_score(shared), SCHEMA)
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return scored.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("p_bad") < most_bad))
