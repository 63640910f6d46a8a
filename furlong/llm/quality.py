"""Quality classifier: co-training of a text view and a metadata view, combined after calibration."""

import copy
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import released, sliced, trim, written
from .decontamination import _FOLD
from .shingles import Words, chunks

#: Bound of the labelled documents that the models are fitted on, those of least hash.
FIT_ROWS = 16_000
#: Hashed words; of these, so many at most enter the model of a head, by their association with the label.
WORDS, CHOSEN, LEAST_Z = 1 << 18, 400, 5.0
BINS, META, FIELDS = 10, 1 << 12, 5
ROUNDS, CONFIDENT, STEPS = 3, 0.02, 12
#: A label needs so many documents of either kind; else it rejects nothing.
LEAST_LABELS = 10
HEADS, VIEWS = ("bad", "toxic"), ("text", "meta")
THRESHOLD = 0.65

_WORD = np.array([b >= 128 or 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 for b in range(256)])
_BYTES = np.arange(256)
#: Shares of a text's bytes that are marks, bars, capitals, digits, newlines, spaces.
_KINDS = [~_WORD & (_BYTES > 32) & ~np.isin(_BYTES, list(b".,;:'\"-()|")), _BYTES == 124, (_BYTES >= 65) & (_BYTES <= 90), (_BYTES >= 48) & (_BYTES <= 57), _BYTES == 10, _BYTES == 32]
SHAPES = len(_KINDS) + 4


def text_features(texts: list[str]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Shape of each text (shares of byte kinds; word length, distinct words, repeats, log length) and its hashed words."""
    shapes, words = np.zeros((len(texts), SHAPES)), []
    for a, b in chunks(texts):
        raw = [t.encode() for t in texts[a:b]]
        sizes = np.array([len(r) for r in raw])
        data = np.frombuffer(b"".join(raw), np.uint8)
        owner = np.repeat(np.arange(b - a), sizes)
        for k, kind in enumerate(_KINDS):
            shapes[a:b, k] = np.bincount(owner[kind[data]], minlength=b - a) / np.maximum(sizes, 1)
        w = Words(texts[a:b], _FOLD)
        n = int(w.counts.sum())
        every = np.arange(n)
        h = (w.hashes(every, every) % np.uint64(WORDS)).astype(np.int32)
        again = np.append(False, h[1:] == h[:-1])[:n]
        for i, (own, rep) in enumerate(zip(np.split(h, w.firsts[1:]), np.split(again, w.firsts[1:]))):
            distinct = np.unique(own)
            words.append(distinct)
            shapes[a + i, len(_KINDS) :] = sizes[i] / max(len(own), 1), len(distinct) / max(len(own), 1), rep.sum() / max(len(own), 1), np.log1p(len(own))
    return shapes, words


def meta_features(lang, source, n_chars) -> list[int]:
    """Hashed features of a document's metadata."""
    size = -1 if n_chars is None else int(n_chars).bit_length()
    return [zlib.crc32(f"{k}={v}".encode()) % META for k, v in (("lang", lang), ("source", source), ("size", size), ("lang,source", (lang, source)), ("lang,size", (lang, size)))]


class Part:
    """Features of some documents; words and metadata lie flat, each value beside the row it belongs to."""

    def __init__(self, shapes: np.ndarray, words: np.ndarray, word_of: np.ndarray, metas: np.ndarray):
        self.shapes, self.words, self.word_of, self.metas, self.n = shapes, words, word_of, metas, len(shapes)

    @staticmethod
    def of(batch) -> "Part":
        flat = lambda c: batch.column(c).flatten().to_numpy(zero_copy_only=False)
        sizes = batch.column("words").value_lengths().to_numpy(zero_copy_only=False)
        n = len(sizes)
        return Part(flat("shapes").reshape(n, SHAPES), flat("words"), np.repeat(np.arange(n), sizes), flat("metas").reshape(n, FIELDS))

    @staticmethod
    def of_texts(texts: list[str], metas: list[list[int]]) -> "Part":
        shapes, words = text_features(texts)
        return Part(shapes, np.concatenate([*words, np.zeros(0, np.int32)]).astype(np.int64), np.repeat(np.arange(len(words)), [len(w) for w in words]), np.array(metas, np.int64).reshape(len(texts), FIELDS))


def loss(w: np.ndarray, index: np.ndarray, owner: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, np.ndarray]:
    """Weighted logistic loss of binary features and its gradient; the last weight is the constant."""
    z = np.bincount(owner, w[index], len(y)) + w[-1]
    r = weight * (prob(z) - y)
    return float((weight * (np.logaddexp(0, z) - y * z)).sum()), np.append(np.bincount(index, r[owner], len(w) - 1), r.sum())


def minimise(f, w: np.ndarray, steps: int, memory: int = 8) -> np.ndarray:
    """L-BFGS with backtracking; f gives the value and the gradient."""
    (v, g), past = f(w), []
    for _ in range(steps):
        d, scale = -g, []
        for s, u in reversed(past):
            scale.append((s @ d) / (s @ u))
            d = d - scale[-1] * u
        if past:
            d = d * ((past[-1][0] @ past[-1][1]) / (past[-1][1] @ past[-1][1]))
        for (s, u), k in zip(past, reversed(scale)):
            d = d + s * (k - (u @ d) / (s @ u))
        t = 1.0
        while t > 1e-3:
            new = w + t * d
            v_new, g_new = f(new)
            if v_new <= v + 1e-4 * t * (g @ d):
                break
            t /= 2
        else:
            break
        if (new - w) @ (g_new - g) > 1e-12:
            past = [*past, (new - w, g_new - g)][-memory:]
        w, v, g = new, v_new, g_new
    return w


def logistic(x: np.ndarray, y: np.ndarray, steps: int = 30) -> np.ndarray:
    """Coefficients, the last a constant, of a logistic regression on few columns, by Newton's method with a ridge."""
    x = np.column_stack([x, np.ones(len(y))])
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + 0.1 * w
        w -= np.linalg.solve((x.T * (p * (1 - p))) @ x + 0.1 * np.eye(len(w)), grad)
    return w


def prob(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Head:
    """Both views of one label, each calibrated on held-out rows, and their combination; holds no documents."""

    def __init__(self, part: Part, y: np.ndarray, held: np.ndarray):
        """y: 1, 0, or -1 where the label isn't known; held: labelled rows kept for calibration."""
        fit, held = (y >= 0) & ~held, (y >= 0) & held
        self.ready = min((y[fit] == 1).sum(), (y[fit] == 0).sum(), (y[held] == 1).sum(), (y[held] == 0).sum()) >= LEAST_LABELS
        if self.ready:
            self.edges = np.quantile(part.shapes[fit], np.linspace(0, 1, BINS + 1)[1:-1], axis=0)
            self.best, self.weights, self.scales = np.zeros(0, np.int64), {v: np.zeros(1 + (META if v == "meta" else SHAPES * BINS)) for v in VIEWS}, {}

    def choose(self, counts: list[np.ndarray], n: list[float]) -> None:
        """Take the words that go best with the label; weights of words that stay are kept."""
        both = (counts[0] + counts[1] + 1) / (n[0] + n[1] + 2)
        z = np.abs(counts[1] / n[1] - counts[0] / n[0]) / np.sqrt(both * (1 - both) * (1 / n[0] + 1 / n[1]))
        best = np.argsort(-z, kind="stable")[:CHOSEN]
        best = best[z[best] >= LEAST_Z]
        w, known = self.weights["text"], np.zeros(WORDS)
        known[self.best] = w[SHAPES * BINS : -1]
        self.weights["text"] = np.concatenate([w[: SHAPES * BINS], known[best], w[-1:]])
        self.best = best

    def rows(self, view: str, part: Part) -> tuple[np.ndarray, np.ndarray]:
        """Indices of the features that each row has, and the row of each."""
        every = np.arange(part.n)
        if view == "meta":
            return part.metas.ravel(), np.repeat(every, FIELDS)
        column = np.full(WORDS, -1, np.int64)
        column[self.best] = SHAPES * BINS + np.arange(len(self.best))
        bins = np.stack([np.searchsorted(self.edges[:, k], part.shapes[:, k], side="right") for k in range(SHAPES)], axis=1) + np.arange(SHAPES) * BINS
        picked = column[part.words]
        return np.concatenate([bins.ravel(), picked[picked >= 0]]), np.concatenate([np.repeat(every, SHAPES), part.word_of[picked >= 0]])

    def logits(self, view: str, part: Part) -> np.ndarray:
        index, owner = self.rows(view, part)
        return np.bincount(owner, self.weights[view][index], part.n) + self.weights[view][-1]

    def calibrated(self, view: str, part: Part) -> np.ndarray:
        return self.scales[view][0] * self.logits(view, part) + self.scales[view][1]

    def calibrate(self, part: Part, y: np.ndarray, held: np.ndarray) -> None:
        held = (y >= 0) & held
        for v in VIEWS:
            self.scales[v] = logistic(self.logits(v, part)[held][:, None], y[held])
        self.mix = logistic(np.column_stack([self.calibrated(v, part)[held] for v in VIEWS]), y[held])

    def taught(self, part: Part) -> dict[str, np.ndarray]:
        """For each view, the labels of which the other view is sure; else -1."""
        out = {}
        for v, other in (("text", "meta"), ("meta", "text")):
            p = prob(self.calibrated(v, part))
            out[other] = np.where(1 - p <= CONFIDENT, 1, np.where(p <= CONFIDENT, 0, -1))
        return out

    def probability(self, part: Part) -> np.ndarray:
        if not self.ready:
            return np.zeros(part.n)
        return prob(self.mix[0] * self.calibrated("text", part) + self.mix[1] * self.calibrated("meta", part) + self.mix[2])


def _columns(batch):
    return batch.column("text").to_pylist(), [meta_features(*x) for x in zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "n_chars")))]


def _extract(batches):
    """Features of texts and metadata; the columns doc_id, quality and toxic, if there, stay beside them."""
    for batch in sliced(batches):
        texts, metas = _columns(batch)
        shapes, words = text_features(texts)
        kept = [c for c in ("doc_id", "quality", "toxic") if c in batch.schema.names]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(list(shapes), pa.list_(pa.float64())), pa.array(words, pa.list_(pa.int32())), pa.array(metas, pa.list_(pa.int32()))], names=[*kept, "shapes", "words", "metas"])


def _score(shared):
    def run(batches):
        heads = shared.value
        for batch in sliced(batches):
            part = Part.of_texts(*_columns(batch))
            p = [h.probability(part) for h in heads]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(p[0]), pa.array(p[1])], names=["doc_id", "p_bad", "p_toxic"])

    return released(run)


def _count(shared):
    """Rows (head, class, word, documents) over what the views teach; words -1 and -2 count the documents of either view."""

    def run(batches):
        heads, counts, n = shared.value, np.zeros((len(HEADS), 2, WORDS), np.int64), np.zeros((len(HEADS), 2, len(VIEWS)), np.int64)
        for batch in sliced(batches):
            part = Part.of(batch)
            for k, h in enumerate(heads):
                if h.ready:
                    taught = h.taught(part)
                    for c in (0, 1):
                        counts[k, c] += np.bincount(part.words[(taught["text"] == c)[part.word_of]], minlength=WORDS)
                        n[k, c] += [(taught[v] == c).sum() for v in VIEWS]
        for k in range(len(HEADS)):
            for c in (0, 1):
                word = np.flatnonzero(counts[k, c])
                ids, values = np.append(word, [-1, -2]), np.append(counts[k, c, word], n[k, c])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), k), pa.int32()), pa.array(np.full(len(ids), c), pa.int32()), pa.array(ids, pa.int32()), pa.array(values, pa.int64())], names=["head", "class", "word", "n"])

    return released(run)


_PICKED = ", ".join(f"index{m} array<int>, y{m} int" for m in ("0", "0m", "1", "1m"))


def _pick(shared):
    """For each document and head, the indices of both views under the new words, and what the old models teach."""

    def run(batches):
        old, new = shared.value
        for batch in sliced(batches):
            part, arrays, names, some = Part.of(batch), [], [], np.zeros(batch.num_rows, bool)
            for k, (h, to) in enumerate(zip(old, new)):
                taught = h.taught(part) if h.ready else {v: np.full(part.n, -1) for v in VIEWS}
                for v, tail in zip(VIEWS, ("", "m")):
                    index, owner = to.rows(v, part) if h.ready else (np.zeros(0, int), np.zeros(0, int))
                    index = index[np.argsort(owner, kind="stable")].astype(np.int32)
                    starts = np.append(0, np.cumsum(np.bincount(owner, minlength=part.n))).astype(np.int32)
                    arrays += [pa.ListArray.from_arrays(pa.array(starts), pa.array(index)), pa.array(taught[v].astype(np.int32))]
                    names += [f"index{k}{tail}", f"y{k}{tail}"]
                    some |= taught[v] >= 0
            yield pa.RecordBatch.from_arrays(arrays, names=names).filter(pa.array(some))

    return released(run)


def _gradient(weights, share):
    """One row for each model and index with a gradient; index -1 holds the loss."""

    def run(batches):
        total = {m: [0.0, np.zeros(len(w))] for m, w in weights.items()}
        for batch in batches:
            for m, w in weights.items():
                y = batch.column(f"y{m}").to_numpy()
                column = batch.column(f"index{m}")
                owner = np.repeat(np.arange(len(y)), column.value_lengths().to_numpy(zero_copy_only=False))
                value, grad = loss(w, column.flatten().to_numpy(), owner, np.maximum(y, 0), np.select([y == 0, y == 1], share[m], 0.0))
                total[m][0] += value
                total[m][1] += grad
        for m, (value, grad) in total.items():
            index = np.flatnonzero(grad)
            yield pa.RecordBatch.from_arrays([pa.array([m] * (len(index) + 1)), pa.array(np.append(index, -1), pa.int32()), pa.array(np.append(grad[index], value))], names=["model", "index", "value"])

    return released(run)


def _input(docs: DataFrame) -> DataFrame:
    column = lambda name, kind: (F.col(name) if name in docs.columns else F.lit(None)).cast(kind).alias(name)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), column("lang", "string"), column("source", "string"), column("n_chars", "long"))


def _fit_models(heads: list[Head], part: Part, ys: list[np.ndarray], held: np.ndarray, picked: DataFrame | None, share: dict) -> None:
    """Fit all models at once: labelled rows on the driver, gradients of the taught documents on executors."""
    models = {f"{k}{tail}": (h, v) for k, h in enumerate(heads) if h.ready for v, tail in zip(VIEWS, ("", "m"))}
    own, size = {}, {}
    for m, (h, v) in models.items():
        y = ys[int(m[0])]
        use = (y >= 0) & ~held
        own[m] = (*h.rows(v, part), np.maximum(y, 0), use.astype(float))
        size[m] = use.sum() + sum(n * w for n, w in share[m]) if picked is not None else use.sum()
    cuts = np.cumsum([len(h.weights[v]) for h, v in models.values()])[:-1]

    def value(flat):
        w = dict(zip(models, np.split(flat, cuts)))
        total = {m: list(loss(w[m], *own[m])) for m in models}
        if picked is not None:
            got = picked.mapInArrow(_gradient(w, {m: [x[1] for x in share[m]] for m in models}), "model string, index int, value double").toArrow()
            model, index, values = (np.asarray(got.column(c).to_numpy()) for c in ("model", "index", "value"))
            for m in models:
                mine = model == m
                total[m][0] += values[mine & (index < 0)].sum()
                at = mine & (index >= 0)
                total[m][1] = total[m][1] + np.bincount(index[at], values[at], len(w[m]))
        parts = [(total[m][0] / size[m] + 5e-5 * (w[m][:-1] ** 2).sum(), total[m][1] / size[m] + 1e-4 * np.append(w[m][:-1], 0)) for m in models]
        return sum(v for v, _ in parts), np.concatenate([g for _, g in parts])

    start = np.concatenate([h.weights[v] for h, v in models.values()])
    for (h, v), w in zip(models.values(), np.split(minimise(value, start, STEPS if picked is not None else 5 * STEPS), cuts)):
        h.weights[v] = w


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> list[Head]:
    """Co-train both heads on a bounded sample of labelled rows and on all unlabelled documents; the driver keeps nothing of the sample."""
    try:
        return _fit(docs, labels, fit_rows)
    finally:
        trim()


def _fit(docs: DataFrame, labels: DataFrame, fit_rows: int) -> list[Head]:
    spark, texts = docs.sparkSession, _input(docs)
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.struct("quality", "toxic").alias("label")).where("doc_id is not null").groupBy("doc_id").agg(F.min("label").alias("label")).select("doc_id", "label.*")
    chosen = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows).select("doc_id", F.col("quality").cast("int"), F.col("toxic").cast("int"))
    features = "shapes array<double>, words array<int>, metas array<int>"
    # the sample has a fixed bound, so it may be broadcast; only its features reach the driver
    got = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "quality", "toxic").agg(F.min(F.struct("text", "lang", "source", "n_chars")).alias("row")).select("doc_id", "quality", "toxic", "row.*").mapInArrow(_extract, f"doc_id long, quality int, toxic int, {features}").toArrow().sort_by("doc_id").combine_chunks()
    ids, (quality, toxic) = got.column("doc_id").to_pylist(), (np.array([-1 if x not in (0, 1) else x for x in got.column(c).to_pylist()], int) for c in ("quality", "toxic"))
    held = np.array([zlib.crc32(str(i).encode()) % 4 == 0 for i in ids], bool)
    batches = got.to_batches()
    if not batches:
        return [Head(Part.of_texts([], []), np.zeros(0, int), held)] * len(HEADS)
    part, ys = Part.of(batches[0]), [np.where(quality < 0, -1, 1 - quality), toxic]
    del got, batches
    trim()
    heads = [Head(part, y, held) for y in ys]
    ready = [k for k, h in enumerate(heads) if h.ready]
    if not ready:
        return heads
    base = {k: [((ys[k] == c) & ~held).sum() for c in (0, 1)] for k in ready}
    counted = {k: [np.bincount(part.words[((ys[k] == c) & ~held)[part.word_of]], minlength=WORDS) for c in (0, 1)] for k in ready}
    for k in ready:
        heads[k].choose(counted[k], base[k])
    _fit_models(heads, part, ys, held, None, {})
    for k in ready:
        heads[k].calibrate(part, ys[k], held)
    free = written(texts.mapInArrow(_extract, f"doc_id long, {features}").join(own.select("doc_id").hint("merge"), "doc_id", "left_anti").drop("doc_id"), "features")
    for _ in range(ROUNDS - 1):
        old = heads
        shared = spark.sparkContext.broadcast(old)
        sums = free.mapInArrow(_count(shared), "head int, class int, word int, n long").groupBy("head", "class", "word").agg(F.sum("n").alias("n")).toArrow()
        head, label, word, n = (sums.column(c).to_numpy() for c in ("head", "class", "word", "n"))
        heads, share = copy.deepcopy(old), {}
        for k in ready:
            taught = {}
            for c in (0, 1):
                mine = (head == k) & (label == c)
                for v, tail, mark in zip(VIEWS, ("", "m"), (-1, -2)):
                    total = int(n[mine & (word == mark)].sum())
                    # all taught documents count, but together no more than the labelled ones of their class: the few wrong ones among many would outweigh true labels
                    share.setdefault(f"{k}{tail}", []).append((total, min(1.0, base[k][c] / max(total, 1))))
                at = mine & (word >= 0)
                taught[c] = np.bincount(word[at], n[at], WORDS)
            weight = share[str(k)]
            heads[k].choose([counted[k][c] + weight[c][1] * taught[c] for c in (0, 1)], [base[k][c] + weight[c][0] * weight[c][1] for c in (0, 1)])
        picked = written(free.mapInArrow(_pick(spark.sparkContext.broadcast((old, heads))), _PICKED), "taught")
        _fit_models(heads, part, ys, held, picked, share)
        for k in ready:
            heads[k].calibrate(part, ys[k], held)
        trim()
    return heads


def classify(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """Score every document: doc_id, p_bad, p_toxic, rejected.

    Each label is a head with two views: the text (shape of the writing, hashed words that go
    with the label) and the metadata (language, source, size). In each exchange both views score
    every unlabelled document; each gives the other all labels whose calibrated probability of
    being wrong is CONFIDENT at most, words are chosen again from the counts of labelled and
    taught documents, and the models are fitted by gradients summed on executors. Both views
    are calibrated on held-out labelled rows and combined there. All documents are then scored
    in the scan; rejected are those of p_bad or p_toxic at the threshold or above.

    Defined cases: null text is empty, null or missing metadata a value of its own; labels
    that are null or outside 0 and 1 count as unlabelled; of repeated labels or documents of
    one id the smallest is fitted on, so the sample stays bounded; a label with
    fewer than LEAST_LABELS documents of either kind in either part rejects nothing; repeated
    rows are scored alike; an empty table gives an empty result. Other columns are ignored.
    """
    spark = docs.sparkSession
    heads = spark.sparkContext.broadcast(fit(docs, labels, fit_rows))
    scored = _input(docs).mapInArrow(_score(heads), "doc_id long, p_bad double, p_toxic double")
    return scored.withColumn("rejected", (F.col("p_bad") >= threshold) | (F.col("p_toxic") >= threshold))
