"""Mixing to target weights: soft domain membership, and rates by projected gradient least squares."""

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, id_and_text, written

#: Domains are what the labelled table tells apart: quality and toxicity.
DOMAINS = ("q0t0", "q0t1", "q1t0", "q1t1")
#: Target weights of expected tokens; with KEEP, that domain stays whole and the others are held to their weight beside it.
TARGETS = {"q0t0": 0.02, "q0t1": 0.01, "q1t0": 0.94, "q1t1": 0.03}
KEEP = "q1t0"
#: Labelled rows that the classifier is fitted on at most, those of least hash; hashed features; ridge on 1 - rate.
FIT_ROWS, FEATURES, RIDGE = 20_000, 1 << 14, 1e-6
STEPS, TOLERANCE = 60, 1e-6


def _tokens(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), SPACE, -1), "")


def posteriors(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", fit_rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, n_tokens, p (posterior of each of DOMAINS) for every document.

    A multinomial logistic regression on hashed words, fitted on a bounded sample of labelled
    documents (the fit_rows rows of least hash). With fewer than two labelled domains the
    posteriors are the labels' shares, or equal ones without labels.
    """
    # marks around words are features of their own, so that "idiot###" still is "idiot"
    words = lambda text: F.concat(_tokens(F.regexp_replace(text, r"[^\p{L}\p{N}\s]+", " ")), F.transform(F.array_distinct(_tokens(F.regexp_replace(text, r"[\p{L}\p{N}]+", " "))), lambda x: F.concat(F.lit("mark:"), x)))
    texts = id_and_text(docs, id_col, text_col)
    domain = (F.col("quality") * 2 + F.col("toxic")).cast("double")
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), domain.alias("label")).where("doc_id is not null and label in (0, 1, 2, 3)").groupBy("doc_id").agg(F.min("label").alias("label"))
    sample = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    hashing = HashingTF(numFeatures=FEATURES, binary=True, inputCol="words", outputCol="features")
    known = texts.join(F.broadcast(sample), "doc_id").groupBy("doc_id").agg(F.min("label").alias("label"), F.min("text").alias("text")).select("label", words(F.col("text")).alias("words"))
    fit = written(hashing.transform(known).select("label", "features"), "fit")
    counts = {r["label"]: r["count"] for r in fit.groupBy("label").count().collect()}
    if len(counts) < 2:
        share = np.array([counts.get(float(i), 0) for i in range(len(DOMAINS))], float)
        share = share / share.sum() if share.sum() else np.full(len(DOMAINS), 1 / len(DOMAINS))
        return texts.select("doc_id", F.size(_tokens(F.col("text"))).cast("long").alias("n_tokens"), F.array(*map(F.lit, share.tolist())).alias("p"))
    model = LogisticRegression(maxIter=25, regParam=2e-3, standardization=False, family="multinomial").fit(fit)
    scored = model.transform(hashing.transform(texts.select("doc_id", F.size(_tokens(F.col("text"))).cast("long").alias("n_tokens"), words(F.col("text")).alias("words"))))
    p = vector_to_array("probability")
    n = model.numClasses
    return scored.select("doc_id", "n_tokens", p.alias("v")).select("doc_id", "n_tokens", F.array(*(F.col("v")[i] if i < n else F.lit(0.0) for i in range(len(DOMAINS)))).alias("p"))


def fit_rates(members: DataFrame, targets: np.ndarray) -> np.ndarray:
    """Multipliers w such that rates max(least, 1 - p.w) meet the targets' expected tokens; `least` is a column, 0 or more.

    It minimises the squared distance of domain totals to their targets, over nonnegative
    rates (and rates of `least` or more), with a small ridge on 1 - rate, by projected gradient steps from rates of 1. The
    gradient of a document's rate is p.gap, the same D numbers for all, so the unprojected
    rates after any steps are 1 - p.w for the sum w of the steps, and their projection on
    rates of 0 or more is what meets the targets next; w are the multipliers of the dual. A
    step is scaled by the Gram matrix of the documents whose rate isn't at its bound, and
    halves until the dual's value falls enough, so the steps also end where bounds keep the
    targets out of reach. One aggregation of 1 + D + D*D numbers over all documents makes a
    step, and nothing per document leaves the executors.
    """
    d = len(targets)
    total = max(float(members.agg(F.sum("n_tokens")).first()[0] or 0), 1.0)
    goal = targets / total

    def at(w):
        """The dual's value, its gradient and the Gram matrix."""
        raw = sum((F.col("p")[i] * float(w[i]) for i in range(d)), F.lit(0.0))
        live = 1.0 - raw > F.col("least")
        rate = F.greatest(F.col("least"), 1.0 - raw)
        loss = F.when(live, raw * raw / 2 - raw).otherwise(-F.col("least") * raw - (1 - F.col("least")) ** 2 / 2)
        weight = F.when(live, F.col("n_tokens")).otherwise(0)
        sums = [F.sum(loss * F.col("n_tokens")), *(F.sum(rate * F.col("n_tokens") * F.col("p")[i]) for i in range(d))]
        sums += [F.sum(weight * F.col("p")[i] * F.col("p")[j]) for i in range(d) for j in range(i, d)]
        got = np.array([x or 0.0 for x in members.agg(*sums).first()]) / total
        gram = np.zeros((d, d))
        gram[np.triu_indices(d)] = got[1 + d :]
        gram = gram + gram.T - np.diag(np.diag(gram))
        return got[0] + goal @ w + RIDGE / 2 * w @ w, goal - got[1 : 1 + d] + RIDGE * w, gram

    w, size = np.zeros(d), 1.0
    value, slope, gram = at(w)
    for _ in range(STEPS):
        if np.abs(slope).max() < TOLERANCE or size < 1e-9:
            break
        step = -np.linalg.solve(gram + RIDGE * np.eye(d), slope)
        new = at(w + size * step)
        if new[0] <= value + 1e-4 * size * (slope @ step):
            w, (value, slope, gram), size = w + size * step, new, min(1.0, size * 4)
        else:
            size /= 4
    return w


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, keep: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rates of documents whose expected domain tokens match target weights.

    Returns one row per document: doc_id, n_tokens, p (posterior of each of DOMAINS), rate
    and copies (the rate rounded up or down at random, keyed by doc_id, so that its mean is
    the rate and expected totals stay on target).

    Without `keep` the totals are weights times all tokens. With it, that domain's total is
    what it has now, and another domain's its weight in proportion, or what it has if that is
    less: nothing is repeated to fill a domain. A document that is more likely of `keep` than of all other domains
    then has a rate of 1 at least, a bound that the fit knows.

    Defined cases: null or empty texts have no tokens and weigh nothing in the totals; labels
    that are null, outside 0 and 1, or without a document are not used, and of repeated ones
    the smallest is, beside the smallest text of that id; repeated rows are separate documents; an empty table gives an empty result.
    Other columns are ignored. No row is shuffled by domain or source, so none can be hot.
    """
    least = F.when(F.col("p")[DOMAINS.index(keep)] > 0.5, 1.0).otherwise(0.0) if keep else F.lit(0.0)
    members = written(posteriors(docs, labels, id_col, text_col).withColumn("least", least), "members")
    have = members.agg(*(F.sum(F.col("n_tokens") * F.col("p")[i]) for i in range(len(DOMAINS)))).first()
    have = np.array([x or 0.0 for x in have])
    weights = np.array([targets[k] for k in DOMAINS]) / sum(targets.values())
    if keep:
        k = DOMAINS.index(keep)
        goal = np.minimum(have, weights / weights[k] * have[k])
    else:
        goal = weights * have.sum()
    w = fit_rates(members, goal)
    rate = F.greatest(F.col("least"), 1.0 - sum((F.col("p")[i] * float(w[i]) for i in range(len(DOMAINS))), F.lit(0.0)))
    chance = F.pmod(F.xxhash64("doc_id", F.lit("copies")), F.lit(1 << 30)) / float(1 << 30)
    copies = F.floor(F.col("rate") + chance).cast("int")
    return members.withColumn("rate", rate).withColumn("copies", copies).drop("least")
