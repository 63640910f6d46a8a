"""Entity resolution: blocking, similarity, scoring, clusters, canonical rows, registries."""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalars as x
from ..sources.store import partitions
from .similarity import cached_ratio, levenshtein_ratio, matching_ratio, name_similarity, similar


def exact_pairs(names: DataFrame, key: str = "key") -> DataFrame:
    """Pairs of rows with one normalised key, each row with the least of its group: links, not all pairs."""
    first = names.groupBy(key).agg(F.min("id").alias("a"))
    return names.join(first, key).where("id != a").select("a", F.col("id").alias("b"))


def fuzzy_pairs(names: DataFrame, threshold: float, block: Column, ratio=levenshtein_ratio) -> DataFrame:
    """Pairs within a block whose similarity reaches the threshold; equal names meet once, as one row.

    Candidates come from an inverted index (similarity.similar), so a large block isn't compared with itself.
    """
    n = names.where("key != ''").groupBy("key").agg(F.min("id").alias("id"))
    near = similar(n, n, threshold, ratio is levenshtein_ratio, block).where("key < other and similarity >= " + repr(threshold))
    pairs = near.join(n, "key").withColumnRenamed("id", "i").join(n.select(F.col("key").alias("other"), F.col("id").alias("j")), "other")
    return pairs.select(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b"), "similarity")


def match_candidates(names: DataFrame, threshold: float, block: Column, ratio=matching_ratio) -> DataFrame:
    """Exact and fuzzy candidates, each unordered pair once with its best method; fuzzy ones of .98 and above are for review."""
    exact = exact_pairs(names).select("a", "b", F.lit("exact").alias("method"), F.lit(1.0).alias("score"))
    fuzzy = fuzzy_pairs(names, threshold, block, ratio).select("a", "b", F.lit("fuzzy").alias("method"), F.col("similarity").alias("score"))
    best = exact.unionByName(fuzzy).groupBy("a", "b").agg(F.max(F.struct("score", "method")).alias("m")).select("a", "b", "m.method", "m.score")
    return best.withColumn("review", (F.col("method") == "fuzzy") & ((F.col("score") >= 0.98) | (F.col("score") < 0.88)))


def profiles(starts: DataFrame) -> DataFrame:
    """Five most frequent owners and trainers of each horse, starts, courses and date range."""
    out = starts.groupBy("horse_id").agg(F.count("*").alias("starts"), F.min("race_date").alias("first_day"), F.max("race_date").alias("last_day"), F.sort_array(F.collect_set("course")).alias("courses"))
    for role in ("owner_id", "trainer_id"):
        g = starts.groupBy("horse_id", role).agg(F.count("*").alias("n"))
        g = g.withColumn("rn", F.row_number().over(Window.partitionBy("horse_id").orderBy(F.desc("n"), role))).where("rn <= 5")
        out = out.join(g.groupBy("horse_id").agg(F.sort_array(F.collect_list(role)).alias(role + "s"), F.min_by(role, "rn").alias("first_" + role)), "horse_id", "left")
    return out


def candidate_pairs(names: DataFrame, large: int | None = None) -> DataFrame:
    """Pairs a < b of one source id, of one block (sex, first token, first 3 letters) or of one name.

    With `large`, blocks of more rows give only pairs of one name. Columns: id, key, sex; source
    and source_id, if there.
    """
    own = [c for c in ("source", "source_id") if c in names.columns]
    n = names.select("id", "key", *own, F.concat_ws("|", F.coalesce("sex", F.lit("?")), F.split("key", " ")[0], F.substring(F.replace("key", F.lit(" "), F.lit("")), 1, 3)).alias("block"))
    small = n if large is None else n.join(n.groupBy("block").agg(F.count("*").alias("n")).where(F.col("n") <= large).select("block"), "block")
    meet = lambda df, on: df.alias("p").join(df.alias("q"), [F.col(f"p.{c}") == F.col(f"q.{c}") for c in on] + [F.col("p.id") < F.col("q.id")]).select(F.col("p.id").alias("a"), F.col("q.id").alias("b"))
    out = meet(n.where("key != ''"), ["key"]).unionByName(meet(small, ["block"]))
    if len(own) == 2:
        out = out.unionByName(meet(n.where("source_id != '' and source != ''"), own))
    return out.distinct()


def paired(rows: DataFrame, large: int | None = None) -> DataFrame:
    """The pairs of candidate_pairs with the columns of either side (a, b, `<column>_a`, `<column>_b`) and their name_score.

    A pair comes of the first rule that it fits, so pairs are neither made distinct nor joined
    to their sides: they are made where the rows of a name or block meet, and only rows are
    shuffled. Their number is quadratic in the rows of a block; partitions keep their number,
    since what they give is no matter of their size.
    """
    spark = rows.sparkSession
    n = rows.withColumn("block", F.concat_ws("|", F.coalesce("sex", F.lit("?")), F.split("key", " ")[0], F.substring(F.replace("key", F.lit(" "), F.lit("")), 1, 3)))
    c = F.col
    n = n.withColumn("small", F.lit(True)) if large is None else n.join(n.groupBy("block").agg((F.count("*") <= large).alias("small")), "block")

    other = (c("key_a") != c("key_b")) | (c("key_a") == "")
    out = meet_tiled(n.where("key != ''"), ["key"]).withColumn("name_score", F.lit(1.0))
    rest = meet_tiled(n.where("small"), ["block"], [other])
    if "source" in rows.columns and "source_id" in rows.columns:
        rest = rest.unionByName(meet_tiled(n.where("source_id != '' and source != ''"), ["source", "source_id"], [other, (c("block_a") != c("block_b")) | ~c("small_a")]))
    near = rest.withColumn("name_score", F.when(c("key_a") == c("key_b"), 0.0).otherwise(name_similarity(c("key_a"), c("key_b"), cached_ratio)))
    return out.unionByName(near).drop("block_a", "block_b", "small_a", "small_b")


#: A group is cut into the square root of so many rows' share of it: cells of few rows, and few copies of a row.
TILE = 64


def meet_tiled(df: DataFrame, on: list[str], apart: list[Column] | None = None) -> DataFrame:
    """Pairs a < b of rows that are equal in the columns `on`, with the columns of either side; `apart` are further conditions.

    A group of n rows is cut into t = sqrt(n / TILE) tiles, and each pair of tiles is a cell of its
    own: a row goes to 2 t cells, and a large group is dealt over all tasks, of which none holds more than
    the rows of a tile.
    """
    c, parts = F.col, partitions(df.sparkSession)
    tiles = df.groupBy(*on).agg(F.ceil(F.sqrt(F.count("*") / TILE)).cast("int").alias("_t"))
    d = df.join(tiles, on).withColumn("_own", F.pmod(F.xxhash64("id"), c("_t").cast("long")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), c("_t") - 1))

    def side(k, mine, theirs):
        s = d.withColumn(theirs, every).withColumnRenamed("_own", mine).repartition(parts, *on, "_i", "_j")
        return s.select(*(c(v).alias(k if v == "id" else f"{v}_{k}") for v in (*df.columns, "_i", "_j")))

    same = [c(f"{v}_a") == c(f"{v}_b") for v in (*on, "_i", "_j")]
    return side("a", "_i", "_j").hint("merge").join(side("b", "_j", "_i"), [*same, c("a") < c("b"), *(apart or [])]).drop("_i_a", "_j_a", "_i_b", "_j_b")


def name_scores(pairs: DataFrame, ratio=matching_ratio) -> DataFrame:
    """The similarity of key_a and key_b as name_score; two different names are compared once."""
    keys = pairs.where("key_a != key_b").select("key_a", "key_b").distinct()
    scored = keys.select("key_a", "key_b", name_similarity(F.col("key_a"), F.col("key_b"), ratio).alias("s"))
    same = F.when(F.col("key_a") == F.col("key_b"), F.when(F.col("key_a") == "", 0.0).otherwise(1.0))
    return pairs.join(scored, ["key_a", "key_b"], "left").withColumn("name_score", F.coalesce(same, "s", F.lit(0.0))).drop("s")


def days_apart(days_a: Column, days_b: Column) -> Column:
    """The least number of days between a day of either list: neighbours of different lists in their common order, not all pairs."""
    mark = lambda days, side: F.transform(days, lambda d: F.unix_date(d) * 2 + side)
    merged = lambda m: F.zip_with(F.slice(m, 1, F.size(m) - 1), F.slice(m, 2, F.size(m) - 1), lambda p, q: F.when((p + q) % 2 != 0, F.shiftright(q, 1) - F.shiftright(p, 1)))
    both = F.array(F.sort_array(F.concat(mark(days_a, 0), mark(days_b, 1))))  # sorted once, read by name
    return F.when((F.size(days_a) > 0) & (F.size(days_b) > 0), F.array_min(F.element_at(F.transform(both, merged), 1)))


@F.arrow_udf(T.StructType([T.StructField(k, T.IntegerType()) for k in ("gap", "same", "shared", "only_a", "only_b")]))
def careers_met(days_a: pa.Array, days_b: pa.Array, courses_a: pa.Array, courses_b: pa.Array) -> pa.Array:
    """days_apart, and how many days and courses two careers share or have alone; nothing is null but what a missing list leaves open. A batch of pairs is sorted at once."""
    n = len(days_a)

    def met(pair: np.ndarray, value: np.ndarray, side: np.ndarray, n: int) -> tuple[np.ndarray, ...]:
        """For n pairs of sets, given as rows (pair, value, side): least distance of values of either side (-1 if none), values in both, in the first alone, in the second alone."""
        key = np.unique((pair << 34) | ((value + 2**31) << 1) | side)
        p, v, s = key >> 34, (key >> 1) & (2**33 - 1), key & 1
        at = np.flatnonzero((p[1:] == p[:-1]) & (s[1:] != s[:-1]))  # neighbours of different sides
        q, d = p[at], v[at + 1] - v[at]
        least = np.full(n, -1)
        if len(at):
            first = np.flatnonzero(np.r_[True, q[1:] != q[:-1]])
            least[q[first]] = np.minimum.reduceat(d, first)
        both = np.bincount(q[d == 0], minlength=n)
        return least, both, np.bincount(p[s == 0], minlength=n) - both, np.bincount(p[s == 1], minlength=n) - both

    def counted(a, b, codes):
        lists = [v.flatten() for v in (a, b)]
        where = [np.repeat(np.arange(n), v.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)) for v in (a, b)]
        side = np.repeat([0, 1], [len(w) for w in where])
        return met(np.concatenate(where), codes(pa.concat_arrays(lists)).to_numpy(zero_copy_only=False).astype("int64"), side, n)

    gap, same, _, _ = counted(days_a, days_b, lambda v: v.cast(pa.int32()))
    _, shared, only_a, only_b = counted(courses_a, courses_b, lambda v: v.dictionary_encode().indices)
    no_days, no_courses = (np.asarray(a.is_null()) | np.asarray(b.is_null()) for a, b in ((days_a, days_b), (courses_a, courses_b)))
    columns = [(gap, gap < 0), (same, no_days), *((v, no_courses) for v in (shared, only_a, only_b))]
    return pa.StructArray.from_arrays([pa.array(v.astype("int32"), mask=m) for v, m in columns], ["gap", "same", "shared", "only_a", "only_b"])


def continuity_score(days_a: Column, days_b: Column, met: Column) -> tuple[Column, Column]:
    """How well two careers continue each other, null if one has no days; and whether they exclude each other. `met` is careers_met."""
    missing = F.coalesce((F.size(days_a) <= 0) | (F.size(days_b) <= 0), F.lit(True))
    only_a, only_b, shared, gap = met["only_a"] > 0, met["only_b"] > 0, met["shared"] > 0, met["gap"]
    clash = F.coalesce(~missing & (met["same"] > 0) & only_a & only_b & ~shared, F.lit(False))
    span = F.datediff(F.greatest(F.array_max(days_a), F.array_max(days_b)), F.least(F.array_min(days_a), F.array_min(days_b)))
    mixed = ((F.array_min(days_a) < F.array_max(days_b)) & (F.array_min(days_b) < F.array_max(days_a))) | (gap <= 120)
    score = F.when(clash, 0.0).when(span == 0, 0.55).when(mixed & (only_a | only_b) & (gap <= 60), 0.95).when(mixed & (gap <= 120), 0.85).when(shared & (gap <= 180), 0.75).when(gap <= 365, 0.6).when(gap > 900, 0.25).otherwise(0.45)
    return F.when(~missing, score), clash


def score_pairs(pairs: DataFrame, *more: Column) -> DataFrame:
    """Eight weighted signals of candidate pairs, renormalised over those present, with vetoes, boosts and a verdict.

    Columns of either side, ending in _a and _b: sex, year, sire, dam, owner and trainer (the
    most frequent), owners, trainers, courses, days; source and source_id, if there. Ids stand
    for names of parents and people, so such a signal is 1 or 0. The left side's first owner
    and trainer are looked for among all of the right. `more`: further columns of the result,
    which may read `met` (careers_met).
    """
    both = lambda k: (F.col(k + "_a"), F.col(k + "_b"))
    sim, (sex_a, sex_b) = F.col("name_score"), both("sex")
    known = sex_a.isin("male", "female", "gelding") & sex_b.isin("male", "female", "gelding")
    sex = F.when(known, F.when(sex_a == sex_b, 1.0).when(sex_a.isin("male", "gelding") & sex_b.isin("male", "gelding"), 0.4).otherwise(0.0))
    apart = F.abs(F.col("year_a") - F.col("year_b"))
    year = F.when(apart.isNotNull(), F.when(apart == 0, 1.0).when(apart == 1, 0.7).when(apart == 2, 0.3).otherwise(0.0))
    equal = lambda k: (both(k)[0] == both(k)[1]).cast("double")
    among = lambda k: F.when(F.col(f"{k}_a").isNotNull() & (F.size(f"{k}s_b") > 0), F.array_contains(F.col(f"{k}s_b"), F.col(f"{k}_a")).cast("double"))
    flow, clash = continuity_score(*both("days"), F.col("met"))
    p = pairs.withColumn("met", careers_met(*both("days"), *both("courses"))).withColumns({"a": x.unfused(F.col("a")), "_sex": sex, "_year": year, "_flow": flow, "_clash": clash})
    sex, year, flow, clash = (F.col(c) for c in ("_sex", "_year", "_flow", "_clash"))
    base = x.weighted_present([(0.30, sim), (0.12, equal("sire")), (0.12, equal("dam")), (0.10, year), (0.08, sex), (0.08, among("owner")), (0.07, among("trainer")), (0.13, flow)])
    veto = F.when(sex == 0, 0.35).otherwise(1.0) * F.when(sim < 0.55, 0.5).otherwise(1.0) * F.when(clash, 0.25).otherwise(1.0) * F.when(year == 0, 0.55).otherwise(1.0)
    source = F.lit(False)
    if "source_id_a" in pairs.columns and "source_a" in pairs.columns:
        source = F.coalesce((F.col("source_id_a") == F.col("source_id_b")) & (F.col("source_a") == F.col("source_b")) & (F.col("source_id_a") != ""), F.lit(False))
    p = p.withColumns({"a": x.unfused(F.col("a")), "_s": F.when(source, F.greatest(base * veto, F.lit(0.99))).otherwise(base * veto)})
    auto = (F.col("_s") >= 0.88) & (sim >= 0.8)
    national = F.coalesce(~auto & ~clash & (sim >= 0.98) & (sex == 1) & (year >= 0.7) & (flow >= 0.75), F.lit(False))
    verdict = F.when(auto | national, "auto").when((F.col("_s") >= 0.72) & (sim >= 0.65), "candidate").otherwise("distinct")
    return p.select(x.unfused(F.col("a")).alias("a"), "b", F.when(national, F.greatest("_s", F.lit(0.88))).otherwise(F.col("_s")).alias("score"), verdict.alias("verdict"), *more)


def continuity(pairs: DataFrame) -> DataFrame:
    """Days on which both started, the least gap between their careers, and shared courses."""
    met = pairs.withColumn("met", careers_met("days_a", "days_b", "courses_a", "courses_b"))
    return met.select("a", "b", *continuity_columns())


def continuity_columns() -> tuple[Column, ...]:
    a, b = F.col("days_a"), F.col("days_b")
    gap = F.greatest(F.datediff(F.array_min(b), F.array_max(a)), F.datediff(F.array_min(a), F.array_max(b)))
    return F.col("met.same").alias("same_days"), F.when(gap > 0, gap).otherwise(0).alias("career_gap"), F.col("met.shared").alias("shared_courses")


def canonical(members: DataFrame) -> DataFrame:
    """The canonical row of each component: most starts, longest name, least id."""
    best = F.min(F.struct((-F.col("starts")).alias("s"), (-F.length("name")).alias("l"), "id"))
    c = members.groupBy("component").agg(best.alias("b"), F.count("*").alias("members")).select("component", F.col("b.id").alias("canonical_id"), "members")
    return members.join(c, "component").select("id", "canonical_id", "members")


def apply_corrections(rows: DataFrame, corrections: DataFrame, value: str) -> DataFrame:
    """Overlay of corrected values, by source id, then by id; the old value stays beside the new."""
    c = corrections.select(F.col("key").alias("k"), "new_value", "source_note")
    s = rows.join(c.select(F.col("k").alias("source_id"), F.col("new_value").alias("v1")), "source_id", "left").join(c.select(F.col("k").alias("id"), F.col("new_value").alias("v2")), "id", "left")
    return s.withColumn("old_" + value, F.col(value)).withColumn(value, F.coalesce("v1", "v2", value)).drop("v1", "v2")


def resolve(queries: DataFrame, directory: DataFrame, k: int, edits: bool = True, least: float = 0.7) -> DataFrame:
    """Best ids for each query, k at most: query_id, id, score, decision, rank.

    A query whose source_id the directory has gets that id at .99 and no other ("source_id");
    the other queries an exact name at .99 ("exact") and names of similarity `least` or more
    ("name"), by score and id. Names meet by an inverted index (similarity.similar), with
    Levenshtein's ratio or, without `edits`, that of matching blocks. A directory may hold
    several names for an id. Of the ids of one name, only the k least can be among the best.
    """
    best = lambda key: F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), "id"))
    known = None
    if "source_id" in queries.columns and "source_id" in directory.columns:
        sources = directory.where("source_id != ''").groupBy("source_id").agg(F.min("id").alias("id"))
        known = queries.join(sources, "source_id").groupBy("query_id").agg(F.min("id").alias("id"))
        known = known.select("query_id", "id", F.lit(0.99).alias("score"), F.lit("source_id").alias("decision"))
        queries = queries.join(known.select("query_id"), "query_id", "left_anti")
    near = similar(queries, directory, least, edits).select(F.col("key").alias("q"), F.col("other").alias("key"), F.col("similarity").alias("score"))
    same = queries.select("key").where("key != ''").distinct().join(directory.select("key").distinct(), "key")
    pairs = near.union(same.select(F.col("key").alias("q"), "key", F.lit(0.99).alias("score")))
    first = directory.select("key", "id").distinct().withColumn("rn", F.row_number().over(Window.partitionBy("key").orderBy("id"))).where(F.col("rn") <= k).drop("rn")
    top = pairs.join(first, "key").groupBy("q", "id").agg(F.max("score").alias("score"), F.max(F.col("q") == F.col("key")).alias("exact"))
    top = top.withColumn("rank", best("q")).where(F.col("rank") <= k)
    out = queries.select("query_id", F.col("key").alias("q")).join(top.drop("rank"), "q").groupBy("query_id", "id").agg(F.max("score").alias("score"), F.max("exact").alias("exact"))
    out = out.select("query_id", "id", "score", F.when(F.col("exact"), "exact").otherwise("name").alias("decision"))
    out = out if known is None else out.unionByName(known)
    return out.withColumn("rank", best("query_id")).where(F.col("rank") <= k)


def collisions(ids: DataFrame, fields: list[str]) -> DataFrame:
    """Names whose rows disagree in a field."""
    sets = ids.groupBy("key").agg(F.count("*").alias("rows"), *(F.array_size(F.collect_set(f)).alias(f) for f in fields))
    return sets.where(F.greatest(*fields) > 1 if len(fields) > 1 else F.col(fields[0]) > 1)


def entity_registry(parts: dict[str, DataFrame]) -> DataFrame:
    """One row per kind and normalised name; the least source id comes first."""
    out = None
    for kind, df in parts.items():
        r = df.select(F.lit(kind).alias("kind"), x.normalize_name(F.col("name")).alias("key"), "id", "name").where("key != ''")
        out = r if out is None else out.unionByName(r)
    return out.groupBy("kind", "key").agg(F.min("id").alias("id"), F.countDistinct("name").alias("aliases"))


def search_names(directory: DataFrame, q: str, n: int) -> DataFrame:
    """Exact first, then containment either way; shorter names, then ids."""
    hit = F.col("key").contains(q) | F.lit(q).contains(F.col("key"))
    return directory.where(hit).orderBy(F.desc((F.col("key") == q).cast("int")), F.length("key"), "id").limit(n)


def resolve_pedigree(assertions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Relationships that all sources agree on, and conflicts (more than one parent in a field)."""
    parent = F.coalesce(F.concat(F.lit("src:"), F.col("parent_source_id").cast("string")), F.concat(F.lit("name:"), x.normalize_name(F.col("parent_name"))))
    g = assertions.withColumn("parent", parent).where("parent is not null").groupBy("horse_id", "field").agg(F.sort_array(F.collect_set("parent")).alias("parents"), F.count("*").alias("sources"))
    return g.where(F.size("parents") == 1).select("horse_id", "field", F.element_at("parents", 1).alias("parent"), "sources"), g.where(F.size("parents") > 1)


def pedigree_coverage(horses: DataFrame) -> DataFrame:
    """Horses with sire, dam, both and neither, by breed and in all."""
    s, d = F.col("sire_id").isNotNull(), F.col("dam_id").isNotNull()
    return horses.rollup("breed").agg(F.count("*").alias("horses"), F.count_if(s).alias("sire"), F.count_if(d).alias("dam"), F.count_if(s & d).alias("both"), F.count_if(~s & ~d).alias("neither"))
