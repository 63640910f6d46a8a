"""Line dedup: a log-template tree; lines whose template recurs across documents are dropped."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import forget, id_and_text, written

#: Leading tokens that, with the token count, make a node of the tree.
DEPTH = 2
#: Documents that a template, and lines of a node that a token in one place, have to be in.
MIN_DOCS = 10
FIELD = "<*>"
#: Fields that vary in any line: tokens with a digit, an @ or a scheme (in lines of single spaces).
VARIABLE = r"(?<![^ ])(?:[^ 0-9@]*+[0-9@]|[^ ]*?://)[^ ]*"
BLANK = r"[\x20\x09\x0B-\x0D]+"


def lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _tokens(text: str) -> Column:
    return F.length(text) - F.length(F.replace(F.col(text), F.lit(" "), F.lit(""))) + 1


def _hash(*parts: Column) -> Column:
    return F.unhex(F.md5(F.concat_ws("\x1f", *parts)))


def parsed(texts: DataFrame, depth: int = DEPTH) -> DataFrame:
    """One row per line that isn't blank: doc_id, h (hash of the text), i, node, path, masked (null if the line stands for itself).

    Patterns run only on the lines that hold something for them to find.
    """
    each = texts.select("doc_id", F.xxhash64("text").alias("h"), F.posexplode(lines(F.col("text"))).alias("i", "line"))
    odd = F.col("line").rlike(r"[\x09\x0B-\x0D]|\x20\x20|^\x20|\x20$")
    plain = each.select("doc_id", "h", "i", F.when(odd, F.trim(F.regexp_replace("line", BLANK, " "))).otherwise(F.col("line")).alias("plain")).where("plain != ''")
    fields = F.col("plain").rlike("[0-9@]") | F.contains(F.col("plain"), F.lit("://"))
    masked = plain.withColumn("masked", F.when(fields, F.regexp_replace("plain", VARIABLE, FIELD)).otherwise(F.col("plain")))
    holes = F.when(F.contains(F.col("masked"), F.lit(FIELD)), F.size(F.filter(F.split("masked", " "), lambda x: x == FIELD))).otherwise(0)
    counted = masked.withColumn("n", _tokens("masked")).withColumn("masked", F.when(2 * holes <= F.col("n"), F.col("masked")))
    path = F.when(F.col("masked").isNull(), _hash(F.lit("line"), F.col("plain"))).otherwise(_hash(F.col("masked")))
    node = F.when(F.col("masked").isNull(), F.col("path")).otherwise(_hash(F.col("n").cast("string"), F.substring_index("masked", " ", depth)))
    return counted.withColumn("path", path).select("doc_id", "h", "i", node.alias("node"), "path", "masked")


def templates(candidates: DataFrame, min_docs: int = MIN_DOCS, depth: int = DEPTH) -> DataFrame:
    """path -> template for the paths of more than `depth` tokens that generalise.

    Beyond the leading tokens, a token stays if min_docs lines of the node have it in its
    place; the others become fields. Equal lines count together before tokens are exploded.
    """
    distinct = candidates.where(F.col("masked").isNotNull() & (_tokens("masked") > depth)).groupBy("path").agg(F.first("node").alias("node"), F.first("masked").alias("masked"), F.count(F.lit(1)).alias("n"))
    distinct = written(distinct, "paths")
    each = distinct.select("path", "node", "n", F.posexplode(F.split("masked", " ")).alias("at", "token")).where((F.col("at") >= depth) & (F.col("token") != FIELD))
    often = each.groupBy("node", "at", "token").agg(F.sum("n").alias("lines")).where(F.col("lines") >= min_docs).select("node", "at", "token")
    stay = each.join(often, ["node", "at", "token"]).groupBy("path").agg(F.collect_set("at").alias("stay"))
    places = F.coalesce("stay", F.expr("array()").cast("array<int>"))
    general = F.transform(F.split("masked", " "), lambda x, at: F.when((at < depth) | F.array_contains(places, at), x).otherwise(FIELD))
    own = distinct.join(stay, "path", "left").select("path", general.alias("t"))
    return own.where(2 * F.size(F.filter("t", lambda x: x != FIELD)) >= F.size("t")).select("path", _hash(F.array_join("t", " ")).alias("template"))


def line_dedup(docs: DataFrame, min_docs: int = MIN_DOCS, depth: int = DEPTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Drop every line whose template occurs in min_docs documents or more.

    Returns one row per document: doc_id, n_lines, n_dropped, text (the lines left, joined by
    newlines; dropped lines leave nothing).

    The tree has a fixed depth: token count, then the `depth` leading tokens (all, if a line
    has no more), where tokens that hold a digit, an @ or a scheme are one variable field.
    Below a node, a further token stays in a template if min_docs lines of the node have it in
    the same place; others are generalised to fields, so lines that differ in a name meet. A
    template keeps half of its tokens or more: a line that would keep fewer has its masked
    tokens as template, and itself if even these are mostly fields.

    Only nodes of min_docs lines or more can hold a recurring template, so all other lines
    fall away by an aggregation of hashes that combines before the shuffle; a line that is in a
    third of all documents then is one row wherever tokens are counted. Documents count once
    for each template. Texts are matched to their lines' places by id and text hash.

    Defined cases: null text is empty, one empty line; blank lines always stay; rows that repeat
    an id count as one document and lose the same lines, each by its own text; a null id never
    loses lines. An empty table gives an empty result. Other columns are ignored.
    """
    texts = id_and_text(docs, id_col, text_col)
    every = written(parsed(texts.where("doc_id is not null"), depth), "lines")
    nodes = written(every.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_docs).select("node"), "nodes")
    candidates = written(every.join(nodes, "node", "left_semi"), "candidates")
    forget(every, nodes)
    general = written(templates(candidates, min_docs, depth), "templates")
    own = candidates.select("doc_id", "h", "i", "path").join(general, "path", "left").select("doc_id", "h", "i", F.coalesce("template", "path").alias("t"))
    recurring = own.select("doc_id", "t").distinct().groupBy("t").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_docs).select("t")
    drops = own.join(recurring, "t").groupBy("doc_id", "h").agg(F.collect_set("i").alias("drop"))
    drops = written(drops, "drops")
    kept = F.filter(lines(F.col("text")), lambda x, at: ~F.array_contains(F.col("drop"), at))
    out = texts.withColumn("h", F.xxhash64("text")).join(drops, ["doc_id", "h"], "left")
    return out.select("doc_id", F.size(lines(F.col("text"))).cast("long").alias("n_lines"), F.coalesce(F.size("drop"), F.lit(0)).cast("long").alias("n_dropped"), F.when(F.col("drop").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("text"))


def digest(cleaned: DataFrame) -> DataFrame:
    return cleaned.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))
