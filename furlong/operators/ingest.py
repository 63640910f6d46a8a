"""Sources, sinks and versioned ingest."""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def write_observations(df: DataFrame, path: str, fmt: str = "json") -> None:
    """Gzip JSON lines or Parquet."""
    (df.write.json(path, compression="gzip") if fmt == "json" else df.write.parquet(path))


def read_observations(spark: SparkSession, path: str, schema, fmt: str = "json") -> DataFrame:
    return spark.read.schema(schema).format(fmt).load(path)


def write_sample(df: DataFrame, path: str, n: int, *keys: str) -> None:
    """The first n rows in key order as CSV with a header."""
    df.orderBy(*keys).limit(n).write.csv(path, header=True)


def payload_hash(columns: list[str]) -> Column:
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)


def scd2_append(current: DataFrame | None, incoming: DataFrame, keys: list[str], payload: list[str], order: str) -> DataFrame:
    """Merge a batch into an append-only table of versions.

    A payload equal to the one before (of the batch, or the table's current one) is skipped;
    any other closes the current version and opens the next. Several changes of a key in one
    batch become several versions, in `order`. One shuffle by key; returns the whole table.
    """
    new = incoming.select(*keys, *payload, order, payload_hash(payload).alias("hash"), F.lit(None).cast("int").alias("version"))
    old = new.where("false") if current is None else current.select(*keys, *payload, order, "hash", "version")
    w = Window.partitionBy(*keys).orderBy(F.col("version").isNull(), "version", order, "hash")
    rows = old.unionByName(new)
    changed = F.col("version").isNotNull() | ~F.col("hash").eqNullSafe(F.lag("hash").over(w))
    kept = rows.withColumn("changed", changed).where("changed").drop("changed")
    numbered = kept.withColumn("version", F.row_number().over(w))
    return numbered.withColumn("is_current", F.col("version") == F.max("version").over(Window.partitionBy(*keys)))


def current_rows(df: DataFrame) -> DataFrame:
    return df.where("is_current")


def latest_by(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The newest row of each key; the struct of order columns ends in a unique id."""
    return df.groupBy(*keys).agg(F.max(F.struct(*order, *[c for c in df.columns if c not in (*keys, *order)])).alias("r")).select(*keys, "r.*")


def dimension(rows: DataFrame, name: str, id_col: str) -> DataFrame:
    """Distinct trimmed non-empty names with ids; the id is a hash, so it needs no global order."""
    n = F.trim(name)
    return rows.select(n.alias("name")).where("name != ''").distinct().select(F.xxhash64("name").alias(id_col), "name")


def build_warehouse(results: DataFrame, people: dict[str, str]) -> dict[str, DataFrame]:
    """Dimensions of the named people, and the facts with their ids."""
    out, facts = {}, results
    for role, column in people.items():
        out[role] = dimension(results, column, f"{role}_id")
        facts = facts.withColumn(f"{role}_id", F.when(F.trim(column) != "", F.xxhash64(F.trim(column)))).drop(column)
    return out | {"results": facts}


MEDIA = "array<struct<url:string,kind:string>>"


def explode_media(races: DataFrame, column: str = "media") -> DataFrame:
    """Nested media list as rows; entries without a URL go, repeated URLs of a race count once."""
    m = races.select("race_id", F.explode(F.from_json(column, MEDIA)).alias("m")).select("race_id", "m.*")
    return m.where("url is not null").groupBy("race_id", "url").agg(F.min("kind").alias("kind"))


def page_links(pages: DataFrame, pattern: str = "") -> DataFrame:
    """All links of pages that match a pattern: absolute, without fragment, each once."""
    href = F.explode(F.regexp_extract_all("html", F.lit(r'href="([^"#]*)(?:#[^"]*)?"'), F.lit(1)))
    links = pages.select("page_id", F.regexp_extract("url", r"^(https?://[^/?#]+)", 1).alias("host"), href.alias("href")).where("href != ''")
    absolute = F.when(F.col("href").rlike("^https?://"), F.col("href")).otherwise(F.concat("host", F.when(F.col("href").startswith("/"), "").otherwise("/"), F.col("href")))
    return links.select("page_id", absolute.alias("link")).where(F.col("link").rlike(pattern)).distinct()


def balanced(text: str, start: int) -> str | None:
    """The {} or [] that begins at start, strings and escapes respected."""
    depth, quoted, i = 0, False, start
    while i < len(text):
        ch = text[i]
        if quoted:
            if ch == "\\":
                i += 1
            elif ch == '"':
                quoted = False
        elif ch == '"':
            quoted = True
        elif ch in "{[":
            depth += 1
        elif ch in "}]":
            depth -= 1
            if not depth:
                return text[start : i + 1]
        i += 1
    return None


def page_json(pages: DataFrame, marker: str, schema: str) -> DataFrame:
    """JSON embedded in pages after a marker, parsed by the schema; the scan is Python, the parsing isn't."""

    def run(frames):
        for f in frames:
            found = []
            for html in f["html"].fillna(""):
                html = html.replace('\\"', '"') if marker not in html else html
                at = html.find(marker)
                starts = [i for i in (html.find("{", at + len(marker)), html.find("[", at + len(marker))) if at >= 0 and i >= 0]
                found.append(balanced(html, min(starts)) if starts else None)
            f = f[["page_id"]].copy()
            f["text"] = found
            yield f

    return pages.select("page_id", "html").mapInPandas(run, "page_id long, text string").where("text is not null").select("page_id", F.from_json("text", schema).alias("data"))


def market_entries(cards: DataFrame) -> dict[str, DataFrame]:
    """Snapshots of cards as events and entries: latest card per key, nested races and runners exploded."""
    card = latest_by(cards, ["source_key"], "captured_at", "event_id")
    schema = "struct<races:array<struct<id:long,number:int,race_horses:array<struct<cloth:int,horse_id:long,odds:double>>>>>"
    races = card.select("source_key", F.explode_outer(F.from_json("payload", schema)["races"]).alias("r")).select("source_key", F.col("r.id").alias("race_id"), "r.number", "r.race_horses")
    return {"events": races.select("source_key", "race_id", "number"), "entries": races.select("race_id", F.explode("race_horses").alias("h")).select("race_id", "h.*")}


ODDS = "map<string,map<string,struct<runnerId:int,odd:double>>>"


def pick_odds(df: DataFrame, column: str, key: str) -> DataFrame:
    """Odds of the best market in a payload: win before place before most runners, then the name; two odds at least."""
    m = df.select(key, F.explode(F.from_json(column, ODDS)).alias("market", "odds"))
    o = m.select(key, "market", F.explode(F.map_values("odds")).alias("o")).where(F.col("o.odd") > 0)
    prefer = F.when(F.lower("market").rlike("pish|win"), 2).when(F.lower("market").rlike("miyan|place"), 1).otherwise(0)
    g = o.groupBy(key, "market").agg(F.collect_list("o").alias("odds"), F.count("*").alias("n")).where("n >= 2")
    best = g.groupBy(key).agg(F.min(F.struct((-prefer).alias("p"), (-F.col("n")).alias("n"), "market", "odds")).alias("b"))
    return best.select(key, "b.market", F.explode("b.odds").alias("o")).select(key, "market", F.col("o.runnerId").alias("cloth"), F.col("o.odd").alias("odds"))


def pick_survey(df: DataFrame, column: str, key: str) -> DataFrame:
    """Votes per cloth from a survey payload, whatever its field names."""
    schema = "array<struct<horse_num:int,number:int,cloth:int,runnerId:int,count:double,votes:double,amount:double>>"
    e = df.select(key, F.explode(F.from_json(column, schema)).alias("s"))
    return e.select(key, F.coalesce("s.horse_num", "s.number", "s.cloth", "s.runnerId").alias("cloth"), F.coalesce("s.count", "s.votes", "s.amount").alias("votes")).where("cloth is not null")


def fingerprint(df: DataFrame) -> DataFrame:
    """One row: rows and two order-insensitive sums of row hashes."""
    h = F.xxhash64(*sorted(df.columns))
    return df.agg(F.count("*").alias("rows"), F.bit_xor(h).alias("xor"), F.sum(F.pmod(h, F.lit(1 << 31))).alias("total"))


def freeze(obs: DataFrame, version: str) -> dict:
    """Manifest of a dataset: version, fingerprint, counts and date range."""
    row = fingerprint(obs).crossJoin(obs.agg(F.countDistinct("race_id").alias("races"), F.countDistinct("horse_id").alias("horses"), F.min("race_date").cast("string").alias("first"), F.max("race_date").cast("string").alias("last"))).first()
    return {"version": version, **row.asDict()}


def assert_frozen(obs: DataFrame, manifest: dict) -> None:
    """Refuse a dataset that differs from its manifest."""
    now = freeze(obs, manifest["version"])
    if now != manifest:
        raise ValueError(f"dataset differs from its manifest: {sorted(k for k in now if now[k] != manifest.get(k))}")
