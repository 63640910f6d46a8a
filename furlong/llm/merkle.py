"""Merkle manifest: aligned builders append nodes in completion order; closed-form positions address the siblings of proofs."""

import hashlib
import zlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, released, written

#: Children of a node, and the levels that one builder completes: its block is FAN ** LEVELS aligned leaves.
FAN, LEVELS = 3, 6
#: Bytes of a digest in a log.
WIDTH = 32
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

PATH = "array<struct<left: string, right: string>>"
_PATH = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))


def leaf_hash(docs: DataFrame, fields=FIELDS, **instead: Column) -> Column:
    """Lowercase hex SHA-256 of a row's fields: each its UTF-8 byte count, ":" and value, or "-" if null; a missing one is null."""
    parts = []
    for name in fields:
        value = instead.get(name, F.col(name) if name in docs.columns else F.lit(None)).cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def node_hash(children: list[str]) -> str:
    return hashlib.sha256("".join(children).encode()).hexdigest()


def height(n: int) -> int:
    """Levels above n leaves."""
    h = 0
    while FAN**h < n:
        h += 1
    return h


def position(n: int, level: int, i: int) -> int:
    """Place of a node in the postorder of a tree of n leaves.

    A node is complete with its last leaf e, after the nodes below it that end there. Before
    leaf e stand e leaves and, of each level m, the e // FAN ** m nodes whose subtrees are full.
    """
    e = min((i + 1) * FAN**level, n) - 1
    before, m = e, FAN
    while m <= e:
        before += e // m
        m *= FAN
    return before + level


def append(leaves: list[str], levels: int) -> list[str]:
    """Digests of a block's nodes in order of completion; the last is the block's root after so many levels."""
    log, waiting = [], [[] for _ in range(levels + 1)]

    def complete(node: str, level: int) -> None:
        log.append(node)
        waiting[level].append(node)

    for leaf in leaves:
        complete(leaf, 0)
        for level in range(levels):
            if len(waiting[level]) < FAN:
                break
            node, waiting[level] = node_hash(waiting[level]), []
            complete(node, level + 1)
    for level in range(levels):  # runs that the block's end cuts short
        if waiting[level]:
            complete(node_hash(waiting[level]), level + 1)
    return log


def siblings(log: list[str], n: int, levels: int, i: int) -> list[dict]:
    """For each level, the digests left and right of the node above leaf i in its run."""
    out, size = [], n
    for level in range(levels):
        first = i - i % FAN
        near = [log[position(n, level, j)] for j in range(first, min(first + FAN, size))]
        out.append({"left": "".join(near[: i - first]), "right": "".join(near[i - first + 1 :])})
        i, size = i // FAN, -(-size // FAN)
    return out


def _numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """Rows with their place i in their tree and its number n of leaves; ranges spread a tree of any size over tasks."""
    spark = rows.sparkSession
    ranged = rows.repartitionByRange(partitions(spark), "tree", *order).sortWithinPartitions("tree", *order)
    # the id is the partition's number and the row's place in it, and fixed once it is written
    ranged = written(ranged.withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.shiftrightunsigned("at", 33)), "leaves")
    counts = ranged.groupBy("tree", "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("rows"))
    # a tree has a row for each partition that it reaches
    tree = Window.partitionBy("tree").orderBy("part")
    before = F.sum("rows").over(tree.rowsBetween(Window.unboundedPreceding, -1))
    total = F.sum("rows").over(tree.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    shifts = counts.select("tree", "part", (F.col("first") - F.coalesce(before, F.lit(0))).alias("shift"), total.alias("n"))
    return ranged.join(shifts, ["tree", "part"]).withColumn("i", F.col("at") - F.col("shift")).drop("at", "part", "shift")


def _append(tier: int, levels: int):
    """Blocks of leaves -> their part of the log: digests in completion order."""

    def run(batches):
        for batch in batches:
            leaves, counts = batch.column("leaves"), batch.column("n").to_pylist()
            logs = []
            for n, own in zip(counts, leaves.to_pylist()):
                done = append([x.hex() for x in own], min(levels, height(n) - tier * levels))
                logs.append(bytes.fromhex("".join(done)))
            columns = [batch.column(c) for c in ("tree", "n", "block", "carried")]
            schema = pa.schema([*(pa.field(c, x.type) for c, x in zip(("tree", "n", "block", "carried"), columns)), ("nodes", pa.binary())])
            yield pa.RecordBatch.from_arrays([*columns, pa.array(logs, pa.binary())], schema=schema)

    return released(run)


def build(rows: DataFrame, order: list[str], carry: list[str], levels: int = LEVELS) -> list[DataFrame]:
    """The postorder logs of all trees, a table for each tier of builders: tree, n, block, carried, nodes.

    rows: tree, leaf (binary digest), the columns of `order`, in which a tree's leaves stand,
    and those of `carry`, which go with the leaves. A builder gets an aligned block of FAN **
    levels leaves, a bounded group however large the tree, and completes its levels; the roots
    of blocks are the leaves of the next tier. Few tiers hold any tree: three at 10^8 leaves.
    """
    leaf = F.struct(F.col("i"), F.col("leaf"), F.struct(*carry).alias("carried"))
    todo, tiers = _numbered(rows, order), []
    while True:
        tier, span = len(tiers), FAN ** (levels * (len(tiers) + 1))
        block = F.expr(f"i div {FAN**levels}").alias("block")
        grouped = todo.groupBy("tree", "n", block).agg(F.array_sort(F.collect_list(leaf)).alias("x"))
        ready = grouped.select("tree", "n", "block", F.col("x.carried").alias("carried"), F.col("x.leaf").alias("leaves"))
        kinds = ", ".join(f"{c} {t}" for c, t in ready.dtypes if c != "leaves")
        tiers.append(written(ready.mapInArrow(_append(tier, levels), f"{kinds}, nodes binary"), f"log{tier}"))
        above = tiers[-1].where(F.col("n") > span)
        if above.isEmpty():
            return tiers
        todo = above.select("tree", "n", F.col("block").alias("i"), F.expr(f"substring(nodes, -{WIDTH}, {WIDTH})").alias("leaf"), "block")
        carry = ["block"]
        leaf = F.struct(F.col("i"), F.col("leaf"), F.struct(*carry).alias("carried"))


def _last(log: DataFrame, tier: int, levels: int) -> DataFrame:
    """The blocks of a tier that hold the root of their tree."""
    return log.where((F.col("n") <= FAN ** (levels * (tier + 1))) & (F.col("n") > (FAN ** (levels * tier) if tier else 0)))


def roots(tiers: list[DataFrame], levels: int = LEVELS) -> DataFrame:
    """tree and its root (binary): the last node that its last builder completed."""
    out = None
    for tier, log in enumerate(tiers):
        last = _last(log, tier, levels).select("tree", F.expr(f"substring(nodes, -{WIDTH}, {WIDTH})").alias("root"))
        out = last if out is None else out.union(last)
    return out


def _extract(tier: int, levels: int):
    """Blocks with the path above them -> a row for each leaf: tree, carried, top, place in the postorder, path."""

    def run(batches):
        for batch in batches:
            carried, at = batch.column("carried"), 0
            flat = carried.flatten()
            for r in range(batch.num_rows):
                n, block, nodes, above = (batch.column(c)[r].as_py() for c in ("n", "block", "nodes", "path"))
                text, size = nodes.hex(), len(carried[r])
                log = [text[k : k + 2 * WIDTH] for k in range(0, len(text), 2 * WIDTH)]
                own = min(levels, height(n) - tier * levels)
                paths = [siblings(log, size, own, i) + above for i in range(size)]
                first = block * FAN**levels
                places = [position(n, 0, first + i) if tier == 0 else None for i in range(size)]
                trees, top = (c.take(pa.array([r] * size, pa.int32())) for c in (batch.column("tree"), batch.column("top")))
                columns = [trees, flat.slice(at, size), top, pa.array(places, pa.int64()), pa.array(paths, _PATH)]
                yield pa.RecordBatch.from_arrays(columns, names=["tree", "carried", "top", "position", "path"])
                at += size

    return released(run)


def paths(tiers: list[DataFrame], tops: DataFrame, levels: int = LEVELS) -> DataFrame:
    """Every leaf of the logs: tree, carried, top, position, path (siblings from the leaf up).

    tops: tree, top (a struct that all leaves of the tree get) and path (what lies above its
    root). From the last tier down, each block gets the path above it, so one row for each
    block moves, and not one for each leaf.
    """
    down = None
    for tier in reversed(range(len(tiers))):
        log = tiers[tier]
        ready = _last(log, tier, levels).join(tops, "tree").select("tree", "n", "block", "carried", "nodes", "top", "path")
        if down is not None:
            above = down.select("tree", F.col("carried.block").alias("block"), "top", "path")
            ready = ready.union(log.join(above, ["tree", "block"]).select(*ready.columns))
        kinds = dict(ready.dtypes)
        schema = f"tree {kinds['tree']}, carried {kinds['carried'][6:-1]}, top {kinds['top']}, position bigint, path {PATH}"
        down = ready.mapInArrow(_extract(tier, levels), schema)
    return down


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path lead to, as hex."""
    return F.aggregate(path, leaf, lambda acc, p: F.sha2(F.concat(p["left"], acc, p["right"]), 256))


@dataclass
class Manifest:
    """Logs of the sources' trees and of the tree over their roots."""

    sources: list[DataFrame]
    top: list[DataFrame]
    levels: int = LEVELS

    def subroots(self) -> DataFrame:
        """source, subroot."""
        key = F.expr("case when tree != '' then substring(tree, 2) end").alias("source")
        return roots(self.sources, self.levels).select(key, F.lower(F.hex("root")).alias("subroot"))

    def root(self) -> DataFrame:
        """One row, root; none if there are no rows at all."""
        return roots(self.top, self.levels).select(F.lower(F.hex("root")).alias("root"))

    def proofs(self) -> DataFrame:
        """Every row: source, what it carries, position (in its source's log), subroot, root, path."""
        none = F.expr(f"cast(array() as {PATH})").alias("path")
        root = F.lower(F.hex("root"))
        tops = roots(self.top, self.levels).select("tree", F.struct(root.alias("root")).alias("top"), none)
        own = paths(self.top, tops, self.levels).select(F.col("carried.key").alias("tree"), F.col("top.root").alias("root"), "path")
        subroots = roots(self.sources, self.levels).select("tree", root.alias("subroot"))
        tops = own.join(subroots, "tree").select("tree", F.struct("subroot", "root").alias("top"), "path")
        key = F.expr("case when tree != '' then substring(tree, 2) end").alias("source")
        return paths(self.sources, tops, self.levels).select(key, "carried.*", "position", "top.*", "path")


def manifest(docs: DataFrame, carry: dict[str, Column] | None = None, levels: int = LEVELS) -> Manifest:
    """Merkle trees over documents: one for each source, and one over the sources' roots.

    Leaves are the hashes of whole rows (leaf_hash), in ascending doc_id within their source;
    sources are in UTF-8 byte order, null first. Every FAN consecutive nodes become one. doc_id,
    leaf (binary) and the columns of `carry` stay with each leaf in the log. Texts are read and
    hashed once; only digests travel on.

    Defined cases: a null doc_id comes first in its source; rows of one doc_id are ordered by
    their hash, so equal rows are leaves side by side; null and empty source are two sources; a
    lone row is its own subroot, a lone subroot the root; an empty table has no root and no
    proofs. Missing columns count as null, further ones are ignored.
    """
    extra = {f"carried_{k}": v for k, v in (carry or {}).items()}
    source = F.col("source").cast("string") if "source" in docs.columns else F.lit(None).cast("string")
    tree = F.coalesce(F.concat(F.lit("="), source), F.lit(""))
    leaf = F.unhex(leaf_hash(docs))
    rows = docs.select(tree.alias("tree"), F.col("doc_id").cast("long").alias("doc_id"), leaf.alias("leaf"), *(v.alias(k) for k, v in extra.items()))
    rows = written(rows, "hashes").withColumn("own", F.col("leaf"))
    names = ["doc_id", "own", *extra]
    sources = build(rows, ["doc_id", "leaf"], names, levels)
    over = written(roots(sources, levels).select(F.lit("").alias("tree"), F.col("tree").alias("key"), F.col("root").alias("leaf")), "subroots")
    return Manifest(sources, build(over, ["key"], ["key"], levels), levels)


def tampered_leaf(docs: DataFrame) -> Column:
    """The leaf of a row of which someone took the newlines; null where crc32 of the decimal doc_id is odd, or there is none."""
    text = F.regexp_replace("text", "\n", "")
    return F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.unhex(leaf_hash(docs, text=text)))


def digest(proofs: DataFrame) -> DataFrame:
    """The contract's columns from proofs that carry the tampered leaf."""
    hexed = lambda c: F.lower(F.hex(c))
    parts = F.array_join(F.transform("path", lambda p: F.concat(p["left"], p["right"])), "")
    folded = fold(F.coalesce(hexed("carried_tampered"), hexed("own")), F.col("path"))
    out = proofs.select("doc_id", "source", hexed("own").alias("leaf"), "subroot", "root", F.sha2(parts, 256).alias("proof_sha256"), folded.alias("folded_root"), "position")
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def brute(rows: list[tuple]) -> list[tuple]:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) by whole levels, from (doc_id, source, lang, n_chars, text), for tests."""
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    part = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r: sha("".join(map(part, r)))

    def tree(leaves):
        levels = [leaves]
        while len(levels[-1]) > 1:
            levels.append([sha("".join(levels[-1][k : k + 3])) for k in range(0, len(levels[-1]), 3)])
        return levels

    def near(levels, i):
        out = []
        for level in levels[:-1]:
            first = i // 3 * 3
            out.append(("".join(level[first:i]), "".join(level[i + 1 : first + 3])))
            i //= 3
        return out

    by: dict = {}
    for r in rows:
        by.setdefault(r[1], []).append(r)
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    for s in order:
        by[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    trees = {s: tree([leaf(r) for r in by[s]]) for s in order}
    top, out = tree([trees[s][-1][0] for s in order]), []
    for k, s in enumerate(order):
        for i, r in enumerate(by[s]):
            path = near(trees[s], i) + near(top, k)
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
            acc = leaf((*r[:4], r[4].replace("\n", "") if hit and r[4] is not None else r[4]))
            for left, right in path:
                acc = sha(left + acc + right)
            root = top[-1][0]
            out.append((r[0], leaf(r), trees[s][-1][0], root, sha("".join(a + b for a, b in path)), acc, acc == root))
    return out
