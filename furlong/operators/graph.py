"""Connected components by contraction along random light edges, and their upkeep as edges arrive."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.store import forget, written

#: Pointer doublings in a round: trees of up to 2 ** JUMPS steps collapse at once, deeper ones over more rounds.
JUMPS = 2


def _ordered(a: Column, b: Column) -> tuple[Column, Column]:
    return F.least(a, b).alias("a"), F.greatest(a, b).alias("b")


def _pointers(edges: DataFrame, turn: int) -> DataFrame:
    """Each vertex with the other end of its lightest edge: v, p; of two that choose each other, the smaller is its own."""
    weight = F.xxhash64("a", "b", F.lit(turn))
    both = edges.select("a", "b", weight.alias("w"))
    both = both.union(both.select("b", "a", "w"))
    pick = both.groupBy("a").agg(F.min(F.struct("w", "b")).alias("m")).select(F.col("a").alias("v"), F.col("m.b").alias("p"))
    back = pick.select(F.col("v").alias("p"), F.col("p").alias("q"))
    mutual = (F.col("q") == F.col("v")) & (F.col("v") < F.col("p"))
    return pick.join(back, "p").select("v", F.when(mutual, F.col("v")).otherwise(F.col("p")).alias("p"))


def connected_components(
    edges: DataFrame, keep: Callable[[DataFrame], DataFrame] = written, src: str = "src", dst: str = "dst"
) -> DataFrame:
    """Each vertex of the edges with the smallest vertex of its component: id, component.

    In a round every vertex points along its lightest edge, by weights drawn anew from a hash
    of the edge and the round. The pointers form trees of at least two vertices each, so a round
    leaves at most half of the vertices of any graph (a third of a path's, one of a star's),
    whatever the order of the ids. Pointers are doubled JUMPS times and the edges contracted.
    Random weights keep the trees shallow: their depth is logarithmic with high probability.

    Each round's map from vertices to the next round's is kept; at the end they are composed
    from the last, smallest one back to the first, so that the work is linear in the edges and
    vertices, not in vertices times rounds. `keep` writes tables to the shared folder and
    reads them back, so that neither lineage nor the size estimates of the plan grow; tables no
    longer read are emptied. Hot vertices meet in joins that adaptive execution may split.

    Loops and repeated edges are ignored; no edges give no rows; null ends are dropped.
    """
    ends = F.col(src).isNotNull() & F.col(dst).isNotNull() & (F.col(src) != F.col(dst))
    left = keep(edges.where(ends).select(*_ordered(F.col(src), F.col(dst))).distinct())
    if left.isEmpty():
        return left.select(F.col("a").alias("id"), F.col("b").alias("component"))
    maps = []
    while not left.isEmpty():
        step = keep(_pointers(left, len(maps)))
        first = step
        for _ in range(JUMPS):
            onward = step.select(F.col("v").alias("p"), F.col("p").alias("q"))
            step = step.join(onward, "p").select("v", F.col("q").alias("p"))
        maps.append(keep(step))
        a, b = (maps[-1].select(F.col("v").alias(x), F.col("p").alias(f"p{x}")) for x in "ab")
        moved = left.join(a, "a").join(b, "b").where(F.col("pa") != F.col("pb"))
        contracted = keep(moved.select(*_ordered(F.col("pa"), F.col("pb"))).distinct())
        forget(left, first)
        left = contracted
    root = maps[-1]
    for lower in reversed(maps[:-1]):
        onward = root.select(F.col("v").alias("p"), F.col("p").alias("q"))
        root = lower.join(onward, "p", "left").select("v", F.coalesce("q", "p").alias("p"))
    roots = keep(root)
    least = roots.groupBy("p").agg(F.min("v").alias("component"))
    out = keep(roots.join(least, "p").select(F.col("v").alias("id"), "component"))
    forget(roots, *maps)
    return out
