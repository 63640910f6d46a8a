"""Conversation structure repair: iterative-deepening A* over edits of a conversation's rows."""

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import partitions

#: Costs of edits, and of a truncated row that is not deleted. Fixed values.
DELETE, INSERT, KEEP, REROLE, TRUNCATED = 4, 3, 0, 3, 3
#: Initials of the edits, in the order in which they are tried. Fixed values.
EDITS = "DIKR"
ROLES = ("user", "assistant")

#: A row as the search sees it: the role's initial, and faults that are added to it.
OTHER, SYSTEM, USER, ASSISTANT = range(4)
CUT, DEAD = 4, 8

#: States of `(s?(ua)+)?`: at the start, after s, after a pair, after a user. A row or insert of that kind leads on, or nowhere (-1).
START, OPENED, PAIRED, ASKED = range(4)
NEXT = {SYSTEM: (OPENED, -1, -1, -1), USER: (ASKED, ASKED, ASKED, -1), ASSISTANT: (-1, -1, -1, PAIRED), OTHER: (-1, -1, -1, -1)}
ACCEPTING = (START, PAIRED)
#: What a rerole or an insert can bring in each state, the only one that leads on.
WANTED = tuple(ASSISTANT if q == ASKED else USER for q in range(4))

SPACES = r"\x20\x09-\x0D"
FAR = 1 << 60


def bounds(rows: list[int]) -> list[tuple[int, int, int, int]]:
    """For each row and state, the least cost of the rest if a conversation might end in any state.

    That is a relaxation of the task, so the bound never exceeds the true cost; and since
    dropping the end's condition saves two inserts at most, few deepenings reach the answer.
    One pass from the end, whose memory and time are linear in the rows.
    """
    out = [(0, 0, 0, 0)]
    for code in reversed(rows):
        after = out[-1]
        cut, kind = TRUNCATED if code & CUT else 0, code & 3
        here = []
        for q in range(4):
            best = DELETE + after[q]
            if not code & DEAD:
                if (to := NEXT[kind][q]) >= 0:
                    best = min(best, KEEP + cut + after[to])
                best = min(best, REROLE + cut + after[NEXT[WANTED[q]][q]])
            here.append(best)
        # an insert before the row; two in a row lead back to where one was, so one step is enough
        out.append(tuple(min(here[q], INSERT + here[NEXT[WANTED[q]][q]]) for q in range(4)))
    out.reverse()
    return out


def search(rows: list[int]) -> tuple[int, str]:
    """The least cost and, of the cheapest edit strings, the first in ASCII order.

    Depth-first search tries D, I, K, R in turn wherever the cost so far and the bound of the
    rest stay within the limit; the first path to an accepting state at the end is the answer.
    If there is none, the limit rises to the least sum beyond it. The transposition table
    holds, for each row and state, the largest remainder of a limit with which no path was
    found; it stays valid in later deepenings. The stack is explicit, so length is no matter.
    """
    n, rest = len(rows), bounds(rows)
    failed: list = [[-1] * 4 for _ in range(n + 1)]
    limit = rest[0][START]
    while True:
        beyond = FAR
        # one entry for each node of the path: row, state, cost so far, next edit to try
        path, trail = [[0, START, 0, 0]], []
        while path:
            i, q, cost, edit = node = path[-1]
            if edit == 0:
                if i == n and q in ACCEPTING:
                    return cost, "".join(EDITS[k] for k in trail)
                if failed[i][q] >= limit - cost:
                    node[3] = edit = len(EDITS)
            step = None
            while edit < len(EDITS) and step is None:
                if edit == 1:
                    step = i, NEXT[WANTED[q]][q], cost + INSERT
                elif i < n and edit == 0:
                    step = i + 1, q, cost + DELETE
                elif i < n and not rows[i] & DEAD:
                    to = NEXT[rows[i] & 3 if edit == 2 else WANTED[q]][q]
                    if to >= 0:
                        step = i + 1, to, cost + (KEEP if edit == 2 else REROLE) + (TRUNCATED if rows[i] & CUT else 0)
                if step is not None and (total := step[2] + rest[step[0]][step[1]]) > limit:
                    beyond, step = min(beyond, total), None
                edit += 1
            node[3] = edit
            if step is None:
                failed[i][q] = max(failed[i][q], limit - cost)
                path.pop()
                if trail:
                    trail.pop()
            else:
                trail.append(edit - 1)
                path.append([*step, 0])
        limit = beyond


def outcome(rows: list[int], audit: str) -> tuple[list[int], list[str | None]]:
    """Of each row of the repaired conversation, the row it comes from (-1: inserted) and its new role, if that changes."""
    origin, roles, i, q = [], [], 0, START
    for edit in audit:
        if edit != "D":
            kind = rows[i] & 3 if edit == "K" else WANTED[q]
            origin.append(-1 if edit == "I" else i)
            roles.append(None if edit == "K" else ROLES[kind == ASSISTANT])
            q = NEXT[kind][q]
        i += edit != "I"
    return origin, roles


_FOUND = (
    T.StructType().add("cost", T.LongType()).add("audit", T.StringType())
    .add("origin", T.ArrayType(T.IntegerType())).add("roles", T.ArrayType(T.StringType()))
)


@F.arrow_udf(_FOUND)
def _repairs(codes: pa.Array) -> pa.Array:
    found = []
    for rows in codes.to_pylist():
        cost, audit = search(rows)
        origin, roles = outcome(rows, audit)
        found.append({"cost": cost, "audit": audit, "origin": origin, "roles": roles})
    kinds = [("cost", pa.int64()), ("audit", pa.string()), ("origin", pa.list_(pa.int32())), ("roles", pa.list_(pa.string()))]
    return pa.array(found, pa.struct(kinds))


def plain(turns: DataFrame) -> DataFrame:
    """The four columns under fixed types; null role or text reads as one space."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    return turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), text("role"), text("text"))


def repair(turns: DataFrame) -> DataFrame:
    """Each conversation's faults and its cheapest repair: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired.

    A conversation is its rows by turn (null first), role and text. Of each row the first
    fault counts: blank (nothing but ASCII white space), duplicate (a row of that role and text
    came before), truncated (its last other character is none of .!?). gaps counts the turns
    missing between the first and the last, illegal the neighbours whose roles' initials are
    none of su, ua, au. `repaired` (role, text) has roles of the form `(s?(ua)+)?`, by the
    cheapest edits; `audit` lists their initials, `cost` is their sum.

    One exchange by conv_id serves the window that finds duplicates and the gathering. Only a
    byte for each row reaches the search; texts stay in the JVM. A conversation is one output
    row, so its size bounds what one task holds; the search is linear in its rows.

    Defined cases: null role or text is one space, and such a row is blank if the text is; an
    empty role or a role of another initial can only be reroled or deleted; equal rows of one turn
    are one and its duplicate; rows of null conv_id make one conversation; an empty table gives
    none. Other columns are ignored.
    """
    own = plain(turns).repartition(partitions(turns.sparkSession), "conv_id")
    again = F.row_number().over(Window.partitionBy("conv_id", "role", "text").orderBy(F.asc_nulls_first("turn"))) > 1
    last = F.regexp_extract("text", rf"([^{SPACES}])[{SPACES}]*\z", 1)
    fault = F.when(last == "", "blank").when(F.col("again"), "duplicate").when(~last.isin(".", "!", "?"), "truncated")
    rows = own.withColumn("again", again).withColumn("fault", fault)
    g = rows.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("turn", "role", "text", "again", "fault"))).alias("rows"),
        *(F.count_if(F.col("fault") == c).alias(c) for c in ("blank", "duplicate", "truncated")),
    )
    initial = lambda r: F.substring(r["role"], 1, 1)
    pairs = F.zip_with("rows", F.slice("rows", 2, F.size("rows")), lambda a, b: F.concat(initial(a), initial(b)))
    # the last row has no neighbour, so its pair is null and fails the test
    illegal = F.size(F.filter(pairs, lambda p: ~p.isin("su", "ua", "au"))).cast("long")
    kind = lambda r: F.when(initial(r) == "s", SYSTEM).when(initial(r) == "u", USER).when(initial(r) == "a", ASSISTANT).otherwise(OTHER)
    extra = lambda r: F.when(r["fault"].isin("blank", "duplicate"), DEAD).when(r["fault"] == "truncated", CUT).otherwise(0)
    g = g.withColumn("found", _repairs(F.transform("rows", lambda r: (kind(r) + extra(r)).cast("int"))))
    origin = lambda k: F.get("rows", k)
    repaired = F.zip_with(
        "found.origin", "found.roles",
        lambda k, r: F.struct(F.coalesce(r, origin(k)["role"]).alias("role"), F.when(k < 0, "").otherwise(origin(k)["text"]).alias("text")),
    )
    turns_of = F.transform(F.filter("rows", lambda r: r["turn"].isNotNull()), lambda r: r["turn"])
    gaps = F.array_max("turns") - F.array_min("turns") + 1 - F.size(F.array_distinct("turns"))
    counts = ("blank", "duplicate", "truncated")
    g = g.withColumn("turns", turns_of)
    return g.select("conv_id", F.coalesce(gaps, F.lit(0)).alias("gaps"), *counts, illegal.alias("illegal"), "found.cost", "found.audit", repaired.alias("repaired"))


def damage(turns: DataFrame) -> DataFrame:
    """Rows by crc32(`conv_id:turn`) % 20: 0 gone, 1 without text, 2 without .!?, 3 twice, 4 as user; nulls are one space."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = plain(turns).withColumn("kind", F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn"))) % 20).where("kind != 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    times = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), times.alias("time")).drop("time")


def digest(turns: DataFrame, repaired: DataFrame) -> DataFrame:
    """The contract's columns for every conv_id of the rows before damage."""
    lines = F.array_join(F.transform("repaired", lambda r: F.concat(r["role"], F.lit(":"), r["text"])), "\n")
    sums = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    sha = F.sha2(F.coalesce(lines, F.lit("")), 256).alias("repaired_sha256")
    ids = turns.select(F.col("conv_id").cast("long").alias("id")).distinct()
    out = ids.join(repaired, F.col("id").eqNullSafe(F.col("conv_id")), "left")
    return out.select(F.col("id").alias("conv_id"), *sums, F.coalesce("audit", F.lit("")).alias("audit"), sha)
