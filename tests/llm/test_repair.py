import hashlib
import itertools
import random
import re
import time
import zlib

from pyspark.sql import functions as F

from furlong.llm import repair

TURNS = "conv_id long, turn long, role string, text string"
SPACE = " \t\n\v\f\r"
FORM = re.compile("(s?(ua)+)?")


def faults(rows):
    """Codes of (role, text) rows in order, and their faults."""
    codes, names, seen = [], [], set()
    for role, text in rows:
        shown = text.strip(SPACE)
        name = "blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else None
        seen.add((role, text))
        kind = {"s": repair.SYSTEM, "u": repair.USER, "a": repair.ASSISTANT}.get(role[:1], repair.OTHER)
        codes.append(kind + (repair.DEAD if name in ("blank", "duplicate") else repair.CUT if name else 0))
        names.append(name)
    return codes, names


def every_repair(codes, inserts=2):
    """The least (cost, audit) of all edit strings with so many inserts at most before each row and at the end."""
    best = None
    choice = [["D"] if c & repair.DEAD else ["D", "K", "Ru", "Ra"] for c in codes]
    gaps = [p for k in range(inserts + 1) for p in itertools.product("ua", repeat=k)]
    for rows in itertools.product(*choice):
        for added in itertools.product(gaps, repeat=len(codes) + 1):
            roles, audit, cost = "", "", 0
            for k, own in enumerate([*rows, ""]):
                roles += "".join(added[k])
                audit += "I" * len(added[k])
                cost += 3 * len(added[k])
                if own:
                    audit += own[0]
                    cost += {"D": 4, "K": 0, "R": 3}[own[0]] + (3 if own != "D" and codes[k] & repair.CUT else 0)
                    roles += "" if own == "D" else own[1] if own[0] == "R" else "xsua"[codes[k] & 3]
            if FORM.fullmatch(roles) and (best is None or (cost, audit) < best):
                best = cost, audit
    return best


def forward(codes):
    """The same by dynamic programming, for long conversations."""
    states = {repair.START: (0, "")}

    def inserted(states):
        out = dict(states)
        for q, (c, a) in states.items():
            to = repair.NEXT[repair.WANTED[q]][q]
            out[to] = min(out.get(to, (repair.FAR, "")), (c + 3, a + "I"))
        return out

    for code in codes:
        after = {}
        for q, (c, a) in inserted(states).items():
            steps = [(q, 4, "D")]
            if not code & repair.DEAD:
                steps += [(repair.NEXT[code & 3][q], 0, "K"), (repair.NEXT[repair.WANTED[q]][q], 3, "R")]
            for to, cost, edit in steps:
                if to >= 0:
                    cost += 3 if edit != "D" and code & repair.CUT else 0
                    after[to] = min(after.get(to, (repair.FAR, "")), (c + cost, a + edit))
        states = after
    return min(v for q, v in inserted(states).items() if q in repair.ACCEPTING)


def test_search_equals_enumeration():
    kinds = [k + extra for k in range(4) for extra in (0, repair.CUT, repair.DEAD)]
    for n in range(3):
        for codes in itertools.product(kinds, repeat=n):
            assert repair.search(list(codes)) == every_repair(codes)
    rng = random.Random(1)
    for _ in range(20):
        codes = [rng.choice(kinds) for _ in range(3)]
        assert repair.search(codes) == every_repair(codes, 1)


def test_search_equals_dynamic_programming_and_is_linear():
    rng = random.Random(2)
    for n in (5, 9, 30, 200):
        for weights in ((1, 1, 5, 5), (0, 9, 1, 1), (0, 0, 1, 0), (3, 3, 1, 1)):
            for _ in range(10):
                codes = [rng.choices(range(4), weights)[0] + rng.choice((0, 0, 0, repair.CUT, repair.DEAD)) for _ in range(n)]
                assert repair.search(codes) == forward(codes)
    began = time.time()
    cost, audit = repair.search([rng.choice((repair.SYSTEM, repair.USER, repair.ASSISTANT + repair.CUT)) for _ in range(60_000)])
    assert len(audit) >= 60_000 and time.time() - began < 20


def brute(rows):
    """conv_id -> contract columns of (conv_id, turn, role, text) rows, damage included."""
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    show = lambda v: " " if v is None else str(v)
    by = {r[0]: [] for r in rows}
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{show(conv)}:{show(turn)}".encode()) % 20
        role, text = show(role), show(text)
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            by[conv] += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    out = {}
    for conv, own in by.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        codes, names = faults([r[1:] for r in own])
        turns = [r[0] for r in own if r[0] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        cost, audit = forward(codes)
        roles, lines, rest = "", [], iter(own)
        for edit in audit:
            row = next(rest) if edit != "I" else (None, None, "")
            if edit != "D":
                role = row[1] if edit == "K" else "assistant" if roles[-1:] == "u" else "user"
                roles += role[0]
                lines.append(f"{role}:{row[2]}")
        assert FORM.fullmatch(roles)
        count = lambda x: sum(v == x for v in names)
        out[conv] = (gaps, count("blank"), count("duplicate"), count("truncated"), illegal, cost, audit, sha("\n".join(lines)))
    return out


def got(df):
    out = repair.digest(df, repair.repair(repair.damage(df)))
    return {r["conv_id"]: tuple(r[c] for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")) for r in out.collect()}


def conversations(seed=5):
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "cut", "more?  \n", "", " \t", None, "é ü.", "a.b", "Yes."]
    rows = []
    for conv in range(120):
        for turn in range(rng.choice((1, 2, 5, 12, 40))):
            role = rng.choice(["user", "assistant"] * 4 + ["system", None, "", "User", "tool", "usr"])
            at = rng.choice([turn] * 9 + [None, turn + 3, 0])
            rows.append((conv, at, role, rng.choice(texts)))
    rows += [(None, 1, "user", "A."), (None, None, "assistant", "B."), (500, None, None, None), (-3, 2**40, "user", "far."), (-3, 0, "user", "near.")]
    rows += [(600, k, ("user", "assistant")[k % 2], f"{k}.") for k in range(700)] + [(601, 0, "user", "long " * 200_000 + "end.")]
    rng.shuffle(rows)
    return rows


def test_repair_equals_brute_force(spark):
    rows = conversations()
    want = brute(rows)
    assert got(spark.createDataFrame(rows, TURNS)) == want
    edits = "".join(v[6] for v in want.values())
    assert set(edits) == set("DIKR") and any(v[6] == "" for v in want.values())


def test_conversation_that_loses_all_rows_is_returned(spark):
    conv = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    df = spark.createDataFrame([(conv, 0, "user", "Hi.")], TURNS)
    assert got(df) == {conv: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_no_rows_and_clashing_columns(spark):
    assert got(spark.createDataFrame([], TURNS)) == {}
    rows = conversations()[:60]
    names = ("rows", "again", "fault", "found", "turns", "kind", "time", "id", "cost", "audit", "repaired")
    odd = spark.createDataFrame(rows, TURNS).withColumns({c: F.lit(c) for c in names})
    assert got(odd) == brute(rows)


def test_repaired_turns(spark):
    rows = [(1, 0, "system", "Be brief."), (1, 1, "user", "Why?"), (1, 2, "user", "How?"), (1, 3, "assistant", "So.")]
    r = repair.repair(spark.createDataFrame(rows, TURNS)).first()
    assert (r["cost"], r["audit"]) == (3, "KKIKK")
    assert [x["role"] for x in r["repaired"]] == ["system", "user", "assistant", "user", "assistant"]
