"""Benchmark decontamination: one Aho-Corasick automaton over normalised benchmark windows."""

import hashlib
from collections import defaultdict
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, released, written

WINDOW = 10
#: Characters of benchmark text that go into one automaton; more items are dealt over several.
AUTOMATON_CHARS = 4_000_000

#: Bytes to bytes: A-Z become a-z, other ASCII characters that aren't in words become a space.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))

SCAN_SCHEMA = "doc_id long, n_words long, word_spans array<struct<first:int,last:int>>, char_spans array<struct<start:int,end:int>>, items array<string>"


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_FOLD).split()


def patterns(items: list[tuple], window: int = WINDOW) -> dict[str, list[str]]:
    """Each window of the items' words, framed by spaces, with the ids of the items that hold it."""
    out = defaultdict(set)
    for item_id, text in items:
        words = words_of(text)
        for i in range(max(1, len(words) - window + 1) if words else 0):
            ids = out[b" ".join([b"", *words[i : i + window], b""]).decode("latin-1")]
            if item_id is not None:
                ids.add(str(item_id))
    return {k: sorted(v) for k, v in out.items()}


_automata: dict[int, object] = {}


def _automaton(shared):
    if shared.value is not None and shared.id not in _automata:
        import ahocorasick

        machine = ahocorasick.Automaton()
        for key, ids in shared.value.items():
            machine.add_word(key, (len(key), ids))
        machine.make_automaton()
        _automata.clear()
        _automata[shared.id] = machine
    return _automata[shared.id]


class _Shared:
    """A broadcast and its number, so that a worker builds each automaton once."""

    def __init__(self, broadcast):
        self.broadcast, self.id = broadcast, broadcast._jbroadcast.id()

    def __getstate__(self):
        return {"broadcast": self.broadcast, "id": self.id}

    @property
    def value(self):
        return self.broadcast.value


def merged(starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """Union of intervals [start, end) as sorted disjoint intervals."""
    order = np.argsort(starts, kind="stable")
    out: list[list[int]] = []
    for s, e in zip(starts[order].tolist(), ends[order].tolist()):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def find(text: str, machine) -> tuple[int, list, list, list]:
    """Words of the text, merged hit spans in words and in characters of the original, item ids."""
    folded = text.encode().translate(_FOLD)
    words = folded.split()
    hay = b" ".join([b"", *words, b""]).decode("latin-1")
    hits = list(machine.iter(hay)) if words and len(machine) else []
    if not hits:
        return len(words), [], [], []
    spaces = np.cumsum(np.frombuffer(hay.encode("latin-1"), np.uint8) == 32)
    last = np.array([end for end, _ in hits])
    first = last - np.array([length for _, (length, _) in hits]) + 1
    spans = merged(spaces[first] - 1, spaces[last] - 1)
    raw = np.frombuffer(folded, np.uint8)
    inside = np.concatenate([[False], raw != 32, [False]])
    begins, ends = np.flatnonzero(inside[1:-1] & ~inside[:-2]), np.flatnonzero(inside[1:-1] & ~inside[2:]) + 1
    chars = np.append(0, np.cumsum((raw & 0xC0) != 0x80))  # code points before each byte
    return len(words), spans, [(int(chars[begins[s]]), int(chars[ends[e - 1]])) for s, e in spans], sorted({i for _, (_, ids) in hits for i in ids})


def _scan(shared):
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("word_spans", pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))), ("char_spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), ("items", pa.list_(pa.string()))])

    def run(batches):
        machine = _automaton(shared)
        for batch in batches:
            found = [find(t, machine) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f[0] for f in found], pa.int64()), pa.array([[{"first": a, "last": b - 1} for a, b in f[1]] for f in found], schema.field(2).type), pa.array([[{"start": a, "end": b} for a, b in f[2]] for f in found], schema.field(3).type), pa.array([f[3] for f in found], schema.field(4).type)], schema=schema)

    return released(run)


def _union(spans: str, start: str, end: str, gap: int) -> F.Column:
    """Disjoint union of an array of spans, natively; only for more than one automaton."""
    step = lambda acc, x: F.when((F.size(acc) > 0) & (x[start] <= F.element_at(acc, -1)[end] + gap), F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(F.element_at(acc, -1)[start].alias(start), F.greatest(F.element_at(acc, -1)[end], x[end]).alias(end))))).otherwise(F.concat(acc, F.array(x)))
    return F.aggregate(F.array_sort(spans), F.slice(F.col(spans), 1, 0), step)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, automaton_chars: int = AUTOMATON_CHARS) -> DataFrame:
    """Where documents hold a window of consecutive benchmark words.

    Returns one row per document: doc_id, n_words, word_spans (first and last word of each
    merged hit), char_spans (start and end in code points of the original text), items
    (the ids, as strings, of all items with an occurring window, sorted).

    Words are runs of digits, letters and non-ASCII characters after lower-casing A-Z. An item
    of fewer words than the window is one window; one without words has none. The benchmark is
    measured first: up to automaton_chars characters make one automaton, which is broadcast;
    a larger benchmark is dealt by item over several, each bounded, and the spans are united.

    Null text has no words; an item without an id makes hits but is in no list of items;
    documents are scanned row by row, so repeated rows and ids give repeated results (with
    several automata, rows are numbered and written first). An empty benchmark hits nothing.
    Other columns are ignored.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text")
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    shards = -(-chars // automaton_chars) or 1
    texts = id_and_text(docs)
    shard = F.pmod(F.xxhash64("item_id", "text"), F.lit(shards))
    if shards > 1:
        numbered = written(texts.withColumn("row", F.monotonically_increasing_id()), "rows")
        texts = numbered.select(F.col("row").alias("doc_id"), "text")
    scans = []
    for k in range(shards):
        own = [tuple(r) for r in items.where(shard == k).toLocalIterator()]
        scans.append(texts.mapInArrow(_scan(_Shared(spark.sparkContext.broadcast(patterns(own, window)))), SCAN_SCHEMA))
    if shards == 1:
        return scans[0]
    every = reduce(DataFrame.unionByName, scans).groupBy("doc_id").agg(F.max("n_words").alias("n_words"), *(F.flatten(F.collect_list(c)).alias(c) for c in ("word_spans", "char_spans", "items")))
    every = every.withColumnRenamed("doc_id", "row").join(numbered.select("row", "doc_id"), "row")
    return every.select("doc_id", "n_words", _union("word_spans", "first", "last", 1).alias("word_spans"), _union("char_spans", "start", "end", 0).alias("char_spans"), F.array_sort(F.array_distinct("items")).alias("items"))


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns from the operator's spans."""
    n_hit = F.aggregate("word_spans", F.lit(0).cast("long"), lambda acc, s: acc + (s["last"] - s["first"] + 1))
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("word_spans") > 0).alias("contaminated"))


def brute(docs: list[tuple], items: list[tuple], window: int = WINDOW) -> dict:
    """The contract by plain comparison, for tests."""
    wins = defaultdict(set)
    for item_id, text in items:
        w = words_of(text)
        for i in range(max(1, len(w) - window + 1) if w else 0):
            wins[tuple(w[i : i + window])].update([] if item_id is None else [str(item_id)])
    out = {}
    for doc_id, text in docs:
        w, hit, got = words_of(text), set(), set()
        for size in {len(k) for k in wins}:
            for i in range(len(w) - size + 1):
                if (ids := wins.get(tuple(w[i : i + size]))) is not None:
                    hit.update(range(i, i + size))
                    got |= ids
        out[doc_id] = (len(w), len(hit), len(got), hashlib.sha256(",".join(sorted(got)).encode()).hexdigest(), bool(hit))
    return out
