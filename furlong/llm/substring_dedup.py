"""Substring dedup: FM-indexes over shards of repeated passages, searched backward window by window."""

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, partitions, written
from .shingles import SAME, Words, chunks

WINDOW = 20
#: Words of a minimizer.
GRAM = 5
#: Segments of a minimizer beyond which its windows are dealt out one by one.
HOT = 2000


def segments(w: Words, window: int = WINDOW) -> tuple[np.ndarray, ...]:
    """Runs of windows with one minimizer in one place: minimizer hash, text number, first word, number of windows.

    A window's minimizer is the smallest hash among its GRAM-word spans, the first of equal
    ones, so windows of equal words always have equal minimizers, wherever they stand, and
    equal windows of one document are in different runs.
    """
    n, spans = int(w.counts.sum()), window - GRAM + 1
    if n < window:
        return (np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3)
    gram = w.hashes(np.arange(n - GRAM + 1), np.arange(GRAM - 1, n))
    least, size = np.arange(len(gram)), 1  # place of the first minimum of each span
    while size < spans:  # spans double
        step = min(size, spans - size)
        left, right = least[:-step], least[step:]
        least = np.where(gram[right] < gram[left], right, left)
        size += step
    text = np.repeat(np.arange(len(w.counts)), w.counts)
    place = np.arange(n) - w.firsts[text]
    ok = np.flatnonzero(place[: n - window + 1] + window <= w.counts[text[: n - window + 1]])
    if not len(ok):
        return (np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3)
    at, t = least[ok], text[ok]
    h, cut = gram[at], np.append(True, (at[1:] != at[:-1]) | (t[1:] != t[:-1]))
    begin = np.flatnonzero(cut)  # a run has at most window - GRAM + 1 windows, so a mask of them fits a long
    return h[begin], t[begin], place[ok[begin]], np.diff(np.append(begin, len(h)))


def _minimizers(window: int):
    """Documents -> (minimizer, doc_id, at): `at` is the first word times 64 plus the number of windows."""

    def run(batches):
        for batch in batches:
            ids, texts = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_pylist()
            for a, b in chunks(texts):
                h, t, start, n = segments(Words(texts[a:b], SAME), window)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(ids[a:b][t].astype(np.int64)), pa.array(start * 64 + n)], names=["minimizer", "doc_id", "at"])

    return run


class FMIndex:
    """FM-index of a sequence of word numbers; occurrence counts come from a wavelet matrix of packed bits.

    Suffixes are sorted by their first `depth` words, which is enough for backward search of
    patterns up to that length: rows of equal context are contiguous, whatever their order.
    """

    def __init__(self, text: np.ndarray, sigma: int, depth: int = WINDOW):
        n = len(text)
        after = np.append(text, [0, 0])
        key = (text * sigma + after[1 : n + 1]) * sigma + after[2 : n + 2]  # three words at once
        order = np.argsort(key, kind="stable")
        first, place, span = np.append(True, np.diff(key[order]) != 0), np.arange(n), 3
        rank = np.empty(n + 1, np.int64)
        rank[order], rank[n] = np.maximum.accumulate(np.where(first, place, 0)), -1
        while span < depth:  # spans double; only suffixes that still tie are sorted again
            tied = np.flatnonzero(~(first & np.append(first[1:], True)))
            if not len(tied):
                break
            rows = order[tied]
            key = rank[rows] * (n + 1) + rank[np.minimum(rows + span, n)] + 1
            again = np.argsort(key, kind="stable")
            order[tied] = rows = rows[again]
            first[tied] = new = np.append(True, np.diff(key[again]) != 0)
            rank[rows] = tied[np.maximum.accumulate(np.where(new, np.arange(len(rows)), 0))]
            span *= 2
        self.suffixes = order
        bwt = text[self.suffixes - 1]
        self.before = np.append(0, np.cumsum(np.bincount(text, minlength=sigma)))  # words smaller than each
        self.levels = []
        for bit in range(max(1, (sigma - 1).bit_length()) - 1, -1, -1):
            ones = (bwt >> bit & 1).astype(bool)
            packed = np.packbits(np.append(ones, np.zeros(-n % 64 + 64, bool)), bitorder="little").view(np.uint64)
            counts = np.append(0, np.cumsum(np.bitwise_count(packed), dtype=np.int64))[:-1]
            self.levels.append((bit, packed, counts, n - int(ones.sum())))
            bwt = np.concatenate([bwt[~ones], bwt[ones]])
        self.origins = self._down(np.arange(sigma), np.zeros(sigma, np.int64))

    def _down(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        for bit, packed, counts, zeros in self.levels:
            block = i >> 6
            ones = counts[block] + np.bitwise_count(packed[block] & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)))
            i = np.where(c >> bit & 1, zeros + ones, i - ones)
        return i

    def occurrences(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each word c stands in the first i places of the transform."""
        return self._down(c, i) - self.origins[c]

    def repeated(self, text: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Which of the patterns text[start : start + length] occur twice or more, and their rows [low, high).

        The last array is for all patterns: from where to the pattern's end the text already is
        the only one of its kind, -1 for the repeated ones.
        """
        live, c = np.arange(len(starts)), text[starts + length - 1]
        low, high, alone = self.before[c], self.before[c + 1], np.full(len(starts), -1)
        for back in range(length - 2, -2, -1):
            many = high - low > 1
            alone[live[~many]] = starts[live[~many]] + back + 1
            live, low, high = live[many], low[many], high[many]
            if back < 0 or not len(live):
                break
            c = text[starts[live] + back]
            both = self.occurrences(np.append(c, c), np.append(low, high))
            low, high = self.before[c] + both[: len(c)], self.before[c] + both[len(c) :]
        return live, low, high, alone


def _cut(window: int, once: bool = False, remembered: int = 500_000):
    """(doc_id, packed text, runs) -> occurrences: key (128 bits of the words), doc_id, first word, windows.

    With `once`, route and words come along, and a task leaves out words that it has sent with
    an earlier place already: equal runs combine before the shuffle, so that none of them is
    hot after it.
    """

    def run(batches):
        unzip, sent = zstandard.ZstdDecompressor(), {}
        for batch in batches:
            segs = batch.column(2)
            ends = segs.offsets.to_numpy()
            runs = segs.values
            minimizer, at, hot = (runs.field(i).to_numpy(zero_copy_only=False) for i in range(3))
            out: tuple[list, ...] = ([], [], [], [], [], [])
            for doc_id, z, a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), ends[:-1].tolist(), ends[1:].tolist()):
                text = unzip.decompress(z)
                words = text.translate(SAME).split()
                start, n = np.divmod(at[a:b], 64)
                lone = hot[a:b]
                routes, starts, sizes = minimizer[a:b][~lone].tolist(), start[~lone].tolist(), n[~lone].tolist()
                if lone.any():
                    first = np.concatenate([np.arange(x, x + k) for x, k in zip(start[lone], n[lone])])
                    routes += Words([text.decode()], SAME).hashes(first, first + window - 1).view(np.int64).tolist()
                    starts += first.tolist()
                    sizes += [1] * len(first)
                for route, x, k in zip(routes, starts, sizes):
                    cut = b" ".join(words[x : x + k + window - 1])
                    key = hashlib.md5(cut).digest()
                    if once:
                        if key in sent and sent[key] <= (doc_id, x):
                            continue
                        if len(sent) > remembered:
                            sent.clear()
                        sent[key] = (doc_id, x)
                    for column, value in zip(out, (key, doc_id, x, k, route, cut)):
                        column.append(value)
            kinds = [("key", pa.binary()), ("doc_id", pa.int64()), ("start", pa.int64()), ("n", pa.int64()), ("route", pa.int64()), ("words", pa.binary())][: 6 if once else 4]
            for i in range(0, len(out[0]), 10_000):
                yield pa.RecordBatch.from_arrays([pa.array(c[i : i + 10_000], k) for c, (_, k) in zip(out, kinds)], names=[name for name, _ in kinds])

    return run


def _search(window: int, step: int = 100_000):
    """A shard's segments -> each distinct one's earliest place, and those of its windows that also start before it, as a mask."""

    def run(batches):
        places: dict[bytes, tuple[int, int]] = {}
        for batch in batches:
            for words, *place in zip(*(batch.column(c).to_pylist() for c in ("words", "doc_id", "start"))):
                if words not in places or tuple(place) < places[words]:
                    places[words] = tuple(place)
        if not places:
            return
        keys = [hashlib.md5(x).digest() for x in places]
        doc, first = (np.array([p[i] for p in places.values()], np.int64) for i in (0, 1))
        cuts = [x.split(b" ") for x in places]
        places.clear()
        number: dict[bytes, int] = {}
        lens = np.array([len(x) for x in cuts])
        begin = np.cumsum(lens + 1) - lens - 1
        text = np.zeros(int((lens + 1).sum()), np.int64)  # 0 ends a segment
        text[np.arange(lens.sum()) + np.repeat(np.arange(len(lens)), lens)] = [number.setdefault(w, len(number) + 1) for x in cuts for w in x]
        index = FMIndex(text, len(number) + 1, window)
        segment = np.repeat(np.arange(len(lens)), lens + 1)
        place = np.arange(len(text)) - begin[segment]
        order = np.lexsort((first[segment] + place, doc[segment]))
        # equal (document, word) share a rank: the same window may lie in two segments
        d, f = doc[segment][order], (first[segment] + place)[order]
        age = np.zeros(len(text), np.int64)
        age[order] = np.cumsum(np.append(0, (d[1:] != d[:-1]) | (f[1:] != f[:-1])))
        in_rows = np.append(age[index.suffixes], np.iinfo(np.int64).max)
        masks = np.zeros(len(lens), np.uint64)
        # from the left of each run: where a search ends early, all windows with that stretch are settled at once
        todo, limit = begin.copy(), begin + lens - window
        while len(todo):
            nxt = []
            for i in range(0, len(todo), step):
                own = todo[i : i + step]
                live, low, high, alone = index.repeated(text, own, window)
                if len(live):
                    rows, back = np.unique(low, return_inverse=True)
                    top = np.zeros(len(rows), np.int64)
                    top[back] = high
                    earliest = np.minimum.reduceat(in_rows, np.stack([rows, top], axis=1).ravel())[::2][back]
                    late = own[live][age[own[live]] > earliest]
                    np.bitwise_or.at(masks, segment[late], np.uint64(1) << place[late].astype(np.uint64))
                after = np.maximum(own, alone) + 1
                nxt.append(after[after <= limit[segment[own]]])
            todo = np.concatenate(nxt)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(doc), pa.array(first), pa.array(masks.view(np.int64))], names=["key", "from_doc", "from_start", "mask"])

    return run


def _whole(batches):
    """Documents as they are: number of words and digest of the words joined by single spaces."""
    for batch in batches:
        words = [t.encode().translate(SAME).split() for t in batch.column(1).to_pylist()]
        shas = [hashlib.sha256(b" ".join(w)).hexdigest() for w in words]
        columns = [batch.column(0), batch.column(2), pa.array([len(w) for w in words], pa.int64()), pa.array(shas, pa.string())]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_hash", "n_words", "sha"])


def _zip(batches):
    pack = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([pack.compress(t.encode()) for t in batch.column(1).to_pylist()], pa.binary())], names=["doc_id", "z"])


def _removed(window: int):
    """(doc_id, packed text, flagged segments) -> kept text, words removed and their spans."""

    def run(batches):
        unzip = zstandard.ZstdDecompressor()
        for batch in batches:
            out = []
            ends, runs = batch.column(2).offsets.to_numpy(), batch.column(2).values
            start, mask = runs.field(0).to_numpy(), runs.field(1).to_numpy()
            for doc_id, z, a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), ends[:-1].tolist(), ends[1:].tolist()):
                words = unzip.decompress(z).translate(SAME).split()
                change = np.zeros(len(words) + 1, np.int64)
                run_, bit = np.nonzero(np.unpackbits(np.ascontiguousarray(mask[a:b]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
                first = start[a:b][run_] + bit
                np.add.at(change, first, 1)
                np.add.at(change, first + window, -1)
                gone = np.cumsum(change[:-1]) > 0
                edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]])))
                out.append((doc_id, int(gone.sum()), b" ".join(w for w, g in zip(words, gone) if not g).decode(), [{"first": int(a), "last": int(b) - 1} for a, b in edges.reshape(-1, 2)]))
            c = list(zip(*out)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.int64()), pa.array(c[1], pa.int64()), pa.array(c[2], pa.string()), pa.array(c[3], pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())])))], names=["doc_id", "n_removed", "kept_text", "spans"])

    return run


def repeated_passages(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Words covered by a window that also starts earlier, and what is left without them.

    Returns a row for each document that loses words: doc_id, text_hash, n_removed, kept_text,
    spans (first and last word of each removed run). Earlier is a smaller doc_id, or the same
    document and an earlier start; windows are judged on the input.

    1. Documents are cut into runs of windows that share a minimizer; equal windows always
       share it. Runs whose minimizer occurs once in the corpus can't repeat and fall away.
    2. The words of the remaining runs are gathered, and equal runs collapse before and after
       the shuffle to their earliest occurrence; all windows of the others are repeats.
    3. Distinct runs go to shards by minimizer. Each shard is one FM-index, and each of its
       windows is searched backward through the wavelet matrix; a search ends when a single
       row is left. Windows that keep several rows are compared with the earliest of them.

    A minimizer with more than HOT runs has its windows dealt out one by one, by their own
    hash, so no shard grows with a common passage; equal windows collapse as runs do.

    Defined cases: null or short texts lose nothing; null ids take no part; different texts of
    one doc_id are documents of their own, in order of their hash, and rows that repeat both
    id and text are one document. window is 2 to 64. An empty table gives an empty result.
    Other columns are ignored.
    """
    if not 2 <= window <= 64:
        raise ValueError("a window has 2 to 64 words")
    spark = docs.sparkSession
    texts = id_and_text(docs, id_col, text_col).where("doc_id is not null")
    hashed = texts.withColumn("text_hash", F.xxhash64("text"))
    ids = hashed.select("doc_id", "text_hash").groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows"), F.min("text_hash").alias("text_hash"))
    ids = written(ids, "ids")
    if ids.where("rows > 1").isEmpty():
        numbers = ids.select("doc_id", "text_hash", F.col("doc_id").alias("number"))
    else:  # numbers in order of id and hash stand for the rows
        ranged = hashed.select("doc_id", "text_hash").distinct().repartitionByRange(partitions(spark), "doc_id", "text_hash").sortWithinPartitions("doc_id", "text_hash")
        numbers = written(ranged.withColumn("number", F.monotonically_increasing_id()), "numbers")
        texts = hashed.join(numbers, ["doc_id", "text_hash"]).dropDuplicates(["number"]).select(F.col("number").alias("doc_id"), "text")
        texts = written(texts, "numbered")
    runs = texts.mapInArrow(_minimizers(window), "minimizer long, doc_id long, at long")
    often = runs.groupBy("minimizer").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("minimizer", (F.col("c") > HOT).alias("hot"))
    of_doc = runs.join(often, "minimizer").groupBy("doc_id").agg(F.collect_list(F.struct("minimizer", "at", "hot")).alias("segs"))
    # the texts that hold candidates, packed; all later steps read these
    held = written(texts.mapInArrow(_zip, "doc_id long, z binary").join(of_doc, "doc_id"), "candidates")
    sent = held.select("doc_id", "z", "segs").mapInArrow(_cut(window, once=True), "key binary, doc_id long, start long, n long, route long, words binary")
    shards = written(sent.select("route", "words", "doc_id", "start").repartition(partitions(spark), "route").mapInArrow(_search(window), "key binary, from_doc long, from_start long, mask long"), "shards")
    found = held.select("doc_id", "z", "segs").mapInArrow(_cut(window), "key binary, doc_id long, start long, n long")
    every = F.when(F.col("n") == 64, F.lit(-1)).otherwise(F.expr("shiftleft(1L, cast(n as int)) - 1"))
    own = (F.col("doc_id") == F.col("from_doc")) & (F.col("start") == F.col("from_start"))
    flagged = found.join(shards, "key").select("doc_id", "start", F.when(own, F.col("mask")).otherwise(every).alias("mask")).where("mask != 0")
    by_doc = flagged.groupBy("doc_id").agg(F.collect_list(F.struct("start", "mask")).alias("flags"))
    lost = held.select("doc_id", "z").join(by_doc, "doc_id").select("doc_id", "z", "flags")
    lost = lost.mapInArrow(_removed(window), "doc_id long, n_removed long, kept_text string, spans array<struct<first:int,last:int>>")
    return numbers.join(lost.withColumnRenamed("doc_id", "number"), "number").drop("number")


def digest(docs: DataFrame, passages: DataFrame) -> DataFrame:
    """The contract's columns for all documents."""
    hashed = id_and_text(docs).withColumn("text_hash", F.xxhash64("text"))
    whole = hashed.mapInArrow(_whole, "doc_id long, text_hash long, n_words long, sha string")
    changed = passages.select("doc_id", "text_hash", "n_removed", F.sha2("kept_text", 256).alias("new"))
    return whole.join(changed, ["doc_id", "text_hash"], "left").select("doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.coalesce("new", "sha").alias("kept_sha256"))


def brute(rows: list[tuple], window: int = WINDOW) -> dict:
    """doc_id -> (n_words, n_removed, kept_sha256) by a dictionary of windows, for tests; rows in their order."""
    seen: set = set()
    out = {}
    for doc_id, text in sorted(rows, key=lambda r: r[0]):
        w = (text or "").encode().translate(SAME).split()
        gone = set()
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            if k in seen:
                gone.update(range(i, i + window))
            seen.add(k)
        out[doc_id] = (len(w), len(gone), hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest())
    return out
