"""Token-ID output: Simple-8b words in blocks, written and read as a Spark table of binary rows."""

import os
import re
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import id_and_text, partitions, released

#: Simple-8b, fixed values: bits of one id and ids in a word, by selector (the top 4 bits).
WIDTHS = np.array([1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
COUNTS = np.array([60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
#: A word of this selector stands for one id of more than 60 bits, kept in the row's exceptions.
ESCAPE = 15
BLOCK = 1024
#: A row of the file closes with the document that takes it past so many ids.
ROW_IDS = 1 << 17
#: Words whose ids a Python worker remembers at most.
CACHE_WORDS = 500_000

FILE_SCHEMA = "part int, seq int, first long, n_ids long, block_words binary, words binary, exceptions binary, doc_ids array<long>, doc_lens array<long>"


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids (unsigned 64-bit) as Simple-8b words, the number of words before each block, exceptions."""
    ids = np.asarray(ids, dtype=np.uint64)
    n, n_blocks = len(ids), -(-len(ids) // BLOCK)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint32), np.zeros(0, np.uint64)
    pad = int(COUNTS[0])
    grid = np.zeros((n_blocks, BLOCK + pad), np.uint64)
    grid[:, :BLOCK] = np.concatenate([ids, np.zeros(n_blocks * BLOCK - n, np.uint64)]).reshape(n_blocks, BLOCK)
    big = grid >> np.uint64(60) != 0
    _, exponent = np.frexp(grid.astype(np.float64))
    bits = exponent.astype(np.uint8).ravel()
    # the most bits among the c ids from each place, for every count c, each from two shorter spans
    most = {1: bits}
    for c in sorted(set(COUNTS.tolist()) - {1}):
        a = max(x for x in most if 2 * x >= c)
        out = most[a].copy()
        np.maximum(most[a][: -(c - a)], most[a][c - a :], out=out[: -(c - a)])
        most[c] = out
    selector = np.full(len(bits), len(COUNTS) - 1, np.uint8)
    for k in range(len(COUNTS) - 2, -1, -1):
        selector[most[int(COUNTS[k])] <= WIDTHS[k]] = k
    selector[big.ravel()] = ESCAPE
    counts = np.append(COUNTS, [1, 1]).astype(np.uint8)[selector]
    # greedy: each word takes the longest span that fits, in all blocks at once; blocks close their last word with zeros
    at = np.arange(n_blocks) * (BLOCK + pad)
    end = at + np.minimum(BLOCK, n - np.arange(n_blocks) * BLOCK)
    places, blocks, block = [], [], np.arange(n_blocks)
    while len(at):
        places.append(at)
        blocks.append(block)
        at = at + counts[at]
        more = at < end
        at, end, block = at[more], end[more], block[more]
    place, per_block = np.sort(np.concatenate(places)), np.bincount(np.concatenate(blocks), minlength=n_blocks).astype(np.uint32)
    flat, chosen = grid.ravel(), selector[place]
    words = chosen.astype(np.uint64) << np.uint64(60)
    for k in np.unique(chosen[chosen < len(COUNTS)]):
        mine = np.flatnonzero(chosen == k)
        shifts = np.arange(COUNTS[k], dtype=np.uint64) * np.uint64(WIDTHS[k])
        words[mine] |= np.bitwise_or.reduce(flat[place[mine][:, None] + np.arange(COUNTS[k])] << shifts, axis=1)
    return words, np.cumsum(per_block, dtype=np.uint32) - per_block, flat[place[chosen == ESCAPE]]


def unpack(words: np.ndarray, block_words: np.ndarray, exceptions: np.ndarray, n: int) -> np.ndarray:
    """The ids again; all words of one selector are decoded at once."""
    if not n:
        return np.zeros(0, np.uint64)
    selector = (words >> np.uint64(60)).astype(np.int64)
    counts = np.append(COUNTS, [1, 1])[selector]
    sizes = np.full(len(block_words), BLOCK)
    sizes[-1] = n - BLOCK * (len(block_words) - 1)
    last = np.append(block_words[1:], len(words)).astype(np.int64) - 1
    counts[last] -= np.add.reduceat(counts, block_words.astype(np.int64)) - sizes
    at, out = np.cumsum(counts) - counts, np.zeros(n, np.uint64)
    for k in np.unique(selector):
        mine = np.flatnonzero(selector == k)
        if k == ESCAPE:
            out[at[mine]] = exceptions
            continue
        lanes = np.arange(COUNTS[k])
        values = (words[mine][:, None] >> (lanes.astype(np.uint64) * np.uint64(WIDTHS[k]))) & np.uint64((1 << int(WIDTHS[k])) - 1)
        real = lanes < counts[mine][:, None]
        out[(at[mine][:, None] + lanes)[real]] = values[real]
    return out


#: Byte-level vocabularies write a byte as the printable character of its number, the others as U+0100 on.
_PRINTED = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_BYTE_CHARS = np.arange(0x100, dtype="<u4")
_BYTE_CHARS[[b for b in range(0x100) if b not in _PRINTED]] = 0x100 + np.arange(0x100 - len(_PRINTED))
_BYTE_CHARS[0x20] = 0x20  # only ever between pre-tokens


class Numbers(dict):
    """Words' numbers; a new word gets the next one and waits in `new`."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self)
        self.new.append(word)
        return number


#: Pre-tokens of lower-case text up to U+00FF, as the vocabulary's own pattern cuts them: letters, one digit, contractions, marks.
_LETTERS, _NUMBERS = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe"
_PRE_TOKENS = re.compile(f"[{_LETTERS}]+|[{_NUMBERS}]|'(?:s|t|re|ve|m|ll|d)|[^\t-\r \x85\xa0{_LETTERS}{_NUMBERS}]+")


def _narrow(text: str) -> bool:
    """Whether all characters are up to U+00FF."""
    try:
        return text.isascii() or bool(text.encode("latin-1"))
    except UnicodeEncodeError:
        return False


class WordIds:
    """Ids of whole texts from a tokenizer that lower-cases and cuts by _PRE_TOKENS.

    Each distinct pre-token goes through the vocabulary's merges once; texts are then joined
    from the remembered ids. Texts with characters beyond U+00FF or with a special token's
    brackets go through the tokenizers library as they are. The memory is emptied at
    CACHE_WORDS. `word_end` is how the vocabulary marks the last id of a pre-token.
    """

    def __init__(self, path: str, word_end: str = "</w>"):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        # pre-tokens are in normal form; they need only their bytes and the merges
        self.merges = Tokenizer.from_file(path)
        self.merges.normalizer, self.merges.pre_tokenizer = normalizers.Sequence([]), pre_tokenizers.WhitespaceSplit()
        size = self.tokenizer.get_vocab_size()
        self.last = np.zeros(size, bool)
        self.last[[i for token, i in self.tokenizer.get_vocab().items() if token.endswith(word_end)]] = True
        self.clear()

    def clear(self) -> None:
        self.known = Numbers()
        self.ids, self.starts, self.lens = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def learn(self, new: list[str]) -> None:
        """Ids of new pre-tokens, encoded as one text and cut after each last id of a pre-token."""
        text = " ".join(new)  # a pre-token holds no space
        if not (text.isascii() and text.isprintable()):
            text = _BYTE_CHARS[np.frombuffer(text.encode(), np.uint8)].tobytes().decode("utf-32-le")
        ids = np.array(self.merges.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
        ends = np.flatnonzero(self.last[ids]) + 1
        lens = np.diff(np.append(0, ends))
        self.starts, self.lens = np.append(self.starts, len(self.ids) + ends - lens), np.append(self.lens, lens)
        self.ids = np.append(self.ids, ids)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other, and each text's number of ids."""
        if len(self.known) > CACHE_WORDS:
            self.clear()
        cut, other = [], []
        for i, t in enumerate(texts):
            if "<|" in t or not _narrow(t):
                other.append(i)
                cut.append(())
            else:
                cut.append(_PRE_TOKENS.findall(t.lower()))
        sizes = np.array([len(c) for c in cut], np.int64)
        index = np.fromiter(map(self.known.__getitem__, chain.from_iterable(cut)), np.int64, int(sizes.sum()))
        if self.known.new:
            self.learn(self.known.new)
            self.known.new = []
        lens = self.lens[index]
        total = np.cumsum(lens)
        gather = np.repeat(self.starts[index] - (total - lens), lens) + np.arange(total[-1] if len(total) else 0)
        ids, of_text = self.ids[gather], np.diff(np.append(0, total)[np.append(0, np.cumsum(sizes))])
        if other:
            whole = self.tokenizer.encode_batch_fast([texts[i] for i in other], add_special_tokens=False)
            parts = np.split(ids, np.cumsum(of_text)[:-1])
            for i, e in zip(other, whole):
                parts[i] = np.array(e.ids, np.uint32)
                of_text[i] = len(e.ids)
            ids = np.concatenate(parts)
        return ids, of_text


_encoders: dict[str, WordIds] = {}


def _file_rows(path: str, end_id: int):
    """Batches of (doc_id, text) in order -> rows of the file."""
    schema = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("first", pa.int64()), ("n_ids", pa.int64()), ("block_words", pa.binary()), ("words", pa.binary()), ("exceptions", pa.binary()), ("doc_ids", pa.list_(pa.int64())), ("doc_lens", pa.list_(pa.int64()))])

    def run(batches):
        encoder = _encoders.setdefault(path, None) or WordIds(path)
        _encoders[path] = encoder
        part, seq, first = TaskContext.get().partitionId(), 0, 0
        held, held_ids, held_lens, size = [], [], [], 0

        def row():
            ids = np.concatenate(held)
            words, block_words, exceptions = pack(ids)
            values = [part, seq, first, len(ids), block_words.tobytes(), words.tobytes(), exceptions.tobytes(), held_ids, held_lens]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, schema.types)], schema=schema)

        for batch in batches:
            doc_ids, sizes = batch.column(0).to_pylist(), pc.binary_length(batch.column(1)).to_pylist()
            at = 0
            while at < len(sizes):  # so many documents at once that strings and arrays stay small
                to, size_at_once = at, 0
                while to < len(sizes) and (to == at or size_at_once + sizes[to] < 500_000):
                    size_at_once += sizes[to]
                    to += 1
                ids, lens = encoder.encode(batch.column(1).slice(at, to - at).to_pylist())
                with_end = np.full(len(ids) + len(lens), end_id, np.uint32)
                with_end[np.arange(len(ids)) + np.repeat(np.arange(len(lens)), lens)] = ids
                for doc_id, text_ids in zip(doc_ids[at:to], np.split(with_end, np.cumsum(lens + 1)[:-1])):
                    held.append(text_ids)
                    held_ids.append(doc_id)
                    held_lens.append(len(text_ids))
                    size += len(text_ids)
                    if size >= ROW_IDS:
                        yield row()
                        seq, first = seq + 1, first + size
                        held, held_ids, held_lens, size = [], [], [], 0
                at = to
        if held:
            yield row()

    return released(run)


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every whole text, end it with end_id and write the ids in ascending doc_id order.

    The table at `path` has one row per run of whole documents (about ROW_IDS ids; one longer
    document has a row of its own): the writing partition and the row's place in it, the ids
    in Simple-8b words, the number of words before each block of BLOCK ids, ids of more than
    60 bits, and the documents' ids and lengths.

    Documents are dealt out by ranges of doc_id, so partition order and row order give the
    global order. A hash of the text stands beside the id in the ranges, so that rows of one
    id spread and the driver samples no text. Null text encodes as empty (only end_id); null
    ids come first; equal ids are ordered by that hash, then by text; an empty table writes
    no rows.
    """
    hashed = id_and_text(docs, id_col, text_col).withColumn("h", F.xxhash64("text"))
    ranged = hashed.repartitionByRange(partitions(docs.sparkSession), "doc_id", "h").sortWithinPartitions("doc_id", "h", "text").select("doc_id", "text")
    ranged.mapInArrow(_file_rows(tokenizer_path, end_id), FILE_SCHEMA).write.parquet(path)


def read_tokens(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """Documents of a file of write_tokens: doc_id, start, n_tokens, ids_crc32 and, if asked, ids.

    start counts the ids of all documents before. ids_crc32 is the CRC-32 of the ids as
    little-endian unsigned 32-bit integers.
    """
    fields = [("doc_id", pa.int64()), ("part", pa.int32()), ("place", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())] + [("ids", pa.list_(pa.int64()))] * with_ids

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                ids = unpack(np.frombuffer(r["words"], np.uint64), np.frombuffer(r["block_words"], np.uint32), np.frombuffer(r["exceptions"], np.uint64), r["n_ids"])
                lens = np.array(r["doc_lens"], np.int64)
                ends = np.cumsum(lens)
                raw = memoryview(ids.astype("<u4")).cast("B")
                crc = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), lens.tolist())]
                columns = [r["doc_ids"], [r["part"]] * len(lens), r["first"] + ends - lens, lens, crc] + [[x.astype(np.int64) for x in np.split(ids, ends[:-1])]] * with_ids
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, fields)], names=[n for n, _ in fields])

    files = spark.read.schema(FILE_SCHEMA).parquet(path)
    # one row for each writing partition, however many documents there are
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    docs = files.select("part", "first", "n_ids", "block_words", "words", "exceptions", "doc_ids", "doc_lens").mapInArrow(run, "doc_id long, part int, place long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids)
    return docs.join(F.broadcast(parts), "part").select("doc_id", (F.col("place") + F.col("before")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)
