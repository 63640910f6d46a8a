"""Chat formatting at token level: segments encoded alone, reserved ids spliced, loss masks by prefix sums."""

import hashlib
import os
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Reserved ids, counted from the first id beyond the tokenizer's vocabulary, and their strings in the rendered text.
BEGIN, MIDDLE, END = 0, 1, 2
MARKS = {BEGIN: "### ", MIDDLE: ": ", END: " </turn>\n"}
#: What the rendered text may not hold outside marks; "\" escapes each, and itself.
_CONTROL = re.compile(r"\\|###|</turn>|: ")
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


_tokenizers: dict[str, object] = {}


def _tokenizer(path: str):
    if path not in _tokenizers:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _tokenizers[path] = Tokenizer.from_file(path)
        _tokenizers[path].encode_special_tokens = True
    return _tokenizers[path]


def _segments(path: str, reserved: int, learn: str):
    """Turns -> their segments' ids (role and text between reserved ids), lengths and loss flags."""

    def run(batches):
        t = _tokenizer(path)
        for batch in batches:
            roles, texts = batch.column("role").to_pylist(), batch.column("text").to_pylist()
            role_ids = {r: t.encode(escape(r), add_special_tokens=False).ids for r in set(roles)}
            text_ids = [e.ids for e in t.encode_batch([escape(x) for x in texts], add_special_tokens=False)]
            ids = [[reserved + BEGIN, *role_ids[r], reserved + MIDDLE, *x, reserved + END] for r, x in zip(roles, text_ids)]
            lens = [[1, len(role_ids[r]), 1, len(x), 1] for r, x in zip(roles, text_ids)]
            loss = [[0, 0, 0, int(r == learn), 0] for r in roles]
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("turn"), pa.array(roles, pa.string()), pa.array(ids, pa.list_(pa.int32())), pa.array(lens, pa.list_(pa.int32())), pa.array(loss, pa.list_(pa.int8()))], names=["conv_id", "turn", "role", "ids", "lens", "loss"])

    return run


def _spans(batches):
    """Segment lengths -> [start, end) of each learnt segment, by prefix sums."""
    for batch in batches:
        starts, ends = [], []
        for lens, loss in zip(batch.column("lens").to_pylist(), batch.column("loss").to_pylist()):
            upto, learnt = np.cumsum(lens), np.array(loss, bool)
            starts.append((upto - lens)[learnt].tolist())
            ends.append(upto[learnt].tolist())
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("n_turns"), batch.column("ids"), pa.array(starts, pa.list_(pa.int64())), pa.array(ends, pa.list_(pa.int64()))], names=["conv_id", "n_turns", "input_ids", "loss_starts", "loss_ends"])


def format_chats(turns: DataFrame, tokenizer_path: str, vocabulary: int, learn: str = "assistant") -> DataFrame:
    """Conversations as token ids: conv_id, n_turns, input_ids, loss_starts, loss_ends.

    A turn is BEGIN role MIDDLE text END; the three marks are reserved ids from `vocabulary`
    on, which no text can encode to. Role and text are escaped (so that the rendered text is
    unambiguous too) and encoded alone, before turns are gathered, so that the work spreads
    over rows rather than conversations. The loss covers the ids of each text whose role is
    `learn`; its spans are prefix sums of segment lengths.

    Turns are in order of (turn, role, ids); null turns come first, repeated rows stay. Null
    role or text is empty; rows of null conv_id make one conversation; an empty table gives
    none. Other columns are ignored. A conversation is one output row, so its size bounds
    what one task holds.
    """
    clean = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    parts = clean.mapInArrow(_segments(tokenizer_path, vocabulary, learn), "conv_id long, turn long, role string, ids array<int>, lens array<int>, loss array<tinyint>")
    gathered = parts.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "ids", "lens", "loss"))).alias("t"))
    joined = gathered.select("conv_id", F.size("t").cast("long").alias("n_turns"), F.flatten("t.ids").alias("ids"), F.flatten("t.lens").alias("lens"), F.flatten("t.loss").alias("loss"))
    return joined.mapInArrow(_spans, "conv_id long, n_turns long, input_ids array<int>, loss_starts array<long>, loss_ends array<long>")


def render(chats: DataFrame, tokenizer_path: str, vocabulary: int) -> DataFrame:
    """Read formatted ids back: conv_id, n_turns, roles, texts, loss_text, formatted (rendered text)."""

    def run(batches):
        t = _tokenizer(tokenizer_path)
        decode = lambda ids: t.decode(ids, skip_special_tokens=False) if len(ids) else ""
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                ids = np.array(r["input_ids"], np.int64)
                marks = np.flatnonzero(ids >= vocabulary)
                between = [decode(x[1:].tolist()) for x in np.split(ids, marks)[1:]]  # what follows each mark
                kinds = (ids[marks] - vocabulary).tolist()
                roles = [unescape(x) for x, k in zip(between, kinds) if k == BEGIN]
                texts = [unescape(x) for x, k in zip(between, kinds) if k == MIDDLE]
                loss = "".join(unescape(decode(r["input_ids"][a:b])) for a, b in zip(r["loss_starts"], r["loss_ends"]))
                rows.append((r["conv_id"], len(roles), roles, texts, loss, "".join(MARKS[k] + x for k, x in zip(kinds, between))))
            columns = list(zip(*rows)) or [[]] * 6
            kinds = [pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.string()), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["conv_id", "n_turns", "roles", "texts", "loss_text", "formatted"])

    return chats.mapInArrow(run, "conv_id long, n_turns long, roles array<string>, texts array<string>, loss_text string, formatted string")


def digest(rendered: DataFrame) -> DataFrame:
    """The contract's columns from the texts that were read back."""
    turns = F.array_join(F.transform(F.arrays_zip("roles", "texts"), lambda x: F.concat(x["roles"], F.lit("\n"), x["texts"], F.lit("\n"))), "")
    return rendered.select("conv_id", "n_turns", F.sha2(turns, 256).alias("turns_sha256"), F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


def brute(rows: list[tuple]) -> dict:
    """conv_id -> contract columns, from (conv_id, turn, role, text) rows, for tests."""
    convs: dict = {}
    for conv_id, turn, role, text in sorted(rows, key=lambda r: (r[0], r[1], r[2] or "")):
        convs.setdefault(conv_id, []).append((role or "", text or ""))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    out = {}
    for conv_id, turns in convs.items():
        loss = "".join(x for r, x in turns if r == "assistant")
        formatted = "".join(f"### {escape(r)}: {escape(x)} </turn>\n" for r, x in turns)
        out[conv_id] = (len(turns), sha("".join(f"{r}\n{x}\n" for r, x in turns)), len(loss), sha(loss), len(formatted))
    return out
