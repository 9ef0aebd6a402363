"""Chat formatting by token-level assembly (operator 6).

`assemble` encodes every turn's role and text on its own, escapes control strings in them, splices the reserved ids between, and
derives each turn's place and its part of the loss mask by running sums over the turns of its conversation. The sequence of a
conversation is the ids of its turns one after another; it is kept a row a turn, so no row or task holds a whole conversation.
`read_back` walks those ids in order, decodes and parses them, and needs no other column than the ids and the mask.

Template of a turn: <|im_start|> role \\n text <|im_end|> \\n, where <|im_start|> and <|im_end|> are reserved ids past the
vocabulary. The mask covers the text ids of assistant turns.

Escaping, which unescape() undoes: `<`, any backslashes, `|` gets one backslash more before the `|`; in a role, a backslash is
doubled and a line feed written \\n first.

Defined cases: a null role or text is empty; turns go by turn (nulls first), then role, then the digest of the text, so repeated and tied rows are all
kept in a fixed order; a null conv_id is a conversation of its own; an empty table gives no rows; other columns are ignored.
A conversation of any size is streamed through one task with a constant state, as its digests are sequential by definition; the
encoding is done before, in all tasks.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.llm.common import slices
from marketloom.llm.tokens import Bpe, bpe

#: What the two reserved ids stand for in the formatted text.
START, END = "<|im_start|>", "<|im_end|>"

ASSEMBLED = "conv_id long, turn_no long, ids binary, start long, mask_start long, mask_end long"


def escape(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\1\\|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def _encoded(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    b: Bpe = bpe(path)
    start, end = np.array([b.size], "<u4").tobytes(), np.array([b.size + 1], "<u4").tobytes()
    line = b.plain("\n").tobytes()
    for batch in slices(batches):
        ids, before, inside = [], [], []
        for role, text in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            head = start + b.plain(escape_role(role or "")).tobytes() + line
            body = b.plain(escape(text or "")).tobytes()
            ids.append(head + body + end + line)
            before.append(len(head) // 4)
            inside.append(len(body) // 4 if role == "assistant" else 0)
        # The text stays only where its order can matter: as the last sort key its digest does.
        mark = [hashlib.md5((t or "").encode()).digest() for t in batch.column(3).to_pylist()]
        arrays = [batch.column(0), batch.column(1), batch.column(2), pa.array(mark, pa.binary()), pa.array(ids, pa.binary()), pa.array(before, pa.int64()), pa.array(inside, pa.int64())]
        yield pa.record_batch(arrays, ["conv_id", "turn", "role", "mark", "ids", "head", "body"])


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by conversation and turn; starts are running sums of lengths."""
    now, turn_no, at = object(), 0, 0
    for batch in slices(batches, 2048):
        starts, numbers = [], []
        for conv, ids in zip(batch.column(0).to_pylist(), batch.column(4).to_pylist(), strict=True):
            if conv != now:
                now, turn_no, at = conv, 0, 0
            starts.append(at)
            numbers.append(turn_no)
            turn_no, at = turn_no + 1, at + len(ids) // 4
        first = np.array(starts) + np.asarray(batch.column(5))
        arrays = [batch.column(0), pa.array(numbers, pa.int64()), batch.column(4), pa.array(starts, pa.int64()), pa.array(first, pa.int64()), pa.array(first + np.asarray(batch.column(6)), pa.int64())]
        yield pa.record_batch(arrays, ["conv_id", "turn_no", "ids", "start", "mask_start", "mask_end"])


def assemble(turns: DataFrame, tokenizer: str) -> DataFrame:
    """turns: conv_id, turn, role, text. One row a turn: conv_id, turn_no, ids (packed), start, mask_start, mask_end; in order within partitions."""
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    encoded = rows.mapInArrow(lambda it: _encoded(it, tokenizer), "conv_id long, turn long, role string, mark binary, ids binary, head long, body long")
    return encoded.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "mark").mapInArrow(_placed, ASSEMBLED)


class _Reader:
    """State of one conversation while its ids pass."""

    def __init__(self, conv: int | None):
        self.conv, self.turns, self.loss_chars, self.chars = conv, 0, 0, 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def row(self) -> tuple:
        return self.conv, self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def _read(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    b = bpe(path)
    word = b.bytes_of | {b.size: START.encode(), b.size + 1: END.encode()}
    decode = lambda ids: b"".join(map(word.__getitem__, ids)).decode()
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    made = lambda rows: pa.record_batch([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)
    now, done = None, []
    for batch in slices(batches):
        for conv, packed, start, a, z in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3, 4, 5)), strict=True):
            if now is None or conv != now.conv:
                done += [now.row()] if now else []
                now = _Reader(conv)
            ids = np.frombuffer(packed, "<u4").tolist()
            if ids[0] != b.size or ids[-2] != b.size + 1 or b.size in ids[1:] or b.size + 1 in ids[:-2]:
                raise ValueError("the reserved ids do not enclose one turn")
            role, _, text = decode(ids[1:-2]).partition("\n")
            now.turns += 1
            now.all.update(f"{unescape_role(role)}\n{unescape(text)}\n".encode())
            loss = unescape(decode(ids[a - start : z - start]))
            now.loss.update(loss.encode())
            now.loss_chars += len(loss)
            now.chars += len(decode(ids))
        if len(done) > 1000:
            yield made(done)
            done = []
    done += [now.row()] if now else []
    if done:
        yield made(done)


def read_back(assembled: DataFrame, tokenizer: str) -> DataFrame:
    """One row a conversation, from the assembled ids as assemble() leaves them (whole and in order within a partition)."""
    kinds = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return assembled.mapInArrow(lambda it: _read(it, tokenizer), kinds)
