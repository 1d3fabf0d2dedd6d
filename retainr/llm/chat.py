"""Chat formatting (operator 9): prefix-target expansion.

Every assistant turn becomes one example: all turns before it are the context, and only the reply
itself lies under the loss mask.  A conversation that does not end with an assistant turn adds one
example without a target, so that the output holds every turn.

Template: ``<|im_start|>role\\n text <|im_end|>\\n`` for each turn (no blanks around the text).
Inside roles and texts a backslash is doubled and ``<|`` becomes ``<\\|``; a line feed in a role
becomes ``\\n``.  So a control string can only come from the template, and ``unescape`` gives the
text back.

Rows are dealt by conversation and sorted inside the partition; a task streams them and holds one
conversation's formatted prefix at a time.  The output of a conversation with n turns is of the
order of n**2 turns: that is what the method makes.

Edge cases: null text or role counts as empty; turns are ordered by turn, then role, then text
(null first); rows with a null conversation id are one conversation; no rows give no examples.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, END, TARGET_ROLE = "<|im_start|>", "<|im_end|>", "assistant"
EXAMPLES = "conv_id long, example int, text string, loss_start int, loss_end int"
BATCH_CHARS = 8 << 20


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S) if "\\" in text else text


def _escape_role(role: str) -> str:
    return escape(role).replace("\n", "\\n")


def _unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], role, flags=re.S)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns)), strict=True)


def _examples(rows: Iterator[tuple]) -> Iterator[tuple]:
    """(conv_id, role, text) by conversation and turn -> examples, one conversation at a time."""
    now, prefix, n, pending = None, None, 0, False
    for conv, role, text in rows:
        if prefix is None or conv != now:
            if pending:
                yield now, n, prefix, -1, -1
            now, prefix, n, pending = conv, "", 0, False
        role, body = role or "", escape(text or "")
        head = f"{prefix}{START}{_escape_role(role)}\n"
        prefix = f"{head}{body}{END}\n"
        pending = role != TARGET_ROLE
        if not pending:
            yield now, n, prefix, len(head), len(head) + len(body)
            n += 1
    if pending:
        yield now, n, prefix, -1, -1


def _batched(rows: Iterator[tuple], schema: pa.Schema, chars: int) -> Iterator[pa.RecordBatch]:
    """Arrow batches of rows; ``chars`` bounds the text in one."""
    held: list[tuple] = []
    size = 0
    for row in rows:
        held.append(row)
        size += sum(len(x) for x in row if isinstance(x, str)) + 64
        if size >= chars:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


_EXAMPLES = pa.schema([("conv_id", pa.int64()), ("example", pa.int32()), ("text", pa.string()),
                       ("loss_start", pa.int32()), ("loss_end", pa.int32())])


def expand(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text -> one row an example: conv_id, example (from 0), text (the whole
    formatted example) and the trainable part text[loss_start:loss_end] (-1: none)."""
    rows = (conversations.select("conv_id", "role", "text", "turn")
            .repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
            .select("conv_id", "role", "text"))

    def run(batches):
        yield from _batched(_examples(_rows(batches)), _EXAMPLES, BATCH_CHARS)

    return rows.mapInArrow(run, EXAMPLES)


def turns_of(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts of a formatted example."""
    out, at = [], 0
    while at < len(formatted):
        if not formatted.startswith(START, at):
            raise ValueError("not a formatted conversation")
        line = formatted.index("\n", at)
        end = formatted.index(END, line + 1)
        out.append((_unescape_role(formatted[at + len(START):line]), unescape(formatted[line + 1:end])))
        at = end + len(END) + 1
    return out


READ = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
_READ = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()),
                   ("loss_chars", pa.int64()), ("loss_sha256", pa.string()),
                   ("formatted_chars", pa.int64())])


def _read(rows: Iterator[tuple]) -> Iterator[tuple]:
    now, last, loss, loss_chars, chars = None, None, hashlib.sha256(), 0, 0

    def done():
        turns = turns_of(last)
        all_turns = hashlib.sha256()
        for role, text in turns:
            all_turns.update(f"{role}\n{text}\n".encode())
        return now, len(turns), all_turns.hexdigest(), loss_chars, loss.hexdigest(), chars

    for conv, text, start, end in rows:
        if last is not None and conv != now:
            yield done()
            last = None
        if last is None:
            now, loss, loss_chars, chars = conv, hashlib.sha256(), 0, 0
        last = text
        chars += len(text)
        if start >= 0:
            target = unescape(text[start:end])
            loss.update(target.encode())
            loss_chars += len(target)
    if last is not None:
        yield done()


def read_back(examples: DataFrame) -> DataFrame:
    """What the examples of ``expand`` hold, for each conversation: its turns (from the longest
    example) and the text under the loss masks.  Narrow: ``expand`` leaves a conversation's
    examples next to each other in one partition."""

    def run(batches):
        yield from _batched(_read(_rows(batches)), _READ, BATCH_CHARS)

    return examples.select("conv_id", "text", "loss_start", "loss_end").mapInArrow(run, READ)
