"""Chat formatting by prefix-target expansion.

Every assistant turn of a conversation becomes an example of its own: all turns before it as
context, then the turn itself, whose text alone is under the loss mask. Turns behind the last
assistant turn, and conversations without one, make a last example without a target, so that
nothing said is lost.

The template marks turns by control strings; a text can't hold one, since the characters they
start with are written as an escape, which ``unescape`` takes back:

    system      <<SYS>>text<</SYS>>
    user        [INST]text[/INST]
    assistant   <s>text</s>
    any other   [ROLE]role[SEP]text[/ROLE]
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# What each role's turn begins and ends with.
MARKS = {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")}
OTHER, NAMED, OTHER_END = "[ROLE]", "[SEP]", "[/ROLE]"
TARGET = "assistant"

_ESCAPES = {"\\": "\\\\", "<": "\\l", "[": "\\b"}
_BACK = {"\\": "\\", "l": "<", "b": "["}
_TURN = re.compile(
    "|".join(f"{re.escape(a)}(?P<{role}>[^<\\[]*){re.escape(b)}" for role, (a, b) in MARKS.items())
    + f"|{re.escape(OTHER)}(?P<other>[^<\\[]*){re.escape(NAMED)}(?P<said>[^<\\[]*){re.escape(OTHER_END)}")


def escape(text: str) -> str:
    return re.sub(r"[\\<\[]", lambda m: _ESCAPES[m[0]], text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: _BACK[m[1]], text)


def turn_text(role: str, text: str) -> tuple[str, int, int]:
    """A formatted turn, and where its text begins and ends in it."""
    if role in MARKS:
        opening, closing = MARKS[role]
    else:
        opening, closing = OTHER + escape(role) + NAMED, OTHER_END
    body = escape(text)
    return opening + body + closing, len(opening), len(opening) + len(body)


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """Role and text of every turn of a formatted conversation; raises if it is not one."""
    turns, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if m is None:
            raise ValueError(f"no turn at character {at}")
        role = m.lastgroup
        if role == "said":
            turns.append((unescape(m["other"]), unescape(m["said"])))
        else:
            turns.append((role, unescape(m[role])))
        at = m.end()
    return turns


def examples_of(turns: list[tuple[str, str]]) -> Iterator[tuple[int | None, str, int, int]]:
    """Number of the target turn (None for the rest without one), formatted text, and the loss span in characters."""
    prefix, last = "", -1
    for i, (role, text) in enumerate(turns):
        piece, low, high = turn_text(role, text)
        start = len(prefix)
        prefix += piece
        if role == TARGET:
            yield i, prefix, start + low, start + high
            last = i
    if last < len(turns) - 1:
        yield None, prefix, 0, 0


def _expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("conv_id")
        rows: list[tuple] = []
        size = 0
        for i in range(batch.num_rows):
            said = batch.column("turns")[i].as_py()
            for target, text, low, high in examples_of([(t["role"], t["text"]) for t in said]):
                rows.append((ids[i].as_py(), target, text, low, high))
                size += len(text)
                if size > 4 << 20:
                    yield _examples(rows)
                    rows, size = [], 0
        if rows:
            yield _examples(rows)


_EXAMPLE = pa.schema([("conv_id", pa.int64()), ("target_turn", pa.int64()), ("text", pa.string()),
                      ("loss_from", pa.int64()), ("loss_to", pa.int64())])


def _examples(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), _EXAMPLE)], schema=_EXAMPLE)


def examples(conversations: DataFrame) -> DataFrame:
    """``conv_id, target_turn, text, loss_from, loss_to``: one row for each target, in order within a conversation.

    Turns are ordered by ``turn``, equal ones by role and text; repeated rows stay. A null role or text is
    empty, null turns come first; null ids are one conversation. Spans are in code points; an example without
    a target has a null ``target_turn`` and an empty span.
    """
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    gathered = conversations.groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(
        F.sort_array(F.collect_list(turn)).alias("turns"))
    shape = "conv_id long, target_turn long, text string, loss_from long, loss_to long"
    return gathered.mapInArrow(_expand, shape)


_DIGEST = pa.schema([("conv_id", pa.int64()), ("n_examples", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()),
                     ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def told(conv_id, last: str, n: int, chars: int, loss, loss_chars: int) -> tuple:
        turns = read_turns(last)
        said = hashlib.sha256("".join(f"{role}\n{text}\n" for role, text in turns).encode())
        return conv_id, n, len(turns), said.hexdigest(), loss_chars, loss.hexdigest(), chars

    state, rows = None, []
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("conv_id", "text", "loss_from", "loss_to")]
        for conv_id, text, low, high in zip(*columns):
            if state is None or state[0] != conv_id:
                if state is not None:
                    rows.append(told(*state))
                state = [conv_id, "", 0, 0, hashlib.sha256(), 0]
            target = unescape(text[low:high])
            state[1] = text  # every example continues the one before it
            state[2] += 1
            state[3] += len(text)
            state[4].update(target.encode())
            state[5] += len(target)
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), _DIGEST)], schema=_DIGEST)
            rows = []
    if state is not None:
        yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(told(*state), _DIGEST)], schema=_DIGEST)


def digests(made: DataFrame) -> DataFrame:
    """What ``examples`` made, read back: the turns from a conversation's last example, the targets from all loss spans.

    Takes the examples as they come, those of a conversation one behind the other."""
    return made.mapInArrow(_digests, "conv_id long, n_examples long, n_turns long, turns_sha256 string, "
                                     "loss_chars long, loss_sha256 string, formatted_chars long")
