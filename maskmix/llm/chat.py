"""Conversations as training windows: turn-aligned, within a token budget, every target learned once.

A turn is written ``<|im_start|>role``, a line feed, its text, ``<|im_end|>`` and a line feed.  Inside
roles and texts every ``<``, backslashes, ``|`` gets one backslash more, so that no control string can
occur there; reading takes it away again.  A line feed or backslash of a role is written with a backslash.

Turns are laid out once by range of (conversation, turn); running sums of their tokens, with the sums
of the ranges before, give every turn its place in its conversation however long that is.  Each
``STRETCH`` budgets of tokens are planned on their own, so a task holds a stretch and never a whole
conversation.  Within a stretch the prefix sums choose the spans: as many whole turns as fit beside the
system turn and the repeated history.  A turn longer than the room is a window alone, never cut.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from maskmix.functions.runtime import map_arrow
from maskmix.llm.common import regroup, texts_of
from maskmix.llm.tokens import encoder
from maskmix.workspace import Workspace

#: Fixed values of the template.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
#: Tokens of a turn beside its role and text: both marks and the last line feed.
MARK_TOKENS = 3
SYSTEM, TARGET = "system", "assistant"
#: Tokens of a window and, of those, of repeated turns.
BUDGET, HISTORY = 2048, 512
#: Budgets in a stretch that is planned at once.
STRETCH = 64

WINDOW_COLUMNS = (
    "first_turn long, n_turns int, n_repeated int, n_tokens long, text string, loss array<struct<start:int,stop:int>>"
)

_ESCAPED = re.compile(r"<\\(\\*)\|")


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def _escaped(column):
    return F.regexp_replace(column, r"<(\\*)\|", r"<\\$1|")


def _role_text(raw: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m.group(1) == "n" else m.group(1), unescape(raw), flags=re.S)


@dataclass(frozen=True)
class Limits:
    budget: int = BUDGET
    history: int = HISTORY
    stretch: int = STRETCH

    def __post_init__(self):
        if self.budget < 1 or not 0 <= self.history <= self.budget or self.stretch < 1:
            raise ValueError("needs budget >= 1, 0 <= history <= budget and stretch >= 1")

    @property
    def stretch_tokens(self) -> int:
        return self.budget * self.stretch


def plan_windows(tokens: np.ndarray, known: int, system: int, limits: Limits) -> list[tuple[int, int, int]]:
    """Windows ``(history start, first new turn, end)`` over consecutive turns, of which ``known`` are new to
    nobody: they were in windows before and can only be repeated.  ``system`` tokens open every window."""
    before = np.concatenate([[0], np.cumsum(tokens)])
    out, at = [], known
    while at < len(tokens):
        room = min(limits.history, limits.budget - system - int(tokens[at]))
        past = int(np.searchsorted(before, before[at] - max(0, room)))
        past = min(past, at)
        used = system + int(before[at] - before[past])
        end = int(np.searchsorted(before, before[at] + limits.budget - used, side="right")) - 1
        end = max(end, at + 1)
        out.append((past, at, end))
        at = end
    return out


def _running(batches, tokenizer_path: str) -> Iterator[pa.RecordBatch]:
    """Tokens of each row, and tokens and turns before it within its conversation and partition."""
    encode = encoder(tokenizer_path).encode
    conv, tokens, turns = object(), 0, 0
    for batch in regroup(batches, "__text"):
        roles, texts = texts_of(batch, "__role"), texts_of(batch, "__text")
        sizes = [len(ids) // 4 + MARK_TOKENS for ids in encode([f"{r}\n{t}" for r, t in zip(roles, texts)])]
        before, place = [], []
        for c, n in zip(batch.column(batch.schema.get_field_index("__conv")).to_pylist(), sizes):
            if c != conv:
                conv, tokens, turns = c, 0, 0
            before.append(tokens)
            place.append(turns)
            tokens, turns = tokens + n, turns + 1
        columns = [*batch.columns, *(pa.array(x, pa.int64()) for x in (sizes, before, place))]
        yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "__tokens", "__before", "__place"])


def _bases(stored: DataFrame) -> DataFrame:
    """Tokens and turns that the first conversation of a partition has in the partitions before.

    One row per partition of the layout passes the driver."""
    place = F.struct("__conv", "__place")
    end = F.struct((F.col("__before") + F.col("__tokens")).alias("tokens"), (F.col("__place") + 1).alias("turns"))
    ends = stored.groupBy("__part").agg(
        F.min(F.struct("__conv"))["__conv"].alias("first"),
        F.max(place)["__conv"].alias("last"),
        F.max_by(end, place).alias("end"),
    )
    rows, last, tokens, turns = [], (), 0, 0
    for r in sorted(ends.collect(), key=lambda r: r["__part"]):
        goes_on = last == (r["first"],)
        rows.append((r["__part"], r["first"], tokens if goes_on else 0, turns if goes_on else 0))
        same = goes_on and r["first"] == r["last"]
        last = (r["last"],)
        tokens = r["end"]["tokens"] + (tokens if same else 0)
        turns = r["end"]["turns"] + (turns if same else 0)
    kind = stored.schema["__conv"].dataType.simpleString()
    schema = f"__part int, __first {kind}, __base_tokens long, __base_turns long"
    return stored.sparkSession.createDataFrame(rows, schema)


def _groups(batches, keys: tuple[str, ...]) -> Iterator[list[dict]]:
    """Consecutive rows that agree on ``keys``, whatever batches they come in."""
    held, key = [], None
    for batch in regroup(batches, "__text"):
        for row in batch.to_pylist():
            now = tuple(row[k] for k in keys)
            if held and now != key:
                yield held
                held = []
            key = now
            held.append(row)
    if held:
        yield held


def _windows(batches, limits: Limits, kind):
    made = []
    size = 0
    for rows in _groups(batches, ("__conv", "__stretch")):
        system = [r for r in rows if r["__kind"] == 0]
        turns = [r for r in rows if r["__kind"] > 0]
        opening = system[0] if system else None
        if opening is None and turns[0]["__kind"] == 2 and turns[0]["__place"] == 0 and turns[0]["__role"] == SYSTEM:
            opening = turns[0]
        turns = [r for r in turns if not (r["__kind"] == 1 and opening is not None and r["__place"] == 0)]
        known = sum(r["__kind"] == 1 for r in turns)
        lead = int(opening is not None and not system)  # the system turn is itself new in the first window
        tokens = np.array([r["__tokens"] for r in turns], dtype=np.int64)
        system_tokens = opening["__tokens"] if opening is not None else 0
        plans = plan_windows(tokens[lead:], known, system_tokens, limits) if len(tokens) > lead else [(0, 0, 0)]
        for n, (past, first, end) in enumerate(plans):
            new_system = lead and n == 0
            repeated = turns[lead + past : lead + first]
            if opening is not None and not new_system:
                repeated = [opening, *repeated]
            new = turns[lead + first : lead + end]
            if new_system:
                new = [opening, *new]
            if not new:
                continue
            parts, loss, at = [], [], 0
            for r, fresh in [*((r, False) for r in repeated), *((r, True) for r in new)]:
                head = f"{OPEN}{r['__role']}\n"
                if fresh and r["__role"] == TARGET:
                    loss.append({"start": at + len(head), "stop": at + len(head) + len(r["__text"])})
                parts.append(f"{head}{r['__text']}{CLOSE}\n")
                at += len(parts[-1])
            count = sum(r["__tokens"] for r in repeated) + sum(r["__tokens"] for r in new)
            made.append((rows[0]["__conv"], new[0]["__place"], len(new), len(repeated), count, "".join(parts), loss))
            size += at
            if size >= 2_000_000 or len(made) >= 4096:
                yield _window_batch(made, kind)
                made, size = [], 0
    if made:
        yield _window_batch(made, kind)


def _window_batch(made: list[tuple], kind) -> pa.RecordBatch:
    span = pa.struct([("start", pa.int32()), ("stop", pa.int32())])
    kinds = [kind, pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.list_(span)]
    names = ["__conv", "first_turn", "n_turns", "n_repeated", "n_tokens", "text", "loss"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*made), kinds)], names=names)


def format_chats(
    turns: DataFrame,
    tokenizer_path: str,
    limits: Limits = Limits(),
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    workspace: Workspace | None = None,
) -> DataFrame:
    """Windows of all conversations: ``conv_col``, the place of the first new turn, numbers of new and of
    repeated turns, tokens, the formatted text and the spans (code points) that are learned.

    Each turn is new in one window.  A first turn whose role is ``system`` opens every window; before the
    new turns come as many of the turns before them as ``limits.history`` tokens hold.  Only new turns of
    the assistant are learned.  A window is over the budget only where the system turn and one new turn
    are.  Missing roles and texts are empty; rows without a conversation id are one conversation; a
    missing turn number comes first; rows of one turn follow each other by role and text, repeated rows
    all stay.  An empty table has no windows.  Columns other than the four named are not read.
    """
    spark = turns.sparkSession
    workspace = workspace or Workspace(spark, "chat")
    role = F.regexp_replace(F.regexp_replace(F.coalesce(F.col(role_col), F.lit("")), r"\\", r"\\\\"), "\n", r"\\n")
    rows = turns.select(
        F.col(conv_col).alias("__conv"),
        F.col(turn_col).alias("__turn"),
        _escaped(role).alias("__role"),
        _escaped(F.coalesce(F.col(text_col), F.lit(""))).alias("__text"),
    )
    order = ["__conv", "__turn", "__role", "__text"]
    laid = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id())
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in laid.schema) + ", __tokens long, __before long, __place long"
    stored = workspace.save(map_arrow(laid, partial(_running, tokenizer_path=tokenizer_path), schema), "turns")

    goes_on = F.col("__first").eqNullSafe(F.col("__conv"))
    base = lambda c: F.when(goes_on, F.col(c)).otherwise(0)
    placed = stored.join(F.broadcast(_bases(stored)), "__part").select(
        "__conv", "__role", "__text", "__tokens",
        (F.col("__before") + base("__base_tokens")).alias("__before"),
        (F.col("__place") + base("__base_turns")).alias("__place"),
    )
    whole = F.lit(limits.stretch_tokens)
    stretch = F.floor(F.col("__before") / whole).cast("long")
    placed = placed.withColumn("__stretch", stretch).withColumn("__kind", F.lit(2))
    tail = placed.where((F.col("__stretch") + 1) * whole - F.col("__before") <= limits.history)
    tail = tail.withColumn("__stretch", F.col("__stretch") + 1).withColumn("__kind", F.lit(1))
    reach = placed.where("__stretch > 0").groupBy("__conv").agg(F.max("__stretch").alias("__reach"))
    opening = placed.where((F.col("__place") == 0) & (F.col("__role") == SYSTEM))
    again = opening.alias("o").join(reach.alias("r"), F.col("o.__conv").eqNullSafe(F.col("r.__conv")))
    again = again.select("o.*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__reach"))).alias("__to"))
    again = again.withColumn("__stretch", F.col("__to")).withColumn("__kind", F.lit(0)).drop("__to")
    dealt = placed.unionByName(tail).unionByName(again).repartition("__conv", "__stretch")
    dealt = dealt.sortWithinPartitions("__conv", "__stretch", "__kind", "__place")
    conv_kind = turns.schema[conv_col].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    step = partial(_windows, limits=limits, kind=to_arrow_type(conv_kind))
    made = map_arrow(dealt, step, f"__conv {conv_kind.simpleString()}, {WINDOW_COLUMNS}")
    return made.withColumnRenamed("__conv", conv_col)


def parse_window(text: str) -> list[tuple[str, str]]:
    """Roles and texts of the turns of a window."""
    turns = []
    for part in text.split(OPEN)[1:]:
        role, body = part.split("\n", 1)
        turns.append((_role_text(role), unescape(body[: -len(CLOSE) - 1])))
    return turns


def _digest(batches, kind):
    names = ["__conv", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_windows"]
    kinds = [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
    made: list[tuple] = []
    state: list | None = None

    def close():
        conv, n, turns, chars, loss, formatted, windows = state
        made.append((conv, n, turns.hexdigest(), chars, loss.hexdigest(), formatted, windows))

    batch_of = lambda: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*made), kinds)], names=names)
    for batch in regroup(batches, "text"):
        for row in batch.to_pylist():
            if state is None or state[0] != row["__conv"]:
                if state is not None:
                    close()
                state = [row["__conv"], 0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
            for role, text in parse_window(row["text"])[row["n_repeated"] :]:
                state[1] += 1
                state[2].update(f"{role}\n{text}\n".encode())
            for span in row["loss"]:
                learned = unescape(row["text"][span["start"] : span["stop"]])
                state[3] += len(learned)
                state[4].update(learned.encode())
            state[5] += len(row["text"])
            state[6] += 1
        if len(made) >= 4096:
            yield batch_of()
            made = []
    if state is not None:
        close()
    if made:
        yield batch_of()


def read_back(windows: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """Per conversation what its windows say: turns, digests of turns and learned text, code points, windows.

    A digest of a whole conversation is sequential by its nature: windows of one conversation stream through
    one task in order, one batch in memory at a time."""
    from pyspark.sql.pandas.types import to_arrow_type

    kind = windows.schema[conv_col].dataType
    rows = windows.select(F.col(conv_col).alias("__conv"), "first_turn", "n_repeated", "text", "loss")
    dealt = rows.repartition("__conv").sortWithinPartitions("__conv", "first_turn")
    schema = (
        f"__conv {kind.simpleString()}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
        "formatted_chars long, n_windows long"
    )
    step = partial(_digest, kind=to_arrow_type(kind))
    return map_arrow(dealt, step, schema).withColumnRenamed("__conv", conv_col)
