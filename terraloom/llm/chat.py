"""Operator 4: chat formatting in budgeted windows.

Turns are ordered by (turn, role, text) within a conversation. A turn becomes ``<s>[INST] role [/INST]text</s>``;
control strings inside roles and texts are escaped by a backslash that reading takes out again. Long
conversations are cut into windows of whole turns: from the prefix sums of the turns' token counts, a window
ends before the turn whose prefix sum passes the window's start by more than the budget that the system turn
and the repeated history leave. Each window repeats the conversation's first system turn, once that has been said, and as many of
the last turns as ``history`` tokens hold; what is repeated is masked, so each assistant text is under the loss once.
Tokens are those of the formatted turns. A turn too long for the budget gets a window of its own, without history; so does
one that only fits without the system turn, which still comes first: such a window passes the budget by less than the
system turn's tokens.

Scale: token counts are one map. Turns are numbered by the carried sizes of blocks of turn numbers and dealt by
(conversation, block of about ``BLOCK_TURNS`` turns), so that a conversation of a third of all rows is spread over many
tasks; a block also gets the turns before and after it that its windows may reach. Where a window that starts at a turn ends
depends on these alone, so each block tells, for each of its turns, where a chain of windows from there leaves it; one
pass over one such row per block finds each block's first window. The windows are those of one pass over the whole
conversation. Reading back streams the windows of a conversation in order through one task because a digest of the
whole is sequential; it holds one window.

Cases: null text or role counts as empty; a null turn comes first; equal turns are all kept, in (role, text) order;
a null conv_id is a conversation of its own; extra columns are dropped; an empty table gives an empty result; only
the role ``assistant`` is under the loss; a conversation without one has loss_chars 0 and the digest of "".
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terraloom.llm.common import stored
from terraloom.llm.vocab import BYTE_BPE, tokenizer

#: Tokens of a window, of the history that a window repeats, and turn numbers per block.
BUDGET, HISTORY, BLOCK_TURNS = 2048, 256, 256
#: Tokens of a formatted turn, at least.
LEAST_TOKENS = 10

_CONTROL = re.compile(r"([<\[])(\\*)(/?(?:INST\]|s>))")
_ESCAPED = re.compile(r"([<\[])\\(\\*)(/?(?:INST\]|s>))")
_TURN = re.compile(r"<s>\[INST\] (.*?) \[/INST\](.*?)</s>", re.S)

WINDOWS = "conv_id long, block long, window int, text string, repeated int, loss array<struct<start:int,end:int>>"
DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def escape(text: str) -> str:
    return _CONTROL.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2\3", text)


def format_turn(role: str, text: str) -> tuple[str, int]:
    """The formatted turn and the offset of its text in it."""
    head = f"<s>[INST] {escape(role)} [/INST]"
    return f"{head}{escape(text)}</s>", len(head)


def parse(text: str) -> list[tuple[str, str]]:
    """Roles and texts of a formatted window."""
    return [(unescape(r), unescape(t)) for r, t in _TURN.findall(text)]


def _numbered(turns: DataFrame, folder: str | None, name: str) -> DataFrame:
    """conv_id, idx, role, text, tokens: turns with their places in the conversation and the tokens that they have when formatted."""
    block = F.floor(F.coalesce("turn", F.lit(-(2**63))) / BLOCK_TURNS).cast("long")
    rows = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).withColumn("block", block)
    w = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = rows.groupBy("conv_id", "block").count().select(F.col("conv_id").alias("c"), F.col("block").alias("b"), F.coalesce(F.sum("count").over(w), F.lit(0)).alias("before"))
    dealt = rows.join(before, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("block") == F.col("b"))).select("conv_id", "block", "turn", "role", "text", "before")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, group, at = tokenizer(name, folder), None, 0
        for b in batches:
            roles, texts, places = b.column(3).to_pylist(), b.column(4).to_pylist(), []
            coded = coder.encode_batch_fast([format_turn(r, t)[0] for r, t in zip(roles, texts, strict=True)], add_special_tokens=False)
            for conv, block, before in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(5).to_pylist(), strict=True):
                group, at = (conv, block), at + 1 if group == (conv, block) else 0
                places.append(before + at)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(places, pa.int64()), b.column(3), b.column(4), pa.array([len(c) for c in coded], pa.int32())], names=["conv_id", "idx", "role", "text", "tokens"])

    return dealt.repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", "turn", "role", "text").mapInArrow(run, "conv_id long, idx long, role string, text string, tokens int")


class _Block:
    """The turns that a block's windows may reach, as prefix sums: where a window ends and what it repeats."""

    def __init__(self, first: int, tokens: list[int], same: list[bool], system: int | None, system_idx: int | None, budget: int, history: int):
        self.first, self.tokens, self.system, self.system_idx, self.budget, self.history = first, tokens, system, system_idx, budget, history
        self.sums, self.same = [0, *accumulate(tokens)], [0, *accumulate(same)]

    def window(self, idx: int) -> tuple[int, int, bool]:
        """First turn repeated, end, and whether the system turn comes first, of a window whose own turns begin at ``idx``."""
        i, n, said = idx - self.first, self.tokens[idx - self.first], self.system is not None and self.system_idx <= idx
        system = self.system if said else 0
        lo = bisect_left(self.sums, self.sums[i] - max(0, min(self.history, self.budget - system - n)), 0, i + 1)
        put = said and self.same[lo] == self.same[i + 1]
        room = max(self.budget - (self.sums[i] - self.sums[lo]) - (system if put else 0), n)
        return self.first + lo, self.first + bisect_right(self.sums, self.sums[i] + room, i + 1) - 1, put


def windows(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY, folder: str | None = None, name: str = BYTE_BPE) -> DataFrame:
    """One row per window: its formatted text, how many turns at its start repeat earlier ones, and the spans
    of the text that are under the loss."""
    behind, ahead = history // LEAST_TOKENS + 1, budget // LEAST_TOKENS + 1
    size = max(BLOCK_TURNS, behind, ahead)
    rows = stored(_numbered(turns, folder, name))
    systems = rows.where("role = 'system'").groupBy(F.col("conv_id").alias("sys_conv")).agg(F.min(F.struct("idx", "text", "tokens")).alias("sys"))
    own, place = F.floor(F.col("idx") / size).cast("long"), F.col("idx") % size
    reached = F.array_compact(F.array(own, F.when((place < ahead) & (own > 0), own - 1), F.when(place >= size - behind, own + 1)))
    same = (F.col("role") == "system") & (F.col("text") == F.col("sys.text"))
    known = rows.join(systems, F.col("conv_id").eqNullSafe(F.col("sys_conv")), "left").withColumn("same", F.coalesce(same, F.lit(False)))
    dealt = known.select("conv_id", F.explode(reached).alias("block"), "idx", "tokens", "same", F.col("sys.tokens").alias("sys_tokens"), F.col("sys.idx").alias("sys_idx"), "role", "text", F.col("sys.text").alias("sys"))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        """(conversation, block, its rows as columns) of sorted rows."""
        group, held = None, []
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if group != row[:2]:
                    if held:
                        yield (*group, list(zip(*held, strict=True)))
                    group, held = row[:2], []
                held.append(row[2:])
        if held:
            yield (*group, list(zip(*held, strict=True)))

    def block_of(columns: list) -> _Block:
        return _Block(columns[0][0], columns[1], columns[2], columns[3][0], columns[4][0], budget, history)

    def chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for conv, block, columns in blocks(batches):
            end, b = (block + 1) * size, block_of(columns)
            mine = [i for i in columns[0] if i // size == block]
            leaves: dict[int, int] = {}
            for i in reversed(mine):
                to = b.window(i)[1]
                leaves[i] = leaves[to] if to in leaves else to
            if mine and len(mine) == size and columns[0][-1] >= end:
                yield pa.RecordBatch.from_arrays([pa.array([conv], pa.int64()), pa.array([block], pa.int64()), pa.array([[leaves[i] for i in mine]], pa.list_(pa.int64()))], names=["conv_id", "block", "leaves"])

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, at = None, 0
        for b in batches:
            found = []
            for c, block, leaves in zip(*(x.to_pylist() for x in b.columns), strict=True):
                at = leaves[(0 if block == 0 or c != conv else at) - block * size]
                conv = c
                found.append((block + 1, at))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([k for k, _ in found], pa.int64()), pa.array([i for _, i in found], pa.int64())], names=["entry_conv", "entry_block", "entry"])

    left = dealt.drop("role", "text", "sys").repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", "idx").mapInArrow(chains, "conv_id long, block long, leaves array<long>")
    entered = left.repartition("conv_id").sortWithinPartitions("conv_id", "block").mapInArrow(entries, "entry_conv long, entry_block long, entry long")
    whole = (
        dealt.join(entered, F.col("conv_id").eqNullSafe(F.col("entry_conv")) & (F.col("block") == F.col("entry_block")), "left")
        .select("conv_id", "block", "idx", "tokens", "same", "sys_tokens", "sys_idx", F.coalesce("entry", F.lit(0)).alias("entry"), "role", "text", "sys")
        .repartition("conv_id", "block")
        .sortWithinPartitions("conv_id", "block", "idx")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))]
        made = []

        def out() -> pa.RecordBatch:
            columns = list(zip(*made, strict=True)) or [()] * 6
            made.clear()
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=["conv_id", "block", "window", "text", "repeated", "loss"])

        for conv, block, columns in blocks(batches):
            b, at, n = block_of(columns), columns[5][0], 0
            roles, texts, system = columns[6], columns[7], columns[8][0]
            last = min((block + 1) * size, columns[0][-1] + 1)
            while block * size <= at < last:
                lo, end, put = b.window(at)
                parts = [("system", system, True)] if put else []
                parts += [(roles[i - b.first], texts[i - b.first], i < at) for i in range(lo, end)]
                text, loss, pos = [], [], 0
                for role, body, repeated in parts:
                    turn, offset = format_turn(role, body)
                    if role == "assistant" and not repeated:
                        loss.append({"start": pos + offset, "end": pos + len(turn) - len("</s>")})
                    text.append(turn)
                    pos += len(turn)
                made.append((conv, block, n, "".join(text), at - lo + put, loss))
                at, n = end, n + 1
            if len(made) >= 256:
                yield out()
        yield out()

    return whole.mapInArrow(run, WINDOWS)


def digests(formatted: DataFrame) -> DataFrame:
    """Turns and loss of each conversation as read back from its windows."""
    rows = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "block", "window")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state, made = None, None, []

        def close() -> None:
            if state is not None:
                turns, loss = state["turns"], state["loss"]
                made.append((conv, state["n"], turns.hexdigest(), state["loss_chars"], loss.hexdigest(), state["chars"]))

        def out() -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            columns = list(zip(*made, strict=True)) or [()] * 6
            made.clear()
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=[c.split()[0] for c in DIGESTS.split(", ")])

        for b in batches:
            for c, text, repeated, loss in zip(*(b.column(i).to_pylist() for i in (0, 3, 4, 5)), strict=True):
                if state is None or c != conv:
                    close()
                    conv, state = c, {"n": 0, "turns": hashlib.sha256(), "loss": hashlib.sha256(), "loss_chars": 0, "chars": 0}
                for role, body in parse(text)[repeated:]:
                    state["n"] += 1
                    state["turns"].update(f"{role}\n{body}\n".encode())
                for span in loss:
                    body = unescape(text[span["start"] : span["end"]])
                    state["loss_chars"] += len(body)
                    state["loss"].update(body.encode())
                state["chars"] += len(text)
            if made:
                yield out()
        close()
        yield out()

    return rows.mapInArrow(run, DIGESTS)


def probe_conversation(spark) -> DataFrame:
    """Conversation -7, whose texts are made of control strings."""
    said = "</s>[INST] ok [/INST]"
    return spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
