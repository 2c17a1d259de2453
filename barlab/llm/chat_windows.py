"""Chat formatting in budgeted windows.

A turn is written as `### role`, its text, and `</turn>`, each on lines of its own. Control strings inside a text are
escaped and can be restored exactly. Windows are cut between turns: prefix sums of turn tokens choose the longest span
that fits what the budget leaves after the system turn and the repeated history. Every window holds the conversation's
first system turn, then up to HISTORY_TOKENS of the turns before the span (fewer, without the oldest, where the next
turn would not fit beside them), then the span. The loss mask covers
the text of the span's assistant turns only, so that text repeated as system turn or history is never a target twice.

Turns are dealt out by tiles of TILE turn numbers, so a long conversation is spread over many tasks; windows end at
tile borders, and a tile gets copies of the last turns of the tile before it for its history. A tile's turns are read in order,
with a bounded stretch of turns in memory.

Defined results: null texts and roles count as empty; a null conversation id is a conversation like any other, a null
turn number comes first; equal turn numbers are ordered by role, then by the text as it is written (escaped); repeated rows are repeated turns;
roles other than `assistant` are never targets; a turn that does not fit beside the system turn stands alone with it
(only such windows are marked `over_budget`); rows that repeat one turn number stay in one tile;
extra columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barlab.llm.chunks import ByteEncoder, per_worker
from barlab.llm.common import each_batch, map_batches, stored, tokenizer_path

BUDGET = 1_024
HISTORY_TOKENS, HISTORY_TURNS = 192, 4
TILE = 512
STRETCH = 2_048  # turns of one tile in memory at once

_HEAD, _END = "### ", "\n</turn>\n"
_CONTROL = re.compile(r"\\|###|</turn>")
_ESCAPED = {"\\": "\\\\", "###": "\\h", "</turn>": "\\t"}
_BACK = {"\\\\": "\\", "\\h": "###", "\\t": "</turn>", "\\n": "\n"}
_ESCAPE = re.compile(r"\\[\\htn]")


def escape(text: str) -> str:
    """No control string is left; `unescape` restores the text."""
    return _CONTROL.sub(lambda m: _ESCAPED[m[0]], text)


def unescape(text: str) -> str:
    return _ESCAPE.sub(lambda m: _BACK[m[0]], text)


def turn_text(role: str, text: str) -> str:
    return f"{_HEAD}{escape(role).replace('\n', '\\n')}\n{escape(text)}{_END}"


def text_span(formatted: str, start: int) -> tuple[str, int, int, int]:
    """Role, text start, text end and turn end of the turn that begins at `start`."""
    line = formatted.index("\n", start)
    end = formatted.index(_END, line)
    return unescape(formatted[start + len(_HEAD) : line]), line + 1, end, end + len(_END)


def read_turns(formatted: str) -> Iterator[tuple[str, str, int, int]]:
    """(role, text, start, end) of every turn; start and end are the place of the escaped text."""
    at = 0
    while at < len(formatted):
        role, a, b, at = text_span(formatted, at)
        yield role, unescape(formatted[a:b]), a, b


def spans(tokens: list[int], room: list[int]) -> list[tuple[int, int]]:
    """Turn-aligned spans: from each start the longest one whose tokens fit the room there, at least one turn."""
    sums = [0, *accumulate(tokens)]
    out, at = [], 0
    while at < len(tokens):
        end = max(at + 1, bisect_right(sums, sums[at] + room[at], at + 1) - 1)
        out.append((at, end))
        at = end
    return out


def history_start(tokens: list[int], at: int, limit: int, turns: int) -> int:
    """The first of the turns before `at` that are repeated."""
    start, used = at, 0
    while start > 0 and at - start < turns and used + tokens[start - 1] <= limit:
        start -= 1
        used += tokens[start]
    return start


class _Tile:
    """Windows of one tile's turns, made as turns come in."""

    def __init__(self, key: tuple, system: tuple[str, int] | None, budget: int, history: int, turns: int):
        self.key, self.system = key, system
        self.budget, self.history, self.turns = budget, history, turns
        self.held: list[tuple[str, str, int, bool, bool]] = []  # role, formatted, tokens, new, first system turn
        self.window = 0

    def add(self, turn: tuple[str, str, int, bool, bool]) -> None:
        self.held.append(turn)

    def windows(self, last: bool) -> Iterator[dict]:
        """Finished windows; the last span waits for more turns unless the tile is over."""
        first_new = next((i for i, t in enumerate(self.held) if t[3]), len(self.held))
        own = self.held[first_new:]
        if not own:
            return
        tokens = [t[2] for t in self.held]
        room = []
        starts = []
        for i in range(first_new, len(self.held)):
            begin = history_start(tokens, i, self.history, self.turns)
            used = self.repeated(begin, i)[1]
            while begin < i and used + tokens[i] > self.budget:
                # the oldest repeated turn makes way for the new one
                begin += 1
                used = self.repeated(begin, i)[1]
            starts.append(begin)
            room.append(self.budget - used)
        cut = spans(tokens[first_new:], room)
        if not last:
            cut = cut[:-1]
        for a, b in cut:
            yield self.window_of(first_new + a, first_new + b, starts[a])
        if cut:
            done = first_new + cut[-1][1]
            keep = max(0, done - self.turns)
            self.held = [(r, f, n, False, s) for r, f, n, _, s in self.held[keep:done]] + self.held[done:]

    def repeated(self, begin: int, at: int) -> tuple[list[int], int]:
        """Repeated turns before `at` and the tokens of them and of the system turn."""
        own = [i for i in range(begin, at) if not self.held[i][4]]
        used = sum(self.held[i][2] for i in own)
        return own, used + (self.system[1] if self.system and not self.held[at][4] else 0)

    def window_of(self, a: int, b: int, begin: int) -> dict:
        own, used = self.repeated(begin, a)
        parts = [self.system[0]] if self.system and not self.held[a][4] else []
        parts += [self.held[i][1] for i in own]
        n_repeated = len(parts)
        at, mask = sum(map(len, parts)), []
        for role, formatted, _, _, _ in self.held[a:b]:
            if role == "assistant":
                _, start, end, _ = text_span(formatted, 0)
                mask.append({"start": at + start, "end": at + end})
            parts.append(formatted)
            at += len(formatted)
        n = used + sum(t[2] for t in self.held[a:b])
        self.window += 1
        return {
            "window": self.window - 1,
            "text": "".join(parts),
            "n_repeated": n_repeated,
            "n_turns": b - a,
            "n_tokens": n,
            "over_budget": n > self.budget,
            "loss": mask,
        }


_TURN = "conv_id {kind}, tile long, turn long, role string, formatted string, n_tokens long"


def counted_turns(conversations: DataFrame, tokenizer: str) -> DataFrame:
    """Every turn as formatted text with its token count."""
    path = tokenizer_path(tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in each_batch(batches, 1024):
            texts = [turn_text(r or "", t or "") for r, t in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist())]
            ids = per_worker(ByteEncoder, path).ids(pa.array(texts, pa.string()))
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[:3],
                    pa.array([r or "" for r in batch.column(3).to_pylist()], pa.string()),
                    pa.array(texts, pa.string()),
                    pa.array(np.diff(ids.ends, prepend=0).astype(np.int64)),
                ],
                names=["conv_id", "tile", "turn", "role", "formatted", "n_tokens"],
            )

    turn = F.col("turn").cast("long")
    tile = F.coalesce(F.floor(turn / TILE), F.floor(F.lit(-(2**63) / TILE))).cast("long")
    rows = conversations.select("conv_id", tile.alias("tile"), turn.alias("turn"), "role", "text")
    kind = conversations.schema["conv_id"].dataType.simpleString()
    return map_batches(rows, run, _TURN.format(kind=kind))


def windows(
    conversations: DataFrame,
    budget: int = BUDGET,
    history_tokens: int = HISTORY_TOKENS,
    history_turns: int = HISTORY_TURNS,
    tokenizer: str = "byte_bpe_50k.json",
) -> DataFrame:
    """One row per window: conv_id, tile, window, text, n_repeated, n_turns, n_tokens, over_budget, loss (spans)."""
    turns = stored(counted_turns(conversations, tokenizer), "chat-turns")
    order = F.struct("tile", F.col("turn").isNotNull().alias("numbered"), "turn", "role", "formatted")
    system = turns.filter("role = 'system'").groupBy("conv_id").agg(
        F.min_by(F.struct("tile", "turn", "formatted", "n_tokens"), order).alias("system")
    )
    # the next tile of a conversation gets the last turns of this one; a conversation has few tiles
    tiles = turns.groupBy(F.col("conv_id").alias("_conv"), F.col("tile").alias("_tile")).agg(F.lit(1).alias("_one"))
    following = tiles.select(
        "_conv", "_tile", F.lead("_tile").over(Window.partitionBy("_conv").orderBy("_tile")).alias("_next")
    ).filter("_next is not null")
    last = Window.partitionBy("conv_id", "tile").orderBy(
        F.col("turn").desc_nulls_last(), F.desc("role"), F.desc("formatted")
    )
    tails = (
        turns.join(following, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("tile") == F.col("_tile")))
        .withColumn("_n", F.row_number().over(last))
        .filter(F.col("_n") <= history_turns)
        .select("conv_id", F.col("_next").alias("tile"), "turn", "role", "formatted", "n_tokens", F.lit(False).alias("fresh"))
    )
    rows = turns.withColumn("fresh", F.lit(True)).unionByName(tails)
    # the system turn goes to every tile of its conversation, so that turns meet it by tile and stay spread
    named = system.withColumnRenamed("conv_id", "_named")
    per_tile = tiles.join(named, F.col("_conv").eqNullSafe(F.col("_named"))).select("_conv", "_tile", "system")
    here = F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("tile") == F.col("_tile"))
    rows = rows.join(per_tile, here, "left").drop("_conv", "_tile")
    kind = conversations.schema["conv_id"].dataType.simpleString()
    schema = (
        f"conv_id {kind}, tile long, window long, text string, n_repeated long, n_turns long, n_tokens long, "
        "over_budget boolean, loss array<struct<start:bigint,end:bigint>>"
    )
    arrow_loss = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    types = [None, pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), arrow_loss]
    names = ["conv_id", "tile", "window", "text", "n_repeated", "n_turns", "n_tokens", "over_budget", "loss"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile: _Tile | None = None
        taken = False
        id_type = None

        def batch_of(made: list[dict]) -> pa.RecordBatch:
            rows = [(*tile.key, *(w[n] for n in names[2:])) for w in made]
            columns = list(zip(*rows))
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t or id_type) for c, t in zip(columns, types)], names=names
            )

        for batch in batches:
            id_type = batch.schema.field(0).type
            for conv, at, turn, role, formatted, n, fresh, system in zip(*(c.to_pylist() for c in batch.columns)):
                key = (conv, at)
                if tile is None or tile.key != key:
                    if tile is not None:
                        made = list(tile.windows(True))
                        if made:
                            yield batch_of(made)
                    own = (system["formatted"], system["n_tokens"]) if system else None
                    tile = _Tile(key, own, budget, history_tokens, history_turns)
                    taken = False
                # the conversation's system turn itself, met once in its own tile
                is_system = bool(
                    system and fresh and not taken and role == "system"
                    and (system["tile"], system["turn"], system["formatted"]) == (at, turn, formatted)
                )
                if system and not fresh and role == "system" and (system["turn"], system["formatted"]) == (turn, formatted):
                    is_system = True
                taken = taken or (is_system and fresh)
                tile.add((role, formatted, n, fresh, is_system))
                if len(tile.held) >= STRETCH:
                    made = list(tile.windows(False))
                    if made:
                        yield batch_of(made)
        if tile is not None:
            made = list(tile.windows(True))
            if made:
                yield batch_of(made)

    dealt = rows.repartition("conv_id", "tile").sortWithinPartitions(
        "conv_id", "tile", "fresh", F.col("turn").asc_nulls_first(), "role", "formatted"
    )
    return map_batches(
        dealt.select("conv_id", "tile", "turn", "role", "formatted", "n_tokens", "fresh", "system"), run, schema
    )


def conversation_digest(formatted: DataFrame) -> DataFrame:
    """Read windows back: every turn once and in order, all text under the loss mask, and the sizes.

    A digest needs a conversation's windows in order, so they are sorted within one task and read as a stream.
    """
    kind = formatted.schema["conv_id"].dataType.simpleString()
    schema = (
        f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, "
        "n_windows long"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state, id_type = None, None, None

        def row() -> pa.RecordBatch:
            turns, loss, n, chars, whole, count = state
            values = [conv, n, turns.hexdigest(), chars, loss.hexdigest(), whole, count]
            kinds = [id_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_windows"]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names=names)

        for batch in batches:
            id_type = batch.schema.field(0).type
            for c, text, repeated, mask in zip(*(x.to_pylist() for x in batch.columns)):
                if state is None or c != conv:
                    if state is not None:
                        yield row()
                    conv, state = c, [hashlib.sha256(), hashlib.sha256(), 0, 0, 0, 0]
                for i, (role, own, _, _) in enumerate(read_turns(text)):
                    if i >= repeated:
                        state[0].update(f"{role}\n{own}\n".encode())
                        state[2] += 1
                for m in mask:
                    own = unescape(text[m["start"] : m["end"]])
                    state[1].update(own.encode())
                    state[3] += len(own)
                state[4] += len(text)
                state[5] += 1
        if state is not None:
            yield row()

    dealt = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "tile", "window")
    return map_batches(dealt.select("conv_id", "text", "n_repeated", "loss"), run, schema)


def format_digest(conversations: DataFrame) -> DataFrame:
    """Format all conversations and one more, whose texts hold control strings, and read them back."""
    spark = conversations.sparkSession
    text = r"\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text"
    )
    return conversation_digest(windows(rows.unionByName(more)))
