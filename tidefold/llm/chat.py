"""Chat formatting in budgeted windows: turn-aligned spans, a retained system turn, masked repeats."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate, groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidefold.llm.common import table
from tidefold.llm.tokens import encoder

BUDGET = 1024
#: Turns and tokens of earlier context repeated before a window's own turns.
HISTORY_TURNS = 2
HISTORY_TOKENS = 256
#: Turn numbers of one block; a conversation of any length is formatted block by block.
BLOCK_TURNS = 256

#: The markers of the template.  After each of ``[``, ``<`` and a backslash inside a text comes a
#: backslash, so no marker can occur there.
SYSTEM = ("<<SYS>>", "<</SYS>>")
ASSISTANT = ("<s>", "</s>")
OTHER = ("[INST]", "[/INST]")
_SPECIAL = re.compile(r"[\[<\\]")
_ESCAPED = re.compile(r"([\[<\\])\\")
_TURN = re.compile(r"<<SYS>>(?P<system>.*?)<</SYS>>|<s>(?P<assistant>.*?)</s>|\[INST\](?P<role>.*?)\n(?P<text>.*?)\[/INST\]", re.S)


def escape(text: str) -> str:
    return _SPECIAL.sub(lambda m: m[0] + "\\", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """The marked turn, and where the escaped text lies in it."""
    body = escape(text)
    if role == "assistant":
        head, tail = ASSISTANT
    elif role == "system":
        head, tail = SYSTEM
    else:
        # a line feed in a role becomes "<n", which no escaped text contains
        head, tail = OTHER[0] + escape(role).replace("\n", "<n") + "\n", OTHER[1]
    return head + body + tail, len(head), len(head) + len(body)


def parse_turns(formatted: str) -> list[tuple[str, str]]:
    """``(role, text)`` of all turns of a formatted window."""
    out, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError("a turn marker was expected")
        if m["system"] is not None:
            out.append(("system", unescape(m["system"])))
        elif m["assistant"] is not None:
            out.append(("assistant", unescape(m["assistant"])))
        else:
            out.append((unescape(m["role"].replace("<n", "\n")), unescape(m["text"])))
        at = m.end()
    return out


def plan_windows(tokens: list[int], system: int, context: int = 0, budget: int = BUDGET) -> list[tuple[int, int, int]]:
    """``(history start, first, end)`` of each window over turns ``context ..``.

    Prefix sums of the turn tokens give by bisection the longest span of whole
    turns within what system turn and history leave of the budget.  History is the
    longest run of the turns before the window within both history bounds; it gives
    way to a turn that would not fit beside it.  A turn above the budget is a window
    of its own.  ``system`` counts where the system turn is not among the window's own.
    """
    sums = [0, *accumulate(tokens)]
    out, first = [], context
    while first < len(tokens):
        back = first
        while back > 0 and first - back < HISTORY_TURNS and sums[first] - sums[back - 1] <= HISTORY_TOKENS:
            back -= 1
        while back < first and system + sums[first + 1] - sums[back] > budget:
            back += 1
        end = max(first + 1, bisect_right(sums, sums[back] + max(0, budget - system)) - 1)
        out.append((back, first, end))
        first = end
    return out


_WINDOW = "conv_id {}, block bigint, window int, text string, n_context int, n_turns int, n_tokens bigint, loss_spans array<struct<start:int,end:int>>"


def _format_block(turns: list[tuple[str, str, int]], count) -> Iterator[tuple]:
    """Windows of one block; ``turns`` are (role, text, kind), kind 0: system from before, 1: history, 2: own."""
    system = [t for t in turns if t[2] == 0][:1]
    rest = [t for t in turns if t[2]]
    context = sum(t[2] == 1 for t in rest)
    made = [format_turn(r, x) for r, x, _ in rest]
    tokens = [count(m[0]) for m in made]
    leads = bool(rest) and not system and context == 0 and rest[0][0] == "system"
    if leads:
        system = rest[:1]
    sys_made = [format_turn(r, x) for r, x, _ in system]
    sys_tokens = sum(count(m[0]) for m in sys_made)
    plan = plan_windows(tokens, sys_tokens, context)
    if leads:  # the first window holds the system turn as its own
        head = plan_windows(tokens, 0, 0)[0]
        plan, at = [head], head[2]
        if at < len(tokens):
            plan += [(b + 1, f + 1, e + 1) for b, f, e in plan_windows(tokens[1:], sys_tokens, at - 1)]
    for w, (back, first, end) in enumerate(plan):
        parts = ([] if leads and w == 0 else sys_made) + made[back:end]
        n_context = len(parts) - (end - first)
        spans, at, text = [], 0, []
        for i, (s, a, b) in enumerate(parts):
            j = i - n_context + first
            if i >= n_context and rest[j][0] == "assistant":
                spans.append({"start": at + a, "end": at + b})
            text.append(s)
            at += len(s)
        total = sum(tokens[back:end]) + (0 if leads and w == 0 else sys_tokens)
        yield w, "".join(text), n_context, end - first, total, spans


def format_conversations(
    conversations: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    vocabulary: str | None = None,
) -> DataFrame:
    """One row per window: ``(conv_id, block, window, text, n_context, n_turns, n_tokens, loss_spans)``.

    ``loss_spans`` are code point ranges of ``text`` with the escaped texts of the
    window's own assistant turns; the ``n_context`` leading turns are repeats and
    masked.  Rows are ordered by turn (null first), role and text; null roles and
    texts are empty; a null ``conv_id`` is a conversation of its own; repeated rows
    are turns; no rows give no windows.  Blocks of turn numbers bound what one
    step holds, so one conversation with very many turns is spread over tasks;
    each block gets the turns just before it as history and the system turn.
    """
    kind = conversations.schema[conv_col].dataType.simpleString()
    rows = conversations.select(
        F.col(conv_col).alias("conv_id"),
        F.col(turn_col).cast("bigint").alias("turn"),
        F.coalesce(F.col(role_col), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    ).withColumn("block", F.coalesce(F.floor(F.col("turn") / BLOCK_TURNS), F.lit(-(1 << 62))))
    own = rows.withColumn("kind", F.lit(2))
    history = (
        rows.where(F.pmod("turn", F.lit(BLOCK_TURNS)) >= BLOCK_TURNS - HISTORY_TURNS)
        .withColumn("block", F.col("block") + 1)
        .withColumn("kind", F.lit(1))
    )
    spread = rows.groupBy("conv_id").agg(F.min("block").alias("b0"), F.max("block").alias("b1")).where("b0 < b1").select(F.col("conv_id").alias("c"), "b0")
    same = F.col("conv_id").eqNullSafe(F.col("c"))
    first = (
        rows.join(spread, same & (F.col("block") == F.col("b0")), "inner")
        .groupBy("conv_id")
        .agg(F.min(F.struct("turn", "role", "text")).alias("s"))
        .where("s.role = 'system'")
        .select(F.col("conv_id").alias("c"), F.col("s.turn").alias("turn"), F.col("s.text").alias("text"))
    )
    later = rows.join(spread, same & (F.col("block") > F.col("b0"))).select("conv_id", "block").distinct()
    system = later.join(first, same).select("conv_id", "turn", F.lit("system").alias("role"), "text", "block", F.lit(0).alias("kind"))
    # history for a block without turns of its own would make no window: _format_block yields none
    everything = own.unionByName(history).unionByName(system)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = encoder(vocabulary).count

        id_type = None

        def stream():
            nonlocal id_type
            for b in batches:
                id_type = b.schema.field(0).type
                yield from zip(*(b.column(i).to_pylist() for i in range(5)))

        out: list[tuple] = []
        names = ["conv_id", "block", "window", "text", "n_context", "n_turns", "n_tokens", "loss_spans"]
        types = [None, pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))]

        def flush():
            types[0] = id_type
            batch = pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out), types)], names)
            out.clear()
            return batch

        for (conv, block), group in groupby(stream(), key=lambda r: r[:2]):
            for w in _format_block([(r, t, k) for _, _, k, r, t in group], count):
                out.append((conv, block, *w))
                if len(out) >= 2000:
                    yield flush()
        if out:
            yield flush()

    dealt = everything.repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", "kind", F.asc_nulls_first("turn"), "role", "text")
    return dealt.select("conv_id", "block", "kind", "role", "text").mapInArrow(run, _WINDOW.format(kind))


def read_back(windows: DataFrame) -> DataFrame:
    """What the formatted windows say of each conversation.

    The windows of a conversation meet in order in one task, because its digests
    run over all of its text; they are hashed as they stream by and not gathered.
    """
    kind = windows.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, n_windows bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        done: list[tuple] = []
        id_type = pa.int64()

        def close():
            conv, n, turns, chars, loss, total, k = state
            done.append((conv, n, turns.hexdigest(), chars, loss.hexdigest(), total, k))

        def flush():
            types = [id_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*done), types)], [x.split()[0] for x in schema.split(", ")])

        for b in batches:
            id_type = b.schema.field(0).type
            for conv, text, n_context, spans in zip(*(b.column(i).to_pylist() for i in range(4))):
                if state is None or state[0] != conv:
                    if state is not None:
                        close()
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                for role, body in parse_turns(text)[n_context:]:
                    state[1] += 1
                    state[2].update(f"{role}\n{body}\n".encode())
                for s in spans:
                    target = unescape(text[s["start"] : s["end"]])
                    state[3] += len(target)
                    state[4].update(target.encode())
                state[5] += len(text)
                state[6] += 1
            if len(done) > 2000:
                yield flush()
                done.clear()
        if state is not None:
            close()
        if done:
            yield flush()

    ordered = windows.repartition("conv_id").sortWithinPartitions("conv_id", "block", "window")
    return ordered.select("conv_id", "text", "n_context", "loss_spans").mapInArrow(run, schema)


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nulls, repeated rows and empty tables: as ``format_conversations``; an empty table leaves the added conversation."""
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", probe), (-7, 1, "assistant", probe)], given.schema)
    return read_back(format_conversations(given.unionByName(extra)))
