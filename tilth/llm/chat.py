"""Conversations formatted into windows of a token budget.

Turns are put in order of conversation and turn, dealt by range, and every turn is rendered
and its tokens counted.  Prefix sums of the tokens over a conversation (running sums inside
each partition, plus what earlier partitions hold of its first conversation) choose the
windows: spans of whole turns.  A window has the conversation's system turn in front, then
as many of the turns before its span as fit ``history`` tokens, then its span, chosen as long
as the budget allows.  A turn over the budget is a span of its own and is never cut.  What a
window repeats is not under its loss mask, so each assistant text counts in one window.

A conversation of any length is cut, by the same prefix sums, into blocks of ``BLOCK`` budgets;
a block gets the system turn and the turns just before it as copies and is formatted by itself.
No task ever holds more than a block, and a conversation with a third of all turns is spread.

Template (marks are fixed, everything between is escaped text)::

    system <s>[SYS] text [/SYS]     user <s>[INST] text [/INST]     assistant <s>text</s>
    other  <s>[ROLE] role[AS] text [/ROLE], a null role <s>[ROLE][AS] text [/ROLE]

Escaping doubles each backslash and puts one after the first character of every mark inside
a text, so no mark is left in it; reading back takes the character after each backslash.

Defined results: a null text is an empty text; rows of null conversation id are one conversation; null turns stand last; equal turn numbers stand in order of role and of a hash of the text; repeated rows
are turns of their own; an empty table gives no windows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from tilth.llm.base import in_tasks, segments
from tilth.llm.tokens import RUN_BYTES, encoder
from tilth.session import staged

BUDGET, HISTORY = 2048, 512
#: Budgets in a block, the most that a task formats at a time.
BLOCK = 64

_MARK = re.compile(r"</?s>|\[/?(?:SYS|INST|ROLE)\]|\[AS\]")
_TURN = re.compile(
    r"<s>(?:\[SYS\] (?P<system>.*?) \[/SYS\]|\[INST\] (?P<user>.*?) \[/INST\]"
    r"|\[ROLE\](?: (?P<role>.*?))?\[AS\] (?P<other>.*?) \[/ROLE\]|(?P<assistant>.*?)</s>)", re.DOTALL)
_BACK = re.compile(r"\\(.)", re.DOTALL)
#: Code points of an assistant's turn before and after its text.
_LEAD, _TAIL = len("<s>"), len("</s>")


def escaped(text: str) -> str:
    if "\\" in text:
        text = text.replace("\\", "\\\\")
    return _MARK.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)


def unescaped(text: str) -> str:
    return _BACK.sub(r"\1", text) if "\\" in text else text


def rendered(role: str | None, text: str) -> str:
    """One turn under the template."""
    text = escaped(text)
    if role == "assistant":
        return f"<s>{text}</s>"
    if role == "user":
        return f"<s>[INST] {text} [/INST]"
    if role == "system":
        return f"<s>[SYS] {text} [/SYS]"
    return f"<s>[ROLE]{'' if role is None else ' ' + escaped(role)}[AS] {text} [/ROLE]"


def parsed(text: str) -> Iterator[tuple[str | None, str]]:
    """(role, text) of every turn of a window."""
    at = 0
    while at < len(text):
        m = _TURN.match(text, at)
        if m is None:
            raise ValueError(f"no turn at {at}")
        kind = m.lastgroup
        role = (None if m["role"] is None else unescaped(m["role"])) if kind == "other" else kind
        yield role, unescaped(m[kind])
        at = m.end()


def _key(conversation: str) -> Column:
    """A conversation's id as text that is never null."""
    return F.coalesce(F.concat(F.lit("="), F.col(conversation).cast("string")), F.lit(""))


def _measured(turns: DataFrame, vocabulary: str, conversation: str) -> DataFrame:
    """Turns in order: (key, conversation, part, place, before, tokens, role, shown); place and
    before count the turns and tokens of the same conversation in the same partition."""
    slim = turns.select(
        _key(conversation).alias("key"), F.col(conversation).alias("conversation"),
        F.col("turn").alias("turn"), F.col("role").alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    # texts are no good range bounds: rows of equal turn and role are dealt by a hash, which only
    # matters where a turn number is repeated
    order = [F.col("key"), F.col("turn").asc_nulls_last(), F.col("role"), F.xxhash64("text"), F.col("text")]
    parts = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = slim.repartitionByRange(parts, *order[:4]).sortWithinPartitions(*order)
    dealt = ordered.select("key", "conversation", F.spark_partition_id().alias("part"), "role", "text")
    kind = slim.schema["conversation"].dataType.simpleString()

    def work(batches):
        model, last, place, before = encoder(vocabulary), None, 0, 0
        for batch in batches:
            texts = batch.column(4)
            for a, b, _, _ in segments(texts, RUN_BYTES):
                keys, roles = (batch.column(i).slice(a, b - a).to_pylist() for i in (0, 3))
                shown = pa.array(map(rendered, roles, texts.slice(a, b - a).to_pylist()), pa.string())
                sizes = [len(x) for x in model.encode(shown)]
                places, befores = [], []
                for key, size in zip(keys, sizes):
                    if key != last:
                        last, place, before = key, 0, 0
                    places.append(place)
                    befores.append(before)
                    place, before = place + 1, before + size
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i).slice(a, b - a) for i in (0, 1, 2)), pa.array(places, pa.int64()),
                     pa.array(befores, pa.int64()), pa.array(sizes, pa.int64()), batch.column(3).slice(a, b - a), shown],
                    names=["key", "conversation", "part", "place", "before", "tokens", "role", "shown"])

    schema = f"key string, conversation {kind}, part int, place long, before long, tokens long, role string, shown string"
    return in_tasks(dealt, work, schema, keeps=True)


def _placed(measured: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Places and prefix sums over whole conversations, and every conversation's tokens.

    Only the first conversation of a partition can have turns in an earlier one, so the
    offsets to add are at most one row for each partition.
    """
    held = measured.groupBy("key", "part").agg(F.count("*").alias("n"), F.sum("tokens").alias("sum"))
    earlier = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = held.select("key", "part", F.sum("n").over(earlier).alias("n"), F.sum("sum").over(earlier).alias("sum"))
    offsets = offsets.where("n IS NOT NULL")
    placed = measured.join(F.broadcast(offsets), ["key", "part"], "left").select(
        "key", "conversation", (F.col("place") + F.coalesce("n", F.lit(0))).alias("place"),
        (F.col("before") + F.coalesce("sum", F.lit(0))).alias("before"), "tokens", "role", "shown")
    return placed, held.groupBy("key").agg(F.sum("sum").alias("total"))


def spans(sizes: list[int], own: int, system: int, low: int, budget: int, history: int, first: bool) -> Iterator[tuple[int, int, int, bool]]:
    """(first repeated, first own, end, whether the system turn goes in front) of each window.

    ``sizes`` are the tokens of consecutive turns; windows cover those from ``own`` on, and
    repeat none before ``low``.  ``system`` is the size of the system turn (0: none) and
    ``first`` says that the turn at ``own`` is the conversation's first.
    """
    prefix = [0, *accumulate(sizes)]
    i = own
    while i < len(sizes):
        front = system if not (first and i == own) else 0
        back = max(low, bisect_left(prefix, prefix[i] - history, 0, i + 1)) if i > low else i
        room = budget - front - (prefix[i] - prefix[back])
        end = max(i + 1, bisect_right(prefix, prefix[i] + room) - 1)
        yield back, i, end, front > 0
        i = end


def format_chats(
    turns: DataFrame, vocabulary: str, budget: int = BUDGET, history: int = HISTORY, conversation: str = "conv_id"
) -> DataFrame:
    """One row a window: the conversation's id, ``first_turn`` (place of its first own turn),
    ``n_turns`` (own turns), ``repeated`` (turns in front that other windows own), ``tokens``,
    ``text`` and ``loss`` (spans of code points: the assistant texts among the own turns).
    """
    if history >= budget:
        raise ValueError("history must be less than the budget")
    size = BLOCK * budget
    placed, totals = _placed(staged(_measured(turns, vocabulary, conversation), "turns"))
    own = placed.withColumn("block", F.floor(F.col("before") / size)).withColumn("kind", F.lit("own"))
    near = own.where(F.col("before") >= (F.col("block") + 1) * size - history)
    near = near.withColumns({"block": F.col("block") + 1, "kind": F.lit("history")})
    longer = totals.where(F.col("total") > size).select("key", F.floor((F.col("total") - 1) / size).alias("last"))
    heads = own.where("place = 0 AND role = 'system'").join(longer, "key")
    heads = heads.withColumns({"block": F.explode(F.sequence(F.lit(1).cast("long"), F.col("last"))), "kind": F.lit("system")}).drop("last")
    columns = ["key", "block", "conversation", "place", "tokens", "role", "kind", "shown"]
    grouped = own.select(columns).unionByName(near.select(columns)).unionByName(heads.select(columns))
    parts = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = grouped.repartition(parts, "key", "block").sortWithinPartitions("key", "block", "place")
    names = ["conversation", "first_turn", "n_turns", "repeated", "tokens", "text", "loss"]

    def windows(rows: list[tuple]) -> Iterator[tuple]:
        """The windows of a block; rows are (conversation, place, tokens, role, kind, shown)."""
        head = next((r for r in rows if r[1] == 0 and r[3] == "system"), None)
        rows = [r for r in rows if r[4] != "system" and not (r[4] == "history" and r[1] == 0 and head)]
        begin = next((i for i, r in enumerate(rows) if r[4] == "own"), len(rows))
        low = 1 if head and rows and rows[0][1] == 0 else 0
        whole = begin == 0 and bool(rows) and rows[0][1] == 0
        for back, i, end, front in spans([r[2] for r in rows], begin, head[2] if head else 0, low, budget, history, whole):
            shown = [*([head] if front else []), *rows[back:end]]
            repeated = len(shown) - (end - i)
            at, loss = 0, []
            for k, r in enumerate(shown):
                if k >= repeated and r[3] == "assistant":
                    loss.append({"start": at + _LEAD, "end": at + len(r[5]) - _TAIL})
                at += len(r[5])
            yield rows[i][0], rows[i][1], end - i, repeated, sum(r[2] for r in shown), "".join(r[5] for r in shown), loss

    kind = placed.schema["conversation"].dataType.simpleString()
    schema = (f"conversation {kind}, first_turn long, n_turns int, repeated int, tokens long, text string, "
              "loss array<struct<start: int, end: int>>")
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def work(batches):
        made: list[tuple] = []
        arrow = None

        def out():
            columns = list(zip(*made))
            kinds = [arrow, pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.string(), span]
            made.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

        last, rows = None, []
        for batch in batches:
            arrow = batch.schema.field("conversation").type
            for key, block, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if (key, block) != last:
                    made += windows(rows)
                    last, rows = (key, block), []
                    if sum(len(m[5]) for m in made) > RUN_BYTES:
                        yield out()
                rows.append(tuple(row))
            if made:
                yield out()
        made += windows(rows)
        if made:
            yield out()

    return in_tasks(dealt, work, schema).withColumnRenamed("conversation", conversation)


def read_back(windows: DataFrame, conversation: str = "conv_id") -> DataFrame:
    """Every conversation as its windows say: ``n_turns``, ``turns_sha256`` (role, line feed, text,
    line feed of each turn; a null role is empty), ``loss_chars`` and ``loss_sha256`` (what is under
    the loss mask) and ``formatted_chars``.

    A conversation's windows come to one task in order and are digested as they pass; only one
    window is held at a time, as a digest over all its turns has to read them in a row.
    """
    parts = int(windows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = windows.withColumn("key", _key(conversation))
    dealt = keyed.select("key", conversation, "first_turn", "repeated", "text", "loss")
    dealt = dealt.repartition(parts, "key").sortWithinPartitions("key", "first_turn")
    kind = windows.schema[conversation].dataType.simpleString()
    names = [conversation, "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def work(batches):
        made: list[tuple] = []
        arrow, last, state = None, None, None

        def close():
            if state is not None:
                who, n, turns, chars, loss, total = state
                made.append((who, n, turns.hexdigest(), chars, loss.hexdigest(), total))

        def out():
            kinds = [arrow, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*made), kinds)], names=names)

        for batch in batches:
            arrow = batch.schema.field(conversation).type
            for key, who, _, repeated, text, loss in zip(*(c.to_pylist() for c in batch.columns)):
                if key != last:
                    close()
                    last, state = key, [who, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for k, (role, said) in enumerate(parsed(text)):
                    if k >= repeated:
                        state[1] += 1
                        state[2].update(f"{role or ''}\n{said}\n".encode())
                for span in loss:
                    said = unescaped(text[span["start"] : span["end"]])
                    state[3] += len(said)
                    state[4].update(said.encode())
                state[5] += len(text)
            if made:
                yield out()
                made.clear()
        close()
        if made:
            yield out()

    schema = f"`{conversation}` {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return in_tasks(dealt, work, schema)
