"""Rebuilding conversations from message rows.

Rows of a conversation are put in order along their parents or, where they have
none, by time or number; those a user or an assistant visibly speaks are its
turns. Conversations that are broken, empty or leave a message without a reply
are dropped. A conversation of up to ``task_rows`` rows is rebuilt inside a
task; a larger one across tasks, by pointers that double their reach with each
round, so that one conversation may hold any part of the table.

The method's splitting at inactivity gaps is kept as a mark: the length of a gap
that ends a session is calibrated on the histogram of all gaps, and the turns
that follow such a gap are marked. Conversations aren't cut there.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataloom.operators.current import current_rows
from strataloom.operators.ranking import positions
from strataloom.scratch import materialize

# Spellings of the two speakers, in lower case, and content that isn't said to the other side.
SPEAKERS = {
    "user": ["user", "human", "prompter", "customer", "person", "me"],
    "assistant": ["assistant", "ai", "model", "bot", "chatbot", "gpt", "chatgpt", "claude", "agent"],
}
HIDDEN_CONTENT = ["thoughts", "reasoning_recap", "user_editable_context", "model_editable_context"]
_BLANK = r"(?U)^[\s\x1c-\x1f]*$"


@dataclass(frozen=True)
class ConversationConfig:
    """``task_rows``: rows of a conversation that one task may hold. ``default_gap``: seconds, where no gaps are known."""

    task_rows: int = 20_000
    default_gap: float = 1800.0


def seconds(time: Column) -> Column:
    """Epoch seconds of seconds or milliseconds; null for what is no number."""
    t = F.when(~F.isnan(time), time)
    return F.when(F.abs(t) >= 1e11, t / 1000).otherwise(t)


def speaker(role: Column) -> Column:
    key = F.lower(F.regexp_replace(role, r"(?U)^\s+|\s+$", ""))
    return reduce(lambda c, kv: c.when(key.isin(kv[1]), kv[0]), SPEAKERS.items(), F.when(F.lit(False), F.lit("")))


def message_rows(turns: DataFrame) -> DataFrame:
    """Current rows, narrow: conversation_id, node_id, parent, at, speaker (null: no turn), number (of flat-<number>)."""
    hidden = F.coalesce(F.lower(F.try_variant_get(F.try_parse_json("metadata"), "$.is_visually_hidden_from_conversation", "string")) == "true", F.lit(False))
    visible = (
        ~F.coalesce(F.col("text").rlike(_BLANK), F.lit(True))
        & F.coalesce(F.col("recipient").isin("", "all"), F.lit(True))
        & ~F.coalesce(F.col("content_type").isin(HIDDEN_CONTENT), F.lit(False))
        & ~hidden
    )
    return current_rows(
        turns,
        ["conversation_id", "node_id"],
        [
            F.when(F.col("parent") != "", F.col("parent")).alias("parent"),
            seconds(F.col("create_time")).alias("at"),
            F.when(visible, speaker(F.col("role"))).alias("speaker"),
            F.regexp_extract("node_id", r"^flat-(\d{1,18})$", 1).alias("number"),
        ],
    ).withColumn("number", F.when(F.col("number") != "", F.col("number").cast("long")))


def _small(lists: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in lists:
        out = []
        for conversation, current, rows in batch.itertuples(index=False):
            path = path_of(rows, current)
            turns = [(r["node_id"], r["speaker"], r["at"]) for r in path or () if r["speaker"]]
            if answered([t[1] for t in turns]):
                out.extend((conversation, k, node, who, at) for k, (node, who, at) in enumerate(turns))
        yield pd.DataFrame(out, columns=["conversation_id", "turn_pos", "node_id", "speaker", "at"])


def _time_key(r: dict) -> tuple:
    return (r["at"] is not None, r["at"] or 0.0, r["node_id"])


def path_of(rows: list[dict], current: str | None) -> list[dict] | None:
    """The rows of a conversation's path in order; None if it is broken."""
    if not any(r["parent"] for r in rows):
        if all(r["number"] is not None for r in rows):
            return sorted(rows, key=lambda r: (r["number"], r["node_id"]))
        return sorted(rows, key=_time_key)
    by = {r["node_id"]: r for r in rows}
    if current not in by:
        parents = {r["parent"] for r in rows}
        leaves = [r for r in rows if r["node_id"] not in parents]
        if not leaves:
            return None
        current = max(leaves, key=_time_key)["node_id"]
    path, seen = [], set()
    while current is not None:
        if current not in by or current in seen:
            return None
        seen.add(current)
        path.append(by[current])
        current = by[current]["parent"]
    return path[::-1]


def answered(speakers: list[str]) -> bool:
    if not speakers or speakers[0] != "user":
        return False
    return all(who != "user" or after == "assistant" for who, after in zip(speakers, [*speakers[1:], None]))


def _large_paths(rows: DataFrame, heads: DataFrame) -> DataFrame:
    """conversation_id, node_id, speaker, at, o1, o2, o3 (the order) of unbroken paths."""
    kinds = rows.groupBy("conversation_id").agg(F.max(F.col("parent").isNotNull()).alias("linked"), F.min(F.col("number").isNotNull()).alias("numbered"), F.count("*").alias("n"))
    kinds = materialize(kinds, "kinds")
    tagged = materialize(rows.join(kinds.drop("n"), "conversation_id"), "tagged")
    number = F.when(F.col("numbered"), F.col("number"))
    out = tagged.where("not linked").select("conversation_id", "node_id", "speaker", "at", number.alias("o1"), F.when(number.isNull(), F.col("at")).alias("o2"), F.col("node_id").alias("o3"))
    most = kinds.where("linked").agg(F.max("n")).first()[0]
    if most is None:
        return out
    mine = tagged.where("linked").drop("linked", "numbered")
    keys = ["conversation_id", "node_id"]
    parents = mine.where("parent is not null").select("conversation_id", F.col("parent").alias("node_id")).distinct()
    leaves = mine.join(parents, keys, "left_anti").groupBy("conversation_id").agg(F.max(F.struct(F.col("at").isNotNull().alias("a"), "at", "node_id"))["node_id"].alias("leaf"))
    named = mine.join(heads.withColumnRenamed("current_node", "node_id"), keys, "left_semi").select("conversation_id", F.col("node_id").alias("named"))
    starts = heads.select("conversation_id").join(leaves, "conversation_id", "left").join(named, "conversation_id", "left")
    starts = starts.select("conversation_id", F.coalesce("named", "leaf").alias("node_id")).where("node_id is not null")
    # jump: the ancestor 2^k steps up; state 'end' above a row without a parent, 'lost' above a missing one.
    here = mine.select("conversation_id", F.col("node_id").alias("parent"), F.lit(True).alias("there"))
    jump = mine.select(*keys, "parent").join(here, ["conversation_id", "parent"], "left")
    jump = materialize(jump.select(*keys, F.when(F.col("there"), F.col("parent")).alias("up"), F.lit(1).cast("long").alias("steps"), (F.col("parent").isNotNull() & F.col("there").isNull()).alias("lost")), "jump")
    path = materialize(starts, "path")
    for _ in range(int(most).bit_length() + 1):
        further = path.join(jump, keys).where("up is not null").select("conversation_id", F.col("up").alias("node_id"))
        path = materialize(path.unionByName(further).distinct(), "path")
        above = jump.select("conversation_id", F.col("node_id").alias("up"), F.col("up").alias("up2"), F.col("steps").alias("steps2"), F.col("lost").alias("lost2"))
        doubled = jump.join(above, ["conversation_id", "up"], "left")
        jump = materialize(doubled.select(*keys, F.col("up2").alias("up"), (F.col("steps") + F.coalesce("steps2", F.lit(0))).alias("steps"), (F.col("lost") | F.coalesce("lost2", F.lit(False))).alias("lost")), "jump")
    # What still leads up is a circle.
    broken = path.join(jump.where("lost or up is not null"), keys, "left_semi").select("conversation_id").distinct()
    good = path.join(broken, "conversation_id", "left_anti").join(jump.select(*keys, "steps"), keys).join(mine.select(*keys, "speaker", "at"), keys)
    return out.unionByName(good.select(*keys, "speaker", "at", F.col("steps").alias("o1"), F.lit(None).cast("double").alias("o2"), F.col("node_id").alias("o3")))


def _large(rows: DataFrame, heads: DataFrame) -> DataFrame:
    spoken = _large_paths(rows, heads).where("speaker is not null")
    placed = materialize(positions(spoken, "conversation_id", ["o1", "o2", "o3"], "turn_pos").select("conversation_id", "turn_pos", "node_id", "speaker", "at"), "placed")
    after = placed.select("conversation_id", (F.col("turn_pos") - 1).alias("turn_pos"), F.col("speaker").alias("after"))
    checked = placed.join(after, ["conversation_id", "turn_pos"], "left")
    wrong = checked.where("(turn_pos = 0 and speaker <> 'user') or (speaker = 'user' and coalesce(after, '') <> 'assistant')")
    return placed.join(wrong.select("conversation_id").distinct(), "conversation_id", "left_anti")


def rebuild(turns: DataFrame, conversations: DataFrame, config: ConversationConfig = ConversationConfig()) -> DataFrame:
    """Turns of the kept conversations: conversation_id, turn_pos (from 0), node_id, speaker (user, assistant), at (epoch seconds).

    Both tables are reduced to their current rows first; rows without a
    conversation or node id are dropped, and columns other than those named in
    :func:`message_rows` are ignored. Times in milliseconds are taken to seconds;
    rows without a time come first where time decides; equal times go by node_id.
    A row of unknown role, blank text or hidden content is no turn but carries
    its place in the path. A conversation without a row in ``conversations`` is
    dropped, as are those whose path lacks a node or runs in a circle.
    Empty tables give an empty result.
    """
    rows = materialize(message_rows(turns), "messages")
    heads = current_rows(conversations, ["conversation_id"], ["current_node"])
    sizes = rows.groupBy("conversation_id").agg(F.count("*").alias("n"))
    large = sizes.where(F.col("n") > config.task_rows).select("conversation_id")
    small = sizes.where(F.col("n") <= config.task_rows).select("conversation_id")
    packed = rows.join(small, "conversation_id", "left_semi").groupBy("conversation_id").agg(F.collect_list(F.struct("node_id", "parent", "at", "speaker", "number")).alias("rows"))
    listed = packed.join(heads, "conversation_id").select("conversation_id", "current_node", "rows")
    schema = "conversation_id string, turn_pos long, node_id string, speaker string, at double"
    out = listed.mapInPandas(_small, schema)
    if large.isEmpty():
        return out
    big_rows = materialize(rows.join(large, "conversation_id", "left_semi").join(heads, "conversation_id", "left_semi"), "large")
    return out.unionByName(_large(big_rows, heads.join(large, "conversation_id", "left_semi")))


def calibrated_gap(kept: DataFrame, default: float) -> float:
    """Seconds of inactivity that end a session: the emptiest power of two above the most frequent one."""
    before = kept.select("conversation_id", (F.col("turn_pos") + 1).alias("turn_pos"), F.col("at").alias("before"))
    gaps = kept.join(before, ["conversation_id", "turn_pos"]).select((F.col("at") - F.col("before")).alias("gap")).where("gap >= 1")
    bins = {r.b: r.n for r in gaps.groupBy(F.floor(F.log2("gap")).cast("int").alias("b")).agg(F.count("*").alias("n")).collect()}  # at most 64 rows
    if not bins:
        return default
    mode = max(bins, key=lambda b: (bins[b], -b))
    above = range(mode + 1, max(bins) + 2)
    return float(2 ** min(above, key=lambda b: (bins.get(b, 0), b)))


def with_sessions(kept: DataFrame, turns: DataFrame, config: ConversationConfig = ConversationConfig()) -> DataFrame:
    """Kept turns with their text and ``new_session``: whether a calibrated gap lies before the turn."""
    kept = materialize(kept, "kept")
    gap = calibrated_gap(kept, config.default_gap)
    before = kept.select("conversation_id", (F.col("turn_pos") + 1).alias("turn_pos"), F.col("at").alias("before"))
    texts = current_rows(turns, ["conversation_id", "node_id"], ["text"])
    out = kept.join(before, ["conversation_id", "turn_pos"], "left").join(texts, ["conversation_id", "node_id"])
    new = (F.col("turn_pos") == 0) | F.coalesce(F.col("at") - F.col("before") >= gap, F.lit(False))
    return out.select("conversation_id", "turn_pos", "node_id", "speaker", "at", "text", new.alias("new_session"))
