"""Chat exports: a conversation's JSON with its message graph becomes turns and a document. Expressions of the JVM, but for the walk along the graph."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataloom.functions.text import epoch_to_timestamp, first_nonempty, strip

_MESSAGE = "struct<id: string, author: struct<role: string, name: string>, create_time: double, update_time: double, content: struct<content_type: string, parts: array<string>, text: string, result: string>, metadata: string, recipient: string>"
# What a document keeps of its conversation's other fields.
CONVERSATION_KEYS = ["default_model_slug", "conversation_template_id", "gizmo_id", "gizmo_type", "is_archived", "is_starred", "conversation_origin", "memory_scope", "voice"]
CONVERSATION = f"{', '.join(f'{k} string' for k in CONVERSATION_KEYS)}, id string, conversation_id string, title string, create_time double, update_time double, current_node string, mapping map<string, struct<id: string, parent: string, children: array<string>, message: {_MESSAGE}>>, messages array<{_MESSAGE}>"
HIDDEN = ["thoughts", "reasoning_recap", "user_editable_context", "model_editable_context"]


def _walk(ids: list[str], parents: list[str | None], at: str | None) -> list[int]:
    place, path = {node: i for i, node in enumerate(ids)}, {}
    while (i := place.get(at)) is not None and i not in path:
        path[i] = None
        at = parents[i]
    return list(path)[::-1]


def active_path(ids: Column, parents: Column, current: Column) -> Column:
    """Places in ``ids`` (from 0) of the nodes from the root to ``current``: parents are followed up to a missing node or one seen before. Time grows with the nodes, not with their square, as a fold over a map would."""

    @F.pandas_udf("array<int>")
    def path(ids: pd.Series, parents: pd.Series, current: pd.Series) -> pd.Series:
        return pd.Series([_walk(*row) for row in zip(ids, parents, current)], dtype=object)

    return path(ids, parents, current)


def latest_leaf(mapping: Column) -> Column:
    """The childless node of the greatest (create_time, id); any node if none is childless."""
    entries = F.map_entries(mapping)
    leaves = F.filter(entries, lambda e: F.coalesce(F.size(e.value.children), F.lit(0)) == 0)
    chosen = F.when(F.size(leaves) > 0, leaves).otherwise(entries)
    return F.array_max(F.transform(chosen, lambda e: F.struct(F.coalesce(e.value.message.create_time, F.lit(float("-1e300"))).alias("t"), e.key.alias("id"))))["id"]


# What is kept of an asset and of a message's metadata.
ASSET_SIZES = ["size_bytes", "width", "height"]
METADATA_KEYS = ["model_slug", "message_type", "finish_details", "attachments", "content_references", "citations"]


def _part(part: Column) -> tuple[Column, Column, Column]:
    """(own text, content type, pointer) of a JSON part; its text is null if it has none."""
    field = lambda name: F.get_json_object(part, f"$.{name}")
    own = F.when(~part.startswith("{"), part).otherwise(first_nonempty(field("text"), field("content")))
    return own, F.coalesce(F.nullif(field("content_type"), F.lit("")), F.lit("unknown")), first_nonempty(field("asset_pointer"), field("image_asset_pointer"), field("file_id"))


def part_text(part: Column) -> Column:
    """A text part as it is; of an object its text, else a placeholder of its asset: image before audio before file."""
    own, kind, pointer = _part(part)
    named = lambda label, other: F.coalesce(F.concat(F.lit(f"[{label}: "), pointer, F.lit("]")), other)
    return (
        F.when(own.isNotNull(), own).when(kind.contains("image"), named("Image", F.lit("[Image]"))).when(kind.contains("audio"), named("Audio", F.lit("[Audio]")))
        .when(kind.contains("file") | pointer.isNotNull(), named("File", F.concat(F.lit("[File: "), kind, F.lit("]")))).otherwise(F.concat(F.lit("[Unsupported content: "), kind, F.lit("]")))
    )


def part_assets(parts: Column) -> Column:
    """array<struct<content_type, pointer, size_bytes, width, height>> of the parts that are images, sounds or files; empty for null."""

    def asset(part: Column) -> Column:
        own, kind, pointer = _part(part)
        sizes = [F.get_json_object(part, f"$.{c}").try_cast("long").alias(c) for c in ASSET_SIZES]
        is_asset = own.isNull() & (kind.contains("image") | kind.contains("audio") | kind.contains("file") | pointer.isNotNull())
        return F.when(is_asset, F.struct(kind.alias("content_type"), pointer.alias("pointer"), *sizes))

    none = F.expr("cast(array() as array<struct<content_type: string, pointer: string, size_bytes: bigint, width: bigint, height: bigint>>)")
    return F.coalesce(F.filter(F.transform(parts, asset), lambda x: x.isNotNull()), none)


def kept_metadata(metadata: Column) -> Column:
    """map<key, value as JSON> of METADATA_KEYS in a message's metadata (JSON); empty for null or what is no object."""
    each = F.map_filter(F.from_json(metadata, "map<string,string>"), lambda k, _: k.isin(METADATA_KEYS))
    return F.coalesce(each, F.expr("cast(map() as map<string, string>)"))


def turns_of(nodes: Column) -> Column:
    """Visible turns of (node id, message) structs, in order."""

    def text(m: Column) -> Column:
        parts = F.array_join(F.filter(F.transform(m.content.parts, lambda p: strip(part_text(p))), lambda t: t != ""), "\n\n")
        return F.coalesce(F.nullif(parts, F.lit("")), first_nonempty(m.content.text, m.content.result), F.lit(""))

    def shown(n: Column) -> Column:
        m = n.message
        hidden = F.coalesce(F.get_json_object(m.metadata, "$.is_visually_hidden_from_conversation") == "true", F.lit(False))
        return m.author.role.isin("user", "assistant") & ~hidden & F.coalesce(m.recipient.isin("", "all"), F.lit(True)) & ~F.coalesce(m.content.content_type.isin(HIDDEN), F.lit(False)) & (strip(text(m)) != "")

    return F.transform(
        F.filter(nodes, lambda n: F.coalesce(shown(n), F.lit(False))),
        lambda n: F.struct(n.node_id.alias("node_id"), n.message.id.alias("message_id"), n.message.author.role.alias("role"), n.message.create_time.alias("create_time"), n.message.content.content_type.alias("content_type"), strip(text(n.message)).alias("text"),
                           part_assets(n.message.content.parts).alias("assets"), kept_metadata(n.message.metadata).alias("metadata")),
    )


def canonical_json(text: Column) -> Column:
    """JSON with sorted keys and no white space, so that equal values are equal texts."""

    @F.pandas_udf("string")
    def sort(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: json.dumps(json.loads(t), sort_keys=True, ensure_ascii=False, separators=(",", ":")), na_action="ignore")

    return sort(text)


def normalize(conversations: DataFrame, column: str = "conversation", keep: tuple[str, ...] = ()) -> DataFrame:
    """One document a conversation JSON: document_id, title, content (the transcript), turns, role counts and node counts, times, diagnostics, fields (a map of
    CONVERSATION_KEYS that are there and not null, as text or JSON), and ``keep``.

    The path leads from current_node, or from the latest leaf where that is no
    node; a conversation without a mapping has its ``messages`` as turns named
    flat-<i>. Conversations without a visible turn are dropped; of several with
    one id the newest stays.
    """
    c = F.from_json(F.col(column), CONVERSATION)
    rows = conversations.select(*keep, F.col(column).alias("_raw"), c.alias("c"))
    mapping = F.coalesce("c.mapping", F.expr(f"cast(map() as map<string, struct<id: string, parent: string, children: array<string>, message: {_MESSAGE}>>)"))
    start = F.when(F.map_contains_key(mapping, F.coalesce("c.current_node", F.lit(""))), F.col("c.current_node")).otherwise(latest_leaf(mapping))
    rows = rows.select(*keep, "_raw", "c", mapping.alias("mapping"), start.alias("start"))
    rows = rows.withColumn("_ids", F.map_keys("mapping")).withColumn("_nodes", F.map_values("mapping"))
    # Both Python steps stand in one projection, below all that is built on them: projections with one each would be merged, and copy the turns into every column.
    walked = active_path(F.col("_ids"), F.transform("_nodes", lambda n: n.parent), F.col("start"))
    rows = rows.select("*", walked.alias("_path"), canonical_json(F.col("_raw")).alias("_canonical"))
    on_path = F.transform("_path", lambda p: F.struct(F.get("_ids", p).alias("node_id"), F.get("_nodes", p).message.alias("message")))
    flat = F.transform("c.messages", lambda m, i: F.struct(F.concat(F.lit("flat-"), i.cast("string")).alias("node_id"), m.alias("message")))
    # Flat messages stand in where the mapping gives no turn.
    rows = rows.withColumn("_graph", turns_of(on_path)).withColumn("turns", F.when(F.size("_graph") > 0, F.col("_graph")).otherwise(turns_of(flat)))
    times = F.transform("turns", lambda t: t.create_time)
    created = F.coalesce("c.create_time", F.array_min(times))
    updated = F.greatest(F.coalesce("c.update_time", F.array_max(times)), created)
    key = F.coalesce(first_nonempty(F.col("c.id"), F.col("c.conversation_id")), F.concat(F.lit("anonymous-"), F.substring(F.sha2("_canonical", 256), 1, 16)))
    content = F.array_join(F.transform("turns", lambda t: F.concat(F.lit("## "), F.initcap(t.role), F.lit("\n\n"), t.text)), "\n\n")
    count = lambda role: F.size(F.filter("turns", lambda t: t.role == role))
    beyond = F.get("_nodes", F.get("_path", F.lit(0))).parent  # of the node that the walk ended at
    seen = F.array_contains(F.transform("_path", lambda p: F.get("_ids", p)), beyond)
    diagnostics = F.array_compact(F.array(
        F.when((F.size("mapping") > 0) & ~F.coalesce(F.map_contains_key("mapping", F.coalesce("c.current_node", F.lit(""))), F.lit(False)), "no_current_node"),
        F.when(seen, "circle"), F.when(beyond.isNotNull() & ~F.array_contains("_ids", F.coalesce(beyond, F.lit(""))), "missing_parent"),
        F.when((F.size("mapping") > 0) & (F.size("_graph") == 0), "flat_messages"),
    ))
    fields = F.map_filter(F.map_from_arrays(F.array(*map(F.lit, CONVERSATION_KEYS)), F.array(*[F.col(f"c.{k}") for k in CONVERSATION_KEYS])), lambda _, v: v.isNotNull())
    out = rows.select(
        F.concat(F.lit("chatgpt:"), key).alias("document_id"), first_nonempty(F.col("c.title"), F.lit("Untitled conversation")).alias("title"), content.alias("content"), F.sha2(content, 256).alias("content_hash"), "turns",
        count("user").alias("user_turns"), count("assistant").alias("assistant_turns"), F.size("mapping").alias("mapping_nodes"), (F.size("mapping") - F.size("_path")).alias("inactive_nodes"),
        epoch_to_timestamp(created).alias("created_at"), epoch_to_timestamp(updated).alias("updated_at"), diagnostics.alias("diagnostics"), fields.alias("fields"), *keep,
    )
    # Those without a turn are left out here: a condition ahead of the shuffle would be pushed below the parsed columns, and parse the JSON again for each node.
    order = F.when(F.size("turns") > 0, F.struct(F.coalesce("updated_at", "created_at"), "content_hash"))
    whole = F.struct(*[x for x in out.columns if x != "document_id"])
    return out.groupBy("document_id").agg(F.max_by(whole, order).alias("d")).where("d is not null").select("document_id", "d.*")
