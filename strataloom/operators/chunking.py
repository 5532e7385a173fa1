"""Structure-aware chunking of Markdown and of conversations.

Blocks come from a small parser; what follows is Spark: tokens are counted once a
block, blocks are packed by a fold over their counts, and chunks are rows.
Counts add up over joints of white space, so no text is counted again.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataloom.functions.text import strip
from strataloom.functions.tokens import token_count
from strataloom.scratch import materialize


@dataclass(frozen=True)
class ChunkingConfig:
    max_tokens: int = 512
    overlap_tokens: int = 64
    overlap_turns: int = 1

    def __post_init__(self) -> None:
        if self.max_tokens <= 0 or not 0 <= self.overlap_tokens < self.max_tokens or self.overlap_turns < 0:
            raise ValueError("max_tokens > overlap_tokens >= 0 and overlap_turns >= 0 are required")


# Fixed value: one approximate token, as in functions.tokens.
_TOKEN = re.compile(r"[㐀-䶿一-鿿豈-﫿]|[A-Za-z0-9_]+(?:[-./:][A-Za-z0-9_]+)*|[^\s]")
_JOINT = re.compile(r"[-./:]")
# What a line is by itself; the name of the group that matches says it.
_LINE = re.compile(r"(?P<heading>#{1,6})\s+(?P<title>.+?)\s*$|\s*(?P<fence>`{3}|~{3})|(?P<blank>\s*)$|\s*(?P<item>[-*+] |\d+[.)]\s)")


def _fenced(fences: list[tuple[int, str]], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Which of ``n`` lines lie in fences, marks included, and which open one. ``fences``: lines of marks with their marks."""
    inside, opens, at = np.zeros(n, bool), np.zeros(n, bool), -1
    same = {mark: [i for i, m in fences if m == mark] for _, mark in fences}
    for i, mark in fences:
        if i > at:
            later = bisect_right(same[mark], i)
            at = same[mark][later] if later < len(same[mark]) else n - 1
            inside[i : at + 1] = opens[i] = True
    return inside, opens


def parse_blocks(text: str) -> list[tuple[str, list[str], str]]:
    """(text, section path, kind) of each block: heading, code, list, table or text.

    Each line is classified by itself, fences are paired by their marks, and a
    running sum over the lines where something begins numbers the blocks.
    Headings don't count inside fences; a fence ends at the same mark or the end;
    text that a heading or fence cuts off without a blank line is plain text;
    where a heading level is skipped, the path closes up.
    """
    lines = re.split(r"\r\n|\r|\n", text)
    n = len(lines)
    found = [_LINE.match(x) for x in lines]
    kind = np.array([m.lastgroup if m else "other" for m in found], object)
    inside, opens = _fenced([(i, found[i]["fence"]) for i in np.flatnonzero(kind == "fence")], n)
    heading, blank = (kind == "title") & ~inside, (kind == "blank") & ~inside
    # A block begins where a line differs in what it belongs to, at each heading and at each fence.
    part = np.where(inside, 1, np.where(heading, 2, np.where(blank, 3, 0)))
    begins = np.ones(n, bool)
    begins[1:] = (part[1:] != part[:-1]) | heading[1:] | opens[1:]
    starts = np.flatnonzero(begins)
    out: list[tuple[str, list[str], str]] = []
    path: list[str] = []
    for s, e in zip(starts.tolist(), [*starts[1:].tolist(), n]):
        body = "\n".join(lines[s:e]).strip()
        if not body:
            continue
        if part[s] == 2:
            path = [*path[: len(found[s]["heading"]) - 1], found[s]["title"].strip()]
            of = "heading"
        elif part[s] == 1:
            of = "code"
        elif e < n and part[e] != 3:
            of = "text"
        elif (kind[s:e] == "item").all():
            of = "list"
        else:
            of = "table" if e - s > 1 and "|" in lines[s] and "|" in lines[s + 1] else "text"
        out.append((body, path, of))
    return out


def _tokens(text: str) -> int:
    return len(_TOKEN.findall(text))


# Ways to take a text apart, the coarsest first, and what joins the parts again.
_SENTENCE_END = re.compile(r"(?<=[.!?。！？；;])\s*")
_LEVELS = ((str.splitlines, "\n"), (lambda text: [x for part in _SENTENCE_END.split(text) if (x := part.strip())], " "), (str.split, " "))


def _gathered(units: list[str], joint: str, limit: int) -> Iterator[str]:
    """Runs of units of at most ``limit`` tokens, or of one longer unit: cut at running sums of their tokens."""
    sums = np.concatenate([[0], np.cumsum([_tokens(u) for u in units])])
    at = 0
    while at < len(units):
        end = max(at + 1, int(np.searchsorted(sums, sums[at] + limit, side="right")) - 1)
        if run := joint.join(units[at:end]).strip():
            yield run
        at = end


def _cut(word: str, limit: int) -> Iterator[str]:
    """Pieces of a word of more than ``limit`` tokens. A piece ends before a token; or before the first joint of its last token that comes after ``limit`` characters, as the part up to a joint counts one more than the whole."""
    at = 0
    while at < len(word):
        ahead = list(islice(_TOKEN.finditer(word, at), limit + 1))
        end = ahead[limit].start() if len(ahead) > limit else len(word)
        if len(ahead) >= limit and (joint := _JOINT.search(word, max(ahead[limit - 1].start() + 1, at + limit), ahead[limit - 1].end())):
            end = joint.start()
        yield word[at:end]
        at = end


def fit(text: str, limit: int) -> list[str]:
    """Pieces of at most ``limit`` tokens: runs of lines; of longer lines runs of sentences, of longer sentences runs of words; longer words are cut."""
    pieces = [text.strip()] if text.strip() else []
    for apart, joint in _LEVELS:
        if all(len(p) <= limit for p in pieces):  # a token has a character at least
            return pieces
        pieces = [q for p in pieces for q in ([p] if _tokens(p) <= limit else _gathered(apart(p), joint, limit))]
    return [q for p in pieces for q in ([p] if _tokens(p) <= limit else _cut(p, limit))]


def document_blocks(docs: DataFrame, id_col: str, text_col: str, config: ChunkingConfig) -> DataFrame:
    """id, blocks: array of (text, section_path, kind, tokens), each within the limit."""
    limit = config.max_tokens

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            blocks = [[{"text": piece, "section_path": path, "kind": kind} for body, path, kind in parse_blocks(t or "") for piece in fit(body, limit)] for t in b[text_col]]
            yield pd.DataFrame({id_col: b[id_col], "blocks": blocks})

    kind = docs.schema[id_col].dataType.simpleString()
    parsed = docs.select(id_col, text_col).mapInPandas(parse, f"{id_col} {kind}, blocks array<struct<text: string, section_path: array<string>, kind: string>>")
    counted = F.transform("blocks", lambda x: F.struct(x.text.alias("text"), x.section_path.alias("section_path"), x.kind.alias("kind"), token_count(x.text).cast("int").alias("tokens")))
    return parsed.select(id_col, counted.alias("blocks"))


def pack(counts: Column, limit: int, overlap: int) -> Column:
    """Greedy groups of positions: array of (first, last), first reaching back over up to ``overlap`` tokens of the group before.

    A fold over the counts; overlap that would not leave room for the next
    position is given up from its beginning.
    """
    state = F.struct(F.expr("cast(array() as array<struct<first: int, last: int>>)").alias("done"), F.lit(0).alias("first"), F.lit(0).alias("used"))

    def tokens(a: Column, b: Column) -> Column:  # of positions a <= i < b
        return F.when(b > a, F.aggregate(F.slice(counts, a + 1, F.greatest(b - a, F.lit(0))), F.lit(0), lambda s, x: s + x)).otherwise(0)

    def step(s: Column, i: Column) -> Column:
        n = F.element_at(counts, i + 1)
        # The longest suffix within the overlap that leaves room for position i.
        room = F.least(F.lit(overlap), F.lit(limit) - n)
        back = F.aggregate(
            F.when(i > s.first, F.sequence(i - 1, s.first, F.lit(-1))).otherwise(F.expr("cast(array() as array<int>)")),
            F.struct(F.lit(0).alias("k"), F.lit(0).alias("t"), F.lit(overlap > 0).alias("on")),
            lambda a, j: F.when(a.on & (a.t + F.element_at(counts, j + 1) <= room), F.struct((a.k + 1).alias("k"), (a.t + F.element_at(counts, j + 1)).alias("t"), F.lit(True).alias("on"))).otherwise(
                F.struct(a.k.alias("k"), a.t.alias("t"), F.lit(False).alias("on"))
            ),
        )
        full = (i > s.first) & (s.used + n > limit)
        return F.when(full, F.struct(F.concat(s.done, F.array(F.struct(s.first.alias("first"), (i - 1).alias("last")))).alias("done"), (i - back.k).alias("first"), (back.t + n).alias("used"))).otherwise(
            F.struct(s.done.alias("done"), s.first.alias("first"), (s.used + n).alias("used"))
        )

    positions = F.when(F.size(counts) > 0, F.sequence(F.lit(0), F.size(counts) - 1)).otherwise(F.expr("cast(array() as array<int>)"))
    return F.aggregate(positions, state, step, lambda s: F.when(F.size(counts) > 0, F.concat(s.done, F.array(F.struct(s.first.alias("first"), (F.size(counts) - 1).alias("last"))))).otherwise(s.done))


def chunk_id(doc: Column, strategy: str, index: Column, content_hash: Column) -> Column:
    return F.concat(doc, F.lit(":chunk:"), F.substring(F.sha2(F.concat_ws("\n", doc, F.lit(strategy), index.cast("string"), content_hash), 256), 1, 20))


def chunk_documents(docs: DataFrame, id_col: str = "document_id", text_col: str = "content", config: ChunkingConfig = ChunkingConfig()) -> DataFrame:
    """Chunks of every document: id, chunk_id, chunk_index, text, token_count, section_path, block_kinds, overlap_blocks (blocks that the chunk before has too), content_hash. Blank texts give none."""
    strategy = "markdown_structure_v1"
    packed = document_blocks(docs, id_col, text_col, config)
    # The counts as a column of their own: the fold looks at them again and again.
    packed = packed.withColumn("counts", F.transform("blocks", lambda b: b.tokens)).withColumn("groups", pack(F.col("counts"), config.max_tokens, config.overlap_tokens))
    # Cut before the explode: a row then carries its own blocks and not the document's.
    shared = lambda g, i: F.when(i > 0, F.greatest(F.element_at("groups", i).last - g.first + 1, F.lit(0))).otherwise(0)
    cut = packed.select(id_col, F.transform("groups", lambda g, i: F.struct(F.slice("blocks", g.first + 1, g.last - g.first + 1).alias("mine"), shared(g, i).alias("overlap"))).alias("cut"))
    # Outer, then filtered: a plain explode has the optimizer test the array first, and work it out twice.
    rows = cut.select(id_col, F.posexplode_outer("cut").alias("chunk_index", "c")).where("chunk_index is not null").select(id_col, "chunk_index", "c.mine", F.col("c.overlap").alias("overlap_blocks"))
    with_path = F.filter("mine", lambda x: F.size(x.section_path) > 0)
    rows = rows.select(
        id_col, "chunk_index", F.array_join(F.col("mine.text"), "\n\n").alias("text"), F.aggregate("mine", F.lit(0), lambda s, x: s + x.tokens).alias("token_count"),
        F.when(F.size(with_path) > 0, F.element_at(with_path, -1).section_path).otherwise(F.expr("cast(array() as array<string>)")).alias("section_path"), F.array_distinct(F.col("mine.kind")).alias("block_kinds"), "overlap_blocks",
    )
    hashed = rows.withColumn("content_hash", F.sha2("text", 256))
    return hashed.withColumn("chunk_id", chunk_id(F.col(id_col).cast("string"), strategy, F.col("chunk_index"), F.col("content_hash")))


def pack_lines(docs: DataFrame, id_col: str, text_col: str, limit: int = 512) -> DataFrame:
    """Lines packed into groups of at most ``limit`` tokens (a longer line alone): id, chunk_index, n_lines, tokens. All in the JVM."""
    lines = F.split(F.col(text_col), "\n")
    counted = docs.where(F.col(text_col).isNotNull()).select(id_col, F.transform(lines, lambda x: token_count(x).cast("int")).alias("counts"))
    groups = counted.select(id_col, "counts", F.posexplode_outer(pack(F.col("counts"), limit, 0)).alias("chunk_index", "g")).where("chunk_index is not null")
    n = F.col("g.last") - F.col("g.first") + 1
    return groups.select(id_col, "chunk_index", n.alias("n_lines"), F.aggregate(F.slice("counts", F.col("g.first") + 1, n), F.lit(0), lambda s, x: s + x).alias("tokens"))


def render_turn(role: Column, text: Column) -> Column:
    return F.concat(F.lit("## "), F.initcap(role), F.lit("\n\n"), strip(text))


def chunk_conversations(turns: DataFrame, conv: str = "conversation_id", pos: str = "turn_pos", role: str = "speaker", text: str = "text", config: ChunkingConfig = ChunkingConfig()) -> DataFrame:
    """Chunks of whole turns with whole-turn overlap: id, chunk_index, turn_start, turn_end, overlap_pieces, overlap_turns, token_count, text.

    A turn above the limit is cut, each piece under the turn's heading. A
    conversation may be of any size: only the numbers of its pieces pass through
    one task, in order, and their texts come together by chunk.
    """
    limit = config.max_tokens

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for c, p, r, t in b.itertuples(index=False):
                head = f"## {r.title()}"
                for k, piece in enumerate(fit(t or "", limit - _tokens(head))):
                    out.append((c, p, k, f"{head}\n\n{piece}"))
            yield pd.DataFrame(out, columns=["conv", "pos", "part", "piece"])

    pieces = turns.select(conv, pos, role, text).mapInPandas(cut, "conv string, pos long, part int, piece string")
    pieces = materialize(pieces.withColumns({"tokens": token_count(F.col("piece")).cast("int"), "id": F.monotonically_increasing_id()}), "pieces")
    # Equal positions go by the hash of their pieces.
    order = pieces.select("conv", "pos", "part", F.xxhash64("piece").alias("h"), "id", "tokens").repartition("conv").sortWithinPartitions("conv", "pos", "part", "h", "id")
    placed = order.select("conv", "pos", "id", "tokens").mapInArrow(lambda b: pack_turns(b, limit, config.overlap_turns), "conv string, chunk_index int, place int, overlap boolean, id long")
    rows = placed.join(pieces.select("id", "pos", "piece", "tokens"), "id").groupBy("conv", "chunk_index").agg(
        F.min("pos").alias("turn_start"), F.max("pos").alias("turn_end"), F.count_if("overlap").cast("int").alias("overlap_pieces"), F.count_distinct(F.when(F.col("overlap"), F.col("pos"))).cast("int").alias("overlap_turns"), F.sum("tokens").cast("int").alias("token_count"),
        F.array_sort(F.collect_list(F.struct("place", "piece"))).alias("mine"),
    )
    return rows.select(F.col("conv").alias(conv), "chunk_index", "turn_start", "turn_end", "overlap_pieces", "overlap_turns", "token_count", F.array_join("mine.piece", "\n\n").alias("text"))


def pack_turns(batches: Iterator[pa.RecordBatch], limit: int, overlap_turns: int) -> Iterator[pa.RecordBatch]:
    """conv, chunk_index, place, overlap, id of each piece in each chunk, of rows (conv, pos, id, tokens) that come sorted. Only the open chunk is held."""
    held: list[tuple[int, int, int]] = []  # pos, id, tokens
    now, index, used, kept = None, 0, 0, 0
    out: list[tuple] = []

    def close() -> None:
        out.extend((now, index, k, k < kept, x[1]) for k, x in enumerate(held))

    def batch() -> pa.RecordBatch:
        done = pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * 5, (pa.string(), pa.int32(), pa.int32(), pa.bool_(), pa.int64()))], names=["conv", "chunk_index", "place", "overlap", "id"])
        out.clear()
        return done

    for b in batches:
        for c, pos, i, n in zip(*[x.to_pylist() for x in b.columns]):
            if c != now:
                close()
                now, index, used, kept, held = c, 0, 0, 0, []
            if held and used + n > limit:
                close()
                held = [x for x in held if x[0] > held[-1][0] - overlap_turns]
                used = sum(x[2] for x in held)
                if used + n > limit:
                    used, held = 0, []
                index, kept = index + 1, len(held)
            held.append((pos, i, n))
            used += n
        yield batch()
    close()
    yield batch()


def inherited(chunks: DataFrame, docs: DataFrame, id_col: str = "document_id", columns: tuple[str, ...] = ("title", "source", "domain", "project", "security")) -> DataFrame:
    """Chunks with what they take over from their documents: those of ``columns`` that the documents have."""
    return chunks.join(docs.select(id_col, *[c for c in columns if c in docs.columns and c not in chunks.columns]), id_col)


def chunk_all(docs: DataFrame, turns: DataFrame, id_col: str = "document_id", source_type: str = "source_type", text_col: str = "content", conv: str = "conversation_id", pos: str = "turn_pos", role: str = "speaker", text: str = "text", config: ChunkingConfig = ChunkingConfig()) -> DataFrame:
    """Chunks of documents of every source type: conversations by their turns, all else by Markdown structure.

    ``turns``: ``conv`` is the document's id. A conversation without turns is
    chunked by its content (``conversation_fallback``). Turns of no conversation
    document are left out. Ids of documents are unique.
    """
    strategy = "conversation_turn_window_v1"
    is_conversation = F.coalesce(F.col(source_type) == "conversation", F.lit(False))
    talks = docs.where(is_conversation).select(F.col(id_col).alias("_id"))
    with_turns = turns.join(talks, F.col(conv) == F.col("_id"), "left_semi")
    spoken = chunk_conversations(with_turns, conv, pos, role, text, config).withColumnRenamed(conv, id_col).withColumn("content_hash", F.sha2("text", 256))
    spoken = spoken.withColumn("chunk_id", chunk_id(F.col(id_col).cast("string"), strategy, F.col("chunk_index"), F.col("content_hash"))).withColumn("strategy", F.lit(strategy))
    # One pass over the documents: those that have turns leave, the rest are read as Markdown.
    said = with_turns.where(strip(F.col(text)) != "").select(F.col(conv).alias("_id")).distinct()
    rest = docs.join(said, docs[id_col] == F.col("_id"), "left_anti")
    written = chunk_documents(rest.select(id_col, text_col), id_col, text_col, config).withColumn("strategy", F.lit("markdown_structure_v1"))
    fallback = docs.where(is_conversation).select(id_col).withColumn("conversation_fallback", F.lit(True))
    written = written.join(fallback, id_col, "left")
    return written.unionByName(spoken, allowMissingColumns=True).withColumn("conversation_fallback", F.coalesce("conversation_fallback", F.lit(False)))
