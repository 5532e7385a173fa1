"""Encoding of a corpus with a public byte-level BPE vocabulary by merge replay.

The corpus is read once and cut into blocks of bounded text. A block keeps each
document as a list of word numbers and its own list of distinct words. The
distinct words of all blocks are grouped into the corpus's vocabulary of words,
and the merges are replayed over that: an inverted index leads from a pair of
neighbouring symbols to the positions that hold it, pairs come up in rank order,
and a merge touches only the positions listed for its pair and their neighbours.
The ids of the words go back to the blocks by a join, and a block's documents
are put together by array lookups. A word is thus merged once however often the
corpus has it, and no document's text is shuffled.
"""

from __future__ import annotations

import base64
import heapq
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.scratch import materialize

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

# Fixed value: the public pattern that cuts text into words before the merges.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# The same for text of ASCII characters alone, where the standard library's faster engine will do.
ASCII_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+"


@dataclass(frozen=True)
class EncodingConfig:
    """``vocabulary``: a rank file (base64 token, rank). ``block_chars``: text of a block, at most one document more.
    ``replay_words``: distinct words that one replay holds in memory."""

    vocabulary: str = DEFAULT_VOCABULARY
    block_chars: int = 6_000_000
    replay_words: int = 200_000


_BLOCKS = "kind tinyint, block string, doc long, words array<int>, no int, word string"
_BLOCKS_ARROW = pa.schema([("kind", pa.int8()), ("block", pa.string()), ("doc", pa.int64()), ("words", pa.list_(pa.int32())), ("no", pa.int32()), ("word", pa.string())])


def cut_blocks(batches: Iterator[pa.RecordBatch], block_chars: int) -> Iterator[pa.RecordBatch]:
    """Rows of kind 0 (a document as word numbers, with the third column of the batch, if there is one, in ``word``) and, as each block closes, of kind 1 (its distinct words)."""
    import regex

    find_any, find_ascii = regex.compile(WORD_PATTERN).findall, re.compile(ASCII_PATTERN, re.ASCII).findall
    part, seq, size, numbers = TaskContext.get().partitionId(), 0, 0, {}

    def close() -> pa.RecordBatch:
        n = len(numbers)
        return pa.record_batch([pa.array(np.ones(n, np.int8)), pa.array([f"{part}-{seq}"] * n, pa.string()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.list_(pa.int32())), pa.array(np.arange(n, dtype=np.int32)), pa.array(list(numbers), pa.string())], schema=_BLOCKS_ARROW)

    for batch in batches:
        docs, flat, ends, blocks = [], [], [0], []
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            text = text.as_py() or ""
            words = (find_ascii if text.isascii() else find_any)(text)
            give = numbers.setdefault
            flat.extend([give(w, len(numbers)) for w in words])
            ends.append(len(flat))
            docs.append(doc)
            blocks.append(f"{part}-{seq}")
            size += len(text)
            if size >= block_chars:
                yield close()
                seq, size, numbers = seq + 1, 0, {}
        n = len(docs)
        yield pa.record_batch([pa.array(np.zeros(n, np.int8)), pa.array(blocks, pa.string()), pa.array(docs, pa.int64()), pa.ListArray.from_arrays(pa.array(np.array(ends, np.int32)), pa.array(np.array(flat, np.int32))), pa.nulls(n, pa.int32()), batch.column(2) if batch.num_columns > 2 else pa.nulls(n, pa.string())], schema=_BLOCKS_ARROW)
    if numbers:
        yield close()


class Merges:
    """The ranks of a vocabulary, and the merge of a pair of symbols where it has one."""

    def __init__(self, rank_file: bytes):
        self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in rank_file.splitlines() if line.strip())}
        self.spelling = {b: a for a, b in self.ranks.items()}
        self.first = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        self.of_pair: dict[tuple[int, int], int | None] = {}

    def merged(self, a: int, b: int) -> int | None:
        key = (a, b)
        if key not in self.of_pair:
            self.of_pair[key] = self.ranks.get(self.spelling[a] + self.spelling[b])
        return self.of_pair[key]


def replay(words: list[bytes], merges: Merges) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words, one after another, and where each word's ids end."""
    lengths = np.array([len(w) for w in words], np.int64)
    data = np.frombuffer(b"".join(words), np.uint8)
    sym = merges.first[data].tolist()
    n = len(sym)
    left, right = list(range(-1, n - 1)), list(range(1, n + 1))
    ends = np.cumsum(lengths)
    for e, size in zip(ends.tolist(), lengths.tolist()):
        if size:
            right[e - 1] = -1
            left[e - size] = -1
    # The inverted index: pair -> positions of its left symbol, in order.
    where: dict[tuple[int, int], list[int]] = {}
    for i in range(n):
        j = right[i]
        if j >= 0:
            where.setdefault((sym[i], sym[j]), []).append(i)
    queue = [(m, pair) for pair in where if (m := merges.merged(*pair)) is not None]
    heapq.heapify(queue)
    while queue:
        new, pair = heapq.heappop(queue)
        a, b = pair
        for i in where.pop(pair, ()):
            j = right[i]
            if sym[i] != a or j < 0 or sym[j] != b:
                continue  # a neighbour's merge has used one of the two
            sym[i], sym[j] = new, -1
            k = right[i] = right[j]
            if k >= 0:
                left[k] = i
                _list(where, queue, merges, new, sym[k], i)
            h = left[i]
            if h >= 0:
                _list(where, queue, merges, sym[h], new, h)
    out = np.array(sym, np.int32) if n else np.zeros(0, np.int32)
    alive = out >= 0
    counts = np.concatenate([[0], np.cumsum(alive)])[ends] if len(words) else np.zeros(0, np.int64)
    return out[alive], counts


def _list(where: dict, queue: list, merges: Merges, a: int, b: int, at: int) -> None:
    pair = (a, b)
    spots = where.get(pair)
    if spots is None:
        if (m := merges.merged(a, b)) is None:
            return
        where[pair] = [at]
        heapq.heappush(queue, (m, pair))
    else:
        spots.append(at)


def replay_batches(batches: Iterator[pa.RecordBatch], ranks, most: int) -> Iterator[pa.RecordBatch]:
    merges = Merges(ranks.value)
    for batch in batches:
        words = batch.column(0)
        for at in range(0, len(words), most):
            some = words.slice(at, most)
            ids, ends = replay([w.encode() for w in some.to_pylist()], merges)
            yield pa.record_batch([some, pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(ids))], names=["word", "ids"])


def _flat(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    arr = column.combine_chunks()
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.chunk(0) if arr.num_chunks else pa.array([], column.type)
    return arr.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(arr.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)


def put_together(docs: pa.Table, words: pa.Table) -> pa.Table:
    """The ids of a block's documents, by lookups in the ids of its words."""
    order = np.argsort(words.column("no").to_numpy())
    ids, ends = _flat(words.column("ids"))
    starts, sizes = ends[:-1][order], np.diff(ends)[order]
    nos, doc_ends = _flat(docs.column("words"))
    n = sizes[nos] if len(nos) else np.zeros(0, np.int64)
    at = np.concatenate([[0], np.cumsum(n)])
    take = np.arange(at[-1]) - np.repeat(at[:-1], n) + np.repeat(starts[nos] if len(nos) else n, n)
    return pa.table({"doc": docs.column("doc"), "ids": pa.ListArray.from_arrays(pa.array(at[doc_ends].astype(np.int32)), pa.array(ids[take].astype(np.int32)))})


def count_together(docs: pa.Table, words: pa.Table) -> pa.Table:
    sizes = np.zeros(words.num_rows, np.int64)
    sizes[words.column("no").to_numpy()] = words.column("n").to_numpy()
    nos, doc_ends = _flat(docs.column("words"))
    at = np.concatenate([[0], np.cumsum(sizes[nos] if len(nos) else np.zeros(0, np.int64))])
    return pa.table({"doc": docs.column("doc"), "carried": docs.column("carried"), "n_tokens": pa.array(at[doc_ends[1:]] - at[doc_ends[:-1]])})


def _blocks_and_ids(df: DataFrame, doc: str, text: str, config: EncodingConfig, carry: str | None = None) -> tuple[DataFrame, DataFrame]:
    spark: SparkSession = df.sparkSession
    with open(config.vocabulary, "rb") as f:
        ranks = spark.sparkContext.broadcast(f.read())  # a vocabulary file, of fixed size
    most, chars = config.replay_words, config.block_chars
    blocks = materialize(df.select(F.col(doc).cast("long"), F.col(text).cast("string"), *([F.col(carry).cast("string")] if carry else [])).mapInArrow(lambda b: cut_blocks(b, chars), _BLOCKS), "blocks")
    listed = blocks.where("kind = 1").select(F.col("block").alias("home"), "no", "word")
    ids = listed.select("word").distinct().mapInArrow(lambda b: replay_batches(b, ranks, most), "word string, ids array<int>")
    return blocks.where("kind = 0").select("block", "doc", "words", F.col("word").alias("carried")), listed.join(ids, "word").select("home", "no", "ids")


def encode(df: DataFrame, doc: str = "doc_id", text: str = "text", config: EncodingConfig = EncodingConfig()) -> DataFrame:
    """Token ids of every row's text: columns ``doc`` (renamed to its name in ``df``) and ``ids``, an array of int.

    No special tokens are added, and their spellings in a text are ordinary text.
    An empty or null text has the empty list. Every row of ``df`` gives one row,
    repeated and null document ids too; other columns of ``df`` are neither read
    nor returned, so none can clash. Texts of any length are encoded whole. An
    empty table gives an empty result.
    """
    docs, words = _blocks_and_ids(df, doc, text, config)
    out = docs.drop("carried").groupBy("block").cogroup(words.groupBy("home")).applyInArrow(put_together, "doc long, ids array<int>")
    return out.withColumnRenamed("doc", doc)


def count_tokens(df: DataFrame, doc: str = "doc_id", text: str = "text", config: EncodingConfig = EncodingConfig(), carry: str | None = None) -> DataFrame:
    """As :func:`encode`, with the number of ids, ``n_tokens``, in place of the ids, and the string column ``carry`` of each row beside it."""
    docs, words = _blocks_and_ids(df, doc, text, config, carry)
    sizes = words.select("home", "no", F.size("ids").cast("long").alias("n"))
    out = docs.groupBy("block").cogroup(sizes.groupBy("home")).applyInArrow(count_together, "doc long, carried string, n_tokens long").withColumnRenamed("doc", doc)
    return out.withColumnRenamed("carried", carry) if carry else out.drop("carried")
