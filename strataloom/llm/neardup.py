"""Near-duplicate texts by fingerprints in a Gray-ordered hierarchical index.

A text is its set of shingles (hashes of consecutive words). Texts of one set are
a class and take part once. A class's fingerprint is made of 64 min-hashes: some
bits of each of them (a symbol), and one bit of each (the tail). The index holds
a fingerprint in several rotations, each with other symbols in front and the tail
behind, in Gray order: Spark partitions the codes by ranges of their Gray rank
and sorts them, so that codes of one masked pattern of front bits lie together.

In a task the sorted codes are the leaves of a tree: a node above has the range of
patterns below it and the tail's bits that all below agree on. A search of the
tree with itself drops two nodes, and all that lies below them, when they share no
pattern or when the agreed bits differ too often. A pattern that goes on beyond a
run of codes is met again between runs: their nodes are rows of a table, pairs of
nodes are pruned in Spark first by run and then by node, and only the codes under
the pairs that remain are sent. Every candidate comes out of this index, whatever
the size of a pattern; the sets decide.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataloom.operators.current import current_rows, newest_versions, row_version
from strataloom.scratch import materialize

# A word: a character from U+3400 to U+9FFF, or a run of other letters and digits.
WORD_RE = r"[㐀-鿿]|[\p{L}\p{N}&&[^㐀-鿿]]+"


@dataclass(frozen=True)
class NearDupConfig:
    """``rotations`` of ``symbols`` in front: at a similarity of 0.7 all of 20 by 3 miss a pair once in 4,400. ``distance``: of the
    64 bits of the tail, that two fingerprints may differ in; at 0.7 a pair exceeds 21 once in some 20,000, and 64 prunes nothing.
    ``exact``: the front is one shingle of a text's prefix instead (its least shingles, of which texts of this similarity share
    one), and the tail prunes nothing: no pair is missed, and the index has some n (1 - similarity) codes of a text.
    ``run_rows``: codes that a task searches at once; ``node_rows``: codes under a node that is met between runs.
    ``hub_pairs``: candidates of one class that meet one copy of its set. ``filter_bits``: size of the filter that thins the second read
    of the texts. ``block_rows``: members of a class that are paired at once.
    ``expand``: unless None, of more copies than that of one text (byte by byte) each is paired with the least id, and only
    that with other texts; pairs of different texts all come out."""

    words: int = 5
    similarity: float = 0.8
    min_words: int = 1
    rotations: int = 20
    symbols: int = 3
    distance: int = 21
    exact: bool = False
    run_rows: int = 65_536
    node_rows: int = 1024
    hub_pairs: int = 2000
    filter_bits: int = 1 << 26
    block_rows: int = 1000
    expand: int | None = None
    seed: int = 3

    def __post_init__(self) -> None:
        if not 0 < self.rotations * self.symbols <= 64 or self.words < 1 or not 0 < self.similarity <= 1:
            raise ValueError("rotations * symbols is 1 to 64, words 1 or more, similarity above 0 and up to 1")


_MIX = np.uint64(0x9E3779B97F4A7C15)


def word_hashes(text: Column) -> Column:
    """Hashes of a text's words, in order."""
    return F.transform(F.regexp_extract_all(F.lower(text), F.lit(WORD_RE), F.lit(0)), lambda w: F.xxhash64(w))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def shingle_sets(column: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each row, one row after another in order, and their number."""
    flat = column.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    rolled = flat.copy()
    for k in range(1, words):
        rolled[: len(flat) - k] = _mixed(rolled[: len(flat) - k]) * _MIX + flat[k:]
    rolled = _mixed(rolled)
    sets = [np.unique(rolled[e - n : e - words + 1]) if n >= words else rolled[:0] for e, n in zip(ends.tolist(), sizes.tolist())]
    return (np.concatenate(sets) if sets else rolled[:0]), np.array([len(s) for s in sets], np.int64)


def gray_rank(fp: np.ndarray) -> np.ndarray:
    """The place of each code in Gray order."""
    r = fp.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        r ^= r >> np.uint64(shift)
    return r


def sketch_batches(batches: Iterator[pa.RecordBatch], config: NearDupConfig) -> Iterator[pa.RecordBatch]:
    """Columns before ``hashes`` as they are, then n, set1, set2, tail, fronts (nulls for texts too short).

    ``fronts`` has the Gray rank of each rotation's front, ``tail`` that of the tail. The first column is the kind: fronts of different kinds differ.
    """
    rng = np.random.default_rng(config.seed)
    mult = rng.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    add = rng.integers(0, 2**63, 64, dtype=np.uint64)
    least = max(config.min_words, config.words)
    width = 58 // config.symbols  # bits of a symbol; the six above them number the rotation
    for whole in batches:
        for at in range(0, whole.num_rows, 2000):
            b = whole.slice(at, 2000)
            hashes = b.column(b.num_columns - 1)
            long_enough = hashes.value_lengths().fill_null(0).to_numpy(zero_copy_only=False) >= least
            rows = np.flatnonzero(long_enough)
            flat, n = shingle_sets(hashes.take(pa.array(rows)), config.words)
            starts = np.cumsum(n) - n
            m = len(rows)
            kind = np.array([zlib.crc32((k or "").encode()) for k in b.column(0).take(pa.array(rows)).to_pylist()], np.uint64) if m else np.zeros(0, np.uint64)
            mins = np.zeros((64, m), np.uint64)
            if m:
                for k in range(64):
                    mins[k] = np.minimum.reduceat(flat * mult[k] + add[k], starts)
            mins = _mixed(mins * _MIX)
            tail = np.zeros(m, np.uint64)
            for k in range(64):
                tail |= (mins[k] >> np.uint64(63)) << np.uint64(k)
            if config.exact:
                sizes = n - np.ceil(config.similarity * n - 1e-9).astype(np.int64) + 1
                front = flat[np.repeat(starts, sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)] if m else flat
                front = front ^ np.repeat(kind, sizes)
            else:
                sizes = np.full(m, config.rotations, np.int64)
                fronts = np.zeros((m, config.rotations), np.uint64)
                for j in range(config.rotations):
                    code = np.full(m, j, np.uint64)
                    for k in range(j * config.symbols, (j + 1) * config.symbols):
                        code = code << np.uint64(width) | mins[k] & np.uint64((1 << width) - 1)
                    fronts[:, j] = code ^ kind
                front = fronts.ravel()
            set1 = np.add.reduceat(_mixed(flat), starts) if m else tail
            set2 = np.add.reduceat(_mixed(flat * _MIX), starts) if m else tail
            back = np.full(b.num_rows, -1, np.int64)
            back[rows] = np.arange(m)
            take = pa.array(back, mask=back < 0)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(gray_rank(front).view(np.int64)))
            columns = [pa.array(n.astype(np.int32)), *[pa.array(x.view(np.int64)) for x in (set1, set2, gray_rank(tail))], lists]
            yield pa.record_batch([*b.columns[:-1], *[c.take(take) for c in columns]], names=[*b.schema.names[:-1], "n", "set1", "set2", "tail", "fronts"])


class GrayIndex:
    """Codes in order of their front's and their tail's Gray rank, under nodes over ``width`` of them each, and nodes over nodes."""

    def __init__(self, tail: np.ndarray, front: np.ndarray | None = None, width: int = 8):
        front = np.zeros(len(tail), np.int64) if front is None else front
        self.width, self.order = width, np.lexsort((gray_rank(tail), front))
        self.tail, self.front = tail[self.order], front[self.order]
        self.levels: list[tuple[np.ndarray, ...]] = []
        ones, zeros, low, high = self.tail, ~self.tail, self.front, self.front
        while len(ones) > 1:
            starts = np.arange(0, len(ones), width)
            ends = np.minimum(starts + width, len(ones)) - 1
            ones, zeros, low, high = np.bitwise_and.reduceat(ones, starts), np.bitwise_and.reduceat(zeros, starts), low[starts], high[ends]
            self.levels.append((ones | zeros, ones, low, high))  # the mask of agreed bits, the bits, the first and the last front

    def pairs(self, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Positions (in the input) of all pairs of one front whose tails are within ``distance``, in blocks."""
        if not self.levels:
            return
        stack = [(len(self.levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
        step = np.arange(self.width)
        while stack:
            level, a, b = stack.pop()
            if len(a) > 16_384:
                half = len(a) // 2
                stack += [(level, a[:half], b[:half]), (level, a[half:], b[half:])]
                continue
            mask, bits, low, high = self.levels[level]
            meet = (a == b) | (high[a] == low[b])  # in order, so what lies between has that front too
            a, b = a[meet], b[meet]
            apart = np.bitwise_count((bits[a] ^ bits[b]) & mask[a] & mask[b])
            a, b = a[apart <= distance], b[apart <= distance]
            count = len(self.levels[level - 1][0]) if level else len(self.tail)
            i = np.broadcast_to((a[:, None] * self.width + step)[:, :, None], (len(a), self.width, self.width)).ravel()
            j = np.broadcast_to((b[:, None] * self.width + step)[:, None, :], (len(a), self.width, self.width)).ravel()
            there = (j < count) & ((i < j) if level == 0 else (i <= j))
            i, j = i[there], j[there]
            if level:
                stack.append((level - 1, i, j))
                continue
            same = self.front[i] == self.front[j]
            i, j = i[same], j[same]
            near = np.bitwise_count(self.tail[i] ^ self.tail[j]) <= distance
            yield self.order[i[near]], self.order[j[near]]


_FOUND = "a long, b long, front long, run long, node int, tail long, n int"
_NAMES = ["a", "b", "front", "run", "node", "tail", "n"]


def _sized(i: np.ndarray, j: np.ndarray, cid: np.ndarray, n: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Class ids, the smaller first, of the pairs whose sizes allow the similarity."""
    fits = np.minimum(n[i], n[j]) >= similarity * np.maximum(n[i], n[j]) - 1e-9
    x, y = cid[i[fits]], cid[j[fits]]
    return np.minimum(x, y), np.maximum(x, y)


def index_batches(batches: Iterator[pa.RecordBatch], config: NearDupConfig) -> Iterator[pa.RecordBatch]:
    """The candidate pairs (a, b) within each run of the codes (front, tail, cid, n) that come sorted, and the codes of each run's first
    and last front, which other runs may have too: b is null, and node is the code's place in Gray order by ``node_rows``."""
    distance = 64 if config.exact else config.distance
    first_run = TaskContext.get().partitionId() << 32
    runs = 0

    def search(front: np.ndarray, rank: np.ndarray, cid: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        tail = rank ^ (rank >> np.uint64(1))
        none = lambda k, t: pa.nulls(k, t)
        for i, j in GrayIndex(tail, front).pairs(distance):
            a, b = _sized(i, j, cid, n, config.similarity)
            if len(a):
                yield pa.record_batch([pa.array(a), pa.array(b), *[none(len(a), t) for t in (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32())]], names=_NAMES)
        at = np.flatnonzero((front == front[0]) | (front == front[-1]))
        run = np.full(len(at), first_run + runs, np.int64)
        yield pa.record_batch([pa.array(cid[at]), none(len(at), pa.int64()), pa.array(front[at]), pa.array(run), pa.array((at // config.node_rows).astype(np.int32)), pa.array(tail[at].view(np.int64)), pa.array(n[at].astype(np.int32))], names=_NAMES)

    held: list[list[np.ndarray]] = []
    size = 0
    for b in batches:
        for at in range(0, b.num_rows, config.run_rows):
            part = b.slice(at, config.run_rows)
            held.append([part.column(0).to_numpy(), part.column(1).to_numpy().view(np.uint64), part.column(2).to_numpy(), part.column(3).to_numpy()])
            size += part.num_rows
            if size >= config.run_rows:
                yield from search(*[np.concatenate(x) for x in zip(*held)])
                held, size, runs = [], 0, runs + 1
    if size:
        yield from search(*[np.concatenate(x) for x in zip(*held)])


def between_batches(batches: Iterator[pa.RecordBatch], config: NearDupConfig) -> Iterator[pa.RecordBatch]:
    """Candidate pairs between the two sides of each meeting of two nodes, of rows (meeting, side, tail, cid, n) that come sorted."""
    distance = 64 if config.exact else config.distance

    def meet(side: np.ndarray, tail: np.ndarray, cid: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        for at in range(0, len(left), 256):
            some = left[at : at + 256]
            i, j = np.nonzero(np.bitwise_count(tail[some][:, None] ^ tail[right]) <= distance)
            a, b = _sized(some[i], right[j], cid, n, config.similarity)
            if len(a):
                yield pa.record_batch([pa.array(a), pa.array(b)], names=["a", "b"])

    held = None
    for batch in batches:
        now = [batch.column(k).to_numpy() for k in range(5)]
        now = now if held is None else [np.concatenate(x) for x in zip(held, now)]
        if not len(now[0]):
            continue
        cuts = [0, *(np.flatnonzero(np.diff(now[0])) + 1).tolist()]
        for s, e in zip(cuts, cuts[1:]):
            yield from meet(now[1][s:e], now[2][s:e].view(np.uint64), now[3][s:e], now[4][s:e])
        held = [x[cuts[-1] :] for x in now]
    if held is not None and len(held[0]):
        yield from meet(held[1], held[2].view(np.uint64), held[3], held[4])


def _apart(a: str, b: str) -> Column:
    """In how many bits, of those that all codes of either node agree on, two nodes differ."""
    agreed = F.col(f"mask_{a}").bitwiseAND(F.col(f"mask_{b}"))
    return F.bit_count(F.col(f"ones_{a}").bitwiseXOR(F.col(f"ones_{b}")).bitwiseAND(agreed))


def _candidates(classes: DataFrame, config: NearDupConfig) -> DataFrame:
    """Pairs of classes that the index doesn't prune: cid_a, cid_b. ``classes``: cid, fronts, tail, n."""
    codes = classes.select(F.explode("fronts").alias("front"), "tail", "cid", "n")
    ordered = codes.repartitionByRange("front", "tail").sortWithinPartitions("front", "tail", "cid")
    found = materialize(ordered.mapInArrow(lambda b: index_batches(b, config), _FOUND), "index")
    within = found.where("b is not null").select("a", "b")
    # Fronts that more than one run has: their nodes, a level of runs above them, and the pairs of nodes that may hold near codes.
    edge = found.where("b is null").select("front", "run", "node", "tail", F.col("a").alias("cid"), "n")
    several = edge.groupBy("front").agg(F.min("run").alias("x"), F.max("run").alias("y")).where("x < y").select("front")
    edge = materialize(edge.join(several, "front", "left_semi"), "edge")
    agreed = [F.bit_and("tail").alias("ones"), F.bit_and(F.bitwise_not("tail")).alias("zeros")]
    nodes = edge.groupBy("front", "run", "node").agg(*agreed)
    runs = nodes.groupBy("front", "run").agg(F.bit_and("ones").alias("ones"), F.bit_and("zeros").alias("zeros"))

    def side(df: DataFrame, x: str) -> DataFrame:
        masked = df.withColumn("mask", F.col("ones").bitwiseOR(F.col("zeros"))).drop("zeros")
        return masked.select("front", *[F.col(c).alias(f"{c}_{x}") for c in masked.columns if c != "front"])

    distance = 64 if config.exact else config.distance
    met = side(runs, "a").join(side(runs, "b"), "front").where((F.col("run_a") < F.col("run_b")) & (_apart("a", "b") <= distance)).select("front", "run_a", "run_b")
    met = met.join(side(nodes, "a"), ["front", "run_a"]).join(side(nodes, "b"), ["front", "run_b"]).where(_apart("a", "b") <= distance)
    met = materialize(met.select("front", "run_a", "node_a", "run_b", "node_b", F.xxhash64("front", "run_a", "node_a", "run_b", "node_b").alias("meeting")), "met")

    def sent(x: str, number: int) -> DataFrame:
        of = met.select("front", F.col(f"run_{x}").alias("run"), F.col(f"node_{x}").alias("node"), "meeting")
        return edge.join(of, ["front", "run", "node"]).select("meeting", F.lit(number).alias("side"), "tail", "cid", "n")

    both = sent("a", 0).unionByName(sent("b", 1)).repartition("meeting").sortWithinPartitions("meeting")
    between = both.mapInArrow(lambda b: between_batches(b, config), "a long, b long")
    return within.unionByName(between).distinct().select(F.col("a").alias("cid_a"), F.col("b").alias("cid_b"))


def _checked(pairs: DataFrame, sets: DataFrame, config: NearDupConfig) -> DataFrame:
    """Pairs with the Jaccard similarity of their sets, where it is high enough. ``sets``: cid, shingles.

    A class with very many candidates has its set copied, one copy for about ``hub_pairs`` of them.
    """
    parts = pairs.select(F.explode(F.array("cid_a", "cid_b")).alias("cid")).groupBy("cid").agg(F.ceil(F.count("*") / config.hub_pairs).alias("parts"))
    copies = sets.join(parts, "cid").select("cid", "shingles", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))

    def end(x: str) -> DataFrame:  # grows with the data: merged at every size
        return copies.select(F.col("cid").alias(f"cid_{x}"), F.col("part").alias(f"part_{x}"), F.col("shingles").alias(f"shingles_{x}")).hint("merge")

    placed = pairs
    for x, other in ("ab", "ba"):
        placed = placed.join(parts.select(F.col("cid").alias(f"cid_{x}"), F.col("parts").alias(f"of_{x}")), f"cid_{x}").withColumn(f"part_{x}", F.pmod(F.xxhash64(f"cid_{other}"), f"of_{x}"))
    met = placed.select("cid_a", "part_a", "cid_b", "part_b").join(end("a"), ["cid_a", "part_a"]).join(end("b"), ["cid_b", "part_b"])
    both = F.size(F.array_intersect("shingles_a", "shingles_b"))
    judged = met.select("cid_a", "cid_b", (both / (F.size("shingles_a") + F.size("shingles_b") - both)).alias("similarity"))
    return judged.where(F.col("similarity") >= config.similarity - 1e-12)


def _texts_of(deliveries: DataFrame, readers: DataFrame, filter_bits: int) -> DataFrame:
    """Current texts of the few items in ``readers`` with their cid. A bitmap of their ids, of ``filter_bits`` whatever their number, thins the texts before the shuffle."""
    place = F.pmod(F.xxhash64("item_kind", "item_id"), F.lit(filter_bits)) + 1
    bit = F.bitmap_bit_position(place)
    bitmap = readers.groupBy(F.bitmap_bucket_number(place).alias("_bucket")).agg(F.bitmap_construct_agg(bit).alias("_bits"))
    byte = F.conv(F.hex(F.expr("substring(_bits, cast(_bit div 8 as int) + 1, 1)")), 16, 10).cast("int")
    marked = deliveries.withColumns({"_bucket": F.bitmap_bucket_number(place), "_bit": bit}).join(F.broadcast(bitmap), "_bucket")
    maybe = marked.where(byte.bitwiseAND(F.expr("shiftleft(1, cast(_bit % 8 as int))")) != 0).drop("_bucket", "_bit", "_bits")
    kept = maybe.join(readers, ["item_kind", "item_id"])
    return current_rows(kept, ["item_kind", "item_id"], ["cid", "text"], row_id=F.col("row_id") if "row_id" in kept.columns else None)


def near_duplicates(deliveries: DataFrame, config: NearDupConfig = NearDupConfig()) -> tuple[DataFrame, DataFrame]:
    """(members, links) of the current rows of ``deliveries`` (item_kind, item_id, text, arrived_at, and where
    rows can be told apart a long row_id; see ``current_rows``).

    ``members``: item_kind, item_id, cid, copy (a hash of the text: equal for
    copies), representative (the least id of the class) and members (of the
    class), for every text of at least ``min_words`` words; ``links``: item_kind, cid_a, cid_b, similarity, for every two classes
    of a kind with a similarity of at least ``similarity``. Null, empty and short
    texts are in neither. Repeated rows are one item; other columns are ignored;
    empty tables give empty results.
    """
    identity = ["row_id"] if "row_id" in deliveries.columns else []
    deliveries = deliveries.select("item_kind", "item_id", "text", "arrived_at", *identity)
    version = row_version(F.col("arrived_at"), F.col("row_id")) if identity else F.lit(None).cast("decimal(38,0)")
    hashed = deliveries.select("item_kind", "item_id", "arrived_at", version.alias("version"), F.xxhash64("text").alias("copy"), word_hashes(F.col("text")).alias("hashes"))
    schema = "item_kind string, item_id string, arrived_at timestamp, version decimal(38,0), copy long, n int, set1 long, set2 long, tail long, fronts array<long>"
    sketched = hashed.mapInArrow(lambda b: sketch_batches(b, config), schema)
    payload = ["copy", "n", "set1", "set2", "tail", "fronts"]
    if identity:  # the newest are found from ids and ages alone: no text is sketched for that
        newest = newest_versions(deliveries.select("item_kind", "item_id", version.alias("version")), ["item_kind", "item_id"], "version")
        current = sketched.where("n > 0").join(newest.hint("shuffle_hash"), "version", "left_semi").select("item_kind", "item_id", *payload)
    else:
        current = current_rows(sketched, ["item_kind", "item_id"], payload).where("n > 0")
    current = materialize(current.withColumn("cid", F.xxhash64("item_kind", "set1", "set2", "n")).drop("set1", "set2"), "sketches")
    classes = current.groupBy("cid").agg(F.first("item_kind").alias("item_kind"), F.min("item_id").alias("representative"), F.count("*").alias("members"), F.first("tail").alias("tail"), F.first("n").alias("n"), F.first("fronts").alias("fronts"))
    classes = materialize(classes, "classes")
    pairs = materialize(_candidates(classes, config), "pairs")
    wanted = pairs.select(F.explode(F.array("cid_a", "cid_b")).alias("cid")).distinct()
    readers = materialize(classes.select("item_kind", F.col("representative").alias("item_id"), "cid").join(wanted, "cid", "left_semi"), "readers")
    n_words = config.words

    def to_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                b = whole.slice(at, 2000)
                flat, n = shingle_sets(b.column(1), n_words)
                # 32 bits tell the shingles of two texts apart well enough, and halve what is sent.
                yield pa.record_batch([b.column(0), pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array((flat >> np.uint64(32)).astype(np.uint32).view(np.int32)))], names=["cid", "shingles"])

    sets = materialize(_texts_of(deliveries, readers, config.filter_bits).select("cid", word_hashes(F.col("text")).alias("h")).mapInArrow(to_sets, "cid long, shingles array<int>"), "sets")
    kinds = readers.select("cid", "item_kind")
    links = _checked(pairs, sets, config).join(kinds, F.col("cid_a") == kinds.cid).select("item_kind", "cid_a", "cid_b", "similarity")
    members = current.select("item_kind", "item_id", "cid", "copy").join(classes.select("cid", "representative", "members"), "cid")
    return members, links


def pairs_of_ids(members: DataFrame, links: DataFrame, config: NearDupConfig = NearDupConfig()) -> DataFrame:
    """item_kind, id_a, id_b (the smaller first): the links between items, and the pairs inside classes (copies as ``expand`` says).

    A class is cut into blocks of about ``block_rows`` members, and every two blocks meet under a key of their own.
    """
    tasks = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    links = materialize(links, "links")
    touched = links.select(F.explode(F.array("cid_a", "cid_b")).alias("cid")).distinct().withColumn("linked", F.lit(True))
    members = materialize(members.join(touched, "cid", "left").where("linked or members > 1").drop("linked"), "members")
    shown = members.select("item_kind", "cid", "item_id", "members")
    if config.expand is not None:
        crowds = members.groupBy("item_kind", "cid", "copy").agg(F.min("item_id").alias("first"), F.count("*").alias("copies")).where(F.col("copies") > config.expand)
        marked = members.join(crowds.drop("copies"), ["item_kind", "cid", "copy"], "left")
        shown = marked.where("first is null or item_id = first").select("item_kind", "cid", "item_id", "members")
        star = marked.where("item_id <> first").select("item_kind", F.col("first").alias("a"), F.col("item_id").alias("b"))
    blocks = F.ceil(F.col("members") / config.block_rows)
    placed = shown.select("item_kind", "cid", "item_id", "members", blocks.alias("blocks"), F.pmod(F.xxhash64("item_id"), blocks).alias("block"))
    large = members.where(F.col("members") > config.block_rows).select("cid", blocks.alias("blocks")).distinct()

    def side(df: DataFrame, x: str) -> DataFrame:  # each link once for every block of the class on this side
        cut = df.join(large.withColumnRenamed("cid", f"cid_{x}"), f"cid_{x}", "left")
        return cut.withColumn(f"block_{x}", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("blocks", F.lit(1)) - 1))).drop("blocks")

    def items(x: str) -> DataFrame:
        return placed.select("item_kind", F.col("cid").alias(f"cid_{x}"), F.col("block").alias(f"block_{x}"), F.col("item_id").alias(x))

    keys = ["item_kind", "cid_a", "block_a", "cid_b", "block_b"]
    met = side(side(links.select("item_kind", "cid_a", "cid_b"), "a"), "b")
    ends = [met.join(items(x), ["item_kind", f"cid_{x}", f"block_{x}"]).select(*keys, x).repartition(tasks, *keys) for x in "ab"]
    across = ends[0].join(ends[1], keys).select("item_kind", "a", "b")
    several = placed.where("members > 1")
    inner = ["item_kind", "cid", "low", "high"]
    low = several.select("item_kind", "cid", F.col("block").alias("low"), F.explode(F.expr("sequence(block, blocks - 1)")).alias("high"), F.col("item_id").alias("a")).repartition(tasks, *inner)
    high = several.select("item_kind", "cid", F.explode(F.expr("sequence(0L, block)")).alias("low"), F.col("block").alias("high"), F.col("item_id").alias("b")).repartition(tasks, *inner)
    out = across.unionByName(low.join(high, inner).where("low < high or a < b").select("item_kind", "a", "b"))
    if config.expand is not None:
        out = out.unionByName(star)
    return out.select("item_kind", F.least("a", "b").alias("id_a"), F.greatest("a", "b").alias("id_b"))
