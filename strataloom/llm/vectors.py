"""Most similar vectors by a hierarchical k-means tree.

The tree is fitted on a bounded sample, and a node is split as long as enough of
the sample lies in it, so dense regions get more leaves. Every vector is put in
its leaf. A search goes through the tree best bin first: from a priority queue
of nodes it opens the one whose centre is most similar to the query, and visits
leaves as they come up. How many leaves are visited is calibrated: the true
neighbours of some queries are found by a pass over all vectors, and visits are
widened until they hold the share asked for.

Spark groups the vectors and the queries that visit a leaf by leaf; a leaf of
very many vectors is cut into parts, each of which gets all of the leaf's
queries. Equal vectors are one vector with several ids.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataloom.operators.current import current_rows
from strataloom.scratch import materialize


@dataclass(frozen=True)
class SearchConfig:
    """``leaf_rows``: vectors aimed at for a leaf, ``leaf_sample`` the sampled ones a leaf is fitted on. The tree is fitted on
    count * leaf_sample / leaf_rows vectors, ``max_fit_rows`` at most. ``calibration_rows``: queries whose true neighbours
    calibrate the visits. ``either``: two neighbours may find each other from either side, as where pairs are wanted: a neighbour counts
    as held if its leaf is visited, or if it visits the query's leaf. ``min_similarity``: neighbours below it aren't wanted, neither in the result nor for the recall.
    ``part_rows``: vectors of a leaf that one task compares at once; ``task_rows``: vectors and queries aimed at for a task."""

    k: int = 10
    dim: int = 64
    min_similarity: float = -1.0
    recall: float = 0.95
    either: bool = False
    branch: int = 16
    leaf_rows: int = 4000
    leaf_sample: int = 16
    max_fit_rows: int = 262_144
    calibration_rows: int = 1024
    part_rows: int = 20_000
    task_rows: int = 100_000
    seed: int = 11


@dataclass
class Tree:
    """Nodes in arrays: centre, children (empty for a leaf), and the number of the leaf."""

    centers: np.ndarray
    children: list[np.ndarray]
    leaf_no: np.ndarray
    leaf_share: np.ndarray  # of the sample

    @property
    def leaves(self) -> int:
        return int((self.leaf_no >= 0).sum())


def usable(vector: Column, dim: int) -> Column:
    """``dim`` finite values, not all zero."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vector) == dim) & fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def _unit_batches(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
        x /= np.abs(x).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
        x = (x / np.sqrt((x * x).sum(axis=1, keepdims=True))).astype(np.float32)
        x += 0.0  # one zero
        yield pa.record_batch([batch.column(0), pa.array([r.tobytes() for r in x], pa.binary())], names=["id", "vec"])


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    """Spherical k-means: the number of each row's centre."""
    centers = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        of = np.argmax(x @ centers.T, axis=1)
        sums = np.zeros_like(centers)
        np.add.at(sums, of, x)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centers = np.where(norm > 1e-9, sums / np.maximum(norm, 1e-9), centers)
    return np.argmax(x @ centers.T, axis=1)


def fit_tree(x: np.ndarray, config: SearchConfig) -> Tree:
    rng = np.random.default_rng(config.seed)
    centers: list[np.ndarray] = [np.zeros(config.dim, np.float32)]
    children: list[np.ndarray] = [np.zeros(0, np.int32)]
    sizes, leaf_sample = [len(x)], config.leaf_sample
    todo = [(0, np.arange(len(x)))]
    while todo:
        node, rows = todo.pop()
        k = min(config.branch, max(2, len(rows) // leaf_sample))
        if len(rows) <= max(leaf_sample, 2) or len(rows) <= k:
            continue
        of = kmeans(x[rows], k, rng)
        parts = [rows[of == c] for c in range(k) if (of == c).any()]
        if len(parts) < 2:
            continue
        first = len(centers)
        children[node] = np.arange(first, first + len(parts), dtype=np.int32)
        for p in parts:
            c = x[p].sum(axis=0)
            centers.append((c / max(np.linalg.norm(c), 1e-9)).astype(np.float32))
            children.append(np.zeros(0, np.int32))
            sizes.append(len(p))
        todo += [(first + i, p) for i, p in enumerate(parts)]
    leaf = np.array([len(c) == 0 for c in children])
    number = np.where(leaf, np.cumsum(leaf) - 1, -1).astype(np.int32)
    return Tree(np.array(centers, np.float32), children, number, np.array(sizes)[leaf] / max(len(x), 1))


def visits(tree: Tree, q: np.ndarray, most: int) -> np.ndarray:
    """Numbers of the leaves that each query visits, best bin first: queries x most, -1 where there are no more.

    The priority queues of a block of queries are the rows of one array: nodes
    are pushed behind one another, and the greatest score of a row is popped.
    """
    n, most = len(q), min(most, tree.leaves)
    wide = max([1, *(len(c) for c in tree.children)])
    score, node = np.full((n, 4 * wide), -np.inf, np.float32), np.zeros((n, 4 * wide), np.int32)
    score[:, 0] = 2.0
    used, filled = np.ones(n, np.int64), np.zeros(n, np.int64)
    out = np.full((n, most), -1, np.int32)
    alive = np.arange(n)
    while len(alive):
        reach = int(used[alive].max())
        col = np.argmax(score[alive, :reach], axis=1)
        there = score[alive, col] > -np.inf
        alive, col = alive[there], col[there]
        top = node[alive, col]
        score[alive, col] = -np.inf
        leaf = tree.leaf_no[top]
        hit = leaf >= 0
        at = alive[hit]
        out[at, filled[at]] = leaf[hit]
        filled[at] += 1
        rows, opened = alive[~hit], top[~hit]
        if len(rows) and reach + wide > score.shape[1]:
            score = np.hstack([score, np.full_like(score, -np.inf)])
            node = np.hstack([node, np.zeros_like(node)])
        by = np.argsort(opened, kind="stable")
        for group in np.split(by, np.flatnonzero(np.diff(opened[by])) + 1) if len(rows) else ():
            mine, kids = rows[group], tree.children[opened[group[0]]]
            cols = used[mine][:, None] + np.arange(len(kids))
            score[mine[:, None], cols] = q[mine] @ tree.centers[kids].T
            node[mine[:, None], cols] = kids
            used[mine] += len(kids)
        alive = alive[filled[alive] < most]
    return out


def _matrix(column: pa.Array | pd.Series, dim: int) -> np.ndarray:
    data = column.to_pylist() if isinstance(column, (pa.Array, pa.ChunkedArray)) else list(column)
    return np.frombuffer(b"".join(data), np.float32).reshape(-1, dim)


def unit_vectors(rows: DataFrame, config: SearchConfig = SearchConfig()) -> DataFrame:
    """id, rid (a hash: equal for equal vectors) and vec (the unit vector's bytes) of the usable vectors of ``id, vector``; written."""
    dim = config.dim
    units = rows.where(usable(F.col("vector"), dim)).select("id", F.col("vector").cast("array<float>")).mapInArrow(lambda b: _unit_batches(b, dim), "id string, vec binary")
    return materialize(units.select("id", F.xxhash64("vec").alias("rid"), "vec"), "units")


def _picked(vectors: DataFrame, rows: int, count: int, seed: int) -> DataFrame:
    """rid, vec of up to ``rows`` different vectors of the lowest hashes, the same at each run. ``count``: of ``vectors`` with their copies."""
    buckets = 1_000_003
    share = min(1.0, 1.2 * rows / max(count, 1))
    hashed = vectors.where(F.pmod(F.xxhash64("rid", F.lit(seed)), F.lit(buckets)) < int(share * buckets) + 1)
    return hashed.groupBy("rid").agg(F.first("vec").alias("vec")).orderBy(F.xxhash64("rid", F.lit(seed))).limit(rows)


def _sample(units: DataFrame, rows: int, count: int, config: SearchConfig) -> np.ndarray:
    batches = _picked(units, rows, count, config.seed).select("vec").toArrow().to_batches()  # max_fit_rows vectors at most
    return np.concatenate([np.zeros((0, config.dim), np.float32), *[_matrix(b.column(0), config.dim) for b in batches if b.num_rows]])


def similar_vectors(units: DataFrame, queries: DataFrame | None = None, config: SearchConfig = SearchConfig()) -> DataFrame:
    """qrid, rid, similarity: for each different vector of ``queries`` (all of ``units`` if None) up to ``k`` different others, the most similar first found by the tree."""
    count = units.count()
    if count == 0:
        return units.sparkSession.createDataFrame([], "qrid long, rid long, similarity double")
    rows = min(config.max_fit_rows, max(64, count * config.leaf_sample // config.leaf_rows))
    tree = units.sparkSession.sparkContext.broadcast(fit_tree(_sample(units, rows, count, config), config))  # max_fit_rows vectors at most
    most = calibrate(queries if queries is not None else units, units, tree, count, config)
    if queries is None:
        return _best(_visit(None, units, tree, 0, most, count, config), config)
    asked = queries.select(F.col("rid").alias("qrid"), "vec", F.lit(config.min_similarity).cast("float").alias("bound"))
    first = min(most, 8)
    found = materialize(_best(_visit(asked, units, tree, 0, first, count, config), config), "near")
    if first == most:
        return found
    bounds = found.groupBy("qrid").agg(F.when(F.count("*") >= config.k, F.min("similarity")).otherwise(config.min_similarity).cast("float").alias("bound"))
    wider = asked.drop("bound").join(bounds, "qrid", "left").na.fill({"bound": config.min_similarity})
    return _best(found.unionByName(_visit(wider, units, tree, first, most, count, config)), config)


def calibrate(queries: DataFrame, units: DataFrame, tree, count: int, config: SearchConfig) -> int:
    """The least number of visits whose leaves hold the wanted share of the calibration queries' true neighbours. Which visit comes to a neighbour's leaf is found in tasks."""
    dim, k, low = config.dim, config.k, config.min_similarity
    few = _picked(queries, config.calibration_rows, count, config.seed + 1).toPandas()
    q, qids = _matrix(few["vec"], dim), few["rid"].to_numpy(np.int64)
    shared = units.sparkSession.sparkContext.broadcast((q, qids))  # calibration_rows vectors

    home = visits(tree.value, q, 1)[:, 0] if len(q) else np.zeros(0, np.int32)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, qids = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 4000):
                b = batch.slice(at, 4000)
                x, rids = _matrix(b.column(1), dim), b.column(0).to_numpy()
                s = q @ x.T
                own = np.isin(rids, qids)
                s[:, own] = np.where(rids[own][None, :] == qids[:, None], -2, s[:, own])
                if s.shape[1] > k:
                    kth = -np.partition(-s, k - 1, axis=1)[:, k - 1]
                    row, col = np.nonzero((s >= kth[:, None]) & (s >= low))
                else:
                    row, col = np.nonzero(s >= max(low, -1.5))
                used, back = np.unique(col, return_inverse=True)
                order = visits(tree.value, x[used], 16 if config.either else 1)[back] if len(used) else np.zeros((0, 1), np.int32)
                # At which of its first visits the neighbour comes to the query's leaf; 0: at none of them.
                hit = order == home[row][:, None]
                from_there = np.where(hit.any(axis=1), hit.argmax(axis=1) + 1, 0) if config.either else np.zeros(len(row), np.int64)
                yield pa.record_batch([pa.array(row.astype(np.int32)), pa.array(rids[col]), pa.array(s[row, col].astype(np.float64)), pa.array(order[:, 0].astype(np.int32)), pa.array(from_there.astype(np.int64))], names=["q", "rid", "s", "leaf", "back"])

    found = units.select("rid", "vec").mapInArrow(nearest, "q int, rid long, s double, leaf int, back long").dropDuplicates(["q", "rid"])
    best = found.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("s"), "rid"))).where(F.col("r") <= k).select("q", "leaf", "back")

    def ranks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, _ = shared.value
        for batch in batches:
            of, leaf = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            rank, most = np.zeros(len(of), np.int64), 16
            while (open_ := np.flatnonzero(rank == 0)).size:  # outwards, until every leaf is found
                asked, at = np.unique(of[open_], return_inverse=True)
                hit = visits(tree.value, q[asked], most)[at] == leaf[open_][:, None]
                rank[open_] = np.where(hit.any(axis=1), hit.argmax(axis=1) + 1, 0)
                most *= 4
            back = batch.column(2).to_numpy()
            yield pa.record_batch([pa.array(np.where(back > 0, np.minimum(back, rank), rank))], names=["rank"])

    counts = best.repartition("q").mapInArrow(ranks, "rank long").groupBy("rank").agg(F.count("*").alias("n")).orderBy("rank").toPandas()  # a row a rank, of calibration_rows * k neighbours
    if counts.empty:
        return 1
    held = counts["n"].cumsum()
    return int(counts["rank"][(held >= np.ceil(config.recall * held.iloc[-1])).idxmax()])


def _best(found: DataFrame, config: SearchConfig) -> DataFrame:
    order = Window.partitionBy("qrid").orderBy(F.desc("similarity"), "rid")
    return found.dropDuplicates(["qrid", "rid"]).withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= config.k).drop("_r")


def _visit(queries: DataFrame | None, units: DataFrame, tree, start: int, stop: int, count: int, config: SearchConfig) -> DataFrame:
    """Compare queries with the vectors of the leaves that come start-th to stop-th. None: every vector is a query, in its own leaf without being sent there."""
    dim, k, low = config.dim, config.k, config.min_similarity
    everyone = queries is None

    def to_leaves(batches: Iterator[pa.RecordBatch], skip: int, most: int) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # copies of a vector leave a task once
        for b in batches:
            if len(seen) > 1_000_000:
                seen.clear()
            rids = b.column(0).to_pylist()
            fresh = [i for i, r in enumerate(rids) if not (r in seen or seen.add(r))]
            b = b.take(pa.array(fresh, pa.int32()))
            for at in range(0, b.num_rows, 2000):
                part = b.slice(at, 2000)
                v = visits(tree.value, _matrix(part.column(1), dim), most)[:, skip:]
                row, col = np.nonzero(v >= 0)
                yield pa.record_batch([pa.array(v[row, col], pa.int32()), *[c.take(pa.array(row)) for c in part.columns]], names=["leaf", *part.schema.names])

    placed = units.select("rid", "vec").mapInArrow(lambda b: to_leaves(b, 0, 1), "leaf int, rid long, vec binary")
    if everyone:
        asked = units.select(F.col("rid").alias("qrid"), "vec", F.lit(low).cast("float").alias("bound")).mapInArrow(lambda b: to_leaves(b, 1, stop), "leaf int, qrid long, vec binary, bound float")
    else:
        asked = queries.select("qrid", "vec", "bound").mapInArrow(lambda b: to_leaves(b, start, stop), "leaf int, qrid long, vec binary, bound float")
    share = tree.value.leaf_share * count
    parts = {i: int(-(-n // config.part_rows)) for i, n in enumerate(share.tolist()) if n > config.part_rows}
    placed, asked = placed.withColumn("part", F.lit(0)), asked.withColumn("part", F.lit(0))
    if parts:
        table = F.broadcast(units.sparkSession.createDataFrame(list(parts.items()), "leaf int, many int"))  # fewer rows than the tree has leaves
        placed = placed.drop("part").join(table, "leaf", "left").withColumn("part", F.pmod(F.xxhash64("rid"), F.coalesce("many", F.lit(1)).cast("long")).cast("int"))
        asked = asked.drop("part").join(table, "leaf", "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("many", F.lit(1)) - 1))).drop("many")
        if everyone:  # vectors of a leaf in parts ask the other parts too
            split = placed.where("many is not null")
            others = split.select("leaf", F.col("rid").alias("qrid"), "vec", F.lit(low).cast("float").alias("bound"), "part", F.explode(F.sequence(F.lit(0), F.col("many") - 1)).alias("other"))
            asked = asked.unionByName(others.where("other <> part").select("leaf", "qrid", "vec", "bound", F.col("other").alias("part")))
        placed = placed.drop("many")

    def compare(asking: pa.Table, there: pa.Table) -> pa.Table:
        q_out, r_out, s_out = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        if there.num_rows:
            rids, first = np.unique(there.column("rid").to_numpy(), return_index=True)
            x = _matrix(there.column("vec"), dim)[first]
            asks = []
            if asking.num_rows:
                asks.append((asking.column("qrid").to_numpy(), _matrix(asking.column("vec"), dim), asking.column("bound").to_numpy()))
            if everyone:
                asks.append((rids, x, np.full(len(x), low, np.float32)))
            for qids, q, bound in asks:
                for a in range(0, len(q), 1024):
                    s = q[a : a + 1024] @ x.T
                    keep = s >= bound[a : a + 1024][:, None] - 1e-6
                    if s.shape[1] > k + 1 and keep.sum(axis=1).max() > k + 1:  # one more than k: the query itself may be there
                        keep &= s >= -np.partition(-s, k, axis=1)[:, k : k + 1]
                    i, j = np.nonzero(keep)
                    other = qids[a + i] != rids[j]
                    i, j = i[other], j[other]
                    exact = (q[a + i].astype(np.float64) * x[j]).sum(axis=1)
                    fine = exact >= low
                    q_out.append(qids[a + i][fine])
                    r_out.append(rids[j][fine])
                    s_out.append(exact[fine])
        return pa.table({"qrid": np.concatenate(q_out), "rid": np.concatenate(r_out), "similarity": np.concatenate(s_out)})

    asked = asked.withColumnRenamed("leaf", "at").withColumnRenamed("part", "at_part")
    # As many tasks as the data asks for, whatever the session's number is.
    visitors = count * (stop - (0 if everyone else start))
    tasks = max(int(units.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-(count + visitors) // config.task_rows))
    asked, placed = asked.repartition(tasks, "at", "at_part"), placed.repartition(tasks, "leaf", "part")
    return asked.groupBy("at", "at_part").cogroup(placed.groupBy("leaf", "part")).applyInArrow(compare, "qrid long, rid long, similarity double")


def neighbours(rows: DataFrame, queries: Column | None = None, config: SearchConfig = SearchConfig()) -> DataFrame:
    """id, neighbour, similarity, rank: for every usable vector of ``rows`` (id, vector) its ``k`` most similar other rows by cosine.

    ``queries``: a condition on ``id``; None takes every row. Vectors of another
    length, with nulls, NaN or infinities, or all zero take no part; magnitudes
    of any size do. Equal similarities are ranked by id. Rows of equal vectors
    are neighbours with similarity 1; however many there are, each is compared
    as one vector and has its k smallest other ids. Rows below
    ``min_similarity`` are left out, so a row may have fewer than k or none. A
    repeated id counts once for each of its different vectors. Empty tables give
    an empty result; columns other than id and vector are ignored.
    """
    k = config.k
    units = unit_vectors(rows, config)
    found = similar_vectors(units, None if queries is None else units.where(queries), config)
    ids = units.select("rid", "id").distinct()
    # Of each vector the ids that can be neighbours (pruned before the shuffle), and of each asking id its vector.
    listed = units.select(F.col("rid").alias("nrid"), F.col("id").alias("neighbour"))
    listed = listed.withColumn("_r", F.row_number().over(Window.partitionBy("nrid").orderBy("neighbour"))).where(F.col("_r") <= k + 1).drop("_r")
    asking = ids if queries is None else ids.where(queries)
    many = units.groupBy("rid").agg(F.count("*").alias("n")).where("n > 1")
    copies = asking.join(many.select("rid"), "rid").select("id", F.col("rid").alias("nrid"), F.lit(1.0).alias("similarity"))
    crowded = many.where(F.col("n") > k).select(F.col("rid").alias("qrid"))  # their nearest are all copies
    near = found.join(crowded, "qrid", "left_anti").select(F.col("qrid").alias("qr"), F.col("rid").alias("nrid"), "similarity")
    near = asking.join(near, asking.rid == F.col("qr")).select("id", "nrid", "similarity")
    pairs = near.unionByName(copies).join(listed, "nrid").where("id <> neighbour").groupBy("id", "neighbour").agg(F.max("similarity").alias("similarity"))
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("similarity"), "neighbour"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k)


def current_vectors(records: DataFrame, row_id: Column | None = None) -> DataFrame:
    return current_rows(records, ["chunk_id"], ["vector"], row_id=row_id).select(F.col("chunk_id").alias("id"), "vector")
