"""Nearest vectors by cosine, from a hierarchical k-means tree with best-bin-first traversal.

The tree is fitted on at most ``SAMPLE`` of the vectors, those with the smallest hash of their id, by splitting each node into
``BRANCHES`` clusters until a leaf stands for about ``LEAF_ROWS`` vectors of the whole table, or four times the root of their
number if that is more: a query sends on a few candidates from each leaf it visits, so these grow more slowly than the table. Every vector is then put into a
leaf. A query takes nodes from a priority queue, nearest centre first, and visits the leaves it meets. How many is calibrated:
at most ``TRIALS`` queries are also answered by scanning all vectors, and the visits are widened until these answers are found
with a recall of ``RECALL``; a query goes on besides until its leaves hold enough candidates.

Equal vectors are one class, with the few smallest ids that an answer can name; queries are searched once a class and drop their
own id afterwards. Leaves and their queries meet in cells of at most ``CELL`` classes on either side, so that a crowded leaf is
many tasks. Scores are sums over elements in one fixed order, equal for equal vectors.

Vectors that are null, empty, zero or hold null or non-finite components take no part, neither do null ids, nor vectors of
another length than the most common one (ties to the shortest); of rows repeated with one id each vector counts. An empty table
gives an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barline.session import written

SAMPLE, BRANCHES, LEAF_ROWS, TRIALS, RECALL, CELL = 20_000, 8, 256, 128, 0.97, 1024


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one length from their bytes."""
    raw = column.to_pylist()
    return np.frombuffer(b"".join(raw), dtype=np.float64).reshape(len(raw), -1)


@dataclass
class Tree:
    """Nodes in one array: centres, children of inner nodes, the leaf number of leaves."""

    centres: np.ndarray
    children: list[list[int]]
    leaf: list[int]
    leaves: int

    def place(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row of unit vectors."""
        node = np.zeros(len(x), dtype=np.int64)
        out = np.empty(len(x), dtype=np.int64)
        todo = np.arange(len(x))
        while len(todo):
            on = []
            for v in np.unique(node[todo]):
                rows = todo[node[todo] == v]
                if self.children[v]:
                    kids = np.array(self.children[v])
                    node[rows] = kids[np.argmax(x[rows] @ self.centres[kids].T - 0.5 * (self.centres[kids] ** 2).sum(axis=1), axis=1)]
                    on.append(rows)
                else:
                    out[rows] = self.leaf[v]
            todo = np.concatenate(on) if on else todo[:0]
        return out

    def visits(self, q: np.ndarray) -> Iterator[int]:
        """Leaves for a unit vector, best bin first."""
        queue = [(0.0, 0)]
        while queue:
            _, v = heapq.heappop(queue)
            kids = self.children[v]
            if not kids:
                yield self.leaf[v]
                continue
            d = ((self.centres[kids] - q) ** 2).sum(axis=1)
            for distance, k in zip(d.tolist(), kids, strict=True):
                heapq.heappush(queue, (distance, k))


def fit(x: np.ndarray, leaf_rows: int, branches: int = BRANCHES, rounds: int = 10, seed: int = 7) -> Tree:
    """Hierarchical k-means over unit vectors; a node whose vectors cannot be told apart is a leaf."""
    rng = np.random.default_rng(seed)
    centres, children, leaf = [x.mean(axis=0) if len(x) else np.zeros(x.shape[1])], [[]], [-1]
    open_, leaves = [(0, np.arange(len(x)))], 0
    while open_:
        v, rows = open_.pop()
        wanted = min(branches, -(-len(rows) // leaf_rows))  # no more clusters than full leaves
        parts = _split(x[rows], wanted, rounds, rng) if wanted > 1 else []
        if len(parts) < 2:
            leaf[v], leaves = leaves, leaves + 1
            continue
        for centre, members in parts:
            children[v].append(len(centres))
            open_.append((len(centres), rows[members]))
            centres.append(centre)
            children.append([])
            leaf.append(-1)
    return Tree(np.array(centres), children, leaf, leaves)


def _split(x: np.ndarray, branches: int, rounds: int, rng: np.random.Generator) -> list[tuple[np.ndarray, np.ndarray]]:
    distinct = np.unique(x, axis=0)
    if len(distinct) < 2:
        return []
    c = distinct[rng.choice(len(distinct), min(branches, len(distinct)), replace=False)]
    for _ in range(rounds):
        near = np.argmax(x @ c.T - 0.5 * (c**2).sum(axis=1), axis=1)
        c = np.array([x[near == i].mean(axis=0) for i in np.unique(near)])
    near = np.argmax(x @ c.T - 0.5 * (c**2).sum(axis=1), axis=1)
    return [(c[i], np.flatnonzero(near == i)) for i in np.unique(near)]


def classes(df: DataFrame, is_query: Column, keep: int, id_col: str, vector_col: str) -> tuple[DataFrame, DataFrame]:
    """Distinct vectors ``key, ids, first_query`` with the smallest ids, and the query rows ``query_id, key``; key: doubles as bytes."""
    raw = df.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"), is_query.alias("asks"))
    whole = raw.where("vec_id IS NOT NULL AND v IS NOT NULL AND size(v) > 0")

    def as_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = []
            for v in batch.column("v").to_pylist():
                a = np.array([np.nan if e is None else e for e in v], dtype=np.float64)
                keys.append(a.tobytes() if np.isfinite(a).all() and (a * a).sum() > 0 else None)
            yield pa.record_batch([batch.column("vec_id"), batch.column("asks"), pa.array(keys, pa.binary())], names=["vec_id", "asks", "key"])

    rows = written(whole.mapInArrow(as_bytes, "vec_id long, asks boolean, key binary").where("key IS NOT NULL"), "vectors")
    sizes = rows.groupBy(F.octet_length("key").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    if sizes:
        rows = rows.where(F.octet_length("key") == sizes[0].n)

    def smallest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """At most ``keep`` ids of a class in a task, so that a crowd of equal vectors is few rows."""
        held: dict[bytes, tuple[list[int], list[int]]] = {}
        out = lambda: pa.record_batch([pa.array(list(held), pa.binary()), pa.array([[-i for i in sorted(a, reverse=True)] for a, _ in held.values()], pa.list_(pa.int64())), pa.array([min(q, default=None) for _, q in held.values()], pa.int64())], names=["key", "ids", "first_query"])
        for batch in batches:
            for i, asks, key in zip(*(batch.column(c).to_pylist() for c in ("vec_id", "asks", "key")), strict=True):
                ids, queries = held.setdefault(key, ([], []))
                if -i not in ids:
                    (heapq.heappush if len(ids) < keep else heapq.heappushpop)(ids, -i)  # a heap of negatives keeps the smallest
                if asks and (not queries or i < queries[0]):
                    queries[:] = [i]
            if len(held) > 20_000:
                yield out()
                held.clear()
        yield out()

    some = rows.mapInArrow(smallest, "key binary, ids array<long>, first_query long")
    merged = some.groupBy("key").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, keep).alias("ids"), F.min("first_query").alias("first_query"))
    return written(merged, "vector_classes"), rows.where("asks").select(F.col("vec_id").alias("query_id"), "key")


def _scores(members: np.ndarray, queries: np.ndarray) -> Iterator[np.ndarray]:
    """Cosines of each query with all members, every one summed in the same order."""
    norm = np.sqrt((members * members).sum(axis=1))
    for q in queries:
        yield (members * q).sum(axis=1) / (norm * np.sqrt((q * q).sum()))


def _best(score: np.ndarray, ids: list[list[int]], keep: int) -> list[tuple[float, int]]:
    """The ``keep`` best (score, id), higher scores and smaller ids first."""
    if len(score) > keep:
        edge = np.partition(score, len(score) - keep)[len(score) - keep]
        at = np.flatnonzero(score >= edge)
    else:
        at = np.arange(len(score))
    return sorted(((float(score[a]), i) for a in at for i in ids[a]), key=lambda x: (-x[0], x[1]))[:keep]


def calibrate(placed: DataFrame, tree: Tree, queries: list[tuple[int, bytes]], keep: int, recall: float) -> int:
    """Leaves to visit so that the scan's answers to the trial queries are found with that recall."""
    if not queries or tree.leaves < 2:
        return 1
    q = np.array([np.frombuffer(k) for _, k in queries])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, leaf = batch.column("ids").to_pylist(), batch.column("leaf").to_pylist()
            of, at, where, what = [], [], [], []
            place = {i: n for n, own in zip(leaf, ids, strict=True) for i in own}
            for (number, _), score in zip(queries, _scores(_matrix(batch.column("key")), q), strict=True):
                for s, i in _best(score, ids, keep):
                    of.append(number)
                    at.append(s)
                    where.append(place[i])
                    what.append(i)
            yield pa.record_batch([pa.array(of, pa.int64()), pa.array(what, pa.int64()), pa.array(at, pa.float64()), pa.array(where, pa.int64())], names=["query", "vec_id", "score", "leaf"])

    found = placed.mapInArrow(scan, "query long, vec_id long, score double, leaf long")
    ranked = found.withColumn("k", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))).where(F.col("k") <= keep)
    truth: dict[int, list[int]] = {}
    for r in ranked.select("query", "leaf").collect():  # trials x keep rows
        truth.setdefault(r.query, []).append(r.leaf)
    ranks = []
    for (number, _), v in zip(queries, _unit(q), strict=True):
        order = {leaf: n for n, leaf in enumerate(tree.visits(v))}
        ranks += [order[x] for x in truth.get(number, [])]
    need = np.sort(np.array(ranks))
    return int(need[min(len(need) - 1, int(np.ceil(recall * len(need))) - 1)]) + 1 if len(need) else 1


def nearest(df: DataFrame, is_query: Column, k: int = 5, sample: int = SAMPLE, leaf_rows: int = LEAF_ROWS, trials: int = TRIALS, recall: float = RECALL, cell: int = CELL, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest found of each query row, its own id left out."""
    spark, keep = df.sparkSession, k + 1
    distinct, asking = classes(df, is_query, keep, id_col, vector_col)
    n = distinct.count()
    h = F.xxhash64(F.element_at("ids", 1))
    share = lambda size: F.pmod(h, F.lit(1_000_003)) <= int(min(1.0, 1.5 * size / max(1, n)) * 1_000_003)
    chosen = distinct.where(share(sample)).orderBy(h, "key").limit(sample).select("key").toPandas()["key"]
    x = _unit(np.array([np.frombuffer(b) for b in chosen])) if len(chosen) else np.zeros((0, 1))
    per_leaf = max(leaf_rows, 4 * n**0.5)
    tree = fit(x, max(16, round(per_leaf * len(x) / max(1, n))))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf = tree.place(_unit(_matrix(batch.column("key")))) if batch.num_rows else np.zeros(0, dtype=np.int64)
            yield pa.record_batch([*batch.columns, pa.array(leaf, pa.int64())], names=[*batch.schema.names, "leaf"])

    placed = written(distinct.mapInArrow(place, "key binary, ids array<long>, first_query long, leaf long"), "leaves")
    queries = placed.where("first_query IS NOT NULL").select(F.col("first_query").alias("query"), "key")
    counted = queries.count()
    few = queries.where(F.pmod(F.xxhash64("query"), F.lit(1_000_003)) <= int(min(1.0, 3 * trials / max(1, counted)) * 1_000_003)).orderBy(F.xxhash64("query")).limit(trials)
    visits = calibrate(placed, tree, [(r["query"], bytes(r["key"])) for r in few.collect()], keep, recall)
    sizes = {r.leaf: (r.classes, r.ids) for r in placed.groupBy("leaf").agg(F.count(F.lit(1)).alias("classes"), F.sum(F.size("ids")).alias("ids")).collect()}  # a row a leaf, of which the sample bounds the number

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, leaves = [], []
            for r, q in enumerate(_unit(_matrix(batch.column("key"))) if batch.num_rows else []):
                seen = held = 0
                for leaf in tree.visits(q):
                    seen += 1
                    if leaf in sizes:
                        rows.append(r)
                        leaves.append(leaf)
                        held += sizes[leaf][1]
                    if seen >= visits and held >= keep:
                        break
            take = pa.array(rows, pa.int64())
            yield pa.record_batch([batch.column("query").take(take), batch.column("key").take(take), pa.array(leaves, pa.int64())], names=["query", "key", "leaf"])

    probes = written(queries.mapInArrow(probe, "query long, key binary, leaf long"), "probes")
    asked = {r.leaf: r["count"] for r in probes.groupBy("leaf").count().collect()}
    grid = [(leaf, -(-m // cell), -(-asked.get(leaf, 1) // cell)) for leaf, (m, _) in sizes.items()]
    shape = spark.createDataFrame(grid, "leaf long, member_parts int, query_parts int")
    # leaves are as many as the sample allows, so this side is small enough to send to all
    left = probes.join(F.broadcast(shape), "leaf").select("leaf", "query", "key", F.pmod(F.xxhash64("query"), F.col("query_parts")).cast("int").alias("q"), F.explode(F.sequence(F.lit(0), F.col("member_parts") - 1)).alias("m"))
    right = placed.join(F.broadcast(shape), "leaf").select("leaf", "ids", "key", F.pmod(F.xxhash64(F.element_at("ids", 1)), F.col("member_parts")).cast("int").alias("m"), F.explode(F.sequence(F.lit(0), F.col("query_parts") - 1)).alias("q"))

    def meet(asks: pa.Table, members: pa.Table) -> pa.Table:
        query, what, score = [], [], []
        if asks.num_rows and members.num_rows:
            ids = members.column("ids").to_pylist()
            for number, s in zip(asks.column("query").to_pylist(), _scores(_matrix(members.column("key")), _matrix(asks.column("key"))), strict=True):
                for value, i in _best(s, ids, keep):
                    query.append(number)
                    what.append(i)
                    score.append(value)
        return pa.table([pa.array(query, pa.int64()), pa.array(what, pa.int64()), pa.array(score, pa.float64())], names=["query", "vec_id", "score"])

    found = left.groupBy("leaf", "m", "q").cogroup(right.groupBy("leaf", "m", "q")).applyInArrow(meet, "query long, vec_id long, score double")
    by_score = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    best = found.withColumn("k", F.row_number().over(by_score)).where(F.col("k") <= keep).groupBy("query").agg(F.collect_list(F.struct("vec_id", "score")).alias("best"))
    named = asking.distinct().join(distinct.where("first_query IS NOT NULL").select("key", F.col("first_query").alias("query")), "key").join(best, "query")
    answers = named.select("query_id", F.explode("best").alias("b")).select("query_id", "b.vec_id", "b.score").where("vec_id <> query_id")
    ranked = answers.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
