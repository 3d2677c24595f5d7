"""Nearest neighbours by largest inner product: vantage-point trees per shard."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from castloom.llm.base import parked, pick
from castloom.operators.rows import hash_sample

#: Rows of a shard, and of a leaf of its tree.
SHARD_ROWS, LEAF_ROWS = 8192, 128
#: Rows that the routing tree is fitted on (all rows are indexed), and rows per route at least.
SAMPLE_ROWS, ROUTE_ROWS = 8192, 16
#: Queries that visit a shard in one task.
BLOCK_QUERIES = 8192
#: Candidates beyond k + 1 kept by rounded products, before exact scores decide.
SPARE = 8
#: Distances that differ by less may be equal.
ROUNDING = 1e-9


@dataclass
class Node:
    """A vantage point with the radius between its two sides, or a leaf with its rows."""

    vantage: np.ndarray | None = None
    radius: float = 0.0
    inner: Node | None = None
    outer: Node | None = None
    rows: np.ndarray | None = None
    leaf: int = -1
    #: Of a leaf: (vantage number, nearest, farthest) for each vantage point above.
    bounds: list = field(default_factory=list)


def _distances(points: np.ndarray, vantage: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(((points - vantage) ** 2).sum(axis=1), 0))


def grow(points: np.ndarray, least: int, rows: np.ndarray | None = None) -> Node:
    """A tree over points; rows of a node are halved by the distance to its vantage point."""
    rows = np.arange(len(points)) if rows is None else rows
    if len(rows) <= least:
        return Node(rows=rows)
    # The point farthest from the first one sees the rest under the widest range of distances.
    own = points[rows]
    vantage = own[int(_distances(own, own[0]).argmax())]
    away = _distances(own, vantage)
    radius = float(np.median(away))
    near = away < radius
    if near.sum() * 16 < len(rows):  # nearly all equally far: another level would not help
        return Node(rows=rows)
    return Node(
        vantage, radius, grow(points, least, rows[near]), grow(points, least, rows[~near])
    )


class Found:
    """The best rows of each query so far, with the distance of the last one."""

    def __init__(self, queries: int, keep: int, reach: np.ndarray):
        self.keep = keep
        self.away = np.full((queries, keep), np.inf)
        self.row = np.full((queries, keep), -1, np.int64)
        self.reach = reach.copy()

    def add(self, of: np.ndarray, rows: np.ndarray, away: np.ndarray) -> None:
        away = np.concatenate([self.away[of], away], axis=1)
        row = np.concatenate([self.row[of], np.broadcast_to(rows, (len(of), len(rows)))], axis=1)
        ids = np.argsort(row, axis=1, kind="stable")  # rows are in the order of their ids
        best = np.argsort(np.take_along_axis(away, ids, axis=1), axis=1, kind="stable")
        best = np.take_along_axis(ids, best[:, : self.keep], axis=1)
        self.away[of] = np.take_along_axis(away, best, axis=1)
        self.row[of] = np.take_along_axis(row, best, axis=1)
        self.reach[of] = np.minimum(self.reach[of], self.away[of].max(axis=1))


def descend(
    node: Node, points: np.ndarray, queries: np.ndarray, of: np.ndarray, found: Found, factor: float
) -> None:
    """Visit the side a query lies on, then the other one unless the triangle inequality,
    tightened by the factor, says that nothing within reach can be there."""
    if not len(of):
        return
    if node.rows is not None:
        square = (points[node.rows] ** 2).sum(axis=1)[None, :] - 2 * queries[of] @ points[node.rows].T
        square += (queries[of] ** 2).sum(axis=1)[:, None]
        found.add(of, node.rows, np.sqrt(np.maximum(square, 0)))
        return
    away = _distances(queries[of], node.vantage)
    inside = away < node.radius
    descend(node.inner, points, queries, of[inside], found, factor)
    descend(node.outer, points, queries, of[~inside], found, factor)
    crossing = np.abs(away - node.radius) * factor <= found.reach[of] + ROUNDING
    descend(node.outer, points, queries, of[inside & crossing], found, factor)
    descend(node.inner, points, queries, of[~inside & crossing], found, factor)


@dataclass
class Routes:
    """The top of the index: which shard group a point belongs to, and how near it can be."""

    root: Node
    longest: float

    def __post_init__(self):
        self.vantages, self.leaves = [], []
        self._number(self.root, [])

    def _number(self, node: Node, bounds: list) -> None:
        if node.rows is not None:
            node.rows, node.leaf, node.bounds = np.empty(0), len(self.leaves), bounds
            self.leaves.append(node)
            return
        i = len(self.vantages)
        self.vantages.append(node.vantage)
        self._number(node.inner, [*bounds, (i, 0.0, node.radius)])
        self._number(node.outer, [*bounds, (i, node.radius, np.inf)])

    def leaf_of(self, points: np.ndarray) -> np.ndarray:
        out = np.zeros(len(points), np.int32)

        def walk(node: Node, rows: np.ndarray) -> None:
            if node.rows is not None:
                out[rows] = node.leaf
            elif len(rows):
                near = _distances(points[rows], node.vantage) < node.radius
                walk(node.inner, rows[near])
                walk(node.outer, rows[~near])

        walk(self.root, np.arange(len(points)))
        return out

    def nearest(self, queries: np.ndarray) -> np.ndarray:
        """For each query and leaf, a distance that no point there undercuts."""
        away = np.stack([_distances(queries, v) for v in self.vantages], axis=1) if self.vantages else None
        least = np.zeros((len(queries), len(self.leaves)))
        for node in self.leaves:
            for i, lo, hi in node.bounds:
                np.maximum(least[:, node.leaf], lo - away[:, i], out=least[:, node.leaf])
                np.maximum(least[:, node.leaf], away[:, i] - hi, out=least[:, node.leaf])
        return least


def _matrix(vectors) -> np.ndarray:
    vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(vectors), -1)


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products, summed from the first component on: equal rows give equal numbers."""
    total = np.zeros(len(a))
    for i in range(a.shape[1]):
        total += a[:, i] * b[:, i]
    return total


def _lifted(points: np.ndarray, longest: float) -> np.ndarray:
    """One more coordinate gives all points the same length: nearest then means largest product."""
    rest = np.maximum(longest**2 - (points**2).sum(axis=1), 0)
    return np.concatenate([points, np.sqrt(rest)[:, None]], axis=1)


def _asking(points: np.ndarray, longest: float) -> np.ndarray:
    """Queries scaled to the same length, which changes no order."""
    points = points * (longest / np.sqrt((points**2).sum(axis=1)))[:, None]
    return np.concatenate([points, np.zeros((len(points), 1))], axis=1)


def usable(vector: Column) -> Column:
    """Not null, not zero, and without null or non-finite components."""
    bad = F.exists(
        vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    )
    return F.coalesce(vector.isNotNull() & ~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def _points(rows: DataFrame, k: int) -> DataFrame:
    """Each different vector once: its smallest id, its k + 1 smallest ids, whether it asks."""
    order = Window.partitionBy("vector").orderBy("vec_id")
    first = (
        rows.withColumn("n", F.row_number().over(order))
        .where(F.col("n") <= k + 1)
        .groupBy("vector")
        .agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    )
    asks = rows.groupBy("vector").agg(F.max("asks").alias("asks"))
    return first.join(asks, "vector").select(F.col("ids")[0].alias("rep"), "ids", "asks", "vector")


def _visit(points: DataFrame, asking: DataFrame, k: int, longest: float, factor: float) -> DataFrame:
    """Each query's best vectors in each shard it visits: (query, rep, score, away)."""
    keep = k + 1 + SPARE

    def search(shard: pa.Table, asked: pa.Table) -> pa.Table:
        shape = ("query", "rep", "score", "away")
        if not (shard.num_rows and asked.num_rows):
            return pa.table({c: pa.array([], pa.float64() if c in shape[2:] else pa.int64()) for c in shape})
        shard = shard.sort_by("rep")
        plain, wanted = _matrix(shard["vector"]), _matrix(asked["vector"])
        lifted, scaled = _lifted(plain, longest), _asking(wanted, longest)
        reach = asked["reach"].to_numpy()
        found = Found(len(wanted), min(keep, len(plain)), reach)
        descend(grow(lifted, LEAF_ROWS), lifted, scaled, np.arange(len(wanted)), found, factor)
        query, place = np.nonzero(found.row >= 0)
        row = found.row[query, place]
        return pa.table(
            {
                "query": asked["query"].to_numpy()[query],
                "rep": shard["rep"].to_numpy()[row],
                "score": _products(plain[row], wanted[query]),
                "away": found.away[query, place],
            }
        )

    keys = ("leaf", "part", "block")
    return (
        points.groupBy(*keys)
        .cogroup(asking.groupBy(*keys))
        .applyInArrow(search, "query bigint, rep bigint, score double, away double")
    )


def _best(found: DataFrame, keep: int) -> DataFrame:
    """The best `keep` vectors of each query."""
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), "rep")
    return found.withColumn("n", F.row_number().over(order)).where(F.col("n") <= keep).drop("n")


def search(
    vectors: DataFrame,
    queries: Column,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    k: int = 20,
    factor: float = 1.5,
    shard_rows: int = SHARD_ROWS,
) -> DataFrame:
    """Each query's k nearest rows by inner product: query_id, rank, vec_id, score.

    `queries` is a condition on vec_id. A tree of vantage points, fitted on SAMPLE_ROWS rows,
    deals all rows to groups; a group of more than `shard_rows` rows is dealt to shards by
    hash. Each shard grows its own tree. A query first visits its own group, which tells how
    far it has to reach, then all groups and branches that the triangle inequality does not
    exclude within that reach divided by `factor`: 1 is exact search, more is faster.

    Equal vectors are indexed once, with their k + 1 smallest ids, which is all that a result
    can hold; ties go to the smaller id. Vectors that are null, zero or hold null or
    non-finite components take no part, neither do rows without an id or, should lengths
    differ, vectors that have not the most frequent length. Of rows with one id, the smallest
    vector counts. An empty table gives an empty result. Other columns are not used.
    """
    spark = vectors.sparkSession
    rows = pick(vectors, vec_id=vec_id, vector=vector).where(
        F.col("vec_id").isNotNull() & usable(F.col("vector"))
    )
    rows = rows.groupBy("vec_id").agg(F.min("vector").alias("vector"))
    rows = parked(rows.withColumn("asks", F.coalesce(queries, F.lit(False))), "vectors")
    lengths = rows.groupBy(F.size("vector").alias("dims")).count()
    top = lengths.orderBy(F.col("count").desc(), "dims").first()
    shape = "query_id bigint, rank int, vec_id bigint, score double"
    if top is None:
        return spark.createDataFrame([], shape)
    rows = rows.where(F.size("vector") == top["dims"])
    points = parked(_points(rows, k), "points")
    square = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    total, longest, asking = points.agg(
        F.count("*"), F.sqrt(F.max(square)), F.count(F.when(F.col("asks"), 1))
    ).first()

    # Numbers stay of the type they have, for scores are those of the original vectors.
    kind = points.schema["vector"].dataType.simpleString()
    sample = hash_sample(points.select("rep", "vector"), ["rep"], total, SAMPLE_ROWS).toArrow()
    fitted = _lifted(_matrix(sample["vector"]), longest)
    least = max(ROUTE_ROWS, len(fitted) * shard_rows // max(total, 1))
    routes = Routes(grow(fitted, least), longest)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf = routes.leaf_of(_lifted(_matrix(batch["vector"]), longest))
            yield pa.RecordBatch.from_arrays(
                [batch["rep"], batch["vector"], pa.array(leaf)], ["rep", "vector", "leaf"]
            )

    placed = points.select("rep", "vector").mapInArrow(
        route, f"rep bigint, vector {kind}, leaf int"
    )
    placed = parked(placed, "placed")
    parts = {  # bounded by the number of leaves of a tree over the sample
        leaf: -(-n // shard_rows) for leaf, n in placed.groupBy("leaf").count().collect()
    }
    part_count = F.element_at(
        F.create_map(*(F.lit(x) for pair in sorted(parts.items()) for x in pair)), F.col("leaf")
    )
    blocks = -(-max(asking, 1) // BLOCK_QUERIES)
    shards = placed.select(
        "leaf",
        F.pmod(F.xxhash64("rep"), part_count).cast("int").alias("part"),
        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"),
        "rep",
        "vector",
    )

    def visits(first: bool):
        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                asked = _asking(_matrix(batch["vector"]), longest)
                reach = batch["reach"].to_numpy(zero_copy_only=False)
                own = routes.leaf_of(asked)
                if first:
                    query, leaf = np.arange(len(own)), own
                else:
                    near = routes.nearest(asked) * factor <= reach[:, None] + ROUNDING
                    near[np.arange(len(own)), own] = False
                    query, leaf = np.nonzero(near)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch["query"].take(pa.array(query)),
                        batch["vector"].take(pa.array(query)),
                        pa.array(reach[query]),
                        pa.array(leaf.astype(np.int32)),
                    ],
                    ["query", "vector", "reach", "leaf"],
                )

        return deal

    def dealt(asked: DataFrame, first: bool) -> DataFrame:
        out = asked.mapInArrow(
            visits(first), f"query bigint, vector {kind}, reach double, leaf int"
        )
        last = F.element_at(
            F.create_map(*(F.lit(x) for pair in sorted(parts.items()) for x in pair)), F.col("leaf")
        )
        return out.where(last.isNotNull()).select(
            "leaf",
            F.explode(F.sequence(F.lit(0), (last - 1).cast("int"))).alias("part"),
            F.pmod(F.xxhash64("query"), F.lit(blocks)).cast("int").alias("block"),
            "query",
            "vector",
            "reach",
        )

    asked = points.where("asks").select(F.col("rep").alias("query"), "vector")
    start = asked.withColumn("reach", F.lit(float("inf")))
    near = parked(_best(_visit(shards, dealt(start, True), k, longest, factor), k + 1), "near")
    reach = near.groupBy("query").agg(
        F.when(F.count("*") > k, F.max("away")).otherwise(float("inf")).alias("reach")
    )
    again = asked.join(reach, "query", "left").fillna(float("inf"), ["reach"])
    far = _visit(shards, dealt(again, False), k, longest, factor)
    best = _best(near.unionByName(far), k + 1)

    ids = points.select("rep", "ids")
    listed = (
        best.join(ids, "rep")
        .groupBy("query")
        .agg(F.collect_list(F.struct("score", "ids")).alias("found"))
    )
    asking_ids = (
        rows.where("asks")
        .select(F.col("vec_id").alias("query_id"), "vector")
        .join(points.where("asks").select(F.col("rep").alias("query"), "vector"), "vector")
        .select("query_id", "query")
    )
    each = (
        asking_ids.join(listed, "query")
        .select("query_id", F.explode("found").alias("f"))
        .select("query_id", "f.score", F.explode("f.ids").alias("vec_id"))
        .where("vec_id <> query_id")
    )
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return (
        each.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def brute_force(rows: list[tuple[int, list[float]]], k: int, asks) -> dict[int, list[int]]:
    """Every query against all rows, for tests and for measuring recall."""
    ids = np.array([i for i, _ in rows])
    points = np.array([v for _, v in rows], np.float64)
    out = {}
    for i, q in zip(ids, points, strict=True):
        if asks(int(i)):
            score = _products(points, np.broadcast_to(q, points.shape))
            order = [j for j in np.lexsort((ids, -score)) if ids[j] != i]
            out[int(i)] = [int(ids[j]) for j in order[:k]]
    return out


#: Twin of exact search with the queries of op4, for DuckDB.
SEARCH_SQL = """
WITH points AS (
    SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
    WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), scored AS (
    SELECT q.vec_id AS query_id, p.vec_id, list_inner_product(q.v, p.v) AS score
    FROM points q JOIN points p ON p.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored
) WHERE rank <= 20
"""
