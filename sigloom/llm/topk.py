"""Exact top-k inner-product search: ball-tree branch and bound in every shard.

Candidates are placed into cells, the balls around the nearest of a bounded number of centres, and cells
into shards of bounded size. A task builds a ball tree over its shard and visits the nodes in the order of
their upper bound on the inner product, q.c + |q| r. Each query's current kth score is shared: within a
task it rises with every leaf, and a first pass over one pilot shard gives a score that at least k
candidates reach. With it a query is sent only to the shards of cells whose bound is not below, and all of
them start from it.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigloom.session import cut_lineage

LEAF_ROWS = 128
CELLS = 1024  # centres over all lengths of vectors
SAMPLE_NUMBERS = 1 << 21  # components of the draw that the centres are fitted on
PART_BLOCKS = 64  # blocks of queries that meet one copy of a shard
SHARD = ["dim", "cell", "sub"]
NONE = -(2**62)
FOUND = "query_id long, vec_id long, score long"


def integer_vectors(vectors: DataFrame, scale: int = 1024) -> DataFrame:
    """vec_id and vec = floor(scale * x) per component, as long.

    Vectors that are null, empty or hold a null or non-finite component take no part; nor do
    rows without a vec_id.
    """
    xs = F.col("embedding").cast("array<double>")
    bad = F.exists(xs, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.where(F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & ~bad).select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.transform(xs, lambda x: F.floor(x * F.lit(float(scale))).cast("long")).alias("vec"),
    )


class BallTree:
    """Median splits on the widest direction; nodes are consecutive slices of ``order``."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF_ROWS):
        self.order = np.arange(len(points))
        self.nodes: list[tuple[int, int, int, int]] = []  # start, end, left, right
        centers, radii = [], []
        todo = [(0, len(points), -1, 0)]
        while todo:
            a, b, parent, side = todo.pop()
            here = points[self.order[a:b]]
            center = here.mean(axis=0)
            far = np.sqrt(((here - center) ** 2).sum(axis=1).max())
            k = len(self.nodes)
            self.nodes.append((a, b, -1, -1))
            centers.append(center)
            radii.append(far)
            if parent >= 0:
                s, e, left, right = self.nodes[parent]
                self.nodes[parent] = (s, e, k, right) if side == 0 else (s, e, left, k)
            if b - a > leaf and far > 0:
                pole = here[((here - center) ** 2).sum(axis=1).argmax()]
                other = here[((here - pole) ** 2).sum(axis=1).argmax()]
                along = here @ (other - pole)
                half = (b - a) // 2
                self.order[a:b] = self.order[a:b][np.argpartition(along, half)]
                todo += [(a, a + half, k, 0), (a + half, b, k, 1)]
        self.centers, self.radii = np.array(centers), np.array(radii)


class Shard:
    """Points of one shard with their ball tree, built once for all blocks of queries."""

    def __init__(self, points: np.ndarray, ids: np.ndarray):
        self.whole, self.ids = points, ids
        self.points = points.astype(np.float64)
        self.most = max(abs(int(points.max())), abs(int(points.min())))
        self.tree = BallTree(self.points)


def _upper(wide: np.ndarray, centers: np.ndarray, radii: np.ndarray) -> np.ndarray:
    """Largest inner product that each row of ``wide`` can reach in each ball, errors of doubles added."""
    size = np.linalg.norm(wide, axis=1)[:, None]
    slack = 1e-9 * size * (np.linalg.norm(centers, axis=1) + radii)[None, :] + 1e-6
    return wide @ centers.T + size * radii[None, :] + slack


def search(queries, query_ids, floors, shard: Shard, k: int):
    """Best k candidates of each query in one shard, by descending score, then ascending id.

    ``queries`` and points are integers, ``floors`` a score that k candidates are known to reach
    somewhere; lower ones are left out. Scores are exact: products that stay below 2**53 are taken in
    doubles, others in 64-bit integers, and components whose products may pass 64 bits raise.
    """
    n = len(queries)
    most = queries.shape[1] * max(abs(int(queries.max())), abs(int(queries.min()))) * shard.most
    if most >= 1 << 62:
        raise ValueError("inner products of these components may not fit 64 bits")
    tree, wide = shard.tree, queries.astype(np.float64)
    bounds = _upper(wide, tree.centers, tree.radii)
    best = np.full((n, k), NONE, np.int64)
    who = np.full((n, k), np.iinfo(np.int64).max, np.int64)
    floors = floors.astype(np.int64)
    frontier = [(0.0, 0, np.arange(n))]
    while frontier:  # the node with the largest bound over the queries that reach it comes next
        _, node, rows = heapq.heappop(frontier)
        rows = rows[bounds[rows, node] >= floors[rows]]
        if not len(rows):
            continue
        a, b, left, right = tree.nodes[node]
        if left >= 0:
            for child in (left, right):
                heapq.heappush(frontier, (-bounds[rows, child].max(), child, rows))
            continue
        inside = tree.order[a:b]
        own = shard.ids[inside]
        if most < 1 << 53:
            scores = (wide[rows] @ shard.points[inside].T).astype(np.int64)
        else:
            scores = queries[rows] @ shard.whole[inside].T
        scores[query_ids[rows][:, None] == own[None, :]] = NONE
        for r, line in zip(rows.tolist(), scores):
            near = np.flatnonzero(line >= max(floors[r], NONE + 1))
            if not len(near):
                continue
            s, w = np.concatenate([best[r], line[near]]), np.concatenate([who[r], own[near]])
            keep = np.lexsort((w, -s))[:k]
            best[r], who[r] = s[keep], w[keep]
            floors[r] = max(floors[r], best[r][-1])
    hit = best > NONE
    return np.repeat(query_ids, hit.sum(axis=1)), who[hit], best[hit]


def _centers(points: DataFrame, rows: int, shard_rows: int) -> dict[int, np.ndarray]:
    """Centres of the cells of every length of vectors, from a bounded draw.

    The draw holds about ``SAMPLE_NUMBERS`` components. It decides which vectors lie together, never
    which are found. Lengths that are not drawn have one cell without a bound.
    """
    longest = points.agg(F.max("dim")).first()[0] or 1
    wanted = max(CELLS, SAMPLE_NUMBERS // longest)
    share = min(1.0, wanted / max(rows, 1))
    drawn = points.where(F.rand(23) < share).limit(2 * wanted).select("dim", "vec").toPandas()
    centers = {}
    for dim, part in drawn.groupby("dim"):
        cells = min(math.ceil(len(part) / share / shard_rows), CELLS * len(part) // len(drawn), len(part))
        sample = np.stack(part["vec"].to_numpy()).astype(np.float64)
        tree = BallTree(sample, max(1, -(-len(part) // max(1, cells))))
        leaves = [i for i, (_, _, left, _) in enumerate(tree.nodes) if left < 0]
        centers[int(dim)] = tree.centers[leaves]
    return centers


def _placed(points: DataFrame, centers: dict[int, np.ndarray]) -> DataFrame:
    """Adds cell, the nearest centre of the vector's length, and its distance (infinite without centres)."""

    @F.pandas_udf("cell int, far double")
    def nearest(vecs: pd.Series) -> pd.DataFrame:
        cell, far = np.zeros(len(vecs), np.int32), np.full(len(vecs), np.inf)
        dims = vecs.map(len).to_numpy()
        for dim in set(dims.tolist()) & set(centers):
            at = np.flatnonzero(dims == dim)
            wide, c = np.stack(vecs.iloc[at].to_numpy()).astype(np.float64), centers[dim]
            cell[at] = ((c**2).sum(axis=1)[None, :] - 2 * wide @ c.T).argmin(axis=1)
            far[at] = np.linalg.norm(wide - c[cell[at]], axis=1)
        return pd.DataFrame({"cell": cell, "far": far})

    return points.withColumn("_place", nearest("vec")).select("*", "_place.cell", "_place.far").drop("_place")


class Balls:
    """Cells of each length: centres, radii and whether k candidates lie inside. Bounded by ``CELLS``."""

    def __init__(self, centers: dict[int, np.ndarray], sizes: DataFrame, k: int):
        self.of = {}
        known = sizes.where(F.col("dim").isin(*centers)) if centers else sizes.limit(0)
        found = known.select("dim", "cell", "radius", "n").toPandas()
        for dim, part in found.groupby("dim"):
            ids = part["cell"].to_numpy(np.int32)
            self.of[int(dim)] = (ids, centers[int(dim)][ids], part["radius"].to_numpy(float), part["n"].to_numpy() > k)

    def pilot(self) -> Callable[[Column], Column]:
        """The cell whose centre has the largest product, of those that hold more than k vectors."""
        of = self.of

        @F.pandas_udf("int")
        def best(vecs: pd.Series) -> pd.Series:
            out = np.zeros(len(vecs), np.int32)
            dims = vecs.map(len).to_numpy()
            for dim in set(dims.tolist()) & set(of):
                at = np.flatnonzero(dims == dim)
                ids, c, _, enough = of[dim]
                product = np.stack(vecs.iloc[at].to_numpy()).astype(np.float64) @ c.T
                out[at] = ids[(np.where(enough, product, -np.inf) if enough.any() else product).argmax(axis=1)]
            return pd.Series(out)

        return best

    def reached(self) -> Callable[[Column, Column], Column]:
        """All cells whose upper bound is not below the floor of the query."""
        of = self.of

        @F.pandas_udf("array<int>")
        def within(vecs: pd.Series, floors: pd.Series) -> pd.Series:
            out = [[0]] * len(vecs)
            dims = vecs.map(len).to_numpy()
            for dim in set(dims.tolist()) & set(of):
                at = np.flatnonzero(dims == dim)
                ids, c, radii, _ = of[dim]
                bounds = _upper(np.stack(vecs.iloc[at].to_numpy()).astype(np.float64), c, radii)
                for i, hit in zip(at, bounds >= floors.iloc[at].to_numpy()[:, None]):
                    out[i] = ids[hit].tolist()
            return pd.Series(out)

        return within


def _searched(points: DataFrame, asked: DataFrame, k: int, block_rows: int) -> DataFrame:
    """query_id, vec_id, score: the best k of every (query, shard) pair in ``asked``.

    Both sides have dim, cell, sub. The rows of a shard come first, then its queries: the tree is built
    once and queries stream past it in blocks. A shard that more than ``PART_BLOCKS`` blocks ask is copied
    for each further lot of them, so that no task meets an unbounded number.
    """
    asked = cut_lineage(asked)
    lot = PART_BLOCKS * block_rows
    lots = cut_lineage(asked.groupBy(*SHARD).agg(F.ceil(F.count(F.lit(1)) / F.lit(lot)).cast("int").alias("parts")))
    tasks = lots.agg(F.sum("parts")).first()[0] or 1
    asked = asked.join(lots, SHARD).withColumn("part", F.pmod(F.xxhash64(F.lit(1), "vec_id", "vec"), F.col("parts")).cast("int"))
    there = points.join(lots, SHARD).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    columns = [*SHARD, "part", "vec_id", "vec"]
    rows = there.select(*columns, F.lit(0).alias("kind"), F.lit(NONE).cast("long").alias("floor")).unionAll(
        asked.select(*columns, F.lit(1).alias("kind"), "floor")
    )
    group = [*SHARD, "part"]
    parallel = points.sparkSession.sparkContext.defaultParallelism
    rows = rows.repartition(min(tasks, max(parallel, tasks // 4)), *group).sortWithinPartitions(*group, "kind")

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, held, shard = None, [], None
        for frame in frames:
            for here, part in frame.groupby(group, sort=False):
                if here != key:
                    key, held, shard = here, [], None
                own, ask = part[part["kind"] == 0], part[part["kind"] == 1]
                if len(own):
                    held.append((np.stack(own["vec"].to_numpy()), own["vec_id"].to_numpy()))
                if not len(ask) or not (held or shard):
                    continue
                if shard is None:
                    shard, held = Shard(np.concatenate([p for p, _ in held]), np.concatenate([i for _, i in held])), []
                for a in range(0, len(ask), block_rows):
                    q = ask.iloc[a : a + block_rows]
                    found = search(np.stack(q["vec"].to_numpy()), q["vec_id"].to_numpy(), q["floor"].to_numpy(), shard, k)
                    yield pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), found)))

    return rows.mapInPandas(work, FOUND)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, shard_rows: int = 8192, block_rows: int = 512) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k largest inner products of every query.

    Both sides have vec_id and vec (``integer_vectors``). Ties go to the smaller vec_id. Rows
    with the query's own vec_id are left out; rows that repeat another vec_id are candidates of
    their own; a query that is repeated is answered once per distinct vector and then keeps its
    k best. Vectors meet only vectors of the same length. Fewer than k candidates: all of them.

    A query is sent to one pilot shard, then to the shards of those cells only whose ball can hold a
    score of its floor or more. Shards grow in number, not in size, with the table: a cell that holds
    more than ``shard_rows`` vectors is dealt into several by hash.
    """
    narrow = [F.col("vec_id").alias("vec_id"), F.col("vec").alias("vec"), F.size("vec").alias("dim")]
    points = cut_lineage(vectors.select(*narrow))
    centers = _centers(points, points.count(), shard_rows)
    points = cut_lineage(_placed(points, centers))
    sizes = cut_lineage(
        points.groupBy("dim", "cell").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("radius"))
        .withColumn("subs", F.ceil(F.col("n") / F.lit(shard_rows)).cast("int"))
    )
    balls = Balls(centers, sizes, k)
    subs = sizes.select("dim", "cell", "subs")
    dealt = F.pmod(F.xxhash64(F.lit(2), "vec_id", "vec"), F.col("subs")).cast("int")
    points = points.join(subs, ["dim", "cell"]).select("vec_id", "vec", "dim", "cell", dealt.alias("sub"))

    asked = queries.select(*narrow).distinct().withColumn("cell", balls.pilot()("vec"))
    asked = cut_lineage(asked.join(subs, ["dim", "cell"]).withColumns({"sub": dealt, "floor": F.lit(NONE).cast("long")}).drop("subs"))
    seen = cut_lineage(_searched(points, asked, k, block_rows))
    floors = (
        seen.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("floor")).where(F.col("n") == k)
        .select(F.col("query_id").alias("vec_id"), "floor")
    )
    pilots = asked.drop("floor").withColumnsRenamed({"cell": "_cell", "sub": "_sub"})
    pairs = pilots.join(floors, "vec_id", "left").withColumn("floor", F.coalesce("floor", F.lit(NONE).cast("long")))
    pairs = pairs.withColumn("cell", F.explode(balls.reached()("vec", "floor"))).join(subs, ["dim", "cell"])
    pairs = pairs.withColumn("sub", F.explode(F.sequence(F.lit(0), F.col("subs") - 1)))
    pairs = pairs.where((F.col("cell") != F.col("_cell")) | (F.col("sub") != F.col("_sub")))
    found = seen.unionAll(_searched(points, pairs.select("vec_id", "vec", *SHARD, "floor"), k, block_rows))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"
    )
