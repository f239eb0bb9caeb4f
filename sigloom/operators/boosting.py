"""Histogram boosting of many models in the same passes.

Features are cut into bins once. Rows with equal bins and target have equal scores from the first tree
to the last, so they are folded to one cell with the number of rows that train each model. The cells that
train a model are dealt out by model, as tiles of at most about ``TILE_CELLS`` cells with the bins of its
features only. While a tile holds all cells of its model, the task that has it grows all trees without a
pass, and the models grow beside each other. With more tiles a pass makes one level of the trees of all
models: tasks add up gradient, curvature and number of rows by (model, node, feature, bin), and these sums
are added by (model, node) and searched for the best split. The trees of all models come to the driver: at
most 2 * leaves nodes each. Then every cell is scored by every model, also by those that it does not
train; rows take the scores of their cell.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from sigloom.functions.batches import stream_groups
from sigloom.operators.blocks import Blocks, Fit, Shape, numbers, reducers, rows_of, to_blocks
from sigloom.session import cut_lineage


@dataclass(frozen=True)
class BoostSpec:
    trees: int = 200
    rate: float = 0.05
    leaves: int = 15
    l2: float = 1.0
    bins: int = 64
    min_rows: int = 20
    min_curvature: float = 1e-3
    #: Trees after which the scores are written and the lineage is cut.
    checkpoint: int = 5

    def __post_init__(self) -> None:
        if not (2 <= self.bins <= 256 and self.leaves >= 2 and self.trees >= 1 and self.min_rows >= 1):
            raise ValueError("need 2 to 256 bins, at least 2 leaves, and a tree")

    @property
    def depth(self) -> int:
        return math.ceil(math.log2(self.leaves))


@dataclass
class Trees:
    """One tree of every model: nodes in heap order, children of i at 2i + 1 and 2i + 2."""

    feature: np.ndarray  # (models, nodes), -1 at a leaf
    bin: np.ndarray
    value: np.ndarray

    @classmethod
    def empty(cls, models: int, depth: int) -> Trees:
        nodes = (2 << depth) - 1
        return cls(np.full((models, nodes), -1, np.int32), np.zeros((models, nodes), np.int32), np.zeros((models, nodes)))

    def values(self, codes: np.ndarray, m: int) -> np.ndarray | float:
        """What the tree of a model gives for cells; ``codes``: (features, cells)."""
        return self.value[m].take(self.leaf_of(codes, m))

    def leaf_of(self, codes: np.ndarray, m: int) -> np.ndarray | int:
        """The node at which every cell ends, or 0 if the root was not split."""
        feature, bins = self.feature[m].tolist(), self.bin[m].astype(np.uint8)
        ids = np.arange(len(feature), dtype=np.min_scalar_type(len(feature)))

        def below(node: int) -> np.ndarray | int:
            if feature[node] < 0:
                return ids[node]
            left, right = below(2 * node + 1), below(2 * node + 2)
            # one of both by its bits: a choice by np.where takes several times as long
            return left ^ ((codes[feature[node]] > bins[node]).view(np.uint8) * (left ^ right))

        return below(0)


def codes_of(x: np.ndarray, edges: Sequence[np.ndarray]) -> np.ndarray:
    """The bin of every number."""
    return np.stack([np.searchsorted(e, x[:, i]) for i, e in enumerate(edges)], axis=1).astype(np.uint8)


@dataclass
class Boosted:
    """The fitted models."""

    spec: BoostSpec
    features: tuple[str, ...]
    edges: list[np.ndarray]
    start: np.ndarray
    trees: list[Trees] = field(default_factory=list)

    def totals(self, codes: np.ndarray) -> np.ndarray:
        """(cells, models): log odds of class 1 for ``codes`` (cells, features)."""
        columns, total = np.ascontiguousarray(codes.T), np.repeat(self.start[:, None], len(codes), axis=1)
        for t in self.trees:
            for m in range(len(total)):
                total[m] += t.values(columns, m)
        return np.ascontiguousarray(total.T)

    def score(self, df: DataFrame, name: str = "scores") -> DataFrame:
        """Adds the probability of class 1 by every model, as an array."""

        @F.pandas_udf("array<double>")
        def run(xs: pd.Series) -> pd.Series:
            total = self.totals(codes_of(np.stack(xs.to_numpy()), self.edges))
            return pd.Series(list(1 / (1 + np.exp(-total))))

        return df.withColumn(name, run(F.array(*[F.col(f).cast("double") for f in self.features])))


def bin_edges(df: DataFrame, features: Sequence[str], bins: int) -> list[np.ndarray]:
    """Upper bounds of all bins but the last: up to ``bins`` - 1 quantiles, in one aggregation."""
    at = F.array(*[F.lit((i + 1) / bins) for i in range(bins - 1)])
    found = df.agg(*[F.percentile_approx(F.col(f).cast("double"), at, 10_000).alias(f"q{i}") for i, f in enumerate(features)]).first()
    return [np.unique(np.array(found[f"q{i}"] or [], float)) for i in range(len(features))]


#: Histograms of single features that the driver adds up itself, 1.5 kB each with 64 bins; more are added
#: and searched by (model, node) in the cluster, and only the best split of each node comes back.
DIRECT_COLUMNS = 2048
_BEST = "model int, node int, gain double, feature int, bin int, g double, h double, n double, left_g double, left_h double, left_n double"


def best_split(sums: np.ndarray, spec: BoostSpec) -> tuple:
    """gain, feature, bin, totals and left sums of the best split of a node; ``sums``: (3, features,
    bins) of gradient, curvature and rows. The first feature and the lowest bin win ties."""
    total = sums[:, 0, :].sum(axis=1)
    left = np.cumsum(sums, axis=2)[:, :, :-1]
    right = total[:, None, None] - left
    score = lambda s: s[0] ** 2 / (s[1] + spec.l2 + 1e-300)
    gain = score(left) + score(right) - score(total)
    fits = (np.minimum(left[2], right[2]) >= spec.min_rows) & (np.minimum(left[1], right[1]) >= spec.min_curvature)
    gain = np.where(fits, gain, -np.inf)
    f, b = np.unravel_index(np.argmax(gain), gain.shape)
    return (float(gain[f, b]), int(f), int(b), *map(float, total), *map(float, left[:, f, b]))


@dataclass
class Tile:
    """Cells that train one model."""

    codes: np.ndarray  # (features of the model, cells)
    y: np.ndarray
    count: np.ndarray

    def slopes(self, score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gradient and curvature of every cell."""
        p = 1 / (1 + np.exp(-score))
        return (p - self.y) * self.count, p * (1 - p) * self.count

    def sums(self, slopes: tuple[np.ndarray, np.ndarray], tree: Trees, m: int, nodes: list[int], bins: int) -> np.ndarray:
        """(nodes, 3, features, bins): gradient, curvature and rows of the cells in the open ``nodes``."""
        size = tree.feature.shape[1]
        begins = np.full(size, -1)
        begins[nodes] = np.arange(len(nodes)) * bins
        codes, weights = self.codes, [*slopes, self.count]
        at = np.broadcast_to(begins.take(tree.leaf_of(codes, m)), self.y.shape)
        if at.size and at.min() < 0:
            inside = np.flatnonzero(at >= 0)
            at, codes, weights = at[inside], [c.take(inside) for c in codes], [w[inside] for w in weights]
        out = np.empty((len(nodes), 3, len(codes), bins))
        for f, c in enumerate(codes):
            cell = at + c
            for i, w in enumerate(weights):
                out[:, i, f] = np.bincount(cell, w, len(nodes) * bins).reshape(len(nodes), bins)
        return out


def fit_boosted(
    df: DataFrame, key: str, target: str, fits: Sequence[Fit], spec: BoostSpec = BoostSpec(), name: str = "scores"
) -> tuple[DataFrame, Boosted]:
    """(``df`` with the array ``name``: the probability of class 1 by every model of ``fits``, models).

    Trees grow level by level to at most ``leaves`` leaves; where a level would have more, the splits
    of largest gain stay. A model whose rows are all of one class, or that has none, gives a constant.
    """
    blocks = to_blocks(df, key, target, fits)
    shape = blocks.shape
    edges = bin_edges(df, shape.features, spec.bins)
    model = Boosted(spec, shape.features, edges, np.zeros(shape.models))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = [codes_of(numbers(r, "x", np.float64, len(edges)), edges).tobytes() for r in rows_of([batch])]
            yield batch.drop_columns(["x"]).append_column("codes", pa.array(codes, pa.binary()))

    fields = "part int, block int, rows int, kept binary, y binary, train binary, stop binary, codes binary"
    coded = cut_lineage(blocks.table.mapInArrow(encode, fields))
    cells, parts = _cells(coded, len(edges), shape.models)
    model.start, sizes = _start(cells, shape.models)
    _grow(cells, model, shape, parts, sizes)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [model.totals(numbers(r, "codes", np.uint8, len(edges))).tobytes() for r in rows_of([batch])]
            yield batch.append_column("score", pa.array(scores, pa.binary()))

    scored = cut_lineage(cells.select("rows", "codes").mapInArrow(score, "rows int, codes binary, score binary"))
    out = _of_rows(coded, scored, blocks, len(edges), name)
    return out.withColumn(name, F.transform(name, lambda s: 1 / (1 + F.exp(-s)))), model


#: Cells of one block, and blocks of cells: bins and target of each cell, and how many rows train each model.
CELL_ROWS = 4096
CELLS = "part int, block int, rows int, codes binary, y binary, train binary"


def fixed(flat: bytes | np.ndarray, width: int) -> pa.Array:
    """Bytes as binary values of ``width`` bytes each."""
    data = pa.py_buffer(flat)
    offsets = pa.array(np.arange(0, data.size + 1, width), pa.int32())
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, offsets.buffers()[1], data])


def _cells(coded: DataFrame, features: int, models: int) -> tuple[DataFrame, int]:
    """The cells of all rows as ``CELLS``, and the partitions of that table."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in rows_of(batches):
            columns = [fixed(r["codes"], features), pa.array(numbers(r, "y", np.float64)), fixed(r["train"], models)]
            yield pa.RecordBatch.from_arrays(columns, ["codes", "y", "train"])

    single = coded.select("codes", "y", "train").mapInArrow(rows, "codes binary, y double, train binary")
    folded = cut_lineage(single.groupBy("codes", "y", "train").agg(F.count(F.lit(1)).alias("n")))
    parts = max(1, -(-folded.select("codes", "y").distinct().count() // CELL_ROWS))
    placed = folded.repartition(parts, "codes").sortWithinPartitions("codes", "y", "train").withColumn("part", F.spark_partition_id())

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, batch in enumerate(batches):  # a cell on the border of two batches becomes two, with the same sums
            codes = np.frombuffer(b"".join(batch.column("codes").to_pylist()), np.uint8).reshape(-1, features)
            y, n = batch.column("y").to_numpy(), batch.column("n").to_numpy()
            train = np.frombuffer(b"".join(batch.column("train").to_pylist()), np.uint8).reshape(-1, models)
            first = np.flatnonzero(np.append(True, (codes[1:] != codes[:-1]).any(axis=1) | (y[1:] != y[:-1])))
            counts = np.add.reduceat(train * n[:, None].astype(float), first, axis=0)
            values = [batch.column("part")[0].as_py(), block, len(first), codes[first].tobytes(), y[first].tobytes(), counts.tobytes()]
            kinds = [pa.int32()] * 3 + [pa.binary()] * 3
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], [c.split()[0] for c in CELLS.split(", ")])

    return cut_lineage(placed.mapInArrow(pack, CELLS)), parts


def _of_rows(coded: DataFrame, state: DataFrame, blocks: Blocks, features: int, name: str) -> DataFrame:
    """The original rows with ``name``: the score of their cell by every model."""
    models = blocks.shape.models

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in rows_of(batches):
            for kept in pa.ipc.open_stream(r["kept"]).read_all().combine_chunks().to_batches():
                yield pa.RecordBatch.from_arrays([*kept.columns, fixed(r["codes"], features)], [*kept.schema.names, "_codes"])

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in rows_of(batches):
            offsets = pa.array(np.arange(0, (r["rows"] + 1) * models, models)[: r["rows"] + 1], pa.int32())
            values = pa.ListArray.from_arrays(offsets, pa.array(numbers(r, "score", np.float64)))
            yield pa.RecordBatch.from_arrays([fixed(r["codes"], features), values], ["_codes", name])

    found = state.select("rows", "codes", "score").mapInArrow(scores, f"_codes binary, {name} array<double>").dropDuplicates(["_codes"])
    single = coded.select("kept", "codes").mapInArrow(rows, StructType([*blocks.kept.fields, StructField("_codes", BinaryType())]))
    return single.join(found, "_codes").select(*blocks.kept.names, name)


def _start(coded: DataFrame, models: int) -> tuple[np.ndarray, np.ndarray]:
    """Log odds of each model's rows, 40 or -40 for rows of one class; and the cells that train it."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, positive, cells = (np.zeros(models, np.int64) for _ in range(3))
        for r in rows_of(batches):
            train, y = numbers(r, "train", np.float64, models).astype(np.int64), numbers(r, "y", np.float64)
            n += train.sum(axis=0)
            positive += train[y == 1].sum(axis=0)
            cells += (train > 0).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(models), pa.int32()), *map(pa.array, (n, positive, cells))], ["model", "n", "p", "cells"])

    rows = coded.select("train", "y").mapInArrow(count, "model int, n long, p long, cells long").groupBy("model").agg(*[F.sum(c).alias(c) for c in ("n", "p", "cells")])
    start, sizes = np.full(models, -40.0), np.zeros(models, np.int64)
    for r in rows.collect():  # one row per model
        n, p = r["n"], r["p"]
        start[r["model"]] = -40.0 if not p else 40.0 if p == n else math.log(p / (n - p))
        sizes[r["model"]] = r["cells"]
    return start, sizes


#: Cells of a tile, about: a task has the bins of so many cells and some numbers for each.
TILE_CELLS = 1 << 20
TILES = "slot int, model int, codes binary, y binary, count binary"


def _tiles(cells: DataFrame, shape: Shape, parts: int, sizes: np.ndarray) -> tuple[DataFrame, int, bool]:
    """(``TILES``, a partition for each; how many; whether every model has but one). Those that take
    longest come first."""
    tiles = np.minimum(-(-sizes // TILE_CELLS), parts)
    cost = sizes / np.maximum(tiles, 1) * [len(c) for c in shape.columns]
    order = [(m, i) for m in np.argsort(-cost, kind="stable").tolist() for i in range(tiles[m])]
    slots, features = {where: slot for slot, where in enumerate(order)}, len(shape.features)
    names = ["slot", "model", "part", "block", "codes", "y", "count"]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in rows_of(batches):
            codes, y = numbers(r, "codes", np.uint8, features).T, numbers(r, "y", np.float64)
            train = np.ascontiguousarray(numbers(r, "train", np.float64, shape.models).T)
            out = []
            for m, columns in enumerate(shape.columns):
                rows = np.flatnonzero(train[m])
                if len(rows):
                    slot = slots[m, r["part"] * int(tiles[m]) // parts]
                    out.append((slot, m, r["part"], r["block"], codes[np.ix_(columns, rows)].tobytes(), y[rows].tobytes(), train[m, rows].tobytes()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if i < 4 else pa.binary()) for i, c in enumerate(zip(*out))], names)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(rows_of(batches))
        if held:
            codes = np.concatenate([numbers(r, "codes", np.uint8).reshape(len(shape.columns[r["model"]]), -1) for r in held], axis=1)
            values = [held[0]["slot"], held[0]["model"], codes.tobytes(), *(b"".join(r[c] for r in held) for c in ("y", "count"))]
            yield pa.RecordBatch.from_arrays([pa.array([v], pa.int32() if i < 2 else pa.binary()) for i, v in enumerate(values)], [c.split()[0] for c in TILES.split(", ")])

    dealt = cells.mapInArrow(deal, "slot int, model int, part int, block int, codes binary, y binary, count binary")
    placed = dealt.repartitionById(max(1, len(order)), "slot").sortWithinPartitions("slot", "part", "block")
    return placed.mapInArrow(join, TILES), len(order), bool((tiles <= 1).all())


def _tile(row: dict) -> Tile:
    y = numbers(row, "y", np.float64)
    return Tile(numbers(row, "codes", np.uint8).reshape(-1, len(y)), y, numbers(row, "count", np.float64))


def _grow(cells: DataFrame, model: Boosted, shape: Shape, parts: int, sizes: np.ndarray) -> None:
    """Append all trees to ``model``."""
    tiles, number, whole = _tiles(cells, shape, parts, sizes)
    grown = _grow_alone(tiles, model, shape) if whole else _grow_by_level(tiles, model, shape, number)
    for trees in grown:  # places among the features of a model become those among all
        for m, columns in enumerate(shape.columns):
            trees.feature[m] = np.where(trees.feature[m] >= 0, np.array(columns)[np.maximum(trees.feature[m], 0)], -1)
        model.trees.append(trees)


def _grow_alone(tiles: DataFrame, model: Boosted, shape: Shape) -> list[Trees]:
    """All trees of a model in the task that has its tile."""
    spec, start = model.spec, model.start

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in rows_of(batches):
            tile, trees = _tile(r), [Trees.empty(1, spec.depth) for _ in range(spec.trees)]
            score = np.full(len(tile.y), start[r["model"]])
            for tree in trees:
                slopes, nodes, leaves = tile.slopes(score), [0], 1
                for _ in range(spec.depth):
                    sums = tile.sums(slopes, tree, 0, nodes, spec.bins)
                    nodes, leaves = split_nodes(tree, 0, [(n, *best_split(s, spec)) for n, s in zip(nodes, sums)], leaves, spec)
                    if not nodes:
                        break
                score += tree.values(tile.codes, 0)
            values = [np.stack([getattr(t, c)[0] for t in trees]).tobytes() for c in ("feature", "bin", "value")]
            yield pa.RecordBatch.from_arrays([pa.array([r["model"]], pa.int32()), *(pa.array([v], pa.binary()) for v in values)], ["model", "feature", "bin", "value"])

    out = [Trees.empty(shape.models, spec.depth) for _ in range(spec.trees)]
    for r in tiles.mapInArrow(run, "model int, feature binary, bin binary, value binary").collect():  # one row per model
        for c, kind in (("feature", np.int32), ("bin", np.int32), ("value", np.float64)):
            for tree, row in zip(out, np.frombuffer(r[c], kind).reshape(spec.trees, -1)):
                getattr(tree, c)[r["model"]] = row
    return out


def _grow_by_level(tiles: DataFrame, model: Boosted, shape: Shape, number: int) -> Iterator[Trees]:
    """The trees of all models level by level, a pass over ``number`` tiles for each."""
    spec, start = model.spec, model.start
    fields = TILES + ", score binary"

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [np.full(len(numbers(r, "y", np.float64)), start[r["model"]]).tobytes() for r in rows_of([batch])]
            yield batch.append_column("score", pa.array(scores, pa.binary()))

    state = cut_lineage(tiles.mapInArrow(begin, fields))
    for tree in range(spec.trees):
        trees = Trees.empty(shape.models, spec.depth)
        _levels(state, trees, shape, spec, number)

        def add(batches: Iterator[pa.RecordBatch], trees: Trees = trees) -> Iterator[pa.RecordBatch]:
            at = fields.split(", ").index("score binary")
            for batch in batches:
                scores = [(numbers(r, "score", np.float64) + trees.values(_tile(r).codes, r["model"])).tobytes() for r in rows_of([batch])]
                yield batch.set_column(at, "score", pa.array(scores, pa.binary()))

        moved = state.mapInArrow(add, fields)
        if (tree + 1) % spec.checkpoint == 0:
            moved = cut_lineage(moved)
            state.unpersist()
            state = moved
        else:
            state = moved.persist()
        yield trees
    state.unpersist()


def split_nodes(trees: Trees, m: int, found: list[tuple], leaves: int, spec: BoostSpec) -> tuple[list[int], int]:
    """Split open nodes of a model; ``found``: node, then ``best_split`` of each. (Nodes that are open
    now, leaves.)"""
    nodes = []
    for node, _, _, _, g, h, *_ in found:
        if node == 0:
            trees.value[m, 0] = -spec.rate * g / (h + spec.l2 + 1e-300)
    useful = sorted((r for r in found if r[1] > 1e-12), key=lambda r: (-r[1], r[0]))
    for node, _, feature, at, g, h, n, left_g, left_h, left_n in useful[: spec.leaves - leaves]:
        trees.feature[m, node], trees.bin[m, node] = feature, at
        for child, cg, ch, cn in ((2 * node + 1, left_g, left_h, left_n), (2 * node + 2, g - left_g, h - left_h, n - left_n)):
            trees.value[m, child] = -spec.rate * cg / (ch + spec.l2 + 1e-300)
            if cn >= 2 * spec.min_rows:
                nodes.append(child)
        leaves += 1
    return ([] if leaves >= spec.leaves else sorted(nodes)), leaves


def _levels(state: DataFrame, trees: Trees, shape: Shape, spec: BoostSpec, tiles: int) -> None:
    """Fill ``trees``, one pass for each level."""
    open_nodes = {m: [0] for m in range(shape.models)}
    leaves = dict.fromkeys(open_nodes, 1)
    for _ in range(spec.depth):

        def histograms(batches: Iterator[pa.RecordBatch], now: dict = open_nodes) -> Iterator[pa.RecordBatch]:
            for r in rows_of(batches):
                m = r["model"]
                if m in now:
                    tile = _tile(r)
                    sums = tile.sums(tile.slopes(numbers(r, "score", np.float64)), trees, m, now[m], spec.bins)
                    values = [[m] * len(now[m]), now[m], [r["slot"]] * len(now[m])]
                    yield pa.RecordBatch.from_arrays(
                        [*(pa.array(v, pa.int32()) for v in values), pa.array([s.tobytes() for s in sums], pa.binary())], ["model", "node", "part", "sums"]
                    )

        def best(rows: list) -> Iterator[tuple]:
            columns = len(shape.columns[rows[0].model])
            sums = sum(np.frombuffer(r.sums).reshape(3, columns, spec.bins) for r in rows)
            yield rows[0].model, rows[0].node, *best_split(sums, spec)

        parts = state.mapInArrow(histograms, "model int, node int, part int, sums binary")
        per_model = -(-tiles // shape.models)
        if per_model * sum(len(n) * len(shape.columns[m]) for m, n in open_nodes.items()) <= DIRECT_COLUMNS:
            rows = sorted(parts.collect(), key=lambda r: (r.model, r.node, r.part))
            found = [tuple(s) for _, g in groupby(rows, key=lambda r: (r.model, r.node)) for s in best(list(g))]
        else:
            found = stream_groups(parts, ["model", "node"], ["part"], _BEST, best, reducers(shape.models)).collect()  # a row per open node
        by_model: dict[int, list] = {}
        for m, *split in sorted(tuple(r) for r in found):
            by_model.setdefault(m, []).append(tuple(split))
        open_nodes = {}
        for m, rows in by_model.items():
            nodes, leaves[m] = split_nodes(trees, m, rows, leaves[m], spec)
            if nodes:
                open_nodes[m] = nodes
        if not open_nodes:
            return


def held_out_score(fold: str, folds: Sequence, name: str = "scores", offset: int = 0) -> Column:
    """From the array of all scores, that of the model that never saw the row's fold."""
    at = F.lit(None).cast("int")
    for i, f in enumerate(folds):
        at = F.when(F.col(fold) == F.lit(f), F.lit(offset + i)).otherwise(at)
    return F.get(name, at)


def cross_fit_boosted(
    df: DataFrame, features: Sequence[str], fold: str = "fold", target: str = "target", key: str = "sample_id", spec: BoostSpec = BoostSpec()
) -> DataFrame:
    """Out-of-fold probabilities: the models of all folds grow in the same passes."""
    folds = sorted(r[0] for r in df.select(fold).distinct().collect())
    if len(folds) < 2:
        raise ValueError("cross-fitting needs at least two folds")
    fits = [Fit(tuple(features), F.col(fold) != F.lit(f)) for f in folds]
    scored, _ = fit_boosted(df, key, target, fits, spec)
    return scored.withColumn("probability", held_out_score(fold, folds)).drop("scores")
