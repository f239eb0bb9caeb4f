"""Near-duplicate detection by a chosen-path set similarity join.

Every document is the set of its word shingles. Independent trees branch the documents by
selected minwise tokens: a node of a tree selects coordinates of the MinHash signature, 1/threshold
of them on average, and a document goes to the child of every (coordinate, value) it has, so that a
pair at the threshold meets in about one child of each node where it meets. Nodes that are small
are compared exhaustively, larger ones branch again. Trees are repeated until the recall is there.
Candidates that the signatures leave possible are confirmed on the full sets of shingles.

Equal sets are one class and take part once. Of every node, a maximum spanning forest of the
possible pairs is confirmed first, which connects a group of near copies by few pairs. Then the
members that may still be linked with another group are compared on their full sets inside their
nodes, so that no pair of unconnected documents is passed over; a node too large for one comparison
is compared part by part, every part with every other.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigloom.llm.store import stored
from sigloom.llm.text import chunks, mix, seeds, utf8, word_hashes

_U = np.uint64
COORDINATES = 128
#: A signature keeps one byte of each minimum, so 1 in 256 coordinates agrees by chance.
CHANCE = 1 / 256


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of the word shingles of each text. A text with fewer words
    has its whole sequence as one shingle; one without words has none."""
    hashes, firsts = word_hashes(data, offsets)
    factors = seeds(words + 1, 77)
    n = max(0, len(hashes) - words + 1)
    rolled = np.zeros(n, np.uint64)
    for i in range(words):
        rolled += hashes[i : i + n] * factors[i]
    rolled = mix(rolled)
    out = []
    for a, b in zip(firsts[:-1].tolist(), firsts[1:].tolist()):
        if b - a >= words:
            out.append(np.unique(rolled[a : b - words + 1]))
        elif b > a:
            terms = np.append(hashes[a:b] * factors[: b - a], factors[words : words + 1] * _U(b - a))
            out.append(mix(terms.sum(dtype=np.uint64, keepdims=True)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def minwise(shingles: np.ndarray) -> np.ndarray:
    """Minimum over the set of each of ``COORDINATES`` hash functions, 32 bits each."""
    low = (shingles >> _U(32)).astype(np.uint32)
    out = np.full(COORDINATES, np.iinfo(np.uint32).max, np.uint32)
    for a in range(0, len(low), 1024):
        np.minimum(out, ((low[a : a + 1024, None] ^ _XORS) * _FACTORS).min(axis=0), out=out)
    return out


_FACTORS = (seeds(COORDINATES, 5) >> _U(20)).astype(np.uint32) | np.uint32(1)
_XORS = (seeds(COORDINATES, 6) >> _U(20)).astype(np.uint32)


def root_branches(trees: int, threshold: float) -> list[tuple[int, int]]:
    """(tree, coordinate) selected by the roots: 1/threshold per tree on average, all different."""
    total = min(COORDINATES, math.ceil(trees / threshold))
    order = np.random.default_rng(3).permutation(COORDINATES)
    return [(i % trees, int(order[i])) for i in range(total)]


def sketch(docs: DataFrame, words: int, trees: int, threshold: float) -> DataFrame:
    """doc_id, n_shingles, two halves of the set's digest, signature, and its nodes of the first level."""
    branches = root_branches(trees, threshold)
    tree = np.array([t for t, _ in branches], np.uint64)
    coordinate = np.array([c for _, c in branches])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks(whole):
                sets = shingle_sets(*utf8(batch.column("text")), words)
                minima = np.array([minwise(s) for s in sets], np.uint32).reshape(len(sets), COORDINATES)
                nodes = mix(
                    minima[:, coordinate].astype(np.uint64)
                    + (tree * _U(COORDINATES) + coordinate.astype(np.uint64) + _U(1))[None, :] * _U(0x9E3779B97F4A7C15)
                ).view(np.int64)
                digests = np.frombuffer(b"".join(hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets), np.int64)
                count = len(branches)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id"),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array(digests[::2]),
                        pa.array(digests[1::2]),
                        pa.array([m.tobytes() for m in (mix(minima.astype(np.uint64)) & _U(255)).astype(np.uint8)], pa.binary()),
                        pa.ListArray.from_arrays(pa.array(np.arange(0, count * len(sets) + 1, count), pa.int32()), pa.array(nodes.ravel())),
                    ],
                    ["doc_id", "n_shingles", "d1", "d2", "sig", "nodes"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_shingles long, d1 long, d2 long, sig binary, nodes array<long>"
    return docs.select("doc_id", "text").mapInArrow(work, schema)


def _sizes(rows: DataFrame) -> DataFrame:
    """node and size of nodes with 2 members and more. It is written out, so that a node that
    holds a third of all rows can be split in the joins that follow."""
    return stored(rows.groupBy("node").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "sizes")


def _split(rows: DataFrame, leaf: int) -> tuple[DataFrame, DataFrame]:
    """Rows (node, id, sig) of nodes with 2 to ``leaf`` members, and of larger ones."""
    sized = stored(rows.join(_sizes(rows), "node"), "nodes")
    return sized.where(F.col("size") <= leaf).drop("size"), sized.where(F.col("size") > leaf).drop("size")


def leaves(members: DataFrame, threshold: float, leaf: int, levels: int) -> tuple[DataFrame, DataFrame]:
    """(node, id, sig) of the nodes with at most ``leaf`` members, and of the larger ones whose
    members do not come apart in ``levels`` levels. ``members``: id, sig, nodes."""
    rows = members.select(F.explode("nodes").alias("node"), "id", "sig")
    # Only ids travel until the single nodes, which are most of them, are gone.
    met = rows.select("node", "id").join(_sizes(rows), "node")
    signatures = members.select("id", "sig")
    sized = stored(met.join(signatures, "id"), "nodes")
    out = sized.where(F.col("size") <= leaf).drop("size")
    large = sized.where(F.col("size") > leaf).drop("size")
    extra = 1 / threshold - 1
    for level in range(levels):
        if not large.limit(1).count():
            break
        # every node selects one coordinate, and a second one in a part of the nodes
        first = F.pmod(F.xxhash64(F.lit(level), "node"), F.lit(COORDINATES)).cast("int")
        second = F.pmod(first + 1 + F.pmod(F.xxhash64(F.lit(level + 100), "node"), F.lit(COORDINATES - 1)), F.lit(COORDINATES)).cast("int")
        both = F.pmod(F.xxhash64(F.lit(level + 200), "node"), F.lit(1000)) < int(1000 * extra)
        picked = F.when(both, F.array(first, second)).otherwise(F.array(first))
        children = large.select("node", "id", "sig", F.explode(picked).alias("c")).select(
            F.xxhash64("node", "c", F.col("sig").substr(F.col("c") + 1, F.lit(1))).alias("node"), "id", "sig"
        )
        small, large = _split(children, leaf)
        out = out.unionByName(small)
    return out, large


def _deal(large: DataFrame, leaf: int) -> DataFrame:
    """Leaves of nodes that branching does not take apart: hashed parts of bounded size, each with
    the members whose signature agrees most with the node's most frequent values."""
    bytes_ = [F.col("sig").substr(i, 1) for i in range(1, 17)]
    typical = large.groupBy("node").agg(F.count(F.lit(1)).alias("size"), *[F.mode(b).alias(f"top{i}") for i, b in enumerate(bytes_)])
    agree = sum(((b == F.col(f"top{i}")).cast("int") for i, b in enumerate(bytes_)), F.lit(0)).alias("score")
    scored = large.join(stored(typical, "typical"), "node").select("node", "id", "size", agree)
    hubs = scored.groupBy("node").agg(
        F.max("size").alias("size"), *[F.max_by("id", F.struct("score", F.xxhash64("id", F.lit(i)))).alias(f"hub{i}") for i in range(4)]
    )
    hubs = hubs.select("node", F.ceil(F.col("size") / (leaf // 2)).alias("parts"), F.array_distinct(F.array(*[f"hub{i}" for i in range(4)])).alias("hubs"))
    placed = large.join(stored(hubs, "hubs"), "node")
    part = F.pmod(F.xxhash64("id", F.lit(9)), F.col("parts"))
    own = placed.select(F.xxhash64("node", part).alias("node"), "id", "sig")
    everywhere = (
        placed.where(F.array_contains("hubs", F.col("id")))
        .select("node", "id", "sig", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("p"))
        .select(F.xxhash64("node", "p").alias("node"), "id", "sig")
    )
    return own.unionByName(everywhere).dropDuplicates(["node", "id"])


def _blocks(grouped: DataFrame, leaf: int) -> DataFrame:
    """Leaves in which every two members of a large node meet, if their groups differ.
    ``grouped``: node, id, sig, group.

    The members of a node are dealt into parts of about half a leaf, those of a large group into
    parts of their own; a leaf is two parts, or one. Parts of one and the same group do not meet,
    so a node whose members are all connected makes no rows.
    """
    half = leaf // 2
    counts = grouped.groupBy("node", "group").agg(F.count(F.lit(1)).alias("n"))
    counts = stored(counts.withColumn("own", F.when(F.col("n") > half, F.col("group"))), "counts")
    sums = counts.groupBy("node", "own").agg(F.ceil(F.sum("n") / half).alias("parts"))
    sums = stored(sums.select(F.col("node").alias("_node"), F.col("own").alias("_own"), "parts"), "sums")
    dealt = counts.join(sums, (F.col("node") == F.col("_node")) & F.col("own").eqNullSafe(F.col("_own"))).select("node", "group", "own", "parts")
    part = F.xxhash64("own", F.pmod(F.xxhash64("id", F.lit(9)), F.col("parts"))).alias("part")
    placed = stored(grouped.join(stored(dealt, "dealt"), ["node", "group"]).select("node", "id", "sig", "group", "own", part), "placed")
    parts = stored(placed.select("node", "part", "own").distinct(), "parts")
    other = parts.select("node", F.col("part").alias("part_b"), F.col("own").alias("own_b"))
    apart = F.col("own").isNull() | F.col("own_b").isNull() | (F.col("own") != F.col("own_b"))
    pairs = parts.join(other, "node").where((F.col("part") <= F.col("part_b")) & apart)
    sides = pairs.select(
        "node", F.xxhash64("node", "part", "part_b").alias("block"), F.explode(F.array_distinct(F.array("part", "part_b"))).alias("part")
    )
    return placed.join(stored(sides, "sides"), ["node", "part"]).select(F.col("block").alias("node"), "id", "sig", "group")


def spanning_pairs(sigs: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Maximum spanning forest of the pairs with at least ``least`` equal coordinates."""
    n = len(sigs)
    best, parent = np.full(n, -1, np.int64), np.zeros(n, np.int64)
    open_ = np.ones(n, bool)
    out = []
    at = 0
    for _ in range(n):
        open_[at] = False
        if best[at] >= least:
            out.append((int(parent[at]), at, int(best[at])))
        same = (sigs == sigs[at]).sum(axis=1)
        closer = open_ & (same > best)
        best[closer], parent[closer] = same[closer], at
        at = int(np.where(open_, best, -2).argmax())
    return out


def undecided(sigs: np.ndarray, groups: np.ndarray, least: int) -> np.ndarray:
    """Members that may be linked with a member of another group."""
    out = np.zeros(len(sigs), bool)
    for i in range(len(sigs) - 1):
        near = ((sigs[i + 1 :] == sigs[i]).sum(axis=1) >= least) & (groups[i + 1 :] != groups[i])
        out[i + 1 :] |= near
        out[i] |= near.any()
    return np.flatnonzero(out)


def set_links(sets: list[np.ndarray], groups: list[int], percent: int) -> list[tuple[int, int]]:
    """Pairs whose full sets reach the threshold, as few as connect what links connect. The
    intersections of all pairs are one product of the members' incidence matrix with itself."""
    n = len(sets)
    owner = np.repeat(np.arange(n), [len(x) for x in sets])
    values, column, number = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    place = np.cumsum(number > 1) - 1  # shingles of one member only meet nobody
    shared = np.zeros((n, n), np.float32)
    owner, column = owner[number[column] > 1], place[column[number[column] > 1]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
        a, b = np.searchsorted(column, [start, start + 4096])
        block = np.zeros((n, 4096), np.float32)
        block[owner[a:b], column[a:b] - start] = 1
        shared += block @ block.T
    size = np.array([len(x) for x in sets], np.float64)
    good = 100 * shared.astype(np.float64) >= percent * (size[:, None] + size[None, :] - shared)
    parent = {g: g for g in groups}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for i, j in zip(*np.nonzero(np.triu(good, 1))):
        x, y = find(groups[i]), find(groups[j])
        if x != y:
            parent[max(x, y)] = min(x, y)
            out.append((int(i), int(j)))
    return out


def _leaf_rows(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple[int, list[list]]]:
    """Node and column values of each leaf, from batches in node order."""
    node, held = None, [[] for _ in columns]
    for batch in batches:
        nodes = batch.column("node").to_numpy()
        values = [batch.column(c).to_pylist() for c in columns]
        cuts = [0, *(np.flatnonzero(np.diff(nodes)) + 1).tolist(), len(nodes)]
        for a, b in zip(cuts, cuts[1:]):
            if a == b:
                continue
            if nodes[a] != node:
                if len(held[0]) > 1:
                    yield node, held
                node, held = int(nodes[a]), [[] for _ in columns]
            for h, c in zip(held, values):
                h.extend(c[a:b])
    if len(held[0]) > 1:
        yield node, held


def _in_leaves(rows: DataFrame) -> DataFrame:
    return rows.repartition("node").sortWithinPartitions("node", "id")


def _matrix(sigs: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(sigs), np.uint8).reshape(len(sigs), COORDINATES)


def forest_pairs(rows: DataFrame, least: int) -> DataFrame:
    """Distinct candidate pairs (a < b): the spanning forests of all leaves. ``rows``: node, id,
    sig. Leaves are streamed in node order; a leaf has a bounded number of rows."""
    kind = rows.schema["id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for _, (ids, sigs) in _leaf_rows(batches, ["id", "sig"]):
            for i, j, _ in spanning_pairs(_matrix(sigs), least):
                if ids[i] != ids[j]:
                    seen.add((min(ids[i], ids[j]), max(ids[i], ids[j])))
            if len(seen) > 100_000:
                yield _pairs(seen)
                seen.clear()
        yield _pairs(seen)

    return _in_leaves(rows.select("node", "id", "sig")).mapInArrow(work, f"a {kind}, b {kind}").distinct()


def _pairs(pairs) -> pa.RecordBatch:
    pairs = list(pairs)
    return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], ["a", "b"])


def leaf_links(rows: DataFrame, texts: DataFrame, least: int, words: int, threshold: float) -> DataFrame:
    """Links (a, b) between different groups that share a leaf. ``rows``: node, id, sig, group.

    Leaves are compared exhaustively: by signature to find the members that may have a link to
    another group, then these on their full sets of shingles. Only links leave a leaf, and only
    as many as connect its groups, so that a family of documents just below the threshold costs
    comparisons inside its leaves and no rows.
    """
    kind = rows.schema["id"].dataType.simpleString()
    percent = round(threshold * 100)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for node, (ids, groups, sigs) in _leaf_rows(batches, ["id", "group", "sig"]):
            if len(set(groups)) > 1:
                out += [(node, ids[i], groups[i]) for i in undecided(_matrix(sigs), np.array(groups), least)]
            if len(out) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["node", "id", "group"])
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["node", "id", "group"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sized():
            for whole in batches:
                for batch in chunks(whole):
                    sets = [s.tobytes() for s in shingle_sets(*utf8(batch.column("text")), words)]
                    columns = [batch.column("node"), batch.column("id"), batch.column("group"), pa.array(sets, pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, ["node", "id", "group", "set"])

        for _, (ids, groups, sets) in _leaf_rows(sized(), ["id", "group", "set"]):
            if len(set(groups)) > 1:
                found = set_links([np.frombuffer(s, np.uint64) for s in sets], groups, percent)
                yield _pairs([(ids[i], ids[j]) for i, j in found])

    marked = _in_leaves(rows.select("node", "id", "group", "sig")).mapInArrow(mark, f"node long, id {kind}, group {kind}")
    members = stored(marked, "marked").join(texts.hint("merge"), "id")
    return _in_leaves(members.select("node", "id", "group", "text")).mapInArrow(compare, f"a {kind}, b {kind}").distinct()


def confirm(pairs: DataFrame, texts: DataFrame, words: int, threshold: float) -> DataFrame:
    """The pairs (a, b) whose full sets of shingles reach the threshold. ``texts``: id, text."""
    percent = round(threshold * 100)
    left = texts.select(F.col("id").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("id").alias("b"), F.col("text").alias("text_b"))
    both = pairs.join(right.hint("merge"), "b").join(left.hint("merge"), "a")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for half in chunks(whole, "text_a"):
                for batch in chunks(half, "text_b"):
                    one = shingle_sets(*utf8(batch.column("text_a")), words)
                    two = shingle_sets(*utf8(batch.column("text_b")), words)
                    shared = [len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(one, two)]
                    good = [100 * s >= percent * (len(x) + len(y) - s) for s, x, y in zip(shared, one, two)]
                    yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(good, pa.bool_())], ["a", "b", "linked"])

    kind = pairs.schema["a"].dataType.simpleString()
    return both.select("a", "b", "text_a", "text_b").mapInArrow(work, f"a {kind}, b {kind}, linked boolean")


def components(links: DataFrame) -> DataFrame:
    """(id, component): the smallest id that can be reached, for every id of ``links`` (a, b).

    Large-star and small-star steps alternate: each tells all larger (then all smaller)
    neighbours of an id about the smallest one. Links never grow in number; the steps grow with
    the logarithm of the longest chain.
    """
    edges = stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "links")
    before = None
    while True:
        both = edges.union(edges.select("v", "u"))
        lowest = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(lowest, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(lowest, "u")
            .select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v").where("u <> v").distinct()
        )
        edges = stored(small, "links")
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v") % 1_000_000_007), F.bit_xor(F.xxhash64("u", "v"))).first()
        if state == before:
            break
        before = state
    ids = edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return ids.union(edges.select("v", "v")).distinct()


def near_duplicates(
    docs: DataFrame, words: int = 5, threshold: float = 0.8, trees: int = 8, leaf: int = 1024, levels: int = 2, slack: float = 4.5
) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs`` (doc_id, text).

    Words are lower-cased in A-Z. Two documents are linked if the Jaccard similarity of their
    sets of ``words``-word shingles is at least ``threshold``. component_id is the smallest
    doc_id that links reach; a document is kept if that is its own. A text without words is
    linked with nothing. A row with a null doc_id cannot be named in a component: it is linked
    with nothing, has a null component_id and is kept. Rows with equal doc_id and different
    texts are documents of their own that share the name; equal rows are judged alike.

    A pair at the threshold meets in a first-level node with a probability of
    1 - (1 - threshold) ** ceil(trees / threshold), which is 1 - 1e-7 by default. Where all nodes
    that it meets in branch ``levels`` times, that is about 1 - 3e-4. ``slack`` is
    how many standard deviations below the threshold a signature may lie and still be confirmed.
    """
    sketched = stored(sketch(docs, words, trees, threshold), "sketch")
    nonempty = sketched.where(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0))
    classes = nonempty.groupBy("d1", "d2", "n_shingles").agg(F.min("doc_id").alias("rep"))
    classes = stored(classes.select(F.col("d1").alias("c1"), F.col("d2").alias("c2"), F.col("n_shingles").alias("cn"), "rep"), "classes")
    same = (F.col("d1") == F.col("c1")) & (F.col("d2") == F.col("c2")) & (F.col("n_shingles") == F.col("cn"))
    members = stored(
        nonempty.join(classes, same & (F.col("doc_id") == F.col("rep")), "left_semi")
        .dropDuplicates(["doc_id", "d1", "d2"])
        .select(F.col("doc_id").alias("id"), "sig", "nodes"),
        "members",
    )
    rows, large = leaves(members, threshold, leaf, levels)
    deep = large.limit(1).count() > 0
    sure = threshold + (1 - threshold) * CHANCE
    least = math.floor(COORDINATES * (sure - slack * math.sqrt(sure * (1 - sure) / COORDINATES)))
    first = stored(forest_pairs(rows.unionByName(_deal(large, leaf)) if deep else rows, least), "pairs")
    # Texts of all documents that are in any possible pair or large node, once; both rounds read them. They
    # move by a merge join at every size: the ids on the other side grow with the table.
    involved = first.select(F.col("a").alias("id")).union(first.select("b"))
    involved = (involved.union(large.select("id")) if deep else involved).distinct()
    texts = docs.select(F.col("doc_id").alias("id"), "text").where(F.col("id").isNotNull())
    texts = stored(texts.join(involved.hint("merge"), "id", "left_semi").dropDuplicates(["id", "text"]), "texts")
    links = stored(confirm(first, texts, words, threshold).where("linked").select("a", "b"), "links")
    groups = stored(components(links), "groups")
    # What the forest left unconnected: every pair of different groups that share a node.
    group = F.coalesce("component", "id").alias("group")
    grouped = rows.join(groups, "id", "left").select("node", "id", "sig", group)
    if deep:
        grouped = grouped.unionByName(_blocks(stored(large.join(groups, "id", "left").select("node", "id", "sig", group), "large"), leaf))
    more = stored(leaf_links(grouped, texts, least, words, threshold), "links")
    if more.limit(1).count():
        groups = stored(components(links.union(more)), "groups")
    named = stored(classes.join(groups, F.col("rep") == F.col("id"), "left").select(
        "c1", "c2", "cn", F.coalesce("component", "rep").alias("component")
    ), "named")
    member = F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0)
    key = F.when(member, F.col("d1"))  # rows without a class do not travel to one key
    done = sketched.select("doc_id", "n_shingles", key.alias("d1"), "d2").join(
        named, (F.col("d1") == F.col("c1")) & (F.col("d2") == F.col("c2")) & (F.col("n_shingles") == F.col("cn")), "left"
    )
    component = F.coalesce("component", "doc_id")
    return done.select(
        "doc_id",
        "n_shingles",
        component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
    )
