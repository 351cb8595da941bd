"""Centroid clustering of integer vectors by ball-tree filtering.

Each task builds metric trees over up to ``TREE`` of its own vectors: a node knows its rows, their integer sum, a
centre and a radius that holds them all. In a round a tree is walked from its root with the centroids that may still
win. A centroid z leaves a ball of centre c and radius r if |c - z|^2 - |c - b|^2 > 2 r |z - b| for the ball's best
centroid b: by the triangle inequality then every vector of the ball is nearer to b. A ball with one centroid left
goes to it whole, by its count and sum; else its children are walked, and vectors of undecided leaves are compared with
the centroids that are left. All sums and compared distances are 64-bit integers; a bound is rounded to the safe side.

Trees are written once; a round reads them, and a task returns a count and a sum a cluster. What comes to the driver is a
vector a cluster. A lost executor's trees are read again from the shared folder.

Defined results: a vector is kept if it has exactly ``dim`` components, none of them null or non-finite, and all within
2^27 after scaling (beyond that a squared distance does not fit 64 bits); others get no row. Repeated rows, also of one id,
are as many vectors; a null id is kept but starts no centroid; fewer vectors than ``k`` give as many centroids as there
are; no rows give no rows; sums of distances beyond 64 bits are null; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, tidied

DIM, SCALE, K, ROUNDS, SEED = 64, 1024, 8, 10, "3"
#: Vectors of a tree and of a leaf at most.
TREE, LEAF = 1024, 16
#: Bound of a component, so that squared distances fit 64 bits.
MOST = 1 << 27

#: Arrays of a tree, as columns of bytes: of its vectors in leaf order, then of its nodes.
PARTS = {"points": np.int32, "centres": np.int32, "radii": np.float64, "sums": np.int64, "starts": np.int32, "ends": np.int32, "left": np.int32, "right": np.int32}


def squares(x: np.ndarray, z: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of x to all of z, exact."""
    return (x * x).sum(1)[:, None] - 2 * (x @ z.T) + (z * z).sum(1)


def build(x: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Order of the rows in the tree, and its arrays; rows are split at the median of their projections on the line of two far ones."""
    order = np.arange(len(x))
    nodes: list[list] = []

    def grow(start: int, end: int) -> int:
        own = x[order[start:end]]
        total = own.sum(0)
        centre = np.rint(total / len(own)).astype(np.int64)
        away = squares(own, centre[None])[:, 0]
        nodes.append([centre, np.sqrt(float(away.max())) * (1 + 1e-12), total, start, end, -1, -1])
        me = len(nodes) - 1
        if len(own) > LEAF and away.max() > 0:
            a = own[away.argmax()]
            b = own[squares(own, a[None])[:, 0].argmax()]
            along = own @ (b - a).astype(np.float64)
            middle = len(own) // 2
            order[start:end] = order[start:end][np.argpartition(along, middle)]
            nodes[me][5] = grow(start, start + middle)
            nodes[me][6] = grow(start + middle, end)
        return me

    grow(0, len(x))
    columns = [np.array(c) for c in zip(*nodes, strict=True)]
    return order, dict(zip(PARTS, [x[order], *columns], strict=True))


def walk(tree: dict[str, np.ndarray], z: np.ndarray) -> tuple[list[tuple[int, int]], np.ndarray, np.ndarray]:
    """Nodes that go whole to a centroid, as (node, centroid), and the vectors of undecided leaves with their nearest."""
    spread = np.sqrt(squares(z, z).astype(np.float64))
    nodes, left = np.zeros(1, np.int64), np.ones((1, len(z)), bool)
    whole: list[tuple[int, int]] = []
    rows, nearest = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    far = np.iinfo(np.int64).max
    while len(nodes):
        d = np.where(left, squares(tree["centres"][nodes], z), far)
        best = d.argmin(1)
        gap = d - d[np.arange(len(nodes)), best][:, None]
        bound = np.minimum(2 * tree["radii"][nodes][:, None] * spread[best] * (1 + 1e-9) + 1, 2.0**62).astype(np.int64)
        left &= gap <= bound
        left[np.arange(len(nodes)), best] = True
        one = left.sum(1) == 1
        whole += zip(nodes[one].tolist(), best[one].tolist(), strict=True)
        leaf = ~one & (tree["left"][nodes] < 0)
        if leaf.any():
            at = nodes[leaf]
            sizes = tree["ends"][at] - tree["starts"][at]
            own = np.concatenate([np.arange(s, e) for s, e in zip(tree["starts"][at], tree["ends"][at], strict=True)])
            allowed = np.repeat(left[leaf], sizes, axis=0)
            rows.append(own)
            nearest.append(np.where(allowed, squares(tree["points"][own], z), far).argmin(1))
        inner = ~one & ~leaf
        nodes, left = np.r_[tree["left"][nodes[inner]], tree["right"][nodes[inner]]].astype(np.int64), np.r_[left[inner], left[inner]]
    return whole, np.concatenate(rows), np.concatenate(nearest)


def _packed(ids: pa.Array, x: np.ndarray) -> pa.RecordBatch:
    order, arrays = build(x)
    ids = ids.take(pa.array(order))
    columns = [pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)]
    columns += [pa.array([arrays[n].astype(kind).tobytes()], pa.binary()) for n, kind in PARTS.items()]
    return pa.record_batch(columns, ["ids", *PARTS])


def _trees(batch: pa.RecordBatch, dim: int) -> Iterator[tuple[pa.Array, dict[str, np.ndarray]]]:
    for i in range(batch.num_rows):
        tree = {n: np.frombuffer(batch.column(n)[i].as_buffer(), kind) for n, kind in PARTS.items()}
        for n in ("points", "centres", "sums"):
            tree[n] = tree[n].reshape(-1, dim).astype(np.int64)
        yield batch.column("ids")[i].values, tree


def _planting(dim: int, scale: int) -> Callable:
    """Batches of (id, vector) to trees of the task's vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, parts, held = [], [], 0

        def cut(least: int) -> Iterator[pa.RecordBatch]:
            nonlocal ids, parts, held
            if held >= least and held:
                every, x = pa.concat_arrays(ids), np.concatenate(parts)
                full = len(x) if least <= 1 else len(x) - len(x) % TREE
                for at in range(0, full, TREE):
                    size = min(TREE, full - at)
                    yield _packed(every.slice(at, size), x[at : at + size])
                ids, parts, held = [every.slice(full)], [x[full:]], len(x) - full

        for batch in batches:
            values = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            parts.append(np.floor(values * scale).astype(np.int64).reshape(-1, dim))
            ids.append(batch.column(0))
            held += batch.num_rows
            yield from cut(TREE)
        yield from cut(1)

    return tidied(run)


def _summing(centroids: np.ndarray) -> Callable:
    """Trees to the count and sum of each cluster in the task."""
    k, dim = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = np.zeros(k, np.int64), np.zeros((k, dim), np.int64)
        for batch in batches:
            for _, tree in _trees(batch, dim):
                whole, rows, nearest = walk(tree, centroids)
                for node, c in whole:
                    n[c] += tree["ends"][node] - tree["starts"][node]
                    sums[c] += tree["sums"][node]
                n += np.bincount(nearest, minlength=k)
                np.add.at(sums, nearest, tree["points"][rows])
        full = np.flatnonzero(n)
        if len(full):
            yield pa.record_batch([pa.array(full, pa.int32()), pa.array(n[full]), pa.array(sums[full].tolist(), pa.list_(pa.int64()))], ["cluster", "n", "sums"])

    return tidied(run)


def _placing(centroids: np.ndarray) -> Callable:
    """Trees to the cluster and squared distance of each vector."""
    dim = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, tree in _trees(batch, dim):
                cluster = np.zeros(len(ids), np.int32)
                whole, rows, nearest = walk(tree, centroids)
                for node, c in whole:
                    cluster[tree["starts"][node] : tree["ends"][node]] = c
                cluster[rows] = nearest
                away = tree["points"] - centroids[cluster]
                yield pa.record_batch([ids, pa.array(cluster), pa.array((away * away).sum(1))], ["id", "cluster", "distance"])

    return tidied(run)


def usable(vector: str, dim: int, scale: int) -> Column:
    fits = F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double") * scale) < MOST, F.lit(False)) & ~F.isnan(x))
    return (F.size(vector) == dim) & fits


def starts(kept: DataFrame, k: int, scale: int, seed: str) -> list[list[int]]:
    """The k vectors of least hash of their id."""
    named = kept.where("id is not null").select(
        F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256).alias("h"),
        F.transform("v", lambda x: F.floor(x.cast("double") * scale)).alias("x"),
    )
    return [list(r["x"]) for r in named.orderBy("h", "x").limit(k).collect()]


def moved(trees: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round: floors of their vectors' means; one without vectors stays."""
    sums = trees.mapInArrow(_summing(centroids), "cluster int, n long, sums array<long>").select("cluster", "n", F.posexplode("sums").alias("i", "s"))
    whole = sums.groupBy("cluster", "i").agg(F.sum(F.col("n").cast("decimal(38,0)")).alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    out = centroids.copy()
    for r in whole.collect():  # a number a component of each cluster
        out[r["cluster"], r["i"]] = int(r["s"]) // int(r["n"])
    return out


def cluster(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", k: int = K, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE, seed: str = SEED) -> DataFrame:
    """id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every kept vector."""
    spark, scratch = vectors.sparkSession, Scratch(vectors.sparkSession)
    kept = vectors.select(F.col(id_col).alias("id"), F.col(vector).alias("v")).where(usable("v", dim, scale))
    kind = kept.schema["id"].dataType.simpleString()
    trees = scratch.keep(kept.mapInArrow(_planting(dim, scale), f"ids array<{kind}>, " + ", ".join(f"{n} binary" for n in PARTS)), "trees")
    first = starts(kept, k, scale, seed)
    centroids = np.array(first, np.int64).reshape(len(first), dim)
    for _ in range(rounds if first else 0):
        centroids = moved(trees, centroids)
    if not first:  # vectors without ids alone have no centroids either
        trees = trees.limit(0)
    placed = scratch.keep(trees.mapInArrow(_placing(centroids), f"id {kind}, cluster int, distance long"), "placed")
    total = lambda c: F.sum(F.col(c).cast("decimal(38,0)"))
    sums = {r["cluster"]: r["s"] for r in placed.groupBy("cluster").agg(total("distance").alias("s")).collect()}
    fits = lambda s: int(s) if s < 1 << 63 else None
    rows = [(c, fits(s), fits(sum(sums.values())), hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c, s in sums.items()]
    figures = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    out = placed.join(F.broadcast(figures), "cluster")  # k rows
    return out.select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
