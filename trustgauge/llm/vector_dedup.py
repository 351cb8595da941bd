"""Near-duplicate vectors by product quantisation.

A coarse quantiser cuts the unit sphere into cells; a vector is in the inverted list of its
cell as the codes of its residual, one per subspace. A query probes every cell whose border
to its own is near enough for a linked vector to lie beyond it, sums its distances to the
codewords of the coded rows there, and drops what is too far even after the code's
own error: by the triangle inequality that drops no linked vector. The rest is compared by
exact cosine in double precision.

A list holds the codes of its rows, made once, and their vectors for the cosines. Lists are
packed into blocks of at most ``BLOCK`` rows, a row of a table each. A task reads a pair of blocks
from that table, so a vector is shuffled once, into its block, and never to the lists that it
probes. There each list adds its codewords up, so that the distances of all its rows to all that
probe it are one product of matrices in 32 bits; what these may be off by is let through.
A task returns, per row, its number of links and the least linked id of its group in
that pair, never the pairs themselves. Both quantisers are fitted in numpy on at most
``SAMPLE`` rows of least id hash; every row is indexed. Vectors travel as 32-bit numbers where
these are their exact values. A border is near enough if a vector of ``reach`` times link length can cross it.
With a reach of 1 no linked vector is beyond a border that is farther, whatever its direction, so no link is
lost. In many dimensions differences hardly ever point straight at a border: reach is ``REACH`` standard
deviations of the links' differences along the direction in which they spread most, as measured on the linked
pairs of ``PAIR_ROWS`` sampled rows with all sampled ones; with fewer than ``LEAST_PAIRS`` of them, or a spread that
needs it (few dimensions, few edited components), it is 1. Recall is held against brute force in the tests.

Defined results: vectors that are null, zero, or hold a null or non-finite component link with
nothing; with ``each_length`` vectors of one length link among themselves, by quantisers of
their own, else only those of the most frequent length (the least of several) link; rows of one id are one vector,
the least of them; a null id is an id; no rows give no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, tidied
from .graph import components

THRESHOLD = 0.95
#: Rows that the quantisers are fitted on at most, and rows per cell aimed at.
SAMPLE, PER_CELL, MAX_CELLS = 20_000, 400, 4096
SUBSPACE, CODEWORDS = 4, 16
ROUNDS = 6
#: Standard deviations of a link's difference that a border must be away, rows that are compared with the sample to measure them, pairs of a row that count, and least pairs.
REACH, PAIR_ROWS, PAIRS_A_ROW, LEAST_PAIRS = 4.0, 4000, 8, 200
#: Rows of a block at most; blocks that fewer rows make, and rows that one of these has at least.
BLOCK, BLOCKS, LEAST_BLOCK = 1 << 15, 12, 256
#: Pairs of vectors whose distances are worked out together, as many as a core's cache holds, and links that are held.
PAIRS, HELD = 1 << 18, 1 << 20
SEED = 11
LINKS = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("other", pa.int64())])


def _kmeans(x: np.ndarray, k: int, rng) -> np.ndarray:
    centres = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(ROUNDS):
        near = _nearest(x, centres)
        n = np.bincount(near, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        full = n > 0
        centres[full] = sums[full] / n[full, None]
    return centres


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    half = 0.5 * (centres**2).sum(1)
    return np.concatenate([(x[i : i + 4096] @ centres.T - half).argmax(1) for i in range(0, len(x), 4096)] or [np.empty(0, np.int64)])


@dataclass
class Quantiser:
    cells: np.ndarray
    #: One table of codewords per subspace.
    books: list[np.ndarray]
    gaps: np.ndarray
    threshold: float
    #: Share of a link's length that borders are probed for.
    reach: float = 1.0

    @property
    def dim(self) -> int:
        return self.cells.shape[1]

    @property
    def rough(self) -> float:
        """What a product of unit vectors in 32 bits may be off by, and more."""
        return 1e-5 + self.dim * 2.0**-21

    @property
    def radius(self) -> float:
        """Distance of unit vectors whose cosine is the threshold."""
        return float(np.sqrt(max(0.0, 2 - 2 * self.threshold)))

    def cuts(self) -> list[slice]:
        return [slice(i, min(i + SUBSPACE, self.dim)) for i in range(0, self.dim, SUBSPACE)]

    def encode(self, x: np.ndarray, cell: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the residuals, and the length of what the codes leave."""
        rest = x - self.cells[cell]
        codes = np.stack([_nearest(rest[:, s], b) for s, b in zip(self.cuts(), self.books, strict=True)], axis=1).astype(np.uint8)
        left = sum(((rest[:, s] - b[codes[:, m]]) ** 2).sum(1) for m, (s, b) in enumerate(zip(self.cuts(), self.books, strict=True)))
        return codes, np.sqrt(left)

    def probes(self, x: np.ndarray, cell: np.ndarray, among: np.ndarray | None = None, slack: float = 1e-9) -> np.ndarray:
        """Rows of booleans: cells from the own one on, of all or of some, in which a linked vector can lie; a pair meets once.

        With own centre c and another one d, |y - d|^2 - |y - c|^2 changes by 2 r |c - d| at most on a way of length r towards d, and
        must fall to 0 for y to be nearer to d.
        """
        among = np.arange(len(self.cells)) if among is None else among
        squares = (self.cells**2).sum(1)
        d = squares[among] - 2 * x @ self.cells[among].T.astype(x.dtype)
        own = np.empty(len(x))
        for i in range(0, len(x), 4096):
            at = slice(i, i + 4096)
            own[at] = squares[cell[at]] - 2 * np.einsum("ij,ij->i", x[at], self.cells[cell[at]])
        return (d - own[:, None] <= 2 * self.reach * self.radius * self.gaps[cell[:, None], among] + slack) & (among >= cell[:, None])

    def coded(self, cell: int, codes: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The coded vectors of a list, and what the product of each with a unit vector must reach for their distance to be within a link's length and the code's own error.

        The product is the sum over the subspaces of the products with the codewords, as |x - y|^2 = 1 + |y|^2 - 2 x y.
        """
        y = self.cells[cell] + np.concatenate([b[codes[:, m]] for m, b in enumerate(self.books)], axis=1)
        return y.astype(np.float32), ((1 + (y**2).sum(1) - (self.radius + left) ** 2) / 2 - self.rough).astype(np.float32)


def fit(vectors: DataFrame, threshold: float = THRESHOLD) -> Quantiser | None:
    """Quantisers for a table (id, v) of usable vectors of one length; None if it is empty."""
    n = vectors.count()
    hashed = vectors.select(F.xxhash64("id").alias("h"), "v")
    last = hashed.select("h").orderBy("h").limit(SAMPLE).agg(F.max("h")).first()[0]
    if last is None:
        return None
    rows = hashed.where(F.col("h") <= last).toPandas().sort_values("h")["v"][:SAMPLE]
    x = _unit(np.stack(rows.to_numpy()).astype(np.float64))
    dim = x.shape[1]
    rng = np.random.default_rng(SEED)
    k = int(max(1, min(MAX_CELLS, n // PER_CELL, len(x) // 4)))
    cells = _kmeans(x, k, rng)
    rest = x - cells[_nearest(x, cells)]
    gaps = np.sqrt(np.maximum(0, (cells**2).sum(1)[:, None] + (cells**2).sum(1) - 2 * cells @ cells.T))
    books = [_kmeans(rest[:, i : i + SUBSPACE], CODEWORDS, rng) for i in range(0, dim, SUBSPACE)]
    return Quantiser(cells, books, gaps, threshold, _reach(x, threshold))


def _reach(x: np.ndarray, threshold: float) -> float:
    """Share of a link's length by which it may move along any one direction, from the linked pairs of a sample."""
    moments, n, rng = np.zeros((x.shape[1], x.shape[1])), 0, np.random.default_rng(SEED)
    for at in range(0, min(PAIR_ROWS, len(x)), 256):
        own = x[at : min(at + 256, PAIR_ROWS)]
        near = own @ x.T
        for i, row in enumerate(near):
            linked = np.flatnonzero(row >= threshold)  # any of them, as those of one group share their first ones
            steps = x[rng.choice(linked, min(len(linked), 8 * PAIRS_A_ROW), replace=False)] - own[i]
            size = np.linalg.norm(steps, axis=1)
            moved = size > 1e-6  # copies move nowhere
            unit = (steps[moved] / size[moved, None])[:PAIRS_A_ROW]
            moments += unit.T @ unit
            n += len(unit)
    if n < LEAST_PAIRS:
        return 1.0
    return float(min(1.0, REACH * np.sqrt(np.linalg.eigvalsh(moments / n)[-1])))


def _usable(vec: str):
    v = F.col(vec).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return F.coalesce(fine, F.lit(False))


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1)[:, None]  # so that squares neither vanish nor overflow
    return x / np.linalg.norm(x, axis=1)[:, None]


def _pack(x: np.ndarray) -> list[bytes]:
    """The numbers of each row as bytes, in 32 bits if all of them are such numbers."""
    with np.errstate(over="ignore"):
        short = x.astype(np.float32)
    exact = (short == x).all(axis=1)
    return [(s if e else v).tobytes() for s, v, e in zip(short, x, exact, strict=True)]


def _unpack(rows: pd.Series, dim: int) -> np.ndarray:
    out = np.empty((len(rows), dim))
    short = (rows.map(len) == 4 * dim).to_numpy()
    for which, kind in ((short, np.float32), (~short, np.float64)):
        out[which] = np.frombuffer(b"".join(rows[which]), kind).reshape(-1, dim)
    return out


def _place(model):
    """Rows (id, cell, vec, codes, left): a vector as a row of its cell's list."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        q = model.value
        for pdf in batches:
            for at in range(0, len(pdf), 1024):
                part = pdf[at : at + 1024]
                raw = np.stack(part["v"].to_numpy()).astype(np.float64)
                x = _unit(raw)
                cell = _nearest(x, q.cells)
                codes, left = q.encode(x, cell)
                yield pd.DataFrame({"id": part["id"], "cell": cell, "vec": _pack(raw), "codes": [c.tobytes() for c in codes], "left": left})

    return run


def _least_linked(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For nodes 0..n-1 the least node that links a-b lead to."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        fresh = label.copy()
        np.minimum.at(fresh, a, low)
        np.minimum.at(fresh, b, low)
        fresh = fresh[fresh]
        if (fresh == label).all():
            return label
        label = fresh


BLOCK_SCHEMA = "block long, ids binary, cells binary, codes binary, lefts binary, vecs binary"


def _packed(dim: int):
    """The rows of a block, by cell, as one row; numbers in 32 bits if all of the block's are such numbers."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["cell", "id"])
        short = (pdf["vec"].map(len) == 4 * dim).all()
        vecs = b"".join(pdf["vec"]) if short else _unpack(pdf["vec"], dim).tobytes()
        columns = [pdf[c].to_numpy(kind).tobytes() for c, kind in (("id", np.int64), ("cell", np.int32))]
        return pd.DataFrame([[pdf["block"].iloc[0], *columns, b"".join(pdf["codes"]), pdf["left"].to_numpy(np.float64).tobytes(), vecs]], columns=["block", "ids", "cells", "codes", "lefts", "vecs"])

    return run


class Block:
    """Some lists, as they are asked and as they ask."""

    def __init__(self, q: Quantiser, ids: bytes, cells: bytes, codes: bytes, lefts: bytes, vecs: bytes):
        self.q, self.ids, self.cell = q, np.frombuffer(ids, np.int64), np.frombuffer(cells, np.int32)
        n = len(self.ids)
        self.codes, self.left = np.frombuffer(codes, np.uint8).reshape(n, -1), np.frombuffer(lefts, np.float64)
        self.raw = np.frombuffer(vecs, np.float32 if len(vecs) == 4 * n * q.dim else np.float64).reshape(n, q.dim)
        starts = np.flatnonzero(np.diff(self.cell, prepend=-1))
        self.lists = list(zip(self.cell[starts].tolist(), starts.tolist(), [*starts[1:].tolist(), n], strict=True))
        self.exact, self.known = np.empty((n, q.dim)), np.zeros(n, bool)
        self.rough = _unit(self.raw).astype(np.float32)

    def unit(self, at: np.ndarray) -> np.ndarray:
        """Rows in double precision."""
        fresh = np.unique(at[~self.known[at]])
        if len(fresh):
            self.exact[fresh], self.known[fresh] = _unit(self.raw[fresh].astype(np.float64)), True
        return self.exact[at]


def _few_true(table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """np.nonzero of a table of booleans with few true ones, eight looked at together."""
    flat = table.reshape(-1)
    eights = np.flatnonzero(flat[: len(flat) & ~7].view(np.uint64)) * 8
    at = np.concatenate([(eights[:, None] + np.arange(8)).reshape(-1), np.arange(len(flat) & ~7, len(flat))])
    return np.divmod(at[flat[at]], table.shape[1])


def _links_of(asked: Block, listed: Block, same: bool) -> pd.DataFrame:
    """(id, n, other) of what a block finds in the lists of another one, which is not before it, or in its own."""
    q = asked.q
    every = np.unique(np.concatenate([asked.ids, listed.ids]))
    of_asked, of_listed = np.searchsorted(every, asked.ids), np.searchsorted(every, listed.ids)
    n, label, held, size = np.zeros(len(every), np.int64), np.arange(len(every)), [], 0

    def join() -> None:
        """Links become those of each row with the least one of its group, so that they don't pile up."""
        nonlocal label, held, size
        rows = np.flatnonzero(label != np.arange(len(label)))
        a, b = (np.concatenate([start, *(h[i] for h in held)]) for i, start in enumerate((rows, label[rows])))
        label, held, size = _least_linked(len(every), a, b), [], 0

    probes = q.probes(asked.rough, asked.cell, np.array([c for c, _, _ in listed.lists]), 2 * q.rough)
    for k, (cell, lo, hi) in enumerate(listed.lists):
        asking = np.flatnonzero(probes[:, k])
        coded, least = q.coded(cell, listed.codes[lo:hi], listed.left[lo:hi])
        for i in range(0, len(asking), step := max(16, PAIRS // (hi - lo))):
            rows = asking[i : i + step]
            close = asked.rough[rows] @ coded.T >= least
            if same and asked.cell[rows[-1]] == cell:  # within a list a pair counts from its earlier row
                close &= rows[:, None] < np.arange(lo, hi)
            if 16 * (many := np.count_nonzero(close)) > close.size:
                close &= asked.unit(rows) @ listed.unit(np.arange(lo, hi)).T >= q.threshold
                a, b = np.nonzero(close)
                a, b = rows[a], b + lo
            elif many:
                a, b = _few_true(close)
                a, b = rows[a], b + lo
                near = np.einsum("ij,ij->i", asked.unit(a), listed.unit(b)) >= q.threshold
                a, b = a[near], b[near]
            else:
                continue
            a, b = of_asked[a], of_listed[b]
            n += np.bincount(a, minlength=len(n)) + np.bincount(b, minlength=len(n))
            held.append((a, b))
            size += len(a)
            if size > HELD:
                join()
    join()
    some = np.flatnonzero(n)
    return pd.DataFrame({"id": every[some], "n": n[some], "other": every[label[some]]})


def _compare(model):
    """Rows that hold a pair of blocks each, to the links between these."""
    names = [f.split(" ")[0] for f in BLOCK_SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                a, b = ({c: batch.column(f"{side}_{c}")[i].as_py() for c in names} for side in "ab")
                if a["block"] > b["block"]:
                    a, b = b, a
                same = a.pop("block") == b.pop("block")
                asked = Block(model.value, **a)
                yield pa.RecordBatch.from_pandas(_links_of(asked, asked if same else Block(model.value, **b), same), LINKS, preserve_index=False)

    return tidied(run)


def _dealt(counts: dict[int, int], cells: int) -> tuple[list[int], list[int], int]:
    """Of each cell the first block and the number of its blocks, and the number of all blocks. Small lists share one, of large ones each block has a part."""
    most = min(BLOCK, max(LEAST_BLOCK, -(-sum(counts.values()) // BLOCKS)))
    first, parts, at, room = [0] * cells, [1] * cells, -1, 0
    for cell, n in sorted(counts.items()):
        if n > most:
            first[cell], parts[cell] = at + 1, -(-n // most)
            at, room = at + parts[cell], 0
        else:
            if n > room:
                at, room = at + 1, most
            first[cell], room = at, room - n
    return first, parts, at + 1


def links(vectors: DataFrame, model: Quantiser, scratch: Scratch) -> DataFrame:
    """(id, n, other): parts of a vector's number of links, and an id of its group, for a table (id, v) of distinct ids and one length."""
    spark = vectors.sparkSession
    shared = spark.sparkContext.broadcast(model)  # as large as its cells and their gaps, at most MAX_CELLS squared numbers
    placed = scratch.keep(vectors.mapInPandas(_place(shared), "id long, cell long, vec binary, codes binary, left double"), f"placed{model.dim}")
    counts = {r["cell"]: r["count"] for r in placed.groupBy("cell").count().collect()}  # a row a cell
    first, parts, blocks = _dealt(counts, len(model.cells))
    at = F.col("cell").cast("int")
    block = F.get(F.array(*map(F.lit, first)), at) + F.pmod(F.xxhash64("id"), F.get(F.array(*map(F.lit, parts)), at))
    dealt = placed.withColumn("block", block.cast("long")).repartitionByRange(blocks, "block").groupBy("block")
    packed = scratch.keep(dealt.applyInPandas(_packed(model.dim), BLOCK_SCHEMA), f"blocks{model.dim}")
    scratch.drop(f"placed{model.dim}")
    # Pairs of blocks are read where they are, so no vector is sent to the lists that it probes; of both orders of a pair one counts, so that rows and columns share the work.
    a, b = (packed.select(*(F.col(c).alias(f"{side}_{c}") for c in packed.columns)) for side in "ab")
    odd = (F.col("a_block") + F.col("b_block")) % 2 == 1
    once = (F.col("a_block") == F.col("b_block")) | ((F.col("a_block") < F.col("b_block")) == odd)
    return a.hint("shuffle_replicate_nl").join(b, once).mapInArrow(_compare(shared), "id long, n long, other long")


def near_duplicates(df: DataFrame, vec: str = "embedding", id_col: str = "vec_id", threshold: float = THRESHOLD, each_length: bool = False) -> DataFrame:
    """id, n_links, component_id (least id that links reach, its own without any) and kept (whether that is its own)."""
    scratch = Scratch(df.sparkSession)
    rows = scratch.keep(df.select(F.col(id_col).alias("id"), F.when(_usable(vec), F.col(vec)).alias("v")), "rows")
    if not rows.groupBy("id").count().where("count > 1").isEmpty():
        rows = scratch.keep(rows.groupBy("id").agg(F.min("v").alias("v")), "once")
        scratch.drop("rows")
    usable = rows.where("v is not null and id is not null")
    found = rows.select("id", F.lit(0).cast("long").alias("n"), F.col("id").alias("other")).limit(0)
    counted = usable.groupBy(F.size("v").alias("n")).count().collect()  # a row a length
    lengths = sorted((-r["count"], r["n"]) for r in counted)
    for _, n in [(c, n) for c, n in lengths if c < -1] if each_length else lengths[:1]:
        same = usable.where(F.size("v") == n)
        found = found.unionByName(scratch.keep(links(same, fit(same, threshold), scratch), f"found{n}"))
        scratch.drop(f"blocks{n}")
    counts = found.groupBy("id").agg(F.sum("n").alias("n_links"))
    of = components(found.select(F.col("id").alias("a"), F.col("other").alias("b")), scratch)
    out = rows.select("id").join(counts, "id", "left").join(of, "id", "left")
    component = F.coalesce("component", "id")
    return out.select(
        F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept")
    )
