"""N-gram Jaccard join: prefixes of single tokens where they are rare, of token combinations where they are frequent.

Tokens are hashes of word shingles, ordered by hash; those found in more than ``RARE`` of the
sets' first tokens, up to ``MAX_LAST`` of them and the most frequent, come last instead. Any
choice of these gives one order for all sets. Two sets of the wanted similarity differ in so few
tokens that they share one in their first X + 1, where X is how many tokens of a set may be
missing in the other. Tokens of such prefixes that are in at most ``RARE`` of them are index
keys. Sets with a more frequent token left in their prefix extend it, until the tokens they
share with a partner cannot all be parted by tokens they don't share, and index runs of ``RUN``
neighbouring tokens. A pair without a rare common token so has a common run, and no pair is lost.
A key holds a class of sizes too, each set having its own class and the next, so that sets of
sizes too different to be similar seldom meet.

Equal sets are one node first, the one of least id. As links are asked for by component, each
key's nodes are first compared with one of them, the one that shares most of its tokens, which
copies derive from. Then only pairs under one key that the links so far leave in different
components are looked at, inside the tasks that hold the keys (a key with many nodes is dealt out
as pairs of blocks of them): in ``ROUNDS`` rounds each node's most similar one under an eighth of
the keys, as similar ones share many, then all that are left under any key. Pairs pass
a size filter and a bound of their difference from parity bitmaps, two bits a token or more, before
their texts are fetched and counted.

Defined results: a null or empty text, or one without words, has no shingles and no links; with
fewer words than a shingle the whole is one; very long texts count whole; rows of one id are
one document that has the links of each; a row without id has no links; no rows give no rows;
other columns pass through in ``keep_one`` and are not read else.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, free, join_sized, most_frequent, tidied
from .graph import components
from .shingles import byte_parts, combined, mix, shingle_sets

#: Sets that share a rare token at most, and tokens of a combination.
RARE, RUN = 32, 3
#: Frequent tokens that come last, at most: 8 MB of them are broadcast.
MAX_LAST = 1 << 20
#: Nodes of a key that are compared as one block.
BLOCK = 2000
#: Rounds in which each node is compared with its most similar one elsewhere: each joins two or more components to one.
ROUNDS = 3
#: Bytes of the bitmaps that are compared first.
SMALL = 64


class Bounds:
    """What sets of n tokens with a Jaccard similarity of percent / 100 or more can differ in."""

    def __init__(self, percent: int):
        if not 50 <= percent <= 100:  # sizes of similar sets are then within a factor of two
            raise ValueError(f"a similarity of {percent} percent is not supported")
        self.percent = percent
        bad = [n for n in range(1, 2000) if self.apart(n) and self.extended(n, RUN) > n]
        #: Sets up to this size also index runs of two: a partner may be too small for longer ones.
        self.short = max(bad, default=0) * 100 // percent

    def missing(self, n: int) -> int:
        """Tokens of a set that are not in the other, at most."""
        return n * (100 - self.percent) // 100

    def apart(self, n: int) -> int:
        """Tokens in one of the two sets only, at most."""
        return n * (100 - self.percent) // self.percent

    def prefix(self, n: int) -> int:
        """No set but an equal one is similar if none may be apart."""
        return self.missing(n) + 1 if self.apart(n) else 0

    def extended(self, n: int, run: int) -> int:
        return self.missing(n) + (run - 1) * (self.apart(n) + 1) + 1

    def linked(self, n: int, m: int, common: int) -> bool:
        return n > 0 and m > 0 and 100 * common >= self.percent * (n + m - common)

    def size_fits(self, n: Column, m: Column) -> Column:
        return 100 * F.least(n, m) >= self.percent * F.greatest(n, m)


def _bitmap(tokens: np.ndarray) -> bytes:
    """Parities of the tokens of each slot; with the slots in halves, smaller maps are folds of larger ones."""
    size = 1 << max(7, int(2 * len(tokens)).bit_length())
    slots = (mix(tokens.view(np.uint64), 5) & np.uint64(size - 1)).astype(np.int64)
    return np.packbits((np.bincount(slots, minlength=size) & 1).astype(np.uint8)).tobytes()


def _small(bits: bytes) -> bytes:
    """A bitmap folded to SMALL bytes at most: what travels with every key of a node."""
    x = np.frombuffer(bits, np.uint8)
    while len(x) > SMALL:
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return x.tobytes()


def _differ(a: bytes, b: bytes) -> int:
    """Tokens that two sets differ in, at least."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def _sketches(width: int, bounds: Bounds):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            at = 0
            for raw in byte_parts(pdf["text"]):
                out = []
                for t in shingle_sets(raw, width):
                    u = t.view(np.uint64)
                    h1, h2 = (int(mix(u, k).sum(dtype=np.uint64).astype(np.int64)) for k in (1, 2))
                    bits = _bitmap(t) if len(t) else b""
                    out.append((len(t), h1, h2, bits, _small(bits), t[: bounds.prefix(len(t)) * 5 // 4 + 4]))
                made = pd.DataFrame(out, columns=["n", "h1", "h2", "bits", "small", "first"])
                made.insert(0, "id", pdf["id"].iloc[at : at + len(raw)].to_numpy())
                at += len(raw)
                yield made

    return run


def _is_in(tokens: np.ndarray, ascending: np.ndarray) -> np.ndarray:
    if not len(ascending):
        return np.zeros(len(tokens), bool)
    return ascending[np.minimum(np.searchsorted(ascending, tokens), len(ascending) - 1)] == tokens


def _prefixes(bounds: Bounds, last):
    """Prefix of each node in the order with frequent tokens last; null where the first tokens kept of a set don't hold it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for n, first in zip(pdf["n"].tolist(), pdf["first"], strict=True):
                fine, p = first[~_is_in(first, last.value)], bounds.prefix(n)
                out.append(fine[:p] if len(fine) >= p else None)
            yield pdf[["id", "n"]].assign(prefix=out)

    return run


def _ordered(width: int, bounds: Bounds, last):
    """Of whole texts the prefix (run 0) or the runs of an extended one, in the order with frequent tokens last."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            at, wanted = 0, pdf["runs"].tolist()
            for raw in byte_parts(pdf["text"]):
                ids, sizes, keys = [], [], []
                for t in shingle_sets(raw, width):
                    n, back = len(t), _is_in(t, last.value)
                    t = np.r_[t[~back], t[back]]
                    if wanted[at]:
                        got = [combined(t[: bounds.extended(n, k)].view(np.uint64), k).view(np.int64) for k in {RUN, 2 if n <= bounds.short else RUN}]
                    else:
                        got = [t[: bounds.prefix(n)]]
                    for x in got:
                        ids.append(np.full(len(x), pdf["id"].iloc[at]))
                        sizes.append(np.full(len(x), n))
                        keys.append(x)
                    at += 1
                ids, sizes, keys = map(np.concatenate, (ids, sizes, keys))
                for i in range(0, len(keys), 1 << 17):
                    s = slice(i, i + (1 << 17))
                    yield pd.DataFrame({"id": ids[s], "n": sizes[s], "key": keys[s]})

    return run


def _near_bits(bounds: Bounds):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            most = (pdf["n"] + pdf["m"]).to_numpy() * (100 - bounds.percent) / (100 + bounds.percent)
            least = np.array([_differ(a, b) for a, b in zip(pdf["x"], pdf["y"], strict=True)], np.float64)
            yield pdf.loc[least <= most + 1e-9, ["a", "b"]]

    return run


def _across(bounds: Bounds, best: bool):
    """Pairs of nodes of a unit (a key, or two blocks of one) in different components that sizes and bitmaps don't rule out.

    If best, only the least different one of each node outside the unit's largest component. ``d`` is the least difference.
    """

    def folded(bits: np.ndarray) -> np.ndarray:
        half = bits.shape[1] // 2
        return bits[:, :half] ^ bits[:, half:]

    def pairs(df: pd.DataFrame) -> pd.DataFrame:
        unit, n, component = df["unit"].to_numpy(), df["n"].to_numpy(), df["component"].to_numpy()
        ids, block, alone = df["id"].to_numpy(), df["block"].to_numpy(), (df["lo"] == df["hi"]).to_numpy()
        width = df["bits"].map(len).to_numpy()
        row = np.zeros(len(df), np.int64)
        own, half = {}, {}
        for w in np.unique(width).tolist():
            at = np.flatnonzero(width == w)
            row[at] = np.arange(len(at))
            own[w] = np.frombuffer(b"".join(df["bits"].iloc[at]), np.uint8).reshape(len(at), w)
            half[w] = folded(own[w])
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        most = int(np.diff(np.r_[np.flatnonzero(np.r_[True, unit[1:] != unit[:-1]]), len(unit)]).max())
        for d in range(1, most):
            i = np.flatnonzero(unit[d:] == unit[:-d])
            j = i + d
            fine = (component[i] != component[j]) & (ids[i] != ids[j]) & (alone[i] | (block[i] != block[j]))
            fine &= 100 * np.minimum(n[i], n[j]) >= bounds.percent * np.maximum(n[i], n[j])
            i, j = i[fine], j[fine]
            i, j = np.where(width[i] <= width[j], i, j), np.where(width[i] <= width[j], j, i)
            for w in np.unique(width[i]).tolist():
                for same in (True, False):  # sizes that fit differ by one halving at most
                    k = np.flatnonzero((width[i] == w) & ((width[j] == w) == same))
                    if not len(k):
                        continue
                    a, b = i[k], j[k]
                    other = own[w][row[b]] if same else half[2 * w][row[b]]
                    least = np.bitwise_count(own[w][row[a]] ^ other).sum(1, dtype=np.int64)
                    near = least * (100 + bounds.percent) <= (n[a] + n[b]) * (100 - bounds.percent)
                    if near.any():
                        found.append((a[near], b[near], least[near]))
        a, b, least = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.empty(0, np.int64),) * 3
        if best:
            sizes = pd.DataFrame({"unit": unit, "component": component}).groupby(["unit", "component"], sort=False).size().reset_index(name="c")
            largest = sizes.sort_values("c", kind="stable").drop_duplicates("unit", keep="last").set_index("unit")["component"]
            a, b, least = np.r_[a, b], np.r_[b, a], np.r_[least, least]
            small = component[a] != largest.reindex(unit[a]).to_numpy()
            a, b, least = a[small], b[small], least[small]
            by = np.lexsort([b, least, a])
            a, b, least = a[by], b[by], least[by]
            one = np.r_[True, a[1:] != a[:-1]] if len(a) else np.empty(0, bool)
            return pd.DataFrame({"a": ids[a[one]], "b": ids[b[one]], "d": least[one]})
        x, y = ids[a], ids[b]
        return pd.DataFrame({"a": np.minimum(x, y), "b": np.maximum(x, y), "d": least}).drop_duplicates()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, out = None, []
        for pdf in batches:  # a partition comes in order of unit
            held = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            if len(held) >= BLOCK:
                last = (held["unit"] != held["unit"].iloc[-1]).to_numpy()
                if last.any():
                    out.append(pairs(held[last]))
                    held = held[~last].reset_index(drop=True)
        if held is not None and len(held):
            out.append(pairs(held))
        if out:  # a pair may meet under many keys
            found = pd.concat(out, ignore_index=True)
            yield found.sort_values(["a", "d", "b"]).drop_duplicates("a") if best else found.drop_duplicates()

    return run


def _exact(width: int, bounds: Bounds):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for i in range(0, len(pdf), 256):
                part = pdf[i : i + 256]
                texts = list(dict.fromkeys([*part["x"], *part["y"]]))
                sets = dict(zip(texts, (s for raw in byte_parts(texts) for s in shingle_sets(raw, width)), strict=True))
                fits = [
                    bounds.linked(len(u := sets[x]), len(v := sets[y]), len(np.intersect1d(u, v, assume_unique=True)))
                    for x, y in zip(part["x"], part["y"], strict=True)
                ]
                yield part.loc[fits, ["a", "b"]]

    return run


class Join:
    def __init__(self, docs: DataFrame, text: str, id_col: str, width: int, percent: int):
        self.docs = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
        self.kind = self.docs.schema["id"].dataType.simpleString()
        self.width, self.bounds, self.scratch = width, Bounds(percent), Scratch(docs.sparkSession)

    def nodes(self) -> DataFrame:
        """(id, n, node, bits, small, first) of every row; the last three only for nodes, node is null without shingles or id."""
        schema = f"id {self.kind}, n long, h1 long, h2 long, bits binary, small binary, first array<long>"
        sketches = self.scratch.keep(self.docs.mapInPandas(tidied(_sketches(self.width, self.bounds)), schema), "sketches")
        # a table, so that both sides of the join are plain shuffles and one with very many copies can be split
        classes = self.scratch.keep(sketches.where("n > 0").groupBy("h1", "h2", "n").agg(F.min("id").alias("node")), "classes")
        joined = sketches.join(classes.hint("merge"), ["h1", "h2", "n"], "left")
        own = F.col("id") == F.col("node")
        out = self.scratch.keep(joined.select("id", "n", "node", *(F.when(own, F.col(c)).alias(c) for c in ("bits", "small", "first"))), "nodes")
        self.scratch.drop("sketches")
        return out

    def shared(self, rows: DataFrame, tag: str) -> DataFrame:
        """Rows (id, n, key) whose key occurs twice or more, and how often, as c."""
        often = rows.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
        return self.scratch.keep(rows.join(often, "key"), tag)

    def of_texts(self, ids: DataFrame, last, runs: bool) -> DataFrame:
        texts = join_sized(self.docs, ids, "id", "left_semi", 32).withColumn("runs", F.lit(runs))
        return texts.mapInPandas(tidied(_ordered(self.width, self.bounds, last)), f"id {self.kind}, n long, key long")

    def index(self, nodes: DataFrame) -> DataFrame:
        own = nodes.where("first is not null").select("id", "n", "first")
        counted = own.select(F.explode("first").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > RARE)
        counted = self.scratch.keep(counted.withColumnRenamed("c", "n"), "counted")
        last = self.docs.sparkSession.sparkContext.broadcast(np.sort(np.array(most_frequent(counted, "t", MAX_LAST), np.int64)))
        made = self.scratch.keep(own.mapInPandas(tidied(_prefixes(self.bounds, last)), f"id {self.kind}, n long, prefix array<long>"), "prefixes")
        beyond = self.scratch.keep(made.where("prefix is null").select("id"), "beyond")
        more = self.scratch.keep(self.of_texts(beyond, last, False), "more")
        single = self.shared(made.select("id", "n", F.explode("prefix").alias("key")).unionByName(more), "singles")
        frequent = self.scratch.keep(single.where(F.col("c") > RARE).select("id").distinct(), "frequent")
        runs = self.scratch.keep(self.of_texts(frequent, last, True), "runs")
        rare = single.where(F.col("c") <= RARE).select("id", "n", "key")
        step = float(np.log(100 / self.bounds.percent))  # the larger of two similar sets is in the class of the smaller or the next
        own = F.floor(F.log("n") / step)
        sized = rare.unionByName(runs).withColumn("class", F.explode(F.array(own, own + 1)))
        out = self.shared(sized.select("id", "n", F.xxhash64("key", "class").alias("key")).distinct(), "index").drop("c")
        self.scratch.drop("classes", "counted", "prefixes", "beyond", "more", "singles", "frequent", "runs")
        return out

    def near(self, pairs: DataFrame, nodes: DataFrame) -> DataFrame:
        """Pairs (a, b) that the bitmaps don't rule out."""
        of = nodes.where("bits is not null")
        a = of.select(F.col("id").alias("a"), "n", F.col("bits").alias("x"))
        b = of.select(F.col("id").alias("b"), F.col("n").alias("m"), F.col("bits").alias("y"))
        joined = pairs.join(a, "a").join(b, "b").select("a", "b", "n", "m", "x", "y")
        return joined.mapInPandas(tidied(_near_bits(self.bounds)), f"a {self.kind}, b {self.kind}")

    def linked(self, pairs: DataFrame, tag: str) -> DataFrame:
        """Pairs whose whole texts are similar enough."""
        pairs = self.scratch.keep(pairs.distinct(), f"{tag}-pairs")
        ids = self.scratch.keep(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), f"{tag}-ids")
        texts = join_sized(self.docs, ids, "id", "left_semi", 32)
        a, b = texts.select(F.col("id").alias("a"), F.col("text").alias("x")), texts.select(F.col("id").alias("b"), F.col("text").alias("y"))
        joined = pairs.join(a.hint("merge"), "a").join(b.hint("merge"), "b").select("a", "b", "x", "y")  # as for large tables
        out = self.scratch.keep(joined.mapInPandas(tidied(_exact(self.width, self.bounds)), f"a {self.kind}, b {self.kind}").distinct(), f"{tag}-links")
        self.scratch.drop(f"{tag}-pairs", f"{tag}-ids")
        return out

    def star(self, index: DataFrame, nodes: DataFrame) -> DataFrame:
        """A link of each node with one centre: of the centres of its keys the one that shares most keys."""
        share = index.groupBy("id").agg(F.count(F.lit(1)).alias("keys"))
        ranked = index.join(share, "id")
        centre = ranked.groupBy("key").agg(F.min(F.struct((-F.col("keys") / F.col("n")).alias("rank"), F.col("id").alias("b"))).alias("c"))
        pairs = index.join(centre, "key").select(F.col("id").alias("a"), F.col("c.b").alias("b")).where("a <> b")
        pairs = self.scratch.keep(pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("c")), "star")
        near = self.near(pairs.select("a", "b"), nodes).join(pairs, ["a", "b"])
        best = near.groupBy("a").agg(F.max(F.struct("c", "b")).alias("best")).select("a", F.col("best.b").alias("b"))
        out = self.linked(best, "centres")
        self.scratch.drop("star")
        return out

    def across(self, index: DataFrame, nodes: DataFrame, links: DataFrame, tag: str, best: bool) -> DataFrame:
        """Links of pairs under one key that ``links`` leave in different components: of each node's best one, or of all."""
        of = components(links, self.scratch, f"before-{tag}")
        placed = index.join(of, "id", "left").withColumn("component", F.coalesce("component", "id"))
        if best:
            placed = placed.where(F.pmod(F.xxhash64("key", F.lit(5)), F.lit(8)) == 0)
        placed = self.scratch.keep(placed, f"placed-{tag}")
        spans = F.min("component").alias("low"), F.max("component").alias("high"), F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks")
        open_keys = placed.groupBy("key").agg(*spans).where("low < high").drop("low", "high")
        bits = nodes.where("bits is not null").select("id", F.col("small").alias("bits"))
        rows = placed.join(open_keys, "key").withColumn("block", F.pmod(F.xxhash64("id", F.lit(3)), "blocks"))
        rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        rows = rows.withColumn("lo", F.least("block", "other")).withColumn("hi", F.greatest("block", "other")).withColumn("unit", F.xxhash64("key", "lo", "hi"))
        rows = rows.join(bits.hint("merge"), "id").select("unit", "id", "n", "component", "block", "lo", "hi", "bits")
        dealt = rows.repartition("unit").sortWithinPartitions("unit")
        pairs = dealt.mapInPandas(tidied(_across(self.bounds, best)), f"a {self.kind}, b {self.kind}, d long")
        if best:
            pairs = pairs.groupBy("a").agg(F.min(F.struct("d", "b")).alias("best")).select(F.least("a", "best.b").alias("a"), F.greatest("a", "best.b").alias("b"))
        pairs = self.scratch.keep(pairs.select("a", "b").distinct(), f"met-{tag}")
        self.scratch.drop(f"placed-{tag}")
        out = self.linked(self.near(pairs, nodes), tag)
        self.scratch.drop(f"met-{tag}")
        return out

    def run(self) -> DataFrame:
        """(id, n_shingles, component_id) of every row."""
        nodes = self.nodes()
        index = self.index(nodes)
        links = self.star(index, nodes)
        for turn in range(1, ROUNDS + 1):
            links = self.scratch.keep(links.union(self.across(index, nodes, links, f"best{turn}", True)), f"links{turn}")
            self.scratch.drop(f"best{turn}-links", f"links{turn - 1}" if turn > 1 else "centres-links")
        links = self.scratch.keep(links.union(self.across(index, nodes, links, "all", False)), "links")
        self.scratch.drop("index", "all-links", f"links{ROUNDS}" if ROUNDS else "centres-links")
        of = components(links, self.scratch, "end").withColumnRenamed("id", "node")
        out = nodes.select("id", "n", "node").join(of, "node", "left")
        return out.select("id", F.col("n").alias("n_shingles"), F.coalesce("component", "node", "id").alias("component_id"))


def similar_groups(docs: DataFrame, text: str = "text", id_col: str = "doc_id", width: int = 3, percent: int = 90) -> DataFrame:
    """id, n_shingles (size of its set) and component_id (least id that links reach, itself included) of every row."""
    return Join(docs, text, id_col, width, percent).run().withColumnRenamed("id", id_col)


def keep_one(docs: DataFrame, text: str = "text", id_col: str = "doc_id", width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs whose id is the least of its group; those without id or shingles stay."""
    groups = Join(docs, text, id_col, width, percent)
    (own,) = free(docs, "_gone")
    gone = groups.scratch.last(groups.run().where("component_id <> id").select(F.col("id").alias(own)).distinct(), "gone")
    return join_sized(docs, gone, F.col(id_col) == F.col(own), "left_anti", 32)
