"""Removal of repeated byte strings by collection suffix arrays, built column by column.

A byte goes if a string of ``length`` bytes that covers it also starts earlier: in a smaller
document id, or earlier in the same text. Strings are judged on the input.

Strings of that length which are equal hold the same least-hashed anchor of ``ANCHOR`` bytes, so
neighbouring starts with one place of it make a segment, and only segments of one anchor can share
strings. Anchors that occur once, nearly all, end there. Equal segments are counted together
before and after the shuffle: all but the earliest go, and it alone stands for them. What is left
of an anchor, different segments, is dealt by anchor to collections of about ``COLLECTION``. There,
round after round, the next symbol of every segment from its end on is inserted into the
collection's Burrows-Wheeler transform, and the common prefix of each new suffix with its
neighbours follows from the ranges between equal symbols; each round reads both sequences once from
front to back and writes them anew. As a collection is small they are arrays in memory, not files. Suffixes
in one interval of common prefixes of ``length`` or more are equal strings, of which the earliest stays.

An anchor with more different segments than a collection holds (a line that a third of all documents hold,
say, between ever other neighbours) would be one task's work: its strings are dealt out by two independent
64-bit hashes of their own. Those that are more than a fair share of a task are known from counts
before anything is shuffled, and their segments are dealt by their own hash from the start; a task
reads its segments in order of anchor and never holds an anchor whole that is larger.

Defined results: a null text is empty; texts shorter than ``length`` stay whole; a row without id
stays whole and is no copy's origin; repeated equal rows are one document; of different texts
under one id the one of least hash is judged and the others stay whole; no rows give no rows;
other columns pass through, ``kept``, ``n_bytes``, ``n_removed`` and ``n_spans`` are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, free, join_sized, parallelism, tidied
from .shingles import _BYTE, PART_BYTES, byte_parts, mix, powers

LENGTH = 100
ANCHOR = 48
#: Segments of a collection, about; an anchor with more is hot.
COLLECTION = 4000
#: Segments that a task counts together before the shuffle.
TOGETHER = 400_000
#: Rows of a task that are looked at together after it.
CHUNK = 200_000
#: Of the segments counted together, different ones of an anchor from which on it may be more than a fair share.
OFTEN = 16
#: Bits that hold a place in the bytes of a part, which no Arrow string column exceeds.
_PLACE = np.uint64((1 << 31) - 1)


def segments(raw: list[bytes], length: int = LENGTH, anchor: int = ANCHOR) -> tuple[np.ndarray, ...]:
    """(text, first start, starts, anchor hash, hash) of the segments of each text: a segment is ``starts`` strings one byte apart."""
    sizes = np.array([len(x) for x in raw])
    begin = np.r_[0, np.cumsum(sizes)]
    flat = np.frombuffer(b"".join(raw), np.uint8)
    n = len(flat)
    if n < length:
        none = np.empty(0, np.int64)
        return none, none, none, none, none
    up, down = powers(n + 1)
    sums = np.r_[np.uint64(0), np.cumsum(_BYTE[flat] * up[:n])]
    hashes = mix((sums[anchor:] - sums[:-anchor]) * down[: n - anchor + 1])
    # least by the upper bits, then leftmost: then equal strings have their anchor at the same offset
    least = hashes & ~_PLACE | np.arange(len(hashes), dtype=np.uint64)
    have, per = 1, length - anchor + 1
    while have < per:
        step = min(have, per - have)
        least = np.minimum(least[:-step], least[step:])
        have += step
    last = np.repeat(begin[1:], sizes)[: len(least)] - length  # the last start in the text of each place
    fits = np.arange(len(least)) <= last
    edge = np.ones(len(least), bool)
    edge[1:] = (least[1:] != least[:-1]) | (fits[1:] != fits[:-1])
    edge[begin[:-1][begin[:-1] < len(least)]] = True
    first = np.flatnonzero(edge)
    end = np.r_[first[1:], len(least)]
    first, end = first[fits[first]], end[fits[first]]
    whole = mix((sums[end + length - 1] - sums[first]) * down[first], 9)
    text = np.searchsorted(begin, first, "right") - 1
    return text, first - begin[text], end - first, hashes[(least[first] & _PLACE).astype(np.int64)].view(np.int64), whole.view(np.int64)


def _first_of(keys: list[np.ndarray], order: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A sorting by keys and then order, where new keys begin in it, and the place of each row's first."""
    by = np.lexsort([*order[::-1], *keys[::-1]])
    fresh = np.zeros(len(by), bool)
    fresh[:1] = True
    for k in keys:
        fresh[1:] |= k[by][1:] != k[by][:-1]
    return by, fresh, np.flatnonzero(fresh)[np.cumsum(fresh) - 1] if len(by) else by


_ROW = "kind int, anchor long, hash long, id {0}, at int, n int"
_NAMES = ["anchor", "hash", "id", "at", "n"]
SEGMENT, GONE, HOTTER = 0, 1, 2


def _same_place(df: pd.DataFrame, by: np.ndarray, first: np.ndarray) -> np.ndarray:
    a, b = df.iloc[by], df.iloc[by[first]]
    return (a["id"].to_numpy() == b["id"].to_numpy()) & (a["at"].to_numpy() == b["at"].to_numpy())


def _together(rows: list[pd.DataFrame]) -> pd.DataFrame:
    """One row for each anchor and hash, the earliest; the others with kind GONE."""
    df = pd.concat(rows, ignore_index=True)
    by, fresh, first = _first_of([df["anchor"].to_numpy(), df["hash"].to_numpy()], [df["id"].to_numpy(), df["at"].to_numpy()])
    kind = np.where(fresh, SEGMENT, GONE)
    stays = fresh | ~_same_place(df, by, first)  # a repeated row is no copy
    out = df.iloc[by][stays]
    out.insert(0, "kind", kind[stays])
    return out


def _chunks(batches: Iterator[pd.DataFrame], length: int) -> Iterator[list[pd.DataFrame]]:
    """Segments of about ``TOGETHER`` at a time."""
    rows, size = [], 0
    for pdf in batches:
        at, ids = 0, pdf["id"].to_numpy()
        for raw in byte_parts(pdf["text"]):
            text, first, n, anchor, whole = segments(raw, length)
            rows.append(pd.DataFrame({"anchor": anchor, "hash": whole, "id": ids[at + text], "at": first, "n": n}))
            at += len(raw)
            size += len(text)
            if size > TOGETHER:
                yield rows
                rows, size = [], 0
    if rows:
        yield rows


def _often(length: int, often: int):
    """Anchors that are often met in what a task counts together, and under null how many segments there are."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in _chunks(batches, length):
            pairs = np.unique(np.concatenate([r[["anchor", "hash"]].to_numpy() for r in rows]), axis=0)
            anchor, n = np.unique(pairs[:, 0], return_counts=True)
            many = n >= often
            yield pd.DataFrame({"anchor": pd.array([*anchor[many].tolist(), None], "Int64"), "n": [*n[many].tolist(), len(pairs)]})

    return run


def _cut(length: int, hot):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in _chunks(batches, length):
            out = _together(rows)
            if len(hot.value):
                out.loc[out["anchor"].isin(hot.value) & (out["kind"] == SEGMENT), "kind"] = HOTTER
            yield from _slices(out)

    return run


def _slices(df: pd.DataFrame, most: int = 200_000) -> Iterator[pd.DataFrame]:
    for i in range(0, len(df), most):
        yield df[i : i + most]


def _by_anchor(collection: int, chunk: int):
    """Of rows in order of kind, anchor, hash and place: copies as GONE, and segments of anchors that have different ones."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        big: tuple | None = None  # kind, anchor and hash of what came last, if its anchor is too large to hold

        def whole(df: pd.DataFrame) -> Iterator[pd.DataFrame]:
            """Of anchors that end here."""
            nonlocal big
            if big is not None:
                more = int(((df["kind"] == big[0]) & (df["anchor"] == big[1])).sum())
                if more:
                    yield from part(df[:more])
                    df = df[more:]
                if len(df):
                    big = None
            if df.empty:
                return
            kind, anchor, fine = (df[c].to_numpy() for c in ("kind", "anchor", "hash"))
            new = np.r_[True, (anchor[1:] != anchor[:-1]) | (kind[1:] != kind[:-1])]
            first = new | np.r_[True, fine[1:] != fine[:-1]]
            group = np.cumsum(new) - 1
            different = np.bincount(group, weights=first)[group]
            out = np.where(~first, GONE, np.where(different > collection, HOTTER, SEGMENT))
            out[kind == HOTTER] = np.where(first, HOTTER, GONE)[kind == HOTTER]
            out[kind == GONE] = GONE
            stays = (out == GONE) | (kind == HOTTER) | (different > 1)
            yield from _slices(df[stays].assign(kind=out[stays]))

        def part(df: pd.DataFrame) -> Iterator[pd.DataFrame]:
            """Of one anchor that is larger than a chunk."""
            nonlocal big
            kind, anchor, fine = df["kind"].iloc[0], df["anchor"].iloc[0], df["hash"].to_numpy()
            first = np.r_[big is None or big[2] != fine[0], fine[1:] != fine[:-1]]
            big = kind, anchor, fine[-1]
            yield from _slices(df.assign(kind=np.where(first & (kind != GONE), HOTTER, GONE)))

        held: list[pd.DataFrame] = []
        size = 0
        for pdf in batches:
            held.append(pdf)
            size += len(pdf)
            if size < chunk:
                continue
            df = pd.concat(held, ignore_index=True)
            same = ((df["kind"] == df["kind"].iloc[-1]) & (df["anchor"] == df["anchor"].iloc[-1])).to_numpy()
            begin = int(same.argmax())
            if begin:
                yield from whole(df[:begin])
                df = df[begin:]
            if len(df) >= chunk:
                if big is not None and (big[0] != df["kind"].iloc[0] or big[1] != df["anchor"].iloc[0]):
                    big = None
                yield from part(df)
                df = df[:0]
            held, size = [df], len(df)
        if size:
            yield from whole(pd.concat(held, ignore_index=True))

    return run


def _fetch(length: int):
    """Bytes of the segments of each document; of hot anchors two hashes of each string."""

    def strings(pieces: list[bytes], ids: list, at: list[int]) -> Iterator[pd.DataFrame]:
        flat = np.frombuffer(b"".join(pieces), np.uint8)
        sizes = np.array([len(x) for x in pieces])
        n = sizes - length + 1
        nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        start = np.repeat(np.cumsum(sizes) - sizes, n) + nth
        two = {}
        for base, name in enumerate(("anchor", "hash")):
            up, down = powers(len(flat) + 1, base)
            sums = np.r_[np.uint64(0), np.cumsum(mix(_BYTE[flat], base) * up[: len(flat)])]
            two[name] = mix((sums[start + length] - sums[start]) * down[start], 3 + base).view(np.int64)
        yield from _slices(pd.DataFrame({"kind": HOTTER, **two, "id": np.repeat(ids, n), "at": np.repeat(at, n) + nth, "n": 1, "piece": b""}))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            columns = [[] for _ in range(5)]
            anchor, ids, at, n, pieces = columns
            hot_pieces, hot_ids, hot_at, size = [], [], [], 0
            for i, text, kinds, anchors, starts, counts in zip(*(pdf[c] for c in ("id", "text", "kinds", "anchors", "starts", "counts")), strict=True):
                raw = text.encode()
                plain = kinds == SEGMENT
                for k, a, s, c in zip(plain.tolist(), anchors.tolist(), starts.tolist(), counts.tolist(), strict=True):
                    piece = raw[s : s + c + length - 1]
                    size += len(piece)
                    if k:
                        anchor.append(a)
                        ids.append(i)
                        at.append(s)
                        n.append(c)
                        pieces.append(piece)
                    else:
                        hot_pieces.append(piece)
                        hot_ids.append(i)
                        hot_at.append(s)
                if size > PART_BYTES * 8:
                    yield pd.DataFrame({"kind": SEGMENT, "anchor": anchor, "hash": 0, "id": ids, "at": at, "n": n, "piece": pieces})
                    if hot_pieces:
                        yield from strings(hot_pieces, hot_ids, hot_at)
                    for c in (*columns, hot_pieces, hot_ids, hot_at):
                        c.clear()
                    size = 0
            if pieces:
                yield pd.DataFrame({"kind": SEGMENT, "anchor": anchor, "hash": 0, "id": ids, "at": at, "n": n, "piece": pieces})
            if hot_pieces:
                yield from strings(hot_pieces, hot_ids, hot_at)

    return run


def column_wise(texts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, interval) of every string of ``length`` bytes; equal strings have one interval.

    The transform and the common prefixes are sequences that a round reads once and replaces.
    No text may hold byte 255, as UTF-8 doesn't, and none may be longer than 254 bytes.
    """
    m = len(texts)
    size = np.array([len(t) for t in texts])
    flat = np.frombuffer(b"".join(texts), np.uint8)
    end = np.cumsum(size)
    bwt, lcp = flat[end - 1] + np.uint8(1), np.zeros(m, np.uint8)  # 0 is the end mark before a whole text
    place = np.arange(m)  # of each text's newest suffix
    for j in range(1, int(size.max()) + 1):
        n = len(bwt)
        order = np.argsort(bwt, kind="stable")
        live = np.flatnonzero(size >= j)
        live = live[np.argsort(place[live])]
        newest = np.zeros(n, bool)
        newest[place[live]] = True
        t = np.flatnonzero(newest[order])
        r = order[t]
        live = live[np.searchsorted(place[live], r)]
        new = t + len(live)  # behind the marks: as many texts as are live have not reached theirs
        symbol = bwt[r]
        before, after = order[np.maximum(t - 1, 0)], order[np.minimum(t + 1, n - 1)]
        has_before = (t > 0) & (bwt[before] == symbol)
        has_after = (t + 1 < n) & (bwt[after] == symbol)
        out_bwt, out_lcp = np.empty(n + len(live), np.uint8), np.zeros(n + len(live), np.uint8)
        old = np.ones(n + len(live), bool)
        old[new] = False
        out_bwt[old], out_lcp[old] = bwt, lcp
        out_bwt[new] = np.where(size[live] > j, flat[end[live] - np.minimum(j + 1, size[live])] + np.uint8(1), 0)
        out_lcp[new] = 0
        lo = np.r_[before[has_before] + 1, r[has_after] + 1]
        hi = np.r_[r[has_before] + 1, after[has_after] + 1]
        to = np.r_[new[has_before], new[has_after] + 1]
        if len(lo):
            out_lcp[to] = _range_min(lcp, lo, hi) + 1
        bwt, lcp = out_bwt, out_lcp
        place[live] = new
    rank = np.empty(len(bwt), np.int64)
    rank[np.argsort(bwt, kind="stable")] = np.arange(len(bwt))
    interval = np.cumsum(lcp < length)
    owner, start, found = [], [], []
    p = np.arange(m)
    for j in range(1, int(size.max()) + 1):
        live = np.flatnonzero(size >= j)
        p[live] = rank[p[live]]
        if j >= length:
            owner.append(live)
            start.append(size[live] - j)
            found.append(interval[p[live]])
    return np.concatenate(owner), np.concatenate(start), np.concatenate(found)


def _range_min(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Minima of values[lo:hi], no range empty."""
    by = np.argsort(lo)
    padded = np.r_[values, np.uint8(255)]
    out = np.empty(len(lo), values.dtype)
    out[by] = np.minimum.reduceat(padded, np.c_[lo[by], hi[by]].ravel())[::2]
    return out


def _collection(length: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        owner, start, interval = column_wise(pdf["piece"].tolist(), length)
        ids, at = pdf["id"].to_numpy()[owner], pdf["at"].to_numpy()[owner] + start
        df = pd.DataFrame({"id": ids, "at": at})
        by, _, first = _first_of([interval], [ids, at])
        gone = df.iloc[by][~_same_place(df, by, first)].sort_values(["id", "at"])
        i, a = gone["id"].to_numpy(), gone["at"].to_numpy()
        fresh = np.ones(len(a), bool)
        fresh[1:] = (i[1:] != i[:-1]) | (a[1:] != a[:-1] + 1)
        s = np.flatnonzero(fresh)
        return pd.DataFrame({"id": i[s], "at": a[s], "n": np.diff(np.r_[s, len(a)])})

    return run


def repeats(docs: DataFrame, scratch: Scratch, length: int = LENGTH) -> DataFrame:
    """(id, at, n): of the document, the ``n`` strings from byte ``at`` on also start earlier; docs is (id, text), an id once."""
    kind = docs.schema["id"].dataType.simpleString()
    row = _ROW.format(kind)
    often = docs.mapInPandas(tidied(_often(length, OFTEN)), "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n"))
    often = scratch.keep(often, "often")
    share = (often.where("anchor is null").agg(F.sum("n")).first()[0] or 0) // (8 * parallelism(docs.sparkSession))
    hot = often.where(F.col("anchor").isNotNull() & (F.col("n") > max(share, COLLECTION)))  # so many shares there are at most
    hot = docs.sparkSession.sparkContext.broadcast(np.array([r["anchor"] for r in hot.collect()], np.int64))
    cut = docs.mapInPandas(tidied(_cut(length, hot)), row)
    own = F.when(F.col("kind") == SEGMENT, F.col("anchor")).when(F.col("kind") == HOTTER, F.xxhash64("anchor", "hash")).otherwise(F.xxhash64("id", "at"))
    spread = cut.repartition(own).sortWithinPartitions("kind", "anchor", "hash", "id", "at")
    found = scratch.keep(spread.mapInPandas(tidied(_by_anchor(COLLECTION, CHUNK)), row), "anchors")
    gone = found.where(F.col("kind") == GONE).select("id", "at", "n")
    open_ = found.where(F.col("kind") != GONE)
    lists = open_.groupBy("id").agg(F.collect_list(F.struct("kind", "anchor", "at", "n")).alias("p"))
    lists = lists.select("id", F.col("p.kind").alias("kinds"), F.col("p.anchor").alias("anchors"), F.col("p.at").alias("starts"), F.col("p.n").alias("counts"))
    lists = scratch.keep(lists, "lists")
    pieces = scratch.keep(docs.join(lists.hint("merge"), "id").mapInPandas(tidied(_fetch(length)), f"{row}, piece binary"), "pieces")
    segment = pieces.where(F.col("kind") == SEGMENT)
    many = max(1, -(-segment.count() // COLLECTION))
    dealt = segment.select("id", "at", "n", "piece", F.pmod(F.xxhash64("anchor"), F.lit(many)).alias("part"))
    dealt = dealt.repartition(min(many, max(4 * parallelism(docs.sparkSession), many // 50)), "part")  # a given number, as few bytes are much work
    later = dealt.groupBy("part").applyInPandas(_collection(length), f"id {kind}, at long, n long")
    hot = pieces.where(F.col("kind") == HOTTER).select("anchor", "hash", "id", "at")
    firsts = hot.groupBy("anchor", "hash").agg(F.min(F.struct("id", "at")).alias("first"), F.count(F.lit(1)).alias("c")).where("c > 1")
    firsts = scratch.keep(firsts.drop("c"), "firsts")
    hot = hot.join(firsts, ["anchor", "hash"]).where(F.struct("id", "at") != F.col("first"))
    return gone.unionByName(later).unionByName(hot.select("id", "at", F.lit(1).alias("n")))


def _remove(length: int):
    def one(raw: bytes, spans) -> tuple[bytes, int, int]:
        depth = np.zeros(len(raw) + 1, np.int64)
        at = np.array([s["at"] for s in spans])
        np.add.at(depth, at, 1)
        np.add.at(depth, at + np.array([s["n"] for s in spans]) + length - 1, -1)
        gone = np.cumsum(depth)[:-1] > 0
        runs = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
        return np.frombuffer(raw, np.uint8)[~gone].tobytes(), int(gone.sum()), runs

    @F.pandas_udf("kept binary, n_removed long, n_spans long")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, spans in batches:
            rows = [(None, 0, 0) if s is None else one(t.encode(), s) for t, s in zip(texts, spans, strict=True)]
            yield pd.DataFrame(rows, columns=["kept", "n_removed", "n_spans"])

    return run


def remove_repeats(docs: DataFrame, text: str = "text", id_col: str = "doc_id", length: int = LENGTH) -> DataFrame:
    """docs with kept (the remaining bytes, which may cut a character), n_bytes, n_removed and n_spans (maximal removed runs)."""
    scratch = Scratch(docs.sparkSession)
    docs = docs.drop("kept", "n_bytes", "n_removed", "n_spans")
    columns = docs.columns
    own_id, own_h, other, own_spans, own_cut = free(docs, "_id", "_h", "_other", "_spans", "_cut")
    ids = docs.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias(own_id))
    twice = ids.agg(F.min(F.xxhash64(text)).alias(own_h), F.count(F.lit(1)).alias("c")).where("c > 1").drop("c")
    twice = scratch.keep(twice, "twice")
    full = F.coalesce(F.col(text), F.lit(""))
    if twice.take(1):  # rows of one id
        docs = join_sized(docs, twice, F.col(id_col) == F.col(own_id), "left", 32)
        docs = docs.withColumn(other, F.col(own_h).isNotNull() & (F.xxhash64(text) != F.col(own_h))).drop(own_id, own_h)
        judged = docs.where(F.col(id_col).isNotNull() & ~F.col(other)).select(F.col(id_col).alias("id"), full.alias("text")).distinct()
    else:
        docs = docs.withColumn(other, F.lit(False))
        judged = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), full.alias("text"))
    spans = repeats(judged, scratch, length).groupBy(F.col("id").alias(own_id)).agg(F.collect_list(F.struct("at", "n")).alias(own_spans))
    spans = scratch.keep(spans, "spans")
    out = docs.join(spans.hint("merge"), (F.col(id_col) == F.col(own_id)) & ~F.col(other), "left")
    cut = _remove(length)(F.when(F.col(own_spans).isNotNull(), full), F.col(own_spans))
    out = out.withColumn(own_cut, cut).withColumn("n_bytes", F.octet_length(full).cast("long"))
    parts = {"kept": F.coalesce(F.col(own_cut)["kept"], full.cast("binary")), "n_removed": F.col(own_cut)["n_removed"], "n_spans": F.col(own_cut)["n_spans"]}
    return out.withColumns(parts).select(*columns, "n_bytes", *parts)
