"""Substring dedup of near-equal passages by compact windows.

A text is a sequence of 5-word shingles. Under one hash function the Cartesian tree of their
hashes has a node for each shingle that is least in some passage; the node's compact window
stands for all passages around that shingle inside it, which so share a min-hash. Only nodes
whose window holds ``MIN_WORDS`` words are made, ``HASHES`` functions each: two passages of
Jaccard similarity 0.8 agree under one of four with probability 0.998, and longer ones have more nodes.

Windows meet by hash function and min-hash. Windows whose surroundings are equal are copies, all
but the earliest are marked at once, before and after the shuffle. Where surroundings differ, a
passage reaches at least half its length to the left or to the right of the shared shingle, and
one changed word leaves one of these sides as it was. So a window is joined with the earliest one
of its min-hash, if 64-bit parities of the shingles on one side are alike, and with the earliest
ones of equal parity on the left and on the right, if the intervals leave room for a passage. This
takes no pairs of a group, only firsts, and nearly all copies are found by it. A window that no passage
found so covers is then laid beside all other earlier windows of its min-hash, inside the tasks that hold
the key, in blocks where it has many, and joined with those that differ least from it on the left and on
the right; so a first that is only half a passage hides no later one, and no pairs of a group leave a task.
Where more of them fit than were compared, and the window is still open, it is crowded: a last round lays it
beside all of them by 16-bit codes of every shingle around, which tell passages from halves. All passages of least length
around one shingle run together, so the one of the least and the one of the greatest place that shares enough span them all.
Texts of such pairs are fetched and the passages around the shared shingle are grown in both as
long as four of five shingles are shared, or eight of nine; where that ends too early, as a change near
an end costs more than what follows it gives, the passage of least length with most shared ones is
taken. Both must hold ``MIN_WORDS`` words and their sets reach the similarity. The passage of the later text is marked, wherever it is, and marked
words go. Passages are judged on the input, not on what is left; at their edges, words that only
another earlier text than the one compared shares stay.

Shingles that are least in more than ``FREQUENT`` windows of different surroundings, such as those of a line that a third of
all texts hold, come last in every order, up to ``MAX_FREQUENT`` of them, the most frequent: any
choice gives valid orders, so this only moves windows to rarer shingles.

Defined results: a null text, one shorter than ``MIN_WORDS`` words or a row without id stays as it
is; earlier means a smaller id or an earlier place in one text; repeated equal rows are one
document and stay alike; different texts under one id get the spans found in any of them, cut to
their length; no rows give no rows; other columns pass through; ``n_removed`` and
``n_spans`` are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, free, join_sized, most_frequent, tidied
from .shingles import byte_parts, combined, mix, powers, words

WIDTH, PERCENT, MIN_WORDS = 5, 80, 50
HASHES = 4
FREQUENT, MAX_FREQUENT = 8, 1 << 20
#: Windows that a task counts together before the shuffle.
TOGETHER = 400_000
#: Windows that a task looks at together after the shuffle, and windows of a key that are laid beside each other as one block.
CHUNK, BLOCK = 200_000, 20_000
#: Least different windows, on either side, that an open window is compared with in each block at once; if more fit, codes decide.
NEAREST = 2
#: Shingles of a passage of least length, and how far surroundings reach.
SPAN = MIN_WORDS - WIDTH + 1
#: Shingles on a side of a window's own that are compared by parity, and bits that may differ: one word changed makes ten.
SIDE, SIDE_BITS = SPAN // 2, 12
#: Shingles in common that two passages of least length need, and that one needs to be four fifths of a set.
ALIKE, PARTLY = -(-2 * SPAN * PERCENT // (100 + PERCENT)), -(-SPAN * PERCENT // 100)
#: Places around a window's own that have codes.
AROUND = 2 * SPAN - 1
_PLACE = np.uint64((1 << 31) - 1)
_LAST = np.uint64(1 << 63)


def least_places(key: np.ndarray, cut: np.ndarray, span: int) -> np.ndarray:
    """Ascending places that are least in some ``span`` neighbouring places of a text; the lower bits of a key are its place."""
    n = len(key)
    if n < span:
        return np.empty(0, np.int64)
    least, have = key, 1
    while have < span:
        step = min(have, span - have)
        least = np.minimum(least[:-step], least[step:])
        have += step
    last = np.repeat(cut[1:], np.diff(cut))[: len(least)] - span
    at = (least[np.arange(len(least)) <= last] & _PLACE).astype(np.int64)
    return at[np.r_[True, at[1:] != at[:-1]]] if len(at) else at


def nodes(hashes: np.ndarray, cut: np.ndarray, span: int = SPAN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(least place, first, last) of the Cartesian trees' nodes of ``span`` places or more; text i holds places cut[i] to cut[i + 1]."""
    key = hashes & ~_PLACE | np.arange(len(hashes), dtype=np.uint64)
    at = least_places(key, cut, span)
    # what bounds a node on either side is itself least in a window of that size, so the rest needn't be looked at
    owner = np.searchsorted(cut, at, "right") - 1
    first, last = cut[owner].copy(), cut[owner + 1] - 1
    fresh = np.r_[True, owner[1:] != owner[:-1], True][: len(at) + 1]
    row = np.arange(len(at))
    left = _smaller(key[at], np.where(fresh[:-1], -1, row - 1))
    right = _smaller(key[at], np.where(fresh[1:], -1, row + 1))
    first[left >= 0] = at[left[left >= 0]] + 1
    last[right >= 0] = at[right[right >= 0]] - 1
    return at, first, last


def _smaller(key: np.ndarray, to: np.ndarray) -> np.ndarray:
    """The next row with a smaller key, -1 if none; ``to`` is the next row, -1 at a text's end, and is altered."""
    open_ = np.flatnonzero(to >= 0)
    while len(open_):
        # what lies up to the row that one points to is larger than that one, so is what lies up to where that row points
        open_ = open_[key[to[open_]] > key[open_]]
        to[open_] = to[to[open_]]
        open_ = open_[to[open_] >= 0]
    return to


class Frequent:
    """A bounded set of shingles; most lookups end at a bitmap."""

    def __init__(self, shingles: np.ndarray):
        self.all = np.sort(shingles)
        self.bits = np.zeros(1 << 22, bool)
        self.bits[self.all & np.uint64((1 << 22) - 1)] = True

    def has(self, grams: np.ndarray) -> np.ndarray:
        out = self.bits[grams & np.uint64((1 << 22) - 1)]
        at = np.flatnonzero(out)
        if len(at):
            out[at] = self.all[np.minimum(np.searchsorted(self.all, grams[at]), len(self.all) - 1)] == grams[at]
        return out


def _shingles(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of all texts and where each text's begin; texts of fewer words have none."""
    w = words(raw, True)
    size = np.maximum(np.diff(w.cut) - WIDTH + 1, 0)
    grams = combined(w.hashes, WIDTH)
    cut = np.r_[0, np.cumsum(size)]
    place = np.arange(cut[-1]) + np.repeat(w.cut[:-1] - cut[:-1], size)
    return grams[place], cut


def _around(grams: np.ndarray, cut: np.ndarray):
    """Function from places to the first place of their text and a hash of the shingles around them."""
    up, down = powers(len(grams) + 1)
    sums = np.r_[np.uint64(0), np.cumsum(mix(grams, 50) * up[: len(grams)])]

    def of(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        text = np.searchsorted(cut, at, "right") - 1
        lo, hi = np.maximum(at - SPAN + 1, cut[text]), np.minimum(at + SPAN, cut[text + 1])
        return text, mix((sums[hi] - sums[lo]) * down[lo] + (at - lo).astype(np.uint64), 51).view(np.int64)

    return of


def windows(raw: list[bytes], frequent: Frequent) -> pd.DataFrame:
    """key, around, text, at, first and last of all compact windows."""
    grams, cut = _shingles(raw)
    around, late = _around(grams, cut), frequent.has(grams)
    parity = np.r_[np.uint64(0), np.bitwise_xor.accumulate(np.uint64(1) << (mix(grams, 55) >> np.uint64(58)))]
    out = []
    for k in range(HASHES):
        h = mix(grams, 60 + k)
        at, first, last = nodes(np.where(late, h | _LAST, h & ~_LAST), cut)
        text, near = around(at)
        base = cut[text]
        left = parity[at] ^ parity[np.maximum(at - SIDE, base)]
        right = parity[np.minimum(at + 1 + SIDE, cut[text + 1])] ^ parity[at + 1]
        places = {"at": at - base, "first": first - base, "last": last - base}
        out.append(pd.DataFrame({"kind": k, "key": h[at].view(np.int64), "around": near, "text": text, **places, "left": left.view(np.int64), "right": right.view(np.int64)}))
    return pd.concat(out, ignore_index=True)


def _both(key: np.ndarray, around: np.ndarray) -> np.ndarray:
    """One hash of a shingle and its surroundings."""
    return mix(key.view(np.uint64) ^ mix(around.view(np.uint64)))


def _counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """How many windows of different surroundings a shingle is least in; copies in other parts count again."""
    for pdf in batches:
        for raw in byte_parts(pdf["text"]):
            grams, cut = _shingles(raw)
            around, found = _around(grams, cut), []
            for k in range(HASHES):
                at = least_places(mix(grams, 60 + k) & ~_LAST & ~_PLACE | np.arange(len(grams), dtype=np.uint64), cut, SPAN)
                found.append((grams[at], around(at)[1]))
            key, near = (np.concatenate(x) for x in zip(*found, strict=True))
            one = np.unique(_both(key, near), return_index=True)[1]
            key, n = np.unique(key[one].view(np.int64), return_counts=True)
            yield pd.DataFrame({"key": key, "n": n})


#: A window's kind is the number of its function, or this once an earlier one is known to have equal surroundings.
GONE = -1
#: Kind of a window's row that is kept for the second round.
OPEN = -2
#: What a row of the first round holds of a window besides its place; only those of kind OPEN have it.
_SHAPE = ("key", "first", "last", "left", "right")


def _repeated(ordered: np.ndarray) -> np.ndarray:
    """For each of an ordered array whether a neighbour is equal."""
    out, same = np.zeros(len(ordered), bool), ordered[1:] == ordered[:-1]
    out[1:] |= same
    out[:-1] |= same
    return out


def _together(df: pd.DataFrame) -> pd.DataFrame:
    """Windows by key and surroundings, one of each, the earliest; the others as GONE, for the first function only.

    Every ``SPAN`` places of a copied stretch have a window of the first function, so those cover it.
    """
    key, around, kind = (df[c].to_numpy() for c in ("key", "around", "kind"))
    both = _both(key, around)
    by = np.argsort(both)
    by = by[_repeated(both[by])]  # most are alone
    key, around, ids, at = (df[c].to_numpy()[by] for c in ("key", "around", "id", "at"))
    order = np.lexsort([at, ids, around, key])
    by, key, around, ids, at = by[order], key[order], around[order], ids[order], at[order]
    fresh = np.ones(len(by), bool)
    fresh[1:] = (key[1:] != key[:-1]) | (around[1:] != around[:-1])
    first = np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
    stays, kinds = np.ones(len(df), bool), kind.copy()
    stays[by] = fresh | ((kind[by] == 0) & ((ids != ids[first]) | (at != at[first])))
    kinds[by[~fresh]] = GONE
    return df.assign(kind=kinds)[stays]


#: Rows of Arrow batches that are made one table of pandas, as each conversion has its price.
GATHERED = 50_000


def _in_arrow(run, columns: dict[str, pa.DataType | str]):
    """``run`` over tables for mapInArrow: batches go in together; columns name a type or the column that goes in with the same one."""

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= GATHERED:
                yield pa.Table.from_batches(held).to_pandas()
                held, size = [], 0
        if size:
            yield pa.Table.from_batches(held).to_pandas()

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is None:
            return
        schema = pa.schema([(c, first.schema.field(t).type if isinstance(t, str) else t) for c, t in columns.items()])
        for df in run(gathered(chain([first], batches))):
            yield pa.RecordBatch.from_pandas(df[schema.names], schema=schema, preserve_index=False)

    return whole


_PAIR = {"id": "id", "at": pa.int32(), "b": "id", "b_at": pa.int32()}
_MET = {"kind": pa.int32(), **_PAIR, "key": pa.int64(), "first": pa.int32(), "last": pa.int32(), "left": pa.int64(), "right": pa.int64()}


def _slices(df: pd.DataFrame, most: int = 200_000) -> Iterator[pd.DataFrame]:
    for i in range(0, len(df), most):
        yield df[i : i + most]


def _windows(frequent):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, size = [], 0
        for pdf in batches:
            at, ids = 0, pdf["id"].to_numpy()
            for raw in byte_parts(pdf["text"]):
                w = windows(raw, frequent.value)
                w["id"] = ids[at + w.pop("text").to_numpy(dtype=np.int64)]
                rows.append(w)
                at += len(raw)
                size += len(w)
                if size > TOGETHER:
                    yield from _slices(_together(pd.concat(rows)))
                    rows, size = [], 0
        if rows:
            yield from _slices(_together(pd.concat(rows)))

    return run


def _firsts(*keys: np.ndarray) -> np.ndarray:
    """For each row the first one with its keys."""
    by = np.lexsort(keys)  # stable
    fresh = np.ones(len(by), bool)
    fresh[1:] = np.any([k[by][1:] != k[by][:-1] for k in keys], axis=0)
    out = np.empty(len(by), np.int64)
    out[by] = by[np.flatnonzero(fresh)[np.cumsum(fresh) - 1]]
    return out


def _laid(at: np.ndarray, first: np.ndarray, last: np.ndarray, ids: np.ndarray, left: np.ndarray, right: np.ndarray):
    """Function from rows i and j to whether the windows leave room for a passage, and how they differ on either side."""

    def of(i, j) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        # laid over each other at the shared shingle; a quarter more for words put in
        room = np.minimum(at[i] - first[i], at[j] - first[j]) + np.minimum(last[i] - at[i], last[j] - at[j])
        apart = (ids[i] != ids[j]) | (at[i] - at[j] >= MIN_WORDS)
        return (room * 5 + 4 >= SPAN * 4) & apart, np.bitwise_count(left[i] ^ left[j]), np.bitwise_count(right[i] ^ right[j])

    return of


def _by_key(chunk: int):
    """(kind, id, at, b, b_at, shape): copies as GONE, windows with an earlier one to compare, and as OPEN all of a key with three or more.

    Rows come in order of key and place. Of a key with more than ``chunk`` windows a part at a time is looked at, beside its first one.
    """
    none = dict.fromkeys(_SHAPE, 0)

    def copies(df: pd.DataFrame) -> pd.DataFrame:
        return df[["kind", "id", "at"]].assign(b=df["id"], b_at=-1, **none)

    def found(df: pd.DataFrame, before: pd.DataFrame | None) -> Iterator[pd.DataFrame]:
        gone = df["kind"] == GONE
        yield from _slices(copies(df[gone]))
        df = df[~gone]
        if before is None:
            df = df[_repeated(df["key"].to_numpy())]
        if df.empty:
            return
        # rows are in order of place, so the first of equal surroundings is the earliest
        first_of = _firsts(df["around"].to_numpy(), df["key"].to_numpy())
        gone = first_of != np.arange(len(df))
        elsewhere = (df["id"].to_numpy() != df["id"].to_numpy()[first_of]) | (df["at"].to_numpy() != df["at"].to_numpy()[first_of])
        yield from _slices(copies(df[gone & elsewhere & (df["kind"] == 0).to_numpy()].assign(kind=GONE)))
        df = df[~gone]
        if before is not None:  # the key's first one of all, which orders before these
            df = pd.concat([before, df], ignore_index=True)
        key, ids, at, first, last, left, right = (df[c].to_numpy() for c in ("key", "id", "at", "first", "last", "left", "right"))
        laid = _laid(at, first, last, ids, left, right)
        for other in (_firsts(key), _firsts(left, key), _firsts(right, key)):
            i = np.flatnonzero(other != np.arange(len(other)))
            j = other[i]
            room, on_left, on_right = laid(i, j)
            fits = room & (np.minimum(on_left, on_right) <= SIDE_BITS)
            i, j = i[fits], j[fits]
            yield from _slices(pd.DataFrame({"kind": 0, "id": ids[i], "at": at[i], "b": ids[j], "b_at": at[j], **none}))
        fresh = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        size = np.diff(np.r_[fresh, len(key)])
        more = np.repeat(size > 2, size) | (before is not None)
        if before is not None:
            more[0] = False
        shape = dict(zip(_SHAPE, (x[more] for x in (key, first, last, left, right)), strict=True))
        yield from _slices(pd.DataFrame({"kind": OPEN, "id": ids[more], "at": at[more], "b": ids[more], "b_at": at[more], **shape}))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        size, before = 0, None

        def whole(df: pd.DataFrame) -> Iterator[pd.DataFrame]:
            nonlocal before
            if before is not None:  # the rest of a key that was looked at in part
                more = int((df["key"] == before["key"].iloc[0]).sum())
                if more:
                    yield from found(df[:more], before)
                    df = df[more:]
                before = None
            if len(df):
                yield from found(df, None)

        for pdf in batches:
            if (pdf["kind"] == GONE).all():
                yield copies(pdf)
                continue
            held.append(pdf)
            size += len(pdf)
            if size < chunk:
                continue
            df = pd.concat(held, ignore_index=True)
            begin = int((df["key"] == df["key"].iloc[-1]).to_numpy().argmax())
            if begin:
                yield from whole(df[:begin])
                df = df[begin:]
            if len(df) >= chunk:
                if before is not None and before["key"].iloc[0] != df["key"].iloc[0]:
                    before = None
                yield from found(df, before)
                windows_ = df[df["kind"] != GONE][:1]
                before = windows_ if before is None and len(windows_) else before
                df = df[:0]
            held, size = [df], len(df)
        if size:
            yield from whole(pd.concat(held, ignore_index=True))

    return run


#: Units of up to so many windows are laid beside each other together.
SMALL = 64


def _whole_units(look, chunk: int):
    """``look`` over rows in order of unit and place, some units at a time, each whole."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        size = 0
        for pdf in batches:
            held.append(pdf)
            size += len(pdf)
            if size < chunk:
                continue
            df = pd.concat(held, ignore_index=True)
            begin = int((df["unit"] == df["unit"].iloc[-1]).to_numpy().argmax())
            if begin:
                yield from look(df[:begin])
            held, size = [df[begin:]], len(df) - begin
        if size:
            yield from look(pd.concat(held, ignore_index=True))

    return run


def _edges(df: pd.DataFrame) -> np.ndarray:
    """Where units begin, and the end."""
    unit = df["unit"].to_numpy()
    return np.flatnonzero(np.r_[True, unit[1:] != unit[:-1], True])


def _nearest(nearest: int):
    """(id, at, b, b_at): windows asked for of a unit (blocks of a key) with the earlier ones that differ least on the left and on the right.

    A window that more of them fit on a side is given beside itself too.
    """

    def small(df: pd.DataFrame) -> Iterator[pd.DataFrame]:
        """Of many small units: each row beside the one d places before it, for all d."""
        ids, at, first, last, left, right = (df[c].to_numpy() for c in ("id", "at", "first", "last", "left", "right"))
        there, edges = df["there"].to_numpy(), _edges(df)
        rank = np.arange(len(df)) - np.repeat(edges[:-1], np.diff(edges))
        laid, found, own = _laid(at, first, last, ids, left, right), [], np.flatnonzero(df["asked"].to_numpy())
        for d in range(1, SMALL):
            own = own[rank[own] >= d]
            i = own[there[own - d]]
            if not len(i):
                continue
            room, *sides = laid(i, i - d)
            for side, bits in enumerate(sides):
                fits = room & (bits <= SIDE_BITS)
                found.append(np.c_[i[fits], np.full(fits.sum(), side), bits[fits], i[fits] - d])
        if not found:
            return
        i, side, bits, j = np.concatenate(found).T
        by = np.lexsort([j, bits, side, i])
        i, side, j = i[by], side[by], j[by]
        fresh = np.r_[True, (i[1:] != i[:-1]) | (side[1:] != side[:-1])] if len(i) else np.empty(0, bool)
        place = np.arange(len(i)) - np.maximum.accumulate(np.where(fresh, np.arange(len(i)), 0))
        j = np.where(place < nearest, j, i)
        i, j = i[place <= nearest], j[place <= nearest]
        yield pd.DataFrame({"id": ids[i], "at": at[i], "b": ids[j], "b_at": at[j]})

    def large(df: pd.DataFrame) -> Iterator[pd.DataFrame]:
        ids, at, first, last, left, right = (df[c].to_numpy() for c in ("id", "at", "first", "last", "left", "right"))
        laid = _laid(at, first, last, ids, left, right)
        there, here = np.flatnonzero(df["there"].to_numpy()), np.flatnonzero(df["asked"].to_numpy())
        if not len(there):
            return
        for k in range(0, len(here), 256):
            i = here[k : k + 256]
            room, *sides = laid(i[:, None], there[None, :])
            for bits in sides:
                bits = np.where(room & (there < i[:, None]) & (bits <= SIDE_BITS), bits, 255).astype(np.uint8)
                for _ in range(nearest):
                    j = bits.argmin(1)  # the earliest of equal ones
                    rows = np.flatnonzero(bits[np.arange(len(i)), j] < 255)
                    if not len(rows):
                        break
                    a, b = i[rows], there[j[rows]]
                    yield pd.DataFrame({"id": ids[a], "at": at[a], "b": ids[b], "b_at": at[b]})
                    bits[np.arange(len(i)), j] = 255
                a = i[(bits < 255).any(1)]
                yield pd.DataFrame({"id": ids[a], "at": at[a], "b": ids[a], "b_at": at[a]})

    def units(df: pd.DataFrame) -> Iterator[pd.DataFrame]:
        edges = _edges(df)
        size = np.diff(edges)
        few = np.repeat(size <= SMALL, size)
        if few.any():
            yield from small(df[few])
        for k in np.flatnonzero(size > SMALL):
            yield from large(df[edges[k] : edges[k + 1]])

    return units


def _coded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Windows of texts with the codes of the shingles inside them, AROUND places about their own; 0 is none.

    A row has a text and its windows, an array for each of their columns.
    """
    about, wide = np.arange(1 - SPAN, SPAN), 2 * AROUND
    for pdf in batches:
        done = 0
        for raw in byte_parts(pdf["text"]):
            grams, cut = _shingles(raw)
            code = np.maximum(mix(grams, 57) >> np.uint64(48), 1).astype("<u2")
            part = pdf[done : done + len(raw)]
            done += len(raw)
            count = part["at"].map(len).to_numpy()
            rows = pd.DataFrame({c: np.concatenate(part[c].to_list()) for c in ("at", *_SHAPE, "open")})
            rows["id"], text = np.repeat(part["id"].to_numpy(), count), np.repeat(np.arange(len(raw)), count)
            own = rows["at"].to_numpy() < np.diff(cut)[text]  # the others are of another text of this id
            rows, text = rows[own], text[own]
            for i in range(0, len(rows), 20_000):
                some, base = rows[i : i + 20_000], cut[text[i : i + 20_000], None]
                place = some["at"].to_numpy()[:, None] + about
                inside = (place >= some["first"].to_numpy()[:, None]) & (place <= some["last"].to_numpy()[:, None])
                near = np.where(inside, code[np.clip(place + base, 0, len(code) - 1)], 0).astype("<u2").tobytes()
                yield some.assign(codes=[near[k : k + wide] for k in range(0, len(near), wide)])


def _closest(df: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """(id, at, b, b_at): windows asked for of a unit with the earlier ones that share most codes of a passage of least length.

    And with those that share enough of the first such passage and of the last one.
    """
    ids, at, first, last, left, right, asked, there = (df[c].to_numpy() for c in ("id", "at", "first", "last", "left", "right", "asked", "there"))
    codes = np.frombuffer(b"".join(df["codes"]), "<u2").reshape(-1, AROUND)
    laid, edges, found = _laid(at, first, last, ids, left, right), _edges(df), []
    where = np.zeros(1 << 16, np.int64)
    for lo, hi in zip(edges[:-1], edges[1:], strict=True):
        sources = lo + np.flatnonzero(there[lo:hi])
        for i in lo + np.flatnonzero(asked[lo:hi]):
            j = sources[: np.searchsorted(sources, i)]
            room, *sides = laid(i, j)
            j = j[room & (np.minimum(*sides) <= SIDE_BITS)]
            own, back = np.unique(codes[i], return_inverse=True)
            where[own] = np.arange(1, len(own) + 1)
            where[0] = 0
            best: list[tuple] = []  # what to have least, and the row
            for k in range(0, len(j), 4096):
                some = j[k : k + 4096]
                hit = np.zeros((len(some), len(own) + 1), bool)
                hit[np.arange(len(some))[:, None], where[codes[some]]] = True
                hit[:, 0] = False
                total = np.cumsum(np.c_[np.zeros(len(some), np.int64), hit[:, back + 1]], axis=1)
                common = total[:, SPAN:] - total[:, :-SPAN]
                most, enough = common.max(1), common >= ALIKE
                n = int(most.argmax())
                here = [(-int(most[n]), some[n])] if most[n] >= PARTLY else [(1, -1)]
                rows = np.flatnonzero(enough.any(1))
                if len(rows):
                    begin, end = enough[rows].argmax(1), -enough[rows, ::-1].argmax(1)
                    here += [(int(begin.min()), some[rows[begin.argmin()]]), (int(-end.max()), some[rows[end.argmax()]])]
                else:
                    here += [(SPAN, -1)] * 2
                best = [min(x, y, key=lambda t: t[0]) for x, y in zip(best, here, strict=True)] if best else here
            where[own] = 0
            found += [(i, x) for x in {int(x) for _, x in best if x >= 0}]
    i, j = np.array(found, np.int64).reshape(-1, 2).T
    yield pd.DataFrame({"id": ids[i], "at": at[i], "b": ids[j], "b_at": at[j]})


def _reach(total: np.ndarray, start: int, step: int, most: int) -> int:
    """How many places from start on, to the right or left, to take so that the gain is most; the search ends when it has fallen by ``most``.

    total holds running sums of the gain of each place.
    """
    best, reach, size, done, n = 0, 0, 128, 0, len(total) - 1
    while True:
        if step > 0:
            part = total[start + done + 1 : start + done + 1 + size] - total[start]
        else:
            part = total[start] - total[max(0, start - done - size) : max(0, start - done)][::-1]
        if not len(part):
            return reach
        top = np.maximum.accumulate(np.maximum(part, best))
        fell = top - part > most
        end = int(fell.argmax())
        ended = bool(fell[end])
        high = int(top[end if ended else -1])
        if high > best:
            best, reach = high, done + int(top.searchsorted(high)) + 1
        if ended:
            return reach
        done += size
        size = min(2 * size, n)


#: What a shingle that isn't shared costs, in shared ones: first as in sets four fifths alike, then more strictly.
_COSTS = (4, 8)


def _sums(flags: np.ndarray) -> np.ndarray:
    out = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=out[1:])
    return out


class Marks:
    """Sets of numbers below n, compared by marks at their places instead of sorts."""

    def __init__(self, n: int):
        self.marks, self.rows = np.zeros(n, bool), np.zeros(n, np.int64)

    def among(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For each of a whether b holds it."""
        self.marks[b] = True
        out = self.marks[a]
        self.marks[b] = False
        return out

    def firsts(self, a: np.ndarray) -> np.ndarray:
        """One row of a for each of its numbers, as flags."""
        row = np.arange(len(a))
        self.rows[a] = row
        return self.rows[a] == row

    def alike(self, a: np.ndarray, b: np.ndarray) -> bool:
        """Whether the sets of a and b have the similarity."""
        one = self.firsts(a)
        common = int(np.count_nonzero(self.among(a, b) & one))
        return 100 * common >= PERCENT * (int(np.count_nonzero(one)) + int(np.count_nonzero(self.firsts(b))) - common)


def passages(a: np.ndarray, b: np.ndarray, anchors: np.ndarray, marks: Marks, shift: int = 0) -> list[tuple[int, int]]:
    """First and last shingle in a of passages near-equal to one in b around the anchors, rows of (place in a, place in b).

    a and b hold the shingles' numbers, which ``marks`` has places for.
    """
    n_b, n_a = _sums(marks.among(a, b)), _sums(marks.among(b, a))
    places = anchors[np.lexsort(anchors.T[::-1])]

    def near(n: np.ndarray, at: np.ndarray) -> np.ndarray:
        return n[np.minimum(at + SPAN, len(n) - 1)] - n[np.maximum(at - SPAN, 0)]

    # most places share little but the one shingle
    places = places[(near(n_b, places[:, 0]) >= SPAN * 4 // 9) & (near(n_a, places[:, 1]) >= SPAN * 4 // 9)]
    gains: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def grown(p: int, q: int) -> Iterator[tuple[tuple[int, int], tuple[int, int]]]:
        for c in _COSTS:
            if c not in gains:
                gains[c] = (1 + c) * n_b - c * np.arange(len(n_b)), (1 + c) * n_a - c * np.arange(len(n_a))
            (gain_a, gain_b), most = gains[c], c * SPAN
            lo, hi = p - _reach(gain_a, p, -1, most), p + _reach(gain_a, p + 1, 1, most)
            lo_b, hi_b = q - _reach(gain_b, q, -1, most), q + _reach(gain_b, q + 1, 1, most)
            yield (lo, hi), (lo_b, hi_b)
            # a text that repeats itself grows further than the other: take as much of both
            yield (max(lo, p - (q - lo_b)), min(hi, p + (hi_b - q))), (max(lo_b, q - (p - lo)), min(hi_b, q + (hi - p)))

    def least(p: int, q: int, lo: int, hi: int) -> Iterator[tuple[tuple[int, int], tuple[int, int]]]:
        """The passage of SPAN shingles that touches lo to hi and shares most with what lies beside it in b."""
        s = np.arange(max(0, lo - SPAN + 1), min(hi, len(a) - SPAN) + 1)
        if len(s):
            t, u = np.clip(s - p + q, 0, len(b)), np.clip(s - p + q + SPAN, 0, len(b))
            i = int((n_b[s + SPAN] - n_b[s] + n_a[u] - n_a[t]).argmax())
            yield (int(s[i]), int(s[i]) + SPAN - 1), (int(t[i]), int(u[i]) - 1)

    def matches(x: tuple[int, int], y: tuple[int, int]) -> bool:
        if x[1] - x[0] + 1 < SPAN or y[1] - y[0] + 1 < SPAN * PERCENT // 100:
            return False
        return marks.alike(a[x[0] : x[1] + 1], b[y[0] : y[1] + 1])

    out: list[tuple[int, int]] = []
    failed: list[tuple[int, int, int, int]] = []
    for p, q in places.tolist():
        if any(lo <= p <= hi for lo, hi in out) or any(lo <= p <= hi and lo_b <= q <= hi_b for lo, hi, lo_b, hi_b in failed[-8:]):
            continue
        for x, y in grown(p, q):
            if matches(x, y):
                out.append(x)
                break
        else:
            strict = (*x, *y)  # its other places would grow alike
            more = [x for x, y in least(p, q, *x) if matches(x, y)]
            if more:
                out += more
            else:
                failed.append(strict)
    return [(lo + shift, hi + shift) for lo, hi in out]


def _verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for i in range(0, len(pdf), 256):
            part = pdf[i : i + 256]
            texts = list(dict.fromkeys([*part["x"], *part["y"]]))
            found = [_shingles(raw) for raw in byte_parts(texts)]
            # shingles by number, so that sets of them are compared without sorting
            number, every = pd.factorize(np.concatenate([grams for grams, _ in found]))
            marks = Marks(len(every))
            size = np.concatenate([np.diff(cut) for _, cut in found])
            sets = dict(zip(texts, np.split(number, np.cumsum(size)[:-1]), strict=True))
            rows = []
            for a, b, x, y, at, b_at in zip(part["a"], part["b"], part["x"], part["y"], part["at"], part["b_at"], strict=True):
                u, v, pairs = sets[x], sets[y], np.array([at, b_at], np.int64).T
                pairs = pairs[(pairs[:, 0] < len(u)) & (pairs[:, 1] < len(v))]
                if a != b:
                    rows += [(a, *s) for s in passages(u, v, pairs, marks)]
                else:  # a text against what of it lies before the middle of the two places
                    for p, q in pairs.tolist():
                        half = (p + q + 1) // 2
                        rows += [(a, *s) for s in passages(u[half:], u[: max(0, half - WIDTH + 1)], np.array([[p - half, q]]), marks, half)] if q < half - WIDTH + 1 else []
            yield pd.DataFrame(rows, columns=["id", "first", "last"])


def _outside(windows_: DataFrame, spans: DataFrame, *names: str) -> DataFrame:
    """The columns of windows, and ``open``, whether a window's place is outside all spans of its text."""
    kinds = {f.name: f.dataType for f in windows_.schema}
    ends = spans.select("id", F.col("first").cast("int").alias("at"), F.col("last").cast("int").alias("_end"), *(F.lit(None).cast(kinds[c]).alias(c) for c in names))
    both = windows_.select("id", "at", F.lit(None).cast("int").alias("_end"), *names).unionByName(ends)
    # in order of place, spans before windows, a window is inside if an end so far lies at its place or behind
    w = Window.partitionBy("id").orderBy("at", F.col("_end").isNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    far = both.withColumn("_far", F.max("_end").over(w)).where("_end IS NULL")
    return far.select("id", "at", *names, F.coalesce(F.col("_far") < F.col("at"), F.lit(True)).alias("open"))


def _dealt(marked: DataFrame, scratch: Scratch, name: str, *more: str) -> DataFrame:
    """Rows of keys with an open window in units: all of a key, or where it has many a block of open ones beside a block of all."""
    sizes = marked.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("there"), F.ceil(F.count_if("open") / BLOCK).alias("here")).where("here > 0")
    rows = marked.join(scratch.keep(sizes, name), "key")
    own = F.xxhash64("id", "at")
    last_of = lambda c: F.sequence(F.lit(0).cast("long"), F.col(c) - 1)
    one, none, yes, no = (F.col("there") == 1) & (F.col("here") == 1), F.lit(0).cast("long"), F.lit(True), F.lit(False)

    def unit(a, b, asked, source):
        return F.struct(F.xxhash64("key", a, b).alias("unit"), asked.alias("asked"), source.alias("there"))

    there = F.transform(last_of("here"), lambda k: unit(k, F.pmod(own, "there"), no, yes))
    here = F.transform(last_of("there"), lambda k: unit(F.pmod(own, "here"), k, yes, no))
    units = F.when(one, F.array(unit(none, none, F.col("open"), yes))).when(F.col("open"), F.concat(there, here)).otherwise(there)
    shape = ("id", "at", "first", "last", "left", "right", *more)
    dealt = rows.select(F.explode(units).alias("_unit"), *shape).select("_unit.unit", "_unit.asked", "_unit.there", *shape)
    return dealt.repartition("unit").sortWithinPartitions("unit", "id", "at")


def _rest(marked: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, at, b, b_at): open windows with the least different earlier ones of their key, and beside themselves where more fit."""
    kind = marked.schema["id"].dataType.simpleString()
    near = _dealt(marked, scratch, "sizes").mapInArrow(tidied(_in_arrow(_whole_units(_nearest(NEAREST), CHUNK), _PAIR)), f"id {kind}, at int, b {kind}, b_at int")
    return scratch.keep(near.distinct(), "near")


#: A row of ``_rest`` that names a crowded window.
_SELF = "id = b AND at = b_at"


def _crowds(docs: DataFrame, marked: DataFrame, crowded: DataFrame, scratch: Scratch) -> DataFrame | None:
    """(id, at, b, b_at): crowded windows (id, at) with those of their key whose codes are alike; None if there are none."""
    kind = marked.schema["id"].dataType.simpleString()
    crowded = scratch.keep(crowded, "crowded")
    if not crowded.take(1):
        return None
    asked = marked.join(crowded.withColumn("asked", F.lit(True)), ["id", "at"], "left").withColumn("open", F.col("open") & F.coalesce("asked", F.lit(False)))
    keys = asked.where("open").select("key").distinct()
    shapes = asked.join(keys, "key", "left_semi").groupBy("id").agg(F.collect_list(F.struct("at", *_SHAPE, "open")).alias("windows"))
    row = f"id {kind}, at int, key long, first int, last int, left long, right long, open boolean, codes binary"
    shapes = scratch.keep(shapes, "shapes")
    texts = join_sized(docs, shapes.select("id"), "id", "left_semi", 32)  # few texts have one
    coded = texts.join(shapes.hint("merge"), "id").select("id", "text", *(F.col(f"windows.{c}").alias(c) for c in ("at", *_SHAPE, "open"))).mapInPandas(tidied(_coded), row)
    coded = scratch.keep(coded, "coded")
    scratch.drop("shapes")
    dealt = _dealt(coded, scratch, "crowds", "codes")
    return dealt.mapInPandas(tidied(_whole_units(_closest, CHUNK)), f"id {kind}, at int, b {kind}, b_at int").distinct()


def _found(docs: DataFrame, places: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(id, first, last): passages around pairs of places that are near-equal to one of b."""
    kind = docs.schema["id"].dataType.simpleString()
    pairs = places.groupBy(F.col("id").alias("a"), "b").agg(F.collect_set(F.struct("at", "b_at")).alias("anchors"))
    pairs = scratch.keep(pairs, f"{name}-pairs")
    ids = scratch.keep(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), f"{name}-ids")
    texts = join_sized(docs, ids, "id", "left_semi", 32)
    x, y = texts.select(F.col("id").alias("a"), F.col("text").alias("x")), texts.select(F.col("id").alias("b"), F.col("text").alias("y"))
    joined = pairs.join(x.hint("merge"), "a").join(y.hint("merge"), "b").select("a", "b", "x", "y", "anchors.at", "anchors.b_at")
    found = joined.mapInPandas(tidied(_verify), f"id {kind}, first int, last int").distinct()
    found = scratch.keep(found, f"{name}-found")
    scratch.drop(f"{name}-pairs", f"{name}-ids")
    return found


def later_passages(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, first, last): shingles of passages that have an earlier near-equal one; docs is (id, text)."""
    spark, kind = docs.sparkSession, docs.schema["id"].dataType.simpleString()
    counted = docs.mapInPandas(tidied(_counts), "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") > FREQUENT)
    counted = scratch.keep(counted, "counted")
    hot = np.array(most_frequent(counted, "key", MAX_FREQUENT), np.int64)
    frequent = spark.sparkContext.broadcast(Frequent(hot.view(np.uint64)))
    row = f"kind int, key long, around long, at int, first int, last int, left long, right long, id {kind}"
    made = docs.mapInPandas(tidied(_windows(frequent)), row)
    spread = made.repartition(F.when(F.col("kind") == GONE, F.xxhash64("id", "at")).otherwise(F.col("key"))).sortWithinPartitions("key", "id", "at")
    met = f"kind int, id {kind}, at int, b {kind}, b_at int, key long, first int, last int, left long, right long"
    met = scratch.keep(spread.mapInArrow(tidied(_in_arrow(_by_key(CHUNK), _MET)), met), "met")
    copies = met.where(F.col("kind") == GONE).select("id", F.greatest(F.lit(0), F.col("at") - SPAN + 1).alias("first"), (F.col("at") + SPAN - 1).alias("last"))
    firsts = met.where(F.col("kind") == 0).select("id", "at", "b", "b_at")
    found = _found(docs, firsts, scratch, "firsts")
    spans = copies.unionByName(found)
    marked = scratch.keep(_outside(met.where(F.col("kind") == OPEN), spans, *_SHAPE), "marked")
    near = _rest(marked, scratch)
    rest = _found(docs, near.where(f"NOT ({_SELF})").join(firsts, ["id", "at", "b", "b_at"], "left_anti"), scratch, "rest")
    crowded = _outside(near.where(_SELF).select("id", "at"), rest).where("open").select("id", "at")
    close = _crowds(docs, marked, crowded, scratch)
    if close is None:
        return spans.unionByName(rest)
    close = close.join(near, ["id", "at", "b", "b_at"], "left_anti").join(firsts, ["id", "at", "b", "b_at"], "left_anti")
    return spans.unionByName(rest).unionByName(_found(docs, close, scratch, "close"))


def _strip(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for texts, spans in batches:
        rows = []
        for text, own in zip(texts, spans, strict=True):
            if own is None:
                rows.append((None, 0, 0))
                continue
            raw = text.encode()
            w = words([raw], False)
            n = len(w.begin)
            depth = np.zeros(n + 1, np.int64)
            np.add.at(depth, np.minimum([s["first"] for s in own], n), 1)
            np.add.at(depth, np.minimum([s["last"] + WIDTH for s in own], n), -1)
            gone = np.r_[False, np.cumsum(depth)[:-1] > 0, False]
            start, stop = np.flatnonzero(gone[1:] & ~gone[:-1]), np.flatnonzero(gone[:-1] & ~gone[1:])
            kept, at = [], 0
            for s, e in zip(start.tolist(), stop.tolist(), strict=True):
                kept.append(raw[at : w.begin[s]])
                at = int(w.begin[e]) if e < n else len(raw)
            rows.append((b"".join([*kept, raw[at:]]).decode(), int(gone.sum()), len(start)))
        yield pd.DataFrame(rows, columns=["kept", "n_removed", "n_spans"])


def remove_passages(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """docs with shortened texts, n_removed (words) and n_spans (runs of removed words)."""
    scratch = Scratch(docs.sparkSession)
    docs = docs.drop("n_removed", "n_spans")
    own_id, own_spans, own_cut = free(docs, "_id", "_spans", "_cut")
    judged = docs.where(F.col(id_col).isNotNull() & F.col(text).isNotNull()).select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    spans = later_passages(judged, scratch).groupBy(F.col("id").alias(own_id)).agg(F.collect_list(F.struct("first", "last")).alias(own_spans))
    spans = scratch.last(spans, "spans")
    out = docs.join(spans.hint("merge"), F.col(id_col) == F.col(own_id), "left")
    some = F.col(own_spans).isNotNull() & F.col(text).isNotNull()
    strip = F.pandas_udf(_strip, "kept string, n_removed long, n_spans long")
    out = out.withColumn(own_cut, strip(F.when(some, F.col(text)), F.when(some, F.col(own_spans))))
    cut = F.col(own_cut)
    out = out.withColumns({text: F.coalesce(cut["kept"], F.col(text)), "n_removed": cut["n_removed"], "n_spans": cut["n_spans"]})
    return out.select(*docs.columns, "n_removed", "n_spans")
