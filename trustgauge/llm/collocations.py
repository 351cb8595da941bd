"""Phrase collocations: sketch upper bounds, delimiter-guarded automata, exact counts and cut scores.

1. Three passes over the texts build count-min sketches of words, of word pairs and of longer phrases. A phrase enters
   a pass only if the sketches before it leave room for its parts. A sketch's counters stop at ``least``: what matters is
   whether an upper bound reaches it, so a finished sketch is a bit a cell.
2. Phrases whose bounds all reach ``least`` are gathered as texts (so a hash never decides equality), with their words.
3. They are compiled into Aho-Corasick automata, one a language, with a space before and behind each phrase and a single
   space between words of a text, so overlapping matches share their guards. Tasks count matches of their texts and send
   counts in blocks of terms; sums are exact. Phrases beyond ``PART_CHARACTERS`` make further automata, parted by the hash of the first
   word. Then the texts are read once more, not once an automaton: a word goes, with the words behind it as far as the sketches leave
   room for a phrase, to the automaton of its own part, so a stretch of text is scanned for what can begin in it.
4. Thresholds, cut scores, contained phrases and ranks are DataFrame work over the counted phrases.

Sketch cells follow the bytes of the texts up to ``MOST_BITS``; beyond that bounds get looser and more phrases are
counted, with the same result.

Defined results: a null or empty text has no words; a null language is ``und``, as is the language of that name; repeated
rows count as often as they occur; no rows, or no phrase that is frequent enough, give no rows; other columns are not
looked at. A task holds one text, its word places and hashes at a time: some 60 bytes for each byte of its longest text.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, join_sized, parallelism, tidied

#: Least occurrences of a candidate, its most words, rows returned a language, and the percentage of its occurrences from which a longer candidate covers it.
LEAST, MOST_WORDS, TOP, COVERED_PERCENT = 100, 5, 2000, 100
#: Rows of a sketch; bytes of text a cell; bounds of the cells of a row as powers of two; cells sent together.
DEPTH, BYTES_A_CELL, LEAST_BITS, MOST_BITS, BLOCK_BITS = 2, 64, 16, 26, 16
#: Characters of the phrases of one pass of automata.
PART_CHARACTERS = 4 << 20
#: Terms whose counts are sent together; texts, one in so many, whose phrases are gathered first, and their bytes a task.
TERMS, SIEVE, SIEVE_BYTES = 256, 16, 16 << 20
#: Bytes of text that a task scans for a part of the phrases.
DEALT = 128 << 20
#: Bytes of text handled together, and gathered phrases that a task remembers.
CHUNK, REMEMBERED = 1 << 21, 200_000

_UPPER = bytes(range(65, 91))
#: Byte by byte: A-Z lower-cased, piece delimiters to line feeds, tabs to spaces.
_PLAIN = bytes.maketrans(_UPPER + b".,;:!?\x0b\x0c\r\t", _UPPER.lower() + b"\n" * 9 + b" ")
_ODD = np.random.default_rng(13).integers(1 << 62, size=(MOST_WORDS + DEPTH + 2), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = _ODD[-1]
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


class Chunk:
    """Some texts end to end: where their words are, hashes of these and the piece and language each is in."""

    powers = np.ones(1, np.uint64)
    inverses = np.ones(1, np.uint64)

    def __init__(self, texts: list[bytes], langs: list[str]):
        self.raw, self.langs = b"\n".join(texts).translate(_PLAIN), langs
        a = np.frombuffer(self.raw, np.uint8)
        breaks = a == 10
        edges = np.flatnonzero(np.diff((a != 32) & ~breaks, prepend=False, append=False))
        self.starts, self.ends = edges[::2], edges[1::2]
        self.piece = np.cumsum(breaks, dtype=np.int64)[self.starts] if len(a) else self.starts
        text_ends = np.cumsum([len(t) + 1 for t in texts])
        self.text = np.searchsorted(text_ends, self.starts, "right")
        if len(a) >= len(Chunk.powers):
            for name, base in (("powers", _BASE), ("inverses", _BASE_INVERSE)):
                steps = np.full(len(a) + 1, base, np.uint64)
                steps[0] = 1
                setattr(Chunk, name, np.multiply.accumulate(steps))
        sums = np.zeros(len(a) + 1, np.uint64)
        np.cumsum((a + np.uint64(1)) * Chunk.powers[: len(a)], dtype=np.uint64, out=sums[1:])
        self.words = _mix((sums[self.ends] - sums[self.starts]) * Chunk.inverses[self.starts])
        names = np.array([hash_text(x) for x in langs], np.uint64)
        self.lang = names[self.text]

    @property
    def wide(self) -> np.ndarray:
        """Whether more than a space is behind a word, in its piece."""
        out = np.zeros(len(self.starts), bool)
        out[:-1] = (self.starts[1:] - self.ends[:-1] > 1) & (self.piece[1:] == self.piece[:-1])
        return out

    def named(self) -> tuple[list[str], np.ndarray]:
        """The different languages, and for each word the place of its own among them."""
        names = sorted(set(self.langs))
        place = {name: k for k, name in enumerate(names)}
        return names, np.array([place[x] for x in self.langs], np.int64)[self.text]

    def grams(self, size: int, keep: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """First words, as places, and hashes of the phrases of a size that lie in one piece, of those with ``keep`` at their first word."""
        n = len(self.starts) - size + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        inside = self.piece[:n] == self.piece[size - 1 :]
        at = np.flatnonzero(inside if keep is None else inside & keep[:n])
        h = self.lang[at] + np.uint64(size)
        for k in range(size):
            h += self.words[at + k] * _ODD[k]
        return at, _mix(h)


def hash_text(text: str) -> int:
    """A 64-bit number of a short text that is the same in every process."""
    h = 1469598103934665603
    for b in text.encode():
        h = (h ^ b) * 1099511628211 % (1 << 64)
    return h


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[Chunk]:
    """Batches of (lang, text as bytes), some texts at a time."""
    texts, langs, size = [], [], 0
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            texts.append(text.as_py())
            langs.append(lang)
            size += len(texts[-1])
            if size >= CHUNK:
                yield Chunk(texts, langs)
                texts, langs, size = [], [], 0
    if texts:
        yield Chunk(texts, langs)


class Room:
    """A finished sketch: whether a phrase may occur ``least`` times."""

    def __init__(self, bits: int, rows: list[bytes]):
        self.bits, self.rows = bits, rows

    def of(self, hashes: np.ndarray) -> np.ndarray:
        out = np.ones(len(hashes), bool)
        for r, row in enumerate(self.rows):
            cell, held = cells(hashes, r, self.bits), np.frombuffer(row, np.uint8)
            out &= (held[cell >> 3] >> (cell & 7).astype(np.uint8) & 1).astype(bool)
        return out

    def starting(self, chunk: Chunk, size: int) -> np.ndarray:
        """For each word whether the phrase of a size that begins there has room."""
        out = np.zeros(len(chunk.starts), bool)
        at, hashes = chunk.grams(size)
        out[at] = self.of(hashes)
        return out


def cells(hashes: np.ndarray, row: int, bits: int) -> np.ndarray:
    return ((hashes * _ODD[MOST_WORDS + row]) >> np.uint64(64 - bits)).astype(np.int64)


def _run(starts: np.ndarray, length: int) -> np.ndarray:
    """Places from which ``length`` neighbours hold."""
    out = starts.copy()
    for k in range(1, length):
        out[: len(out) - k] &= starts[k:]
        out[max(0, len(out) - k) :] = False
    return out


def _wanted(chunk: Chunk, rooms: list[Room], most: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(size, places, hashes) of the phrases that the next sketch counts: words, then pairs, then all that are longer."""
    if not rooms:
        yield 1, *chunk.grams(1)
        return
    single = rooms[0].starting(chunk, 1)
    if len(rooms) == 1:
        yield 2, *chunk.grams(2, _run(single, 2))
        return
    pair = _pairs(chunk, rooms)
    for size in range(3, most + 1):
        yield size, *chunk.grams(size, _run(pair, size - 1))


def _pairs(chunk: Chunk, rooms: list[Room]) -> np.ndarray:
    out = np.zeros(len(chunk.starts), bool)
    at, hashes = chunk.grams(2, _run(rooms[0].starting(chunk, 1), 2))
    out[at] = rooms[1].of(hashes)
    return out


def _counting(rooms: list[Room], bits: int, least: int, most: int) -> Callable:
    """Batches of texts to a task's counters, in blocks of cells that are not all zero."""
    kind = np.uint8 if least < 256 else np.uint32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = np.zeros((DEPTH, 1 << bits), kind)
        for chunk in chunks(batches):
            for _, _, hashes in _wanted(chunk, rooms, most):
                for r in range(DEPTH):
                    cell, n = np.unique(cells(hashes, r, bits), return_counts=True)
                    counters[r, cell] = np.minimum(counters[r, cell] + n, least)
        per_row = 1 << max(0, bits - BLOCK_BITS)
        for r in range(DEPTH):
            full = np.flatnonzero(counters[r])
            ends = np.searchsorted(full, np.arange(1, per_row + 1) << BLOCK_BITS)
            slots, places, counts = [], [], []
            for b, (lo, hi) in enumerate(zip(np.r_[0, ends[:-1]], ends, strict=True)):
                if hi > lo:
                    slots.append(r * per_row + b)
                    places.append((full[lo:hi] & ((1 << BLOCK_BITS) - 1)).astype(np.uint16).tobytes())
                    counts.append(counters[r, full[lo:hi]].tobytes())
            for at in range(0, len(slots), 64):
                one = slice(at, at + 64)
                yield pa.record_batch([pa.array(slots[one], pa.int32()), pa.array(places[one], pa.binary()), pa.array(counts[one], pa.binary())], ["slot", "places", "counts"])

    return tidied(run)


def _summing(least: int) -> Callable:
    """Sorted blocks of counters to the bits of those that reach ``least``, one slot at a time."""
    kind = np.uint8 if least < 256 else np.uint32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, np.zeros(1 << BLOCK_BITS, np.int64)

        def done() -> pa.RecordBatch:
            bits = np.packbits(held >= least, bitorder="little").tobytes()
            return pa.record_batch([pa.array([now], pa.int32()), pa.array([bits], pa.binary())], ["slot", "bits"])

        for batch in batches:
            for slot, places, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if slot != now:
                    if now is not None:
                        yield done()
                    now, held = slot, np.zeros(1 << BLOCK_BITS, np.int64)
                held[np.frombuffer(places, np.uint16)] += np.frombuffer(counts, kind)
        if now is not None:
            yield done()

    return run


def sketch(texts: DataFrame, rooms: list[Room], bits: int, least: int, most: int) -> Room:
    """The next sketch after ``rooms``; what comes to the driver is a bit a cell, 2^MOST_BITS a row at most."""
    spark = texts.sparkSession
    counted = texts.mapInArrow(_counting(rooms, bits, least, most), "slot int, places binary, counts binary")
    summed = counted.repartition(parallelism(spark), "slot").sortWithinPartitions("slot").mapInArrow(_summing(least), "slot int, bits binary")
    per_row, size = 1 << max(0, bits - BLOCK_BITS), 1 << (BLOCK_BITS - 3)
    rows = [bytearray(per_row * size) for _ in range(DEPTH)]
    for r in summed.toLocalIterator():
        row, block = divmod(r["slot"], per_row)
        rows[row][block * size : (block + 1) * size] = r["bits"]
    return Room(bits, [bytes(x) for x in rows])


def _gathering(rooms: list[Room], most: int, known) -> Callable:
    """Batches of texts to the different phrases that may occur often enough and are not among the known ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, set[bytes]] = {}
        for chunk in chunks(batches):
            names, lang = chunk.named()
            found: list[set[bytes]] = [set() for _ in names]
            pair = _pairs(chunk, rooms)
            for size in range(2, most + 1):
                at = np.flatnonzero(pair)
                if size > 2:
                    at, hashes = chunk.grams(size, _run(pair, size - 1))
                    at = at[rooms[2].of(hashes)]
                own = lang[at]
                for k, phrases in enumerate(found):
                    some = at[own == k]
                    phrases.update([chunk.raw[a:b] for a, b in zip(chunk.starts[some].tolist(), chunk.ends[some + size - 1].tolist(), strict=True)])
            spaced = chunk.wide.any()
            if sum(map(len, seen.values())) > REMEMBERED:
                seen = {}
            for name, phrases in zip(names, found, strict=True):
                before = seen.setdefault(name, set())
                new = phrases - before
                before |= new
                if spaced:
                    new = {b" ".join(p.split()) for p in new}
                if known is not None:
                    new -= new & known.value.get(name, set())
                if new:
                    yield pa.record_batch([pa.array([name] * len(new), pa.string()), pa.array(list(new), pa.binary()).cast(pa.string())], ["lang", "phrase"])

    return tidied(run)


def _automata(terms: dict[str, list[str]]) -> dict[str, ahocorasick.Automaton]:
    """An automaton a language; a phrase's value is its place among all of them."""
    out, place = {}, 0
    for lang, own in terms.items():
        out[lang] = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for p in own:
            out[lang].add_word(f" {p} ", place)
            place += 1
        out[lang].make_automaton()
    return out


def _scanning(terms) -> Callable:
    """Batches of texts to a task's counts of the terms, in blocks of places, and in a row of slot -1 its words by language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automata, words = _automata(terms.value), {}
        counts = np.zeros(sum(map(len, terms.value.values())), np.int64)
        held: dict[str, list[str]] = {}
        size = 0

        def scan() -> None:
            nonlocal held, size
            for lang, texts in held.items():
                seen, n = np.unique(np.fromiter(map(itemgetter(1), automata[lang].iter("\n".join(texts))), np.int64), return_counts=True)
                counts[seen] += n
            held, size = {}, 0

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                pieces = [p.split() for p in text.as_py().translate(_PLAIN).split(b"\n")]
                words[lang] = words.get(lang, 0) + sum(map(len, pieces))
                if lang in automata:
                    held.setdefault(lang, []).append(b"\n".join(b" %b " % b" ".join(p) for p in pieces if p).decode())
                    size += len(held[lang][-1])
                    if size > CHUNK:
                        scan()
        scan()
        some = np.flatnonzero(counts)
        slots = np.unique(some // TERMS)
        rows = [(-1, json.dumps(words).encode(), b"")] if words else []
        for slot, own in zip(slots.tolist(), np.split(some, np.searchsorted(some, slots[1:] * TERMS)), strict=False):
            rows.append((slot, (own - slot * TERMS).astype(np.uint16).tobytes(), counts[own].tobytes()))
        for at in range(0, len(rows), 1000):
            yield pa.record_batch([pa.array(c, kind) for c, kind in zip(zip(*rows[at : at + 1000], strict=True), (pa.int32(), pa.binary(), pa.binary()), strict=True)], ["slot", "places", "counts"])

    return tidied(run)


def _adding(terms) -> Callable:
    """Sorted blocks of counts to the sums of their terms, one slot at a time; a language's words stand beside a null phrase."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [(lang, p) for lang, own in terms.value.items() for p in own]
        now, held, words = None, np.zeros(TERMS, np.int64), {}

        def done() -> pa.RecordBatch:
            rows = [(*names[now * TERMS + i], int(held[i])) for i in np.flatnonzero(held).tolist()] if now >= 0 else [(x, None, n) for x, n in words.items()]
            return pa.record_batch([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.string(), pa.string(), pa.int64()))], ["lang", "phrase", "n"])

        for batch in batches:
            for slot, places, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if slot != now:
                    if now is not None:
                        yield done()
                    now, held = slot, np.zeros(TERMS, np.int64)
                if slot < 0:
                    for lang, n in json.loads(places).items():
                        words[lang] = words.get(lang, 0) + n
                else:
                    held[np.frombuffer(places, np.uint16)] += np.frombuffer(counts, np.int64)
        if now is not None:
            yield done()

    return run


def _part_of(hashes: np.ndarray, n_parts: int) -> np.ndarray:
    return ((hashes >> np.uint64(33)) % np.uint64(n_parts)).astype(np.int64)


def _parting(n_parts: int) -> Callable:
    """Batches of terms to these with the part of their first word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, phrases = (c.to_pylist() for c in batch.columns)
            if not phrases:
                continue
            chunk = Chunk([p.encode() for p in phrases], langs)
            first = np.flatnonzero(np.diff(chunk.text, prepend=-1))
            part = _part_of(chunk.grams(1)[1][first], n_parts)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(part, pa.int32())], ["lang", "phrase", "part"])

    return run


def _room(chunk: Chunk, rooms: list[Room], most: int) -> np.ndarray:
    """For each word the most words of a phrase that begins there and may be a term."""
    out = rooms[0].starting(chunk, 1).astype(np.int64)
    pair = _pairs(chunk, rooms)
    out[pair] = 2
    for size in range(3, most + 1):
        at, hashes = chunk.grams(size, _run(pair, size - 1))
        out[at[rooms[2].of(hashes)]] = size
    return out


def stretches(chunk: Chunk, room: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """Of the words with room, and those behind them as far as it goes, the stretches of one group and piece: their groups, ascending, and texts."""
    at = np.flatnonzero(room)
    at = at[np.argsort(group[at], kind="stable")]
    own = group[at]
    beyond = own * (len(room) + MOST_WORDS + 1)
    stop = np.maximum.accumulate(at + room[at] + beyond) - beyond
    fresh = np.ones(len(at), bool)
    fresh[1:] = (own[1:] != own[:-1]) | (at[1:] > stop[:-1]) | (chunk.piece[at[1:]] != chunk.piece[at[:-1]])
    first = np.flatnonzero(fresh)
    lo, hi = at[first], stop[np.r_[first[1:], len(at)] - 1] - 1 if len(at) else at
    texts = [chunk.raw[a:b] for a, b in zip(chunk.starts[lo].tolist(), chunk.ends[hi].tolist(), strict=True)]
    wide = np.zeros(len(room) + 1, np.int64)  # places with more than a space behind a word, so far
    np.cumsum(chunk.wide, out=wide[1:])
    for i in np.flatnonzero(wide[hi] > wide[lo]).tolist():
        texts[i] = b" ".join(texts[i].split())
    return own[first], texts


def _dealing(rooms: list[Room], most: int, n_parts: int, salts: int) -> Callable:
    """Batches of texts to their stretches by part and language, and in rows of part -1 their words by language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[str, int] = {}
        salt = TaskContext.get().partitionId()
        for chunk in chunks(batches):
            salt += 1
            names, lang = chunk.named()
            for name, n in zip(names, np.bincount(lang, minlength=len(names)).tolist(), strict=True):
                words[name] = words.get(name, 0) + n
            groups, texts = stretches(chunk, _room(chunk, rooms, most), _part_of(chunk.grams(1)[1], n_parts) * len(names) + lang)
            own, cuts = np.unique(groups, return_index=True)
            bodies = [b" %b " % b" \n ".join(texts[a:b]) for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(texts)], strict=True)]
            yield _dealt(own // len(names), salt % salts, [names[k] for k in (own % len(names)).tolist()], bodies)
        yield _dealt(np.full(len(words), -1), 0, list(words), [b"%d" % n for n in words.values()])

    return tidied(run)


def _dealt(part: np.ndarray, salt: int, langs: list[str], bodies: list[bytes]) -> pa.RecordBatch:
    n = len(bodies)
    return pa.record_batch([pa.array(part, pa.int32()), pa.array([salt] * n, pa.int32()), pa.array([1] * n, pa.int32()), pa.array(langs, pa.string()), pa.array(bodies, pa.binary())], DEALT_NAMES)


DEALT_NAMES = ["part", "salt", "kind", "lang", "body"]
DEALT_SCHEMA = "part int, salt int, kind int, lang string, body binary"


def _matching(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows of a part, its terms (kind 0) before the stretches dealt to it (kind 1), to (lang, phrase, n); words of a language stand beside a null phrase."""
    key, terms, automata, counts, words = None, {}, {}, np.zeros(0, np.int64), {}

    def done() -> Iterator[pa.RecordBatch]:
        names = [(lang, p) for lang, own in terms.items() for p in own]
        rows = [(*names[i], int(counts[i])) for i in np.flatnonzero(counts).tolist()] + [(lang, None, n) for lang, n in words.items()]
        for at in range(0, len(rows), 50_000):
            yield pa.record_batch([pa.array([r[k] for r in rows[at : at + 50_000]], kind) for k, kind in enumerate((pa.string(), pa.string(), pa.int64()))], ["lang", "phrase", "n"])

    for batch in batches:
        for i in range(batch.num_rows):
            part, salt, kind, lang, body = (c[i].as_py() for c in batch.columns)
            if (part, salt) != key:
                yield from done()
                key, terms, automata, counts, words = (part, salt), {}, {}, np.zeros(0, np.int64), {}
            if part < 0:
                words[lang] = words.get(lang, 0) + int(body)
            elif kind == 0:
                terms.setdefault(lang, []).extend(body.decode().split("\n"))
            else:
                if not automata:
                    automata = _automata(terms)
                    counts = np.zeros(sum(map(len, terms.values())), np.int64)
                if lang in automata:
                    seen, n = np.unique(np.fromiter(map(itemgetter(1), automata[lang].iter(body.decode())), np.int64), return_counts=True)
                    counts[seen] += n
    yield from done()


def _part(terms: DataFrame, part: int, n_parts: int) -> dict[str, list[str]]:
    """One part of a written table of phrases by language: about PART_CHARACTERS characters."""
    own: dict[str, list[str]] = {}
    for r in terms.where(F.pmod(F.xxhash64("lang", "phrase"), F.lit(n_parts)) == part).toLocalIterator():
        own.setdefault(r["lang"], []).append(r["phrase"])
    return own


def _parts(terms: DataFrame) -> int:
    return max(1, math.ceil((terms.agg(F.sum(F.length("phrase") + 2)).first()[0] or 0) / PART_CHARACTERS))


def text_bytes(texts: DataFrame) -> int:
    return texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def sketches(texts: DataFrame, size: int, least: int, most: int) -> list[Room]:
    """Of words, of pairs and of all longer phrases."""
    bits = min(MOST_BITS, max(LEAST_BITS, math.ceil(math.log2(max(1, size / BYTES_A_CELL)))))
    rooms: list[Room] = []
    for _ in range(3):
        rooms.append(sketch(texts, rooms, bits, least, most))
    return rooms


def candidates(texts: DataFrame, scratch: Scratch, rooms: list[Room], size: int, most: int) -> DataFrame:
    """(lang, phrase): all phrases of 2 words and more that occur ``least`` times, some others, and their words.

    Most frequent phrases occur in one text of SIEVE, so these are gathered first, in few tasks; the tasks over all other texts
    then return only what was not among them, or not in the part of them that is small enough to be sent along.
    """
    schema, early = "lang string, phrase string", F.pmod(F.xxhash64("text"), F.lit(SIEVE)) == 0
    first = texts.where(early).repartition(math.ceil((size + 1) / SIEVE / SIEVE_BYTES)).mapInArrow(_gathering(rooms, most, None), schema)
    first = scratch.keep(first.distinct(), "first")
    own = {lang: {x.encode() for x in p} for lang, p in _part(first, 0, _parts(first)).items()}
    known = texts.sparkSession.sparkContext.broadcast(own)  # bounded by PART_CHARACTERS
    rest = texts.where(~early).mapInArrow(_gathering(rooms, most, known), schema)
    every = scratch.keep(first.unionByName(rest).distinct(), "every")
    return every.unionByName(every.select("lang", F.explode(F.split("phrase", " ")).alias("phrase")).distinct())


def occurrences(texts: DataFrame, terms: DataFrame, rooms: list[Room], size: int, most: int) -> DataFrame:
    """(lang, phrase, n): exact counts of a written table of phrases, and of all words of a language beside a null phrase."""
    spark, n_parts = texts.sparkSession, _parts(terms)
    if n_parts == 1:
        held = spark.sparkContext.broadcast(_part(terms, 0, 1))  # bounded by PART_CHARACTERS
        counted = texts.mapInArrow(_scanning(held), "slot int, places binary, counts binary")
        return counted.repartition(parallelism(spark), "slot").sortWithinPartitions("slot").mapInArrow(_adding(held), "lang string, phrase string, n long")
    salts = math.ceil((size + 1) / n_parts / DEALT)
    parted = terms.mapInArrow(_parting(n_parts), "lang string, phrase string, part int").groupBy("part", "lang").agg(F.array_join(F.collect_list("phrase"), "\n").cast("binary").alias("body"))
    asked = parted.select("part", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), F.lit(0).alias("kind"), "lang", "body")
    every = asked.unionByName(texts.mapInArrow(_dealing(rooms, most, n_parts, salts), DEALT_SCHEMA))
    dealt = every.repartition(max(parallelism(spark), n_parts * salts), "part", "salt").sortWithinPartitions("part", "salt", "kind")
    return dealt.mapInArrow(tidied(_matching), "lang string, phrase string, n long").groupBy("lang", "phrase").agg(F.sum("n").alias("n"))


def _contained(phrases: DataFrame) -> DataFrame:
    """(lang, phrase, longest_n): the largest count of a longer candidate that holds a phrase of 2 words and more."""
    size = F.size("words")
    inner = F.flatten(
        F.transform(F.sequence(F.lit(2), size - 1), lambda k: F.transform(F.sequence(F.lit(1), size - k + 1), lambda i: F.array_join(F.slice("words", i, k), " ")))
    )
    return phrases.where(size > 2).select("lang", F.explode(inner).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longest_n"))


def scored(counts: DataFrame, least: int = LEAST, covered_percent: int = COVERED_PERCENT) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) of the candidates of a written table of counts that no longer candidate covers.

    Products are decimals of up to 38 digits, so scores are exact for counts of up to 10^16 in 10^18 words.
    """
    totals = counts.where("phrase is null").select("lang", "n")
    terms = counts.where("phrase is not null")
    long = terms.select("lang", "phrase", F.col("n").alias("a"), F.split("phrase", " ").alias("words")).where((F.size("words") > 1) & (F.col("a") >= least))
    part = lambda name, n: terms.select("lang", F.col("phrase").alias(name), F.col("n").alias(n))
    cuts = long.withColumn("k", F.explode(F.sequence(F.lit(1), F.size("words") - 1)))
    cuts = cuts.withColumn("first", F.array_join(F.slice("words", 1, F.col("k")), " ")).withColumn("rest", F.array_join(F.expr("slice(words, k + 1, size(words))"), " "))
    cuts = join_sized(cuts.drop("words"), part("first", "l"), ["lang", "first"], "inner", 80)
    cuts = join_sized(cuts, part("rest", "r"), ["lang", "rest"], "inner", 80)
    cuts = join_sized(cuts, totals, "lang", "inner", 80)
    score = F.expr("(1000 * cast(a as decimal(20, 0)) * cast(n as decimal(20, 0))) div (cast(l as decimal(19, 0)) * cast(r as decimal(19, 0)))")
    best = cuts.withColumn("score", score).groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("b"))
    kept = best.join(_contained(long), ["lang", "phrase"], "left").where(f"longest_n is null or 100 * longest_n < {covered_percent} * b.a")
    return kept.select("lang", "phrase", "b.a", "b.l", "b.r", "b.n", "b.score")


def ranked(phrases: DataFrame, top: int = TOP) -> DataFrame:
    """The first ``top`` of each language with their rank; a language is cut down in many tasks before one ranks it."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salted = phrases.withColumn("_salt", F.pmod(F.xxhash64("phrase"), F.lit(4 * parallelism(phrases.sparkSession))))
    for by in (("lang", "_salt"), ("lang",)):
        salted = salted.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return salted.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def mine(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, most: int = MOST_WORDS, top: int = TOP, covered_percent: int = COVERED_PERCENT) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of the collocations of each language."""
    if not (3 <= most <= MOST_WORDS):
        raise ValueError(f"most must be 3 to {MOST_WORDS}")
    scratch = Scratch(docs.sparkSession)
    texts = docs.where(F.col(text).isNotNull()).select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).cast("binary").alias("text"))
    size = text_bytes(texts)
    rooms = sketches(texts, size, least, most)
    terms = scratch.keep(candidates(texts, scratch, rooms, size, most), "terms")
    scratch.drop("first", "every")
    counts = scratch.keep(occurrences(texts, terms, rooms, size, most), "counts")
    return ranked(scored(counts, least, covered_percent), top)
