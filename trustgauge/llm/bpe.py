"""BPE encoding and decoding of whole texts with a word-end vocabulary.

A text is cut at white space, as no token crosses it. A Python worker remembers the
encoding of a bounded number of white-space-free pieces and of words; new pieces of a
batch go through normalisation and the word pattern, and all their new words are merged
together in numpy: symbols of all words lie in one flat array, every round
finds each word's lowest-rank pair by binary search over the sorted pair keys and merges
it, until no word has a mergeable pair.

Defined results: a null or empty text has no tokens and empty strings; strings of special
tokens in a text become these tokens, as in the tokenizers library; ids that are null or
unknown are skipped in decoding; repeated rows and ties (the leftmost pair of the lowest
rank goes first) are plain cases; other columns are passed on by ``encode`` and replaced
where they have the name of an added one.
"""

from __future__ import annotations

import gc
import hashlib
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Recent, parts

#: Words, and as many pieces, whose encoding a Python worker remembers; twice as many at most.
CACHE = 150_000
_GAP = regex.compile(r"\p{White_Space}+")
#: Characters on which str.split() and the Unicode property White_Space disagree.
_ODD = regex.compile(r"[\x1c-\x1f]")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = [""] * 256, 256
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b], extra = chr(extra), extra + 1
    return out


class WordBpe:
    """Vocabulary, pair ranks and the batched merge."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, vocab = spec["model"], spec["model"]["vocab"]
        self.end = model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        self.word = regex.compile(
            next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        )
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")")
        symbols = byte_symbols()
        self.inner = np.array([vocab.get(s, -1) for s in symbols], np.int64)
        self.final = np.array([vocab.get(s + self.end, -1) for s in symbols], np.int64)
        self.base = 1 + max(vocab.values())
        left, right, made = (np.empty(len(model["merges"]), np.int64) for _ in range(3))
        for i, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            left[i], right[i], made[i] = vocab[a], vocab[b], vocab[a + b]
        keys = left * self.base + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.made = keys[order], made[order]
        self.rank = np.r_[order, len(order)]
        born = np.full(self.base, -1, np.int64)
        for i in range(len(made)):  # the last rule that makes a symbol
            born[made[i]] = i
        rules = np.arange(len(made))
        #: No rule that uses a symbol ranks before one that makes it: then equal pairs of a word can merge in one round.
        self.ordered = bool(np.all((born[left] < rules) & (born[right] < rules)))

    def slots(self, symbols: np.ndarray, owner: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Place among the sorted keys of the pair that begins at each position, len(keys) where it is no pair."""
        none = len(self.keys)
        at_next = np.minimum(at + 1, len(symbols) - 1)
        pair = symbols[at] * self.base + symbols[at_next]
        found = np.minimum(np.searchsorted(self.keys, pair), none - 1)
        fits = (self.keys[found] == pair) & (owner[at] == owner[at_next]) & (at_next > at)
        return np.where(fits, found, none)

    def merge(self, symbols: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Final symbols of all words; owner says which word a symbol is in, in ascending order."""
        done_s, done_o = [], []
        none = len(self.keys)
        slot = self.slots(symbols, owner, np.arange(len(symbols)))
        while len(symbols):
            rank = self.rank[slot]
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            best = np.minimum.reduceat(rank, starts)
            sizes = np.diff(np.r_[starts, len(symbols)])
            live = best < none
            if not live.all():  # words without a pair are finished
                stay = np.repeat(live, sizes)
                done_s.append(symbols[~stay])
                done_o.append(owner[~stay])
                symbols, owner, slot, rank = symbols[stay], owner[stay], slot[stay], rank[stay]
                best, sizes = best[live], sizes[live]
                if not len(symbols):
                    break
            where = np.flatnonzero(rank == np.repeat(best, sizes))
            if self.ordered:  # of a run of touching hits every other one, from the left
                fresh = np.r_[True, np.diff(where) > 1]
                first = where[fresh][np.cumsum(fresh) - 1]
                where = where[(where - first) % 2 == 0]
            else:
                where = where[np.r_[True, owner[where][1:] != owner[where][:-1]]]
            symbols[where] = self.made[slot[where]]
            left = np.ones(len(symbols), bool)
            left[where + 1] = False
            symbols, owner, slot = symbols[left], owner[left], slot[left]
            here = where - np.arange(len(where))  # each merge before it took one symbol
            changed = np.concatenate([here, np.maximum(here - 1, 0)])
            slot[changed] = self.slots(symbols, owner, changed)
        if not done_s:
            return symbols, owner
        s, o = np.concatenate(done_s), np.concatenate(done_o)
        order = np.argsort(o, kind="stable")
        return s[order], o[order]

    def encode_words(self, words: list[str]) -> tuple[list[int], list[int]]:
        """Ids of all words one after the other, and where each word's ids begin and end."""
        raw = [w.encode() for w in words]
        n = np.array([len(b) for b in raw], np.int64)
        flat = np.frombuffer(b"".join(raw), np.uint8)
        symbols = self.inner[flat]
        ends = np.cumsum(n) - 1
        symbols[ends] = self.final[flat[ends]]
        owner = np.repeat(np.arange(len(n)), n)
        known = symbols >= 0
        symbols, owner = self.merge(symbols[known], owner[known])
        return symbols.tolist(), np.searchsorted(owner, np.arange(len(n) + 1)).tolist()

    def words(self, piece: str) -> list[str]:
        """Normalised words of a piece without white space."""
        if not piece.isascii():
            piece = unicodedata.normalize("NFC", piece).replace("Σ", "σ")
        piece = piece.lower()
        if piece.isalpha():
            return [piece]
        if piece[-1] in ".," and piece[:-1].isalpha():
            return [piece[:-1], piece[-1]]
        return self.word.findall(piece)

    def pieces(self, text: str) -> list[str]:
        """White-space-free pieces; special tokens are pieces of their own."""
        if "<|" in text or any(s in text for s in self.special):
            out: list[str] = []
            for i, part in enumerate(self.cut.split(text)):
                out += [part] if i % 2 else self.pieces_plain(part)
            return out
        return self.pieces_plain(text)

    @staticmethod
    def pieces_plain(text: str) -> list[str]:
        return [p for p in _GAP.split(text) if p] if _ODD.search(text) else text.split()

    def decode(self, ids) -> str:
        """Tokens joined by one space: the vocabulary's file names no decoder."""
        return " ".join(self.tokens[i] for i in ids if i in self.tokens)


class Encoder:
    """Remembers (number of ids, ids as text, decoded text) of words and of pieces."""

    def __init__(self, path: str):
        self.bpe = WordBpe(path)
        self.of_word, self.of_piece = Recent(CACHE), Recent(CACHE)
        self.id_text = {i: str(i) for i in self.bpe.tokens}

    def learn_words(self, words: list[str]) -> list[tuple[int, str, str]]:
        """Values of words, new ones encoded together."""
        out = self.of_word.find(words)
        new = list(dict.fromkeys(w for w, v in zip(words, out, strict=True) if v is None))
        if new:
            ids, cut = self.bpe.encode_words(new)
            texts, tokens = list(map(self.id_text.__getitem__, ids)), list(map(self.bpe.tokens.__getitem__, ids))
            got = {w: (b - a, " ".join(texts[a:b]), " ".join(tokens[a:b])) for w, a, b in zip(new, cut[:-1], cut[1:], strict=True)}
            self.of_word.add(got)
            out = [got[w] if v is None else v for w, v in zip(words, out, strict=True)]
        return out

    def __call__(self, texts: list[str]) -> Iterator[tuple[int, str, str]]:
        cut = [self.bpe.pieces(t) for t in texts]
        flat = [p for t in cut for p in t]
        values = self.of_piece.find(flat)
        new = dict.fromkeys(p for p, v in zip(flat, values, strict=True) if v is None)
        if new:
            special = self.bpe.special
            words = [[] if p in special else self.bpe.words(p) for p in new]
            got = self.learn_words([w for ws in words for w in ws])
            at = 0
            for p, ws in zip(new, words, strict=True):
                if p in special:
                    new[p] = (1, str(special[p]), p)
                    continue
                own = got[at : at + len(ws)]
                at += len(ws)
                if len(own) != 1:
                    n, a, b = zip(*own, strict=True) if own else ((), (), ())
                    own = [(sum(n), " ".join(filter(None, a)), " ".join(filter(None, b)))]
                new[p] = own[0]
            self.of_piece.add(new)
            values = [new[p] if v is None else v for p, v in zip(flat, values, strict=True)]
        at = 0
        for pieces in cut:
            if not pieces:
                yield 0, "", ""
                continue
            n, a, b = zip(*values[at : at + len(pieces)], strict=True)
            at += len(pieces)
            yield sum(n), " ".join(filter(None, a)), " ".join(filter(None, b))


_ENCODERS: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    """One for a Python worker, which may serve many tasks."""
    if path not in _ENCODERS:
        gc.disable()  # the maps hold no cycles, and scanning them takes longer than encoding
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def encode(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """docs with ``ids``, an array of token ids."""
    keep = [c for c in docs.columns if c != "ids"]
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def run(batches):
        encoder = _encoder(path)
        for pdf in batches:
            texts = pdf[text].where(pdf[text].notna(), "").tolist()
            ids = [np.array(x[1].split(), np.int32) if x[0] else np.empty(0, np.int32) for p in parts(texts) for x in encoder(p)]
            yield pdf.assign(ids=ids)

    return docs.select(*keep).mapInPandas(run, schema)


def decode(df: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """df with ``decoded``, the text of an array of token ids."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bpe = WordBpe(path)
        for s in batches:
            yield s.map(lambda x: "" if x is None else bpe.decode(x))

    return df.withColumn("decoded", run(ids))


def digests(docs: DataFrame, path: str, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """id, n_tokens and SHA-256 of the ids and of the decoded text, by the same encoder and decoder."""
    schema = T.StructType(
        [docs.schema[id_col], T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    )

    def run(batches):
        encoder = _encoder(path)
        for pdf in batches:
            texts = pdf[text].where(pdf[text].notna(), "").tolist()
            rows = [(n, *(hashlib.sha256(x.encode()).hexdigest() for x in (a, b))) for p in parts(texts) for n, a, b in encoder(p)]
            n, a, b = zip(*rows, strict=True) if rows else ((), (), ())
            yield pd.DataFrame({id_col: pdf[id_col], "n_tokens": n, "ids_sha256": a, "decoded_sha256": b})

    return docs.select(id_col, text).mapInPandas(run, schema)
