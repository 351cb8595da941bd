"""Token counts under a sentencepiece vocabulary, without making the ids.

An Aho-Corasick automaton over the vocabulary finds all pieces that end at each character, and
dynamic programming carries what is needed of the one path that the tokenizer would take up to there.

``with_merge_counts`` is for BPE models, whose scores are merge ranks: of all neighbouring symbols whose
concatenation is a piece, those of the best score merge first, the leftmost of equal ones. A sequence of
pieces is the outcome of these merges just if every two neighbours of it are the outcome for their own
text, so exactly one of the pieces that end at a character follows from the last piece of the path before it.
The programme carries that piece and the number of tokens; a character that is no piece counts as its UTF-8 bytes.

``with_counts`` is for unigram vocabularies, whose scores are log-probabilities: the programme carries the
best score and the number of pieces. Of equal scores the piece that starts first wins, as in the
tokenizers library's Unigram model; a character that no piece matches alone costs the least score less
10 and counts as its UTF-8 bytes where the vocabulary has byte pieces, else neighbouring ones count as one.

A text becomes a leading word mark plus the text with spaces as word marks. Where no piece
has a mark after another character, neither a merge nor a best path crosses the start of a run of
marks, so texts are counted word by word and a Python worker remembers words it has met.
Sums of whole scores are exact in doubles, so cutting changes no tie.

Defined results: a null or empty text has 0 tokens; other columns pass through, a column
named like the result is replaced; repeated rows are counted alike; no text is shortened.
"""

from __future__ import annotations

import gc
import re
from collections.abc import Iterator

import ahocorasick
import pandas as pd
import sentencepiece
from sentencepiece import sentencepiece_model_pb2
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Recent, parts

MARK = "▁"
UNKNOWN_PENALTY = 10.0
#: Words whose count a Python worker remembers; twice as many at most.
CACHE = 300_000


def load_pieces(path: str) -> list[tuple[str, float]]:
    """Pieces that stand for text, with scores; control, unknown, unused and byte pieces match none."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    other = lambda i: model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or model.is_byte(i)
    return [(model.id_to_piece(i), float(model.get_score(i))) for i in range(model.get_piece_size()) if not other(i)]


def has_bytes(path: str) -> bool:
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return sum(model.is_byte(i) for i in range(model.get_piece_size())) == 256


class Counter:
    def __init__(self, pieces: list[tuple[str, float]], has_bytes: bool):
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        names = {p for p, _ in pieces}
        self.single = {p for p in names if len(p) == 1}
        self.unknown = min(score for _, score in pieces) - UNKNOWN_PENALTY
        self.bytes = has_bytes
        #: Words can be counted one by one.
        self.by_word = not any(MARK in p.lstrip(MARK) for p in names)
        #: A new line is in no piece, so it is one byte piece and a place to cut.
        self.lines = self.by_word and self.bytes and not any("\n" in p for p in names)
        self.known = Recent(CACHE)

    def count(self, text: str) -> int:
        """Pieces of the best path over a text whose spaces are marks already."""
        n = len(text)
        best, pieces, open_unknown = [0.0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        reached, single, unknown = 0, self.single, self.unknown
        score_at = float("-inf")

        def close(end: int) -> None:  # all pieces that end here have been seen
            nonlocal score_at
            c = text[end - 1]
            if c not in single and (alone := best[end - 1] + unknown) > score_at:
                score_at = alone
                own = len(c.encode("utf-8", "surrogatepass")) if self.bytes else 1 - open_unknown[end - 1]
                pieces[end], open_unknown[end] = pieces[end - 1] + own, True
            best[end] = score_at
            score_at = float("-inf")

        for at, (size, score) in self.automaton.iter(text):
            end = at + 1
            while reached + 1 < end:
                reached += 1
                close(reached)
            start = end - size
            if (total := best[start] + score) > score_at:
                score_at, pieces[end], open_unknown[end] = total, pieces[start] + 1, False
        while reached < n:
            reached += 1
            close(reached)
        return pieces[n]

    def cut(self, text: str) -> list[str]:
        """Keys of the parts of a text: a word (a mark before it is understood), or a new line and what follows it."""
        if not text:
            return []
        if not self.by_word:
            return [MARK + text.replace(" ", MARK)]
        if MARK in text or "  " in text or text[0] == " ":
            marked = MARK + text.replace(" ", MARK)
            return [MARK + x for x in re.findall(f"{MARK}+[^{MARK}]*", marked)]
        if self.lines:
            text = text.replace("\n", " \n")
        return text.split(" ")

    def of_key(self, key: str) -> int:
        if key[:1] == MARK:  # written out in full
            return self.count(key[1:] if self.by_word else key)
        if self.lines and key[:1] == "\n":
            return 1 + (self.count(key[1:]) if key[1:] else 0)
        return self.count(MARK + key)

    def __call__(self, texts: list[str]) -> Iterator[int]:
        cut = [self.cut(t) for t in texts]
        flat = [k for t in cut for k in t]
        counts = self.known.find(flat)
        new = dict.fromkeys(k for k, v in zip(flat, counts, strict=True) if v is None)
        if new:
            for k in new:
                new[k] = self.of_key(k)
            self.known.add(new)
            counts = [new[k] if v is None else v for k, v in zip(flat, counts, strict=True)]
        at = 0
        for keys in cut:
            yield sum(counts[at : at + len(keys)])
            at += len(keys)


#: Pairs of neighbouring pieces whose outcome a Python worker remembers.
PAIRS = 500_000


class MergeCounter(Counter):
    """Counts by the merges of a BPE model with byte pieces, no normalisation and a leading mark."""

    def __init__(self, path: str):
        spec = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            spec.ParseFromString(f.read())
        norm, kinds = spec.normalizer_spec, {x.type for x in spec.pieces}
        plain = not norm.precompiled_charsmap and norm.add_dummy_prefix and not norm.remove_extra_whitespaces
        piece = spec.SentencePiece
        if spec.trainer_spec.model_type != spec.trainer_spec.BPE or not plain or not has_bytes(path) or kinds & {piece.USER_DEFINED, piece.UNUSED}:
            raise ValueError(f"{path}: not a BPE model with byte pieces and unchanged text")
        pieces = load_pieces(path)
        super().__init__(pieces, True)
        self.scores = dict(pieces)

        self.fits: dict[tuple[str, str], bool] = {}

    def count(self, text: str) -> int:
        """Tokens of a text whose spaces are marks already."""
        n, single = len(text), self.single
        last, tokens = [""] * (n + 1), [0] * (n + 1)
        ending: list[list[int]] = [[] for _ in range(n + 1)]
        for at, (size, _) in self.automaton.iter(text):
            ending[at + 1].append(size)
        for end in range(1, n + 1):
            c = text[end - 1]
            if c not in single:
                ending[end].append(1)
            for size in ending[end]:
                start = end - size
                piece = text[start:end]
                if self.follows(last[start], piece):
                    last[end] = piece
                    tokens[end] = tokens[start] + (len(c.encode("utf-8", "surrogatepass")) if size == 1 and c not in single else 1)
                    break
        return tokens[n]

    def follows(self, a: str, b: str) -> bool:
        """Whether the merges leave a and b of their concatenation; at the start of a text a is empty."""
        known = self.fits.get((a, b))
        if known is None:
            if len(self.fits) > PAIRS:
                self.fits.clear()
            known = self.fits[a, b] = self.merged(list(a + b)) == ([a, b] if a else [b])
        return known

    def merged(self, symbols: list[str]) -> list[str]:
        find, none = self.scores.get, float("-inf")
        pairs = [find(a + b, none) for a, b in zip(symbols, symbols[1:], strict=False)]
        while pairs and (best := max(pairs)) > none:
            i = pairs.index(best)
            symbols[i] += symbols.pop(i + 1)
            del pairs[i]
            if i:
                pairs[i - 1] = find(symbols[i - 1] + symbols[i], none)
            if i < len(pairs):
                pairs[i] = find(symbols[i] + symbols[i + 1], none)
        return symbols


_COUNTERS: dict[tuple[str, bool], Counter] = {}


def _counter(path: str, merges: bool) -> Counter:
    """One for a Python worker, which may serve many tasks."""
    if (path, merges) not in _COUNTERS:
        gc.disable()  # the maps hold no cycles, and scanning them takes long
        _COUNTERS[path, merges] = MergeCounter(path) if merges else Counter(load_pieces(path), has_bytes(path))
    return _COUNTERS[path, merges]


def with_merge_counts(docs: DataFrame, path: str, text: str = "text", out: str = "n_tokens") -> DataFrame:
    """docs with the number of tokens of each text under a BPE model."""
    return with_counts(docs, path, text, out, True)


def with_counts(docs: DataFrame, path: str, text: str = "text", out: str = "n_tokens", merges: bool = False) -> DataFrame:
    """docs with the number of tokens of each text under a unigram vocabulary, or by merges."""

    @F.pandas_udf("long")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = _counter(path, merges)
        for s in batches:
            texts = s.where(s.notna(), "").tolist()
            yield pd.Series([n for p in parts(texts) for n in counter(p)], dtype="int64")

    return docs.withColumn(out, run(text))
