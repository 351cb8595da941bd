"""Language identification: averaged hashed subword embeddings and a linear softmax.

A word is its character n-grams with edge marks and itself, each hashed to a row of an
embedding table; a text is the mean of all its subwords' rows, and a linear layer with a
softmax gives the languages. The model is trained by stochastic gradient descent in numpy
on at most ``SAMPLE`` labelled rows, those of least hash of their id; all other rows are
only predicted. A temperature and a rejection threshold are set on a part of that sample
which the descent hasn't seen.

As the layer is linear in the mean, the scores of a text are the mean of its words'
scores, and a Python worker remembers those of words it has met.

Defined results: a null text or one without letters is ``und`` with score 0 and not
accepted; without any labelled row every text is ``und``; a row without id is held out; of equal scores the language
that is first in the alphabet wins; repeated rows are predicted alike; whole texts count,
however long; other columns are not read.
"""

from __future__ import annotations

import gc
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Recent, parts

#: Labelled rows that training uses at most: the bound of what the driver gathers.
SAMPLE = 4000
#: Characters of one of them at most; a longer text is trained on by ``PIECES`` pieces, at equal distances from its start to its end.
CHARACTERS, PIECES = 8192, 16
#: Training examples drawn from them at most.
EXAMPLES = 20_000
BUCKETS = 1 << 15
WIDTH = 16
GRAMS = (2, 3, 4)
#: Words of a training example: texts are cut so that short ones are learnt too.
EXAMPLE_WORDS = 24
EPOCHS = 3
#: Steps of the descent at least: small samples are gone through more often.
LEAST_STEPS = 300
BATCH = 128
RATE = 0.5
SEED = 7
UNDEFINED = "und"
#: Words whose scores a Python worker remembers; twice as many at most.
CACHE = 150_000
#: Share of wrong answers that the accepted ones may have on the rows held back.
ACCEPTED_ERROR = 0.01

#: Odd multiplier of the n-gram hash.
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    """Runs of letters; numerals that are no digits (a half, a circled or a Roman one) part them."""
    found = _WORD.findall(text.lower())
    if text.isascii():
        return found
    return [p for w in found for p in ([w] if w.isalpha() else "".join(c if c.isalpha() else " " for c in w).split())]


def subwords(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the words' n-grams and of the words themselves, word by word, and how many each word has."""
    marked = [f"<{w}>" for w in words]
    size = np.array([len(w) for w in marked])
    flat = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    owner, begin = np.repeat(np.arange(len(words)), size), np.r_[0, np.cumsum(size)[:-1]]
    place = np.arange(len(flat)) - begin[owner]
    buckets, owners = [], []
    rolled, power = np.zeros(len(flat), np.uint64), np.ones(int(size.max()), np.uint64)
    power[1:] = _FACTOR
    power = np.cumprod(power)
    for n in range(1, max(GRAMS) + 1):
        rolled = rolled * _FACTOR + np.r_[flat[n - 1 :], np.zeros(min(n - 1, len(flat)), np.uint64)]
        if n in GRAMS:
            inside = place + n <= size[owner]
            buckets.append(rolled[inside] + np.uint64(n))
            owners.append(owner[inside])
    buckets.append(np.add.reduceat(flat * power[place], begin))
    owners.append(np.arange(len(words)))
    mixed, who = np.concatenate(buckets) * _FACTOR, np.concatenate(owners)
    order = np.argsort(who, kind="stable")
    ids = ((mixed ^ (mixed >> np.uint64(29))) * _FACTOR >> np.uint64(40)) % np.uint64(BUCKETS)
    return ids[order].astype(np.int64), np.bincount(who, minlength=len(words))


@dataclass
class Model:
    languages: list[str]
    #: Scores of each bucket: the embedding table times the layer.
    table: np.ndarray
    bias: np.ndarray
    temperature: float
    least: float
    key: str

    def of_words(self, words: list[str]) -> list[tuple]:
        """(subwords, sums of their scores) of each word."""
        ids, n = subwords(words)
        sums = np.add.reduceat(self.table[ids], np.r_[0, np.cumsum(n)[:-1]], axis=0)
        return list(map(tuple, np.c_[n, sums].tolist()))


def _examples(rows: list[tuple[str, str]]) -> tuple[list[list[str]], list[str]]:
    texts, labels = [], []
    for text, lang in rows:
        ws = words_of(text)
        for i in range(0, len(ws), EXAMPLE_WORDS):
            texts.append(ws[i : i + EXAMPLE_WORDS])
            labels.append(lang)
    return texts, labels


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit(rows: list[tuple[str, str]]) -> Model | None:
    """Train on (text, language) rows; None if no row has a letter."""
    rng = np.random.default_rng(SEED)
    order = rng.permutation(len(rows))
    held = [rows[i] for i in order[: len(rows) // 8]]
    texts, labels = _examples([rows[i] for i in order[len(rows) // 8 :]])
    if not texts:
        return None
    drawn = rng.permutation(len(texts))[:EXAMPLES]
    texts, labels = [texts[i] for i in drawn], [labels[i] for i in drawn]
    languages = sorted(set(labels))
    y = np.array([languages.index(x) for x in labels])
    vocabulary = {w: i for i, w in enumerate(dict.fromkeys(w for t in texts for w in t))}
    flat, sizes = subwords(list(vocabulary))
    begin = np.r_[0, np.cumsum(sizes)]
    table = rng.normal(0, 0.1, (BUCKETS, WIDTH))
    layer, bias = np.zeros((WIDTH, len(languages))), np.zeros(len(languages))
    at = [np.array([vocabulary[w] for w in t]) for t in texts]
    batches = -(-len(texts) // BATCH)
    epochs = max(EPOCHS, -(-LEAST_STEPS // batches))
    steps, step = epochs * batches, 0
    for _ in range(epochs):
        shuffled = rng.permutation(len(texts))
        for b in range(0, len(texts), BATCH):
            batch = shuffled[b : b + BATCH]
            ws = np.concatenate([at[i] for i in batch])
            n = sizes[ws]
            ends = np.cumsum(n)
            sub = flat[np.repeat(begin[ws] - (ends - n), n) + np.arange(ends[-1])]
            word_cut = np.r_[0, np.cumsum([len(at[i]) for i in batch])]
            cut = np.r_[0, ends][word_cut]
            count = np.diff(cut)
            mean = np.add.reduceat(table[sub], cut[:-1], axis=0) / count[:, None]
            error = _softmax(mean @ layer + bias)
            error[np.arange(len(batch)), y[batch]] -= 1
            rate = RATE * (1 - step / steps)
            back = (error @ layer.T) / count[:, None]
            layer -= rate * (mean.T @ error) / len(batch) * 8
            bias -= rate * error.mean(axis=0)
            used, inverse = np.unique(sub, return_inverse=True)
            grad = np.zeros((len(used), WIDTH))
            np.add.at(grad, inverse, np.repeat(back, count, axis=0))
            table[used] -= rate * grad
            step += 1
    model = Model(languages, table @ layer, bias, 1.0, 0.0, uuid.uuid4().hex)
    return calibrate(model, held)


def logits(model: Model, texts: list[list[str]]) -> np.ndarray:
    if not texts:
        return np.empty((0, len(model.languages)))
    known = dict.fromkeys(w for t in texts for w in t)
    known = dict(zip(known, model.of_words(list(known)), strict=True))
    sums = np.add.reduceat(np.array([known[w] for t in texts for w in t]), np.r_[0, np.cumsum([len(t) for t in texts])[:-1]], axis=0)
    return sums[:, 1:] / sums[:, :1] + model.bias


def calibrate(model: Model, held: list[tuple[str, str]]) -> Model:
    """Temperature of least log loss, and the least score whose accepted rows err rarely enough."""
    known = {x: i for i, x in enumerate(model.languages)}
    rows = [(t, known[lang]) for t, lang in zip(*_examples(held), strict=True) if lang in known]
    if not rows:
        return model
    z, y = logits(model, [t for t, _ in rows]), np.array([k for _, k in rows])

    def loss(t: float) -> float:
        return -np.log(np.maximum(_softmax(z / t)[np.arange(len(y)), y], 1e-12)).mean()

    model.temperature = float(min(np.geomspace(0.05, 10, 60), key=loss))
    p = _softmax(z / model.temperature)
    top, right = p.max(axis=1), p.argmax(axis=1) == y
    order = np.argsort(-top, kind="stable")
    fine = np.flatnonzero(np.cumsum(~right[order]) <= ACCEPTED_ERROR * np.arange(1, len(y) + 1))
    model.least = float(top[order][fine[-1]]) if len(fine) else 1.0
    return model


class Predictor:
    def __init__(self, model: Model):
        self.model, self.known = model, Recent(CACHE)

    def __call__(self, texts: list[str]) -> Iterator[tuple[str, float, bool]]:
        m = self.model
        cut = [words_of(t) for t in texts]
        flat = [w for t in cut for w in t]
        rows = self.known.find(flat)
        new = list(dict.fromkeys(w for w, v in zip(flat, rows, strict=True) if v is None))
        if new:
            got = dict(zip(new, m.of_words(new), strict=True))
            self.known.add(got)
            rows = [got[w] if v is None else v for w, v in zip(flat, rows, strict=True)]
        full = [i for i, t in enumerate(cut) if t]
        out = [(UNDEFINED, 0.0, False)] * len(texts)
        if full:
            starts = np.r_[0, np.cumsum([len(cut[i]) for i in full])[:-1]]
            sums = np.add.reduceat(np.array(rows), starts, axis=0)
            p = _softmax((sums[:, 1:] / sums[:, :1] + m.bias) / m.temperature)
            for i, k, s in zip(full, p.argmax(axis=1), p.max(axis=1), strict=True):
                out[i] = (m.languages[k], float(s), bool(s >= m.least))
        yield from out


_PREDICTORS: dict[str, Predictor] = {}


def _predictor(model: Model) -> Predictor:
    """One for a model and Python worker, which may serve many tasks."""
    if model.key not in _PREDICTORS:
        gc.disable()  # the map holds no cycles, and scanning it takes long
        _PREDICTORS.clear()
        _PREDICTORS[model.key] = Predictor(model)
    return _PREDICTORS[model.key]


def pieces_of(text: Column, most: int = CHARACTERS) -> Column:
    """The text, or where it is longer than ``most`` characters, pieces of it that are about as long together, each on a line."""
    size = most // PIECES
    begin = lambda i: F.floor((F.length(text) - size) * i / (PIECES - 1)).cast("int") + 1
    cut = F.transform(F.sequence(F.lit(0), F.lit(PIECES - 1)), lambda i: F.substring(text, begin(i), F.lit(size)))
    return F.when(F.length(text) > most, F.array_join(cut, "\n")).otherwise(text)


def train(labelled: DataFrame, text: str = "text", lang: str = "lang", id_col: str = "doc_id") -> Model | None:
    """Fit on the ``SAMPLE`` rows of least id hash that have a text and a label; rows of one id go by their text.

    Texts are cut in the executors, so the driver gathers ``SAMPLE`` times ``CHARACTERS`` characters at most, however long the texts and however often an id occurs.
    """
    usable = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).withColumn("_h", F.xxhash64(id_col))
    last = usable.select("_h").orderBy("_h").limit(SAMPLE).agg(F.max("_h")).first()[0]  # hashes go to the driver before any text does
    if last is None:
        return None
    cut = usable.where(F.col("_h") <= last).select("_h", pieces_of(F.col(text)).alias("text"), F.col(lang).alias("lang"))
    rows = cut.orderBy("_h", "text", "lang").limit(SAMPLE).toPandas()
    return fit(list(zip(rows["text"], rows["lang"], strict=True)))


def predict(docs: DataFrame, model: Model | None, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns, lang_pred, score and accepted of each row."""
    schema = T.StructType(
        [docs.schema[c] for c in keep]
        + [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("accepted", T.BooleanType())]
    )
    shared = docs.sparkSession.sparkContext.broadcast(model)  # as large as BUCKETS * languages

    def run(batches):
        predictor = _predictor(shared.value) if shared.value else None
        for pdf in batches:
            texts = pdf[text].where(pdf[text].notna(), "").tolist()
            rows = [x for p in parts(texts) for x in predictor(p)] if predictor else [(UNDEFINED, 0.0, False)] * len(texts)
            lang, score, accepted = zip(*rows, strict=True) if rows else ((), (), ())
            yield pdf[list(keep)].assign(lang_pred=list(lang), score=list(score), accepted=list(accepted))

    return docs.select(*keep, text).mapInPandas(run, schema)


def held_out(id_col: str = "doc_id"):
    """Rows that training may not see; one without id is held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(True))
