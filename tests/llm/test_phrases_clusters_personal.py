"""Personal data, ball-tree clusters and collocations against brute force, and their odd rows."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from trustgauge.llm import ball_clusters as B
from trustgauge.llm import collocations as C
from trustgauge.llm import personal_data as P

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(x - 9 * (x > 9) for x in doubled) % 10 == 0


def confirmed(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(x) <= 255 for x in value.split("."))
    return kind == "email" or (kind == "phone" and 8 <= len(digits) <= 15) or (kind == "card" and 16 <= len(digits) <= 19 and luhn(digits))


def base_spans(text):
    return [(k, *m.span()) for k, p in PATTERNS.items() for m in re.finditer(p, text or "") if confirmed(k, m.group())]


ODD = [
    "a@b.com@c.org", "x@y.zz_a@b.cc", "a@b@c.d", "x@y.zz.._q@w.ee.rr.", "1.2.3.4.5.6.7.8 256.1.1.1 001.02.3.0255 1.2.3", "4111 1111 1111 1111 and 5500005555555559 12",
    "+1 (974) 555-3436 +44 20 7946 0958- +1+2 +1(((((( x +12345678901234567", "é😀 a@b.de ñ +49 (30) 1234-5678 1.1.1.1é", None, "", "9" * 3000, "a." * 5000 + "@x.y", "1.2.3.4 " * 3000,
]


def test_base_spans_against_brute_force(spark):
    rng = random.Random(3)
    texts = ODD + ["".join(rng.choice("ab1290+@.-() _%é\n") for _ in range(rng.randint(1, 300))) for _ in range(400)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in P.digests(docs).collect():
        want = base_spans(texts[r["doc_id"]])
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        counts = collections.Counter(k for k, *_ in want)
        assert [r[f"n_{k}"] for k in PATTERNS] == [counts[k] for k in PATTERNS]
        assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert r["spans"].split(",")[: len(want)] == joined.split(",")[: len(want)]


def test_checksums_context_and_redaction(spark):
    texts = [
        "iban DE89 3704 0044 0532 0130 00 please",  # mod-97 holds
        "iban DE89 3704 0044 0532 0130 01 please",  # it doesn't
        "xDE89370400440532013000",  # within a word
        "amex card 378282246310005, thanks",  # 15 digits count with context alone
        "number 378282246310005, thanks",
        "my ssn is 123-45-6789",
        "part 123-45-6789",
        "ssn 000-45-6789 ssn 123-45-67890",
        "version 1.2.3.4 and, as ever so often, host 1.2.3.4",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: [(s["kind"], s["value"], s["score"]) for s in r["spans"]] for r in P.with_spans(docs).collect()}
    assert got[0] == [("iban", "DE89 3704 0044 0532 0130 00", 1.0)]
    assert [got[i] for i in (1, 2, 4, 6, 7)] == [[]] * 5
    assert got[3] == [("short_card", "378282246310005", 0.65)] and got[5] == [("national_id", "123-45-6789", 0.65)]
    assert got[8] == [("ip", "1.2.3.4", 0.25), ("ip", "1.2.3.4", 0.95)]
    clean = {r["doc_id"]: r["text"] for r in P.redacted(docs).collect()}
    assert clean[0] == "iban <iban> please" and clean[8] == "version 1.2.3.4 and, as ever so often, host <ip>" and clean[6] == texts[6]
    assert P.redacted(spark.createDataFrame([(1, None)], "doc_id long, text string")).first()["text"] is None


def clustered(ids, x, k=8, rounds=10, seed="3"):
    order = sorted(range(len(ids)), key=lambda i: (hashlib.sha256(f"{seed}:{ids[i]}".encode()).hexdigest(), x[i].tolist()))
    z = x[order[:k]].copy()
    away = lambda: ((x[:, None, :] - z[None]) ** 2).sum(2)
    for _ in range(rounds):
        c = away().argmin(1)
        for j in range(len(z)):
            if (c == j).any():
                z[j] = [int(s) // int((c == j).sum()) for s in x[c == j].sum(0)]
    d = away()
    c, d = d.argmin(1), d.min(1)
    digest = [hashlib.sha256(",".join(map(str, row)).encode()).hexdigest() for row in z.tolist()]
    return sorted((ids[i], int(c[i]), int(d[i]), int(d[c == c[i]].sum()), int(d.sum()), digest[c[i]]) for i in range(len(ids)))


@pytest.mark.parametrize("tree,spread", [(1024, 1.0), (40, 0.02), (7, 0.0)])
def test_clusters_against_brute_force(spark, monkeypatch, tree, spread):
    monkeypatch.setattr(B, "TREE", tree)
    rng = np.random.default_rng(8)
    v = (rng.normal(size=(12, 64))[rng.integers(0, 12, 700)] + spread * rng.normal(size=(700, 64))).astype(np.float32)
    v[:40] = v[0]  # copies, so ties between centroids that start alike
    rows = [(int(i), x.tolist(), "x", "y") for i, x in enumerate(v)]
    got = B.cluster(spark.createDataFrame(rows, "vec_id long, embedding array<float>, id string, v string").repartition(3))
    assert sorted(map(tuple, got.collect())) == clustered(list(range(700)), np.floor(v.astype(np.float64) * 1024).astype(np.int64))


def test_balls_go_whole_and_bounds_hold():
    """A tight cloud is assigned by its balls alone; every vector of a whole ball is nearest to its centroid."""
    rng = np.random.default_rng(1)
    x = (rng.integers(-2000, 2000, (5, 64))[rng.integers(0, 5, 900)] + rng.integers(-40, 40, (900, 64))).astype(np.int64)
    order, tree = B.build(x)
    assert sorted(order) == list(range(900)) and (tree["points"] == x[order]).all()
    z = x[:5].copy()
    whole, rows, nearest = B.walk(tree, z)
    truth = B.squares(tree["points"], z).argmin(1)
    covered = np.zeros(900, bool)
    for node, c in whole:
        own = slice(tree["starts"][node], tree["ends"][node])
        assert (truth[own] == c).all() and (tree["sums"][node] == tree["points"][own].sum(0)).all()
        covered[own] = True
    assert (truth[rows] == nearest).all() and covered.sum() + len(rows) == 900 and len(rows) < 450


def test_odd_vectors(spark):
    good, nan = [0.5] * 64, float("nan")
    rows = [(1, good), (1, good), (None, [1.0] * 64), (2, None), (3, []), (4, [1.0] * 63), (5, [None] * 64), (6, [nan] * 64), (7, [float("inf")] * 64), (8, [1e30] * 64), (9, [-0.3] * 64)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r["vec_id"] or 0, r["cluster"], r["distance"]) for r in B.cluster(df).collect())
    assert [g[0] for g in got] == [0, 1, 1, 9] and all(r["centroid_sha256"] for r in B.cluster(df).collect())
    assert B.cluster(df.where("vec_id = 2")).count() == 0 and B.cluster(df.limit(0)).columns == B.cluster(df).columns


def mined(rows, least, most=5, top=2000):
    count, n, lower = collections.defaultdict(collections.Counter), collections.Counter(), {c: c + 32 for c in range(65, 91)}
    for lang, text in rows:
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(lower)):
            w = re.findall("[^ \t]+", piece)
            n[lang or "und"] += len(w)
            for k in range(1, most + 1):
                count[lang or "und"].update(zip(*[w[i:] for i in range(k)], strict=False))
    out = []
    for lang, c in count.items():
        found = {g: a for g, a in c.items() if len(g) > 1 and a >= least}
        covered = {g[i : i + k] for g, a in found.items() for k in range(2, len(g)) for i in range(len(g) - k + 1) if a >= found[g[i : i + k]]}
        rows = []
        for g, a in found.items():
            if g not in covered:
                score, k = min((1000 * a * n[lang] // (c[g[:k]] * c[g[k:]]), k) for k in range(1, len(g)))
                rows.append((-score, -a, " ".join(g).encode(), a, c[g[:k]], c[g[k:]], n[lang], score))
        out += [(lang, i, r[2].decode(), *r[3:]) for i, r in enumerate(sorted(rows)[:top], 1)]
    return sorted(out)


@pytest.mark.parametrize("part,bits", [(4 << 20, 16), (300, 4)])
def test_collocations_against_brute_force(spark, monkeypatch, part, bits):
    """Also with many automata and a sketch so small that its bounds say little."""
    monkeypatch.setattr(C, "PART_CHARACTERS", part)
    for name in ("LEAST_BITS", "MOST_BITS"):
        monkeypatch.setattr(C, name, bits)
    monkeypatch.setattr(C, "REMEMBERED", 10)
    rng = random.Random(4)
    some = ["New", "york", "CITY", "Ünïcode", "a", "aa", "the", "of", " x", "z\x1cz"]
    texts = [" ".join(rng.choice(some) + rng.choice(["", "", ".", ",", "\t", "\n", " ", "\r\n"]) for _ in range(rng.randint(0, 40))) for _ in range(150)]
    rows = [(rng.choice(["en", "de", None, "und"]), t) for t in texts] + [("en", None), (None, ""), ("fr", "one two three"), ("xx", "a a a a a a a a a a a a")]
    docs = spark.createDataFrame(rows, "lang string, text string").withColumn("phrase", F.lit("x")).withColumn("n", F.lit(1)).repartition(3)
    got = sorted(tuple(r) for r in C.mine(docs, least=8, top=50).collect())
    assert got == mined(rows, 8, top=50) and got


def test_collocations_of_nothing(spark):
    docs = spark.createDataFrame([("en", "a b c"), (None, None)], "lang string, text string")
    assert C.mine(docs).count() == 0 and C.mine(docs.limit(0)).count() == 0


def test_scores_beyond_64_bits(spark):
    big = 3 * 10**14
    counts = spark.createDataFrame([("en", "a b", big), ("en", "a", big + 7), ("en", "b", big + 1), ("en", None, 10**17)], "lang string, phrase string, n long")
    assert C.scored(counts).first()["score"] == 1000 * big * 10**17 // ((big + 7) * (big + 1))


def test_many_automata_read_the_texts_once(spark, monkeypatch):
    monkeypatch.setattr(C, "PART_CHARACTERS", 60)
    plans, keep = {}, C.Scratch.keep

    def noted(self, df, name):
        plans[name] = df._jdf.queryExecution().optimizedPlan().toString()
        return keep(self, df, name)

    monkeypatch.setattr(C.Scratch, "keep", noted)
    rows = [("en", "one two three four five. six seven eight  nine ten")] * 9 + [("de", "one two. three four five")] * 9
    got = sorted(tuple(r) for r in C.mine(spark.createDataFrame(rows, "lang string, text string"), least=8).collect())
    assert got == mined(rows, 8)
    assert plans["counts"].count("MapInArrow") == 3  # terms to their parts, texts to theirs, and counts there


def test_stretches_hold_each_word_with_its_room():
    chunk = C.Chunk([b"a b c d  e. f g h", b"i j,k l\tm", b""], ["en", "de", "en"])
    room = np.array([2, 0, 1, 2, 0, 1, 2, 0, 1, 0, 2, 0, 0])
    group = np.array([1, 0, 1, 0, 0, 0, 0, 1, 0, 0, 1, 1, 1])
    groups, texts = C.stretches(chunk, room, group)
    assert list(zip(groups.tolist(), texts, strict=True)) == [(0, b"d e"), (0, b"f g h"), (0, b"i"), (1, b"a b c"), (1, b"k l")]
    assert C.stretches(chunk, 0 * room, group)[1] == []
