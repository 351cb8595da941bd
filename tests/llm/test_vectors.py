"""Near-duplicate vectors against brute force."""

import numpy as np
import pytest

from trustgauge.llm import vector_dedup as V


def brute(ids, x, threshold=0.95):
    x = x / np.linalg.norm(x, axis=1)[:, None]
    near = x @ x.T >= threshold
    np.fill_diagonal(near, False)
    label = np.arange(len(ids))
    while True:
        fresh = np.array([min([label[i], *label[near[i]]]) for i in range(len(ids))])
        fresh = fresh[fresh]
        if (fresh == label).all():
            break
        label = fresh
    return {int(i): (int(n), int(ids[c])) for i, n, c in zip(ids, near.sum(1), label, strict=True)}


def run(spark, rows, schema="vec_id long, embedding array<float>, label int", **how):
    df = spark.createDataFrame(rows, schema)
    return {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in V.near_duplicates(df, **how).collect()}


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(V, "BLOCK", 50)  # so that lists are cut into blocks
    rng = np.random.default_rng(5)
    base = rng.normal(size=(300, 24))
    near = base[rng.integers(0, 60, 300)] + 0.08 * rng.normal(size=(300, 24))
    hot = base[0] + 0.02 * rng.normal(size=(200, 24))
    x = np.r_[base, near, hot, hot[:5], 3 * hot[:5]].astype(np.float32)
    ids = rng.permutation(len(x))
    got = run(spark, [(int(i), v.tolist(), 1) for i, v in zip(ids, x, strict=True)])
    want = brute(ids, x.astype(np.float64))
    order = np.argsort(ids)
    assert brute(ids[order], x[order].astype(np.float64)).keys() == got.keys()
    want = brute(ids[order], x[order].astype(np.float64))
    assert {i: got[i][:2] for i in got} == want
    assert all(got[i][2] == (i == got[i][1]) for i in got)


def test_each_length_by_itself(spark):
    rng = np.random.default_rng(6)
    rows, want = [], {}
    for at, dim in ((0, 8), (100, 12), (200, 3)):
        x = np.repeat(rng.normal(size=(20, dim)), 3, axis=0) + 0.02 * rng.normal(size=(60, dim))
        ids = np.arange(at, at + 60)
        rows += [(int(i), v.tolist(), 0) for i, v in zip(ids, x, strict=True)]
        want |= brute(ids, x)
    got = run(spark, [*rows, (300, [1.0], 0)], "vec_id long, embedding array<double>, label int", each_length=True)
    assert {i: got[i][:2] for i in got} == want | {300: (0, 300)}


def test_packed_numbers_are_exact():
    x = np.array([[0.5, -3.0], [0.1, 2.0], [1e300, 1.0], [np.float32(0.1), 1e-30]])
    rows = V._pack(x)
    assert [len(r) for r in rows] == [8, 16, 16, 16]
    assert (V._unpack(V.pd.Series(rows), 2) == x).all()


def test_odd_rows(spark):
    nan = float("nan")
    rows = [(1, [1.0, 0.0], 0), (2, [2.0, 0.0], 0), (2, [2.0, 0.0], 0), (3, None, 0), (4, [0.0, 0.0], 0), (5, [1.0, nan], 0), (6, [1.0, None], 0), (7, [1.0, 0.0, 0.0], 0), (None, [1.0, 0.0], 0), (8, [1e-30, 0.0], 0)]
    got = run(spark, rows)
    assert got[1] == (2, 1, True) and got[2] == (2, 1, False) and got[8] == (2, 1, False)
    assert all(got[i] == (0, i, True) for i in (3, 4, 5, 6, 7)) and got[None] == (0, None, True)
    assert run(spark, []) == {}
    assert run(spark, [(1, None, 0)]) == {1: (0, 1, True)}


@pytest.mark.parametrize("n", [1, 3])
def test_columns_clash(spark, n):
    df = spark.createDataFrame([(i, [1.0, 2.0], 9) for i in range(n)], "vec_id long, embedding array<double>, n_links int")
    assert {r["n_links"] for r in V.near_duplicates(df).collect()} == {n - 1}


def _low(rng, n, inner, sparse=False):
    """Vectors of 64 components near a subspace of few dimensions, in pairs that differ by about the length of a link."""
    base = rng.normal(size=(n // 2, inner))
    step = rng.normal(size=base.shape)
    if sparse:
        step[:, 1:] = 0
    step *= 0.9 * np.sqrt(2 - 2 * V.THRESHOLD) * rng.random((len(base), 1)) ** 0.3 * np.linalg.norm(base, axis=1)[:, None] / np.linalg.norm(step, axis=1)[:, None]
    return np.r_[base, base + step] @ np.linalg.qr(rng.normal(size=(64, inner)))[0].T


@pytest.mark.parametrize("inner,sparse", [(3, False), (4, False), (6, False), (4, True)])
@pytest.mark.parametrize("cells", [30, 300])
def test_probes_lose_no_link_near_a_subspace(inner, sparse, cells):
    rng = np.random.default_rng(inner)
    x = V._unit(_low(rng, 4000, inner, sparse))
    centres = V._kmeans(x[rng.permutation(len(x))[:2000]], cells, rng)
    gaps = np.sqrt(np.maximum(0, (centres**2).sum(1)[:, None] + (centres**2).sum(1) - 2 * centres @ centres.T))
    q = V.Quantiser(centres, [], gaps, V.THRESHOLD)
    cell = V._nearest(x, centres)
    probes = q.probes(x, cell)
    a, b = np.nonzero(np.triu(x @ x.T >= V.THRESHOLD, 1))
    low, high = np.where(cell[a] <= cell[b], a, b), np.where(cell[a] <= cell[b], b, a)
    assert probes[low, cell[high]].all() and len(a) > 1000


def test_reach_follows_the_spread_of_links():
    rng = np.random.default_rng(3)
    wide = rng.normal(size=(500, 64))
    links = V._unit(np.r_[wide, wide + 0.15 * rng.normal(size=wide.shape)])
    assert 0.45 < V._reach(links, V.THRESHOLD) < 0.75
    edited = wide.copy()
    edited[:, 0] += 1.5
    assert V._reach(V._unit(np.r_[wide, edited]), V.THRESHOLD) == 1  # one component
    assert V._reach(V._unit(_low(rng, 1000, 3)), V.THRESHOLD) == 1  # three dimensions
    assert V._reach(V._unit(wide), V.THRESHOLD) == 1  # no links to measure


@pytest.mark.parametrize("inner,sparse", [(3, False), (6, False), (4, True)])
def test_near_a_subspace_against_brute_force(spark, monkeypatch, inner, sparse):
    monkeypatch.setattr(V, "PER_CELL", 20)
    rng = np.random.default_rng(9)
    x = _low(rng, 1200, inner, sparse)
    got = run(spark, [(int(i), v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    assert {i: got[i][:2] for i in got} == brute(np.arange(len(x)), x)


def test_vectors_are_not_sent_to_the_lists_they_probe(spark, monkeypatch):
    """Rows without clusters probe about every cell; what is shuffled must follow the rows, not the probes."""
    monkeypatch.setattr(V, "PER_CELL", 50)
    x = np.random.default_rng(1).normal(size=(4000, 32))
    context = spark.sparkContext._jsc.sc()

    def shuffled():
        context.listenerBus().waitUntilEmpty(30_000)
        executors = context.statusStore().executorList(False)
        return sum(executors.apply(i).totalShuffleWrite() for i in range(executors.size()))

    before = shuffled()
    run(spark, [(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    assert shuffled() - before < 2 * x.nbytes


@pytest.mark.parametrize("most", [40, 300, 100_000])
def test_lists_dealt_to_blocks(monkeypatch, most):
    monkeypatch.setattr(V, "BLOCK", most)
    counts = {0: 10, 2: 35, 3: 1000, 4: 1, 7: 39, 8: 900}
    first, parts, n = V._dealt(counts, 10)
    took = [range(first[c], first[c] + parts[c]) for c in counts]
    assert sorted({b for own in took for b in own}) == list(range(n))
    assert all(a[-1] <= b[0] for a, b in zip(took, took[1:], strict=False))  # so lists of a later block are of no earlier cell
    assert all(counts[c] <= min(most, 256) * parts[c] for c in counts)


def test_groups_that_hold_all_rows_of_many_blocks(spark, monkeypatch):
    for name, value in (("BLOCK", 64), ("LEAST_BLOCK", 16), ("PAIRS", 256), ("HELD", 100), ("PER_CELL", 100)):
        monkeypatch.setattr(V, name, value)
    rng = np.random.default_rng(4)
    x = np.r_[np.repeat(rng.normal(size=(1, 16)), 300, axis=0), np.repeat(rng.normal(size=(20, 16)), 15, axis=0)]
    x += 0.03 * rng.normal(size=x.shape)
    got = run(spark, [(int(i), v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    assert {i: got[i][:2] for i in got} == brute(np.arange(len(x)), x)


def test_few_true_ones():
    for shape in ((5, 7), (16, 8), (1, 3)):
        table = np.random.default_rng(2).random(shape) < 0.2
        table[-1, -1] = True
        assert all((a == b).all() for a, b in zip(V._few_true(table), np.nonzero(table), strict=True))
