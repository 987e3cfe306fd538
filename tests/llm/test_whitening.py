"""Whitening: eigenvectors against wide arithmetic, exact columns against whole numbers, odd rows."""

import math
from fractions import Fraction

import numpy as np
import pytest

from twinsift.llm.queries import QUERIES
from twinsift.llm.whitening import WIDE, clusters, eigenvectors, fit, product, refine, sub_solve, usable, whiten

VECTORS = "vec_id bigint, embedding array<float>, label int, n string"


def given_matrix(values, seed=1):
    """A symmetric matrix with these eigenvalues, rounded once from extended precision."""
    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(len(values),) * 2))[0].astype(WIDE)
    for _ in range(4):
        q = q + q @ (np.eye(len(q), dtype=WIDE) - q.T @ q) / 2
    return ((q * np.array(values, WIDE)) @ q.T).astype(np.float64), q


@pytest.mark.parametrize(
    "values",
    [
        np.linspace(1, 50, 40),
        np.geomspace(1e-9, 1e6, 30),
        [5, 5 + 1e-9, 5 - 1e-9, 3, 2, 1],
        [5, 5 + 1e-6, 5 + 2e-6, 5 + 3e-6, 1, 1 + 1e-7],
        [7] * 6 + [2] * 5 + [1],
        [4.0] * 8,
        [3, 0, 0, 0],
        [1],
    ],
)
def test_eigenvectors(values):
    matrix, _ = given_matrix(values)
    e, x = eigenvectors(matrix)
    assert (np.diff(e) <= 0).all()
    wide, v = matrix.astype(WIDE), x.astype(WIDE)
    size = np.abs(matrix).sum(axis=1).max()
    eps = 2.3e-16
    assert np.abs(wide @ v - v * e).max() <= 4 * eps * size
    assert np.abs(v.T @ v - np.eye(len(v))).max() <= 4 * eps


def test_vectors_are_right_where_float32_is_not():
    matrix, q = given_matrix([5, 5 + 1e-6, 3, 3 - 1e-6, 1])
    true = q[:, [1, 0, 2, 3, 4]]
    single = np.linalg.eigh(matrix.astype(np.float32))[1][:, ::-1]
    far = lambda x: np.abs(np.abs((true * x).sum(axis=0)) - 1).max()
    # The matrix is a double, so its own rounding moves vectors by 1e-16 / 1e-6, and cosines by the square of it.
    assert far(single) > 1e-4 and far(eigenvectors(matrix)[1]) < 1e-15


def test_the_iteration_doubles_digits():
    matrix, q = given_matrix(np.linspace(1, 9, 9))
    x = np.linalg.eigh(matrix.astype(np.float32))[1].astype(WIDE)
    moved = []
    for _ in range(3):
        x, _, close, by = refine(matrix.astype(WIDE), x)
        moved.append(by)
    assert moved[1] < moved[0] ** 1.5 and moved[2] < 1e-15 and close.sum() == 9


def test_products_are_wide():
    random = np.random.default_rng(2)
    a, b = (random.normal(size=(60, 60)).astype(WIDE) * WIDE(2) ** random.integers(-40, 40, (60, 1)) / 3 for _ in range(2))
    far = np.abs(product(a, b) - a @ b) / (np.abs(a).max(axis=1, keepdims=True) * np.abs(b).max(axis=0))
    assert far.max() < 1e-17


def test_a_cluster_is_solved_within_its_span():
    matrix, q = given_matrix([5, 5 + 1e-10, 1])
    turned = q.copy()
    turned[:, 0], turned[:, 1] = (q[:, 0] + q[:, 1]) / np.sqrt(WIDE(2)), (q[:, 0] - q[:, 1]) / np.sqrt(WIDE(2))
    _, values, close, _ = refine(matrix.astype(WIDE), turned)
    members = clusters(values, close)
    assert [sorted(m.tolist()) for m in members] == [[0, 1]]
    own = sub_solve(matrix.astype(WIDE), turned, values, members[0])
    assert np.abs(np.sort(np.abs(q[:, :2].T @ own), axis=1) - [0, 1]).max() < 1e-4


def exact(rows):
    """Whole numbers, sums and deviations with Python's own integers."""
    whole = [[math.floor(64 * Fraction(c)) + 1_000_000 for c in v] for v in rows]
    n, s = len(whole), [sum(c) for c in zip(*whole)]
    return whole, [sum((n * c - t) ** 2 for c, t in zip(x, s)) for x in whole]


def check(found, rows, components):
    vectors = {i: [float(c) for c in v] for i, v in rows}
    ids = sorted(vectors)
    whole, deviation = exact([vectors[i] for i in ids])
    y = np.array(whole, WIDE) - np.array(whole, WIDE).mean(axis=0)
    v = (y.T @ y) / len(ids)
    values = np.linalg.eigvalsh(v.astype(float))[::-1]
    by = {(r.vec_id, r.component): r for r in found}
    assert len(by) == len(found) == len(ids) * components
    w = np.array([[by[i, c + 1].whitened for c in range(components)] for i in ids])
    assert [by[i, 1].deviation for i in ids] == deviation and {r.n for r in found} == {len(ids)}
    explained = np.array([by[ids[0], c + 1].explained for c in range(components)])
    assert np.allclose(explained, values[:components] / np.trace(v).astype(float), rtol=1e-9)
    error = np.abs(w.T @ w / len(ids) - np.eye(components)).max()
    assert error < 1e-9 and {r.identity_error for r in found} and abs(found[0].identity_error - error) < 1e-9
    # w = y axes / sqrt(e), so y^T w / n is each axis times sqrt(e).
    axes = (y.T @ w.astype(WIDE)) / len(ids) / np.sqrt(values[:components])
    assert np.abs(v @ axes - axes * values[:components]).max() < 1e-9 * values[0]


def test_query(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    found = QUERIES["op11_whitening"](spark, sf_dir).collect()
    check(found, [(r.vec_id, r.embedding) for r in table.collect()], 32)



def long_form(df):
    return df.selectExpr("vec_id", *[f"`{c}` as {c[2:]}" for c in df.columns if c.startswith("__")]).collect()


def test_odd_rows(llm):
    random = np.random.default_rng(4)
    good = [(i, [float(np.float32(x)) for x in random.normal(size=5) * [9, 3, 1, 1, 0.2]]) for i in range(60)]
    nan, inf = float("nan"), float("inf")
    bad = [None, [], [1.0, None, 0.0, 0.0, 0.0], [nan] * 5, [0.0, inf, 0.0, 0.0, 0.0], [0.0, 0.0, 0.0, -inf, 1.0], [1.0, 2.0], [1e30] * 5]
    rows = [(i, v, 0, "mine") for i, v in good] + [(100 + i, v, 1, None) for i, v in enumerate(bad)]
    found = whiten(llm.createDataFrame(rows, VECTORS))
    assert found.columns[:3] == ["vec_id", "label", "n"]
    check(long_form(found), good, 5)


def test_repeated_rows_and_ties(llm):
    v = [[1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0], [-1.0, 0.0, 0.0], [0.0, -1.0, 0.0], [0.0, 0.0, -1.0]]
    once = whiten(llm.createDataFrame([(i, x, 0, "") for i, x in enumerate(v)], VECTORS))
    check(long_form(once), list(enumerate(v)), 3)
    twice = whiten(llm.createDataFrame([(i, x, 0, "") for i, x in enumerate(v)] * 2 + [(None, v[0], 0, "")], VECTORS))
    assert twice.count() == 13 * 3 and {r["__n"] for r in twice.collect()} == {13}


@pytest.mark.parametrize("vectors", [[], [[1.0, 2.0]], [[1.0, 2.0]] * 4, [None, [float("nan")]]])
def test_nothing_to_whiten(llm, vectors):
    table = llm.createDataFrame([(i, v, 0, "") for i, v in enumerate(vectors)], VECTORS)
    assert whiten(table).count() == 0


def test_dimensions_without_variance_are_left_out(llm):
    rows = [(i, [float(i % 5), float(i % 7), float(i % 5 + i % 7), 3.0], 0, "") for i in range(70)]
    table = usable(llm.createDataFrame(rows, VECTORS))
    fitted = fit(table)
    assert len(fitted.variances) == 2 and fitted.identity_error < 1e-9


def test_large_numbers_stay_exact(llm):
    rows = [(i, [float(i * 2**32), float(-i * 2**30), 1.0], 0, "") for i in range(40)]
    found = {r.vec_id: r.deviation for r in long_form(whiten(llm.createDataFrame(rows, VECTORS)))}
    _, want = exact([v for _, v, *_ in rows])
    assert found == {i: w if w < 2**63 else None for i, w in enumerate(want)} and None in found.values()
