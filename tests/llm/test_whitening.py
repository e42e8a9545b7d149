"""Whitening against a plain covariance and its eigenvectors."""

import math

import numpy as np
import pytest

from tidepool.llm import registry, whitening
from tidepool.llm.whitening import fit, jacobi, whiten

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>, n string, component int"


def plain(vectors, k):
    x = np.floor(1024 * np.array(vectors, np.float64)).astype(np.int64) + 100000
    n, s = len(x), x.sum(axis=0)
    centred = x - s / n
    v = centred.T @ centred / n
    e, axes = np.linalg.eigh(v)
    e, axes = e[::-1][:k], axes[:, ::-1][:, :k]
    return n, ((n * x - s) ** 2).sum(axis=1), centred @ axes / np.sqrt(e), e / np.trace(v)


def held_against_plain(got, ids, vectors, k):
    n, deviation, w, share = plain(vectors, k)
    assert len(got) == len(ids) * k
    at = {(r.vec_id, r.component): r for r in got}
    signs = np.sign([at[ids[0], c + 1].whitened * w[0, c] for c in range(k)])
    for i, vec in enumerate(ids):
        for c in range(k):
            r = at[vec, c + 1]
            assert (r.n, r.deviation) == (n, deviation[i])
            assert r.whitened == pytest.approx(signs[c] * w[i, c], rel=1e-7, abs=1e-9)
            assert r.explained == pytest.approx(share[c], rel=1e-9)
            assert 0 <= r.identity_error < 1e-9


def test_query_equals_plain(spark):
    got = registry.queries()["op13_embedding_whitening"](spark, SF).collect()
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect()
    held_against_plain(got, [r.vec_id for r in rows], [r.embedding for r in rows], 8)


def test_unusable_rows_and_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(whitening, "FAN", 2)
    r = np.random.default_rng(5)
    good = (r.standard_normal((400, 6)) * [30, 10, 3, 1, 0.3, 0.1] @ np.linalg.qr(r.standard_normal((6, 6)))[0]).astype(np.float32)
    good[17] = good[3]
    rows = [(i, v.tolist(), "x", 7) for i, v in enumerate(good)]
    bad = [None, [], [1.0, None, 2.0, 3.0, 4.0, 5.0], [math.nan] * 6, [math.inf] + [0.0] * 5, [1.0, 2.0]]
    df = spark.createDataFrame(rows + [(1000 + i, v, None, None) for i, v in enumerate(bad)], SCHEMA).repartition(9)
    held_against_plain(whiten(df, 5).collect(), list(range(400)), good.tolist(), 5)
    # nearly dependent columns keep their small deviations
    model = fit(df, 6)
    x = np.floor(1024 * good.astype(np.float64))
    want = np.linalg.svd(x - x.mean(axis=0), compute_uv=False) / 20
    assert np.allclose(model.deviations, want, rtol=1e-10)


def test_without_variance_and_without_rows(spark):
    assert whiten(spark.createDataFrame([], SCHEMA)).collect() == []
    assert whiten(spark.createDataFrame([(1, None, "x", 1)], SCHEMA)).collect() == []
    one = whiten(spark.createDataFrame([(None, [1.0, 2.0], "x", 1), (None, [1.0, 2.0], "x", 1)], SCHEMA)).collect()
    assert sorted((r.vec_id, r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one) == [
        (None, c, 2, 0, 0.0, 0.0, 0.0) for c in (1, 1, 2, 2)
    ]
    # one direction varies, the other does not
    flat = whiten(spark.createDataFrame([(i, [float(i), 2.0], "x", 1) for i in range(5)], SCHEMA)).collect()
    assert {r.component: r.explained for r in flat} == {1: pytest.approx(1), 2: 0}
    assert [r.whitened for r in flat if r.component == 2] == [0.0] * 5


def test_too_large_numbers_raise(spark):
    df = spark.createDataFrame([(1, [1e30]), (2, [0.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="beyond 64 bits"):
        whiten(df).collect()


@pytest.mark.parametrize("shape", [(1, 1), (2, 5), (5, 5), (40, 7), (64, 64)])
def test_rotations_give_the_singular_values(shape):
    a = np.random.default_rng(2).standard_normal(shape) * np.logspace(0, -9, shape[1])
    lengths, axes = jacobi(a)
    want = np.linalg.svd(a, compute_uv=False)
    assert np.allclose(lengths[: len(want)], want, rtol=1e-6, atol=1e-14) and np.allclose(lengths[len(want) :], 0, atol=1e-14)
    assert np.allclose(axes.T @ axes, np.eye(shape[1]), atol=1e-13)
    assert np.allclose(np.linalg.norm(a @ axes, axis=0), lengths, rtol=1e-6, atol=1e-14)
