import numpy as np
import pytest

from factloom.llm import queries, whitening

SCHEMA = "vec_id long, embedding array<float>, x string, id string"


def plain(rows, components=4, scale=256):
    """(vec_id, component) to the row expected, by a dense covariance."""
    kept = [(i, [int(np.floor(scale * np.float64(np.float32(c)))) for c in v]) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in kept})
    n, total = len(fit), [sum(c) for c in zip(*fit)]
    far = np.array([[n * c - s for c, s in zip(x, total)] for x in fit], float) / n
    cov = far.T @ far / n
    e, q = np.linalg.eigh(cov)
    e, q = e[::-1][:components], q[:, ::-1][:, :components]
    out = []
    for i, x in kept:
        d = np.array([n * c - s for c, s in zip(x, total)], float) / n
        dev = sum((n * c - s) ** 2 for c, s in zip(x, total))
        out += [(i, k + 1, n, dev, float(d @ q[:, k]) / np.sqrt(e[k]), e[k] / np.trace(cov)) for k in range(len(e))]
    return out


def compare(found, want):
    key = lambda r: (str(r[0]), r[1], r[3], abs(r[4]))
    found, want = sorted((tuple(r)[:7] for r in found), key=key), sorted(want, key=key)
    assert [r[:4] for r in found] == [r[:4] for r in want]
    signs = {}
    for f, w in zip(found, want):
        assert abs(f[5] / w[5] - 1) < 1e-9 and f[6] < 1e-9
        assert abs(abs(f[4]) - abs(w[4])) < 1e-7
        if abs(w[4]) > 1e-3:
            assert signs.setdefault(f[1], np.sign(f[4] * w[4])) == np.sign(f[4] * w[4])


def test_query_against_a_dense_covariance(spark):
    d = "/root/testdata/sf0.001"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{d}/embeddings.parquet").collect()]
    found = queries.op11_embedding_whitening(spark, d)
    assert found.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    compare(found.collect(), plain(rows))


def test_odd_rows(spark):
    rng = np.random.default_rng(3)
    good = [(i, [float(v) for v in rng.normal(size=6)], "a", None) for i in range(40)]
    odd = [(100, None, "b", "c"), (101, [1.0, None, 0.0, 0.0, 0.0, 0.0], None, None), (102, [float("nan")] * 6, None, None), (103, [float("inf")] * 6, None, None), (104, [1.0], None, None), (105, [], None, None)]
    again = [(None, good[0][1], None, None), (0, good[0][1], None, None), *[(7, good[7][1], None, None)] * 50]
    found = whitening.whiten(spark.createDataFrame(good + odd + again, SCHEMA)).collect()
    compare(found, plain([(i, v) for i, v, *_ in good + again]))


def test_no_rows_and_no_spread(spark):
    assert whitening.whiten(spark.createDataFrame([], SCHEMA)).collect() == []
    assert whitening.whiten(spark.createDataFrame([(1, None, None, None), (2, [], None, None)], SCHEMA)).collect() == []
    one = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0], None, None)] * 3, SCHEMA)).collect()
    assert len(one) == 6 and all(r.whitened is None and r.deviation == 0 and r.explained == 0 and r.identity_error is None for r in one)
    line = whitening.whiten(spark.createDataFrame([(i, [float(i), 2.0 * i, 0.0], None, None) for i in range(5)], SCHEMA)).collect()
    assert {r.component for r in line if r.whitened is not None} == {1} and {r.component for r in line} == {1, 2, 3}


def test_deviations_beyond_doubles_are_exact(spark):
    for step in (1e3, 1e6):
        rows = [(i, [3e7 + i * step, 1.0 * i], None, None) for i in range(30)]
        want = {i: dev if dev < 2**63 else None for i, _, _, dev, *_ in plain([(i, v) for i, v, *_ in rows])}
        found = {r.id: r.deviation for r in whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect()}
        assert found == want and any(want.values()) == (step == 1e3)


@pytest.mark.parametrize("kind", ["spread", "equal", "low rank", "large basis"])
def test_lanczos(kind):
    rng = np.random.default_rng(5)
    d, most = (400, 60) if kind == "large basis" else (60, 256)
    q, _ = np.linalg.qr(rng.normal(size=(d, d)))
    e = {"spread": 1.0 / np.arange(1, d + 1), "equal": np.ones(d), "low rank": np.r_[[5.0, 3.0, 2.0], np.zeros(d - 3)], "large basis": np.r_[[9.0, 7.0, 5.0, 4.0], 2 / np.arange(1, d - 3)]}[kind]
    a = (q * e) @ q.T
    passes = []
    value, vector, told = whitening.lanczos(lambda v: passes.append(1) or a @ v, d, 4, 8, most_basis=most)
    assert np.allclose(value, np.sort(e)[::-1][:4], atol=1e-12)
    assert np.allclose(vector.T @ vector, np.eye(4), atol=1e-13)
    assert np.abs(a @ vector - vector * value).max() < 1e-11
    if kind == "low rank":
        assert told["restarts"] > 0
    if kind == "large basis":
        assert told["thick_restarts"] > 0 and told["basis"] <= most


def test_the_passes_are_what_the_result_comes_from(spark, monkeypatch):
    monkeypatch.setattr(whitening._Covariance, "__matmul__", lambda self, q: 2.0 * q)
    rows = [(i, [float(i % 7), float(i % 5), float(i % 3)], None, None) for i in range(50)]
    assert max(r.identity_error for r in whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect()) > 0.5
