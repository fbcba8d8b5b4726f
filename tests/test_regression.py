import numpy as np
import pytest
from pyspark.sql import functions as F

from sparrel.functions import text as T
from sparrel.operators import regression as R


def dense(v):
    out = [0.0] * v["size"]
    for k, x in zip(v["indices"], v["values"]):
        out[k] = x
    return out


def newton(x, y, kinds, c=1.0):
    """The optimum by Newton's method in one process: weights and intercepts of each class."""
    x = np.hstack([x, np.ones((len(x), 1))])
    d, w = x.shape[1], np.zeros((kinds, x.shape[1]))
    penalty = np.kron(np.eye(kinds), np.diag([1.0 / c] * (d - 1) + [1e-9]))
    for _ in range(40):
        z = x @ w.T
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        g = ((p - np.eye(kinds)[y]).T @ x).ravel() + penalty @ w.ravel()
        h = penalty.copy()
        for a in range(kinds):
            for b in range(kinds):
                h[a * d : (a + 1) * d, b * d : (b + 1) * d] += x.T @ (x * (p[:, a] * ((a == b) - p[:, b]))[:, None])
        w -= np.linalg.solve(h, g).reshape(w.shape)
    return w


@pytest.fixture(scope="module")
def sample(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(90, 6)) * (rng.random((90, 6)) < 0.5)
    y = ((x[:, 0] > 0).astype(int) + (x[:, 1] + 0.4 * rng.normal(size=90) > 0.3)).astype(int)
    rows = spark.createDataFrame([(k, a.tolist(), float(b)) for k, (a, b) in enumerate(zip(x, y))], "id int, a array<double>, label double")
    return x, y, rows.select("id", "label", R.from_dense(F.col("a"), 6).alias("f"))


def test_the_fit_is_the_only_optimum(sample):
    x, y, rows = sample
    model = R.fit(R.vectors(rows, "f"), "f", "label")
    want = newton(x, y, 3)
    assert np.allclose(model.coefficientMatrix.toArray(), want[:, :-1], atol=1e-4)
    found = {(r["class"], r["index"]): r for r in R.stationarity(model, rows, "f", "label").collect()}
    assert len(found) == 21 and all(abs(r.gradient) < 1e-4 for r in found.values())
    for k in range(3):
        assert abs(found[k, -1].observed - (y == k).sum()) < 1e-9 and abs(found[k, 2].observed - x[y == k, 2].sum()) < 1e-9


def test_a_fit_cut_short_shows(sample):
    _, _, rows = sample
    model = R.fit(R.vectors(rows, "f"), "f", "label", max_iter=2)
    assert max(abs(r.gradient) for r in R.stationarity(model, rows, "f", "label").collect()) > 0.1


def test_vectors_side_by_side(spark):
    rows = spark.createDataFrame([([0.0, 2.0, 0.0], [1.0, 0.0]), ([0.0, 0.0, 0.0], [0.0, 0.0]), ([1.0, 2.0, 3.0], [0.0, 5.0])], "a array<double>, b array<double>")
    both = rows.select("a", "b", R.beside(R.from_dense(F.col("a"), 3), R.from_dense(F.col("b"), 2)).alias("v")).collect()
    assert all(dense(r.v) == [*r.a, *r.b] and r.v["indices"] == sorted(r.v["indices"]) and 0.0 not in r.v["values"] for r in both)
    for wrong in ([1.0, 2.0], None):
        with pytest.raises(Exception, match="not 3 values"):
            spark.createDataFrame([(wrong,)], "a array<double>").select(R.from_dense(F.col("a"), 3)).collect()


def test_sparse_terms_are_the_dense_ones(spark):
    rows = [(1, "brake disc brake"), (2, "oil filter"), (3, None), (4, "nothing known"), (5, "disc oil disc")]
    docs = spark.createDataFrame(rows, "id int, t string")
    vocabulary = T.fit(docs.where("id < 3"), "id", "t", 5)
    whole = {r.id: r.text for r in T.dense(docs, vocabulary, "id", "t").collect()}
    few = {r.id: r.text for r in T.sparse(docs, vocabulary, "id", "t").collect()}
    assert few.keys() == whole.keys() == {1, 2, 3, 4, 5} and all(dense(few[k]) == whole[k] for k in whole)
    assert few[3]["indices"] == [] and few[1]["size"] == 5
