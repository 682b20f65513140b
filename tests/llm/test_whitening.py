"""Whitening against numpy's own decomposition."""

import numpy as np
import pytest

from tallystone.llm import whitening
from tallystone.llm.queries import QUERIES
from tests.llm.data import write


def plain(rows):
    """op12 for rows (id, vector): n, sums, variances, components, trace."""
    usable = [(i, v) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    dims = max((len(v) for _, v in usable), default=0)
    whole = [(i, tuple(int(np.floor(256 * float(np.float32(x)))) for x in v) + (0,) * (dims - len(v))) for i, v in usable]
    fit = sorted({x for _, x in whole})
    sums = [sum(c) for c in zip(*fit)]
    centred = np.array(fit, float) - np.array([s / len(fit) for s in sums])
    values, vectors = np.linalg.eigh(centred.T @ centred / len(fit))
    return whole, len(fit), sums, values[::-1], vectors[:, ::-1]


def check(spark, folder, rows, components=4):
    write(spark, folder, embeddings=[(i, v, None) for i, v in rows], extra=True)
    got = QUERIES["op12_embedding_whitening"](spark, folder).collect()
    whole, n, sums, values, vectors = plain(rows)
    by_row = {}
    for r in got:
        assert r["n"] == n and r["identity_error"] <= 1e-9
        assert abs(r["explained"] - values[r["component"] - 1] / values.sum()) <= 1e-9
        by_row.setdefault((r["vec_id"], r["deviation"]), []).append((r["component"], r["whitened"]))
    assert len(got) == components * len(whole)
    signs = {}
    for i, x in whole:
        deviation = sum((n * a - s) ** 2 for a, s in zip(x, sums))
        mine = by_row[i, deviation]
        for c, white in mine:
            want = (np.array(x) - np.array(sums) / n) @ vectors[:, c - 1] / np.sqrt(values[c - 1])
            if abs(want) > 1e-6:
                sign = signs.setdefault(c, np.sign(white) * np.sign(want))
                assert abs(white * sign - want) <= 1e-7 * max(1, abs(want))


def test_op12_matches_numpy(spark, tmp_path):
    rng = np.random.default_rng(4)
    data = (rng.standard_normal((400, 24)) * np.linspace(3, 0.2, 24)).astype(np.float32).tolist()
    rows = list(enumerate(data))
    rows += [(1000 + i, data[0]) for i in range(150)]  # copies count once in the fit
    rows += [(2000, None), (2001, [None] + data[0][1:]), (2002, [float("nan")] * 24), (2003, [float("inf")] + data[0][1:])]
    rows += [(None, data[1]), (3000, data[2]), (3000, data[2]), (2004, []), (2005, [1.0, -2.0])]
    check(spark, str(tmp_path), rows)


def test_op12_few_vectors(spark, tmp_path):
    check(spark, str(tmp_path), [(1, [1.0, 2.0]), (2, [3.0, 1.0]), (3, [0.0, 0.5])], components=2)
    for rows in ([], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, [])], [(1, None)]):
        write(spark, str(tmp_path), embeddings=[(i, v, None) for i, v in rows])
        assert QUERIES["op12_embedding_whitening"](spark, str(tmp_path)).count() == 0


def test_deviation_is_exact_or_null(spark, tmp_path):
    rows = [(1, [1e6, 0.0]), (2, [3.5e6, 1.0]), (3, [-1e9, 1e6]), (4, [1e12, 0.0]), (5, [1e25, 0.0])]
    write(spark, str(tmp_path), embeddings=[(i, v, None) for i, v in rows])
    got = {(r["vec_id"], r["deviation"]) for r in QUERIES["op12_embedding_whitening"](spark, str(tmp_path)).collect()}
    assert got == {(i, None) for i in range(1, 6)}


@pytest.mark.parametrize("block", [1, 3, 8])
def test_bidiagonalisation_equals_svd(block):
    rng = np.random.default_rng(block)
    for shape, scale in (((300, 20), np.geomspace(1, 1e-4, 20)), ((50, 7), np.ones(7)), ((30, 12), np.r_[np.ones(3), np.zeros(9)])):
        a = rng.standard_normal(shape) * scale
        found, sigma = whitening.bidiagonalise(lambda p: a.T @ (a @ p), shape[1], 3, block)
        want = np.linalg.svd(a, compute_uv=False)
        assert np.allclose(sigma[:3], want[:3], rtol=1e-10)
        assert np.allclose(a.T @ (a @ found[:, :3]), found[:, :3] * sigma[:3] ** 2, atol=1e-8 * want[0] ** 2)


def test_equal_variances_are_found_as_often():
    q = np.linalg.qr(np.random.default_rng(1).standard_normal((40, 9)))[0] * [5, 5, 5, 5, 2, 1, 1, 1, 1]
    found, sigma = whitening.bidiagonalise(lambda p: q.T @ (q @ p), 9, 4)
    assert np.allclose(sigma[:4], 5) and np.allclose(found[:, :4].T @ found[:, :4], np.eye(4))


def test_sums_meet_in_tasks_when_there_are_many(spark, monkeypatch):
    monkeypatch.setattr(whitening, "DIRECT_PARTS", 1)
    monkeypatch.setattr(whitening, "BLOCK_BYTES", 64)
    df = spark.createDataFrame([(i, [float(i % 7), float(i % 5), 1.0]) for i in range(300)], "vec_id long, embedding array<float>")
    model = whitening.fit_whitening(df.repartition(6))
    assert model.n == 35 and len(model.variances) == 2 and model.identity_error < 1e-10
