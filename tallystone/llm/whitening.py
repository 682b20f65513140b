"""Whitening of embeddings by Golub-Kahan-Lanczos bidiagonalisation.

Every usable vector c becomes whole numbers x = floor(256 c). The fit list A holds each distinct x
once, less the mean, a row each. The bidiagonalisation builds orthonormal V and U = A W with
A V = U B, B upper bidiagonal, by alternating products A v and A'u; the singular values and right
vectors of the small B give the components and their deviations. It runs in blocks of BLOCK vectors,
so that B is block bidiagonal and a value that occurs several times is found as often (single
vectors, block=1, see each value once), and a pass over the data serves a whole block.

One Spark pass makes both products of a step: a task keeps u = A p for its rows only and adds
their A'u. U is never stored: as U = A W, the inner products of its full reorthogonalisation are
W'(A'A p), which the same pass has returned. V is reorthogonalised twice at each step. The driver
holds matrices of the size dimensions x steps, never rows. Steps end when the residuals of the
wanted components vanish to rounding, or when no direction is left.

The fit list is stored once as blocks of whole numbers, a few MB a row; each pass reads it anew, so
a lost executor repeats only its own tasks. Equal vectors are dropped before and after the exchange,
so a vector copied a million times is one row of it from each task.

Defined cases: rows whose vector is null or holds null, NaN or infinite entries are left out; other
columns and null ids don't matter. Shorter vectors count as filled up with 0, so an empty vector is
0. Entries beyond a long take its nearest end. A component whose variance is under RANK_TOLERANCE of
the first one's counts as absent (so n = 1, equal vectors, or an empty table give no rows). Of equal
variances any orthonormal components may be returned. A deviation beyond a long is null. A very long
vector is one small row of a block.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallystone.llm.common import table
from tallystone.session import materialize

SCALE, COMPONENTS, BLOCK, TOLERANCE, RANK_TOLERANCE = 256, 4, 8, 1e-15, 1e-11
BLOCK_BYTES = 4 << 20
# Above so many parts the sums of a pass meet in tasks before they meet on the driver.
DIRECT_PARTS = 64
WIDTHS = (1, 2, 4, 8)
LONG = (-(1 << 63), (1 << 63) - 1)


# Vectors as bytes


def whole_numbers(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows that are usable, their lengths, all their x in one array)."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.asarray(pc.fill_null(pc.list_value_length(column), 0)).astype(np.int64)
    flat = column.flatten().cast(pa.float64())
    values = np.asarray(flat.fill_null(np.nan), dtype=np.float64)
    ends = np.cumsum(lengths)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
    usable = (bad[ends] == bad[ends - lengths]) & np.asarray(column.is_valid())
    with np.errstate(invalid="ignore", over="ignore"):
        scaled = np.floor(values[np.repeat(usable, lengths)] * SCALE)
    whole = np.clip(scaled, -(2.0**63), 2.0**63 - 1024).astype(np.int64)
    whole[scaled >= 2.0**63] = LONG[1]
    return np.flatnonzero(usable), lengths[usable], whole


def pack(lengths: np.ndarray, whole: np.ndarray) -> list[bytes]:
    """One string a vector: width of its numbers, then the numbers without zeros at the end."""
    ends = np.cumsum(lengths)
    out = []
    for low, high in zip((ends - lengths).tolist(), ends.tolist()):
        x = whole[low:high]
        last = np.flatnonzero(x)
        x = x[: last[-1] + 1] if len(last) else x[:0]
        top = max(int(x.max(initial=0)), -1 - int(x.min(initial=0)))
        width = next(w for w in WIDTHS if top < 1 << (8 * w - 1))
        out.append(bytes([width]) + x.astype(f"<i{width}").tobytes())
    return out


def unpack(packed: list[bytes], dims: int) -> np.ndarray:
    out = np.zeros((len(packed), dims), dtype=np.int64)
    for row, data in zip(out, packed):
        x = np.frombuffer(data, dtype=f"<i{data[0]}", offset=1)
        row[: len(x)] = x
    return out


def packed_vectors(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """Rows (id, x, size) of usable vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, lengths, whole = whole_numbers(batch.column(1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows)), pa.array(pack(lengths, whole), pa.binary()), pa.array(lengths)],
                names=["id", "x", "size"],
            )

    kind = dict(vectors.dtypes)[id_col]
    return vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("vector")).mapInArrow(
        run, f"id {kind}, x binary, size bigint"
    )


# Passes over the fit list


def fit_list(packed: DataFrame) -> DataFrame:
    """Distinct vectors in blocks of about BLOCK_BYTES, stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for data in batch.column(0).to_pylist():
                held.append(data)
                size += len(data)
                if size >= BLOCK_BYTES:
                    yield pa.RecordBatch.from_pydict({"vectors": pa.array([held], pa.list_(pa.binary()))})
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pydict({"vectors": pa.array([held], pa.list_(pa.binary()))})

    return materialize(packed.select("x").distinct().mapInArrow(run, "vectors array<binary>"), "vectors")


def total(fit: DataFrame, dims: int, of_block) -> np.ndarray:
    """Sum over all blocks of the array that `of_block(rows as whole numbers)` returns.

    Each task adds up its own blocks; many tasks' sums are added by fewer before the driver adds the
    rest. Arrays of Python's whole numbers stay exact.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        added = None
        for batch in batches:
            for block in batch.column(0):
                part = of_block(unpack(block.as_py(), dims))
                added = part if added is None else added + part
        if added is not None:
            yield pa.RecordBatch.from_pydict({"part": pa.array([pickle.dumps(added)], pa.binary())})

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        added = None
        for batch in batches:
            for part in batch.column(0):
                added = pickle.loads(part.as_py()) if added is None else added + pickle.loads(part.as_py())
        if added is not None:
            yield pa.RecordBatch.from_pydict({"part": pa.array([pickle.dumps(added)], pa.binary())})

    parts, tasks = fit.mapInArrow(run, "part binary"), fit.rdd.getNumPartitions()
    if tasks > DIRECT_PARTS:
        parts = parts.repartition(int(tasks**0.5)).mapInArrow(merge, "part binary")
    added = None
    for row in parts.toLocalIterator():
        part = pickle.loads(bytes(row["part"]))
        added = part if added is None else added + part
    return added


def counts_and_sums(rows: np.ndarray) -> np.ndarray:
    """[number of rows, sum of each dimension], exact."""
    top = max(int(rows.max(initial=0)), -int(rows.min(initial=0)))
    sums = rows.sum(axis=0) if top * len(rows) < LONG[1] else rows.astype(object).sum(axis=0)
    return np.array([len(rows), *map(int, sums)], dtype=object)


# Bidiagonalisation


@dataclass(frozen=True)
class Whitening:
    n: int
    sums: tuple[int, ...]
    components: np.ndarray  # dimensions x components
    variances: np.ndarray
    trace: float
    identity_error: float
    passes: int

    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])


def significant(gram: np.ndarray, floor: float) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues above the floor and their vectors, of a small symmetric matrix."""
    values, vectors = np.linalg.eigh((gram + gram.T) / 2)
    keep = values > floor
    return values[keep], vectors[:, keep]


def bidiagonalise(product, dims: int, wanted: int, block: int = BLOCK, tolerance: float = TOLERANCE):
    """Right singular vectors and values of A, largest first; `product(P)` returns A'(A P).

    Step k: A V_k = U_{k-1} S'_{k-1} + U_k R_k, then A'U_k = V_k R'_k + V_{k+1} S_k.
    """
    start = np.random.default_rng(0).standard_normal((dims, min(block, dims)))
    v = [np.linalg.qr(start)[0]]
    w, g, r, s = [], [], [], []  # U_k = A W_k and G_k = A'U_k
    largest = 0.0
    while True:
        p = v[-1] - w[-1] @ s[-1].T if w else v[-1]
        image = product(p)
        for _ in range(2):  # all earlier U
            for w_j, g_j in zip(w, g):
                inner = w_j.T @ image
                p, image = p - w_j @ inner, image - g_j @ inner
        gram = p.T @ image
        largest = max(largest, float(np.linalg.norm(gram, 2)))
        values, turn = significant(gram, largest * RANK_TOLERANCE)
        if not len(values):
            break
        roots = np.sqrt(values)
        w.append(p @ turn / roots)
        g.append(image @ turn / roots)
        r.append(roots[:, None] * turn.T)
        rest = g[-1] - v[-1] @ r[-1].T
        basis = np.hstack(v)
        for _ in range(2):  # all V
            rest = rest - basis @ (basis.T @ rest)
        left, values, right = np.linalg.svd(rest, full_matrices=False)
        keep = values > np.sqrt(largest) * 1e-14
        keep[max(dims - basis.shape[1], 0) :] = False
        s.append(values[keep, None] * right[keep])
        u_small, sigma, v_small = np.linalg.svd(bidiagonal(r, s))
        last = r[-1].shape[0]
        missing = np.linalg.norm(s[-1] @ u_small[-last:, :wanted], axis=0)
        if not keep.any() or (len(sigma) >= wanted and np.all(missing <= tolerance * sigma[0])):
            break
        new = left[:, keep]
        new = np.linalg.qr(new - basis @ (basis.T @ new))[0]
        s[-1] = new.T @ rest
        v.append(new)
    if not r:
        return np.zeros((dims, 0)), np.zeros(0)
    _, sigma, v_small = np.linalg.svd(bidiagonal(r, s, beyond=len(v) > len(r)))
    basis = np.hstack(v)
    keep = sigma > sigma[0] * np.sqrt(RANK_TOLERANCE)
    return (basis @ v_small.T[:, : len(sigma)])[:, keep], sigma[keep]


def bidiagonal(r: list[np.ndarray], s: list[np.ndarray], beyond: bool = False) -> np.ndarray:
    """B of the steps so far: R on the diagonal, the transposed S right of it.

    `beyond`: the last V has no U of its own, as A takes it into the space of the U before.
    """
    rows, columns = sum(x.shape[0] for x in r), sum(x.shape[1] for x in r) + beyond * s[-1].shape[0]
    out, i, j = np.zeros((rows, columns)), 0, 0
    for k, block in enumerate(r):
        out[i : i + block.shape[0], j : j + block.shape[1]] = block
        i, j = i + block.shape[0], j + block.shape[1]
        if k + 1 < len(r) or beyond:
            out[i - block.shape[0] : i, j : j + s[k].shape[0]] = s[k].T
    return out


def fit_whitening(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS, block: int = BLOCK) -> Whitening | None:
    """Fit on the distinct vectors of a table; None where no vector is usable."""
    packed = packed_vectors(vectors, id_col, vector_col)
    fit = fit_list(packed)
    dims = packed.agg(F.max("size")).first()[0]
    if dims is None:
        return None
    n, *sums = total(fit, dims, counts_and_sums)
    mean = np.array([s / n for s in sums])
    passes, spread = 0, 0.0

    def product(p: np.ndarray) -> np.ndarray:
        nonlocal passes, spread

        def of_block(rows: np.ndarray) -> np.ndarray:
            centred = rows - mean
            return np.hstack([centred.T @ (centred @ p), np.sum(centred * centred, axis=0)[:, None]])

        added = total(fit, dims, of_block)
        passes, spread = passes + 1, float(added[:, -1].sum())
        return added[:, :-1]

    found, sigma = bidiagonalise(product, dims, min(components, dims), block) if dims else (np.zeros((0, 0)), np.zeros(0))
    found, variances = found[:, :components], (sigma * sigma / n)[:components]
    error = 0.0
    if len(variances):
        scaled = found / np.sqrt(variances)

        def whitened_products(rows: np.ndarray) -> np.ndarray:
            white = (rows - mean) @ scaled
            return white.T @ white

        error = float(np.abs(total(fit, dims, whitened_products) / n - np.eye(len(variances))).max())
    return Whitening(n, tuple(sums), found, variances, spread / n, error, passes)


def whiten(vectors: DataFrame, model: Whitening, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Rows (id, deviation, whitened) of the usable vectors; `whitened` has an entry a component."""
    dims, n = len(model.sums), model.n
    scaled, mean = model.components / np.sqrt(model.variances), model.mean()
    sums = np.array(model.sums, dtype=object)
    top_sum = max(map(abs, model.sums), default=0)

    def deviations(rows: np.ndarray) -> list[int | None]:
        top = n * max(int(rows.max(initial=0)), -int(rows.min(initial=0))) + top_sum
        if dims * top * top <= LONG[1]:
            away = rows * n - sums.astype(np.int64)
            return (away * away).sum(axis=1).tolist()
        exact = [int(((x * n - sums) ** 2).sum()) for x in rows.astype(object)]
        return [d if d <= LONG[1] else None for d in exact]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = unpack(batch.column(1).to_pylist(), dims)
            white = (rows - mean) @ scaled
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(deviations(rows), pa.int64()), pa.array(list(white), pa.list_(pa.float64()))],
                names=["id", "deviation", "whitened"],
            )

    packed = packed_vectors(vectors, id_col, vector_col)
    kind = dict(packed.dtypes)["id"]
    return packed.mapInArrow(run, f"id {kind}, deviation bigint, whitened array<double>")


RESULT = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    model = fit_whitening(vectors)
    if model is None or not len(model.variances):
        return spark.createDataFrame([], RESULT)
    explained = F.array(*[F.lit(float(e / model.trace)) for e in model.variances])
    rows = whiten(vectors, model).select("id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return rows.select(
        F.col("id").alias("vec_id"),
        (F.col("at") + 1).cast("int").alias("component"),
        F.lit(model.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(explained, F.col("at")).alias("explained"),
        F.lit(model.identity_error).alias("identity_error"),
    )
