"""Whitening of embeddings by Chebyshev-filtered subspace iteration.

The leading eigenvectors of the covariance are found without forming it: a block of vectors Q is sent to the tasks, each
multiplies its centred rows X to XᵀXQ, and the small products are summed. A polynomial of such passes (the Chebyshev
recurrence over the interval below the block's least Ritz value) damps the unwanted part of the spectrum, then a QR
factorisation and a Rayleigh-Ritz step give estimates. It ends when the residual of every wanted component, measured by a
pass of its own, certifies it, or when rounding keeps the residuals from falling.

Entries are fixed-point numbers, so the fit list (each distinct vector once), its count, its sums and the trace are exact;
all sums but those of the passes are of whole numbers.

What goes to the driver is a vector or block of dimension x ``BLOCK`` numbers, whatever the number of rows.

Result cases. Null vectors, vectors with null or non-finite entries or such of 2 ** 54 and more, empty vectors, and vectors of another length than most
(ties: the longer) are dropped. Null or repeated vec_id: each row is projected. Repeated vectors count once
in the fit. Components without variance (fewer directions than components, one vector, equal vectors) are not
returned. Deviations beyond 64 bits: null. Very long vectors: work grows with length x ``BLOCK``. Empty table: no
rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricelake.llm.common import run_folder

SCALE = 256
LARGEST = 2.0**54  # entries from here on have no 64-bit fixed-point number
COMPONENTS = 4
BLOCK = 32  # vectors in the iterated block
DEGREE = 12  # passes of a filter
CERTIFIED = 1e-13  # residual as a part of the largest eigenvalue
ROUNDS = 60
FLAT = 1e-12  # eigenvalues below this part of the trace have no direction


def fixed_point(rows: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, x): rows whose vector can be used, entries as whole numbers of 1 / ``scale``."""
    entries = F.col("embedding")
    usable = F.size(entries) > 0
    finite = F.forall(entries, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(LARGEST)))
    good = rows.where(entries.isNotNull()).where(usable & finite)
    x = F.transform(entries, lambda c: F.floor(c.cast("double") * scale).cast("bigint"))
    good = good.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x"))
    sizes = good.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n"))
    most = sizes.agg(F.max(F.struct("n", "d"))["d"]).first()[0]
    return good.where(F.size("x") == (most or 0))


def _matrix(column, d: int):
    import numpy as np

    flat = column.flatten().to_numpy(zero_copy_only=False)
    return np.asarray(flat, dtype=np.int64).reshape(-1, d)


class Fit:
    """The fit list: ``n``, ``d``, exact sums and trace, and products with the covariance."""

    def __init__(self, vectors: DataFrame, folder: str):
        vectors.select("x").distinct().write.parquet(folder)
        self.rows = vectors.sparkSession.read.parquet(folder)
        sums = self.rows.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(
            F.count("*").alias("n"), F.sum(F.col("v").cast("decimal(20,0)")).alias("s"), F.sum(F.col("v").cast("decimal(19,0)") * F.col("v").cast("decimal(19,0)")).alias("q")
        )
        found = sorted(sums.collect())  # one row for each dimension
        self.d, self.n = len(found), found[0]["n"] if found else 0
        self.sums = [int(r["s"]) for r in found]
        spread = sum(self.n * int(r["q"]) - int(r["s"]) ** 2 for r in found)
        self.trace = spread / self.n**2 if self.n else 0.0

    def mean(self):
        import numpy as np

        return np.array([s / self.n for s in self.sums])

    def summed(self, product, width: int):
        """Sum over the rows of ``product(centred rows)``, an array of ``width`` columns."""
        import numpy as np

        d, mean = self.d, self.mean()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for batch in batches:
                if batch.num_rows:
                    part = product(_matrix(batch.column(0), d) - mean)
                    total = part if total is None else total + part
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), *[pa.array(c, pa.float64()) for c in total.T]], names)

        names = ["i", *[f"c{k}" for k in range(width)]]
        parts = self.rows.mapInArrow(run, ", ".join(["i int", *[f"c{k} double" for k in range(width)]]))
        rows = sorted(parts.groupBy("i").agg(*[F.sum(c).alias(c) for c in names[1:]]).collect())
        return np.array([list(r)[1:] for r in rows])

    def covariance_times(self, q):
        return self.summed(lambda x: x.T @ (x @ q), q.shape[1]) / self.n


def chebyshev(times, q, low: float, high: float, degree: int):
    """``q`` after the scaled Chebyshev polynomial that is small on [0, low] and one at ``high``."""
    centre, half = low / 2, low / 2
    first = half / (high - centre)
    ratio = first
    before, now = q, (times(q) - centre * q) * (ratio / half)
    for _ in range(degree - 1):
        after = 1 / (2 / first - ratio)
        before, now = now, (times(now) - centre * now) * (2 * after / half) - ratio * after * before
        ratio = after
    return now


def leading(fit: Fit, components: int = COMPONENTS, block: int = BLOCK, degree: int = DEGREE):
    """(eigenvalues, eigenvectors as columns) of the covariance, falling; those without variance are left out."""
    import numpy as np

    width = min(fit.d, block)
    q = np.linalg.qr(np.random.default_rng(13).standard_normal((fit.d, width)))[0]
    wanted, best = min(components, width), None
    values = vectors = None
    for _ in range(ROUNDS):
        product = fit.covariance_times(q)
        small = q.T @ product
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        vectors = q @ turn
        residual = float(np.linalg.norm(product @ turn - vectors * values, axis=0)[:wanted].max())
        if best is None or residual < best[0]:
            best, stuck = (residual, values, vectors), 0
        else:
            stuck += 1
        if residual <= CERTIFIED * max(values[0], 0) or stuck == 2 or width == fit.d:
            break
        low = max(float(values[-1]), FLAT * fit.trace)
        if low >= values[0]:
            break
        q = np.linalg.qr(chebyshev(fit.covariance_times, vectors, low, float(values[0]), degree))[0]
    _, values, vectors = best
    keep = [k for k in range(wanted) if values[k] > FLAT * fit.trace]
    return values[keep], vectors[:, keep]


def whitened(rows: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error for every usable row and component."""
    import numpy as np

    vectors = fixed_point(rows)
    fit = Fit(vectors, run_folder(rows.sparkSession, "fit"))
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if not fit.n or not fit.trace:
        return rows.sparkSession.createDataFrame([], schema)
    values, basis = leading(fit, components)
    scale = basis / np.sqrt(values)
    error = float(np.abs(fit.summed(lambda x: (x @ scale).T @ (x @ scale), len(values)) / fit.n - np.eye(len(values))).max())
    explained = [float(v) / fit.trace for v in values]
    d, n, mean, sums = fit.d, fit.n, fit.mean(), fit.sums

    def deviations(x) -> list[int | None]:
        # n x - S in whole numbers; Python's where 64 bits could overflow
        wide = n * max(int(np.abs(x).max()), 1) + max(map(abs, sums))
        if wide**2 * d < 2**63:
            return ((n * x - np.array(sums, np.int64)) ** 2).sum(axis=1).tolist()
        exact = ((n * x.astype(object) - np.array(sums, object)) ** 2).sum(axis=1)
        return [int(v) if v < 2**63 else None for v in exact]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, k = _matrix(batch.column(1), d), len(values)
            ids = batch.column(0).take(pa.array(np.repeat(np.arange(len(x)), k)))
            far = pa.array(deviations(x), pa.int64()).take(pa.array(np.repeat(np.arange(len(x)), k)))
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(np.tile(np.arange(1, k + 1), len(x)), pa.int32()), pa.array(np.full(len(ids), n), pa.int64()), far,
                 pa.array(((x - mean) @ scale).ravel()), pa.array(np.tile(explained, len(x))), pa.array(np.full(len(ids), error))],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return vectors.mapInArrow(run, schema)
