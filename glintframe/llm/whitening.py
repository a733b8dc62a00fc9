"""PCA whitening of embeddings from a compensated covariance."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glintframe.llm.common import give_back, written

#: An entry c counts as the whole number floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 64, 1_000_000
#: Whole numbers beyond this size (entries beyond 7e13) count as this size.
LIMIT = float(1 << 52)
#: Bits of a slice of a double, and rows of a block: sums of a block's products of slices fit 53 bits.
SLICE_BITS, BLOCK_ROWS = 21, 1024
#: Rows of a matrix that travel together.
TILE = 64


def two_sum(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """a + b as a double and what its rounding lost, without an error."""
    s = a + b
    t = s - a
    return s, (a - (s - t)) + (b - t)


def dd_add(hi: np.ndarray, lo: np.ndarray, more: np.ndarray, less: np.ndarray | float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """The sum of two double-doubles, high and low parts apart."""
    s, e = two_sum(hi, more)
    t, f = two_sum(lo, less + np.zeros_like(more))
    s, e = two_sum(s, e + t)
    return two_sum(s, e + f)


def slices(c: np.ndarray) -> list[np.ndarray]:
    """c as a sum of matrices whose entries have SLICE_BITS bits each, counted from their
    column's largest entry, so that products of two slices add up exactly over
    BLOCK_ROWS rows. Three slices hold all but what lies 63 bits below that entry."""
    out, rest = [], c
    top = np.abs(c).max(axis=0, initial=0.0)
    _, power = np.frexp(top)
    for k in range(1, 4):
        unit = np.ldexp(1.0, np.maximum(power - SLICE_BITS * k, -1000))
        part = np.rint(rest / unit) * unit
        out.append(part)
        rest = rest - part
    return out


def outer_sums(c: np.ndarray, hi: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """hi + lo plus the sum of outer products of c's rows with themselves. The products
    of slices are matrix products that don't round; they enter the double-double
    sum from the largest to the smallest."""
    for at in range(0, len(c), BLOCK_ROWS):
        parts = slices(c[at : at + BLOCK_ROWS])
        for i, j in sorted(((i, j) for i in range(3) for j in range(3)), key=sum):
            hi, lo = dd_add(hi, lo, parts[i].T @ parts[j])
    return hi, lo


def _whole(values: np.ndarray) -> np.ndarray:
    return (np.clip(np.floor(SCALE * values.astype(np.float64)), -LIMIT, LIMIT) + SHIFT).astype(np.int64)


def _vectors(b: pa.RecordBatch, column: str, dim: int) -> np.ndarray:
    return b.column(column).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def usable(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, int]:
    """(id, vector) of the rows that remain, and their dimension: vectors that aren't null
    and hold no null or non-finite entry, of the size that most of these have (the
    greater one on ties). A vector of another size has no place in the fit."""
    v = F.col(vector_col).cast("array<double>")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    good = df.select(F.col(id_col).cast("long").alias("id"), v.alias("vector")).where(F.col("vector").isNotNull() & ~F.exists("vector", bad) & (F.size("vector") > 0))
    most = good.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    dim = most["d"] if most else 0
    return good.where(F.size("vector") == dim), dim


def column_sums(rows: DataFrame, dim: int, of, kind: str = "long") -> tuple[int, list]:
    """How many rows there are, and the sums of of(batch), a matrix with dim columns: each
    task adds up its own, dim + 1 numbers, and these are summed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, 0
        for b in batches:
            x = of(b)
            n, total = n + len(x), total + x.sum(axis=0)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(-1, dim), pa.int32()), pa.array([n, *total.tolist()], pa.int64() if kind == "long" else pa.float64())], names=["i", "v"])

    got = {r.i: r.v for r in rows.mapInArrow(give_back(run), f"i int, v {kind}").groupBy("i").agg(F.sum(F.col("v").cast("decimal(38,0)") if kind == "long" else "v").alias("v")).collect()}
    return int(got.get(-1, 0)), [got.get(i, 0) for i in range(dim)]


def compensated_covariance(rows: DataFrame, dim: int, of, n: int, fan_in: int = 32) -> tuple[np.ndarray, np.ndarray]:
    """The sum over rows of outer products of of(batch)'s centred rows, over n, as a
    double-double matrix (high, low).

    A task adds its rows' products up in a double-double matrix and sends it in strips
    of TILE rows. High and low parts of fan_in tasks at a time are merged, until one
    is left; what reaches the driver are dim x dim numbers, whatever the rows.
    """
    schema = "task int, strip int, hi array<double>, lo array<double>"

    def told(task: int, hi: np.ndarray, lo: np.ndarray, strips: list) -> dict:
        return pa.table({
            "task": pa.array([task] * len(strips), pa.int32()), "strip": pa.array(strips, pa.int32()),
            "hi": pa.array([x.ravel() for x in hi], pa.list_(pa.float64())), "lo": pa.array([x.ravel() for x in lo], pa.list_(pa.float64())),
        })

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hi, lo, task, held, some = np.zeros((dim, dim)), np.zeros((dim, dim)), 0, [], 0
        for b in batches:
            if len(b):
                task = b.column("task")[0].as_py()
                held.append(of(b))
                some += len(b)
            if some >= BLOCK_ROWS:
                hi, lo = outer_sums(np.concatenate(held), hi, lo)
                held, some = [], 0
        if held:
            hi, lo = outer_sums(np.concatenate(held), hi, lo)
        strips = range(0, dim, TILE)
        yield from told(task, [hi[k : k + TILE] for k in strips], [lo[k : k + TILE] for k in strips], list(range(len(strips)))).to_batches()

    def merge(group: pa.Table) -> pa.Table:
        hi = lo = None
        for a, b in zip(group.column("hi"), group.column("lo")):
            a, b = a.values.to_numpy(), b.values.to_numpy()
            hi, lo = (a.copy(), b.copy()) if hi is None else dd_add(hi, lo, a, b)
        return told(group.column("task")[0].as_py(), [hi], [lo], [group.column("strip")[0].as_py()])

    named = rows.withColumn("task", F.spark_partition_id())
    parts, left = named.mapInArrow(give_back(run), schema), rows.rdd.getNumPartitions()
    while True:
        left = -(-left // fan_in)
        parts = parts.withColumn("task", F.pmod("task", F.lit(left))).groupBy("task", "strip").applyInArrow(merge, schema)
        if left <= 1:
            break
        parts = written(parts, "covariance")
    got = sorted(parts.collect(), key=lambda r: r.strip)  # dim / TILE rows
    if not got:
        return np.zeros((dim, dim)), np.zeros((dim, dim))
    both = [np.concatenate([np.array(r[c]).reshape(-1, dim) for r in got]) for c in ("hi", "lo")]
    high = both[0] / n
    return high, (both[1] + _remainder(both[0], high, n)) / n


def _remainder(a: np.ndarray, q: np.ndarray, n: int) -> np.ndarray:
    """a - q * n, without an error where n has 26 bits at most, else nearly so."""
    split = q * 134217729.0
    top = split - (split - q)
    return (a - top * n) - (q - top) * n


def components(high: np.ndarray, low: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, float]:
    """(eigenvalues, unit eigenvectors as rows, trace) of the symmetric matrix high + low,
    by falling eigenvalue, `most` at most; those without variance, below what
    doubles can tell from 0, are left out. Each vector's largest entry is positive.

    The solver brings the matrix to tridiagonal form and solves that by divide and
    conquer (LAPACK's syevd, which is what numpy's eigh calls)."""
    v = high + low
    v = (v + v.T) / 2
    if not len(v):
        return np.zeros(0), np.zeros((0, 0)), 0.0
    values, vectors = np.linalg.eigh(v)
    values, vectors, trace = values[::-1], vectors.T[::-1], float(np.trace(v))
    count = int((values > len(v) * np.finfo(float).eps * max(values[0], 0.0)).sum()) if values[0] > 0 else 0
    values, vectors = values[: min(count, most)], vectors[: min(count, most)]
    sign = np.sign(vectors[np.arange(len(vectors)), np.abs(vectors).argmax(axis=1)]) if len(vectors) else np.zeros(0)
    return values, vectors * sign[:, None], trace


def _squares(d: np.ndarray) -> list:
    """Sums of squares of each row of whole numbers, exact; None beyond a long."""
    if not d.size or float(np.abs(d.astype(np.float64)).max()) ** 2 * d.shape[1] < 2.0**62:
        return (d * d).sum(axis=1).tolist()
    sums = [sum(int(x) ** 2 for x in row) for row in d.tolist()]
    return [s if s < 1 << 63 else None for s in sums]


def _apart(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - sums, whole numbers without an overflow."""
    most = max(int(np.abs(x).max(initial=0)), max((abs(s) // max(n, 1) for s in sums), default=0) + 1)
    if most * max(n, 1) * 2 < 1 << 62:
        return x * n - np.array(sums, dtype=np.int64)
    return x.astype(object) * n - np.array(sums, dtype=object)


def whiten(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", *, most: int = 32, fan_in: int = 32) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: for each
    row that remains (see usable), its coordinates on the first `most` principal
    components of all that remain, each divided by its standard deviation.

    Entries count as whole numbers (see SCALE), so that sums and each row's
    `deviation`, the sum over dimensions of (n * x - S)^2, are exact (null where it
    is beyond a long). The covariance is of exactly centred values, in double-double
    (see compensated_covariance); explained is a component's share of the
    variance. identity_error, in every row, is the largest entry by size of the
    whitened rows' own covariance less the identity, measured in a further pass
    over them by the same sums.

    Rows with a null id count like others; repeated rows count each. Components without
    variance aren't told: vectors that are all alike, or a single one, give no rows,
    as an empty table does. Other columns aren't read. The driver holds matrices of
    the vectors' dimension, no rows.
    """
    rows, dim = usable(df, id_col, vector_col)
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    none = df.sparkSession.createDataFrame([], schema)
    if not dim:
        return none
    whole = lambda b: _whole(_vectors(b, "vector", dim))
    n, sums = column_sums(rows, dim, whole)
    sums = [int(s) for s in sums]
    centred = lambda b: (_apart(whole(b), n, sums) / n).astype(np.float64)
    high, low = compensated_covariance(rows, dim, centred, n, fan_in)
    values, vectors, trace = components(high, low, most)
    if not len(values):
        return none
    k = len(values)
    turn = (vectors / np.sqrt(values)[:, None]).T
    white = lambda b: centred(b) @ turn
    _, total = column_sums(rows, k, white, "double")
    mean = np.array(total) / n
    high, low = compensated_covariance(rows, k, lambda b: white(b) - mean, n, fan_in)
    error = float(np.abs((high - np.eye(k)) + low).max())
    share = values / trace

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, len(b), BLOCK_ROWS):
                part = b.slice(at, BLOCK_ROWS)
                d = _apart(whole(part), n, sums)
                m = len(part)
                cols = [
                    pa.array(part.column("id")).take(pa.array(np.repeat(np.arange(m), k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n, dtype=np.int64)),
                    pa.array(_squares(d), pa.int64()).take(pa.array(np.repeat(np.arange(m), k))), pa.array(((d / n).astype(np.float64) @ turn).ravel()),
                    pa.array(np.tile(share, m)), pa.array(np.full(m * k, error)),
                ]
                yield pa.RecordBatch.from_arrays(cols, names=[c.split()[0] for c in schema.split(", ")])

    return rows.mapInArrow(give_back(run), schema)
