"""Operator 12, whitening of embeddings by merged singular value decompositions.

Each partition keeps the number of its vectors, their exact sums and the singular values and right vectors of
its centred rows, all of them. Two such states merge without loss: the scaled vectors of both, and one row for
the difference of their means, are decomposed again. States merge within tasks as blocks stream by, then FAN by FAN in rounds.
What is left is one state of the size of the dimensions squared, from which components and variances are read.

Components are whole numbers, floor(scale * c) + shift, so counts, sums and deviations are exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.llm.common import remove_table, write_table

SCALE, SHIFT = 1024, 100_000
#: States that one task merges; rows decomposed at a time.
FAN, ROWS = 16, 8192
STATE = "node long, n long, sums array<string>, basis array<double>"
LONG = 2**63 - 1


class Whitener(NamedTuple):
    """Of n vectors of `width` components: exact sums, unit components (a column each, by falling variance), and all variances."""

    n: int
    sums: list
    components: object
    variances: object


def usable(column: Column) -> Column:
    """Not null, and without null or non-finite entries."""
    bad = F.exists(column, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return column.isNotNull() & ~F.coalesce(bad, F.lit(False))


def _whole(column: pa.Array, width: int, scale: int, shift: int):  # noqa: ANN202
    """floor(scale * c) + shift of list rows, held in the range of long; as int64 or, for large ones, as Python's
    integers. Rows that are shorter than width go on with zeros for c."""
    import numpy as np

    lengths = np.asarray(column.value_lengths())
    flat = np.asarray(column.flatten(), np.float64)
    x = np.zeros((len(lengths), width))
    x[np.arange(width) < lengths[:, None]] = flat
    with np.errstate(over="ignore"):
        y = np.floor(x * scale)
    if not len(y) or np.abs(y).max() < 2**53:
        return y.astype(np.int64) + shift
    held = np.vectorize(lambda c: max(-LONG - 1, min(LONG, int(min(max(c, -(2.0**64)), 2.0**64)) + shift)), otypes=[object])
    return held(y)


def _centred(x, n: int, sums: list):  # noqa: ANN001, ANN202
    """x - sums / n, each entry rounded once; and n * x - sums, exact."""
    import numpy as np

    large = x.dtype == object or max([abs(s) for s in sums], default=0) + n * int(np.abs(x).max(initial=0)) >= 2**62
    d = n * x.astype(object) - np.array(sums, object) if large else n * x - np.array(sums, np.int64)
    return (d / n).astype(np.float64), d


def _scaled(rows):  # noqa: ANN001, ANN202
    """Singular values times right vectors, as many as rows or dimensions: the same inner products as rows."""
    import numpy as np

    if rows.shape[0] <= 1:
        return rows
    _, s, v = np.linalg.svd(rows, full_matrices=False)
    return s[:, None] * v


def _state(x):  # noqa: ANN001, ANN202
    import numpy as np

    sums = [int(s) for s in (x.astype(object) if x.dtype == object or len(x) * int(np.abs(x).max(initial=0)) >= 2**62 else x).sum(0)]
    return len(x), sums, _scaled(_centred(x, len(x), sums)[0])


def merged(a, b):  # noqa: ANN001, ANN201
    """The state (n, sums, basis) of two sets of vectors together. The row that is put below the bases holds what
    the difference of the two means adds to the inner products."""
    import numpy as np

    (n, sums, basis), (m, more, other) = a, b
    gap = np.array([(m * s - n * t) / (n * m) for s, t in zip(sums, more, strict=True)])
    rows = np.concatenate([basis, other, [gap * np.sqrt(n * m / (n + m))]])
    return n + m, [s + t for s, t in zip(sums, more, strict=True)], _scaled(rows)


def _row(node: int, state) -> pd.DataFrame:  # noqa: ANN001
    n, sums, basis = state
    return pd.DataFrame({"node": [node], "n": [n], "sums": [[str(s) for s in sums]], "basis": [basis.reshape(-1)]})


def _read(row):  # noqa: ANN001, ANN202
    import numpy as np

    sums = [int(s) for s in row.sums]
    return int(row.n), sums, np.asarray(row.basis, np.float64).reshape(-1, len(sums))


def fit_whitener(vectors: DataFrame, width: int, scale: int = SCALE, shift: int = SHIFT) -> Whitener | None:
    """The whitener of vectors (vec, usable arrays of double, none longer than width); None without any."""
    import numpy as np

    def states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = _state(_whole(batch.column(0).slice(at, ROWS), width, scale, shift))
                state = merged(state, part) if state else part
        if state:
            yield pa.RecordBatch.from_pandas(_row(TaskContext.get().partitionId(), state), preserve_index=False, schema=pa.schema([("node", pa.int64()), ("n", pa.int64()), ("sums", pa.list_(pa.string())), ("basis", pa.list_(pa.float64()))]))

    def merge(frame: pd.DataFrame) -> pd.DataFrame:
        state = None
        for row in frame.sort_values("node").itertuples():
            state = merged(state, _read(row)) if state else _read(row)
        return _row(int(frame["node"].iloc[0]) // FAN, state)

    level = write_table(vectors.select("vec").mapInArrow(states, STATE), "states")
    while (top := level.agg(F.max("node")).first()[0]):
        # One group is one node above: FAN states of which each has at most width * width numbers.
        above = write_table(level.withColumn("above", F.floor(F.col("node") / FAN)).groupBy("above").applyInPandas(merge, STATE), "states")
        remove_table(level)
        level = above
    if top is None:
        remove_table(level)
        return None
    n, sums, basis = _read(level.first())
    remove_table(level)
    _, s, v = np.linalg.svd(basis, full_matrices=False)
    return Whitener(n, sums, v.T, s * s / n)


def _products(vectors: DataFrame, project, k: int) -> object:  # noqa: ANN001
    """Covariance of the projected rows: counts, means and centred products of partitions, merged in pairs."""
    import numpy as np

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, mean, products = 0, np.zeros(k), np.zeros((k, k))
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = project(batch.column(0))[0]
            own, m = rows.mean(0), len(rows)
            gap = own - mean
            products += (rows - own).T @ (rows - own) + np.outer(gap, gap) * (n * m / (n + m))
            mean, n = mean + gap * (m / (n + m)), n + m
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()]), pa.array([n]), pa.array([mean]), pa.array([products.reshape(-1)])], names=["node", "n", "mean", "products"])

    def merge(frame: pd.DataFrame) -> pd.DataFrame:
        n, mean, products = 0, np.zeros(k), np.zeros((k, k))
        for row in frame.sort_values("node").itertuples():
            gap, m = np.asarray(row.mean) - mean, int(row.n)
            products = products + np.asarray(row.products).reshape(k, k) + np.outer(gap, gap) * (n * m / (n + m))
            mean, n = mean + gap * (m / (n + m)), n + m
        return pd.DataFrame({"node": [int(frame["node"].iloc[0]) // FAN], "n": [n], "mean": [mean], "products": [products.reshape(-1)]})

    schema = "node long, n long, mean array<double>, products array<double>"
    level = write_table(vectors.select("vec").mapInArrow(parts, schema), "products")
    while level.agg(F.max("node")).first()[0] > 0:
        above = write_table(level.withColumn("above", F.floor(F.col("node") / FAN)).groupBy("above").applyInPandas(merge, schema), "products")
        remove_table(level)
        level = above
    row = level.first()
    remove_table(level)
    return np.array(row.products).reshape(k, k) / row.n


def whiten(df: DataFrame, most: int = 8, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """A row for each usable vector and each of the first `most` components: id_col, component (from 1), n, deviation
    (exact; beyond the range of long its end), whitened, explained and identity_error, the largest entry, without its sign,
    of whitened's measured covariance minus the identity.

    Vectors that are null or hold null or non-finite entries go. Vectors shorter than the longest go on with entries
    of zero; entries too large are held in the range of long. Null and repeated ids and repeated rows stay, each with rows of its own. A component without variance (one
    vector, equal vectors) has whitened and explained 0. Equal variances leave the direction of their components
    open: one choice holds for all rows. Other columns, whatever their names, are not read; no usable vector, or
    only such without entries, gives an empty result. The state of a task has 8 bytes for each two dimensions.
    """
    import numpy as np

    vectors = df.select(F.col(id_col).cast("long").alias("id"), F.transform(F.col(vec_col), lambda x: x.cast("double")).alias("vec")).where(usable(F.col("vec")))
    schema = f"{id_col} long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    width = vectors.agg(F.max(F.size("vec"))).first()[0] or 0
    fitted = fit_whitener(vectors, width, scale, shift) if width else None
    if not fitted:
        return df.sparkSession.createDataFrame([], schema)
    n, sums, k = fitted.n, fitted.sums, min(most, width)
    total = float(fitted.variances.sum())
    # With fewer vectors than dimensions the rest of the components has no variance.
    variances = np.append(fitted.variances, np.zeros(k))[:k]
    flat = np.sqrt(variances) <= 64 * width * np.finfo(float).eps * np.sqrt(total)
    axes = np.concatenate([fitted.components, np.zeros((width, k))], axis=1)[:, :k] / np.where(flat, np.inf, np.sqrt(np.where(flat, 1, variances)))
    explained = np.where(flat, 0, variances / (total or 1))

    def project(column: pa.Array):  # noqa: ANN202
        rows, exact = _centred(_whole(column, width, scale, shift), n, sums)
        return rows @ axes, exact

    error = float(np.abs(_products(vectors, project, k) - np.eye(k)).max())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, exact = project(batch.column(1))
            small = exact.dtype != object and float(np.abs(exact).max(initial=0)) ** 2 * width < 2**62
            squares = (exact * exact).sum(1) if small else [min(int(s), LONG) for s in (exact.astype(object) ** 2).sum(1)]
            m = len(rows)
            ids = batch.column(0).take(pa.array(np.repeat(np.arange(m), k)))
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n, np.int64)), pa.array(np.repeat(np.array(squares, np.int64), k)), pa.array(rows.reshape(-1)), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error))],
                names=[id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return vectors.mapInArrow(run, schema)
