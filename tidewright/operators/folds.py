"""Recursions over each key's rows in order, on arrays: rows stream through their task, and a key's state
is carried from batch to batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame

#: A step takes a run of one key's rows, a dict of arrays, and gives arrays of as many new values; NaN is null.
Step = Callable[[dict], dict]


def array_fold(df: DataFrame, keys: list[str], order: list[str | Column], start: Callable[[], Step], inputs: list[str], schema: str) -> DataFrame:
    """df with the columns of schema, which start()'s step makes of the inputs. Strings among the inputs
    come as arrays of objects."""
    names = [x.split()[0] for x in schema.split(",")]
    kinds = {x.split()[0]: x.split()[1] for x in schema.split(",")}
    full = ", ".join(f"`{n}` {t}" for n, t in df.dtypes) + ", " + schema
    columns = df.columns
    places, key_places = {c: columns.index(c) for c in inputs}, [columns.index(k) for k in keys]
    arrow = {"double": pa.float64(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "string": pa.string()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        last, step = None, None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            values = {c: batch.column(i).to_numpy(zero_copy_only=False) for c, i in places.items()}
            new = np.zeros(n, bool)
            for i in key_places:
                column = batch.column(i).to_numpy(zero_copy_only=False)
                new[1:] |= column[1:] != column[:-1]
            edges = [0, *np.flatnonzero(new).tolist(), n]
            parts: dict[str, list] = {c: [] for c in names}
            for a, b in zip(edges, edges[1:]):  # noqa: B905
                key = tuple(batch.column(i)[a].as_py() for i in key_places)
                if key != last:
                    last, step = key, start()
                found = step({c: v[a:b] for c, v in values.items()})
                for c in names:
                    parts[c].append(found[c])
            out = []
            for c in names:
                whole = np.concatenate(parts[c])
                mask = np.isnan(whole) if whole.dtype.kind == "f" else None
                out.append(pa.array(whole, arrow[kinds[c]], mask=mask, from_pandas=whole.dtype.kind == "O") if kinds[c] in ("double", "string") else pa.array(whole).cast(arrow[kinds[c]]))
            yield pa.RecordBatch.from_arrays([*batch.columns, *out], names=[*columns, *names])

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, full)
