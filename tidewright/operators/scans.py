"""Recursions over the ordered rows of each key, by pieces that are computed side by side.

A key's rows are numbered and cut into chunks of so many rows. A chunk starts with copies of the rows before it on
which its first rows look back. Where a value also depends on all rows before, a chunk first gives what it does to a
state, as a few numbers (of an affine recursion its composed map, of a sum the sum, of a peak the peak); a small
ordered pass over these gives each chunk's own starting state; then all chunks are filled. So one key
with a third of all rows is many tasks' work, and no task holds more than a chunk.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.sources.scratch import scratch

#: Rows of a chunk.
CHUNK = 16_384
ARROW = {"double": pa.float64(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "string": pa.string()}


class Recurrence:
    """What scan() computes. inputs: the columns it reads; schema: those it adds; lookback: how many rows before a row
    it reads; levels: how many rounds it takes until a chunk's start is known (0: it only looks back)."""

    inputs: list[str] = []
    schema: str = ""
    lookback: int = 0
    levels: int = 1

    def least(self) -> int:
        """Rows that a key's first chunk needs for all states to have begun."""
        return self.lookback + 1

    def run(self, x: dict, halo: int, state):  # noqa: ANN001, ANN201
        """The new columns (arrays; NaN is null) of the rows of x from halo on, and the state after them. x: an array for each input;
        state: None at a key's first row."""
        raise NotImplementedError

    def summary(self, level: int, x: dict, halo: int, state):  # noqa: ANN001, ANN201
        """Numbers that say what a chunk other than the first does to the states of a level. state: its
        starting state as far as earlier levels know it."""
        return self.run(x, halo, self.neutral())[1]

    def follow(self, level: int, state, summary):  # noqa: ANN001, ANN201
        """The state after a chunk, from that before it and its summary."""
        return self.merge(state, summary)

    def known(self, level: int, before, state):  # noqa: ANN001, ANN201
        """A chunk's start after a level: what earlier levels knew, and the level's own state."""
        return state

    def neutral(self):  # noqa: ANN201
        raise NotImplementedError

    def merge(self, state, more):  # noqa: ANN001, ANN201
        raise NotImplementedError


def written(df: DataFrame, name: str) -> DataFrame:
    """df by way of the shared folder, where its lineage ends."""
    path = f"{scratch(df.sparkSession, name)}-{uuid.uuid4().hex[:6]}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, keys: list[str], order: list[str | Column], name: str = "__row") -> DataFrame:
    """df with the number of each row, from 0, among those of its key in order. Rows are dealt by ranges of key and
    order, so a key of many rows is in many tasks, and written. Rows equal in order are numbered as they come."""
    n, columns = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.columns
    places = [columns.index(k) for k in keys]
    extra = pa.schema([("__part", pa.int32()), (name, pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        part, last, count = TaskContext.get().partitionId(), None, 0
        for b in batches:
            if not b.num_rows:
                continue
            starts = _starts([b.column(i) for i in places], b.num_rows)
            if (key := tuple(b.column(i)[0].as_py() for i in places)) != last:
                count = 0
            at = np.arange(b.num_rows)
            first = np.zeros(b.num_rows, np.int64)
            first[starts] = starts
            rows = at - np.maximum.accumulate(first) + np.where(at < (starts[1] if len(starts) > 1 else b.num_rows), count, 0)
            last, count = (tuple(b.column(i)[b.num_rows - 1].as_py() for i in places), int(rows[-1]) + 1) if len(starts) > 1 else (key, count + b.num_rows)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(b.num_rows, part, np.int32)), pa.array(rows)], names=[*columns, *extra.names])

    full = ", ".join(f"`{c}` {t}" for c, t in df.dtypes) + f", __part int, `{name}` long"
    table = written(df.repartitionByRange(n, *keys, *order).sortWithinPartitions(*keys, *order).mapInArrow(run, full), "numbered")
    counts = table.groupBy(*keys, "__part").agg((F.max(name) + 1).alias("n"))
    before = F.sum("n").over(Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    # A part goes on with one key at most from the parts before it, so these are no more rows than parts.
    offsets = counts.withColumn("before", before).where("before > 0").select("__part", "before", *[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)])
    same = [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)]
    joined = table.join(F.broadcast(offsets.withColumnRenamed("__part", "__p")), [F.col("__part") == F.col("__p"), *same], "left")
    return joined.select(*columns, (F.col(name) + F.coalesce("before", F.lit(0))).alias(name))


def _starts(columns: list, n: int):  # noqa: ANN202
    """Where runs of equal keys start in a batch."""
    import numpy as np

    new = np.zeros(n, bool)
    new[0] = True
    for column in columns:
        codes = column.dictionary_encode().indices.to_numpy(zero_copy_only=False) if column.null_count == 0 else np.asarray(column.dictionary_encode().indices.fill_null(-1))
        new[1:] |= codes[1:] != codes[:-1]
    return np.flatnonzero(new)


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.RecordBatch]:
    """Rows of each key (the first columns), which come together."""
    parts, last = [], None
    for b in batches:
        if not b.num_rows:
            continue
        starts = _starts(b.columns[:keys], b.num_rows).tolist()
        for i, j in zip(starts, [*starts[1:], b.num_rows], strict=True):
            key = tuple(b.column(k)[i].as_py() for k in range(keys))
            if key != last and parts:
                yield pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
                parts = []
            last = key
            parts.append(b.slice(i, j - i))
    if parts:
        yield pa.Table.from_batches(parts).combine_chunks().to_batches()[0]


def scan(df: DataFrame, keys: list[str], order: list[str | Column], recurrence: Recurrence, rows: int = CHUNK) -> DataFrame:
    """df with the columns of the recurrence. Its rows are in total order within a key, or equal ones may come in
    any order. Keys of at most `rows` rows are one chunk each, and if there are no others they are not numbered."""
    columns, r, partitions = df.columns, recurrence, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if rows < r.least():
        raise ValueError(f"chunks of {rows} rows are too short: {r.least()} at least")
    df = written(df, "rows")  # what makes the rows runs once
    largest = df.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    if largest <= rows:
        flat = df.withColumns({"__chunk": F.lit(0).cast("long"), "__own": F.lit(True), "__state": F.lit(None).cast("binary")})
        sort = list(order)
    else:
        row, at = F.col("__row"), F.floor(F.col("__row") / rows)
        both = F.when(row % rows >= rows - r.lookback, F.array(at, at + 1)).otherwise(F.array(at)) if r.lookback else F.array(at)
        flat = numbered(df, keys, order).withColumn("__chunk", F.explode(both)).withColumns({"__own": F.col("__chunk") == at, "__state": F.lit(None).cast("binary")})
        sort = ["__row"]
    data = [*keys, "__chunk", "__own", "__state", *([] if largest <= rows else ["__row"])]

    def chunks(starts: DataFrame | None, wanted: list[str]) -> DataFrame:
        own = flat.select(*data, *[F.col(c) for c in wanted if c not in keys])
        if starts is not None:  # a chunk's state comes first among its rows
            own = own.unionByName(starts.withColumns({"__row": F.lit(-1).cast("long"), "__own": F.lit(False)}), allowMissingColumns=True)
        # A stated number of parts: left to itself, Spark would put a few MB of rows into one task, whatever their work.
        return own.repartition(partitions, *keys, "__chunk").sortWithinPartitions(*keys, "__chunk", *sort)

    def opened(group: pa.RecordBatch):  # noqa: ANN202
        import numpy as np

        state = group.column(len(keys) + 2)[0].as_py()  # as bytes: an array column of nulls takes seconds to hand over
        body, state = (group, None) if state is None else (group.slice(1), np.frombuffer(state))
        own = body.column(len(keys) + 1).to_numpy(zero_copy_only=False)
        x = {c: body.column(body.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in r.inputs}
        return body, int(own.argmax()) if own.any() else len(own), x, state

    kinds = dict(df.dtypes)
    key_types = ", ".join(f"`{k}` {kinds[k]}" for k in keys)

    def round_of(level: int):  # noqa: ANN202
        def summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            import numpy as np

            for group in _groups(batches, len(keys) + 1):
                body, halo, x, state = opened(group)
                if halo == body.num_rows:
                    continue  # copies for a chunk that is not there
                first = body.column(len(keys))[0].as_py() == 0
                found = r.run(x, 0, None)[1] if first else r.summary(level, x, halo, state)
                yield pa.RecordBatch.from_arrays([*[body.column(k).slice(0, 1) for k in range(len(keys) + 1)], pa.array([np.asarray(found, float)])], names=[*keys, "__chunk", "__summary"])

        def follow(frame: pd.DataFrame) -> pd.DataFrame:
            import numpy as np

            frame, out, state = frame.sort_values("__chunk"), [], None
            known = frame["__state"].tolist()
            for i, summary in enumerate(frame["__summary"]):
                if i:
                    out.append(state if level == 0 else r.known(level, np.frombuffer(known[i]), state))
                state = np.array(summary) if state is None else r.follow(level, state, np.array(summary))
            return pd.DataFrame({**{k: frame[k].iloc[1:].tolist() for k in keys}, "__chunk": frame["__chunk"].iloc[1:].tolist(), "__state": [np.asarray(s, float).tobytes() for s in out]}, columns=[*keys, "__chunk", "__state"])

        return summaries, follow

    starts = None
    for level in range(r.levels if largest > rows else 0):
        summaries, follow = round_of(level)
        schema = f"{key_types}, __chunk long, __summary array<double>"
        maps = written(chunks(starts, r.inputs).mapInArrow(summaries, schema), "summaries")
        maps = maps.withColumn("__state", F.lit(None).cast("binary")) if starts is None else maps.join(starts, [*keys, "__chunk"], "left")
        starts = written(maps.groupBy(*keys).applyInPandas(follow, f"{key_types}, __chunk long, __state binary"), "starts")

    kinds_new = [(x.split()[0], x.split()[1]) for x in r.schema.split(", ")]

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for group in _groups(batches, len(keys) + 1):
            body, halo, x, state = opened(group)
            if halo == body.num_rows:
                continue
            found = r.run(x, halo, state)[0]
            out = []
            for c, kind in kinds_new:
                whole = np.asarray(found[c])
                nan = np.isnan(whole) if whole.dtype.kind == "f" else None
                out.append(pa.array(whole, mask=nan, from_pandas=whole.dtype.kind == "O").cast(ARROW[kind]))
            own = body.slice(halo)
            yield pa.RecordBatch.from_arrays([*[own.column(own.schema.get_field_index(c)) for c in columns], *out], names=[*columns, *[c for c, _ in kinds_new]])

    full = ", ".join(f"`{c}` {t}" for c, t in df.dtypes) + ", " + r.schema
    return chunks(starts, columns).mapInArrow(fill, full)
