"""Operator 10, exact top-k search by inner product, over an impact-ordered index.

Vectors are dealt into shards. A shard's index has a list of vectors for each level of length, dimension
and sign: those whose largest component is there, in order of its impact. The lists are cut into segments,
each with the ends of every dimension's values and its greatest length, so that its impact on a query's score, the most
that a vector in it may reach, is known without its vectors. For a batch of queries segments come score at a
time: by descending impact, whatever the list. A segment is left out for the queries whose k best so far are
beyond its impact, and the batch ends when that holds for all. Scores are whole numbers that floats hold exactly;
what is too large for that is scored in Python's integers.

A shard's index is made once in its task, and the queries stream past it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SCALE, MOST = 256, 1.7976931348623157e308
#: Components and vectors of a shard at most, about; queries that pass one index; vectors of a segment; queries of a batch.
SHARD_VALUES, SHARD_ROWS, GROUP_QUERIES, SEGMENT, BATCH = 16_000_000, 262144, 131072, 512, 512
#: As long as shards are smaller than that, there are at most SHARDS of them and they have at least LEAST_ROWS vectors.
SHARDS, LEAST_ROWS = 64, 16384
#: Vectors of a length below this have inner products that floats hold exactly. Finds after which bars are set anew.
TAME, FINDS = 2.0**26, 2_000_000


def valid_vector(column: Column) -> Column:
    """Not null, and without null or non-finite components."""
    bad = F.exists(column, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return column.isNotNull() & ~F.coalesce(bad, F.lit(False))


def _matrix(column: pa.Array) -> object:
    """floor(SCALE * x) of list rows as floats, rows padded with zeros to the longest: an absent
    component adds nothing to an inner product. What is no double any more counts as the largest one."""
    import numpy as np

    lengths = np.asarray(column.value_lengths().fill_null(0))
    with np.errstate(over="ignore"):
        flat = np.clip(np.floor(SCALE * np.asarray(column.flatten(), float)), -MOST, MOST)
    if not len(lengths) or not lengths.max():
        return np.zeros((len(lengths), 1))
    if (lengths == lengths[0]).all():
        return flat.reshape(len(lengths), -1)
    out = np.zeros((len(lengths), lengths.max()))
    out[np.arange(out.shape[1]) < lengths[:, None]] = flat
    return out


class Index:
    """The segments of one shard: x[row, dimension] whole numbers as floats, ids of the rows (their places, if not given)."""

    def __init__(self, x, ids=None) -> None:  # noqa: ANN001
        import numpy as np

        ids = np.arange(len(x)) if ids is None else ids
        length = _lengths(x)
        tame = np.flatnonzero(length < TAME)
        length, place = length[tame], np.abs(x[tame]).argmax(1)
        top = x[tame, place]
        level = np.floor(4 * np.log2(np.maximum(length, 1)))
        # Equal vectors come in order of their ids, so that of equal scores the later ones are no finds.
        order = np.lexsort((ids[tame], -np.abs(top), top < 0, place, -level))
        self.rows, self.wild, self.source, self.ids = tame[order], np.flatnonzero(~(_lengths(x) < TAME)), x, ids
        kept = x[self.rows]
        self.x = kept.astype(np.float32) if np.abs(kept).max(initial=0) < 2**24 else kept
        self.starts = np.arange(0, len(kept), SEGMENT)
        if len(kept):
            self.low, self.high = (f.reduceat(kept, self.starts).astype(float) for f in (np.minimum, np.maximum))
            self.longest = np.maximum.reduceat(length[order], self.starts)
        #: Products of a vector with a query so far.
        self.products = 0

    def candidates(self, q, k: int):  # noqa: ANN001, ANN201
        """The rows of the shard that are the k best for q."""
        import numpy as np

        return self.best(q[None], np.full(1, np.iinfo(np.int64).min), k)[1]

    def best(self, qs, asked, k: int):  # noqa: ANN001, ANN201
        """Places of queries, rows and scores: for each of the queries its k best rows, ties to the smaller id,
        without those that have the query's own id, its place in asked."""
        import numpy as np

        tame = _lengths(qs) < TAME
        found = []
        # Queries with one largest component have the same segments of high impact.
        near = np.flatnonzero(tame)
        near = near[np.argsort(np.abs(qs[near]).argmax(1), kind="stable")]
        for some in (near[a : a + BATCH] for a in range(0, len(near) if len(self.rows) else 0, BATCH)):
            query, row, score = self._batch(qs[some], asked[some], k)
            found.append((some[query], row, score))
        for at in range(len(qs)) if len(self.wild) else np.flatnonzero(~tame).tolist():
            rest = self.wild if tame[at] else np.arange(len(self.source))
            rest = rest[self.ids[rest] != asked[at]]
            found.append((np.full(len(rest), at), rest, _exact(self.source[rest].astype(float), qs[at])))
        if not found:
            return tuple(np.zeros(0, np.int64) for _ in range(3))
        query, row, score = (np.concatenate(c) for c in zip(*found, strict=True))
        kept = _first(query, score, self.ids[row], k)[0]
        return query[kept], row[kept], score[kept]

    def _batch(self, qs, asked, k: int):  # noqa: ANN001, ANN202
        import numpy as np

        lengths = _lengths(qs)
        # No partial sum is beyond the product of two lengths.
        single = self.x.dtype == np.float32 and self.longest.max() * lengths.max() < 2**24
        kind = np.float32 if single else np.float64
        scaled, n = qs.astype(kind), len(qs)
        impacts = np.maximum(qs, 0) @ self.high.T + np.minimum(qs, 0) @ self.low.T
        reach = lengths[:, None] * self.longest
        impacts = np.minimum(impacts, reach) + 1e-9 * reach  # impacts are rounded, scores are not
        most = impacts.max(0)
        line = np.argsort(-most, kind="stable")
        bar, bar_id = np.full(n, -np.inf), np.full(n, np.iinfo(np.int64).max)
        held = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]

        def set_bars() -> None:
            query, row, score = (np.concatenate(c) for c in zip(*held, strict=True))
            kept, last = _first(query, score, self.ids[row], k)
            held[:] = [(query[kept], row[kept], score[kept])]
            bar[query[last]], bar_id[query[last]] = score[last], self.ids[row[last]]

        space, finds = np.empty(n * SEGMENT, kind), 0
        for step, s in enumerate(line.tolist(), 1):
            if most[s] < bar.min():
                break
            place = np.flatnonzero(impacts[:, s] >= bar)
            if not len(place):
                continue
            a = int(self.starts[s])
            rows = self.rows[a : a + SEGMENT]
            ids = self.ids[rows]
            sums = space[: len(place) * len(rows)].reshape(len(place), len(rows))
            np.matmul(scaled if len(place) == n else scaled[place], self.x[a : a + SEGMENT].astype(kind, copy=False).T, out=sums)
            self.products += sums.size
            if step == 1:
                head = np.where(ids == asked[place, None], -np.inf, sums)
                if head.shape[1] >= k:
                    bar[place] = np.partition(head, -k, axis=1)[:, -k]
            some = np.flatnonzero(sums.max(1) >= bar[place])
            hit = np.flatnonzero(sums[some] >= bar[place[some], None].astype(kind))
            at, column = np.divmod(hit, len(rows))
            query, score = place[some[at]], sums[some[at], column]
            new = (ids[column] != asked[query]) & ((score > bar[query]) | (ids[column] < bar_id[query]))
            held.append((query[new], rows[column[new]], score[new].astype(float)))
            finds += int(new.sum())
            if step & (step - 1) == 0 or finds > FINDS:
                set_bars()
                finds = 0
        set_bars()
        query, row, score = held[0]
        return query, row, score.astype(np.int64)


def _lengths(x):  # noqa: ANN001, ANN202
    """Of the rows of x; infinite where squares are beyond the floats."""
    import numpy as np

    with np.errstate(over="ignore"):
        return np.sqrt(np.einsum("ij,ij->i", x, x, dtype=float))


def _first(query, score, ids, k: int):  # noqa: ANN001, ANN202
    """Of finds those that are among the k best of their query; and those that are the k-th."""
    import numpy as np

    # ~ turns the order of whole numbers, and unlike - does so for the least one too.
    order = np.lexsort((ids, ~score if score.dtype.kind == "i" else -score, query))
    query = query[order]
    rank = np.arange(len(query)) - np.searchsorted(query, query)
    return order[rank < k], order[rank == k - 1]


def _exact(x, q):  # noqa: ANN001, ANN202
    """Inner products as Python's integers, held at the ends of the long range."""
    import numpy as np

    whole = x.astype(object)
    sums = [sum(int(a) * int(b) for a, b in zip(row, q, strict=True)) for row in whole]
    return np.array([min(max(s, -(2**63)), 2**63 - 1) for s in sums], np.int64)


def layout(n: int, queries: int, width: int) -> tuple[int, int]:
    """Shards of n vectors and groups of queries. Each group reads all vectors and each shard all queries, so both are few:
    up to SHARDS shards fill a cluster, and more only where one would be too large for a task."""
    most = max(1, min(SHARD_ROWS, SHARD_VALUES // max(1, width)))
    rows = min(most, max(LEAST_ROWS, -(-n // SHARDS)))
    return max(1, -(-n // rows)), max(1, -(-queries // GROUP_QUERIES))


def search(df: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id and score: for each row of queries the k rows of df with the
    highest inner products of floor(256 * x), ties to the smaller id.

    Rows with the query's own id are no candidates for it. Vectors that are null or hold null or
    non-finite components take no part; nor do null ids. Vectors of unequal lengths are compared
    as if padded with zeros. Rows of df that repeat an id are candidates each; of queries that
    repeat an id, that with the smallest vector is asked. A score beyond the range of long is its end.
    Other columns, whatever their names, are not read. An empty table of either gives an empty result.
    """
    def usable(rows: DataFrame) -> DataFrame:
        plain = dict(rows.dtypes)[vec_col] in ("array<float>", "array<double>")
        vec = F.col(vec_col) if plain else F.transform(F.col(vec_col), lambda x: x.cast("double"))
        return rows.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), vec.alias("vec")).where(valid_vector(F.col("vec")))

    every, asked = usable(df), usable(queries).groupBy("id").agg(F.min("vec").alias("vec"))
    n, width = every.agg(F.count(F.lit(1)), F.max(F.size("vec"))).first()
    shards, groups = layout(n, queries.where(F.col(id_col).isNotNull()).count(), width or 1)
    # Rows are dealt by place, not by id: one id that repeats cannot fill a shard. Only queries go to all shards.
    shard = F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), F.lit(shards)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    items = every.select(shard.alias("shard"), each(groups).alias("group"), F.lit(0).alias("asks"), "id", "vec")
    asks = asked.select(each(shards).alias("shard"), F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int").alias("group"), F.lit(1).alias("asks"), "id", "vec")
    rows = items.unionByName(asks).withColumn("tile", F.col("shard") * groups + F.col("group")).select("tile", "asks", "id", "vec")
    # A tile, a shard for one group, is a task's: by hash some tasks would have several and others none.
    rows = rows.repartitionById(min(shards * groups, 100_000), "tile").sortWithinPartitions("tile", "asks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        tile, parts, index = None, [], None
        for batch in batches:
            place = [np.asarray(c) for c in batch.columns[:2]]
            edges = [0, *(np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in place])) + 1).tolist(), batch.num_rows] if batch.num_rows else [0]
            for a, b in zip(edges, edges[1:]):  # noqa: B905
                own, values = np.asarray(batch.column(2).slice(a, b - a)), _matrix(batch.column(3).slice(a, b - a))
                if place[0][a] != tile:
                    tile, parts, index = place[0][a], [], None
                if place[1][a] == 0:
                    parts.append((own, values.astype(np.float32) if np.abs(values).max() < 2**24 else values))
                    continue
                if not parts and index is None:
                    continue  # a shard without rows
                if index is None:
                    most = max(m.shape[1] for _, m in parts)
                    index = Index(np.concatenate([np.pad(m, ((0, 0), (0, most - m.shape[1]))) for _, m in parts]), np.concatenate([i for i, _ in parts]))
                    parts = []
                # What a query has beyond the shard's longest vector meets nothing there.
                most = index.source.shape[1]
                values = np.pad(values, ((0, 0), (0, max(0, most - values.shape[1]))))[:, :most]
                query, row, score = index.best(values, own, k)
                yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in (own[query], index.ids[row], score)], names=["query_id", "vec_id", "score"])

    found = rows.mapInArrow(run, "query_id long, vec_id long, score long")
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
