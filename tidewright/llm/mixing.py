"""Operator 4, mixing sources to target weights by Pfair scheduling.

The documents of a source are dealt into blocks in a seeded order. Slot t of the mix holds one
block. A source of weight w has to get its block j (from 0) between the slots floor(j / w) and
ceil((j + 1) / w): its release time and its deadline. Each slot goes to the released block with
the earliest deadline, so that at every slot the number of blocks a source has had is less than
one away from w times the slots (Baruah, Cohen, Plaxton and Varvel 1996; on one resource earliest
deadline first is enough).

Weights are taken as exact fractions: a float is the fraction that it stores. The slots are computed
in ranges side by side. A range starts its count some slots early, from any state in which every
source is less than a block off: jobs that are due after those slots have all been served in their
order by then, whatever the start, so that from the range's own first slot on the schedule is the one
that a count from slot 0 would give. How early follows from the smallest weight.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from fractions import Fraction

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewright.llm.common import stable, write_table

BLOCK_DOCS = 32
#: Slots that a task computes at least.
RANGE = 20_000
#: Rows of one source that a task orders together, about.
ROWS_A_BUCKET = 20_000


def by_name(sources) -> list:  # noqa: ANN001
    """Sources in order, null before all."""
    return sorted(sources, key=lambda s: (s is not None, s or ""))


def exact_shares(weights: dict) -> dict:
    """Weights as whole numbers in exactly the same proportion."""
    exact = {s: Fraction(w) for s, w in weights.items()}
    if any(w <= 0 for w in exact.values()):
        raise ValueError("weights have to be positive")
    unit = math.lcm(*(w.denominator for w in exact.values())) if exact else 1
    whole = {s: int(w * unit) for s, w in exact.items()}
    shared = math.gcd(*whole.values()) if whole else 1
    return {s: w // shared for s, w in whole.items()}


def lead(shares: list[int]) -> int:
    """Slots by which a range has to start early."""
    return -(-sum(shares) // min(shares)) + 2


def pfair_slots(shares: list[int], start: int, end: int) -> Iterator[tuple[int, int, int]]:
    """(slot, number of the source, its block) for the slots [start, end) of the whole schedule.
    Earliest deadline first; ties go to the source that comes first."""
    total = sum(shares)
    early = max(0, start - lead(shares))
    done = [early * a // total for a in shares]
    # As many blocks as slots: what the floors leave goes to sources that are amid a block.
    amid = [i for i, a in enumerate(shares) if early * a % total]
    for i in amid[: early - sum(done)]:
        done[i] += 1
    waiting = [(j * total // a, -(-(j + 1) * total // a), i, j) for i, (a, j) in enumerate(zip(shares, done, strict=True))]
    ready: list[tuple[int, int, int]] = []
    heapq.heapify(waiting)
    for slot in range(early, end):
        while waiting and waiting[0][0] <= slot:
            heapq.heappush(ready, heapq.heappop(waiting)[1:])
        _, i, j = heapq.heappop(ready)
        if slot >= start:
            yield slot, i, j
        a, j = shares[i], j + 1
        heapq.heappush(waiting, (j * total // a, -(-(j + 1) * total // a), i, j))


def schedule(spark: SparkSession, shares: dict, blocks: dict, least: int = RANGE) -> DataFrame:
    """s, j, release, deadline and slot of the first blocks[s] blocks of each source s of shares."""
    order = by_name(shares)
    own, have, total = [shares[s] for s in order], [blocks[s] for s in order], sum(shares.values())
    slots = max((-(-n * total // a) for n, a in zip(have, own, strict=True)), default=0)
    # A range is several times as long as the slots before it that its task computes for its start.
    step = max(least, 4 * lead(own)) if own else 1

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        def table(rows: list) -> pd.DataFrame:
            return pd.DataFrame([(order[i], j, j * total // own[i], -(-(j + 1) * total // own[i]), slot) for slot, i, j in rows], columns=["s", "j", "release", "deadline", "slot"])

        for batch in batches:
            for k in batch["id"]:
                rows = []
                for row in pfair_slots(own, int(k) * step, min(slots, (int(k) + 1) * step)):
                    if row[2] < have[row[1]]:
                        rows.append(row)
                        if len(rows) >= 50_000:
                            yield table(rows)
                            rows = []
                yield table(rows)

    ranges = -(-slots // step)
    return spark.range(0, ranges, 1, max(1, min(ranges, 10_000))).mapInPandas(run, "s string, j long, release long, deadline long, slot long")


def whole_shares(weights: dict, period: int) -> dict:
    """Weights as numbers of slots of a period, at least 1 each, by largest remainders; ties go to
    the source that sorts first (null before all)."""
    order = sorted(weights, key=lambda s: (s is not None, s or ""))
    if not order:
        return {}
    period, total = max(period, len(order)), sum(weights.values())
    spare = period - len(order)
    exact = {s: spare * weights[s] / total for s in order}
    shares = {s: 1 + int(exact[s]) for s in order}
    for s in sorted(order, key=lambda s: -(exact[s] % 1))[: period - sum(shares.values())]:
        shares[s] += 1
    return shares


def pfair_period(shares: dict) -> list[tuple]:
    """One period as rows (source, place of the block in the period, release, deadline, slot).
    Earliest deadline first; ties go to the source that sorts first."""
    order = sorted(shares, key=lambda s: (s is not None, s or ""))
    period = sum(shares.values())
    due = lambda i, j: (-(-(j + 1) * period // shares[order[i]]), i, j)
    waiting, ready, out = [(0, *due(i, 0)) for i in range(len(order))], [], []
    heapq.heapify(waiting)
    for slot in range(period):
        while waiting and waiting[0][0] <= slot:
            heapq.heappush(ready, heapq.heappop(waiting)[1:])
        deadline, i, j = heapq.heappop(ready)
        out.append((order[i], j, j * period // shares[order[i]], deadline, slot))
        if j + 1 < shares[order[i]]:
            heapq.heappush(waiting, ((j + 1) * period // shares[order[i]], *due(i, j + 1)))
    return out


def shuffle_key(id_col: str, seed: int) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))


def mix(df: DataFrame, weights: dict | None = None, id_col: str = "doc_id", source_col: str = "source", block_docs: int = BLOCK_DOCS, period: int | None = None, seed: int = 0, temperature: float = 0.5) -> DataFrame:
    """One row per row of df: id_col, source_col, place (number in the source's order), block,
    release, deadline and slot of its block, and position, by which the mix is ordered.

    Without weights, a source's weight is its number of rows to the power `temperature`. Sources
    that weights doesn't name get the smallest weight named. Weights are kept exactly, unless the caller
    asks by `period` for whole_shares() of that many slots instead. A null source is a source of its own;
    null and repeated ids are ordered like others, ties in order of the rows of a plain read (what is no plain
    read is written first). An empty table gives an empty result. Every row has a place:
    after a source's last block its slots stay empty, and the bound of one block holds for the
    slots before the first source ends.
    """
    docs = stable(df, F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"))
    placed = _placed(docs, weights, block_docs, period, seed, temperature)
    return placed.drop("rid").withColumnsRenamed({"id": id_col, "source": source_col})


def _placed(docs: DataFrame, weights: dict | None = None, block_docs: int = BLOCK_DOCS, period: int | None = None, seed: int = 0, temperature: float = 0.5) -> DataFrame:
    """mix() for documents (rid, id, source), with rid."""
    rows = docs.select("rid", "id", "source", shuffle_key("id", seed).alias("key"))
    # A few digits of the key split each source into buckets; offsets of buckets come from counts.
    rows = write_table(rows, "mixing")
    counts = {r["source"]: r["n"] for r in rows.groupBy("source").agg(F.count(F.lit(1)).alias("n")).collect()}
    digits = 1
    while max(counts.values(), default=0) > ROWS_A_BUCKET * 16**digits:
        digits += 1
    bucket = F.substring("key", 1, digits)
    sizes = rows.groupBy("source", bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select(F.col("source").alias("s"), F.col("bucket").alias("b"), before.alias("start"))
    ranked = rows.select("*", bucket.alias("bucket")).withColumn("rank", F.row_number().over(Window.partitionBy("source", "bucket").orderBy("key", "id", "rid")) - 1)
    placed = ranked.join(starts, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b"))).select("rid", "id", "source", (F.col("start") + F.col("rank")).alias("place"))

    least = min((weights or {}).values(), default=1)
    target = {s: (weights.get(s, least) if weights else n**temperature) for s, n in counts.items()}
    shares = whole_shares(target, period) if period else exact_shares(target)
    timed = schedule(docs.sparkSession, shares, {s: -(-n // block_docs) for s, n in counts.items()})
    blocks = placed.withColumn("block", F.floor(F.col("place") / block_docs)).join(timed, F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("j")))
    return blocks.select(
        "rid", "id", "source", "place", "block", "release", "deadline", "slot", (F.col("slot") * block_docs + F.col("place") % block_docs).alias("position"),
    )


def in_mixed_order(df: DataFrame, id_col: str = "doc_id", source_col: str = "source", **how) -> DataFrame:
    """All rows of df with its columns, whatever their names, sorted by their position in the mix."""
    rows = stable(df, F.struct(*[F.col(c) for c in df.columns]).alias("row"))
    docs = rows.select("rid", F.col("row")[id_col].alias("id"), F.col("row")[source_col].cast("string").alias("source"))
    return rows.join(_placed(docs, **how).select("rid", "position"), "rid").sort("position").select("row.*")
