"""Populations of candidates: ranks of Pareto fronts, elites, diverse choices and Gower distances."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.operators.scans import written
from tidewright.operators.screening import Staircase


def elites(scored: DataFrame, k: int, key: str = "run_id") -> DataFrame:
    """The k rows of the highest score, ties by key: each task sends k rows at most."""
    return scored.orderBy(F.desc("score"), key).limit(k)


def pareto_ranks(rows: DataFrame, objectives: list[str], by: str = "generation", key: str = "run_id") -> DataFrame:
    """by, key and pareto_rank: 0 for rows of a population that none dominates, 1 for those that only rank 0
    dominates, and so on (all objectives maximised).

    A population's rows stream through its task from the largest first objective on, so that a row's
    dominators come before it. What is held of each front is its Staircase; the first front that has no dominator of
    a row is found by halving, as fronts before one with a dominator have one too. Rows equal in all objectives share
    a rank; NaN and null compare with nothing, so such rows have rank 0."""
    kinds = dict(rows.dtypes)
    values = [f"o{i}" for i in range(len(objectives))]
    own = rows.select(by, key, *[F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))).alias(v) for v, c in zip(values, objectives, strict=True)])

    def rank(batches):  # noqa: ANN001, ANN202
        now, fronts, last = None, [], (None, 0)
        for batch in batches:
            out = []
            for group, *x in zip(batch[by], *(batch[v].tolist() for v in values), strict=True):
                if group != now:
                    now, fronts, last = group, [], (None, 0)
                if any(v != v for v in x):
                    out.append(0)
                    continue
                if x != last[0]:
                    low, high = 0, len(fronts)
                    while low < high:
                        middle = (low + high) // 2
                        low, high = (middle + 1, high) if fronts[middle].dominates(x[1:]) else (low, middle)
                    if low == len(fronts):
                        fronts.append(Staircase())
                    fronts[low].add(x[1:])
                    last = (x, low)
                out.append(last[1])
            yield batch[[by, key]].assign(pareto_rank=out)

    ordered = own.repartition(by).sortWithinPartitions(by, *[F.desc(v) for v in values])
    return ordered.mapInPandas(rank, f"`{by}` {kinds[by]}, `{key}` {kinds[key]}, pareto_rank int")


def diverse(scored: DataFrame, features: list[str], k: int = 5, distance: float = 0.15, by: str = "generation", key: str = "run_id") -> DataFrame:
    """by, key, score and place: per population up to k rows by falling score (ties by key), each at least
    `distance` from all taken before it. features are numbers scaled to 0..1; a distance is the mean of
    their differences. A population's rows stream through its task; only those taken are held."""
    kinds = dict(scored.dtypes)
    sorted_ = scored.select(by, key, F.col("score").cast("double").alias("score"), *[F.col(c).cast("double").alias(f"f{i}") for i, c in enumerate(features)]).repartition(by).sortWithinPartitions(by, F.desc("score"), key)

    def choose(batches):  # noqa: ANN001, ANN202
        import numpy as np
        import pandas as pd

        now, taken = None, []
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                if row[0] != now:
                    now, taken = row[0], []
                if len(taken) < k:
                    x = np.array(row[3:])
                    if all(np.abs(x - y).mean() >= distance for y in taken):
                        taken.append(x)
                        out.append((row[0], row[1], row[2], len(taken)))
            yield pd.DataFrame(out, columns=[by, key, "score", "place"])

    return sorted_.mapInPandas(choose, f"`{by}` {kinds[by]}, `{key}` {kinds[key]}, score double, place int")


#: Rows of a block of groups_of_near, which the driver decides.
BLOCK = 4096


def groups_of_near(scored: DataFrame, features: list[str], kinds: list[str] = (), distance: float = 0.15, key: str = "run_id", block: int = BLOCK) -> DataFrame:
    """key, score and founder. Rows are taken by falling score, ties by key: one joins the first founder that is nearer than
    `distance`, and founds a group of its own where none is. A distance is the mean over features (numbers scaled to
    0..1) of their differences and over kinds of whether they differ; one with a null or NaN feature is near nothing.

    The founders are the first maximal independent set in that order. A round takes the next `block` undecided rows,
    finds the founders among them, and sends these to all undecided rows, each of which joins the first that is near: no
    founder of a later round comes before it. So a round decides a block and all that is near to it, and no pairs are made."""
    types = dict(scored.dtypes)
    x = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))) for c in features])
    left = written(scored.select(key, F.col("score").cast("double").alias("score"), x.alias("x"), F.array(*[F.col(c).cast("string") for c in kinds]).alias("k")), "undecided")
    parts, done = len(features) + len(kinds), None
    while head := left.orderBy(F.desc("score"), key).limit(block).collect():
        names, numbers, words = _founders([(r[key], r["x"], r["k"]) for r in head], parts, distance)

        def place(batches, names=names, numbers=numbers, words=words):  # noqa: ANN001, ANN202
            import numpy as np

            for b in batches:
                xs = np.array(b["x"].tolist(), float).reshape(len(b), -1)
                ks = np.array(b["k"].tolist(), object).reshape(len(b), -1)
                found, open_ = np.full(len(b), None, object), np.arange(len(b))
                own = b[key].tolist()
                founds = {name: i for i, name in enumerate(names)}
                for i, name in enumerate(names):
                    near = (np.abs(xs[open_] - numbers[i]).sum(1) + (ks[open_] != words[i]).sum(1)) / parts < distance
                    found[open_[near]] = name
                    open_ = open_[~near]
                for j in open_.tolist():  # a founder without all its features is not even near itself
                    found[j] = own[j] if own[j] in founds else None
                yield b[[key, "score", "x", "k"]].assign(founder=found)

        table = written(left.mapInPandas(place, f"`{key}` {types[key]}, score double, x array<double>, k array<string>, founder {types[key]}"), "placed")
        more = table.where("founder IS NOT NULL").select(key, "score", "founder")
        done = more if done is None else done.unionByName(more)
        left = table.where("founder IS NULL").drop("founder")
    return done if done is not None else left.select(key, "score", F.col(key).alias("founder"))


def _founders(rows: list[tuple], parts: int, distance: float) -> tuple:
    """Names, features and kinds of the rows, in order, that no founder before them is near to."""
    import numpy as np

    xs = np.array([r[1] for r in rows], float).reshape(len(rows), -1)
    ks = np.array([r[2] for r in rows], object).reshape(len(rows), -1)
    free, chosen = np.ones(len(rows), bool), []
    for i in range(len(rows)):
        if free[i]:
            chosen.append(i)
            free[i + 1 :] &= ~((np.abs(xs[i + 1 :] - xs[i]).sum(1) + (ks[i + 1 :] != ks[i]).sum(1)) / parts < distance)
    return [rows[i][0] for i in chosen], xs[chosen], ks[chosen]


#: Weights of a gene's parts (indicator, condition, threshold, parameters) and of a chromosome's (genes,
#: direction, stop, target); fixed values, as is the range of thresholds of unknown indicators.
GENE_WEIGHTS, CHROMOSOME_WEIGHTS, THRESHOLD_RANGE = (2.0, 1.0, 1.0, 1.0), (3.0, 1.0, 0.5, 0.5), 100.0


def _looked_up(ranges: dict[str, float], name: Column, otherwise: float) -> Column:
    out = F.lit(otherwise)
    for k, v in ranges.items():
        out = F.when(name == k, F.lit(float(v))).otherwise(out)
    return out


def gene_distance(a: Column, b: Column, threshold_ranges: dict[str, float] | None = None, parameter_ranges: dict[str, dict[str, tuple[float, float]]] | None = None) -> Column:
    """Gower distance in 0..1 of two genes (indicator, condition, threshold, parameters map). Of different
    indicators thresholds and parameters count as far apart as can be; an indicator without known
    parameter ranges counts half for these."""
    wi, wc, wt, wp = GENE_WEIGHTS
    same = a["indicator"] == b["indicator"]
    threshold = F.least(F.lit(1.0), F.abs(a["threshold"] - b["threshold"]) / _looked_up(threshold_ranges or {}, a["indicator"], THRESHOLD_RANGE))
    parameters = F.lit(0.5)
    for name, ranges in (parameter_ranges or {}).items():
        parts = [F.abs(F.coalesce(a["parameters"][p], F.lit(low)) - F.coalesce(b["parameters"][p], F.lit(low))) / (high - low) if high > low else F.lit(0.0) for p, (low, high) in ranges.items()]
        if parts:
            parameters = F.when(a["indicator"] == name, sum(parts[1:], parts[0]) / len(parts)).otherwise(parameters)
    differs = lambda x: F.when(x, 0.0).otherwise(1.0)
    total = differs(same) * wi + differs(a["condition"] == b["condition"]) * wc + F.when(same, threshold).otherwise(1.0) * wt + F.when(same, parameters).otherwise(1.0) * wp
    return total / sum(GENE_WEIGHTS)


def chromosome_distance(a: Column, b: Column, gene: Callable[[Column, Column], Column] = gene_distance, stop_range: float = 1.0, target_range: float = 1.0) -> Column:
    """Gower distance in 0..1 of two chromosomes (entry and exit genes, direction, stop, target). Genes are
    compared by place; a missing one is as far as can be. LONG and SHORT are 1 apart, BOTH 1/2 from either."""
    pair = lambda x, y: F.when(x.isNull() | y.isNull(), 1.0).otherwise(gene(x, y))
    parts = F.concat(*[F.zip_with(a[side], b[side], pair) for side in ("entry", "exit")])
    genes = F.when(F.size(parts) > 0, F.aggregate(parts, F.lit(0.0), lambda s, x: s + x) / F.greatest(F.size(parts), F.lit(1))).otherwise(0.0)
    one_is_both = (a["direction"] == "BOTH") | (b["direction"] == "BOTH")
    direction = F.when(a["direction"] == b["direction"], 0.0).when(one_is_both, 0.5).otherwise(1.0)
    wg, wd, ws, wt = CHROMOSOME_WEIGHTS
    total = genes * wg + direction * wd + F.abs(a["stop"] - b["stop"]) / stop_range * ws + F.abs(a["target"] - b["target"]) / target_range * wt
    return F.least(F.lit(1.0), total / sum(CHROMOSOME_WEIGHTS))


def entropy(rows: DataFrame, loci: list[str]) -> DataFrame:
    """One row: the mean over loci of Shannon's entropy of their values, in parts of the largest that so
    many values can have (0 for a single value). Each locus is counted apart, by one grouping of all."""
    each = rows.select(F.explode(F.array(*[F.struct(F.lit(c).alias("locus"), F.col(c).cast("string").alias("value")) for c in loci])).alias("x")).select("x.*")
    counts = each.groupBy("locus", "value").agg(F.count(F.lit(1)).alias("c"))
    totals = counts.groupBy("locus").agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.log2("c")).alias("s"), F.count(F.lit(1)).alias("k"))
    own = F.when(F.col("k") > 1, (F.log2("n") - F.col("s") / F.col("n")) / F.log2(F.greatest("k", F.lit(2)))).otherwise(0.0)
    return totals.agg(F.avg(own).alias("entropy"))


def chromosome_json(rows: DataFrame, columns: list[str], name: str = "genome") -> DataFrame:
    """rows with the columns as one JSON text."""
    return rows.withColumn(name, F.to_json(F.struct(*columns)))


def from_chromosome_json(rows: DataFrame, schema: str, name: str = "genome") -> DataFrame:
    """rows with the fields of the JSON text as columns again; null where it does not parse."""
    return rows.withColumn("__x", F.from_json(name, schema)).select(*[c for c in rows.columns], "__x.*")

