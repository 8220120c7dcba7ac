"""Operator 5, exact dedup by deterministic block naming.

Texts are cut into blocks of a fixed number of bytes. Distinct blocks are sorted and get integer
names by their place in the order; then adjacent pairs of names are named in the same way, level
by level, until each document has one name. Two documents of as many blocks have the same name
if and only if they have the same bytes.

Blocks are sorted by a key (two seeded 64-bit hashes, length). The key is no article of faith:
the distinct blocks themselves are grouped with it, and if two different blocks share a key the
pass runs again with other seeds. So text is shuffled once, after each task has merged its own
copies, and a block's name is found by key alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.llm.common import SPACES, stable, write_table

BLOCK_BYTES = 16384
KEY = ["h1", "h2", "len"]


def normalised(text: Column) -> Column:
    """Each run of space and \\t..\\r as one space; null as the empty text."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")


def numbered(names: DataFrame, keys: list[str]) -> DataFrame:
    """Sort the rows by keys over range partitions and number them by place, from 1. The numbers
    are fixed by writing the table, so that a task that runs again cannot change them."""
    ordered = names.repartitionByRange(*keys).sortWithinPartitions(*keys)
    return write_table(ordered.withColumn("name", F.monotonically_increasing_id() + 1), "names")


def blocks(docs: DataFrame, size: int, seed: int) -> DataFrame:
    """One row per block instead of bytes: its place pos, their number n, the block and its key."""
    n = F.greatest(F.lit(1), F.ceil(F.length("bytes") / F.lit(size))).cast("int")
    cut = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(F.col("bytes"), i * size + 1, F.lit(size)))
    return docs.select("*", n.alias("n"), F.posexplode(cut).alias("pos", "block")).drop("bytes").select(
        "*", F.xxhash64(F.lit(2 * seed), "block").alias("h1"), F.xxhash64(F.lit(2 * seed + 1), "block").alias("h2"), F.length("block").alias("len")
    )


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per row of df: id_col, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after replacing each run of ASCII white space by one space;
    null counts as empty. Of equal texts the row with the smallest id stays; among rows that repeat
    that id too, exactly one stays. An empty table gives an empty result. Other columns of df are
    neither read nor returned. A null id is the smallest id.
    """
    docs = stable(df, F.col(id_col).alias("id"), normalised(F.col(text_col)).cast("binary").alias("bytes"))
    return _classes(docs, block_bytes).drop("rid").withColumnRenamed("id", id_col)


def _classes(docs: DataFrame, block_bytes: int) -> DataFrame:
    """rid, id, keep_id, group_size, kept and text_sha256 for documents (rid, id, bytes)."""
    for seed in range(64):
        distinct = blocks(docs.select("bytes"), block_bytes, seed).groupBy(*KEY, "block").agg(F.count(F.lit(1)).alias("copies"))
        classes = write_table(distinct.groupBy(*KEY).agg(F.count(F.lit(1)).alias("members")), "classes")
        if not classes.where("members > 1").take(1):
            break
    else:
        raise ValueError("no seed separates the blocks")

    signed = docs.withColumn("sha", F.unhex(F.sha2("bytes", 256)))
    first = F.col("pos") == 0
    places = write_table(blocks(signed, block_bytes, seed).select("rid", F.when(first, F.col("id")).alias("id"), F.when(first, F.col("sha")).alias("sha"), "n", "pos", *KEY), "places")
    named = places.join(numbered(classes.select(*KEY), KEY), KEY).select("rid", "n", "pos", "name")

    identity = named.where("n = 1").select("rid", "name")
    most = places.agg(F.max("n")).first()[0] or 1
    rest = named.where("n > 1").select("*", F.col("n").alias("m"))
    while most > 1:
        most = (most + 1) // 2
        left = F.col("pos") % 2 == 0
        pairs = write_table(
            rest.groupBy("rid", "n", F.ceil(F.col("m") / 2).cast("int").alias("m"), F.floor(F.col("pos") / 2).cast("int").alias("pos")).agg(
                F.max(F.when(left, F.col("name"))).alias("a"), F.coalesce(F.max(F.when(~left, F.col("name"))), F.lit(0)).alias("b")
            ),
            "pairs",
        )
        rest = pairs.join(numbered(pairs.select("a", "b").distinct(), ["a", "b"]), ["a", "b"]).select("rid", "n", "pos", "name", "m")
        identity = identity.unionByName(rest.where("m = 1").select("rid", "name"))
        rest = rest.where("m > 1")

    whole = places.where("pos = 0").select("rid", "id", "sha", "n").join(identity, "rid")
    # Only groups of several are looked up; written, so that the join can split a group of a large part of the rows.
    groups = whole.groupBy("n", "name").agg(F.min(F.struct("id", "rid")).alias("keep"), F.count(F.lit(1)).alias("size")).where("size > 1")
    own = F.struct("id", "rid")
    rows = whole.join(write_table(groups, "groups"), ["n", "name"], "left").withColumn("keep", F.coalesce("keep", own))
    return rows.select("rid", "id", F.col("keep.id").alias("keep_id"), F.coalesce("size", F.lit(1)).cast("long").alias("group_size"), (F.col("rid") == F.col("keep.rid")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def keep_one_of_equal(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of df that exact_dedup() keeps, with the columns of df, whatever their names."""
    rows = stable(df, F.struct(*[F.col(c) for c in df.columns]).alias("row"))
    docs = rows.select("rid", F.col("row")[id_col].alias("id"), normalised(F.col("row")[text_col]).cast("binary").alias("bytes"))
    return rows.join(_classes(docs, block_bytes).where("kept").select("rid"), "rid", "left_semi").select("row.*")
