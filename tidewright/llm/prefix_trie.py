"""Operator 11, the trie of conversations that begin with the same turns.

Turns travel as 16-byte digests of role and text with the text's length, so no text is shuffled.
Conversations of equal turns are one sequence with a count, whatever their number. Sequences are dealt
out by the digest of their first turn; tries of pointers in dictionaries are built within tasks, and their
nodes are summed up children first. A first turn whose sequences are too many for a task is dealt out
again by the turn after the longest beginning that all of them share, and so on; the nodes above are
summed from what the parts return.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator
from operator import add
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.llm.common import partitions_for, write_table

#: Turns of one task's tries at most, about; conversation ids that travel as one row.
TURNS, IDS = 100_000, 4096
NODES = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, sid binary, ends_sha256 string, last binary, up binary"
NOTHING = hashlib.sha256(b"").hexdigest()
TURN = "struct<turn:{},digest:binary,size:int>"


class Trie(NamedTuple):
    """nodes, one row each, and ends: (sid, conv_id) of each conversation, sid being that of its last node."""

    nodes: DataFrame
    ends: DataFrame


def digest(*parts: Column) -> Column:
    return F.unhex(F.substring(F.sha2(F.concat(*parts), 256), 1, 32))


def as_rows(df: DataFrame) -> DataFrame:
    """conv_id and turns, an array of (turn, digest, size) in order of turn, null first; turns of one number
    are in the order of their digests. Rows with a null conv_id take no part."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turn = F.struct("turn", digest(F.octet_length(role).cast("string"), F.lit(":"), role, text).alias("digest"), F.char_length(text).alias("size"))
    return df.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))


def grafted(rows: DataFrame, block: int = 100, most: int = 6) -> DataFrame:
    """Each conversation c of as_rows() with its first h turns replaced by those of conversation c - c % block
    (the remainder has the sign of c), where h is crc32 of c as text modulo most."""
    rows = write_table(rows, "turns")
    heads = rows.where(F.col("conv_id") % block == 0).select(F.col("conv_id").alias("donor"), F.slice("turns", 1, most - 1).alias("head"))
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(most)).cast("int")
    both = rows.withColumns({"donor": F.col("conv_id") - F.col("conv_id") % block, "h": h}).join(heads, "donor", "left")
    own = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns") - F.col("h"), F.lit(0)))
    return both.select("conv_id", F.when(F.col("head").isNull(), own).otherwise(F.concat(F.slice("head", F.lit(1), F.col("h")), own)).alias("turns"))


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows in order of sid and conv_id: the ids of a sid as texts of up to IDS of them."""
    out: tuple[list, ...] = ([], [], [], [])

    def batch() -> pa.RecordBatch:
        full = pa.RecordBatch.from_arrays([pa.array(out[0], pa.binary()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.string())], names=["sid", "conv_id", "n", "ids"])
        for column in out:
            column.clear()
        return full

    at, ids = None, []
    for sid, conv in ((s, c) for b in batches for s, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)):
        if sid != at or len(ids) == IDS:
            if ids:
                for column, value in zip(out, (at, ids[0], len(ids), ",".join(map(str, ids))), strict=True):
                    column.append(value)
            at, ids = sid, []
            if len(out[0]) == 1024:
                yield batch()
        ids.append(conv)
    if ids:
        for column, value in zip(out, (at, ids[0], len(ids), ",".join(map(str, ids))), strict=True):
            column.append(value)
    yield batch()


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The texts of a sid, in order, as one hash; nothing but its state is held."""
    at, first, n, state = None, 0, 0, None
    for b in batches:
        out = []
        for sid, conv, k, ids in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if sid != at:
                if at is not None:
                    out.append((at, first, n, state.hexdigest()))
                at, first, n, state = sid, conv, 0, hashlib.sha256()
            else:
                state.update(b",")
            state.update(ids.encode())
            n += k
        yield _hash_rows(out)
    yield _hash_rows([(at, first, n, state.hexdigest())] if at is not None else [])


def _hash_rows(rows: list) -> pa.RecordBatch:
    sids, convs, counts, hashes = zip(*rows, strict=True) if rows else ((), (), (), ())
    return pa.RecordBatch.from_arrays([pa.array(sids, pa.binary()), pa.array(convs, pa.int64()), pa.array(counts, pa.int64()), pa.array(hashes, pa.string())], names=["sid", "conv_id", "n", "ends_sha256"])


def sequences(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct sequences of turns (sid, conv_id, n, ends_sha256, seq, sizes), conv_id being the smallest of
    n; and (sid, conv_id) of all conversations."""
    seq = F.transform("turns", lambda t: t["digest"])
    named = write_table(rows.select("conv_id", digest(F.array_join(F.transform("turns", lambda t: F.hex(t["digest"])), "")).alias("sid"), seq.alias("seq"), F.transform("turns", lambda t: t["size"]).alias("sizes")), "sequences")
    ends, n = named.select("sid", "conv_id"), partitions_for(rows)
    parts = ends.repartitionByRange(n, "sid", "conv_id").sortWithinPartitions("sid", "conv_id").mapInArrow(_joined, "sid binary, conv_id long, n long, ids string")
    hashes = parts.repartition(n, "sid").sortWithinPartitions("sid", "conv_id").mapInArrow(_hashed, "sid binary, conv_id long, n long, ends_sha256 string")
    return write_table(named.join(hashes, ["sid", "conv_id"]), "distinct"), ends


def _tries(frame: pd.DataFrame) -> pd.DataFrame:
    """The tries of sequences that share `key`, the node of depth `depth`, as nodes: numbers in lists, with a
    dictionary from a turn to its child for each. A child's number is above its parent's, so numbers
    downwards are a postorder."""
    kids: list[dict] = []
    parent, depth, conv, n, size, last, end, above = ([] for _ in range(8))
    tops: dict[bytes, int] = {}

    def node(up: int, at: int, turn: bytes, length: int, row: int) -> int:
        kids.append({})
        for column, value in ((parent, up), (depth, at), (conv, None), (n, 0), (size, length), (last, turn), (end, -1), (above, row)):
            column.append(value)
        return len(kids) - 1

    ids = frame["conv_id"].tolist()
    for row, (key, start, count, c, seq, sizes) in enumerate(zip(frame["key"], frame["depth"], frame["n"], ids, frame["seq"], frame["sizes"], strict=True)):
        at = tops.get(key)
        if at is None:
            at = tops[key] = node(-1, start, seq[start - 1], int(sizes[start - 1]), row)
        d = start
        while True:
            n[at] += count
            if conv[at] is None or c < conv[at]:
                conv[at] = c
            if d == len(seq):
                end[at] = row
                break
            below = kids[at].get(seq[d])
            if below is None:
                below = kids[at][seq[d]] = node(at, d + 1, seq[d], int(sizes[d]), -1)
            at, d = below, d + 1
    leaves, saved = [0] * len(kids), [(k - 1) * s for k, s in zip(n, size, strict=True)]
    for at in range(len(kids) - 1, -1, -1):
        leaves[at] = leaves[at] or 1
        if parent[at] >= 0:
            leaves[parent[at]] += leaves[at]
            saved[parent[at]] += saved[at]
    hashes, sids, ups, over = frame["ends_sha256"].tolist(), frame["sid"].tolist(), frame["up"].tolist(), frame["parent_conv"].tolist()
    return pd.DataFrame({
        "conv_id": conv, "depth": depth, "parent_conv_id": [conv[p] if p >= 0 else over[a] for p, a in zip(parent, above, strict=True)], "n_convs": n, "n_children": [len(k) for k in kids], "n_leaves": leaves, "saved_tokens": saved,
        "sid": [sids[e] if e >= 0 else None for e in end], "ends_sha256": [hashes[e] if e >= 0 else NOTHING for e in end], "last": last, "up": [ups[a] if a >= 0 else None for a in above],
    })


def _chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nodes from where a split group starts to where its sequences part, with the sums of what is below."""
    names = [f.split()[0] for f in NODES.split(", ")]
    for b in batches:
        for r in b.to_pylist():
            nodes, saved = [], r["saved"] or 0
            for k in range(len(r["turns"]) - 1, -1, -1):
                saved += (r["n"] - 1) * r["sizes"][k]
                bottom, top = k == len(r["turns"]) - 1, k == 0
                nodes.append((r["conv_id"], r["depth"] + k, r["parent_conv"] if top else r["conv_id"], r["n"], (r["children"] or 0) if bottom else 1, r["leaves"] or 1, saved, r["sid"] if bottom else None, (r["ends_sha256"] if bottom else None) or NOTHING, r["turns"][k], r["up"] if top else None))
            kinds = [pa.int64()] * 7 + [pa.binary(), pa.string(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*nodes, strict=True), kinds, strict=True)], names=names)


def build(rows: DataFrame, turns: int = TURNS) -> Trie:
    """The trie of conversations given as conv_id and turns (of as_rows() or grafted()).

    nodes: conv_id (the smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens
    (over the subtree, (n_convs - 1) times the node's last text's code points), sid (of the conversations that
    end there, else null), ends_sha256 (of their ids, in order, joined by commas) and last, the digest of the
    node's last turn. The root has no parent and no last turn.

    A task gets about so many turns as `turns` says; a conversation is one row of 20 bytes a turn. Rounds of dealing
    out again are as many as places where an oversized group parts. No conversation: no node. Conversations of any
    length, without turns, or equal to others are members like all; ties are settled in as_rows().
    """
    spark = rows.sparkSession
    distinct, ends = sequences(rows)
    root = distinct.agg(F.sum("n").alias("n"), F.min("conv_id").alias("conv_id"), F.max(F.when(F.size("seq") == 0, F.col("sid"))).alias("sid"), F.max(F.when(F.size("seq") == 0, F.col("ends_sha256"))).alias("ends")).first()
    if root.n is None:
        return Trie(spark.createDataFrame([], NODES).drop("up"), ends)
    weight = F.size("seq") - F.col("depth") + 1
    open_ = distinct.where(F.size("seq") > 0).withColumns({"key": F.get("seq", F.lit(0)), "depth": F.lit(1), "up": F.lit(b""), "parent_conv": F.lit(root.conv_id)})
    ready, split = [], []
    while True:
        sums = write_table(open_.groupBy("key").agg(F.sum(weight).alias("weight")), "weights")
        hot = sums.where(F.col("weight") > turns).select("key")
        if not hot.limit(1).count():
            ready.append(open_)
            break
        ready.append(open_.join(hot, "key", "left_anti"))
        large = open_.join(hot, "key")
        # What all sequences between the least and the greatest share, these two share.
        ranges = large.groupBy("key").agg(F.min(F.struct("seq", "sizes")).alias("low"), F.max("seq").alias("high"), F.sum("n").alias("n"), F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"), F.first("up").alias("up"), F.first("parent_conv").alias("parent_conv"))
        differs = F.array_position(F.zip_with(F.col("low.seq"), "high", lambda x, y: x.eqNullSafe(y)), F.lit(False)).cast("int")
        to = F.when(differs == 0, F.size("low.seq")).otherwise(differs - 1)
        part = lambda of: F.slice(of, F.col("depth"), F.col("to") - F.col("depth") + 1)
        groups = write_table(ranges.withColumn("to", to).select("key", "to", "n", "conv_id", "depth", "up", "parent_conv", part(F.col("low.seq")).alias("turns"), part(F.col("low.sizes")).alias("sizes")), "groups")
        below = write_table(large.join(groups.select("key", "to", F.col("conv_id").alias("group_conv")), "key"), "below")
        split.append(groups.join(below.where(F.size("seq") == F.col("to")).select("key", "sid", "ends_sha256"), "key", "left"))
        onward = below.where(F.size("seq") > F.col("to")).withColumns({"up": F.col("key"), "key": digest(F.hex("key"), F.hex(F.get("seq", F.col("to")))), "depth": F.col("to") + 1, "parent_conv": F.col("group_conv")})
        open_ = onward.select(open_.columns)
    every = functools.reduce(DataFrame.unionByName, ready)
    buckets = max(partitions_for(rows), -(-(every.agg(F.sum(weight)).first()[0] or 0) // turns))
    dealt = every.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets))).repartition(min(buckets, 100_000), "bucket")
    nodes = [write_table(dealt.groupBy("bucket").applyInPandas(_tries, NODES), "nodes")]
    tops = lambda: functools.reduce(DataFrame.unionByName, [t.where(F.col("up").isNotNull()).select("up", "n_leaves", "saved_tokens") for t in nodes])
    total = [F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"), F.count(F.lit(1)).alias("children")]
    for groups in reversed(split):
        sums = tops().groupBy(F.col("up").alias("key")).agg(*total)
        nodes.append(write_table(groups.join(sums, "key", "left").mapInArrow(_chains, NODES), "nodes"))
    top = tops().where(F.col("up") == F.lit(b"")).agg(*total)
    first = [F.lit(root.conv_id), F.lit(0), F.lit(None), F.lit(root.n), F.col("children"), F.greatest(F.coalesce("leaves", F.lit(1)), F.lit(1)), F.coalesce("saved", F.lit(0)), F.lit(root.sid), F.lit(root.ends or NOTHING), F.lit(None), F.lit(None)]
    fields = [f.split() for f in NODES.split(", ")]
    nodes.append(top.select(*(c.cast(kind).alias(name) for c, (name, kind) in zip(first, fields, strict=True))))
    return Trie(functools.reduce(DataFrame.unionByName, nodes).drop("up"), ends)


def prefix_trie(df: DataFrame, block: int = 100, most: int = 6, turns: int = TURNS) -> DataFrame:
    """The nodes of the trie of conversations (conv_id, turn, role, text) whose beginnings are grafted().

    Null roles and texts are empty; a null turn comes first. Turns of one number, repeated rows among them, all
    count, in the order of their digests. Rows with a null conv_id take no part; an empty table has no nodes; other
    columns, whatever their names, are not read. A conversation of n turns is a row of 20 n bytes, its texts
    are hashed where they are read.
    """
    nodes = build(grafted(as_rows(df), block, most), turns).nodes
    return nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
