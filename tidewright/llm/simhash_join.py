"""Operator 13, near-duplicates by SimHash, joined over a hierarchical index in Gray order.

Fingerprints of equal texts are one row. Two fingerprints within k bits agree on one of k + 1 blocks
of bits, so each fingerprint goes to k + 1 shards, named by as many first bits of a block as bring a shard
down to SHARD fingerprints. A shard that is larger all the same is dealt out again, by more bits of its block and
then by blocks of the bits that are left.

In a shard, fingerprints are sorted by Gray rank, in which neighbours differ in few bits. Runs of FAN of
them become a node that keeps the bits on which all of them agree (a mask and a pattern), runs of FAN nodes a
node above, and so on. Pairs of nodes are compared from the top. Of the bits that are fixed in both, those that differ are
counted; each level adds those among the bits that it is the first to fix. A pair of nodes with more than k differences goes at
once, with all below it, as does one whose fingerprints are all linked by now. What a shard returns is a forest: one link a
fingerprint at most.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.llm.common import partitions_for, write_table
from tidewright.llm.components import components

SEED, BITS = 42, 64
#: Bytes of text hashed at a time; fingerprints of a shard; of a node; pairs of nodes compared at a time; bits in
#: which a shard that is not dealt out again may differ.
PIECE, SHARD, FAN, PAIRS = 1 << 20, 8192, 8, 1 << 14
FEW_BITS = 20
GAP = re.compile(rb"[\x20\x09-\x0D]")


def _counts(words: list[bytes], width: int):  # noqa: ANN202
    """How many shingles of so many words have each bit of their hash set."""
    import numpy as np
    from xxhash import xxh64_intdigest

    data, width = b" ".join(words), min(width, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.append(0, ends[:-1] + 1)[: len(words) - width + 1]
    hashes = np.array([xxh64_intdigest(data[a:b], SEED) for a, b in zip(starts.tolist(), ends[width - 1 :].tolist(), strict=True)], np.uint64)
    return np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)


def fingerprint(text: bytes, width: int = 3) -> int:
    """Bit b is set where over half of the text's shingles have bit b of their XXH64 set. Without words: zero.
    A long text is hashed in pieces, each with the last words of the one before it."""
    import numpy as np

    bits, n, at, words = np.zeros(BITS, np.int64), 0, 0, []
    while at < len(text):
        cut = GAP.search(text, at + PIECE)
        to = cut.start() if cut else len(text)
        words += text[at:to].lower().split()
        at = to
        if len(words) >= width:
            bits += _counts(words, width)
            n += len(words) - width + 1
            words = words[len(words) - width + 1 :]
    if not n and words:
        bits, n = _counts(words, width), 1
    return int(np.packbits(2 * bits > n, bitorder="little").view(np.uint64)[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """id_col and fp, the fingerprint as a long of the same bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [fingerprint(t.as_py() or b"", width) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([f - (f >> 63 << 64) for f in fps], pa.int64())], names=["id", "fp"])

    return df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").cast("binary").alias("text")).mapInArrow(run, "id long, fp long")


def gray_rank(x):  # noqa: ANN001, ANN201
    """The places of uint64 codes in the reflected Gray sequence."""
    import numpy as np

    for shift in (1, 2, 4, 8, 16, 32):
        x = x ^ (x >> np.uint64(shift))
    return x


class Index:
    """The nodes over fingerprints, in levels from the fingerprints (0) up: mask and pattern hold the bits
    that all below share."""

    def __init__(self, fps, fan: int = FAN) -> None:  # noqa: ANN001
        import numpy as np

        self.fps, self.fan = fps[np.argsort(gray_rank(fps), kind="stable")], fan
        self.masks, self.patterns = [np.full(len(fps), 2**64 - 1, np.uint64)], [self.fps]
        while len(self.masks[-1]) > fan:
            starts = np.arange(0, len(self.masks[-1]), fan)
            mask, low, high = (f.reduceat(x, starts) for f, x in ((np.bitwise_and, self.masks[-1]), (np.bitwise_and, self.patterns[-1]), (np.bitwise_or, self.patterns[-1])))
            # Below, patterns are zero outside their masks; bits that are in all masks decide.
            mask &= ~(low ^ high)
            self.masks.append(mask)
            self.patterns.append(low & mask)

    def forest(self, most: int, pairs: int = PAIRS) -> list:
        """Links (positions in fps) that join all fingerprints that links of at most `most` differing bits join."""
        import numpy as np

        label, links, fan = np.arange(len(self.fps)), [], self.fan
        top = len(self.masks) - 1
        a, b = np.triu_indices(len(self.masks[top]))
        todo = [(top, a, b, np.bitwise_count((self.patterns[top][a] ^ self.patterns[top][b]) & self.masks[top][a] & self.masks[top][b]).astype(np.int64))]
        low = high = None
        while todo:
            level, a, b, gap = todo.pop()
            if len(a) > pairs:
                todo += [(level, a[pairs:], b[pairs:], gap[pairs:])]
                a, b, gap = a[:pairs], b[:pairs], gap[:pairs]
            keep = gap <= most
            if level == 0:
                keep &= a < b
                a, b = a[keep], b[keep]
                fresh = label[a] != label[b]
                if fresh.any():
                    links += _joined(label, a[fresh], b[fresh])
                    low = None
                continue
            if low is None:  # the least and greatest label below each node, of all levels
                low, high = [label], [label]
                for masks in self.masks[1:]:
                    starts = np.arange(0, len(low[-1]), fan)[: len(masks)]
                    low, high = [*low, np.minimum.reduceat(low[-1], starts)], [*high, np.maximum.reduceat(high[-1], starts)]
            keep &= (low[level][a] != high[level][a]) | (low[level][b] != high[level][b]) | (low[level][a] != low[level][b])
            a, b, gap = a[keep], b[keep], gap[keep]
            if not len(a):
                continue
            below = len(self.masks[level - 1])
            step = np.arange(fan)
            x, y = (a[:, None] * fan + np.repeat(step, fan)).reshape(-1), (b[:, None] * fan + np.tile(step, fan)).reshape(-1)
            came = np.repeat(np.arange(len(a)), fan * fan)
            real = (x < below) & (y < below) & (x <= y)
            x, y, came = x[real], y[real], came[real]
            # What the nodes above have compared is not compared again: bits that are new on either side are added.
            masks, patterns, above = self.masks[level - 1], self.patterns[level - 1], self.masks[level]
            new = masks[x] & masks[y] & ~(above[a] & above[b])[came]
            more = gap[came] + np.bitwise_count((patterns[x] ^ patterns[y]) & new)
            keep = more <= most
            todo.append((level - 1, x[keep], y[keep], more[keep]))
        return links


def _joined(label, a, b) -> list:  # noqa: ANN001
    """Join the classes of label that pairs (a, b) link, in place; returns one pair for each joining."""
    import numpy as np

    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = parent.get(up, up)
            x = up
        return x

    links = []
    la, lb = label[a], label[b]
    _, first = np.unique(np.minimum(la, lb) * len(label) + np.maximum(la, lb), return_index=True)
    for k in first.tolist():
        p, q = find(int(la[k])), find(int(lb[k]))
        if p != q:
            parent[max(p, q)] = min(p, q)
            links.append((int(a[k]), int(b[k])))
    moved = np.fromiter(parent, np.int64, len(parent))
    to = np.arange(len(label))
    to[moved] = [find(x) for x in moved.tolist()]
    label[:] = to[label]
    return links


def _links(frame: pd.DataFrame, most: int) -> pd.DataFrame:
    """The forest of each shard (shard, fp) of a frame."""
    import numpy as np

    out = []
    for fps in frame.groupby("shard", sort=False)["fp"]:
        index = Index(np.unique(fps[1].to_numpy(np.int64).view(np.uint64)))
        out += [(index.fps[a], index.fps[b]) for a, b in index.forest(most)]
    pairs = np.array(out, np.uint64).reshape(-1, 2).view(np.int64)
    return pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})


def _parts(bits: list[int], blocks: int) -> list[list[int]]:
    return [bits[len(bits) * i // blocks : len(bits) * (i + 1) // blocks] for i in range(blocks)]


def _mask(bits: list[int]) -> int:
    return functools.reduce(lambda m, b: m | 1 << b, bits, 0)


def _dealt(rows: DataFrame, masks: Column) -> DataFrame:
    """fp, mask and shard, for each of a row's masks: a shard's fingerprints are equal under its mask."""
    wide = rows.select("fp", F.explode(masks).alias("mask"))
    return wide.withColumn("shard", F.xxhash64("mask", F.col("fp").bitwiseAND(F.col("mask"))))


def near_links(distinct: DataFrame, most: int = 3, shard: int = SHARD) -> DataFrame:
    """Links a, b between distinct fingerprints (fp long) of at most `most` differing bits: enough of them to
    join all that such links join. A shard's links are a forest. Shards of over `shard` fingerprints are
    dealt out again, until they differ in FEW_BITS at most and so are of 2 ** FEW_BITS at most."""
    n, blocks = distinct.count(), most + 1
    first = next(w for w in range(BITS) if n <= (shard // 2) << w or w == BITS // blocks)
    whole = _parts(list(range(BITS - 1, -1, -1)), blocks)
    # A mask and those that follow it. A pair that agrees on a block agrees on its first bits; one that agrees on a
    # mask of whole blocks agrees on one of the parts of the rest.
    after = {_mask(block[:first]): [_mask(block)] for block in whole} if first else {0: [_mask(block) for block in whole]}
    signed = lambda m: F.lit(m - (m >> 63 << 64))
    open_, ready = _dealt(distinct, F.array(*(signed(m) for m in after))), []
    while True:
        open_ = write_table(open_, "shards")
        hot = open_.groupBy("shard").count().where(F.col("count") > shard).select("shard")
        if all(BITS - m.bit_count() <= FEW_BITS for m in after) or not hot.limit(1).count():
            ready.append(open_.select("fp", "shard"))
            break
        ready.append(open_.join(hot, "shard", "left_anti").select("fp", "shard"))
        table = F.create_map(*(x for m, to in after.items() for x in (signed(m), F.array(*(signed(t) for t in to)))))
        open_ = _dealt(open_.join(hot, "shard"), F.element_at(table, F.col("mask")))
        rest = lambda m: [b for b in range(BITS - 1, -1, -1) if not m >> b & 1]
        after = {t: [t | _mask(part) for part in _parts(rest(t), blocks)] for to in after.values() for t in to}
    rows = functools.reduce(DataFrame.unionByName, ready)
    # A task of pandas gets many shards, of a bounded size together.
    buckets = max(partitions_for(distinct), -(-n * blocks // (4 * shard)))
    dealt = rows.withColumn("bucket", F.pmod("shard", F.lit(buckets))).repartition(min(buckets, 100_000), "bucket")
    return dealt.groupBy("bucket").applyInPandas(lambda f: _links(f, most), "a long, b long")


def simhash_join(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, most: int = 3) -> DataFrame:
    """id_col, fingerprint (16 hex digits) and component_id, the smallest id that links of at most `most`
    differing bits reach.

    Null and wordless texts have fingerprint zero, which links like any other. Null ids get a row and are no
    component's smallest; a component of null ids alone has a null one. Rows that repeat stay and share their
    component. Texts of any length are hashed whole. Other columns, whatever their names, are not read; an
    empty table gives an empty result.
    """
    rows = write_table(fingerprints(df, id_col, text_col, width), "fingerprints")
    distinct = write_table(rows.groupBy("fp").agg(F.min("id").alias("first")), "distinct")
    joined = components(near_links(distinct.select("fp"), most)).select(F.col("node").alias("fp"), "comp").join(distinct, "fp")
    least = joined.groupBy("comp").agg(F.min("first").alias("least"))
    classes = distinct.join(joined.join(least, "comp").select("fp", "least"), "fp", "left").select("fp", F.coalesce("least", "first").alias("component_id"))
    return rows.join(classes, "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
