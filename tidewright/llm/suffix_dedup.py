"""Operator 6, removal of repeated byte strings with suffix arrays.

Every string of LENGTH bytes, a window, names an anchor: the place of the smallest hash among its
grams of GRAM bytes. Equal windows name equal anchors at equal places, so all windows can be dealt out
by their anchors. Consecutive windows that name the same place form a segment, of the bytes that
they cover.

1. Each document's segments are found, with the first 128 bits of each one's SHA-256. Segments of equal bytes are
   counted by these, and kept once; anchors all of whose segments are equal are done.
2. The other anchors' different segments are dealt into shards by anchor. In a shard, a suffix array is
   made by Larsson and Sadakane's refinement (ranks of twice the depth from pairs of ranks, for
   unsorted groups only), and common prefixes of neighbours by Kasai's algorithm, in numpy, with
   all segments in step. A window is repeated where a neighbour shares LENGTH bytes with it.
3. An anchor with too many different segments for one shard has several. Each gives its sorted
   distinct windows' fingerprints, cut by ranges; for a range, shards are merged by binary search.

Work, and what is shuffled, is in proportion to the text, whatever repeats how often.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.llm.common import byte_column, mixed, portions, stable, write_table

LENGTH, GRAM = 400, 32
#: Bytes of segments in a shard, about, and different segments of one anchor in it at most, about.
SHARD_BYTES, SHARD_KINDS = 2_000_000, 2048
PORTION = 2_000_000
#: Windows of anchors with several shards that one range of the merge holds, about.
MERGE_WINDOWS = 200_000
#: Never in UTF-8: stands between segments, so that no window reaches across.
STOP = 0xFF
#: Bits of a place in a text: a binary value of Spark has less than 2**31 bytes.
PLACE_BITS = 31

_powers: list[tuple] = []


def powers(n: int):  # noqa: ANN201
    """Powers of an odd multiplier and of its inverse modulo 2**64, n or more of each."""
    import numpy as np

    if not _powers or len(_powers[0][0]) < n:
        base = 0x9E3779B97F4A7C15
        _powers[:] = [tuple(np.cumprod(np.append(np.uint64(1), np.full(max(n, PORTION) + 64, x, np.uint64))) for x in (base, pow(base, -1, 2**64)))]
    return _powers[0]


def hasher(data):  # noqa: ANN001, ANN201
    """A function of starts and ends that gives the 64-bit polynomial hashes of data between them, by which anchors are chosen."""
    import numpy as np

    up, down = powers(len(data) + 1)
    values = mixed(np.arange(256, dtype=np.uint64), 31)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values[data] * up[: len(data)])])
    return lambda a, b: (sums[b] - sums[a]) * down[a]


def digests(data, first, past):  # noqa: ANN001, ANN201
    """The first 16 bytes of the SHA-256 of data[first[i]:past[i]], as two numbers each."""
    import hashlib

    import numpy as np

    text = memoryview(np.ascontiguousarray(data))
    found = b"".join([hashlib.sha256(text[a:b]).digest()[:16] for a, b in zip(first.tolist(), past.tolist(), strict=True)])
    return np.frombuffer(found, np.uint64).reshape(-1, 2).T


def segments(data, ends, length: int = LENGTH, gram: int = GRAM):  # noqa: ANN001, ANN201
    """Segments of all documents data[ends[i]:ends[i+1]]: anchor hash, two digests, document, first
    and last window (from the document's start), and whether the windows repeat one another."""
    import numpy as np

    n, u64 = len(data), np.uint64
    if n < length:
        return [np.zeros(0, np.int64)] * 7
    places = np.arange(n - gram + 1)
    grams = mixed(hasher(data)(slice(0, n - gram + 1), slice(gram, n + 1)))
    width = length - gram + 1
    low = u64((1 << PLACE_BITS) - 1)
    least = np.full(-(-len(grams) // width) * width, ~u64(0))
    least[: len(grams)] = (grams & ~low) | places.astype(u64)
    blocks = least.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, 1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    anchor = (np.minimum(behind[: n - length + 1], ahead[width - 1 : n - gram + 1]) & low).astype(np.int64)
    valid = np.zeros(n + 1, np.int8)
    long = np.flatnonzero(np.diff(ends) >= length)
    valid[ends[long]] += 1
    valid[ends[long + 1] - length + 1] -= 1
    valid = np.cumsum(valid[: n - length + 1], dtype=np.int8).astype(bool)
    same = np.append(False, (anchor[1:] == anchor[:-1]) & valid[1:] & valid[:-1])
    first = np.flatnonzero(valid & ~same)
    last = np.flatnonzero(valid & ~np.append(same[1:], False))
    # In a run of one byte each window is a segment, all equal: the run becomes one row.
    single, changes = first == last, np.cumsum(np.append(False, data[1:] != data[:-1]))
    run = np.append(False, single[1:] & single[:-1] & (first[1:] == last[:-1] + 1) & (changes[first[1:] + length - 1] == changes[first[:-1]]))[: len(first)]
    head = np.flatnonzero(~run)
    first, past = first[head], last[head] + length
    last = last[np.append(head[1:], len(run)) - 1] if len(run) else last
    d1, d2 = digests(data, first, past)
    doc = np.searchsorted(ends, first, side="right") - 1
    self_repeated = np.append(run[1:], False)[head]
    return grams[anchor[first]].view(np.int64), d1.view(np.int64), d2.view(np.int64), doc, first - ends[doc], last - ends[doc], self_repeated


def suffix_array(text):  # noqa: ANN001, ANN201
    """The suffix array of uint8 text and its inverse, by Larsson and Sadakane's refinement.

    Suffixes are first sorted by 8 bytes. A group's rank is the place of its first member. Each round
    sorts the members of unsorted groups by the ranks of what follows at the depth reached, and
    doubles it; groups of one leave.
    """
    import numpy as np

    n = len(text)
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    key = np.zeros(n, np.uint64)
    for k in range(8):
        key = (key << np.uint64(8)) | padded[k : n + k]
    # A suffix shorter than 8 sorts before those that go on with zero bytes.
    order = np.lexsort((np.minimum(n - np.arange(n), 8), key)) if n and not text.all() else np.argsort(key, kind="stable")
    sa = order.astype(np.int64)
    tail = np.minimum(n - sa, 8)
    new = np.append(True, (key[sa][1:] != key[sa][:-1]) | (tail[1:] != tail[:-1])) if n else np.zeros(0, bool)
    start = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.empty(n + 1, np.int64)
    rank[sa], rank[n] = start, -1
    at = np.flatnonzero(~(new & np.append(new[1:], True))) if n else np.zeros(0, np.int64)  # places of unsorted groups
    depth = 8
    while len(at):
        who = sa[at]
        group = rank[who]
        pair = group * (n + 1) + rank[np.minimum(who + depth, n)] + 1
        order = np.argsort(pair, kind="stable")
        who, pair = who[order], pair[order]
        sa[at] = who
        new = np.append(True, pair[1:] != pair[:-1])
        rank[who] = at[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))]
        at = at[~(new & np.append(new[1:], True))]
        depth *= 2
    return sa, rank[:n]


def common_prefixes(text, sa, rank, starts, counts, most: int):  # noqa: ANN001, ANN201
    """Kasai's algorithm: for the positions starts[k] + 0..counts[k] the length, up to most, that the
    suffix shares with the one before it in the array; 0 elsewhere. Runs of positions go in step."""
    import numpy as np

    n = len(text)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    out = np.zeros(n, np.int32)
    padded = np.append(text, np.uint8(STOP))
    i, end = starts[counts > 0].copy(), (starts + counts)[counts > 0]
    size = np.zeros(len(i), np.int64)
    while len(i):
        j = before[i]
        more = (j >= 0) & (size < most) & (padded[np.minimum(i + size, n)] == padded[np.minimum(j + size, n)])
        done = ~more
        out[i[done]] = size[done]
        size = np.where(more, size + 1, np.maximum(size - 1, 0))
        i = i + done
        going = i < end
        if not going.all():
            i, end, size = i[going], end[going], size[going]
    return out


def repeated_windows(parts: list[bytes], counts, length: int = LENGTH):  # noqa: ANN001, ANN201
    """For segments of which the first counts[k] positions start windows: the concatenated text, where
    each segment starts, whether each position's window is repeated, and the array's order."""
    import numpy as np

    text = np.frombuffer(b"\xff".join(parts) + b"\xff", np.uint8)
    sizes = np.array([len(x) + 1 for x in parts])
    starts = np.cumsum(sizes) - sizes
    sa, rank = suffix_array(text)
    shared = common_prefixes(text, sa, rank, starts, np.asarray(counts), length)
    again = shared >= length
    hit = np.flatnonzero(again)
    both = again.copy()
    both[sa[rank[hit] - 1]] = True  # the one before shares as much
    return text, starts, both, sa, again


def _runs(flags, starts, counts):  # noqa: ANN001, ANN201
    """Runs of flagged positions among the first counts[k] of each segment: segment, from, past."""
    import numpy as np

    inside = np.zeros(len(flags) + 1, np.int8)
    np.add.at(inside, starts, 1)
    np.add.at(inside, starts + counts, -1)
    on = np.concatenate([[False], flags & (np.cumsum(inside[:-1]) > 0), [False]])
    head = np.zeros(len(flags) + 2, bool)
    head[starts] = True  # a run does not go on into the next segment
    a = np.flatnonzero(on[1:] & (~on[:-1] | head[: len(on) - 1]))
    b = np.flatnonzero(on[:-1] & (~on[1:] | head[: len(on) - 1]))
    owner = np.searchsorted(starts, a, side="right") - 1
    return owner, a - starts[owner], b - starts[owner]


def suffix_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, shard_bytes: int = SHARD_BYTES, shard_kinds: int = SHARD_KINDS, keep_bytes: bool = False) -> DataFrame:
    """One row per row of df: id_col, n_bytes, n_removed, n_spans, kept_sha256, and with keep_bytes
    `kept`, the remaining bytes.

    Removed is each byte that a string of `length` bytes covers which also starts elsewhere, in the
    same document or another; null is empty, and texts shorter than `length` lose nothing. Rows that
    repeat, with or without their id, are documents each. An empty table gives an empty result.
    What is no plain read of files is written first, as it is read three times.
    """
    docs = stable(df, F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("data"))
    kind = dict(docs.dtypes)["id"]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, ends = byte_column(batch.column(1))
            rids = batch.column(0).to_numpy()
            for i, j in portions(ends, PORTION):
                anchor, d1, d2, doc, first, last, *own = segments(data[ends[i] : ends[j]], ends[i : j + 1] - ends[i], length, gram)
                if len(anchor):
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (anchor, d1, d2, rids[i:j][doc], first, last, own[0])], names=["anchor", "d1", "d2", "rid", "first", "last", "self"])

    found = write_table(docs.select("rid", "data").where(F.octet_length("data") >= length).mapInArrow(find, "anchor long, d1 long, d2 long, rid long, first long, last long, self boolean"), "segments")
    key = ["anchor", "d1", "d2"]
    kinds = write_table(found.groupBy(*key).agg(F.count(F.lit(1)).alias("times"), F.max("self").alias("self"), F.min(F.struct("rid", "first", "last")).alias("at")), "kinds")
    # Equal segments: all that they cover is repeated.
    equal = kinds.where((F.col("times") > 1) | F.col("self")).select(*key)
    whole = found.join(equal, key, "left_semi").select("rid", F.col("first").alias("a"), (F.col("last") + length).alias("b"))

    several = kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1")
    salts = F.ceil(F.col("kinds") / shard_kinds)
    open_ = kinds.join(several, "anchor").select("anchor", F.when(salts > 1, F.pmod("d1", salts)).otherwise(0).cast("int").alias("salt"), (salts > 1).alias("hot"), "at.*")
    open_ = write_table(open_.withColumn("last", F.when(F.col("last") - F.col("first") > length - gram, F.col("first")).otherwise(F.col("last"))), "open")
    windows = F.col("last") - F.col("first") + 1
    volume, hot_windows = (x or 0 for x in open_.agg(F.sum(windows + (length - 1)), F.sum(F.when(F.col("hot"), windows))).first())
    shards = max(1, -(-volume // shard_bytes))
    parts = max(1, -(-hot_windows // MERGE_WINDOWS))
    wanted = open_.select("rid", F.struct("first", "last", "hot", F.pmod(F.xxhash64("anchor", "salt"), F.lit(shards)).alias("shard")).alias("x")).groupBy("rid").agg(F.collect_list("x").alias("wanted"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rid, data, wanted_ in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                text, rows = memoryview(data.as_buffer()), wanted_.values
                first, last = (rows.field(k).to_numpy() for k in ("first", "last"))
                for s in range(0, len(rows), 4096):
                    blobs = [bytes(text[a : b + length]) for a, b in zip(first[s : s + 4096], last[s : s + 4096], strict=True)]
                    own = rows.slice(s, 4096)
                    yield pa.RecordBatch.from_arrays(
                        [own.field("shard"), own.field("hot"), pa.array([rid] * len(blobs), pa.int64()), own.field("first"), pa.array(blobs, pa.binary())], names=["shard", "hot", "rid", "first", "bytes"]
                    )

    pieces = docs.select("rid", "data").join(wanted, "rid").mapInArrow(cut, "shard long, hot boolean, rid long, first long, bytes binary")

    def sort_shard(table: pa.Table) -> pa.Table:
        import numpy as np

        blobs = table.column("bytes").to_pylist()
        counts = np.array([len(x) - length + 1 for x in blobs])
        text, starts, both, sa, again = repeated_windows(blobs, counts, length)
        rid, first, hot = (table.column(c).to_numpy() for c in ("rid", "first", "hot"))
        owner, a, b = _runs(both, starts, counts)
        rows = [pa.table({"rid": rid[owner], "a": first[owner] + a, "b": first[owner] + b - 1 + length, "part": np.full(len(a), -1), "prints": pa.array([b""] * len(a), pa.binary())})]
        if hot.any():
            # One window of each class of equal ones, for the merge with the anchor's other shards.
            valid = np.zeros(len(text), bool)
            for k in np.flatnonzero(hot):
                valid[starts[k] : starts[k] + counts[k]] = True
            spot = sa[valid[sa] & ~again[sa]]
            one, two = digests(text, spot, spot + length)
            mine = np.searchsorted(starts, spot, side="right") - 1
            packed = np.stack([one, two, rid[mine].astype(np.uint64), (first[mine] + spot - starts[mine]).astype(np.uint64)], 1)[np.argsort(one)]
            cuts = np.searchsorted(packed[:, 0], np.array([k * (2**64 // parts) for k in range(1, parts)], np.uint64))
            for part, x in enumerate(np.split(packed, cuts)):
                if len(x):
                    rows.append(pa.table({"rid": [0], "a": [0], "b": [0], "part": [part], "prints": pa.array([x.tobytes()], pa.binary())}))
        return pa.concat_tables([t.cast(pa.schema([("rid", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("part", pa.int64()), ("prints", pa.binary())])) for t in rows])

    sorted_ = write_table(pieces.groupBy("shard").applyInArrow(sort_shard, "rid long, a long, b long, part long, prints binary"), "sorted")

    def merge(table: pa.Table) -> pa.Table:
        import numpy as np

        runs = [np.frombuffer(x, np.uint64).reshape(-1, 4) for x in table.column("prints").to_pylist()]
        hits = []
        while len(runs) > 1:  # pairs of sorted runs, by binary search
            merged = []
            for x, y in zip(runs[::2], runs[1::2], strict=False):
                at = np.minimum(np.searchsorted(x[:, 0], y[:, 0]), len(x) - 1)
                same = (x[at, 0] == y[:, 0]) & (x[at, 1] == y[:, 1])
                hits += [x[at[same]], y[same]]
                rest = y[~same]
                merged.append(np.insert(x, np.searchsorted(x[:, 0], rest[:, 0]), rest, 0))
            runs = merged + runs[len(runs) - len(runs) % 2 :]
        got = np.unique(np.concatenate([np.zeros((0, 4), np.uint64), *hits])[:, 2:], axis=0).astype(np.int64)
        if not len(got):  # no two shards have a window of this range in common
            return pa.table({k: pa.array([], pa.int64()) for k in ("rid", "a", "b")})
        new = np.flatnonzero(np.append(True, (got[1:, 0] != got[:-1, 0]) | (got[1:, 1] != got[:-1, 1] + 1)))
        last = np.append(new[1:], len(got)) - 1
        return pa.table({"rid": got[new, 0], "a": got[new, 1], "b": got[last, 1] + length})

    merged = sorted_.where("part >= 0").select("part", "prints").groupBy("part").applyInArrow(merge, "rid long, a long, b long")
    spans = whole.unionByName(sorted_.where("part < 0").select("rid", "a", "b")).unionByName(merged)
    spans = spans.groupBy("rid").agg(F.collect_list(F.struct("a", "b")).alias("spans"))

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        import numpy as np

        for batch in batches:
            sizes, removed, n_spans, shas, kept = [], [], [], [], []
            for data, x in zip(batch.column(1), batch.column(2), strict=True):
                text = np.frombuffer(data.as_buffer(), np.uint8)
                left, count = text, 0
                if x.is_valid:
                    edge = np.zeros(len(text) + 1, np.int32)
                    np.add.at(edge, x.values.field("a").to_numpy(), 1)
                    np.add.at(edge, x.values.field("b").to_numpy(), -1)
                    gone = np.cumsum(edge[:-1]) > 0
                    count, left = int((gone & ~np.append(False, gone[:-1])).sum()), text[~gone]
                sizes.append(len(text))
                removed.append(len(text) - len(left))
                n_spans.append(count)
                shas.append(hashlib.sha256(left).hexdigest())
                kept.append(left.tobytes() if keep_bytes else b"")
            columns = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(shas), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    out = docs.join(spans, "rid", "left").select("id", "data", "spans").mapInArrow(remove, f"id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return (out if keep_bytes else out.drop("kept")).withColumnRenamed("id", id_col)
