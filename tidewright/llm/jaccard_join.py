"""Operator 7, the exact n-gram Jaccard join with set-relation skipping (Wang et al. 2017).

A document's set holds the hashes of its word shingles. Documents of equal sets are one node.
Nodes that link share some of the first shingles of both, in an order that puts frequent shingles
last (prefix filtering, with prefixes that have to share several for larger sets), so that lists of
an inverted index over these find all links. Relations between sets save most comparisons:

* Each list has a leader, and a node is first compared only with the leader of most of its lists.
* Answers for nodes that are near the same leader are derived from theirs: two such sets share what both
  share with the leader, and of what sets either apart from it that in which they differ alike.
  Only these differences, of which the answer asks for a known number in common, are indexed
  and compared; of two nodes that link with the leader nothing has to be known.
* Links found so far give components; a list whose members are all in one component, or all near one
  leader, needs no more work. In the lists that remain, blocks of members are skipped whole by
  size and position, where even the best member of the block cannot reach the overlap asked for,
  or is in the same component or near the same leader. Pairs that are left are compared by their sets.

What is returned, components, loses no link.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewright.llm.common import byte_column, mixed, partitions_for, portions, release, remove_table, stable, write_table
from tidewright.llm.components import components

WORDS, PERCENT = 5, 75
#: Shingles that order last: the most frequent of those that recur within a task's portion of text.
#: Any choice gives whole results.
FREQUENT, RECURS = 65_536, 4
#: Members of one list that one task sees at first; longer lists are dealt out by salt.
LIST_ROWS = 4096
#: Members of a list that are skipped or looked at together, and those that are paired in one task.
BLOCK, CELL_ROWS = 64, 1024
#: Bytes of text whose sets are made together, and of it those whose words are hashed together.
PORTION, PIECE = 3_000_000, 1 << 18
#: Of the words' hashes: odd.
BASE = 0xD6E8FEB86659FD93
#: A node is compared with a leader first if they share this part of its prefix; any choice gives whole results.
FEW = 8
#: Per cent of similarity from which on a node is near its leader; any choice gives whole results.
NEAR = 50
#: Prefixes are longer by up to MORE than one common shingle asks for: 1 for every PER shingles of the set.
PER, MORE = 40, 7
#: One place of a shingle in the index.
ENTRY = [("key", "<i8"), ("node", "<i8"), ("n", "<i4"), ("pos", "<i4"), ("salt", "<i4")]


def _word_sums(low, at):  # noqa: ANN001, ANN201
    """For each word that begins at `at` the sum of its bytes (value + 1; space adds nothing) times powers
    of a base by place, modulo 2**64. Bytes are taken a piece at a time, wherever words begin."""
    import numpy as np

    u64, out = np.uint64, np.zeros(len(at), np.uint64)
    power = np.cumprod(np.append(u64(1), np.full(min(PIECE, len(low)), BASE, u64)))
    for s in range(0, len(low), PIECE):
        own = low[s : s + PIECE]
        i, j = np.searchsorted(at, [s, s + len(own)])
        heads = at[i:j] - s
        begin = np.zeros(len(own), np.int32)
        begin[heads] = heads
        place = np.arange(len(own), dtype=np.int32) - np.maximum.accumulate(begin)
        terms = np.where(own != 32, own.astype(u64) + u64(1), u64(0)) * power[place]
        before = heads[0] if len(heads) else len(own)
        if i and before:  # the last word of the piece before goes on
            out[i - 1 : i] += terms[:before].sum(keepdims=True) * u64(pow(BASE, s - int(at[i - 1]), 1 << 64))
        if len(heads):
            out[i:j] += np.add.reduceat(terms, heads)
    return out


def shingle_sets(data, ends, words: int = WORDS, seed: int = 0):  # noqa: ANN001, ANN201
    """Sorted distinct shingle hashes of all texts on end, and how many each has.

    Words are maximal runs of bytes other than space and \\t..\\r, with A-Z in lower case. A text of
    fewer words has one shingle of all of them, or none.
    """
    import numpy as np

    u64 = np.uint64
    n_docs = len(ends) - 1
    counts = np.zeros(n_docs, np.int64)
    if not len(data):
        return np.zeros(0, u64), counts
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    table[[9, 10, 11, 12, 13]] = 32
    low = table[data]
    first = low != 32
    heads = ends[:-1][ends[:-1] < len(data)]
    solid = first[heads]
    first[1:] &= low[:-1] == 32
    first[heads] = solid
    at = np.flatnonzero(first)
    del first
    if not len(at):
        return np.zeros(0, u64), counts
    word = mixed(_word_sums(low, at), seed)
    doc = (np.searchsorted(ends, at, side="right") - 1).astype(np.int32)
    per_doc = np.bincount(doc, minlength=n_docs)
    start = np.cumsum(per_doc) - per_doc
    del low, at, doc
    odd = [u64((0xA24BAED4963EE407 * (2 * k + 1) + 2 * k * k) & (2**64 - 1) | 1) for k in range(words)]
    padded = np.concatenate([word, np.zeros(words, u64)])
    full = np.zeros(len(word), u64)
    for k in range(words):
        full += padded[k : len(word) + k] * odd[k]
    full = mixed(full, seed + 7)
    out = []
    for i in np.flatnonzero(per_doc):
        n, s = per_doc[i], start[i]
        if n >= words:
            own = np.sort(full[s : s + n - words + 1])
            own = own[np.append(True, own[1:] != own[:-1])]
        else:
            own = mixed(sum((word[s + k : s + k + 1] * odd[k] for k in range(n)), np.zeros(1, u64)), seed + 100 + int(n))
        counts[i] = len(own)
        out.append(own)
    return np.concatenate(out), counts


def set_nodes(hashes, counts):  # noqa: ANN001, ANN201
    """Two 64-bit digests of each set; zeros for empty ones."""
    import numpy as np

    some = np.flatnonzero(counts)
    digests = np.zeros((2, len(counts)), np.uint64)
    if len(some):
        start = (np.cumsum(counts) - counts)[some]
        for k in range(2):
            digests[k, some] = mixed(np.add.reduceat(mixed(hashes, 11 + k), start) + counts[some].astype(np.uint64), k)
    return digests.view(np.int64)


def packed(entries) -> bytes:  # noqa: ANN001
    """Entries column by column, compressed: sizes, places and salts shrink to little."""
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(b"".join(entries[name].tobytes() for name, _ in ENTRY))


def unpacked(blob: bytes):  # noqa: ANN201
    import numpy as np
    import zstandard

    data = zstandard.ZstdDecompressor().decompress(blob)
    out, at = np.empty(len(data) // np.dtype(ENTRY).itemsize, ENTRY), 0
    for name, kind in ENTRY:
        own = np.frombuffer(data, kind, len(out), at)
        out[name], at = own, at + own.nbytes
    return out


def _cells(rows: DataFrame) -> DataFrame:
    """rows, with the number c of their list, dealt into cells (i, j) of a list: its members fall into
    blocks of CELL_ROWS or so, and a cell holds two of them, or one. A member is in as many cells as its
    list has blocks, so that no list is one task's."""
    blocks = F.greatest(F.lit(1), F.ceil(F.col("c") / CELL_ROWS)).cast("int")
    rows = rows.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    every = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return every.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")}).drop("blocks", "other", "c")


def _streamed(batches: Iterator[pa.RecordBatch], keys: int, out):  # noqa: ANN001, ANN202
    """Give `out` the whole lists of sorted rows, as columns of numbers: a list may go on in the next batch."""
    import numpy as np

    held = None
    for batch in batches:
        rows = [np.asarray(c).astype(np.int64) for c in batch.columns]
        if held is not None:
            rows = [np.concatenate([h, x]) for h, x in zip(held, rows, strict=True)]
        same = np.ones(len(rows[0]), bool)
        for x in rows[:keys]:
            same &= x == x[-1] if len(x) else same
        last = len(same) - int(np.argmin(same[::-1])) if len(same) and not same.all() else 0
        if last:
            yield out([x[:last] for x in rows])
        held = [x[last:] for x in rows]
    if held is not None and len(held[0]):
        yield out(held)


def _edges(keys: list):  # noqa: ANN202
    import numpy as np

    new = np.ones(len(keys[0]), bool)
    new[1:] = np.logical_or.reduce([x[1:] != x[:-1] for x in keys])
    cut = np.flatnonzero(new)
    return zip(cut, np.append(cut[1:], len(new)), strict=True)


def _pairs_of(rows, need: int, total: int, across: bool):  # noqa: ANN001, ANN201
    """Pairs of one cell in different components that may link: arrays of rows' numbers. rows: n, pos, comp,
    guide and block, ordered by n; across: of different blocks only. Blocks of rows that can hold no
    partner are passed over whole."""
    import numpy as np

    n, pos, comp, guide, block = rows
    rest = n - pos + MORE  # may be the last of so many more that both have to share
    cuts = np.arange(0, len(n), BLOCK)
    most_n, most_rest = np.maximum.reduceat(n, cuts), np.maximum.reduceat(rest, cuts)
    (low, high), (least_guide, most_guide) = ((np.minimum.reduceat(x, cuts), np.maximum.reduceat(x, cuts)) for x in (comp, guide))
    left, right = [], []
    for x in range(1, len(n)):
        blocks = np.arange(-(-x // BLOCK))
        # Smaller partners only; they need n >= need / total of x's, and enough left from here on.
        least = np.ceil(need * n[x] / total)
        asked = np.ceil(need * (n[x] + least) / (total + need))
        open_ = (most_n[blocks] >= least) & (np.minimum(most_rest[blocks], rest[x]) >= asked)
        open_ &= ((low[blocks] != comp[x]) | (high[blocks] != comp[x])) & ((least_guide[blocks] != guide[x]) | (most_guide[blocks] != guide[x]))
        for at in blocks[open_]:
            y = np.arange(at * BLOCK, min((at + 1) * BLOCK, x))
            ok = (comp[y] != comp[x]) & (guide[y] != guide[x]) & (n[y] * total >= need * n[x]) & (np.minimum(rest[y], rest[x]) * (total + need) >= need * (n[x] + n[y]))
            if across:
                ok &= block[y] != block[x]
            right.append(y[ok])
            left.append(np.full(ok.sum(), x))
    return (np.concatenate(left), np.concatenate(right)) if left else (np.zeros(0, int), np.zeros(0, int))


def jaccard_join(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row per row of df: id_col, n_shingles, component_id, node (of equal sets).

    Two documents link when 100 * intersection >= percent * union of their sets of `words`-word
    shingles; component_id is the smallest id that is reachable by links, itself included. Null and
    blank texts have empty sets and link with nothing. Rows that repeat an id are documents each.
    Shingles are told apart by 64-bit hashes, and equal sets by 128 bits. Other columns of df, whatever
    their names, are not read. An empty table gives an empty result.
    """
    docs = stable(df, F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("data"))
    joined = _joined(docs, words, percent)
    return joined.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("least", "id").alias("component_id"), "node")


def _joined(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """rid, id, n, node, group and least (the group's smallest id; null for an empty set) for documents (rid,
    id, data)."""
    spark = docs.sparkSession
    kind = dict(docs.dtypes)["id"]
    parts = partitions_for(docs)

    def survey(seed: int):  # noqa: ANN202
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            import numpy as np

            for batch in batches:
                data, ends = byte_column(batch.column(2))
                for i, j in portions(ends, 4 * PORTION):
                    hashes, counts = shingle_sets(data[ends[i] : ends[j]], ends[i : j + 1] - ends[i], words, seed)
                    node, more = set_nodes(hashes, counts)
                    ordered = np.sort(hashes)
                    edge = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])) if len(ordered) else np.zeros(0, int)
                    times = np.diff(np.append(edge, len(ordered)))
                    often = times >= RECURS
                    none = [[]] * (j - i - 1)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(counts), pa.array(node), pa.array(more), pa.array([ordered[edge[often]].view(np.int64), *none], pa.list_(pa.int64())), pa.array([times[often], *none], pa.list_(pa.int64()))],
                        names=["rid", "id", "n", "node", "more", "often", "times"],
                    )

        return run

    for seed in range(64):
        nodes = write_table(docs.mapInArrow(survey(seed), f"rid long, id {kind}, n long, node long, more long, often array<long>, times array<long>"), "nodes")
        if not nodes.where("n > 0").groupBy("node").agg(F.min(F.struct("more", "n")).alias("x"), F.max(F.struct("more", "n")).alias("y")).where("x <> y").take(1):
            break
    often = nodes.where(F.size("often") > 0).select(F.explode(F.arrays_zip("often", "times")).alias("x")).groupBy(F.col("x.often").alias("hash")).agg(F.sum("x.times").alias("times"))
    # At most FREQUENT rows reach the driver and the tasks.
    top = often.orderBy(F.desc("times"), "hash").limit(FREQUENT).collect()
    frequent = spark.sparkContext.broadcast(([r["hash"] for r in top], [r["times"] for r in top]))

    buckets = 4 * parts

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        hot, times = (np.array(x, np.int64) for x in frequent.value)
        # Frequent shingles order after others, the most frequent last.
        by_hash = np.argsort(hot.view(np.uint64))
        hot_hash, hot_rank, hot_salts = hot.view(np.uint64)[by_hash], len(hot) - by_hash, -(-times[by_hash] // LIST_ROWS)
        seen: set[int] = set()
        for batch in batches:
            data, ends = byte_column(batch.column(2))
            for i, j in portions(ends, PORTION):
                hashes, counts = shingle_sets(data[ends[i] : ends[j]], ends[i : j + 1] - ends[i], words, seed)
                node = set_nodes(hashes, counts)[0]
                start = np.cumsum(counts) - counts
                keep = []
                for d in np.flatnonzero(counts):
                    if (key := int(node[d])) not in seen:
                        seen.add(key)
                        keep.append(d)
                if not keep:
                    continue
                if len(hot_hash):
                    found = np.minimum(np.searchsorted(hot_hash, hashes), len(hot_hash) - 1)
                    is_hot = hot_hash[found] == hashes
                else:
                    found, is_hot = np.zeros(len(hashes), int), np.zeros(len(hashes), bool)
                key, owner, size, pos, salt = [], [], [], [], []
                for d in keep:
                    n, s = counts[d], start[d]
                    p = min(n, n - -(-percent * n // 100) + 1 + min(n // PER, MORE))
                    cold = np.flatnonzero(~is_hot[s : s + n])[:p]
                    if len(cold) < p:
                        warm = np.flatnonzero(is_hot[s : s + n])
                        warm = warm[np.argsort(hot_rank[found[s + warm]])][: p - len(cold)]
                        pick = s + np.concatenate([cold, warm])
                    else:
                        pick = s + cold
                    key.append(hashes[pick])
                    owner.append(np.full(len(pick), node[d]))
                    size.append(np.full(len(pick), n))
                    pos.append(np.arange(len(pick)))
                    salt.append(np.where(is_hot[pick], node[d].view(np.uint64) % np.maximum(1, hot_salts[found[pick]] if len(hot_hash) else 1).astype(np.uint64), 0))
                key, owner, size, pos, salt = (np.concatenate(x) for x in (key, owner, size, pos, salt))
                entry = np.empty(len(key), ENTRY)
                for name, x in (("key", key.view(np.int64)), ("node", owner), ("n", size), ("pos", pos), ("salt", salt)):
                    entry[name] = x
                bucket = (mixed(key + salt.astype(np.uint64)) % np.uint64(buckets)).astype(np.int32)
                order = np.argsort(bucket, kind="stable")
                bucket, entry = bucket[order], entry[order]
                cut = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
                blobs = [packed(entry[a:b]) for a, b in zip(cut, np.append(cut[1:], len(entry)), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(bucket[cut]), pa.array(blobs, pa.binary())], names=["bucket", "entries"])

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        hot = np.sort(np.array(frequent.value[0], np.int64)[np.array(frequent.value[1], np.int64) > LIST_ROWS])

        def out(blobs: list[bytes]) -> pa.RecordBatch:
            e = np.concatenate([unpacked(x) for x in blobs])
            e = e[np.lexsort((e["node"], e["salt"], e["key"]))]
            new = np.append(True, (e["key"][1:] != e["key"][:-1]) | (e["salt"][1:] != e["salt"][:-1]))
            again = ~new & np.append(False, e["node"][1:] == e["node"][:-1])
            e, new = e[~again], new[~again]
            group = np.cumsum(new) - 1
            many = (np.bincount(group)[group] > 1) | np.isin(e["key"], hot)
            return pa.RecordBatch.from_arrays([pa.array(e[c][many]) for c in ("key", "salt", "node", "n", "pos")], names=["key", "salt", "node", "n", "pos"])

        bucket, held = None, []
        for batch in batches:
            for own, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if own != bucket and held:
                    yield out(held)
                    held = []
                bucket = own
                held.append(blob)
        if held:
            yield out(held)

    posted = docs.mapInArrow(index, "bucket int, entries binary").repartition(parts, "bucket").sortWithinPartitions("bucket")
    shared_lists = posted.mapInArrow(lists, "key long, salt int, node long, n int, pos int")
    # A list's leader is the node most of whose prefix is in lists of several: what it has in common with
    # others is most of it, as of a text whose copies differ from it and more from one another.
    whole_prefix = F.least(F.col("n"), F.col("n") - F.ceil(F.col("n") * percent / 100) + 1 + F.least(F.floor(F.col("n") / PER), F.lit(MORE)))
    central = F.count(F.lit(1)).over(Window.partitionBy("node")) / whole_prefix
    top = F.max(F.struct("central", "node", "n")).over(Window.partitionBy("key", "salt"))
    members = write_table(shared_lists.withColumn("central", central).withColumn("top", top).select("key", "node", "n", "pos", F.col("top.node").alias("lead"), F.col("top.n").alias("lead_n")), "members")
    del posted, shared_lists
    release(spark)

    near = lambda a, b: (F.least(a, b) * 100 >= F.greatest(a, b) * percent)
    # A node is first compared with one leader at most, that of most of its lists. What else may link is left
    # to the lists that are then still of several components.
    shared = members.where("node <> lead").where(near(F.col("n"), F.col("lead_n"))).groupBy("node", "lead").agg(F.count(F.lit(1)).alias("lists"), F.first("n").alias("n"))
    stars = shared.groupBy("node").agg(F.max_by("lead", F.struct("lists", "lead")).alias("lead"), F.max("lists").alias("lists"), F.first("n").alias("n"))
    stars = stars.where(F.col("lists") * FEW >= F.col("n") * (100 - percent) / 100).select(F.col("lead").alias("a"), F.col("node").alias("b"))
    leads = members.select("key", "lead", "lead_n").distinct()
    chief = leads.groupBy("key").agg(F.min(F.struct("lead", "lead_n")).alias("top"), F.count(F.lit(1)).alias("salts")).where("salts > 1")
    bridges = leads.join(chief, "key").where(near(F.col("lead_n"), F.col("top.lead_n"))).select(F.col("top.lead").alias("a"), F.col("lead").alias("b")).where("a <> b")
    compared = stars.withColumn("star", F.lit(True)).unionByName(bridges.withColumn("star", F.lit(False)))
    first = write_table(compared.groupBy("a", "b").agg(F.max("star").alias("star")), "stars")

    def sets_of(pairs: DataFrame) -> DataFrame:
        """node and hashes of the nodes of pairs, each from the first of its documents."""
        wanted = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
        owner = nodes.where("n > 0").groupBy("node").agg(F.min("rid").alias("rid")).join(wanted, "node").select("rid")
        sets = write_table(_sets(docs.join(owner, "rid", "left_semi"), words, seed), "sets")
        release(spark)
        return sets

    sets = sets_of(first)
    answers = write_table(_overlaps(first, sets, differences=True), "answers")
    enough = F.col("both") * 100 >= percent * (F.col("na") + F.col("nb") - F.col("both"))
    led = answers.where(F.col("star") & (F.col("both") * 100 >= NEAR * (F.col("na") + F.col("nb") - F.col("both")))).select(
        F.col("a").alias("lead"), F.col("b").alias("node"), F.col("na").alias("nl"), (F.col("nb") * percent - F.col("both") * (100 + percent)).alias("short"), enough.alias("linked"), "apart"
    )
    links = write_table(answers.where(enough).select("a", "b").unionByName(_derived(led, percent, parts)), "links")
    linked = components(links)
    remove_table(sets)
    release(spark)

    placed = members.select("key", "node", "n", "pos").join(linked, "node", "left").join(led.select("node", F.col("lead").alias("guide")), "node", "left")
    placed = placed.withColumns({"comp": F.coalesce("comp", "node"), "guide": F.coalesce("guide", "node")})
    some = placed.groupBy("key").agg(F.count(F.lit(1)).alias("c"), *[f(x).alias(f"{k}_{x}") for x in ("comp", "guide") for k, f in (("least", F.min), ("most", F.max))])
    open_lists = _cells(placed.join(some.where("least_comp <> most_comp AND least_guide <> most_guide").select("key", "c"), "key"))
    open_lists = open_lists.select("key", "i", "j", "node", "n", "pos", "comp", "guide", "block").repartition(parts, "key", "i", "j").sortWithinPartitions("key", "i", "j", "n", "pos", "node")

    def open_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        def out(rows: list) -> pa.RecordBatch:
            i, j, node, n = rows[1:5]
            found = []
            for a, b in _edges(rows[:3]):
                x, y = _pairs_of([c[a:b] for c in rows[4:]], percent, 100, bool(i[a] != j[a]))
                if len(x):
                    u, v, nu, nv = node[a:b][x], node[a:b][y], n[a:b][x], n[a:b][y]
                    swap = u > v
                    found.append(np.stack([np.where(swap, v, u), np.where(swap, u, v), np.where(swap, nv, nu), np.where(swap, nu, nv)], 1))
            pairs, times = np.unique(np.concatenate(found), axis=0, return_counts=True) if found else (np.zeros((0, 4), np.int64), np.zeros(0, np.int64))
            return pa.RecordBatch.from_arrays([*(pa.array(pairs[:, k].copy()) for k in range(4)), pa.array(times)], names=["a", "b", "na", "nb", "shared"])

        yield from _streamed(batches, 3, out)

    needed = F.least(F.floor(F.least("na", "nb") / PER), F.lit(MORE)) + 1
    pairs = open_lists.mapInArrow(open_pairs, "a long, b long, na long, nb long, shared long").groupBy("a", "b", "na", "nb").agg(F.sum("shared").alias("shared"))
    pairs = write_table(pairs.where(F.col("shared") >= needed).select("a", "b"), "pairs")
    comp = linked
    if pairs.take(1):
        late = write_table(_overlaps(pairs, sets_of(pairs)).where(enough).select("a", "b"), "late")
        if late.take(1):
            of = linked.select(F.col("node").alias("x"), "comp")
            ends = late.join(of.withColumnRenamed("comp", "ca"), F.col("a") == F.col("x"), "left").drop("x").join(of.withColumnRenamed("comp", "cb"), F.col("b") == F.col("x"), "left").drop("x")
            ends = ends.select("a", "b", F.coalesce("ca", "a").alias("ca"), F.coalesce("cb", "b").alias("cb"))
            higher = components(ends, "ca", "cb").select(F.col("node").alias("comp"), F.col("comp").alias("higher"))
            known = linked.unionByName(ends.select(F.col("a").alias("node"), F.col("ca").alias("comp"))).unionByName(ends.select(F.col("b").alias("node"), F.col("cb").alias("comp"))).distinct()
            comp = write_table(known.join(higher, "comp", "left").select("node", F.coalesce("higher", "comp").alias("comp")), "comp")
    for table in (members, first, answers, links, pairs):  # what is left reads none of these
        remove_table(table)

    whole = nodes.select("rid", "id", "n", "node").join(comp, "node", "left").withColumn("group", F.coalesce("comp", "node"))
    # Written, so that the join below can split a group that holds a large part of the rows.
    least = write_table(whole.where("n > 0").groupBy("group").agg(F.min("id").alias("least")), "least")
    return whole.join(least, "group", "left").select("rid", "id", "n", "node", "group", F.when(F.col("n") > 0, F.col("least")).alias("least"))


def _derived(led: DataFrame, percent: int, parts: int) -> DataFrame:
    """Links a, b of nodes near the same leader, derived from their answers. led: lead, node, nl (the leader's
    size), short = percent * n - (100 + percent) * overlap, linked (with the leader), and apart: what
    sets the node apart, first its own elements, then those of the leader that it lacks.

    Two nodes' overlap is both overlaps with the leader, less the leader's size, and as many as their
    differences have in common. So they link where total = 100 + percent times these is at least the sum of
    both shorts and total times the leader's size. That is above 0 unless both link with the leader, so
    nodes that link otherwise share one of the first differences, as many as a bound leaves room for."""
    total = 100 + percent
    bounds = led.groupBy("lead").agg(F.min("short").alias("low"), F.min(F.when(~F.col("linked"), F.col("short"))).alias("low_open")).where(F.col("low_open").isNotNull())
    asked = F.ceil((F.col("short") + F.when(F.col("linked"), F.col("low_open")).otherwise(F.col("low")) + F.col("nl") * total) / total)
    rows = led.join(bounds, "lead").withColumn("first", F.floor(F.octet_length("apart") / 8) - F.greatest(asked, F.lit(1)) + 1).where("first > 0")

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            first = batch.column(5).to_numpy()
            apart = [np.frombuffer(x.as_buffer(), np.int64) for x in batch.column(6)]
            keys = np.concatenate([x[:n] for x, n in zip(apart, first, strict=True)]) if len(first) else np.zeros(0, np.int64)
            rest = np.concatenate([len(x) - np.arange(n) for x, n in zip(apart, first, strict=True)]) if len(first) else np.zeros(0, np.int64)
            columns = [pa.array(np.repeat(batch.column(c).to_numpy(zero_copy_only=False), first)) for c in range(5)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(keys), pa.array(rest)], names=["lead", "node", "nl", "short", "linked", "key", "rest"])

    kinds = "lead long, node long, nl long, short long, linked boolean, key long, rest long"
    entries = rows.select("lead", "node", "nl", "short", "linked", "first", "apart").mapInArrow(index, kinds)
    of = Window.partitionBy("lead", "key")
    lists = entries.withColumns({"c": F.count(F.lit(1)).over(of), "open": F.max((~F.col("linked")).cast("int")).over(of)}).where("c > 1 AND open = 1")
    cells = _cells(lists).select("lead", "key", "i", "j", "node", "nl", "short", F.col("linked").cast("int").alias("linked"), "rest", "block")
    cells = cells.repartition(parts, "lead", "key", "i", "j").sortWithinPartitions("lead", "key", "i", "j", "node")

    def near_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        def out(rows: list) -> pa.RecordBatch:
            lead, _, i, j, node, nl, short, linked, rest, block = rows
            found = [np.zeros((0, 3), np.int64)]
            for a, b in _edges(rows[:4]):
                for x in range(a + 1, b):
                    y = np.arange(a, x)
                    # Of the elements that a pair shares, the first leaves room for all that are asked for.
                    ok = ((linked[y] == 0) | (linked[x] == 0)) & (np.minimum(rest[y], rest[x]) * total >= short[y] + short[x] + nl[x] * total)
                    if i[a] != j[a]:
                        ok &= block[y] != block[x]
                    y = y[ok]
                    found.append(np.stack([np.full(len(y), lead[a]), node[y], np.full(len(y), node[x])], 1))
            pairs = np.unique(np.concatenate(found), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, k].copy()) for k in range(3)], names=["lead", "a", "b"])

        yield from _streamed(batches, 4, out)

    pairs = cells.mapInArrow(near_pairs, "lead long, a long, b long").distinct()
    x, y = (led.select(F.col("node").alias(k), "nl", F.col("short").alias(f"s{k}"), F.col("apart").alias(f"d{k}")) for k in "ab")
    both = pairs.join(y.drop("nl"), "b").join(x, "a").select("a", "b", "nl", "sa", "sb", "da", "db")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            common = np.array([_common(u, v) for u, v in zip(batch.column(5), batch.column(6), strict=True)], np.int64)
            nl, sa, sb = (batch.column(c).to_numpy() for c in (2, 3, 4))
            yield batch.select([0, 1]).filter(pa.array(common * total >= sa + sb + nl * total))

    return both.mapInArrow(compare, "a long, b long")


def _common(x, y) -> int:  # noqa: ANN001
    """How many 8-byte elements two binary values share; neither repeats one."""
    import numpy as np

    both = np.sort(np.concatenate([np.frombuffer(z.as_buffer(), np.uint64) for z in (x, y)]), kind="stable")
    return int((both[1:] == both[:-1]).sum())


def _sets(docs: DataFrame, words: int, seed: int) -> DataFrame:
    """node and its sorted hashes as bytes, for documents (id, data)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            data, ends = byte_column(batch.column(0))
            for i, j in portions(ends, PORTION):
                hashes, counts = shingle_sets(data[ends[i] : ends[j]], ends[i : j + 1] - ends[i], words, seed)
                node, stop = set_nodes(hashes, counts)[0], np.cumsum(counts)
                keep = np.unique(node, return_index=True)[1]
                keep = keep[counts[keep] > 0]
                yield pa.RecordBatch.from_arrays([pa.array(node[keep]), pa.array([hashes[b - n : b].tobytes() for b, n in zip(stop[keep], counts[keep], strict=True)], pa.binary())], names=["node", "hashes"])

    return docs.select("data").mapInArrow(run, "node long, hashes binary")


def _overlaps(pairs: DataFrame, sets: DataFrame, differences: bool = False) -> DataFrame:
    """The columns of pairs (a, b of nodes among them), na, nb and both (the intersection's size); with
    differences also `apart`: the elements of b that a lacks, then marks of those of a that b lacks, each
    in order of hash."""
    own = [c for c in pairs.columns if c not in "ab"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            out, apart = [], []
            for x, y in zip(batch.column(batch.num_columns - 2), batch.column(batch.num_columns - 1), strict=True):
                u, v = (np.frombuffer(z.as_buffer(), np.uint64) for z in (x, y))
                if differences:
                    more, less = (p[q[np.minimum(np.searchsorted(q, p), len(q) - 1)] != p] for p, q in ((v, u), (u, v)))
                    out.append((len(u), len(v), len(v) - len(more)))
                    apart.append(np.concatenate([more, mixed(less, 77)]).tobytes())
                else:
                    out.append((len(u), len(v), _common(x, y)))
            sizes = np.array(out, np.int64).reshape(-1, 3)
            columns = [*batch.columns[:-2], *(pa.array(sizes[:, k].copy()) for k in range(3)), *([pa.array(apart, pa.binary())] if differences else [])]
            yield pa.RecordBatch.from_arrays(columns, names=["a", "b", *own, "na", "nb", "both", *(["apart"] if differences else [])])

    x, y = (sets.select(F.col("node").alias(k), F.col("hashes").alias(f"h{k}")) for k in "ab")
    rows = pairs.join(y, "b").join(x, "a").select("a", "b", *own, "ha", "hb")
    kinds = ", ".join(f"{c} {dict(pairs.dtypes)[c]}" for c in ["a", "b", *own])
    return rows.mapInArrow(run, f"{kinds}, na long, nb long, both long" + (", apart binary" if differences else ""))


def keep_one_of_near(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row of each component, that with the smallest id (of rows that repeat it, the first), and all rows
    with empty sets; the columns of df. An empty table gives an empty result."""
    rows = stable(df, F.struct(*[F.col(c) for c in df.columns]).alias("row"))
    own = lambda c: F.col("row")[c]
    joined = _joined(rows.select("rid", own(id_col).alias("id"), F.coalesce(own(text_col), F.lit("")).cast("binary").alias("data")), words, percent)
    kept = joined.where("n > 0").groupBy("group").agg(F.min(F.struct("id", "rid")).alias("first")).select("first.rid").unionByName(joined.where("n = 0").select("rid"))
    return rows.join(kept, "rid", "left_semi").select("row.*")
