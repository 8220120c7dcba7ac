"""Operators 11 to 13 against plain loops, and with nulls, empty and very long texts, ties, repeated rows,
empty tables and clashing columns."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidewright.llm import prefix_trie, simhash_join, whitening
from tidewright.llm.queries import OP11_SQL

TURNS = "conv_id long, turn long, role string, text string"
VECTORS = "vec_id long, embedding array<float>"


def turn_rows():
    """Shared beginnings at every depth, whole conversations that repeat, nulls everywhere, a long one."""
    rng = random.Random(4)
    rows = []
    for c in [*range(-120, 260), 300, 417, 500, 901]:
        if c % 9 == 0:
            turns = [("user", "hot"), ("bot", "hot too")] + [("user", f"x{rng.randrange(3)}") for _ in range(rng.randrange(4))]
        else:
            turns = [(rng.choice(["user", None, ""]), rng.choice(["a", "b", None, "", "é日本"])) for _ in range(rng.randrange(1, 8))]
        rows += [(c, rng.choice([k, k]), r, t) for k, (r, t) in enumerate(turns)]
    rows += [(77, None, "user", "null turn"), (78, 1, "user", "tie"), (78, 1, "bot", "tie"), (78, 1, "bot", "tie"), (None, 0, "user", "no id")]
    rows += [(700 + k, t, "u", "path") for k in range(3) for t in range(400)] + [(703, 0, "u", "long " * 100_000)]
    return rows


def trie_by_loops(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            convs[c].append((turn is not None, turn or 0, digest, (role, text)))
    own = {c: [t[-1] for t in sorted(ts)] for c, ts in convs.items()}
    paths = {}
    for c, ts in own.items():
        h, rest = zlib.crc32(str(c).encode()) % 6, abs(c) % 100
        paths[c] = tuple(own.get(c - (rest if c >= 0 else -rest), [])[:h] + ts[h:])
    members, ends, kids = defaultdict(list), defaultdict(list), defaultdict(set)
    for c, p in paths.items():
        ends[p].append(c)
        for d in range(len(p) + 1):
            members[p[:d]].append(c)
            if d:
                kids[p[: d - 1]].add(p[:d])
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in kids[p]) or 1
        saved[p] = sum(saved[k] for k in kids[p]) + (len(p) and (len(members[p]) - 1) * len(p[-1][1]))
    return {(min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids[p]), leaves[p], saved[p], hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()) for p, m in members.items()}


def test_trie_equals_loops(spark):
    rows = turn_rows()
    df = spark.createDataFrame(rows, TURNS).withColumn("n_convs", F.lit(1)).withColumn("sid", F.lit("x"))
    want = trie_by_loops(rows)
    for turns in (100_000, 40):
        got = prefix_trie.prefix_trie(df, turns=turns).collect()
        assert len(got) == len(want) and {tuple(r) for r in got} == want
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", [r for r in rows if r[0] is None or r[0] < 700])
    assert set(con.execute(OP11_SQL).fetchall()) == trie_by_loops([r for r in rows if r[0] is None or r[0] < 700])


def test_trie_of_nothing_and_ends(spark):
    none = spark.createDataFrame([], TURNS)
    assert prefix_trie.prefix_trie(none).collect() == []
    trie = prefix_trie.build(prefix_trie.as_rows(spark.createDataFrame([(1, 0, "u", "a"), (2, 0, "u", "a"), (3, 0, "u", "b")], TURNS)))
    at = {r.sid: r.conv_id for r in trie.nodes.where("sid IS NOT NULL").collect()}
    assert sorted((at[r.sid], r.conv_id) for r in trie.ends.collect()) == [(1, 1), (1, 2), (3, 3)]


def whitened_by_eigenvectors(rows, width):
    ids = [i for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    x = np.array([[int(np.floor(1024.0 * float(np.float32(c)))) + 100_000 for c in v] + [100_000] * (width - len(v)) for _, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)])
    n, s = len(x), x.sum(0)
    centred = (n * x - s) / n
    e, p = np.linalg.eigh(centred.T @ centred / n)
    return ids, ((n * x - s) ** 2).sum(1), centred, e[::-1], p[:, ::-1]


@pytest.mark.parametrize("partitions", [1, 7, 40])
def test_whitening_equals_eigenvectors(spark, partitions):
    rng = np.random.default_rng(8)
    scale = np.linspace(1, 0.2, 12)
    rows = [(i, [float(np.float32(c)) for c in rng.normal(0, scale)]) for i in range(500)]
    rows += [(501, None), (502, [float("nan")] * 12), (503, [None] + [1.0] * 11), (504, [float("-inf")] * 12), (505, [0.5] * 5), (506, []), (3, rows[3][1])]
    got = whitening.whiten(spark.createDataFrame(rows, VECTORS).withColumn("component", F.lit("x")).withColumn("n", F.lit(0)).repartition(partitions)).collect()
    ids, deviation, centred, e, p = whitened_by_eigenvectors(rows, 12)
    assert len(got) == 8 * len(ids) and {r.n for r in got} == {len(ids)}
    assert sorted((r.vec_id, r.deviation) for r in got if r.component == 1) == sorted(zip(ids, deviation.tolist(), strict=True))
    for k in range(8):
        own = sorted((r.vec_id, r.whitened) for r in got if r.component == k + 1)
        want = sorted(zip(ids, (centred @ p[:, k] / np.sqrt(e[k])).tolist(), strict=True))
        sign = np.sign(own[0][1] * want[0][1])
        assert np.allclose([w for _, w in own], [sign * w for _, w in want], rtol=0, atol=1e-9)
        assert all(abs(r.explained / (e[k] / e.sum()) - 1) < 1e-9 and r.identity_error < 1e-9 for r in got if r.component == k + 1)


def test_whitening_of_few_and_odd_vectors(spark):
    assert whitening.whiten(spark.createDataFrame([], VECTORS)).collect() == []
    assert whitening.whiten(spark.createDataFrame([(1, []), (2, None)], VECTORS)).collect() == []
    one = whitening.whiten(spark.createDataFrame([(None, [1.0, 2.0])], VECTORS)).collect()
    assert [(r.vec_id, r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [(None, 1, 1, 0, 0.0, 0.0, 1.0), (None, 2, 1, 0, 0.0, 0.0, 1.0)]
    flat = whitening.whiten(spark.createDataFrame([(i, [1.0, float(i), 2.0 * i]) for i in range(9)], VECTORS)).collect()
    assert [round(r.explained, 12) for r in flat if r.vec_id == 1] == [1.0, 0.0, 0.0] and all(r.whitened == 0 for r in flat if r.component > 1)
    huge = whitening.whiten(spark.createDataFrame([(1, [3e38, 1.0]), (2, [-3e38, 1.0]), (3, [0.0, 0.0])], VECTORS)).collect()
    assert len(huge) == 6 and all(np.isfinite(r.whitened) for r in huge) and {r.deviation for r in huge if r.vec_id < 3} == {2**63 - 1}


def fingerprint_by_loops(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes_by_loops(fps, most=3):
    at = list(range(len(fps)))
    changed = True
    while changed:
        changed = False
        for i in range(len(fps)):
            for j in range(i):
                if bin(fps[i] ^ fps[j]).count("1") <= most and at[i] != at[j]:
                    low, changed = min(at[i], at[j]), True
                    at = [low if a in (at[i], at[j]) else a for a in at]
    return at


def test_simhash_equals_loops(spark, monkeypatch):
    rng = random.Random(2)
    base = [" ".join(rng.choice("abcdefgh") * rng.randrange(1, 4) for _ in range(400)) for _ in range(6)]
    texts = [None, "", " \n\t", "A", "a", "É b", "é b", "one two", "ONE  two\n", "one two three", "w" * 3000]
    for b in base:
        texts += [b, b.upper(), b + " end", "start " + b] + [re.sub("^" + "[a-h]+ " * k, "", b) for k in range(1, 12)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(0, None), (None, base[0]), (None, "alone with null")]
    fps = [fingerprint_by_loops(t) for _, t in rows]
    at = classes_by_loops(fps)
    least = {c: min((i for (i, _), a in zip(rows, at, strict=True) if a == c and i is not None), default=None) for c in set(at)}
    want = sorted((str(i), f"{f:016x}", str(least[a])) for (i, _), f, a in zip(rows, fps, at, strict=True))
    assert len(set(at)) < len(set(fps)) < len(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit(1)).withColumn("fingerprint", F.lit("x"))
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in simhash_join.simhash_join(df).collect()) == want
    # Shards of few fingerprints are dealt out again and again, with the same links.
    distinct = spark.createDataFrame([(f - (f >> 63 << 64),) for f in set(fps)], "fp long")
    for shard in (2, 7):
        links = [(r.a % 2**64, r.b % 2**64) for r in simhash_join.near_links(distinct, shard=shard).collect()]
        assert all(bin(a ^ b).count("1") <= 3 for a, b in links)
        known = sorted(set(fps))
        linked = list(range(len(known)))
        for _ in known:
            for a, b in links:
                x, y = linked[known.index(a)], linked[known.index(b)]
                linked = [min(x, y) if c in (x, y) else c for c in linked]
        assert linked == classes_by_loops(known)
    assert simhash_join.simhash_join(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_simhash_of_long_texts_in_pieces(monkeypatch):
    rng = random.Random(3)
    text = " ".join(rng.choice(["alpha", "Beta", "\x0b", "g" * 40]) + str(rng.randrange(50)) for _ in range(3000))
    want = fingerprint_by_loops(text)
    for piece in (1 << 20, 1000, 7, 1):
        monkeypatch.setattr(simhash_join, "PIECE", piece)
        assert simhash_join.fingerprint(text.encode()) == want


def test_gray_index_prunes_and_loses_nothing():
    rng = np.random.default_rng(5)
    fps = rng.integers(0, 2**64, 60, dtype=np.uint64)[rng.integers(0, 60, 700)]
    for _ in range(3):
        fps ^= np.uint64(1) << rng.integers(0, 64, 700).astype(np.uint64)
    index = simhash_join.Index(np.unique(fps))
    assert (np.diff(simhash_join.gray_rank(index.fps).astype(object)) > 0).all()
    for low, high in zip(index.masks, index.masks[1:]):  # noqa: B905
        assert ((np.repeat(high, index.fan)[: len(low)] & ~low) == 0).all()
    for pairs in (1 << 14, 8):
        links = index.forest(3, pairs)
        at = classes_by_loops([int(f) for f in index.fps])
        assert len(links) == len(at) - len(set(at)) and all(at[a] == at[b] for a, b in links)
