"""Batches of queries over the segments of a shard, and how vectors and queries are dealt out."""

import time

import numpy as np

from tidewright.llm import topk_search


def unit(rng, n, d=64):
    x = rng.normal(size=(n, d))
    return np.floor(256 * x / np.linalg.norm(x, axis=1)[:, None])


def brute(x, ids, qs, asked, k):
    found = []
    for i, q in enumerate(qs):
        scores = [max(-(2**63), min(2**63 - 1, sum(int(a) * int(b) for a, b in zip(v, q, strict=True)))) for v in x.tolist()]
        found += [(i, d, -s) for s, d in sorted((-s, d) for s, d in zip(scores, ids.tolist(), strict=True) if d != asked[i])[:k]]
    return found


def test_batches_equal_brute_force():
    rng = np.random.default_rng(3)
    for scale, spread in ((1, 0), (200, 0), (200, 1.5), (3e5, 0), (3e7, 2), (1e40, 0)):
        x = np.floor(scale * rng.normal(size=(2500, 3)) * np.exp(rng.normal(0, spread, (2500, 1))))
        x[rng.random(2500) < 0.4] = x[0]  # many ties
        ids, asked = rng.integers(0, 2000, 2500), rng.integers(0, 2000, 8)
        index = topk_search.Index(x, ids)
        qs = x[:8]
        query, row, score = index.best(qs, asked, 5)
        got = sorted(zip(query.tolist(), (-score.astype(object)).tolist(), ids[row].tolist(), strict=True))
        assert [(i, d, -s) for i, s, d in got] == brute(x, ids, qs, asked, 5)


def test_short_vectors_are_left_out():
    """All queries together end before the segments whose impact is too small for any of them."""
    rng = np.random.default_rng(5)
    x = unit(rng, 30_000)
    x[3000:] = np.floor(x[3000:] / 16)
    index = topk_search.Index(x)
    index.best(x[:200], np.arange(200), 5)
    assert index.products < 200 * 30_000 / 4


def test_queries_are_scored_together():
    rng = np.random.default_rng(6)
    x, began = unit(rng, 40_000), time.time()
    index = topk_search.Index(x)
    query, row, score = index.best(x[::100], np.arange(0, 40_000, 100), 5)
    assert time.time() - began < 15 and len(query) == 2000  # over a minute one by one
    at = query == 7
    other = np.arange(40_000) != 700
    assert score[at].tolist() == np.sort((x @ x[700])[other])[::-1][:5].astype(int).tolist()


def test_what_is_read_again_is_bounded():
    for n, most in ((50_000, 2), (700_000, 3), (15_000_000, 5)):
        shards, groups = topk_search.layout(n, n // 50, 64)
        assert n * groups + n // 50 * shards <= most * n
    assert topk_search.layout(50_000, 1000, 64)[0] > 1  # not all in one task
    assert topk_search.layout(15_000_000, 300_000, 64)[0] * 262_144 >= 15_000_000
