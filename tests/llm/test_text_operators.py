"""The text operators against brute force, exact round trips and held-out accuracy on small tables, and
with nulls, empty and long texts, ties, repeated rows, empty tables and clashing extra columns."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tidewright.llm import crf_quality, exact_dedup, jaccard_join, language_id, lm_scoring, mixing, sentencepiece_codec, suffix_dedup, topk_search, warc
from tidewright.llm.components import components
from tidewright.llm.queries import piece_model

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SPACE = re.compile(r"[\x20\x09-\x0D]+")


def prose(rng, n, words=200):
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


def odd_rows():
    """Nulls in every column, empty, blank, very long and repeated texts and rows."""
    rng = random.Random(5)
    long = prose(rng, 9000, 4000)
    shared = prose(rng, 120)
    texts = [None, "", " \n\t ", "one", "One  word", "a b c d e", "A b c d e f", long, long, long + " end", shared, shared + " x", "z " + shared, "é ▁ ▁x\ny", "a" * 1500, "ab" * 700, shared, "\x00 nul \x00", "日本語のテキスト"]
    rows = [(i, t, None if i % 5 == 0 else "ab"[i % 2], None if i % 4 == 0 else "st"[i % 2], None) for i, t in enumerate(texts)]
    return [*rows, rows[7], rows[10], (None, shared, None, None, None)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


def test_exact_dedup_equals_grouping(odd, none):
    for size in (16384, 16):
        got = exact_dedup.exact_dedup(odd.withColumn("rid", F.lit(1)), block_bytes=size).collect()
        groups = defaultdict(list)
        for i, t, *_ in odd_rows():
            groups[SPACE.sub(" ", t or "")].append(i)
        want = Counter((i, min(g, key=lambda x: (x is not None, x or 0)), len(g), hashlib.sha256(x.encode()).hexdigest()) for x, g in groups.items() for i in g)
        assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
        assert sum(r.kept for r in got) == len(groups)
    assert exact_dedup.exact_dedup(none).count() == 0
    kept = exact_dedup.keep_one_of_equal(odd)
    assert kept.columns == odd.columns and kept.count() == len(groups)


def shingles(text):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    words = [w for w in SPACE.split(low) if w]
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4)) if len(words) >= 5 else frozenset([tuple(words)] if words else [])


def brute_components(rows):
    sets = [shingles(t) for _, t in rows]
    comp = list(range(len(rows)))

    def root(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for x in range(len(rows)):
        for y in range(x):
            both = len(sets[x] & sets[y])
            if both and 100 * both >= 75 * (len(sets[x]) + len(sets[y]) - both):
                comp[root(x)] = root(y)
    ids = defaultdict(list)
    for x in range(len(rows)):
        ids[root(x)].append(rows[x][0])
    return Counter((rows[x][0], len(sets[x]), min((i for i in ids[root(x)]), key=lambda i: (i is None, i or 0)) if sets[x] else rows[x][0]) for x in range(len(rows)))


def test_jaccard_join_equals_brute_force(spark, odd, none, docs, monkeypatch):
    for table in (odd, docs):
        rows = [(r.doc_id, r.text) for r in table.select("doc_id", "text").collect()]
        got = jaccard_join.jaccard_join(table.withColumn("node", F.lit(1))).collect()
        assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_components(rows)
    rng = random.Random(1)
    rows, base = [], [f"v{i}" for i in range(40)]
    for i in range(250):  # overlaps near the threshold, and chains of links
        words = list(base)
        for _ in range(rng.randrange(4)):
            words[rng.randrange(40)] = f"x{rng.randrange(6)}"
        rows.append((i, " ".join(words[: rng.randrange(25, 41)])))
    monkeypatch.setattr(jaccard_join, "LIST_ROWS", 16)  # lists are dealt out by salt
    monkeypatch.setattr(jaccard_join, "CELL_ROWS", 8)
    for _ in range(120):  # sets of more than 280 shingles, whose prefixes have to share several
        words = [f"long{i}" for i in range(330)]
        for _ in range(rng.randrange(1, 14)):
            words[rng.randrange(330)] = f"x{rng.randrange(40)}"
        rows.append((len(rows), " ".join(words[: rng.randrange(290, 331)])))
    want = brute_components(rows)
    for near in (50, 101):  # answers derived from leaders', and none
        monkeypatch.setattr(jaccard_join, "NEAR", near)
        got = jaccard_join.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
        assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == want
    assert jaccard_join.jaccard_join(none).count() == 0


def test_one_of_near_stays(spark, odd):
    kept = jaccard_join.keep_one_of_near(odd)
    assert kept.columns == odd.columns
    t = " ".join(f"w{i}" for i in range(60))
    rows = [(1, t), (1, t), (2, t), (1, "u"), (3, None), (3, None), (4, t + " more"), (None, "of none but itself")]
    got = jaccard_join.keep_one_of_near(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert Counter(map(tuple, got)) == Counter([(1, t), (1, "u"), (3, None), (3, None), (None, "of none but itself")])
    clash = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "1 AS rid", "2 AS __id", "3 AS row", "4 AS node")
    kept = jaccard_join.keep_one_of_near(clash)
    assert kept.columns == clash.columns and kept.count() == 5


def test_word_sums_do_not_depend_on_pieces(monkeypatch):
    import numpy as np

    rng = random.Random(3)
    texts = ["".join(rng.choice("ab  \tC") for _ in range(rng.randrange(300))) for _ in range(20)] + ["y" * 500, "", "q"]
    data, ends = np.frombuffer("".join(texts).encode(), np.uint8), np.cumsum([0, *map(len, texts)])
    want = jaccard_join.shingle_sets(data, ends)
    for piece in (1, 7, 64):
        monkeypatch.setattr(jaccard_join, "PIECE", piece)
        got = jaccard_join.shingle_sets(data, ends)
        assert all((x == y).all() for x, y in zip(got, want, strict=True))


def test_components_follow_long_chains(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1000), (900, 950)], "a long, b long")
    got = {r.node: r.comp for r in components(links).collect()}
    assert all(got[i] == 0 for i in range(301)) and got[950] == 900


def brute_removal(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(b for b, g in zip(d, gone, strict=True) if not g)
        out.append((len(d), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return out


def test_suffix_dedup_equals_brute_force(spark, odd, none, docs):
    for table, length, gram, kinds in ((odd, 400, 32, 2048), (docs, 400, 32, 2), (docs, 60, 8, 1)):
        rows = [(r.doc_id, r.text) for r in table.select("doc_id", "text").collect()]
        got = suffix_dedup.suffix_dedup(table.withColumn("rid", F.lit(1)), length=length, gram=gram, shard_kinds=kinds, shard_bytes=20_000).collect()
        want = brute_removal([t for _, t in rows], length)
        assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == Counter((i, *w) for (i, _), w in zip(rows, want, strict=True))
    rng = random.Random(2)
    passage = prose(rng, 30)
    rows = [(i, prose(rng, 40) + passage[: rng.randrange(40, len(passage))] + prose(rng, rng.randrange(60))) for i in range(120)] + [(200, "x" * 500), (201, "xy" * 300)]
    want = brute_removal([t for _, t in rows], 50)
    for kinds in (2048, 4):
        got = suffix_dedup.suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string"), length=50, gram=8, shard_kinds=kinds, shard_bytes=9000).collect()
        assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == Counter((i, *w) for (i, _), w in zip(rows, want, strict=True))
    assert suffix_dedup.suffix_dedup(none).count() == 0


def test_suffix_dedup_where_shards_share_no_window(spark, monkeypatch):
    rng = random.Random(8)
    letters = lambda n: "".join(rng.choice("abcdefghij") for _ in range(n))
    rows = [(i, letters(60) + "a common string of 20" + letters(60)) for i in range(60)]
    monkeypatch.setattr(suffix_dedup, "MERGE_WINDOWS", 50)
    got = suffix_dedup.suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string"), length=50, gram=8, shard_kinds=1).collect()
    assert len(got) == 60 and all(r.n_removed == 0 and r.n_spans == 0 for r in got)


def test_segments_that_polynomials_confuse_are_told_apart():
    import numpy as np

    word = b"O"
    for _ in range(9):  # a Thue-Morse word of 512 bytes and its complement: equal under any polynomial modulo 2**64
        word += word.translate(bytes.maketrans(b"O^", b"^O"))
    both = np.frombuffer(word + word.translate(bytes.maketrans(b"O^", b"^O")), np.uint8)
    poly = suffix_dedup.hasher(both)
    starts, ends = np.array([0, 512]), np.array([512, 1024])
    assert len(set(poly(starts, ends).tolist())) == 1
    one, two = suffix_dedup.digests(both, starts, ends)
    assert one[0] != one[1] and two[0] != two[1]


def test_suffix_array_and_prefixes():
    import numpy as np

    rng = np.random.default_rng(0)
    for n in (1, 7, 60, 400):
        text = rng.integers(0, 3, n).astype(np.uint8)
        raw = text.tobytes()
        sa, rank = suffix_dedup.suffix_array(text)
        assert sa.tolist() == sorted(range(n), key=lambda i: raw[i:])
        shared = suffix_dedup.common_prefixes(text, sa, rank, np.array([0]), np.array([n]), 10**6)
        for x, y in zip(sa, sa[1:]):  # noqa: B905
            assert shared[y] == next((k for k in range(n) if raw[x + k : x + k + 1] != raw[y + k : y + k + 1] or y + k >= n or x + k >= n), n)


def test_sentencepiece_round_trip(spark, odd, none, docs):
    import sentencepiece

    for table in (odd.withColumn("n_tokens", F.lit("x")), docs):
        got = sentencepiece_codec.encode(table, piece_model()).collect()
        assert all(r.lossless for r in got) and len(got) == table.count()
        assert all((r.token_ids is None) == (r.text is None) for r in got)
    back = sentencepiece_codec.decode(sentencepiece_codec.encode(docs, piece_model()).withColumnRenamed("text", "was"), piece_model())
    assert back.where(~F.col("text").eqNullSafe(F.col("was"))).count() == 0
    sp = sentencepiece.SentencePieceProcessor(model_file=piece_model())
    plain = sentencepiece_codec.encode(docs, piece_model(), dropout=0.0).collect()
    assert all(list(r.token_ids) == sp.encode(r.text) for r in plain if r.text is not None)
    one, two = (sentencepiece_codec.encode(docs, piece_model(), seed=s).agg(F.sum("n_tokens")).first()[0] for s in (1, 2))
    assert one != two and one > sum(r.n_tokens for r in plain)
    assert sentencepiece_codec.encode(none, piece_model()).count() == 0


def test_title_counts_all_words_of_a_line():
    plain, junk = b"word " * 40, b"Word " * 40
    bins, _, _ = crf_quality.measures([plain + junk, plain * 2, junk + plain])
    title = bins[:, crf_quality.MEASURES.index("title")]
    assert title.tolist() == [crf_quality.BINS // 2, 0, crf_quality.BINS // 2]


def piece_codec():
    with open(piece_model(), "rb") as f:
        return sentencepiece_codec.Codec(f.read())


def dropped_by_hand(codec, text, key, dropout):
    """The pieces of a text, segment by segment and candidate by candidate, with the draws that its key gives."""
    import numpy as np

    letter = lambda c: c.isalpha()
    parts = []
    for c in " " + text if text else "":
        last = parts[-1][-1] if parts else "\n"
        if c == "\n" or last == "\n" or c == " " and last != " " or not letter(c) and c != " " and letter(last):
            parts.append(c)
        else:
            parts[-1] += c
    out = []
    for place, part in enumerate(parts):
        base = sentencepiece_codec.mixed(np.array([(key + place * sentencepiece_codec.GOLDEN) & sentencepiece_codec.MASK], np.uint64))
        draw = lambda turn, base=base: sentencepiece_codec.gaps(base, np.array([turn]), dropout)[0]
        marks = ["\ud800" if c == "\u2581" else "\u2581" if c == " " else c for c in part]
        turn, since, gone = 0, 0, set()
        while True:
            open_ = [(codec.order[a + b], i) for i, (a, b) in enumerate(zip(marks, marks[1:])) if a + b in codec.order and i not in gone]  # noqa: B905
            if not open_:
                break
            i = min(open_)[1]
            if since == draw(turn):
                turn, since = turn + 1, 0
                gone.add(i)
                continue
            since += 1
            marks[i : i + 2] = [marks[i] + marks[i + 1]]
            gone = {g - (g > i) for g in gone if g not in (i - 1, i)} - {i - 1, i}
        for m in marks:
            out += [codec.piece[m]] if m in codec.piece else [int(codec.byte[x]) for x in m.replace("\ud800", "\u2581").encode()]
    return out


def test_dropout_equals_brute_force(monkeypatch):
    codec, rng = piece_codec(), random.Random(6)
    letters = "aeinrst  \n0,.é\u2581語ß"
    texts = [" ".join(rng.choice(["responsibility", "something", "at", "x1y2", "--", "naïve", "日本", "▁"]) for _ in range(30)) for _ in range(12)]
    texts += ["".join(rng.choice(letters) for _ in range(rng.randrange(120))) for _ in range(40)] + ["", "understanding" * 9, " " * 90, "ab\x00c" * 30]
    keys = [rng.getrandbits(64) for _ in texts]
    for dropout in (0.0, 0.1, 0.6, 1.0):
        want = [dropped_by_hand(codec, t, k, dropout) for t, k in zip(texts, keys, strict=True)]
        for wide in (48, 3, 1000):  # rows in step, or an agenda for each long segment
            monkeypatch.setattr(sentencepiece_codec, "WIDE", wide)
            ids, ends = codec.encode_all(texts, keys, dropout)
            assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:])] == want  # noqa: B905
            assert codec.decode_all(ids, ends) == [t.encode() for t in texts]


def test_dropout_skips_each_candidate_of_each_segment_by_itself():
    with open(piece_model(), "rb") as f:
        model = f.read()
    codec, fresh, rng, n, places = sentencepiece_codec.Codec(model), sentencepiece_codec.Codec(model), random.Random(1), 4000, 3

    def tossed(word):
        """Candidate by candidate, a coin each."""
        marks = list(word.replace(" ", sentencepiece_codec.SPACE))
        gone = set()
        while True:
            open_ = [(codec.order[a + b], i) for i, (a, b) in enumerate(zip(marks, marks[1:])) if a + b in codec.order and i not in gone]  # noqa: B905
            if not open_:
                return tuple(codec.piece[x] for x in marks)
            i = min(open_)[1]
            if rng.random() < 0.1:
                gone.add(i)
                continue
            marks[i : i + 2] = [marks[i] + marks[i + 1]]
            gone = {g - (g > i) for g in gone if g not in (i - 1, i + 1)}

    for word in (" at", " something", " responsibility"):
        want, got, alike = Counter(tossed(word) for _ in range(n)), [Counter() for _ in range(places)], 0
        for key in range(n):
            key = (key * 0x9E3779B97F4A7C15 + 12345) & sentencepiece_codec.MASK
            ids = codec.encode((word * places)[1:], key, 0.1)
            starts = [i for i, x in enumerate(ids) if codec.bytes[x][:1] == b" "]
            own = [tuple(ids[a:b]) for a, b in zip(starts, [*starts[1:], len(ids)], strict=True)]
            for seen, x in zip(got, own, strict=True):
                seen[x] += 1
            alike += own[0] == own[1]
            if key % 40 == 0:
                assert fresh.encode((word * places)[1:], key, 0.1) == ids
        for seen in got:
            assert all(abs(seen[x] - c) / n < 0.04 for x, c in want.items())
            assert abs(len(seen) - len(want)) <= 0.4 * len(want)
        assert abs(alike / n - sum((c / n) ** 2 for c in want.values())) < 0.04
    assert len(want) > 8


def test_language_id_on_held_out_rows(odd, none, docs):
    got = language_id.identify_language(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null and lang_pred <> 'und'").collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.9 * len(got)
    rows = language_id.identify_language(odd.withColumn("score", F.lit("x"))).collect()
    assert len(rows) == len(odd_rows())
    texts = {i: t for i, t, *_ in odd_rows() if i is not None}
    for r in rows:
        if r.doc_id is not None:
            assert (r.lang_pred == "und") == (not any(c.isalpha() for c in texts[r.doc_id] or ""))
            assert 0 <= r.score <= 1 and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
    assert language_id.identify_language(none).count() == 0
    assert language_id.keep_known_language(odd).columns == odd.columns


def test_mixing_keeps_every_source_within_one_block(spark, odd, none):
    counts = {"a": 500, "b": 40, "c": 160, None: 7}
    rows = [(i, s) for i, s in enumerate(x for x, n in counts.items() for _ in range(n))]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string"), block_docs=4, period=50).collect()
    assert len(got) == len(rows) and len({r.position for r in got}) == len(rows)
    shares = mixing.whole_shares({s: n**0.5 for s, n in counts.items()}, 50)
    assert sum(shares.values()) == 50
    blocks = {(r.source, r.block): r for r in got}
    assert all(r.release <= r.slot < r.deadline for r in blocks.values())
    assert len({r.slot for r in blocks.values()}) == len(blocks)
    period = mixing.pfair_period(shares)
    for slot in range(1, 51):
        for s, w in shares.items():
            assert abs(sum(1 for x in period[:slot] if x[0] == s) - w * slot / 50) < 1
    assert mixing.mix(none).count() == 0
    assert mixing.mix(odd).count() == len(odd_rows())
    order = mixing.in_mixed_order(odd)
    assert order.columns == odd.columns and order.count() >= len({r[0] for r in odd_rows()})


def test_mixing_keeps_exact_weights_for_ever(spark):
    rng = random.Random(2)
    for n, most in ((2, 10), (7, 10), (40, 10), (40, 10**6), (300, 10**6)):
        shares = list(mixing.exact_shares({i: rng.choice([1, 3, rng.randrange(1, most) ** 0.5]) for i in range(n)}).values())
        assert most > 10 or mixing.lead(shares) < 300
        whole = list(mixing.pfair_slots(shares, 0, 6000))
        assert all(j * sum(shares) // shares[i] <= slot < -(-(j + 1) * sum(shares) // shares[i]) for slot, i, j in whole)
        for start in (1, 77, 1500, 4999):
            assert list(mixing.pfair_slots(shares, start, start + 900)) == whole[start : start + 900]
    # 20 sources, one with a third of the rows: over 1.5 periods of 1000 slots, against the target weights.
    counts = {"big": 950, **{f"s{i:02}": 100 for i in range(19)}}
    # 1100 sources of unlike sizes
    many = {f"m{i:04}": 1 + 8 * (i % 2) for i in range(1100)}
    for sizes, how in ((counts, {"block_docs": 1}), (many, {"block_docs": 1, "temperature": 1.0}), ({"a": 1500, "b": 900, None: 3}, {"block_docs": 1, "weights": {"a": 5, "b": 3.3}})):
        rows = spark.createDataFrame([(i, s) for i, s in enumerate(s for s, n in sizes.items() for _ in range(n))], "doc_id long, source string")
        got = mixing.mix(rows, **how).collect()
        assert len(got) == len({r.slot for r in got}) == sum(sizes.values())
        weights = {s: how["weights"].get(s, 3.3) if "weights" in how else n ** how.get("temperature", 0.5) for s, n in sizes.items()}
        for s, w in weights.items():
            w /= sum(weights.values())
            slots = sorted(r.slot for r in got if r.source == s)
            # Just before and just after its block j a source has had j and j + 1.
            assert all(abs(j - w * t) < 1 and abs(j + 1 - w * (t + 1)) < 1 for j, t in enumerate(slots))
    assert max(r.slot for r in mixing.mix(spark.createDataFrame([(i, s) for i, s in enumerate(s for s, n in counts.items() for _ in range(n))], "doc_id long, source string"), block_docs=1).collect()) > 1500


def test_warc_round_trip(spark, tmp_path):
    page = "<html>" + "x" * 120 + "\r\n\r\nWARC/1.0\r\n"
    rows = [(5, "http://a/1 2", page), (3, None, page), (9, "http://b", page), (1, "u", None), (2, "u", ""), (4, "u", "short"), (6, "u", "short"), (7, "ü", "é" * 60)]
    path = f"file://{tmp_path}/a"
    warc.write_warc(spark.createDataFrame(rows, "page_id long, url string, html string"), path, file_bytes=300)
    got = {r.page_id: r for r in warc.assemble(warc.read_warc(spark, path)).collect()}
    assert set(got) == {r[0] for r in rows}
    for i, _, html in rows:
        r = got[i]
        assert r.response.payload_digest == hashlib.sha256((html or "").encode()).hexdigest() and r.response.payload_bytes == len((html or "").encode())
        assert r.request is not None and r.metadata is not None
        assert (r.response.type, r.of_page_id) == (("revisit", 3) if i in (5, 9) else ("response", None))
        assert r.response.type == "revisit" or bytes(r.response.block) == (html or "").encode()
    # Rows that repeat an id or all, a long body that is in most rows, null ids, clashing columns.
    long = "<p>" * 200_000
    many = [(i, "u", long, 1, 2) for i in range(40)] + [(3, "u", long, 1, 2), (50, "u", "z" * 100, 1, 2), (50, "u", "z" * 100, 1, 2), (None, "u", "q" * 100, 1, 2), (7, "u", "q" * 100, 1, 2)]
    warc.write_warc(spark.createDataFrame(many, "page_id long, url string, html string, rid int, digest int"), f"file://{tmp_path}/c")
    got = Counter((r.page_id, r.response.type, r.of_page_id, r.response.payload_bytes) for r in warc.assemble(warc.read_warc(spark, f"file://{tmp_path}/c", blocks=False)).collect())
    want = Counter({(i, "revisit", 0, 600_000): 1 for i in range(1, 40)}) + Counter([(0, "response", None, 600_000), (3, "revisit", 0, 600_000), (50, "response", None, 100), (50, "revisit", 50, 100), (None, "response", None, 100), (7, "revisit", None, 100)])
    assert got == want
    empty = f"file://{tmp_path}/b"
    warc.write_warc(spark.createDataFrame([], "page_id long, url string, html string"), empty)
    assert warc.assemble(warc.read_warc(spark, empty)).count() == 0


def test_lm_scores(spark, odd, none, docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    train = [t for i, t in rows if zlib.crc32(str(i).encode()) % 5 != 1]
    count = Counter()
    for t in train:
        count.update([*lm_scoring.words((t or "").encode()), None])
    n, v = sum(count.values()), len(count)
    got = {r.doc_id: r for r in lm_scoring.score_documents(docs, head=300).collect()}  # most words are looked up
    for i, t in rows:
        own = [*lm_scoring.words((t or "").encode()), None]
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(own), sum(count[w] > 0 for w in own), n)
        assert math.isclose(r.base_score, sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in own), rel_tol=1e-9)
    held = lm_scoring.score_documents(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where("held_out").collect()
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    rows = lm_scoring.score_documents(odd.withColumn("n", F.lit(1)), symbols=8, bins=3, members=20, dimension=4).collect()
    assert len(rows) == len(odd_rows()) and all(math.isfinite(r.score) for r in rows)
    assert lm_scoring.score_documents(none).count() == 0


def test_lm_score_equals_brute_force(spark, docs):
    """Every token's probability by sums over all symbols, and over all words of its bin."""
    import numpy as np

    small, sizes = docs.limit(40), {"symbols": 30, "bins": 5, "members": 60}
    texts = [(r.doc_id, (r.text or "").encode()) for r in small.collect()]
    counts = lm_scoring.count_tokens(small).cache()
    total, kinds, ends = counts.agg(F.sum("c")).first()[0], counts.count(), len(texts)
    head = lm_scoring.most_frequent(counts, 150, 10_000)
    assert 85 < len(head) <= 150 and head == sorted(head, key=lambda r: (-r[1], r[0]))
    lexicon = lm_scoring.Lexicon(head, ends, total, kinds, **sizes)
    model = lm_scoring.train_model(small.repartition(3), lexicon, dimension=5, inner=3)
    assert not np.allclose(model.outer.q, lm_scoring.LogBilinear(lexicon.noise, 5).q) and not np.allclose(model.within.v, lm_scoring.Within(lexicon, 3).v)
    model.prepare()
    count = {bytes(r.word): r.c for r in counts.collect()}
    o, w = model.outer, model.within
    symbol = lambda word: lm_scoring.END if word is None else int(lexicon.symbol[lexicon.number[word]]) if word in lexicon.number else lm_scoring.RARE
    got, _, last, _ = lm_scoring.token_numbers([t for _, t in texts[:6]], lexicon.number)
    logs = model.logs(got)
    at = 0
    for _, text in texts[:6]:
        own = [None, None, *lm_scoring.words(text), None]
        for a, b, c in zip(own, own[1:], own[2:]):  # noqa: B905
            guess = o.r[symbol(b)] * o.place[0] + o.r[symbol(a)] * o.place[1]
            every = np.exp(o.q @ guess + o.b)
            want = math.log(every[symbol(c)] / every.sum())
            m = int(lexicon.member[lexicon.number[c]]) if c in lexicon.number else -1
            if m >= 0:
                k = lexicon.bin_of[m]
                like = [j for j in range(len(w.v)) if lexicon.bin_of[j] == k]
                inner = {j: math.exp(w.v[j] @ w.u[symbol(b)] + w.b[j]) for j in like}
                want += math.log(inner[m] / sum(inner.values()))
            assert math.isclose(logs[at + 2], want, rel_tol=1e-6, abs_tol=1e-9)
            at += 1
        at += 2
    # The rare words' share is spread over them, and what is left is that of one word never seen.
    rare = [c for x, c in count.items() if x and symbol(x) == lm_scoring.RARE]
    assert lexicon.rare == sum(rare) and lexicon.rare_kinds == len(rare)
    assert math.isclose(sum((c + 0.5) / (lexicon.rare + 0.5 * (len(rare) + 1)) for c in [*rare, 0]), 1.0)


def test_log_bilinear_model_is_normalised():
    import numpy as np

    model = lm_scoring.LogBilinear(np.array([0.1, 0.2, 0.3, 0.4]), 5, seed=3)
    model.train(np.random.default_rng(0).integers(0, 4, 500), 1)
    one, two, z = model.tables()
    total = np.exp(one[:, None, :] + two[None, :, :] - z[:, :, None]).sum(2)
    assert np.allclose(total, 1)


def test_topk_equals_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(4)
    for scale in (1.0, 0.01):  # many ties at the small scale
        rows = [(i, [float(x) for x in rng.normal(0, scale, 6)]) for i in range(700)]
        rows += [(800, None), (850, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (900, [float("nan")] * 6), (950, [float("inf")] * 6), (1000, []), (rows[50][0], rows[51][1]), rows[3]]
        df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
        got = Counter(tuple(r) for r in topk_search.search(df, df.where("vec_id % 50 = 0")).select("query_id", "rank", "vec_id", "score").collect())
        good = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
        asked = {}
        for i, v in sorted(((i, [float(np.float32(x)) for x in v]) for i, v in rows if i % 50 == 0 and v is not None and all(x is not None and math.isfinite(x) for x in v)), reverse=True):
            asked[i] = [math.floor(256 * x) for x in v]
        want = Counter()
        for q, e in asked.items():
            best = sorted((-sum(a * b for a, b in zip(e, v)), i) for i, v in good if i != q)[:5]  # noqa: B905
            want.update((q, k + 1, i, -s) for k, (s, i) in enumerate(best))
        assert got == want
    few = spark.createDataFrame([(50, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in topk_search.search(few, few.where("vec_id = 50")).collect()] == [(50, 1, 1, 131072)]
    none = few.where("false")
    assert topk_search.search(none, none).count() == 0
    # Components beyond the doubles when scaled, scores beyond long, and columns named like the operator's own.
    huge = spark.createDataFrame([(50, [1e307, 1.0], 7, 8), (1, [1e307, 0.0], 7, 8), (2, [-1e307, 0.0], 7, 8), (3, [0.0, 2.0], 7, 8)], "vec_id long, embedding array<double>, id int, shard int")
    got = [tuple(r) for r in topk_search.search(huge, huge.where("vec_id = 50")).orderBy("rank").collect()]
    assert got == [(50, 1, 1, 2**63 - 1), (50, 2, 3, 131072), (50, 3, 2, -(2**63))]


def test_topk_over_many_shards_and_groups(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(topk_search, "SHARD_ROWS", 64)
    monkeypatch.setattr(topk_search, "GROUP_QUERIES", 5)
    x = np.random.default_rng(5).normal(size=(600, 4)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(7)
    whole = np.floor(256 * x.astype(float)).astype(int)
    want = Counter()
    for q in range(0, 600, 50):
        best = sorted((-int(whole[q] @ v), i) for i, v in enumerate(whole) if i != q)[:5]
        want.update((q, k + 1, i, -s) for k, (s, i) in enumerate(best))
    assert Counter(map(tuple, topk_search.search(df, df.where("vec_id % 50 = 0")).collect())) == want


def test_impact_order_stops_early():
    import numpy as np

    rng = np.random.default_rng(0)
    x = np.floor(256 * rng.normal(size=(20000, 16)))
    index = topk_search.Index(x)
    q = x[17]
    rows = index.candidates(q, 6)
    assert set(np.argsort(-(x @ q), kind="stable")[:6]) <= set(rows.tolist()) and len(rows) < 5000


def test_quality_on_held_out_rows(spark, odd, none):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    crf = crf_quality.fit_quality(docs, labels)
    got = crf_quality.score_quality(docs, crf).join(labels, "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.quality for r in got) > 0.8 * len(got)
    rows = crf_quality.score_quality(odd.withColumn("score", F.lit("x")), crf).collect()
    assert len(rows) == len(odd_rows()) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    assert crf_quality.score_quality(none, crf).count() == 0
    empty = crf_quality.fit_quality(none, labels.where("false"))
    assert {r.score for r in crf_quality.score_quality(odd, empty).collect()} == {0.5}


def test_crf_marginals_equal_enumeration():
    import itertools

    import numpy as np

    crf = crf_quality.LineCRF(t=np.array([[0.3, -0.2], [0.1, 0.7]]))
    emission, counts = np.array([0.5, -1.0, 2.0, 0.1, -0.4]), np.array([3, 2])
    good, pairs, _ = crf.marginals(emission, counts)
    want, both = [], np.zeros((2, 2))
    for e in (emission[:3], emission[3:]):
        weights = {y: math.exp(sum(e[i] * y[i] for i in range(len(e))) + sum(crf.t[a, b] for a, b in zip(y, y[1:]))) for y in itertools.product((0, 1), repeat=len(e))}  # noqa: B905
        total = sum(weights.values())
        want += [sum(w for y, w in weights.items() if y[i]) / total for i in range(len(e))]
        for y, w in weights.items():
            for a, b in zip(y, y[1:]):  # noqa: B905
                both[a, b] += w / total
    assert np.allclose(good, want) and np.allclose(pairs, both)
