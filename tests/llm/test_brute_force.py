"""Queries of the text operators that SQL cannot express, against plain loops on small tables; rows that
repeat, clashing columns and very long texts."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import zlib
from collections import Counter
from fractions import Fraction

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from tidewright.llm import crf_quality, exact_dedup, language_id, mixing

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


def test_quality_query_equals_enumeration(spark, docs):
    """Every labelling of a document's lines is weighed; lines count by their length."""
    crf = crf_quality.fit_quality(docs, spark.read.parquet(f"{SMALL}/labels.parquet"))
    rng = random.Random(9)
    texts = [r.text for r in docs.select("text").collect() if r.text and r.text.count("\n") < 9][:40]
    texts += ["\n".join(rng.choice(["Plain words here", "$$ 12 %%", "", "ALL CAPS!", "a | b | c"]) for _ in range(rng.randrange(1, 8))) for _ in range(20)] + [None, "", "\n\n"]
    rows = [(i, t) for i, t in enumerate(texts)]
    got = {r.doc_id: r for r in crf_quality.score_quality(spark.createDataFrame(rows, "doc_id long, text string"), crf).collect()}
    for i, text in rows:
        bins, size, counts = crf_quality.measures([(text or "").encode()])
        emission = crf.emissions(crf.features(bins, counts))
        total, good = 0.0, [0.0] * len(emission)
        for labels in itertools.product((0, 1), repeat=len(emission)):
            weight = math.exp(sum((e if y else -e) / 2 for e, y in zip(emission, labels, strict=True)) + sum(crf.t[a, b] for a, b in zip(labels, labels[1:])))  # noqa: B905
            total += weight
            good = [g + weight * y for g, y in zip(good, labels, strict=True)]
        want = sum(g / total * n for g, n in zip(good, size, strict=True)) / sum(size)
        r = got[i]
        assert math.isclose(r.score, want, rel_tol=1e-6, abs_tol=1e-9) and r.predicted == int(r.score >= 0.7)
        assert r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2)


def test_language_query_equals_brute_force(spark, docs):
    """Dictionaries from the rows of two folds, and each text's sizes under each of them."""
    got = {r.doc_id: r for r in language_id.identify_language(docs).collect()}
    learnt = language_id.learn_dictionaries(docs.where(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) != 1))
    for r in docs.select("doc_id", "text").collect():
        if not r.text or not any(c.isalpha() for c in r.text):
            assert got[r.doc_id].lang_pred == "und"
            continue
        data, sizes = language_id.letters(r.text), {}
        for lang, dictionary in sorted(learnt.items()):
            sizes[lang] = sum(len(language_id.coder(dictionary, language_id.FRAME).compress(data[i : i + language_id.FRAME])) for i in range(0, len(data), language_id.FRAME))
        least = min(sizes.values())
        best = next(lang for lang in sorted(sizes) if sizes[lang] == least)
        odds = {lang: math.exp(-(n - least) / (0.01 * least)) for lang, n in sizes.items()}
        second = sorted(sizes.values())[1]
        assert got[r.doc_id].lang_pred == best and math.isclose(got[r.doc_id].score, 1 / sum(odds.values()), rel_tol=1e-9)
        assert got[r.doc_id].rejected == (second - least < language_id.MARGIN * least)


def test_mixing_query_equals_brute_force(spark):
    """Slot by slot, the released block with the earliest deadline, in exact fractions."""
    rng = random.Random(4)
    rows = [(i, rng.choice(["a"] * 6 + ["b"] * 2 + ["c", None])) for i in range(900)]
    rows += [(5, "a"), (5, "a"), (None, "b")]
    block = 3
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string").coalesce(1), block_docs=block).collect()
    own: dict = {}
    for i, (doc, source) in enumerate(rows):
        own.setdefault(source, []).append((hashlib.md5(f"0:{'' if doc is None else doc}".encode()).hexdigest(), (doc is not None, doc or 0), i))
    weights = {s: Fraction(len(x) ** 0.5) for s, x in own.items()}
    total, names = sum(weights.values()), sorted(own, key=lambda s: (s is not None, s or ""))
    share = {s: w / total for s, w in weights.items()}
    left, done, slot, want = {s: -(-len(x) // block) for s, x in own.items()}, dict.fromkeys(own, 0), 0, Counter()
    while any(done[s] < left[s] for s in own):
        ready = [(math.ceil((done[s] + 1) / share[s]), k, s) for k, s in enumerate(names) if math.floor(done[s] / share[s]) <= slot]
        deadline, _, s = min(ready)
        for at, (_, _, i) in enumerate(sorted(own[s])[done[s] * block : (done[s] + 1) * block]):
            want[(rows[i][0], s, done[s], math.floor(done[s] / share[s]), deadline, slot, slot * block + at)] += 1
        done[s] += 1
        slot += 1
    assert Counter((r.doc_id, r.source, r.block, r.release, r.deadline, r.slot, r.position) for r in got) == want


def test_equal_rows_and_clashing_columns(spark):
    rows = [(1, "a  b", "x"), (1, "a b", "y"), (2, "a\tb", "z"), (1, "c", "x"), (None, None, "n"), (3, "", "e"), (4, "c", "x"), (4, "c", "x")]
    df = spark.createDataFrame([(*r, 7, 8, 9, 10) for r in rows], "doc_id long, text string, source string, rid int, __id int, row int, keep int").coalesce(1)
    kept = exact_dedup.keep_one_of_equal(df)
    assert kept.columns == df.columns
    assert Counter((r.doc_id, r.text, r.source) for r in kept.collect()) == Counter([(1, "a  b", "x"), (1, "c", "x"), (None, None, "n")])
    groups = Counter((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(df).collect())
    assert groups == Counter([(1, 1, 3, True), (1, 1, 3, False), (2, 1, 3, False), (1, 1, 3, True), (None, None, 2, True), (3, None, 2, False), (4, 1, 3, False), (4, 1, 3, False)])
    order = mixing.in_mixed_order(df.withColumnRenamed("keep", "position"))
    assert order.count() == len(rows) and order.columns == df.withColumnRenamed("keep", "position").columns
    place = [r.doc_id for r in mixing.mix(df).orderBy("position").collect()]
    assert [r.doc_id for r in mixing.in_mixed_order(df).collect()] == place
    pred = language_id.predict_language(df.withColumn("score", F.lit("was")).withColumn("rejected", F.lit(1)), {"en": b"some words of a language", "xx": b"qqq zzz qqq"})
    assert dict(pred.dtypes)["score"] == "double" and pred.columns.count("rejected") == 1 and pred.count() == len(rows)


def test_stages_with_repeated_rows_long_texts_and_clashing_columns(spark):
    rng = random.Random(3)
    words = [f"{a}{b}" for a in ("ba", "le", "mi", "sto", "wer", "den") for b in ("nd", "s", "ten", "ra", "lig", "kum")]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    long, text = prose(60_000), prose(80)
    rows = [(1, long, "en", "s", 1), (1, long, "en", "s", 1), (2, text, "en", "s", 1), (2, text, "en", "s", 1), (3, text + " more", "en", "t", 1), (4, prose(50), "en", None, None), (5, None, None, None, None), (6, "", "en", "s", 0), (None, prose(60), "en", "t", 1)]
    docs = spark.createDataFrame(rows, DOCS).withColumns({"rid": F.lit(1), "row": F.lit("r"), "node": F.lit(2), "position": F.lit(3), "token_ids": F.lit("t")})
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        columns, docs = docs.columns, stage(spark, docs, SMALL)
        assert k == len(corpus_pipeline.STAGES) - 1 or docs.columns == columns
    got = docs.select("doc_id", "lossless").collect()
    assert sorted((r.doc_id is not None, r.doc_id or 0) for r in got) == [(False, 0), (True, 1), (True, 2), (True, 4)] and all(r.lossless for r in got)
