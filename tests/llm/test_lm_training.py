"""Training does not depend on how the table is cut, padding teaches nothing, and scores equal a loop's."""

from __future__ import annotations

import math
import random

from pyspark.sql import functions as F

from tidewright.llm import lm_scoring

SMALL = "/root/testdata/sf0.001"


def test_scores_do_not_depend_on_partitions_and_equal_loops(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").where("doc_id < 120").cache()
    got = [{r.doc_id: r.score for r in lm_scoring.score_texts(docs.repartition(n), docs.repartition(n), head=400, dimension=6, inner=3, symbols=60, bins=6, members=200).collect()} for n in (1, 4, 16)]
    assert all(math.isclose(g[d], s, rel_tol=1e-9) for g in got[1:] for d, s in got[0].items())
    counts = lm_scoring.count_tokens(docs).cache()
    head = lm_scoring.most_frequent(counts, 400, lm_scoring.HEAD_BYTES)
    count = {bytes(r.word): r.c for r in counts.collect()}
    lexicon = lm_scoring.Lexicon(head, count[b""], sum(count.values()), len(count), symbols=60, bins=6, members=200)
    model = lm_scoring.train_model(docs, lexicon, dimension=6, inner=3).prepare()
    for d, text in docs.limit(40).collect():
        numbers, first, last, _ = lm_scoring.token_numbers([(text or "").encode()], lexicon.number)
        want = sum(model.logs(numbers)[first[0] : last[0]].tolist()) / math.log(10)
        for w in lm_scoring.words((text or "").encode()):
            if w not in lexicon.number or lexicon.symbol[lexicon.number[w]] == lm_scoring.RARE:
                want += math.log10((count[w] + 0.5) / (lexicon.rare + 0.5 * (lexicon.rare_kinds + 1)))
        assert math.isclose(got[0][d], want, rel_tol=1e-9)


def test_empty_texts_are_as_likely_as_they_are_frequent(spark):
    rng = random.Random(5)
    rows = [(i, None if i % 10 == 0 else " ".join(rng.choice("abcdefgh") for _ in range(30))) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    score = {r.doc_id: r.score for r in lm_scoring.score_texts(df, df).where("doc_id < 20").collect()}
    assert 0.05 < 10 ** score[0] < 0.2


def test_shards_leave_words_to_those_that_have_them(spark):
    """With five shards of few tokens the model still gains a part of what it gains with one."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    counts = lm_scoring.count_tokens(docs).cache()
    total, kinds = counts.agg(F.sum("c"), F.count("*")).first()
    lexicon = lm_scoring.Lexicon(lm_scoring.most_frequent(counts, 2000, lm_scoring.HEAD_BYTES), docs.count(), total, kinds, symbols=300, bins=16, members=1000)
    texts = [(r.text or "").encode() for r in docs.limit(60).collect()]
    numbers = lm_scoring.token_numbers(texts, lexicon.number)[0]
    start = lm_scoring.Model(lexicon).prepare().logs(numbers).sum()
    five, one = (lm_scoring.train_model(docs, lexicon, shard_tokens=t).prepare().logs(numbers).sum() - start for t in (total // 5, total))
    assert five > 0.2 * one > 0, (five, one)
