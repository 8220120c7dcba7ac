"""Operator 1, a quality classifier: a linear-chain conditional random field over lines.

Every line is labelled good or bad. Its features are binned measures of the line itself and of the
lines before and after it; a chain weight joins the labels of neighbouring lines. Marginals by
forward-backward, weighted by line length, are averaged to the document's score.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.llm.common import split_of

#: The CRF is fitted to this many labelled documents at most, of this many characters at most
#: each: the first in order of a hash of the id.
SAMPLE_DOCS, SAMPLE_CHARS = 3000, 20_000
GOOD = 0.7
BINS = 10
MEASURES = ("letters", "upper", "digits", "marks", "signs", "high", "exclamations", "pipes", "bytes", "words", "word_length", "distinct", "repeated", "title")


def measures(docs: list[bytes]):  # noqa: ANN201
    """For all lines of docs: bins[line, measure], bytes of the line with its end, lines per doc."""
    import numpy as np

    lines, counts, more = [], [], []
    for doc in docs:
        own = doc.split(b"\n")
        seen: set[bytes] = set()
        for line in own:
            words = line.split()
            different = len(set(words))
            more.append((len(words), different, line in seen and bool(words), sum(w[:1].isupper() for w in words) / max(1, len(words))))
            seen.add(line)
        lines += own
        counts.append(len(own))
    data = np.frombuffer(b"\n".join(lines) + b"\n", np.uint8)
    size = np.array([len(x) + 1 for x in lines])
    start = np.cumsum(size) - size
    table = np.zeros((8, 256), np.uint8)
    c = np.arange(256)
    table[0] = ((c | 32) >= 97) & ((c | 32) <= 122)
    table[1] = (c >= 65) & (c <= 90)
    table[2] = (c >= 48) & (c <= 57)
    table[3] = np.isin(c, list(b".,;:?'\"()-"))
    table[4] = np.isin(c, list(b"#$%&*+/<=>@[\\]^_`{}~"))
    table[5] = c >= 128
    table[6] = c == ord("!")
    table[7] = c == ord("|")
    share = [np.add.reduceat(t[data], start, dtype=np.int64) / size for t in table]
    words, distinct, repeated, title = np.array(more, float).T
    logs = [np.log2(size) / 12, np.log2(1 + words) / 10, size / (words + 1) / 16, distinct / np.maximum(1, words), repeated, title]
    grown = [*(np.sqrt(s) if i else s for i, s in enumerate(share)), *logs]
    return np.minimum((np.stack(grown, 1) * BINS).astype(np.int32), BINS), size, np.array(counts)


class LineCRF:
    """Weights of two-label chains: w[feature] for the label good against bad, t[from, to]."""

    width = len(MEASURES) * (BINS + 2)

    def __init__(self, w=None, t=None) -> None:  # noqa: ANN001
        import numpy as np

        self.w = np.zeros(3 * self.width + 1) if w is None else w
        self.t = np.zeros((2, 2)) if t is None else t

    def features(self, bins, counts):  # noqa: ANN001, ANN201
        """Numbers of the active features of each line: own, before and after. Bin BINS + 1 stands for
        a neighbour that isn't there."""
        import numpy as np

        ends = np.cumsum(counts)
        before, after = np.roll(bins, 1, 0), np.roll(bins, -1, 0)
        before[ends - counts], after[ends - 1] = BINS + 1, BINS + 1
        base = np.arange(bins.shape[1]) * (BINS + 2)
        return np.concatenate([bins + base, before + base + self.width, after + base + 2 * self.width], 1)

    def emissions(self, features):  # noqa: ANN001, ANN201
        return self.w[features].sum(1) + self.w[-1]

    def marginals(self, emission, counts):  # noqa: ANN001, ANN201
        """Per line the probability of good, and summed over neighbours the expected pairs[from, to].

        All documents go forward in step, the longest first, so that step s works on those with
        more than s lines. Messages are normalised at each step.
        """
        import numpy as np

        ends = np.cumsum(counts)
        order = np.argsort(-counts, kind="stable")
        start, longest = (ends - counts)[order], counts[order]
        active = np.searchsorted(-longest, -np.arange(longest.max(initial=0)), side="left")
        e = np.exp(np.stack([-emission, emission], 1) / 2 - np.abs(emission)[:, None] / 2)
        step = np.exp(self.t)
        forward, backward = np.ones((len(emission), 2)), np.ones((len(emission), 2))
        message = None
        for s, n in enumerate(active):
            at = start[:n] + s
            message = e[at] if s == 0 else (message[:n] @ step) * e[at]
            message /= message.sum(1, keepdims=True)
            forward[at] = message
        for s in range(len(active) - 2, -1, -1):
            n = active[s + 1]
            at = start[:n] + s
            message = (backward[at + 1] * e[at + 1]) @ step.T
            backward[at] = message / message.sum(1, keepdims=True)
        good = forward * backward
        good /= good.sum(1, keepdims=True)
        first = np.setdiff1d(np.arange(len(emission)), ends - 1, assume_unique=True)
        pairs = forward[first][:, :, None] * step[None] * (e * backward)[first + 1][:, None, :]
        return good[:, 1], (pairs / pairs.sum((1, 2), keepdims=True)).sum(0), first

    def fit(self, docs: list[bytes], labels: list[int], rounds: int = 120, rate: float = 0.15, decay: float = 1e-4) -> LineCRF:
        """Maximum likelihood by Adam, all lines of a document having its label. Each document weighs
        the same, however many lines it has."""
        import numpy as np

        bins, _, counts = measures(docs)
        features, y = self.features(bins, counts), np.repeat(np.asarray(labels), counts)
        weight = np.repeat(1 / counts, counts) / len(docs)
        rows = np.repeat(np.arange(len(features)), features.shape[1])
        moments = [np.zeros(len(self.w) + 4) for _ in range(2)]
        for i in range(1, rounds + 1):
            good, pairs, first = self.marginals(self.emissions(features), counts)
            miss = (good - y) * weight
            grad_w = np.bincount(features.ravel(), miss[rows], len(self.w)) + decay * self.w
            grad_w[-1] = miss.sum()
            real = np.zeros((2, 2))
            np.add.at(real, (y[first], y[first + 1]), 1)
            grad_t = (pairs - real) / max(1, len(first)) + decay * self.t
            grad = np.concatenate([grad_w, grad_t.ravel()])
            moments[0] += 0.1 * (grad - moments[0])
            moments[1] += 0.01 * (grad**2 - moments[1])
            move = rate * (moments[0] / (1 - 0.9**i)) / (np.sqrt(moments[1] / (1 - 0.99**i)) + 1e-9)
            self.w -= move[:-4]
            self.t = np.clip(self.t - move[-4:].reshape(2, 2), -1.5, 1.5)
        return self

    def scores(self, docs: list[bytes]):  # noqa: ANN201
        import numpy as np

        if not docs:
            return np.zeros(0)
        bins, size, counts = measures(docs)
        good, _, _ = self.marginals(self.emissions(self.features(bins, counts)), counts)
        start = np.cumsum(counts) - counts
        return np.clip(np.add.reduceat(good * size, start) / np.add.reduceat(size, start), 0, 1)


def fit_quality(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", folds: int = 4, held: int = 2, sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS) -> LineCRF:
    """The CRF fitted to a bounded sample of labelled documents whose crc32 fold is not `held`. Null
    labels are left out; an id with several labels has their maximum. With one label or none among
    the sample, every score is that label's, or 0.5."""
    h = F.xxhash64(F.col(id_col).cast("string"), F.lit("quality"))
    some = labels.where(F.col(label_col).isNotNull() & (split_of(id_col, folds) != held)).groupBy(id_col).agg(F.max(label_col).cast("int").alias("__label"))
    some = some.orderBy(h, id_col).limit(sample_docs)
    # At most sample_docs rows of two numbers are broadcast.
    rows = df.select(F.col(id_col), F.col(text_col).alias("__text")).where(F.length("__text") <= sample_chars).join(F.broadcast(some), id_col).select("__text", "__label", h.alias("h")).orderBy("h", "__text").limit(sample_docs).collect()
    docs, y = [r["__text"].encode() for r in rows], [int(r["__label"] > 0) for r in rows]
    crf = LineCRF()
    if len(set(y)) < 2:
        crf.w[-1] = 40.0 * (2 * y[0] - 1) if y else 0.0
        return crf
    return crf.fit(docs, y)


def score_quality(df: DataFrame, crf: LineCRF, id_col: str = "doc_id", text_col: str = "text", folds: int = 4, held: int = 2, good: float = GOOD) -> DataFrame:
    """doc id, held_out, score and predicted (1 if score >= good) for each row of df. A null text is
    scored as the empty text, which is one empty line; repeated rows are scored alike. A null id is not
    held out. An empty table gives an empty result; other columns, whatever their names, are not read. Texts
    are scored whole, which takes some 340 bytes a line: a text of some million lines fits a task."""
    import numpy as np

    rows = df.select(F.col(id_col).alias("id"), F.coalesce(split_of(id_col, folds) == held, F.lit(False)).alias("held_out"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("data"))
    kind = dict(rows.dtypes)["id"]
    w, t = crf.w, crf.t

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = LineCRF(w, t)
        for batch in batches:
            docs, at = batch.column(2).to_pylist(), 0
            score = []
            while at < len(docs):  # a few MB at a time
                end, size = at, 0
                while end < len(docs) and (end == at or size + len(docs[end]) < 4_000_000):
                    size += len(docs[end])
                    end += 1
                score.append(own.scores(docs[at:end]))
                at = end
            score = np.concatenate(score) if score else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(score), pa.array((score >= good).astype(np.int32))], names=["id", "held_out", "score", "predicted"])

    return rows.mapInArrow(run, f"id {kind}, held_out boolean, score double, predicted int").withColumnRenamed("id", id_col)
